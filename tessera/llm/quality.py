"""op7: quality rules, with distribution divergence from language references.

Base rules are counts of words, symbols, repeated lines and repeated five-word windows.  The method's rule compares
each document's histograms of character classes and of common words with the reference of its language by
Jensen-Shannon distance (base 2, so from 0 to 1).  A reference is the mean histogram of all documents of the language
that pass the base rules and are long enough; without such documents a language has none and rejects nothing.
A document is rejected when one distance is far (MOST_CLASS, MOST_WORD), or both are unusual (BOTH_CLASS and
BOTH_WORD).  Guards: under MIN_CHARS or MIN_WORDS a histogram says little and the base rules judge alone; under
BOTH_WORDS words the joint limit of words grows, as BOTH_WORD (BOTH_WORDS / words)^SHORT_POWER.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import blocks as b
from .storage import lookup, materialize

# Frequent words of English, German, French and Spanish; all other words are one more bin.
COMMON = (
    "the of and to in a is that it for was on are as with his they at be this from or had by not but what all were we when your can said there an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could my than been who its now did get come made may part "
    "der die das und ist nicht ein eine zu den mit von auf für im dem sich des auch es an er so dass wir als oder aber bei nach wie nur noch werden aus um sie "
    "le la les des et est un une dans que qui pour pas sur avec ce il au du ne se plus par je son sont ou mais nous vous cette en de "
    "el los las y por con para una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante"
).split()
BINS = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
SYMBOLS = b"#*$%&|<>"
MIN_CHARS, MIN_WORDS = 200, 40
MOST_LANGS = 5_000  # references (1.6 KB each) that are broadcast; more are joined by a salted hash
MOST_CLASS, MOST_WORD = 0.35, 0.75
BOTH_CLASS, BOTH_WORD, BOTH_WORDS, SHORT_POWER = 0.13, 0.28, 100, 0.35

# Classes of bytes: lower case, upper case, digit, listed symbol, sentence mark, other ASCII mark, line end, other space, control, beyond ASCII.
CLASSES = 10
CLASS = np.full(256, 9, np.uint8)
CLASS[:32] = 8
CLASS[127] = 8
CLASS[33:127] = 5
CLASS[97:123], CLASS[65:91], CLASS[48:58] = 0, 1, 2
CLASS[list(SYMBOLS)] = 3
CLASS[list(b".,;:!?'\"()-")] = 4
CLASS[list(b" \t\v\f")] = 7
CLASS[list(b"\n\r")] = 6
COUNTED = (np.arange(256) & 0xC0) != 0x80  # a code point's first byte
SYMBOL = np.isin(np.arange(256), list(SYMBOLS))

_RAW = list(BINS)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_counted")
FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_counted long, class_n array<int>, bins array<int>, bin_n array<int>"


def _hashes_of(values: list[bytes]) -> np.ndarray:
    offs = np.append(0, np.cumsum([len(v) for v in values]))
    return b.Spans(np.frombuffer(b"".join(values), np.uint8), b.BYTE_LOWER)(offs[:-1], offs[1:])


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All counts and histograms of the documents of a block."""
    starts, ends, bounds = b.words(buf, offs)
    n = np.diff(bounds)
    spans = b.Spans(buf)
    h = spans(starts, ends)
    solid = ~b.SPACE[buf]
    counted = COUNTED[buf]
    out = {"n_words": n, "word_chars": b.per_doc(solid & counted, offs), "n_symbols": b.per_doc(SYMBOL[buf], offs), "n_counted": b.per_doc(counted, offs)}
    # words in five-word windows that a document has twice: a window's hash takes its document in
    docs = len(n)
    doc = np.repeat(np.arange(docs), n)
    grams = b.chain(h, 5)
    inside = doc[: len(grams)] == doc[4:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = b.mix(grams[at] + doc[at].astype(np.uint64) * b.COEFF[30])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + 5, -1)
    out["n_repeat_words"] = b.per_doc(np.cumsum(step[:-1]) > 0, bounds)
    # lines with a word that equal an earlier one
    cut = np.flatnonzero(buf == 10)
    first = np.unique(np.concatenate([offs[:-1], cut + 1]))
    first = first[first < len(buf)]
    line_doc = np.searchsorted(offs, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(buf)), offs[line_doc + 1])
    bare = np.where((last > first) & (buf[np.maximum(last - 1, 0)] == 10), last - 1, last)
    worded = np.append(0, np.cumsum(solid))
    ok = worded[bare] > worded[first]
    first, bare, line_doc = first[ok], bare[ok], line_doc[ok]
    key = b.mix(spans(first, bare) + line_doc.astype(np.uint64) * b.COEFF[31])
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    again[order[1:][key[order][1:] == key[order][:-1]]] = True
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=docs)
    byte_doc = np.repeat(np.arange(docs), np.diff(offs))
    out["class_n"] = np.bincount((byte_doc * CLASSES + CLASS[buf])[counted], minlength=docs * CLASSES).reshape(docs, CLASSES)
    # bare lower-case words against the list
    left = starts + (CLASS[buf[starts]] >= 3) * (CLASS[buf[starts]] <= 5) if len(starts) else starts
    right = ends - (CLASS[buf[ends - 1]] >= 3) * (CLASS[buf[ends - 1]] <= 5) if len(starts) else ends
    h = b.Spans(buf, b.BYTE_LOWER)(np.minimum(left, right), right)
    known = _hashes_of(_RAW)
    by = np.argsort(known)
    place = by[np.minimum(np.searchsorted(known[by], h), len(known) - 1)]
    bins = np.where(known[place] == h, place, len(known))
    # sparse counts: only the bins that a document has, (document, bin, count) in order
    pairs, out["bin_n"] = np.unique(doc * (len(known) + 1) + bins, return_counts=True)
    out["bins"], out["bin_at"] = pairs % (len(known) + 1), np.searchsorted(pairs, np.arange(docs + 1) * (len(known) + 1))
    return out


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.astype(np.int32)))


def _features(carry: list[str]):
    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            for i, j, part, at in b.slices(buf, offs, 1 << 20):
                m = measure(part, at)
                made = {c: batch.column(c).slice(i, j - i) for c in carry}
                made |= {name: pa.array(m[name].astype(np.int64)) for name in COUNTS}
                made["class_n"] = _lists(m["class_n"].ravel(), np.arange(j - i + 1) * CLASSES)
                made |= {name: _lists(m[name], m["bin_at"]) for name in ("bins", "bin_n")}
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _half(p, q):
    """Sum of p log2(p / m) with m the mean of p and q."""
    return F.aggregate(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)


def jensen_shannon(p, q):
    """Distance (square root of the divergence, base 2) of two arrays of shares, from 0 to 1."""
    return F.sqrt(F.greatest(F.lit(0.0), (_half(p, q) + _half(q, p)) / 2))


def sparse_jensen_shannon(bins, counts, total, q):
    """The same from sparse counts: bins (from 0) that occur and how often, their total, and all shares q.  A bin that
    doesn't occur adds q."""
    def part(i, c):
        x, y = c / total, F.element_at(q, i + 1)
        return x * F.log2(2 * x / (x + y)) + F.when(y > 0, y * F.log2(2 * y / (x + y))).otherwise(0.0) - y

    add = lambda s, x: s + x
    return F.sqrt(F.greatest(F.lit(0.0), (F.aggregate(F.zip_with(bins, counts, part), F.lit(0.0), add) + F.aggregate(q, F.lit(0.0), add)) / 2))


SCALE = 10**12  # shares are added as integers, so that a sum doesn't depend on the order of rows


def _sums(batches):
    """Of each batch and language one row a bin: the sum of its shares, and (bin -1) the number of documents."""
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False)
        n_words, n_counted = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_words", "n_counted"))
        keys, values = [lang.astype(np.int64) * WIDTH], [np.ones(len(lang), np.int64)]
        for first, bins, counts, total in ((1, None, "class_n", n_counted), (1 + CLASSES, "bins", "bin_n", n_words)):
            rows = pc.list_parent_indices(batch.column(counts)).to_numpy()
            found = pc.list_flatten(batch.column(counts)).to_numpy()
            at = pc.list_flatten(batch.column(bins)).to_numpy() if bins else np.arange(len(found)) % CLASSES
            keys.append(lang[rows].astype(np.int64) * WIDTH + first + at)
            values.append(np.round(found / total[rows] * SCALE).astype(np.int64))
        keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, np.concatenate(values))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(keys // WIDTH)), pa.array((keys % WIDTH - 1).astype(np.int32)), pa.array(sums)], names=["lang", "bin", "total"])


WIDTH = 1 + CLASSES + len(BINS) + 1


def references(found: DataFrame) -> DataFrame:
    """lang, class_ref, word_ref: the mean shares of each language's documents in found."""
    partial = found.select("lang", "n_words", "n_counted", "class_n", "bins", "bin_n").mapInArrow(_sums, "lang string, bin int, total long")
    sums = partial.groupBy("lang", "bin").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    # at most WIDTH entries a language
    by_bin = sums.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bin", "total"))).alias("m"))
    share = lambda i: F.coalesce(F.element_at("m", i).cast("double"), F.lit(0.0)) / F.element_at("m", F.lit(-1)).cast("double") / SCALE
    return by_bin.select("lang", F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), share).alias("class_ref"), F.transform(F.sequence(F.lit(CLASSES), F.lit(WIDTH - 2)), share).alias("word_ref"))


def _judge(docs: DataFrame, key: list[str], max_class: float, max_word: float) -> DataFrame:
    """docs has the columns of key, text and lang."""
    schema = StructType([*(docs.schema[c] for c in [*key, "lang"]), *StructType.fromDDL(FEATURES)])
    found = materialize(docs.mapInArrow(_features([*key, "lang"]), schema))
    found = found.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    long = (F.col("n_counted") >= MIN_CHARS) & (F.col("n_words") >= MIN_WORDS)
    far = (F.col("class_distance") > max_class) | (F.col("word_distance") > max_word)
    limit = BOTH_WORD * F.pow(BOTH_WORDS / F.least(F.greatest("n_words", F.lit(1)), F.lit(BOTH_WORDS)), F.lit(SHORT_POWER))
    odd = (F.col("class_distance") > BOTH_CLASS) & (F.col("word_distance") > limit)
    reference = materialize(references(found.filter(long & ~F.col("base_failed") & F.col("lang").isNotNull())))
    class_share = F.transform("class_n", lambda x: x / F.greatest(F.col("n_counted"), F.lit(1)))
    judged = lookup(found, reference, ["lang"], ["n_words", "n_counted", "bin_n"], "left", MOST_LANGS)
    return judged.withColumns({
        "class_distance": F.round(jensen_shannon(class_share, F.col("class_ref")), 9),
        "word_distance": F.round(sparse_jensen_shannon(F.col("bins"), F.col("bin_n"), F.greatest(F.col("n_words"), F.lit(1)), F.col("word_ref")), 9),
    }).withColumn("kept", ~F.col("base_failed") & ~(long & F.coalesce(far | odd, F.lit(False))))


def quality(docs: DataFrame, max_class: float = MOST_CLASS, max_word: float = MOST_WORD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and both distances.

    One row per input row; repeated rows and null ids keep their own.  A null or blank text has no words and fails.
    A null or unknown language has no reference and is judged by the base rules; distances are null then.  Reads
    doc_id, text and lang.  No documents: no rows.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return _judge(own, ["doc_id"], max_class, max_word).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that quality() keeps, with all their columns.  Each row has a verdict of its own, whatever its doc_id:
    rows that share one are judged apart, and rows without one stay where they pass."""
    name = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in name.items()), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    if docs.schema["text"].dataType.typeName() == "string":
        own = own.drop("text").withColumnRenamed(name["text"], "text")
        name["text"] = "text"
    return _judge(own, list(name.values()), MOST_CLASS, MOST_WORD).filter("kept").select(*(F.col(n).alias(c) for c, n in name.items()))
