"""op2: near-duplicates by MinHash with banding, verified, and joined into components.

1. Every document's set of word shingles gets the minima of many universal hash functions (x -> a x + b modulo 2^64,
   a odd), grouped into bands; documents with one set share one representative from here on.
2. Within each bucket of a band all members are compared with the bucket's least one.  A pair's signatures are
   compared first; what is far below the threshold goes, all other pairs are confirmed on their full sets.
3. Confirmed links join into components.  Then, in every bucket that still holds several components, members of
   different components are compared in the same way.  A group of copies is one component by then and costs nothing.
   What is left are documents that were edited too much; their edits are shingles that no other document left has, and
   these bound what a pair can share: with r shingles that are not its own alone, a pair of sizes n and m shares at
   most the lesser r, so (100 + percent) * r >= percent * (n + m) must hold.  1024 further minima, a bit of each, are
   compared in the join itself, and a pair is taken in the first bucket that both have.  Few pairs pass.  Buckets with many such
   members are compared in cells of CELL x CELL, so no task holds more of one.
4. Components are joined anew over all links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as b
from .components import connected_components
from .storage import groups_for, keyed, lookup, materialize, merged, text_bytes

BANDS, ROWS = 26, 5
SALTS = 8  # shares of a hot bucket or set beyond the size of a broadcast
CELL = 2000  # members of a side that a task compares at once
_A = b.stream(21, 1024) | np.uint64(1)
_B = b.stream(22, 1024)
_BAND = b.stream(23, 1024)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, sorted within each, and their bounds.

    Words are of the text with A-Z lower-cased.  With fewer words than `width` the whole sequence is one shingle.
    """
    starts, ends, bounds = b.words(buf, offs)
    h = b.Spans(buf, b.BYTE_LOWER)(starts, ends)
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    grams = b.chain(h, width)
    ok = b.within(bounds, width, len(grams)) & (doc[: len(grams)] == doc[width - 1 :][: len(grams)]) if len(grams) else np.zeros(0, bool)
    values, owner = grams[ok], doc[: len(grams)][ok]
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = np.array([int(b.chain(h[bounds[i] : bounds[i + 1]], int(n[i]))[0]) for i in short], np.uint64)
        values, owner = np.concatenate([values, b.mix(whole + n[short].astype(np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def minima(values: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """(documents, hashes): least value of each hash function over each set; documents must have a shingle."""
    out = np.empty((len(bounds) - 1, hashes), np.uint64)
    # about 32 KB of shingles at a time, so that the 130 passes stay in cache
    for i, j, v, at in _chunks(values, bounds, 1 << 14):
        work = np.empty_like(v)
        for k in range(hashes):
            np.multiply(v, _A[k], out=work)
            np.add(work, _B[k], out=work)
            out[i:j, k] = np.minimum.reduceat(work, at[:-1])
    return out


def _chunks(values: np.ndarray, bounds: np.ndarray, most: int):
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, min(n, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1))
        yield i, j, values[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


SIGNED = "doc_id long, n_shingles long, print string, bands array<long>, sketch binary"


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            ids = batch.column("doc_id")
            for i, j, part, at in b.slices(buf, offs):
                values, bounds = shingle_sets(part, at, width)
                n = np.diff(bounds)
                some = np.flatnonzero(n)
                keys = np.zeros((len(n), bands), np.uint64)
                low = np.zeros((len(n), bands * rows), np.uint8)
                if len(some):
                    packed = np.append(bounds[:-1][some], bounds[-1])
                    m = minima(values, packed, bands * rows)
                    low[some] = (b.mix(m.ravel()) >> np.uint64(56)).astype(np.uint8).reshape(m.shape)
                    for k in range(bands):
                        part_of = m[:, k * rows : (k + 1) * rows]
                        keys[some, k] = b.mix((part_of * b.COEFF[:rows]).sum(1, dtype=np.uint64) + _BAND[k])
                # of the whole set, in order: equal prints are equal sets
                raw = values.tobytes()
                prints = [hashlib.blake2b(raw[8 * x : 8 * y], digest_size=16).hexdigest() if y > x else None for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                made = {
                    "doc_id": ids.slice(i, j - i).cast(pa.int64()),
                    "n_shingles": pa.array(n.astype(np.int64)),
                    "print": pa.array(prints, pa.string()),
                    "bands": pa.array([r if z else [] for r, z in zip(keys.view(np.int64).tolist(), n.tolist())], pa.list_(pa.int64())),
                    "sketch": pa.array([r.tobytes() for r in low], pa.binary()),
                }
                yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return run


def _verify(width: int, percent: int):
    """Pairs with both texts: those whose sets overlap enough."""

    def run(batches):
        for batch in batches:
            left, right = b.texts_of(batch.column("left")), b.texts_of(batch.column("right"))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, _ = shingle_sets(left[0][left[1][i] : left[1][i + 1]], left[1][i : i + 2] - left[1][i], width)
                y, _ = shingle_sets(right[0][right[1][i] : right[1][i + 1]], right[1][i : i + 2] - right[1][i], width)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = len(x) > 0 and 100 * same >= percent * (len(x) + len(y) - same)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(at), batch.column("v").filter(at)], names=["u", "v"])

    return run


def _alike(least: int):
    """Signature verification: pairs that share at least `least` of their minima (as bytes; chance ones only add)."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b.texts_of(batch.column(c))[0], np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8) for c in ("su", "sv"))
            ok = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(ok), batch.column("v").filter(ok)], names=["u", "v"])

    return run


def _full(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs confirmed on their full sets."""
    both = merged(pairs, texts.select(F.col("doc_id").alias("u"), F.col("text").alias("left")), "u")
    both = merged(both, texts.select(F.col("doc_id").alias("v"), F.col("text").alias("right")), "v")
    return both.select("u", "v", "left", "right").mapInArrow(_verify(width, percent), "u long, v long")


def _confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, width: int, percent: int, hashes: int) -> DataFrame:
    pairs = pairs.distinct()
    signed = merged(pairs, sketches.select(F.col("doc_id").alias("u"), F.col("sketch").alias("su")), "u")
    signed = merged(signed, sketches.select(F.col("doc_id").alias("v"), F.col("sketch").alias("sv")), "v")
    # six standard deviations below the threshold: misses are rarer than those of the banding
    t = percent / 100
    least = int(hashes * t - 6 * (hashes * t * (1 - t)) ** 0.5)
    close = materialize(signed.select("u", "v", "su", "sv").mapInArrow(_alike(least), "u long, v long"))
    return _full(close, texts, width, percent)


OWN = "p int, hashes binary, docs binary, several binary, of binary, sizes binary"


def _own_shingles(width: int, shards: int):
    """Shingles of a block by range, each once, with its document and whether several have it; and sets' sizes."""

    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            ids = b.ids_of(batch.column("doc_id"))
            for i, j, part, at in b.slices(buf, offs):
                values, bounds = shingle_sets(part, at, width)
                doc = np.repeat(ids[i:j], np.diff(bounds))
                order = np.argsort(values)
                values, doc = values[order], doc[order]
                first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
                several = np.diff(np.append(first, len(values))) > 1
                values, doc = values[first], doc[first]
                shard = (values >> np.uint64(32)) % np.uint64(shards)
                out = {c.split()[0]: [] for c in OWN.split(", ")}
                for k in np.unique(shard).tolist():
                    m = shard == k
                    for name, v in zip(out, (k, values[m].tobytes(), doc[m].tobytes(), several[m].tobytes(), b"", b"")):
                        out[name].append(v)
                for name, v in zip(out, (int(ids[i]) % shards, b"", b"", b"", ids[i:j].tobytes(), np.diff(bounds).tobytes())):
                    out[name].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if c == "p" else pa.binary()) for c, v in out.items()], names=list(out))

    return run


FINE = 1024


def _fine(width: int):
    """One bit of each of FINE further minima, 64 to a number: equal bits come with (1 + s) / 2 for similarity s."""

    def run(batches):
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            out = []
            for _, _, part, at in b.slices(buf, offs):
                values, bounds = shingle_sets(part, at, width)
                some = np.flatnonzero(np.diff(bounds))
                bits = np.zeros((len(bounds) - 1, FINE), np.uint8)
                if len(some):
                    low = minima(b.mix(values), np.append(bounds[:-1][some], bounds[-1]), FINE)
                    bits[some] = (b.mix(low.ravel()) >> np.uint64(63)).astype(np.uint8).reshape(low.shape)
                out += np.packbits(bits, axis=1).view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int64()))], names=["node", "fine"])

    return run


def _count_own(key, table):
    """Per document the shingles of this range that it alone has, and its set's size where it is told here."""
    get = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    values, doc, several = get("hashes", np.uint64), get("docs", np.int64), get("several", bool)
    order = np.argsort(values)
    values, doc, several = values[order], doc[order], several[order]
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    alone = new & np.append(new[1:], True)[: len(new)] & ~several
    ids, count = np.unique(doc[alone], return_counts=True)
    of, sizes = get("of", np.int64), get("sizes", np.int64)
    return pa.table({"doc_id": np.concatenate([ids, of]), "own": np.concatenate([count.astype(np.int64), np.zeros(len(of), np.int64)]), "n": np.concatenate([np.zeros(len(ids), np.int64), sizes])})


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Links: documents whose sets of `width`-word shingles have 100 * intersection >= percent * union.  component_id:
    least doc_id reachable.  kept: doc_id = component_id.  A text without words (or null) has an empty set and no
    link.  A null doc_id takes no part: component_id null, kept true.  Rows that share a doc_id are one document;
    where their texts differ, the least that has a word stands for all of them, and each row returns its own n_shingles.
    No documents: no rows.  Only doc_id and text are read.  A pair at the threshold is missed with (1 - s^rows)^bands, 2e-7 at 0.85 and 3e-5
    at 0.8 with 26 bands of 5.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialize(own.mapInArrow(_sign(width, bands, rows), SIGNED))
    some = signed.filter("print is not null and doc_id is not null")
    # where a doc_id is repeated, its least text alone stands for it from here on
    again = materialize(signed.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id"))
    if again.limit(1).count():
        worded = F.when(F.col("text").rlike("(?U)\\S"), F.col("text"))
        least_text = materialize(merged(own, again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(worded).alias("text")))
        some = merged(some, again, "doc_id", "left_anti").unionByName(materialize(least_text.mapInArrow(_sign(width, bands, rows), SIGNED)).filter("print is not null"))
        own = merged(own, again, "doc_id", "left_anti").unionByName(least_text)
    leader = materialize(some.groupBy("print").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("top")))
    shared = leader.filter("leader != top").select("print", "leader")
    exact = lookup(some.select("doc_id", "print"), shared, ["print"], ["doc_id"], salts=SALTS).filter("doc_id != leader").select(F.col("leader").alias("u"), F.col("doc_id").alias("v")).distinct()
    # one row a set; a doc_id has one row by now
    single = materialize(merged(some, leader.select(F.col("leader").alias("doc_id")), "doc_id", "left_semi"))
    members = single.select("doc_id", F.explode("bands").alias("bucket"))
    least = materialize(members.groupBy("bucket").agg(F.min("doc_id").alias("u"), F.max("doc_id").alias("top")).filter("u != top").select("bucket", "u"))
    crowded = materialize(lookup(members, least, ["bucket"], ["doc_id"], salts=SALTS).select("bucket", "u", F.col("doc_id").alias("v")))
    sketches = single.select("doc_id", "sketch")
    # the texts of both passes: of documents that share a bucket with another
    crowd = crowded.filter("u != v").select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = materialize(merged(own, crowd, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
    hashes = bands * rows
    links = materialize(_confirm(crowded.filter("u != v").select("u", "v"), sketches, texts, width, percent, hashes).unionByName(exact))
    found = connected_components(links)
    # second pass: only across components
    placed = materialize(merged(crowded.select("bucket", F.col("v").alias("node")), found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
    mixed = materialize(placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo != hi").select("bucket"))
    placed = materialize(lookup(placed, mixed, ["bucket"], ["node"], "left_semi", salts=SALTS))
    left = merged(texts, placed.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi")
    shards = groups_for(text_bytes(left), 8 << 20)
    sizes = left.mapInArrow(_own_shingles(width, shards), OWN).groupBy("p").applyInArrow(_count_own, "doc_id long, own long, n long").groupBy("doc_id").agg(F.sum("n").alias("n"), (F.sum("n") - F.sum("own")).alias("r"))
    sized = materialize(merged(placed, sizes.withColumnRenamed("doc_id", "node"), "node"))
    smallest = materialize(sized.groupBy("bucket").agg(F.min("n").alias("least_n")))
    able = lookup(sized, smallest, ["bucket"], ["node"], salts=SALTS).filter(F.expr(f"{100 + percent} * r >= {percent} * (n + least_n)")).drop("least_n")
    bands_of = single.select(F.col("doc_id").alias("node"), F.col("bands").alias("all"))
    fine = left.mapInArrow(_fine(width), "node long, fine array<long>")
    able = materialize(merged(merged(able, bands_of, "node"), fine, "node"))
    # a bucket with many members is cut into cells of CELL x CELL; its rows go to all cells of their row or column
    cuts = materialize(able.groupBy("bucket").agg(F.ceil(F.count("*") / cell).alias("cuts")).filter("cuts > 1"))
    able = lookup(able, cuts, ["bucket"], ["node"], "left", salts=SALTS)
    own = F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("cuts", F.lit(1)) - 1))
    side = lambda x, place: able.select("bucket", *place, F.col("node").alias(x), *(F.col(c).alias(f"{c[0]}{x}") for c in ("component", "n", "r", "all", "fine")))
    one, two = side("u", (own.alias("row"), every.alias("column"))), side("v", (every.alias("row"), own.alias("column")))
    # four and a half standard deviations of the bits; then a pair counts in the first bucket that both have
    p = (1 + percent / 100) / 2
    least_bits = int(FINE * p - 4.5 * (FINE * p * (1 - p)) ** 0.5)
    same_bits = " + ".join(f"64 - bit_count(fu[{k}] ^ fv[{k}])" for k in range(FINE // 64))
    first = "bucket = filter(au, x -> array_contains(av, x))[0]"
    near = F.expr(f"u < v and cu != cv and {100 + percent} * least(ru, rv) >= {percent} * (nu + nv) and {same_bits} >= {least_bits} and {first}")
    across = merged(merged(one, two, ["bucket", "row", "column"]).filter(near).select("u", "v"), crowded.select("u", "v"), ["u", "v"], "left_anti")
    more = materialize(_full(across.distinct(), texts, width, percent))
    if more.limit(1).count():
        found = connected_components(links.unionByName(more))
    return merged(signed.select("doc_id", "n_shingles"), found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicate rows, with all its columns: the one with the least doc_id, and one without
    a doc_id only where no other is there.  Rows are compared by their texts, whatever their doc_ids: repeated rows are
    reduced to one, and rows with other texts stay, though they share a doc_id or have none.  Texts without words have no
    group, and stay."""
    rows, key = keyed(docs)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    kept = merged(found, rows.select(key, "doc_id"), key).groupBy("component_id").agg(F.min(order)[key].alias(key)).select(key)
    return merged(rows, kept, key, "left_semi").select(docs.columns)
