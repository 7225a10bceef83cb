"""op11: the fill-in-middle transformation by a sparse checkpoint index.

A text's units are a word with the white space before it, and white space at the end.  While units are counted, in
portions of the text, every `every`-th unit's end is kept as a checkpoint (units, bytes, code points so far); all other ends
are forgotten.  A cut is then found by a binary search of the checkpoints and a scan of fewer than `every` units from there.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, SPACE, slices, texts_of

SEED, EVERY, PORTION = 42, 64, 1 << 20
#: Shares in per cent: texts that are cut, and cut texts whose suffix comes first.
CUT, SUFFIX_FIRST = 50, 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string())]
    + [("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]
)


@functools.cache
def _units(k: int) -> re.Pattern:
    return re.compile(rb"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){%d}" % k)


class Checkpoints:
    """The index of a run of documents (buf, with their offsets): units a document, and cuts after any of them."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, every: int = EVERY, portion: int = PORTION):
        self.offs, self.every, self.raw = offs, every, buf.tobytes()
        docs, n = len(offs) - 1, len(buf)
        # words and code points before each document's start, and before the end of all
        self.first, self.chars = np.zeros(docs + 1, np.int64), np.zeros(docs + 1, np.int64)
        kept, words, chars, doc = [np.zeros((3, 0), np.int64)], 0, 0, 0
        for low in range(0, n, portion):
            high = min(n, low + portion)
            solid = ~SPACE[buf[low : min(n, high + 1)]]
            end = solid[: high - low].copy()
            end[: len(solid) - 1] &= ~solid[1:]
            last = int(np.searchsorted(offs, high, "right"))
            inside = offs[doc:last]
            cut = inside[inside > low] - low - 1
            end[cut] = solid[cut]
            ends = np.flatnonzero(end) + low + 1
            count = np.zeros(high - low + 1, np.int64)
            np.cumsum((buf[low:high] & 0xC0) != 0x80, out=count[1:])
            # a document at an offset of this portion starts behind the words that end there
            self.first[doc:last] = words + np.searchsorted(ends, inside, "right")
            self.chars[doc:last] = chars + count[inside - low]
            number = words + 1 + np.arange(len(ends))
            own = np.searchsorted(offs, ends, "left") - 1
            pick = (number - self.first[own]) % every == 0
            kept.append(np.stack([number[pick], ends[pick], chars + count[ends[pick] - low]]))
            words, chars, doc = words + len(ends), chars + int(count[-1]), last
        self.first[doc:], self.chars[doc:] = words, chars
        self.number, self.place, self.at_char = np.concatenate(kept, 1)
        size = np.diff(offs)
        tail = np.zeros(docs, np.int64)
        some = size > 0
        tail[some] = SPACE[buf[offs[1:][some] - 1]]
        self.words = np.diff(self.first)
        self.units = self.words + tail

    def cut(self, doc: int, units: int) -> tuple[int, int]:
        """Byte and code point (of the whole run) at which the document's first `units` units end."""
        if units > self.words[doc]:
            return int(self.offs[doc + 1]), int(self.chars[doc + 1])
        i = int(np.searchsorted(self.number, self.first[doc] + units, "right")) - 1
        if i >= 0 and self.number[i] > self.first[doc]:
            left, at, char = units - int(self.number[i] - self.first[doc]), int(self.place[i]), int(self.at_char[i])
        else:
            left, at, char = units, int(self.offs[doc]), int(self.chars[doc])
        if left:
            end = _units(left).match(self.raw, at, int(self.offs[doc + 1])).end()
            char += _chars(self.raw[at:end])
            at = end
        return at, char


def _chars(raw: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the document's id; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def _transform(seed: int, every: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, buf, offs in slices(*texts_of(batch.column("text")), BLOCK):
                index, rows = Checkpoints(buf, offs, every), []
                for k, doc_id in enumerate(ids[low:high]):
                    text, n = index.raw[offs[k] : offs[k + 1]], int(index.units[k])
                    h = draws(seed, doc_id)
                    if not text or h[2] % 100 >= CUT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                        rows.append((doc_id, n, "plain", None, None, text))
                        continue
                    (a, a_char), (b, b_char) = (index.cut(k, u) for u in sorted((h[0] % (n + 1), h[1] % (n + 1))))
                    a, b = a - int(offs[k]), b - int(offs[k])
                    head, tail = PREFIX + text[:a], SUFFIX + text[b:]
                    spm = h[3] % 100 < SUFFIX_FIRST
                    out = (tail + head if spm else head + tail) + MIDDLE + text[a:b]
                    rows.append((doc_id, n, "spm" if spm else "psm", a_char - int(index.chars[k]), b_char - a_char, out))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return run


def transform(docs: DataFrame, seed: int = SEED, every: int = EVERY) -> DataFrame:
    """doc_id, n (units), form (plain, spm or psm), prefix_chars, middle_chars (null if plain), output (the text's form).

    One row per input row.  Null text counts as empty and stays plain; so do texts that hold a mark themselves.  A null id
    draws like an empty one, and repeated rows draw alike.  Texts longer than a block (2 MiB) are counted in portions of
    1 MiB, with the same result.  Other columns, whatever their names, are not read.  No rows give no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_transform(seed, every), RESULT)


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output: its pieces in their first order.  Marks stand only where transform() put them."""
    piece = F.split(output, "<[PSM]>", -1)
    first, second = F.when(form == "psm", piece[1]).otherwise(piece[2]), F.when(form == "psm", piece[2]).otherwise(piece[1])
    return F.when(form == "plain", output).otherwise(F.concat(first, piece[3], second))
