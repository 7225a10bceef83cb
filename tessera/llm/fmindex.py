"""op6: remove word sequences that a document with a smaller doc_id has, by compressed FM-indexes.

A shard's text is kept as the Burrows-Wheeler transform of its word numbers in a wavelet matrix: one bit vector a
level with popcount ranks.  A second wavelet matrix holds the document of each suffix, in suffix order; the suffix
array itself is only needed to build the two and isn't kept.  Backward search narrows the suffix interval of a
pattern word by word from its end; the interval's width is the pattern's number of occurrences.  For each end of a
window the length reached is the matching statistic, up to the threshold: the longest run of words ending there that
occurs twice.  Its search ends early once its interval has shrunk to one place (itself).  Where the threshold is
reached, the least document of the interval comes from the second matrix.  All ends are searched together, level by
level, in whole arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as b
from .anchored import Group, Segments, Unit, covered, removed_by_document, steps


class WaveletMatrix:
    """Rank queries on a sequence of numbers below 2^levels, one bit vector a level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.n, self.levels, self.bits, self.before, self.zeros = len(values), levels, [], [], []
        v = values.astype(np.uint32)
        for level in range(levels - 1, -1, -1):
            bit = ((v >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.zeros(-(-(self.n + 1) // 64) * 8, np.uint8)
            some = np.packbits(bit, bitorder="little")
            packed[: len(some)] = some
            word = packed.view(np.uint64)
            self.bits.append(word)
            self.before.append(np.append(0, np.cumsum(np.bitwise_count(word).astype(np.int32))[:-1]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            v = np.concatenate([v[~bit], v[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & mask).astype(np.int64)

    def rank(self, values: np.ndarray, at: np.ndarray, base: np.ndarray) -> np.ndarray:
        """How often each value occurs before each place.  base: start of the value's leaf, from leaves()."""
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (values >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at - base

    def leaves(self, values: np.ndarray) -> np.ndarray:
        at = np.zeros(len(values), np.int64)
        for level in range(self.levels):
            ones = self._ones(level, at)
            bit = (values >> (self.levels - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each interval [low, high); none may be empty."""
        found = np.zeros(len(low), np.int64)
        for level in range(self.levels):
            before, until = self._ones(level, low), self._ones(level, high)
            bit = until - before == high - low  # only ones are left
            found = found << 1 | bit
            low = np.where(bit, self.zeros[level] + before, low - before)
            high = np.where(bit, self.zeros[level] + until, high - until)
        return found


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` numbers, by doubling; singletons leave early."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:n] = text[order][1:] != text[order][:-1]
    slot = np.arange(n)
    pointer = np.zeros(n + depth, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new[:n], slot, 0)) + 1
    at = np.flatnonzero(~(new[:n] & new[1:]))
    reach = 1
    while reach < depth and len(at):
        step = min(reach, depth - reach)
        members = order[at]
        key = (pointer[members].astype(np.uint64) << np.uint64(32)) | pointer[members + step].astype(np.uint64)
        by = np.argsort(key)
        members, key = members[by], key[by]
        order[at] = members
        new = np.ones(len(members) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        pointer[members] = np.maximum.accumulate(np.where(new[:-1], at, 0)) + 1
        at = at[~(new[:-1] & new[1:])]
        reach += step
    return order


class FmIndex:
    """Of a text of numbers from 1; 0 separates.  Suffixes are sorted to `depth`, enough for patterns up to it.  document
    has each place's document, as numbers from 0 in the order of the ids."""

    def __init__(self, text: np.ndarray, document: np.ndarray, depth: int):
        places = suffix_order(text, depth)
        self.levels = max(1, int(text.max(initial=0)).bit_length())
        counts = np.bincount(text, minlength=(1 << self.levels) + 1)
        self.smaller = np.append(0, np.cumsum(counts))
        self.wavelet = WaveletMatrix(text[places - 1], self.levels)  # place 0 wraps to the last
        self.documents = WaveletMatrix(document[places], max(1, int(document.max(initial=0)).bit_length()))
        self.leaf = self.wavelet.leaves(np.arange(len(counts) - 1))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]), np.tile(self.leaf[symbol], 2))
        n, base = len(symbol), self.smaller[symbol]
        return base + both[:n], base + both[n:]

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of text[start : start + length]: reached length, and its interval.

        The search stops at the first word at which only one place is left.
        """
        last = text[starts + length - 1]
        low, high = self.smaller[last].copy(), self.smaller[last + 1].copy()
        reached = np.ones(len(starts), np.int64)
        live = np.flatnonzero(high - low > 1)
        for j in range(length - 2, -1, -1):
            if not len(live):
                break
            low[live], high[live] = self.step(text[starts[live] + j], low[live], high[live])
            reached[live] += 1
            live = live[high[live] - low[live] > 1]
        return reached, low, high


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words.  Words meet by hash and are compared byte by byte; should one
    hash stand for different words, they are numbered by their bytes."""
    _, first, number = np.unique(b.Spans(data)(starts, ends), return_index=True, return_inverse=True)
    size, like = ends - starts, first[number]
    which, step = steps(size)
    if (size == size[like]).all() and (data[starts[which] + step] == data[starts[like][which] + step]).all():
        return number
    _, number = np.unique(np.array([data[i:j].tobytes() for i, j in zip(starts, ends)], object), return_inverse=True)
    return number


def least_document(length: int):
    """Index for segments of words: the smallest doc_id that has each window."""

    def index(seg: Segments) -> np.ndarray:
        starts, ends, bounds = b.words(seg.data, seg.offs)
        if not len(starts):
            return np.zeros(0, np.int64)
        number = _numbers(seg.data, starts, ends)
        # one separator after each segment
        place = np.arange(len(starts)) + np.repeat(np.arange(len(seg.doc)), np.diff(bounds))
        text = np.zeros(len(starts) + len(seg.doc), np.int64)
        text[place] = number + 1
        ids, rank = np.unique(seg.doc, return_inverse=True)
        owner = np.repeat(rank, np.diff(bounds) + 1)
        which, step = steps(seg.n_windows)
        begin = bounds[:-1][which] + which + step
        fm = FmIndex(text, owner, length)
        # equal windows are searched once
        runs = np.zeros(len(text), np.uint64)
        got = b.chain(b.mix(text.astype(np.uint64)), length)
        runs[: len(got)] = got
        _, first, same = np.unique(runs[begin], return_index=True, return_inverse=True)
        if not all((text[begin + j] == text[begin[first][same] + j]).all() for j in range(length)):
            first = same = np.arange(len(begin))
        reached, low, high = fm.matching(text, begin[first], length)
        least = owner[begin[first]]
        wide = np.flatnonzero((reached == length) & (high - low > 1))
        least[wide] = fm.documents.least(low[wide], high[wide])
        return ids[least][same]

    return index


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(keep_text: bool):
    def cut(group: Group, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        order = np.argsort(row, kind="stable")
        row, first, last = row[order], first[order], last[order]
        at = np.searchsorted(row, np.arange(len(group.ids) + 1))
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for i in range(len(group.ids)):
            words = group.buf[group.offs[i] : group.offs[i + 1]].tobytes().split()
            n = len(words)
            if at[i] < at[i + 1]:
                gone = covered(n, first[at[i] : at[i + 1]], last[at[i] : at[i + 1]])
                words = [w for w, x in zip(words, gone.tolist()) if not x]
            kept = b" ".join(words)
            for name, v in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if keep_text else None)):
                out[name].append(v)
        return pa.table({"doc_id": group.table["doc_id"], **{k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in out.items()}})

    return cut


def remove_repeated_words(docs: DataFrame, length: int = 13, gram: int = 5, keep_text: bool = True) -> DataFrame:
    """Each document without the words covered by a run of `length` words that also starts in a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space; null unless
    keep_text).  One row per input row.  Null or blank text: no words.  A null doc_id comes after all others and is no source.  Rows with
    one doc_id are not each other's source.  No documents: no rows.
    """
    return removed_by_document(docs, Unit(True, length, gram), least_document(length), _cut(keep_text), SCHEMA)
