"""Repeated windows across documents, resolved exactly in shards that hold only what can repeat.

A window is `length` consecutive units (bytes, or words) of one document.  Each window has an anchor: the
gram of `gram` units with the smallest hash in it (the leftmost of equals).  Equal windows have equal
anchors, so all copies of a window meet in the shard of their anchor.  The steps, each one exchange:

1. documents are dealt to groups by a hash of doc_id and text; a group lists its distinct anchor hashes,
   each once however often it occurs, and deals them by hash;
2. for each hash that several documents have, the groups that have it are told;
3. a group takes the windows around such anchors, settles those that repeat inside the group with an index
   of its own, and ships only each window's first document, as byte segments, to the anchor's shard: a passage
   that a third of all documents hold costs one segment a group, not one a document;
4. a shard indexes its segments, equal ones once, and finds for each window whether a smaller doc_id has it;
5. the answers go back to the groups, where documents are cut.

The index of steps 3 and 4 is a parameter: a suffix array by bucket-pointer refinement, or a compressed
FM-index.  Group and shard numbers follow the input's size, so their memory doesn't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as b
from .storage import groups_for, text_bytes

GROUP_BYTES = 4 << 20
SHARD_BYTES = 3 << 20

#: (segment bytes, segment offsets, doc_id of each segment, index of its first window, number of windows) -> for
#: all windows, segment by segment: the smallest doc_id that has it
Index = Callable[["Segments"], np.ndarray]


@dataclass
class Segments:
    """Byte strings, each with n_windows windows that start at its first units; all within one document."""

    data: np.ndarray
    offs: np.ndarray
    doc: np.ndarray
    n_windows: np.ndarray


@dataclass(frozen=True)
class Unit:
    by_word: bool
    length: int
    gram: int


class Group:
    """The documents of one group in a fixed order, with their units."""

    def __init__(self, table: pa.Table, unit: Unit):
        buf, offs = b.texts_of(table["text"])
        ids = b.ids_of(table["doc_id"])
        at = b.hashes(buf, offs)
        order = np.lexsort((at, ids))
        self.table = table.take(pa.array(order))
        self.buf, self.offs = b.texts_of(self.table["text"])
        self.ids, self.unit = ids[order], unit

    def blocks(self):
        """(first document, unit starts, unit ends, unit bounds, gram hashes, byte shift) of each block."""
        for i, j, buf, offs in b.slices(self.buf, self.offs, 1 << 20):
            if self.unit.by_word:
                starts, ends, bounds = b.words(buf, offs)
                grams = b.chain(b.Spans(buf)(starts, ends), self.unit.gram)
            else:
                starts = np.arange(len(buf))
                ends, bounds, grams = starts + 1, offs, b.Spans(buf).grams(self.unit.gram)
            yield i, j, starts, ends, bounds, grams, int(self.offs[i])

    def windows(self, bounds: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all windows of a block, and the place of each one's anchor."""
        w = self.unit.length - self.unit.gram + 1
        packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        low = (b.slide_min(packed, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.arange(len(low))
        doc_end = np.repeat(bounds[1:], np.diff(bounds))[: len(low)]
        ok = start + self.unit.length <= doc_end
        return start[ok], low[ok]


def _first_of_runs(x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    ok[1:] = x[1:] != x[:-1]
    return ok


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


ANCHORS = "p int, q int, hashes binary, several binary"


def anchors_of(unit: Unit, shards: int):
    def run(key, table):
        group, hashes, docs = Group(table, unit), [], []
        for i, _, _, _, bounds, grams, _ in group.blocks():
            _, anchor = group.windows(bounds, grams)
            anchor = anchor[_first_of_runs(anchor)]
            hashes.append(grams[anchor])
            docs.append(group.ids[i + np.searchsorted(bounds, anchor, "right") - 1])
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        d = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        part = (h >> np.uint64(32)) % np.uint64(shards)
        low = h & np.uint64(0xFFFFFFFF)
        order = np.lexsort((d, low, part))
        part, low, d = part[order], low[order], d[order]
        new = _first_of_runs(low) | _first_of_runs(part)
        at = np.flatnonzero(new)
        last = np.append(at[1:], len(d)) - 1
        several = d[at] != d[last] if len(at) else np.zeros(0, bool)
        part, low = part[at], low[at]
        cut = np.flatnonzero(_first_of_runs(part))
        end = np.append(cut[1:], len(part))
        return pa.table({
            "p": pa.array(part[cut].astype(np.int32), pa.int32()),
            "q": pa.array(np.full(len(cut), key[0].as_py(), np.int32), pa.int32()),
            "hashes": pa.array([_pack(low[x:y].astype(np.uint32)) for x, y in zip(cut, end)], pa.binary()),
            "several": pa.array([_pack(np.packbits(several[x:y])) for x, y in zip(cut, end)], pa.binary()),
        })

    return run


SHARED = "q int, p int, hashes binary"


def shared(key, table):
    """Of each group's anchor hashes in this range those that some other document has too."""
    hashes = [np.frombuffer(x.as_py(), np.uint32) for x in table["hashes"]]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8))[: len(h)].astype(bool) for x, h in zip(table["several"], hashes)]
    everything = np.concatenate(hashes)
    again = np.sort(everything)
    again = np.unique(again[1:][again[1:] == again[:-1]])
    flags = np.concatenate(several)
    if len(again):
        at = np.minimum(np.searchsorted(again, everything), len(again) - 1)
        flags |= again[at] == everything
    out, q, at = [], [], 0
    for h, group in zip(hashes, table["q"].to_pylist()):
        if (kept := h[flags[at : at + len(h)]]).size:
            out.append(_pack(kept))
            q.append(group)
        at += len(h)
    return pa.table({"q": pa.array(q, pa.int32()), "p": pa.array([key[0].as_py()] * len(q), pa.int32()), "hashes": pa.array(out, pa.binary())})


SEGMENTS = "s int, q int, row binary, doc binary, at binary, n binary, size binary, data binary, settled binary"


def _spans(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Runs of consecutive window starts of a row, as rows of (row, first, last + 1)."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1)
    cut = np.flatnonzero(new)
    return np.stack([row[cut], at[cut], at[np.append(cut[1:], len(row)) - 1] + 1], 1)


def segments_of(unit: Unit, shards: int, index: Index):
    def run(key, table, told):
        q, group = key[0].as_py(), None
        by_part = {p: np.frombuffer(h, np.uint32) for p, h in zip(told["p"].to_pylist(), told["hashes"].to_pylist())}
        if not by_part or not table.num_rows:
            return pa.table({c.split()[0]: pa.array([], pa.int32() if c.split()[1] == "int" else pa.binary()) for c in SEGMENTS.split(", ")})
        wanted = np.sort(np.concatenate([h.astype(np.uint64) | (np.uint64(p) << np.uint64(32)) for p, h in by_part.items()]))
        group = Group(table, unit)
        parts, codes, rows, ats, counts, lows, highs = [], [], [], [], [], [], []
        for i, _, starts, ends, bounds, grams, shift in group.blocks():
            start, anchor = group.windows(bounds, grams)
            if not len(start):
                continue
            cut = np.flatnonzero(_first_of_runs(anchor) | np.append(True, start[1:] != start[:-1] + 1))
            h = grams[anchor[cut]]
            part = (h >> np.uint64(32)) % np.uint64(shards)
            code = (h & np.uint64(0xFFFFFFFF)) | (part << np.uint64(32))
            found = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
            n = np.diff(np.append(cut, len(start)))[found]
            cut = cut[found]
            first = start[cut]
            doc = np.searchsorted(bounds, first, "right") - 1
            parts.append(part[found].astype(np.int64))
            codes.append(code[found].view(np.int64))
            rows.append(i + doc)
            ats.append(first - bounds[doc])
            counts.append(n)
            lows.append(starts[first] + shift)
            highs.append(ends[first + n + unit.length - 2] + shift)
        part, code, row, at, n, low, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, codes, rows, ats, counts, lows, highs))
        # anchors that several documents of this group have: what repeats here is settled here
        settled = np.zeros((0, 3), np.int64)
        keep = np.ones(len(part), bool)
        for k in _portions(part, high - low, _in_several(code, group.ids[row])):
            seg = _cut(group.buf, low[k], high[k], group.ids[row[k]], n[k])
            least = once(index, seg)
            own, (which, step) = np.repeat(seg.doc, seg.n_windows), steps(seg.n_windows)
            gone = least < own
            settled = np.concatenate([settled, _spans(row[k][which[gone]], (at[k][which] + step)[gone])])
            keep[k] = False
            keep[k[which[~gone]]] = True  # a segment with any open window goes whole
        part, row, at, n, low, high = (x[keep] for x in (part, row, at, n, low, high))
        order = np.argsort(part, kind="stable")
        part, row, at, n, low, high = (x[order] for x in (part, row, at, n, low, high))
        cut = np.flatnonzero(_first_of_runs(part))
        out = {c.split()[0]: [] for c in SEGMENTS.split(", ")}
        for x, y in zip(cut, np.append(cut[1:], len(part))):
            seg = _cut(group.buf, low[x:y], high[x:y], group.ids[row[x:y]], n[x:y])
            for name, v in zip(out, (int(part[x]), q, _planes(row[x:y], np.uint32), _planes(seg.doc, np.int64), _planes(at[x:y], np.int64), _planes(n[x:y], np.uint8), _planes((high - low - n)[x:y], np.uint32), _pack(seg.data), b"")):
                out[name].append(v)
        # what is settled travels with the rest, so that documents are cut in one place
        if len(settled):
            for name, v in zip(out, (q % shards, q, b"", b"", b"", b"", b"", b"", _pack(settled))):
                out[name].append(v)
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], pa.int32() if c.split()[1] == "int" else pa.binary()) for c in SEGMENTS.split(", ")})

    return run


def _planes(x: np.ndarray, kind) -> bytes:
    """Byte by byte of all values: leading zeros lie together and compress."""
    x = np.ascontiguousarray(x, kind)
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, len(x) // size).T).view(kind).ravel().astype(np.int64)


def steps(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows that stand segment by segment: the segment of each, and its place in it."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def _in_several(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which anchors occur in more than one document."""
    if not len(code):
        return np.zeros(0, bool)
    order = np.lexsort((doc, code))
    first = np.flatnonzero(_first_of_runs(code[order]))
    last = np.append(first[1:], len(code)) - 1
    out = np.zeros(len(code), bool)
    out[order] = np.repeat(doc[order][first] != doc[order][last], last - first + 1)
    return out


def _portions(part: np.ndarray, size: np.ndarray, some: np.ndarray, most: int = 2 << 20):
    """Indexes of some segments in portions of about `most` bytes, never splitting one anchor range: equal windows stay together."""
    order = np.flatnonzero(some)
    order = order[np.argsort(part[order], kind="stable")]
    if not len(order):
        return
    filled = np.cumsum(size[order])
    ends = np.append(np.flatnonzero(part[order][1:] != part[order][:-1]) + 1, len(order))
    at = 0
    while at < len(order):
        base = filled[at - 1] if at else 0
        fit = ends[(ends > at) & (filled[ends - 1] <= base + most)]
        end = int(fit[-1]) if len(fit) else int(ends[ends > at][0])
        yield order[at:end]
        at = end


def once(index: Index, seg: Segments) -> np.ndarray:
    """The index's answer, with equal segments indexed once, under the least of their documents.  Segments meet by
    hash and are compared byte by byte; should one hash stand for different segments, all are indexed as they are."""
    size = np.diff(seg.offs)
    key = b.mix(b.hashes(seg.data, seg.offs) + seg.n_windows.astype(np.uint64) * b.COEFF[50])
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    doc = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(doc, same, seg.doc)
    lone = _cut(seg.data, seg.offs[:-1][first], seg.offs[:-1][first] + size[first], doc, seg.n_windows[first])
    if not (size == size[first][same]).all() or not (seg.n_windows == seg.n_windows[first][same]).all() or not (seg.data == lone.data[_places(lone.offs[:-1][same], size)]).all():
        return index(seg)
    least = index(lone)
    which, step = steps(seg.n_windows)
    return least[(np.cumsum(lone.n_windows) - lone.n_windows)[same[which]] + step]


def _places(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of stretches that start at low, one stretch after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - size), size)


def _cut(buf: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray, n: np.ndarray) -> Segments:
    size = high - low
    return Segments(buf[_places(low, size)], np.append(0, np.cumsum(size)), np.asarray(doc, np.int64), np.asarray(n, np.int64))


SPANS = "q int, spans binary"


def resolve(unit: Unit, index: Index):
    def run(key, table):
        got = {c: table[c].to_pylist() for c in table.column_names}
        spans: dict[int, list[np.ndarray]] = {}
        for q, x in zip(got["q"], got["settled"]):
            if x:
                spans.setdefault(q, []).append(np.frombuffer(x, np.int64).reshape(-1, 3))
        whole = lambda c, kind: np.concatenate([_unplanes(x, kind) for x in got[c]] or [np.zeros(0, np.int64)])
        row, doc, at, n, size = whole("row", np.uint32), whole("doc", np.int64), whole("at", np.int64), whole("n", np.uint8), whole("size", np.uint32)
        if len(row):
            group = np.repeat(np.array(got["q"], np.int64), [len(x) // 4 for x in got["row"]])
            data = np.frombuffer(b"".join(got.pop("data")), np.uint8)
            least = once(index, Segments(data, np.append(0, np.cumsum(size + n)), doc, n))
            which, step = steps(n)
            gone = np.flatnonzero(least < doc[which])
            which, step = which[gone], step[gone]
            order = np.argsort(group[which], kind="stable")
            which, step = which[order], step[order]
            g = group[which]
            cut = np.flatnonzero(_first_of_runs(g))
            for x, y in zip(cut, np.append(cut[1:], len(g))):
                k = which[x:y]
                spans.setdefault(int(g[x]), []).append(_spans(row[k], at[k] + step[x:y]))
        return pa.table({"q": pa.array(list(spans), pa.int32()), "spans": pa.array([_pack(np.concatenate(x)) for x in spans.values()], pa.binary())})

    return run


def removed_by_document(docs: DataFrame, unit: Unit, index: Index, cut: Callable, schema: str) -> DataFrame:
    """cut(group, row numbers, first units, last units + 1 of removed stretches) makes the result table of a group.

    Uses doc_id and text alone, so other columns may have any names.  A null text is empty.  A row with a null
    doc_id comes after all others: what they have goes, and it is no source.  Rows that share a doc_id are not each other's source.
    """
    size = text_bytes(docs)
    groups, shards = groups_for(size, GROUP_BYTES), groups_for(size, SHARD_BYTES)
    dealt = docs.select(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(groups)).cast("int").alias("q"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    anchors = dealt.groupBy("q").applyInArrow(anchors_of(unit, shards), ANCHORS)
    told = anchors.groupBy("p").applyInArrow(shared, SHARED)
    segments = dealt.groupBy("q").cogroup(told.groupBy("q")).applyInArrow(segments_of(unit, shards, index), SEGMENTS)
    spans = segments.groupBy("s").applyInArrow(resolve(unit, index), SPANS)

    def finish(key, table, got):
        group = Group(table, unit)
        found = [np.frombuffer(x, np.int64).reshape(-1, 3) for x in got["spans"].to_pylist()]
        found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        return cut(group, found[:, 0], found[:, 1], found[:, 2] + unit.length - 1)

    return dealt.groupBy("q").cogroup(spans.groupBy("q")).applyInArrow(finish, schema)


def covered(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of n units lie in a stretch [first, last)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return np.cumsum(step[:-1]) > 0
