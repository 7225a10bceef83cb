"""op3: remove byte strings that a document with a smaller doc_id has, by suffix arrays.

Bucket-pointer refinement: suffixes are first bucketed by their q-gram; every suffix has a pointer to its
bucket, and every bucket knows how many bytes its members share.  A bucket is refined by sorting its members on the
pointers at that offset; the new buckets' pointers are written at once, and they are refined in turn before buckets that
wait, so that whatever refers to them later finds finer pointers and gains more bytes a step.  Buckets go through in
portions (whole arrays of them), the latest first.  Buckets with one member are final, and so are those that share
the wanted depth; neighbours in the order that were told apart beyond that depth are put together again by comparing bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .anchored import Group, Segments, Unit, covered, removed_by_document, steps

Q = 8
PORTION = 1 << 16
DONE = np.iinfo(np.int32).max


def bucket_pointers(data: np.ndarray, depth: int, q: int = Q, portion: int = PORTION) -> np.ndarray:
    """For each position the pointer to its bucket of suffixes with equal first `depth` bytes (zeros follow the end).

    Pointers are ranks in the suffix array: buckets' order is the suffixes' order.  depth >= q, q at most 8.
    """
    n = len(data)
    if n >= 2**31 - depth:
        raise ValueError("a shard has over 2^31 bytes")
    padded = np.zeros(n + depth + 8, np.uint8)
    padded[:n] = data
    eight = np.ndarray((n + depth,), ">u8", padded.data, strides=(1,))
    gram = eight[:n].astype(np.uint64) >> np.uint64(8 * (8 - q))
    order = np.argsort(gram).astype(np.int32)
    gram = gram[order]
    head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[:n]).astype(np.int32)
    size = np.diff(np.append(head, n)).astype(np.int32)
    pointer = np.zeros(n + depth, np.int32)  # 0 is the end
    pointer[order] = np.repeat(head, size) + 1
    shared = np.full(n + 1, DONE, np.int32)  # by pointer: bytes that the bucket's members share; nothing follows the end
    shared[head + 1] = q
    del gram
    waiting = [(head[size > 1], size[size > 1])]
    while waiting:
        heads, sizes = waiting.pop()
        while waiting and sizes.sum(dtype=np.int64) < portion // 4:
            more = waiting.pop()
            heads, sizes = np.concatenate([heads, more[0]]), np.concatenate([sizes, more[1]])
        if len(heads) > 1 and sizes.sum(dtype=np.int64) > portion:
            last = max(1, int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), portion, "right")))
            waiting.append((heads[last:], sizes[last:]))
            heads, sizes = heads[:last], sizes[:last]
        which, step = steps(sizes)
        slots = heads[which] + step
        members, bytes_shared = order[slots], shared[heads + 1]
        beyond = pointer[members + bytes_shared[which]]
        key = (which.astype(np.uint64) << np.uint64(32)) | beyond.astype(np.uint64)
        by = np.argsort(key)
        members, key, beyond = members[by], key[by], beyond[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(first, len(key))).astype(np.int32)
        # a bucket's members keep its slots
        order[slots] = members
        new = slots[first].astype(np.int32)
        pointer[members] = np.repeat(new, count) + 1
        gained = np.minimum(shared[beyond[first]], DONE - depth)
        shared[new + 1] = bytes_shared[which[first]] + gained
        open_ = (count > 1) & (shared[new + 1] < depth)
        if open_.any():
            waiting.append((new[open_], count[open_]))
    # buckets that differ only beyond the depth become one
    apart = np.append(True, pointer[order[1:]] != pointer[order[:-1]])[:n]
    same = np.flatnonzero(apart)[1:]
    for at in range(0, depth, 8):
        shift = np.uint64(8 * max(0, at + 8 - depth))
        left, right = (eight[order[same - k] + at].astype(np.uint64) >> shift for k in (1, 0))
        same = same[left == right]
    apart[same] = False
    pointer[order] = np.maximum.accumulate(np.where(apart, np.arange(n, dtype=np.int32), 0)) + 1
    return pointer[:n]


def least_document(length: int):
    """Index for segments of bytes: the smallest doc_id that has each window."""

    def index(seg: Segments) -> np.ndarray:
        pointer = bucket_pointers(seg.data, length)
        which, step = steps(seg.n_windows)
        mine = pointer[seg.offs[:-1][which] + step]
        least = np.full(len(pointer) + 2, np.iinfo(np.int64).max)
        np.minimum.at(least, mine, seg.doc[which])
        return least[mine]

    return index


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(keep_text: bool):
    def cut(group: Group, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
        order = np.argsort(row, kind="stable")
        row, first, last = row[order], first[order], last[order]
        at = np.searchsorted(row, np.arange(len(group.ids) + 1))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for i in range(len(group.ids)):
            text = group.buf[group.offs[i] : group.offs[i + 1]]
            spans = removed = 0
            if at[i] < at[i + 1]:
                gone = covered(len(text), first[at[i] : at[i + 1]], last[at[i] : at[i + 1]])
                removed, spans = int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = text[~gone].tobytes()
            else:
                kept = text.tobytes()
            for name, v in zip(out, (len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None)):
                out[name].append(v)
        return pa.table({"doc_id": group.table["doc_id"], **{k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string() if k == "kept_sha256" else pa.binary()) for k, v in out.items()}})

    return cut


def remove_repeated_bytes(docs: DataFrame, length: int = 50, gram: int = 20, keep_text: bool = True) -> DataFrame:
    """Each document without the bytes covered by a `length`-byte string that also starts in a smaller doc_id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes left; a cut can fall inside a
    character; null unless keep_text).  One row per input row.  Null text: empty.  A null doc_id comes after all others and is no
    source.  Rows with one doc_id are not each other's source.  No documents: no rows.
    """
    return removed_by_document(docs, Unit(False, length, gram), least_document(length), _cut(keep_text), SCHEMA)
