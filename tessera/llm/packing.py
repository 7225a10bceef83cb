"""op5: pack documents into token sequences along a space-filling curve.

Each document's hashed word counts are projected to DIMENSIONS signed sums, turned into ranks of a fixed normal
scale, and interleaved into a Hilbert key.  Documents are range-sorted by (key, doc_id) and laid out along the curve, so
neighbours in a sequence have similar words; the stream is cut every `length` tokens.  What is left at a
range's end is cut into powers of two, which need no padding.  A hot key (many copies) spreads over ranges by doc_id.
"""

from __future__ import annotations

import base64
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as b
from .storage import groups_for, materialize

DIMENSIONS, BITS = 4, 15
RANGE_TOKENS = 8 << 20
#: Texts of these characters alone get equal ids from both libraries; all other texts take the slower one.
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-¬®-ɏ]*")


class Encoder:
    """Ids of tokenizers' byte-level BPE file, by tiktoken with the same ranks where both agree for certain."""

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            import public_tokenizers

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks_path: str | None) -> Encoder:
    if (path, ranks_path) not in _encoders:
        _encoders[path, ranks_path] = Encoder(path, ranks_path)
    return _encoders[path, ranks_path]


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of points (n, dimensions) with `bits`-bit coordinates, most significant bit first.

    Gray-code form: walking from the top bit down, each coordinate either inverts or swaps the lower bits of
    the first, then the transposed bits are Gray-decoded and interleaved."""
    x = x.astype(np.int64).copy()
    n, d = x.shape
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(d):
            on = (x[:, i] & bit) != 0
            x[on, 0] ^= low
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= swap
            x[:, i] ^= swap
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    fold = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        fold ^= np.where(x[:, d - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= fold[:, None]
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> level) & 1)
    return key


def keys(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hilbert keys of a block's documents; a document without words is at the middle of all axes."""
    starts, ends, bounds = b.words(buf, offs)
    h = b.Spans(buf, b.BYTE_LOWER)(starts, ends)
    n = np.maximum(1, np.diff(bounds)).astype(float)
    axes = np.empty((len(n), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((h >> np.uint64(d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        z = b.per_doc(sign, bounds) / np.sqrt(n)
        axes[:, d] = np.clip((np.tanh(z / 4) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(axes)


ENCODED = "doc_id long, key long, n long, ids binary"


def _encode(path: str, ranks_path: str | None, end: int):
    def run(batches):
        encode = encoder(path, ranks_path)
        for batch in batches:
            buf, offs = b.texts_of(batch.column("text"))
            for i, j, part, at in b.slices(buf, offs, 1 << 20):
                texts = batch.column("text").slice(i, j - i).to_pylist()
                ids = [np.array([*encode(t or ""), end], "<u4") for t in texts]
                # ids below 2^16 take two bytes on their way
                small = [x.astype("<u2") if not len(x) or x.max() < 1 << 16 else x for x in ids]
                made = [batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(keys(part, at)), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in small], pa.binary())]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "key", "n", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long, ids binary"


def lay_out(sizes, length: int):
    """Pieces (document, start, length, sequence, offset) of documents laid end to end and cut every `length`
    tokens; the tail is cut into powers of two."""
    whole, tail = divmod(int(sum(sizes)), length)
    cuts = [length] * whole + [1 << p for p in range(tail.bit_length() - 1, -1, -1) if tail >> p & 1]
    sequence, room, at = 0, cuts[0] if cuts else 0, 0
    for doc, n in enumerate(sizes):
        start = 0
        while start < n:
            take = min(int(n) - start, room - at)
            yield doc, start, take, sequence, at
            start += take
            at += take
            if at == room:
                sequence, at = sequence + 1, 0
                room = cuts[sequence] if sequence < len(cuts) else 0


def _pack(length: int, keep_ids: bool):
    def run(batches):
        base = TaskContext.get().partitionId() << 40
        held, total = [], 0
        sequence = base

        def flush(last: bool):
            nonlocal held, total, sequence
            # whole sequences leave at once; the open one waits for its next documents
            whole = total if last else total // length * length
            out = {c.split()[0]: [] for c in PIECES.split(", ")}
            done, rest = 0, []
            sizes = []
            for k, (doc, ids, from_, n) in enumerate(held):
                take = min(len(ids), whole - done)
                sizes.append(take)
                done += take
                if take < len(ids):
                    rest.append((doc, ids[take:], from_ + take, n))
            used = 0
            for k, start, take, seq, at in lay_out(sizes, length):
                doc, ids, from_, n = held[k]
                piece = np.ascontiguousarray(ids[start : start + take], "<u4").tobytes()
                for name, v in zip(out, (doc, from_ + start, take, zlib.crc32(piece), n, sequence + seq, at, 0, piece if keep_ids else None)):
                    out[name].append(v)
                used = seq + 1
            sequence += used
            held, total = rest, total - whole
            return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()], names=list(out))

        for batch in batches:
            for doc, n, ids in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")):
                raw = ids.as_py()
                held.append((doc, np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"), 0, n))
                total += n
                if total >= 1 << 18:
                    yield flush(False)
        yield flush(True)

    return run


def pack(docs: DataFrame, path: str, ranks_path: str | None = None, length: int = 2048, end: int = 1, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding (always 0), ids
    (unsigned little-endian 32-bit; null unless keep_ids).

    path: a tokenizers file; ranks_path: the same vocabulary as tiktoken ranks, for speed, or None.  length: a power
    of two.  A null or empty text is the end id alone.  Null ids and repeated rows are packed like others.  Reads
    doc_id and text alone.  No documents: no rows.
    """
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    encoded = materialize(own.mapInArrow(_encode(path, ranks_path, end), ENCODED))
    total = encoded.agg(F.sum("n")).first()[0] or 0
    parts = groups_for(int(total), RANGE_TOKENS, 12)
    ranged = encoded.repartitionByRange(parts, "key", "doc_id", F.crc32("ids")).sortWithinPartitions("key", "doc_id", F.crc32("ids"))
    return ranged.select("doc_id", "n", "ids").mapInArrow(_pack(length, keep_ids), PIECES)
