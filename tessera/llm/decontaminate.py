"""op1: benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ in k = floor(rate * m) edits.  Cut into k + 1 pieces, at least one piece of any
such copy is left whole, so exact hits of pieces (an Aho-Corasick automaton over all pieces of a block of
items) find every place where a copy can be.  The windows around hits are verified with Myers' bit-parallel distance.
Items pass over the documents in blocks of bounded size; a benchmark of any size needs no more memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as b
from .storage import keyed

RATE, BLOCK_CHARS, SHORTEST = 0.05, 4 << 20, 12


def normal(text: str) -> str:
    """Lower case, with runs of white space as one blank."""
    return " ".join(text.lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(x, item[x:y]) for x, y in zip(cut, cut[1:])]


def bordered(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] cuts no word at either end."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class Pattern:
    def __init__(self, item: str):
        self.m = len(item)
        self.top, self.all = 1 << (self.m - 1), (1 << self.m) - 1
        self.at: dict[str, int] = {}
        for i, c in enumerate(item):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance between the item and any substring of text, and the (first) end of such a one."""
        plus, minus, score, found = self.all, 0, self.m, (self.m, 0)
        at, top, every = self.at.get, self.top, self.all
        for j, c in enumerate(text):
            eq = at(c, 0)
            x = eq | minus
            d0 = ((((x & plus) + plus) ^ plus) | x) & every
            hp, hn = (minus | ~(d0 | plus)) & every, plus & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < found[0]:
                    found = (score, j + 1)
            # a match may begin anywhere: the top row stays 0
            hp, hn = (hp << 1) & every, (hn << 1) & every
            plus, minus = (hn | ~(d0 | hp)) & every, hp & d0
        return found


class Automaton:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = {i: t for i, t in items}
        self.budget = {i: int(rate * len(t)) if len(t) >= SHORTEST else 0 for i, t in items}
        self.patterns: dict[int, Pattern] = {}
        self.words = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for i, t in items:
            for at, piece in pieces(t, self.budget[i]):
                where.setdefault(piece, []).append((i, at))
        for piece, places in where.items():
            self.words.add_word(piece, (len(piece), places))
        if where:
            self.words.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item, distance, end in text) of the best copy of each item that text holds within its budget."""
        windows: dict[int, list[list[int]]] = {}
        short: dict[int, int] = {}
        for end, (n, places) in self.words.iter(text):
            for item, at in places:
                k, start = self.budget[item], end + 1 - n - at
                if len(self.items[item]) < SHORTEST:
                    if item not in short and bordered(text, start, end + 1):
                        short[item] = end + 1
                    continue
                low, high = max(0, start - k), min(len(text), start + len(self.items[item]) + k)
                of = windows.setdefault(item, [])
                if of and low <= of[-1][1]:
                    of[-1][0], of[-1][1] = min(low, of[-1][0]), max(high, of[-1][1])
                else:
                    of.append([low, high])
        out = [(item, 0, end) for item, end in short.items()]
        for item, of in windows.items():
            whole = self.items[item]
            exact = text.find(whole)
            if exact >= 0:
                out.append((item, 0, exact + len(whole)))
                continue
            if item not in self.patterns:
                self.patterns[item] = Pattern(whole)
            best = min(((d, low + e) for low, high in of for d, e in [self.patterns[item].best(text[low:high])]), default=(len(whole), 0))
            if best[0] <= self.budget[item]:
                out.append((item, *best))
        return out


MATCHES = "doc_id long, item_id long, distance long, budget long, item_chars long, end long"


def _search(items: list[tuple[int, str]], rate: float):
    def run(batches):
        automaton = Automaton(items, rate)
        for batch in batches:
            made = {c.split()[0]: [] for c in MATCHES.split(", ")}
            if automaton.any:
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    for item, distance, end in automaton.find(normal(text.as_py() or "")):
                        for name, v in zip(made, (doc, item, distance, automaton.budget[item], len(automaton.items[item]), end)):
                            made[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in made.values()], names=list(made))

    return run


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS):
    """Blocks of (item_id, normalised text) of at most `most` characters, or of one item; null ids and null or blank
    texts are left out.  Items stream through the driver one partition at a time."""
    block, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").distinct().toLocalIterator():
        t = normal(r[1])
        if not t:
            continue
        if block and size + len(t) > most:
            yield sorted(block)
            block, size = [], 0
        block.append((r[0], t))
        size += len(t)
    if block:
        yield sorted(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document row and benchmark item that it holds within the item's edit budget: doc_id, item_id,
    distance, budget, item_chars, end (of the best place, in the normalised text; the first of equals).

    Both texts are compared in lower case with white space runs as one blank.  Items under 12 characters
    match exactly, and only where they cut no word; null or blank texts and items match nothing; items that share an item_id count one by one.  Repeated rows repeat.  Reads
    doc_id and text alone.  An empty table on either side: no rows.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(benchmark, block_chars):
        # several texts under one id go to passes of their own
        while block:
            now, later, seen = [], [], set()
            for i, t in block:
                (later if i in seen else now).append((i, t))
                seen.add(i)
            found = own.mapInArrow(_search(now, rate), MATCHES)
            out = found if out is None else out.unionByName(found)
            block = later
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows that hold no benchmark item, with all their columns.  Each row is judged by its own text, whatever its
    doc_id."""
    rows, key = keyed(docs)
    hit = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, rate).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(hit, key, "left_anti").drop(key)
