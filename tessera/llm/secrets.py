"""op12: secrets by rules, found through a trigram inverted index.

Each rule is a regular expression.  From its syntax tree comes a Boolean query of trigrams (of bytes, letters A-Z as
a-z) that every text with a match fulfils: mandatory trigrams of a string are joined by and, ways to match by or.  Blocks of
texts are indexed by the trigrams that some rule asks for; a rule's postings are intersected and united as its query says, and
only the texts left are searched.  A rule without mandatory trigrams searches every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import slices, texts_of


class Rule(NamedTuple):
    """A pattern; matches count only if the group's length is at least `least` and each of `has` is found in the match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    has: tuple[str, ...] = ()


def either_case(words: str) -> str:
    """The pattern with ASCII letters in either case (the flag for it would match further letters, such as U+212A)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


ASSIGNED = either_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: 32 or more in a row match as runs of any length do that are 32 long or more, without stopping at each short run.
BASE = (Rule("assign", ASSIGNED, 2, 8), Rule("access", "AKIA[A-Z0-9]+", 0, 16), Rule("hex", "[0-9a-f]{32,}"))

# Published forms of keys.
ADDED = (
    Rule("forge", "gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("service", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\x09-\x0D\x20A-Za-z0-9+/=]{32,}-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,19}://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{4,64}@[A-Za-z0-9.-]+"),
    Rule("bearer", either_case("bearer") + r"\x20{1,3}[A-Za-z0-9._~+/-]{20,}"),
    Rule("mixed", "[A-Za-z0-9+/_-]{24,}={0,2}", 0, 0, ("[A-Z]", "[a-z]", "[0-9]")),
)
RULES = BASE + ADDED

# Queries: True (no condition), a trigram's bytes, or (and | or, parts).
MOST_STRINGS = 64


def both(*parts):
    """All of the parts."""
    flat = {q for p in parts if p is not True for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])}
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def one_of(parts: Iterable):
    """One of the parts at least."""
    parts = set(parts)
    return True if True in parts else parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def holds(strings: Iterable[bytes]):
    """A text has one of the strings; more than MOST_STRINGS of them are no condition worth an index."""
    strings = set(strings)
    return True if len(strings) > MOST_STRINGS else one_of(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings)


class Part(NamedTuple):
    """What is known of a part of a pattern: all strings that it matches (None if too many), and otherwise how matches begin
    and end (sets of strings of two bytes or fewer) and the query that they fulfil."""

    exact: frozenset[bytes] | None
    head: frozenset[bytes]
    tail: frozenset[bytes]
    need: object


def _ends(strings: Iterable[bytes]) -> frozenset[bytes]:
    few = frozenset(strings)
    return few if len(few) <= MOST_STRINGS // 4 else frozenset([b""])


def _exactly(strings) -> Part:
    s = frozenset(strings)
    return Part(s, _ends(x[:2] for x in s), _ends(x[-2:] for x in s), True)


ANY = Part(None, frozenset([b""]), frozenset([b""]), True)
NOTHING = _exactly([b""])


def _loose(p: Part) -> Part:
    """p, without its list of strings."""
    return p if p.exact is None else Part(None, p.head, p.tail, holds(p.exact))


def _then(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _exactly(x + y for x in a.exact for y in b.exact)
    pairs = lambda left, right: {x + y for x in left for y in right}
    meet = holds(pairs(a.tail, b.head))
    # a side that is known whole reaches through to the other
    head = _ends(s[:2] for s in pairs(a.exact, b.head)) if a.exact is not None else a.head
    tail = _ends(s[-2:] for s in pairs(a.tail, b.exact)) if b.exact is not None else b.tail
    return Part(None, head, tail, both(_loose(a).need, _loose(b).need, meet))


def _or(parts: list[Part]) -> Part:
    known = [p.exact for p in parts]
    if None not in known and len(strings := frozenset().union(*known)) <= MOST_STRINGS:
        return _exactly(strings)
    head, tail = (_ends(s for p in parts for s in getattr(p, side)) for side in ("head", "tail"))
    return Part(None, head, tail, one_of(_loose(p).need for p in parts))


def _one_char(codes: Iterable[int]) -> Part:
    found = set()
    for c in codes:
        found.add(chr(c).lower().encode() if c < 128 else chr(c).encode())
        if len(found) > MOST_STRINGS // 4:
            return ANY
    return _exactly(found)


def _part(tree) -> Part:
    """What is known of a syntax tree; whatever isn't listed could be anything."""
    out = NOTHING
    for kind, value in tree:
        if kind is op.LITERAL:
            step = _one_char([value])
        elif kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
            step = _one_char(c for k, v in value for c in ([v] if k is op.LITERAL else range(v[0], v[1] + 1)))
        elif kind is op.BRANCH:
            step = _or([_part(way) for way in value[1]])
        elif kind is op.SUBPATTERN:
            step = _part(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _part(inner)
            step = NOTHING
            for _ in range(min(low, 3)):
                step = _then(step, once)
            if low > 3 or (high > low and (low, high) != (0, 1)):
                step = _then(_then(step, ANY), once) if low else ANY
            elif high > low:
                step = _or([NOTHING, once])
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            step = NOTHING
        else:
            step = ANY
        out = _then(out, step)
    return out


def trigram_query(pattern: str):
    """The Boolean query that each text with a match of the pattern fulfils; True if there are no mandatory trigrams."""
    tree = _parser.parse(pattern)
    if tree.state.flags & re.IGNORECASE:
        raise ValueError("write letters in either case as classes: the flag matches letters beyond ASCII")
    return _loose(_part(tree)).need


def trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Postings:
    """The inverted index of a block of texts, of the given trigrams."""

    def __init__(self, slots: np.ndarray, known: dict[bytes, int], buf: np.ndarray, offs: np.ndarray):
        self.known, self.docs = known, len(offs) - 1
        low = LOWER[buf]
        code = (low[:-2].astype(np.int32) << 16) | (low[1:-1].astype(np.int32) << 8) | low[2:]
        slot = slots[code]
        at = np.flatnonzero(slot)
        doc = np.searchsorted(offs, at, "right") - 1
        inside = at + 3 <= offs[doc + 1]
        entries = np.unique(slot[at[inside]].astype(np.int64) * self.docs + doc[inside])
        self.starts = np.searchsorted(entries, np.arange(len(known) + 2) * self.docs)
        self.list = entries % max(1, self.docs)

    def of(self, query) -> np.ndarray:
        """Numbers of the texts that fulfil the query, in order."""
        if query is True:
            return np.arange(self.docs)
        if isinstance(query, bytes):
            s = self.known[query]
            return self.list[self.starts[s] : self.starts[s + 1]]
        found = [self.of(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        found.sort(key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True)
        return out


class Scanner:
    """All rules, with their queries."""

    def __init__(self, rules: tuple[Rule, ...], index: bool = True):
        self.rules = [(r, re.compile(r.pattern), [re.compile(h) for h in r.has]) for r in rules]
        self.queries = [trigram_query(r.pattern) if index else True for r in rules]
        asked = sorted(set().union(*map(trigrams, self.queries)))
        self.known = {t: i + 1 for i, t in enumerate(asked)}
        self.slots = np.zeros(1 << 24, np.int16)
        for t, i in self.known.items():
            self.slots[int.from_bytes(t, "big")] = i

    def spans(self, text: str, rule: int) -> list[tuple[int, int, int]]:
        """(start, the rule's number, end) of a rule's matches that count."""
        r, pattern, has = self.rules[rule]
        return [
            (m.start(), rule, m.end())
            for m in pattern.finditer(text)
            if len(m[r.group]) >= r.least and all(h.search(m[0]) for h in has)
        ]

    def block(self, buf: np.ndarray, offs: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """The spans of each text of a block, by start, then rule."""
        index = Postings(self.slots, self.known, buf, offs)
        to_search: list[list[int]] = [[] for _ in range(index.docs)]
        for rule, query in enumerate(self.queries):
            for k in index.of(query).tolist():
                to_search[k].append(rule)
        raw, out = buf.tobytes(), []
        for k, own in enumerate(to_search):
            text = raw[offs[k] : offs[k + 1]].decode() if own else ""
            out.append(sorted(s for rule in own for s in self.spans(text, rule)))
        return out


RESULT = "doc_id long, counts array<long>, base string, spans string, n_added long"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("counts", pa.list_(pa.int64())), ("base", pa.string())]
    + [("spans", pa.string()), ("n_added", pa.int64())]
)


def _find(rules: tuple[Rule, ...], n_base: int, index: bool):
    def run(batches):
        scanner = Scanner(rules, index)
        said = lambda spans: ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, buf, offs in slices(*texts_of(batch.column("text"))):
                rows = []
                for doc_id, spans in zip(ids[low:high], scanner.block(buf, offs)):
                    base = [x for x in spans if x[1] < n_base]
                    counts = [sum(x[1] == r for x in base) for r in range(n_base)]
                    rows.append((doc_id, counts, said(base), said(spans), len(spans) - len(base)))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    return run


def find(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, index: bool = True) -> DataFrame:
    """doc_id, counts (of each base rule), base and spans (kind:start:end in code points, end exclusive, by start, then
    rule, joined by commas; spans holds those of all rules), n_added.

    One row per input row.  A rule's matches are leftmost and don't overlap; those of different rules may.  Null or
    empty text: no spans.  Null ids and repeated rows are searched like others; a text longer than a block is a block of its
    own.  Other columns, whatever their names, are not read.  No rows give no rows.  index=False searches every text by every
    rule, with the same result.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find(base + added, len(base), index), RESULT)


def redact(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED) -> DataFrame:
    """doc_id, text with each run of covered characters as <SECRET>, n_redacted (such runs).  Null text stays null."""

    def run(batches):
        scanner = Scanner(base + added)
        for batch in batches:
            ids, values = batch.column("doc_id").to_pylist(), batch.column("text")
            for low, high, buf, offs in slices(*texts_of(values)):
                raw, rows = buf.tobytes(), []
                for k, spans in enumerate(scanner.block(buf, offs)):
                    text, out, at, runs = raw[offs[k] : offs[k + 1]].decode(), [], 0, 0
                    for s, _, e in spans:
                        if s > at or not runs:
                            out += [text[at:s], "<SECRET>"]
                            runs += 1
                        at = max(at, e)
                    whole = None if values[low + k].as_py() is None else "".join(out) + text[at:]
                    rows.append((ids[low + k], whole, runs))
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "text", "n_redacted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, text string, n_redacted long")

