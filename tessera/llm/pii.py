"""op10: personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans.  The field labels all tokens (O, email, ip, card, phone, secret); its potentials are
features of a token's shape, one matrix for neighbours in the text, and one each for distant tokens that are equal (without
case, punctuation and signs) and that are similar (equal length, marks and kinds of characters).  Loopy belief
propagation passes messages along all edges, so one sure mention pulls a doubtful one along.  Tokens with base spans are
observed.  Plain tokens (no digit, no @) have one node potential and no distant edges; a run of them between two
other tokens is summed out of the chain exactly (a matrix product; runs over MOST_GAP count as MOST_GAP, where the
product has long been of rank one), so the field is small and no text is left out.  Plain tokens get no span.

Teachers of the weights (pseudo-likelihood) are weak labels: base spans, and secrets that a word like "token" or "key" and
a sign = or : announce.  For MASKED of the labelled tokens the evidence that the teachers went by is hidden, and of
the tokens with an equal one elsewhere all features are, so that the weights of other features, neighbours and distant
mentions are learned.  How far they carry is measured by hidden_mentions(), against without_distance().  The fit takes at most
FIT_DOCS documents (least hash of doc_id and text) of at most FIT_CHARS characters together.  A very long text is one field, in
memory linear in its tokens with a digit or @.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SPAN_KINDS = (*KINDS, "secret")
LABELS = ("O", *SPAN_KINDS)
FIT_DOCS, FIT_CHARS, ROUNDS, SURE, MASKED, MOST_GAP = 2000, 20_000_000, 10, 0.9, 0.5, 64
#: Of the squared weights.  At 1.0 the potentials of distant mentions stayed too weak to carry a label to a mention without evidence.
PENALTY = 0.1

# Equal to the contract's patterns; the looks-behind only spare starts that can't match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
SHAPED = re.compile(r"[0-9@]")


def emails(text: str):
    """Leftmost non-overlapping e-mail addresses, in time linear in the text."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of all base spans, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


EDGE = "\"'()[]{}<>,;:!?.#$%&*|"
FEATURES = 30
PLAIN = [0, 1, 18]  # features of a token of letters
EVIDENCE = [9, 12, 14, 25, 28]  # what the teachers of weak labels go by
SECRET = re.compile(r"[A-Za-z0-9_+/-]{20,}=*")
# Words that announce a secret.
CUE = re.compile(r"(?:token|key|secret|password|passwd|pwd|auth|bearer|credential)s?[\"']?[ ]?[=:][ ]?[\"']?$", re.IGNORECASE)


def secret_in(token: str) -> re.Match | None:
    """The last long run of letters and digits in a token, where it has both."""
    found = None
    for found in SECRET.finditer(token):
        pass
    return found if found and any(c.isdigit() for c in found[0]) and any(c.isalpha() for c in found[0]) else None


def features(token: str, before: str) -> list[int]:
    """Numbers of the features that hold for a token; before: the text just before it."""
    core = token.strip(EDGE)
    digits = sum(c in "0123456789" for c in core)
    letters = any(c.isalpha() for c in core)
    out = [0, 1 + (0 if digits == 0 else 1 if digits < 3 else 2 if digits < 5 else 3 if digits < 9 else 4 if digits < 12 else 5 if digits < 16 else 6)]
    at = core.find("@")
    if at > 0:
        out.append(8)
        if "." in core[at:]:
            out.append(9)
    if at == 0:
        out.append(10)
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append(11)
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append(12)
    elif len(parts) > 2:
        out.append(13)
    if core.startswith("+"):
        out.append(14)
    if "-" in core:
        out.append(15)
    if token.startswith("(") or ")" in core:
        out.append(16)
    if letters and digits:
        out.append(17)
    if letters and not digits:
        out.append(18)
    if core.isdigit():
        out.append(19)
        if len(core) == 4:
            out.append(20)
    if before.endswith(":"):
        out.append(21)
    if before[-12:].lower().strip(EDGE).endswith(("tel", "phone", "call", "mail", "card", "ip", "fax")):
        out.append(22)
    if len(core) > 24:
        out.append(23)
    run = secret_in(token)
    if run:
        out.append(24)
        if CUE.search(before[-14:] + " " + token[: run.start()]):
            out.append(25)
    if token[:1] in ("'", '"'):
        out.append(26)
    if 12 <= digits <= 19 and not letters:
        out.append(28 if luhn(DIGITS.sub("", core)) else 27)
    if at < 0 and run is None and len(core) >= 12 and letters and digits:
        out.append(29)
    return out


def signature(token: str) -> tuple | None:
    """What similar tokens have in common: length, marks and kinds of characters; None for short tokens."""
    if len(token) < 8:
        return None
    marks = "".join(sorted({c for c in token if not c.isalnum()}))
    return len(token), marks, any(c.isalpha() for c in token), any(c.isdigit() for c in token)


class Field:
    """The tokens of one text that aren't plain, with their edges.

    edges: (i, j, kind) with kind 0 for neighbours, 1 for equal, 2 for similar tokens; each token has an edge to the last
    equal one and to the last similar one before it.  gaps: (i, j, plain tokens between them); ends: plain tokens before
    the first and after the last.  taught: weak labels, which are base labels and announced secrets.
    """

    def __init__(self, text: str, base: list[tuple[int, int, int]]):
        self.spans, self.features, self.clamped, self.taught = [], [], [], []
        self.edges: list[tuple[int, int, int]] = []
        self.gaps: list[tuple[int, int, int]] = []
        last_token, seen, alike, k, place = -1, {}, {}, 0, -1
        known = {}
        for place, m in enumerate(TOKEN.finditer(text)):
            if not SHAPED.search(m[0]):
                continue
            i = len(self.spans)
            self.spans.append((m.start(), m.end()))
            on = features(m[0], text[max(0, m.start() - 14) : m.start()].rstrip(" "))
            self.features.append(on)
            while k < len(base) and base[k][2] <= m.start():
                k += 1
            j, label = k, 0
            while j < len(base) and base[j][0] < m.end():
                if base[j][2] > m.start():
                    label = base[j][1] + 1
                    break
                j += 1
            self.clamped.append(label)
            if i == 0:
                self.first = place
            elif last_token == place - 1:
                self.edges.append((i - 1, i, 0))
            else:
                self.gaps.append((i - 1, i, place - 1 - last_token))
            last_token = place
            key = re.sub(r"[^0-9a-z@]+", "", m[0].lower())
            if not label and 25 in on:
                label = known[key] = len(LABELS) - 1
            self.taught.append(label or key)
            equal = seen.get(key) if len(key) > 3 else None
            if equal is not None:
                self.edges.append((equal, i, 1))
            seen[key] = i
            like = signature(m[0])
            if like is not None:
                if alike.get(like, equal) != equal:
                    self.edges.append((alike[like], i, 2))
                alike[like] = i
        self.taught = [t if isinstance(t, int) else known.get(t, 0) for t in self.taught]
        self.ends = (self.first, place - last_token) if self.spans else (0, 0)


class Crf:
    def __init__(self, node: np.ndarray, pair: np.ndarray):
        self.node, self.pair = node, pair  # (features, labels), (kinds of edges, labels, labels)

    @classmethod
    def untrained(cls):
        node = np.zeros((FEATURES, len(LABELS)))
        node[0, 0] = 8.0
        return cls(node, np.zeros((3, len(LABELS), len(LABELS))))

    @classmethod
    def fit(cls, fields: list[Field], rounds: int = 400, rate: float = 0.05, penalty: float = PENALTY, masked: float = MASKED):
        fields = [f for f in fields if f.spans]
        if not any(any(f.taught) for f in fields):
            return cls.untrained()
        x, _, edges = stack(fields)
        y = np.concatenate([f.taught for f in fields])
        hide = np.random.default_rng(0).random(len(y)) < masked
        x[np.ix_(hide & (y > 0), EVIDENCE)] = 0
        twins = np.zeros(len(y), bool)
        twins[edges[edges[:, 2] == 1, :2]] = True
        x[hide & twins, 1:] = 0
        n, k, kinds = len(y), len(LABELS), 3
        # plain tokens are O; those beside other tokens are told apart by the labels there, k for none, and all
        # together weigh as much as the other tokens
        sides = np.zeros((k + 1, k + 1))
        at, near_o = 0, np.zeros((n, 2))  # whether a plain token stands before and after
        for f in fields:
            for i, j, gap in [(None, at, f.ends[0]), *((a + at, c + at, g) for a, c, g in f.gaps), (at + len(f.spans) - 1, None, f.ends[1])]:
                if not gap:
                    continue
                if i is not None:
                    near_o[i, 1] = 1
                if j is not None:
                    near_o[j, 0] = 1
                if gap > 1:
                    sides[k if i is None else y[i], 0] += 1
                    sides[0, k if j is None else y[j]] += 1
                    sides[0, 0] += gap - 2
                else:
                    sides[k if i is None else y[i], k if j is None else y[j]] += 1
            at += len(f.spans)
        sides *= n / max(1.0, sides.sum())
        target = np.eye(k)[y]
        u, v, kind = edges[:, 0], edges[:, 1], edges[:, 2]
        node, pair = np.zeros((FEATURES, k)), np.zeros((kinds, k, k))
        moments = [np.zeros_like(node), np.zeros_like(node), np.zeros_like(pair), np.zeros_like(pair)]
        for t in range(1, rounds + 1):
            score = x @ node + near_o[:, :1] * pair[0][0] + near_o[:, 1:] * pair[0][:, 0]
            for e in range(kinds):
                at = kind == e
                np.add.at(score, v[at], pair[e][y[u[at]]])
                np.add.at(score, u[at], pair[e].T[y[v[at]]])
            miss = target - _softmax(score)
            g_node = x.T @ miss - penalty * node
            g_pair = np.stack([target[u[kind == e]].T @ miss[v[kind == e]] + miss[u[kind == e]].T @ target[v[kind == e]] - penalty * pair[e] for e in range(kinds)])
            g_pair[0][0] += near_o[:, 0] @ miss
            g_pair[0][:, 0] += near_o[:, 1] @ miss
            wide = np.zeros((k + 1, k + 1))
            wide[:k, :k] = pair[0]
            plain = -_softmax(node[PLAIN].sum(0) + wide[:, None, :k] + wide.T[None, :, :k])
            plain[:, :, 0] += 1
            plain *= sides[:, :, None]
            g_node[PLAIN] += plain.sum((0, 1))
            g_pair[0] += plain.sum(1)[:k] + plain.sum(0)[:k].T
            g_pair[1:] = (g_pair[1:] + g_pair[1:].transpose(0, 2, 1)) / 2
            for value, g, m, s in ((node, g_node / n, *moments[:2]), (pair, g_pair / n, *moments[2:])):
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                value += rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        return cls(node, pair)

    def _runs(self) -> np.ndarray:
        """[g]: the table of an edge over g plain tokens that are summed out, up to a factor."""
        beside = np.exp(self.pair[0])
        one = np.exp(self.node[PLAIN].sum(0) - self.node[PLAIN].sum(0).max())[:, None] * beside
        out = [beside]
        for _ in range(MOST_GAP):
            out.append(out[-1] @ one / (out[-1] @ one).max())
        return np.stack(out)

    def marginals(self, x: np.ndarray, clamped: np.ndarray, edges: np.ndarray, gaps: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Loopy belief propagation: (tokens, labels) marginals.  clamped: labels over 0 are observed.  ends: (token, 0
        before it or 1 after it, plain tokens there)."""
        local = x @ self.node
        seen = clamped > 0
        local[seen] = -50
        local[seen, clamped[seen]] = 0
        tables = np.exp(self.pair)[edges[:, 2]]
        ends_at = edges[:, :2]
        if gaps is not None:
            runs = self._runs()
            tables = np.concatenate([tables, runs[np.minimum(gaps[:, 2], MOST_GAP)]])
            ends_at = np.concatenate([ends_at, gaps[:, :2]])
            plain = np.exp(self.node[PLAIN].sum(0) - self.node[PLAIN].sum(0).max())
            for token, after, gap in ends:
                if gap:
                    t = runs[min(gap, MOST_GAP) - 1]
                    local[token] += np.log((t @ plain if after else plain @ t) + 1e-300)
        if len(ends_at):
            u, v = ends_at[:, 0], ends_at[:, 1]
            # both directions of every edge; a message's reverse is the other half's
            src, dst = np.concatenate([u, v]), np.concatenate([v, u])
            table = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(u)) + len(u), np.arange(len(u))])
            messages = np.zeros((len(src), local.shape[1]))
            for _ in range(ROUNDS):
                belief = local.copy()
                np.add.at(belief, dst, messages)
                out = belief[src] - messages[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ea,eab->eb", out, table) + 1e-300)
                new -= new.max(1, keepdims=True)
                messages = 0.5 * messages + 0.5 * new
            np.add.at(local, dst, messages)
        return _softmax(local)


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def stack(fields: list[Field]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = sum(len(f.spans) for f in fields)
    x, y, edges, at = np.zeros((n, FEATURES)), np.zeros(n, np.int64), [], 0
    for f in fields:
        for i, on in enumerate(f.features):
            x[at + i, on] = 1
        y[at : at + len(f.spans)] = f.clamped
        edges += [(a + at, c + at, e) for a, c, e in f.edges]
        at += len(f.spans)
    return x, y, np.array(edges, np.int64).reshape(-1, 3)


def stack_plain(fields: list[Field]) -> tuple[np.ndarray, np.ndarray]:
    """The fields' gaps and ends, numbered as stack() numbers tokens."""
    gaps, ends, at = [], [], 0
    for f in fields:
        if f.spans:
            gaps += [(a + at, c + at, g) for a, c, g in f.gaps]
            ends += [(at, 0, f.ends[0]), (at + len(f.spans) - 1, 1, f.ends[1])]
        at += len(f.spans)
    return np.array(gaps, np.int64).reshape(-1, 3), np.array(ends, np.int64).reshape(-1, 3)


def added_spans(text: str, field: Field, p: np.ndarray, base: list[tuple[int, int, int]], sure: float = SURE) -> list[tuple[int, int, int]]:
    """Spans of the field beyond the base: runs of neighbouring tokens with one sure label, without edge marks."""
    label = p.argmax(1)
    label[p.max(1) < sure] = 0
    out, near = [], {(a, c) for a, c, e in field.edges if e == 0}
    i, n = 0, len(label)
    while i < n:
        if label[i] == 0 or field.clamped[i]:
            i += 1
            continue
        j = i + 1
        while j < n and label[j] == label[i] and not field.clamped[j] and (j - 1, j) in near:
            j += 1
        start, end = field.spans[i][0], field.spans[j - 1][1]
        if label[i] == len(LABELS) - 1:
            j = i + 1  # each secret is a span of its own: its token's long run
            run = secret_in(text[start : field.spans[i][1]])
            start, end = (start + run.start(), start + run.end()) if run else (start, field.spans[i][1])
        while start < end and text[start] in EDGE:
            start += 1
        while end > start and text[end - 1] in EDGE:
            end -= 1
        if start < end:
            out.append((start, int(label[i]) - 1, end))
        i = j
    return out


RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
TOKENS_AT_ONCE = 50_000


def _render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


EMPTY = hashlib.sha256(b"").hexdigest()


def _find(crf: Crf, sure: float):
    def settle(rows, waiting):
        fields = [w[2] for w in waiting]
        x, y, edges = stack(fields)
        p, at = crf.marginals(x, y, edges, *stack_plain(fields)), 0
        for k, text, field, base in waiting:
            more = added_spans(text, field, p[at : at + len(field.spans)], base, sure)
            at += len(field.spans)
            count = [sum(s[1] == kind for s in base) for kind in range(len(KINDS))]
            rows[k] = (rows[k], *count, hashlib.sha256(_render(base).encode()).hexdigest(), _render(base + more), len(more), len(base) + len(more))

    def run(batches):
        for batch in batches:
            rows, waiting, tokens = [], [], 0
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = value.as_py()
                if not text or not SHAPED.search(text):
                    rows.append((doc, 0, 0, 0, 0, EMPTY, "", 0, 0))
                    continue
                base = base_spans(text)
                waiting.append((len(rows), text, Field(text, base), base))
                rows.append(doc)
                tokens += len(waiting[-1][2].spans)
                if tokens > TOKENS_AT_ONCE:
                    settle(rows, waiting)
                    waiting, tokens = [], 0
            if waiting:
                settle(rows, waiting)
            made = [pa.array([r[c] for r in rows], pa.string() if c in (5, 6) else pa.int64()) for c in range(9)]
            yield pa.RecordBatch.from_arrays(made, names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def fit(docs: DataFrame, most_docs: int = FIT_DOCS, most_chars: int = FIT_CHARS) -> Crf:
    """Fit on the texts of at most most_docs documents with a digit or @ (least hash of doc_id and text): those of them, in
    the order of hashes, that together have at most most_chars characters.  A text that would pass the bound is left out and the
    next one taken."""
    own = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    # only hashes and sizes meet for the choice; texts of the chosen few follow
    total, taken = 0, set()
    for r in own.select("h", F.length("text").alias("n")).orderBy("h", "n").limit(most_docs).collect():
        if r.h not in taken and total + r.n <= most_chars:
            total += r.n
            taken.add(r.h)
    picked = own.filter(F.col("h").isin(sorted(taken))).dropDuplicates(["h"]).collect() if taken else []
    return Crf.fit([Field(r.text, base_spans(r.text)) for r in sorted(picked, key=lambda r: (r.h, r.text))])


def without_distance(crf: Crf) -> Crf:
    """The same field, with potentials between neighbours only: a plain chain, to compare with."""
    near = crf.pair.copy()
    near[1:] = 0
    return Crf(crf.node, near)


def hidden_mentions(texts: list[str], crf: Crf, everything: bool = True, sure: float = SURE) -> tuple[int, int]:
    """(found, asked): labelled tokens (base or announced) that an earlier mention equals, with what tells their label hidden: their base
    span and evidence, or all their features.  What is found comes from other mentions and neighbours."""
    found = asked = 0
    for text in texts:
        field = Field(text, base_spans(text))
        pairs = [(a, b) for a, b, kind in field.edges if kind == 1]
        hide: set[int] = set()
        for a, b in sorted(pairs, key=lambda p: p[1]):
            if field.taught[b] and a not in hide:
                hide.add(b)
        if not hide:
            continue
        x, clamped, edges = stack([field])
        at = sorted(hide)
        clamped[at] = 0
        x[np.ix_(at, range(1, FEATURES) if everything else EVIDENCE)] = 0
        p = crf.marginals(x, clamped, edges, *stack_plain([field]))
        found += sum(int(p[i].argmax() == field.taught[i] and p[i].max() >= sure) for i in at)
        asked += len(at)
    return found, asked


def find(docs: DataFrame, crf: Crf, sure: float = SURE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added, n_spans.

    Spans are kind:start:end in code points, end exclusive, by start, then kind, joined by commas; added ones can be of
    the kind secret.  One row per input row; null or empty text: no spans.  Null ids and repeated rows are searched like
    others.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_find(crf, sure), RESULT)
