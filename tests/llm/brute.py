"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(docs, width, percent):
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for c in ids[i + 1 :]:
            same = len(sets[a] & sets[c])
            if same and 100 * same >= percent * len(sets[a] | sets[c]):
                x, y = find(a), find(c)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def removed(docs, length, by_word):
    """doc_id -> (n, removed, runs, sha256 of what is kept)."""
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        units = (t or "").encode().split() if by_word else (t or "").encode()
        gone, own = bytearray(len(units)), []
        for i in range(len(units) - length + 1):
            key = tuple(units[i : i + length])
            if key in seen:
                gone[i : i + length] = b"\1" * length
            own.append(key)
        seen.update(own)
        kept = [u for u, g in zip(units, gone) if not g]
        kept = b" ".join(kept) if by_word else bytes(kept)
        out[d] = (len(units), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def base_quality(text):
    t = text or ""
    w, seen, dup = WORD.findall(t), set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def personal(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            s = [int(c) for c in digits[::-1]]
            luhn = sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(s)) % 10 == 0
            if (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 12 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def edit_distance(item, text):
    """Least distance of item to a substring of text, and the first end of such a one."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row), row.index(min(row))


def boilerplate(docs, least):
    """docs: (id, text, source) -> id: (lines, removed, text)."""
    sites = {}
    bare = lambda x: x.strip(" \t\r\f\x0b")
    for _, t, s in docs:
        for line in set((t or "").split("\n")) if t is not None and s is not None else ():
            if bare(line):
                sites.setdefault(bare(line), set()).add(s)
    gone = {x for x, s in sites.items() if len(s) >= least}
    out = {}
    for d, t, _ in docs:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if bare(x) not in gone]
        out[d] = (len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept))
    return out
