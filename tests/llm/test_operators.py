import functools
import random
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tessera.llm import anchored, components, decontaminate, fmindex, licenses, lines, minhash, packing, pii, quality, storage, suffix, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, q int, u long, bucket string, key string, __key string, kept boolean, label int"


def corpus(seed=0, n=60):
    """Texts with copies, near copies, shared passages and lines, and the odd cases."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=40))
    line = "Common line of many sites"
    texts = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(1, 150))
        if i % 5 == 1 and texts:
            words = rng.choice(texts).split(" ")
        if i % 5 == 2 and texts:
            words = rng.choice(texts).split(" ")
            for _ in range(max(1, len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        if i % 4 == 0:
            text += "\n" + line + " \n" + passage
        texts.append(text)
    texts += ["", "   \n\t ", "one", "two words", "a a a a a a a a a a a a a a a a a a a a a a a a a", "x" * 300, "x" * 300, "ab " * 3000, "é" * 60 + " É ü"]
    return [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]


def frame(spark, docs):
    rows = [(d, t, "en" if i % 3 else None, f"s{i % 12}" if i % 7 else None, None, 1, 2, "b", "k", "z", True, 3) for i, (d, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(), frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def repeated(df):
    """Repeated rows, and a row without an id."""
    return df.unionByName(df.filter("doc_id % 9 = 0")).unionByName(df.filter("doc_id = 3").selectExpr("CAST(NULL AS long) AS doc_id", *df.columns[1:]))


def test_near_duplicates(spark, docs, empty):
    rows, df = docs
    for width, percent in ((3, 85), (5, 80), (1, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, width, percent).collect()}
        assert got == brute.components(rows, width, percent)
    assert minhash.near_duplicates(empty).collect() == []
    twice = minhash.near_duplicates(repeated(df), 3, 85).collect()
    want = brute.components(rows, 3, 85)
    assert len(twice) == repeated(df).count() and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in twice if r.doc_id is not None)
    assert [r.kept for r in twice if r.doc_id is None] == [True]


def test_second_pass_of_near_duplicates(spark, monkeypatch):
    """Two near copies whose bucket leader is too far from both."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    docs = []
    for d in range(40):
        w = list(base)
        for _ in range(rng.choice((2, 6, 12, 20))):
            w[rng.randrange(300)] = f"e{rng.randrange(40)}"
        docs.append((d, " ".join(w)))
    docs += [(d + 40, t) for d, t in docs[:3] for _ in range(2)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), 3, 85).collect()}
    assert got == brute.components(docs, 3, 85)
    # in cells of few members
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), 3, 85, cell=3).collect()} == got
    # and with all joins by bucket or set salted
    monkeypatch.setattr(minhash, "lookup", functools.partial(minhash.lookup, most_rows=0))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), 3, 85).collect()} == got


def test_near_duplicates_broadcast_what_is_measured_alone(spark, docs, monkeypatch):
    """F1 of round 4: Spark's own choice of broadcasts goes by bytes of compressed files, which say little of what the driver gets."""
    rows, df = docs
    want = brute.components(rows, 3, 85)
    monkeypatch.setattr(minhash, "lookup", functools.partial(minhash.lookup, most_rows=-1))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        got = minhash.near_duplicates(repeated(df), 3, 85).collect()
        kept = minhash.keep_one(df).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None) and len(got) == repeated(df).count()
    assert kept == minhash.keep_one(df).count()


def test_least_text_stands_for_a_repeated_id(spark):
    """Ids with several texts: the result is that of their least texts alone, whichever of them has the least print."""
    rng = random.Random(6)
    texts = lambda k: " ".join(f"{k}{rng.randrange(10**6)}" for _ in range(80))
    docs, alone = [], []
    for i in range(0, 80, 2):
        words = texts("a").split()
        near = words[:40] + ["new"] + words[40:]
        docs += [(i, " ".join(words)), (i, "z " + texts("z")), (i, ""), (i + 1, " ".join(near)), (i + 1, "y " + texts("y"))]
        alone += [(i, " ".join(words)), (i + 1, " ".join(near))]
    want = brute.components(alone, 3, 85)
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame(spark, docs), 3, 85).collect()}
    assert got == {(d, c) for d, (_, c) in want.items()} and any(d != c for d, c in got)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (70, 70), (1, 0), (200, 201)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(31)} | {50: 50, 70: 50, 100: 50, 200: 200, 201: 200}
    # a hub is joined in portions, and so is everything where hubs are too many
    star = spark.createDataFrame(edges + [(0, 300 + i) for i in range(40)] + [(400 + i, 339) for i in range(9)], "u long, v long")
    want = got | {300 + i: 0 for i in range(40)} | {400 + i: 0 for i in range(9)}
    assert dict(components.connected_components(star, hub=4).collect()) == want


def test_hubs_are_spread(spark):
    big = spark.createDataFrame([(k, v) for k in range(6) for v in range(k * k * 3)], "u long, v long")
    small = big.groupBy("u").count().withColumn("m", big.u * 10)
    want = sorted((r.u, r.v, r.u * 10) for r in big.collect())
    for most, hubs in ((10_000, 10), (5, 10), (5, 1)):
        got = storage.by_hub(big, small, "u", "v", "count", most, hubs).select("u", "v", "m")
        assert sorted(map(tuple, got.collect())) == want


def test_bucket_pointers_are_ranks():
    rng = random.Random(2)
    for _ in range(20):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 200)))
        got = suffix.bucket_pointers(np.frombuffer(data, np.uint8), 13, 3)
        keys = [data[i : i + 13].ljust(13, b"\0") for i in range(len(data))]
        assert [sorted(keys).index(k) + 1 for k in keys] == got.tolist()


def test_refinement_in_small_portions():
    """Periodic and repetitive data, deep and shallow, with portions down to single buckets."""
    rng = random.Random(9)
    for text in (b"a" * 300, b"abcabd" * 60, b"ab" * 40 + b"ba" * 40, bytes(rng.choice(b"abc") for _ in range(50)) * 6, bytes(rng.randrange(1, 256) for _ in range(400))):
        for depth in (8, 9, 20, 50):
            keys = [text[i : i + depth].ljust(depth, b"\0") for i in range(len(text))]
            want = [sorted(keys).index(k) + 1 for k in keys]
            for portion in (1, 64, 1 << 16):
                assert suffix.bucket_pointers(np.frombuffer(text, np.uint8), depth, 8, portion).tolist() == want


def test_index_of_words_and_documents():
    rng = np.random.default_rng(3)
    for n, words, docs, length in ((1, 1, 1, 2), (7, 2, 3, 3), (200, 3, 9, 4), (500, 40, 70, 3)):
        text, document = rng.integers(1, words + 1, n), np.sort(rng.integers(0, docs, n))
        text[-1] = 0
        fm = fmindex.FmIndex(text, document, length)
        starts = np.arange(max(0, n - length))
        reached, low, high = fm.matching(text, starts, length)
        for i, r, lo, hi in zip(starts, reached, low, high):
            runs = [[j for j in range(n - k + 1) if (text[j : j + k] == text[i + length - k : i + length]).all()] for k in range(1, length + 1)]
            assert r == next((k for k, found in enumerate(runs, 1) if len(found) == 1), length)
            assert hi - lo == len(runs[r - 1])
            assert fm.documents.least(np.array([lo]), np.array([hi])) == min(document[j] for j in runs[r - 1])


def test_equal_hashes_are_no_equality(monkeypatch):
    """With a hash that tells little apart, results stay exact, as bytes are compared."""
    docs = [(0, b"alpha beta gamma delta eps zeta"), (1, b"alpha betb gamma delta eps zetb")]
    data = np.frombuffer(b"".join(t for _, t in docs), np.uint8)
    offs = np.append(0, np.cumsum([len(t) for _, t in docs]))
    monkeypatch.setattr(anchored.b, "hashes", lambda buf, offs: np.zeros(len(offs) - 1, np.uint64))
    monkeypatch.setattr(fmindex.b.Spans, "__call__", lambda self, starts, ends: np.zeros(len(starts), np.uint64))
    least = anchored.once(fmindex.least_document(3), anchored.Segments(data, offs, np.array([5, 7]), np.array([4, 4])))
    assert least.tolist() == [5, 5, 5, 5, 7, 7, 5, 7]


@pytest.mark.parametrize("by_word", [False, True])
def test_repeats(spark, docs, empty, by_word):
    rows, df = docs
    f = fmindex.remove_repeated_words if by_word else suffix.remove_repeated_bytes
    for length, gram in ((13, 5), (6, 2)) if by_word else ((50, 20), (20, 8)):
        want = brute.removed(rows, length, by_word)
        got = {r.doc_id: r for r in f(df, length, gram).collect()}
        assert {d: (r[1], r.n_removed, r.kept_sha256) for d, r in got.items()} == {d: (w[0], w[1], w[3]) for d, w in want.items()}
        if not by_word:
            assert {d: r.n_spans for d, r in got.items()} == {d: w[2] for d, w in want.items()}
    assert f(empty).collect() == []
    more = f(repeated(df)).collect()
    assert len(more) == repeated(df).count()
    last = brute.removed([(0, rows[3][1]), (1, rows[3][1])], 13 if by_word else 50, by_word)[1]
    assert [r.n_removed for r in more if r.doc_id is None] == [last[1]]


def test_repeats_settled_in_groups(spark):
    """A passage in all documents, in one group and over many."""
    rng = random.Random(3)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(60))
    docs = [(d, f"{' '.join(f'o{rng.randrange(10**6)}' for _ in range(20))} {passage} {' '.join(f'o{rng.randrange(10**6)}' for _ in range(20))}") for d in range(200)]
    df = frame(spark, docs)
    assert {r.doc_id: r.n_removed for r in fmindex.remove_repeated_words(df).collect()} == {d: w[1] for d, w in brute.removed(docs, 13, True).items()}
    assert {r.doc_id: r.kept_sha256 for r in suffix.remove_repeated_bytes(df).collect()} == {d: w[3] for d, w in brute.removed(docs, 50, False).items()}


def test_quality(spark, docs, empty):
    rows, df = docs
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    for d, t in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_quality(t)
        assert not (r.base_failed and r.kept)
    assert quality.quality(empty).collect() == []
    assert quality.quality(repeated(df)).count() == repeated(df).count()
    assert set(quality.keep_good(df).columns) == set(df.columns)


def test_divergence(spark):
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.2, 0.7])
    m = (p + q) / 2
    want = np.sqrt(sum(x * np.log2(x / y) for x, y in zip(p, m) if x) / 2 + sum(x * np.log2(x / y) for x, y in zip(q, m) if x) / 2)
    df = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>")
    assert abs(df.select(quality.jensen_shannon(df.p, df.q)).first()[0] - want) < 1e-12
    good = [(i, " ".join(random.Random(i).choices("the of and house tree water stone to in that".split(), k=200))) for i in range(50)]
    junk = [(99, " | ".join(random.Random(9).choices(["XQ#", "ZZ%", "9$$"], k=200)) + " " + " ".join(map(str, range(80))))]
    kept = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame([(d, t, "en") for d, t in good + junk], "doc_id long, text string, lang string")).collect()}
    assert not kept[99]


def test_joint_limit_of_short_texts(spark):
    """Junk of 40 to 99 words goes though neither distance is far; texts of the same length like the others stay."""
    words = "the of and house tree water stone to in that".split()
    text = lambda i, n: " ".join(random.Random(i).choices(words, k=n))
    table = [(900 + n, text(n, n // 5) + " " + " ".join(f"stock{i % 7} |" if i % 2 else "carton" + "abcdefgh"[i % 8] for i in range(n // 2))) for n in (60, 80, 95)]
    rows = [(i, text(i, 200)) for i in range(50)] + [(800 + n, text(n, n)) for n in (60, 80, 95)] + table
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")).collect()}
    for d, _ in table:
        r = got[d]
        assert 40 <= r.n_words < 100 and not r.base_failed and r.class_distance < quality.MOST_CLASS and r.word_distance < quality.MOST_WORD and not r.kept, r
    assert all(got[800 + n].kept for n in (60, 80, 95))


def test_personal_data(spark, docs, empty):
    texts = ["a@b", "x.y@mail.example.org, 10.0.0.1 999.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 3", "a@b.c@d.e 1.2.3.4.5.6.7.8", "é@x.y +49 30 1234567", "a" * 5000 + "@b.co", "1" * 3000, "+" * 2000, None, ""]
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + docs[0]
    df = frame(spark, rows)
    crf = pii.fit(df)
    got = {r.doc_id: r for r in pii.find(df, crf).collect()}
    for d, t in rows:
        base = brute.personal(t)
        assert pii.base_spans(t or "") == base
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
        assert set(pii._render(base).split(",")) <= set(got[d].spans.split(",")) | {""}
    assert pii.find(empty, pii.fit(empty)).collect() == []
    assert pii.find(repeated(df), crf).count() == repeated(df).count()


def test_skip_edges_pull_repeated_tokens():
    """A token that is unsure by itself takes the label of an equal one elsewhere."""
    node, pair = np.zeros((pii.FEATURES, 5)), np.zeros((2, 5, 5))
    node[0, 0] = 1.0
    pair[1][4, 4] = 9.0
    text = "call +1-555-123-4567 now " + "word " * 50 + "1-555-123-4567 again"
    base = pii.base_spans(text)
    field = pii.Field(text, base)
    x, y, edges = pii.stack([field])
    assert len(base) == 1 and len(edges) == 1
    p = pii.Crf(node, pair).marginals(x, y, edges)
    assert [text[s:e] for s, _, e in pii.added_spans(text, field, p, base)] == ["1-555-123-4567"]
    assert pii.added_spans(text, field, pii.Crf(node, pair * 0).marginals(x, y, edges), base) == []


def test_message_passing_is_exact_on_a_tree():
    rng = np.random.default_rng(0)
    crf = pii.Crf(rng.normal(size=(pii.FEATURES, 5)), rng.normal(size=(2, 5, 5)))
    x = rng.integers(0, 2, (4, pii.FEATURES)).astype(float)
    edges = np.array([(0, 1, 0), (1, 2, 1), (1, 3, 0)])
    score = np.zeros((5,) * 4)
    for at in np.ndindex(*score.shape):
        score[at] = sum((x[i] @ crf.node)[at[i]] for i in range(4)) + sum(crf.pair[e][at[a], at[c]] for a, c, e in edges)
    p = np.exp(score - score.max())
    p /= p.sum()
    want = np.stack([p.sum(tuple(k for k in range(4) if k != i)) for i in range(4)])
    assert np.abs(crf.marginals(x, np.zeros(4, int), edges) - want).max() < 1e-2


def test_plain_tokens_are_summed_out_exactly():
    """Marginals of a field with gaps equal those of the whole chain by enumeration."""
    rng = np.random.default_rng(1)
    k = len(pii.LABELS)
    crf = pii.Crf(rng.normal(size=(pii.FEATURES, k)) / 2, rng.normal(size=(3, k, k)))
    for text in ("a b +1 c d 22", "9 x y", "x 1-1 2@2 y"):
        field = pii.Field(text, [])
        x, y, edges = pii.stack([field])
        got = crf.marginals(x, y, edges[edges[:, 2] == 0], *pii.stack_plain([field]))
        tokens = list(pii.TOKEN.finditer(text))
        node = [crf.node[field.features[field.spans.index(m.span())]].sum(0) if m.span() in field.spans else crf.node[pii.PLAIN].sum(0) for m in tokens]
        score = np.zeros((k,) * len(tokens))
        for at in np.ndindex(*score.shape):
            score[at] = sum(node[i][at[i]] for i in range(len(tokens))) + sum(crf.pair[0][at[i], at[i + 1]] for i in range(len(tokens) - 1))
        p = np.exp(score - score.max())
        p /= p.sum()
        want = [p.sum(tuple(j for j in range(len(tokens)) if j != i)) for i, m in enumerate(tokens) if m.span() in field.spans]
        assert np.abs(got - np.stack(want)).max() < 1e-2


def test_field_finds_secrets(spark):
    """Announced secrets teach the field; it finds them, also without the announcement, and adds nothing to clean texts."""
    rng = random.Random(7)
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(36)) + "a1b2"
    quote = lambda i, c: f'"{c}"' if i % 2 else c
    rows = [(i, f"some words here {rng.randrange(100)} token = {quote(i, code())} and more words at {i}.") for i in range(60)]
    rows += [(100 + i, f"plain words about {rng.randrange(3000)} things, no secret {i}.") for i in range(100)]
    again = code()
    rows += [(300, f"the key = {again} " + "word " * 30 + f"then {again} once more"), (301, f"x {code()}!! y")]
    df = frame(spark, rows)
    got = {r.doc_id: r for r in pii.find(df, pii.fit(df)).collect()}
    texts = dict(rows)
    cut = {d: [texts[d][int(s.split(":")[1]) : int(s.split(":")[2])] for s in r.spans.split(",") if s.startswith("secret")] for d, r in got.items()}
    assert all(len(cut[i]) == 1 and len(cut[i][0]) == 40 and cut[i][0] in texts[i] for i in range(60))
    assert cut[300] == [again, again] and len(cut[301]) == 1 and not any(got[100 + i].n_spans for i in range(100))
    assert all(r.n_spans == r.n_added + r.n_email + r.n_ip + r.n_card + r.n_phone for r in got.values())


def test_decontamination(spark, docs, empty):
    rng = random.Random(5)
    items = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 150))).strip() for _ in range(6)] + ["short", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = []
    for i in range(40):
        t = "".join(rng.choice("abcdefgh ") for _ in range(300))
        if i % 2:
            item = list(items[i % 6])
            for _ in range(rng.randint(0, 9)):
                item[rng.randrange(len(item))] = rng.choice("xyz")
            t = t[:100] + "".join(item).upper() + t[100:]
        texts.append((i, t))
    texts += [(90, None), (91, "")]
    df = frame(spark, texts)
    want = {}
    for d, t in texts:
        for k, item in enumerate(items):
            x = decontaminate.normal(item or "")
            if len(x) >= 12:
                best = brute.edit_distance(x, decontaminate.normal(t or ""))
                if best[0] <= int(0.05 * len(x)):
                    want[d, k] = best
    for size in (1 << 20, 100):  # one block of items, and many
        got = {(r.doc_id, r.item_id): (r.distance, r.end) for r in decontaminate.contaminated(df, bench, block_chars=size).collect()}
        assert got == want
    assert any(d for d, _ in want.values())
    assert decontaminate.contaminated(empty, bench).collect() == []
    assert decontaminate.contaminated(df, bench.filter("false")).collect() == []
    assert {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()} == {d for d, _ in texts} - {d for d, _ in want}


def test_short_benchmark_items(spark):
    """Items under 12 characters are met exactly, at word borders."""
    bench = spark.createDataFrame([(1, "is  42 So?"), (2, "cat"), (3, " \n"), (4, "a long item of words")], "item_id long, text string")
    df = frame(spark, [(0, "It is 42 so? Yes"), (1, "concat, cats. Cat!"), (2, "concat cats"), (3, "this 42 so?"), (4, "cat"), (5, "a long item of wards")])
    got = sorted((r.doc_id, r.item_id, r.distance, r.budget, r.end) for r in decontaminate.contaminated(df, bench).collect())
    assert got == [(0, 1, 0, 0, 12), (1, 2, 0, 0, 17), (4, 2, 0, 0, 3), (5, 4, 1, 1, 20)]


def test_hilbert_steps():
    x = np.array(list(np.ndindex(8, 8, 8)))
    key = packing.hilbert(x, 3)
    assert sorted(key) == list(range(512)) and (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_packing_round_trip(spark, docs, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = docs[0] + [(500, "special <|endoftext|> text"), (501, "日本語     x"), (502, "word " * 9000)]
    paths = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")
    exact = Tokenizer.from_file(paths[0])
    got = packing.pack(frame(spark, rows), *paths, length=256).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for d, t in rows:
        parts = sorted(by_doc[d], key=lambda r: r.start)
        ids = [*exact.encode(t or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(b"".join(p.ids for p in parts), "<u4").tolist() == ids and all(p.doc_tokens == len(ids) for p in parts)
        assert [p.start for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        total = sum(p.length for p in parts)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist() and total <= 256 and total & (total - 1) == 0
    assert packing.pack(empty, *paths).collect() == []
    again = packing.pack(repeated(frame(spark, rows)), *paths).groupBy().sum("length").first()[0]
    assert again > sum(r.length for r in got)


def test_lines(spark, docs, empty):
    rows, df = docs
    sources = {r.doc_id: r.source for r in df.collect()}
    for least in (3, 6):
        want = brute.boilerplate([(d, t, sources[d]) for d, t in rows], least)
        for held in (lines.MOST_HELD, 0):
            got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.clean_lines(df, least, held).collect()}
            assert got == want
    assert any(w[1] for w in want.values())
    assert lines.clean_lines(empty).collect() == []
    for held in (lines.MOST_HELD, 0):
        more = lines.clean_lines(repeated(df), 3, held)
        assert more.count() == repeated(df).count() and set(df.columns) <= set(more.columns)


def test_licenses(spark, docs, empty):
    texts = [licenses.MIT.replace("<year> <copyright holders>", "2020 A. Person"), licenses.MIT.upper().replace("SUBLICENSE", "sub-license"), "x\nReleased under the MIT LICENCE!\ny", "Licensed under CC BY-NC 4.0", "", None, licenses.ISC + " more"]
    df = frame(spark, list(enumerate(texts)))
    got = {r.doc_id: (r.license_id, r.notice_ids) for r in licenses.scan(df, licenses.catalogue(spark)).collect()}
    assert got[0] == ("MIT", "") and got[1] == ("MIT", "") and got[2] == (None, "MIT") and got[3] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0")
    assert got[4] == (None, "") and got[5] == (None, "") and got[6][0] is None
    assert licenses.scan(empty, licenses.catalogue(spark)).collect() == []
    assert licenses.scan(repeated(df), licenses.catalogue(spark)).count() == repeated(df).count()


def test_known_licenses(spark):
    """Whole texts as they stand on disk, filled in, without appendix; headers; SPDX tags."""
    text = lambda i: (Path(licenses.__file__).parent / "texts" / f"{i}.txt").read_text()
    bsd = licenses.BSD.format(third=licenses.THIRD.format("the copyright holder"), holders="COPYRIGHT HOLDERS", holder="COPYRIGHT HOLDER")
    cases = [(i, text(i)) for i in licenses.IN_FILES]
    cases += [("Apache-2.0", text("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2021 A. Person")), ("GPL-3.0", text("GPL-3.0").split("How to Apply")[0])]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, A. Person\nAll rights reserved.\n\n" + bsd), ("BSD-3-Clause", "Copyright 2020 A. Person. All rights reserved.\n\n" + bsd), ("BSD-2-Clause", bsd.replace(licenses.THIRD.format("the copyright holder"), ""))]
    cases += [("MIT", "The MIT License (MIT)\n" + licenses.MIT.split("\n", 1)[1]), ("MIT", licenses.MIT.split("\n\n", 1)[1]), ("Apache-2.0", licenses.APACHE)]
    notices = [("Apache-2.0", '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file'), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;"), ("BSD-3-Clause", "/* SPDX-License-Identifier: BSD-3-Clause */\nint x;"), ("LGPL-2.1", "x\nReleased under the GNU LGPL v2.1\ny".replace("LGPL v", "LGPLv"))]
    df = frame(spark, list(enumerate(t for _, t in cases + notices)))
    got = {r.doc_id: r for r in licenses.scan(df, licenses.catalogue(spark)).collect()}
    assert [got[k].license_id for k in range(len(cases))] == [i for i, _ in cases]
    assert [got[len(cases) + k].notice_ids for k in range(len(notices))] == [i for i, _ in notices]


def test_wrapped_licenses(spark):
    """Whole texts broken over lines anew, at several widths, and in other case: lines that begin with the word
    copyright, and lists that begin with (c), are no lines of rights then."""
    import textwrap

    text = lambda i: (Path(licenses.__file__).parent / "texts" / f"{i}.txt").read_text()
    own = [("MIT", licenses.MIT), ("ISC", licenses.ISC), ("Zlib", licenses.ZLIB), ("BSD-3-Clause", licenses.BSD.format(third=licenses.THIRD.format("the copyright holder"), holders="COPYRIGHT HOLDERS", holder="COPYRIGHT HOLDER"))]
    own = [(i, t.replace("<year> <copyright holders>", "2020 A. Person").replace("<year> <owner>", "2020 A. Person")) for i, t in own]
    own += [(i, text(i)) for i in ("Apache-2.0", "CC0-1.0", "MPL-2.0")]

    def wrapped(t, width):
        return "\n\n".join(textwrap.fill(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False) for part in t.split("\n\n"))

    cases = [(i, f(wrapped(t, width))) for i, t in own for width in (60, 72, 79, 400) for f in (str, str.upper)]
    got = {r.doc_id: r.license_id for r in licenses.scan(frame(spark, list(enumerate(t for _, t in cases))), licenses.catalogue(spark)).collect()}
    missed = [(i, k) for k, (i, _) in enumerate(cases) if got[k] != i]
    assert not missed


def test_queries_equal_their_sql(spark):
    """Every query with SQL against DuckDB, on the smallest tables."""
    import duckdb

    from tessera.llm import queries

    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("needs the test tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    made = queries.queries()
    for name, text in queries.oracle_sql().items():
        found = con.execute(text)
        columns = [c[0] for c in found.description]
        df = made[name](spark, data)
        assert sorted(df.columns) == sorted(columns), name
        # nulls, of texts and of numbers, alike on both sides
        plain = lambda rows: sorted((tuple("" if v is None else v for v in r) for r in rows), key=str)
        assert plain(tuple(r[c] for c in columns) for r in df.collect()) == plain(found.fetchall()), name


def test_chain_equals_a_plain_loop():
    """Out-of-fold probabilities and weights against models fitted one by one."""
    rng = np.random.default_rng(3)
    x, fold = rng.integers(0, 2, (90, 4)).astype(float), rng.integers(0, toxicity.FOLDS, 90)
    y = np.column_stack([x[:, 0] * (rng.random(90) < 0.8), x[:, 1], x[:, 0]]).astype(int)
    chain = toxicity.Chain(np.arange(4, dtype=np.uint64), np.ones(4, np.int64), x, y, fold)
    wide, weights = x.tolist(), []
    for k in range(3):
        new = [0.0] * 90
        for f in range(toxicity.FOLDS):
            rest = [i for i in range(90) if fold[i] != f]
            w = toxicity.fit_logistic(np.array([wide[i] for i in rest]), y[rest, k].astype(float))
            for i in range(90):
                if fold[i] == f:
                    new[i] = 1 / (1 + np.exp(-(sum(a * c for a, c in zip(wide[i], w)) + w[-1])))
        weights.append(toxicity.fit_logistic(np.array(wide), y[:, k].astype(float)))
        wide = [[*r, v] for r, v in zip(wide, new)]
    assert all(np.allclose(a, c, atol=1e-6) for a, c in zip(chain.weights, weights))
    out = []
    for row in x.tolist():
        for w in weights:
            row = [*row, 1 / (1 + np.exp(-(sum(a * c for a, c in zip(row, w)) + w[-1])))]
        out.append(row[-3:])
    assert np.allclose(chain.score(x), out, atol=1e-6)


def test_categories_come_from_the_data():
    x = np.array([[1, 1, 0, 0]] * 5 + [[0, 0, 1, 1]] * 8 + [[0, 0, 0, 0]] * 6, float)
    y = toxicity.categories(x, np.array([1] * 13 + [0] * 6))
    assert y.tolist() == [[0, 1, 1]] * 5 + [[1, 0, 1]] * 8 + [[0, 0, 0]] * 6
    assert toxicity.categories(x[:3], np.array([1, 1, 1])).tolist() == [[1, 0, 1]] * 3 and toxicity.categories(x[:0], np.zeros(0, int)).shape == (0, 3)


def test_toxicity(spark, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        words = rng.choices([f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)], k=60) + (rng.choices(["idiot", "moron", "trash", "stupid"], k=2) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + "."))
        labels.append((i, int(bad)))
    df = frame(spark, rows + [(9000, None), (9001, "")])
    known = spark.createDataFrame([r for r in labels if r[0] % 2 == 0 or r[0] % 5] [:400] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.fit(df, known)
    got = {r.doc_id: r for r in toxicity.score(df, chain).collect()}
    held = [i for i in range(420, 600)]
    assert np.mean([got[i].toxic == bool(labels[i][1]) for i in held]) >= 0.97
    assert not got[9000].toxic and not got[9001].toxic
    assert toxicity.score(empty, toxicity.fit(empty, known.filter("false"))).collect() == []
    assert toxicity.score(repeated(df), chain).count() == repeated(df).count()
