"""What the skip-chain field's distant potentials do, and which texts its fit takes."""

import random

from tessera.llm import pii

SCHEMA = "doc_id long, text string"


def texts(n, seed):
    """Documents with personal data, some of it more than once."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    out = []
    for _ in range(n):
        kind = rng.choice(("mail", "ip", "phone", "token"))
        value = {
            "mail": lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.org",
            "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
            "phone": lambda: f"+1-{rng.randint(200, 999)}-555-{rng.randint(1000, 9999)}",
            "token": lambda: 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"',
        }[kind]()
        words = [word() for _ in range(rng.randint(20, 60))]
        words += [str(rng.randint(1, 9999)) for _ in range(3)] + [f"{word()}{rng.randint(1, 9)}" for _ in range(2)]
        rng.shuffle(words)
        for _ in range(rng.choice((1, 1, 2, 3))):
            words.insert(rng.randrange(len(words)), value)
        out.append(" ".join(words))
    return out


def test_distant_mentions_carry_labels():
    own, held = texts(300, 1), texts(200, 2)
    crf = pii.Crf.fit([pii.Field(t, pii.base_spans(t)) for t in own])
    found, asked = pii.hidden_mentions(held, crf)
    alone, same = pii.hidden_mentions(held, pii.without_distance(crf))
    assert asked == same > 50 and found >= 0.9 * asked and alone <= 0.5 * asked
    # plain numbers and words with digits aren't drawn along
    clean = [" ".join(w for w in t.split(" ") if "@" not in w and not pii.base_spans(w) and len(w) < 20 and w not in ("token", "=")) for t in held]
    for t in clean:
        field = pii.Field(t, [])
        if field.spans:
            x, y, edges = pii.stack([field])
            assert pii.added_spans(t, field, crf.marginals(x, y, edges, *pii.stack_plain([field])), []) == []


def test_a_long_text_does_not_end_the_choice(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 3))]
    size = sum(len(t) for _, t in rows)
    with_long = spark.createDataFrame(rows + [(900 + i, "9 " * size) for i in range(8)], SCHEMA)
    alone = pii.fit(spark.createDataFrame(rows, SCHEMA))
    got = pii.fit(with_long, most_chars=size)
    assert (got.pair == alone.pair).all() and (got.node == alone.node).all() and abs(got.pair).max() > 0
