"""Personal data: patterns against the plain expressions, the field against exact sums, added spans."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from bizmetrics.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_email string, h string"
PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    """The four expressions as they are."""
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2:
                twice = [int(d) * 2 for d in digits[-2::-2]]
                total = sum(int(d) for d in digits[-1::-2]) + sum(d // 10 + d % 10 for d in twice)
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_patterns_are_the_plain_ones():
    rng = random.Random(4)
    pieces = ["4316522678525456", "4111 1111 1111 1111", "+1 (523) 555-1055", "a.b@c.de", "@", ".", "1.2.3.4", "..", "256", " ", "-", "+", "x", "é", "0", "00255", "(", ")", "\n", "a@b.c@d.e@f.g", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert pii.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["9" * 200_000, "x" * 200_000, "a@" * 100_000, "1." * 100_000, "+1 " * 70_000, "+1" + " (" * 100_000, "1 " * 100_000, "0" * 5000 + ".1.1.1"])
def test_long_texts_take_linear_time(text):
    pii.found([text], pii.train(pii.field([], [])))


def _field(labels, chain, skip):
    n = len(labels)
    features = np.zeros((n, pii.WIDTH), np.int64)
    features[:, 0] = np.arange(n)
    edges = [np.array(e, np.int64).reshape(-1, 2) for e in (chain, skip)]
    return pii.Field(np.zeros(n), np.arange(n), np.arange(n) + 1, np.array(labels), features, *edges)


def _model(seed):
    rng = np.random.default_rng(seed)
    weights = np.zeros((pii.FEATURES, pii.LABELS))
    weights[1:9] = rng.normal(size=(8, pii.LABELS))
    tables = rng.normal(size=(2, pii.LABELS, pii.LABELS))
    return pii.Model(weights, tables[0] + tables[0].T, tables[1] + tables[1].T)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_messages_are_exact_on_trees(seed, monkeypatch):
    """On a field without cycles the posteriors are those of all labellings."""
    monkeypatch.setattr(pii, "ROUNDS", 60)
    of, model = _field([0, 0, 2, 0, 0], [(0, 1), (1, 2)], [(1, 3), (3, 4)]), _model(seed)
    own = model.weights[of.features].sum(axis=1)
    own[2, 2] += pii.FIXED
    want = np.zeros((5, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=5):
        score = sum(own[i, y] for i, y in enumerate(labels))
        score += sum(model.chain[labels[a], labels[b]] for a, b in of.chain)
        score += sum(model.skip[labels[a], labels[b]] for a, b in of.skip)
        for i, y in enumerate(labels):
            want[i, y] += np.exp(score)
    want /= want.sum(axis=1, keepdims=True)
    assert np.allclose(model.posteriors(of), want, atol=1e-6)


def test_skip_edges_decide():
    """The same node is another label with than without its distant repeat."""
    model = _model(5)
    model.weights[:] = 0
    model.skip[:] = np.where(np.eye(pii.LABELS) > 0, 3.0, -3.0)
    assert model.posteriors(_field([0, 4], [], [(0, 1)]))[0].argmax() == 4
    assert model.posteriors(_field([0, 4], [], []))[0].max() < 0.5


def corpus():
    rng = random.Random(7)
    words = ["call", "the", "office", "about", "a", "note", "on", "Monday"]
    text = lambda k: " ".join(rng.choices(words, k=k))
    rows = []
    for i in range(400):
        part, last = rng.randint(200, 999), rng.randint(1000, 9999)
        entity = rng.choice([f"+1 ({part}) 555-{last}", f"user{i}.x@mail.example.com", f"10.{i % 256}.3.{i % 200}", "4316522678525456", f"item {i}", f"AKIA{i}QX"])
        rows.append((i, f"{text(9)} {entity} {text(7)}"))
    return rows


def run(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "s", "n", "h") for r in rows], SCHEMA).repartition(parts)
    got = pii.personal_data(df)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return {(r.doc_id, i): r for i, r in enumerate(sorted(got.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)))}


def test_base_stays_and_repeats_are_added(spark):
    rows = corpus()
    extra = [
        (1000, "call the office +1 (523) 555-1055 about a note and then 555-1055 again"),
        (1001, "call the office about 555-1055 on Monday"),  # no evidence here
        (1002, "AKIA77QX and +1 (523) 555-1055 and AKIA77QX"),
        (1003, "user5.x@mail.example.com wrote; user5.x@mail.example.com."),
    ]
    by_id = dict(rows + extra)
    got = run(spark, rows + extra)
    for r in got.values():
        base = plain(by_id[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(1 for s in base if s[1] == k) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert {pii.joined([s]) for s in base} <= set(every)
        if r.doc_id < 1000:
            assert len(every) == len(base)  # nothing repeats in these
    spans = {r.doc_id: r.spans for r in got.values()}
    at = by_id[1000].rindex("555")
    assert f"phone:{at}:{at + 8}" in spans[1000].split(",")
    assert spans[1001] == ""
    assert spans[1002].count(":") == 2
    assert spans[1003].count("email") == 2


def test_independent_of_partitions(spark):
    rows = corpus()[:120]
    one, many = run(spark, rows, 1), run(spark, rows, 9)
    assert one == many


def test_defined_cases(spark):
    long = "word " * 50_000 + "a@b.cd " * 3000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "é 😀 a@b.cd"), (4, "é 😀 a@b.cd"), (None, "1.2.3.4"), (6, long), (7, "5 @ 7 + -")]
    got = list(run(spark, rows).values())
    assert [r.n_email for r in got] == [0, 0, 0, 1, 1, 3000, 0, 0]
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    assert got[3] == got[4] and "email:4:10" in got[3].spans.split(",")
    assert got[7].doc_id is None and got[7].n_ip == 1


def test_empty_table(spark):
    assert run(spark, []) == {}
    assert [r.spans for r in run(spark, [(1, "no such thing")]).values()] == [""]
