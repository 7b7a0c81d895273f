"""Decontamination, collocations and hard negatives against plain versions, over tables that hold the awkward cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import collocations, decontaminate, hard_negatives, tables


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def ordered(values):
    return sorted(values, key=repr)


# decontamination


def spoken(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(text)) if w]


def plain_hits(docs, items):
    """A row for each document, as the contract has it."""
    known = {}
    for item, text in items:
        w = spoken(text)
        for s in range(max(1, len(w) - 9) if w else 0):
            known.setdefault(tuple(w[s : s + 10]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, found = spoken(text), set(), set()
        for s in range(len(w)):
            for n in range(1, 11):
                own = known.get(tuple(w[s : s + n])) if s + n <= len(w) else None
                if own is not None:
                    hit |= set(range(s, s + n))
                    found |= {str(x) for x in own if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(4)
    vocabulary = ["the", "of", "Été", "naïve", "x1", "zwölf", "and", "to", "is", "q", "東京"]

    def text(n):
        return " ".join(rng.choice(vocabulary) + (str(rng.randint(0, 30)) if rng.random() < 0.7 else "") for _ in range(n))

    items = [(k, text(rng.randint(10, 40))) for k in range(12)] + [(20, text(9)), (21, text(5)), (22, text(3)), (23, "unique-word"), (24, ""), (25, None), (26, " -- "), (27, text(10))]
    items += [(30, items[0][1]), (31, items[0][1].upper().replace("É", "é")), (0, items[1][1]), (None, text(12)), (9, text(14)), (10, "the the the the the the the the the the the the")]
    docs = [None, "", " \x00 ", "the", "the " * 40, "The,the;THE " * 9, text(5)]
    for _, t in items:
        w = (t or "").split(" ")
        docs += [text(30) + ". " + (t or "") + "! " + text(20), " ".join(w[:9]), " ".join(w[1:11]), " ".join([*w[:6], "changed", *w[6:]]), "x" + (t or "")]
    docs += [" ".join(t or "" for _, t in items), text(20_000) + " " + items[3][1] + " " + text(20_000), "Z" * 5000]
    rows = [(k % 60 if k % 17 else None, t) for k, t in enumerate(docs)] + [(3, docs[9]), (3, docs[9])]
    return rows, items


@pytest.mark.parametrize("bound", [tables.BROADCAST_ROWS, 0])
def test_decontamination(spark, leaks, bound, monkeypatch):
    """Rows of odd ids and texts, short, repeated, equal and nameless items; with both ways to join."""
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
    docs, items = leaks
    left = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, key string, n int").repartition(3)
    right = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, window string, hash int")
    assert ordered(map(tuple, decontaminate.decontaminate(left, right).collect())) == ordered(plain_hits(docs, items))


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    empty = hashlib.sha256(b"").hexdigest()
    assert ordered(map(tuple, decontaminate.decontaminate(docs, none).collect())) == [(1, 3, 0, 0, empty, False), (2, 0, 0, 0, empty, False)]
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0
    assert decontaminate.decontaminate(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_decontamination_runs_no_python(spark, leaks):
    docs, items = leaks
    plan = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()


# collocations


def plain_phrases(docs, least=30, top=2000, cover=80):
    f = {}
    for lang, text in docs:
        own = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            own.update(tuple(w[s : s + k]) for k in range(1, 5) for s in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        n, rows = sum(v for g, v in own.items() if len(g) == 1), []
        frequent = {g: v for g, v in own.items() if v >= least}
        hidden = {g[s : s + m] for g, v in frequent.items() for m in range(2, len(g)) for s in range(len(g) - m + 1) if 100 * v >= cover * own[g[s : s + m]]}
        for g, a in frequent.items():
            if len(g) > 1 and g not in hidden:
                score, _, l, r = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), a, l, r))
        out += [(lang, k, p.decode(), a, l, r, n, -s) for k, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(14)] + ["É", "é", "(x", "a\x00b", "naïve", "東京"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]

    def text(n):
        return "".join(rng.choices(vocabulary, weights)[0].upper() * rng.choice((1, 1, 2)) + rng.choice((" ", " ", " ", "\t", "  ", ". ", ",", "\n", " ? ")) for _ in range(n))

    docs = [(rng.choice(("en", "en", "en", "de", None, "und", "")), text(rng.randint(0, 120))) for _ in range(250)]
    docs += [("en", None), (None, None), ("fr", ""), ("fr", " .\t,"), ("en", "new york city " * 60), ("en", "the the the the the " * 40), ("de", text(9000)), ("rare", "only once here")]
    return docs + [("en", "the same line of all of them, again") for _ in range(50)]


@pytest.mark.parametrize(("common", "salt", "block", "part"), [(1 << 19, 1_000_000, 1 << 20, 1_000_000), (5, 40, 97, 50), (0, 1, 1 << 20, 1 << 20)])
def test_collocations(spark, prose, common, salt, block, part, monkeypatch):
    """Whatever is common, salted or cut into blocks: the result is that of the plain version."""
    for name, value in (("COMMON", common), ("SALT", salt), ("BLOCK", block), ("WORDS_A_PART", part), ("GATHER", 500 if common == 5 else 1_000_000)):
        monkeypatch.setattr(collocations, name, value)
    docs = spark.createDataFrame([(t, x, "clash", 1) for t, x in prose], "lang string, text string, word string, id int").repartition(3)
    assert ordered(map(tuple, collocations.collocations(docs).collect())) == ordered(plain_phrases(prose))
    if common == 5:
        assert ordered(map(tuple, collocations.collocations(docs, least=3, top=7, cover=50).collect())) == ordered(plain_phrases(prose, 3, 7, 50))


def test_words_that_share_an_id_are_counted_again(spark, prose, monkeypatch):
    whole = collocations._counted
    monkeypatch.setattr(collocations, "_salts", lambda langs, seed, real=collocations._salts: real(langs, seed))

    def weak(seed):
        def run(batches):
            for batch in whole(seed)(batches):
                ids = batch.column("id").to_numpy() % 7 if seed == 1 else batch.column("id").to_numpy()
                yield batch.set_column(0, "id", collocations.pa.array(ids))

        return run

    monkeypatch.setattr(collocations, "_counted", weak)
    docs = spark.createDataFrame(prose, "lang string, text string")
    docs = docs.fillna("und", ["lang"])
    words, seed = collocations.count_words(docs, tables.Tables(spark, "test"))
    assert seed == 2 and words.count() == words.select("id").distinct().count()


def test_scores_beyond_64_bits(spark):
    a, both = 9_000_000_000_000_000_000, "9000000000000000001"
    row = spark.sql(f"select {a}L as a, cast({both} as decimal(20,0)) as b")
    assert row.select(collocations.score(row.a, row.b)).first()[0] == 2_000_000 * a // int(both)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], "lang string, text string")).count() == 0


# hard negatives


def plain_negatives(rows):
    good = []
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            own = np.floor(256 * np.array(x, dtype=float)).astype(np.int64)
            good.append((i, (label + 1) % 10 if i % 7 == 0 else label, np.pad(own, (0, 40 - len(own))).tolist()))
    out = []
    for i in sorted({i for i, _, _ in good if i % 50 == 0}):
        _, label, q = min(r for r in good if r[0] == i)
        scored = sorted((-int(np.dot(q, v)), j, own) for j, own, v in good if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:5]:
            found = [(t, k) for t, k, own in scored if own != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(found, 1)]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 40))
    rows = [(i, (centres[i % 4] + 0.6 * rng.normal(size=40)).tolist(), int(rng.integers(0, 4))) for i in range(500)]
    rows += [(i + 1000, [0.5, 0.25, float(i % 3)], 1) for i in range(60)]  # ties, another length
    rows += [(2000, [], 1), (2001, None, 1), (2002, [1.0, None], 2), (2003, [float("nan")], 0), (2050, [float("inf")], 0), (2004, [1.0], None), (None, [1.0], 1), (2100, [0.0] * 40, 3)]
    return rows + [(50, rows[3][1], 2), (50, rows[4][1], 1), (77, rows[0][1], 1), (77, rows[0][1], 1)]


@pytest.mark.parametrize(("block", "together", "held"), [(4096, 128, 16 << 20), (37, 3, 1000)])
def test_hard_negatives(spark, vectors, block, together, held, monkeypatch):
    for name, value in (("BLOCK", block), ("TOGETHER", together), ("ANCHOR_BYTES", held)):
        monkeypatch.setattr(hard_negatives, name, value)
    df = spark.createDataFrame([(*r, "clash", 1) for r in vectors], "vec_id long, embedding array<double>, label int, v string, rank int").repartition(4)
    rows = hard_negatives.mislabelled(hard_negatives.labelled(df))
    got = hard_negatives.hard_negatives(rows, rows.filter("vec_id % 50 = 0")).collect()
    want = plain_negatives(vectors)
    assert len(want) > 60 and ordered(map(tuple, got)) == ordered(want)


@pytest.mark.parametrize("score", [-7, -1, 0, 1, 19, 20, 21, 101, 10**17 + 1])
def test_limits(score):
    low, high = hard_negatives.limits(score, 50, 95)
    assert 50 * score <= 100 * low < 50 * score + 100 and 95 * score - 100 < 100 * high <= 95 * score


def test_hard_negatives_of_nothing(spark):
    rows = hard_negatives.labelled(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert hard_negatives.hard_negatives(rows, rows).count() == 0
