"""Spelling variants and hard negatives against brute force, with nulls, ties, repeats, hot groups and empty tables."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from evenhand.llm import hard_negatives, spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.fixture(scope="module")
def lexicon():
    r = random.Random(1)
    words = {"".join(r.choice("abé") for _ in range(r.randint(2, 9))) for _ in range(200)}
    for w in sorted(words)[:60]:
        i = r.randrange(len(w))
        words |= {w[:i] + "z" + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + "q" + w[i:]}
    # One chunk in many words that share nothing else.
    words |= {"common" + "".join(r.choice("klmnop") for _ in range(6)) for _ in range(150)}
    return sorted(w for w in words if len(w) >= 2)


@pytest.mark.parametrize("often", [64, 3])
def test_near_words(spark, lexicon, often):
    want = {tuple(sorted(p, key=lambda w: (len(w), w))) for p in itertools.combinations(lexicon, 2) if near(*p)}
    got = [tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in [*lexicon, *lexicon[:9], None, "a", ""]], "word string"), often=often).collect()]
    assert len(got) == len(set(got))
    assert set(got) == want


def test_variants(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        words = r.choices(["colour", "colours", "Château", "chateau", "planet", "plane"], [60, 9, 30, 4, 50, 9], k=r.randint(0, 90))
        rows.append((r.choice([i, 7]), r.choice([" ", "\n", "-1"]).join(words)))
    rows += [(None, None), (None, "colour colour"), (3, ""), (5, "colour " * 20_000), (5, "x" * 30_000)]
    df = spark.createDataFrame([(*x, "w") for x in rows], "doc_id long, text string, word string")
    count = Counter()
    for k, t in rows:
        for w in spelling.RUN.findall("".join(c.lower() if c.isascii() else c for c in t or "")):
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            at = h % len(w)
            count[w if h % 199 else w[:at] + w[at + 1 :]] += 1
    count = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, want = {}, {}
    for w in count:
        others = sorted((v for v in count if v != w and near(v, w)), key=lambda v: (-count[v], v))
        form[w] = others[0] if others and count[others[0]] >= 5 * count[w] else None
        want[w] = len(others)
    got = {r["word"]: r for r in spelling.grouped(df).collect()}
    assert set(got) == set(count)
    assert any(form.values())
    for w, r in got.items():
        root = w
        while form[root]:
            root = form[root]
        assert (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) == (form[w], root, count[w], want[w], count.get(form[w]))
    assert spelling.grouped(df.where("false")).count() == 0


def brute(rows):
    rows = [(i, [math.floor(256 * float(x)) for x in v], c) for i, v, c in rows if i is not None and v is not None and c is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v, c in rows:
        if i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), j, d) for j, w, d in rows if j != i and len(w) == len(v)))
        for s, p, _ in [x for x in scored if x[2] == c][:5]:
            inside = [(x, j) for x, j, d in scored if d != c and 50 * -s <= 100 * -x <= 95 * -s]
            out += [(i, p, k, j, -s, -x) for k, (x, j) in enumerate(inside[:3], 1)]
    return out


@pytest.mark.parametrize("sizes", [(8192, 2048), (20, 3)])
def test_hard_negatives(spark, sizes):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(3, 8))
    rows = [(i, [float(x) for x in centre[i % 3] + 0.4 * rng.normal(size=8)], int(rng.integers(4))) for i in range(200)]
    rows += [(1000 + i, rows[60][1], i % 2) for i in range(90)]  # one vector in a third of the rows
    rows += [(300, [0.0] * 8, 1), (350, [1.0, None] + [0.0] * 6, 1), (400, [float("nan")] * 8, 1), (450, None, 1), (500, [1.0] * 8, None), (550, [2.0, 1.0], 1), (551, [2.0, 1.0], 1), (552, [1.5, 0.1], 2), (600, [], 1), (None, [1.0] * 8, 1), (650, [float("inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<float>, label int, norm double, block string")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c in rows]
    got = hard_negatives.mined(hard_negatives.prepared(df), rows=sizes[0], anchors=sizes[1]).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(exact))
    assert hard_negatives.mined(hard_negatives.prepared(df.where("false"))).count() == 0


def test_bounds_hold_and_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.uniform(-60_000, 60_000, 6)], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    base = hard_negatives.prepared(df)
    assert sorted(tuple(r) for r in hard_negatives.mined(base).collect()) == sorted(brute(rows))
    found = base.toPandas()
    angles, norms = np.stack(found["angles"]).astype(float), found["norm"].to_numpy()
    v = np.stack([np.frombuffer(x, "<i4") for x in found["v"]]).astype(np.int64)
    whole = np.arange(len(v))
    kept = defaultdict(int)
    for i in range(len(v)):
        s = v @ v[i]
        at = hard_negatives._looked_at(whole, angles[i], norms[i], angles, norms, float(s.min()), float(s.max()))
        assert len(at) == len(v)
        few = hard_negatives._looked_at(whole, angles[i], norms[i], angles, norms, float(s[i]), np.inf)
        assert set(np.flatnonzero(s >= s[i])) <= set(few)
        kept[len(few) < len(v)] += 1
    assert kept[True] > 0
