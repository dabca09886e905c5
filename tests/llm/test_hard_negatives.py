"""Hard negatives against a plain search."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewater.llm import hard_negatives as hn

R = random.Random(11)
SCHEMA = "vec_id long, label int, vector array<double>, place long, slot int, score long, id long, block int"
EXTRA = (1, 1, 1, 1, 1)


def vectors(n, dims, spread=1.0):
    return [[R.gauss(0, spread) + (0.7 if d == i % 3 else 0) for d in range(dims)] for i in range(n)]


def table(n, dims, labels=3):
    rows = [(i, 0 if i % 3 == 0 else i % labels, v) for i, v in enumerate(vectors(n, dims))]
    rows += [(n + i, *rows[R.randrange(n)][1:]) for i in range(n // 4)]  # ties
    rows += [rows[5], rows[5], rows[7]]  # repeated rows
    rows += [(None, 1, rows[0][2]), (10_000, None, rows[1][2]), (10_001, 1, None), (10_002, 1, [1.0] * (dims - 1) + [math.nan]), (10_003, 1, [math.inf] * dims), (10_004, 1, [None] + [1.0] * (dims - 1))]
    return rows + [(10_005, 1, []), (10_006, 2, [2.0]), (10_007, 1, [3.0] * (dims + 2)), (10_008, 2, [-0.5] * dims)]


def plain_version(rows, is_anchor, k_pos, k_neg, low, high):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {(i, lab, tuple(v)) for i, lab, v in good if is_anchor(i)}
    out = Counter()
    for a, lab, v in anchors:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == lab) for i, other, w in good if i != a)
        for s, p, _ in [x for x in scored if x[2]][:k_pos]:
            fits = [x for x in scored if not x[2] and low * -s <= 100 * -x[0] <= high * -s]
            out.update((a, p, r, x[1], -s, -x[0]) for r, x in enumerate(fits[:k_neg], 1))
    return out


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("n, dims, every, settings", [(400, 6, 10, {}), (300, 3, 7, {"positives": 3, "negatives": 4, "low": 10, "high": 95, "block_bytes": 400}), (60, 2, 1, {"negatives": 1000})])
def test_against_plain(spark, monkeypatch, n, dims, every, settings):
    rows = table(n, dims)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    got = hn.mine_hard_negatives(df, df.where(F.col("vec_id") % every == 0), **settings)
    want = plain_version(rows, lambda i: i % every == 0, settings.get("positives", 5), settings.get("negatives", 10), settings.get("low", 30), settings.get("high", 90))
    assert want and Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want


@pytest.mark.parametrize("share", [1, 2])
def test_sample_of_any_size(spark, monkeypatch, share):
    """What the sample leaves out is never among the best: as many candidates as there are results where it has all rows, and the same results."""
    monkeypatch.setattr(hn, "SHARE", share)
    rows = table(400, 4)
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(7)
    want = plain_version(rows, lambda i: i % 9 == 0, 5, 10, 30, 90)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in hn.mine_hard_negatives(df, df.where("vec_id % 9 = 0")).collect()) == want


def test_empty(spark):
    df = spark.createDataFrame([(*r, *EXTRA) for r in table(20, 3)], SCHEMA)
    none = df.limit(0)
    assert hn.mine_hard_negatives(none, none).collect() == [] and hn.mine_hard_negatives(df, none).collect() == [] and hn.mine_hard_negatives(none, df).collect() == []
    assert hn.mine_hard_negatives(df.where("label = 0"), df.where("label = 0")).collect() == []


def test_large_components(spark):
    """Scores beyond what doubles hold stay exact."""
    rows = [(i, i % 2, [R.uniform(-900_000, 900_000) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)
    got = hn.mine_hard_negatives(df, df.where("vec_id % 5 = 0"))
    want = plain_version(rows, lambda i: i % 5 == 0, 5, 10, 30, 90)
    assert want and Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want


def test_best_cut(monkeypatch):
    monkeypatch.setattr(hn, "HELD", 7)
    import numpy as np

    rows, best = [(R.randrange(4), R.randrange(6), i) for i in range(200)], hn.Best(np.full(4, -1), 3)
    for at in range(0, 200, 9):
        best.add(*(np.array(c, np.int64) for c in zip(*rows[at : at + 9], strict=True)))
    group, score, own = best.cut()
    got = sorted(zip(group.tolist(), (-score).tolist(), own.tolist(), strict=True))
    assert got == [x for g in range(4) for x in sorted((h, -s, i) for h, s, i in rows if h == g)[:3]]
