"""Summaries and sentiment against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import enrich
from tidewater.operators import summaries as S

R = random.Random(2)
WORDS = ["Ähre", "word", "Profit", "x9", "loss", "日本", "the", "a", "rain", "Über", "cat", "dog"]


def text(n):
    return "".join(" ".join(R.choice(WORDS) for _ in range(R.randint(0, 6))) + R.choice([". ", "! ", "?\n", " ", "..  "]) for _ in range(n))


TEXTS = [None, "", " ", "One.", "No end", "A. A. A. A.", "... ! ?", "a b. b a. c. a b.", *(text(R.randint(1, 30)) for _ in range(60)), text(4000)]


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def bucket(w):
    return int(hashlib.md5(w.encode()).hexdigest()[:4], 16)


def plain_summary(t, idf, n):
    sentences = re.split(r"(?<=[.!?])[ \t\n\r\f\v]+", t)
    count = [Counter(bucket(w) for w in words(s)) for s in sentences]
    whole = sum(count, Counter())
    scores = []
    for c in count:
        norm = math.sqrt(sum((k * idf[b]) ** 2 for b, k in c.items()))
        scores.append(round(sum(k * idf[b] * whole[b] * idf[b] for b, k in c.items()) / norm, 9) if norm else 0.0)
    best = sorted(sorted(range(len(sentences)), key=lambda i: (-scores[i], i))[:n])
    return " ".join(sentences[i] for i in best)


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string").repartition(3)


def test_idf(texts):
    n = Counter(b for t in TEXTS for b in {bucket(w) for w in words(t or "")})
    want = [math.log((len(TEXTS) + 1) / (n[b] + 1)) + 1 for b in range(S.BUCKETS)]
    assert np.allclose(S.corpus_idf(texts), want) and np.allclose(S.corpus_idf(texts.limit(0)), 1)


@pytest.mark.parametrize("n", [1, 3])
def test_summaries(texts, n):
    idf = S.corpus_idf(texts)
    got = {r["i"]: r["s"] for r in texts.select("i", S.extractive_summariser(idf, n)(F.col("text")).alias("s")).collect()}
    assert got == {i: None if t is None else plain_summary(t, idf, n) for i, t in enumerate(TEXTS)}


def test_sentiment(spark, tmp_path):
    good, bad = ["gain", "win", "rise", "the"], ["loss", "fall", "crash", "the"]
    rows = [(" ".join(R.choice(good if i % 2 else bad) for _ in range(R.randint(0, 9))), i % 2, i % 3 == 0) for i in range(300)] + [(None, 1, False), ("win", 7, False), ("win", None, True)]
    df = spark.createDataFrame(rows, "text string, label int, held boolean")
    model = S.fit_sentiment(df)
    count = [Counter(bucket(w) for t, y, h in rows if y == k and not h for w in words(t or "")) for k in (0, 1)]
    odds = lambda b: math.log((count[1][b] + 1) / (count[1].total() + S.BUCKETS)) - math.log((count[0][b] + 1) / (count[0].total() + S.BUCKETS))
    assert all(model.weights[bucket(w)] == pytest.approx(odds(bucket(w))) for w in [*good, *bad, "none"])
    S.save_sentiment(spark, model, f"{tmp_path}/m")
    again = S.load_sentiment(spark, f"{tmp_path}/m")
    assert (again.weights == model.weights).all() and (again.positive == model.positive).all()
    score = S.sentiment_scorer(again)(F.col("text"))
    got = df.where("label < 2").select("label", "text", score["label"].alias("l"), score["confidence"].alias("c")).collect()
    clear = [r for r in got if {w for w in words(r["text"] or "")} - {"the"}]
    assert len(clear) > 200 and all((r["l"] == "positive") == (r["label"] == 1) and 0.5 <= r["c"] <= 1 for r in clear)
    # calibrated: what is said of the held rows is what was the case, bin by bin
    held = df.where("held AND label < 2").select("label", S.sentiment_scorer(model)(F.col("text"))["confidence"].alias("c")).collect()
    assert sum(r["c"] for r in held) / len(held) > 0.8
    empty = S.fit_sentiment(df.limit(0))
    assert (empty.weights == 0).all() and empty.positive[S.BINS // 2] == pytest.approx(0.5, abs=0.1) and (np.diff(empty.positive) > 0).all()


def test_in_enrichment(spark, texts):
    rows = spark.createDataFrame([(1, "Short one. Rain rain. Cat.", None), (2, "H", "y" * 60), (3, "Only", "s")], "id long, headline string, summary string")
    rows = rows.select("*", *(F.lit(None).cast("string").alias(c) for c in ("category", "published_at_utc", "source", "url", "image_url", "scraped_at")))
    out = enrich.enrich(rows, S.extractive_summariser(S.corpus_idf(texts), 1), S.sentiment_scorer(S.fit_sentiment(spark.createDataFrame([], "text string, label int, held boolean"))))
    got = {r["id"]: (r["summary"], r["sentiment_label"], r["sentiment_score"]) for r in out.collect()}
    assert got[2][:2] == ("y" * 60, "positive") and 0.5 <= got[2][2] < 0.6 and got[3][0] == "Only" and got[1][0] in ("Short one.", "Rain rain.", "Cat.")
