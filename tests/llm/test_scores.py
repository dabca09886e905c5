"""Scores of the two classifiers over whole tables, recomputed by plain versions."""

import math
import re

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewater.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def logistic(z):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores(tables):
    """Each feature counted by looking at every word of a text; the vocabulary is made up of words and starts, as these tables have too few labels
    for one of their own."""
    docs, labels = tables
    fitted, draw = toxicity.fit_toxicity(docs, labels), np.random.default_rng(1)
    words = sorted({w.lower() for r in docs.collect() for w in re.findall(r"[a-zà-ÿ]+", (r["text"] or "").lower())})[::150]
    vocabulary = sorted({*words, *(w[:4] + "-" for w in words if len(w) > 4), *(w[:3] + "-" for w in words if len(w) > 3)})
    weights = np.concatenate([draw.normal(0, 0.3, len(vocabulary)), fitted.weights[len(fitted.vocabulary) :] + 1])
    model = toxicity.ToxicityModel(fitted.mined, fitted.label_model, vocabulary, weights, fitted.intercept, 1.3, 0.2)
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, model).collect()}
    fits = lambda f, w: len(w) > len(f) - 1 and w.startswith(f[:-1]) if f.endswith("-") else w == f
    assert len(vocabulary) > 20 and len({round(x, 3) for x in got.values()}) > 50
    for r in docs.collect():
        words = [w for part in re.split(r"[\x00-\x40\x5b-\x60\x7b-\x7f]+", (r["text"] or "").lower()) for w in part.split()]
        part = lambda n: min(3.0, 60 * n / (len(words) + 100))  # noqa: B023, E731
        z = model.intercept
        known = {w: words.count(w) for w in set(words)}
        for weight, f in zip(model.weights, model.vocabulary, strict=False):
            z += weight * part(sum(n for w, n in known.items() if fits(f, w)))
        for weight, lexicon in zip(model.weights[len(model.vocabulary) :], toxicity.LEXICONS.values(), strict=True):
            z += weight * part(sum(n for w, n in known.items() if w in lexicon.split()))
        assert got[r["doc_id"]] == pytest.approx(logistic(model.slope * z + model.shift), abs=1e-9)


def test_quality_scores(spark, tables):
    """Fitted and scored anew: halves and order by the hashes that Spark gives, fresh compressors, logistic regression by small steps."""
    docs, labels = tables
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()}
    known = docs.join(labels.where("quality IS NOT NULL"), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    known = known.select("text", F.col("quality").alias("y"), F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half"), F.xxhash64("doc_id").alias("order")).collect()
    cut = lambda t: [t[i : i + 2048] for i in range(0, len(t), 2048)]
    dictionaries = []
    for y in (1, 0):
        pieces = [p for r in sorted((r for r in known if r["half"] == 0 and r["y"] == y), key=lambda r: r["order"]) for p in cut(r["text"].encode())]
        try:
            dictionaries.append(zstandard.train_dictionary(65536, pieces).as_bytes())
        except zstandard.ZstdError:
            dictionaries.append(b"".join(pieces)[-65536:])

    def inputs(text):
        if not text:
            return [1.0, 0.0, 0.0, 0.0]
        sizes = []
        for d in dictionaries:
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(p)) for p in cut(text)))
        good, bad = sizes
        return [1.0, 20 * (bad - good) / len(text), max(-20.0, min(20.0, (bad - good) / 50)), min(good, bad) / len(text)]

    rows = [(inputs(r["text"].encode()), r["y"]) for r in known if r["half"] == 1]
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
    assert 0 < y.sum() < len(y)
    w, step = np.zeros(4), 4 / (np.linalg.eigvalsh(x.T @ x)[-1] + 4e-3)
    momentum, t = w.copy(), 1.0
    for _ in range(200_000):  # accelerated steps downhill
        new = momentum + step * (x.T @ (y - 1 / (1 + np.exp(-np.clip(x @ momentum, -30, 30)))) - 1e-3 * momentum)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        momentum = new + (before - 1) / t * (new - w)
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    for r in docs.collect():
        assert got[r["doc_id"]] == pytest.approx(logistic(float(np.dot(w, inputs((r["text"] or "").encode())))), abs=1e-3)
