"""An extractive summariser and a fitted sentiment scorer, as Column functions that enrich() takes."""

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: Words share so many buckets, by the first two bytes of their MD5: what is known of a corpus has a fixed size.
BUCKETS = 1 << 16
_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+")


def bucket(word: Column) -> Column:
    """A word's bucket."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 4), 16, 10).cast("int")


def bucket_column(text: Column) -> Column:
    """Buckets of the words (runs of letters and digits, in lower case) of a text, repeats included; none of a null."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.transform(words, bucket)


class Buckets(dict):
    """Buckets of words, each looked up once; forgotten when they are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.md5(word.encode()).digest()[:2], "big")
        return found

    def of(self, text: str) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, _WORD.findall(text.lower())), np.int64)


# Summaries


def corpus_idf(texts: DataFrame, column: str = "text") -> np.ndarray:
    """ln((N + 1) / (n + 1)) + 1 for each bucket, over all rows: N of them, n with the bucket. Null texts count as empty."""
    rows = texts.select(F.array_distinct(bucket_column(F.col(column))).alias("b"))
    counts = rows.select(F.explode(F.concat("b", F.array(F.lit(-1)))).alias("b")).groupBy("b").count().collect()  # a row for each bucket, and one for all texts
    n = {r[0]: r[1] for r in counts}
    total, found = n.pop(-1, 0), np.zeros(BUCKETS)
    found[list(n.keys())] = list(n.values())
    return np.log((total + 1) / (found + 1)) + 1


def sentence_scores(sentences: list[str], idf: np.ndarray, buckets: Buckets) -> np.ndarray:
    """How near each sentence is to its text: the product of both TF-IDF vectors, divided by the sentence's length, to nine places. Without words: 0."""
    found = [buckets.of(s) for s in sentences]
    sizes = np.array([len(f) for f in found])
    words, row = np.concatenate(found), np.repeat(np.arange(len(found)), sizes)
    whole, at = np.unique(words, return_inverse=True)
    centroid = np.bincount(at, minlength=len(whole)) * idf[whole]
    pairs, n = np.unique(row * len(whole) + at, return_counts=True)
    row, at = pairs // max(1, len(whole)), pairs % max(1, len(whole))
    weight = n * idf[whole[at]]
    near, norm = (np.bincount(row, weights=w, minlength=len(sentences)) for w in (weight * centroid[at], weight * weight))
    return np.round(near / np.sqrt(np.where(norm > 0, norm, 1)), 9)


def summary_of(text: str, idf: np.ndarray, buckets: Buckets, n: int) -> str:
    sentences = _END.split(text)
    if len(sentences) > n:
        scores = sentence_scores(sentences, idf, buckets)
        best = np.lexsort((np.arange(len(sentences)), -scores))[:n]
        sentences = [sentences[i] for i in sorted(best)]
    return " ".join(sentences)


def extractive_summariser(idf: np.ndarray, n: int = 3) -> Callable[[Column], Column]:
    """A Column function: the n sentences nearest to the whole text, in its order; of equally near ones, the first. Null for a null.

    Time and memory follow the text's length: sentences meet the text's own vector, and no sentence meets another. Sentences end with ., ! or ?
    before white space.
    """

    @F.pandas_udf(StringType())
    def summarise(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for batch in texts:
            yield batch.map(lambda t: summary_of(t, idf, buckets, n), na_action="ignore")

    return summarise


# Sentiment


@dataclass
class SentimentModel:
    """Log odds of each bucket, where bins of a text's mean log odds begin and how wide they are, and how likely positive is in each."""

    weights: np.ndarray
    low: float
    width: float
    positive: np.ndarray


#: Bins of the calibration, which covers mean log odds from -RANGE to RANGE; what is beyond counts in the outermost.
BINS, RANGE = 40, 2.0
#: What is thought of a bin before any row of it is seen.
SLOPE = 4.0


def mean_odds(buckets: np.ndarray, weights: np.ndarray) -> float:
    return float(weights[buckets].sum() / len(buckets)) if len(buckets) else 0.0


def bin_of(mean: Column) -> Column:
    return F.least(F.greatest(F.floor((mean + RANGE) / (2 * RANGE / BINS)), F.lit(0)), F.lit(BINS - 1)).cast("int")


def fit_sentiment(texts: DataFrame, label: str = "label", held: str = "held", column: str = "text") -> SentimentModel:
    """A naive Bayes model over hashed words from rows whose label is 1 (positive) or 0 (negative), calibrated on those of them with held true.

    Words are counted by bucket and label, over all rows with held false, before a shuffle; what is collected are the sums of 65,536 buckets. A
    text's score is the mean log odds of its words; how likely a score is to be positive is the share in its bin among the held rows, which the
    weights have not seen, smoothed by two rows that are positive as the logistic function of SLOPE times the bin's middle has it. Rows with another label, or none, take no part. Without rows the words of a text tell nothing.
    """
    rows = texts.where(F.col(label).isin(0, 1))
    counts = rows.where(~F.col(held)).select(F.explode(bucket_column(F.col(column))).alias("b"), F.col(label).alias("l")).groupBy("b", "l").count().collect()
    found = np.zeros((2, BUCKETS))
    for r in counts:
        found[r["l"], r["b"]] = r["count"]
    odds = np.log((found + 1) / (found.sum(axis=1, keepdims=True) + BUCKETS))
    weights = odds[1] - odds[0]
    scored = rows.where(held).select(F.col(label).alias("l"), bin_of(score_column(F.col(column), weights)).alias("bin"))
    before = 1 / (1 + np.exp(-SLOPE * (-RANGE + (np.arange(BINS) + 0.5) * 2 * RANGE / BINS)))
    share = before.copy()
    for r in scored.groupBy("bin").agg(F.count_if(F.col("l") == 1).alias("good"), F.count("*").alias("n")).collect():
        share[r["bin"]] = (r["good"] + 2 * before[r["bin"]]) / (r["n"] + 2)
    return SentimentModel(weights, -RANGE, 2 * RANGE / BINS, share)


def score_column(text: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for batch in texts:
            yield pd.Series([mean_odds(buckets.of(t), weights) for t in batch.fillna("")], dtype="float64")

    return score(text)


def sentiment_scorer(model: SentimentModel) -> Callable[[Column], Column]:
    """A Column function: struct(label, confidence). Confidence is how likely the label is, at least a half; a null or empty text is judged by no words."""

    @F.pandas_udf(StructType([StructField("label", StringType()), StructField("confidence", DoubleType())]))
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        buckets = Buckets()
        for batch in texts:
            means = np.array([mean_odds(buckets.of(t), model.weights) for t in batch.fillna("")])
            at = np.clip(np.floor((means - model.low) / model.width), 0, len(model.positive) - 1).astype(int)
            good = model.positive[at]
            yield pd.DataFrame({"label": np.where(good >= 0.5, "positive", "negative"), "confidence": np.maximum(good, 1 - good)})

    return score


def save_sentiment(spark: SparkSession, model: SentimentModel, path: str) -> None:
    """The model as a small table."""
    row = (model.weights.tolist(), model.low, model.width, model.positive.tolist())
    spark.createDataFrame([row], "weights array<double>, low double, width double, positive array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load_sentiment(spark: SparkSession, path: str) -> SentimentModel:
    r = spark.read.parquet(path).first()
    return SentimentModel(np.array(r["weights"]), r["low"], r["width"], np.array(r["positive"]))

