"""LM scoring: prediction by partial matching over a byte-context trie, beside an add-one unigram base."""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import CHUNK_BYTES, chunked, documents, fold, give_back, stored, table, unpacked

#: Bytes of context: four-byte strings are the trie's leaves.
ORDER = 3
#: Stands for the end of a text among its tokens; no word has a space.
END = b" "


def byte_strings(text: bytes) -> np.ndarray:
    """Each byte with the three before it (zeros before the start) as one number."""
    a = np.frombuffer(b"\0" * ORDER + text, np.uint8).astype(np.uint32)
    return (a[:-3] << np.uint32(24)) | (a[1:-2] << np.uint32(16)) | (a[2:-1] << np.uint32(8)) | a[3:]


def tokens_of(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, and one end."""
    return [*text.lower().split(), END]


def _counts(chunks: DataFrame) -> DataFrame:
    """(chunk, word or string, n): how often each token and byte string of a chunk is in its training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                rows = unpacked(blob)
                words, known, strings = Counter(), Counter(), {True: [], False: []}
                for held, text in zip(rows.column("held_out").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    (words if held else known).update(tokens_of(text))
                    strings[held].append(byte_strings(text))
                for w in words:
                    known.setdefault(w, 0)
                keys = list(known)
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk] * len(keys), pa.int64()), "word": pa.array(keys, pa.binary()), "string": pa.nulls(len(keys), pa.int64()), "n": pa.array([known[k] for k in keys], pa.int64())})
                learnt, n = np.unique(np.concatenate(strings[False] or [np.zeros(0, np.uint32)]), return_counts=True)
                others = np.setdiff1d(np.concatenate(strings[True] or [np.zeros(0, np.uint32)]), learnt)
                strings_all, n = np.concatenate([learnt, others]).astype(np.int64), np.concatenate([n, np.zeros(len(others), np.int64)])
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(n), chunk)), "word": pa.nulls(len(n), pa.binary()), "string": pa.array(strings_all), "n": pa.array(n.astype(np.int64))})
                del rows, words, known, strings, keys
                give_back()

    return chunks.mapInArrow(count, "chunk long, word binary, string long, n long")


def string_scores(totals: DataFrame) -> DataFrame:
    """string and lp (log10 of its last byte's probability after the others) from string and n, its count in training rows.

    The trie's levels are sums of the level above. Escape by method C: a context gives a share to its
    different symbols q against its count N. Symbols of a longer context are excluded below it; as
    they all occur below as well, what is left of a level is its totals less what those symbols have there
    (x). Below order 0, the bytes that never occurred share what is left.
    """
    byte = 1 << 8
    seen = totals.where("n > 0")
    level = {ORDER: seen.select((F.col("string") / byte).cast("long").alias("c3"), (F.col("string") % byte).alias("s"), F.col("n").alias("n3"))}
    for j in range(ORDER - 1, -1, -1):
        above = level[j + 1]
        level[j] = above.groupBy((F.col(f"c{j + 1}") % (1 << 8 * j)).alias(f"c{j}"), "s").agg(F.sum(f"n{j + 1}").alias(f"n{j}"))
    out = totals.select("string", (F.col("string") % byte).alias("s"), *(((F.col("string") / byte).cast("long") % (1 << 8 * j)).alias(f"c{j}") for j in range(ORDER, -1, -1)))
    # levels 0 and 1 have 256 and 65,536 rows at most; a join on so few keys would put many strings into one task
    few = lambda rows, j: F.broadcast(rows) if j < 2 else rows
    for j in range(ORDER, -1, -1):
        rows = level[j]
        if j:
            rows = rows.withColumn(f"c{j - 1}", F.col(f"c{j}") % (1 << 8 * (j - 1))).join(few(level[j - 1], j - 1), [f"c{j - 1}", "s"])
        below = F.sum(f"n{j - 1}") if j else F.lit(0)
        contexts = rows.groupBy(f"c{j}").agg(F.sum(f"n{j}").alias(f"t{j}"), F.count("*").alias(f"q{j}"), below.alias(f"x{j}"))
        out = out.join(few(contexts, j), f"c{j}", "left").join(few(level[j], j), [f"c{j}", "s"], "left")
    lp, found = F.lit(0.0), F.lit(False)
    for j in range(ORDER, -1, -1):
        longer_q, longer_x = (F.coalesce(f"q{j + 1}", F.lit(0)), F.coalesce(f"x{j + 1}", F.lit(0))) if j < ORDER else (F.lit(0), F.lit(0))
        new = F.coalesce(f"q{j}", F.lit(0)) - longer_q
        room = F.coalesce(f"t{j}", F.lit(0)) - longer_x + new
        here = F.col(f"n{j}").isNotNull()
        share = F.when(here, F.col(f"n{j}")).otherwise(new)
        lp = lp + F.when(found | (room <= 0), 0.0).otherwise(F.log10(share / room))
        found = found | here
    lp = lp - F.when(found, 0.0).otherwise(F.log10(256.0 - F.coalesce("q0", F.lit(0))))
    return out.select("string", lp.alias("lp"))


def score_corpus(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, folds: int = 7, fold_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    held_out marks rows whose crc32 of the id modulo folds is fold_out; all others are learnt from. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens; score is the log10 probability of the text's
    bytes under the pretrained trie. Counts are gathered for each chunk, combined, and go back to the chunks
    that need them, so neither the vocabulary nor the trie is ever in one place. Null texts count as
    empty: one token, score 0. Null ids count as the text "" in the fold; repeated rows count each time; with nothing to learn from,
    c, N and V are 0 and bytes are uniform; an empty table gives an empty result.
    """
    rows = documents(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == fold_out)
    chunks = chunked(rows, chunk_bytes)
    side = stored(_counts(chunks))
    sums = stored(side.groupBy("word", "string").agg(F.sum("n").alias("n")))
    total, different = sums.where("word IS NOT NULL AND n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    words = sums.where("word IS NOT NULL").select("word", F.col("n").cast("double").alias("value"))
    strings = stored(string_scores(sums.where("string IS NOT NULL").select("string", "n")))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob").to_pylist():
            texts = unpacked(blob)
            kind = np.asarray(right.column("word").is_null())
            word_rows, string_rows = right.filter(pa.array(~kind)), right.filter(pa.array(kind))
            value = dict(zip(word_rows.column("word").to_pylist(), word_rows.column("value").to_pylist(), strict=True))
            string, lp = string_rows.column("string").to_numpy(), string_rows.column("value").to_numpy()
            order = np.argsort(string)
            string, lp = string[order].astype(np.uint32), np.append(lp[order], 0.0)
            for text in texts.column("text").cast(pa.binary()).to_pylist():
                tokens = tokens_of(text)
                c = np.fromiter(map(value.__getitem__, tokens), float, len(tokens))
                base = float(np.log10((c + 1) / (total + different + 1)).sum())
                out.append((len(tokens), int(np.count_nonzero(c)), base, float(lp[np.searchsorted(string, byte_strings(text))].sum())))
        cols = list(zip(*out, strict=True)) or [()] * 4
        del value, string, lp, string_rows, word_rows
        give_back()
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(cols[0], pa.int64()), "n_known": pa.array(cols[1], pa.int64()), "base_score": pa.array(cols[2], pa.float64()), "score": pa.array(cols[3], pa.float64())})

    side = side.where("word IS NOT NULL").join(words, "word").select("chunk", "word", "string", "value").unionByName(
        side.where("string IS NOT NULL").join(strings, "string").select("chunk", "word", "string", F.col("lp").alias("value"))
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    scored = chunks.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(score, schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


class AdaptiveTrie:
    """The same model as a plain byte trie that may go on learning: for single texts and as a check of the tables."""

    def __init__(self, order: int = ORDER) -> None:
        self.order, self.counts = order, {}

    def learn(self, context: bytes, symbol: int) -> None:
        for n in range(len(context) + 1):
            self.counts.setdefault(context[n:], Counter())[symbol] += 1

    def log10(self, context: bytes, symbol: int) -> float:
        excluded: set[int] = set()
        lp = 0.0
        for n in range(len(context) + 1):
            left = {s: c for s, c in self.counts.get(context[n:], {}).items() if s not in excluded}
            if left:
                room = sum(left.values()) + len(left)
                if symbol in left:
                    return lp + math.log10(left[symbol] / room)
                lp += math.log10(len(left) / room)
                excluded |= set(left)
        return lp - math.log10(256 - len(excluded))

    def score(self, text: bytes, learn: bool = False) -> float:
        """log10 probability of a text; with learn, each byte is learnt after it is coded (adaptive code length)."""
        padded, lp = b"\0" * self.order + text, 0.0
        for i, s in enumerate(text):
            context = padded[i : i + self.order]
            lp += self.log10(context, s)
            if learn:
                self.learn(context, s)
        return lp
