"""Hard-negative mining: scores split into disjoint slots at the upper limits of an anchor's positives."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import give_back, shared_dir, stored, table

# How many positives and negatives, the window in percent of a positive's score, and the scale of components.
POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Components are held within this bound, so that scores of up to 127 components fit 64 bits.
LIMIT = 1 << 28
#: Bytes of vectors of the anchors that meet all rows in one pass.
BLOCK_BYTES = 8 << 20
#: One row of so many tells, before the whole search, what scores it need not look for.
SHARE = 64
#: Rows and anchors that are multiplied at once, and candidates that are held before they are cut to the best.
ROWS, ANCHORS, HELD = 4096, 512, 1 << 19


def integers(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places in the batch, ids, labels and integer vectors (shorter ones filled up with zeros) of the rows that take part."""
    at = np.arange(batch.num_rows)
    known = np.logical_and.reduce([batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "vector")])
    at, batch = at[known], batch.filter(pa.array(known))
    lists = batch.column("vector")
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls read as NaN
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    vectors = np.zeros((len(at), int(lengths.max(initial=0))))
    vectors[np.arange(vectors.shape[1]) < lengths[:, None]] = flat
    good = np.isfinite(vectors).all(axis=1)
    vectors = np.clip(np.floor(scale * vectors[good]), -LIMIT, LIMIT)
    return at[good], *(batch.column(c).to_numpy(zero_copy_only=False)[good].astype(np.int64) for c in ("vec_id", "label")), vectors


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products, as integers or as doubles that hold them; where vectors are of different lengths, missing components are zeros."""
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * width < 2**53:
        return q @ v.T
    return q.astype(np.int64) @ v.astype(np.int64).T


class Best:
    """The first k (score, id) of each group, higher scores first, ties by smaller id."""

    def __init__(self, floor: np.ndarray, k: int) -> None:
        self.k, self.floor, self.size = k, floor.copy(), 0
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, group: np.ndarray, score: np.ndarray, own: np.ndarray) -> None:
        self.parts.append((group, score.astype(np.int64), own))
        self.size += len(group)
        if self.size > HELD:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keeps the best; what is below the floor of its group has no need to be added."""
        empty = (np.zeros(0, np.int64),) * 3
        group, score, own = (np.concatenate(c) for c in zip(empty, *self.parts, strict=True))
        order = np.lexsort((own, -score, group))
        group, score, own = group[order], score[order], own[order]
        first = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))
        last = rank == self.k - 1
        self.floor[group[last]] = score[last]
        keep = rank < self.k
        self.parts = [(group[keep], score[keep], own[keep])]
        self.size = int(keep.sum())
        return self.parts[0]


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
FOUND = "place long, slot int, score long, id long"


def scanner(queries: pa.Table, slots: int, k: int, same_label: bool, scale: int, known: pa.Table | None = None) -> Scan:
    """A task's part of the search: of all rows it reads, the k best of each slot of each query.

    queries: place, vec_id, label, vector and, for each slot, uppers and lowers (both ends count). Rows of the query's own id are left out. known:
    place, slot and a score that k rows of the slot reach; what is below it is left out.
    """
    at, ids, labels, q = integers(queries.combine_chunks().to_batches()[0], scale)
    place, limits = (queries.select(c).combine_chunks() for c in (["place"], ["uppers", "lowers"]))
    place = place.column(0).to_numpy()[at]
    floors = np.full(len(at) * slots, np.iinfo(np.int64).min)
    if known is not None:
        of_place, spot, score = (known.column(c).to_numpy() for c in ("place", "slot", "score"))
        order = np.argsort(place)
        floors[order[np.searchsorted(place[order], of_place)] * slots + spot] = score
    high, low = (np.array(limits.column(c).to_pylist(), np.int64).reshape(-1, slots)[at] for c in ("uppers", "lowers"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, seen = Best(floors, k), 0
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                n = ROWS if seen else ROWS // 16  # floors are known from a few rows on
                _, own, kinds, vectors = integers(batch.slice(start, n), scale)
                start, seen = start + n, seen + len(own)
                for a in range(0, len(at), ANCHORS):
                    some = slice(a, a + ANCHORS)
                    score = products(q[some], vectors)
                    fits = ((labels[some, None] == kinds) == same_label) & (ids[some, None] != own)
                    for slot in range(slots):
                        floor = np.maximum(best.floor[a * slots + slot : (a + len(score)) * slots : slots], low[some, slot])
                        i, j = np.nonzero(fits & (score >= floor[:, None]) & (score <= high[some, slot, None]))
                        best.add((i + a) * slots + slot, score[i, j], own[j])
        group, score, own = best.cut()
        for i in range(0, max(1, len(group)), 1 << 16):
            some = slice(i, i + (1 << 16))
            cols = (pa.array(place[group[some] // slots], pa.int64()), pa.array(group[some] % slots, pa.int32()), pa.array(score[some], pa.int64()), pa.array(own[some], pa.int64()))
            yield pa.RecordBatch.from_arrays(list(cols), names=["place", "slot", "score", "id"])
        give_back()

    return scan


def search(rows: DataFrame, queries: DataFrame, blocks: int, slots: int, k: int, same_label: bool, scale: int) -> DataFrame:
    """The k best rows of each slot of each query: a pass over all rows for each block of queries, whose size is bounded.

    Before it, a pass over one row of SHARE, by a hash of its id, tells for each slot a score that k rows reach. No row below that is among the
    best, so tasks leave it out: all of them together find about SHARE times k rows a slot, and each k at most, and the result is that of
    all rows.
    """
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession)
    order = Window.partitionBy("place", "slot").orderBy(F.desc("score"), "id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(SHARE)) == 0)
    for block in range(blocks):
        own = queries.where(F.col("block") == block).drop("block").toArrow()
        if own.num_rows:
            first = ranked(sample.mapInArrow(scanner(own, slots, k, same_label, scale), FOUND))
            known = first.where(F.col("rank") == k).select("place", "slot", "score").toArrow()  # one row for each slot of the block, at most
            rows.mapInArrow(scanner(own, slots, k, same_label, scale, known), FOUND).write.parquet(f"{path}/block={block}")
    found = spark.createDataFrame([], FOUND) if queries.isEmpty() else spark.read.schema(FOUND).parquet(path)
    return ranked(found.select("place", "slot", "score", "id"))


def mine_hard_negatives(
    rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score over rows (vec_id, label, vector) for the rows in anchors.

    A component x counts as floor(scale * x); a score is the inner product with the anchor, and higher scores come first, ties by smaller
    vec_id. Positives are the first rows of the anchor's label. For each of them, negatives are the first rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    The positives' upper limits, in descending order, split scores into disjoint slots. Every task keeps the best of each slot, these are
    merged, and a positive's answer is the merge of its slot and all below it, up to the number of negatives, of which those under its lower limit
    go: one scan answers all windows of an anchor, however they overlap. Anchors meet all rows in blocks of block_bytes of vectors; a sample
    only tells what need not be looked for, and no label, however frequent, is gathered anywhere.

    Rows with a null vec_id, label, vector or component, or with a component that isn't finite, take no part. Repeated rows count each,
    but rows of the anchor's own vec_id never are its positives or negatives; anchors alike in all three columns are answered once. Missing components
    of shorter vectors are zeros; components are held within LIMIT, so scores of vectors of up to 127 components are exact. Other columns
    aren't read. Positives without a negative give no rows; empty tables give none.
    """
    plain = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    rows, own = plain(rows), plain(anchors).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").dropDuplicates()
    own = stored(own.withColumn("place", F.monotonically_increasing_id()))  # fixes places
    n, width = own.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * max(1, width) * 8 // block_bytes))
    own = own.withColumn("block", F.pmod(F.xxhash64("place"), F.lit(blocks)))
    every = own.withColumns({"uppers": F.array(F.lit(2**63 - 1)), "lowers": F.array(F.lit(-(2**63)))})
    near = stored(search(rows, every, blocks, 1, positives, True, scale).select("place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    near = near.withColumns({"upper": F.expr(f"floor({high}BD * positive_score / 100)").cast("long"), "lower": F.expr(f"ceil({low}BD * positive_score / 100)").cast("long")})
    near = near.where("lower <= upper")
    slots = near.groupBy("place").agg(F.sort_array(F.collect_set("upper"), asc=False).alias("own"), F.min("lower").alias("least"))  # as many as positives, at most
    fill = lambda found, value: F.concat(found, F.array_repeat(F.lit(value).cast("long"), F.lit(positives) - F.size("own")))
    ends = F.concat(F.transform(F.slice("own", 2, positives), lambda u: F.greatest(u + 1, F.col("least"))), F.array("least"))
    asked = own.join(slots, "place").select(*own.columns, fill(F.col("own"), 0).alias("uppers"), fill(ends, 1).alias("lowers"))
    kept = search(rows, stored(asked), blocks, positives, negatives, False, scale)
    lists = kept.groupBy("place").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("found"))  # negatives of each slot, at most
    below = F.slice(F.filter("found", lambda x: -x["less"] <= F.col("upper")), 1, negatives)
    answer = F.posexplode(F.filter(below, lambda x: -x["less"] >= F.col("lower"))).alias("pos", "x")
    out = near.join(stored(lists), "place").join(own.select("place", F.col("vec_id").alias("anchor_id")), "place").select("anchor_id", "positive_id", "positive_score", answer)
    return out.select("anchor_id", "positive_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return mine_hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP13_SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a, e r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
