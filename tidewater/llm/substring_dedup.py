"""Substring dedup: winnowed anchors seed repeats, which are extended both ways and kept from a length on."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import CHUNK_BYTES, answered, chunked, documents, give_back, table, unpacked

#: Words of a repeat at least, and words of an anchor. Any repeat holds LENGTH - ANCHOR + 1 anchors in a row.
LENGTH, ANCHOR = 20, 6
#: Bits of an anchor's hash left out in counts: 48 stay. A chance match adds windows to compare, never a repeat.
SPARED = np.uint64(16)
#: Sorts after any id: stands for a null doc_id.
LAST = np.iinfo(np.int64).max


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = (a ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) + b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def run_hashes(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A hash of each n consecutive words, from those of powers of two."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if n & size:
            out = power if out is None else _mix(out[: len(h) - done - size + 1], power[done:], salt + done)
            done += size
        if done == n:
            return out[: len(h) - n + 1]
        power = _mix(power[:-size], power[size:], salt + size * 1000)
        size *= 2


def least_of(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive numbers."""
    power, size = h, 1
    while size * 2 <= n:
        power = np.minimum(power[:-size], power[size:])
        size *= 2
    return np.minimum(power[: len(h) - n + 1], power[n - size :][: len(h) - n + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def among(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which numbers are among sorted keys; the keys, far more than the numbers, aren't touched as a whole."""
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def anchors_of(h: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (least hash of the word groups inside) of each window of length words, and the hashes of all groups."""
    groups = run_hashes(h, anchor, 1) >> SPARED
    return least_of(groups, length - anchor + 1), groups


def windows_of(h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each window of length words."""
    return run_hashes(h, length, 2), run_hashes(h, length, 3)


def _texts(blob: bytes) -> Iterator[tuple[int | None, list[bytes]]]:
    rows = unpacked(blob)
    for part in rows.to_batches(max_chunksize=64):
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            yield doc, text.split()


def _digest(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.sha256(b" ".join(words)).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:16], "little", signed=True)


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, chunk_bytes: int = CHUNK_BYTES, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (null without texts), kept_sha256 and repeats (first word, words) for every row of docs.

    A window of length words is a repeat if the same words also start earlier (smaller doc_id, or the
    same document, earlier start), judged on the input; words under a repeat are removed.

    Each window holds the anchor that winnowing picks in it, so equal windows share an anchor. Anchors
    are counted over the corpus; only where one occurs twice can a window repeat. There the anchor is
    extended both ways to all windows around it, each compared by 128 bits with the earliest one of
    its words; windows that touch make up the maximal repeat. Exact copies of a whole document are
    settled by their digest and need no windows. Counts and earliest places are combined in each chunk
    and again before a shuffle: a passage in every document is one row for each chunk, and
    no two occurrences are ever paired.

    Null texts count as empty; a null doc_id sorts last; rows with the same doc_id and text are the same place and do not
    remove each other; an empty table gives an empty result.
    """
    chunks = chunked(documents(docs), chunk_bytes)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                copies: dict[tuple[int, int], list[int]] = {}
                found = []
                for doc, words in _texts(blob):
                    if len(words) < length:
                        continue
                    own = copies.setdefault(_digest(words), [LAST, 0])
                    own[0] = min(own[0], LAST if doc is None else doc)
                    own[1] += 1
                    if own[1] > 1:  # its anchors are counted already; the count of copies tells the rest
                        continue
                    least, groups = anchors_of(word_hashes(words), length, anchor)
                    chosen = np.unique(least)
                    found.append(groups[among(groups, chosen)])
                keys, n = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
                yield rows(chunk, keys.view(np.int64), np.zeros(len(keys), np.int64), n, np.zeros(len(keys), np.int64), False)
                k = np.array(list(copies), np.int64).reshape(-1, 2)
                v = np.array(list(copies.values()), np.int64).reshape(-1, 2)
                yield rows(chunk, k[:, 0], k[:, 1], v[:, 1], v[:, 0], True)
                give_back()

    def rows(chunk: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, first: np.ndarray, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(a), chunk, np.int64)), "whole": pa.array(np.full(len(a), whole)), "a": pa.array(a), "b": pa.array(b), "n": pa.array(n.astype(np.int64)), "first": pa.array(first)})

    shared = answered(
        chunks.mapInArrow(seeds, "chunk long, whole boolean, a long, b long, n long, first long"),
        ["whole", "a", "b"], [F.sum("n").alias("total"), F.min("first").alias("least")], F.col("total") > 1,
    ).select("chunk", "whole", "a", "b", "least")

    def repeated(side: pa.Table) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
        whole = side.filter(side.column("whole"))
        copies = dict(zip(zip(whole.column("a").to_pylist(), whole.column("b").to_pylist(), strict=True), whole.column("least").to_pylist(), strict=True))
        return np.sort(side.filter(pc.invert(side.column("whole"))).column("a").to_numpy().view(np.uint64)), copies

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob").to_pylist():
            anchors, copies = repeated(right)
            for doc, words in _texts(blob):
                place = LAST if doc is None else doc
                if len(words) < length or copies.get(_digest(words), place) < place:
                    continue
                h = word_hashes(words)
                at = np.flatnonzero(among(anchors_of(h, length, anchor)[0], anchors))
                if len(at):
                    a, b = (x[at] for x in windows_of(h, length))
                    out.append((a, b, np.full(len(at), place, np.int64), at.astype(np.int64)))
        a, b, doc, start = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.lexsort((start, doc, b, a))
        a, b, doc, start = a[order], b[order], doc[order], start[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
        n = np.diff(np.append(new, len(a)))
        # in the order of the text again: neighbouring rows then share most of their bytes, which the shuffle's compression uses
        order = np.lexsort((start[new], doc[new]))
        new, n = new[order], n[order]
        del out
        give_back()
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table({"chunk": pa.array(np.full(len(new), chunk, np.int64)), "a": pa.array(a[new].view(np.int64)), "b": pa.array(b[new].view(np.int64)), "doc": pa.array(doc[new]), "start": pa.array(start[new]), "n": pa.array(n.astype(np.int64))})

    def by_chunk(side: DataFrame, f, schema: str) -> DataFrame:
        return chunks.groupBy("chunk").cogroup(side.groupBy("chunk")).applyInArrow(f, schema)

    # one row for each chunk and window, so that a key's group is as many rows as chunks hold it, whatever the copies in them
    same = Window.partitionBy("a", "b")
    windows = by_chunk(shared, extend, "chunk long, a long, b long, doc long, start long, n long").repartition("a", "b")  # plain columns cross the network, structs are made behind it
    windows = windows.select("chunk", "a", "b", "n", F.struct("doc", "start").alias("own"), F.min(F.struct("doc", "start")).over(same).alias("first"))
    # a chunk whose only such window is the earliest one has nothing to remove and needs no answer
    windows = windows.where((F.col("n") > 1) | (F.col("first") < F.col("own")))
    side = windows.select("chunk", F.lit(None).cast("boolean").alias("whole"), "a", "b", F.col("first.doc").alias("least"), F.col("first.start").alias("start"))
    side = side.unionByName(shared.where("whole"), allowMissingColumns=True)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("blob").to_pylist():
            _, copies = repeated(right.filter(pc.is_valid(right.column("whole"))))
            mine = right.filter(pc.is_null(right.column("whole")))
            a, b = (mine.column(c).to_numpy().view(np.uint64) for c in "ab")
            order = np.argsort(a)
            a, b = a[order], b[order]
            doc, start = (mine.column(c).to_numpy()[order] for c in ("least", "start"))
            for own, words in _texts(blob):
                place = LAST if own is None else own
                spans = []
                if len(words) >= length and copies.get(_digest(words), place) < place:
                    spans = [(0, len(words))]
                elif len(words) >= length and len(a):
                    x, y = windows_of(word_hashes(words), length)
                    at = np.minimum(np.searchsorted(a, x), len(a) - 1)
                    begin = np.arange(len(x))
                    hit = (a[at] == x) & (b[at] == y) & ((doc[at] < place) | ((doc[at] == place) & (start[at] < begin)))
                    for s in np.flatnonzero(hit).tolist():
                        if spans and s <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], s + length)
                        else:
                            spans.append((s, s + length))
                kept, at = [], 0
                for s, e in spans:
                    kept += words[at:s]
                    at = e
                kept = b" ".join(kept + words[at:])
                out.append((own, len(words), sum(e - s for s, e in spans), kept if texts else None, hashlib.sha256(kept).hexdigest(), [{"first_word": s, "n_words": e - s} for s, e in spans]))
        cols = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32())])))
        names = ("doc_id", "n_words", "n_removed", "kept_text", "kept_sha256", "repeats")
        made = pa.table({n: pa.array(list(c), k) for n, c, k in zip(names, cols, kinds, strict=True)})
        del out, cols
        give_back()
        return made.set_column(3, "kept_text", made.column("kept_text").cast(pa.string()))

    return by_chunk(side, finish, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string, repeats array<struct<first_word:int,n_words:int>>")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS s, ws FROM d WHERE len(ws) >= 20),
v AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS t FROM w),
f AS (SELECT t, min((doc_id, s)) AS first FROM v GROUP BY t HAVING count(*) > 1),
c AS (SELECT DISTINCT v.doc_id, v.s + k AS i FROM v JOIN f USING (t), range(20) r(k) WHERE (v.doc_id, v.s) > f.first),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN c USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""
