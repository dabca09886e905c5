"""Benchmark decontamination: spaced-seed hashes join test items and documents; overlaps are then verified."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import documents, rows_of, stored, table

#: Token positions that count (1) and that are ignored (0). Every overlap of MIN_WORDS words, and every whole item from SHORTEST words,
#: with MIN_SHARE of equal words has a place where one of them sees equal words alone (a test enumerates all substitutions).
SEEDS = ("11111", "110111", "11001011")
#: An overlap counts from this many words (or a whole shorter item of at least SHORTEST), at this share of equal words; a shorter item as a whole phrase.
MIN_WORDS, SHORTEST, MIN_SHARE = 13, 8, 0.8
#: Words of test items in one block: bounds what is broadcast; further blocks take further passes.
BLOCK_WORDS = 2_000_000
#: Words of items that are compared with a text at once.
AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), without ASCII punctuation at their ends."""
    return [x for x in (w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in text.lower().split()) if x]


def _hashes(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the seen positions at each place of a mask; places with a word that no item has are marked bad."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, good = np.full(n, len(mask), np.uint64), np.ones(n, bool)
    for k, seen in enumerate(mask):
        if seen == "1":
            part = ids[k : k + n]
            good &= part > 0
            h = (h ^ part.astype(np.uint64)) * _MIX
            h ^= h >> np.uint64(29)
    return h, good


@dataclass
class Index:
    """A block of test items: their words as numbers, and for each mask (of short items, their length) the sorted hashes with their places."""

    vocabulary: dict[bytes, int]
    items: list[tuple[int, np.ndarray]]
    tables: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]
    #: The words of all items one after another, where each item begins, how many words it has, and how many must be equal at least.
    words: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    least: np.ndarray


def build_index(items: list[tuple[int, str]], masks: tuple[str, ...] = SEEDS) -> Index:
    vocabulary: dict[bytes, int] = {}
    coded = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of((t or "").encode())], np.int64)) for i, t in items]
    tables = []
    of_mask = [(mask, [k for k, (_, ids) in enumerate(coded) if len(ids) >= SHORTEST]) for mask in masks]
    of_mask += [("1" * n, [k for k, (_, ids) in enumerate(coded) if len(ids) == n]) for n in range(1, SHORTEST)]
    for mask, own in of_mask:
        if not own:
            continue
        parts = [(h := _hashes(coded[k][1], mask)[0], np.full(len(h), k), np.arange(len(h))) for k in own]
        hs, ks, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(hs, kind="stable")
        tables.append((mask, hs[order].astype(np.uint64), ks[order], at[order]))
    sizes = np.array([len(ids) for _, ids in coded], np.int64)
    words = np.concatenate([np.zeros(0, np.int64), *(ids for _, ids in coded)])
    least = np.where(sizes < SHORTEST, sizes, np.ceil(MIN_SHARE * np.minimum(sizes, MIN_WORDS) - 1e-9).astype(np.int64))
    return Index(vocabulary, coded, tables, words, np.cumsum(sizes) - sizes, sizes, least)


def _ramps(sizes: np.ndarray) -> np.ndarray:
    """0 to n - 1 for each n, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _spans(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of neighbours whose sizes add up to about most, one of a larger size by itself."""
    start, sums = 0, np.cumsum(sizes)
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(sums, most + (sums[start - 1] if start else 0), side="right")))
        yield slice(start, end)
        start = end


def _lines(index: Index, ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Items and shifts at which an overlap may lie: those that a mask hits and at which enough words of the item are equal.

    However many items have what a place shows (a prompt that thousands begin with), their hits are taken and their equal words counted
    together, AT_ONCE words at a time; what a line costs by itself is paid for lines with enough equal words alone.
    """
    for mask, hs, ks, at in index.tables:
        h, good = _hashes(ids, mask)
        places = np.flatnonzero(good)
        lo = np.searchsorted(hs, h[places])
        hit = hs[np.minimum(lo, len(hs) - 1)] == h[places]
        if not hit.any():
            continue
        places, lo = places[hit], lo[hit]
        n = np.searchsorted(hs, h[places], side="right") - lo
        for some in _spans(n, AT_ONCE // 4):
            entries = np.repeat(lo[some], n[some]) + _ramps(n[some])
            shifts = np.repeat(places[some], n[some]) - at[entries]
            k, shift = ks[entries], shifts
            if len(k) > 1:  # hits of one line follow each other in a text, and are one
                order = np.lexsort((shift, k))
                k, shift = k[order], shift[order]
                new = np.concatenate(([True], (np.diff(k) != 0) | (np.diff(shift) != 0)))
                k, shift = k[new], shift[new]
            first = np.maximum(0, -shift)
            width = np.minimum(index.sizes[k], len(ids) - shift) - first
            for part in _spans(width, AT_ONCE):
                step = _ramps(width[part])
                own = index.words[np.repeat(index.starts[k[part]] + first[part], width[part]) + step]
                equal = own == ids[np.repeat(first[part] + shift[part], width[part]) + step]
                counts = np.add.reduceat(equal, np.cumsum(width[part]) - width[part], dtype=np.int64)
                enough = counts >= index.least[k[part]]
                yield from zip(k[part][enough].tolist(), shift[part][enough].tolist(), strict=True)


def _longest(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the longest stretch with enough equal words: prefix sums of (equal - share), never falling below where they start."""
    total = np.concatenate(([0.0], np.cumsum(equal - MIN_SHARE)))
    ahead = np.maximum.accumulate(total[::-1])[::-1]
    reach = np.searchsorted(-ahead, 1e-9 - total, side="right") - 1
    a = int(np.argmax(reach - np.arange(len(total))))
    return a, int(reach[a])


def overlaps(index: Index, text: bytes) -> list[tuple[int, int, int, int]]:
    """(item_id, first word, words, equal words) for each verified overlap of a text with an item."""
    get = index.vocabulary.get
    ids = np.fromiter((get(w, 0) for w in words_of(text)), np.int64)
    found = {}
    for k, shift in sorted(set(_lines(index, ids))):
        item, own = index.items[k]
        lo, hi = max(0, -shift), min(len(own), len(ids) - shift)
        equal = (own[lo:hi] == ids[lo + shift : hi + shift]).astype(np.int64)
        spans = [(0, len(equal))]
        while spans:  # the longest stretch, then those before and after it
            start, stop = spans.pop()
            a, end = _longest(equal[start:stop])
            a, end = a + start, end + start
            n, same = end - a, int(equal[a:end].sum())
            if n >= min(MIN_WORDS, len(own)) and same >= (MIN_SHARE * n if len(own) >= SHORTEST else n) - 1e-9:
                key = (item, a + lo + shift)
                found[key] = max(found.get(key, (0, 0)), (n, same))
                spans += [(start, a), (end, stop)]
    return [(i, s, n, e) for (i, s), (n, e) in sorted(found.items(), key=str)]


def blocks_of(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, str]]]:
    """The test items, streamed to the driver in blocks of bounded size."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1]) // 2 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def contaminations(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, n_words and n_equal, one row for each overlap of a document with a test item.

    Whole texts are read. The hashes of a block of items, of bounded size, go to all tasks; a larger
    benchmark takes one pass over the documents for each block. An overlap lies on one diagonal through a
    hit, reaches MIN_SHARE of equal words and MIN_WORDS words (or all words of a shorter item): none is
    missed, as a hit is certain. Items of fewer than SHORTEST words are found as whole phrases, all words equal. Null texts
    and items without words have no overlaps; null ids are carried; repeated rows repeat their result; an empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, first_word int, n_words int, n_equal int"
    spark, out, texts_of = docs.sparkSession, None, documents(docs)
    for block in blocks_of(benchmark, block_words):
        shared = spark.sparkContext.broadcast(build_index(block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch, texts in rows_of(batches):
                rows = [(d, *o) for d, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True) for o in overlaps(index, t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        part = stored(texts_of.mapInArrow(search, schema))
        shared.destroy()  # one block's index is held at a time
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs that share no passage with the benchmark, all columns carried.

    Each row is judged by its own text in the pass that reads it: null and repeated ids don't matter, repeated rows all go or all
    stay, null texts stay, columns of any name stay; an empty table or benchmark leaves docs as it is. A benchmark of several blocks takes a
    pass for each, and what a pass keeps is stored before the next block is built.
    """
    kept, held = docs, None
    for block in blocks_of(benchmark, block_words):
        if held is not None:
            kept = stored(kept)
            held.destroy()
        held = shared = docs.sparkSession.sparkContext.broadcast(build_index(block))

        def judge(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, texts in rows_of(batches):
                yield batch.filter(pa.array([not t or not overlaps(shared.value, t) for t in texts], pa.bool_()))

        kept = kept.mapInArrow(judge, docs.schema)
    return kept


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
