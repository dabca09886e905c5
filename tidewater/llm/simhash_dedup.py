"""Near-dedup: SimHash with segment popcounts and a grid range join under Manhattan distance; shingle similarity with MinHash bands; exact verification."""

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import BROADCAST_BYTES, answered, documents, give_back, mark, rows_of, small, stored, table, without

#: Words in a shingle, differing bits that still link, hash seed.
WORDS, MAX_BITS, SEED = 4, 4, 42
#: Bits in a segment, fingerprints that a cell of the grid may have by chance, members of a cell above which its work is split over tasks.
SEGMENT, CHANCE, CELL = 2, 8, 4096
#: Members up to which a cell gives all its links; a larger one gives a spanning forest of them.
SMALL = 24
#: Of drop_near_duplicates: words in a shingle and the Jaccard similarity that links; bands of a text and minima in a band; texts and shingles in a block.
SHINGLE, SIMILAR, BANDS, ROWS, BLOCK, BLOCK_WORDS = 5, 0.8, 24, 6, 1024, 1 << 19
_FACTORS, _OFFSETS = (np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash over XXH64 of the shingles of a text: a bit is set if it is in over half of the hashes; zero without words."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as one number; zero where there are none."""
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65535):
        part = hashes[at : at + 65535].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for every row."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(fps)})

    return documents(docs).mapInArrow(compute, "doc_id long, fp long")


def embedding(fps: np.ndarray) -> np.ndarray:
    """Counts of set bits in each two-bit segment, in unary (0: 00, 1: 01, 2: 11), packed into 64 bits.

    The Hamming distance of two such codes is the Manhattan distance of the counts, which never
    exceeds the Hamming distance of the fingerprints.
    """
    low, high = fps & np.uint64(0x5555555555555555), (fps >> np.uint64(1)) & np.uint64(0x5555555555555555)
    return (low | high) | ((low & high) << np.uint64(1))


def cells(parts: int, max_bits: int) -> np.ndarray:
    """Masks of the grid: each choice of parts - max_bits parts of the segments.

    Two vectors at a Manhattan distance of at most max_bits agree on all counts in at least that
    many parts, so they share the cell of one such choice.
    """
    edges = np.linspace(0, 64 // SEGMENT, parts + 1).astype(int) * SEGMENT
    masks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in itertools.pairwise(edges)]
    return np.array([sum(masks[i] for i in chosen) for chosen in itertools.combinations(range(parts), parts - max_bits)], np.uint64)


def parts_for(n: int, max_bits: int = MAX_BITS) -> int:
    """Parts of the grid for n different fingerprints: the fewest with which a cell has at most CHANCE of them by chance.

    A segment's count has 1.5 bits, so max_bits of parts parts left out leave 48 * (1 - max_bits / parts) bits. A fingerprint goes to
    one cell for each choice of those parts: the work grows as n times a polynomial of degree max_bits in the number of parts,
    and pairs that meet by chance grow as n, not as its square.
    """
    bits = 1.5 * 64 / SEGMENT
    return next((p for p in range(max_bits + 1, 64 // SEGMENT + 1) if n <= CHANCE * 2 ** (bits * (1 - max_bits / p))), 64 // SEGMENT)


def _links(left: np.ndarray, right: np.ndarray, same: bool, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between two blocks of fingerprints: pairs of positions, each joining parts not yet joined."""
    codes = embedding(right)
    parent = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    a_out, b_out = [], []
    step = max(1, (4 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        block = left[at : at + step]
        bound = np.bitwise_count(embedding(block)[:, None] ^ codes[None, :]) <= max_bits
        i, j = np.nonzero(np.triu(bound, at + 1) if same else bound)
        near = np.bitwise_count(block[i] ^ right[j]) <= max_bits
        for a, b in zip((i[near] + at).tolist(), j[near].tolist(), strict=True):
            x, y = root(a), root(b if same else len(left) + b)
            if x != y:
                parent[x] = y
                a_out.append(a)
                b_out.append(b)
    return np.array(a_out, np.int64), np.array(b_out, np.int64)


def near_links(fps: DataFrame, parts: int | None = None, max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """Links (a, b) among different fingerprints (column fp), enough to connect all within max_bits of each other.

    Each fingerprint is dealt to its grid cells. A cell compares the embeddings of its members, the
    lower bound, and then the fingerprints of those within it; a larger one gives a spanning forest of its
    links, at most one row for each member. A cell with more members than cell is split into blocks; each two
    blocks meet in a task of their own, so no link is lost and no task holds more than two blocks.
    """
    masks = cells(parts or parts_for(fps.count(), max_bits), max_bits)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().astype(np.int64)
            code = embedding(fp.view(np.uint64))
            for c, mask in enumerate(masks):
                yield pa.RecordBatch.from_pydict({"choice": pa.array(np.full(len(fp), c, np.int32)), "cell": pa.array((code & mask).view(np.int64)), "fp": pa.array(fp)})

    dealt = fps.mapInArrow(deal, "choice int, cell long, fp long")
    sizes = dealt.groupBy("choice", "cell").agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes)
    dealt = dealt.join(sizes, ["choice", "cell"])
    blocks = F.ceil(F.col("n") / cell).cast("int")
    dealt = dealt.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block i meets each block j: once as (i, j) for i <= j and once as (j, i) for j < i
    meets = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda j: F.struct(F.least("mine", j).alias("lo"), F.greatest("mine", j).alias("hi")),
    )
    dealt = dealt.withColumn("meet", F.explode(meets)).select("choice", "cell", "meet.lo", "meet.hi", (F.col("mine") == F.col("meet.lo")).alias("is_lo"), "fp")

    def compare(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a partition has whole groups, sorted; small cells cost a few array operations each
        held = None
        for batch in itertools.chain(groups, [None]):
            rows = pa.Table.from_batches([batch]) if batch is not None else None
            if held is not None and held.num_rows:
                rows = pa.concat_tables([held, rows]) if rows is not None else held
            if rows is None or not rows.num_rows:
                continue
            cols = [rows.column(c).to_numpy() for c in ("choice", "cell", "lo", "hi")]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            # the last group may go on in the next batch
            last = rows.num_rows if batch is None else 0 if not len(change) else int(change[-1])
            held = None if batch is None else rows.slice(last)
            edges = np.concatenate(([0], change[change < last], [last]))
            fp, is_lo = rows.column("fp").to_numpy().view(np.uint64)[:last], rows.column("is_lo").to_numpy(zero_copy_only=False)[:last]
            same, size = (cols[2] == cols[3])[edges[:-1]], np.diff(edges)
            of, code, out = np.repeat(np.arange(len(size)), size), embedding(fp), []
            small = np.flatnonzero((size <= SMALL)[of])
            for k in range(1, SMALL):  # small cells: all at once, by the distance of two members in the sorted rows
                i = small[small + k < last]
                i = i[of[i] == of[i + k]]
                if not len(i):
                    break
                i = i[same[of[i]] | (is_lo[i] != is_lo[i + k])]
                i = i[np.bitwise_count(code[i] ^ code[i + k]) <= max_bits]
                i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= max_bits]
                out.append((fp[i], fp[i + k]))
            for g in np.flatnonzero(size > SMALL).tolist():
                f, low = fp[edges[g] : edges[g + 1]], is_lo[edges[g] : edges[g + 1]]
                left, right = (f, f) if same[g] else (f[low], f[~low])
                i, j = _links(left, right, bool(same[g]), max_bits)
                out.append((left[i], right[j]))
            if out:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

    grouped = dealt.repartition("choice", "cell", "lo", "hi").sortWithinPartitions("choice", "cell", "lo", "hi")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b).

    Large-star and small-star steps in turn: each is a minimum over the neighbours of a node, combined
    before its shuffle, then a join back. Goes on until a round changes nothing.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        out = both.join(least, "u")
        if large:
            out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        return stored(out.where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while now[0] and now != before:
        edges = star(star(edges, True), False)
        before, now = now, state(edges)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs.

    Copies share a fingerprint and are compared once. Texts without words have fingerprint zero and
    link like any other. A null doc_id is never the smallest of a group; a group of null ids alone has
    a null component_id. Repeated rows keep their rows; an empty table gives none.
    """
    fps = stored(fingerprints(docs, words))
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(near_links(reps.select("fp"), max_bits=max_bits))
    # a component is named by its smallest document, not by its smallest fingerprint
    named = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "rep", "component")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    known = stored(named.join(stored(least), "component", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 hashes of the shingles of a text, sorted; a shorter text is one shingle, one without words has none."""
    found = text.lower().split()
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i : i + k]), SEED) for i in range(len(found) - k + 1)] if found else [], np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """One hash for each band: two sets of similarity s agree on a band with probability s to the power of ROWS."""
    mins = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        mins = np.minimum(mins, (own[at : at + 1024, None] * _FACTORS + _OFFSETS).min(axis=0))
    rows = mins.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64)


def similar_links(sets: list[np.ndarray], side: np.ndarray | None = None, share: float = SIMILAR) -> list[tuple[int, int]]:
    """A forest of the pairs of sets whose Jaccard similarity reaches share, counted exactly; with side, of those on different sides."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    size, side = size[order], None if side is None else side[order]
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    edges = np.concatenate(([0], np.cumsum(size)))
    mark, part, out = np.zeros(int(codes.max(initial=0)) + 1, bool), np.arange(len(sets)), []
    ends = np.searchsorted(size, size / share + 1e-9, side="right")  # a set larger than that cannot be similar enough
    for i, end in enumerate(ends.tolist()):
        open_ = part[i + 1 : end] != part[i]
        if side is not None:
            open_ &= side[i + 1 : end] != side[i]
        if not open_.any() or not size[i]:
            continue
        mark[codes[edges[i] : edges[i + 1]]] = True
        common = np.add.reduceat(mark[codes[edges[i + 1] : edges[end]]], edges[i + 1 : end] - edges[i + 1], dtype=np.int64)
        mark[codes[edges[i] : edges[i + 1]]] = False
        for j in (np.flatnonzero(open_ & (common >= share * (size[i] + size[i + 1 : end] - common) - 1e-9)) + i + 1).tolist():
            if part[i] != part[j]:
                part[part == part[j]] = part[i]
                out.append((int(order[i]), int(order[j])))
    return out


def _blocks(block: int) -> Column:
    """Blocks of a set of texts with the counts n and words."""
    return F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")


def near_leaders(large: DataFrame, sets: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """key and leader for the texts of large (key, component, leader, bytes) that are similar to their component's leader.

    The leaders' shingle sets go to all tasks while their known sizes allow. Beyond that a text meets its leader's set in a plain join on the
    component, in which adaptive execution splits one that many texts have.
    """
    leaders = stored(large.where("key = leader").select("component", "key", "bytes"))
    known = 0 < (leaders.agg(F.sum("bytes")).first()[0] or 0) <= broadcast_bytes
    theirs = leaders.join(sets, "key").select("component", F.col("own").alias("theirs"))
    of: dict[int, np.ndarray] = {r["component"]: np.frombuffer(r["theirs"], np.uint64) for r in theirs.collect()} if known else {}
    shared = large.sparkSession.sparkContext.broadcast(of)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for i, (component, own) in enumerate(zip(batch.column("component").to_pylist(), batch.column("own"), strict=True)):
                a, b = np.frombuffer(own.as_buffer(), np.uint64), shared.value[component] if known else np.frombuffer(batch.column("theirs")[i].as_buffer(), np.uint64)
                common = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                near.append(common >= SIMILAR * (len(a) + len(b) - common) - 1e-9)
            yield batch.filter(pa.array(near, pa.bool_())).select(["key", "leader"])

    rows = large.select("key", "component", "leader").join(sets, "key").select("key", "leader", "component", "own")
    rows = rows if known else stored(rows).join(stored(theirs), "component")
    return rows.mapInArrow(compare, "key long, leader long")


def simhash_candidates(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of keys, enough to connect all whose fingerprints (column fp) differ by MAX_BITS at most: the grid join of near_links over
    the different fingerprints, then back to the texts that have them. Texts without words take no part."""
    of = stored(answered(reps.where("size > 0").select("key", "fp"), ["fp"], [F.min("key").alias("top")]))
    tops = stored(of.where("key = top").select("fp", "top"))
    links = near_links(tops.select("fp"))
    for end in "ab":
        links = links.join(tops.select(F.col("fp").alias(end), F.col("top").alias(f"top_{end}")), end)
    return of.where("key <> top").select(F.col("key").alias("a"), F.col("top").alias("b")).union(links.select("top_a", "top_b"))


def similar_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, mark, component_id and component_mark for every row: groups linked by a Jaccard similarity of SIMILAR over shingles of SHINGLE words.

    Candidates are all texts whose SimHash fingerprints, over their distinct shingles, differ by MAX_BITS at most: the grid join finds every
    such pair. No larger radius has selective cells, and fingerprints at a similarity of 0.8 differ by 8 bits on average, so MinHash
    bands add the candidates beyond the radius: a pair of similarity 0.8 with probability 0.9993 and more similar ones more surely. Texts connected by candidates meet once, and all their pairs are
    verified on their whole shingle sets. In a larger set of them, all texts first meet one, the leader, from the largest group of a
    band: copies of one text are all linked to it in one pass. Those that aren't are split into blocks, which meet each other and the
    blocks of those that are, each two in a task of their own: the work grows with the texts that are not near the leader times all. Texts with equal shingle sets are compared once (by a hash of 64 bits). Null ids as in near_duplicates. A mark is a
    hash of a row's text; component_id and component_mark together name the text that stands for its group.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            sets = [shingles(t) for t in texts]
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fps = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            found = [bands(s).view(np.int64) if len(s) else [] for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": pa.array(keys), "mark": batch.column("mark"), "size": pa.array([len(s) for s in sets], pa.int64()), "fp": pa.array(fps), "bands": pa.array(found, pa.list_(pa.int64()))})

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            sets = [shingles(t).tobytes() for t in texts]
            keys = np.array([xxhash.xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "own": pa.array(sets, pa.binary())})

    def verify(rows: pa.Table) -> pa.Table:
        keys, lo = rows.column("key").to_pylist(), rows.column("is_lo").to_numpy(zero_copy_only=False)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("own")]
        same = rows.column("lo")[0] == rows.column("hi")[0]
        links = similar_links(sets, None if same else lo)
        del sets
        give_back()
        return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.int64()), "b": pa.array([keys[j] for _, j in links], pa.int64())})

    def least(of: str, by: str) -> Column:
        """The of that goes with the smallest by; the smallest of where there is none."""
        return F.coalesce(F.min_by(of, by), F.min(of))

    docs = documents(docs)
    signed = stored(docs.withColumn("mark", mark(F.col("text"))).mapInArrow(sign, "doc_id long, key long, mark long, size long, fp long, bands array<long>"))
    reps = stored(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), least("mark", "doc_id").alias("rep_mark"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    dealt = answered(reps.select("key", F.explode("bands").alias("band")), ["band"], [F.min("key").alias("least"), F.count("*").alias("n")], F.col("n") > 1)
    near = components(simhash_candidates(reps).union(dealt.select("key", "least")))
    tops = dealt.groupBy("least").agg(F.max("n").alias("top"))
    near = near.join(reps.select("key", "rep", "rep_mark", "size"), near["node"] == reps["key"]).join(tops, F.col("key") == F.col("least"), "left")
    near = stored(near.select("key", "rep", "rep_mark", "size", "component", F.coalesce("top", F.lit(0)).alias("top")))
    near = answered(near, ["component"], [F.count("*").alias("n"), F.sum("size").alias("words"), F.max_by("key", "top").alias("leader")])
    wanted, own = small(stored(near.select("rep", "rep_mark").distinct()), 64), docs.withColumn("mark", mark(F.col("text")))
    texts = own.join(wanted, own["doc_id"].eqNullSafe(F.col("rep")) & (own["mark"] == F.col("rep_mark")), "left_semi").select("doc_id", "text")
    sets = stored(stored(texts.mapInArrow(gather, "key long, own binary")).dropDuplicates(["key"]))
    near = stored(near.join(sets.withColumn("bytes", F.octet_length("own")).select("key", "bytes"), "key"))
    led = stored(near_leaders(near.where(_blocks(block) > 1), sets))
    # near the leader, a text has its link: such texts needn't meet each other, only those that aren't
    near = near.join(led.select("key", F.lit(True).alias("is_led")), "key", "left").withColumn("is_led", F.coalesce("is_led", F.lit(False)))
    count = lambda side: F.greatest(F.ceil(F.count_if(side) / block), F.ceil(F.sum(F.when(side, F.col("size")).otherwise(0)) / BLOCK_WORDS)).cast("int")
    near = answered(near, ["component"], [count(~F.col("is_led")).alias("apart"), count(F.col("is_led")).alias("together")])
    hashed = F.xxhash64("key")
    mine = F.when(F.col("is_led"), F.col("apart") + F.pmod(hashed, F.greatest("together", F.lit(1)))).otherwise(F.pmod(hashed, F.greatest("apart", F.lit(1)))).cast("int")
    near = stored(near.withColumn("mine", mine))
    others = F.when(F.col("is_led"), F.col("apart")).otherwise(F.col("apart") + F.col("together"))
    numbers = F.when(others > 0, F.sequence(F.lit(0), others - 1)).otherwise(F.array().cast("array<int>"))
    meets = F.transform(numbers, lambda j: F.struct(F.least("mine", j).alias("lo"), F.greatest("mine", j).alias("hi")))
    met = near.withColumn("meet", F.explode(meets)).select("component", "meet.lo", "meet.hi", (F.col("mine") == F.col("meet.lo")).alias("is_lo"), "key")
    met = met.join(sets, "key")
    links = met.groupBy("component", "lo", "hi").applyInArrow(verify, "a long, b long")
    found = components(links.unionByName(led.select(F.col("key").alias("a"), F.col("leader").alias("b"))))
    named = reps.join(found, reps["key"] == found["node"], "left").select("key", "rep", "rep_mark", "component")
    first = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"), least("rep_mark", "rep").alias("least_mark"))
    known = named.join(stored(first), "component", "left").select("key", F.coalesce("least", "rep").alias("component_id"), F.coalesce("least_mark", "rep_mark").alias("component_mark"))
    return signed.select("doc_id", "mark", "key").join(stored(known), "key").select("doc_id", "mark", "component_id", "component_mark")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of similar texts, all columns carried: the one with the smallest doc_id.

    Rows are told apart by id and text: null ids sort last, a repeated id keeps only the row whose text stands for its group, rows
    alike in both leave one. Null and empty texts are one group; columns of any name stay; an empty table gives an empty result.
    """
    rows = stored(similar_groups(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("mark") == F.col("component_mark"))))
    pairs = stored(rows.groupBy("doc_id", "mark").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"))
    return without(docs, pairs.where("NOT kept"), pairs.where("kept"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
