"""The operators on small fixtures with nulls, empty and long texts, ties, repeated rows, clashing columns, and against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidewater.llm import decontaminate, exact_dedup, license_scan, lm_score, quality, sentencepiece_codec, simhash_dedup, substring_dedup, toxicity, url_filter

R = random.Random(7)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(1, 7))) for _ in range(300)]
prose = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
BASE = [prose(60) for _ in range(12)]
PASSAGE = prose(30)
TEXTS = [
    *BASE, BASE[0], BASE[0].replace(" ", "  \n"), BASE[1] + " extra", None, "", "   ", "a", "é ñ  ▁ 日本 𝔘", PASSAGE + " " + prose(30), prose(20) + " " + PASSAGE, PASSAGE + " " + PASSAGE,
    prose(30000), "Released under the MIT License. " + prose(5), "Idiot! you are a stupid, worthless clown", BASE[2].upper(),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, chunk long, fp long, key string, run int, held_out boolean, word binary"
EXTRA = ("en", "s", 1, 1, 1, 1, "k", 1, True, None)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *EXTRA) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], *EXTRA), (None, BASE[4], *EXTRA), (None, None, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def as_set(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


EMPTY = [
    lambda d, s: exact_dedup.exact_groups(d), lambda d, s: exact_dedup.exact_dedup(d), lambda d, s: simhash_dedup.near_duplicates(d), lambda d, s: simhash_dedup.drop_near_duplicates(d),
    lambda d, s: sentencepiece_codec.round_trip(d), lambda d, s: license_scan.scan_licences(d), lambda d, s: lm_score.score_corpus(d), lambda d, s: substring_dedup.remove_repeats(d),
    lambda d, s: decontaminate.contaminations(d, s.createDataFrame([], "item_id long, text string")),
    lambda d, s: toxicity.score_toxicity(d, toxicity.fit_toxicity(d, s.createDataFrame([], "doc_id long, quality int, toxic int"))),
    lambda d, s: quality.score_quality(d, quality.fit_quality(d, s.createDataFrame([], "doc_id long, quality int, toxic int"))),
]


@pytest.mark.parametrize("i", range(len(EMPTY)))
def test_empty(spark, docs, i):
    assert EMPTY[i](docs.limit(0), spark).collect() == []


def test_exact(docs):
    groups = {}
    for d, t in plain(docs):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(d)
    want, kept = Counter(), Counter()
    for t, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        want.update((d, least, len(ids), hashlib.sha256(t.encode()).hexdigest()) for d in ids)
        kept[(least, hashlib.sha256(t.encode()).hexdigest())] += 1
    for runs, fan_in in ((4096, 16), (3, 2), (1, 2)):
        got = exact_dedup.exact_groups(docs, runs, fan_in).cache()
        assert as_set(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
        assert as_set(got.where("kept"), "doc_id", "text_sha256") == kept
    assert exact_dedup.exact_dedup(docs).columns == docs.columns
    assert as_set(exact_dedup.exact_dedup(docs), "doc_id") == Counter((k[0],) for k in kept.elements())


def test_exact_merges_sorted_runs(spark):
    """Each of the three rounds deals, sorts and merges: the plan has an exchange, a sort and a window for each."""
    rows = spark.createDataFrame([(i % 4096, f"{i % 7}", 1, 2, i, i, 1) for i in range(60)], "run int, text_sha256 string, n_bytes long, check_hash long, least long, place long, n long")
    merged = exact_dedup.merged_runs(rows)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 3 and plan.count("Sort [run") == 3 and plan.count("Exchange hashpartitioning(run") == 3
    assert sorted((r["text_sha256"], r["least"], r["n"]) for r in merged.collect()) == [(str(i), i, len(range(i, 60, 7))) for i in range(7)]


ALIKE = [(1, "a b"), (1, "a b"), (1, "a  b"), (None, "q"), (None, "q"), (5, "one two three four five six"), (5, "other words here now as well"), (6, "x"), (6, "y"), (7, "x"), (8, None), (9, "")]


def test_one_of_alike_rows(spark):
    """Repeated and null ids: of each group one row stays, and rows of other groups with its id are judged by their own text."""
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in ALIKE], "doc_id long, text string, _digest int, kept boolean").repartition(3)
    for f in (exact_dedup.exact_dedup, simhash_dedup.drop_near_duplicates):
        got = f(docs)
        assert got.columns == docs.columns
        rows = sorted(((r["doc_id"] or 0, (r["text"] or "").replace("  ", " ")) for r in got.collect()), key=str)
        assert rows == sorted([(1, "a b"), (0, "q"), (5, ALIKE[5][1]), (5, ALIKE[6][1]), (6, "x"), (6, "y"), (8, "")], key=str)


def test_rows_of_large_drops(spark, monkeypatch):
    """The way without a broadcast gives the same rows."""
    monkeypatch.setattr("tidewater.llm.common.BROADCAST_BYTES", 0)
    docs = spark.createDataFrame(ALIKE, "doc_id long, text string")
    assert exact_dedup.exact_dedup(docs).count() == 7


def test_decontaminate_judges_rows(spark):
    passage = prose(30)
    docs = spark.createDataFrame([(None, passage), (None, "clean"), (5, passage), (5, "other"), (6, None), (6, "ok")], "_dirty long, text string").selectExpr("_dirty AS doc_id", "text", "_dirty")
    bench = spark.createDataFrame([(1, passage), (2, prose(20)), (3, prose(20))], "item_id long, text string")
    for block in (2_000_000, 1):
        got = decontaminate.decontaminate(docs, bench, block)
        assert got.columns == docs.columns and sorted(str(r["text"]) for r in got.collect()) == ["None", "clean", "ok", "other"]
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 6


def simhash(text):
    words = split(lower(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs):
    rows = [(d, simhash(t)) for d, t in plain(docs)]
    got = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash_dedup.near_duplicates(docs).collect()}
    assert set(got) == {(d, f"{f:016x}") for d, f in rows}
    for d, f in rows:
        near, new = {f}, {f}
        while new:
            new = {g for _, g in rows if g not in near and any((g ^ h).bit_count() <= 4 for h in near)}
            near |= new
        assert got[(d, f"{f:016x}")] == min((e for e, g in rows if g in near and e is not None), default=None)


def test_links_of_split_cells(spark):
    """No link is lost where a cell is split into blocks; the lower bound never exceeds the distance."""
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = {base}
    while len(fps) < 150:
        fps.add(r.choice(sorted(fps)) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    a = np.array(sorted(fps), np.uint64)
    codes = simhash_dedup.embedding(a)
    assert (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= np.bitwise_count(a[:, None] ^ a[None, :])).all()
    signed = a.view(np.int64).tolist()
    found = simhash_dedup.components(simhash_dedup.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), cell=7))
    group = {row[0]: row[1] for row in found.collect()}
    for parts in (5, 8):  # another grid finds the same components
        other = simhash_dedup.components(simhash_dedup.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), parts))
        assert {row[0]: row[1] for row in other.collect()} == group
    for i, x in enumerate(a.tolist()):
        for j in range(i):
            if (x ^ int(a[j])).bit_count() <= 4:
                assert group[signed[i]] == group[signed[j]]


def test_grid_follows_the_fingerprints():
    assert [simhash_dedup.parts_for(n) for n in (0, 1_000, 250_000, 10**7, 10**9, 10**11)] == [5, 5, 6, 7, 10, 14]
    for n in (10**5, 10**8, 10**11):
        p = simhash_dedup.parts_for(n)
        assert n / 2 ** (48 * (1 - 4 / p)) <= simhash_dedup.CHANCE


def test_components_of_a_long_chain(spark):
    """However many rounds it takes: a path, its nodes in any order."""
    nodes = list(range(700))
    R.shuffle(nodes)
    got = simhash_dedup.components(spark.createDataFrame(list(itertools.pairwise(nodes)), "a long, b long")).collect()
    assert len(got) == 700 and {r["component"] for r in got} == {0}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (split(lower(a)), split(lower(b))))
    return len(a & b) / len(a | b)


def test_near_copies_by_shingle_similarity(spark):
    """Planted copies at 0.8 to 0.95 go, those below stay, as a comparison of all pairs says; also where a group is split into blocks."""
    r = random.Random(11)
    texts = []
    for n in (100, 150, 250, 400, 600, 900):
        for changes in (0.006, 0.012, 0.02, 0.03, 0.05):
            base = [f"w{r.randrange(5000)}" for _ in range(n)]
            copy = list(base)
            for i in r.sample(range(n), max(1, int(n * changes))):
                copy[i] = "new"
            texts += [" ".join(base), " ".join(copy)]
    base = [f"v{r.randrange(5000)}" for _ in range(200)]
    texts += [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 200, 5)] + ["", "  ", None, "a b", "A  b"]
    group = list(range(len(texts)))
    sims = {(i, j): jaccard(texts[i] or "", texts[j] or "") for i in range(len(texts)) for j in range(i)}
    assert sum(0.8 <= s <= 0.95 for s in sims.values()) >= 15 and sum(0.5 < s < 0.8 for s in sims.values()) >= 5
    for _ in range(5):
        for (i, j), s in sims.items():
            if s >= 0.8:
                group[i] = group[j] = min(group[i], group[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for block in (1024, 7, 1):
        assert {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(docs, block).collect()} == dict(enumerate(group))
    assert sorted(r["doc_id"] for r in simhash_dedup.drop_near_duplicates(docs).collect()) == sorted(set(group))


def test_decontamination(spark, docs):
    item = PASSAGE.split()
    item[7] = "changed"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "a b c"), (5, prose(25))], "item_id long, text string")
    for block in (2_000_000, 1):
        got = decontaminate.contaminations(docs, bench, block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 1) for i, t in enumerate(TEXTS) if t and PASSAGE in t}
        assert {(r["n_words"], r["n_equal"]) for r in got} == {(30, 29)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3


def test_masks_meet_every_overlap():
    """All places of the allowed substitutions up to 25 words; a longer overlap has one of 13 to 25 words with the same share of equal words."""
    for n in range(decontaminate.SHORTEST, 26):
        wrong = np.array(list(itertools.combinations(range(n), n // 5)))
        equal = np.ones((len(wrong), n), bool)
        equal[np.arange(len(wrong))[:, None], wrong] = False
        met = np.zeros(len(wrong), bool)
        for mask in decontaminate.SEEDS:
            seen = np.array([k for k, x in enumerate(mask) if x == "1"])
            for at in range(n - len(mask) + 1):
                met |= equal[:, seen + at].all(axis=1)
        assert met.all(), n


def test_recall_of_near_copies(spark):
    """All pairs of a whole table at a similarity of 0.8 or more, found through the shingles that they share, are in one group each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    group = {r["doc_id"]: r["component_id"] for r in simhash_dedup.similar_groups(docs).collect()}
    sets, holders = {d: frozenset(simhash_dedup.shingles(t.encode()).tolist()) for d, t in plain(docs)}, {}
    for d, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(d)
    near = Counter(pair for ids in holders.values() for pair in itertools.combinations(sorted(ids), 2))
    found = [(a, b) for (a, b), n in near.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9]
    assert sum(sets[a] != sets[b] for a, b in found) >= 10
    assert all(group[a] == group[b] for a, b in found)
    linked = {x for pair in found for x in pair}
    assert all(group[d] == d for d in group if d not in linked and sets[d])


def test_simhash_gives_candidates(spark, monkeypatch):
    """The pipeline's stage finds every pair within the radius by the grid of fingerprints, and goes through it."""
    r = random.Random(5)
    base = [f"w{r.randrange(9000)}" for _ in range(600)]
    texts = ["", *(" ".join([*base[:k], "x", *base[k + 1 :]]) for k in range(0, 600, 40)), *(" ".join(f"u{r.randrange(9000)}" for _ in range(80)) for _ in range(20))]
    fps = [simhash_dedup.majority(simhash_dedup.shingles(t.encode())) for t in texts]
    rows = [(i, np.array([f], np.uint64).view(np.int64).tolist()[0], len(simhash_dedup.shingles(t.encode()))) for i, (t, f) in enumerate(zip(texts, fps, strict=True))]
    group = {x["node"]: x["component"] for x in simhash_dedup.components(simhash_dedup.simhash_candidates(spark.createDataFrame(rows, "key long, fp long, size long"))).collect()}
    near = [(i, j) for i in range(1, len(texts)) for j in range(1, i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    assert len(near) >= 15 and all(group[i] == group[j] for i, j in near) and 0 not in group
    seen, links = [], simhash_dedup.near_links
    monkeypatch.setattr(simhash_dedup, "near_links", lambda fps: seen.append(fps.count()) or links(fps))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(x["doc_id"] for x in simhash_dedup.drop_near_duplicates(docs).collect()) == [0, 1, *range(16, 36)]
    assert seen == [len({f for f in fps[1:]})]


def test_leaders_beyond_the_broadcast(spark):
    """The same texts are near their leader, whether its shingles are broadcast or joined."""
    base = [np.unique(np.array([R.getrandbits(60) for _ in range(200)], np.uint64)) for _ in range(3)]
    rows, sets, want = [], [], set()
    for component, leader in enumerate(base):
        for i in range(30):
            key = component * 100 + i
            own = leader if i == 0 else np.unique(np.concatenate([leader[: 200 - 3 * i], np.array([R.getrandbits(60) for _ in range(i)], np.uint64)]))
            common = len(np.intersect1d(own, leader))
            want |= {(key, component * 100)} if common >= 0.8 * (len(own) + len(leader) - common) else set()
            rows.append((key, component, component * 100, own.nbytes))
            sets.append((key, own.tobytes()))
    large = spark.createDataFrame(rows, "key long, component long, leader long, bytes long").repartition(3)
    sets = spark.createDataFrame(sets, "key long, own binary")
    assert 3 < len(want) < 90
    for most in (32 << 20, 0):
        assert {tuple(r) for r in simhash_dedup.near_leaders(large, sets, most).collect()} == want
        assert simhash_dedup.near_leaders(large.limit(0), sets, most).collect() == []


def test_overlaps_with_substitutions_and_short_items():
    r = random.Random(5)
    found = lambda item, text: {o[0] for o in decontaminate.overlaps(decontaminate.build_index([(1, " ".join(item))]), " ".join(text).encode())}
    around = lambda x: [*(f"u{i}" for i in range(9)), *x, *(f"v{i}" for i in range(9))]
    for n in (8, 9, 10, 11, 12, 13, 15, 20, 50, 100, 1000):
        item = [f"w{i}" for i in range(n)]
        tried = [range(4, n, 5), *([r.sample(range(n), n // 5) for _ in range(50)])]
        for wrong in tried:
            assert found(item, around("x" if i in wrong else w for i, w in enumerate(item))) == {1}
        assert found(item, around("x" if i in (1, 2, 4, 6, 7) or i % 3 == 0 else w for i, w in enumerate(item))) == set()
    for n in range(1, 8):
        item = [f"w{i}" for i in range(n)]
        assert found(item, around(item)) == {1} and found(item, around([*item[:-1], "x"])) == found(item, around(item[:-1])) == set()
    assert found([], around([])) == set()


def test_many_items_of_one_prompt(monkeypatch):
    """A phrase that all items begin with costs no item its overlap and makes none, however little is compared at once."""
    prompt, tails = WORDS[:5], [[R.choice(WORDS) for _ in range(R.randint(0, 20))] for _ in range(300)]
    items = [(i, " ".join(prompt + t)) for i, t in enumerate(tails)]
    index = decontaminate.build_index(items)
    texts = [prose(50) + " " + " ".join(prompt) + " " + prose(50), " ".join(prompt + prompt * 40), *(f"{prose(9)} {items[i][1]} {prose(9)}" for i in range(0, 300, 60)), " ".join(prompt), ""]
    alone = [{o for i, t in items for o in decontaminate.overlaps(decontaminate.build_index([(i, t)]), text.encode())} for text in texts]
    for at_once in (1 << 20, 50, 1):
        monkeypatch.setattr(decontaminate, "AT_ONCE", at_once)
        assert [set(decontaminate.overlaps(index, text.encode())) for text in texts] == alone
    assert all(any(o[0] == i for o in alone[2 + k]) for k, i in enumerate(range(0, 300, 60)))
    assert {o[0] for o in alone[0]} == {i for i, t in enumerate(tails) if not t}


def test_overlaps_against_all_shifts():
    """Items and texts of few different words, so that much overlaps by chance: the same pairs as a search of every stretch at every shift."""
    r = random.Random(17)
    items = [(i, " ".join(r.choice("abcde") for _ in range(r.choice((3, 6, 8, 10, 13, 20, 30))))) for i in range(40)]
    texts = [" ".join(r.choice("abcdefg") for _ in range(r.randrange(5, 60))) for _ in range(60)]
    texts += [f"x y {' '.join(w if r.random() > 0.15 else 'z' for w in t.split())} x" for _, t in items for _ in range(3)]
    index, pairs = decontaminate.build_index(items), 0
    for text in texts:
        words, want = text.split(), set()
        for i, item in items:
            own = item.split()
            need, share = min(13, len(own)), 0.8 if len(own) >= 8 else 1.0
            for shift in range(1 - len(own), len(words)):
                lo, hi = max(0, -shift), min(len(own), len(words) - shift)
                equal = [own[k] == words[k + shift] for k in range(lo, hi)]
                if any(sum(equal[a:b]) >= share * (b - a) - 1e-9 for a in range(len(equal)) for b in range(a + need, len(equal) + 1)):
                    want.add(i)
        assert {o[0] for o in decontaminate.overlaps(index, text.encode())} == want
        pairs += len(want)
    assert pairs > 100


def test_each_overlap_of_one_shift():
    """Two passages of an item with other words between, at one relative position: both are found."""
    item = [f"w{i}" for i in range(80)]
    text = [*item[:20], *(f"x{i}" for i in range(30)), *item[50:]]
    index = decontaminate.build_index([(1, " ".join(item))])
    rows = decontaminate.overlaps(index, " ".join(text).encode())
    assert len(rows) == 2 and rows[0][1] == 0 and sum(r[3] for r in rows) == 50


def test_sentencepiece(docs):
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rows = sentencepiece_codec.round_trip(docs).collect()
    texts = dict(plain(docs))
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    assert all(list(r["ids"]) == sp.encode(texts[r["doc_id"]]) for r in rows if r["doc_id"] is not None)


def test_sentencepiece_on_documents(spark):
    """Every document of a table, ids as the library gives them."""
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
    rows = sentencepiece_codec.round_trip(table).collect()
    assert len(rows) == len(texts) and all(r["round_trip"] and list(r["ids"]) == sp.encode(texts[r["doc_id"]]) for r in rows)


def test_unigram_on_whole_texts(spark, docs):
    """The sum of scores is that of the best segmentation of the whole text, found without tries or words."""
    v = sentencepiece_codec.Vocabulary(kind="unigram")
    back = {i: p for p, i in v.ids.items()}
    bytes_of = set(v.byte_ids)
    for r in sentencepiece_codec.encode(docs.where("length(text) < 3000"), kind="unigram").collect():
        text = "▁" + r["text"].replace(" ", "▁") if r["text"] else ""
        best = [0.0]
        for end in range(1, len(text) + 1):
            best.append(max(best[s] + v.scores.get(text[s:end], v.lowest if end - s == 1 else -math.inf) for s in range(max(0, end - v.longest), end)))
        known = [back[i] for i in r["ids"] if i not in bytes_of]
        unknown = len(text) - sum(map(len, known))  # characters that became bytes
        assert math.isclose(sum(v.scores[p] for p in known) + unknown * v.lowest, best[-1], rel_tol=1e-9, abs_tol=1e-9)


def test_sentencepiece_encode_and_decode_alone(spark):
    sp = __import__("sentencepiece").SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for texts in (["", ""], [None, "a", "two words"], []):
        docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, decoded string").coalesce(1)
        rows = sentencepiece_codec.decode(sentencepiece_codec.encode(docs)).orderBy("doc_id").collect()
        assert [(list(r["ids"]), r["n_pieces"], r["decoded"]) for r in rows] == [(sp.encode(t or ""), len(sp.encode(t or "")), t or "") for t in texts]
    a = sp.encode("a b")
    given = spark.createDataFrame([(0, None), (1, []), (2, [a[0], None, *a[1:]])], "k long, ids array<int>")
    assert [r["decoded"] for r in sentencepiece_codec.decode(given).orderBy("k").collect()] == ["", "", "a b"]


def test_unigram_viterbi():
    v = sentencepiece_codec.Vocabulary(kind="unigram")
    for word, ids in v.encode_words({"▁the", "▁then", "▁there", "▁abc☃"}):
        n, best = len(word), {0: 0.0}
        for end in range(1, n + 1):
            best[end] = max(best[s] + v.scores.get(word[s:end], v.lowest if end - s == 1 else -math.inf) for s in range(end))
        pieces = np.frombuffer(ids, "<i4").tolist()
        back = {i: p for p, i in v.ids.items()}
        assert math.isclose(sum(v.scores[back[i]] if i in back else v.lowest / 3 for i in pieces), best[n])


def test_licence(docs):
    for r in license_scan.scan_licences(docs).collect():
        if r["doc_id"] is None:
            continue
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(TEXTS[r["doc_id"]] or ""))
        places = [(i, label) for p, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places)) and r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert r["first_word"] == min((i for i, _ in places), default=None) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["labels"] != "") == (r["score"] > 0)


def test_licence_method():
    index = license_scan.TemplateIndex.build(dict.fromkeys(license_scan.VOCABULARY, 1.0))
    for text, want in (("This work is licensed under the GNU General Public License, version 3.", {"gpl-3"}), ("gnu of the license public version", set()), ("", set())):
        words = license_scan.words_of(text.encode())
        assert set(index.labels(words, b" " + b" ".join(words) + b" ")) == want


def plain_licences(index, words):
    """Labels with their score: every template at every relative position."""
    text, best = " " + " ".join(w.decode() for w in words) + " ", {}
    for k, (label, notice, phrases) in enumerate(license_scan.TEMPLATES):
        if not any(f" {p} " in text for p in phrases):
            continue
        own = [w.encode() for w in notice.split()]
        met = {shift: {i for i, w in enumerate(own) if 0 <= i + shift < len(words) and words[i + shift] == w} for shift in range(-len(own) - 2, len(words) + 3)}
        for shift in range(-len(own), len(words) + 1):
            near = set().union(*(met[shift + d] for d in range(-2, 3)))
            share = sum(index.idf[own[i]] for i in near) / sum(index.idf[w] for w in own)
            if met[shift] and len(near) >= 2 and share >= 0.5:
                best[label] = max(best.get(label, 0.0), min(1.0, share))
    return best


def test_licence_labels_and_score(spark):
    """All documents of a table, and notices with words changed, left out and put in, against the plain scan."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    r, changed = random.Random(9), []
    for _, notice, _ in license_scan.TEMPLATES * 3:
        words = notice.split()
        for _ in range(r.randrange(4)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(2)] = [r.choice(WORDS)] * r.randrange(2)
        changed.append(f"{prose(r.randrange(9))} {' '.join(words)} {prose(r.randrange(9))}")
    table = table.union(spark.createDataFrame([(100_000 + i, t) for i, t in enumerate(changed)], table.schema))
    index = license_scan.TemplateIndex.build(license_scan.licence_idf(table))
    texts, labelled = {d["doc_id"]: d["text"] or "" for d in table.collect()}, 0
    for row in license_scan.scan_licences(table).collect():
        want = plain_licences(index, license_scan.words_of(texts[row["doc_id"]].encode()))
        base = set(filter(None, row["base_labels"].split(",")))
        assert set(filter(None, row["labels"].split(","))) == base | set(want)
        assert math.isclose(row["score"], 1.0 if base else max(want.values(), default=0.0))
        labelled += bool(want)
    assert labelled > 30


def test_licence_pairs():
    """Two notices in one text, in either order: both labels."""
    index = license_scan.TemplateIndex.build({w: random.Random(w).uniform(0.01, 9) for w in license_scan.VOCABULARY})
    for (a, first, _), (b, second, _) in itertools.permutations(license_scan.TEMPLATES, 2):
        words = f"{prose(5)} {first} {prose(12)} {second}".encode().split()
        assert {a, b} <= set(index.labels(words, b" " + b" ".join(words) + b" "))


def test_licence_of_many_notices():
    """A text with all notices has all labels, at their full score, whatever the weights."""
    for seed in range(4):
        index = license_scan.TemplateIndex.build({w: random.Random(f"{seed} {w}").uniform(0.01, 9) if seed else 1.0 for w in license_scan.VOCABULARY})
        words = f" {prose(40)} ".join(t for _, t, _ in license_scan.TEMPLATES).encode().split()
        assert index.labels(words, b" " + b" ".join(words) + b" ") == dict.fromkeys((label for label, _, _ in license_scan.TEMPLATES), pytest.approx(1.0))


def test_lm(docs):
    rows = plain(docs)
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    tokens = lambda t: [*split(lower(t)), None]
    counts = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    total, trie = sum(counts.values()), lm_score.AdaptiveTrie()
    for d, t in rows:
        if not held(d):
            b = b"\0\0\0" + t.encode()
            for i in range(3, len(b)):
                trie.learn(b[i - 3 : i], b[i])
    want = {}
    for d, t in rows:
        ts = tokens(t)
        want[(d, len(ts))] = (held(d), sum(counts[w] > 0 for w in ts), sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in ts), trie.score(t.encode()))
    got = lm_score.score_corpus(docs, chunk_bytes=2000).collect()
    assert len(got) == len(rows)
    for r in got:
        h, known, base, score = want[(r["doc_id"], r["n_tokens"])]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (h, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r["score"], score, rel_tol=1e-9, abs_tol=1e-6)


def test_trie_is_a_distribution():
    trie = lm_score.AdaptiveTrie()
    assert trie.score(b"abracadabra", learn=True) < 0
    for context in (b"abr", b"\0\0a", b"zzz", b"xra"):
        assert math.isclose(sum(10 ** trie.log10(context, s) for s in range(256)), 1.0)


def test_substrings(docs):
    seen, want = {}, {}
    rows = sorted(((d if d is not None else substring_dedup.LAST, t) for d, t in plain(docs)), key=lambda x: x[0])
    for d, t in rows:
        words = split(t)
        for s in range(len(words) - 19):
            seen.setdefault(tuple(words[s : s + 20]), (d, s))
    for d, t in rows:
        words = split(t)
        cover = [False] * len(words)
        for s in range(len(words) - 19):
            if seen[tuple(words[s : s + 20])] < (d, s):
                cover[s : s + 20] = [True] * 20
        kept = " ".join(w for w, c in zip(words, cover, strict=True) if not c)
        want[(d, len(words))] = (sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    for size in (1500, substring_dedup.CHUNK_BYTES):
        got = substring_dedup.remove_repeats(docs, chunk_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            key = (substring_dedup.LAST if r["doc_id"] is None else r["doc_id"], r["n_words"])
            assert (r["n_removed"], r["kept_sha256"]) == want[key] and r["n_removed"] == sum(x["n_words"] for x in r["repeats"])


def test_urls(spark):
    urls = [
        (1, "http://WWW.Example.com/en/7198", "block", "x"), (2, "https://a.com/en/1?x", None, None), (3, None, None, None), (4, "no scheme", None, None), (5, "http://com/en/", None, None), (6, "http://xcom/en/", None, None),
        (7, "http://b.net/de/8", None, None), (8, "http://m.x.net/fr/2?ref=q", None, None), (9, "http://x.net/fr/2.html#t", None, None), (9, "http://x.net/fr/2.html#t", None, None), (None, "http://x.net/fr/3", None, None), (11, "", None, None),
    ]
    pages = spark.createDataFrame(urls, "page_id long, url string, verdict string, key string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("q.com", None, "block")], "host string, path string, verdict string")
    got = as_set(url_filter.judge_urls(pages, rules, url_filter.tracked(pages)), "page_id", "host", "path", "rule", "verdict")
    want = [
        (1, "www.example.com", "/en/7198", "example.com/en/7", "allow"), (2, "a.com", "/en/1", "com/en/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "com", "/en/", "com/en/", "block"), (6, "xcom", "/en/", None, "allow"),
        (7, "b.net", "/de/8", "net/de/", "block"), (8, "m.x.net", "/fr/2", None, "block"), (9, "x.net", "/fr/2.html", None, "block"), (9, "x.net", "/fr/2.html", None, "block"), (None, "x.net", "/fr/3", None, "allow"), (11, "", "", None, "allow"),
    ]
    assert got == Counter(want)
    assert url_filter.judge_urls(pages.limit(0), rules, url_filter.tracked(pages)).collect() == []


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) AS key")
    bloom, blocks = url_filter.bloom_filter(keys, 3000)
    assert url_filter.possible_hits(keys, bloom, blocks).count() == 3000
    assert url_filter.possible_hits(spark.range(3000).selectExpr("concat('other', id) AS key"), bloom, blocks).count() < 150


def auc(rows):
    rows = sorted(rows)
    pos = sum(y for _, y in rows)
    return (sum(i for i, (_, y) in enumerate(rows, 1) if y) - pos * (pos + 1) / 2) / max(1, pos * (len(rows) - pos))


@pytest.mark.parametrize("target", ["toxic", "quality"])
def test_classifiers_held_out(spark, target):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)) if target == "toxic" else quality.score_quality(docs, quality.fit_quality(docs, labels))
    rows = scored.join(labels, "doc_id").select("held_out", "score", target, "predicted").collect()
    assert scored.count() == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert auc([(r["score"], r[target]) for r in rows if r["held_out"]]) > 0.75


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int("Idiot" in (t or ""))) for i, t in enumerate(TEXTS)] + [(None, 1, 1), (4, None, None), (5, 1, 0), (5, 0, 1), (10_000, 1, 1)]
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, quality int, toxic int, text string, score double")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_classifier_rows(spark, docs, labels, kind):
    """Null, empty and very long texts, null and repeated ids, columns with the names of the result: one row each, alike for alike texts."""
    docs = docs.withColumns({"score": docs["n_chars"], "predicted": docs["lang"]})
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)) if kind == "toxic" else quality.score_quality(docs, quality.fit_quality(docs, labels))
    rows = scored.collect()
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"] and Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= (0.5 if kind == "toxic" else 0.3)) and r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is not None}
    empty = [i for i, t in enumerate(TEXTS) if not (t or "").strip(" ")][:2]
    assert by[empty[0]] == by[empty[1]] and by[0] == by[12] and len({r["score"] for r in rows if r["doc_id"] == 3}) == 1


def test_drop_toxic_carries_rows(spark, docs, labels):
    kept = toxicity.drop_toxic(docs, labels)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    assert kept.columns == docs.columns and as_set(kept, "doc_id") == as_set(scored.where("predicted = 0"), "doc_id")


def test_toxicity_of_an_unknown_vocabulary(spark):
    """No word of any lexicon: two stems with many endings, which clean texts have too, but far less often."""
    r, rows = random.Random(21), []
    ends = [a + b for a in ("el", "or", "un", "ik", "as", "to") for b in ("na", "mi", "ru", "ves", "ko")]
    for i in range(1500):
        words, toxic = [r.choice(WORDS) for _ in range(r.randrange(30, 400))], i % 8 == 0
        for _ in range(2 + len(words) // 60 if toxic else r.random() < len(words) / 1500):
            words[r.randrange(len(words))] = r.choice(("zarq", "plom")) + r.choice(ends)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(p for p, y in held if y) >= 0.9 * sum(y for _, y in held) and sum(p for p, y in held if not y) <= 0.03 * len(held)


def test_votes_overrule_wrong_labels(spark):
    """One label of twenty is wrong: the classifier says of those rows what their texts are, and not what they are labelled."""
    r, rows = random.Random(22), []
    insults = [" ".join(r.sample(x.split(), 2)) for x in toxicity.LEXICONS.values() for _ in range(4)]
    for i in range(1500):
        words, toxic = [r.choice(WORDS) for _ in range(r.randrange(30, 200))], i % 6 == 0
        for _ in range(3 + len(words) // 40 if toxic else 0):
            words.insert(r.randrange(len(words)), r.choice(insults))
        rows.append((i, " ".join(words), int(toxic), i % 20 == 7))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, y ^ wrong) for i, _, y, wrong in rows], "doc_id long, toxic int")
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()}
    wrong = [(i, y) for i, _, y, w in rows if w]
    assert len(wrong) == 75 and sum(got[i] == y for i, y in wrong) >= 70
    assert sum(got[i] == y for i, _, y, _ in rows) >= 0.97 * len(rows)


def test_posterior_is_that_of_the_tables():
    """Every pattern, with and without a given label, and with silent voters: Bayes' rule by hand."""
    rng = np.random.default_rng(2)
    model = toxicity.LabelModel(4, prior=0.2, parent=[-1, 0, -1, 2], rate=rng.uniform(0.05, 0.9, (2, 4, 2)), given=np.array([0.03, 0.9]))
    for silent in (0, 0b0100, 0b1001):
        for label in (-1, 0, 1):
            for pattern in range(16):
                joint = []
                for y in (0, 1):
                    p = model.prior if y else 1 - model.prior
                    for v in range(4):
                        if not silent >> v & 1:
                            above = model.parent[v]
                            a = (pattern >> above & 1) if above >= 0 and not silent >> above & 1 else 0
                            p *= model.rate[y, v, a] if pattern >> v & 1 else 1 - model.rate[y, v, a]
                    p *= 1 if label < 0 else model.given[y] if label else 1 - model.given[y]
                    joint.append(p)
                got = model.posterior(np.array([pattern]), np.array([label]), np.array([silent]))[0]
                assert math.isclose(got, joint[1] / sum(joint), rel_tol=1e-9)


def test_quality_inputs_are_compressed_sizes():
    """The inputs of the calibration from fresh compressors, with a trained dictionary and with raw text as one."""
    zstandard = __import__("zstandard")
    texts = [prose(60).encode() for _ in range(400)]
    trained, raw = quality._dictionary(texts), quality._dictionary([b"one short text"])
    assert trained[:4] == b"\x37\xa4\x30\xec" and raw == b"one short text" and quality._dictionary([]) == b"no text to learn from "
    model = quality.QualityModel(trained, raw, [0.1, 0.2, 0.3, 0.4])
    for text in (b"", b"a", texts[0], b" ".join(texts)):
        sizes = []
        for d in (trained, raw):
            c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(text[i : i + 2048])) for i in range(0, len(text), 2048)))
        if text:
            assert model.sizes(text) == tuple(sizes) and math.isclose(model.inputs(text)[0], 20 * (sizes[1] - sizes[0]) / len(text))
        assert 0 < model.score(text) < 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.02) for _ in range(5)], axis=1)
    votes = np.column_stack([votes, votes[:, 0]])  # a copy of a voter: correlated given the label
    patterns = (votes.astype(int) << np.arange(6)).sum(axis=1)
    values, counts = np.unique(patterns, return_counts=True)
    model = toxicity.LabelModel(6).fit(values, np.full(len(values), -1), counts.astype(float))
    p = dict(zip(values.tolist(), model.posterior(values).tolist(), strict=True))
    assert np.mean([(p[x] > 0.5) == t for x, t in zip(patterns.tolist(), y, strict=True)]) > 0.97 and model.parent[5] == 0
