"""run() against plain versions of its stages on the smallest table."""

import random
import re

import corpus_pipeline
from tidewater.llm import toxicity
from tidewater.llm.common import table

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_run(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, SF, "labels")))
    left = sorted(r["doc_id"] for r in scored.collect() if not r["predicted"])
    seen = {}
    for d in left:
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
    left = sorted(seen.values())
    # near copies: words five by five, similarity 0.8 or more, all pairs
    sets, group = {d: shingles(texts[d]) for d in left}, {d: d for d in left}
    pairs = [(a, b) for a in left for b in left if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if group[a] != group[b]:
                group[a] = group[b] = min(group[a], group[b])
                changed = True
    left = [d for d in left if group[d] == d]
    items = [r["text"].lower().split() for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    dirty = {d for d in left if any(tuple(w[i : i + 13]) in grams for w in [texts[d].lower().split()] for i in range(len(w) - 12))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == [d for d in left if d not in dirty]
    assert all(r["round_trip"] for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5


def test_run_on_odd_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, ties, columns of clashing names; and empty tables."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    long, passage = prose(30_000), prose(40)
    texts = [(None, None), (None, "alone"), (1, ""), (2, "  "), (3, long), (4, long + " end"), (5, passage), (6, prose(50)), (6, prose(50)), (7, "twice"), (7, "twice"), (9, "x " + passage + " y"), (10, prose(80))]
    rows = [(i, t, "en", "s", len(t or ""), 1, "k", True) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark int, key string, kept boolean"
    labels = [(i, 1, i % 2) for i in range(4)]
    for name, docs, given, bench in (("odd", rows, labels, [(1, passage), (2, None), (3, "")]), ("empty", [], [], [])):
        d = f"file://{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(given, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        got, stage = corpus_pipeline.run(spark, d), table(spark, d, "documents")
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, d)
            assert stage.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").replace(" boolean", "").split(", ")
        if docs:
            assert sorted(x["doc_id"] or 0 for x in got.collect()) == [0, 1, 3, 6, 6, 7, 10] and all(x["round_trip"] for x in got.collect())
        else:
            assert got.collect() == []
