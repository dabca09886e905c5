"""Files of bounded size in the order of arrival: the stateful streams' input."""

from tidewater.plans import flows, registry
from tidewater.sources.scratch import shared_dir

SCHEMA = "event_id long, symbol string, timestamp long, volume long"


def test_files_in_order(spark):
    """Each part one file, all rows in one of them, those without an id in the last; a stream takes them one by one in the order of arrival."""
    path, rows = shared_dir(spark), [(i * 3, "A", i, i) for i in range(100)] + [(None, "A", 1, 1), (-5, "A", 1, 1)]
    n = flows.land_in_order(spark.createDataFrame(rows, SCHEMA).repartition(5), f"{path}/landed", 20, 3)
    assert n == 6
    taken = []
    for run in (range(4), range(4, 6)):
        flows.publish_files(spark, f"{path}/landed", f"{path}/in", run)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        flows.to_end(stream.writeStream.foreachBatch(lambda b, i: taken.append([r[0] for r in b.collect()])).option("checkpointLocation", f"{path}/c"))
    assert max(map(len, taken)) <= 20 and sum(map(len, taken)) == 102 and sum(t.count(None) for t in taken) == 1 and None in taken[-1]
    ends = [(min(x for x in t if x is not None), max(x for x in t if x is not None)) for t in taken]
    assert ends == sorted(ends) and all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_bars_are_made_once(spark, monkeypatch):
    """However many micro-batches there are, the table is read by one job for its bars, and none looks for its part among all rows."""
    reads, bars = [], registry.S.bars
    monkeypatch.setattr(registry, "BATCH_ROWS", 200)
    monkeypatch.setattr(registry.S, "bars", lambda s, d: reads.append(d) or bars(s, d))
    monkeypatch.setattr(registry.flows, "by_arrival", None)
    got = registry.t10_restart(spark, "/root/testdata/sf0.001")
    assert len(reads) == 1 and got.count() == 1000


def test_files_share_micro_batches(spark, monkeypatch):
    """A micro-batch takes several files in the order of arrival, never more than its bound; volumes are those of the batch form."""
    taken = []

    def run(writer):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        taken.append([p.numInputRows for p in query.recentProgress if p.numInputRows])

    monkeypatch.setattr(registry, "BATCH_ROWS", 20)
    monkeypatch.setattr(registry, "_to_end", run)
    got = registry.t10_restart(spark, "/root/testdata/sf0.001")
    bars = registry.S.bars(spark, "/root/testdata/sf0.001")
    want = registry.market.per_tick_volume(bars, ["event_id"], every=100).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len(taken) == 3 and sum(map(sum, taken)) == 1000
    assert max(map(len, taken)) == 1 and max(map(max, taken)) <= 20 * registry.BATCH_FILES


def test_micro_batches_of_one_run(spark, monkeypatch):
    """The state goes on from one micro-batch of several files to the next; how many there are follows from their bound."""
    taken = []

    def run(writer):
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        taken.extend(p.numInputRows for p in query.recentProgress if p.numInputRows)

    monkeypatch.setattr(registry, "BATCH_ROWS", 20)
    monkeypatch.setattr(registry, "_to_end", run)
    got = registry.t3_stream(spark, "/root/testdata/sf0.001")
    want = registry.market.per_tick_volume(registry.S.bars(spark, "/root/testdata/sf0.001"), ["event_id"], every=100).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(taken) == 1000 and len(taken) == -(-50 // registry.BATCH_FILES) and max(taken) <= 20 * registry.BATCH_FILES
