"""Bars and ticks, in batch form: every operator has a streaming twin with the same result."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Short and long names of a bar's fields, with defaults.
BAR_REQUIRED = ["o", "c", "h", "l", "v", "t", "s"]
BAR_FIELDS = [
    ("d", "data_source", "string", None), ("p", "provider", "string", "Finazon"), ("ch", "channel", "string", "bars"), ("f", "frequency", "string", "1s"), ("aggr", "aggregation", "string", "1m"),
    ("s", "symbol", "string", None), ("t", "timestamp", "bigint", None), ("o", "open_price", "double", None), ("c", "close_price", "double", None), ("h", "high_price", "double", None),
    ("l", "low_price", "double", None), ("v", "volume", "bigint", None),
]


def complete_bar(message: Column) -> Column:
    """Whether a bar's JSON text has all required keys; a key that is there with null counts."""
    keys = F.json_object_keys(message)
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, BAR_REQUIRED)), keys)) == 0, F.lit(False))


def parse_bars(df: DataFrame, message: str = "value") -> DataFrame:
    """Complete bar messages with long field names and defaults; other columns stay."""
    schema = ", ".join(f"{short} {kind}" for short, _, kind, _ in BAR_FIELDS)
    rows = df.where(complete_bar(F.col(message))).withColumn("_bar", F.from_json(message, schema))
    fields = [(F.coalesce(f"_bar.{short}", F.lit(default)) if default else F.col(f"_bar.{short}")).alias(name) for short, name, _, default in BAR_FIELDS]
    return rows.select(*(c for c in df.columns if c != message), *fields)


def to_message(df: DataFrame, *fields: str) -> DataFrame:
    """Fields as one JSON message, as a topic takes it."""
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def bars_to_ticks(bars: DataFrame, n: int = 90, span_ms: int = 1000) -> DataFrame:
    """n ticks from each bar, from its open towards its close, which is never reached; prices rounded to five places."""
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    rows = bars.select("symbol", "timestamp", "open_price", "close_price", i)
    price = F.round(F.col("open_price") + F.col("i") * (F.col("close_price") - F.col("open_price")) / n, 5)
    return rows.select("symbol", (F.col("timestamp") + F.col("i") * (span_ms // n)).alias("timestamp"), price.alias("price"))


def parse_ticks(df: DataFrame, strict: bool = True, message: str = "value") -> DataFrame:
    """Tick messages with a price that isn't negative; no symbol reads as unknown.

    strict drops a price that is no number. Else such text, and JSON null, read as 0 and pass, as a lenient JSON
    reader has it. Text that is no JSON, and a missing price, are dropped either way.
    """
    doc = F.try_parse_json(F.col(message))
    price = F.try_variant_get(doc, "$.price", "double")
    has = F.coalesce(F.array_contains(F.json_object_keys(message), "price"), F.lit(False))
    price = F.when(has, price if strict else F.coalesce(price, F.lit(0.0)))
    rows = df.withColumns({"symbol": keyed(F.try_variant_get(doc, "$.symbol", "string")), "timestamp": F.try_variant_get(doc, "$.timestamp", "bigint"), "price": price})
    return valid_ticks(rows.drop(message))


def valid_ticks(df: DataFrame) -> DataFrame:
    return df.where(F.col("price") >= 0)


def keyed(symbol: Column) -> Column:
    """A bar or tick that says no symbol belongs to unknown."""
    return F.coalesce(symbol, F.lit("unknown"))


def from_source() -> Column:
    """data_source of a bar; one that says none is of an unknown one."""
    return keyed(F.col("data_source")).alias("data_source")


def with_latency(df: DataFrame, now: Column | None = None) -> DataFrame:
    """latency_ms: how long ago a tick's timestamp (ms) was, never below 0; a missing one counts from 1970."""
    end = F.unix_millis(F.current_timestamp() if now is None else now)
    return df.withColumn("latency_ms", F.greatest(F.lit(0).cast("long"), end - F.coalesce("timestamp", F.lit(0))))


def tick_volume(volume: Column, ts: Column, before: Column, before_ts: Column) -> Column:
    """Volume of one bar from cumulative volume: the increase if time went on, else (a reset, or a time that did not) all of it."""
    return F.when((volume >= before) & (ts > before_ts), volume - before).otherwise(volume)


def per_tick_volume(bars: DataFrame, order: list[str], ts: str = "timestamp", volume: str = "volume", every: int = 86_400_000) -> DataFrame:
    """bars with per_tick_volume, by symbol in the order of arrival; rows without a volume or time are dropped, and no symbol is a symbol too.

    The row before is looked for inside a bucket of every units of the first column of order; the last row of each bucket, a small
    table, carries over to the next, so that a symbol with most of the rows is spread over its buckets. Their width changes no result. The rows
    cross the network once; for the bucket ends, four columns are read again and combined before their shuffle, so bars that are costly to make
    are better stored first. Keys are never null, so that the join needs no keys of its own.
    """
    key = ["_symbol", "_none", "_bucket"]
    rows = bars.where(F.col(ts).isNotNull() & F.col(volume).isNotNull())
    rows = rows.withColumns({"_symbol": F.coalesce(F.col("symbol"), F.lit("")), "_none": F.col("symbol").isNull(), "_bucket": F.coalesce(F.floor(F.col(order[0]) / every), F.lit(-(1 << 62)))})
    last = F.max_by(F.struct(F.col(volume).alias("volume"), F.col(ts).alias("ts")), F.struct(*order)).alias("_last")
    ends = rows.groupBy(*key).agg(last)
    before = F.lag("_last").over(Window.partitionBy("_symbol", "_none").orderBy("_bucket"))
    carried = ends.select(*key, before.alias("_carried")).select(*key, F.col("_carried.volume").alias("_cv"), F.col("_carried.ts").alias("_ct"))
    w = Window.partitionBy(*key).orderBy(*order)
    rows = rows.withColumns({"_v": F.lag(volume).over(w), "_t": F.lag(ts).over(w)}).join(carried, key, "left")
    made = tick_volume(F.col(volume), F.col(ts), F.coalesce("_v", "_cv", F.lit(0)), F.coalesce("_t", "_ct", F.lit(0)))
    return rows.select(*bars.columns, made.alias("per_tick_volume"))


def last_bars(bars: DataFrame, order: list[str], ts: str = "timestamp", volume: str = "volume") -> DataFrame:
    """symbol, volume and timestamp of each symbol's last bar in the order of arrival: where per-bar volume goes on from."""
    rows = bars.where(F.col(ts).isNotNull() & F.col(volume).isNotNull())
    last = F.max_by(F.struct(F.col(volume).alias("volume"), F.col(ts).alias("timestamp")), F.struct(*order)).alias("last")
    return rows.groupBy("symbol").agg(last).select("symbol", "last.*")


def interval_join(left: DataFrame, right: DataFrame | None, width_ms: int = 1000, ts: str = "timestamp", on: str = "symbol", span: int = 16, parts: int | None = None) -> DataFrame:
    """All pairs of left and right rows of one symbol at most width_ms apart (both ends count). Without right, left meets itself, each row itself as well.

    Rows cross the network once, dealt by symbol and span of buckets of that width, so a symbol with most of the rows is spread over its spans; only
    rows at the ends of a span go to two. In a span a left row collects what lies in its range of time: a task sorts each row once, and holds the pairs
    of one row at a time. parts is the number of tasks. Common columns of the right side get the prefix right_.
    """
    bucket, in_span = F.floor(F.col(ts) / width_ms), lambda c: F.floor(c / span)
    spans = F.explode(F.sequence(in_span(bucket - 1), in_span(bucket + 1))).alias("_span")
    known = lambda df: df.where(F.col(on).isNotNull() & F.col(ts).isNotNull())
    named = lambda df: [F.col(c).alias(f"right_{c}" if c in left.columns else c) for c in df.columns if c != on]
    more = [c for c in left.columns if c not in (on, ts)]
    if right is None:
        rows = known(left).select("*", spans)
        mine, theirs = in_span(bucket) == F.col("_span"), F.struct(*named(left))
    else:
        rows = known(left).select(on, ts, F.struct(*more, F.lit(True).alias("_")).alias("_left"), in_span(bucket).alias("_span"))
        rows = rows.unionByName(known(right).select(on, ts, F.struct(*named(right)).alias("_right"), spans), allowMissingColumns=True)
        mine, theirs = F.col("_left").isNotNull(), F.col("_right")
    near = Window.partitionBy(on, "_span").orderBy(ts).rangeBetween(-width_ms, width_ms)
    rows = rows.repartition(*([] if parts is None else [parts]), on, "_span").withColumn("_met", F.collect_list(theirs).over(near)).where(mine)
    rows = rows.select(on, ts, *([] if right is None else ["_left"]), *(more if right is None else []), F.explode("_met").alias("_met"))
    return rows.select(*(c if right is None or c in (on, ts) else F.col(f"_left.{c}") for c in left.columns), "_met.*")


def vwap(pairs: DataFrame, window_ms: int = 60_000, ts: str = "ts", price: str = "price", volume: str = "volume") -> DataFrame:
    """Volume-weighted mean price by symbol and tumbling window of the pair's time; 0 where the volumes add up to 0 or less.

    data_source, where the pairs have it, is that of the window's last pair (of equally late ones, the last in text order).
    """
    end = ((F.floor(F.col(ts) / window_ms) + 1) * window_ms).alias("window_end")
    return pairs.groupBy("symbol", end).agg(*vwap_columns(pairs, ts, price, volume))


def vwap_columns(pairs: DataFrame, ts: str = "ts", price: str = "price", volume: str = "volume") -> list[Column]:
    """Aggregates of one window of pairs, or of the sums of pairs that pair_sums gives, in batch and stream alike."""
    total, summed = F.sum(volume), "weighted" in pairs.columns
    weighted = F.col("weighted") if summed else F.round(price, 6) * F.col(volume)
    value = F.round(F.when(total > 0, F.sum(weighted) / total).otherwise(0.0), 6)
    source = [F.max(F.struct(ts, "data_source"))["data_source"].alias("data_source")] if "data_source" in pairs.columns else []
    return [value.alias("vwap"), (F.sum("n_pairs") if summed else F.count("*")).alias("n_pairs"), *source]


def pair_sums(ticks: DataFrame, volumes: DataFrame, width_ms: int = 1000, ts: str = "timestamp", price: str = "price", volume: str = "volume", span: int = 16) -> DataFrame:
    """What interval_join's pairs add up to, without a pair being made: for each symbol and ts that is the later time of some pairs, the sums
    of round(price, 6) * volume (weighted) and of volume over these pairs, n_pairs, and their largest data_source where the volumes have it.

    A row belongs to its own time bucket of that width and to the next. What a time pairs with is, of its own bucket, all up to it, and, of
    the bucket before, all from it less the width on: sums from both ends of a bucket, so work and memory grow with the rows, however dense they
    are, and nothing is subtracted. Rows are shuffled once, by span buckets at a time: only those of a span's last bucket go to two spans, and
    a task adds up rows of equal time before it copies them to two buckets.
    """
    bucket, in_span = F.floor(F.col("ts") / width_ms), lambda c: F.floor(c / span)
    rows = _tick_rows(ticks, ts, price).unionByName(_bar_rows(volumes, ts, volume), allowMissingColumns=True).where("symbol IS NOT NULL AND ts IS NOT NULL")
    rows = rows.withColumn("span", F.explode(F.sequence(in_span(bucket), in_span(bucket + 1))))
    return _span_sums(rows.repartition("symbol", "span"), width_ms, span)


def _tick_rows(ticks: DataFrame, ts: str, price: str) -> DataFrame:
    return ticks.select("symbol", F.col(ts).alias("ts"), F.round(price, 6).cast("double").alias("p"), F.lit(None).cast("long").alias("v"), F.lit(True).alias("tick"), F.lit(False).alias("bar"))


def _bar_rows(bars: DataFrame, ts: str, volume: str, *more: str) -> DataFrame:
    source = [F.col("data_source")] if "data_source" in bars.columns else []
    return bars.select("symbol", F.col(ts).alias("ts"), F.lit(None).cast("double").alias("p"), F.col(volume).alias("v"), *source, F.lit(False).alias("tick"), F.lit(True).alias("bar"), *more)


def _span_sums(rows: DataFrame, width_ms: int, span: int) -> DataFrame:
    """pair_sums of ticks and bars that lie dealt by symbol and span.

    What a time meets of its own bucket is summed in the order that adding up equal times leaves, so only sums from the other end of a
    bucket sort again; there, what a time has lies in one column, which the copy that its next bucket gets leaves empty.
    """
    has_source, first = "data_source" in rows.columns, Window.unboundedPreceding
    bucket, in_span = F.floor(F.col("ts") / width_ms), lambda c: F.floor(c / span)
    sums = [F.sum("p").alias("p"), F.count_if("tick").alias("t"), F.sum("v").alias("v"), F.count_if("bar").alias("b"), *([F.max("data_source").alias("s")] if has_source else [])]
    rows = rows.groupBy("symbol", "span", bucket.alias("bucket"), "ts").agg(*sums)
    w = Window.partitionBy("symbol", "span", "bucket")
    up, below, down = w.orderBy("ts").rangeBetween(first, 0), w.orderBy("ts").rangeBetween(first, -1), w.orderBy(F.desc("at")).rangeBetween(first, 0)
    of = [("v", up, F.sum), ("b", up, F.sum), ("p", below, F.sum), ("t", below, F.sum), *([("s", up, F.max)] if has_source else [])]
    names = [n for n, _, _ in of]
    rows = rows.withColumns({f"_{n}0": add(n).over(over) for n, over, add in of}).withColumn("moved", F.explode(F.array(F.lit(0), F.lit(1))))
    here = F.col("moved") == 0
    own = F.when(here, F.struct(*names, *(f"_{n}0" for n in names))).alias("own")
    rows = rows.select("symbol", "span", (F.col("bucket") + F.col("moved")).alias("bucket"), (F.col("ts") + F.col("moved") * width_ms).alias("at"), own, *(F.when(~here, F.col(n)).alias(n) for n in names))
    rows = rows.where(in_span(F.col("bucket")) == F.col("span")).withColumns({f"_{n}1": add(n).over(down) for n, _, add in of}).where("own IS NOT NULL")
    rows = rows.select("symbol", F.col("at").alias("ts"), "own.*", *(f"_{n}1" for n in names))
    either = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b))
    # ticks meet the bars up to their time, bars the ticks before it
    met = {n: either(F.col(f"_{n}0"), F.col(f"_{n}1")) for n in "vbpt"}
    n_pairs = lambda mine, theirs: F.col(mine) * F.coalesce(met[theirs], F.lit(0))
    out = rows.select(
        "symbol", "ts", either(F.col("p") * met["v"], F.col("v") * met["p"]).alias("weighted"), either(F.when(F.col("t") > 0, F.col("t") * met["v"]), F.col("v") * met["t"]).alias("volume"),
        (n_pairs("t", "b") + n_pairs("b", "t")).alias("n_pairs"),
        *([F.greatest(F.when(F.col("t") > 0, F.greatest("_s0", "_s1")), F.when(n_pairs("b", "t") > 0, F.col("s"))).alias("data_source")] if has_source else []),
    )
    return out.where("n_pairs > 0")


def tick_bar_sums(ticks: DataFrame | None, bars: DataFrame, width_ms: int = 1000, order: tuple[str, ...] = ("timestamp",), span: int | None = None) -> DataFrame:
    """pair_sums of ticks and of the per-bar volume of bars, which have a cumulative volume. Without ticks, each row of bars is a tick as well,
    of its price, whether it has a volume or not: such a row crosses the network once for both.

    Where bars come in the order of their times, ticks and bars cross the network once, by symbol and span of buckets, and a bar's volume is made
    where its pairs are summed. A task has the bars of its span and of the bucket before; the last bar before those comes along as a row of its
    own, from a small table of the last bars of spans. bars are read twice, for that table with the same columns, so that a shuffle which made
    them is made once. A span has eight hours where buckets are not longer.
    """
    symbol, price = keyed(F.col("symbol")).alias("symbol"), ["price"] if ticks is None else []
    source = [from_source()] if "data_source" in bars.columns else []
    if order[0] != "timestamp":
        ticks = (bars if ticks is None else ticks).select(symbol, "timestamp", "price")
        volumes = per_tick_volume(bars.withColumn("symbol", symbol), list(order)).select("symbol", "timestamp", F.col("per_tick_volume").alias("volume"), *source)
        return pair_sums(ticks, volumes, width_ms)
    span = span or max(16, 28_800_000 // width_ms)
    in_span, bucket = lambda c: F.floor(c / span), F.floor(F.col("ts") / width_ms)
    ties = [f"_{c}" for c in order[1:]]
    rows = bars.where("timestamp IS NOT NULL").select(symbol, "timestamp", "volume", *price, *source, *(F.col(c).alias(f"_{c}") for c in order[1:]))
    rows = _bar_rows(rows, "timestamp", "volume", *ties, *price)
    if ticks is None:
        bar = F.col("v").isNotNull()
        rows = rows.withColumns({"p": F.round("price", 6).cast("double"), "tick": F.lit(True), "bar": bar, **({"data_source": F.when(bar, F.col("data_source"))} if source else {})}).drop("price")
    else:
        rows = rows.where("v IS NOT NULL")
    # a run of bars is those that enter span run together; of these, the ones of the bucket before it are in span run - 1 as well
    run = in_span(bucket + 1)
    last = rows.where("bar").groupBy("symbol", run.alias("run")).agg(F.max_by(F.struct("ts", "v", *(["data_source"] if source else [])), F.struct("ts", *ties)).alias("last"))
    before = last.select("symbol", "run", F.lag("last").over(Window.partitionBy("symbol").orderBy("run")).alias("last")).where("last IS NOT NULL")
    before = before.select("symbol", "run", F.explode(F.array(F.col("run") - 1, F.col("run"))).alias("span"), F.col("last.ts").alias("ts"), F.col("last.v").alias("v"), F.lit(False).alias("tick"), F.lit(True).alias("bar"))
    if ticks is not None:
        rows = rows.unionByName(_tick_rows(ticks.select(symbol, "timestamp", "price"), "timestamp", "price").where("ts IS NOT NULL"), allowMissingColumns=True)
    rows = rows.withColumn("span", F.explode(F.sequence(in_span(bucket), in_span(bucket + 1))))
    # only bars before a run say which it is: others have it by their time
    rows = rows.unionByName(before, allowMissingColumns=True).repartition("symbol", "span").withColumns({"before": F.col("run").isNotNull(), "run": F.coalesce("run", run)})
    w = Window.partitionBy("symbol", "span", "run", "bar").orderBy(F.desc("before"), "ts", *ties)
    made = tick_volume(F.col("v"), F.col("ts"), F.coalesce("_v", F.lit(0)), F.coalesce("_t", F.lit(0)))
    rows = rows.withColumns({"_v": F.lag("v").over(w), "_t": F.lag("ts").over(w)}).where("NOT before")
    rows = rows.select("symbol", "span", "ts", "p", F.when(F.col("bar"), made).alias("v"), "tick", "bar", *(["data_source"] if source else []))
    return _span_sums(rows, width_ms, span)


def tick_bar_vwap(ticks: DataFrame | None, bars: DataFrame, width_ms: int = 1000, window_ms: int = 60_000, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    """The whole flow: per-bar volume, interval join, mean by window of the later of both times; the bars' data_source is carried. The pairs
    of the join are summed where they meet (tick_bar_sums), as there is no bound on how many a dense symbol has. Without ticks, bars have a price
    and are ticks too.

    Bars and ticks without a symbol are those of the symbol unknown, which counts its volume as any other does; no data_source is the source unknown.
    """
    return vwap(tick_bar_sums(ticks, bars, width_ms, order), window_ms)
