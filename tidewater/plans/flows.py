"""Registered queries over several batches: what arrives in rounds, comes again, comes late, or is run again after a crash; and their SQL."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewater.operators import articles, enrich, market, media_items, posts, summaries
from tidewater.plans import standins as S
from tidewater.sources import envelope, files, intake, objects, points, sinks
from tidewater.sources.scratch import shared_dir, stored
from tidewater.streaming import late, market_stream

E, N = S.EVENTS_SQL, S.NEWS_SQL
TICK = "event_id long, symbol string, timestamp long, price double"
BAR = "event_id long, symbol string, timestamp long, volume long"
POINT = "symbol string, timestamp long, event_id long, price double"
HOUR_MS = 3_600_000


def to_end(writer: DataStreamWriter) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def forget_last_commit(spark: SparkSession, checkpoint: str) -> None:
    """As after a crash between a batch's write and its commit: the next run does that batch again."""
    fs, at = points.filesystem(spark, f"{checkpoint}/commits")
    last = max(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdecimal())
    fs.delete(points.filesystem(spark, f"{checkpoint}/commits/{last}")[1], False)
    fs.delete(points.filesystem(spark, f"{checkpoint}/commits/.{last}.crc")[1], False)


def in_rounds(spark: SparkSession, parts: list[DataFrame], path: str, schema: str, sink: Callable[[DataFrame], DataStreamWriter], again: bool = True) -> None:
    """Parts arrive one after another, each taken in by a new run of the same query; at last the last batch is run again, if so asked."""
    for part in parts:
        part.write.mode("append").parquet(f"{path}/in")
        to_end(sink(spark.readStream.schema(schema).parquet(f"{path}/in")))
    if again:
        forget_last_commit(spark, f"{path}/state")
        to_end(sink(spark.readStream.schema(schema).parquet(f"{path}/in")))


def by_arrival(rows: DataFrame, parts: int) -> list[DataFrame]:
    """Rows in the order of their ids, cut into parts."""
    last = rows.agg(F.max("event_id")).first()[0] or 0
    return [rows.where(F.floor(F.col("event_id") * parts / (last + 1)) == i) for i in range(parts)]


def land_in_order(rows: DataFrame, path: str, most: int, least: int = 1) -> int:
    """Rows cut by event_id into parts, in the order of arrival, of about most rows each (least parts at least), each part one file below part=...; returns how many
    parts there are. The rows are made and read once, and no part is looked for among all rows. Rows without an id come last."""
    rows = stored(rows)
    n, last = rows.agg(F.count("*"), F.max("event_id")).first()
    parts = max(least, -(-n // most))
    part = F.greatest(F.lit(0), F.least(F.floor(F.col("event_id") * parts / (max(last or 0, 0) + 1)), F.lit(parts - 1))).cast("int")
    rows.withColumn("part", part).repartition(min(parts, 200), "part").write.partitionBy("part").parquet(path)
    return parts


def publish_files(spark: SparkSession, landed: str, path: str, parts: range) -> None:
    """Moves the file of each of these parts to path, one after another, each newer than the one before: a file source takes them in that order."""
    fs, to = points.filesystem(spark, path)
    fs.mkdirs(to)
    for part in parts:
        folder = points.filesystem(spark, f"{landed}/part={part}")[1]
        if fs.exists(folder):  # ids may leave gaps
            for f in fs.listStatus(folder):
                name = f.getPath().getName()
                fs.setTimes(f.getPath(), 1_000_000_000_000 + part * 1000, -1)
                if not fs.rename(f.getPath(), points.filesystem(spark, f"{path}/{part:08d}-{name}")[1]):
                    raise OSError(f"{name} could not be moved to {path}")


# Points


def k6_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks of ten minutes under one time, in three batches that all have most keys, the last one twice: the last write of a key stays."""
    path, rows = shared_dir(spark), S.ticks(spark, d).withColumn("timestamp", F.floor(F.col("timestamp") / 600_000) * 600_000).select("symbol", "timestamp", "event_id", "price")
    sink = lambda s: points.point_sink(s, f"{path}/out", f"{path}/state", ["symbol", "timestamp"], arrival="event_id", unit="day")
    in_rounds(spark, [rows.where(F.col("event_id") % 3 == i) for i in range(3)], path, POINT, sink)
    return points.read_points(spark, f"{path}/out", POINT).select("symbol", "timestamp", "event_id", "price", "batch")


def k5_vwap(spark: SparkSession, d: str) -> DataFrame:
    """Windowed means that grow from batch to batch: each batch writes the windows that it changes, over what was there."""
    path = shared_dir(spark)
    sums = stored(market.tick_bar_sums(S.ticks(spark, d), S.bars(spark, d), S.WIDTH_MS, ("timestamp", "event_id")).withColumnRenamed("ts", "timestamp"))
    low, high = sums.agg(F.min("timestamp"), F.max("timestamp")).first()
    third = F.floor((F.col("timestamp") - (low or 0)) * 3 / ((high or 0) - (low or 0) + 1))

    def sink(stream: DataFrame) -> DataStreamWriter:
        rows = market_stream.event_time(stream).select("symbol", "ts", "weighted", "volume", "n_pairs", "data_source")
        return points.point_sink(market_stream.vwap_stream(rows, "1 day"), f"{path}/out", f"{path}/state", ["symbol", "window_end"], unit="day").outputMode("update")

    in_rounds(spark, [sums.where(third == i) for i in range(3)], path, "symbol string, timestamp long, weighted double, volume long, n_pairs long, data_source string", sink)
    return points.read_points(spark, f"{path}/out", "symbol string, window_end long, vwap double, n_pairs long, data_source string").drop("batch", "span")


def k7_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Ticks in hour partitions, from which those that have expired are gone: what storage has left."""
    path, rows = shared_dir(spark), S.ticks(spark, d).select("symbol", "timestamp", "event_id", "price")
    for i, part in enumerate(by_arrival(rows, 3)):
        points.merge_points(part, i, path, ["symbol", "event_id"], ts="timestamp")
    points.drop_expired(spark, path, POINT, "timestamp", "2 DAYS")
    return points.read_points(spark, path, POINT).select("event_id", "timestamp", "price", F.col("span").alias("hour"))


def a6_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Running sums and counts by hour over three batches; a tenth of the ticks come a batch late, within the watermark."""
    path, rows = shared_dir(spark), S.ticks(spark, d)
    now = rows.agg(F.max("timestamp")).first()[0] or 0
    rows = market.with_latency(rows, F.timestamp_millis(F.lit(now)))
    sink = lambda s: points.rollup_sink(market_stream.event_time(s, "15 days"), f"{path}/out", f"{path}/state", ["price", "latency_ms"], "1 hour", unit="day")
    in_rounds(spark, delayed(rows, 3), path, TICK + ", latency_ms long", sink)
    rolled = points.read_points(spark, f"{path}/out", "symbol string, bucket_end long, sum_price double, n_price long, sum_latency_ms long, n_latency_ms long")
    wide = points.rollup_means(rolled, ["price", "latency_ms"], every_ms=S.DAY_MS).withColumn("every", F.lit("day"))
    means = points.rollup_means(rolled, ["price", "latency_ms"]).withColumn("every", F.lit("hour")).unionByName(wide)
    return means.select("every", "symbol", "bucket_end", F.round("mean_price", 6).alias("mean_price"), F.round("mean_latency_ms", 3).alias("mean_latency_ms"))


def delayed(rows: DataFrame, parts: int) -> list[DataFrame]:
    """As by_arrival, but every tenth row comes a part later."""
    last = rows.agg(F.max("event_id")).first()[0] or 0
    part = F.least(F.lit(parts - 1), F.floor(F.col("event_id") * parts / (last + 1)) + (F.col("event_id") % 10 == 0).cast("int"))
    return [rows.where(part == i) for i in range(parts)]


# Late rows and state


def t7_exact(spark: SparkSession, d: str) -> DataFrame:
    """Late rows of three batches by batch, symbol and window, windows over all others, and how many rows a listener saw arrive."""
    path, rows = shared_dir(spark), S.ticks(spark, d)
    arrived = late.ObservedCounts("arrived")
    spark.streams.addListener(arrived)
    try:

        def split(stream: DataFrame) -> DataStreamWriter:
            return late.split_late(stream.observe("arrived", F.count("*").alias("n")), f"{path}/split", f"{path}/state", 3000, S.DAY_MS)

        for part in delayed(rows, 3):
            in_rounds(spark, [part], path, TICK, split, again=False)
            ticks = market_stream.event_time(late.on_time(spark, f"{path}/split", TICK))
            means = ticks.groupBy("symbol", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select("symbol", F.unix_millis(F.col("w.end")).alias("window_end"), "n")
            to_end(means.writeStream.format("parquet").option("checkpointLocation", f"{path}/windows-state").option("path", f"{path}/windows"))
        n = arrived.total(spark)
    finally:
        spark.streams.removeListener(arrived)
    end = ((F.floor(F.col("timestamp") / S.DAY_MS) + 1) * S.DAY_MS).alias("window_end")
    dropped = late.split_rows(spark, f"{path}/split", TICK).where("late").groupBy("batch", "symbol", end).agg(F.count("*").alias("n"))
    windows = spark.read.schema("symbol string, window_end long, n long").parquet(f"{path}/windows").withColumn("batch", F.lit(-1).cast("long"))
    return dropped.unionByName(windows).withColumn("n_arrived", F.lit(n).cast("long"))


def t3_backfill(spark: SparkSession, d: str) -> DataFrame:
    """The first half of the bars as a batch; a stream goes on from its last rows, in batches of bounded size."""
    path, key = shared_dir(spark), "spark.sql.streaming.stateStore.providerClass"
    first, *rest = by_arrival(S.bars(spark, d).select("event_id", "symbol", "timestamp", "volume"), 4)
    first = stored(first)
    done = market.per_tick_volume(first, ["event_id"], every=10_000).select("event_id", "symbol", "timestamp", "per_tick_volume")
    state = stored(market.last_bars(first, ["event_id"]))
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:

        def sink(stream: DataFrame) -> DataStreamWriter:
            out = market_stream.per_tick_volume_stream(stream, state).select("event_id", "symbol", "timestamp", "per_tick_volume")
            return out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out")

        in_rounds(spark, rest, path, BAR, sink, again=False)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return done.unionByName(spark.read.schema("event_id long, symbol string, timestamp long, per_tick_volume long").parquet(f"{path}/out"))


def anonymous_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are a tick and a bar each; some say no symbol, some no source."""
    symbol = F.when(F.col("user_id") % 5 > 0, F.col("symbol")).alias("symbol")
    source = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("exchange"), F.col("user_id") % 3)).alias("data_source")
    return S.events(spark, d).select("event_id", symbol, "timestamp", F.col("value").alias("price"), F.ceil("value").cast("long").alias("volume"), source)


def anonymous(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks and bars, some of which say no symbol, and bars that say no source."""
    rows = anonymous_rows(spark, d)
    return rows.select("symbol", "timestamp", "price"), rows.drop("price")


def t5_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The whole market flow in batch form."""
    return market.tick_bar_vwap(None, anonymous_rows(spark, d), S.WIDTH_MS, S.DAY_MS, ("timestamp", "event_id"))


def j1_unknown(spark: SparkSession, d: str) -> DataFrame:
    """The same over streams of ticks and of per-bar volumes: windows that the watermark has closed."""
    path, (ticks, bars) = shared_dir(spark), anonymous(spark, d)
    volumes = market.per_tick_volume(bars.withColumn("symbol", market.keyed(F.col("symbol"))), ["timestamp", "event_id"])
    ticks.write.parquet(f"{path}/ticks")
    volumes.select(F.nullif("symbol", F.lit("unknown")).alias("symbol"), "timestamp", "per_tick_volume", "data_source").write.parquet(f"{path}/volumes")
    ticks = spark.readStream.schema("symbol string, timestamp long, price double").parquet(f"{path}/ticks")
    volumes = spark.readStream.schema("symbol string, timestamp long, per_tick_volume long, data_source string").parquet(f"{path}/volumes")
    sums = market_stream.pair_sums_stream(market_stream.event_time(ticks), market_stream.event_time(volumes), S.WIDTH_MS // 1000)
    with market_stream.rocksdb(spark):
        to_end(market_stream.vwap_stream(sums, "1 day").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out"))
    return spark.read.schema("symbol string, window_end long, vwap double, n_pairs long, data_source string").parquet(f"{path}/out")


# Files


def scraped(part: str = "part") -> Column:
    """When a file of a part was scraped."""
    return F.timestamp_seconds(F.lit(1700003000) + F.col(part) % 4 * 60)


def s3_intake(spark: SparkSession, d: str) -> DataFrame:
    """News files that land in three rounds, a few in each batch; one batch crashes before its commit. For each file: in how many batches it was
    taken in, its rows by the hand-off and in the table, and whether it was refused."""
    path, seconds = shared_dir(spark), F.unix_seconds("scraped_at").alias("scraped_at")
    made = stored(envelope.build_envelopes(S.raw_news(spark, d), "news", "of_file", [f for f in articles.RAW_FIELDS if f != "related"], scraped(), part="part"))
    most = max(1, made.count() // 6)
    clean = lambda raw: articles.articles_from_files(raw, S.KNOWN)
    rejects = lambda raw: envelope.rejections(raw, "news")

    def run() -> None:
        stream = intake.stream_envelopes(spark, f"{path}/landing/news/*/*.json", most)
        with intake.few_listing_tasks(spark):
            to_end(intake.take_in(stream, f"{path}/table", f"{path}/state", clean, rejects))

    for i in range(3):
        sinks.write_envelopes(made.where(F.col("part") % 3 == i), f"{path}/landing", envelope.envelope_key("news", F.col("of_file"), scraped(), part=F.col("part")))
        run()
        if i == 1:
            forget_last_commit(spark, f"{path}/state")
            run()
    with intake.few_listing_tasks(spark):
        rows = intake.read_part(spark, f"{path}/table", "rows", "id long, source_file string, scraped_at timestamp, scraped_day date, file_key string")
        rows = rows.groupBy("source_file").agg(F.count("*").alias("n_rows"))
        handed = intake.read_part(spark, f"{path}/table", "handoff", intake.HANDOFF).groupBy("source_file").agg(F.count("*").alias("n_batches"), F.sum("n_written").alias("n_written"), F.max("latest_scraped_at").alias("scraped_at"))
        refused = intake.read_part(spark, f"{path}/table", "rejected", "source_path string, at string, rule string").select(F.col("source_path").alias("source_file"), F.col("at").alias("refused_at"))
    out = handed.join(rows, "source_file", "left").join(refused, "source_file", "left").fillna(0, ["n_rows"])
    return out.select(F.regexp_extract("source_file", r"/landing/(.*)$", 1).alias("source_file"), "n_batches", "n_written", "n_rows", seconds, F.col("refused_at").isNotNull().alias("refused"))


def news_over_days(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose files were scraped on three days."""
    raw = S.raw_news(spark, d).withColumn("scraped_at", F.timestamp_seconds(F.unix_seconds("scraped_at") + F.col("part") % 3 * 86_400))
    return articles.finish_articles(articles.accepted(articles.clean_articles(raw, F.col("of_file"), S.KNOWN)))


def k1_once(spark: SparkSession, d: str) -> DataFrame:
    """Files appended in two batches, the first of them twice, with what each write counted: rows by day and file."""
    path, rows = shared_dir(spark), stored(news_over_days(spark, d))
    own = F.crc32(F.col("source_file").cast("binary")) % 2
    written = [intake.append_once(rows.where(own == i), path) for i in (0, 1, 0)]
    schema = rows.schema.add("scraped_day", "date").add("file_key", "string")
    table = spark.read.schema(schema).parquet(path)
    out = table.groupBy("scraped_day", "source_file").agg(F.count("*").alias("n"), F.min("checksum_sha256").alias("first_checksum"))
    return out.select(F.col("scraped_day").cast("string").alias("scraped_day"), "source_file", "n", "first_checksum", F.lit(written[0]["n_written"] + written[1]["n_written"]).alias("n_all"), F.lit(written[2]["n_bad_checksum"]).alias("n_bad"))


def s6_scan(spark: SparkSession, d: str) -> DataFrame:
    """The rows of single files of a table over several days: each scan names a day and a file, and reads one folder."""
    path, rows = shared_dir(spark), news_over_days(spark, d)
    intake.append_once(rows, path)
    table = spark.read.schema(rows.schema.add("scraped_day", "date").add("file_key", "string")).parquet(path)
    asked = [("2023-11-14", "news/en/0"), ("2023-11-15", "news/en/1"), ("2023-11-14", "news/en/1"), ("2023-11-14", "news/none")]
    found = [intake.scan_file(table, day, file).select(F.lit(i).alias("scan"), "id", "checksum_sha256") for i, (day, file) in enumerate(asked)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def s2_names(spark: SparkSession, d: str) -> DataFrame:
    """Files by their base names, with the number of their records; a glob that no file fits adds nothing."""
    path = shared_dir(spark)
    made = envelope.build_envelopes(S.raw_news(spark, d), "news", "of_file", [f for f in articles.RAW_FIELDS if f != "related"], scraped(), part="part")
    sinks.write_envelopes(made, path, envelope.envelope_key("news", F.col("of_file"), scraped(), part=F.col("part")))
    raw = files.read_envelopes(spark, f"{path}/news/*/*.json").unionByName(files.read_envelopes(spark, f"{path}/other/*/*.json"))
    rows = envelope.explode_records(raw, "news", keep=["source_file", "source_path"])
    return rows.groupBy(F.element_at(F.split("source_path", "/"), -2).alias("of_file"), "source_file").agg(F.count("*").alias("n"))


#: Posts that pass the file gate, but for two kinds of rows.
_SOUND = {
    "id": "concat(CASE WHEN doc_id % 37 = 0 THEN 'p_' ELSE 'p' END, doc_id)", "num_comments": "cast(CASE WHEN doc_id % 41 = 0 THEN -1 ELSE doc_id % 11 END AS int)", "upvote_ratio": "(doc_id % 101) / 100.0D",
    "is_original_content": "doc_id % 3 = 0", "selftext": "coalesce(selftext, '')", "title": "concat('t', doc_id)", "url": "concat('ftp://x/', doc_id)",
}


def post_files(spark: SparkSession, d: str) -> DataFrame:
    """Post envelopes of about eight records (value, source_file), some with a bad one."""
    rows = S.raw_posts(spark, d).withColumns({k: F.expr(v) for k, v in _SOUND.items()}).withColumn("of", F.expr("cast(doc_id DIV 32 AS int)"))
    extra = {"sort_by": F.lit("top"), "time_filter": envelope.kept_time_filter(F.lit("top"), F.lit("day"))}
    made = envelope.build_envelopes(rows, "posts", "subreddit", posts.RAW_FIELDS, F.timestamp_seconds(F.lit(1700003000) + F.col("of") * 400), extra, part="of")
    return made.select("value", F.concat(F.lit("posts/"), "subreddit", F.lit("/"), "of").alias("source_file"))


def p2_many(spark: SparkSession, d: str) -> DataFrame:
    """Files of several posts: a bad record takes the others of its file with it, and the count in the metadata is the file's."""
    raw = post_files(spark, d)
    out = posts.posts_from_files(raw, spark.createDataFrame([], media_items.FACTS)).select("id", "subreddit", "score", "num_comments", "source_file")
    count = F.try_variant_get(F.try_parse_json("value"), "$.metadata.post_count", "bigint").alias("post_count")
    return out.join(raw.select("source_file", count), "source_file")


def p7_rejections(spark: SparkSession, d: str) -> DataFrame:
    """Why files were refused: news and posts, some of the news cut off, some with a list that is none."""
    made = envelope.build_envelopes(S.raw_news(spark, d), "news", "of_file", [f for f in articles.RAW_FIELDS if f != "related"], scraped(), part="part")
    value = F.when(F.col("part") % 7 == 3, F.left("value", F.lit(100))).when(F.col("part") % 7 == 5, F.concat(F.left("value", F.instr("value", '"news":') + 6), F.lit("3}"))).otherwise(F.col("value"))
    news = made.select(value.alias("value"), F.concat(F.lit("news/"), "of_file", F.lit("/"), "part").alias("source_path"))
    bad_posts = envelope.rejections(post_files(spark, d), "posts", key="source_file").withColumnRenamed("source_file", "source_path")
    return envelope.rejections(news, "news").unionByName(bad_posts)


def m14_files(spark: SparkSession, d: str) -> DataFrame:
    """Facts from files: pages with the heads of known formats, written as objects; those above a limit are told by their length alone."""
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "000000186674797069736F6D", "1A45DFA3", "524946460000000041564920", "3C68746D6C3E"]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("page_id") % 8 + 1).cast("int")))
    content = F.concat(head, F.when(F.col("page_id") % 5 > 0, F.col("html").cast("binary")).otherwise(F.lit(b"")))
    path = shared_dir(spark)
    objects.write_objects(S.table(spark, d, "pages"), path, F.concat(F.lit("lz/"), F.col("page_id") % 16, F.lit("/"), "page_id"), content)
    facts = media_items.facts_of_files(spark, path, 4000)
    return facts.select(F.regexp_extract("lz_url", r"/lz/\d+/(\d+)$", 1).cast("long").alias("page_id"), "true_mime", "processed_bytes", "failure")


# Enrichment by fitted models


def e2_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The three sentences of each whole text that are nearest to it, words weighed by how rare they are in all texts."""
    docs = S.table(spark, d, "documents")
    summarise = summaries.extractive_summariser(summaries.corpus_idf(docs))
    return docs.select("doc_id", F.sha2(summarise(F.col("text")).cast("binary"), 256).alias("summary_sha256"))


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts with a label for good or bad; a fifth of them, by id, calibrates, and another fifth is for neither."""
    labels = S.table(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    rows = S.table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id")
    fold = F.col("doc_id") % 5
    return rows.withColumns({"held": fold == 1, "unseen": fold == 0})


def e5_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Articles enriched by both models, the scorer fitted on labelled texts, stored, and loaded again."""
    path, rows = shared_dir(spark), labelled(spark, d)
    summaries.save_sentiment(spark, summaries.fit_sentiment(rows.where("NOT unseen")), path)
    scorer = summaries.sentiment_scorer(summaries.load_sentiment(spark, path))
    news = articles.finish_articles(articles.accepted(articles.clean_articles(S.raw_news(spark, d), F.col("of_file"), S.KNOWN)))
    summarise = summaries.extractive_summariser(summaries.corpus_idf(S.table(spark, d, "documents")), 1)
    out = enrich.enrich(news, summarise, scorer)
    return out.select("id", F.sha2("summary", 256).alias("summary_sha256"), "sentiment_label", F.round("sentiment_score", 9).alias("sentiment_score"))


QUERIES = {
    "K6_tick_points": k6_ticks, "K5_vwap_points_by_batch": k5_vwap, "K7_partition_retention": k7_partitions, "A6_Q2_Q3_rollup": a6_rollup, "T7_exact_late": t7_exact, "T3_backfill_stream": t3_backfill,
    "T5_A3_unknown": t5_unknown, "J1_T5_unknown_stream": j1_unknown, "S3_K12_intake": s3_intake, "K1_append_once": k1_once, "S6_file_scan": s6_scan, "S2_base_names": s2_names, "P2_many_posts": p2_many, "P7_rejected_files": p7_rejections, "M14_M16_binary_files": m14_files,
    "E2_extractive_summaries": e2_summaries, "E5_fitted_sentiment": e5_sentiment,
}

_ARRIVED = """late AS (SELECT *, coalesce(lag(volume) OVER w, 0) AS pv, coalesce(lag("timestamp") OVER w, 0) AS pt FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY event_id)),
arrived AS (SELECT event_id, symbol, "timestamp", CASE WHEN volume >= pv AND "timestamp" > pt THEN volume - pv ELSE volume END AS per_tick_volume FROM late)"""
_PAIRS = f"""pairs AS (SELECT t.symbol, greatest(t."timestamp", b."timestamp") AS ts, t.price, b.per_tick_volume, b.data_source FROM ticks t JOIN volumes b ON t.symbol = b.symbol AND b."timestamp" BETWEEN t."timestamp" - {S.WIDTH_MS} AND t."timestamp" + {S.WIDTH_MS})"""
_VWAP = f"""SELECT symbol, (ts // {S.DAY_MS} + 1) * {S.DAY_MS} AS window_end, round(CASE WHEN sum(per_tick_volume) > 0 THEN sum(round(price, 6) * per_tick_volume) / sum(per_tick_volume) ELSE 0.0 END, 6) AS vwap,
count(*) AS n_pairs, arg_max(data_source, (ts, data_source)) AS data_source FROM pairs GROUP BY 1, 2"""
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_BUCKET = "CAST('0x' || md5(w)[1:4] AS INTEGER)"
_IDF = f"""b AS (SELECT DISTINCT doc_id, {_BUCKET} AS b FROM (SELECT doc_id, unnest({_WORDS.format("text")}) AS w FROM documents)),
idf AS (SELECT b, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM b GROUP BY 1)"""


def _summary_sql(texts: str, n: int) -> str:
    """SQL for k (doc_id, summary): the n best sentences of each text of a table (doc_id, t)."""
    return rf"""t AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM {texts}),
s AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS pos FROM t),
v AS (SELECT doc_id, pos, {_BUCKET} AS b, count(*) AS n FROM (SELECT doc_id, pos, unnest({_WORDS.format("s")}) AS w FROM s) GROUP BY 1, 2, 3),
w AS (SELECT v.*, coalesce(idf, ln((SELECT count(*) FROM documents) + 1) + 1) AS idf FROM v LEFT JOIN idf USING (b)),
c AS (SELECT doc_id, b, sum(n) * any_value(idf) AS c FROM w GROUP BY 1, 2),
z AS (SELECT doc_id, pos, round(sum(n * idf * c) / sqrt(sum(n * idf * n * idf)), 9) AS z FROM w JOIN c USING (doc_id, b) GROUP BY 1, 2),
r AS (SELECT doc_id, pos, s, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(z, 0) DESC, pos) AS nth FROM s LEFT JOIN z USING (doc_id, pos)),
k AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS summary FROM r WHERE nth <= {n} GROUP BY 1)"""


_NAMED = """'news/' || lower(of_file) || '/' || strftime(to_timestamp(min(scraped)) AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') || CASE WHEN part > 0 THEN '-' || part ELSE '' END || '.json'"""
_DAYS = S.SCRAPED.replace("DIV", "//")
_POST = """posts AS (SELECT doc_id, lang, doc_id // 32 AS f, (CASE WHEN doc_id % 37 = 0 THEN 'p_' ELSE 'p' END) || doc_id AS id, doc_id % 37 = 0 AS bad_id, doc_id % 41 = 0 AS bad_count,
row_number() OVER (PARTITION BY lang, doc_id // 32 ORDER BY (CASE WHEN doc_id % 37 = 0 THEN 'p_' ELSE 'p' END) || doc_id) - 1 AS pos FROM documents)"""
SQL = {
    "K6_tick_points": f"""WITH {E}, x AS (SELECT symbol, "timestamp" // 600000 * 600000 AS "timestamp", event_id, price, event_id % 3 AS batch FROM ticks)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY batch DESC, event_id DESC) = 1""",
    "K5_vwap_points_by_batch": f"WITH {E}, {_PAIRS} {_VWAP}",
    "K7_partition_retention": f"""WITH {E} SELECT event_id, "timestamp", price, strftime(to_timestamp("timestamp" // 1000) AT TIME ZONE 'UTC', '%Y-%m-%d-%H') AS hour FROM ticks WHERE "timestamp" >= (SELECT max("timestamp") FROM ticks) - 2 * {S.DAY_MS}""",
    "A6_Q2_Q3_rollup": f"""WITH {E}, x AS (SELECT *, (SELECT max("timestamp") FROM ticks) - "timestamp" AS late FROM ticks)
SELECT 'hour' AS every, symbol, ("timestamp" // {HOUR_MS} + 1) * {HOUR_MS} AS bucket_end, round(avg(price), 6) AS mean_price, round(avg(late), 3) AS mean_latency_ms FROM x GROUP BY 2, 3
UNION ALL SELECT 'day', symbol, ("timestamp" // {S.DAY_MS} + 1) * {S.DAY_MS}, round(avg(price), 6), round(avg(late), 3) FROM x GROUP BY 2, 3""",
    "T7_exact_late": f"""WITH {E}, p AS (SELECT *, ("timestamp" // {S.DAY_MS} + 1) * {S.DAY_MS} AS window_end,
    least(2, event_id * 3 // ((SELECT max(event_id) FROM ticks) + 1) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) AS batch FROM ticks),
m AS (SELECT b.batch, max(p."timestamp") - 3000 AS mark FROM (VALUES (1), (2)) b(batch) JOIN p ON p.batch < b.batch GROUP BY 1),
l AS (SELECT p.*, coalesce(window_end <= mark, false) AS late FROM p LEFT JOIN m USING (batch)),
r AS (SELECT batch, symbol, window_end, count(*) AS n FROM l WHERE late GROUP BY 1, 2, 3
    UNION ALL SELECT -1, symbol, window_end, count(*) FROM l WHERE NOT late AND window_end <= (SELECT max("timestamp") - 3000 FROM ticks) GROUP BY 2, 3)
SELECT *, (SELECT count(*) FROM ticks) AS n_arrived FROM r""",
    "T3_backfill_stream": f"WITH {E}, {_ARRIVED} SELECT * FROM arrived",
    "T5_A3_unknown": f"""WITH {E}, x AS (SELECT event_id, CASE WHEN user_id % 5 > 0 THEN symbol ELSE 'unknown' END AS symbol, "timestamp", value AS price, CAST(ceil(value) AS BIGINT) AS volume, CASE WHEN user_id % 3 > 0 THEN 'exchange' || user_id % 3 ELSE 'unknown' END AS data_source FROM ev),
g AS (SELECT *, coalesce(lag(volume) OVER w, 0) AS pv, coalesce(lag("timestamp") OVER w, 0) AS pt FROM x WINDOW w AS (PARTITION BY symbol ORDER BY "timestamp", event_id)),
v AS (SELECT *, CASE WHEN volume >= pv AND "timestamp" > pt THEN volume - pv ELSE volume END AS per_tick_volume FROM g),
{_PAIRS.replace("ticks t", "x t").replace("volumes b", "v b")} {_VWAP}""",
    "S3_K12_intake": f"""WITH {N}, f AS (SELECT of_file, part, 'news/' || of_file || '/' || part AS own, {_NAMED} AS source_file, min(scraped) AS scraped_at, bool_or(id < 0) AS refused FROM raw GROUP BY 1, 2),
a AS (SELECT source_file AS own, count(*) AS n FROM articles GROUP BY 1)
SELECT source_file, 1 AS n_batches, CASE WHEN refused THEN 0 ELSE coalesce(n, 0) END AS n_written, CASE WHEN refused THEN 0 ELSE coalesce(n, 0) END AS n_rows, CASE WHEN NOT refused AND n > 0 THEN scraped_at END AS scraped_at, refused FROM f LEFT JOIN a USING (own)""",
    "K1_append_once": f"""WITH {N.replace(_DAYS, f"{_DAYS} + (doc_id // 100) % 3 * 86400")}
SELECT strftime(to_timestamp(scraped) AT TIME ZONE 'UTC', '%Y-%m-%d') AS scraped_day, source_file, count(*) AS n, min(checksum_sha256) AS first_checksum, (SELECT count(*) FROM articles) AS n_all, 0 AS n_bad FROM articles GROUP BY 1, 2""",
    "S6_file_scan": f"""WITH {N.replace(_DAYS, f"{_DAYS} + (doc_id // 100) % 3 * 86400")}
SELECT CASE source_file WHEN 'news/en/0' THEN 0 ELSE 1 END AS scan, id, checksum_sha256 FROM articles WHERE source_file IN ('news/en/0', 'news/en/1')""",
    "S2_base_names": f"""WITH {N} SELECT of_file, split_part({_NAMED}, '/', 3) AS source_file, count(*) AS n FROM raw GROUP BY of_file, part""",
    "P2_many_posts": f"""WITH {_POST}, f AS (SELECT lang, f, count(*) AS post_count FROM posts GROUP BY 1, 2 HAVING NOT bool_or(bad_id OR bad_count))
SELECT id, lang AS subreddit, greatest(doc_id % 13 - 3, 0) AS score, doc_id % 11 AS num_comments, 'posts/' || lang || '/' || f AS source_file, post_count FROM posts JOIN f USING (lang, f)
WHERE 1700000000 + doc_id * 10.5 <= 1700003000 + f * 400 + 3600""",
    "P7_rejected_files": f"""WITH {_POST}, b AS (SELECT 'posts/' || lang || '/' || f AS source_path, pos, bad_id FROM posts WHERE bad_id OR bad_count),
n AS (SELECT 'news/' || lang || '/' || doc_id // 100 AS source_path, doc_id // 100 % 7 AS k, CASE WHEN lang = 'es' AND doc_id % 23 = 0 THEN -doc_id ELSE doc_id END AS id, left(text, CAST(8 + doc_id % 60 AS INTEGER)) AS headline FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY id) - 1 AS pos FROM n)
SELECT source_path, '$.posts[' || min(pos) || '].' || CASE WHEN arg_min(bad_id, pos) THEN 'id' ELSE 'num_comments' END AS at, CASE WHEN arg_min(bad_id, pos) THEN 'string, v rlike ''^[A-Za-z0-9]+$''' ELSE 'integer, v >= 0' END AS rule FROM b GROUP BY 1
UNION ALL SELECT DISTINCT source_path, CASE k WHEN 3 THEN '$' ELSE '$.news' END, CASE k WHEN 3 THEN 'JSON' ELSE 'array' END FROM n WHERE k IN (3, 5)
UNION ALL SELECT source_path, '$.news[' || min(pos) || '].' || CASE WHEN arg_min(id, pos) < 0 THEN 'id' ELSE 'headline' END, CASE WHEN arg_min(id, pos) < 0 THEN 'integer, v >= 0' ELSE 'string, length(v) >= 1' END FROM o WHERE k NOT IN (3, 5) AND (id < 0 OR headline = '') GROUP BY 1""",
    "E2_extractive_summaries": f"WITH {_IDF}, {_summary_sql('(SELECT doc_id, text AS t FROM documents)', 3)} SELECT doc_id, sha256(summary) AS summary_sha256 FROM documents LEFT JOIN k USING (doc_id)",
    "E5_fitted_sentiment": f"""WITH {N}, {_IDF}, {_summary_sql("(SELECT doc_id, headline AS t FROM articles WHERE length(summary) < 50)", 1)},
fin AS (SELECT a.id, coalesce(k.summary, a.summary) AS summary, a.headline || '. ' || coalesce(k.summary, a.summary) AS text FROM articles a LEFT JOIN k USING (doc_id)),
lab AS (SELECT doc_id, text, quality AS l, doc_id % 5 AS f FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
cnt AS (SELECT {_BUCKET} AS b, count(*) FILTER (l = 1) AS g, count(*) FILTER (l = 0) AS h FROM (SELECT l, unnest({_WORDS.format("text")}) AS w FROM lab WHERE f > 1) GROUP BY 1),
tot AS (SELECT coalesce(sum(g), 0) AS g, coalesce(sum(h), 0) AS h FROM cnt),
wgt AS (SELECT b, ln((cnt.g + 1) / (tot.g + {summaries.BUCKETS})) - ln((cnt.h + 1) / (tot.h + {summaries.BUCKETS})) AS x FROM cnt, tot),
non AS (SELECT ln(1 / (g + {summaries.BUCKETS})) - ln(1 / (h + {summaries.BUCKETS})) AS x FROM tot),
cal AS (SELECT doc_id, any_value(l) AS l, coalesce(avg(coalesce(wgt.x, non.x)) FILTER (w IS NOT NULL), 0) AS m FROM (SELECT doc_id, l, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [NULL] END) AS w FROM (SELECT *, {_WORDS.format("text")} AS ws FROM lab WHERE f = 1)) LEFT JOIN wgt ON {_BUCKET} = wgt.b, non GROUP BY 1),
bin AS (SELECT least(greatest(floor((m + {summaries.RANGE}) / {2 * summaries.RANGE / summaries.BINS}), 0), {summaries.BINS - 1}) AS bin, count(*) FILTER (l = 1) AS good, count(*) AS n FROM cal GROUP BY 1),
art AS (SELECT id, coalesce(avg(coalesce(wgt.x, non.x)) FILTER (w IS NOT NULL), 0) AS m FROM (SELECT id, unnest(CASE WHEN len(ws) > 0 THEN ws ELSE [NULL] END) AS w FROM (SELECT *, {_WORDS.format("text")} AS ws FROM fin)) LEFT JOIN wgt ON {_BUCKET} = wgt.b, non GROUP BY 1),
fit AS (SELECT id, (coalesce(good, 0) + 2 / (1 + exp({-summaries.SLOPE} * ({-summaries.RANGE} + (bin + 0.5) * {2 * summaries.RANGE / summaries.BINS})))) / (coalesce(n, 0) + 2) AS p FROM (SELECT id, least(greatest(floor((m + {summaries.RANGE}) / {2 * summaries.RANGE / summaries.BINS}), 0), {summaries.BINS - 1}) AS bin FROM art) LEFT JOIN bin USING (bin))
SELECT id, sha256(summary) AS summary_sha256, CASE WHEN p >= 0.5 THEN 'positive' ELSE 'negative' END AS sentiment_label, round(greatest(p, 1 - p), 9) AS sentiment_score FROM fin JOIN fit USING (id)""",
    "M14_M16_binary_files": """WITH x AS (SELECT page_id, page_id % 8 AS k, ([4, 8, 6, 12, 12, 4, 12, 6])[page_id % 8 + 1] + CASE WHEN page_id % 5 > 0 THEN coalesce(strlen(html), 0) ELSE 0 END AS n FROM pages)
SELECT page_id, CASE WHEN n <= 4000 THEN (['image/jpeg', 'image/png', 'image/gif', 'image/webp', 'video/mp4', 'video/webm', 'video/x-msvideo', NULL])[k + 1] END AS true_mime, n AS processed_bytes,
CASE WHEN n > 4000 THEN 'exceeds limit of 4000 bytes' WHEN n < 100 THEN 'content too small' END AS failure FROM x""",
}
SQL["J1_T5_unknown_stream"] = f"SELECT * FROM ({SQL['T5_A3_unknown']}) t WHERE window_end < (SELECT max(window_end) FROM ({SQL['T5_A3_unknown']}) u)"
