"""Envelopes {metadata, records[]}: validation of whole files, typed parsing, and the writer's side."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import clean_string, parse_iso

MEDIA = "array<struct<media_type:string,lz_url:string,source_url:string,filename:string,content_type:string>>"
# For each kind the list's name, its raw schema, and the rules (field, type, required, condition on the value v).
KINDS = {
    "news": {
        "list": "news",
        "schema": "struct<metadata:struct<category:string,article_count:int,scraped_at:string>,news:array<struct<id:bigint,category:string,datetime:bigint,headline:string,source:string,summary:string,url:string,image:string>>>",
        "metadata": [("category", "string", True, ""), ("article_count", "integer", True, "v >= 0"), ("scraped_at", "string", True, "")],
        "items": [
            ("id", "integer", True, "v >= 0"), ("category", "string", True, ""), ("datetime", "integer", True, "v >= 0"), ("headline", "string", True, "length(v) >= 1"),
            ("source", "string", True, "length(v) >= 1"), ("summary", "string", False, ""), ("url", "string", True, ""), ("image", "string", False, ""),
        ],
    },
    "posts": {
        "list": "posts",
        "schema": f"struct<metadata:struct<subreddit:string,sort_by:string,time_filter:string,post_count:int,scraped_at:string>,posts:array<struct<id:string,title:string,author:string,created_utc:double,score:int,url:string,selftext:string,num_comments:int,permalink:string,upvote_ratio:double,is_original_content:boolean,is_self:boolean,media:{MEDIA}>>>",
        "metadata": [("subreddit", "string", True, ""), ("sort_by", "string", True, ""), ("time_filter", "string or null", False, ""), ("post_count", "integer", True, "v >= 0"), ("scraped_at", "string", True, "")],
        "items": [
            ("id", "string", True, "v rlike '^[A-Za-z0-9]+$'"), ("title", "string", True, "length(v) >= 1"), ("author", "string", True, "length(v) >= 1"), ("created_utc", "number", True, "v >= 0"),
            ("score", "integer", True, ""), ("url", "string", True, ""), ("selftext", "string", True, ""), ("num_comments", "integer", True, "v >= 0"), ("permalink", "string", True, ""),
            ("upvote_ratio", "number", True, "v >= 0 AND v <= 1"), ("is_original_content", "boolean", True, ""), ("is_self", "boolean", True, ""),
        ],
    },
}
_TYPES = {"string": "= 'STRING'", "boolean": "= 'BOOLEAN'", "integer": r"rlike '^(BIGINT|DECIMAL\\(\\d+,0\\))$'", "number": "rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)'", "string or null": "rlike '^(STRING|VOID)$'"}


def _field_rule(of: str, field: str, kind: str, required: bool, condition: str) -> str:
    """SQL that is true if a field of the variant of has its type and meets its condition, or may be missing and is."""
    here = f"schema_of_variant(try_variant_get({of}, '$.{field}', 'variant'))"
    rule = f"coalesce({here} {_TYPES[kind]}, {str(not required).lower()})"
    if condition:
        value = f"try_variant_get({of}, '$.{field}', '{'string' if kind == 'string' else 'double'}')"
        rule += f" AND coalesce({re.sub(r'\bv\b', lambda _: value, condition)}, {str(not required).lower()})"
    return rule


def envelope_ok(raw: str, kind: str) -> Column:
    """True if the text in column raw is a valid file of its kind, all records included; false for text that is no JSON."""
    k = KINDS[kind]
    doc = f"try_parse_json({raw})"
    meta = [_field_rule(doc, f"metadata.{f}", *rest) for f, *rest in k["metadata"]]
    items = " AND ".join(_field_rule("x", *rule) for rule in k["items"])
    return F.expr(" AND ".join(meta) + f" AND coalesce(forall(try_variant_get({doc}, '$.{k['list']}', 'array<variant>'), x -> {items}), false)")


def rejections(df: DataFrame, kind: str, raw: str = "value", key: str = "source_path") -> DataFrame:
    """key, at and rule for each file that envelope_ok refuses: the JSON path of the first field that fails, and what was asked of it.

    Fields of the metadata come first, then the list itself, then its records in order, each field by field; text that is no JSON fails as a
    whole. Records are rows of a lateral variant_explode; the first failure of a file is a minimum, combined before its shuffle. key tells
    files apart.
    """
    k, rules = KINDS[kind], []

    def rule(at: str, of: str, field: str, asked: str, required: bool, condition: str) -> Column:
        rules.append((at, f"{asked}, {condition}" if condition else asked))
        return F.when(~F.expr(_field_rule(of, field, asked, required, condition)), F.lit(len(rules) - 1))

    doc = f"try_parse_json({raw})"
    rules += [("$", "JSON")]
    checks = [F.when(F.expr(f"{doc} IS NULL"), F.lit(0))]
    checks += [rule(f"$.metadata.{f}", "_doc", f"metadata.{f}", *rest) for f, *rest in k["metadata"]]
    rules.append((f"$.{k['list']}", "array"))
    checks.append(F.when(F.expr("NOT coalesce(schema_of_variant(_list) LIKE 'ARRAY<%', false)"), F.lit(len(rules) - 1)))
    files = df.select(key, F.expr(doc).alias("_doc"), F.col(raw))
    files = files.withColumn("_list", F.expr(f"try_variant_get(_doc, '$.{k['list']}', 'variant')"))
    of_file = files.withColumn("_rule", F.coalesce(*checks))
    whole = of_file.where("_rule IS NOT NULL").select(key, F.lit(-1).alias("_pos"), "_rule")
    items = of_file.where("_rule IS NULL").select(key, "_list").lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    failed = F.coalesce(*(rule(f, "value", f, *rest) for f, *rest in k["items"]))
    records = items.select(key, F.col("pos").alias("_pos"), failed.alias("_rule")).where("_rule IS NOT NULL")
    first = whole.unionByName(records).groupBy(key).agg(F.min(F.struct("_pos", "_rule")).alias("_first"))
    names, asked = (F.element_at(F.array(*(F.lit(r[i]) for r in rules)), F.col("_first._rule") + 1) for i in (0, 1))
    at = F.when(F.col("_first._pos") < 0, names).otherwise(F.concat(F.lit(f"$.{k['list']}["), F.col("_first._pos"), F.lit("]."), names))
    return first.select(key, at.alias("at"), asked.alias("rule"))


def validate_envelopes(df: DataFrame, kind: str, raw: str = "value") -> DataFrame:
    """df with envelope_ok: one bad record rejects its file."""
    return df.withColumn("envelope_ok", F.coalesce(envelope_ok(raw, kind), F.lit(False)))


def explode_records(df: DataFrame, kind: str, raw: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row for each record: the file's metadata as meta, its scraped_at parsed, and the record as record.

    Files without a scrape time that parses are dropped, and so, for news, are those without a category; an empty or missing
    list gives no rows.
    """
    k = KINDS[kind]
    keep = [c for c in df.columns if c not in (raw, "envelope_ok")] if keep is None else keep
    rows = df.withColumn("_js", F.from_json(raw, k["schema"])).select(*keep, F.col("_js.metadata").alias("meta"), F.col(f"_js.{k['list']}").alias("_records"))
    rows = rows.withColumn("scraped_at", parse_iso(F.col("meta.scraped_at"))).where("scraped_at IS NOT NULL")
    if kind == "news":
        rows = rows.where("meta.category IS NOT NULL")
    return rows.select(*keep, "meta", "scraped_at", F.explode("_records").alias("record"))


def group_metadata(kind: str) -> list[Column]:
    """Counts for the metadata of one file, over its records."""
    if kind == "news":
        return [F.count("*").cast("int").alias("article_count")]
    return [
        F.count("*").cast("int").alias("post_count"), F.count_if(F.col("media").isNotNull()).cast("int").alias("posts_with_media"),
        F.sum(F.when(F.col("media").isNull(), 0).otherwise(F.size("media"))).cast("int").alias("total_media_items"),
    ]


def kept_time_filter(sort_by: Column, time_filter: Column) -> Column:
    """A time filter means something for two orders only."""
    return F.when(sort_by.isin("top", "controversial"), time_filter)


def build_envelopes(records: DataFrame, kind: str, group: str, fields: list[str], scraped_at: Column, extra: dict[str, Column] | None = None, part: str | None = None) -> DataFrame:
    """group, part and value: one envelope as JSON text for each group of records, and each part of it.

    A file is one row, put together by one task: part, a column that cuts a group into pieces of bounded size, keeps it small
    however large the group is. Counts in the metadata are those of the file. Records are in the order of their fields, so that a task that is
    run again makes the same text.
    """
    name = {"news": "category", "posts": "subreddit"}[kind]
    records = records if "media" in records.columns or kind == "news" else records.withColumn("media", F.lit(None).cast(MEDIA))
    files = records.groupBy(group, F.col(part) if part else F.lit(0).alias("part")).agg(*group_metadata(kind), F.sort_array(F.collect_list(F.struct(*fields))).alias("_items"))
    part = part or "part"
    counts = [c for c in files.columns if c not in (group, part, "_items")]
    meta = F.struct(F.col(group).alias(name), *(c.alias(k) for k, c in (extra or {}).items()), *counts, F.date_format(scraped_at, "yyyy-MM-dd'T'HH:mm:ss").alias("scraped_at"))
    return files.select(group, part, F.to_json(F.struct(meta.alias("metadata"), F.col("_items").alias(KINDS[kind]["list"]))).alias("value"))


def envelope_key(source: str, group: Column, at: Column, prefix: str = "", part: Column | None = None) -> Column:
    """source/[prefix/]group/YYYYMMDD_HHMMSS.json, the group in lower case; parts of a group but the first (0) add -part to the time."""
    more = F.lit("") if part is None else F.when(part > 0, F.concat(F.lit("-"), part.cast("string"))).otherwise("")
    return F.concat(F.lit(f"{source}/" + (f"{prefix}/" if prefix else "")), F.lower(clean_string(group)), F.lit("/"), F.date_format(at, "yyyyMMdd_HHmmss"), more, F.lit(".json"))
