"""WARC archives: pages as records, with segments and revisits, and the way back to whole payloads."""

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import give_back, shared_dir, small, stored, table

#: A block of more bytes is cut into segments; a file has so many records at most, and so a bounded size.
SEGMENT_BYTES, FILE_RECORDS = 16 << 10, 4096
#: Payloads from this size on are written once; bytes of one chunk of a body.
REVISIT_BYTES, CHUNK = 1000, 4096
END = "\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, warc_type string, target_uri string, warc_date string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, refers_to string, problem string"
_RECORD = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("problem", pa.string()),
])
_SEGMENT = pa.schema([("origin", pa.string()), ("number", pa.int64()), ("total", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("problem", pa.string())])


# Writing


def record_id(archive: str, place: int) -> str:
    """The same for each attempt to write a row of an archive."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}:{place}'.encode()).digest())}>"


def chunked_body(payload: bytes) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK))]
    return b"".join([*parts, b"0\r\n\r\n"])


def one_record(fields: dict[str, str | None], block: bytes) -> bytes:
    """A record up to the end of its block; a field that is None is left out, and line ends in a value are percent-encoded."""
    lines = [f"{k}: {v.replace('\r', '%0D').replace('\n', '%0A')}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}{END}"]).encode() + block


def segments_of(fields: dict[str, str | None], block: bytes, size: int, name: str) -> Iterator[bytes]:
    """The record, or the segments that it is cut into: the first keeps its type, later ones are continuations that name it."""
    if len(block) <= size:
        yield one_record(fields, block)
        return
    yield one_record(fields | {"WARC-Segment-Number": "1"}, block[:size])
    for i, at in enumerate(range(size, len(block), size), 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": record_id(name, i), "WARC-Segment-Origin-ID": fields["WARC-Record-ID"], "WARC-Segment-Number": str(i)}
        last = {"WARC-Segment-Total-Length": str(len(block)) if at + size >= len(block) else None}
        yield one_record(more | last | {k: fields[k] for k in ("WARC-Target-URI", "WARC-Date")}, block[at : at + size])


def write_archives(pages: DataFrame, path: str, at: datetime | None = None, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Pages (page_id, url, html) as gzipped archives below path, one record for each row, its payload the html in UTF-8.

    Of rows with equal payloads of at least revisit_bytes, the one with the largest page_id is a response and the others are revisits
    that refer to it; all other rows are responses. Payloads are equal if SHA-1, length and a second hash are. A block of more than
    segment_bytes is cut into segments, so that a file of at most file_records records has a bounded size; Spark's writer commits the files.

    Null html is an empty payload. Null page_ids sort before all others and make no field; of rows alike in page_id and payload any one
    may be the response. A null url makes no target field. Further columns are ignored. An empty table makes no records.

    The groups of equal payloads are counted before a shuffle, by keys alone. Rows meet the keys that repeat in a broadcast join while those
    are known to be few, else in a plain one, in which adaptive execution splits a payload that many rows have.
    """
    archive, date = uuid.uuid4().hex, (at or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    key = ["sha1", "n_bytes", "check_hash"]
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), F.xxhash64("payload").alias("check_hash"), F.monotonically_increasing_id().alias("place"))
    rows = stored(rows)  # fixes places
    groups = rows.where(F.col("n_bytes") >= revisit_bytes).groupBy(*key).agg(F.max(F.struct("page_id", "place"))["place"].alias("response"), F.count("*").alias("n"))
    repeated = stored(groups.where("n > 1").drop("n"))
    rows = rows.join(small(repeated, 128), key, "left").select("page_id", "url", "payload", "sha1", "place", "response")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(start, 64).to_pylist():
                    own, revisit = record_id(archive, r["place"]), r["response"] is not None and r["response"] != r["place"]
                    fields = {
                        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": r["url"], "Content-Type": "application/http;msgtype=response",
                        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(r["sha1"])).decode(), "WARC-Profile": PROFILE if revisit else None,
                        "WARC-Refers-To": record_id(archive, r["response"]) if revisit else None, "Page-ID": None if r["page_id"] is None else str(r["page_id"]),
                    }
                    out += segments_of(fields, HEAD if revisit else HEAD + chunked_body(r["payload"]), segment_bytes, f"{archive}:{r['place']}")
                yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
        give_back()

    # the text writer puts out the bytes of a string as they are, and its line separator is what ends a record
    out = rows.mapInArrow(write, "record binary").select(F.col("record").cast("string").alias("value"))
    out.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


# Reading


def records_of(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Named fields (lower-case), block and what is wrong of each record; the last thing that an archive which breaks off gives is a problem."""
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                yield {}, b"", "no record where one should start"
                return
            fields, name = {}, ""
            while (line := stream.readline()).strip():
                if line[:1] in b" \t" and name:  # folded
                    fields[name] += " " + line.strip().decode("utf-8", "replace")
                else:
                    name, _, value = (x.strip() for x in line.decode("utf-8", "replace").partition(":"))
                    name = name.lower()
                    fields[name] = value
            size = fields.get("content-length", "")
            if not size.isdecimal():
                yield fields, b"", "no content length"
                return
            block = stream.read(int(size))
            yield fields, block, None if len(block) == int(size) else "block broken off"
    except (EOFError, OSError, zlib.error):
        yield {}, b"", "archive broken off"


def opened(content: bytes) -> BinaryIO:
    """An archive, gzipped as a whole or record by record, or plain."""
    return gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def without_chunks(body: bytes) -> tuple[bytes, str | None]:
    """A body without its chunked transfer framing; of broken framing, what could be read."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        try:
            n = int(size, 16)
        except ValueError:
            return b"".join(parts), "chunk without a size"
        if n == 0:
            return b"".join(parts), None
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if n < 0 or body[at - 2 : at] != b"\r\n":
            return b"".join(parts), "chunk broken off"


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes, str | None]:
    """What an HTTP message carries, without transfer framing; the block of anything else."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, None
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return b"", "no end of the HTTP head"
    lines = [x.lower().partition(b":") for x in head.split(b"\r\n")[1:]]
    return without_chunks(body) if any(k.strip() == b"transfer-encoding" and b"chunked" in v for k, _, v in lines) else (body, None)


def digest_of(field: str) -> str | None:
    """Lower-case hex of a digest field (sha1:BASE32, or hex); None if it is no SHA-1."""
    kind, _, value = field.partition(":")
    if kind.lower() != "sha1":
        return None
    try:
        return (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value.upper())).hex()
    except ValueError:
        return None


def as_row(fields: dict[str, str], block: bytes, problem: str | None) -> tuple:
    """A record as read_archives returns it."""
    stated, kind, refers = digest_of(fields.get("warc-payload-digest", "")), fields.get("warc-type"), fields.get("warc-refers-to")
    common = (fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), list(fields.items()))
    if kind == "revisit":
        return *common, None, None, stated, refers, problem
    payload, wrong = payload_of(fields, block)
    digest = hashlib.sha1(payload).hexdigest()
    differs = "payload digest differs" if stated is not None and stated != digest else None
    return *common, payload, len(payload), digest, refers, problem or wrong or differs


def in_batches(rows: Iterator[tuple], schema: pa.Schema, sized: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about most bytes of their column sized."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 256 + len(r[sized] or b"")
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _all_records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    for batch in batches:
        for content in batch.column(0):
            yield from records_of(opened(content.as_py()))
    give_back()


def whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (as_row(*r) for r in _all_records(batches) if "warc-segment-number" not in r[0])
    return in_batches(rows, _RECORD, 5)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments under the identifier of the record that they belong to; a number or total that is none is null."""

    def number(text: str | None) -> int | None:
        return int(text) if text and text.isdecimal() and len(text) < 19 else None

    rows = ((f.get("warc-segment-origin-id", f.get("warc-record-id")), number(f["warc-segment-number"]), number(f.get("warc-segment-total-length")), list(f.items()), block, problem) for f, block, problem in _all_records(batches) if "warc-segment-number" in f)
    return in_batches(rows, _SEGMENT, 4)


def reassembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records from (parts, total, fields, problem), parts in the order of their numbers."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                blocks = {p["number"]: p["block"] for p in reversed(r["parts"])}  # of segments with one number, the first
                block = b"".join(blocks[k] for k in sorted(blocks))
                wrong = r["problem"] or ("segment missing" if sorted(blocks) != list(range(1, len(blocks) + 1)) else None) or (None if len(block) == r["total"] else "total length differs")
                yield as_row(dict(r["fields"] or []), block, wrong)

    return in_batches(rows(), _RECORD, 5)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives that path names (a folder or a glob), segments put together: record_id, warc_type, target_uri, warc_date,
    fields (all named fields, in lower case), payload, its bytes and bare SHA-1, refers_to, and problem, which is null for a sound record.

    Whole records are decoded by the task that reads them. Segments are grouped by the record that they belong to, which is all that is
    shuffled: put in the order of their numbers, with the total length that the last one states verified, then decoded. A group is one record. A
    revisit has no payload, and the digest that it states. A segment whose number is none, or whose first segment is missing, keeps what there
    is, with a problem; of segments of one number one counts. An archive that breaks off gives what was read and a record with a problem. A path
    without files gives no rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    schema = "origin string, number long, total long, fields map<string,string>, block binary, problem string"
    cut = files.mapInArrow(segments, schema)
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("number", F.lit(0)).alias("number"), "block"))).alias("parts")
    head = F.coalesce(F.first(F.when(F.col("number") == 1, F.col("fields")), ignorenulls=True), F.first("fields")).alias("fields")
    groups = cut.groupBy("origin").agg(ordered, F.max("total").alias("total"), head, F.max("problem").alias("problem"))
    return files.mapInArrow(whole_records, RECORD).unionByName(groups.select("parts", "total", "fields", "problem").mapInArrow(reassembled, RECORD))


def with_originals(records: DataFrame) -> DataFrame:
    """records, a stored table without payloads, with original: struct of record_id, payload_bytes, payload_digest and fields of the response that
    a revisit refers to; null for all others and where there is none.

    The join is a plain one, in which adaptive execution splits a response that many revisits name.
    """
    own = F.struct("record_id", "payload_bytes", "payload_digest", "fields").alias("original")
    originals = records.where("warc_type = 'response'").select(F.col("record_id").alias("_named"), own)
    revisits = records.where("warc_type = 'revisit'").join(originals, F.col("refers_to") == F.col("_named"), "left").drop("_named")
    return records.where("warc_type IS NULL OR warc_type <> 'revisit'").unionByName(revisits, allowMissingColumns=True)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_archives(table(spark, sf_dir, "pages"), path)
    rows = with_originals(stored(read_archives(spark, path).drop("payload")))
    page = lambda fields: F.try_element_at(fields, F.lit("page-id")).cast("long")
    return rows.select(
        page(F.col("fields")).alias("page_id"), F.coalesce("payload_bytes", "original.payload_bytes").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"),
        page(F.col("original.fields")).alias("refers_to"), "problem",
    )


OP11_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> last THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM g
"""
