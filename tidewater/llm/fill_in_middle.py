"""Fill-in-middle: documents as piece tables, cut at tokens, arranged, and restored."""

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.llm.common import documents, rows_of, table

# The buffer of sentinels; of a hundred documents, from which on one stays as it is, and below which one has its suffix first.
SENTINELS = b"<P><S><M>"
PLAIN, SUFFIX_FIRST = 90, 20
#: Which of the six pieces (three sentinels, then prefix, middle, suffix) stands at each place of an output.
ARRANGEMENTS = {"psm": (0, 3, 1, 5, 2, 4), "spm": (1, 5, 0, 3, 2, 4)}
#: Bytes of a text that are looked at at once.
SPAN = 1 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = "restored string, restored_sha256 string"


class Piece(NamedTuple):
    """A descriptor: bytes start to end of an immutable buffer."""

    buffer: bytes
    start: int
    end: int

    def split(self, *at: int) -> list["Piece"]:
        """The pieces between offsets in the buffer, which ascend."""
        bounds = [self.start, *at, self.end]
        return [Piece(self.buffer, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def characters(self) -> int:
        seen = np.frombuffer(self.buffer, np.uint8)[self.start : self.end]
        return sum(int(np.count_nonzero((seen[i : i + SPAN] & 0xC0) != 0x80)) for i in range(0, len(seen), SPAN))


def sha256(pieces: Iterable[Piece]) -> str:
    """Digest of what pieces spell, which is never put together."""
    made = hashlib.sha256()
    for p in pieces:
        made.update(memoryview(p.buffer)[p.start : p.end])
    return made.hexdigest()


def spelled(pieces: Iterable[Piece]) -> bytes:
    return b"".join(memoryview(p.buffer)[p.start : p.end] for p in pieces)


def token_starts(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Spans of a text: their offset, and where tokens begin in them. A token is a run of A-Z and a-z, or any other one character."""
    seen, before = np.frombuffer(text, np.uint8), False
    for at in range(0, len(seen), SPAN):
        span = seen[at : at + SPAN]
        letter = _LETTER[span]
        inside = np.concatenate(([before], letter[:-1])) & letter
        yield at, ~inside & ((span & 0xC0) != 0x80)
        before = bool(letter[-1])


def offset_of(text: bytes, token: int) -> int:
    """Where a token begins; the end of the text for the one after the last."""
    for at, starts in token_starts(text):
        n = int(np.count_nonzero(starts))
        if token < n:
            return at + int(np.flatnonzero(starts)[token])
        token -= n
    return len(text)


def arranged(doc_id: int | None, text: bytes, seed: int = 1) -> tuple[int, str, list[Piece], list[Piece]]:
    """Number of tokens, form, the pieces prefix, middle and suffix (the whole text if it is plain), and the pieces of the output."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = sum(int(np.count_nonzero(starts)) for _, starts in token_starts(text))
    whole, marks = Piece(text, 0, len(text)), Piece(SENTINELS, 0, len(SENTINELS)).split(3, 6)
    if not text or any(spelled([m]) in text for m in marks) or h[2] % 100 >= PLAIN:
        return n, "plain", [whole], [whole]
    form = "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
    parts = whole.split(*(offset_of(text, t) for t in sorted((h[0] % (n + 1), h[1] % (n + 1)))))
    pieces = [*marks, *parts]
    return n, form, parts, [pieces[i] for i in ARRANGEMENTS[form]]


def original(output: bytes, form: str | None) -> list[Piece] | None:
    """The pieces of an output that spell its text: it is cut at its sentinels, and the inverse of the arrangement puts the pieces back. None for
    an output that has not the sentinels of its form in their order."""
    whole = Piece(output, 0, len(output))
    if form == "plain":
        return [whole]
    if form not in ARRANGEMENTS:
        return None
    order, bounds, at = ARRANGEMENTS[form], [], 0
    for i in order[::2]:
        found = output.find(SENTINELS[3 * i : 3 * i + 3], at)
        if found < 0 or (at == 0 and found > 0):
            return None
        at = found + 3
        bounds += [found, at]
    pieces = whole.split(*bounds)[1:]
    inverse = sorted(range(6), key=order.__getitem__)
    return [pieces[i] for i in inverse[3:]]


def transformed_batches(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch, texts in rows_of(batches):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            n, form, parts, output = arranged(doc_id, text, seed)
            counts = (None, None) if form == "plain" else (parts[0].characters(), parts[1].characters())
            rows.append((n, form, *counts, spelled(output), sha256(output)))
        cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
        made[4] = made[4].cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], names=names)


def restored_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), 512):
            part = batch.slice(start, 512)
            found = [None if o is None else original(o, f) for o, f in zip(part.column("output").cast(pa.binary()).to_pylist(), part.column("form").to_pylist(), strict=True)]
            texts = pa.array([None if p is None else spelled(p) for p in found], pa.binary()).cast(pa.string())
            digests = pa.array([None if p is None else sha256(p) for p in found], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, texts, digests], names=[*part.schema.names, "restored", "restored_sha256"])


def fill_in_middle(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output and its SHA-256 for every row of docs.

    A text is cut at two token boundaries that a hash of seed and doc_id names; form says how its parts are arranged: plain (as it is: an
    empty text, one that holds a sentinel, and a tenth of the others), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Cutting and
    arranging move descriptors alone; the output is spelled once. Nothing is shuffled.

    Null texts count as empty; a null doc_id counts as an empty text in the hash; repeated rows repeat their result; texts of any length are read
    span by span; further columns aren't read; an empty table gives an empty result.
    """
    return documents(docs).mapInArrow(lambda batches: transformed_batches(batches, seed), SCHEMA)


def restore(transformed: DataFrame) -> DataFrame:
    """transformed (output, form and whatever else) with the text restored from output and form alone, and its SHA-256.

    Both are null for a null output or form, for a form that is none, and where an output hasn't the sentinels of its form.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.mapInArrow(restored_batches, f"{schema}, {RESTORED}")


def round_trip(docs: DataFrame, seed: int = 1) -> DataFrame:
    """What fill_in_middle and restore give, without the texts: one pass, so that texts go to Python once and don't come back."""
    kept = [x for x in f"{SCHEMA}, {RESTORED}".split(", ") if x.split()[0] not in ("output", "restored")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in restored_batches(transformed_batches(batches, seed)):
            yield part.select([x.split()[0] for x in kept])

    return documents(docs).mapInArrow(run, ", ".join(kept))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM h),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
sha256(t) AS restored_sha256 FROM p
"""
