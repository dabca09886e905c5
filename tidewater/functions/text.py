"""Scalar text and time expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All Unicode white space, as a strip of text removes it.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def clean_string(c: Column) -> Column:
    """Trimmed of white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def is_web_uri(c: Column) -> Column:
    """http or https with a host; null is not."""
    return F.coalesce(c.rlike(r"^(?i:https?)://[^/?#]+"), F.lit(False))


def is_uri(c: Column) -> Column:
    """Any scheme with a host; null is not."""
    return F.coalesce(c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def parse_iso(c: Column) -> Column:
    """ISO 8601 text, Z or offset accepted, naive text as UTC (the session's zone); bad text gives null."""
    return F.try_to_timestamp(c)


def epoch_to_timestamp(c: Column) -> Column:
    """UNIX seconds, with a fraction or not, as a timestamp."""
    return F.timestamp_micros(F.round(c.cast("double") * 1_000_000).cast("long"))


def iso_seconds(ts: Column) -> Column:
    """A timestamp as ISO text in UTC, to the second, with Z."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_micros(ts: Column) -> Column:
    """A timestamp as ISO text without a zone; microseconds only where they aren't zero."""
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""))


def epoch_to_iso(c: Column) -> Column:
    return iso_seconds(epoch_to_timestamp(c))
