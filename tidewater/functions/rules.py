"""Record rules: cleaned values, and predicates that a record must pass."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions.text import clean_string, epoch_to_timestamp, is_uri, is_web_uri

# Fixed values.
KNOWN_SOURCES = [
    "Cointelegraph", "CoinDesk", "Decrypt", "The Block", "CryptoSlate", "Forbes Crypto",
    "Bloomberg Crypto", "Reuters Cryptocurrency", "Wall Street Journal Crypto", "Financial Times Crypto",
    "CNBC Crypto", "Yahoo Finance Crypto", "Business Insider Crypto", "MarketWatch Crypto",
    "Seeking Alpha Crypto", "The Motley Fool Crypto", "Investopedia Crypto", "Bitcoin Magazine",
    "Ethereum World News", "Bitcoin.com News", "CryptoNinjas", "AMBCrypto", "BeInCrypto",
    "Crypto Briefing", "CryptoPotato", "DailyCoin", "DailyHodl", "Finbold", "NewsBTC",
    "NullTX", "The Crypto Basic", "Trustnodes", "UToday", "ZyCrypto", "TechCrunch Crypto",
    "Wired Crypto", "Ars Technica Crypto", "Gizmodo Crypto", "Mashable Crypto", "The Verge Crypto",
]
#: How far ahead of the scrape a record may be dated, and the least headline.
AHEAD, MIN_HEADLINE = "1 HOUR", 10


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_id(c: Column) -> Column:
    return _true(c >= 0)


def same_category(category: Column, of_file: Column) -> Column:
    cleaned = clean_string(category)
    return _true((F.length(cleaned) > 0) & (F.lower(cleaned) == F.lower(of_file)))


def valid_epoch(seconds: Column, scraped_at: Column) -> Column:
    """Not negative, and at most an hour after the scrape."""
    return _true((seconds >= 0) & (epoch_to_timestamp(seconds) <= scraped_at + F.expr(f"INTERVAL {AHEAD}")))


def min_length(c: Column, n: int = 1) -> Column:
    return _true(F.length(clean_string(c)) >= n)


def known_source(c: Column, known: list[str] | None = None) -> Column:
    return _true(clean_string(c).isin(KNOWN_SOURCES if known is None else known))


def web_url(c: Column) -> Column:
    return is_web_uri(clean_string(c))


def image_url(c: Column) -> Column:
    """The trimmed url; null where it is blank or no web address."""
    return F.when(web_url(c), clean_string(c))


def summary_text(c: Column) -> Column:
    return F.coalesce(clean_string(c), F.lit(""))


def alphanumeric(c: Column) -> Column:
    return _true(c.rlike(r"^[\p{L}\p{N}]+$"))


def any_url(c: Column) -> Column:
    return is_uri(clean_string(c))


def count_or_zero(c: Column) -> Column:
    return F.when(c >= 0, c).otherwise(F.lit(0))


def unit_ratio(c: Column) -> Column:
    return F.coalesce(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def first_failure(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that fails; null where all hold."""
    return F.coalesce(*(F.when(~ok, F.lit(name)) for name, ok in rules))
