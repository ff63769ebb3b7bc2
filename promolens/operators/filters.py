"""Predicates on offers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions.validity import TZ, local_date, week_range

FRESH_DAYS = 8


def _today(as_of: datetime, tz: str) -> Column:
    return local_date(F.lit(as_of).cast("timestamp"), tz)


def like_any(columns: Sequence[str], words: Sequence[str]) -> Column:
    """Some column holds some word, whatever the case; % and _ are ordinary characters."""
    out = F.lit(False)
    for c in columns:
        low = F.lower(F.col(c))
        for w in words:
            out = out | F.contains(low, F.lit(w.lower()))
    return F.coalesce(out, F.lit(False))


def exclude_expired(df: DataFrame, as_of: datetime, tz: str = TZ) -> DataFrame:
    return df.filter(F.col("valid_to").isNull() | (F.col("valid_to") >= _today(as_of, tz)))


def exclude_stale(df: DataFrame, as_of: datetime, days: int = FRESH_DAYS) -> DataFrame:
    return df.filter(F.col("last_seen_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def overlaps_week(df: DataFrame, as_of: datetime, week: str = "current", tz: str = TZ) -> DataFrame:
    """Offers valid on some day of the week; open ends always match."""
    span = week_range(F.lit(as_of).cast("timestamp"), week, tz)
    if span is None:
        return df
    monday, sunday = span
    return df.filter((F.col("valid_from").isNull() | (F.col("valid_from") <= sunday)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= monday)))


def currently_valid(df: DataFrame, as_of: datetime, mode: str = "strict", tz: str = TZ) -> DataFrame:
    """Offers valid today. ``reference`` also passes expired ones without a start."""
    today = _today(as_of, tz)
    a, b = F.col("valid_from"), F.col("valid_to")
    if mode == "reference":
        return df.filter(a.isNull() | ((a <= today) & b.isNull()) | ((a <= today) & (b >= today)))
    return df.filter((a.isNull() | (a <= today)) & (b.isNull() | (b >= today)))


def expiring_soon(df: DataFrame, as_of: datetime, days: int = 2, tz: str = TZ) -> DataFrame:
    """Currently valid offers that end within ``days`` days."""
    return currently_valid(df, as_of, tz=tz).filter(F.col("valid_to") <= F.date_add(_today(as_of, tz), days))


def next_week_preview(df: DataFrame, as_of: datetime, tz: str = TZ) -> DataFrame:
    monday, sunday = week_range(F.lit(as_of).cast("timestamp"), "next", tz)
    return df.filter(F.col("valid_from").between(monday, sunday))


def optional_filters(df: DataFrame, max_price: float | None = None, category: str | None = None, stores: Sequence[str] = (), since: datetime | None = None) -> DataFrame:
    """Filters that are off where their value is missing."""
    if max_price is not None:
        df = df.filter(F.col("price") <= max_price)
    if category is not None:
        df = df.filter(like_any(["category"], [category]))
    if stores:
        df = df.filter(F.col("store").isin(*stores))
    if since is not None:
        df = df.filter(F.col("scraped_at") >= F.lit(since).cast("timestamp"))
    return df


def exclude_disallowed(urls: DataFrame, rules: DataFrame, url: str = "url", prefix: str = "prefix") -> DataFrame:
    """URLs whose path begins with no disallowed prefix.

    Of each path the prefixes as long as some rule meet the rules in an equi-join
    (lengths of URL paths are few; only these come to the driver). Spark broadcasts
    the rules where they are small.
    """
    lengths = sorted(r[0] for r in rules.select(F.length(prefix).alias("n")).filter("n > 0").distinct().collect())
    if not lengths:
        return urls
    path = F.regexp_extract(F.col(url), r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    fitting = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    hit = urls.select(url, F.explode(prefixes).alias(prefix)).join(rules.select(prefix), prefix, "left_semi").select(url).distinct()
    return urls.join(hit, url, "left_anti")
