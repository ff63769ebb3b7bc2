"""Vector and keyword search over offers and brochure pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.querytext import BROCHURE_WORDS
from promolens.functions.text import COMPARISON_TITLE, shorten
from promolens.functions.vectors import cosine, dot, norm

from .filters import currently_valid, like_any, optional_filters
from .search_blocks import nearest_in_parts


def with_analysis(offers: DataFrame, analyses: DataFrame) -> DataFrame:
    """Offers with verdict, score, tags and features where an analysis exists."""
    a = analyses.select(F.col("offer_id").alias("id"), "deal_verdict", "quality_score", "tags", "key_features")
    return offers.join(a, "id", "left")


def search_offers(
    offers: DataFrame, query: Sequence[float], cutoff: float = 0.6, max_price: float | None = None, category: str | None = None,
    limit: int = 20, since: datetime | None = None, digits: int | None = None,
) -> DataFrame:
    """Active offers most similar to a query vector: similarity descending, then id.

    Plain filters come before the cosine. Offers without a vector, or with a zero
    one, are not found. ``digits`` rounds the similarity before it is compared.
    """
    vector = F.array(*[F.lit(float(x)) for x in query])
    rows = optional_filters(offers.filter(F.col("is_active") & F.col("embedding").isNotNull()), max_price, category, (), since)
    value = cosine(F.col("embedding"), vector)
    scored = rows.withColumn("similarity", F.round(value, digits) if digits is not None else value)
    # the cutoff comes last: before the limit it would be evaluated with a second cosine in the scan
    return scored.orderBy(F.desc("similarity"), "id").limit(limit).filter(F.col("similarity") >= cutoff)


def nearest(queries: DataFrame, offers: DataFrame, k: int = 8, digits: int | None = None) -> DataFrame:
    """The k most similar offers of each query: (query_id, id, similarity, rank).

    ``queries`` has query_id, vector and cutoff; max_price, category, stores and
    min_discount narrow a query where they are there and not null. Parts of the
    queries meet parts of the offers in matrix products, so neither side need be
    small; both are counted first. Many offers are better searched by a
    ``VectorIndex`` where the cutoff is high.
    """
    return nearest_in_parts(queries, offers, k, digits)


def scored_pairs(queries: DataFrame, offers: DataFrame, digits: int | None = None) -> DataFrame:
    """Offers with each query whose conditions they meet, and their ``similarity``; queries are broadcast, offers may be a stream."""
    rules = {
        "max_price": lambda q: F.col("price") <= q,
        "category": lambda q: F.contains(F.lower("category"), F.lower(q)),
        "stores": lambda q: (F.size(q) == 0) | F.array_contains(q, F.col("store")),
        "min_discount": lambda q: F.col("discount_percent") >= q,
    }
    cond = F.lit(True)
    q = queries
    for name, rule in rules.items():
        if name in queries.columns:
            q = q.withColumnRenamed(name, f"q_{name}")
            cond = cond & F.coalesce(F.col(f"q_{name}").isNull() | rule(F.col(f"q_{name}")), F.lit(False))
    # lengths are computed once for each vector, not for each pair
    q = q.withColumn("q_norm", norm(F.col("vector")))
    rows = offers.filter(F.col("is_active") & F.col("embedding").isNotNull()).withColumn("o_norm", norm(F.col("embedding")))
    pairs = rows.join(F.broadcast(q), cond)
    value = dot(F.col("embedding"), F.col("vector")) / F.nullif(F.col("o_norm") * F.col("q_norm"), F.lit(0.0))
    value = F.when((F.size("embedding") == F.size("vector")) & ~F.isnan(value), value)
    return pairs.withColumn("similarity", F.round(value, digits) if digits is not None else value)


def latest_offers(offers: DataFrame, as_of: datetime, only_current: bool = False, mode: str = "strict", limit: int = 10) -> DataFrame:
    """Active offers: running ones first, then start (none last), discount, sighting."""
    rows = offers.filter("is_active")
    if only_current:
        rows = currently_valid(rows, as_of, mode)
    return rows.orderBy(
        F.asc("is_upcoming"), F.asc_nulls_last("valid_from"), F.desc_nulls_last("discount_percent"), F.desc("scraped_at"), "external_id"
    ).limit(limit)


def keyword_candidates(offers: DataFrame, words: Sequence[str], limit: int = 80) -> DataFrame:
    """Offers whose title holds one of the words, best discount first."""
    return offers.filter("is_active").filter(like_any(["title"], [w.replace("%", "").replace(",", "") for w in words])).orderBy(
        F.desc_nulls_last("discount_percent"), "external_id"
    ).limit(limit)


def search_brochure_pages(pages: DataFrame, query: str, stores: Sequence[str] = (), limit: int = 8) -> DataFrame:
    """Pages that hold a query word of three letters or more in title, brochure or store."""
    words = [w for w in query.lower().replace(",", " ").split() if len(w) >= 3 and w not in BROCHURE_WORDS[:4]]
    if stores:
        pages = pages.filter(like_any(["store"], stores))
    if words:
        pages = pages.filter(like_any(["title", "brochure_title", "store"], words))
    return pages.orderBy(F.desc("scraped_at"), "page_number", "external_id").limit(limit)


def latest_brochure_pages(pages: DataFrame, stores: Sequence[str] = (), limit: int = 8) -> DataFrame:
    return search_brochure_pages(pages, "", stores, limit)


def first_tier(tiers: Sequence[DataFrame]) -> DataFrame:
    """The rows of the first of several answers that is not empty, with its number as ``tier``."""
    tagged = [t.withColumn("tier", F.lit(k)) for k, t in enumerate(tiers)]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    return every.withColumn("__least", F.min("tier").over(Window.partitionBy(F.lit(0)))).filter("tier = __least").drop("__least")


def answer_candidates(offers: DataFrame, generic: bool, query: Sequence[float] | None, as_of: datetime, limit: int = 8) -> DataFrame:
    """What answers a question: current offers, then any, for a generic one; else similar ones, then current ones.

    Each tier has at most ``limit`` rows.
    """
    current, latest = latest_offers(offers, as_of, True, limit=limit), latest_offers(offers, as_of, limit=limit)
    if generic or query is None:
        return first_tier([current, latest])
    return first_tier([search_offers(offers, query, 0.5, limit=limit), current])


def cited_offers(candidates: DataFrame, citations: DataFrame, limit: int = 12) -> DataFrame:
    """Candidates that an answer cites, at most ``limit``."""
    return candidates.join(citations.select("id"), "id", "left_semi").orderBy("id").limit(limit)


def source_list(results: DataFrame, order: str = "rank", limit: int = 5) -> DataFrame:
    """The first results with a link, ranked before those without one are left out."""
    return results.filter(F.col(order) <= limit).filter(F.coalesce(F.trim("url"), F.lit("")) != "").orderBy(order)


def comparison_rows(results: DataFrame, limit: int = 6) -> DataFrame:
    return results.orderBy(F.desc("similarity"), "id").limit(limit).select(shorten(F.col("title"), COMPARISON_TITLE).alias("title"), "price", "discount_percent", "store", "deal_verdict")
