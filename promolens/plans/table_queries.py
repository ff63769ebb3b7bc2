"""Registered queries over tables that are kept up by batches: buckets, materialised scores, compaction."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators import history, scores, search
from promolens.operators.text_index import SubstringIndex
from promolens.operators.vector_index import VectorIndex
from promolens.sources.buckets import BucketTable
from promolens.sources.tables import append_history, compact_history, work_folder

from .queries import _history, _offers, _read, _score_columns, _tenths, ORACLE, query

_BATCHES = (datetime(2024, 1, 8, tzinfo=timezone.utc), datetime(2024, 1, 20, tzinfo=timezone.utc))


@query("bucketed_merge", """WITH s AS (SELECT user_id, event_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 0 WHEN ts < TIMESTAMP '2024-01-20' THEN 1 ELSE 2 END AS batch FROM events),
 g AS (SELECT user_id AS external_id, batch, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM s GROUP BY 1, 2)
 SELECT external_id, arg_min(first_event, batch) AS first_event, arg_max(last_event, batch) AS last_event, arg_max(n, batch) AS n FROM g GROUP BY 1""")
def bucketed_merge(spark, sf_dir):
    """Three batches of sightings, the second one twice."""
    events = _read(spark, sf_dir, "events")

    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("external_id")).agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))

    first, second = (F.col("ts") < F.lit(t) for t in _BATCHES)
    batches = [state(events.filter(first)), state(events.filter(~first & second)), state(events.filter(~second))]
    table = BucketTable(spark, work_folder(spark), batches[0].schema, ["external_id"], 16)
    for number in (0, 1, 1, 2):
        table.merge(batches[number], keep=["first_event"], batch=("crawl", number))
    return table.read()


def _last_day(spark, sf_dir) -> date:
    last = _read(spark, sf_dir, "lineitem").agg(F.to_date(F.max("l_shipdate"))).first()[0]
    return last or date(1970, 1, 1)


def _priced(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2).cast("decimal(10,2)").alias("price"))


@query("materialised_scores", ORACLE["deal_scores"])
def materialised_scores(spark, sf_dir):
    """Observations in three batches of any days, one of them twice, while the window moves on."""
    observed, last = _history(spark, sf_dir), _last_day(spark, sf_dir)
    part = F.pmod(F.xxhash64("external_id", "observed_at", "price"), F.lit(3))
    table = scores.DealScores(spark, work_folder(spark), last - timedelta(days=60), observed.schema["external_id"].dataType, buckets=16)
    table.add(observed.filter(part == 0), 0)
    table.advance(last - timedelta(days=20))
    table.add(observed.filter(part == 1), 1)
    table.add(observed.filter(part == 1), 1)
    table.advance(last)
    table.add(observed.filter(part == 2), 2)
    return _score_columns(table.scores(_priced(spark, sf_dir)))


@query("compacted_scores", ORACLE["deal_scores"])
def compacted_scores(spark, sf_dir):
    """Deal scores over a history of monthly folders after its compaction into buckets."""
    observed, last, folder = _history(spark, sf_dir), _last_day(spark, sf_dir), work_folder(spark)
    append_history(observed, f"{folder}/history", "b0")
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    compacted = compact_history(spark, f"{folder}/history", observed.schema, f"history_{uuid.uuid4().hex}", f"{folder}/compacted", buckets)
    return _score_columns(history.deal_scores(_priced(spark, sf_dir), compacted, datetime(last.year, last.month, last.day, tzinfo=timezone.utc)))


@query("daily_price_percentiles", """WITH h AS (SELECT l_partkey AS external_id, CAST(l_shipdate AS DATE) AS day, CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents FROM lineitem),
 d AS (SELECT external_id, day, min(cents) AS price FROM h GROUP BY 1, 2),
 c AS (SELECT d.external_id, d.day, price, count(*) AS n, count(*) FILTER (WHERE cents <= price) AS below FROM d JOIN h ON h.external_id = d.external_id AND h.day BETWEEN d.day - INTERVAL 90 DAY AND d.day GROUP BY 1, 2, 3)
 SELECT external_id, strftime(day, '%Y-%m-%d') AS day, price, n AS observations, CASE WHEN n >= 3 THEN (2 * below * 1000 + n) // (2 * n) END AS percentile_tenths FROM c""")
def daily_price_percentiles(spark, sf_dir):
    return history.daily_percentiles(_history(spark, sf_dir)).withColumn("day", F.col("day").cast("string"))


@query("indexed_nearest", """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
 p AS (SELECT q.id AS query_id, e.id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity FROM e, e AS q WHERE q.id % 20 = 0)
 SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM p WHERE similarity >= 0.6 QUALIFY rank <= 8""")
def indexed_nearest(spark, sf_dir):
    """Vectors whose id is divisible by 20 against all, through a stored index filled by two batches."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, work_folder(spark))
    index.fit(rows)
    for batch in (0, 1):
        index.insert(rows.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == batch), f"b{batch}")
    asked = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.search(asked, 8, 0.6, digits=6).withColumn("rank", F.col("rank").cast("long"))


@query("indexed_keywords", ORACLE["keyword_candidates"])
def indexed_keywords(spark, sf_dir):
    """Titles with one of two words, from a trigram index that two batches filled."""
    offers, words = _offers(spark, sf_dir), ["ring", "Milch"]
    index = SubstringIndex(spark, work_folder(spark), offers.schema, "external_id", ["title"], 16)
    for batch in (0, 1):
        index.insert(offers.filter(F.col("external_id") % 2 == batch), batch)
    return search.keyword_candidates(index.rows(words), words).select("external_id", "title", _tenths("discount_percent").alias("tenths"))


@query("indexed_brochures", ORACLE["brochure_search"])
def indexed_brochures(spark, sf_dir):
    """Pages with a word of the query, from a trigram index of all texts."""
    none = F.lit(None).cast("string")
    pages = _read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("external_id"), F.col("text").alias("title"), none.alias("brochure_title"), F.col("source").alias("store"), F.col("n_chars").alias("scraped_at"), F.col("doc_id").alias("page_number")
    )
    index = SubstringIndex(spark, work_folder(spark), pages.schema, "external_id", ["title", "brochure_title", "store"], 16)
    index.insert(pages, 0)
    found = search.search_brochure_pages(index.rows(["licensed", "apache"]), "Prospekt Licensed, Apache", ["src1"])
    return found.select(F.col("external_id").alias("doc_id"), "store")
