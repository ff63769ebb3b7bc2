"""Registered queries over the star tables, each with the SQL that DuckDB checks it by.

``part`` stands for offers, ``lineitem`` for price observations, ``supplier`` and
brands for stores, ``orders`` for validity windows, ``events`` for sightings and
labels, ``embeddings`` for vectors, ``pages`` for crawled pages, ``conversations``
for messages, ``documents`` for brochure pages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.functions import prices, querytext, taxonomy, text, validity, vectors
from promolens.operators import alerts, filters, history, labels, merge, search, stats
from promolens.sources import listings

AS_OF = datetime(2024, 1, 20, 12, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TITLES = (
    "Ariel Pods", "iPhone 15", "Krombacher 24x500ml", "Katzenfutter Huhn", "Laptop 14 Zoll", "Hose blau", "Apfel rot", "Milch 1l", "Brot frisch", "Kaffee Kasten",
    "Dashö Müsli", "Shampoo 250 ml", "Rasenmäher", "Reis 1kg", "Unbekanntes", "Cola 12er Pack", "Lego Set", "Gin Tonic", "Öl nativ", "Sekt 6 x 0,75l",
)
SOURCE_PATHS = (
    ("Lebensmittel und Getränke", "Lebensmittel und Getränke > Produkte > Getränke > Bier"),
    ("Lebensmittel und Getränke", "Lebensmittel und Getränke > Produkte > Marken Lebensmittel"),
    ("Drogerie und Haushalt", "Drogerie und Haushalt > Produkte > Drogerie"),
    ("Drogerie und Haushalt", "Drogerie und Haushalt"), ("Möbel und Wohnen", "Möbel und Wohnen > Sofa"), ("Fremd", "Fremd > Mehr"), (None, None),
)
STORES = ("Lidl", "Globus", "Globus-Baumarkt", "ROSSMANN", "MÜLLER", "Norma", "Normal", "Möbelhaus", " dm Markt", "Real")


def _sql(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pick(values: tuple, key: str) -> str:
    """DuckDB: the value at key modulo the list's length."""
    return f"([{', '.join(map(_sql, values))}])[1 + CAST({key} % {len(values)} AS INTEGER)]"


def _pick_col(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


#: The offers that ``_offers`` makes, for DuckDB.
OFFERS_SQL = f"""offers AS (SELECT p_partkey AS external_id, p_partkey AS id, {_pick(TITLES, 'p_partkey')} || ' ' || p_name AS title, p_brand AS brand,
  {_pick(STORES, 'p_partkey')} AS store, p_type AS category, {_pick(tuple(a for a, _ in SOURCE_PATHS), 'p_partkey')} AS source_category,
  {_pick(tuple(b for _, b in SOURCE_PATHS), 'p_partkey')} AS source_category_path, CAST(round(p_retailprice * 100) AS BIGINT) AS cents,
  CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE (p_partkey * 37) % 1000 END AS tenths,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 40 AS INTEGER) END AS valid_from,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 40 + p_size % 14 AS INTEGER) END AS valid_to,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((p_partkey * 13) % 480 AS INTEGER)) AS scraped_at, p_size % 10 <> 0 AS is_active FROM part)"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers from ``part``: derived titles, stores, categories, discounts, windows and sightings."""
    k = F.col("p_partkey")
    start = F.date_add(F.lit(date(2024, 1, 1)), (k % 40).cast("int"))
    seen = F.timestamp_seconds(F.lit(1704067200) + (k * 13) % 480 * 3600)
    return _read(spark, sf_dir, "part").select(
        k.alias("external_id"), k.alias("id"), F.concat_ws(" ", _pick_col(TITLES, k), F.col("p_name")).alias("title"), F.col("p_brand").alias("brand"),
        _pick_col(STORES, k).alias("store"), F.col("p_type").alias("category"),
        _pick_col(tuple(a for a, _ in SOURCE_PATHS), k).alias("source_category"), _pick_col(tuple(b for _, b in SOURCE_PATHS), k).alias("source_category_path"),
        F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2).cast("decimal(10,2)").alias("price"),
        F.when(k % 11 != 0, ((k * 37) % 1000).cast("decimal(5,1)") / 10).cast("decimal(5,1)").alias("discount_percent"),
        F.when(k % 7 != 0, start).alias("valid_from"), F.when(k % 5 != 0, F.date_add(start, (F.col("p_size") % 14).cast("int"))).alias("valid_to"),
        seen.alias("scraped_at"), seen.alias("last_seen_at"), (F.col("p_size") % 10 != 0).alias("is_active"),
        F.coalesce(start > F.lit(date(2024, 1, 20)), F.lit(False)).alias("is_upcoming"),
    )


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations from ``lineitem``: unit prices in whole cents."""
    cents, n = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    unit = F.expr("(2 * ext + n) div (2 * n)")
    return _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("external_id"), cents.alias("ext"), n.alias("n"), F.col("l_shipdate").alias("observed_at")).select(
        "external_id", (unit.cast("decimal(18,0)") / 100).cast("decimal(10,2)").alias("price"), "observed_at"
    )


def _cents(c: str) -> Column:
    return (F.col(c) * 100).cast("long")


def _tenths(c: str) -> Column:
    return (F.col(c) * 10).cast("long")


def query(name: str, oracle: str | None = None):
    """Registers a query; the session's time zone is UTC while it is planned (expressions keep it)."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            before = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            try:
                return f(spark, sf_dir)
            finally:
                spark.conf.set("spark.sql.session.timeZone", before)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return add


_SCORES = """hist AS (SELECT l_partkey AS external_id, CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS BIGINT) AS h, l_shipdate
  FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 90 DAY),
 now AS (SELECT p_partkey AS external_id, CAST(round(p_retailprice * 100) AS BIGINT) AS p FROM part),
 s AS (SELECT external_id, count(*) AS n, CAST(sum(h) AS BIGINT) AS total, min(h) AS low, max(h) AS high, count(*) FILTER (WHERE h <= p) AS below FROM hist JOIN now USING (external_id) GROUP BY 1),
 m AS (SELECT *, (2 * total + n) // (2 * n) AS mean FROM s),
 scores AS (SELECT now.external_id, p AS price_cents, mean AS avg_cents, low AS min_cents, high AS max_cents, n AS observation_count,
  CASE WHEN n >= 3 AND mean > 0 THEN CASE WHEN mean < p THEN -((2 * (p - mean) * 1000 + mean) // (2 * mean)) ELSE (2 * (mean - p) * 1000 + mean) // (2 * mean) END END AS below_avg_tenths,
  CASE WHEN n >= 3 THEN (2 * below * 1000 + n) // (2 * n) END AS percentile_tenths FROM now LEFT JOIN m USING (external_id))"""
_SCORE_COLUMNS = "external_id, price_cents, CAST(avg_cents AS BIGINT) AS avg_cents, min_cents, max_cents, observation_count, CAST(below_avg_tenths AS BIGINT) AS below_avg_tenths, CAST(percentile_tenths AS BIGINT) AS percentile_tenths"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = _history(spark, sf_dir)
    as_of = _read(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).first()[0] or datetime(1970, 1, 1)
    offers = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2).cast("decimal(10,2)").alias("price"))
    return history.deal_scores(offers, observed, as_of.replace(tzinfo=timezone.utc))


def _score_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "external_id", _cents("price").alias("price_cents"), _cents("avg_price_90d").alias("avg_cents"), _cents("min_price_90d").alias("min_cents"),
        _cents("max_price_90d").alias("max_cents"), "observation_count", _tenths("pct_below_avg").alias("below_avg_tenths"), _tenths("price_percentile").alias("percentile_tenths"),
    )


@query("deal_scores", f"WITH {_SCORES} SELECT {_SCORE_COLUMNS} FROM scores")
def deal_scores(spark, sf_dir):
    return _score_columns(_scores(spark, sf_dir))


@query("top_deals", f"WITH {_SCORES} SELECT {_SCORE_COLUMNS} FROM scores WHERE percentile_tenths IS NOT NULL ORDER BY percentile_tenths, external_id LIMIT 30")
def top_deals(spark, sf_dir):
    return _score_columns(history.top_deals(_scores(spark, sf_dir)))


@query("price_series", """WITH best AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 1)
 SELECT l_partkey AS external_id, CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS BIGINT) AS cents, strftime(l_shipdate, '%Y-%m-%d') AS day
 FROM lineitem WHERE l_partkey = (SELECT l_partkey FROM best) ORDER BY l_shipdate, cents LIMIT 500""")
def price_series(spark, sf_dir):
    observed = _history(spark, sf_dir)
    best = observed.groupBy("external_id").count().orderBy(F.desc("count"), "external_id").first()
    rows = history.price_series(observed, F.lit(best[0] if best else None))
    return rows.select("external_id", _cents("price").alias("cents"), F.date_format("observed_at", "yyyy-MM-dd").alias("day"))


@query("latest_labels", "SELECT user_id AS external_id, event_type AS category, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_labels(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("user_id").alias("external_id"), F.col("event_type").alias("category"), F.col("event_id").alias("model_version"), F.col("ts").alias("classified_at"))
    return labels.latest_labels(rows).select("external_id", "category", F.col("model_version").alias("event_id"))


@query("pending_labels", f"WITH {OFFERS_SQL} SELECT external_id, title FROM offers o WHERE is_active AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = o.external_id AND year(l_shipdate) = 2001)")
def pending_labels(spark, sf_dir):
    done = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("external_id"), F.year("l_shipdate").cast("string").alias("model_version"))
    return labels.pending_labels(_offers(spark, sf_dir), done, "2001").select("external_id", "title")


@query("pending_labels_first", f"WITH {OFFERS_SQL} SELECT external_id, title FROM offers o WHERE is_active AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = o.external_id AND year(l_shipdate) = 2001) ORDER BY scraped_at DESC, external_id LIMIT 50")
def pending_labels_first(spark, sf_dir):
    done = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("external_id"), F.year("l_shipdate").cast("string").alias("model_version"))
    return labels.pending_labels(_offers(spark, sf_dir), done, "2001", 50).select("external_id", "title")


@query("pending_labels_forced", f"WITH {OFFERS_SQL} SELECT external_id, title FROM offers WHERE is_active")
def pending_labels_forced(spark, sf_dir):
    """All active offers again, whatever labels they have."""
    done = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("external_id"), F.year("l_shipdate").cast("string").alias("model_version"))
    return labels.pending_labels(_offers(spark, sf_dir), done, "2001", force=True).select("external_id", "title")


@query("dedupe_first_seen", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first_seen(spark, sf_dir):
    return merge.dedupe_first(_read(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("merge_snapshot", """WITH old AS (SELECT user_id AS external_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1),
 new AS (SELECT user_id AS external_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1)
 SELECT coalesce(new.external_id, old.external_id) AS external_id, coalesce(old.first_event, new.first_event) AS first_event, coalesce(new.last_event, old.last_event) AS last_event, coalesce(new.n, old.n) AS n
 FROM old FULL JOIN new USING (external_id)""")
def merge_snapshot(spark, sf_dir):
    def state(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("user_id").alias("external_id")).agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n"))

    events, cut = _read(spark, sf_dir, "events"), F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc))
    return merge.merge_by_key(state(events.filter(F.col("ts") < cut)), state(events.filter(F.col("ts") >= cut)), ["external_id"], keep=["first_event"])


_SEEN = """seen AS (SELECT user_id AS external_id, max(ts) AS last_seen_at, max(event_id) % 3 <> 0 AS has_vector, max(event_id) % 4 <> 0 AS is_active FROM events GROUP BY 1)"""


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("external_id")).agg(F.max("ts").alias("last_seen_at"), F.max("event_id").alias("e")).select(
        "external_id", "last_seen_at", F.when(F.col("e") % 3 != 0, F.array(F.lit(1.0).cast("float"))).alias("embedding"), (F.col("e") % 4 != 0).alias("is_active"), F.col("last_seen_at").alias("updated_at"),
    )


@query("retention", f"WITH {_SEEN}, r AS (SELECT *, last_seen_at < TIMESTAMP '2024-01-28 12:00:00' AS old FROM seen) SELECT external_id, is_active AND NOT old AS is_active, has_vector AND NOT old AS has_vector FROM r")
def retention(spark, sf_dir):
    rows = merge.apply_retention(_seen(spark, sf_dir), datetime(2024, 1, 30, 12, tzinfo=timezone.utc), 2)
    return rows.select("external_id", "is_active", F.col("embedding").isNotNull().alias("has_vector"))


@query("retention_preview", f"WITH {_SEEN} SELECT count(*) FILTER (WHERE is_active AND last_seen_at < TIMESTAMP '2024-01-28 12:00:00') AS deactivated, count(*) FILTER (WHERE has_vector AND last_seen_at < TIMESTAMP '2024-01-28 12:00:00') AS embeddings_cleared FROM seen")
def retention_preview(spark, sf_dir):
    return merge.retention_preview(_seen(spark, sf_dir), datetime(2024, 1, 30, 12, tzinfo=timezone.utc), 2)


_WINDOW = "strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to"


def _window_columns(df: DataFrame, *more) -> DataFrame:
    return df.select("external_id", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), *more)


for _name, _week, _from, _to in (("week_current", "current", "2024-01-15", "2024-01-21"), ("week_next", "next", "2024-01-22", "2024-01-28")):

    @query(_name, f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE (valid_from IS NULL OR valid_from <= DATE '{_to}') AND (valid_to IS NULL OR valid_to >= DATE '{_from}')")
    def _week_query(spark, sf_dir, week=_week):
        return _window_columns(filters.overlaps_week(_offers(spark, sf_dir), AS_OF, week))


@query("currently_valid_strict", f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND (valid_to IS NULL OR valid_to >= DATE '2024-01-20')")
def currently_valid_strict(spark, sf_dir):
    return _window_columns(filters.currently_valid(_offers(spark, sf_dir), AS_OF))


@query("currently_valid_reference", f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE valid_from IS NULL OR (valid_from <= DATE '2024-01-20' AND (valid_to IS NULL OR valid_to >= DATE '2024-01-20'))")
def currently_valid_reference(spark, sf_dir):
    return _window_columns(filters.currently_valid(_offers(spark, sf_dir), AS_OF, "reference"))


@query("fresh_offers", f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE (valid_to IS NULL OR valid_to >= DATE '2024-01-20') AND scraped_at >= TIMESTAMP '2024-01-12 12:00:00'")
def fresh_offers(spark, sf_dir):
    return _window_columns(filters.exclude_stale(filters.exclude_expired(_offers(spark, sf_dir), AS_OF), AS_OF))


@query("expiring_soon", f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND valid_to BETWEEN DATE '2024-01-20' AND DATE '2024-01-22'")
def expiring_soon(spark, sf_dir):
    return _window_columns(filters.expiring_soon(_offers(spark, sf_dir), AS_OF))


@query("next_week_preview", f"WITH {OFFERS_SQL} SELECT external_id, {_WINDOW} FROM offers WHERE valid_from BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'")
def next_week_preview(spark, sf_dir):
    return _window_columns(filters.next_week_preview(_offers(spark, sf_dir), AS_OF))


@query("latest_offers", f"""WITH {OFFERS_SQL}, t AS (SELECT *, DATE '2024-01-01' + CAST(external_id % 40 AS INTEGER) > DATE '2024-01-20' AS is_upcoming FROM offers WHERE is_active)
 SELECT external_id, {_WINDOW}, is_upcoming FROM (SELECT * FROM t ORDER BY is_upcoming, valid_from ASC NULLS LAST, tenths DESC NULLS LAST, scraped_at DESC, external_id LIMIT 25)""")
def latest_offers(spark, sf_dir):
    return _window_columns(search.latest_offers(_offers(spark, sf_dir), AS_OF, limit=25), "is_upcoming")


@query("optional_filters", f"WITH {OFFERS_SQL} SELECT external_id, cents FROM offers WHERE cents <= 95000 AND category ILIKE '%eco%' AND store IN ('Lidl', 'Norma') AND scraped_at >= TIMESTAMP '2024-01-05'")
def optional_filters(spark, sf_dir):
    rows = filters.optional_filters(_offers(spark, sf_dir), 950, "eco", ["Lidl", "Norma"], datetime(2024, 1, 5, tzinfo=timezone.utc))
    return rows.select("external_id", _cents("price").alias("cents"))


@query("keyword_candidates", f"WITH {OFFERS_SQL} SELECT external_id, title, tenths FROM offers WHERE is_active AND (title ILIKE '%ring%' OR title ILIKE '%milch%') ORDER BY tenths DESC NULLS LAST, external_id LIMIT 80")
def keyword_candidates(spark, sf_dir):
    return search.keyword_candidates(_offers(spark, sf_dir), ["ring", "Milch"]).select("external_id", "title", _tenths("discount_percent").alias("tenths"))


def _vector_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("category"), (F.col("vec_id") % 100).cast("decimal(10,2)").alias("price"),
        (F.col("vec_id") % 13 != 0).alias("is_active"), F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("store"), (F.col("vec_id") % 90).cast("decimal(5,1)").alias("discount_percent"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("vec_id") % 480 * 3600).alias("scraped_at"),
    )


_VECTORS = "o AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, CAST(label AS VARCHAR) AS category, vec_id % 100 AS price, 's' || (vec_id % 4) AS store, vec_id % 90 AS discount, vec_id % 480 AS hour FROM embeddings WHERE vec_id % 13 <> 0)"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = _read(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()
    return list(row[0]) if row else []


@query("cosine_topk", f"WITH {_VECTORS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT id, round(list_cosine_similarity(e, v), 6) AS similarity FROM o, q WHERE round(list_cosine_similarity(e, v), 6) >= 0.2 ORDER BY similarity DESC, id LIMIT 20")
def cosine_topk(spark, sf_dir):
    return search.search_offers(_vector_offers(spark, sf_dir), _first_vector(spark, sf_dir), 0.2, digits=6).select("id", "similarity")


@query("search_offers_since", f"WITH {_VECTORS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1) SELECT id, round(list_cosine_similarity(e, v), 6) AS similarity FROM o, q WHERE round(list_cosine_similarity(e, v), 6) >= 0.05 AND price <= 60 AND category ILIKE '%3%' AND hour >= 96 ORDER BY similarity DESC, id LIMIT 10")
def search_offers_since(spark, sf_dir):
    rows = search.search_offers(_vector_offers(spark, sf_dir), _first_vector(spark, sf_dir), 0.05, 60, "3", 10, datetime(2024, 1, 5, tzinfo=timezone.utc), 6)
    return rows.select("id", "similarity")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved searches: the vectors whose id is divisible by 20."""
    v = F.col("vec_id")
    return _read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(
        v.alias("id"), (v % 7).alias("user_id"), F.concat(F.lit("a"), v.cast("string")).alias("name"), F.col("embedding").alias("query_embedding"), F.lit(0.1).alias("similarity_threshold"),
        F.when(v % 3 != 0, F.lit(70)).cast("decimal(10,2)").alias("max_price"), F.lit(True).alias("is_active"),
        F.when(v % 40 == 0, F.array(F.lit("s1"), F.lit("s2"))).alias("stores"), F.when(v % 100 == 0, F.lit(30)).cast("decimal(5,1)").alias("min_discount"), F.lit(None).cast("array<string>").alias("categories"),
    )


_ALERTS = f"""{_VECTORS}, a AS (SELECT vec_id AS alert_id, vec_id % 7 AS user_id, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 3 <> 0 THEN 70 END AS max_price, vec_id % 40 = 0 AS picky, CASE WHEN vec_id % 100 = 0 THEN 30 END AS min_discount FROM embeddings WHERE vec_id % 20 = 0)"""
_MATCHES = f"""{_ALERTS},
 pairs AS (SELECT alert_id, user_id, id, round(list_cosine_similarity(e, v), 6) AS similarity FROM o, a WHERE hour >= 300 AND (max_price IS NULL OR price <= max_price) AND (NOT picky OR store IN ('s1', 's2')) AND (min_discount IS NULL OR discount >= min_discount)),
 matches AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY similarity DESC, id) AS rank FROM pairs WHERE similarity >= 0.1 QUALIFY rank <= 8)"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.match_alerts(_alerts(spark, sf_dir), _vector_offers(spark, sf_dir), AS_OF, days=7, digits=6)


@query("alert_topk", f"WITH {_MATCHES} SELECT alert_id, id, similarity, rank FROM matches")
def alert_topk(spark, sf_dir):
    return _matches(spark, sf_dir).withColumn("rank", F.col("rank").cast("long"))


@query("alert_topk_loose", f"""WITH {_ALERTS}, pairs AS (SELECT alert_id, id, round(list_cosine_similarity(e, v), 6) AS similarity FROM o, a WHERE hour >= 300 AND (max_price IS NULL OR price <= max_price))
 SELECT alert_id, id, similarity, row_number() OVER (PARTITION BY alert_id ORDER BY similarity DESC, id) AS rank FROM pairs WHERE similarity >= 0.1 QUALIFY rank <= 8""")
def alert_topk_loose(spark, sf_dir):
    """Without the alerts' stores and least discounts."""
    rows = alerts.match_alerts(_alerts(spark, sf_dir), _vector_offers(spark, sf_dir), AS_OF, days=7, strict=False, digits=6)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query("alert_digests", f"""WITH {_MATCHES}, sections AS (SELECT alert_id, user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) AS ids, count(*) AS n FROM matches WHERE rank <= 5 GROUP BY 1, 2)
 SELECT user_id, string_agg(alert_id || ':' || ids, ';' ORDER BY alert_id) AS sections, CAST(sum(n) AS BIGINT) AS n_offers FROM sections GROUP BY 1""")
def alert_digests(spark, sf_dir):
    rows = alerts.build_digests(_matches(spark, sf_dir), _alerts(spark, sf_dir))
    part = F.transform("sections", lambda s: F.concat(s["alert_id"].cast("string"), F.lit(":"), F.array_join(s["offer_ids"].cast("array<string>"), ",")))
    return rows.select("user_id", F.array_join(part, ";").alias("sections"), "n_offers")


@query("resolve_users", """WITH c AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN 't' || o_custkey END AS t, CASE WHEN o_orderkey % 4 <> 0 THEN 'm' || o_custkey END AS m FROM orders),
 u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 2 = 0 THEN 't' || c_custkey END AS t, CASE WHEN c_custkey % 5 <> 0 THEN 'm' || c_custkey END AS m FROM customer)
 SELECT c.t AS telegram_chat_id, c.m AS email, coalesce(a.id, b.id, substr(sha256(coalesce('t:' || c.t, 'e:' || c.m)), 1, 32)) AS user_id FROM c LEFT JOIN u a ON c.t = a.t LEFT JOIN u b ON c.m = b.m""")
def resolve_users(spark, sf_dir):
    def named(prefix: str, key: str, cond: str) -> Column:
        return F.when(F.expr(cond), F.concat(F.lit(prefix), F.col(key).cast("string")))

    contacts = _read(spark, sf_dir, "orders").select(named("t", "o_custkey", "o_orderkey % 3 <> 0").alias("telegram_chat_id"), named("m", "o_custkey", "o_orderkey % 4 <> 0").alias("email")).distinct()
    users = _read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), named("t", "c_custkey", "c_custkey % 2 = 0").alias("telegram_chat_id"), named("m", "c_custkey", "c_custkey % 5 <> 0").alias("email"))
    return alerts.resolve_users(contacts, users)[0]


_HITS = f"{OFFERS_SQL}, hits AS (SELECT external_id, cents, coalesce(store, 'Unbekannt') AS store FROM offers WHERE is_active AND title ILIKE '%gear%' ORDER BY cents ASC NULLS LAST, external_id LIMIT 100)"


@query("compare_stores", f"WITH {_HITS} SELECT store, count(*) AS n, min(cents) AS min_cents FROM hits GROUP BY 1")
def compare_stores(spark, sf_dir):
    return stats.compare_stores(_offers(spark, sf_dir), "gear")[0].select("store", "n", _cents("min_price").alias("min_cents"))


@query("compare_store_offers", f"WITH {_HITS} SELECT store, external_id, cents FROM hits QUALIFY row_number() OVER (PARTITION BY store ORDER BY cents, external_id) <= 8")
def compare_store_offers(spark, sf_dir):
    return stats.compare_stores(_offers(spark, sf_dir), "gear")[1].select("store", "external_id", _cents("price").alias("cents"))


@query("store_options", f"""WITH {OFFERS_SQL} SELECT store, count(*) AS n, CASE WHEN regexp_matches(trim(store), '(?i)^(lidl|globus($|[^-])|norma\\b|real\\b)') THEN 'supermarket' WHEN regexp_matches(trim(store), '(?i)^(dm|rossmann|müller)') THEN 'drugstore' ELSE 'other' END AS store_class
 FROM offers WHERE is_active GROUP BY 1""")
def store_options(spark, sf_dir):
    return stats.store_options(_offers(spark, sf_dir))


@query("top_groups", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def top_groups(spark, sf_dir):
    return stats.top_groups(_offers(spark, sf_dir), "brand")


@query("ingestion_trend", """WITH c AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1),
 days AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM c), DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS d) SELECT strftime(days.d, '%Y-%m-%d') AS day, coalesce(n, 0) AS n FROM days LEFT JOIN c ON c.d = days.d""")
def ingestion_trend(spark, sf_dir):
    rows = stats.ingestion_trend(_read(spark, sf_dir, "events").filter("event_type = 'signup'"), "ts", date(2024, 2, 5))
    return rows.select(F.col("day").cast("string").alias("day"), "n")


@query("market_kpis", f"""WITH {OFFERS_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND (valid_to IS NULL OR valid_to >= DATE '2024-01-20')) AS current,
 count(*) FILTER (WHERE valid_from > DATE '2024-01-20') AS upcoming, count(DISTINCT store) AS stores, count(*) FILTER (WHERE tenths > 0) AS discounted, count(*) FILTER (WHERE tenths >= 250) AS pool,
 CAST(floor(avg(tenths) FILTER (WHERE tenths > 0)) AS BIGINT) AS mean_tenths FROM offers""")
def market_kpis(spark, sf_dir):
    rows = stats.market_kpis(_offers(spark, sf_dir), date(2024, 1, 20))
    return rows.select("total", "current", "upcoming", "stores", "discounted", "pool", F.floor(F.col("mean_discount") * 10).cast("long").alias("mean_tenths"))


def _rule_sql(title: str = "title", category: str = "category") -> str:
    """The classifier as a DuckDB CASE over a title and a category, rule by rule."""
    norm = "trim(regexp_replace(replace(replace(replace(replace(regexp_replace(lower({0}), '[-_./]', ' ', 'g'), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '\\s+', ' ', 'g'))"
    out = []
    for k, (b, s, p) in enumerate(taxonomy.BRAND_RULES):
        pattern = p.replace("'", "''")
        out.append(f"WHEN regexp_matches({title}, '(?i)(^|[^A-Za-z0-9_])({pattern})($|[^A-Za-z0-9_])') THEN {_sql(b + '/' + s)}")
    stages = [(title, rule) for rule in taxonomy.KEYWORD_RULES] + [(f"coalesce({category}, {title})", rule) for rule in taxonomy.CATEGORY_RULES]
    for source, (b, s, words) in stages:
        tests = []
        for w in words:
            key = w.lower()
            for x, y in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("-", " "), ("_", " "), (".", " "), ("/", " ")):
                key = key.replace(x, y)
            key = " ".join(key.split())
            padded = f"(' ' || {norm.format(source)} || ' ')"
            tests.append(f"contains({padded}, {_sql(key if len(key) > 4 else f' {key} ')})")
        out.append(f"WHEN {' OR '.join(tests)} THEN {_sql(b + '/' + s)}")
    return "CASE " + " ".join(out) + " ELSE 'Sonstiges/Sonstige' END"


_RULED = f"{OFFERS_SQL}, ruled AS (SELECT *, {_rule_sql()} AS pair FROM offers)"
_SOURCE_SQL = "CASE source_category_path " + " ".join(
    f"WHEN {_sql(p)} THEN {_sql(b)}" for (_, p), b in zip(SOURCE_PATHS, ("Getränke", "Lebensmittel", "Drogerie & Kosmetik", "Haushalt & Reinigung", "Garten & Heimwerken"), strict=False)
) + " END"


@query("classify_titles", f"WITH {_RULED} SELECT external_id, title, pair FROM ruled")
def classify_titles(spark, sf_dir):
    pair = taxonomy.classify(F.col("title"), F.col("category"))
    return _offers(spark, sf_dir).select("external_id", "title", F.concat_ws("/", pair["bucket"], pair["subcategory"]).alias("pair"))


_WORDS = ("actimel", "Akku-Rasenmäher", "Angebot", "Bio-Lachs", "hund", "Alpro Drink", "Fischöl", "apfeltasche", "Frosch", "Aktenschrank", "Florida-Eis", "ariel")


@query("classify_texts", f"""WITH t AS (SELECT p_partkey AS external_id, {_pick(_WORDS, 'p_partkey')} || ' ' || p_name AS text FROM part)
 SELECT external_id, {_rule_sql('text', 'NULL')} AS pair FROM t""")
def classify_texts(spark, sf_dir):
    """One text that is title and category at once."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.concat_ws(" ", _pick_col(_WORDS, F.col("p_partkey")), F.col("p_name")).alias("text"))
    return rows.withColumn("pair", taxonomy.classify(F.col("text"))).select("external_id", F.concat_ws("/", "pair.bucket", "pair.subcategory").alias("pair"))


@query("source_bucket", f"WITH {OFFERS_SQL} SELECT external_id, {_SOURCE_SQL} AS bucket FROM offers")
def source_bucket(spark, sf_dir):
    return _offers(spark, sf_dir).select("external_id", taxonomy.source_bucket(F.col("source_category"), F.col("source_category_path")).alias("bucket"))


_PAIRS = ", ".join(f"({_sql(b)}, {_sql(s)})" for b, subs in taxonomy.TAXONOMY.items() for s in subs)


@query("category_counts", f"""WITH {_RULED}, b AS (SELECT coalesce({_SOURCE_SQL}, split_part(pair, '/', 1)) AS bucket, substr(pair, instr(pair, '/') + 1) AS subcategory FROM ruled),
 c AS (SELECT bucket, subcategory, count(*) AS n FROM b GROUP BY 1, 2), t(bucket, subcategory) AS (VALUES {_PAIRS})
 SELECT coalesce(c.bucket, t.bucket) AS bucket, coalesce(c.subcategory, t.subcategory) AS subcategory, coalesce(n, 0) AS n FROM c FULL JOIN t ON c.bucket = t.bucket AND c.subcategory = t.subcategory""")
def category_counts(spark, sf_dir):
    return stats.category_counts(stats.with_buckets(_offers(spark, sf_dir)))


_TRUST = """CASE WHEN tenths IS NULL THEN 'trusted' WHEN tenths > 950 THEN 'implausible' WHEN tenths > 850 THEN 'suspect'
 WHEN tenths > 700 AND regexp_matches(lower(title), '(^|[^a-z0-9_])(\\d+\\s*er[-\\s]*pack|\\d+\\s*[x×]\\s*[\\d.,]+\\s*(l|ml|cl|g|kg|stk|st\\.)|kasten($|[^a-z0-9_]))') THEN 'suspect' ELSE 'trusted' END"""


@query("discount_trust", f"WITH {OFFERS_SQL} SELECT external_id, {_TRUST} AS trust, CASE WHEN tenths IS NULL OR tenths <= 950 THEN tenths END AS eff_tenths FROM offers")
def discount_trust(spark, sf_dir):
    t, d = F.col("title"), F.col("discount_percent")
    return _offers(spark, sf_dir).select("external_id", prices.discount_trust(t, d).alias("trust"), (prices.effective_discount(t, d) * 10).cast("long").alias("eff_tenths"))


_FEED = f"""{_SCORES}, {_RULED}, cut AS (SELECT * FROM ruled WHERE is_active ORDER BY tenths DESC NULLS LAST, external_id LIMIT 1000),
 feed AS (SELECT external_id, split_part(pair, '/', 1) AS bucket, tenths, {_TRUST} AS trust, CASE WHEN tenths <= 950 THEN tenths END AS eff FROM cut)"""


@query("personal_feed", f"""WITH {_FEED} SELECT external_id, bucket, CAST(coalesce(eff, 0) + CASE WHEN percentile_tenths <= 200 THEN 150 ELSE 0 END AS BIGINT) AS boost_tenths FROM feed LEFT JOIN scores USING (external_id)
 WHERE bucket IN ('Lebensmittel', 'Getränke') ORDER BY boost_tenths DESC, tenths DESC NULLS LAST, external_id LIMIT 60""")
def personal_feed(spark, sf_dir):
    rows = stats.personal_feed(_offers(spark, sf_dir), _scores(spark, sf_dir), ["Lebensmittel", "Getränke"])
    return rows.select("external_id", "bucket", _tenths("boost").alias("boost_tenths"))


@query("bargain_radar", f"WITH {_FEED} SELECT external_id, bucket, eff AS eff_tenths FROM feed WHERE bucket NOT IN ('Lebensmittel', 'Getränke') AND trust = 'trusted' AND eff >= 500 ORDER BY eff DESC, external_id LIMIT 24")
def bargain_radar(spark, sf_dir):
    return stats.bargain_radar(_offers(spark, sf_dir), ["Lebensmittel", "Getränke"], 50).select("external_id", "bucket", _tenths("eff").alias("eff_tenths"))


@query("compute_discount", """WITH p AS (SELECT p_partkey, 100 + (p_partkey * 31) % 900 AS a, 100 + (p_partkey * 77) % 1900 AS b, p_size % 7 = 0 AS ranged FROM part), d AS (SELECT *, (2 * (b - a) * 1000 + b) // (2 * b) AS t FROM p WHERE b > a)
 SELECT p.p_partkey AS external_id, CASE WHEN p.b > p.a AND NOT p.ranged AND d.t < 900 THEN d.t END AS tenths FROM p LEFT JOIN d USING (p_partkey)""")
def compute_discount(spark, sf_dir):
    k = F.col("p_partkey")
    a, b = (F.lit(100) + (k * 31) % 900).cast("decimal(10,2)"), (F.lit(100) + (k * 77) % 1900).cast("decimal(10,2)")
    return _read(spark, sf_dir, "part").select(k.alias("external_id"), (prices.compute_discount(a, b, F.col("p_size") % 7 == 0) * 10).cast("long").alias("tenths"))


_GERMAN_SQL = "CASE WHEN c >= 100000 THEN (c // 100000) || '.' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0') ELSE CAST(c // 100 AS VARCHAR) END || ',' || lpad(CAST(c % 100 AS VARCHAR), 2, '0')"


def _german(c: Column) -> Column:
    """A German price text of whole cents."""
    euros = F.when(c >= 100000, F.concat((c / 100000).cast("long").cast("string"), F.lit("."), F.lpad(((c % 100000) / 100).cast("long").cast("string"), 3, "0"))).otherwise((c / 100).cast("long").cast("string"))
    return F.concat(euros, F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


@query("clean_price", "SELECT p_partkey AS external_id, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part")
def clean_price(spark, sf_dir):
    c = F.round(F.col("p_retailprice") * 100).cast("long")
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.round(prices.clean_price(F.concat(F.lit("ab "), _german(c), F.lit(" €"))) * 100).cast("long").alias("cents"))


@query("price_candidates", """WITH p AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c, p_size FROM part)
 SELECT p_partkey AS external_id, CASE WHEN p_size % 3 = 0 THEN CAST(c AS VARCHAR) ELSE c || ',' || (c + 150) END AS found FROM p""")
def price_candidates(spark, sf_dir):
    c = F.round(F.col("p_retailprice") * 100).cast("long")
    other = F.when(F.col("p_size") % 3 == 0, c).otherwise(c + 150)
    body = F.concat(F.lit("jetzt "), _german(c), F.lit(" € statt "), _german(other), F.lit("€ und 12,5 kg"))
    found = F.transform(prices.price_candidates(body), lambda x: F.round(x * 100).cast("long").cast("string"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.array_join(found, ",").alias("found"))


@query("loyalty_prices", """WITH p AS (SELECT p_partkey AS external_id, CAST(round(p_retailprice * 100) AS BIGINT) AS c, p_partkey % 4 AS k FROM part)
 SELECT external_id, CASE k WHEN 0 THEN 'lidl_plus' WHEN 1 THEN 'payback' WHEN 2 THEN 'kundenkarte' END AS program, CASE WHEN k < 3 THEN c + 150 ELSE c END AS standard_cents, CASE WHEN k < 3 THEN c END AS loyalty_cents FROM p""")
def loyalty_prices(spark, sf_dir):
    c = F.round(F.col("p_retailprice") * 100).cast("long")
    hint = _pick_col(("mit Lidl Plus", "PAYBACK Preis", "nur mit Kundenkarte", "für alle"), F.col("p_partkey"))
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), c.alias("c"), F.concat(hint, F.lit(" "), _german(c), F.lit(" €, sonst "), _german(c + 150), F.lit(" €")).alias("body"))
    rows = rows.withColumn("program", prices.loyalty_program(F.col("body")))
    got = prices.resolve_prices(F.col("c") / 100, F.col("body"), F.col("program").isNotNull())
    return rows.select("external_id", "program", *[F.round(got[k] * 100).cast("long").alias(f"{k.split('_')[0]}_cents") for k in ("standard_price", "loyalty_price")])


@query("parse_validity", """WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 6 AS k FROM orders), x AS (SELECT *, d + CAST((7 - (isodow(d) - 1) + 3) % 7 AS INTEGER) AS thursday FROM t)
 SELECT o_orderkey, strftime(CASE k WHEN 0 THEN d + 3 WHEN 1 THEN thursday WHEN 2 THEN NULL WHEN 3 THEN d + 2 WHEN 4 THEN d + 1 ELSE NULL END, '%Y-%m-%d') AS valid_from,
 strftime(CASE k WHEN 0 THEN d + 9 WHEN 1 THEN NULL WHEN 2 THEN thursday WHEN 3 THEN d + 2 WHEN 4 THEN d + 20 ELSE NULL END, '%Y-%m-%d') AS valid_to,
 coalesce(CASE k WHEN 0 THEN true WHEN 1 THEN thursday > d WHEN 3 THEN true WHEN 4 THEN true END, false) AS is_upcoming FROM x""")
def parse_validity(spark, sf_dir):
    k, d = F.col("o_orderkey") % 6, F.to_date("o_orderdate")

    def german(day: Column, form: str = "dd.MM.yyyy") -> Column:
        return F.date_format(day, form)

    body = (
        F.when(k == 0, F.concat(F.lit("Angebot gültig vom "), german(F.date_add(d, 3)), F.lit(" bis "), german(F.date_add(d, 9))))
        .when(k == 1, F.lit("ab Donnerstag")).when(k == 2, F.lit("bis Donnerstag")).when(k == 3, F.lit("nur am übermorgen"))
        .when(k == 4, F.concat(german(F.date_add(d, 1)), F.lit(" - "), german(F.date_add(d, 20)))).otherwise(F.lit("ohne Angabe"))
    )
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"), body.alias("body"))
    rows = validity.parse_validity(rows, "body", "d")
    return rows.select("o_orderkey", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"), "is_upcoming")


@query("url_fingerprint", "SELECT page_id, substr(sha1(lower(regexp_replace(trim(url), '/+$', ''))), 1, 16) AS fingerprint FROM pages")
def url_fingerprint(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.fingerprint_url(F.col("url")).alias("fingerprint"))


@query("url_page", "SELECT page_id, TRY_CAST(nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS INTEGER) AS page_number FROM pages")
def url_page(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", text.source_page(F.col("url"))[0].alias("page_number"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    noisy = F.concat(F.lit("Antwort: ```json\n"), F.col("props"), F.lit("\n``` fertig"))
    return _read(spark, sf_dir, "events").select("event_id", F.from_json(labels.json_object(noisy), "k long")["k"].alias("k"))


@query("link_prefixes", "WITH l AS (SELECT unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS url FROM pages) SELECT '/' || split_part(regexp_extract(url, '^([^?#]*)', 1), '/', 2) AS prefix, count(*) AS n FROM l GROUP BY 1")
def link_prefixes(spark, sf_dir):
    links = _read(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("url"))
    return stats.url_prefix_counts(links)


@query("discover_keywords", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"/?#<>\\s]+)', 1)) AS keyword, generate_subscripts(regexp_extract_all(html, 'href="/([^"/?#<>\\s]+)', 1), 1) AS pos FROM pages)
 SELECT keyword, min(page_id) AS page_no FROM l GROUP BY 1""")
def discover_keywords(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("page_no"), F.replace("html", F.lit('href="/'), F.lit('href="/Angebote/')).alias("html"))
    return listings.discover_keywords(pages).select("keyword", "page_no")


_PHRASES = ("Vergleiche bitte", "Sag Bescheid sobald", "unter 3,50 Euro bei Lidl", "Aktuelle Angebote im Prospekt", "lade neue", "was kostet es", "lösch den alert", "zeig mein alert bei Edeka und Rewe")


#: What ``tag_queries`` finds in a lower-case text t, for DuckDB.
TAGS_SQL = """CASE WHEN t = '' THEN 'unknown' WHEN contains(t, 'lade') OR contains(t, 'aktualisiere') OR contains(t, 'neue angebote') OR contains(t, 'scan') OR contains(t, 'scrape') THEN 'scrape'
  WHEN contains(t, 'vergleich') OR contains(t, 'unterschied') OR contains(t, 'welch') OR contains(t, 'besser') THEN 'compare'
  WHEN alert AND (contains(t, 'lösch') OR contains(t, 'entfern') OR contains(t, 'deaktiviere')) THEN 'delete_alert'
  WHEN alert AND (contains(t, 'zeig') OR contains(t, 'mein') OR contains(t, 'list') OR contains(t, 'übersicht')) THEN 'list_alerts' WHEN alert THEN 'set_alert' ELSE 'query' END AS intent,
 contains(t, 'prospekt') OR contains(t, 'katalog') OR contains(t, 'seite') OR contains(t, 'flyer') AS is_brochure,
 array_to_string(list_filter(['lidl', 'edeka', 'aldi', 'rewe', 'penny', 'netto'], lambda s: contains(t, s)), ',') AS stores,
 TRY_CAST(replace(nullif(regexp_extract(t, 'unter\\s+([0-9,.]+)', 1), ''), ',', '.') AS DOUBLE) AS price_cap"""
ALERT_SQL = "contains(t, 'benachrichtig') OR contains(t, 'alert') OR contains(t, 'erinner') OR contains(t, 'sobald') AS alert"


@query("tag_queries", f"""WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || {_pick(_PHRASES, 'conv_id')}) AS t FROM conversations), f AS (SELECT *, {ALERT_SQL} FROM m)
 SELECT conv_id, turn, {TAGS_SQL}, contains(t, 'was ist gerade im angebot') OR contains(t, 'was ist aktuell im angebot') OR contains(t, 'aktuelle angebote') OR contains(t, 'gerade im angebot') OR contains(t, 'heute im angebot')
  OR contains(t, 'welche angebote gibt es') OR contains(t, 'zeige aktuelle angebote') AS is_generic FROM f""")
def tag_queries(spark, sf_dir):
    """The messages, each with a request behind it."""
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), _pick_col(_PHRASES, F.col("conv_id")))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text"))
    return querytext.tag_queries(rows).select("conv_id", "turn", "intent", "price_cap", "is_generic", "is_brochure", F.array_join("stores", ",").alias("stores"))


@query("brochure_search", """SELECT doc_id, source AS store FROM documents WHERE (source ILIKE '%src1%') AND (text ILIKE '%licensed%' OR source ILIKE '%licensed%' OR text ILIKE '%apache%' OR source ILIKE '%apache%') ORDER BY n_chars DESC, doc_id LIMIT 8""")
def brochure_search(spark, sf_dir):
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("external_id"), F.col("text").alias("title"), F.lit(None).cast("string").alias("brochure_title"), F.col("source").alias("store"), F.col("n_chars").alias("scraped_at"), F.col("doc_id").alias("page_number"))
    return search.search_brochure_pages(pages, "Prospekt Licensed, Apache", ["src1"]).select(F.col("external_id").alias("doc_id"), "store")


@query("freshness", """WITH u AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1), m AS (SELECT user_id, seen, greatest(0, round(epoch(TIMESTAMP '2024-02-03 12:00:00' - seen) / 60)) AS minutes FROM u)
 SELECT user_id, strftime(seen, '%Y-%m-%d') AS day, CASE WHEN minutes < 60 THEN 'vor ' || CAST(minutes AS BIGINT) || ' min' WHEN round(minutes / 60) < 36 THEN 'vor ' || CAST(round(minutes / 60) AS BIGINT) || ' h'
  ELSE 'vor ' || CAST(round(round(minutes / 60) / 24) AS BIGINT) || ' Tagen' END AS age FROM m""")
def freshness(spark, sf_dir):
    """How long ago every user was last seen."""
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("at"))
    return rows.select("user_id", F.date_format("at", "yyyy-MM-dd").alias("day"), stats.age_text(F.col("at"), datetime(2024, 2, 3, 12, tzinfo=timezone.utc)).alias("age"))


@query("newest_sighting", "SELECT strftime(max(ts), '%Y-%m-%d %H:%M') AS seen, 'vor ' || CAST(round(round(round(epoch(TIMESTAMP '2024-03-03 12:00:00' - max(ts)) / 60) / 60) / 24) AS BIGINT) || ' Tagen' AS age FROM events")
def newest_sighting(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").select(F.col("ts").alias("last_seen_at"))
    return stats.freshness(rows, datetime(2024, 3, 3, 12, tzinfo=timezone.utc)).select(F.date_format("last_seen_at", "yyyy-MM-dd HH:mm").alias("seen"), "age")


@query("review_summary", "SELECT user_id AS review_session_id, count(*) FILTER (WHERE event_type = 'click') AS approved, count(*) FILTER (WHERE event_type = 'error') AS rejected, count(*) FILTER (WHERE event_type = 'view') AS flagged, count(*) AS total FROM events GROUP BY 1")
def review_summary(spark, sf_dir):
    decision = F.create_map(*[F.lit(x) for x in ("click", "approved", "error", "rejected", "view", "flagged")])[F.col("event_type")]
    return labels.review_summary(_read(spark, sf_dir, "events").select(F.col("user_id").alias("review_session_id"), decision.alias("decision")))


@query("run_summary", "SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS scraped, count(*) FILTER (WHERE event_type = 'click') AS analysed, count(*) FILTER (WHERE event_type = 'purchase') AS stored, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")
def run_summary(spark, sf_dir):
    step = F.create_map(*[F.lit(x) for x in ("view", "scraped", "click", "analysed", "purchase", "stored", "error", "errors")])[F.col("event_type")]
    return stats.run_summary(_read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), step.alias("step"), F.lit(1).alias("n")))


@query("list_categories", f"WITH {OFFERS_SQL} SELECT DISTINCT category FROM offers WHERE is_active")
def list_categories(spark, sf_dir):
    return stats.list_categories(_offers(spark, sf_dir))


@query("taxonomy_coverage", f"WITH {OFFERS_SQL} SELECT source_category, count(*) AS n FROM offers GROUP BY 1")
def taxonomy_coverage(spark, sf_dir):
    return stats.taxonomy_coverage(_offers(spark, sf_dir))


@query("label_batches", f"WITH {OFFERS_SQL} SELECT external_id, title, store, CAST(1 AS BIGINT) AS payloads, true AS within_size FROM offers WHERE is_active")
def label_batches(spark, sf_dir):
    """Every offer in one payload, as it was, and no payload above its size."""
    batches = labels.label_batches(_offers(spark, sf_dir).filter("is_active").select("external_id", "title", "store"))
    inside = F.inline(F.from_json("payload", "array<struct<external_id:long,title:string,store:string>>"))
    rows = batches.select("shard", "batch", "n", inside)
    return rows.groupBy("external_id", "title", "store").agg(F.count_distinct("shard", "batch").alias("payloads"), (F.max("n") <= 25).alias("within_size"))


@query("validate_labels", """WITH r AS (SELECT p_partkey AS offer_id, p_partkey % 4 AS k FROM part) SELECT offer_id, CASE WHEN k = 0 THEN 'Bier' ELSE 'Wasser & Säfte' END AS subcategory, k <> 0 AS coerced FROM r WHERE k IN (0, 1)""")
def validate_labels(spark, sf_dir):
    k = F.col("p_partkey") % 4
    body = (
        F.when(k == 0, '"category":"Getränke","subcategory":"Bier"').when(k == 1, '"category":"Getränke","subcategory":"Hund"')
        .when(k == 2, '"category":"Fremdes","subcategory":"Bier"').otherwise('"subcategory":"Bier"')
    )
    responses = _read(spark, sf_dir, "part").select(F.concat(F.lit('Hier: {"results":[{"id":"'), F.col("p_partkey").cast("string"), F.lit('",'), body, F.lit('}]} Ende')).alias("response"))
    offers = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").cast("string").alias("external_id"))
    good, _ = labels.validate_labels(labels.parse_label_responses(responses), offers)
    return good.select(F.col("offer_id").cast("long").alias("offer_id"), "subcategory", "coerced")


@query("listing_offers", """WITH p AS (SELECT *, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part) SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_brand || ' ' || p_name AS title, c AS cents,
 CASE WHEN p_size % 2 = 0 THEN 2 * c END AS original_cents, CASE WHEN p_size % 2 = 0 AND p_size % 7 <> 0 THEN 500 END AS tenths, p_size % 5 = 0 AS requires_loyalty, p_type AS source_category FROM p""")
def listing_offers(spark, sf_dir):
    """Listing pages with embedded JSON, one per brand, made from the parts and read again."""
    part = _read(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2)
    item = F.struct(
        F.col("p_partkey").cast("string").alias("id"), F.lit("OFFER").alias("type"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_brand").alias("publisherName"),
        F.struct(
            cents.cast("double").alias("mainPrice"), F.when(F.col("p_size") % 2 == 0, cents * 2).cast("double").alias("secondaryPrice"), (F.col("p_size") % 7 == 0).alias("priceRange"),
            F.array(F.struct(F.struct((F.col("p_size") % 5 == 0).alias("isCard"), F.lit("Karte").alias("name")).alias("loyaltyProgram"))).alias("conditions"),
        ).alias("prices"),
        F.array(F.array(F.struct(F.lit("1").alias("id"), F.lit("Marken").alias("name"))), F.array(F.struct(F.lit("2").alias("id"), F.col("p_type").alias("name")), F.struct(F.lit("3").alias("id"), F.lit("x").alias("name")))).alias("categoryPaths"),
    )
    offers = F.struct(F.struct(F.collect_list(item).alias("items")).alias("main"))
    nested = F.struct(F.struct(F.struct(F.struct(offers.alias("offers")).alias("pageInformation")).alias("pageProps")).alias("props"))
    pages_of = max(1, -(-part.count() // 50_000))  # for each brand, so that a page stays a page at every size
    page = part.groupBy(F.col("p_brand").alias("keyword"), F.pmod(F.xxhash64("p_partkey"), F.lit(pages_of)).alias("keyword_rank")).agg(F.to_json(nested).alias("json"))
    pages = page.select("keyword", "keyword_rank", F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), "json", F.lit("</script></html>")).alias("html"))
    items = listings.explode_listing_items(listings.extract_listing_json(pages))
    rows = listings.dedupe_offers(listings.normalize_items(items, AS_OF, "https://offers.example"))
    return rows.select("external_id", "title", _cents("price").alias("cents"), _cents("original_price").alias("original_cents"), _tenths("discount_percent").alias("tenths"), "requires_loyalty", "source_category")


@query("card_offers", """SELECT p_partkey AS card_id, p_name AS title, CAST(round(p_retailprice * 100) AS BIGINT) AS cents, p_brand AS store FROM part WHERE p_retailprice > 0""")
def card_offers(spark, sf_dir):
    c = F.round(F.col("p_retailprice") * 100).cast("long")
    none = F.lit(None).cast("string")
    cards = _read(spark, sf_dir, "part").select(
        F.concat(F.lit("Marke\n"), "p_name", F.lit("\n \n"), "p_brand", F.lit("\n"), _german(c), F.lit(" €")).alias("text"), none.alias("alt"), none.alias("image_url"),
        F.concat(F.lit("https://offers.example/o/"), F.col("p_partkey").cast("string")).alias("detail_url"), none.alias("detail_text"), F.lit("x").alias("category"),
    )
    rows = listings.normalize_cards(cards, AS_OF)
    return rows.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("card_id"), "title", F.round(F.col("price") * 100).cast("long").alias("cents"), "store")


@query("daily_percentiles", """WITH h AS (SELECT l_partkey AS external_id, CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT external_id, strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (PARTITION BY external_id ORDER BY day RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS seen_90d FROM h""")
def daily_percentiles(spark, sf_dir):
    """Rolling observation counts for every day at once."""
    days = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("external_id"), F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n"))
    frame = Window.partitionBy("external_id").orderBy(F.unix_date("day")).rangeBetween(-90, 0)
    return days.select("external_id", F.col("day").cast("string").alias("day"), "n", F.sum("n").over(frame).alias("seen_90d"))


@query("embedding_text", "SELECT p_partkey AS external_id, p_name || ' ' || p_type || ' ' || p_brand AS body FROM part")
def embedding_text(spark, sf_dir):
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), vectors.offer_text(F.concat(F.lit("  "), "p_name"), F.col("p_type"), F.concat("p_brand", F.lit("  "))).alias("body"))


_RULES = ("/en/4", "/es", "/nowhere")


@query("exclude_disallowed", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^(/en/4|/es|/nowhere)')")
def exclude_disallowed(spark, sf_dir):
    rules = spark.createDataFrame([(r,) for r in _RULES], "prefix string")
    return filters.exclude_disallowed(_read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "url")


@query("brochure_images", """WITH i AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS viewer_url, url AS image_url, min(page_id) AS pos FROM pages GROUP BY 1, 2)
 SELECT viewer_url, image_url, row_number() OVER (PARTITION BY viewer_url ORDER BY pos, image_url) AS page_number FROM i QUALIFY page_number <= 3""")
def brochure_images(spark, sf_dir):
    images = _read(spark, sf_dir, "pages").select(F.regexp_extract("url", "^([a-z]+://[^/?#]+)", 1).alias("viewer_url"), F.col("url").alias("image_url"), F.col("page_id").alias("pos"))
    return listings.brochure_pages_from_images(images).select("viewer_url", "image_url", F.col("page_number").cast("long").alias("page_number"))


@query("week_version", "SELECT o_orderkey, 'v1-' || isoyear(o_orderdate) || '-W' || lpad(CAST(weekofyear(o_orderdate) AS VARCHAR), 2, '0') AS version FROM orders")
def week_version(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select("o_orderkey", validity.week_version(F.col("o_orderdate")).alias("version"))


@query("report_best", f"WITH {OFFERS_SQL} SELECT external_id, tenths FROM offers WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND (valid_to IS NULL OR valid_to >= DATE '2024-01-20') AND tenths IS NOT NULL ORDER BY tenths DESC, external_id LIMIT 10")
def report_best(spark, sf_dir):
    return stats.report_lists(_offers(spark, sf_dir), AS_OF)["best"].select("external_id", _tenths("discount_percent").alias("tenths"))


@query("report_next_week", f"WITH {OFFERS_SQL} SELECT external_id, store FROM offers WHERE valid_from BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' ORDER BY valid_from, store NULLS LAST, external_id LIMIT 10")
def report_next_week(spark, sf_dir):
    return stats.report_lists(_offers(spark, sf_dir), AS_OF)["next_week"].select("external_id", "store")


@query("label_source", f"WITH {OFFERS_SQL}, b AS (SELECT {_SOURCE_SQL} AS bucket FROM offers) SELECT CASE WHEN count(bucket) > 0 AND count(bucket) * 2 >= count(*) THEN 'source' ELSE 'heuristic' END AS label_source FROM b")
def label_source(spark, sf_dir):
    return stats.label_source(stats.with_buckets(_offers(spark, sf_dir)))


@query("bucket_offers", f"WITH {_RULED}, b AS (SELECT *, coalesce({_SOURCE_SQL}, split_part(pair, '/', 1)) AS bucket FROM ruled) SELECT external_id, tenths FROM b WHERE bucket = 'Lebensmittel' ORDER BY tenths DESC NULLS LAST, external_id LIMIT 60")
def bucket_offers(spark, sf_dir):
    return stats.bucket_offers(stats.with_buckets(_offers(spark, sf_dir)), "Lebensmittel").select("external_id", _tenths("discount_percent").alias("tenths"))


@query("review_patches", "SELECT p_partkey AS offer_id, CASE WHEN p_size % 3 = 0 THEN 'neu: ' || p_name ELSE p_name END AS product_name, p_brand AS brand FROM part")
def review_patches(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    analyses = part.select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"))
    patch = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("product_name"), F.concat(F.lit("neu: "), "p_name"))).otherwise(F.create_map(F.lit("id"), F.lit("x")))
    return labels.apply_review_patches(analyses, part.select(F.col("p_partkey").alias("offer_id"), patch.alias("patch")))[0]


@query("answer_candidates", f"""WITH {_VECTORS}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1),
 near AS (SELECT id, 0 AS tier FROM o, q WHERE list_cosine_similarity(e, v) >= 0.5 ORDER BY list_cosine_similarity(e, v) DESC, id LIMIT 8),
 current AS (SELECT id, 1 AS tier FROM o ORDER BY discount DESC, hour DESC, id LIMIT 8)
 SELECT * FROM near UNION ALL SELECT * FROM current WHERE NOT EXISTS (SELECT 1 FROM near)""")
def answer_candidates(spark, sf_dir):
    offers = _vector_offers(spark, sf_dir).withColumns({c: F.lit(None).cast("date") for c in ("valid_from", "valid_to")}).withColumns({"is_upcoming": F.lit(False), "external_id": F.col("id")})
    return search.answer_candidates(offers, False, _first_vector(spark, sf_dir), AS_OF).select("id", "tier")


@query("notification_log", f"""WITH {_MATCHES}, sent AS (SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY alert_id, rank) AS ids, count(*) AS n FROM matches WHERE rank <= 5 GROUP BY 1)
 SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'sent' ELSE 'failed' END AS status, ids AS offer_ids, n || ' Angebote' AS payload_summary FROM sent""")
def notification_log(spark, sf_dir):
    digests = alerts.build_digests(_matches(spark, sf_dir), _alerts(spark, sf_dir))
    outcomes = _alerts(spark, sf_dir).select("user_id").distinct().select("user_id", F.lit("email").alias("channel"), F.when(F.col("user_id") % 2 == 0, "sent").otherwise("failed").alias("status"), F.lit(None).cast("string").alias("error_message"))
    rows = alerts.notification_rows(digests, outcomes, AS_OF)
    return rows.select("user_id", "status", F.array_join(F.col("offer_ids").cast("array<string>"), ",").alias("offer_ids"), "payload_summary")


@query("touch_alerts", f"WITH {_MATCHES}, had AS (SELECT DISTINCT user_id FROM matches WHERE rank <= 5) SELECT vec_id AS id, vec_id % 7 IN (SELECT user_id FROM had) AS touched FROM embeddings WHERE vec_id % 20 = 0")
def touch_alerts(spark, sf_dir):
    rows = _alerts(spark, sf_dir).withColumn("last_triggered_at", F.lit(None).cast("timestamp"))
    digests = alerts.build_digests(_matches(spark, sf_dir), rows)
    return alerts.touch_alerts(rows, digests, AS_OF).select("id", F.col("last_triggered_at").isNotNull().alias("touched"))


@query("sanitize_prefs", """SELECT CAST(c_custkey AS VARCHAR) AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'Tier' ELSE 'Lebensmittel,Getränke' END AS buckets,
 CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 120 BETWEEN 5 AND 95 THEN CAST(c_custkey % 120 AS DOUBLE) ELSE 50.0 END AS bargain_min_discount FROM customer""")
def sanitize_prefs(spark, sf_dir):
    k = F.col("c_custkey")
    raw = _read(spark, sf_dir, "customer").select(
        k.cast("string").alias("user_id"), F.lit(None).cast("array<string>").alias("stores"), F.when(k % 3 == 0, F.array(F.lit("Tier"), F.lit("Fremd"))).otherwise(F.array(F.lit("Fremd"))).alias("buckets"),
        (k % 120).cast("double").alias("bargain_min_discount"), (k % 7 == 0).alias("no_bargains"), F.lit(True).alias("onboarded"),
    )
    return taxonomy.sanitize_prefs(raw).select("user_id", F.array_join("buckets", ",").alias("buckets"), "bargain_min_discount")
