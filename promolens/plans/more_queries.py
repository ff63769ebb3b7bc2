"""More registered queries over the star tables: parsing, links, labels, alerts, jobs.

Each has the SQL that DuckDB checks it by, written out rather than made from the
library's own rules.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import prices, querytext, taxonomy, text, validity, vectors
from promolens.operators import alerts, history, labels, merge, search, stats
from promolens.schema import OFFERS, align_schema, validate
from promolens.streaming import jobs

from .queries import _MATCHES, _VECTORS, _alerts, _cents, _matches, _offers, _pick, _pick_col, _read, _vector_offers, ALERT_SQL, AS_OF, OFFERS_SQL, query, TAGS_SQL



def _k() -> Column:
    return F.col("p_partkey")
_SITE = "https://offers.example"


def _part(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "part")


def _str(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _euro(cents: Column) -> Column:
    """Cents as 1.234,56."""
    whole, rest = F.floor(cents / 100).cast("long"), F.lpad(_str(F.pmod(cents, F.lit(100))), 2, "0")
    return F.concat(F.when(whole >= 1000, F.concat(_str(F.floor(whole / 1000)), F.lit("."), F.lpad(_str(whole % 1000), 3, "0"))).otherwise(_str(whole)), F.lit(","), rest)


# titles, links, pictures


@query("image_links", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://img.example/' || p_partkey WHEN p_size % 2 = 0 THEN 'https://n.example/' || p_partkey WHEN p_size % 5 = 0 THEN NULL ELSE 'http://t.example/x' END AS image_url FROM part""")
def image_links(spark, sf_dir):
    size = F.col("p_size")
    large = F.when(size % 3 == 0, F.concat(F.lit("//img.example/"), _str(_k()))).otherwise("")
    normal = F.when(size % 2 == 0, F.concat(F.lit("https://n.example/"), _str(_k())))
    return _part(spark, sf_dir).select("p_partkey", text.image_link(large, normal, F.when(size % 5 != 0, "http://t.example/x")).alias("image_url"))


@query("offer_links", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'https://shop.example/' || p_partkey WHEN p_size % 7 = 1 THEN 'https://offers.example' ELSE 'https://offers.example/Angebote/' || replace(p_name, ' ', '%20') END AS link FROM part""")
def offer_links(spark, sf_dir):
    size = F.col("p_size")
    url = F.when(size % 3 == 0, F.concat(F.lit("https://shop.example/"), _str(_k()))).when(size % 2 == 0, "  ")
    title = F.when(size % 7 != 1, F.concat(F.lit(" "), "p_name"))
    return _part(spark, sf_dir).select("p_partkey", text.offer_link(_SITE, url, title).alias("link"))


@query("viewer_links", """SELECT o_orderkey, 'https://offers.example/contentViewer/static/b' || o_custkey || '?feature=brochure_shelf&page=' || CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE o_orderkey % 30 + 1 END AS link FROM orders""")
def viewer_links(spark, sf_dir):
    page = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 30)
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.viewer_url(_SITE, F.concat(F.lit("b"), _str("o_custkey")), page).alias("link"))


@query("canonical_links", """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS root, regexp_extract(url, '^([a-z]+://[^/]+(?:/[^?#]*)?/)[^/]*$', 1) AS folder FROM pages)
 SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://x.example/' || page_id WHEN 1 THEN scheme || '://cdn.example/' || page_id WHEN 2 THEN root || '/top/' || page_id ELSE CASE WHEN folder <> '' THEN folder ELSE root || '/' END || 'next/' || page_id END AS link FROM p""")
def canonical_links(spark, sf_dir):
    k = F.col("page_id") % 4
    head = F.when(k == 0, "https://x.example/").when(k == 1, "//cdn.example/").when(k == 2, "/top/").otherwise("next/")
    return _read(spark, sf_dir, "pages").select("page_id", text.canonical_url(F.col("url"), F.concat(head, _str("page_id"))).alias("link"))


@query("alt_titles", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN p_name || ' im Bild' END AS title,
 CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' || p_name ELSE p_name END AS shown FROM part""")
def alt_titles(spark, sf_dir):
    k = F.col("p_size") % 3
    alt = F.when(k == 0, F.concat(F.lit(" "), "p_name", F.lit("  bei  Markt im Prospekt der Woche"))).when(k == 1, F.concat("p_name", F.lit(" im Bild "))).otherwise(" ")
    brand = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.upper(F.element_at(F.split("p_name", " "), 1)))
    return _part(spark, sf_dir).select("p_partkey", text.title_from_alt(alt).alias("title"), text.display_title(F.col("p_name"), brand).alias("shown"))


@query("embedding_texts_missing", """SELECT p_partkey, p_size % 3 <> 0 AS has_vector, CASE WHEN p_size % 3 = 0 THEN 0 WHEN p_size % 2 = 0 THEN 2 ELSE 64 END AS dims FROM part""")
def embedding_texts_missing(spark, sf_dir):
    """Vectors stay where they are, are made where a text is there, and stay null for a blank text."""
    size = F.col("p_size")
    rows = _part(spark, sf_dir).select("p_partkey", F.when((size % 3 != 0) & (size % 2 == 0), F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")).alias("embedding"), F.when(size % 3 != 0, F.col("p_name")).otherwise(" ").alias("body"))
    made = vectors.embed_missing(rows, text.blank_to_null(F.col("body")))
    return made.select("p_partkey", F.col("embedding").isNotNull().alias("has_vector"), F.coalesce(F.size("embedding"), F.lit(0)).alias("dims"))


@query("vector_length", """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
 SELECT id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS length, len(v) AS size, true AS unit, true AS same FROM e""")
def vector_length(spark, sf_dir):
    """Lengths of the given vectors; vectors made of texts have length 1, and equal words give equal ones."""
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.concat(F.lit("Offer "), _str("vec_id")).alias("body"))
    v = vectors.hashed_embedding(F.col("body"))
    same = vectors.hashed_embedding(F.concat(F.lit("OFFER, "), _str("id")))
    return rows.select(
        "id", F.round(vectors.norm(F.col("embedding")), 5).alias("length"), F.size("embedding").cast("long").alias("size"),
        (F.abs(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) - 1) < 1e-6).alias("unit"), (v == same).alias("same"),
    )


# prices


@query("price_texts", """WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)
 SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN c + 500 ELSE c + 100 END AS original_cents, c || ';' || (c + CASE WHEN p_size % 4 = 1 THEN 500 ELSE 100 END) AS candidates,
 CAST(p_size + 5 AS DOUBLE) AS percent, CAST(p_size * 10 + 5 AS DOUBLE) / 10 AS number FROM p""")
def price_texts(spark, sf_dir):
    c, size = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size")
    word = F.when(size % 4 == 0, "oder ").when(size % 4 == 1, "STATT ").otherwise("war  ")
    other = c + F.when(size % 4 == 1, 500).otherwise(100)
    body = F.concat(_euro(c), F.lit(" € "), word, _euro(other), F.lit(" €, nochmals "), _euro(c), F.lit("€"))
    found = F.transform(prices.price_candidates(body), lambda x: _str(F.round(x * 100).cast("long")))
    return _part(spark, sf_dir).select(
        "p_partkey", F.round(prices.original_price(body) * 100).cast("long").alias("original_cents"), F.array_join(found, ";").alias("candidates"),
        prices.clean_discount(F.concat(F.lit("-"), _str(size + 5), F.lit(" %"))).alias("percent"), prices.clean_number(F.concat(F.lit("ca. "), _str(size), F.lit(",5 kg")).substr(5, 20)).alias("number"),
    )


@query("price_roles", """WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part), r AS (SELECT *, CASE WHEN p_size % 5 <> 0 THEN c END AS price, CASE WHEN p_size % 5 <> 0 AND p_size % 3 = 0 THEN c + 700 END AS original FROM p)
 SELECT p_partkey, price AS price_cents, original AS original_cents, CASE WHEN p_size % 2 = 0 THEN price END AS loyalty_cents, coalesce(original, price) AS standard_cents FROM r""")
def price_roles(spark, sf_dir):
    c, size = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size")
    main = F.when(size % 5 != 0, c / 100).otherwise(0.0)
    second = F.when(size % 3 == 0, (c + 700) / 100).when(size % 3 == 1, (c - 700) / 100).otherwise(0.0)
    roles = prices.price_roles(main, second, size % 2 == 0)
    return _part(spark, sf_dir).select("p_partkey", *[F.round(v * 100).cast("long").alias(f"{k.removesuffix('_price') if k != 'price' else 'price'}_cents") for k, v in roles.items()])


@query("card_prices", """WITH p AS (SELECT p_partkey, p_size, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)
 SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN c + 300 WHEN p_size % 3 = 0 THEN NULL ELSE c END AS standard_cents, CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN c END AS loyalty_cents,
 CASE WHEN p_size % 2 = 0 THEN c + 300 ELSE c END AS price_cents, CASE WHEN p_size % 7 <> 0 THEN -1000 END AS tenths FROM p""")
def card_prices(spark, sf_dir):
    c, size = F.round(F.col("p_retailprice") * 100).cast("long"), F.col("p_size")
    body = F.concat(_euro(c), F.lit(" €"), F.when(size % 2 == 0, F.concat(F.lit(" / ohne Karte "), _euro(c + 300), F.lit(" €"))).otherwise(""))
    got = prices.resolve_prices(c / 100, body, (size % 2 == 0) | (size % 3 == 0))
    percent = prices.card_discount(F.lit(2.0) * c, F.when(size % 7 != 0, F.lit(1.0) * c).otherwise(0.0))
    return _part(spark, sf_dir).select(
        "p_partkey", *[F.round(got[f"{k}_price" if k != "price" else k] * 100).cast("long").alias(f"{k}_cents") for k in ("standard", "loyalty", "price")], F.round(percent * 10).cast("int").alias("tenths"),
    )


@query("percentile_tones", """SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL WHEN p_size * 2 <= 15 THEN 'great' WHEN p_size * 2 <= 35 THEN 'good' WHEN p_size * 2 <= 65 THEN 'fair' ELSE 'high' END AS tone FROM part""")
def percentile_tones(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", prices.percentile_tone(F.when(F.col("p_size") % 10 != 0, F.col("p_size") * 2)).alias("tone"))


@query("loyalty_texts", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'payback' WHEN 1 THEN 'lidl_plus' WHEN 2 THEN 'kundenkarte' WHEN 3 THEN 'kundenkarte' END AS program,
 CASE p_size % 5 WHEN 0 THEN 'Nur mit PAYBACK ' || p_partkey WHEN 1 THEN 'Mit Lidl Plus sparen' WHEN 2 THEN 'Preis mit Kundenkarte' WHEN 3 THEN 'karte' END AS condition FROM part""")
def loyalty_texts(spark, sf_dir):
    k = F.col("p_size") % 5
    body = (
        F.when(k == 0, F.concat(F.lit("Angebot! Nur mit  PAYBACK "), _str(_k()), F.lit(". Mehr im Markt."))).when(k == 1, "Frisch.\nMit Lidl Plus sparen!")
        .when(k == 2, "Preis mit Kundenkarte").when(k == 3, "Speisekarte gratis").otherwise("ohne Bedingung")
    )
    return _part(spark, sf_dir).select("p_partkey", prices.loyalty_program(body).alias("program"), prices.loyalty_condition(body).alias("condition"))


@query("loyalty_hints", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Karte B' WHEN 1 THEN 'penny_app' WHEN 2 THEN NULL ELSE NULL END AS program, p_size % 4 < 2 OR p_size % 4 = 3 AS required,
 CASE p_size % 4 WHEN 0 THEN 'ab 3 Stück' WHEN 1 THEN 'nur heute · mit der Penny App' WHEN 2 THEN 'nur heute' END AS condition FROM part""")
def loyalty_hints(spark, sf_dir):
    def entry(card: bool | None, name: str | None, other: str | None) -> Column:
        program = F.struct(F.lit(card).cast("boolean").alias("isCard"), F.lit(name).cast("string").alias("name"))
        return F.struct(program.alias("loyaltyProgram"), F.lit(other).cast("string").alias("other"))

    k = F.col("p_size") % 4
    found = (
        F.when(k == 0, F.array(entry(True, "Karte A", None), entry(False, "x", " ab 3 Stück "), entry(True, "Karte B", "")))
        .when(k == 1, F.array(entry(None, None, "nur heute"), entry(False, None, "mit der Penny App")))
        .when(k == 2, F.array(entry(None, None, "nur heute"), F.lit(None))).otherwise(F.array(entry(True, None, None)))
    )
    got = prices.structured_loyalty(found)
    return _part(spark, sf_dir).select("p_partkey", got["loyalty_program"].alias("program"), got["requires_loyalty"].alias("required"), got["condition_text"].alias("condition"))


# dates


@query("timestamps", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN ' 06:30' WHEN 1 THEN ' 08:30' ELSE ' 10:30' END AS utc, strftime(o_orderdate, '%Y-%m-%d') AS written FROM orders""")
def timestamps(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    written = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k == 0, "T08:30:00.000+0200").when(k == 1, "T08:30:00").otherwise("T08:30:00-02:00"))
    at = validity.parse_timestamp(written)
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("utc"), _str(validity.date_part(written)).alias("written"))


@query("validity_texts", """WITH t AS (SELECT o_orderkey, o_orderkey % 7 AS k, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate + INTERVAL 6 DAY, '%Y-%m-%d') AS b FROM orders)
 SELECT o_orderkey, CASE k WHEN 0 THEN 'Gültig am ' || a WHEN 1 THEN 'Gültig ab ' || a WHEN 2 THEN 'Gültig ' || a || ' bis ' || b WHEN 3 THEN 'Seit ' || a WHEN 4 THEN 'Gültig ab ' || a WHEN 5 THEN 'Gültig bis ' || b ELSE 'roh' END AS shown FROM t""")
def validity_texts(spark, sf_dir):
    k, a = F.col("o_orderkey") % 7, F.to_date("o_orderdate")
    start = F.when(k < 5, a)
    end = F.when(k < 2, a).when(k.isin(2, 5), F.date_add(a, 6))
    return _read(spark, sf_dir, "orders").select("o_orderkey", validity.validity_display(start, end, k.isin(1, 4), F.lit("roh")).alias("shown"))


@query("event_ages", """WITH a AS (SELECT event_id, (epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60 AS m FROM events), b AS (SELECT event_id, greatest(0, CAST(floor(m + 0.5) AS BIGINT)) AS m FROM a), c AS (SELECT event_id, m, CAST(floor(m / 60.0 + 0.5) AS BIGINT) AS h FROM b)
 SELECT event_id, CASE WHEN m < 60 THEN 'vor ' || m || ' min' WHEN h < 36 THEN 'vor ' || h || ' h' ELSE 'vor ' || CAST(floor(h / 24.0 + 0.5) AS BIGINT) || ' Tagen' END AS age FROM c""")
def event_ages(spark, sf_dir):
    at = F.date_trunc("second", F.col("ts").cast("timestamp"))
    return _read(spark, sf_dir, "events").select("event_id", stats.age_text(at, datetime(2024, 2, 1, tzinfo=timezone.utc)).alias("age"))


# labels, analyses, reviews


@query("labelled_buckets", """SELECT p_partkey AS external_id, CASE WHEN p_partkey % 3 = 0 THEN 'Getränke' WHEN p_partkey % 3 = 1 THEN 'Tier' ELSE 'Sonstiges' END AS bucket,
 CASE WHEN p_partkey % 3 = 0 THEN 'label' WHEN p_partkey % 3 = 1 THEN 'rules' ELSE 'rules' END AS bucket_source, CASE WHEN p_partkey % 3 = 0 THEN 'Bier' WHEN p_partkey % 3 = 1 THEN 'Katze' ELSE 'Sonstige' END AS subcategory FROM part""")
def labelled_buckets(spark, sf_dir):
    """Labels of known buckets come before rules; one of an unknown bucket is passed over."""
    none = F.lit(None).cast("string")
    offers = _part(spark, sf_dir).select(
        _k().alias("external_id"), F.when(_k() % 3 == 2, "Zzyzx").otherwise("Katzenfutter").alias("title"), none.alias("category"), none.alias("source_category"), none.alias("source_category_path"),
    )
    known = _part(spark, sf_dir).filter(_k() % 3 != 2).select(_k().alias("external_id"), F.when(_k() % 3 == 0, "Getränke").otherwise("Fremd").alias("category"), F.lit("Bier").alias("subcategory"))
    return stats.with_buckets(offers, known).select("external_id", "bucket", "bucket_source", "subcategory")


@query("vision_analyses", """SELECT p_partkey AS offer_id, CASE WHEN p_size % 3 = 0 THEN 'P' || p_partkey ELSE p_name END AS product_name, CASE WHEN p_size % 3 = 0 THEN 'neu' ELSE 'unbekannt' END AS condition,
 CASE WHEN p_size % 3 = 0 THEN 75 ELSE 50 END AS quality, CASE WHEN p_size % 3 = 0 THEN 'Sehr gut' ELSE 'Durchschnittlich' END AS deal_verdict, CASE WHEN p_size % 3 = 0 THEN 'a,b' ELSE '' END AS key_features FROM part""")
def vision_analyses(spark, sf_dir):
    part = _part(spark, sf_dir)
    good = F.concat(F.lit('Antwort:\n{"product_name":"P'), _str(_k()), F.lit('","condition":"neu","quality_score":0.75,"deal_verdict":"Sehr gut","key_features":["a","b"]} Ende'))
    responses = part.select(_k().alias("offer_id"), F.when(F.col("p_size") % 3 == 0, good).when(F.col("p_size") % 3 == 1, "{}").otherwise("kein JSON").alias("response"))
    made = labels.build_analyses(part.select(_k().alias("id"), F.col("p_name").alias("title")), responses)
    return made.select("offer_id", "product_name", "condition", (F.col("quality_score") * 100).cast("int").alias("quality"), "deal_verdict", F.array_join("key_features", ",").alias("key_features"))


@query("page_analyses", "SELECT p_partkey AS external_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS page_summary, CASE WHEN p_size % 2 = 0 THEN least(p_size % 8, 5) ELSE 0 END AS shown FROM part")
def page_analyses(spark, sf_dir):
    item = F.lit('{"product":"x","price":"1,00 €","badge":null}')
    n = F.col("p_size") % 8
    body = F.concat(F.lit('```json {"page_summary":"'), "p_name", F.lit('","top_offers":['), F.array_join(F.array_repeat(item, n), ","), F.lit("]} ```"))
    rows = _part(spark, sf_dir).select(_k().alias("external_id"), F.when(F.col("p_size") % 2 == 0, body).otherwise("nichts").alias("response"))
    return labels.parse_page_analyses(rows).select("external_id", "page_summary", F.size("top_offers").alias("shown"))


@query("review_rows", """SELECT o_orderkey AS review_id, o_orderkey % 2 = 0 AS known, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT p_name FROM part WHERE p_partkey = 1 + o_custkey % 100) END AS scraped_title,
 CASE WHEN o_orderkey % 2 = 0 AND (1 + o_custkey % 100) % 3 = 0 THEN 'Marke ' || (1 + o_custkey % 100) END AS vision_brand FROM orders""")
def review_rows(spark, sf_dir):
    part, none = _part(spark, sf_dir), F.lit(None).cast("string")
    offers = part.select(_k().alias("external_id"), _k().alias("id"), F.col("p_name").alias("title"), none.alias("url"), none.alias("image_url"), F.col("p_brand").alias("store"), F.col("p_retailprice").alias("price"), none.alias("validity_text"))
    seen = part.filter(_k() % 3 == 0).select(
        _k().alias("offer_id"), F.col("p_name").alias("product_name"), F.concat(F.lit("Marke "), _str(_k())).alias("brand"), F.lit("neu").alias("condition"), F.array().cast("array<string>").alias("key_features"), F.lit("Gut").alias("deal_verdict")
    )
    k = F.col("o_orderkey")
    decisions = _read(spark, sf_dir, "orders").select(k.alias("review_id"), F.when(k % 2 == 0, 1 + F.col("o_custkey") % 100).otherwise(-k).alias("external_id"), F.lit("approved").alias("decision"))
    rows = labels.append_reviews(decisions, offers, seen)
    return rows.select("review_id", F.col("scraped_title").isNotNull().alias("known"), "scraped_title", "vision_brand")


@query("review_queue", "SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS position, p_size % 3 = 0 AS analysed FROM part QUALIFY position <= 100")
def review_queue(spark, sf_dir):
    part = _part(spark, sf_dir)
    first = part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(100)
    at = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("p_retailprice")).alias("o"), "p_partkey"))), lambda x: x["p_partkey"])
    offers = first.agg(at.alias("ids")).select(F.posexplode("ids").alias("at", "id")).select("id", (F.col("at") + 1).cast("long").alias("position"))  # a hundred rows
    analyses = part.filter("p_size % 3 = 0").select(_k().alias("offer_id"), F.lit("Gut").alias("deal_verdict"))
    return labels.review_queue(offers, analyses).select("id", "position", F.col("deal_verdict").isNotNull().alias("analysed"))


@query("valid_rows", "SELECT p_partkey AS id, p_size % 4 <> 0 AND p_size % 3 <> 0 AS ok FROM part")
def valid_rows(spark, sf_dir):
    rows = _part(spark, sf_dir).select(_k().alias("id"), F.when(F.col("p_size") % 4 == 0, "kaputt").when(F.col("p_size") % 2 == 0, "neu").alias("condition"), F.when(F.col("p_size") % 3 != 0, "x").alias("external_id"))
    good, bad = validate(rows, keys=("external_id",))
    return good.select("id", F.lit(True).alias("ok")).unionByName(bad.select("id", F.lit(False).alias("ok")))


@query("aligned_rows", "SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size AS BIGINT) * 100 END AS cents, CAST(NULL AS VARCHAR) AS store FROM part")
def aligned_rows(spark, sf_dir):
    """Missing columns become null, so do values that cannot be cast."""
    rows = _part(spark, sf_dir).select(_k().alias("EXTERNAL_ID"), F.when(F.col("p_size") % 3 != 0, _str("p_size")).otherwise("ab 3").alias("price"), F.lit(1).alias("foreign"))
    return align_schema(rows, OFFERS).select("external_id", _cents("price").alias("cents"), "store")


#: Titles and categories with their buckets, written by hand.
SAMPLES = (
    ("Android Tablet 10 Zoll", None, "Elektronik & Multimedia", "Smartphone & Tablet"), ("Wodka 0,7 l", None, "Getränke", "Spirituosen"), ("Barilla Pasta", None, "Lebensmittel", "Grundnahrung & Konserven"),
    ("Räucherlachs", None, "Lebensmittel", "Fisch"), ("Bohrmaschine 600 W", None, "Garten & Heimwerken", "Werkzeug & Heimwerken"), ("Babybrei Banane", None, "Baby & Kind", "Baby-Nahrung"),
    ("Pampers Windeln", None, "Baby & Kind", "Windeln & Pflege"), ("Hundefutter Rind", None, "Tier", "Hund"), ("Katzenstreu", None, "Tier", "Katze"), ("Vogelfutter", None, "Tier", "Sonstige Tiere"),
    ("Gartenstuhl Holz", None, "Garten & Heimwerken", "Gartenmöbel"), ("Waschmittel flüssig", None, "Haushalt & Reinigung", "Waschmittel"), ("Zahnpasta", None, "Drogerie & Kosmetik", "Körperpflege"),
    ("Lippenstift rot", None, "Drogerie & Kosmetik", "Kosmetik & Make-up"), ("Fußball Größe 5", None, "Mode, Sport & Freizeit", "Sport & Fitness"), ("Fernseher 55 Zoll", None, "Elektronik & Multimedia", "TV & Audio"),
    ("Kühlschrank", None, "Elektronik & Multimedia", "Haushaltsgeräte"), ("Winterreifen", None, "Sonstiges", "Auto & Mobilität"), ("Tiefkühlpizza", None, "Lebensmittel", "Tiefkühl"),
    ("Gouda Käse", None, "Lebensmittel", "Milchprodukte & Käse"), ("Hähnchenbrust", None, "Lebensmittel", "Fleisch & Wurst"), ("Mineralwasser", None, "Getränke", "Wasser & Säfte"),
    ("Rotwein trocken", None, "Getränke", "Wein & Sekt"), ("Filterkaffee", None, "Getränke", "Kaffee & Tee"), ("Xyz", "actimel", "Lebensmittel", "Milchprodukte & Käse"),
    ("Xyz", "hund", "Tier", "Hund"), ("Xyz", "akku-rasenmaeher", "Garten & Heimwerken", "Gartenwerkzeug"), ("Xyz", "arzneimittel", "Drogerie & Kosmetik", "Gesundheit & Apotheke"),
    ("Xyz", "ariel", "Haushalt & Reinigung", "Waschmittel"), ("Xyz", "adidas", "Mode, Sport & Freizeit", "Kleidung & Schuhe"), ("Xyz", "unbekannt", "Sonstiges", "Sonstige"), ("Bier Pils", "hund", "Getränke", "Bier"),
)


@query("sample_categories", f"SELECT p_partkey, {_pick(tuple(x[2] for x in SAMPLES), 'p_partkey')} AS bucket, {_pick(tuple(x[3] for x in SAMPLES), 'p_partkey')} AS subcategory FROM part")
def sample_categories(spark, sf_dir):
    """Each part under one of the sample titles and categories."""
    title, category = (_pick_col(tuple(x[n] for x in SAMPLES), _k()) for n in (0, 1))
    rows = _part(spark, sf_dir).select("p_partkey", title.alias("title"), category.alias("category"))
    return rows.withColumn("pair", taxonomy.classify(F.col("title"), F.col("category"))).select("p_partkey", "pair.bucket", "pair.subcategory")


@query("short_titles", "SELECT o_orderkey, left(t, 55) AS digest, left(t, 60) AS message FROM (SELECT o_orderkey, repeat('Angebot ' || o_orderkey || ' ', 9) AS t FROM orders)")
def short_titles(spark, sf_dir):
    title = F.repeat(F.concat(F.lit("Angebot "), _str("o_orderkey"), F.lit(" ")), 9)
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.shorten(title, text.DIGEST_TITLE).alias("digest"), text.shorten(title, text.MESSAGE_TITLE).alias("message"))


# merges, history, alerts


@query("merge_analyses", """WITH cur AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0), inc AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 2 = 0 AND p_size % 5 <> 0)
 SELECT coalesce(cur.k, inc.k) AS offer_id, CASE WHEN inc.k IS NULL THEN 'alt' ELSE 'neu' END AS brand, inc.k IS NOT NULL AS updated FROM cur FULL JOIN inc ON cur.k = inc.k""")
def merge_analyses(spark, sf_dir):
    """Analyses of offers that are not there are left out."""
    part, old = _part(spark, sf_dir), F.lit(datetime(2023, 1, 1, tzinfo=timezone.utc)).cast("timestamp")
    current = part.filter(_k() % 3 == 0).select(_k().alias("offer_id"), F.lit("alt").alias("brand"), F.lit("{}").alias("raw_response"), old.alias("created_at"), old.alias("updated_at"))
    incoming = part.filter(_k() % 2 == 0).select(_k().alias("offer_id"), F.lit("neu").alias("brand"), F.lit("{1}").alias("raw_response"))
    twice = incoming.unionByName(incoming.withColumns({"brand": F.lit("zweite"), "raw_response": F.lit("{2}")}))
    rows = merge.merge_analyses(current, twice, part.filter("p_size % 5 <> 0").select(_k().alias("id")), AS_OF)
    return rows.select("offer_id", "brand", (F.col("updated_at") == F.lit(AS_OF).cast("timestamp")).alias("updated"))


@query("merge_labels", """WITH cur AS (SELECT user_id, event_type, max(ts) AS at FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2), inc AS (SELECT user_id, event_type, max(ts) AS at FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1, 2)
 SELECT coalesce(i.user_id, c.user_id) AS external_id, coalesce(i.event_type, c.event_type) AS model_version, CASE WHEN i.user_id IS NULL THEN 'alt' ELSE 'neu' END AS category FROM cur c FULL JOIN inc i ON c.user_id = i.user_id AND c.event_type = i.event_type""")
def merge_labels(spark, sf_dir):
    events, cut = _read(spark, sf_dir, "events"), F.lit(datetime(2024, 1, 20, tzinfo=timezone.utc))
    rows = events.select(F.col("user_id").alias("external_id"), F.col("event_type").alias("model_version"), F.lit("x").alias("subcategory"), F.col("ts").cast("timestamp").alias("classified_at"))
    current = merge.dedupe_first(rows.filter(F.col("classified_at") < cut), ["external_id", "model_version"], ["classified_at"]).withColumn("category", F.lit("alt"))
    incoming = rows.filter(F.col("classified_at") >= cut).withColumn("category", F.lit("neu"))
    return merge.merge_labels(current, incoming).select("external_id", "model_version", "category")


@query("price_observations", f"WITH {OFFERS_SQL} SELECT external_id, cents, store, '2024-01-20' AS day FROM offers")
def price_observations(spark, sf_dir):
    none = F.lit(None).cast("decimal(10,2)")
    rows = history.append_price_history(_offers(spark, sf_dir).withColumns({"loyalty_price": none, "original_price": none}), AS_OF)
    return rows.select("external_id", _cents("price").alias("cents"), "store", F.date_format("observed_at", "yyyy-MM-dd").alias("day"))


@query("merge_brochures", """WITH cur AS (SELECT page_id, 'alt' AS title, true AS old FROM pages WHERE page_id % 3 = 0), inc AS (SELECT page_id FROM pages WHERE page_id % 2 = 0 AND page_id % 5 <> 0)
 SELECT coalesce(i.page_id, c.page_id) AS external_id, CASE WHEN i.page_id IS NOT NULL THEN 'neu' ELSE c.title END AS title, c.old IS NOT NULL AS kept_created, i.page_id IS NOT NULL AS updated FROM cur c FULL JOIN inc i ON c.page_id = i.page_id""")
def merge_brochures(spark, sf_dir):
    k, pages = F.col("page_id"), _read(spark, sf_dir, "pages")
    stamp = F.lit(datetime(2023, 1, 1, tzinfo=timezone.utc)).cast("timestamp")
    common = [k.alias("external_id"), F.lit(1).alias("page_number"), F.col("url").alias("image_url"), F.lit(None).cast("boolean").alias("is_upcoming"), F.lit(None).cast("timestamp").alias("scraped_at")]
    current = pages.filter(k % 3 == 0).select(*common, F.lit("alt").alias("title"), F.lit("prospekt").alias("category"), stamp.alias("created_at"), stamp.alias("updated_at"))
    incoming = pages.filter(k % 2 == 0).select(*common, F.lit("neu").alias("title"), F.when(k % 5 == 0, "andere").otherwise("prospekt").alias("category"), F.lit(AS_OF).cast("timestamp").alias("created_at"))
    rows = merge.merge_brochure_pages(current, incoming, AS_OF)
    return rows.select("external_id", "title", (F.col("created_at") == stamp).alias("kept_created"), (F.col("updated_at") == F.lit(AS_OF).cast("timestamp")).alias("updated"))


@query("merge_offers", """WITH cur AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part WHERE p_partkey % 3 <> 0), inc AS (SELECT p_partkey AS k, CAST(round(p_retailprice * 100) AS BIGINT) + 100 AS cents FROM part WHERE p_partkey % 2 = 0)
 SELECT coalesce(cur.k, inc.k) AS external_id, coalesce(inc.cents, cur.cents) AS cents, inc.k IS NOT NULL AS is_active, cur.k IS NOT NULL AND cur.k % 5 <> 0 AS has_vector, cur.k IS NULL AS first_seen_now FROM cur FULL JOIN inc ON cur.k = inc.k""")
def merge_offers(spark, sf_dir):
    part, old = _part(spark, sf_dir), F.lit(datetime(2023, 1, 1, tzinfo=timezone.utc)).cast("timestamp")
    cents = F.round(F.col("p_retailprice").cast("decimal(12,4)"), 2)
    current = part.filter(_k() % 3 != 0).select(
        _str(_k()).alias("external_id"), F.concat(F.lit("id"), _str(_k())).alias("id"), cents.alias("price"), F.lit(False).alias("is_active"), old.alias("first_seen_at"), old.alias("last_seen_at"),
        F.when(_k() % 5 != 0, F.array(F.lit(1.0)).cast("array<float>")).alias("embedding"),
    )
    incoming = part.filter(_k() % 2 == 0).select(_str(_k()).alias("external_id"), F.col("p_name").alias("title"), F.lit("u").alias("url"), (cents + 1).alias("price"))
    rows = merge.merge_offers(align_schema(current, OFFERS), align_schema(incoming.unionByName(incoming.withColumn("title", F.lit("~"))), OFFERS), AS_OF)
    return rows.select(
        F.col("external_id").cast("long").alias("external_id"), _cents("price").alias("cents"), "is_active", F.col("embedding").isNotNull().alias("has_vector"), (F.col("first_seen_at") == F.lit(AS_OF).cast("timestamp")).alias("first_seen_now"),
    )


@query("new_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7 AND l_partkey IS NOT NULL)")
def new_parts(spark, sf_dir):
    known = _read(spark, sf_dir, "lineitem").filter("l_quantity = 7").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return merge.new_rows(_part(spark, sf_dir).select("p_partkey"), known, "p_partkey")


_ALERT = "SELECT o_orderkey AS id, o_custkey % 50 AS user_id, o_orderkey % 4 <> 0 AS is_active, o_orderkey % 3 = 0 AS named FROM orders"


def _order_alerts(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        k.alias("id"), _str(F.col("o_custkey") % 50).alias("user_id"), F.when(k % 3 == 0, F.lit(0.9)).alias("similarity_threshold"), (k % 4 != 0).alias("is_active"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query("created_alerts", f"WITH a AS ({_ALERT}) SELECT id, CASE WHEN named THEN 90 ELSE 70 END AS threshold, true AS is_active FROM a")
def created_alerts(spark, sf_dir):
    rows = _order_alerts(spark, sf_dir).drop("is_active", "created_at")
    made = alerts.create_alerts(rows.limit(0).withColumns({"is_active": F.lit(True), "created_at": F.lit(AS_OF).cast("timestamp"), "updated_at": F.lit(AS_OF).cast("timestamp")}), rows, AS_OF)
    return made.select("id", F.round(F.col("similarity_threshold") * 100).cast("int").alias("threshold"), "is_active")


@query("listed_alerts", f"WITH a AS ({_ALERT}) SELECT id FROM a WHERE user_id = 7 AND is_active")
def listed_alerts(spark, sf_dir):
    return alerts.list_alerts(_order_alerts(spark, sf_dir), "7").select("id")


@query("deactivated_alerts", f"WITH a AS ({_ALERT}) SELECT id, is_active AND NOT (id % 5 = 0) AS is_active FROM a")
def deactivated_alerts(spark, sf_dir):
    rows = _order_alerts(spark, sf_dir)
    asked = rows.filter("id % 5 = 0").select("id", "user_id").unionByName(rows.filter("id % 7 = 0").select("id", F.lit("nobody").alias("user_id")))
    return alerts.deactivate_alerts(rows, asked).select("id", "is_active")


@query("reachable_alerts", f"WITH a AS ({_ALERT}) SELECT id, user_id FROM a WHERE is_active AND user_id % 6 <> 0 AND user_id % 5 <> 0")
def reachable_alerts(spark, sf_dir):
    users = _read(spark, sf_dir, "customer").select((F.col("c_custkey") % 50).alias("u")).distinct().unionByName(spark.range(50).select(F.col("id").alias("u"))).distinct().select(
        _str("u").alias("id"), F.when(F.col("u") % 5 != 0, F.concat(F.lit("t"), _str("u"))).alias("telegram_chat_id"), F.lit(None).cast("string").alias("email"), F.lit("telegram").alias("notification_channel"), (F.col("u") % 6 != 0).alias("is_active"),
    )
    return alerts.reachable(_order_alerts(spark, sf_dir), users).select("id", F.col("user_id").cast("long").alias("user_id"))


@query("new_users", """WITH c AS (SELECT DISTINCT CASE WHEN o_orderkey % 3 <> 0 THEN 't' || o_custkey END AS t, CASE WHEN o_orderkey % 3 = 0 THEN 'm' || o_custkey END AS m FROM orders WHERE o_custkey % 2 = 1)
 SELECT substr(sha256(coalesce('t:' || t, 'e:' || m)), 1, 32) AS id, CASE WHEN t IS NULL THEN 'email' ELSE 'telegram' END AS channel FROM c""")
def new_users(spark, sf_dir):
    k, c = F.col("o_orderkey"), _str("o_custkey")
    contacts = _read(spark, sf_dir, "orders").select(F.when(k % 3 != 0, F.concat(F.lit("t"), c)).alias("telegram_chat_id"), F.when(k % 3 == 0, F.concat(F.lit("m"), c)).alias("email")).distinct()
    c = _str("c_custkey")
    users = _read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(c.alias("id"), F.concat(F.lit("t"), c).alias("telegram_chat_id"), F.concat(F.lit("m"), c).alias("email"))
    return alerts.resolve_users(contacts, users)[1].select("id", F.col("notification_channel").alias("channel"))


@query("run_digest", f"""WITH {_MATCHES}, sent AS (SELECT user_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY alert_id, rank) AS ids, count(*) AS n FROM matches WHERE rank <= 5 AND user_id % 5 <> 0 GROUP BY 1)
 SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'sent' ELSE 'skipped' END AS status, ids AS offer_ids, n || ' Angebote' AS payload_summary, CASE WHEN user_id % 2 = 0 THEN (SELECT count(*) FROM embeddings e WHERE e.vec_id % 20 = 0 AND e.vec_id % 7 = user_id) ELSE 0 END AS touched FROM sent""")
def run_digest(spark, sf_dir):
    """The whole weekly job: reachable alerts, matches, digests, log rows, alerts touched."""
    rows = _alerts(spark, sf_dir).withColumn("last_triggered_at", F.lit(None).cast("timestamp"))
    users = rows.select(F.col("user_id").alias("id")).distinct().select(
        "id", F.when(F.col("id") % 5 != 0, _str("id")).alias("telegram_chat_id"), F.lit(None).cast("string").alias("email"), F.when(F.col("id") % 2 == 0, "telegram").alias("notification_channel"), F.lit(True).alias("is_active"),
    )
    log, touched = jobs.run_digest(rows, users, _vector_offers(spark, sf_dir), AS_OF, digits=6)
    per = touched.filter("last_triggered_at is not null").groupBy("user_id").agg(F.count("*").alias("touched"))
    return log.join(per, "user_id", "left").select("user_id", "status", F.array_join(F.col("offer_ids").cast("array<string>"), ",").alias("offer_ids"), "payload_summary", F.coalesce("touched", F.lit(0)).alias("touched"))


# search and answers


@query("nearest_offers", f"""WITH {_VECTORS}, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
 pairs AS (SELECT query_id, id, round(list_cosine_similarity(e, v), 6) AS similarity FROM o, q)
 SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM pairs WHERE similarity >= 0.3 QUALIFY rank <= 8""")
def nearest_offers(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all active ones."""
    asked = _read(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit(0.3).alias("cutoff"))
    return search.nearest(asked, _vector_offers(spark, sf_dir), 8, 6).withColumn("rank", F.col("rank").cast("long"))


@query("analysed_offers", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'Gut' END AS deal_verdict FROM part")
def analysed_offers(spark, sf_dir):
    part = _part(spark, sf_dir)
    analyses = part.filter("p_size % 3 = 0").select(_k().alias("offer_id"), F.lit("Gut").alias("deal_verdict"), F.lit(0.5).alias("quality_score"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("key_features"))
    return search.with_analysis(part.select(_k().alias("id")), analyses).select("id", "deal_verdict")


@query("cited_offers", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7) ORDER BY 1 LIMIT 12")
def cited_offers(spark, sf_dir):
    cited = _read(spark, sf_dir, "lineitem").filter("l_quantity = 7").select(F.col("l_partkey").alias("id"))
    return search.cited_offers(_part(spark, sf_dir).select(_k().alias("id")), cited)


def _first_matches(spark, sf_dir):
    """The matches of the first alert that has any; all matches are computed once and go by as one row for each alert."""
    lists = _matches(spark, sf_dir).groupBy("alert_id").agg(F.collect_list(F.struct("alert_id", "id", "similarity", "rank")).alias("found"))
    return lists.agg(F.min_by("found", "alert_id").alias("found")).select(F.inline("found"))


@query("source_links", f"""WITH {_MATCHES} SELECT alert_id, id, rank FROM matches WHERE alert_id = (SELECT min(alert_id) FROM matches) AND rank <= 5 AND id % 3 <> 0""")
def source_links(spark, sf_dir):
    own = _first_matches(spark, sf_dir).withColumn("url", F.when(F.col("id") % 3 != 0, F.concat(F.lit("https://o.example/"), _str("id"))).otherwise(" "))
    return search.source_list(own).select("alert_id", "id", F.col("rank").cast("long").alias("rank"))


@query("comparison_rows", f"""WITH {_MATCHES} SELECT left(repeat('Angebot ' || id || ' ', 8), 40) AS title, 's' || (id % 4) AS store FROM matches WHERE alert_id = (SELECT min(alert_id) FROM matches) ORDER BY similarity DESC, id LIMIT 6""")
def comparison_rows(spark, sf_dir):
    # the matches of one alert are few
    own = _vector_offers(spark, sf_dir).select("id", "price", "discount_percent", "store").join(F.broadcast(_first_matches(spark, sf_dir)), "id")
    named = own.withColumns({"title": F.repeat(F.concat(F.lit("Angebot "), _str("id"), F.lit(" ")), 8), "deal_verdict": F.lit(None).cast("string")})
    return search.comparison_rows(named).select("title", "store")


@query("latest_brochures", "SELECT doc_id, source AS store FROM documents WHERE source ILIKE '%src2%' ORDER BY n_chars DESC, doc_id LIMIT 8")
def latest_brochures(spark, sf_dir):
    pages = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("external_id"), F.lit("x").alias("title"), F.lit(None).cast("string").alias("brochure_title"), F.col("source").alias("store"), F.col("n_chars").alias("scraped_at"), F.col("doc_id").alias("page_number"))
    return search.latest_brochure_pages(pages, ["src2"]).select(F.col("external_id").alias("doc_id"), "store")


@query("answer_generic", f"""WITH {OFFERS_SQL}, t AS (SELECT *, DATE '2024-01-01' + CAST(external_id % 40 AS INTEGER) > DATE '2024-01-20' AS is_upcoming FROM offers WHERE is_active),
 c AS (SELECT * FROM t WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND (valid_to IS NULL OR valid_to >= DATE '2024-01-20') ORDER BY is_upcoming, valid_from ASC NULLS LAST, tenths DESC NULLS LAST, scraped_at DESC, external_id LIMIT 8)
 SELECT external_id, 0 AS tier FROM c""")
def answer_generic(spark, sf_dir):
    return search.answer_candidates(_offers(spark, sf_dir), True, None, AS_OF).select("external_id", "tier")


@query("answer_fallback", f"""WITH {OFFERS_SQL}, t AS (SELECT * FROM offers WHERE is_active AND valid_from > DATE '2024-01-20') SELECT external_id, 1 AS tier FROM (SELECT * FROM t ORDER BY valid_from, tenths DESC NULLS LAST, scraped_at DESC, external_id LIMIT 8)""")
def answer_fallback(spark, sf_dir):
    """Nothing runs now: the latest offers answer."""
    return search.answer_candidates(_offers(spark, sf_dir).filter("valid_from > date'2024-01-20'"), True, None, AS_OF).select("external_id", "tier")


@query("clean_keywords", "SELECT p_partkey, lower(p_brand) || ',' || lower(split_part(p_name, ' ', 1)) AS words FROM part")
def clean_keywords(spark, sf_dir):
    words = F.array(F.concat(F.lit(" "), "p_brand"), F.lit("x"), F.element_at(F.split("p_name", " "), 1), F.repeat(F.lit("lang"), 11), F.lit(" "))
    return _part(spark, sf_dir).select("p_partkey", F.array_join(querytext.clean_keywords(words), ",").alias("words"))


_REVIEWS = ("Bitte den Katalog von Edeka und LIDL manuell prüfen", "/review", "nur der Katalog", "danke", "catalog review of Aldi")


@query("review_queries", f"""WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || {_pick(_REVIEWS, 'conv_id')}) AS t FROM conversations), s AS (SELECT *, list_filter(['lidl', 'aldi', 'edeka'], lambda x: contains(t, x)) AS named FROM m)
 SELECT conv_id, turn, contains(t, '/review') OR ((contains(t, 'katalog') OR contains(t, 'catalog')) AND (contains(t, 'review') OR contains(t, 'prüf') OR contains(t, 'pruef'))) AS is_review,
 array_to_string(CASE WHEN len(named) > 0 THEN named ELSE ['lidl', 'aldi', 'edeka'] END, ',') AS stores, CASE WHEN contains(t, 'manual') OR contains(t, 'manuell') THEN 'manual' ELSE 'auto' END AS mode FROM s""")
def review_queries(spark, sf_dir):
    """The messages, each with a request behind it."""
    said = F.concat_ws(" ", F.coalesce("text", F.lit("")), _pick_col(_REVIEWS, F.col("conv_id")))
    rows = querytext.tag_queries(_read(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("text")))
    return rows.select("conv_id", "turn", "is_review", F.array_join("review_stores", ",").alias("stores"), F.col("review_mode").alias("mode"))


@query("message_tags", f"""WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t FROM conversations), f AS (SELECT *, {ALERT_SQL} FROM m) SELECT conv_id, turn, {TAGS_SQL} FROM f""")
def message_tags(spark, sf_dir):
    """The real messages, as they are."""
    rows = querytext.tag_queries(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", "intent", "is_brochure", F.array_join("stores", ",").alias("stores"), "price_cap")


# reports and feeds


@query("report_expiring", f"WITH {OFFERS_SQL} SELECT external_id FROM offers WHERE (valid_from IS NULL OR valid_from <= DATE '2024-01-20') AND valid_to BETWEEN DATE '2024-01-20' AND DATE '2024-01-22' ORDER BY valid_to, tenths DESC NULLS LAST, external_id LIMIT 10")
def report_expiring(spark, sf_dir):
    return stats.report_lists(_offers(spark, sf_dir), AS_OF)["expiring"].select("external_id")


@query("report_newest", f"WITH {OFFERS_SQL} SELECT external_id FROM offers ORDER BY scraped_at DESC, external_id LIMIT 12")
def report_newest(spark, sf_dir):
    return stats.report_lists(_offers(spark, sf_dir), AS_OF)["newest"].select("external_id")


@query("load_summary", f"""WITH {OFFERS_SQL} SELECT 'stores' AS list, coalesce(store, 'Unknown') AS name, count(*) AS n FROM offers GROUP BY 2
 UNION ALL (SELECT 'keywords', coalesce(category, 'Unknown'), count(*) AS n FROM offers GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)
 UNION ALL SELECT 'with_discount', '', count(tenths) FROM offers UNION ALL SELECT 'with_loyalty', '', count(*) FROM offers WHERE external_id % 3 = 0""")
def load_summary(spark, sf_dir):
    got = stats.load_summary(_offers(spark, sf_dir).withColumn("requires_loyalty", F.col("external_id") % 3 == 0))
    flags = got["flags"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("list"), F.lit("").alias("name"), F.col(c).alias("n")) for c in ("with_discount", "with_loyalty")])).alias("x")).select("x.*")
    return got["stores"].select(F.lit("stores").alias("list"), F.col("store").alias("name"), "n").unionByName(got["keywords"].select(F.lit("keywords").alias("list"), F.col("category").alias("name"), "n")).unionByName(flags)


@query("feed_union", f"""WITH {OFFERS_SQL}, f AS (SELECT external_id FROM offers WHERE tenths IS NOT NULL ORDER BY tenths DESC, external_id LIMIT 40), r AS (SELECT external_id FROM offers WHERE is_active ORDER BY cents, external_id LIMIT 40) SELECT external_id FROM f UNION SELECT external_id FROM r""")
def feed_union(spark, sf_dir):
    rows = _offers(spark, sf_dir)
    feed = rows.filter("discount_percent is not null").orderBy(F.desc("discount_percent"), "external_id").limit(40)
    radar = rows.filter("is_active").orderBy("price", "external_id").limit(40)
    return stats.feed_ids(feed, radar)


@query("daily_arrivals", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def daily_arrivals(spark, sf_dir):
    from promolens.streaming.ingest import daily_counts

    rows = daily_counts(_read(spark, sf_dir, "events").withColumn("scraped_at", F.col("ts").cast("timestamp")))
    return rows.select(_str("day").alias("day"), "n")
