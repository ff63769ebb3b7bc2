"""Crawled listing pages and cards to offer rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions import prices, text, validity
from promolens.functions.taxonomy import longest_path
from promolens.operators.merge import dedupe_first
from promolens.schema import OFFERS

_NODE = "struct<id:string,name:string>"
ITEM = (
    "struct<id:string,type:string,title:string,description:string,brand:string,publisherName:string,validFrom:string,validUntil:string,"
    "parentContent:struct<id:string,page:struct<number:int>>,"
    "prices:struct<mainPrice:double,secondaryPrice:double,priceRange:boolean,"
    "conditions:array<struct<loyaltyProgram:struct<isCard:boolean,name:string>,other:string>>>,"
    "offerImages:struct<url:struct<large:string,normal:string,thumbnail:string>>,"
    f"categoryPaths:array<array<{_NODE}>>>"
)
_BUCKET = f"struct<items:array<{ITEM}>>"
_LISTING = f"struct<props:struct<pageProps:struct<pageInformation:struct<offers:struct<main:{_BUCKET},topRanked:{_BUCKET},otherPublishers:{_BUCKET}>>>>>"
#: The element of a listing page that holds its data.
DATA_PATTERN = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'


def extract_listing_json(pages: DataFrame) -> DataFrame:
    """``pages`` (html) with ``listing``: the page's embedded JSON, null if absent or malformed."""
    raw = F.nullif(F.regexp_extract("html", DATA_PATTERN, 1), F.lit(""))
    return pages.withColumn("listing", F.from_json(raw, _LISTING, {"mode": "PERMISSIVE"}))


def explode_listing_items(listings: DataFrame) -> DataFrame:
    """One row per offer item with its position, over the page's three lists in order."""
    offers = "listing.props.pageProps.pageInformation.offers"
    none = F.array().cast(f"array<{ITEM}>")
    every = F.concat(*[F.coalesce(F.col(f"{offers}.{b}.items"), none) for b in ("main", "topRanked", "otherPublishers")])
    rest = [c for c in listings.columns if c not in ("html", "listing")]
    return listings.select(*rest, F.posexplode(every).alias("pos", "item")).filter("item.type = 'OFFER' and item.id <> ''")


def discover_keywords(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(keyword, page_no, pos): offer links of index pages, first seen first, each once."""
    slugs = F.regexp_extract_all("html", F.lit(r'/Angebote/([^"\'/?#<>\s]+)'), F.lit(1))
    found = pages.select("page_no", F.posexplode(slugs).alias("pos", "keyword"))
    first = found.groupBy("keyword").agg(F.min(F.struct("page_no", "pos")).alias("at")).select("keyword", "at.page_no", "at.pos")
    ordered = first.orderBy("page_no", "pos")
    return ordered if limit is None else ordered.limit(limit)


def normalize_items(items: DataFrame, as_of: datetime, base: str) -> DataFrame:
    """Offer rows from listing items (item, keyword); ``base`` is the site's address."""
    i = F.col("item")
    p = i["prices"]
    loyalty = prices.structured_loyalty(p["conditions"])
    roles = prices.price_roles(p["mainPrice"], p["secondaryPrice"], loyalty["requires_loyalty"])
    top, path = longest_path(i["categoryPaths"])
    start = validity.parse_timestamp(i["validFrom"])
    page = i["parentContent"]["page"]["number"]
    link = F.when(F.nullif(i["parentContent"]["id"], F.lit("")).isNotNull(), text.viewer_url(base, i["parentContent"]["id"], page)).otherwise(
        F.concat(F.lit(f"{base}/Angebote/"), F.col("keyword"))
    )
    images = i["offerImages"]["url"]
    mine = {f.lower() for f in OFFERS.names}
    extra = [c for c in items.columns if c not in ("item", "keyword") and c.lower() not in mine]  # a page's own url is not the offer's
    return items.select(
        *extra, i["id"].alias("external_id"), text.display_title(i["title"], i["brand"]).alias("title"), link.alias("url"),
        text.image_link(images["large"], images["normal"], images["thumbnail"]).alias("image_url"),
        *[v.cast("decimal(10,2)").alias(k) for k, v in roles.items()],
        prices.compute_discount(p["mainPrice"], p["secondaryPrice"], p["priceRange"]).cast("decimal(5,2)").alias("discount_percent"),
        i["publisherName"].alias("store"), F.col("keyword").alias("category"), top.alias("source_category"), path.alias("source_category_path"),
        (page + 1).alias("source_page_number"), loyalty["requires_loyalty"].alias("requires_loyalty"), loyalty["loyalty_program"].alias("loyalty_program"),
        F.coalesce(F.nullif(i["description"], F.lit("")), loyalty["condition_text"]).alias("price_condition_text"),
        validity.date_part(i["validFrom"]).alias("valid_from"), validity.date_part(i["validUntil"]).alias("valid_to"),
        F.coalesce(start > F.lit(as_of).cast("timestamp"), F.lit(False)).alias("is_upcoming"),
    )


def normalize_cards(cards: DataFrame, as_of: datetime) -> DataFrame:
    """Offer rows from card texts: first line brand, last price, the one before store, the rest title.

    ``cards`` has text, alt, image_url, detail_url, detail_text, category. Cards with
    under three lines, no title or no price are left out.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n = F.size("lines")
    middle = F.nullif(F.trim(F.array_join(F.slice("lines", F.lit(2), F.greatest(n - 3, F.lit(0))), " ")), F.lit(""))
    rows = (
        cards.withColumn("lines", lines).filter(n >= 3)
        .withColumn("title", F.coalesce(F.when(n > 3, middle).otherwise(F.get("lines", F.lit(1))), text.title_from_alt(F.col("alt"))))
        .withColumn("price0", prices.clean_price(F.element_at("lines", -1)))
        .filter("title is not null and price0 > 0")
        .withColumn("body", F.coalesce(F.nullif(F.col("detail_text"), F.lit("")), F.array_join("lines", " ")))
        .withColumn("__ref", validity.local_date(F.lit(as_of).cast("timestamp")))
    )
    rows = validity.parse_validity(rows, "body", "__ref")
    program = prices.loyalty_program(F.col("body"))
    rows = rows.withColumns({"loyalty_program": program, "price_condition_text": prices.loyalty_condition(F.col("body"))})
    resolved = prices.resolve_prices(F.col("price0"), F.col("body"), F.col("loyalty_program").isNotNull())
    rows = rows.withColumns({**{f"__{k}": v for k, v in resolved.items()}, "original_price": prices.original_price(F.col("detail_text"))})
    effective = F.coalesce(F.nullif("__loyalty_price", F.lit(0.0)), F.nullif("__standard_price", F.lit(0.0)), "price0")
    return rows.select(
        text.fingerprint_url(F.col("detail_url")).alias("external_id"), "title", F.col("detail_url").alias("url"),
        F.when(F.col("image_url").startswith("//"), F.concat(F.lit("https:"), "image_url")).otherwise(F.col("image_url")).alias("image_url"),
        F.col("__price").alias("price"), F.col("__standard_price").alias("standard_price"), F.col("__loyalty_price").alias("loyalty_price"), "original_price",
        prices.card_discount(effective, F.col("original_price")).alias("discount_percent"), F.element_at("lines", -2).alias("store"), "category",
        F.col("loyalty_program").isNotNull().alias("requires_loyalty"), "loyalty_program", "price_condition_text", "validity_text", "valid_from", "valid_to", "is_upcoming",
    )


def dedupe_offers(offers: DataFrame, keyword_rank: str = "keyword_rank", pos: str = "pos") -> DataFrame:
    """Each offer once: the first by keyword, then position."""
    return dedupe_first(offers, ["external_id"], [keyword_rank, pos])


def brochure_pages_from_images(images: DataFrame, per_brochure: int = 3, limit: int | None = None) -> DataFrame:
    """The first page images of each brochure: (viewer_url, image_url, page_number)."""
    first = images.groupBy("viewer_url", "image_url").agg(F.min("pos").alias("pos"))
    number = F.row_number().over(Window.partitionBy("viewer_url").orderBy("pos", "image_url"))
    pages = first.withColumn("page_number", number).filter(F.col("page_number") <= per_brochure).drop("pos")
    return pages if limit is None else pages.orderBy("viewer_url", "page_number").limit(limit)
