"""Column lists of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, DataType, DateType, DecimalType, FloatType, IntegerType, StringType, StructField, StructType, TimestampType,
)

_PRICE, _PERCENT, _SHARE = "decimal(10,2)", "decimal(5,2)", "decimal(3,2)"


def _kind(name: str) -> DataType:
    if name.startswith("array<"):
        return ArrayType(_kind(name[6:-1]))
    if name.startswith("decimal("):
        return DecimalType(*map(int, name[8:-1].split(",")))
    return {
        "string": StringType(), "boolean": BooleanType(), "int": IntegerType(), "float": FloatType(), "date": DateType(), "timestamp": TimestampType(),
    }[name]


def _schema(columns: str) -> StructType:
    """A schema from "name kind" pairs; it needs no running session."""
    return StructType([StructField(c.split()[0], _kind(c.split()[1])) for c in columns.split(", ")])


OFFERS = _schema(
    f"id string, external_id string, title string, url string, image_url string, price {_PRICE}, standard_price {_PRICE}, loyalty_price {_PRICE}, "
    f"original_price {_PRICE}, discount_percent {_PERCENT}, store string, category string, source_category string, source_category_path string, "
    "requires_loyalty boolean, loyalty_program string, price_condition_text string, validity_text string, valid_from date, valid_to date, "
    "is_upcoming boolean, is_active boolean, first_seen_at timestamp, last_seen_at timestamp, scraped_at timestamp, created_at timestamp, "
    "updated_at timestamp, embedding array<float>"
)
PRICE_HISTORY = _schema(
    f"offer_id string, external_id string, price {_PRICE}, loyalty_price {_PRICE}, original_price {_PRICE}, discount_percent {_PERCENT}, "
    "store string, category string, observed_at timestamp"
)
OFFER_ANALYSES = _schema(
    f"offer_id string, product_name string, brand string, condition string, key_features array<string>, quality_score {_SHARE}, "
    "deal_verdict string, tags array<string>, raw_response string, model_used string, analyzed_at timestamp"
)
LABELS = _schema(
    f"external_id string, model_version string, offer_id string, category string, subcategory string, confidence {_SHARE}, model string, "
    "reasoning string, classified_at timestamp"
)
USERS = _schema("id string, telegram_chat_id string, email string, notification_channel string, is_active boolean, timezone string")
ALERTS = _schema(
    f"id string, user_id string, name string, query_text string, max_price {_PRICE}, min_discount {_PERCENT}, categories array<string>, "
    f"stores array<string>, query_embedding array<float>, similarity_threshold {_SHARE}, is_active boolean, last_triggered_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)
NOTIFICATION_LOG = _schema(
    "user_id string, alert_id string, channel string, status string, offer_ids array<string>, payload_summary string, error_message string, sent_at timestamp"
)
OFFER_REVIEWS = _schema(
    f"review_session_id string, reviewer_user_id string, external_id string, offer_url string, image_url string, scraped_title string, "
    f"scraped_store string, scraped_price {_PRICE}, validity_text string, vision_product_name string, vision_brand string, vision_condition string, "
    "vision_key_features array<string>, vision_verdict string, decision string, created_at timestamp"
)
BROCHURE_PAGES = _schema(
    "external_id string, store string, category string, title string, brochure_title string, viewer_url string, page_number int, image_url string, "
    "validity_text string, valid_from date, valid_to date, is_upcoming boolean, source string, scraped_at timestamp, created_at timestamp, updated_at timestamp"
)
#: Allowed values of enumerated columns.
ENUMS = {
    "condition": ("neu", "gebraucht", "refurbished", "unbekannt"),
    "deal_verdict": ("Sehr gut", "Gut", "Durchschnittlich", "Schlecht"),
    "notification_channel": ("telegram", "email", "both"),
    "status": ("sent", "failed", "skipped"),
    "decision": ("approved", "rejected", "flagged"),
}


def align_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``; missing ones are null, failed casts too."""
    have = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ])


def validate(df: DataFrame, enums: dict[str, tuple[str, ...]] = ENUMS, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) rows: enumerated columns hold an allowed value or null, keys are not null."""
    ok = F.lit(True)
    for name, values in enums.items():
        if name in df.columns:
            ok = ok & (F.col(name).isNull() | F.col(name).isin(*values))
    for key in keys:
        ok = ok & F.col(key).isNotNull()
    return df.filter(ok), df.filter(~ok)
