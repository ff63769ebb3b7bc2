"""Saved searches: users, matches and digests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filters import optional_filters
from .search import nearest


def resolve_users(contacts: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contacts with user_id, users to insert): by chat id, else e-mail, else new.

    ``contacts`` has telegram_chat_id and email. A new user's id follows from the
    contact, its channel from what is known.
    """
    by_chat = users.filter("telegram_chat_id is not null").select("telegram_chat_id", F.col("id").alias("chat_user"))
    by_mail = users.filter("email is not null").select("email", F.col("id").alias("mail_user"))
    made = F.substring(F.sha2(F.coalesce(F.concat(F.lit("t:"), "telegram_chat_id"), F.concat(F.lit("e:"), "email")), 256), 1, 32)
    found = contacts.join(by_chat, "telegram_chat_id", "left").join(by_mail, "email", "left")
    known = found.select("telegram_chat_id", "email", F.coalesce("chat_user", "mail_user", made).alias("user_id"), F.coalesce("chat_user", "mail_user").isNull().alias("is_new"))
    channel = F.when(F.col("telegram_chat_id").isNull(), "email").when(F.col("email").isNull(), "telegram").otherwise("both")
    new = known.filter("is_new and user_id is not null").groupBy("user_id").agg(F.min("telegram_chat_id").alias("telegram_chat_id"), F.min("email").alias("email"))
    return known.select("telegram_chat_id", "email", "user_id"), new.select(F.col("user_id").alias("id"), "telegram_chat_id", "email", channel.alias("notification_channel"), F.lit(True).alias("is_active"))


def create_alerts(current: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Alerts with new ones appended; the threshold defaults to 0.70."""
    rows = requests.withColumns({
        "similarity_threshold": F.coalesce("similarity_threshold", F.lit(0.7)), "is_active": F.lit(True),
        "created_at": F.lit(as_of).cast("timestamp"), "updated_at": F.lit(as_of).cast("timestamp"),
    })
    return current.unionByName(rows, allowMissingColumns=True)


def list_alerts(alerts: DataFrame, user_id: str) -> DataFrame:
    return alerts.filter((F.col("user_id") == user_id) & F.col("is_active")).orderBy(F.desc("created_at"), "id")


def deactivate_alerts(alerts: DataFrame, requests: DataFrame) -> DataFrame:
    """Alerts with those named by (id, user_id) switched off."""
    off = requests.select("id", "user_id").distinct().withColumn("__off", F.lit(True))
    return alerts.join(off, ["id", "user_id"], "left").withColumn("is_active", F.col("is_active") & F.col("__off").isNull()).drop("__off").select(*alerts.columns)


def reachable(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Active alerts of active users with a contact."""
    u = users.filter("is_active and (telegram_chat_id is not null or email is not null)").select(F.col("id").alias("user_id"), "telegram_chat_id", "email", "notification_channel")
    return alerts.filter("is_active").join(u, "user_id")


def alert_queries(alerts: DataFrame, strict: bool = True) -> DataFrame:
    """Active alerts with a vector as search queries: (query_id, vector, cutoff and conditions)."""
    return alerts.filter("is_active and query_embedding is not null").select(
        F.col("id").alias("query_id"), F.col("query_embedding").alias("vector"), F.col("similarity_threshold").cast("double").alias("cutoff"), "max_price",
        F.get("categories", F.lit(0)).alias("category"), *(["stores", "min_discount"] if strict else []),
    )


def match_alerts(alerts: DataFrame, offers: DataFrame, as_of: datetime, days: int = 7, k: int = 8, strict: bool = True, digits: int | None = None) -> DataFrame:
    """(alert_id, id, similarity, rank): the k best offers of the last ``days`` days for each alert.

    Price cap, first category and threshold apply; with ``strict`` also the
    alert's stores and least discount, before ranking.
    """
    since = datetime.fromtimestamp(as_of.timestamp() - days * 86400, as_of.tzinfo)
    recent = optional_filters(offers, since=since)
    return nearest(alert_queries(alerts, strict), recent, k, digits).withColumnRenamed("query_id", "alert_id")


def build_digests(matches: DataFrame, alerts: DataFrame, shown: int = 5) -> DataFrame:
    """One row per user: sections of alerts, each with its best offers in order."""
    offers = F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"])
    sections = (
        matches.filter(F.col("rank") <= shown).groupBy("alert_id").agg(offers.alias("offer_ids"))
        .join(alerts.select(F.col("id").alias("alert_id"), "user_id", "name"), "alert_id")
    )
    return sections.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.struct("alert_id", "name", "offer_ids"))).alias("sections"), F.sum(F.size("offer_ids")).alias("n_offers")
    )


def notification_rows(digests: DataFrame, outcomes: DataFrame, as_of: datetime) -> DataFrame:
    """Log rows of sent and failed digests: outcomes has user_id, channel, status, error_message."""
    ids = F.flatten(F.transform("sections", lambda s: s["offer_ids"]))
    return digests.join(outcomes, "user_id").select(
        "user_id", F.lit(None).cast("string").alias("alert_id"), "channel", "status", ids.alias("offer_ids"),
        F.concat(F.col("n_offers").cast("string"), F.lit(" Angebote")).alias("payload_summary"), "error_message", F.lit(as_of).cast("timestamp").alias("sent_at"),
    )


def touch_alerts(alerts: DataFrame, digests: DataFrame, as_of: datetime) -> DataFrame:
    """Alerts with the time of the last digest for all alerts of users who had one."""
    had = digests.select("user_id").distinct().withColumn("__had", F.lit(True))
    stamp = F.when(F.col("__had"), F.lit(as_of).cast("timestamp")).otherwise(F.col("last_triggered_at"))
    return alerts.join(had, "user_id", "left").withColumn("last_triggered_at", stamp).select(*alerts.columns)
