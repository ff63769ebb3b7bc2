"""Scheduled jobs: one run at a stated point in time."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.operators.alerts import build_digests, match_alerts, notification_rows, reachable, touch_alerts
from promolens.sources.tables import work_folder


def run_digest(alerts: DataFrame, users: DataFrame, offers: DataFrame, as_of: datetime, days: int = 7, k: int = 8, shown: int = 5, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(log rows, alerts afterwards) of one digest run.

    Active alerts of users with a contact are matched with the offers of the last
    ``days`` days. A user with matches gets one digest on the channel they named;
    without a channel it is skipped. Alerts of users who got one are touched.
    Delivery is left to who reads the log. Digests are computed once, here, and
    kept for both results under ``spark.checkpoint.dir``.
    """
    open_ = reachable(alerts, users)
    digests = build_digests(match_alerts(open_.select(*alerts.columns), offers, as_of, days, k, digits=digits), open_.select(*alerts.columns), shown)
    folder = f"{work_folder(alerts.sparkSession)}/digests"
    digests.write.parquet(folder)
    digests = alerts.sparkSession.read.schema(digests.schema).parquet(folder)
    channels = users.select(F.col("id").alias("user_id"), F.col("notification_channel").alias("channel"))
    outcomes = channels.withColumns({"status": F.when(F.col("channel").isNull(), "skipped").otherwise("sent"), "error_message": F.lit(None).cast("string")})
    log = notification_rows(digests, outcomes, as_of)
    return log, touch_alerts(alerts, log.filter("status = 'sent'"), as_of)
