"""Standing alerts over a stream of offers: each alert's best offers of the last days, kept in state.

An alert's state holds the sightings of offers that are among its best or may still
become so: one that ``k`` other offers beat in likeness and outlive is dropped, and
nothing that comes later can bring it back, as sightings never change. A timer for
the oldest of them takes sightings out when they leave the window. What an alert's user was told of is remembered as long as it could come
up again, so nothing is reported twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DataType, StructType

from promolens.operators.alerts import alert_queries
from promolens.operators.search import scored_pairs

DAY_MS = 86_400_000


Sightings = dict[tuple[Any, int], float]  # (offer, time in ms) -> likeness


def best_offers(held: Sightings, k: int) -> list[tuple[float, Any]]:
    """The ``k`` best of (-likeness, offer), each offer with its best sighting."""
    best: dict[Any, float] = {}
    for (key, _), likeness in held.items():
        best[key] = max(likeness, best.get(key, likeness))
    return sorted((-likeness, key) for key, likeness in best.items())[:k]


def still_useful(held: Sightings, k: int) -> Sightings:
    """The sightings that no later one of their offer equals and fewer than ``k`` other offers beat and outlive."""
    out: Sightings = {}
    later: dict[Any, float] = {}  # best likeness of each offer among what leaves later or at the same time
    for (key, at), likeness in sorted(held.items(), key=lambda x: (-x[0][1], -x[1], x[0][0])):
        if later.get(key, -2.0) >= likeness:
            continue
        if sum(name != key and (other > likeness or other == likeness and name < key) for name, other in later.items()) < k:
            out[key, at] = later[key] = likeness
    return out


class _Best(StatefulProcessor):
    def __init__(self, k: int, days: int, kind: DataType):
        self.k, self.span, self.kind = k, days * DAY_MS, kind.simpleString()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", f"id {self.kind}, at long", "similarity double")
        self.told = handle.getMapState("told", f"id {self.kind}", "at long")
        self.shown = handle.getValueState("shown", "ids string")

    def _report(self, alert: Any, held: Sightings) -> Iterator[pd.DataFrame]:
        """The alert's list if it is another one than before."""
        best = best_offers(held, self.k)
        now, before = repr(best), self.shown.get()
        if before is not None and before[0] == now or before is None and not best:
            return
        self.shown.update((now,))
        rows = [(alert, i, -s, n + 1, not self.told.containsKey((i,))) for n, (s, i) in enumerate(best)] or [(alert, None, None, 0, False)]
        yield pd.DataFrame(rows, columns=["alert_id", "id", "similarity", "rank", "is_new"])

    def _load(self, since: int) -> Sightings:
        return {(key[0], key[1]): value[0] for key, value in self.held.iterator() if key[1] >= since}

    def _store(self, held: Sightings, since: int) -> None:
        for key in [(x[0], x[1]) for x in self.held.keys()]:
            if key not in held:
                self.held.removeKey(key)
        for key, likeness in held.items():
            self.held.updateValue(key, (likeness,))
        for _, i in best_offers(held, self.k):
            self.told.updateValue((i,), (max(at for key, at in held if key == i),))
        for i in [x[0] for x, at in self.told.iterator() if at[0] < since]:
            self.told.removeKey((i,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if held:
            self.handle.registerTimer(min(at for _, at in held) + self.span + 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        since = timerValues.getCurrentWatermarkInMs() - self.span
        held = self._load(since)
        for pdf in rows:
            for i, similarity, at in zip(pdf["id"].tolist(), pdf["similarity"].tolist(), pdf["ms"].tolist(), strict=True):
                if at >= since:
                    held[i, at] = max(similarity, held.get((i, at), similarity))
        held = still_useful(held, self.k)
        yield from self._report(key[0], held)
        self._store(held, since)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        since = timerValues.getCurrentWatermarkInMs() - self.span
        held = self._load(since)
        yield from self._report(key[0], held)
        self._store(held, since)

    def close(self) -> None:
        pass


def standing_matches(offers: DataFrame, alerts: DataFrame, days: int = 7, k: int = 8, strict: bool = True, digits: int | None = None, late: str = "0 seconds") -> DataFrame:
    """A stream of (alert_id, id, similarity, rank, is_new): an alert's whole list whenever it changes.

    ``offers`` is a stream with scraped_at, ``alerts`` a table. The list is what
    ``match_alerts`` gives for all offers so far at the stream's watermark;
    ``is_new`` marks offers that the alert had not listed before. A list that
    became empty is one row of rank 0 without an id. An offer that is seen several
    times counts with its best sighting of the window. The session needs the RocksDB state store.
    """
    kind = offers.schema["id"].dataType
    seen = offers.withColumn("scraped_at", F.col("scraped_at").cast("timestamp")).withWatermark("scraped_at", late)
    pairs = scored_pairs(alert_queries(alerts, strict), seen, digits).filter(F.col("similarity") >= F.col("cutoff"))
    rows = pairs.select(F.col("query_id").alias("alert_id"), "id", "similarity", F.unix_millis("scraped_at").alias("ms"), "scraped_at")
    out = StructType().add("alert_id", alerts.schema["id"].dataType).add("id", kind).add("similarity", "double").add("rank", "integer").add("is_new", "boolean")
    return rows.groupBy("alert_id").transformWithStateInPandas(_Best(k, days, kind), out, "Update", "EventTime")
