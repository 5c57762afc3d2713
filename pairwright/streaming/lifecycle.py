"""The life of roles as a stream: first sighted, stale while their source fails, evicted in the end, or back alive.

Roles are dealt to BUCKETS by the hash of their id, as a call of Python for each role costs far more than its
rows do. A bucket's state is a list of its roles with three instants each, and one timer for the stale role that
ends first. Roles that are evicted leave no state, and nor do buckets without roles.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pairwright.functions.ship import ship
from pairwright.operators.snapshot import STALE_DAYS
from pairwright.streaming.jobs import run_to_table

#: The state store that timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What happens to a role, and when; first_seen is that of the life it belongs to.
CHANGES = "id string, change string, at timestamp, first_seen timestamp, stale_since timestamp"
_OUT = "id string, change string, at long, first_seen long, stale_since long"
_STATE = "ids array<string>, first_seen array<long>, last_seen array<long>, stale_since array<long>"
_DAY = 86_400_000_000
#: Part of a checkpoint's layout: it can't change for a stream that goes on.
BUCKETS = 16_384
#: First and last sighting of a role, and since when it is stale.
Life = tuple[int | None, int | None, int | None]


class Lifecycle(StatefulProcessor):
    """Sightings (id, at, failed) of a bucket's roles to their changes.

    failed says that the role's source could not be reached then; it makes a known role stale and tells
    nothing of an unknown one. A sighting before `days` have passed brings the role back with its first
    sighting, a later one begins a new life. A row counts by its own time, so the outcome doesn't depend on
    how rows are dealt to batches; rows older than what has been seen of the role change nothing.
    """

    def __init__(self, days: int = STALE_DAYS):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("life", _STATE)

    def _end(self, stale: int) -> int:
        return stale + self.days * _DAY

    def _timer(self, lives: dict[str | None, Life]) -> int | None:
        """When the bucket's first stale role ends, in ms."""
        stale = min((s for _, _, s in lives.values() if s is not None), default=None)
        return None if stale is None else -(-self._end(stale) // 1000)

    def _held(self) -> dict[str | None, Life]:
        if not self.state.exists():
            return {}
        ids, *instants = self.state.get()
        return dict(zip(ids, zip(*instants, strict=True), strict=True))

    def _keep(self, lives: dict[str | None, Life], was: int | None) -> None:
        """Writes the bucket; was: the timer that it has."""
        ends = self._timer(lives)
        if ends != was:
            if was is not None:
                self.handle.deleteTimer(was)
            if ends is not None:
                self.handle.registerTimer(ends)
        if lives:
            self.state.update((list(lives), *map(list, zip(*lives.values(), strict=True))))
        else:
            self.state.clear()

    def _lived(self, role: str | None, life: Life, rows: list[tuple[int, bool]], out: list[tuple]) -> Life:
        """The role's life after its rows in order; its changes go to out."""
        first, last, stale = life
        for at, failed in rows:
            if last is not None and at < last:
                continue
            if stale is not None and at >= self._end(stale):
                out.append((role, "evicted", self._end(stale), first, stale))
                first = last = stale = None
            if failed and first is not None and stale is None:
                stale = at
                out.append((role, "stale", at, first, stale))
            elif not failed and first is None:
                first = at
                out.append((role, "first", at, first, None))
            elif not failed and stale is not None:
                out.append((role, "alive", at, first, stale))
                stale = None
            if first is not None:
                last = at
        return first, last, stale

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str | None, list[tuple[int, bool]]] = {}
        for part in rows:
            for role, at, failed in zip(part["id"].tolist(), part["us"].tolist(), part["failed"].tolist(), strict=True):
                found.setdefault(role, []).append((at, failed is True))
        lives, out = self._held(), []
        was = self._timer(lives)
        for role, sightings in found.items():
            life = self._lived(role, lives.get(role, (None, None, None)), sorted(sightings), out)
            if life[0] is None:
                lives.pop(role, None)
            else:
                lives[role] = life
        self._keep(lives, was)
        if out:
            yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lives, now = self._held(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        gone = [(role, "evicted", self._end(stale), first, stale) for role, (first, _, stale) in lives.items() if stale is not None and -(-self._end(stale) // 1000) <= now]
        for role, *_ in gone:
            del lives[role]
        self._keep(lives, None)  # its timer is spent
        if gone:
            yield self._table(gone)

    @staticmethod
    def _table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "change", "at", "first_seen", "stale_since"]).astype({"stale_since": "Int64"})

    def close(self) -> None:
        pass


def role_changes(sightings: DataFrame, delay: str = "0 seconds", days: int = STALE_DAYS) -> DataFrame:
    """CHANGES of a stream of sightings (id, at, failed); for append. Rows later than the watermark's delay are dropped by Spark."""
    ship(sightings.sparkSession)
    at = F.col("at").cast("timestamp")
    rows = sightings.filter(at.isNotNull()).select(F.col("id").cast("string").alias("id"), at.alias("at"), F.unix_micros(at).alias("us"), "failed")
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS))).withWatermark("at", delay).groupBy("bucket")
    found = keyed.transformWithStateInPandas(Lifecycle(days), outputStructType=_OUT, outputMode="Append", timeMode="EventTime")
    return found.select("id", "change", *(F.timestamp_micros(c).alias(c) for c in ("at", "first_seen", "stale_since")))


def run_changes(sightings: DataFrame, checkpoint: str, **options) -> DataFrame:
    """Runs role_changes over what there is now, on from the checkpoint, and reads all changes so far."""
    conf, name = sightings.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, PROVIDER)
    try:
        return run_to_table(role_changes(sightings, **options), "changes", checkpoint)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
