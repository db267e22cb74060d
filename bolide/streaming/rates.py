"""Request rates, latest positions and two-point fits on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

PAIR_SCHEMA = (
    "name string, fired_s double,"
    " a struct<obs_s:double,pos_r:double,pos_theta:double,pos_phi:double>,"
    " b struct<obs_s:double,pos_r:double,pos_theta:double,pos_phi:double>, pair_no long"
)
# 2024-01-01 00:00:00 UTC.
EPOCH_MS = 1_704_067_200_000


def request_rates(
    requests: DataFrame, seconds: int, limit: int, lateness: str = "5 minutes"
) -> DataFrame:
    """Clients over the limit per fixed window; requests may be ``lateness`` late.

    Counts are partial before the shuffle, so one client with most of the
    requests costs one small row per task.
    """
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "client")
        .agg(F.count(F.lit(1)).alias("requests"))
        .filter(F.col("requests") > limit)
        .select("client", F.col("w.start").alias("window_start"), "requests")
    )


def latest_positions(observations: DataFrame) -> DataFrame:
    """Latest position per name; run it in update or complete mode."""
    return (
        observations.groupBy("name")
        .agg(
            F.max_by(
                F.struct("pos_r", "pos_theta", "pos_phi"), F.struct("obs_s", "obs_no")
            ).alias("p")
        )
        .select("name", "p.pos_r", "p.pos_theta", "p.pos_phi")
    )


def _pair_up():
    """State function; nested, so that it travels without this package."""

    def take(key, batches, state):
        import pandas as pd

        held, made = state.get if state.exists else (None, None, None, None, 0), []
        for batch in batches:
            seen = batch.sort_values(["obs_s", "obs_no"])[["obs_s", "pos_r", "pos_theta", "pos_phi"]]
            for row in seen.itertuples(index=False, name=None):
                if held[0] is None:
                    held = (*row, held[4])
                else:
                    made.append((held[:4], row, held[4]))
                    held = (None, None, None, None, held[4] + 1)
            if made:
                fields = ("obs_s", "pos_r", "pos_theta", "pos_phi")
                yield pd.DataFrame(
                    {
                        "name": [key[0]] * len(made),
                        "fired_s": [key[1]] * len(made),
                        "a": [dict(zip(fields, m[0])) for m in made],
                        "b": [dict(zip(fields, m[1])) for m in made],
                        "pair_no": [m[2] for m in made],
                    }
                )
                made = []
        state.update(held)

    return take


def observation_pairs(observations: DataFrame) -> DataFrame:
    """Two observations of one object become a pair and are then forgotten.

    State per (name, fired_s) is one observation and the number of pairs so
    far. An object's rows pass through in Arrow batches, never all at once.
    Feed the result to ``operators.solve.fit_pairs``.
    """
    return observations.groupBy("name", "fired_s").applyInPandasWithState(
        _pair_up(),
        PAIR_SCHEMA,
        "obs_s double, pos_r double, pos_theta double, pos_phi double, pairs long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def _pairs_in_order(slot_ms: int, idle_ms: int | None):
    """Stateful processor; nested, so that it travels without this package."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    fields = ("obs_s", "pos_r", "pos_theta", "pos_phi")

    class Pairs(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            row = "struct<obs_s:double,obs_no:long,pos_r:double,pos_theta:double,pos_phi:double>"
            self.waiting = handle.getMapState("waiting", "slot long", f"seen array<{row}>")
            columns = ", ".join(f"{f} double" for f in fields)
            self.last = handle.getValueState("last", f"{columns}, lone boolean, pairs long, idle_at long")

        def handleInputRows(self, key, rows, timerValues):
            for part in rows:
                for slot, some in part.groupby(part["at_ms"] // slot_ms):
                    at = (int(slot),)
                    # Plain tuples: the state's own rows can't be written back.
                    seen = map(tuple, self.waiting.getValue(at)[0]) if self.waiting.containsKey(at) else ()
                    new = some[["obs_s", "obs_no", *fields[1:]]].astype(object)
                    new = new.where(new.notna(), None).itertuples(index=False, name=None)
                    self.waiting.updateValue(at, ([*seen, *new],))
                    end = (int(slot) + 1) * slot_ms
                    self.handle.registerTimer(end)
                    if idle_ms is not None:
                        self.handle.registerTimer(end + idle_ms)
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            now = expiredTimerInfo.getExpiryTimeInMs()
            at = (now // slot_ms - 1,)
            *held, lone, pairs, idle_at = self.last.get() if self.last.exists() else (*[None] * 4, False, 0, None)
            if idle_at is not None and idle_at <= now:
                self.last.clear()
                held, lone, pairs = [None] * 4, False, 0
            if not self.waiting.containsKey(at):
                return
            made = []
            for row in sorted(self.waiting.getValue(at)[0], key=lambda r: (r[0], r[1])):
                found = (row[0], *row[2:])
                if lone:
                    made.append((dict(zip(fields, held)), dict(zip(fields, found)), pairs))
                    held, lone, pairs = [None] * 4, False, pairs + 1
                else:
                    held, lone = list(found), True
            self.waiting.removeKey(at)
            self.last.update((*held, lone, pairs, None if idle_ms is None else now + idle_ms))
            if made:
                a, b, number = zip(*made)
                named = {"name": [key[0]] * len(made), "fired_s": [key[1]] * len(made)}
                yield pd.DataFrame({**named, "a": a, "b": b, "pair_no": number})

        def close(self):
            pass

    return Pairs()


def ordered_observation_pairs(
    observations: DataFrame,
    lateness: str = "5 minutes",
    slot_s: int = 10,
    idle_slots: int | None = None,
) -> DataFrame:
    """Pairs of each object's observations in the order of their times, whatever order they come in.

    An observation waits in the slot of its time until the watermark, ``lateness`` behind the latest
    one, has passed the slot's end. Then the slot's observations are paired in order of (obs_s, obs_no), and a lone
    one waits for the next slot. So the pairs are those of ``operators.solve.observation_pairs``
    on all observations that are not later than that; later ones are left out. A timer reads one slot of one object.
    With ``idle_slots``, an object without observations in that many slots is forgotten, with its lone
    observation, and counts its pairs from 0 if it comes back. ``obs_s`` must not be null; seconds count from 2024
    on. The session needs the RocksDB state store.
    """
    at_ms = F.floor(F.col("obs_s") * 1000) + F.lit(EPOCH_MS)
    timed = observations.withColumn("at_ms", at_ms).withColumn("at", F.timestamp_millis("at_ms"))
    return (
        timed.withWatermark("at", lateness)
        .groupBy("name", "fired_s")
        .transformWithStateInPandas(
            _pairs_in_order(slot_s * 1000, None if idle_slots is None else idle_slots * slot_s * 1000),
            PAIR_SCHEMA,
            "Append",
            "EventTime",
        )
    )
