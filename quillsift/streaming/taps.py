"""Double taps, near misses and adaptive windows over events of users: in batch by windows, in streams by keyed state.

A tap within the window of the tap before it makes a double, after which counting starts anew; a tap that begins a new run after an odd
run, within twice the window, was a near miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.columns import free_names, named

DEFAULT_WINDOW_MS, SAMPLES, LEAST_SAMPLES = 450, 100, 10


def taps(df: DataFrame, window_ms: int | Column = DEFAULT_WINDOW_MS, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), range_ms: int = 6 * 3_600_000) -> DataFrame:
    """df with gap_ms and kind: first, double or miss; columns of these names are replaced.

    Events of a key are dealt by ranges of time, so a key with a third of all events is no hot key: the last event and the length of the
    open run at each range's end, a row a range, are carried over the borders."""
    df = df.drop(*[c for c in df.columns if c.lower() in ("gap_ms", "kind")])
    own, part, us, w, gap, breaks, run, place, before, last, carry, head = free_names(df, "own", "part", "us", "w", "gap", "breaks", "run", "place", "before", "last", "carry", "head")
    out = df.withColumns({us: F.unix_micros(F.col(order[0]).cast("timestamp")), w: F.lit(window_ms) if isinstance(window_ms, int) else window_ms})
    out = out.withColumn(part, F.floor(F.col(us) / (range_ms * 1000)))
    near = Window.partitionBy(key, part).orderBy(*order)
    out = out.withColumn(gap, (F.col(us) - F.lag(us).over(near)) / 1000)
    out = out.withColumn(breaks, F.coalesce(F.col(gap) > F.col(w), F.lit(False)))
    out = out.withColumn(run, F.sum(F.col(breaks).cast("int")).over(near))
    out = out.withColumn(place, F.row_number().over(Window.partitionBy(key, part, run).orderBy(*order)))

    # a row a range: its first event's time and window, its last event's time, runs, and the length of its last run
    ends = out.groupBy(key, part).agg(F.min_by(F.struct(us, w), F.struct(*order)).alias("first"), F.max(us).alias("until"), F.max(run).alias("runs"), F.max_by(place, F.struct(*order)).alias("open"))
    ranges = Window.partitionBy(key).orderBy(part)
    ends = ends.withColumn("gap", (F.col(f"first.{us}") - F.lag("until").over(ranges)) / 1000)
    # an open run goes on through a range without a break; it starts anew at a break inside or before the range
    anew = F.col("gap").isNull() | (F.col("gap") > F.col(f"first.{w}"))
    ends = ends.withColumn("anew", anew).withColumn("chain", F.sum((F.col("anew") | (F.col("runs") > 0)).cast("int")).over(ranges))
    ends = ends.withColumn("open", F.sum("open").over(Window.partitionBy(key, "chain").orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.withColumn("reached", F.lag("open").over(ranges))
    ends = ends.select(F.col(key).alias(own), F.col(part).alias(last), F.col("gap").alias(head), F.when(~F.col("anew"), F.col("reached")).otherwise(0).alias(carry), F.col("reached").alias(before))
    out = out.join(ends, out[key].eqNullSafe(ends[own]) & (out[part] == ends[last]), "left").select(*[out[c] for c in out.columns], head, carry, before)
    out = out.withColumn(place, F.col(place) + F.when(F.col(run) == 0, F.col(carry)).otherwise(0))
    out = out.withColumn(before, F.coalesce(F.lag(place).over(near), F.col(before)))
    gap_ms = F.coalesce(F.col(gap), F.col(head))
    kind = F.when(F.col(place) % 2 == 0, "double").when((F.col(place) == 1) & (F.col(before) % 2 == 1) & (gap_ms < 2 * F.col(w)), "miss").otherwise("first")
    return out.select(*map(named, df.columns), gap_ms.alias("gap_ms"), kind.alias("kind"))


def last_samples(gaps: DataFrame, key: str = "user_id", value: str = "gap_ms", order: tuple[str, ...] = ("ts", "event_id"), n: int = SAMPLES) -> DataFrame:
    """The n newest rows with a value of each key."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    (place,) = free_names(gaps, "place")
    return gaps.where(F.col(value).isNotNull()).withColumn(place, F.row_number().over(newest)).where(F.col(place) <= n).drop(place)


def adaptive_windows(samples: DataFrame, key: str = "user_id", value: str = "gap_ms") -> DataFrame:
    """Each key's value at nine tenths of its sorted samples (by index, rounded down); 0 under LEAST_SAMPLES samples."""
    sorted_ = F.sort_array(F.collect_list(value))
    return samples.groupBy(key).agg(F.count(value).alias("n_samples"), F.when(F.count(value) < LEAST_SAMPLES, F.lit(0).cast("double")).otherwise(F.element_at(sorted_, (F.floor(F.count(value) * 9 / 10) + 1).cast("int"))).alias("window_ms"))


def chosen_window(adaptive: Column, configured: Column | int | None = None) -> Column:
    """The adaptive window if there is one, else the configured one, else the default."""
    own = F.lit(None).cast("double") if configured is None else F.lit(configured) if isinstance(configured, int) else configured
    return F.coalesce(F.nullif(adaptive, F.lit(0)), own, F.lit(DEFAULT_WINDOW_MS))


def latest(df: DataFrame, key: str, generation: str) -> DataFrame:
    """The row of the newest generation of each key: an older result may not replace a newer one."""
    return df.groupBy(F.col(key).alias("key")).agg(F.max_by(F.struct("*"), generation).alias("row")).select("row.*")


def without_echoes(df: DataFrame, own: DataFrame, change: str = "change_id") -> DataFrame:
    """Changes that aren't one's own write-backs."""
    return df.join(own.select(change), change, "left_anti")


def toast_seconds(count: Column) -> Column:
    return F.when(count < 30, 1.5).when(count < 40, 1.0).when(count < 50, 0.5).otherwise(0.0)


#: The key that is tapped, and the flags that must be up and down with it.
TAP_KEY, FLAGS_UP, FLAGS_DOWN = 8, ("command",), ("control", "alternate", "repeated", "paused")


def is_tap(key_code: Column, **flags: Column) -> Column:
    """Whether a key event counts as a tap: the key with the command key alone, not repeated by itself, and not while paused. Flags
    that aren't given are down; null ones too."""
    up = lambda name: F.coalesce(flags[name], F.lit(False)) if name in flags else F.lit(False)
    out = F.coalesce(key_code == TAP_KEY, F.lit(False))
    for name in FLAGS_UP:
        out = out & up(name)
    for name in FLAGS_DOWN:
        out = out & ~up(name)
    return out


#: Milliseconds for which a prepared candidate can be used.
CANDIDATE_MS = 1_000


def with_candidates(events: DataFrame, is_candidate: Column, is_change: Column, key: str = "user_id", order: tuple[str, ...] = ("ts", "event_id"), ttl_ms: int = CANDIDATE_MS) -> DataFrame:
    """events with `candidate`: the time of the newest candidate before each that is still pending: not older than ttl_ms, and no change since.
    Candidates that are changes themselves stand."""
    since = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    made = F.max(F.when(is_candidate, place)).over(since)
    changed = F.max(F.when(is_change & ~is_candidate, place)).over(since)
    fresh = F.unix_micros(F.col(order[0]).cast("timestamp")) - F.unix_micros(made[order[0]].cast("timestamp")) <= ttl_ms * 1000
    return events.withColumn("candidate", F.when(fresh & (changed.isNull() | (changed < made)), made[order[0]]))


TAP_DDL = "user_id bigint, event_id bigint, ts timestamp, kind string"
STATE_DDL = "last_ms double, streak int"


def stream_taps(events: DataFrame, window_ms: int = DEFAULT_WINDOW_MS, ttl_ms: int = 1_000, lateness: str = "10 minutes") -> DataFrame:
    """taps() over a stream (user_id, event_id, ts): state is the last tap and how many are in its run, and goes ttl_ms of event
    time after it can matter. Rows of a key are sorted within a batch; rows later than the watermark are dropped by Spark."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last, streak = state.get if state.exists else (float("-inf"), 0)
        kinds = []
        for ms in rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e3:
            gap = ms - last
            if gap <= window_ms:
                streak += 1
            else:
                kinds.append("miss" if streak % 2 == 1 and gap < 2 * window_ms else "first")
                last, streak = ms, 1
                continue
            kinds.append("double" if streak % 2 == 0 else "first")
            last = ms
        state.update((last, streak))
        state.setTimeoutTimestamp(max(int(last + 2 * window_ms + ttl_ms), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(kind=kinds)[["user_id", "event_id", "ts", "kind"]]

    return events.select("user_id", "event_id", "ts").withWatermark("ts", lateness).groupBy("user_id").applyInPandasWithState(step, TAP_DDL, STATE_DDL, "append", GroupStateTimeout.EventTimeTimeout)
