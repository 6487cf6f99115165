"""Request limits: recent usage, admission and expiry, in batch and on a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Permits in all, and those that one request may take.
PERMITS, MOST_PERMITS = 16, 4
TOO_MANY, OVER_QUOTA, BUSY = -3, -2, -1


def overlap_ms(start: Column, end: Column, now: Column, window_ms) -> Column:
    """Milliseconds of [start, end] in the last window_ms before now; an open record runs until now."""
    ends = F.least(F.coalesce(end, now), now)
    begins = F.greatest(start, now - window_ms)
    return F.greatest(ends - begins, F.lit(0))


def recent_usage(records: DataFrame, window_ms: int, key: str = "ip") -> DataFrame:
    """records (key, start_ms, end_ms) with used_ms: what their key used in the window before each one's start.

    The time used up to t is the sum over starts s <= t of (t - s), less the sum over ends e <= t of (t - e): two
    running sums over each key's sorted events answer it for every t without pairing records.
    """
    rows = records.withColumn("_row", F.struct(key, "start_ms"))
    past = records.select(key, F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), "end_ms")
    row = dict(rows.dtypes)["_row"]
    events = past.select(key, F.col("s").alias("t"), F.lit(1).alias("k"), F.lit(None).cast(row).alias("_row"), F.lit(0).alias("q"))
    events = events.unionByName(past.where("end_ms is not null").select(key, F.col("e").alias("t"), F.lit(-1).alias("k"), F.lit(None).cast(row).alias("_row"), F.lit(0).alias("q")))
    for sign, back in ((1, 0), (-1, window_ms)):
        events = events.unionByName(rows.dropDuplicates(["_row"]).select(key, (F.col("start_ms") - back).alias("t"), F.lit(0).alias("k"), "_row", F.lit(sign).alias("q")))
    so_far = Window.partitionBy(key).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    used = events.withColumn("used", F.sum("k").over(so_far) * F.col("t") - F.sum(F.col("k") * F.col("t")).over(so_far))
    found = used.where("q <> 0").groupBy("_row").agg(F.sum(F.col("q") * F.col("used")).cast("long").alias("used_ms"))
    return rows.join(found, "_row").drop("_row")


class _Usage:
    """What one caller has used up to a moment, for moments that only grow: the sum over starts s <= t of (t - s), less the
    same of ends. Each start and end is passed once."""

    def __init__(self):
        self.starts, self.ends, self.at, self.n, self.total = [], [], 0, 0, 0

    def add(self, start: int, end: int) -> None:
        self.starts.append(start)  # callers come in order
        heapq.heappush(self.ends, end)

    def until(self, t: int) -> int:
        while self.at < len(self.starts) and self.starts[self.at] <= t:
            self.n, self.total, self.at = self.n + 1, self.total + self.starts[self.at], self.at + 1
        while self.ends and self.ends[0] <= t:
            self.n, self.total = self.n - 1, self.total - heapq.heappop(self.ends)
        if self.at > 1024:
            del self.starts[: self.at]
            self.at = 0
        return self.n * t - self.total


def admit(requests: pd.DataFrame, quotas: list[tuple[int, int]] = (), permits: int = PERMITS, most: int = MOST_PERMITS) -> pd.DataFrame:
    """Replays one service's requests (ip, start_ms, end_ms, legs) in order: id, or -3, -2, -1.

    Permits are one pool for all callers, so a replay is sequential by nature; partition by service. Each request costs
    about the logarithm of what runs, whatever its ip has asked before.
    """
    out, running, busy, used, number = [], [], 0, {}, 0
    for r in requests.sort_values(["start_ms", "ip"], kind="stable").itertuples(index=False):
        while running and running[0][0] <= r.start_ms:
            busy -= heapq.heappop(running)[1]
        own = used.setdefault(r.ip, (_Usage(), [_Usage() for _ in quotas]))
        now = own[0].until(r.start_ms)
        spent = [now - u.until(r.start_ms - w) for u, (w, _) in zip(own[1], quotas)]
        if r.legs > most:
            code = TOO_MANY
        elif any(s > allowed for s, (_, allowed) in zip(spent, quotas)):
            code = OVER_QUOTA
        elif permits - busy < most:
            code = BUSY
        else:
            code, number = number, number + 1
            heapq.heappush(running, (r.end_ms, r.legs))
            busy += r.legs
            for u in (own[0], *own[1]):
                u.add(r.start_ms, r.end_ms)
        out.append((r.ip, r.start_ms, code))
    return pd.DataFrame(out, columns=["ip", "start_ms", "code"])


def sweep(records: DataFrame, now_ms: int, window_ms: int, default_ms: int, service: str = "service", permits: int = PERMITS) -> DataFrame:
    """(service, kept, expired, in_use, free) after a clean-up: records that ended before the window go, records without an
    end count as ended default_ms after their start, and permits are counted anew from what still runs."""
    ends = F.coalesce(F.col("end_ms"), F.col("start_ms") + default_ms)
    begun = records.where(F.col("start_ms") <= now_ms)
    stays, runs = ends > now_ms - window_ms, ends > now_ms
    whole = begun.groupBy(service).agg(F.count_if(stays).alias("kept"), F.count_if(~stays).alias("expired"), F.coalesce(F.sum(F.when(runs, F.col("legs"))), F.lit(0)).cast("long").alias("in_use"))
    return whole.withColumn("free", F.lit(permits) - F.col("in_use"))


def admissions(requests: DataFrame, service: str = "service", **options) -> DataFrame:
    """Each service's requests with their codes."""
    kind = dict(requests.dtypes)[service]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return admit(group, **options).assign(**{service: group[service].iloc[0]})[[service, "ip", "start_ms", "code"]]

    return requests.groupBy(service).applyInPandas(run, f"{service} {kind}, ip string, start_ms long, code int")


USAGE = "ip string, start_ms long, used_ms long"


def usage_stream(stream: DataFrame, window_ms: int, idle: str = "5 minutes", late_ms: int = 0) -> DataFrame:
    """A stream of finished records (ip, start_ms, end_ms) with what their ip used in the window before.

    State is the ip's records of the last window and late_ms: a record that starts at most late_ms before the newest one
    of its ip, in whatever batch it comes, still counts all that began before it (answers given already aren't taken
    back). A key without news for so long is dropped by timeout.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    span = pd.Timedelta(idle) // pd.Timedelta("1ms")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(zip(*state.get)) if state.exists else []
        rows = []
        for r in pd.concat(list(batches)).sort_values("start_ms", kind="stable").itertuples(index=False):
            low = r.start_ms - window_ms
            rows.append((key[0], r.start_ms, sum(max(0, min(e, r.start_ms) - max(s, low)) for s, e in kept if s <= r.start_ms)))
            kept.append((r.start_ms, r.end_ms))
        newest = max(s for s, _ in kept)
        kept = [(s, e) for s, e in kept if e > newest - window_ms - late_ms]
        state.update(([s for s, _ in kept], [e for _, e in kept]))
        state.setTimeoutDuration(int(span))
        yield pd.DataFrame(rows, columns=["ip", "start_ms", "used_ms"])

    return stream.groupBy("ip").applyInPandasWithState(run, USAGE, "starts array<long>, ends array<long>", "append", GroupStateTimeout.ProcessingTimeTimeout)
