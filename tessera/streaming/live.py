"""Live variants of the policies: the same results as their batch twins, row by row as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def token_bucket(requests: DataFrame, key: str, ts: str, rate: float, burst: float, cost: float) -> DataFrame:
    """A stream of requests (key, ts in seconds) with accepted. State per key: tokens and the last time."""
    kind = dict(requests.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, -1.0)
        for batch in batches:
            out = []
            for t in sorted(batch[ts]):
                if last >= 0:
                    tokens = min(burst, tokens + rate * max(0.0, t - last))
                ok = tokens >= cost
                tokens, last = tokens - (cost if ok else 0.0), t
                out.append((k[0], t, ok))
            yield pd.DataFrame(out, columns=[key, ts, "accepted"])
        state.update((tokens, last))

    return requests.select(key, ts).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} double, accepted boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, by: list[str], ts: str, wait: str, late: str) -> DataFrame:
    """One firing for each burst, once the watermark has passed it."""
    s = F.session_window(F.col(ts), wait)
    return events.withWatermark(ts, late).groupBy(*by, s.alias("burst")).agg(F.count("*").alias("calls")).select(*by, F.col("burst.end").alias("fired"), "calls")


def pushed_metrics(events: DataFrame, ts: str, kind: str, value: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by kind and window, as they are pushed."""
    w = F.window(F.col(ts), every)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def expiring(entries: DataFrame, key: str, ts: str, ttl: str, late: str) -> DataFrame:
    """(key, expires): an entry that wasn't refreshed for as long as ttl, given out when the watermark has passed its end."""
    s = F.session_window(F.col(ts), ttl)
    return entries.withWatermark(ts, late).groupBy(key, s.alias("life")).agg(F.count("*").alias("refreshes")).select(key, F.col("life.end").alias("expires"), "refreshes")


def post_reports(stream: DataFrame, send, checkpoint: str):
    """Sends each micro-batch's rows, as JSON texts, through send (a function of an iterator of texts that runs on the executors)."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: df.toJSON().foreachPartition(send)).start()
