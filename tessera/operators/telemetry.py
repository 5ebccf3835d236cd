"""Telemetry: counters, gauges, histograms, peer rollups, the health document, the event log's tail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Event log entries that are kept.
TAIL = 256


def bucket(value: Column, bounds: list[float]) -> Column:
    """The index of the first bound that value doesn't exceed; len(bounds) beyond the last."""
    out = F.lit(len(bounds))
    for i in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[i], i).otherwise(out)
    return out


def histogram(rows: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by, bucket, n, sum): buckets aren't cumulative; sums are kept in whole thousandths."""
    return rows.groupBy(*by, bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"), (F.sum(F.floor(F.col(value) * 1000)) / 1000).alias("sum"))


def counters(rows: DataFrame, by: list[str], amount: Column | None = None) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(amount if amount is not None else F.lit(1)).alias("value"))


def gauges(rows: DataFrame, by: list[str], value: str, ts: list[str]) -> DataFrame:
    """The last value of each gauge."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*ts)).alias("value"))


def registry_json(metrics: DataFrame) -> DataFrame:
    """One JSON document per metric (name, type, help, value)."""
    return metrics.select("name", F.to_json(F.struct("type", "help", "value")).alias("json"))


def histogram_json(buckets: DataFrame, by: list[str], bounds: list[float]) -> DataFrame:
    """One JSON document per histogram out of histogram()'s rows: its bounds, the counts of all buckets, those with none included, count and sum."""
    held = F.map_from_entries(F.collect_list(F.struct("bucket", "n")))
    rows = buckets.groupBy(*by).agg(held.alias("held"), F.sum("n").alias("count"), F.sum("sum").alias("sum"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0)))
    return rows.select(*by, F.to_json(F.struct(F.array(*(F.lit(float(b)) for b in bounds)).alias("bounds"), counts.alias("buckets"), "count", "sum")).alias("json"))


def peer_rollup(snapshots: DataFrame) -> DataFrame:
    """Over peers: how many are connected, their mean weight, requests summed by kind."""
    weight = F.avg("weight").alias("mean_weight")
    n = snapshots.agg(F.count_if("connected").alias("connected"), F.count("*").alias("peers"), weight)
    kinds = snapshots.select(F.posexplode("requests").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("n"))
    return kinds.join(F.broadcast(n))


def health_json(state: Column, peers: Column, requests: Column) -> Column:
    """The health document; kinds without requests (requests: map) are left out."""
    return F.to_json(F.struct(state.alias("state"), peers.alias("peers"), F.map_filter(requests, lambda _, n: n > 0).alias("requests")))


def tail(log: DataFrame, by: list[str], order: list[str], after: Column | None = None, keep: int = TAIL) -> DataFrame:
    """The last keep events of each log, of these the ones after a cursor."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    kept = log.withColumn("age", F.row_number().over(w)).where(F.col("age") <= keep)
    return kept.where(after) if after is not None else kept
