"""What the operators share: texts, frequent rows, connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import BROADCAST_ROWS, bounded, fits, met, shared_dir, split, written

__all__ = ["SPACE", "bounded", "components", "fits", "frequent", "met", "shared_dir", "split", "text_of", "written"]

#: ASCII white space, as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def frequent(df: DataFrame, limit: int, count: str = "n") -> DataFrame:
    """The rows of df with the largest counts: all from the smallest count on (above 1024 in steps of 1/32 octave) that leaves limit rows at most.

    Needs no sort and no task that sees all rows: the driver gets a histogram of counts in a bounded number of steps.
    """
    step = F.when(F.col(count) < 1024, F.col(count)).otherwise((F.log2(count) * 32).cast("long") + 704)
    left = limit
    least = 0
    for row in df.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).orderBy(F.desc("step")).collect():
        left -= row["rows"]
        if left < 0:
            least = row["step"] + 1
            break
    return df.where(step >= least)


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges u, v and the smallest node that each reaches: roots hook onto smaller roots, then every node points to its root."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((above := root[root]) != root).any():
            root = above
    return nodes, nodes[root]


def components(edges: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """(node, component) of every node in edges (a, b: long); component is the smallest node reachable.

    Up to limit different edges, as counted, meet on the driver, and the result is broadcast: rounds of
    shuffles would take longer than the work. More alternate large-star and small-star steps. Each takes
    minima by a map-side combined aggregation and a join on the node, whose hot partitions AQE splits,
    so no neighbourhood is gathered in a task. Rounds are written tables.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now = written(now)
    if now.count() <= limit:
        found = now.toArrow()
        node, low = joined(*(found[c].to_numpy() for c in ("u", "v")))
        return F.broadcast(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(low, pa.int64())})))
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct())
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)).first()
        if mark == seen:
            break
        seen = mark
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
