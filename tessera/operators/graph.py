"""The peer graph: latency rings, moving averages, learned edge weights, routing, closest nodes, gossip, path resolution."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import bounded, fits, written

#: Rings, members kept in each, the first ring's width in ms; learning rate, symmetry and feedback factors, weight floor, decay; hops.
RINGS, PRIMARY, SECONDARY, FIRST_MS = 10, 8, 4, 5.0
RATE, FEEDBACK, SYMMETRY, FLOOR, DECAY, SLOWEST_MS = 0.1, 0.25, 0.05, 0.01, 0.999, 60_000.0
ALPHA, HOPS, FANOUT = 0.1, 6, 3


def ring(latency_ms: Column) -> Column:
    """0 below the first width, then one ring for each doubling, RINGS - 1 at most."""
    up = F.floor(F.log2(latency_ms / F.lit(FIRST_MS))) + 1
    return F.when(latency_ms < FIRST_MS, 0).otherwise(F.least(up, F.lit(RINGS - 1))).cast("int")


def membership(nodes: DataFrame, by: list[str], arrival: list[str]) -> DataFrame:
    """nodes with their place in their ring by arrival: primary, secondary, or gone. by: columns that tell ring sets apart, and the ring."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*arrival))
    return nodes.withColumn("place", place).where(F.col("place") <= PRIMARY + SECONDARY).withColumn("member", F.when(F.col("place") <= PRIMARY, "primary").otherwise("secondary"))


def promoted(members: DataFrame, gone: DataFrame, by: list[str], arrival: list[str], key: str) -> DataFrame:
    """Membership after some members went: the oldest secondaries move up."""
    return membership(members.join(gone, key, "left_anti"), by, arrival)


def moving_average(values: Column, alpha: float = ALPHA) -> Column:
    """An exponential moving average over an ordered array; the first value starts it."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    return F.when(F.size(values) > 0, F.aggregate(rest, F.get(values, F.lit(0)).cast("double"), lambda a, x: a * (1 - alpha) + x * alpha))


def delta(latency_ms: Column, factor: float = 1.0) -> Column:
    """What a round trip adds to an edge's weight."""
    return F.greatest(F.lit(0.0), 1 - latency_ms / SLOWEST_MS) * RATE * factor


def learned(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (src, dst, weight) after successes (src, seq, path array, step), in the order of seq: src learns about the peers of each path.

    The holder, last of the path, gains step; then the peers from the third on gain FEEDBACK of it each (the holder too); then all
    but the last gain SYMMETRY of it. A new edge begins at its first gain, or at RATE if that is more; later gains add up.
    """
    gain = lambda i, k, f: F.struct(F.get("path", i).alias("dst"), F.lit(k).alias("rule"), i.alias("at"), (F.col("step") * f).alias("gain"))
    n = F.size("path")
    spans = lambda first, last: F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))
    holder = F.transform(F.array(n - 1), lambda i: gain(i, 0, 1.0))
    feedback = F.transform(spans(2, n - 1), lambda i: gain(i, 1, FEEDBACK))
    back = F.transform(spans(0, n - 2), lambda i: gain(i, 2, SYMMETRY))
    each = paths.where(n > 0).select("src", "seq", F.explode(F.concat(holder, feedback, back)).alias("e")).select("src", "seq", "e.*")
    gains = each.groupBy("src", "dst").agg(F.sum("gain").alias("gain"), F.min_by("gain", F.struct("seq", "rule", "at")).alias("begin"))
    both = edges.join(gains, ["src", "dst"], "full_outer")
    fresh = F.greatest("begin", F.lit(RATE)) + F.col("gain") - F.col("begin")
    known = F.col("weight") + F.coalesce("gain", F.lit(0.0))
    return both.select("src", "dst", F.greatest(F.when(F.col("weight").isNull(), fresh).otherwise(known), F.lit(FLOOR)).alias("weight"))


def decayed(weight: Column, ticks: Column) -> Column:
    return F.greatest(weight * F.pow(F.lit(DECAY), ticks), F.lit(FLOOR))


def dropped_peers(peers: DataFrame, rate: float, least: float) -> DataFrame:
    """Peers after a linear decay: those below least go, friends stay."""
    return peers.withColumn("weight", F.greatest(F.col("weight") - rate, F.lit(0.0))).where(F.col("friend") | (F.col("weight") >= least))


def heaviest(edges: DataFrame, room: int) -> DataFrame:
    """The room heaviest edges of each node."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return edges.withColumn("place", F.row_number().over(w)).where(F.col("place") <= room).drop("place")


def storage_score(weight: Column, capacity: Column, latency_us: Column, availability: Column, beta_us: float = 5000.0) -> Column:
    return F.greatest(weight, F.lit(FLOOR)) * F.greatest(1 - capacity, F.lit(0.0)) / (1 + latency_us / beta_us) * availability


def accept_probability(capacity: Column, size: Column, fib: Column) -> Column:
    """The probability that a node takes a block: 0 from 0.8 of its capacity on, less for large blocks, more for popular ones."""
    p = (1 - capacity / 0.8) / (1 + size / 1048576.0) * (1 + 0.05 * F.least(fib, F.lit(10)))
    return F.when(capacity >= 0.8, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def unit(key: Column, seed: str) -> Column:
    """A number in (0, 1] that depends on key and seed alone."""
    return (F.conv(F.substr(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), F.lit(1), F.lit(12)), 16, 10).cast("double") + 1) / float(1 << 48)


def accepts(key: Column, phase: Column, capacity: Column, size: Column, fib: Column, seed: str = "accept") -> Column:
    """Whether a node takes a block: never while it exhales, else with accept_probability, by a draw that depends on key and seed alone."""
    return (phase != "exhale") & (unit(key, seed) <= accept_probability(capacity, size, fib))


def roulette(candidates: DataFrame, by: list[str], key: str, weight: str, n: int, seed: str) -> DataFrame:
    """n candidates of each group, drawn without replacement in proportion to their weights."""
    order = -F.log(unit(F.col(key), seed)) / F.col(weight)
    w = Window.partitionBy(*by).orderBy(order, key)
    return candidates.where(F.col(weight) >= FLOOR).withColumn("draw", F.row_number().over(w)).where(F.col("draw") <= n)


def best_well(wells: DataFrame, by: list[str]) -> DataFrame:
    """Of the peers whose filters know a hash the one with the fewest hops, then the heaviest. wells: peer, hops, weight."""
    w = Window.partitionBy(*by).orderBy("hops", F.desc("weight"), "peer")
    return wells.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def converged(current: Column, best: Column, num: int, den: int) -> Column:
    """Whether current / best is at most num / den; true without a best one."""
    return F.when(best == 0, F.lit(True)).when(F.lit(den) == 0, F.lit(False)).otherwise(current * den <= best * num)


def reach(start: DataFrame, edges: DataFrame, holders: DataFrame, hops: int = HOPS) -> DataFrame:
    """(query, holder, hops): for each query (query, node, hash) the holders of its hash by the fewest hops, over at most hops of them.

    Queries are numbered, and 64 of them go together as the bits of a mask: a row says which of them are at a node. Each round joins the frontier,
    a written table, with the edges, takes the masks that meet at a node together, and keeps the bits that weren't there before: a node's first visits.
    """
    links = written(edges.select(F.col("src").alias("node"), "dst").distinct())
    begin = start.where(F.col("hash").isNotNull()).select("query", "node", "hash").distinct()
    numbered = written(begin.select("query", "hash").distinct().sort("hash", "query").withColumn("no", F.monotonically_increasing_id()))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    first = begin.alias("s").join(numbered.alias("m"), F.col("s.query").eqNullSafe(F.col("m.query")) & (F.col("s.hash") == F.col("m.hash"))).select("node", "no")
    frontier = written(first.groupBy(F.shiftright("no", 6).alias("block"), "node").agg(F.bit_or(bit(F.col("no").bitwiseAND(F.lit(63)))).alias("mask")))
    visited = frontier.withColumn("hops", F.lit(0))
    for k in range(1, hops + 1):
        step = frontier.join(links, "node").groupBy("block", F.col("dst").alias("node")).agg(F.bit_or("mask").alias("mask"))
        known = visited.groupBy("block", "node").agg(F.bit_or("mask").alias("known"))
        fresh = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        frontier = written(step.join(known, ["block", "node"], "left").select("block", "node", fresh.alias("mask")).where("mask <> 0"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("hops", F.lit(k)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(bit(i)) != 0)
    held = visited.join(holders.select("node").distinct(), "node", "left_semi").select("node", "hops", "block", F.explode(bits).alias("at"))
    found = held.select("node", "hops", (F.col("block") * 64 + F.col("at")).alias("no")).join(bounded(numbered), "no")
    return found.join(holders, ["node", "hash"]).select("query", F.col("node").alias("holder"), "hops")


def next_hop(requests: DataFrame, peers: DataFrame, knows: DataFrame) -> DataFrame:
    """One routing step for each request (request, hash, ttl, path, and visited peers if there is such a column): (request, outcome, peer). A peer that knows the hash comes first, else up to FANOUT by roulette among peers not in the path."""
    open_ = requests.where("ttl > 0")
    free = open_.join(peers.where(~F.col("rendezvous") & (F.col("weight") >= FLOOR)), "node")
    free = free.where(~F.array_contains("path", F.col("peer")))
    if "visited" in requests.columns:
        free = free.where(~F.array_contains("visited", F.col("peer")))
    wells = best_well(free.join(knows, ["peer", "hash"]).select("request", "peer", "hops", "weight"), ["request"]).select("request", "peer", F.lit("well").alias("outcome"))
    drawn = roulette(free.join(wells.select("request"), "request", "left_anti"), ["request"], "peer", "weight", FANOUT, "route").select("request", "peer", F.lit("walk").alias("outcome"))
    known = wells.unionByName(drawn)
    lost = requests.join(known.select("request").distinct(), "request", "left_anti").select("request", F.lit(None).cast("string").alias("peer"), F.when(F.col("ttl") > 0, "not found").otherwise("expired").alias("outcome"))
    return known.select("request", F.col("peer").cast("string").alias("peer"), "outcome").unionByName(lost)


def _nearest(ids: np.ndarray, q: np.ndarray, node: np.ndarray, x: np.ndarray, n: int, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best (rows: query's index, node, distance; at most n a query, by distance and node) after a look at nodes x."""
    size = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :]
    near = size - 2 * q @ x.T  # rounded otherwise than the distances that decide
    slack = 1e-9 * size
    near[ids[:, None] == node[None, :]] = np.inf
    reach = np.full(len(ids), np.inf)
    if near.shape[1] > n:
        reach = np.partition(near, n - 1, axis=1)[:, n - 1]
    row, col = np.nonzero((near <= reach[:, None] + 2 * slack) & np.isfinite(near))  # all that tie with the n-th
    rows = np.r_[best[0], row], np.r_[best[1], node[col]], np.r_[best[2], ((q[row] - x[col]) ** 2).sum(1)]
    order = np.lexsort((rows[1], rows[2], rows[0]))
    at = rows[0][order]
    place = np.arange(len(at)) - np.searchsorted(at, at, "left")
    kept = order[place < n]
    return rows[0][kept], rows[1][kept], rows[2][kept]


def closest(queries: DataFrame, nodes: DataFrame, n: int, block: int = 20_000) -> DataFrame:
    """The n nodes (node, vector) nearest to each query (query, vector) by squared distance, then by node, itself left out. About block queries at a time go to the nodes, so what tasks hold is bounded; each task keeps a running best n of a query."""
    total = queries.count()
    parts = max(1, -(-total // block))
    kept = None
    for k in range(parts):
        table = queries.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == k).select("query", F.col("vector").cast("array<double>").alias("vector")).toArrow()
        if not table.num_rows:
            continue
        sent = queries.sparkSession.sparkContext.broadcast((table["query"].to_numpy(), np.array(table["vector"].to_pylist())))

        def run(batches, sent=sent):
            ids, q = sent.value
            best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    best = _nearest(ids, q, part.column(0).to_numpy(), np.array(part.column(1).to_pylist()), n, best)
            if len(best[0]):
                yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["query", "node", "distance"])

        found = nodes.select("node", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "query long, node long, distance double")
        kept = found if kept is None else kept.unionByName(found)
    if kept is None:
        kept = queries.sparkSession.createDataFrame([], "query long, node long, distance double")
    w = Window.partitionBy("query").orderBy("distance", "node")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def gossip_round(members: DataFrame, seed: str) -> DataFrame:
    """One member of every ring of every node, drawn by a hash: the exchange partners of a round. members: node, ring, peer."""
    w = Window.partitionBy("node", "ring").orderBy(unit(F.concat_ws("/", F.col("node").cast("string"), F.col("peer").cast("string")), seed))
    return members.withColumn("draw", F.row_number().over(w)).where("draw = 1").drop("draw")


def resolve(paths: DataFrame, entries: DataFrame, deepest: int) -> DataFrame:
    """(path_id, entry): directory entries (dir, name, child, is_dir, ordinal) followed along paths (path_id, root, segments). The first entry of a name wins. Each round is a written table."""
    entry = F.struct("child", "is_dir")
    first = written(entries.groupBy("dir", "name").agg(F.min_by(entry, "ordinal").alias("e")).select("dir", "name", "e.*"))
    now = paths.select("path_id", F.col("root").alias("dir"), "segments", F.lit(0).alias("at"), F.lit(True).alias("is_dir"))
    done = None
    for _ in range(deepest + 1):
        now = written(now)
        ended = now.where(F.col("at") >= F.size("segments")).select("path_id", F.col("dir").alias("entry"))
        done = ended if done is None else done.unionByName(ended)
        step = now.where((F.col("at") < F.size("segments")) & F.col("is_dir")).withColumn("name", F.get("segments", F.col("at"))).drop("is_dir")
        now = step.join(first, ["dir", "name"]).select("path_id", F.col("child").alias("dir"), "segments", (F.col("at") + 1).alias("at"), "is_dir")
    return done


def wanted_offers(blocks: DataFrame, wants: DataFrame) -> DataFrame:
    """(peer, hash) of new blocks that peers asked for in vain before."""
    return wants.join(blocks.select("hash").distinct(), "hash", "left_semi").select("peer", "hash").distinct()


def measured(targets: DataFrame, latencies: DataFrame) -> DataFrame:
    """targets with their last measured latency, 0 where there is none. latencies: target, latency_ms, ts."""
    last = latencies.groupBy("target").agg(F.max_by("latency_ms", "ts").alias("latency_ms"))
    return targets.join(last, "target", "left").withColumn("latency_ms", F.coalesce("latency_ms", F.lit(0.0)))


# rings: members are ordered by (ring, place); place is the order of arrival in a ring, primaries before secondaries


def closest_in_lowest_ring(members: DataFrame, by: list[str]) -> DataFrame:
    """The first primary of the lowest ring that has one. members: by, ring, place, member, peer."""
    return members.where("member = 'primary'").groupBy(*by).agg(F.min_by("peer", F.struct("ring", "place")).alias("peer"))


def best_of_rings(members: DataFrame, by: list[str], n: int, exclude: str | None = None) -> DataFrame:
    """(by, ring, peer, latency_ms): of each ring's primaries but exclude (a column) the one with the lowest latency, first come first, of the first n rings that have one."""
    open_ = members.where("member = 'primary'")
    if exclude:
        open_ = open_.where(~F.col("peer").eqNullSafe(F.col(exclude)))
    best = open_.groupBy(*by, "ring").agg(F.min_by(F.struct("peer", "latency_ms"), F.struct("latency_ms", "place")).alias("b"))
    order = Window.partitionBy(*by).orderBy("ring")
    return best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).select(*by, "ring", "b.*")


def find_node(members: DataFrame, by: list[str], n: int = 8) -> DataFrame:
    """The first n primaries by ring and place: what a node answers to a search for nodes, whatever the target."""
    order = Window.partitionBy(*by).orderBy("ring", "place")
    return members.where("member = 'primary'").withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n")


def inserted(members: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """members after an answer (found: by, peer, latency_ms) was put into the rings: peers that are there stay where they are, new ones come after all others."""
    base = members.groupBy(*by, "ring").agg(F.max("place").alias("last"))
    fresh = found.withColumn("ring", ring(F.col("latency_ms"))).join(members.select(*by, "peer"), [*by, "peer"], "left_anti").dropDuplicates([*by, "peer"])
    fresh = fresh.join(base, [*by, "ring"], "left").withColumn("place", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy(*by, "ring").orderBy("peer")))
    names = [*by, "ring", "peer", "latency_ms"]
    return membership(members.select(*names, "place").unionByName(fresh.select(*names, "place")), [*by, "ring"], ["place"])


def ring_topology(members: DataFrame, by: list[str]) -> DataFrame:
    """Primaries with their ring level and round trip."""
    return members.where("member = 'primary'").select(*by, "peer", F.col("ring").alias("ring_level"), F.col("latency_ms").alias("rtt_ms"))


def totals(members: DataFrame, connections: DataFrame, by: list[str]) -> DataFrame:
    """(by, nodes, connections, friends): ring members, and connections (by, peer, friend), of which friends."""
    n = members.groupBy(*by).agg(F.count("*").alias("nodes"))
    c = connections.groupBy(*by).agg(F.count("*").alias("connections"), F.count_if("friend").alias("friends"))
    return n.join(c, by, "full_outer").fillna(0, ["nodes", "connections", "friends"])


def nearest_probe(probes: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, target): the target with the lowest latency, of equal ones the first probed."""
    return probes.groupBy(*by).agg(F.min_by("target", F.struct("latency_ms", order)).alias("target"))


def by_level(peers: DataFrame, by: list[str]) -> DataFrame:
    """peers with rank: by the hop level of their filters, then by peer."""
    return peers.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("level", "peer")))


def by_latency(nodes: DataFrame, by: list[str], order: str) -> DataFrame:
    """nodes with rank: by latency, equal ones as they came."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("latency_ms", order)))


#: Fixed value: failures in a row from which a peer gets no block.
MOST_FAILS = 3


def storage_candidates(requests: DataFrame, peers: DataFrame) -> DataFrame:
    """(request, peer, score): the peers that a block may be sent on to. requests: request, node, path, visited (arrays of peers); peers: node, peer, weight, capacity, latency_ms, availability, rendezvous, phase, fails."""
    score = storage_score(F.col("weight"), F.col("capacity"), F.col("latency_ms") * 1000, F.col("availability"))
    open_ = peers.where(~F.col("rendezvous") & (F.col("phase") != "exhale") & (F.col("fails") < MOST_FAILS)).withColumn("score", score).where(F.col("score") >= FLOOR)
    both = requests.join(open_, "node")
    return both.where(~F.array_contains("path", F.col("peer")) & ~F.array_contains("visited", F.col("peer"))).select("request", "peer", "score")


def store_step(requests: DataFrame, peers: DataFrame, connected: DataFrame, knows: DataFrame, seed: str = "store") -> DataFrame:
    """(request, outcome, peer): one step of placing a block. requests: request, node, hash, ttl, path, visited, accept (whether the node takes it).

    The node keeps it; else, with hops left, it goes to the first connected peer that follows the hash (connected: node, peer, hash, ordinal), else to the peer
    whose filter knows the hash at the fewest hops (knows: peer, hash, hops), else to FANOUT candidates by roulette over their scores; else it's declined.
    """
    taken = requests.where("accept").select("request", F.lit(None).cast("string").alias("peer"), F.lit("accepted").alias("outcome"))
    over = requests.where("not accept and ttl <= 0").select("request", F.lit(None).cast("string").alias("peer"), F.lit("max hops").alias("outcome"))
    open_ = requests.where("not accept and ttl > 0")
    free = ~F.array_contains("path", F.col("peer")) & ~F.array_contains("visited", F.col("peer"))
    plain = peers.where(~F.col("rendezvous"))
    topic = open_.join(connected, ["node", "hash"]).join(plain.select("node", "peer"), ["node", "peer"]).where(free).groupBy("request").agg(F.min_by("peer", "ordinal").alias("peer"))
    rest = open_.join(topic, "request", "left_anti")
    fit = plain.where((F.col("phase") != "exhale") & (F.col("fails") < MOST_FAILS))
    wells = rest.join(fit, "node").join(knows, ["peer", "hash"]).where(free).withColumn("weight", F.greatest("weight", F.lit(FLOOR)))
    wells = best_well(wells.select("request", "peer", "hops", "weight"), ["request"]).select("request", "peer")
    rest = rest.join(wells, "request", "left_anti")
    drawn = roulette(storage_candidates(rest, peers), ["request"], "peer", "score", FANOUT, seed).select("request", "peer")
    sent = topic.unionByName(wells).unionByName(drawn).select("request", F.col("peer").cast("string").alias("peer"), F.lit("forwarded").alias("outcome"))
    declined = rest.join(drawn.select("request").distinct(), "request", "left_anti").select("request", F.lit(None).cast("string").alias("peer"), F.lit("declined").alias("outcome"))
    return taken.unionByName(over).unionByName(sent).unionByName(declined)


def closest_step(requests: DataFrame, peers: DataFrame, latencies: DataFrame, knows: DataFrame, num: int = 1, den: int = 2) -> DataFrame:
    """(request, outcome, peer): one step of a search for a node (request, node, target, best_ms, ttl, path). Found where the node is the target, or where its measured latency to it
    (latencies: node, target, latency_ms) is converged against the best so far; expired without hops; else on to the peer whose filter knows the target at the fewest hops, else to the FANOUT with the lowest latency."""
    near = requests.join(latencies, ["node", "target"], "left")
    found = (F.col("node") == F.col("target")) | ((F.col("latency_ms") > 0) & converged(F.col("latency_ms"), F.col("best_ms"), num, den))
    judged = near.withColumn("outcome", F.when(F.coalesce(found, F.lit(False)), "found").when(F.col("ttl") <= 0, "expired").otherwise("open"))
    ended = judged.where("outcome <> 'open'").select("request", F.lit(None).cast("string").alias("peer"), "outcome")
    open_ = judged.where("outcome = 'open'").select("request", "node", "target", "path")
    free = open_.join(peers.where(~F.col("rendezvous") & (F.col("weight") >= FLOOR)), "node").where(~F.array_contains("path", F.col("peer")))
    wells = best_well(free.join(knows.withColumnRenamed("hash", "target"), ["peer", "target"]).select("request", "peer", "hops", "weight"), ["request"]).select("request", "peer")
    w = Window.partitionBy("request").orderBy("latency_ms", "peer")
    walk = free.join(wells, "request", "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= FANOUT).select("request", "peer")
    sent = wells.unionByName(walk).select("request", F.col("peer").cast("string").alias("peer"), F.lit("forwarded").alias("outcome"))
    lost = open_.join(sent, "request", "left_anti").select("request", F.lit(None).cast("string").alias("peer"), F.lit("not found").alias("outcome"))
    return ended.unionByName(sent).unionByName(lost)


def answers_merged(latencies: DataFrame, answers: DataFrame) -> DataFrame:
    """latencies (target, latency_ms, ts) with the samples of answers (target, latency_ms, ts): the last one counts, a latency of 0 says nothing."""
    last = latencies.unionByName(answers.where("latency_ms > 0")).groupBy("target").agg(F.max_by(F.struct("latency_ms", "ts"), "ts").alias("x"))
    return last.select("target", "x.*")


def pending_kept(pending: DataFrame, by: list[str], room: int = 32) -> DataFrame:
    """pending searches (by, message) with state: the room newest message ids stay open, those below are given up."""
    w = Window.partitionBy(*by).orderBy(F.desc("message"))
    return pending.withColumn("state", F.when(F.row_number().over(w) <= room, "open").otherwise("not found"))


def ranked_forward(requests: DataFrame, peers: DataFrame, hops: int = HOPS) -> DataFrame:
    """(request, peer): a block's rank goes to the first FANOUT peers (by ordinal) that aren't in visited, while its hops are below the limit.

    visited shuts out as many rows of a node as it has ids, times the rows that an id has there. So a request only meets that many of its node's
    peers and FANOUT more, as one list, and not a row for each peer of the node.
    """
    asked = written(requests.where((F.col("hop") < hops) & F.col("visited").isNotNull()).select("request", "node", "visited"))
    most = asked.agg(F.coalesce(F.max(F.size("visited")), F.lit(0))).first()[0]
    known = peers.where(F.col("peer").isNotNull() & F.col("node").isNotNull()).select("node", "peer", "ordinal")
    alike = known.groupBy("node", "peer").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    first = known.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("ordinal", "peer"))).where(F.col("n") <= FANOUT + alike * most)
    lists = first.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "ordinal", "peer"))).alias("peers"))
    near = F.slice("peers", 1, (F.size("visited") * F.lit(alike) + FANOUT).cast("int"))
    free = F.slice(F.filter(near, lambda x: ~F.array_contains("visited", x["peer"])), 1, FANOUT)
    chosen = asked.join(F.broadcast(lists) if fits(first) else lists, "node").select("request", F.explode(free).alias("x")).select("request", "x.ordinal", "x.peer")
    w = Window.partitionBy("request").orderBy("ordinal", "peer")  # a request may be asked at several nodes
    return chosen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= FANOUT).select("request", "peer")


def recalled(followers: DataFrame, declined: DataFrame) -> DataFrame:
    """followers (peer, hash) after a recall: those that declined (peer, hash) don't follow any more."""
    return followers.join(declined, ["peer", "hash"], "left_anti")


def pinged(nodes: DataFrame, answers: DataFrame) -> DataFrame:
    """nodes (peer, latency_ms, capacity, phase, availability, fails) after answers to pings (peer, ts, rtt_ms, capacity, phase, availability; rtt_ms null: none came).

    The round trips move the average in order; the last known capacity, phase and availability hold; fails count those without an answer since the last one.
    """
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "rtt_ms"))), lambda x: x["rtt_ms"])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"new_{c}")
    seen = answers.groupBy("peer").agg(ordered.alias("rtts"), last("capacity"), last("phase"), last("availability"))
    came = F.filter("rtts", lambda x: x.isNotNull())
    since = F.size("rtts") - F.coalesce(F.array_max(F.transform("rtts", lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    both = nodes.join(seen, "peer", "left")
    begin = F.when(F.col("latency_ms") > 0, F.array(F.col("latency_ms").cast("double"))).otherwise(F.array().cast("array<double>"))
    latency = F.coalesce(moving_average(F.concat(begin, came.cast("array<double>"))), F.col("latency_ms"))
    fails = F.when(F.size(came) > 0, since).otherwise(F.col("fails") + F.size("rtts"))
    new = [F.coalesce(f"new_{c}", c).alias(c) for c in ("capacity", "phase", "availability")]
    return both.select("peer", F.when(F.col("rtts").isNull(), F.col("latency_ms")).otherwise(latency).alias("latency_ms"), *new, F.when(F.col("rtts").isNull(), F.col("fails")).otherwise(fails).cast("int").alias("fails"))


def gossip_exchange(members: DataFrame, seed: str, by: str = "node") -> DataFrame:
    """(node, peer, ring): what each node knows after one round of push and pull: its members and those of the partners drawn for it, and of those that drew it. Itself left out."""
    drawn = gossip_round(members, seed).select("node", F.col("peer").alias("partner")).distinct()
    both = drawn.unionByName(drawn.select(F.col("partner").alias("node"), F.col("node").alias("partner"))).distinct()
    learnt = both.join(members.select(F.col("node").alias("partner"), "peer"), "partner").select("node", "peer")
    known = members.select("node", "peer").unionByName(learnt).unionByName(both.select("node", F.col("partner").alias("peer")))
    return known.where("node <> peer").distinct()


def found_locally(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(hash, requesters, outcome): requests (hash, requester) gathered by hash; "local" where the index has it, else "route", once for all that wait."""
    asked = requests.groupBy("hash").agg(F.sort_array(F.collect_set("requester")).alias("requesters"))
    here = index.select("hash").distinct().withColumn("here", F.lit(True))
    return asked.join(here, "hash", "left").select("hash", "requesters", F.when(F.col("here"), "local").otherwise("route").alias("outcome"))
