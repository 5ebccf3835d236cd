"""Policies over time: token buckets, time to live, respiration by capacity, deadlines, bursts, quorums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.folds import folded

#: Fixed values, by kind of request: base rate, greatest rate, burst, cost.
BUCKETS = {"find": (5.0, 50.0, 20.0, 1.0), "store": (0.5, 5.0, 3.0, 1.0), "seek": (1.0, 10.0, 5.0, 1.0), "ping_capacity": (10.0, 10.0, 10.0, 0.1), "ping": (10.0, 10.0, 10.0, 0.1)}
#: Capacity from which a node gives blocks away, and below which it takes them; peers below which rates rise, and by how much.
EXHALE, INHALE, FEW_PEERS, BOOST = 0.8, 0.5, 32, 3.0
#: Wire type to kind of request, for back-off signals.
WIRE = {1: "ping", 3: "ping_capacity", 7: "find", 11: "store", 13: "seek"}


def token_bucket(requests: DataFrame, by: list[str], ts: str, order: list[str], rate: float, burst: float, cost: float) -> DataFrame:
    """requests (ts in seconds as a double) with accepted and tokens. The bucket starts full; the first request only notes the time; later ones fill it by the time that passed."""
    kinds = dict(requests.dtypes)
    names = [*by, ts, *(o for o in order if o != ts and o not in by)]

    def start(_):
        return burst, None

    def step(state, row):
        tokens, last = state
        if last is not None:
            tokens = min(burst, tokens + rate * max(0.0, row[ts] - last))
        ok = tokens >= cost
        tokens -= cost if ok else 0.0
        return (tokens, row[ts]), (*(row[n] for n in names), ok, tokens)

    return folded(requests.select(*names), by, order, start, step, ", ".join(f"{n} {kinds[n]}" for n in names) + ", accepted boolean, tokens double")


def few_peers(peers: Column) -> Column:
    """What the greatest rate and the burst are multiplied with: a node with few peers may ask each of them more often."""
    return F.when((peers > 0) & (peers < FEW_PEERS), F.lit(float(FEW_PEERS)) / peers * BOOST).otherwise(1.0)


def effective_rate(rate: Column, peers: Column) -> Column:
    return rate * few_peers(peers)


def effective_burst(burst: Column, peers: Column) -> Column:
    return burst * few_peers(peers)


def retry_after_ms(tokens: Column, cost: Column, rate: Column) -> Column:
    return F.when(tokens >= cost, F.lit(0.0)).otherwise((cost - tokens) / rate * 1000)


def kind_of_wire(wire: Column) -> Column:
    """The kind of request that a back-off signal's wire type means; null if none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for p in WIRE.items() for x in p)), wire)


def phase(capacity: Column) -> Column:
    return F.when(capacity >= EXHALE, "exhale").when(capacity < INHALE, "inhale").otherwise("neutral")


def seek_interval_ms(capacity: Column, least: float = 5000.0, most: float = 300_000.0) -> Column:
    """How long to wait before seeking blocks; null (never) from half of the capacity on."""
    return F.when(capacity < INHALE, least + (most - least) * F.pow(capacity / INHALE, F.lit(2.0)))


def store_taper(capacity: Column) -> Column:
    """1 up to half of the capacity, down to 0.05 at 0.8 of it."""
    return F.when(capacity <= INHALE, 1.0).when(capacity >= EXHALE, 0.05).otherwise(1.0 - (capacity - INHALE) / (EXHALE - INHALE) * 0.95)


def blocks_to_free(capacity: Column, blocks: Column) -> Column:
    return F.when(capacity >= EXHALE, blocks - F.floor(blocks * INHALE)).otherwise(0).cast("long")


def breath(index: DataFrame, elsewhere: DataFrame, n: int) -> DataFrame:
    """The n blocks to give up, longest ejected first: "delete" where another node holds them, else "push"."""
    oldest = index.where(F.col("ejected").isNotNull()).orderBy("ejected", "hash").limit(n)
    held = elsewhere.select("hash").distinct().withColumn("held", F.lit(True))
    return oldest.join(held, "hash", "left").withColumn("action", F.when(F.col("held"), "delete").otherwise("push")).drop("held")


def ttl_ms(base_ms: Column, level: Column) -> Column:
    """Farther levels live shorter."""
    return base_ms / (1 + 0.5 * level)


def alive(entries: DataFrame, by: list[str], ts: str, ttl: Column, now: Column) -> DataFrame:
    """The last refresh of each entry, if it hasn't run out at now."""
    last = entries.groupBy(*by).agg(F.max(ts).alias(ts))
    return last.where(F.col(ts) + ttl > now)


def swept(waiting: DataFrame, now: Column) -> DataFrame:
    """waiting with expired: whether there is a deadline (0: none) and it has come."""
    return waiting.withColumn("expired", (F.col("deadline_ms") != 0) & (F.col("deadline_ms") <= now))


def expired_queries(queries: DataFrame, now: Column) -> DataFrame:
    """queries whose time is over: strictly later than start_ms + timeout_ms."""
    return queries.where(now > F.col("start_ms") + F.col("timeout_ms"))


def fifo_kept(inserts: DataFrame, by: list[str], key: str, order: str, room: int) -> DataFrame:
    """The entries of a table of room places after inserts, each key with its last row; the first inserted goes first, and an update doesn't move a key back.

    A key that was evicted and comes again begins anew: whether it was is known from the number of new keys between, so
    stays are found from one insertion to the next, in a fold of a bounded table.
    """
    from collections import OrderedDict

    kinds = dict(inserts.dtypes)
    rest = [c for c in inserts.columns if c not in (*by, key, order)]
    names = [*by, key, order, *rest]

    def step(table, row):
        gone = None
        if row[key] not in table and len(table) >= room:
            gone = table.popitem(last=False)[0]
        table.setdefault(row[key], None)
        return table, (*(row[n] for n in names), gone)

    said = folded(inserts.select(*names), by, [order, key], lambda _: OrderedDict(), step, ", ".join(f"{n} {kinds[n]}" for n in names) + f", gone {kinds[key]}")
    last = said.groupBy(*by, key).agg(F.max_by(F.struct(order, *rest), order).alias("last"))
    out = said.where("gone is not null").groupBy(*by, F.col("gone").alias(key)).agg(F.max(order).alias("went"))
    both = last.join(out, [*by, key], "left")
    return both.where(F.col("went").isNull() | (F.col(f"last.{order}") > F.col("went"))).select(*by, key, "last.*")


def refill_evictions(buckets: DataFrame, by: list[str], room: int) -> DataFrame:
    """Of each table the room buckets refilled last (refill_ms; of equal ones those that came later, by ordinal): the others make room."""
    w = Window.partitionBy(*by).orderBy(F.desc("refill_ms"), F.desc("ordinal"))
    return buckets.withColumn("place", F.row_number().over(w)).where(F.col("place") <= room).drop("place")


def backed_off(buckets: DataFrame, signals: DataFrame) -> DataFrame:
    """buckets (peer, kind, tokens) after back-off signals (peer, wire): the kind that a wire type means has no tokens left."""
    hit = signals.select("peer", kind_of_wire(F.col("wire")).alias("kind")).where("kind is not null").distinct().withColumn("hit", F.lit(True))
    return buckets.join(hit, ["peer", "kind"], "left").withColumn("tokens", F.when(F.col("hit"), 0.0).otherwise(F.col("tokens"))).drop("hit")


def resolved_gets(pending: DataFrame, completed: DataFrame) -> DataFrame:
    """(waiter, data): all that wait for a slot (pending: section_id, slot, waiter) get what was read from it."""
    return pending.join(completed, ["section_id", "slot"]).select("waiter", "data")


def answered(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """requests (message, sent_ms) with rtt_ms: their first response (message, got_ms) by message id, null without one."""
    first = responses.groupBy("message").agg(F.min("got_ms").alias("got_ms"))
    return requests.join(first, "message", "left").withColumn("rtt_ms", F.col("got_ms") - F.col("sent_ms")).drop("got_ms")


def ticks(start: Column, end: Column, quick_s: int, quick_count: int, steady_s: int) -> Column:
    """The times of a gossip schedule: quick_count quick intervals, then steady ones, up to end."""
    quick = F.transform(F.sequence(F.lit(1), F.lit(quick_count)), lambda i: start + i * quick_s)
    n = F.greatest(F.floor((end - start - quick_s * quick_count) / steady_s), F.lit(0)).cast("int")
    steady = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: start + quick_s * quick_count + i * steady_s)).otherwise(F.array().cast("array<long>"))
    return F.filter(F.concat(quick.cast("array<long>"), steady.cast("array<long>")), lambda t: t <= end)


def sliding_sessions(log: DataFrame, by: list[str], ts: str, ttl_s: float) -> DataFrame:
    """(by, first, last, reads) of each stay in a cache whose time to live begins anew with each read."""
    w = Window.partitionBy(*by).orderBy(ts)
    gone = F.col(ts).cast("double") - F.lag(F.col(ts).cast("double")).over(w) > ttl_s
    stays = log.withColumn("stay", F.sum(F.when(gone, 1).otherwise(0)).over(w))
    return stays.groupBy(*by, "stay").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("reads"))


def debounced(events: DataFrame, by: list[str], ts: str, wait: str) -> DataFrame:
    """One firing for each burst: (by, fired, calls); it fires when no call came for as long as wait."""
    s = F.session_window(F.col(ts), wait)
    return events.groupBy(*by, s.alias("burst")).agg(F.count("*").alias("calls")).select(*by, F.col("burst.end").alias("fired"), "calls")


def quorum(responses: DataFrame, asked: DataFrame) -> DataFrame:
    """(message, accepted, refused, state): a message is done when a peer found it, failed when as many as were asked haven't, else open."""
    n = responses.groupBy("message").agg(F.sum(F.when(F.col("found"), 1).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("found"), 0).otherwise(1)).alias("refused"))
    both = asked.join(n, "message", "left").fillna(0, ["accepted", "refused"])
    return both.withColumn("state", F.when(F.col("accepted") > 0, "done").when(F.col("refused") >= F.col("asked"), "failed").otherwise("open"))


def coalesced(requests: DataFrame) -> DataFrame:
    """One request per hash, with those who wait for it."""
    return requests.groupBy("hash").agg(F.sort_array(F.collect_set("requester")).alias("waiting"), F.min("deadline_ms").alias("deadline_ms"))


#: Fixed values (field names): configuration rules, column expressions that must hold, with what to say if they don't.
RULES = {
    "index_bucket_size > 0": "index_bucket_size must be positive", "index_wait > 0": "index_wait must be positive", "index_max_wait >= index_wait": "index_max_wait is below index_wait",
    "section_size > 0": "section_size must be positive", "section_cache_count > 0": "section_cache_count must be positive", "section_wait > 0": "section_wait must be positive", "section_max_wait >= section_wait": "section_max_wait is below section_wait",
    "cache_size > 0": "cache_size must be positive", "min_tuple_size > 0": "min_tuple_size must be positive", "max_tuple_size >= min_tuple_size": "max_tuple_size is below min_tuple_size",
    "lru_size > 0": "lru_size must be positive", "lru_size <= cache_size": "lru_size is above cache_size", "descriptor_pad > 0": "descriptor_pad must be positive",
    "max_snapshots > 0": "max_snapshots must be positive", "max_wals > 0": "max_wals must be positive", "max_capacity_bytes > 0": "max_capacity_bytes must be positive",
    "scheduler_thread_count between 1 and 256": "scheduler_thread_count isn't within 1 to 256", "gossip_init_interval_s > 0": "gossip_init_interval_s must be positive", "gossip_init_count > 0": "gossip_init_count must be positive",
    "gossip_steady_interval_s >= gossip_init_interval_s": "gossip_steady_interval_s is below gossip_init_interval_s", "gossip_timeout_ms > 0": "gossip_timeout_ms must be positive",
    "hebbian_decay_factor > 0 and hebbian_decay_factor < 1": "hebbian_decay_factor isn't between 0 and 1", "eabf_maintenance_ms > 0": "eabf_maintenance_ms must be positive", "eabf_base_ttl_ms >= eabf_maintenance_ms": "eabf_base_ttl_ms is below eabf_maintenance_ms",
    "respiration_tau_min_ms > 0": "respiration_tau_min_ms must be positive", "respiration_tau_max_ms >= respiration_tau_min_ms": "respiration_tau_max_ms is below respiration_tau_min_ms",
    "relay_max_retries > 0": "relay_max_retries must be positive", "relay_retry_delay_ms > 0": "relay_retry_delay_ms must be positive",
}


def violations(config: DataFrame) -> DataFrame:
    """config with violations: what its values break, of the rules whose columns it has."""
    known = set(config.columns)
    fits = {r: m for r, m in RULES.items() if {w for w in r.replace("(", " ").split() if "_" in w} <= known}
    return config.withColumn("violations", F.array_compact(F.array(*(F.when(~F.expr(r), F.lit(m)) for r, m in fits.items()))) if fits else F.array().cast("array<string>"))


def staged(changes: DataFrame, fields: DataFrame) -> DataFrame:
    """changes (field, value) with reason: null where the field is known and its value has the declared type (fields: field, type)."""
    typed = {"int": r"^-?[0-9]+$", "float": r"^-?[0-9]+(\.[0-9]+)?$", "bool": "^(true|false)$", "string": "(?s)^.*$"}
    fits = F.lit(False)
    for kind, pattern in typed.items():
        fits = fits | ((F.col("type") == kind) & F.col("value").rlike(pattern))
    return changes.join(fields, "field", "left").withColumn("reason", F.when(F.col("type").isNull(), "unknown field").when(~fits, "wrong type")).drop("type")
