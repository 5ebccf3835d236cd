"""Quality classifier: a sparse rule ensemble.

Statistics of a whole text are taken in one pass over its bytes. Small regression trees
are boosted on labelled rows; in each round another tree is grown for the same gradients on half of the rows, and every
path from its root becomes a conjunctive rule
over statistics (the halves make the rules differ; the boosted trees only move the gradients). A lasso logistic regression leaves few rules with a weight, and the
rules that remain are compiled into one Spark column expression, which scores all rows.

The fit is the one bounded part: it takes at most ``max_rows`` labelled rows, those with
the smallest hashes of their ids, and its model has a bounded number of rules.
Rows whose crc32(id as text) mod 4 is 2 are held out and never learnt from. Labels,
ids, languages and sources are no inputs of a score.

Null text counts as empty; every statistic of an empty text is defined, so it gets a
score like any other. Labels that are null, or disagree for one id, are left out. Without
labels of both kinds every score is the share of label 1 (0.5 without labels). Repeated rows get a
row each, and so do null ids, which are never held out. Texts of any length are measured whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import text_of

#: Labelled rows that the fit takes at most; score from which a text counts as good.
MAX_ROWS, GOOD = 20_000, 0.7

_UPPER, _LOWER, _DIGIT, _SPACE = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (9, 14)))
_SPACE += b" "
_STOPS = b".,;:'\"()-"
_MARKS = bytes(c for c in range(33, 127) if c not in _UPPER + _LOWER + _DIGIT + _STOPS)
STATISTICS = ("log_bytes", "upper", "lower", "digit", "space", "stops", "marks", "bangs", "pipes", "high", "log_words", "word_bytes", "distinct", "top_word", "word_spread", "marked_ends", "log_lines", "line_words", "distinct_lines", "short_lines", "long_word", "repeat_pairs")


def statistics(text: bytes) -> tuple[float, ...]:
    """STATISTICS of a UTF-8 text: shares of bytes, words and lines, and logarithms of counts."""
    n = len(text)
    size = max(1, n)
    share = lambda chars: (n - len(text.translate(None, chars))) / size
    words = text.split()
    m = len(words)
    each = max(1, m)
    lower = text.lower().split()
    counts: dict[bytes, int] = {}
    for w in lower:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.float64, m) if m else np.zeros(1)
    ended = sum(1 for w in words if w[-1] in _MARKS) if m else 0
    lines = text.split(b"\n")
    short = sum(1 for x in lines if len(x) < 20)
    pairs = len(set(zip(lower, lower[1:], strict=False)))
    return (
        float(np.log1p(n)), share(_UPPER), share(_LOWER), share(_DIGIT), share(_SPACE), share(_STOPS), share(_MARKS),
        text.count(b"!") / size, text.count(b"|") / size, share(bytes(range(128, 256))),
        float(np.log1p(m)), float(lengths.mean()), len(counts) / each, max(counts.values(), default=0) / each, float(lengths.std()), ended / each,
        float(np.log1p(len(lines))), m / len(lines), len(set(lines)) / len(lines), short / len(lines), float(lengths.max()), 1 - pairs / max(1, m - 1) if m > 1 else 0.0,
    )


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's rows as a struct named row, and a double column for each of STATISTICS."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.array([statistics((b := t.as_buffer()) and b.to_pybytes() or b"") for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in found.T)], ["row", *STATISTICS])

    out = StructType([rows.schema["row"], *(StructField(s, DoubleType()) for s in STATISTICS)])
    return rows.mapInArrow(run, out)


#: A condition: (statistic, whether it must be above the threshold, threshold).
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class Rules:
    """The fitted ensemble: log-odds = base + the weights of the rules that hold."""

    base: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def log_odds(self) -> Column:
        total = F.lit(self.base)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for s, above, at in conditions:
                c = F.col(STATISTICS[s])
                holds = holds & ((c > at) if above else (c <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self) -> Column:
        """The probability of label 1, as a column expression over STATISTICS."""
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds()))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, above, at in conditions:
        out &= (x[:, s] > at) == above
    return out


def _grown(bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, path: tuple[Condition, ...], depth: int, least: int, out: np.ndarray, found: set) -> None:
    """Grows one tree node on rows: notes the paths, fills out with the leaves' steps."""
    if path:
        found.add(path)
    g, h = grad[rows], hess[rows]
    best = (1e-6, -1, 0)
    if depth and len(rows) >= 2 * least:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for s, cut in enumerate(cuts):
            if not len(cut):
                continue
            b = bins[rows, s]
            gs = np.cumsum(np.bincount(b, g, len(cut) + 1))[:-1]
            hs = np.cumsum(np.bincount(b, h, len(cut) + 1))[:-1]
            ns = np.cumsum(np.bincount(b, minlength=len(cut) + 1))[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), s, k)
    if best[1] < 0:
        out[rows] = -g.sum() / (h.sum() + 1)
        return
    _, s, k = best
    left = bins[rows, s] <= k
    for above, part in ((False, rows[left]), (True, rows[~left])):
        _grown(bins, cuts, grad, hess, part, (*path, (s, above, float(cuts[s][k]))), depth - 1, least, out, found)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 2e-3, steps: int = 600) -> Rules:
    """Fits the ensemble to statistics x and labels y (0 or 1)."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Rules(float(np.log(share / (1 - share))), ())
    cuts = []
    for s in range(x.shape[1]):
        v = np.unique(x[:, s])
        mid = (v[1:] + v[:-1]) / 2
        cuts.append(np.unique(np.quantile(mid, np.linspace(0, 1, 48), method="nearest")) if len(mid) else mid)
    bins = np.stack([np.searchsorted(c, x[:, s], "left") for s, c in enumerate(cuts)], 1)
    least = max(5, len(y) // 400)
    found: set[tuple[Condition, ...]] = set()
    margin = np.full(len(y), np.log(share / (1 - share)))
    rng = np.random.default_rng(0)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        half = np.flatnonzero(rng.random(len(y)) < 0.5)
        _grown(bins, cuts, p - y, p * (1 - p), half, (), depth, least, np.zeros(len(y)), found)  # its paths are the rules
        step = np.zeros(len(y))
        _grown(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), (), depth, least, step, set())  # its steps move the margin
        margin += rate * step
    unique: dict[bytes, tuple[Condition, ...]] = {}
    for path in sorted(found, key=lambda p: (len(p), p)):
        held = _holds(x, path)
        if 0 < held.mean() < 1:
            unique.setdefault(min(held.tobytes(), (~held).tobytes()), path)  # a rule and its opposite say the same
    paths_ = list(unique.values())
    if not paths_:  # no statistic tells any rows apart
        return Rules(float(np.log(share / (1 - share))), ())
    r = np.stack([_holds(x, p) for p in paths_], 1).astype(float)
    mean, scale = r.mean(0), np.maximum(r.std(0), 0.05)
    z = (r - mean) / scale
    w, b = np.zeros(z.shape[1]), float(np.log(share / (1 - share)))
    bound = 0.25 * np.linalg.norm(np.c_[z, np.ones(len(z))], 2) ** 2 / len(z)
    wv, bv, t = w.copy(), b, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        err = 1 / (1 + np.exp(-(z @ wv + bv))) - y
        nw = wv - z.T @ err / len(z) / bound
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / bound, 0)
        nb = bv - err.mean() / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wv, bv = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    weights = w[kept] / scale[kept]
    return Rules(float(b - (weights * mean[kept]).sum()), tuple((paths_[i], float(v)) for i, v in zip(kept, weights, strict=True)))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Rules:
    """Fits rules to labels (doc_id, quality) of rows of docs that aren't held out."""
    clean = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)")
    clean = clean.groupBy("id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    clean = clean.where(~held_out("id")).orderBy(F.xxhash64("id"), "id").limit(max_rows).select("id", "quality")  # max_rows rows at most, so it's broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(clean), "id")
    found = measured(rows).select("row.id", "row.quality", *STATISTICS).dropDuplicates(["id"]).toPandas().sort_values("id")
    return fit(found[list(STATISTICS)].to_numpy(float), found["quality"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, good: float = GOOD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    rules = learnt(docs, labels, id_col, text_col, max_rows)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    score = measured(narrow).select("row.doc_id", F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), rules.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= good).cast("int"))


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, good: float = GOOD) -> DataFrame:
    """The rows of docs that score good or more, as they are."""
    rules = learnt(docs, labels, id_col, text_col, max_rows)
    return measured(docs, text_col).where(rules.score() >= good).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
