"""The training-text operators against brute force, round trips and held-out accuracy, and on odd inputs."""

import hashlib
import math
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers as tokenizer_files
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup, fingerprints, line_dedup, lm_score, packing, quality, sentencepieces, simhash, url_filter, warc

RANKS, PATTERN = tokenizer_files.path("byte_bpe_50k.tiktoken"), tokenizer_files.PATTERN
JSON, PIECES = tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "One"), (5, "One"), (6, "ONE two"), (7, "a  b\n c"), (8, "a b c"), (9, "a b\tc"),
    (10, "é ü ▁ 漢字 \u00a0 x\u2028y <s> <0x0A> <|endoftext|>"), (11, "word " * 3000), (12, "  leading\n\n\n  and   trailing  "), (13, "x" * 5000), (14, "\x85\x1c\u180e"), (14, "\x85\x1c\u180e"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties and repeated rows; extra columns with names that operators use."""
    return spark.createDataFrame(ODD, DOCS).repartition(3).withColumn("fp", F.lit("x")).withColumn("upper", F.lit(None).cast("int")).withColumn("row", F.lit(1)).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def prose(seed, n, words=60):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "of", "an", "re", "tion", "ed", "in", "ou"]) + r.choice(["", "ing", "ly", "ed,", "er."]) for _ in range(r.randint(1, words))) for _ in range(n)]


# 1: SimHash


def test_fingerprint():
    import xxhash

    for text in (b"", b" \n", b"A b", b"a b c", b"x y Z q  w\t\n e r", ("é Ô " * 50).encode()):
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in text).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest(n, near):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    n = 1800
    bucket = np.sort(np.r_[np.zeros(1300, int), rng.integers(1, 200, n - 1300)])
    base = rng.integers(0, 1 << 8 * radius, 5).astype(np.uint64)
    value = base[rng.integers(0, 5, n)]
    for _ in range(radius + 1):
        value = value ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 8 * radius, n).astype(np.uint64), np.uint64(0))
    got = simhash.linked(bucket, value[:, None], 8 * radius, radius)
    assert got.tolist() == smallest(n, lambda i, j: bucket[i] == bucket[j] and int(value[i] ^ value[j]).bit_count() <= radius)


def test_components_of_few_edges_need_no_rounds(spark, monkeypatch):
    """Few edges meet on the driver after one written table; beyond the limit rounds find the same."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)] + [(-(1 << 63), (1 << 63) - 1), (7, 7), (1, 0)]
    df = spark.createDataFrame(edges, "a long, b long")
    rounds = sorted(tuple(x) for x in common.components(df, limit=0).collect())
    tables = []
    monkeypatch.setattr(common, "written", lambda x, write=common.written: tables.append(x) or write(x))
    assert sorted(tuple(x) for x in common.components(df).collect()) == rounds and len(tables) == 1
    low = {n: n for e in edges if e[0] != e[1] for n in e}
    while any(low[a] != low[b] for a, b in edges if a != b):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert rounds == sorted(low.items())
    assert common.components(df.limit(0)).isEmpty()


def test_simhash_components(spark, odd, none):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(6)]
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = {f: i for i, f in reversed(list(enumerate(signed)))}
    df = spark.createDataFrame([(f, i) for f, i in distinct.items()], "fp long, rep long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df)).collect()}
    want = smallest(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert all(found.get(i, i) == want[i] for i in distinct.values())
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.component_id for r in rows if r.doc_id in (1, 2, 3)} == {1} and {r.fp for r in rows if r.doc_id == 1} == {0}
    assert simhash.near_duplicates(none).isEmpty()


def test_similar_groups(spark, odd, none):
    r = random.Random(1)
    docs, words = [], [f"w{i}" for i in range(5000)]
    for i in range(40):
        text = [r.choice(words) for _ in range(400)]
        docs.append((3 * i, " ".join(text)))
        text[r.randrange(400)] = "other"
        docs.append((3 * i + 1, " ".join(text)))  # Jaccard index above 0.97
        docs.append((3 * i + 2, " ".join(r.choice(words) for _ in range(400))))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {d: d - 1 if d % 3 == 1 else d for d, _ in docs}
    assert simhash.similar_groups(odd).count() == len(ODD) and simhash.similar_groups(none).isEmpty()


def test_similar_groups_are_exact(spark):
    r = random.Random(2)
    words, docs = [f"w{i}" for i in range(9000)], []
    for i in range(240):  # pairs whose Jaccard index lies between 0.65 and 0.85
        text = [r.choice(words) for _ in range(300)]
        docs.append((2 * i, " ".join(text)))
        for at in r.sample(range(10, 290), 6 + i % 8):
            text[at] = "other"
        docs.append((2 * i + 1, " ".join(text)))
    docs += [(1000, "the same line of words over and over " * 40 + "first end"), (1001, "the same line of words over and over " * 40 + " ".join(words[:20]))]
    kinds = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    index = lambda i, j: len(kinds[i] & kinds[j]) / len(kinds[i] | kinds[j])
    near = [index(i, i + 1) for i in range(0, len(docs), 2)]
    assert sum(0.8 <= x < 0.83 for x in near) > 10 and sum(0.75 < x < 0.8 for x in near) > 20
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {d: docs[i - i % 2][0] if near[i // 2] >= 0.8 else d for i, (d, _) in enumerate(docs)}


def test_large_groups_are_dealt_out(spark, monkeypatch):
    """Buckets and groups that count as large give the groups that brute force gives."""
    monkeypatch.setattr(simhash, "HELD", 2000)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "LARGE", 4)
    r = random.Random(5)
    words, docs, base = [f"w{i}" for i in range(9000)], [], None
    base = [r.choice(words) for _ in range(250)]
    for i in range(80):  # a chain of edits: neighbours are alike, ends aren't
        if i % 2:
            base[r.randrange(250)] = r.choice(words)
        text = list(base)
        for at in r.sample(range(250), i % 9):
            text[at] = "other"
        docs.append((i, " ".join(text)))
    docs += [(100 + i, docs[3][1]) for i in range(5)]
    kinds = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in docs)]
    want = smallest(len(docs), lambda i, j: len(kinds[i] & kinds[j]) >= 0.8 * len(kinds[i] | kinds[j]) - 1e-9)
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(spark.createDataFrame(docs, DOCS).repartition(3)).collect()}
    assert len(set(want)) > 1 and got == {d: docs[want[i]][0] for i, (d, _) in enumerate(docs)}


def test_alike():
    rng = np.random.default_rng(4)
    base = [rng.choice(400, 60, replace=False) for _ in range(12)]
    sets = [np.unique(np.r_[rng.choice(base[i % 12], rng.integers(52, 60), replace=False), rng.integers(400, 800, rng.integers(0, 6))]).astype(np.uint64) for i in range(150)]
    index = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert simhash.alike(sets, 0.8).tolist() == smallest(len(sets), lambda i, j: index(i, j) >= 0.8)


# 2: packing


def best_fit_decreasing(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect_left(rooms, x)
        room = rooms.pop(k) - x if k < len(rooms) else capacity - x
        insort(rooms, room)
    return len(rooms)


@pytest.mark.parametrize("kind", ["few", "uniform", "normal", "small", "middle", "log"])
def test_plan(kind):
    r = random.Random(7)
    draw = {"few": lambda: r.choice([200, 300, 350, 400, 624]), "uniform": lambda: r.randint(1, 1023), "normal": lambda: min(1023, max(1, int(r.gauss(500, 200)))), "small": lambda: r.randint(1, 60), "middle": lambda: r.randint(200, 600), "log": lambda: min(1023, max(1, int(r.lognormvariate(5.5, 1))))}[kind]
    lengths = Counter(draw() for _ in range(6000))
    got, used = Counter(), 0
    for sizes, n in packing.plan(dict(lengths)):
        assert sum(sizes) <= 1024
        got.update({s: n * k for s, k in Counter(sizes).items()})
        used += n
    assert got == lengths
    assert used <= best_fit_decreasing(lengths.elements(), 1024)
    assert packing.plan({}) == [] and packing.plan({5: 1}) == [((5,), 1)]


def test_packing(spark, odd, none):
    import tokenizers

    exact = tokenizers.Tokenizer.from_file(JSON)
    rows = packing.pack(odd, JSON, RANKS, PATTERN, with_ids=True).collect()
    assert len(rows) == len({(r.sequence_id, r.offset) for r in rows})
    by_sequence = {}
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    for doc, text in ODD[:-1]:
        own = sorted((r.piece, r.start, r.ids) for r in rows if r.doc_id == doc)
        if doc == 14:
            own = own[::2]
        ids = [i for _, _, part in own for i in part]
        assert ids == [*exact.encode(text or "", add_special_tokens=False).ids, 2]
        assert [s for _, s, _ in own] == list(np.cumsum([0, *(len(p) for _, _, p in own)])[:-1]) and all(len(p) == 1024 for _, _, p in own[1:])
    assert packing.pack(none, JSON).isEmpty()


# 3: line dedup


def without_repeats(docs, least):
    texts = [t.split("\n") for _, t in sorted(docs)]
    gone = [[False] * len(x) for x in texts]
    places = [(a, i) for a, x in enumerate(texts) for i in range(len(x))]
    for k, (a, i) in enumerate(places):
        for b, j in places[:k]:
            n = 0
            while i + n < len(texts[a]) and j + n < len(texts[b]) and texts[a][i + n] == texts[b][j + n]:
                n += 1
            if sum(len(x.split()) for x in texts[a][i : i + n]) >= least:
                gone[a][i : i + n] = [True] * n
    return {d: "\n".join(x for x, g in zip(t, m, strict=True) if not g) for (d, _), t, m in zip(sorted(docs), texts, gone, strict=True)}


@pytest.mark.parametrize("seed,least", [(0, 1), (1, 5), (2, 12), (3, 5)])
def test_line_dedup(spark, seed, least):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdef") for _ in range(r.choice([0, 1, 2, 3, 9]))) for _ in range(12)]
    docs = []
    for d in range(25):
        own = [r.choice(lines) for _ in range(r.randint(1, 14))]
        if docs and r.random() < 0.5:
            other = r.choice(docs)[1].split("\n")
            k = r.randrange(len(other))
            own = own[:3] + other[k : k + r.randint(1, 9)] + own[3:]
        docs.append((d * 3, "\n".join(own)))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, DOCS).repartition(3), least)
    assert {x.doc_id: x.text for x in got.collect()} == without_repeats(docs, least)


def test_line_dedup_odd(odd, none):
    got = line_dedup.line_dedup(odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and {(r.doc_id, r.text) for r in got.collect()} == {(d, t or "") for d, t in ODD}
    assert line_dedup.line_dedup(none).isEmpty()


def test_line_dedup_many_copies(spark):
    """A passage in most documents: an interval far above the size that counts as large."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, f"own {i}\n{passage}\nend {i}") for i in range(300)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(docs, DOCS)).collect()}
    assert got == {i: t if not i else f"own {i}\nend {i}" for i, t in docs}


# 4: fingerprints


def winnowed(text, spark, k=5, window=8):
    row = spark.createDataFrame([(text,)], "text string").select(F.transform(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("h")).first()
    mask = (1 << 64) - 1
    turn = lambda x, n: ((x << n) | (x >> (64 - n))) & mask
    h = [x & mask for x in row.h]

    def gram(part):
        out = 0
        for x in part:
            out = turn(out, 1) ^ x
        return out

    grams = [gram(h[i : i + k]) >> 33 for i in range(len(h) - k + 1)] if len(h) >= k else ([gram(h) >> 33] if h else [])
    chosen = []
    for at in range(max(1, len(grams) - window + 1) if grams else 0):
        part = grams[at : at + window]
        best = max(i for i, g in enumerate(part) if g == min(part)) + at
        if (grams[best], best) not in chosen:
            chosen.append((grams[best], best))
    return chosen


def test_winnowing(spark):
    for text in ["", "one", "a b c d e", *prose(5, 6), "same same same same same same same same same same same same same same same"]:
        row = spark.createDataFrame([(text,)], "text string").select(fingerprints.selected(F.col("text")).alias("s")).select(fingerprints.positions(F.col("s")).alias("p"), F.transform("s", lambda x: F.shiftrightunsigned(x, 32)).alias("g")).first()
        assert list(zip(row.g, row.p, strict=True)) == winnowed(text, spark)


def test_fingerprint_pairs(spark, odd, none):
    docs = [(7 * i, t) for i, t in enumerate(prose(9, 700))]
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(docs, DOCS).repartition(5)).collect()}
    for i, (d, text) in enumerate(docs):
        n = len(text) // 3
        edited = text[: len(text) - n] + docs[i - 1][1][:n]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
    sets = {d: {g for g, _ in winnowed(t, spark)} for d, t in docs[:3]}
    a, b = sets[7], sets[0]
    assert got[7].near_next == pytest.approx(len(a & b) / len(a | b))
    rows = fingerprints.fingerprint_pairs(odd).collect()
    assert len(rows) == len(ODD) and len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1 and all(0 <= r.near_next <= 1 for r in rows)
    assert fingerprints.fingerprint_pairs(none).isEmpty() and fingerprints.fingerprint_pairs(spark.createDataFrame([(5, "abc")], DOCS)).first().n_chars == 3


# 5: WARC


def test_loser_tree():
    for seed in range(200):
        r = random.Random(seed)
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(6))) for _ in range(r.randrange(9))]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(sum(runs, []))


def test_warc(spark):
    big = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 60
    pages = [(1, "http://a.b/x?q#f", big), (2, None, big), (3, "HTTP://A.b/\x00 y", ""), (4, "", None), (5, "http://a.b/x", "small"), (6, "http://a.b/x", "small"), (7, "http://a.b/x", big), (7, "http://a.b/x", big)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    rows = warc.capture_histories(df).collect()
    assert [(r.urlkey, r.timestamp, r.page_id) for r in rows] == sorted((r.urlkey, r.timestamp, r.page_id) for r in rows) and len(rows) == len(pages)
    for r in rows:
        html = (dict((p, h) for p, _, h in pages)[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 7) if r.page_id in (1, 2) else ("response", None))
    assert warc.capture_histories(df.limit(0)).isEmpty()


# 6: LM scores


def kneser_ney(texts, ids):
    """P(c | a, b) by plain loops, for a vocabulary of so many ids."""
    c3 = Counter()
    for x in texts:
        y = [lm_score.END, lm_score.END, *x]
        c3.update(zip(y, y[1:], y[2:], strict=False))
    c2, c1 = Counter((b, c) for _, b, c in c3), Counter()
    c1.update(c for _, c in c2)

    def discount(counts):
        n = [sum(v == k for v in counts.values()) for k in (1, 2, 3, 4)]
        return [min(max(k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1], 0.1), k - 0.1) if n[k - 1] and n[0] else 0.75 for k in (1, 2, 3)]

    d3, d2 = discount(c3), discount(c2)
    loss = lambda n, d: d[min(n, 3) - 1] if n else 0

    def mass(counts, key):
        own = [n for k, n in counts.items() if k[:-1] == key]
        return sum(own), own

    def p(a, b, c):
        p1 = (c1[c] + 1) / (len(c2) + ids)
        total, own = mass(c2, (b,))
        p2 = (c2[b, c] - loss(c2[b, c], d2) + sum(loss(n, d2) for n in own) * p1) / total if total else p1
        total, own = mass(c3, (a, b)) if b != lm_score.END else (0, [])
        return (c3[a, b, c] - loss(c3[a, b, c], d3) + sum(loss(n, d3) for n in own) * p2) / total if total else p2

    return p


def test_counts(spark, monkeypatch):
    """The counts' probabilities against plain loops, for texts of the training rows and others; over all ids they sum to 1."""
    monkeypatch.setattr(lm_score, "CHUNK", 500)
    rng = np.random.default_rng(1)
    texts = [np.r_[(rng.integers(0, 60, rng.integers(0, 60)) ** 2) // 60, lm_score.END].astype(np.int32) for _ in range(70)]
    p = kneser_ney([x.tolist() for i, x in enumerate(texts) if i % 7 != 2], lm_score.IDS)
    rows = [(i, i % 7 == 2, x.astype("<u2").tobytes(), i // 9) for i, x in enumerate(texts)]
    tokens = spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary, chunk long").repartition(3)
    got = {r.doc_id: np.frombuffer(r.base, "<f4") for r in lm_score.based(tokens).collect()}
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        y = [lm_score.END, lm_score.END, *x.tolist()]
        assert np.allclose(got[i], [p(*t) for t in zip(y, y[1:], y[2:], strict=False)], rtol=1e-4, atol=1e-9)
    rest = range(60, lm_score.IDS - 1)  # ids that no text has: all alike
    for a, b in ((0, 1), (lm_score.END, lm_score.END), (5, 59), (lm_score.END, 0)):
        assert sum(p(a, b, c) for c in (*range(60), lm_score.END)) + len(rest) * p(a, b, 60) == pytest.approx(1)


def test_attention_sums_to_one():
    """One window whose last place takes every id, over counts that give all the same."""
    rng = np.random.default_rng(0)
    net = lm_score.Attention()
    ids = np.arange(lm_score.IDS, dtype=np.int32)
    now = rng.integers(0, 40, lm_score.STEP).astype(np.int32)[None].repeat(lm_score.IDS, 0)
    now[:, -1] = ids
    past = rng.integers(0, 40, (1, lm_score.BACK)).astype(np.int32)
    total = sum(net.forward(past.repeat(len(part), 0), part, np.full(part.shape, 1 / lm_score.IDS, np.float32))[0][:, -1].astype(float).sum() for part in np.array_split(now, 40))
    assert total == pytest.approx(1, abs=2e-3)


def test_log_probabilities_by_a_loop():
    """Windows and batches against a loop over single ids with the same parameters."""
    rng = np.random.default_rng(2)
    values = lm_score.Attention().values.copy()
    values += rng.normal(0, 0.3, values.shape).astype(np.float32)
    net = lm_score.Attention(values)
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 15, 16, 17, 100)]
    bases = [rng.uniform(0.001, 0.1, len(x)).astype(np.float32) for x in texts]
    got = lm_score.log10_probabilities(texts, bases, net)
    row = lambda i: int(net.rows(np.array([i]))[0])
    distance = values[lm_score.ROWS :, : lm_score.STEP].reshape(-1)
    for x, base, score in zip(texts, bases, got, strict=True):
        want = 0.0
        for t in range(len(x)):
            first = max(0, t // lm_score.STEP * lm_score.STEP - lm_score.BACK)
            before = lambda j: row(x[j - 1] if j else lm_score.END)
            weight = {j: math.exp(float(net.q[before(t)] @ net.k[before(j) if j > first or not j else row(lm_score.END)]) + float(net.bias[row(x[j])]) + float(distance[t - j - 1])) for j in range(first, t)}
            sink = math.exp(float(values[before(t), 2 * lm_score.DIM + 1]))
            copied = sum(w for j, w in weight.items() if x[j] == x[t])
            want += math.log10((sink * float(base[t]) + copied) / (sink + sum(weight.values())))
        assert score == pytest.approx(want, rel=1e-4)


def test_training_takes_all_windows(spark):
    x = np.arange(100, 260, dtype=np.int32)
    rows = [(x.astype("<u2").tobytes(), np.full(len(x), 0.01, np.float32).tobytes())]
    net = lm_score.trained(spark.createDataFrame(rows, "ids binary, without binary"))
    assert (net.values[net.rows(x[:-1]), 2 * lm_score.DIM + 1] != 4.5).all()  # every id that another follows moved its sentinel


def test_answers_leave_no_shuffles(spark, monkeypatch):
    """A triple is asked for once by each group of texts, the answers are 8 bytes for it, and nothing else stays on disk."""
    monkeypatch.setattr(lm_score, "SHARD", 2_000)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (manager.getAllFiles().apply(i).getName() for i in range(manager.getAllFiles().size())) if f.startswith("shuffle_")}
    rng = np.random.default_rng(2)
    texts = [np.r_[rng.integers(0, 30, 200), lm_score.END].astype(np.int32) for _ in range(60)]
    rows = [(i, i % 7 == 2, x.astype("<u2").tobytes(), i // 20) for i, x in enumerate(texts)]
    tokens = lm_score.written(spark.createDataFrame(rows, "doc_id long, held_out boolean, ids binary, chunk long").repartition(3))
    before = shuffles()
    found, shards = lm_score.answers(tokens)
    assert not [f for f in shuffles() - before if f.endswith(".data")]
    groups = {}
    for i, x in enumerate(texts):
        y = [lm_score.END, lm_score.END, *x.tolist()]
        groups.setdefault((i // 20) * 2 + (i % 7 == 2), set()).update(zip(y, y[1:], y[2:], strict=False))
    assert shards > 1 and {r.part: r.n for r in found.groupBy("part").agg(F.sum(F.length("p") + F.length("q")).alias("n")).collect()} == {k: 8 * len(v) for k, v in groups.items()}
    x = np.array([0, 1, 1 << 47, 5, 70_000])
    assert (lm_score.unpacked(lm_score.packed(x, 6), 6, "<i8") == x).all()


def test_rounds_take_all_texts_in_parts(spark, monkeypatch):
    """Every text is trained on and scored once, a part of them at a time; counts and what they give are those of all rounds, and a round goes on from the one before."""
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    r = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(r.choice(("the", "red", "ant", "ran", "over")) for _ in range(60))) for i in range(200)], "doc_id long, text string").repartition(2)
    once = {r.doc_id: r for r in lm_score.scores(df, RANKS, PATTERN).collect()}
    monkeypatch.setattr(lm_score, "ROUND", 4_000)
    sizes, begun, trained, attached = [], [], lm_score.trained, lm_score.attached

    def spy(tokens, answered, shards):
        sizes.append(tokens.agg(F.sum(F.length("ids"))).first()[0] // 2)
        return attached(tokens, answered, shards)

    def spy_trained(train, counts, before):
        begun.append(before)
        return trained(train, counts, before)

    monkeypatch.setattr(lm_score, "attached", spy)
    monkeypatch.setattr(lm_score, "trained", spy_trained)
    rows = lm_score.scores(df, RANKS, PATTERN).collect()
    total = sum(sizes[4:])
    assert len(sizes) == 8 and max(sizes) <= total / 3 and total >= 12_000 and sum(sizes[:4]) < total
    assert begun[0] is None and all(b is not None for b in begun[1:])
    same = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    assert len(rows) == 200 and all([getattr(r, c) for c in same] == [getattr(once[r.doc_id], c) for c in same] for r in rows)
    assert sum(r.score for r in rows) > sum(once[r.doc_id].score for r in rows) - 0.05 * abs(sum(r.score for r in rows))
    tokens = lm_score.written(spark.createDataFrame([(i, i % 7 == 2, np.array([*map(ord, "to be or not to be"), lm_score.END], "<u2").tobytes(), i // 3) for i in range(20)], "doc_id long, held_out boolean, ids binary, chunk long"))
    whole, shards = lm_score.answers(tokens)
    found, _ = lm_score.answers_of(lm_score.in_rounds(tokens, 3), 20 * 19)
    values = lambda df: {(r.part, r.shard): (r.p, r.q) for r in df.collect()}
    parts = [values(x) for x in found]
    assert all(parts) and {k: v for x in parts for k, v in x.items()} == values(whole) and sum(map(len, parts)) == len(values(whole))
    keys = np.random.default_rng(0).integers(0, 50, 300) << 33
    assert all((a == b).all() for a, b in zip(lm_score.placed(keys), np.unique(keys, return_inverse=True), strict=True))
    assert [len(x) for x in lm_score.placed(keys[:0])] == [0, 0]


def predicting(seed, noise):
    """A model with a head whose parameters are drawn."""
    rng = np.random.default_rng(seed)
    net = lm_score.Attention()
    net.head = lm_score.Predictor(np.arange(lm_score.IDS, dtype=np.int64).tobytes())
    rows = lm_score.flat(net)
    return lm_score.unflat(rows + rng.normal(0, noise, rows.shape), net.head.counts)


def test_output_predicts_every_id():
    """One window whose last place takes every id: what the attention's output predicts sums to 1, and so does the mixture."""
    rng, net = np.random.default_rng(0), predicting(1, 0.2)
    now = rng.integers(0, 40, lm_score.STEP).astype(np.int32)[None].repeat(lm_score.IDS, 0)
    now[:, -1] = np.arange(lm_score.IDS)
    past = rng.integers(0, 40, (1, lm_score.BACK)).astype(np.int32)
    found = [net.forward(past.repeat(len(x), 0), x, np.full(x.shape, 1 / lm_score.IDS, np.float32)) for x in np.array_split(now, 40)]
    assert sum(f[0][:, -1].astype(float).sum() for f in found) == pytest.approx(1, abs=2e-3)
    soft = np.concatenate([f[-1][0][:, -1] for f in found]).astype(float)
    assert soft.sum() == pytest.approx(1, abs=2e-3)
    other = net.forward(now[:1, : lm_score.BACK], now[:1], np.full((1, lm_score.STEP), 1 / lm_score.IDS, np.float32))[-1][0][0, -1]
    assert other != soft[0]  # it depends on what stands before


def test_gradients_by_differences():
    """The steps' gradients, of the attention too, against differences of the loss."""
    net = predicting(4, 0.1)
    rng = np.random.default_rng(5)
    past, now = (rng.integers(0, 30, (6, n)).astype(np.int32) for n in (lm_score.BACK, lm_score.STEP))
    base = rng.uniform(0.001, 0.01, now.shape).astype(np.float32)
    rows = lm_score.flat(net).astype(float)
    loss = lambda x: -np.log(lm_score.unflat(x, net.head.counts).forward(past, now, base)[0].astype(float)).mean()
    seen = np.zeros_like(net.values), np.zeros_like(net.head.rows), np.zeros_like(net.head.nodes)
    net.step(past, now, base, seen[0], seen[1:])  # squared gradients
    squares = np.concatenate([x.ravel() for x in seen])
    width = rows.shape[1]
    a, b = net.values.size, net.values.size + net.head.rows.size
    for lo, hi in ((0, a), (a, b), (b, len(squares))):
        for at in lo + np.argsort(-squares[lo:hi])[:4]:
            ends = []
            for d in (1e-2, -1e-2):
                x = rows.copy()
                x[at // width, at % width] += d
                ends.append(loss(x))
            assert abs(ends[0] - ends[1]) / 2e-2 == pytest.approx(squares[at] ** 0.5, rel=0.03, abs=2e-5)


def test_ids_that_follow_are_predicted(spark):
    """Counts that know nothing: what follows is learnt by the attention's output, though nothing can be copied."""
    x = np.concatenate([np.random.default_rng(i).permutation(200).astype(np.int32) * 2 for i in range(150)])
    x = np.c_[x, x + 1].ravel()  # an odd id follows its even one; none comes twice in a window but by chance
    rows = [(x.astype("<u2").tobytes(), np.full(len(x), 1e-3, np.float32).tobytes())]
    net = lm_score.trained(spark.createDataFrame(rows, "ids binary, without binary"))
    flat = [np.full(len(x), 1e-3, np.float32)]
    got = lm_score.log10_probabilities([x], flat, net)
    net.head = None
    assert got / len(x) > lm_score.log10_probabilities([x], flat, net) / len(x) + 0.3


def test_scores(spark, odd, none):
    r = random.Random(5)
    names = [f"{a}{b}" for a in ("the", "re", "tion", "an", "ou") for b in ("ing", "ed", "er", "ly")]
    after = {w: r.sample(names, 3) for w in names}
    docs = list(ODD)
    for i in range(400):  # each word follows from the one before
        text = [r.choice(names)]
        while len(text) < 80:
            text.append(r.choice(after[text[-1]]))
        docs.append((100 + i, " ".join(text)))
    df = spark.createDataFrame(docs, DOCS).repartition(3)
    rows = lm_score.scores(df, RANKS, PATTERN).collect()
    words = [(d, (t or "").encode().translate(simhash.LOWER).split() + ["end"]) for d, t in docs]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, ws in words if not held(d) for w in ws)
    total = sum(c.values())
    want = sorted((d, held(d), len(ws), sum(c[w] > 0 for w in ws), total, round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), 4)) for d, ws in words)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
    out = [r for r in rows if r.held_out and r.doc_id >= 100]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) and all(r.score < 0 for r in rows)
    assert lm_score.scores(none, RANKS, PATTERN).isEmpty()


# 7: URL filter


def test_url_filter(spark):
    r = random.Random(0)
    hosts = ["com", "example.com", "a.example.com", "ample.com", "net", "x.example.net", "EXAMPLE.org", "org", "bexample.com"]
    urls = [None, "", "no scheme", "://", "http://", "a://b://c/en/"] + [f"{s}://{r.choice(hosts)}{p}{r.choice(['', '?q=/en/', '#f', 'x'])}" for p in ("", "/", "/en", "/en/", "/en/7", "/en/71", "/de/", "/de/8", "/DE/8", "/es/") for s in ("http", "HTTPS") for _ in range(6)]
    pages = list(enumerate(urls)) + [(3, urls[9])]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("rule", F.lit("x"))

    def judged(url):
        rest = url.partition("://")[2] if url and "://" in url else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut : min((rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0), default=len(rest))]
        fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda f: len(f[0]), default=(None, "allow"))
        return host, path, rule, verdict

    got = sorted(map(str, (tuple(r) for r in url_filter.url_filter(df, url_filter.listed(spark)).collect())))
    assert got == sorted(str((i, *judged(u))) for i, u in pages)
    assert url_filter.url_filter(df, url_filter.listed(spark).limit(0)).where("verdict = 'allow'").count() == len(pages)
    assert url_filter.url_filter(df.limit(0), url_filter.listed(spark)).isEmpty()


# 8: quality


def test_quality(spark, odd, none):
    r = random.Random(0)
    docs, labels = [], []
    for i, text in enumerate(prose(4, 600)):
        good = r.random() < 0.8
        docs.append((i, text if good else " ".join(w + r.choice(["%%%", "!!", "***"]) for w in text.split())))
        labels.append((i, int(good)))
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.scored(df, marks).collect()}
    want = dict(labels)
    held = [x for x in got.values() if x.held_out]
    assert {x.doc_id for x in held} == {d for d, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(x.predicted == want[x.doc_id] for x in held) / len(held) > 0.95 and all(0 <= x.score <= 1 for x in got.values())
    assert quality.scored(odd, marks).count() == len(ODD) and quality.kept(odd, marks).columns == odd.columns
    assert {x.score for x in quality.scored(odd, marks.limit(0)).collect()} == {0.5} and quality.scored(none, marks).isEmpty()


# 9: exact dedup


@pytest.mark.parametrize("rows_per_word", [1, 50])
def test_exact_dedup(spark, rows_per_word):
    texts = prose(7, 500, 3) + ["heavy"] * 400
    docs = [*enumerate(texts), *((d + 1000, t) for d, t in ODD)]
    groups = {}
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in docs:
        groups.setdefault(norm(t), []).append(d)
    got = sorted(tuple(r) for r in exact_dedup.exact_dedup(spark.createDataFrame(docs, DOCS).repartition(4), rows_per_word=rows_per_word).collect())
    want = sorted((d, min(groups[norm(t)]), len(groups[norm(t)]), d == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in docs)
    assert got == want


def test_exact_dedup_empty(none):
    assert exact_dedup.exact_dedup(none).isEmpty()


# 10: SentencePiece


@pytest.mark.parametrize("table", [sentencepieces.TABLE, 4])
def test_sentencepiece(spark, odd, none, monkeypatch, table):
    import sentencepiece

    monkeypatch.setattr(sentencepieces, "TABLE", table)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepieces.encoded(odd, PIECES, full=True).collect()
    want = sorted((d, model.encode(t or ""), model.decode(model.encode(t or ""))) for d, t in ODD)
    assert sorted((r.doc_id, list(r.ids), r.decoded) for r in rows) == want
    for r in rows:
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() and r.n_tokens == len(r.ids)
    assert sentencepieces.encoded(none, PIECES).isEmpty()


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        now = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and now <= kept and now, name
        kept = now
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).isEmpty(), name


# odd inputs, for every operator and stage

LONG = 1_000_000
TEXTS = {"spaces": " " * LONG, "line ends": "\n" * LONG, "wide spaces": "\u3000" * LONG, "one word": "x" * LONG, "null": None, "empty": "", "same": "the same text", "other": "another text"}
LOW, HIGH = -9223372036854775807, 9223372036854775806
EXTREME = [(LOW, "spaces"), (HIGH, "line ends"), (1, "wide spaces"), (2, "one word"), (3, "null"), (4, "empty"), (None, "same"), (None, "null"), (5, "same"), (5, "same"), (6, "same"), (5, "other")]
CLASHES = ["doc", "twin", "n_lines", "__text", "__salt", "row", "fp", "near", "node", "length", "held", "word", "bits", "cell", "part", "guest", "chosen", "digest", "possible", "id", "cuts", "log_bytes"]


@pytest.fixture(scope="module")
def extreme(spark):
    df = spark.createDataFrame([(d, TEXTS[t]) for d, t in EXTREME], DOCS).repartition(3)
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHES)))


@pytest.mark.parametrize("name", ["near_duplicates", "similar_groups", "pack", "line_dedup", "fingerprint_pairs", "capture_histories", "scores", "url_filter", "scored", "exact_dedup", "encoded"])
def test_extreme(spark, extreme, name):
    labels = spark.createDataFrame([(2, 1), (4, 0)], "doc_id long, quality int")
    run = {
        "near_duplicates": lambda: simhash.near_duplicates(extreme), "similar_groups": lambda: simhash.similar_groups(extreme), "pack": lambda: packing.pack(extreme, JSON, RANKS, PATTERN),
        "line_dedup": lambda: line_dedup.line_dedup(extreme), "fingerprint_pairs": lambda: fingerprints.fingerprint_pairs(extreme), "capture_histories": lambda: warc.capture_histories(extreme, id_col="doc_id", url_col="text", payload_col="text"),
        "scores": lambda: lm_score.scores(extreme, RANKS, PATTERN), "url_filter": lambda: url_filter.url_filter(extreme, url_filter.listed(spark), id_col="doc_id", url_col="text"),
        "scored": lambda: quality.scored(extreme, labels), "exact_dedup": lambda: exact_dedup.exact_dedup(extreme), "encoded": lambda: sentencepieces.encoded(extreme, PIECES),
    }
    rows = run[name]().collect()
    if name == "pack":
        assert {(r.doc_id, r.piece) for r in rows if r.piece == 0} == {(d, 0) for d, _ in EXTREME}
        ends = {d: max(r.start + r.length for r in rows if r.doc_id == d) for d in (1, 2)}
        assert {r.sequence_id for r in rows if r.length == 1024}.isdisjoint(r.sequence_id for r in rows if r.length < 1024) and min(ends.values()) > 100_000
        return
    ids = "page_id" if name in ("capture_histories", "url_filter") else "doc_id"
    key = lambda x: (x is None, x or 0)
    assert sorted((r[ids] for r in rows), key=key) == sorted((d for d, _ in EXTREME), key=key)
    if name == "line_dedup":
        got = Counter((r.doc_id, r.text, r.n_removed, *(r[c] for c in CLASHES if c != "n_lines")) for r in rows)
        assert got == Counter((d, TEXTS[t] or "", 0, *(i for i, c in enumerate(CLASHES) if c != "n_lines")) for d, t in EXTREME)
    if name in ("near_duplicates", "similar_groups"):
        assert {r.component_id for r in rows if r.doc_id in (3, 4, LOW, HIGH)} == {LOW} and {r.component_id for r in rows if r.doc_id == 6} == {5}
    if name == "exact_dedup":
        assert {(r.keep_id, r.group_size, r.kept) for r in rows if r.doc_id == 6} == {(5, 4, False)} and sum(r.kept for r in rows) == 7
    if name == "capture_histories":
        assert Counter(r.payload_bytes for r in rows) == Counter(len((TEXTS[t] or "").encode()) for _, t in EXTREME) and {r.record_type for r in rows} == {"response"}


@pytest.mark.parametrize("stage", ["quality", "line_dedup", "near_dedup", "packing"])
def test_stage_on_extreme(spark, extreme, tmp_path, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(2, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = dict(pipeline.STAGES)[stage]
    got = run(spark, extreme, str(tmp_path))
    if stage == "packing":
        assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == {d for d, _ in EXTREME}
    else:
        assert got.schema.names == extreme.schema.names
        left = Counter((r.doc_id, r.text or "", *(r[c] for c in CLASHES)) for r in got.collect())
        whole = Counter((d, TEXTS[t] or "", *range(len(CLASHES))) for d, t in EXTREME)
        if stage == "quality":  # too few labels to learn from: every row has the same score
            assert left in (whole, Counter())
        elif stage == "line_dedup":
            assert left == whole
        else:  # 3, 4 and HIGH are like LOW, 6 is like 5; null ids stay
            assert left == Counter({k: n for k, n in whole.items() if k[0] not in (3, 4, 6, HIGH)})
    assert run(spark, extreme.limit(0), str(tmp_path)).isEmpty()


def test_twins_keep_their_lines(spark):
    """Of two texts with one id only the copied one loses its lines."""
    run = "\n".join(f"line {i} with some words in it" for i in range(12))
    unique = "\n".join(f"other {i} with some words in it" for i in range(12))
    got = line_dedup.line_dedup(spark.createDataFrame([(1, run), (2, run), (2, unique)], DOCS)).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, run), (2, ""), (2, unique)])


def test_cuts_too_many_to_broadcast(spark):
    run = "\n".join(f"line {i} with some words in it" for i in range(12))
    df = spark.createDataFrame([(i, run if i % 3 else f"own text {i}") for i in range(30)] + [(None, run)], DOCS)
    rows = lambda most: Counter(map(tuple, line_dedup.line_dedup(df, most=most).collect()))
    assert rows(3) == rows(1000) and sum(1 for r in rows(3) if r[3]) == 19


@pytest.mark.parametrize("least", [999, 1000])
def test_payloads_at_the_limit(spark, least):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "x" * least) for i in (1, 2, 3)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.capture_histories(pages).collect()}
    assert got == ({1: ("response", None), 2: ("response", None), 3: ("response", None)} if least < 1000 else {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None)})


def test_records_in_pieces():
    """Payloads that end in, begin with or hold blank lines survive the cutting at blank lines."""
    blocks = [b"", b"\r\n", b"\r\n\r\n", b"a\r\n\r\n\r\nb", b"\r\n\r\n\r\n", b"end\r\n"]
    whole = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks)
    reader, got = warc.Records(), []
    pieces = whole.split(b"\r\n\r\n")
    for piece in pieces if pieces[-1] else pieces[:-1]:
        got += [(at, block) for at, _, _, block in reader.feed(piece)]
    reader.close()
    assert [b for _, b in got] == blocks and all(whole[at:].startswith(b"WARC/1.1") for at, _ in got)
    cut = warc.Records()
    assert list(cut.feed(b"WARC/1.1\r\nContent-Length: 9")) == []
    with pytest.raises(ValueError):
        cut.close()


def test_url_is_percent_encoded(spark):
    pages = spark.createDataFrame([(1, "http://h/a b\tc\x7f", "x"), (2, "http://h/a%20b", "x")], "page_id long, url string, html string")
    assert {r.page_id: r.urlkey for r in warc.capture_histories(pages).collect()} == {1: "h)/a%20b%09c%7f", 2: "h)/a%20b"}


def test_grams_with_positions(spark):
    """What two texts share in window + k - 1 words, their grams share."""
    words = prose(4, 1, 400)[0].split() + [f"w{i}" for i in range(60)]
    shared = words[-20:-8]
    rows = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *shared, "y"]))], DOCS)
    a, b = (r.grams for r in fingerprints.winnowed(rows).orderBy("doc_id").collect())
    at = {g.hash: g.position for g in a}
    common = [g for g in b if g.hash in at]
    assert common and all(at[g.hash] == len(words) - 20 + g.position - 1 for g in common)
