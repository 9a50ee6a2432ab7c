"""Runs, clusters and token counts against brute force, with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op11_periodic_runs, op12_elkan, op13_token_counts
from tidemark.llm.queries import byte_bpe

SCHEMA = "doc_id long, text string, lang string, runs string, collapsed int, `doc.id` string, seed string, _loop int"


def rows_of(texts):
    return [(k, t, "en", "x", k, "y", "z", k) for k, t in enumerate(texts)]


def looped(words, i):
    h = zlib.crc32(str(i).encode())
    g = h // 10
    if i is None or h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def brute_runs(words, least=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        k = 0
        while k + q < len(words):
            end = k
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end + q - k >= max(least, repeats * q):
                found.setdefault((k, end + q), q)
            k = end + 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_digests(i, text):
    words = looped(re.findall(r"[^\x20\x09-\x0D]+", text or ""), i)
    runs = brute_runs(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (i, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def texts_with_runs():
    r = random.Random(11)
    texts = [None, "", " \t\n", "one", "a a a a a a", "a a a a a", "x  a\tb a\nb a b a b\x0b y", "a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb a\x1cb", "é 漢字 " * 9, "z" * 5000 + " ", "a b c " * 3000, " ".join(r.choice("ab") for _ in range(3000))]
    for _ in range(500):
        words = [r.choice("abcdefgh"[: r.choice((2, 3, 8))]) for _ in range(r.randint(0, 60))]
        if words and r.random() < 0.6:
            k, p = r.randrange(len(words)), r.randint(1, 8)
            words[k:] = (words[k : k + p] * 60)[: len(words) - k] + ["x"] * r.randint(0, 2) + words[:5]
        texts.append(r.choice((" ", "  ", "\r\n")).join(words))
    return texts


def test_runs(spark):
    rows = rows_of(texts_with_runs())
    docs = spark.createDataFrame([*rows, rows[6], (None, "b b b b b b b", None, None, None, None, None, None)], SCHEMA).repartition(3)
    got = op11_periodic_runs.run_digests(op11_periodic_runs.collapse_runs(docs, loop=op11_periodic_runs.planted()))
    assert Counter(map(tuple, got.collect())) == Counter(brute_digests(r.doc_id, r.text) for r in docs.collect())
    assert op11_periodic_runs.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_runs_as_they_come(spark):
    docs = spark.createDataFrame([(7, "go  a b a b a b a b a on", "s")], "`my.id` int, `a text` string, doc_id string")
    got = op11_periodic_runs.collapse_runs(docs, "my.id", "a text").collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(7, [(1, 9, 2)], "go a b on")]


@pytest.mark.parametrize(("least", "repeats"), [(2, 2), (6, 4), (3, 5), (9, 2)])
def test_main_lorentz_of_any_bounds(least, repeats):
    r = np.random.default_rng(least)
    assert op11_periodic_runs.least_overlap(6, 4) == 5
    for _ in range(200):
        ids = r.integers(0, r.integers(1, 4) + 1, r.integers(1, 50))
        n = len(ids)
        start, stop, period = op11_periodic_runs.main_lorentz(ids, np.zeros(n, int), np.full(n, n), least, repeats)
        assert list(zip(start.tolist(), (stop - start).tolist(), period.tolist(), strict=True)) == brute_runs(ids.tolist(), least, repeats)


def test_words_outside_repeated_grams_are_not_searched():
    ids = np.array([1, 2, 3, 4, 5, 9, 1, 2, 3, 4, 5, 8, 1, 2, 3, 4, 5])
    text = np.array([0] * 11 + [1] * 6)
    assert op11_periodic_runs.repeated_grams(ids, text, 5).tolist() == [True] * 5 + [False] + [True] * 5 + [False] * 6
    assert not op11_periodic_runs.repeated_grams(ids[:4], text[:4], 5).any()


VECTORS = "vec_id long, embedding array<double>, label int, vec string, cluster string, `up.per` int"


def vectors(n, size, seed, wide=()):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(k, [x + r.gauss(0, 0.2) for x in r.choice(centres)]) for k in range(n)]
    rows += [(n + k, rows[k % 7][1]) for k in range(40)]  # equal vectors, so ties and equal hashes of ids follow
    rows += [(3, rows[5][1]), (None, rows[9][1]), (n + 100, None), (n + 101, []), (n + 102, [1.0] * (size - 1)), (n + 103, [math.nan] * size), (n + 104, [math.inf] * size), (n + 105, [None] * size), (n + 106, [0.0] * size), (n + 107, [-1e-9] * size)]
    return [(i, v, 0, "v", "c", 1) for i, v in [*rows, *wide]]


def brute_clusters(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**50 else int(x) * 1024 for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (sha(f"3:{'null' if r[0] is None else r[0]}"), op12_elkan.as_bytes(np.array([r[1]], float) / 1024)))[:k]
    centroids = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    fits = lambda x: x if x < 2**63 else None
    return Counter((i, j, fits(d), None if any(x[1] >= 2**63 for x in last if x[2] == j) else fits(sum(x[1] for x in last if x[2] == j)), None if any(x[1] >= 2**63 for x in last) else fits(sum(x[1] for x in last)), sha(",".join(map(str, centroids[j])))) for i, d, j in last)


@pytest.mark.parametrize("wide", [(), [(9001, [1e5] * 6), (9002, [-2e8, 0.5, 0.0, 0.0, 0.0, 1.0]), (9003, [1e200, -1e200, 1.0, 2.0, 3.0, 4.0]), (9004, [2.0**17] * 6)]])
def test_clusters(spark, wide):
    rows = vectors(150, 6, 2, wide)
    got = op12_elkan.cluster_report(spark.createDataFrame(rows, VECTORS).repartition(3), k=8, rounds=5, size=6)
    assert Counter(map(tuple, got.collect())) == brute_clusters(rows, 8, 5, 6)


def test_few_vectors_and_none(spark):
    rows = vectors(9, 6, 4)[6:14]
    for some in (rows, rows[:1], []):
        got = op12_elkan.cluster_report(spark.createDataFrame(some, VECTORS), k=8, rounds=2, size=6).collect()
        assert Counter(map(tuple, got)) == brute_clusters(some, 8, 2, 6)


def test_bounds_skip_distances_and_keep_ties():
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.1, (300, 8)) for c in range(-4, 4)])
    x = op12_elkan.scaled(np.concatenate((x, np.repeat(x[:50], 3, axis=0))))
    cluster, upper, lower = np.zeros(len(x), int), np.full(len(x), np.inf), np.zeros((len(x), 8))
    now, before, done = x[::300][:8].tolist(), None, Counter()
    now[5] = now[2]  # two centroids in one place: the smaller number wins every time
    for step in range(6):
        c = op12_elkan.Centroids(now, before)
        cluster, upper, lower = op12_elkan.assign(x, c, cluster, upper, lower, done if step else None)
        d = ((x[:, None] - c.now[None]) ** 2).sum(-1)
        assert (cluster == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[np.arange(len(x)), cluster])).all() and (lower <= np.sqrt(d)).all()
        before, now = now, [(x[cluster == j].sum(0) // (cluster == j).sum()).tolist() if (cluster == j).any() else v for j, v in enumerate(now)]
    assert done["computed"] < done["all"] / 2


def test_digits():
    for v in (0, 5, -5, 1 << 40, -(1 << 40), 10**50, -(10**50) + 7, (1 << 80) - 1):
        assert sum(d << 40 * k for k, d in enumerate(op12_elkan.digits(v))) == v


def awkward_texts():
    r = random.Random(13)
    some = [" ", "  ", "\n", "\t", "a", "the", " the", "'s", "'ll", "1", "22", "é", "漢字", "🙂", ".", "!", "<|endoftext|>", "<|", " ", "　", "-", "\r", "\x1c", "\x85", "_", "ß"]
    return [None, "", " ", "z" * 3000, " " * 60, "the cat sat. " * 4000, *("".join(r.choice(some) for _ in range(r.randint(1, 40))) for _ in range(600))]


def library_counts(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(byte_bpe())
    t.no_truncation()
    t.no_padding()
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(spark):
    texts = [*awkward_texts(), "", "the"]
    rows = rows_of(texts)[:-2] + [(None, "", *[None] * 6), (5, "the", *[None] * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = op13_token_counts.TokenCounts(docs, byte_bpe()).counts(docs)
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, library_counts(texts), strict=True))
    assert Counter(map(tuple, got.collect())) == want
    none = spark.createDataFrame([], SCHEMA)
    empty = op13_token_counts.TokenCounts(none, byte_bpe())
    assert empty.counts(none).count() == 0 and Counter(map(tuple, empty.counts(docs).collect())) == want


def test_the_table_holds_every_frequent_pre_token(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["often", "too", f"w{r.randint(0, 4000)}"]) for _ in range(30)) for _ in range(400)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(20)
    words, bounds = op13_token_counts.frequent_pre_tokens(docs, [], most=16, fan=3)
    true = Counter(w.encode() for t in texts for w in re.findall(r" ?[a-z]+| ?\d+", t))
    assert len(words) <= 16 and {b" often", b" too"} <= set(words)
    assert all(0 < n <= true[w] for w, n in zip(words, bounds, strict=True))


def test_counters_fall_short_by_a_bounded_part():
    r = np.random.default_rng(2)
    words = pa.array([b"%d" % k for k in range(500)], pa.large_binary())
    n = r.integers(1, 1000, 500)
    some, left = op13_token_counts.cut(words, n, 20)
    lost = dict(zip(words.to_pylist(), n.tolist(), strict=True))
    assert len(some) <= 20 and all(0 <= lost[w] - m <= n.sum() / 21 for w, m in zip(some.to_pylist(), left.tolist(), strict=True))


def test_length_table():
    words = [b"", b"a", b"ab", b"12345678", b"123456789", b"x" * 100, *(b"w%d" % k for k in range(5000))]
    table = op13_token_counts.LengthTable(words, range(len(words)))
    assert table.get(pa.array([*words, b"b", b"w5000", b"x" * 99], pa.large_binary())).tolist() == [*range(len(words)), -1, -1, -1]
    table = op13_token_counts.LengthTable([], [])
    assert table.get(pa.array([b"", b"q"], pa.large_binary())).tolist() == [-1, -1]


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(op13_token_counts, "hashes", lambda data, at: np.full(len(at) - 1, 7, np.uint64))
    table = op13_token_counts.LengthTable([b"k", b"l", b"mm"], [1, 2, 3])
    assert table.get(pa.array([b"mm", b"l", b"x", b"k"], pa.large_binary())).tolist() == [3, 2, -1, 1]


def test_the_cache_is_let_go(spark, monkeypatch):
    monkeypatch.setattr(op13_token_counts, "CACHED", 5)
    texts = awkward_texts()
    counter = op13_token_counts.Counter(op13_token_counts.LengthTable([b"the"], [1]), byte_bpe())
    assert counter.counts(pa.array(texts, pa.string())).tolist() == library_counts(texts)


def test_sql_of_clusters_and_runs(spark):
    import os

    import duckdb

    from tidemark.llm import queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    for name in ("op11_periodic_runs", "op12_elkan"):
        got = queries.QUERIES[name](spark, folder)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        assert Counter(map(tuple, got.collect())) == Counter(want)
