"""Importance resampling, quality rules and vector codes against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import codes, quality, resampling

ODD = [
    (1, None, 1), (2, "", 2), (None, "x y", 3), (3, "the cat sat. " * 9, 4), (3, "the cat sat. " * 9, 4), (4, "Ünï 12 a-b É " * 40, 5), (5, "w" * 90_000, 6),
    (6, "one two three four\n" * 30_000, 7), (7, "\x00a\x7fb", 8), (8, " \t\r\n\x0b\x0c", 9), (-9, "$ # a | b " * 20, 10),
]
ODD_SCHEMA = "doc_id bigint, text string, score int"
TARGET = [("the cat sat on the mat. É 12",), (None,), ("",)]


# ---- resampling


def plain_words(text):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def plain_buckets(text):
    w = plain_words(text)
    return Counter(zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


def plain_resample(rows, target):
    raw, wanted = Counter(), Counter()
    for _, text in rows:
        raw += plain_buckets(text)
    for text in target:
        wanted += plain_buckets(text)
    n_raw, n_target = raw.total() + 10_000, wanted.total() + 10_000
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * n_raw / ((raw[b] + 1) * n_target))) for b in range(10_000)}
    out = []
    for key, text in rows:
        own = plain_buckets(text)
        weight = sum(gain[b] * n for b, n in own.items())
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, own.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(text)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_resampling_of_the_corpus(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = as_rows(resampling.resample(docs, target))
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert got == sorted(want, key=str) and sum(r[4] is not None for r in got) > 10


@pytest.mark.parametrize("times", [1, 20])
def test_resampling_of_odd_rows(spark, times):
    rows = [r for k in range(times) for r in ODD]
    got = as_rows(resampling.resample(spark.createDataFrame(rows, ODD_SCHEMA), spark.createDataFrame(TARGET, "text string")))
    want = sorted(plain_resample([r[:2] for r in rows], [t for (t,) in TARGET]), key=str)
    if times == 1:
        assert got == want
    else:  # equal rows share figures; which of them has which rank is open
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert sorted((r[4], r[3]) for r in got if r[4]) == sorted((r[4], r[3]) for r in want if r[4])


def test_resampling_of_nothing(spark):
    some, none = spark.createDataFrame(ODD, ODD_SCHEMA), spark.createDataFrame([], ODD_SCHEMA)
    assert resampling.resample(none, some).count() == 0
    assert as_rows(resampling.resample(some, none)) == sorted(plain_resample([r[:2] for r in ODD], []), key=str)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 19])
def test_tries_of_any_size_count_alike(block):
    texts = [r[1] for r in ODD if r[1] is None or len(r[1]) < 10_000] + ["a b", "b a b a b"]
    total, words = np.zeros(resampling.BUCKETS, np.int64), 0
    for trie, row in resampling.tries(pa.array(texts)[1:], block):
        total += trie.totals()
        words += len(trie.levels[0][0])
    want = Counter()
    for t in texts[1:]:
        want += plain_buckets(t)
    assert {int(b): int(total[b]) for b in np.flatnonzero(total)} == want and words == sum(len(plain_words(t)) for t in texts[1:])


def test_states_follow_from_the_parent_s():
    for n in (0, 1, 7, 300, 70_001):
        tail = bytes(range(256)) * (n // 256 + 1)
        assert resampling._image_of(resampling._shift(n), zlib.crc32(b"head")) ^ zlib.crc32(tail[:n]) == zlib.crc32(b"head" + tail[:n])


# ---- quality


def plain_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(runs)
    covered = {i + k for i, x in enumerate(runs) if often[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def plain_posterior(m, votes):
    good, bad = m[0], 1 - m[0]
    for j, v in enumerate(votes):
        good *= {"+": m[1][j], "-": 1 - m[1][j], "0": 1}[v]
        bad *= {"+": 1 - m[2][j], "-": m[2][j], "0": 1}[v]
    return good / (good + bad)


def plain_fit(counts, n):
    m = (quality.PRIOR, [quality.ON_GOOD] * n, [quality.ON_BAD] * n)
    hold = lambda x, within: min(max(x, within[0]), within[1])
    for _ in range(quality.STEPS):
        g = {v: plain_posterior(m, v) for v in counts}
        share = sum(counts[v] * g[v] for v in counts) / counts.total()
        new = (hold(share, (0.01, 0.99)), [], [])
        for j in range(n):
            for at, right, chance, first, within in ((1, "+", lambda v: g[v], quality.ON_GOOD, quality.WITHIN_GOOD), (2, "-", lambda v: 1 - g[v], quality.ON_BAD, quality.WITHIN_BAD)):
                of = sum(counts[v] * chance(v) for v in counts if v[j] != "0")
                hit = sum(counts[v] * chance(v) for v in counts if v[j] == right)
                new[at].append(hold(hit / of if of else first, within))
        m = new
    return m


@pytest.mark.parametrize("which", ["corpus", "odd", "empty"])
def test_quality(spark, sf, which):
    df = spark.read.parquet(f"{sf}/documents.parquet") if which == "corpus" else spark.createDataFrame(ODD, ODD_SCHEMA)
    df = df.limit(0) if which == "empty" else df
    out = quality.judge(df).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out), key=str)
    assert got == sorted(((r.doc_id, *plain_measures(r.text)) for r in df.collect()), key=str)
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    counts = Counter(r.votes for r in out if not r.base_failed)
    if counts:
        m = plain_fit(counts, len(quality.RULES))
        for r in out:
            assert math.isclose(r.quality, plain_posterior(m, r.votes), abs_tol=2e-6)
            assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_quality_agrees_with_labels(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("good"))
    out = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").where("not base_failed")
    n = {(r.kept, r.good): r["count"] for r in out.groupBy("kept", "good").count().collect()}
    assert n[True, 1] > 100 and n[False, 0] > 10
    assert n.get((False, 1), 0) <= 0.01 * n[True, 1] and n.get((True, 0), 0) <= 0.1 * n[False, 0]


# ---- codes


def plain_codes(rows):
    """``rows``: (key, vector, label). Full distances in every round."""
    rows = [(k, v, c) for k, v, c in rows if v is not None and all(x is not None and math.isfinite(x) and abs(x) < codes.LIMIT for x in v)]
    if not rows:
        return {}, None
    q = [(k, [math.floor(4096 * x) for x in v], c) for k, v, c in rows]
    q.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    dims = len(q[0][1])
    q = [r for r in q if len(r[1]) == dims]
    width = -(-dims // 8)
    cut = [[(r[1] + [0] * (8 * width - dims))[p * width : (p + 1) * width] for p in range(8)] for r in q]
    books = [[x[p] for x in cut[:16]] for p in range(8)]

    def nearest(part, book):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(6):
        for p in range(8):
            of = [nearest(x[p], books[p])[0] for x in cut]
            for e in range(len(books[p])):
                mine = [x[p] for x, k in zip(cut, of) if k == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    out, errors = [], Counter()
    for (key, _, label), x in zip(q, cut):
        found = [nearest(x[p], books[p]) for p in range(8)]
        error = sum(d for _, d in found)
        errors[label] += error
        out.append((key, "".join(f"{k:02x}" for k, _ in found), error, label))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((k, code, e, errors[label], digest) for k, code, e, label in out), key=str)


def vectors(kind):
    rng = np.random.default_rng(7)
    if kind == "ties":  # few values, so distances tie often
        return [(i, [float(x) / 4096 for x in rng.integers(-1, 2, 16)], int(i) % 3 if i % 5 else None) for i in range(300)]
    if kind == "odd":
        nan, inf = float("nan"), float("inf")
        good = [(i, [float(x) for x in rng.normal(size=10)], 0) for i in range(40)]
        return good + [(None, [0.5] * 10, None), (3, [0.25] * 10, 1), (3, [0.25] * 10, 1), (50, None, 0), (51, [nan] * 10, 0), (52, [inf] + [0.0] * 9, 0), (53, [None] + [0.0] * 9, 0), (54, [1.0] * 9, 0), (55, [0.0] * 10, 2), (56, [1e9] * 10, 2)]
    if kind == "few":
        return [(i, [float(x) for x in rng.normal(size=8)], None) for i in range(5)]
    return []


@pytest.mark.parametrize("kind", ["ties", "odd", "few", "none"])
def test_codes(spark, kind):
    df = spark.createDataFrame([(k, v, c, "x") for k, v, c in vectors(kind)], "vec_id bigint, embedding array<double>, label int, error string")
    got = as_rows(codes.encode_vectors(df))
    want = plain_codes(vectors(kind))
    assert got == want if kind != "none" else got == []


def test_codes_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert as_rows(codes.encode_vectors(df)) == plain_codes([(r.vec_id, list(r.embedding), r.label) for r in df.collect()])


def test_few_labels_and_many_are_joined_alike(spark, monkeypatch):
    df = spark.createDataFrame(vectors("ties"), "vec_id bigint, embedding array<double>, label int")
    monkeypatch.setattr(codes, "FEW_LABELS", 1)
    assert as_rows(codes.encode_vectors(df)) == plain_codes(vectors("ties"))


def test_bounds_spare_distances_and_change_no_assignment():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(16, 8, 8)) * 4096
    x = np.floor(middles[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 8, 8)) * 300).astype(np.int64)
    entries = np.ascontiguousarray(x[:16].transpose(1, 0, 2))
    books = codes.Codebooks(entries, np.zeros((8, 16)), 2.0)
    now, measured = codes.first_bounds(x, books), []
    for _ in range(6):
        new = entries.copy()
        for p in range(8):
            for e in range(16):
                mine = x[now.own[:, p] == e, p]
                new[p, e] = mine.sum(axis=0) // len(mine) if len(mine) else entries[p, e]
        books = codes.Codebooks(new, codes._up(codes._squares(new, entries)), 2.0)
        entries = new
        stored = pa.RecordBatch.from_arrays(now.columns(books.unit), ["own", "upper", "lower"])
        now = codes.next_bounds(x, codes.Bounds.read(stored, 16, books.unit), books)
        full = codes.first_bounds(x, books)
        assert (now.own == full.own).all() and (now.upper >= full.upper - 1e-6).all() and (now.lower <= full.lower * (1 + 1e-9) + 1e-6).all()
        measured.append(now.measured)
    assert measured[-1] < 0.2 * x.shape[0] * 8 * 16
