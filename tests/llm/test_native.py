"""Sharding and mixing."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import mixing, sharding

ODD = [(1, None, "a", 1), (2, "", "a", 2), (None, "x", None, 3), (None, "x", None, 3), (5, "é" * 50_000, "b", 4), (5, "é" * 50_000, "b", 4), (6, "same", "b", 5), (7, "same", None, 6)]
ODD_SCHEMA = "doc_id bigint, text string, source string, shard int"


def plain_shards(rows):
    for r in rows:
        size = len((r.text or "").encode()) + 1
        yield r.doc_id, size, zlib.crc32((r.text or "").encode())


@pytest.mark.parametrize("which", ["corpus", "odd", "empty"])
def test_shards(spark, sf, which):
    df = spark.read.parquet(f"{sf}/documents.parquet") if which == "corpus" else spark.createDataFrame(ODD, ODD_SCHEMA)
    df = df.limit(0) if which == "empty" else df
    out = sharding.shard_rows(df).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(plain_shards(df.collect()), key=str)
    by_shard, by_key = defaultdict(list), defaultdict(set)
    for r in out:
        by_shard[r.shard].append(r.slot)
        by_key[r.doc_id].add((r.shard, r.grown_shard))
        assert r.law == "key" and 0 <= r.shard < 8 and r.grown_shard in (r.shard, 8)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and all(len(x) == 1 for x in by_key.values())


def plain_draw(key, node):
    """Minus the logarithm of a uniform number from the hash of key, seed and name, divided by the node's weight."""
    h = 42
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    h = xxhash.xxh64_intdigest(struct.pack("<i", sharding.SEED), h)
    h = xxhash.xxh64_intdigest(node.name.encode(), h)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / node.weight


def plain_shard(key, nodes):
    """One level after another: of the nodes with weight the one with the least draw."""
    best = min((n for n in nodes if n.weight > 0), key=lambda n: plain_draw(key, n))
    return best.shard if best.shard is not None else plain_shard(key, best.children)


@pytest.mark.parametrize("n", range(1, 21))
def test_the_descent_equals_a_plain_one(spark, n):
    keys = [None, -1, 0, 1 << 62, *range(100, 160)]
    df = spark.createDataFrame([(k, "x") for k in keys], "doc_id bigint, text string")
    got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_rows(df, n_shards=n).collect()}
    now, grown = sharding.tree(n), sharding.tree(n + 1)
    assert got == {k: (plain_shard(k, now.regions), plain_shard(k, grown.regions)) for k in keys}
    if n >= sharding.BASE:
        assert all(b in (a, n) for a, b in got.values())


def test_the_corpus_is_sharded_as_a_plain_descent_says(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    t8, t9 = sharding.tree(8), sharding.tree(9)
    for r in sharding.shard_rows(df).collect():
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, t8.regions), plain_shard(r.doc_id, t9.regions))


def test_weights_are_drawn_by(spark):
    leaf = lambda s, w: sharding.Node(f"shard{s}", w, (), s)
    some = sharding.Tree((sharding.Node("a", children=(leaf(0, 0.5), leaf(1, 0.0))), sharding.Node("b", children=(leaf(2, 3.0), leaf(3, 1.5)))))
    got = {r[0]: r[1] for r in spark.range(3000).select("id", sharding.shard_of(F.col("id"), some)).collect()}
    assert got == {k: plain_shard(k, some.regions) for k in range(3000)} and 1 not in got.values()


def test_shares_follow_weights(spark):
    n = 40_000
    got = Counter(r[0] for r in spark.range(n).select(sharding.shard_of(F.col("id"), sharding.tree(8))).collect())
    assert all(abs(got[s] - n / 8) < 5 * math.sqrt(n / 8) for s in range(8))
    moved = spark.range(n).where(sharding.shard_of(F.col("id"), sharding.tree(9)) == 8).count()
    assert abs(moved - n / 9) < 5 * math.sqrt(n / 9)


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    """A heavier shard takes rows; its own rack's and region's others only change by what comes and goes there."""
    leaf = lambda s, w=1.0: sharding.Node(f"shard{s}", w, (), s)

    def build(w):
        racks = lambda r, a, b: sharding.Node(f"rack{r}", children=(a, b))
        one = sharding.Node("region0", children=(racks(0, leaf(0), leaf(1)), racks(1, leaf(2), leaf(3))))
        two = sharding.Node("region1", children=(racks(2, leaf(4), leaf(5)), racks(3, leaf(6), leaf(7, w))))
        return sharding.Tree((one, two))

    k = F.col("id")
    pairs = Counter((r[0], r[1]) for r in spark.range(30_000).select(sharding.shard_of(k, build(1.0)), sharding.shard_of(k, build(3.0))).collect())
    for (a, b), _ in pairs.items():
        if a != b:
            # up the tree, rows enter region 1, then rack 3, then shard 7: never between subtrees without a change
            assert b >= 4 and not (a in (4, 5) and b in (4, 5)) and not (a == 7)
    assert not any(a != b and b < 4 for a, b in pairs)


def brute_mixture(rows, max_repeats=None, target_entropy=None):
    tok = defaultdict(int)
    for r in rows:
        tok[r.source] += len((r.text or "").split())
    total = sum(tok.values())
    p = {s: t / total for s, t in tok.items() if t}

    def at(a):
        w = {s: x**a for s, x in p.items()}
        z = sum(w.values())
        w = {s: x / z for s, x in w.items()}
        return w, -sum(x * math.log(x) for x in w.values()), max((max(p.values()) / x) ** (1 - a) for x in p.values())

    ok = lambda a: (target_entropy is None or at(a)[1] <= target_entropy) and (max_repeats is None or at(a)[2] <= max_repeats)
    low, high = 0.0, 1.0
    if ok(0.0):
        return 0.0, at(0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high, at(high)


@pytest.mark.parametrize("aim", [{"max_repeats": 2.0}, {"max_repeats": 1.0}, {"max_repeats": None, "target_entropy": 2.7}, {"max_repeats": None, "target_entropy": 9.0}])
def test_mixture_of_the_corpus(spark, sf, aim):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.select("doc_id", "text", "source").collect()
    exponent, (weights, _, _) = brute_mixture(rows, **aim)
    out = mixing.mix_documents(df, **aim).collect()
    tok = {r.doc_id: len((r.text or "").split()) for r in rows}
    source_tokens = Counter()
    for r in rows:
        source_tokens[r.source] += tok[r.doc_id]
    top = max(source_tokens.values())
    taken, epochs = Counter(), defaultdict(Counter)
    for r in out:
        assert r.n_tokens == tok[r.doc_id] and abs(r.weight - weights[r.source]) < 1e-6
        taken[r.source] += r.n_tokens
        epochs[r.source, r.epoch][r.doc_id] += 1
    assert {r.doc_id for r in out} == set(tok)
    for s, n in source_tokens.items():
        repeats = (top / n) ** (1 - exponent)
        budget, longest = repeats * n, max(tok[r.doc_id] for r in rows if r.source == s)
        assert budget - longest - 1 <= taken[s] <= budget + 1e-3 * n
        for e in range(math.floor(repeats + 1e-6)):
            assert set(epochs[s, e].values()) == {1} and len(epochs[s, e]) == sum(r.source == s for r in rows)


def test_last_passes_are_prefixes_of_their_permutation(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = mixing.mix_documents(df).toPandas()
    for (_, epoch), part in out.groupby(["source", "epoch"]):
        whole = out[(out.source == part.source.iloc[0]) & (out.epoch == 0)]
        if len(part) < len(whole):
            missing = whole[~whole.doc_id.isin(part.doc_id)]
            # every block before the border's is whole, every one behind it is out
            places = dict(zip(part.block, part.block_place))
            border = max(places.values())
            assert all(places[b] == border for b in missing.block if b in places)


def test_more_blocks_for_more_rows(spark, sf, monkeypatch):
    """Blocks follow the input; what is taken of each source stays within its budget."""
    assert [mixing.blocks_for(n) for n in (0, 1, 4096 << 16, (4096 << 16) + 1, 10**10)] == [4096, 4096, 4096, 8192, 262144]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(mixing, "BLOCKS", 1)
    taken = []
    for rows in (1 << 16, 4):
        monkeypatch.setattr(mixing, "BLOCK_ROWS", rows)
        out = mixing.mix_documents(df)
        taken.append({r.source: r.n for r in out.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()})
        assert out.where("epoch = 0").count() == df.count()
    longest = df.agg(F.max(mixing.n_tokens(F.col("text")))).first()[0]
    assert taken[0].keys() == taken[1].keys() and all(abs(taken[0][k] - taken[1][k]) <= longest + 1 for k in taken[0])


def test_odd_documents_are_mixed(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    out = mixing.mix_documents(df, max_repeats=2.0).collect()
    first = sorted(((r.doc_id, r.source, r.n_tokens) for r in out if r.epoch == 0), key=str)
    assert first == sorted(((d, s, len((t or "").split())) for d, t, s, _ in ODD), key=str)
    rows = mixing.mix_rows(df)
    assert rows.columns == df.columns and rows.distinct().count() == df.distinct().count()
    assert mixing.mix_documents(df.limit(0)).count() == 0 and mixing.mix_rows(df.limit(0)).count() == 0
    assert mixing.mix_documents(df.where("doc_id in (1, 2)")).count() == 2


def test_words_are_counted_by_ascii_blanks(spark):
    texts = ["a b", " a\n\tb ", "", None, "  ", "a　b c", "x\x0by\x1cz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.n_tokens(F.col("t"))).collect()] == [len((t or "").encode().split()) for t in texts]


def test_growing_keeps_what_was_announced(spark):
    """The shard with one more is the shard of the call with one more."""
    df = spark.range(4_000).selectExpr("id as doc_id", "'x' as text")
    calls = {n: {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_rows(df, n_shards=n).collect()} for n in (3, 4, 8, 9, 10)}
    for n in (3, 8, 9):
        assert {k: grown for k, (_, grown) in calls[n].items()} == {k: shard for k, (shard, _) in calls[n + 1].items()}
    assert all(b[0] in (a[0], 9) for a, b in ((calls[9][k], calls[10][k]) for k in calls[9])) and 0 < sum(b[0] == 9 for b in calls[10].values()) < 800
