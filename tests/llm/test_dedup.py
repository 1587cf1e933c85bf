"""SimHash and embedding near-duplicates against brute force."""

import numpy as np
import pytest
import xxhash

from tagloom.llm import components, embed_dedup, simhash


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_follow_their_definition(sf):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' order by length(text) limit 200").fetchall()]
    for t in [*texts, None, "", " \t\n", "A", "a b", "A b\x1cC d e f", "\x85 x y z"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_shingles_in_blocks_count_alike(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_linked_fingerprints_have_a_chain_and_meet_where_it_begins(spark, distance):
    """Pigeonring: some chain keeps the budgets of one, two and three segments; far pairs are mostly pruned by them."""
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    differ = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, distance + 1), replace=False)) for _ in base], np.uint64)
    chains = np.array([simhash._chained(differ, i, distance) for i in range(4)])
    assert chains.any(axis=0).all()
    budgets = [distance * k // 4 for k in (1, 2, 3)]
    for d, own in zip(differ.tolist(), chains.T):
        for i in range(4):
            bits = [(d >> 16 * ((i + k) % 4) & 0xFFFF).bit_count() for k in range(3)]
            assert own[i] == all(sum(bits[: k + 1]) <= budgets[k] for k in range(3))
    spread = np.array([sum(1 << int(b) for b in rng.choice(64, 4 + distance, replace=False)) for _ in range(400)], np.uint64)
    assert np.mean([simhash._chained(spread, i, distance) for i in range(4)]) < 0.2
    fps = sorted(set(base.tolist()) | set((base ^ differ).tolist()))
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp bigint, node bigint")
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes, distance)).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance])
    assert [got.get(i, i) for i in range(len(fps))] == want


@pytest.mark.parametrize("block", [2048, 8])
def test_links_reach_what_brute_force_reaches(spark, block):
    """Random fingerprints with planted neighbours of 1 to 4 bits, and a dense cloud around one of them."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 150, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:60].tolist():
        for _ in range(3):
            y = x
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                y ^= 1 << int(bit)
            fps.add(y)
    for _ in range(150):
        y = int(base[0])
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            y ^= 1 << int(bit)
        fps.add(y)
    fps = sorted(fps | {0, (1 << 64) - 1})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    want = roots(len(fps), pairs)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp bigint, node bigint").repartition(5)
    got = {r.node: r.component for r in components.connected_components(simhash.links(nodes, block=block)).collect()}
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_documents_of_the_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    ids = [r.doc_id for r in rows]
    x = np.array(fps, np.uint64)
    close = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    want = roots(len(x), zip(*np.nonzero(close)))
    least = {}
    for i, r in zip(ids, want):
        least[r] = min(i, least.get(r, i))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", least[r]) for i, f, r in zip(ids, fps, want)}


def test_odd_documents(spark):
    schema = "text string, fp bigint, doc_id bigint, node string, key int"
    rows = [(None, 1, 5, "a", 1), ("", 2, 3, None, 2), ("one", 3, 7, "b", 3), ("one", 3, 7, "b", 3), ("One", 4, 9, "c", 4), (None, 1, None, None, 5), ("w " * 50_000, 5, 11, None, 6), ("lonely text without identifier", 6, None, None, 7)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [("11", 11), ("3", 3), ("5", 3), ("7", 7), ("7", 7), ("9", 7), ("None", 3), ("None", None)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["11", "3", "7", "None"]
    none = df.limit(0)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (301, 300), (300, 301), (None, 4)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert components.connected_components(df.limit(0)).count() == 0


def brute(rows, cosine):
    unit = [embed_dedup.unit(e) for _, e in rows]
    n, pairs = [0] * len(rows), []
    for i, a in enumerate(unit):
        for j, b in enumerate(unit):
            if i != j and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                n[i] += 1
                pairs.append((i, j))
    return n, pairs


@pytest.mark.parametrize("block", [2048, 16])
def test_embeddings_of_the_corpus(spark, sf, block):
    """The table has no links: none is found. Tests below have some."""
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()]
    x = np.array([embed_dedup.unit(e) for _, e in rows])
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df, block=block).collect()}
    assert len(got) == len(rows) and not close.any()
    assert all(r.n_links == 0 and r.kept and r.component_id == i for i, r in got.items())


def normed(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def turned(rng, x, other, low, high):
    """Each vector turned towards another one to a cosine between ``low`` and ``high``."""
    side = other - x
    side = normed(side - (side * x).sum(1, keepdims=True) * x)
    cos = rng.uniform(low, high, size=(len(x), 1))
    return cos * x + np.sqrt(1 - cos**2) * side


@pytest.mark.parametrize(
    "dims,mean_cosine,clusters,short",
    [(64, 0.0, 0, True), (64, 0.5, 0, True), (64, 0.7, 40, False), (64, 0.8, 0, True), (32, 0.5, 40, True), (256, 0.7, 40, True), (768, 0.5, 10, True), (32, 0.9, 0, False)],
)
def test_recall_on_clouds_with_links(spark, dims, mean_cosine, clusters, short):
    """near_vectors itself against brute force: round and narrow clouds, clusters and copies; pairs just over the threshold."""
    rng = np.random.default_rng(dims)
    axis = np.zeros(dims)
    axis[0] = np.sqrt(mean_cosine)
    cloud = lambda n: normed(axis + np.sqrt(1 - mean_cosine) * normed(rng.normal(size=(n, dims))))
    base = cloud(1600)
    pairs = turned(rng, base[:400], base[400:800], 0.9501, 0.96)
    parts = [base, pairs, base[:50]]
    if clusters:
        parts.append(normed(np.repeat(cloud(clusters), 15, axis=0) + rng.normal(size=(clusters * 15, dims)) * 0.1 / np.sqrt(dims)))
    x = np.concatenate(parts)
    x = normed(x.astype(np.float32).astype(np.float64)) if short else x
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32) if short else x)]
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{'float' if short else 'double'}>")
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    n = close.sum(1)
    assert n[1600:2000].min() >= 1
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    print(dims, mean_cosine, "recall", found.sum() / n.sum(), "of pairs just over the threshold", found[1600:2000].sum() / n[1600:2000].sum())
    assert (found <= n).all() and found.sum() >= 0.9 * n.sum() and found[1600:2000].sum() >= 0.9 * n[1600:2000].sum()


def test_vectors_of_many_lengths(spark):
    """Each length has an index of its own, a rare one none; unlike lengths never link."""
    rng = np.random.default_rng(8)
    rows = []
    for d, n in ((16, 900), (24, 700), (40, 12)):
        base = normed(rng.normal(size=(n, d)))
        near = normed(base[: n // 3] + rng.normal(size=(n // 3, d)) * 0.05 / np.sqrt(d))
        rows += [v.tolist() for v in np.concatenate([base, near])]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id bigint, embedding array<double>")
    n, pairs = [0] * len(rows), []
    for d in (16, 24, 40):
        at = [i for i, v in enumerate(rows) if len(v) == d]
        x = np.array([rows[i] for i in at])
        close = x @ x.T >= 0.95
        np.fill_diagonal(close, False)
        for i, c in zip(at, close):
            n[i] = int(c.sum())
        pairs += [(at[i], at[j]) for i, j in zip(*np.nonzero(close))]
    got = {r.vec_id: r for r in embed_dedup.near_vectors(df).collect()}
    assert all(got[i].n_links <= n[i] for i in got) and sum(r.n_links for r in got.values()) >= 0.98 * sum(n) > 0
    want = roots(len(rows), pairs)
    assert sum(got[i].component_id == want[i] for i in got) >= 0.98 * len(rows)


def test_lists_in_blocks_find_the_same(spark):
    """Long lists cut into pairs of blocks: each link is counted once, whatever the blocks."""
    rng = np.random.default_rng(5)
    centers = normed(rng.normal(size=(3, 48)))
    x = np.concatenate([normed(np.repeat(centers, 150, axis=0) + rng.normal(size=(450, 48)) * 0.03), normed(rng.normal(size=(600, 48)))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    runs = [{r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df, block=b).collect()} for b in (2048, 40)]
    assert runs[0] == runs[1]
    found = np.array([runs[0][i][0] for i in range(len(x))])
    assert (found <= close.sum(1)).all() and found.sum() >= 0.97 * close.sum() > 10_000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vecs = [[1.0, 0.0], [2.0, 0.0], [1.0, 0.0], [0.0, 1.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [1.0, 0.0, 0.0], [1e200, 1e199], [-1.0, 0.0]]
    rows = [(i, v, "x", 1) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, node string, n int")
    n, pairs = brute([(r[0], r[1]) for r in rows], 0.95)
    want = roots(len(rows), pairs)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_vectors(df).collect()}
    assert got == {i: (n[i], want[i], want[i] == i) for i in range(len(rows))}
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_pivots_stand_apart():
    rng = np.random.default_rng(0)
    points = np.repeat(rng.normal(size=(40, 16)), 50, axis=0) + rng.normal(size=(2000, 16)) * 0.01
    points /= np.linalg.norm(points, axis=1)[:, None]
    kept, places = embed_dedup._apart(points, 64)
    assert (kept == points[places]).all()
    cos = kept @ kept.T - np.eye(len(kept))
    assert 32 <= len(kept) <= 40 and cos.max() < 0.95


def test_many_near_copies_are_counted_once(spark):
    rng = np.random.default_rng(2)
    center = rng.normal(size=32)
    vecs = [center + rng.normal(size=32) * 0.05 for _ in range(120)] + [rng.normal(size=32) for _ in range(400)]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    n, _ = brute(rows, 0.95)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df, block=32).collect()}
    assert sum(got.values()) >= 0.97 * sum(n) and all(got[i] <= n[i] for i in got)


def test_links_near_the_threshold_are_found(spark):
    """near_vectors itself, on 4,000 vectors of 64 dimensions: pairs planted at cosines of 0.95 to 0.97, and clusters."""
    rng = np.random.default_rng(7)
    normed = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    a = normed(rng.normal(size=(600, 64)))
    side = rng.normal(size=a.shape)
    side = normed(side - (side * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.9501, 0.97, size=(600, 1))
    b = cos * a + np.sqrt(1 - cos**2) * side
    centers = normed(rng.normal(size=(40, 64)))
    clusters = normed(np.repeat(centers, 20, axis=0) + rng.normal(size=(800, 64)) * 0.026)
    x = np.concatenate([a, b, clusters, normed(rng.normal(size=(2000, 64)))])
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(x, rng.uniform(0.5, 2, len(x))))]
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    n = close.sum(1)
    assert n[:1200].min() >= 1 and n[1200:2000].sum() > 10_000
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    print("recall of pairs", found[:1200].sum(), n[:1200].sum(), "of clusters", found[1200:2000].sum(), n[1200:2000].sum())
    assert (found <= n).all()
    assert found[:1200].sum() >= 0.9 * n[:1200].sum() and found[1200:].sum() >= 0.9 * n[1200:].sum()


def test_links_among_vectors_of_the_table(spark, sf):
    """The table's vectors with scaled and slightly turned copies of themselves, which the table alone has none of."""
    rng = np.random.default_rng(9)
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    more = [(10_000 + k, 3.5 * v) for k, v in rows[:60]]
    for k, v in rows[60:260]:
        side = rng.normal(size=len(v))
        side -= side @ v / (v @ v) * v
        cos = rng.uniform(0.952, 0.99)
        more.append((20_000 + k, cos * v / np.linalg.norm(v) + np.sqrt(1 - cos * cos) * side / np.linalg.norm(side)))
    ids, x = zip(*(rows + more))
    unit = np.array(x) / np.linalg.norm(x, axis=1)[:, None]
    want = {(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95)) if a < b}
    df = spark.createDataFrame([(int(i), [float(y) for y in v]) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
    ends = sum(n for n, _ in got.values())
    assert len(want) >= 260 and 0.9 * 2 * len(want) <= ends <= 2 * len(want)
    found = sum(got[ids[a]][1] == got[ids[b]][1] for a, b in want)
    assert found >= 0.95 * len(want)
