"""Embedding near-duplicates through a pivot-permutation index.

Vectors are described by their nearest reference points in order. Inverted lists of points are searched with identifiers
and descriptions only; vectors travel to the lists where they share enough points with another one, to be verified there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import arrow_groups, least_hashes, settle, unsettle
from .components import connected_components

COSINE = 0.95
PIVOTS = 1024  # at least; their number follows the square root of the vectors', up to what POINT_VALUES allows
POINT_VALUES = 1 << 22  # numbers of all reference points: what is broadcast is bounded by it
NEAREST = (6, 8, 10, 12, 16, 20, 24, 32, 48)
FIRST = 3  # nearest points, of which one of two candidates has one among the other's
LEAST_RECALL = 0.93  # of them; where no description finds as many, the cloud is too narrow for one
RECALL = 0.97  # of sampled pairs at the threshold, that the description's length is chosen for
BLOCK = 2048  # vectors of an inverted list that one group holds
SHORT = 48  # vectors of lists that are looked at many at once
TILE = 1 << 22  # compared values at once
BROADCAST_KEYS = 20_000
APART = (0.6, 0.7, 0.8, 0.9, 0.95)
SEED = 3
ALONE = 1 << 39  # marks the list in which all vectors of a dimension without a description meet


def units(vectors: pa.Array) -> list[np.ndarray | None]:
    """Each vector at length 1 in doubles; None for null, zero, empty, and null or non-finite components."""
    out: list[np.ndarray | None] = [None] * len(vectors)
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    valid = vectors.is_valid().to_numpy(zero_copy_only=False)
    offsets = vectors.offsets.to_numpy()
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    sizes = np.where(valid, np.diff(offsets), 0)
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        x = values[offsets[at][:, None] + np.arange(d)]
        top = np.abs(x).max(axis=1)
        good = np.isfinite(x).all(axis=1) & (top > 0)
        x = x[good] / top[good, None]  # lengths neither overflow nor vanish
        x = x / np.sqrt((x * x).sum(axis=1))[:, None]
        for i, u in zip(at[good], x):
            out[i] = u
    return out


def unit(values) -> np.ndarray | None:
    """``units`` of one vector."""
    return units(pa.array([None if values is None else list(values)], pa.list_(pa.float64())))[0]


def _digest(u: np.ndarray) -> bytes:
    return hashlib.blake2b(u.tobytes(), digest_size=16).digest()


def _vectors(df: DataFrame, vec_id: str, embedding: str, whole: bool) -> DataFrame:
    """``id, digest`` of each row, and with ``whole`` its vector's own values; null where it links with nothing.

    The digest is that of the unit vector; values travel in the type that the column has, as floats or doubles.
    """
    slim = df.select(F.col(f"`{vec_id}`").alias("id"), F.col(f"`{embedding}`").alias("e"))
    kind = slim.schema["id"].dataType.simpleString()
    short = slim.schema["e"].dataType.elementType.simpleString() == "float"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = units(b.column("e"))
            digests = pa.array([None if u is None else _digest(u) for u in found], pa.binary())
            if not whole:
                yield pa.RecordBatch.from_arrays([b.column("id"), digests], ["id", "digest"])
                continue
            values = b.column("e").values.cast(pa.float32() if short else pa.float64()).to_numpy(zero_copy_only=False)
            offsets = b.column("e").offsets.to_numpy()
            raw = [None if u is None else values[a:z].tobytes() for u, a, z in zip(found, offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("id"), digests, pa.array(raw, pa.binary())], ["id", "digest", "vec"])

    return slim.mapInArrow(run, f"id {kind}, digest binary" + ", vec binary" * whole)


def _matrix(raw: list[bytes], short: bool) -> np.ndarray:
    """Unit vectors, all of one length, from their own values: the same doubles as ``units`` makes."""
    x = np.frombuffer(b"".join(raw), "<f4" if short else "<f8").reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


@dataclass
class Index:
    """Reference points of a dimension, the centre that vectors are seen from, and how descriptions are used.

    ``nearest`` points describe a vector; two are candidates if they share ``shared`` of them and if one of the first three
    points of one is among the other's. Points are numbered from the rarest to the most frequent one of the sample's descriptions.
    """

    points: np.ndarray
    centre: np.ndarray
    nearest: int
    shared: int

    @property
    def prefix(self) -> int:
        """So many of a description's rarest points hold the two rarest of any ``shared`` that it has in common."""
        return self.nearest - self.shared + 2

    def describe(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the nearest points of unit vectors, nearest first."""
        return _nearest(x - self.centre, self.points, self.nearest)


def _nearest(x: np.ndarray, points: np.ndarray, k: int) -> np.ndarray:
    cos = x @ points.T
    top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(cos, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def fit_index(sample: np.ndarray, n: int, cosine: float = COSINE, pivots: int = PIVOTS, recall: float = RECALL) -> Index | None:
    """The index of one dimension's ``n`` vectors from a bounded sample of them; None if it is too small or too alike.

    Vectors are seen from the sample's mean, without which points near it would be nearest to all. Reference points stand
    apart from each other. Descriptions have the length, and candidates the number of shared points, that find ``recall``
    of test pairs (sampled vectors, and each turned by exactly the threshold's angle towards another one) while moving the
    fewest bytes: a post for each list, and vectors for each candidate that unlike pairs of the sample let expect. Clouds
    so narrow that none of them finds ``LEAST_RECALL`` (a constant share of all pairs are links there) have no index.
    """
    if len(sample) < 4:
        return None
    centre = sample.mean(axis=0)
    moved = sample - centre
    far = np.sqrt((moved * moved).sum(axis=1))
    if far.max() < 1e-6:
        return None
    points, taken = _apart(moved[far > 1e-9] / far[far > 1e-9, None], pivots)
    if len(points) < 2 * NEAREST[0]:
        return None
    rest = np.delete(sample[far > 1e-9], taken, axis=0)[:1024]
    rest = rest if len(rest) >= 64 else sample[:1024]
    side = np.roll(rest, 1, axis=0) - rest
    side -= (side * rest).sum(axis=1)[:, None] * rest
    size = np.sqrt((side * side).sum(axis=1))
    ok = size > 1e-6
    if not ok.any():
        return None
    partner = cosine * rest[ok] + np.sqrt(1 - cosine * cosine) * side[ok] / size[ok, None]
    unlike = np.triu(rest @ rest.T < cosine, 1)
    best = None
    for k in NEAREST:
        if k > len(points) // 2:
            break
        a, b = _nearest(rest[ok] - centre, points, k), _nearest(partner - centre, points, k)
        common, ordered = _agreement(a, b)
        own = _nearest(rest - centre, points, k)
        has = np.zeros((len(rest), len(points)), np.float32)
        has[np.arange(len(rest))[:, None], own] = 1
        first = has[:, own[:, :FIRST]].any(axis=2)
        met = np.bincount((has @ has.T)[unlike & (first | first.T)].astype(np.int64), minlength=k + 1)
        for s in range(2, k // 2 + 2):
            found = float(((common >= s) & ordered).mean())
            lists = comb(k - s + 2, 2)
            strangers = n * (met[s:].sum() + 1) / (unlike.sum() + 1)
            cost = lists * (16 + 2 * k) + min(lists, strangers) * 8 * points.shape[1]
            rank = (found < recall, cost if found >= recall else -found)
            if best is None or rank < best[0]:
                best = (rank, k, s)
    if best is None or -best[0][1] < LEAST_RECALL and best[0][0]:
        return None
    _, k, s = best
    heard = np.bincount(_nearest(moved[far > 1e-9], points, k).ravel(), minlength=len(points))
    return Index(points[np.argsort(heard, kind="stable")], centre, k, s)


def _agreement(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many points pairs of ordered descriptions share, and whether one's first ones are among the other's."""
    same = a[:, :, None] == b[:, None, :]
    return same.sum(axis=(1, 2)), same[:, :FIRST].any(axis=(1, 2)) | same[:, :, :FIRST].any(axis=(1, 2))


def _apart(points: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray]:
    """Points of which none is near another, and their places: copies of one vector would take each other's places.

    The least cosine that leaves half of the asked number is the limit, or the last.
    """
    taken = np.zeros(0, np.int64)
    for limit in APART:
        kept: list[int] = []
        for a in range(0, len(points), 256):
            part = np.arange(a, min(a + 256, len(points)))
            if kept:
                part = part[(points[part] @ points[kept].T).max(axis=1) < limit]
            near = points[part] @ points[part].T >= limit
            own: list[int] = []
            for i in range(len(part)):
                if not near[i, own].any():
                    own.append(i)
            kept += part[own].tolist()
            if len(kept) >= pivots:
                break
        taken = np.array(kept[:pivots])
        if 2 * len(taken) >= min(pivots, len(points)):
            break
    return points[taken], taken


def fit_indices(nodes: DataFrame, short: bool, cosine: float = COSINE, pivots: int = PIVOTS) -> dict[int, Index]:
    """Indices by dimension, each from the vectors with the least hashes, four for each reference point.

    Sampled are the dimensions that hold a 64th of all vectors or more; they share ``POINT_VALUES``, so that all indices
    together stay as large as one. Vectors of a dimension without an index meet in one list, by blocks, which is exact and
    quadratic.
    """
    width = 4 if short else 8
    dims = nodes.groupBy((F.octet_length("vec") / width).cast("int").alias("d")).agg(F.count("*").alias("n"))
    total = dims.agg(F.sum("n")).first()[0] or 0
    out = {}
    common = dims.where(F.col("n") * 64 >= total).collect()
    for r in common:
        wanted = max(pivots, 1 << (int(r["n"] ** 0.5)).bit_length())
        wanted = max(64, min(wanted, POINT_VALUES // (r["d"] * len(common)), 1 << 15))
        rows = nodes.where(F.octet_length("vec") == r["d"] * width).select("vec")
        sample = least_hashes(rows, ["vec"], 4 * wanted, SEED, r["n"]).collect()
        index = fit_index(_matrix([bytes(x["vec"]) for x in sample], short), r["n"], cosine, wanted)
        if index is not None:
            out[r["d"]] = index
    return out


def describe(nodes: DataFrame, indices: dict[int, Index], short: bool) -> DataFrame:
    """``nodes`` with ``dim, near``: the nearest reference points in order, as 16-bit numbers; none without an index."""
    shared = nodes.sparkSession.sparkContext.broadcast(indices)
    width = 4 if short else 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs = b.column("vec").to_pylist()
            near: list[bytes] = [b""] * len(vecs)
            dims = np.array([len(v) // width for v in vecs], np.int32)
            for d in np.unique(dims):
                if int(d) in shared.value:
                    at = np.flatnonzero(dims == d)
                    for i, row in zip(at, shared.value[int(d)].describe(_matrix([vecs[i] for i in at], short)).astype("<u2")):
                        near[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dims), pa.array(near, pa.binary())], [*b.schema.names, "dim", "near"])

    nodes = nodes.select("digest", "node", "copies", "vec")
    return nodes.mapInArrow(run, "digest binary, node bigint, copies bigint, vec binary, dim int, near binary")


def _posts(described: DataFrame, prefixes: dict[int, int], whole: bool) -> DataFrame:
    """``key`` (and with ``whole`` also ``node, near``) of the inverted lists that vectors stand in.

    A list is of two points. A vector stands in those of its rarest points, as many as ``Index.prefix`` says: whatever
    shares enough points with it meets it in the list of the two rarest that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                own = b.take(pa.array(at))
                base = np.int64(d) << 40
                if int(d) not in prefixes:
                    keys, places = np.full(len(at), base | ALONE), np.arange(len(at))
                else:
                    near = np.frombuffer(b"".join(own.column("near").to_pylist()), "<u2").reshape(len(at), -1).astype(np.int64)
                    near = np.sort(near, axis=1)[:, : prefixes[int(d)]]
                    x, y = np.triu_indices(near.shape[1], 1)
                    keys = (base | near[:, x] << 16 | near[:, y]).ravel()
                    places = np.repeat(np.arange(len(at)), len(x))
                made = [pa.array(keys, pa.int64())]
                if whole:
                    places = pa.array(places)
                    made += [own.column("node").take(places), own.column("near").take(places)]
                yield pa.RecordBatch.from_arrays(made, ["key", "node", "near"] if whole else ["key"])

    return described.mapInArrow(run, "key bigint, node bigint, near binary" if whole else "key bigint")


def _long_list(key: int, left: int, right: int, block: np.ndarray, near: np.ndarray, shared: int) -> np.ndarray:
    """Which members of a list of many have a candidate in it, by counts of shared points as products of matrices.

    A pair is looked at in the list of the two rarest points that it shares.
    """
    n, q = len(near), key & 0xFFFF
    points, where = np.unique(near, return_inverse=True)
    where = where.reshape(near.shape)
    has = np.zeros((n, len(points)), np.float32)
    has[np.arange(n)[:, None], where] = 1
    lead = np.zeros_like(has)
    lead[np.arange(n)[:, None], where[:, :FIRST]] = 1
    low = has[:, points < q]
    out = np.zeros(n, bool)
    for a in range(0, n, 512):
        rows = slice(a, a + 512)
        ordered = (lead[rows] @ has.T > 0) | (has[rows] @ lead.T > 0)
        pair = (has[rows] @ has.T >= shared) & (low[rows] @ low.T == 1) & ordered
        if left != right:
            pair &= (block[rows] == left)[:, None] != (block == left)[None, :]
        pair[np.arange(pair.shape[0]), a + np.arange(pair.shape[0])] = False
        out[rows] |= pair.any(axis=1)
    return out


def _short_lists(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, near: np.ndarray, shared: int) -> np.ndarray:
    """The same for many short lists, those of one length together."""
    k = near.shape[1]
    out = np.zeros(len(keys), bool)
    for n in np.unique(sizes):
        x, y = np.triu_indices(n, 1)
        own = starts[sizes == n]
        step = max(1, TILE // (len(x) * k * k))
        for a in range(0, len(own), step):
            i = (own[a : a + step, None] + x).ravel()
            j = (own[a : a + step, None] + y).ravel()
            same = near[i][:, :, None] == near[j][:, None, :]
            common = same.any(axis=2)
            low = (common & (near[i] < (keys[i] & 0xFFFF)[:, None])).sum(axis=1)
            pair = (common.sum(axis=1) >= shared) & (low == 1) & (common[:, :FIRST].any(axis=1) | same[:, :, :FIRST].any(axis=(1, 2)))
            out[i[pair]] = True
            out[j[pair]] = True
    return out


def search(described: DataFrame, indices: dict[int, Index], block: int = BLOCK) -> DataFrame:
    """``key, pair, n_cuts, node``: the lists in which vectors have candidates. Only identifiers and points are shuffled.

    No list is cut short: long ones are split into blocks whose pairs are groups of their own (``pair`` of ``n_cuts``).
    """
    prefixes = {d: x.prefix for d, x in indices.items()}
    counts = {d: x.shared for d, x in indices.items()}
    lengths = _posts(described, prefixes, False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = settle(lengths.select("key", F.ceil(F.col("n") / block).cast("int").alias("cuts")))
    posts = _posts(described, prefixes, True).join(F.broadcast(hot) if hot.count() <= BROADCAST_KEYS else hot, "key", "left")
    cuts = F.coalesce(F.col("cuts"), F.lit(1))
    mine = F.pmod(F.xxhash64("node"), cuts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda x: F.least(x, mine).cast("long") * cuts + F.greatest(x, mine))
    pairs = F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)
    # what is dealt is slim: a group's blocks and pair in one number, and a row's block is told from it afterwards
    part = F.explode(F.transform(pairs, lambda x: F.shiftleft(cuts.cast("long"), 40).bitwiseOR(x.cast("long"))))
    dealt = posts.select("key", part.alias("part"), "node", "near").repartition("key", "part").sortWithinPartitions("key", "part")
    n_cuts = F.shiftright("part", 40)
    dealt = dealt.select(
        "key", F.col("part").bitwiseAND(F.lit((1 << 40) - 1)).alias("pair"), n_cuts.cast("int").alias("n_cuts"), "node", "near",
        F.pmod(F.xxhash64("node"), n_cuts.cast("int")).cast("int").alias("block"),
    )
    names = ["key", "pair", "n_cuts", "node"]

    def points(raw: list[bytes], at: np.ndarray) -> np.ndarray:
        return np.frombuffer(b"".join([raw[i] for i in at]), "<u2").reshape(len(at), -1).astype(np.int64)

    def judge(rows: pa.Table) -> pa.Table | None:
        keys, pair, cut = (rows.column(c).to_numpy() for c in ("key", "pair", "n_cuts"))
        block_of = rows.column("block").to_numpy()
        starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1])))
        sizes = np.diff(np.append(starts, len(keys)))
        flags = (keys[starts] & ALONE) != 0
        out = np.repeat(flags & (sizes > 1), sizes)
        raw = rows.column("near").to_pylist()
        dims = (keys[starts] >> 40).astype(np.int64)
        for d in np.unique(dims[~flags]):
            own = np.flatnonzero((dims == d) & ~flags & (sizes > 1))
            short = (sizes[own] <= SHORT) & (cut[starts[own]] == 1)
            few = own[short]
            if len(few):
                begin = np.cumsum(sizes[few]) - sizes[few]
                at = np.repeat(starts[few] - begin, sizes[few]) + np.arange(sizes[few].sum())
                out[at] = _short_lists(keys[at], begin, sizes[few], points(raw, at), counts[int(d)])
            for g in own[~short]:
                at = np.arange(starts[g], starts[g] + sizes[g])
                left, right = divmod(int(pair[starts[g]]), int(cut[starts[g]]))
                out[at] = _long_list(int(keys[starts[g]]), left, right, block_of[at], points(raw, at), counts[int(d)])
        return rows.filter(pa.array(out)).select(names) if out.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*held, b])
            # the last list may go on in the next batch; it holds two blocks of rows at most
            keys, pair = rows.column("key").to_numpy(), rows.column("pair").to_numpy()
            stop = len(keys) - int(np.argmin(np.append(((keys == keys[-1]) & (pair == pair[-1]))[::-1], False)))
            found = judge(rows.slice(0, stop).combine_chunks()) if stop else None
            if found is not None:
                yield from found.combine_chunks().to_batches()
            held = rows.slice(stop).combine_chunks().to_batches()
        found = judge(pa.Table.from_batches(held).combine_chunks()) if held else None
        if found is not None:
            yield from found.combine_chunks().to_batches()

    return dealt.mapInArrow(run, "key bigint, pair bigint, n_cuts int, node bigint")


def _verify(key: int, left: int, right: int, g: pa.Table, cosine: float, short: bool) -> tuple[list, list]:
    """Counts of links of a group's vectors, and a forest of its links.

    A pair is counted in the list of the two rarest points that it shares.
    """
    node = g.column("node").to_numpy()
    copies = g.column("copies").to_numpy().astype(np.float64)
    block = g.column("block").to_numpy()
    vec = _matrix(g.column("vec").to_pylist(), short)
    n, q = len(node), key & 0xFFFF
    low = None
    if not key & ALONE:
        near = np.frombuffer(b"".join(g.column("near").to_pylist()), "<u2").reshape(n, -1).astype(np.int64)
        points, where = np.unique(np.where(near < q, near, -1), return_inverse=True)
        low = np.zeros((n, len(points)), np.float32)
        low[np.arange(n)[:, None], where.reshape(near.shape)] = 1
        low = low[:, points >= 0]

    def linked(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        link = vec[rows] @ vec[cols].T >= cosine
        link &= rows[:, None] != cols[None, :]
        if left != right:  # pairs within a block are counted where the block meets itself
            link &= (block[rows] == left)[:, None] != (block[cols] == left)[None, :]
        return link

    every = np.arange(n)
    total = np.zeros(n)
    for a in range(0, n, 512):
        rows = every[a : a + 512]
        link = linked(rows, every)
        if low is not None:
            link &= low[rows] @ low.T == 1
        total[rows] = link @ copies
    counts = [(int(a), int(b)) for a, b in zip(node[total > 0], total[total > 0])]
    edges, left_over = [], every
    while len(left_over) > 1:
        root, queue, left_over = left_over[0], [left_over[0]], left_over[1:]
        while queue and len(left_over):
            near_ = linked(np.array([queue.pop()]), left_over)[0]
            reached = left_over[near_]
            edges += [(int(node[r]), int(node[root])) for r in reached]
            queue += reached.tolist()
            left_over = left_over[~near_]
    return counts, edges


def near_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: links at ``cosine`` or more, and the components that they make.

    Vectors equal in direction are one node. Each node is described by its nearest reference points in order; nodes that
    share enough of them, the one's nearest among the other's, are compared exactly. Counts are summed and links reduced to
    forests inside the groups, so thousands of copies give as many rows. Vectors of unlike lengths never link; invalid ones
    (null, zero, empty, null or non-finite components) have no links and are their own component; repeated identifiers are
    rows of their own that share what is said of the identifier; columns besides the two named are not looked at. An empty
    table has an empty result. Links that the index misses: see the README's recall.
    """
    short = df.select(F.col(f"`{embedding}`").alias("e")).schema["e"].dataType.elementType.simpleString() == "float"
    rows = _vectors(df, vec_id, embedding, True).where("digest is not null and id is not null")
    nodes = rows.groupBy("digest").agg(F.min("id").cast("bigint").alias("node"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    nodes = settle(nodes)
    indices = fit_indices(nodes, short, cosine, pivots)
    described = settle(describe(nodes, indices, short))
    unsettle(nodes)
    asked = settle(search(described, indices, block).distinct())
    members = described.select("node", "copies", "vec", "near")
    cuts = F.col("n_cuts")
    posts = asked.join(members, "node").withColumn("block", F.pmod(F.xxhash64("node"), cuts).cast("int"))
    dealt = posts.repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in arrow_groups(batches, ["key", "pair"]):
            key, pair, n = (g.column(c)[0].as_py() for c in ("key", "pair", "n_cuts"))
            counts, edges = _verify(key, *divmod(pair, n), g, cosine, short)
            if counts or edges:
                a, b = [x for x, _ in counts + edges], [y for _, y in edges]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([None] * len(counts) + b, pa.int64()), pa.array([y for _, y in counts] + [0] * len(edges), pa.int64())], ["a", "b", "n"])

    found = settle(dealt.mapInArrow(run, "a bigint, b bigint, n bigint"))
    comp = connected_components(found.where("b is not null").select("a", "b"))
    n_links = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    of = settle(
        described.select("digest", "node", "copies").join(n_links, "node", "left").join(comp, "node", "left").select(
            F.col("digest").alias("__digest"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "node").alias("c")
        )
    )
    every = _vectors(df, vec_id, embedding, False)
    return every.join(of, F.col("digest") == F.col("__digest"), "left").select(
        F.col("id").alias(vec_id),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", F.col("id").cast("long"))).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("c", F.col("id").cast("long")) == F.col("id")).alias("kept"),
    )
