"""SimHash near-duplicates: fingerprints, pigeonring candidates, exact Hamming checks, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import arrow_groups, settle, text_batches
from .components import connected_components

SEED = 42
WORDS = 3
DISTANCE = 3
SEGMENTS, WIDTH = 4, 16
BLOCK = 2048  # fingerprints of a key that one group holds; larger keys are cut into pairs of blocks
SHINGLES_AT_ONCE = 1 << 15
BYTES_AT_ONCE = 1 << 17  # whose words are at hand at once
BROADCAST_KEYS = 20_000
NODES_A_TASK = 10_000  # fingerprints of which one task makes keys
_gap = re.compile(rb"[ \t-\r]")


def fingerprint(text: str | bytes | None, words: int = WORDS) -> int:
    """64 bits, each 1 if set in over half of the shingles' XXH64; 0 without words.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; repeats of a shingle count.
    """
    raw = text.encode() if isinstance(text, str) else text or b""
    held: list[bytes] = []
    n, ones = 0, np.zeros(64, np.int64)
    for part in _word_pieces(raw):
        held += part
        for a in range(0, len(held) - words + 1, SHINGLES_AT_ONCE):
            some = held[a : a + SHINGLES_AT_ONCE + words - 1]
            grams = zip(*[some[k:] for k in range(words)])
            h = np.array([xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams], np.uint64)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
        held = held[max(0, len(held) - words + 1) :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _word_pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The lower-cased words of ``BYTES_AT_ONCE`` after another; a piece ends at white space."""
    at = 0
    while at < len(raw):
        gap = _gap.search(raw, at + BYTES_AT_ONCE)
        end = gap.start() if gap else len(raw)
        yield raw[at:end].lower().split()
        at = end


def fingerprints(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc, text_hash, fp`` (signed 64 bits each) of every row; null texts have no words."""
    text_batches(df.sparkSession)
    t = F.col(f"`{text}`")
    slim = df.select(F.col(f"`{doc}`").alias("doc"), _text_hash(t).alias("text_hash"), t.alias("text"))
    kind = slim.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, words) for x in b.column("text").cast(pa.large_binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("text_hash"), pa.array(fp.view(np.int64))], ["doc", "text_hash", "fp"])

    return slim.mapInArrow(run, f"doc {kind}, text_hash bigint, fp bigint")


def _text_hash(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def _ring_keys(nodes: DataFrame) -> DataFrame:
    """``key, own`` of each fingerprint: where a chain of segments that stays within its budgets can begin.

    Pigeonring: if two fingerprints differ in at most 3 bits, some segment i of 4 in a ring begins a chain whose
    differences summed over its first 1, 2 and 3 segments stay within 0, 1 and 2 (3/4 a segment, rounded down). So
    segment i is equal and its successor differs in one bit at most. A fingerprint is found under its own two segments
    (``own``) and looks under those with one bit of the successor taken away: of two that differ in that bit, the one
    that has it looks. The budget of the third segment, and those of two that both look, are checked in the group.
    """
    fp = F.col("fp")
    keys = []
    for i in range(SEGMENTS):
        a, b = _segment(fp, i), _segment(fp, i + 1)
        base = F.shiftleft(F.lit(i).cast("long"), 2 * WIDTH).bitwiseOR(F.shiftleft(a, WIDTH))
        keys.append(F.struct(base.bitwiseOR(b).alias("key"), F.lit(True).alias("own")))
        for j in range(WIDTH):
            bit = F.lit(1 << j).cast("long")
            has = b.bitwiseAND(bit) != 0
            keys.append(F.when(has, F.struct(base.bitwiseOR(b.bitwiseXOR(bit)).alias("key"), F.lit(False).alias("own"))))
    return nodes.select("fp", "node", F.explode(F.array(*keys)).alias("k")).where("k is not null").select("fp", "node", "k.key", "k.own")


def _hot_keys(nodes: DataFrame, block: int) -> DataFrame:
    """``key, cuts``: keys under which more than ``block`` fingerprints may meet, and into how many blocks they go.

    Only the own keys are counted, summed before they are shuffled. Those that look under a key are at most the own
    ones of the 16 keys with one more bit; a key's neighbours are found from the few large counts.
    """
    fp = F.col("fp")
    own = []
    for i in range(SEGMENTS):
        base = F.shiftleft(F.lit(i).cast("long"), 2 * WIDTH).bitwiseOR(F.shiftleft(_segment(fp, i), WIDTH))
        own.append(base.bitwiseOR(_segment(fp, i + 1)))
    counts = nodes.select(F.explode(F.array(*own)).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block // 16)
    around = [F.col("key")] + [F.when(F.col("key").bitwiseAND(F.lit(1 << j).cast("long")) != 0, F.col("key").bitwiseXOR(F.lit(1 << j).cast("long"))) for j in range(WIDTH)]
    met = counts.select(F.explode(F.array(*around)).alias("key"), "n").where("key is not null").groupBy("key").agg(F.sum("n").alias("n"))
    return met.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("cuts"))


def _chained(differ: np.ndarray, segment: int, distance: int) -> np.ndarray:
    """Of differing bits ``differ``: whether the chain of segments from ``segment`` on stays within its budgets.

    The differences summed over its first 1, 2 and 3 segments are at most 1/4, 2/4 and 3/4 of ``distance``, rounded down.
    """
    at = np.uint64(WIDTH * segment)
    turned = differ >> at | (differ << (np.uint64(64) - at) if segment else np.uint64(0))
    ok = np.ones(len(differ), bool)
    for k in range(1, SEGMENTS):
        ok &= np.bitwise_count(turned & np.uint64((1 << WIDTH * k) - 1)) <= distance * k // SEGMENTS
    return ok


def _forest(fp: np.ndarray, node: np.ndarray, segment: int, distance: int) -> list[tuple[int, int]]:
    """Edges that join what is linked within a group, through the fewest comparisons: a search from node to node.

    Only pairs whose chain from the group's segment on keeps its budgets are checked by their full distance; any linked pair
    has such a chain from one of its segments on, and meets in that segment's group.
    """
    edges = []
    left = np.arange(len(fp))
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        root = queue[0]
        while queue and len(left):
            differ = fp[left] ^ fp[queue.pop()]
            near = _chained(differ, segment, distance)
            near[near] = np.bitwise_count(differ[near]) <= distance
            if near.any():
                reached = left[near]
                edges += [(int(node[r]), int(node[root])) for r in reached]
                queue += reached.tolist()
                left = left[~near]
    return edges


def links(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges between ``nodes(fp, node)``, distinct fingerprints, with the components of all links of up to
    ``distance`` (at most 3) bits.

    Within a key's group a forest of links is found, so copies in their thousands give as many edges, not their square.
    Keys with more than ``block`` fingerprints are cut into blocks, and each pair of blocks is a group of its own: no
    task holds more than two blocks of a key and no pair is lost.
    """
    if distance > DISTANCE:
        raise ValueError("the chains' budgets hold for up to 3 bits")
    # a node becomes 35 rows or so, so a small table of nodes is dealt to as many tasks as its keys need
    nodes = nodes.repartition(-(-nodes.count() // NODES_A_TASK) or 1, "fp")
    hot = settle(_hot_keys(nodes, block))
    few = hot.count() <= BROADCAST_KEYS
    keyed = _ring_keys(nodes).join(F.broadcast(hot) if few else hot, "key", "left")
    cuts = F.coalesce(F.col("cuts"), F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), cuts).cast("int")
    pair = F.transform(F.sequence(F.lit(0), cuts - 1), lambda x: F.least(x, mine) * cuts + F.greatest(x, mine))
    keyed = keyed.withColumn("pair", F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(pair))
    keyed = keyed.select("key", F.explode("pair").alias("pair"), "fp", "node", "own")
    dealt = keyed.repartition("key", "pair").sortWithinPartitions("key", "pair")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for g in arrow_groups(batches, ["key", "pair"]):
            own = g.column("own").to_numpy()
            if not own.any():
                continue
            fp = g.column("fp").to_numpy().view(np.uint64)
            segment = g.column("key")[0].as_py() >> 2 * WIDTH
            out += _forest(fp, g.column("node").to_numpy(), segment, distance)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _components(df: DataFrame, doc: str, text: str, words: int, distance: int) -> DataFrame:
    """``doc, text_hash, fp, component_id, n_copies`` of every row."""
    fps = settle(fingerprints(df, doc, text, words))
    nodes = settle(fps.groupBy("fp").agg(F.min("doc").alias("node"), F.count("*").alias("n_copies")))
    comp = settle(connected_components(links(nodes.where("node is not null").select("fp", "node"), distance)))
    of = settle(
        nodes.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), "n_copies")
    )
    return fps.join(of, "fp").select("doc", "text_hash", "fp", "component_id", "n_copies")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """``doc, fingerprint, component_id, n_copies`` of every row.

    Documents are linked if their fingerprints differ in ``distance`` bits at most; ``component_id`` is the smallest
    identifier that links reach. Equal fingerprints are one node from the start (``n_copies`` rows); null and empty
    texts have fingerprint 0 and link like any other. Rows without an identifier share the component of rows with
    their fingerprint; a fingerprint that no identified row has is linked with nothing and its component is null.
    Repeated rows are rows; an empty table has an empty result.
    """
    return _components(df, doc, text, words, distance).select(
        F.col("doc").alias(doc), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_copies"
    )


def keep_one(df: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``df``, all columns, of which each component keeps one: that with its smallest identifier.

    Of several rows with that identifier the one with the least hash of its text stays, and one of wholly equal ones.
    """
    near = _components(df, doc, text, words, distance).where("doc <=> component_id")
    same = ["doc", F.when(F.col("component_id").isNull(), F.col("fp")).alias("__fp")]
    kept = near.groupBy("doc", "fp", "component_id", "text_hash").agg(F.count("*").alias("n"))
    kept = settle(kept.groupBy(*same).agg(F.min(F.struct("text_hash", "n")).alias("k")).select("doc", "k.text_hash", "k.n"))
    kept = kept.withColumnsRenamed({"doc": "__doc", "text_hash": "__hash", "n": "__n"})
    on = F.col(f"`{doc}`").eqNullSafe(F.col("__doc")) & (_text_hash(F.col(f"`{text}`")) == F.col("__hash"))
    out = df.join(kept.where("__n = 1"), on, "left_semi")
    repeated = kept.where("__n > 1")
    if repeated.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    # summed on the map side, so that a row repeated without end is one row a partition
    again = df.join(repeated, on, "inner").groupBy("__doc", "__hash").agg(F.first(row).alias("row")).select("row.*")
    return out.unionByName(again)
