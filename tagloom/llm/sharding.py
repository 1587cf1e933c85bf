"""Sharding by a hierarchical weighted hash tree (region, rack, shard), in DataFrame expressions only."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import settle

SEED = 6
BASE = 8  # shards in full racks and regions, whatever the number of shards


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``children`` is empty for a shard; an inner node's weight is its children's sum."""

    name: str
    own_weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


@dataclass(frozen=True)
class Tree:
    regions: tuple[Node, ...] = field(default_factory=tuple)


def tree(n_shards: int, base: int = BASE, racks: int = 2, shards_a_rack: int = 2) -> Tree:
    """The tree for ``n_shards``: the first ``base`` in full racks and regions, every later one a region of its own.

    A later shard thus changes no weight inside the regions that were there: their draws stay, the new region outbids
    them for its share, and rows move into the new shard only.
    """
    if n_shards < 1 or base < 1:
        raise ValueError("a tree needs a shard")
    regions: dict[int, dict[int, list[Node]]] = {}
    for s in range(min(n_shards, base)):
        rack = s // shards_a_rack
        regions.setdefault(rack // racks, {}).setdefault(rack, []).append(Node(f"shard{s}", 1.0, (), s))
    built = [
        Node(f"region{g}", children=tuple(Node(f"rack{r}", children=tuple(leaves)) for r, leaves in by_rack.items()))
        for g, by_rack in regions.items()
    ]
    for s in range(base, n_shards):
        leaf = Node(f"shard{s}", 1.0, (), s)
        built.append(Node(f"region-of-{s}", children=(Node(f"rack-of-{s}", children=(leaf,)),)))
    return Tree(tuple(built))


def _draw(key: Column, node: Node) -> Column:
    """An exponential draw at the node's weight: the least of several wins with a chance in proportion to weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(SEED), F.lit(node.name)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(uniform) / F.lit(float(node.weight))


def _descend(key: Column, nodes: tuple[Node, ...]) -> Column:
    """The shard below the winner among ``nodes``; draws depend on key and node alone, never on its siblings."""
    live = [n for n in nodes if n.weight > 0]
    if not live:
        raise ValueError("no node has weight")
    below = [F.lit(n.shard) if n.shard is not None else _descend(key, n.children) for n in live]
    if len(live) == 1:
        return below[0]
    draws = [_draw(key, n) for n in live]
    least = F.least(*draws)
    out = below[-1]
    for draw, shard in reversed(list(zip(draws, below))[:-1]):
        out = F.when(draw == least, shard).otherwise(out)
    return out


def shard_of(key: Column, of: Tree) -> Column:
    """The shard of a key: a weighted draw among regions, then the winner's racks, then that rack's shards.

    A change of weight moves rows only into or out of the subtrees whose weights change. A null key is a key like any
    other (it draws by the seed alone).
    """
    return _descend(key, of.regions).cast("int")


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", n_shards: int = 8, base: int = BASE) -> DataFrame:
    """Every row of ``df`` to a shard: ``key, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``key``: key and shard count decide, so equal keys share a shard and equal texts need not.
    ``grown_shard`` is the shard with one more: what a call with ``n_shards + 1`` and the same ``base`` gives. From
    ``base`` shards on, rows move into the new shard only; below it, a new shard makes its rack and region heavier, which
    may also take rows into their other shards. ``size`` is the text's UTF-8 bytes (null: none) plus 1; a null text has
    the empty one's CRC. ``slot`` numbers a shard's rows without gaps from 0: rows keep their partition, of which the
    shared folder holds one fixed copy without texts, and take its offset plus their rank there; however many rows one
    key or text has, no window sees more than a partition. The table of offsets has a row per partition and shard.
    An empty table has an empty result; columns besides ``key`` and ``text`` are not looked at.
    """
    k, t = F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(
        k.alias(key),
        (F.octet_length(t).cast("long") + 1).alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(k, tree(n_shards, base)).alias("shard"),
        shard_of(k, tree(n_shards + 1, base)).alias("grown_shard"),
        F.spark_partition_id().alias("__part"),
        F.monotonically_increasing_id().alias("__at"),
    )
    rows = settle(rows)
    offsets = rows.groupBy("__part", "shard").agg(F.count("*").alias("__n"))
    offsets = offsets.selectExpr(
        "__part", "shard", "sum(__n) over (partition by shard order by __part) - __n as __before"
    )
    ranked = rows.selectExpr("*", "row_number() over (partition by __part, shard order by __at) - 1L as __rank")
    return ranked.join(offsets, ["__part", "shard"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("__before") + F.col("__rank")).alias("slot"), "grown_shard"
    )
