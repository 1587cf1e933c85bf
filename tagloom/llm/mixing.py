"""Temperature mixing of sources, in DataFrame expressions only.

Shares of tokens p are raised to an exponent a and normalised. The exponent is bisected until the mixture has a target
entropy or its most repeated source stays at a limit. The weights are then realised as budgeted permutations of blocks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._base import settle

BLOCKS = 4096  # at least
BLOCK_ROWS = 1 << 16  # rows of a block on average, beyond as many blocks: what one window sees of a source stays bounded
SEED = 9
GRID, ROUNDS = 64, 5
BROADCAST_SOURCES = 10_000


@dataclass(frozen=True)
class Mixture:
    """``plan`` has a row per source: weight, repeats (passes over the source), whole passes, and the last one's cut."""

    exponent: float
    entropy: float
    plan: DataFrame
    n_sources: int
    n_blocks: int


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))).cast("long")


def blocks_for(n: int) -> int:
    """Blocks that ``n`` rows are dealt into: a power of two, ``BLOCKS`` at least."""
    return max(BLOCKS, 1 << max(0, -(-n // BLOCK_ROWS) - 1).bit_length())


def _block(doc: Column, text: Column, blocks: int) -> Column:
    """Block of a row; an epoch permutes blocks, and rows within a block."""
    return F.pmod(F.xxhash64(F.lit(SEED), doc, text), F.lit(blocks)).cast("int")


def _bisect(sources: DataFrame, target_entropy: float | None, max_repeats: float | None) -> tuple[float, float]:
    """The exponent in 0..1, found by ever finer grids: a job a grid, and only the grid's figures come to the driver.

    Entropy and the highest repetition both fall as the exponent rises from 0 (equal weights) to 1 (shares as they
    are), so the least exponent that respects the repetition limit, or reaches down to the target entropy, is sought.
    """
    top = sources.agg(F.max("p").alias("p"), F.sum("p").alias("s")).first()
    if top["p"] is None or not top["s"]:
        return 1.0, 0.0

    def figures(exponents: list[float]) -> list[tuple[float, float, float]]:
        a = F.explode(F.array(*[F.lit(float(x)) for x in exponents])).alias("a")
        at = sources.where("p > 0").select("p", a)
        w = F.pow("p", F.col("a"))
        out = (
            at.groupBy("a")
            .agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("zl"), F.max(F.pow(F.lit(top["p"]) / F.col("p"), 1 - F.col("a"))).alias("r"))
            .collect()
        )
        return sorted((x["a"], math.log(x["z"]) - x["zl"] / x["z"], x["r"]) for x in out)

    def met(entropy: float, repeats: float) -> bool:
        return (target_entropy is None or entropy <= target_entropy) and (max_repeats is None or repeats <= max_repeats)

    low, high, entropy = 0.0, 1.0, figures([1.0])[0][1]
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        found = figures(grid)
        good = [k for k, (_, h, r) in enumerate(found) if met(h, r)]
        if not good:  # the target lies above what an exponent of 1 gives
            break
        k = good[0]
        high, entropy = grid[k], found[k][1]
        if k == 0:
            break
        low = grid[k - 1]
    return high, entropy


def mixture(rows: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0) -> Mixture:
    """Weights and passes for ``rows(source, doc, th, tokens)``: ``th`` stands for the text in permutations.

    The budget is the least that leaves no source short: the largest source in proportion to its weight has one whole
    pass, and the others as many passes, the last in part, as their weights ask. The last pass is a prefix of that
    epoch's permutation: whole blocks up to the source's budget, and of the block on the border the rows that fit.
    Rows with equal keys in the permutation are all in or all out.
    """
    blocks = blocks_for(rows.count())
    by_block = settle(
        rows.select("source", "tokens", _block(F.col("doc"), F.col("th"), blocks).alias("block"))
        .groupBy("source", "block")
        .agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    )
    sources = by_block.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    sources = settle(sources.withColumn("p", F.col("tokens") / F.lit(float(total or 1))))
    exponent, entropy = _bisect(sources, target_entropy, max_repeats)
    z = sources.where("p > 0").agg(F.sum(F.pow("p", F.lit(exponent))), F.max("p")).first()
    norm, top = z[0] or 1.0, z[1] or 1.0
    plan = sources.select(
        "source",
        "tokens",
        F.when(F.col("p") > 0, F.pow("p", F.lit(exponent)) / F.lit(norm)).otherwise(0.0).alias("weight"),
        F.when(F.col("p") > 0, F.pow(F.lit(top) / F.col("p"), F.lit(1 - exponent))).otherwise(1.0).alias("repeats"),
    ).withColumns(
        {
            "passes": F.floor(F.col("repeats") + 1e-9).cast("int"),
            "rest": F.floor((F.col("repeats") - F.floor(F.col("repeats") + 1e-9)) * F.col("tokens") + 1e-6).cast("long"),
        }
    )
    plan = settle(plan)
    # the last pass: blocks in the permutation's order, then the rows of the block on the border
    last = by_block.join(plan.where("rest > 0").select("source", "passes", "rest").alias("q"), by_block["source"].eqNullSafe(F.col("q.source"))).select(
        by_block["source"], "block", by_block["tokens"], "rest", "passes", F.xxhash64(F.lit(SEED), F.col("passes"), F.col("block")).alias("place")
    )
    last = last.selectExpr(
        "source", "block", "rest", "passes", "place",
        "sum(tokens) over (partition by source order by place, block) - tokens as before",
        "sum(tokens) over (partition by source order by place, block) as upto",
    )
    border = last.where("before <= rest and upto > rest").selectExpr("source", "block", "passes", "place", "rest - before as room")
    inner = rows.select("source", "doc", "th", "tokens", _block(F.col("doc"), F.col("th"), blocks).alias("block"))
    inner = (
        inner.alias("r")
        .join(border.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block")))
        .select(F.col("r.source").alias("source"), "room", F.xxhash64(F.lit(SEED), F.col("passes"), F.col("doc"), F.col("th")).alias("inner"), "tokens")
        .groupBy("source", "room", "inner")
        .agg(F.sum("tokens").alias("tokens"))
        .selectExpr("source", "room", "inner", "sum(tokens) over (partition by source order by inner) as upto")
        .where("upto <= room")
        .groupBy("source")
        .agg(F.max("inner").alias("cut_inner"))
    )
    cuts = border.select("source", F.col("block").alias("cut_block"), F.col("place").alias("cut_place"))
    plan = (
        plan.alias("p")
        .join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
        .join(inner.alias("i"), F.col("p.source").eqNullSafe(F.col("i.source")), "left")
        .select("p.source", "p.tokens", "weight", "repeats", "passes", "rest", "cut_block", "cut_place", "cut_inner")
    )
    plan = settle(plan)
    return Mixture(exponent, entropy, plan, plan.count(), blocks)


def realise(rows: DataFrame, mix: Mixture, keep: list[str]) -> DataFrame:
    """A row per pass for every row of ``rows(source, doc, th, ..)``: ``keep``, weight, epoch, block and block_place.

    Ordering by ``epoch, block_place`` walks the permuted blocks. The plan is broadcast up to a checked number of
    sources, beyond which Spark joins it by shuffle (and splits a hot source, as the plan has one row for each).
    """
    plan = mix.plan.withColumnRenamed("source", "__source").drop("tokens")
    plan = F.broadcast(plan) if mix.n_sources <= BROADCAST_SOURCES else plan
    block = _block(F.col("doc"), F.col("th"), mix.n_blocks)
    at = rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).withColumn("block", block)
    place = F.xxhash64(F.lit(SEED), F.col("passes"), F.col("block"))
    inner = F.xxhash64(F.lit(SEED), F.col("passes"), F.col("doc"), F.col("th"))
    before = (place < F.col("cut_place")) | ((place == F.col("cut_place")) & (F.col("block") < F.col("cut_block")))
    on_border = (F.col("block") == F.col("cut_block")) & (inner <= F.col("cut_inner"))
    # no border: the last pass has no budget, or (a rounding) takes its source whole
    more = F.when(F.col("rest") <= 0, 0).when(F.col("cut_block").isNull(), 1).when(before | F.coalesce(on_border, F.lit(False)), 1).otherwise(0)
    out = at.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("passes") + more - 1)))
    return out.select(*keep, "weight", "repeats", "epoch", "block", F.xxhash64(F.lit(SEED), F.col("epoch"), F.col("block")).alias("block_place"))


def mix_documents(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = None, max_repeats: float | None = 2.0
) -> DataFrame:
    """``doc, source, n_tokens, weight, repeats, epoch, block, block_place``: a row for each time a document is taken.

    Every document is taken at least once. Null sources are a source of their own; documents without tokens (null or
    empty texts) are taken once in each pass that holds them; repeated rows are rows. Columns besides the three named
    are not looked at. An empty table has an empty result.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = settle(
        docs.select(
            F.col(f"`{source}`").alias("source"), F.col(f"`{doc}`").alias("doc"), F.xxhash64(t).alias("th"), n_tokens(t).alias("tokens")
        )
    )
    out = realise(rows, mixture(rows, target_entropy, max_repeats), ["doc", "source", "tokens"])
    return out.withColumnsRenamed({"doc": doc, "tokens": "n_tokens"})


def mix_rows(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", target_entropy: float | None = None, max_repeats: float | None = 2.0) -> DataFrame:
    """The documents themselves, all their columns, each as often as the mixture takes it; texts are not shuffled."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    slim = settle(
        docs.select(F.col(f"`{source}`").alias("source"), F.col(f"`{doc}`").alias("doc"), F.xxhash64(t).alias("th"), n_tokens(t).alias("tokens"))
    )
    mix = mixture(slim, target_entropy, max_repeats)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{source}`").alias("source"),
        F.col(f"`{doc}`").alias("doc"),
        F.xxhash64(t).alias("th"),
    )
    return realise(rows, mix, ["row"]).select("row.*")
