"""Target-distribution importance resampling: documents drawn by how much likelier their runs of words are in a target.

Features are runs of one to three words, hashed into buckets by CRC-32. Each partition reads its words into tries: a node
is a run, a child its run and one more word; nodes hold how often the run comes and the CRC state of its bytes, so a
child's state follows from its parent's and the added word alone. Tries of one pass give bucket totals, which are summed
over partitions; the other pass walks the same paths with each bucket's gain attached to the nodes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settle, text_batches

BUCKETS = 10_000
DEPTH = 3  # words of a run
BLOCK_WORDS = 1 << 19  # words of one trie, after which a partition begins a new one: bounds a task's memory
SEED = 42

# words are of ASCII letters, digits and whatever is not ASCII; A-Z become a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a batch's texts, one after the other, and the row that each is of."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(values, np.uint8)[at[0] : at[-1]]] if values is not None else np.empty(0, np.uint8)
    at = at - at[0]
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = at[(at > 0) & (at < len(raw))]  # no word goes on into the next text
    first[borders] |= inside[borders]
    last[borders - 1] |= inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.append(0, np.cumsum(ends - starts)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(raw[inside])])
    return words, np.searchsorted(at, starts, "right") - 1


def _times(a: list[int], b: list[int]) -> list[int]:
    """The product of two maps of 32 bits, each given by the images of single bits."""
    return [_image(a, x) for x in b]


def _image(a: list[int], x: int) -> int:
    out = 0
    while x:
        low = x & -x
        out ^= a[low.bit_length() - 1]
        x ^= low
    return out


@lru_cache(maxsize=1)
def _one_byte() -> list[int]:
    """What one byte 0 behind a text does to the CRC-32 of it, per bit: polynomial EDB88320."""
    one_bit = [0xEDB88320, *[1 << k for k in range(31)]]
    two = _times(one_bit, one_bit)
    four = _times(two, two)
    return _times(four, four)


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """Four tables by byte: the CRC state after ``n`` bytes more, but for what these bytes are."""
    out, power = [1 << k for k in range(32)], _one_byte()
    while n:
        if n & 1:
            out = _times(power, out)
        power, n = _times(power, power), n >> 1
    bits = np.array(out, np.uint32).reshape(4, 8)
    tables = np.zeros((4, 256), np.uint32)
    for k in range(8):
        tables[:, (np.arange(256) >> k) & 1 == 1] ^= bits[:, k : k + 1]
    return tables


def _image_of(tables: np.ndarray, state: int) -> int:
    return int(np.bitwise_xor.reduce([tables[k, (state >> (8 * k)) & 255] for k in range(4)]))


class Trie:
    """One block's runs as a trie, a level at a time.

    ``levels[k]`` has, for the runs of ``k + 1`` words: the last words' places in the block, the node of each, and each
    node's CRC-32 and count. ``context`` words in front only lead to later ones: their own runs are of the block before.
    """

    def __init__(self, words: pa.Array, row: np.ndarray, context: int):
        coded = words.dictionary_encode()
        word, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        state = np.array([zlib.crc32(w) for w in vocabulary], np.uint32)
        lengths, length_no = np.unique(pc.binary_length(coded.dictionary).to_numpy(), return_inverse=True)
        shifts = np.stack([_shift(int(n)) for n in lengths + 1]) if len(lengths) else np.zeros((0, 4, 256), np.uint32)
        # a blank and the word
        added = state ^ np.array([_image_of(_shift(int(n)), zlib.crc32(b" ")) for n in lengths], np.uint32)[length_no]
        goes_on = np.append(False, row[1:] == row[:-1]) if len(row) else np.zeros(0, bool)
        node, reached = word, np.ones(len(word), bool)
        self.levels = [self._level(np.arange(len(word)), word, state, context)]
        for _ in range(DEPTH - 1):
            # a run that ends at the word before goes on to this one, if that is of the same text
            onward = goes_on & np.append(False, reached[:-1])[: len(word)]
            at = np.flatnonzero(onward)
            paths, inverse = np.unique(node[at - 1] * len(vocabulary) + word[at], return_inverse=True)
            parent, step = np.divmod(paths, max(1, len(vocabulary)))
            before, t, moved = state[parent], length_no[step], added[step]
            for k in range(4):
                moved = moved ^ shifts[t, k, (before >> (8 * k)) & 255]
            node, state, reached = np.zeros(len(word), np.int64), moved, onward
            node[at] = inverse
            self.levels.append(self._level(at, inverse, state, context))

    @staticmethod
    def _level(at: np.ndarray, node: np.ndarray, crc: np.ndarray, context: int) -> tuple[np.ndarray, ...]:
        own = at >= context
        return at[own], node[own], crc, np.bincount(node[own], minlength=len(crc))

    def totals(self) -> np.ndarray:
        """How many features fall into each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for _, _, crc, count in self.levels:
            np.add.at(out, crc % BUCKETS, count)
        return out

    def walk(self, gains: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """The sum of gains along each row's paths."""
        out = np.zeros(n_rows, np.int64)
        for at, node, crc, _ in self.levels:
            np.add.at(out, row[at], gains[crc % BUCKETS][node])
        return out


def tries(texts: pa.Array, block: int = BLOCK_WORDS) -> Iterator[tuple[Trie, np.ndarray]]:
    """A batch's tries with the rows of their words; a long text goes on from one trie to the next."""
    words, row = words_of(texts)
    for a in range(0, len(words), block):
        context = min(a, DEPTH - 1)
        b = min(len(words), a + block)
        yield Trie(words.slice(a - context, b - a + context), row[a - context : b], context), row[a - context : b]


def bucket_totals(df: DataFrame, text: str = "text") -> np.ndarray:
    """Features of all texts by bucket: ``BUCKETS`` numbers, summed in every partition and then over all."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for trie, _ in tries(b.column(0)):
                out += trie.totals()
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out[used], pa.int64())], ["bucket", "n"])

    found = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row per bucket at most
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A feature's gain by bucket: a thousand times the smoothed log ratio of target to raw, rounded down."""
    n_raw, n_target = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    ratio = [(float(t) + 1.0) * n_raw / ((float(s) + 1.0) * n_target) for s, t in zip(raw.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def score_documents(df: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_features, weight, score`` of every row: summed gains, and these with the key's own noise."""
    text_batches(df.sparkSession)
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    slim = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), draw.cast("bigint").alias("h"))
    kind = slim.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            weight, n_words = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for trie, row in tries(b.column("text")):
                weight += trie.walk(gains, row, n)
                n_words += np.bincount(row[trie.levels[0][0]], minlength=n)
            n_features = sum(np.maximum(n_words - k, 0) for k in range(DEPTH))
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in b.column("h").to_pylist()]
            figures = [n_words, n_features, weight, weight + np.array(noise, np.int64)]
            yield pa.RecordBatch.from_arrays([b.column("key"), *[pa.array(x, pa.int64()) for x in figures]], ["key", "n_words", "n_features", "weight", "score"])

    return slim.mapInArrow(run, f"key {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")


def resample(df: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key, n_features, weight, score, rank`` of every row of ``df``; the drawn ones are ranked from 1.

    Of the rows with ``least_words`` words or more, ``percent`` in a hundred (rounded down) are drawn: the highest scores,
    ties to the smaller key. A null or empty text has no feature and weight 0; a null key draws by the seed alone and
    comes behind equal scores. Equal rows have equal figures but ranks of their own. An empty table has an empty result,
    an empty target equal counts in all buckets. Columns besides the key and texts are not looked at.

    Ranks come without a global window: scores are cut into ranges once, each row keeps its range's number in the shared
    folder, and a rank is the rows of earlier ranges plus the place in its own. Ties are split by key, so one score that
    many rows share is many ranges. The table of ranges has a row per partition.
    """
    gains = bucket_gains(bucket_totals(df, text), bucket_totals(target, target_text))
    rows = settle(score_documents(df, gains, key, text))
    able = F.col("n_words") >= least_words
    drawn = rows.where(able).count() * percent // 100
    order = [able.desc(), F.col("score").desc(), F.col("key").asc_nulls_last()]
    laid = settle(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = laid.groupBy("part").agg(F.count("*").alias("n")).selectExpr("part", "sum(n) over (order by part) - n as before")
    ranked = laid.selectExpr("*", f"row_number() over (partition by part order by n_words >= {least_words} desc, score desc, key asc nulls last) as place")
    rank = F.col("before") + F.col("place")
    return ranked.join(before, "part").select(
        F.col("key").alias(key), "n_features", "weight", "score", F.when(able & (rank <= drawn), rank).cast("bigint").alias("rank")
    )
