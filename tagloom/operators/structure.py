"""Structure of documents: parents and depths of elements, and joins by containment."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .events import AT_ONCE, _lexed
from .lexer import FLAT, OPEN, Lexer

RANGE = 1 << 22  # bytes of a document that one group of a containment join covers


class ParentLexer(Lexer):
    """Keeps, of each element as it opens: name, places of its tag, depth, and its parent's name and first byte."""

    def __init__(self) -> None:
        super().__init__(OPEN, False, FLAT)

    def _opened(self, s: str, i: int, name: str, found: list | tuple, closing: bool, end: int) -> int:
        over = self.stack[-1] if self.stack else None
        self.parents.append((name, self.places.at(i)[1], self.places.at(end)[1], self.below + len(self.stack), over and over[0], over and over[5]))
        return super()._opened(s, i, name, found, closing, end)

    def document(self, content: bytes | str | None) -> list[tuple]:
        self.parents: list[tuple] = []
        self.open_document(content)
        return self.parents

    def continued(self, text: str) -> list[tuple]:
        self.parents = []
        self._read(text, True)
        return self.parents


def parent_fields() -> list[T.StructField]:
    return list(T._parse_datatype_string("name string, byte_start bigint, byte_end bigint, depth bigint, parent_name string, parent_start bigint"))


def parent_columns(found: list[tuple]) -> list[pa.Array]:
    return [pa.array([x[k] for x in found], f) for k, f in enumerate((pa.string(), *[pa.int64()] * 3, pa.string(), pa.int64()))]


def element_parents(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, name, byte_start, byte_end, depth, parent_name, parent_start`` of every opening tag.

    The parent is the innermost element that is open there, whether or not it is ever closed; outermost elements have
    depth 0 and no parent. Documents are lexed where they are; ``blocks.split_parents`` does the same for split ones.
    """
    return _lexed(df, content, keep, ParentLexer, parent_columns, parent_fields(), ParentLexer.document)


def contained(outer: DataFrame, inner: DataFrame, keys: list[str], start: str = "byte_start", end: str = "byte_end", width: int = RANGE) -> DataFrame:
    """``keys, outer, inner`` (structs of each side's other columns): pairs of a document where one range holds the other.

    A range of ``outer`` holds one of ``inner`` if it begins no later and ends no earlier, and is not the same range. Both
    sides are dealt to stretches of ``width`` bytes of their document, an inner range by its beginning and an outer one to
    all that it reaches; within a stretch, sorted by where they begin, outer ranges wait on a stack. So no pair is looked at
    that does not overlap, and a large document is many groups. Rows with a null key or place have no partner; repeated rows
    pair as often as they come. Memory is bounded by the ranges that overlap in one place.
    """
    names = [*keys, start, end]

    def side(df: DataFrame, is_outer: bool) -> DataFrame:
        df = df.dropna(subset=names)
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys])
        at, to = (F.floor(F.col(f"`{c}`") / width).cast("bigint") for c in (start, end))
        at = F.explode(F.sequence(at, F.greatest(at, to))) if is_outer else at
        cols = [F.col(f"`{k}`") for k in keys]
        return df.select(*cols, at.alias("__at"), F.col(f"`{start}`").cast("bigint").alias("__a"), F.col(f"`{end}`").cast("bigint").alias("__b"), F.lit(is_outer).alias("__outer"), whole.alias("outer" if is_outer else "inner"))

    both = side(outer, True).unionByName(side(inner, False), allowMissingColumns=True)
    by = [*keys, "__at"]
    laid = both.repartition(*by).sortWithinPartitions(*by, "__a", F.desc("__b"), F.desc("__outer"))
    kinds = T.StructType([laid.schema[c] for c in [*keys, "outer", "inner"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, found = None, [], []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*by, "__a", "__b", "__outer", "outer", "inner")]
            types = [b.column(c).type for c in (*keys, "outer", "inner")]

            def flush() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], kinds.names)

            for row in zip(*columns):
                *own, a, z, is_outer, wide, narrow = row
                if own != group:
                    group, waiting = own, []
                waiting = [w for w in waiting if w[1] >= a]
                if is_outer:
                    waiting.append((a, z, wide))
                    continue
                found += [(*own[:-1], w, narrow) for x, y, w in waiting if z <= y and (x, y) != (a, z)]
                if len(found) >= AT_ONCE:
                    yield flush()
                    found = []
            if found:
                yield flush()
                found = []

    return laid.mapInArrow(run, kinds)
