"""Texts behind places: spans of documents, each document looked through once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Directory:
    """Where a document's lines begin, in bytes; a line's UTF-16 columns are bytes too where it is ASCII."""

    def __init__(self, content: str):
        self.raw = content.encode()
        self.starts = np.append(0, np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 10) + 1)
        self.plain = len(self.raw) == len(content)
        self.line, self.units = -1, b""

    def bytes(self, start: int, end: int) -> str:
        """Text between two byte offsets; what of a character is cut off is replaced."""
        return self.raw[max(0, start) : max(0, end)].decode("utf-8", "replace")

    def place(self, line: int, start: int, end: int) -> str | None:
        """Text between two UTF-16 columns of a line; none beyond the last line."""
        if not 0 <= line < len(self.starts):
            return None
        a = int(self.starts[line])
        z = int(self.starts[line + 1]) - 1 if line + 1 < len(self.starts) else len(self.raw)
        if self.plain:
            return self.raw[a + max(0, start) : min(z, a + max(0, end))].decode()
        if line != self.line:  # the last line is kept, as spans come in their order
            self.line, self.units = line, self.raw[a:z].decode().encode("utf-16-le")
        return self.units[2 * max(0, start) : 2 * max(0, end)].decode("utf-16-le", "replace")


def slices(docs: DataFrame, spans: DataFrame, keys: list[str], content: str, places: tuple[str, ...], into: str = "slice") -> DataFrame:
    """``spans``, all columns, with the text that each one spans in ``docs``.

    ``places`` names two columns with byte offsets, or three with a line and two UTF-16 columns. Documents are one row for
    their ``keys`` (of several the first counts); they meet their spans once, sorted behind them, and no span carries its
    document. Spans without a document, with a null key or a null place have a null text. A task holds one document.
    """
    if len(places) not in (2, 3):
        raise ValueError("a span is two byte offsets, or a line and two columns")
    cols = [F.col(f"`{k}`") for k in keys]
    order = [F.coalesce(F.col(f"`{p}`").cast("bigint"), F.lit(-1)).alias(f"__{i}") for i, p in enumerate(places)]
    held = F.struct(*[F.col(f"`{c}`") for c in spans.columns])
    mine = spans.select(*cols, F.lit(1).alias("__side"), *order, held.alias("__span"), F.lit(None).cast("string").alias("__text"))
    none = [F.lit(0).cast("bigint").alias(f"__{i}") for i in range(len(places))]
    text = docs.select(*cols, F.lit(0).alias("__side"), *none, F.lit(None).cast(mine.schema["__span"].dataType).alias("__span"), F.col(f"`{content}`").cast("string").alias("__text"))
    at = [f"__{i}" for i in range(len(places))]
    laid = text.unionByName(mine).repartition(*cols).sortWithinPartitions(*cols, "__side", *at)
    schema = T.StructType([T.StructField("s", mine.schema["__span"].dataType), T.StructField("t", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, directory = None, None
        for b in batches:
            rows, found = [], []
            side, texts = b.column("__side").to_pylist(), b.column("__text")
            where = list(zip(*[b.column(c).to_pylist() for c in at]))
            for i, own in enumerate(zip(*[b.column(k).to_pylist() for k in keys])):
                if own != key:
                    key, directory = own, None
                if not side[i]:
                    if directory is None and texts[i].is_valid and None not in own:
                        directory = Directory(texts[i].as_py())
                    continue
                rows.append(i)
                known = directory is not None and min(where[i]) >= 0
                found.append((directory.bytes if len(places) == 2 else directory.place)(*where[i]) if known else None)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("__span").take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["s", "t"])

    return laid.mapInArrow(run, schema).select("s.*", F.col("t").alias(into))
