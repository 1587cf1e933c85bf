"""Prefix scans over ordered blocks: what all blocks before a block come to, by any associative merge.

Spark's windows sum numbers; here a block's summary may be any object (a map of states, a stack). Blocks are sorted by
ranges and laid together in runs of consecutive ones, whatever their numbers are; runs are folded side by side, their
summaries walked through one after the other, and then each run's blocks from the run's start on. So a task holds a run
of summaries, or one summary and what came before it, never a document's text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import written

WIDTH = 64  # blocks of a run
ROWS_A_TASK = 1 << 14  # blocks that a task folds


def exclusive_scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    fold: Callable[[Iterable[Any]], Any],
    walk: Callable[[Any, Iterable[Any]], Iterator[Any]],
    of: Callable[[Any, Any], Any] = lambda before, own: before,
    width: int = WIDTH,
) -> DataFrame:
    """``keys``, ``order`` and ``before``: what ``of`` makes of all that comes before a block, and of its own summary, pickled.

    ``df`` has ``keys``, ``order`` (numbers, ascending; repeated ones in no defined order) and ``summary``, pickled.
    ``fold`` puts consecutive summaries together. ``walk(before, summaries)`` gives, for each of consecutive ones, what is
    before it, beginning with ``before`` (None at a document's start); it need give no more than that summary can ask for.
    """
    spark = df.sparkSession
    slim = df.select(*keys, order, "summary")
    tasks = max(spark.sparkContext.defaultParallelism, -(-slim.count() // ROWS_A_TASK))
    first = T.StructField("__first", slim.schema[order].dataType)
    runs = T.StructType([*[slim.schema[k] for k in keys], first, *T._parse_datatype_string("__orders array<bigint>, __own array<binary>, summary binary")])

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, orders, held = None, [], []

        def run() -> pa.RecordBatch:
            folded = pickle.dumps(fold(map(pickle.loads, held)))
            values = [*group, orders[0], orders, held, folded]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], runs.names)

        for b in batches:
            types = [*[b.column(k).type for k in [*keys, order]], pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
            for *own, no, summary in zip(*[b.column(k).to_pylist() for k in [*keys, order, "summary"]]):
                if held and (own != group or len(held) == width):
                    yield run()
                    orders, held = [], []
                group = own
                orders.append(no)
                held.append(summary)
        if held:
            yield run()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(k).to_pylist() for k in [*keys, "summary"]], (b.slice(i, 1) for i in range(b.num_rows))))
        held = next(rows, None)
        while held is not None:
            group, behind, asked = held[:-2], None, []

            def own(row: tuple | None) -> Iterator[Any]:
                nonlocal behind
                while row is not None and row[:-2] == group:
                    asked.append(row[-1])
                    yield pickle.loads(row[-2])
                    row = next(rows, None)
                behind = row

            for before in walk(None, own(held)):
                at = asked.pop()
                yield pa.RecordBatch.from_arrays([*[at.column(k) for k in [*keys, "__first"]], pa.array([pickle.dumps(before)], pa.binary())], [*keys, "__first", "before"])
            held = behind

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (orders, held, before) in enumerate(zip(*[b.column(k).to_pylist() for k in ("__orders", "__own", "before")])):
                own = [pickle.loads(x) for x in held]
                found = [pickle.dumps(of(x, y)) for x, y in zip(walk(pickle.loads(before), own), own)]
                here = pa.array([i] * len(own), pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(here) for k in keys], pa.array(orders, b.column("__first").type), pa.array(found, pa.binary())], out.names)

    by_run = [*keys, "__first"]
    before_runs = T.StructType([*[runs[k] for k in by_run], T.StructField("before", T.BinaryType())])
    out = T.StructType([*[slim.schema[k] for k in [*keys, order]], T.StructField("before", T.BinaryType())])
    packed = written(slim.repartitionByRange(tasks, *keys, order).sortWithinPartitions(*keys, order).mapInArrow(laid, runs))
    ahead = packed.select(*by_run, "summary")
    ahead = (ahead.repartition(*keys) if keys else ahead.repartition(1)).sortWithinPartitions(*by_run).mapInArrow(starts, before_runs)
    return packed.select(*by_run, "__orders", "__own").join(ahead, by_run).mapInArrow(within, out)

