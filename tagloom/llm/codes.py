"""Vector code compression: product codes whose codebooks are fitted by Lloyd's rounds with Elkan's bounds.

Vectors become integers and are cut into parts; each part position has a codebook of a few entries. What a round knows of
a vector is kept in the shared folder: its entries, per part an upper bound of the distance to its own entry, and a lower
bound to each entry. Bounds are shifted by what entries moved, and only entries that they leave open are measured, in
integers, so ties are exact and a pruned round assigns what a full one would.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import settle, unsettle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
LIMIT = 1 << 14  # components beyond are out of range: squares of parts of up to 256 components fit 64 bits
AT_ONCE = 1 << 20  # components that a task measures at once
SALTS = 32
FEW_LABELS = 100_000  # labels that are broadcast; more are joined

_STATE = "own binary, upper binary, lower binary"
_SUMS = "part int, entry int, n bigint, sums array<bigint>"


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]`` has the part's entries as rows; ``moved`` how far each came in the last round, rounded up."""

    entries: np.ndarray
    moved: np.ndarray
    unit: float  # of stored lower bounds

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _up(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 + 1e-12)


def _down(x: np.ndarray) -> np.ndarray:
    return np.sqrt(x.astype(np.float64)) * (1 - 1e-12)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return (d * d).sum(axis=-1)


@dataclass
class Bounds:
    """What is known of some vectors' parts: own entry, upper bound to it, lower bounds to all entries."""

    own: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    measured: int = 0  # distances that were needed

    @staticmethod
    def read(b: pa.RecordBatch, k: int, unit: float) -> Bounds:
        n = b.num_rows
        flat = [np.frombuffer(b"".join(b.column(c).to_pylist()), t) for c, t in (("own", np.uint8), ("upper", np.float32), ("lower", np.uint16))]
        return Bounds(flat[0].reshape(n, PARTS).astype(np.int64), flat[1].reshape(n, PARTS).astype(np.float64), flat[2].reshape(n, PARTS, k) * unit)

    def columns(self, unit: float) -> list[pa.Array]:
        """As bytes: upper bounds rounded up, lower ones rounded down to whole units."""
        upper = np.nextafter(self.upper.astype(np.float32), np.float32(np.inf))
        lower = np.clip(np.floor(self.lower / unit), 0, 65535).astype(np.uint16)
        return [pa.array([x.tobytes() for x in v], pa.binary()) for v in (self.own.astype(np.uint8), upper, lower)]


def first_bounds(x: np.ndarray, books: Codebooks) -> Bounds:
    """All distances of ``x`` (vector, part, component), measured."""
    d = np.stack([_squares(x[:, p, None, :], books.entries[p]) for p in range(PARTS)], axis=1)
    own = d.argmin(axis=2)  # of equals the first
    return Bounds(own, _up(np.take_along_axis(d, own[:, :, None], 2)[:, :, 0]), _down(d), d.size)


def next_bounds(x: np.ndarray, was: Bounds, books: Codebooks) -> Bounds:
    """The same after entries have moved: an entry is passed over only if it is farther than the own one for certain."""
    now = Bounds(was.own.copy(), was.upper.copy(), was.lower.copy())
    for p in range(PARTS):
        entries, own = books.entries[p], now.own[:, p]
        upper = now.upper[:, p] + books.moved[p][own]
        lower = np.maximum(now.lower[:, p] - books.moved[p], 0)
        half = _down(_squares(entries[:, None], entries[None])) / 2
        others = half + np.where(np.eye(len(entries)), np.inf, 0)
        rows = np.flatnonzero(~(upper < others.min(axis=1)[own]))
        mine = own[rows]
        exact = _squares(x[rows, p], entries[mine])
        upper[rows], lower[rows, mine] = _up(exact), _down(exact)
        u = upper[rows, None]
        near = ~(lower[rows] > u) & ~(others[mine] > u)
        near[np.arange(len(rows)), mine] = False
        r, c = np.nonzero(near)
        other = _squares(x[rows[r], p], entries[c])
        lower[rows[r], c] = _down(other)
        d = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
        d[np.arange(len(rows)), mine], d[r, c] = exact, other
        best = d.argmin(axis=1)  # of equals the first
        own[rows], upper[rows] = best, _up(d.min(axis=1)) if len(rows) else 0
        now.upper[:, p], now.lower[:, p] = upper, lower
        now.measured += len(rows) + len(r)
    return now


def quantised(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``key, label, q`` of rows with a whole vector: integers ``floor(SCALE * x)``."""
    v = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LIMIT))
    q = F.transform(v, lambda x: F.floor(x * SCALE).cast("int"))
    return df.where(v.isNotNull() & whole).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), q.alias("q"))


def _matrix(b: pa.RecordBatch, dims: int, width: int) -> np.ndarray:
    """Vectors of a batch as (vector, part, component), with zeros behind a length that parts don't divide."""
    out = np.zeros((b.num_rows, PARTS * width), np.int64)
    out[:, :dims] = np.asarray(b.column("q").flatten(), np.int64).reshape(b.num_rows, dims)
    return out.reshape(b.num_rows, PARTS, width)


def _assigned(state: DataFrame, books: Codebooks, dims: int, last: bool) -> DataFrame:
    """One assignment of all parts: the next state and sums by entry, or codes and errors after the ``last``."""
    kinds = {f.name: f.dataType.simpleString() for f in state.schema}
    first, width, k = "own" not in kinds, books.entries.shape[2], books.entries.shape[1]
    head = f"key {kinds['key']}, label {kinds['label']}"
    schema = f"{head}, code string, error bigint" if last else f"{head}, q array<int>, {_STATE}, {_SUMS}"
    step = max(1, AT_ONCE // max(1, dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                x = _matrix(b, dims, width)
                now = first_bounds(x, books) if first else next_bounds(x, Bounds.read(b, k, books.unit), books)
                if last:
                    error = sum(_squares(x[:, p], books.entries[p][now.own[:, p]]) for p in range(PARTS))
                    code = [bytes(r).hex() for r in now.own.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["key", "label", "code", "error"])
                    continue
                for p in range(PARTS):
                    np.add.at(sums[p], now.own[:, p], x[:, p])
                    count[p] += np.bincount(now.own[:, p], minlength=k)
                yield _rows([b.column(c) for c in ("key", "label", "q")] + now.columns(books.unit) + [None] * 4, b.num_rows)
        if not last:
            part, entry = np.nonzero(count)
            figures = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry], pa.int64()), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))]
            yield _rows([None] * 6 + figures, len(part))

    kinds_of = pa.schema(_arrow_fields(state, last))

    def _rows(columns: list, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else c.cast(f.type) for c, f in zip(columns, kinds_of)], kinds_of.names)

    return state.mapInArrow(run, schema)


def _arrow_fields(state: DataFrame, last: bool) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    own = [("q", pa.list_(pa.int32())), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]
    return [(c, to_arrow_type(state.schema[c].dataType)) for c in ("key", "label")] + ([] if last else own)


def _updated(sums: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the rounded-down means of their parts; entries of no part stay. As many rows come here as the codebooks have numbers."""
    entries = books.entries.copy()
    found = sums.select("part", "entry", "n", F.posexplode("sums").alias("at", "x")).groupBy("part", "entry", "at")
    for r in found.agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        entries[r.part, r.entry, r.at] = r.x // r.n
    return Codebooks(entries, _up(_squares(entries, books.entries)), books.unit)


def encode_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """``key, code, error, label_error, codebooks_sha256`` of every row with a whole vector.

    Vectors that are null, or hold null, non-finite or out-of-range components (``LIMIT`` and more) are left out, and so
    are those of another length than that of the least key's vector. Lengths that ``PARTS`` does not divide are filled
    up with zeros. Codebooks begin as the parts of the ``ENTRIES`` least keys (of equal keys the least vectors first, null
    keys last; all, if there are fewer). Repeated rows count as often as they come. An empty table, or one without a whole
    vector, has an empty result. Columns besides the three are not looked at.

    Each round reads the vectors and bounds that the last one wrote and writes its own; of what goes to the driver only
    the codebooks' sums are left. Labels, however common, are summed before they are joined.
    """
    spark = df.sparkSession
    rows = settle(quantised(df, key, vector, label))
    lead = rows.orderBy(F.col("key").asc_nulls_last(), "q").limit(1).collect()
    dims = len(lead[0].q) if lead else 0
    rows = rows.where(F.size("q") == dims)
    start = [r.q for r in rows.orderBy(F.col("key").asc_nulls_last(), "q").limit(ENTRIES).select("q").collect()]
    if not start:
        names = {f.name: f.dataType.simpleString() for f in rows.schema}
        return spark.createDataFrame([], f"key {names['key']}, code string, error bigint, label_error bigint, codebooks_sha256 string").withColumnRenamed("key", key)
    width = -(-dims // PARTS)
    whole = np.zeros((len(start), PARTS * width), np.int64)
    whole[:, :dims] = start
    entries = np.ascontiguousarray(whole.reshape(len(start), PARTS, width).transpose(1, 0, 2))
    spread = float(np.abs(entries).max(initial=0)) * max(1, width) ** 0.5
    books = Codebooks(entries, np.zeros(entries.shape[:2]), max(1.0, spread / (1 << 14)))
    state = rows
    for _ in range(rounds):
        written = settle(_assigned(state, books, dims, False))
        if state is not rows:
            unsettle(state)
        books = _updated(written.where("part is not null").select("part", "entry", "n", "sums"), books)
        state = written.where("part is null").select("key", "label", "q", "own", "upper", "lower")
    final = settle(_assigned(state, books, dims, True))
    return _with_label_errors(final).select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with its label's summed error. Few labels are broadcast; otherwise a label's rows are dealt to salts."""
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    salted = sums.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
