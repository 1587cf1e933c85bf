"""The ``markup`` data source: files of markup as event rows, with the event kinds pushed into the scan.

``spark.read.format("markup").option("path", folder).load()`` reads every file below a folder, each as a document. As a
stream, files that appear are read once each, in whatever order of names; the offset has the names of all files read, so it
grows with them: where files come without end, ``stream_documents`` has Spark keep the log. Files are read on the executors, small ones several to a task, in pieces and as Arrow batches. Paths with a
scheme are opened by Arrow's file systems; ``binary_documents`` uses Spark's.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..functions.udtf import payload_columns, payload_fields
from ..operators.lexer import BARE, FLAT, FULL, Lexer
from ..schema import EventType, kinds_in, mask_of

CHUNK = 1 << 16
TASK_BYTES = 16 << 20  # of small files that one task reads
AT_ONCE = 10_000  # events of a batch


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """``path, content``: each file below ``path`` as a document, by any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.selectExpr("path", "content")


def stream_documents(spark: SparkSession, path: str, max_files: int = 1000, max_age: str = "7d") -> DataFrame:
    """``path, content`` of files as they appear below ``path``, each once, ``max_files`` a batch at most.

    Admission is Spark's: the checkpoint's log of files, which it compacts, so an offset is a number however many files
    there were. The driver remembers files for ``max_age`` behind the newest one; what appears with an older time is
    passed over. Events of such a stream come by ``operators.events`` like those of any other.
    """
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    options = {"recursiveFileLookup": "true", "maxFilesPerTrigger": str(max_files), "maxFileAge": max_age}
    return spark.readStream.format("binaryFile").options(**options).schema(kinds).load(path).select("path", "content")


def _system(path: str) -> tuple[fs.FileSystem | None, str]:
    """Arrow's file system for a path with a scheme; none for a path of this machine."""
    if path.startswith("file:"):
        return None, "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (None, path)


def _files(path: str) -> dict[str, int]:
    """Files below a path (or that a pattern names) with their sizes, in the order of their names."""
    system, at = _system(path)
    if system is not None:
        prefix = path[: len(path) - len(at)]
        info = system.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, allow_not_found=True, recursive=True))
        return {prefix + f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File}
    if os.path.isfile(at):
        return {at: os.path.getsize(at)}
    pattern = os.path.join(glob.escape(at), "**", "*") if os.path.isdir(at) else at
    return {f: os.path.getsize(f) for f in sorted(glob.glob(pattern, recursive=True)) if os.path.isfile(f)}


def _pieces(path: str, chunk: int) -> Iterator[bytes]:
    system, at = _system(path)
    with open(at, "rb") if system is None else system.open_input_stream(at) as f:
        while piece := f.read(chunk):
            yield piece


def open_input(path: str):  # noqa: ANN201 - a binary file, of Python or of Arrow
    """A file for reading with seeks."""
    system, at = _system(path)
    return open(at, "rb") if system is None else system.open_input_file(at)


def detail_of(columns: list[str], payload: str) -> str:
    """What a lexer has to build for these columns: nothing, nodes without their lists, or whole entities."""
    if set(columns) <= {"path", "seq", "event_type", "event_mask"}:
        return BARE
    return FULL if payload == "full" and "tag" in columns else FLAT


def read_files(paths: list[str], mask: int, chunk: int = CHUNK, payload: str = "full", compat: bool = False, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the files' events, ``path`` first or the ``columns`` that are asked for; what isn't, isn't built.

    Memory holds a batch, a piece and what it leaves open.
    """
    names = columns or ["path", *[f.name for f in payload_fields(payload)]]
    lexer = Lexer(mask, compat, detail_of(names, payload))
    found: list = []
    owners: list[tuple[str, int]] = []

    def flush() -> pa.RecordBatch:
        of = np.repeat(np.array([p for p, _ in owners], object), [n for _, n in owners])
        built = {"path": pa.array(of, pa.string()), **payload_columns(found, payload, names)}
        return pa.RecordBatch.from_arrays([built[c] for c in names], names)

    for path in paths:
        lexer.reset()
        for piece in _with_end(_pieces(path, chunk)):
            own = lexer.end() if piece is None else lexer.write(piece)
            if own:
                found += own
                owners.append((path, len(own)))
            if len(found) >= AT_ONCE:
                yield flush()
                found, owners = [], []
    if found:
        yield flush()


def _with_end(pieces: Iterator[bytes]) -> Iterator[bytes | None]:
    yield from pieces
    yield None


class _Group(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


def _grouped(files: dict[str, int], task_bytes: int) -> list[InputPartition]:
    """Files in order, as many to a group as ``task_bytes`` allow; one file is never split, as it is one document."""
    out: list[list[str]] = []
    held = task_bytes + 1
    for path, size in files.items():
        if held + size > task_bytes:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return [_Group(g) for g in out]


class MarkupReader(DataSourceReader):
    def __init__(self, path: str, mask: int, chunk: int, payload: str = "full", task_bytes: int = TASK_BYTES, compat: bool = False, columns: list[str] | None = None):
        self.path, self.mask, self.chunk, self.payload, self.task_bytes, self.compat, self.columns = path, mask, chunk, payload, task_bytes, compat, columns

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on ``event_type`` and ``event_mask``; Spark evaluates the others."""
        for f in filters:
            values = f.value if isinstance(f, In) else [f.value] if isinstance(f, EqualTo) else None
            if values is not None and f.attribute == ("event_type",):
                known = [v for v in values if v in EventType.__members__]
                self.mask &= mask_of(known) if known else 0
            elif values is not None and f.attribute == ("event_mask",):
                self.mask &= sum({int(v) for v in values if int(v) in {int(e) for e in EventType}})
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return _grouped(_files(self.path), self.task_bytes) if self.mask else []

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, _Group):
            yield from read_files(partition.paths, self.mask, self.chunk, self.payload, self.compat, self.columns)


class MarkupStreamReader(DataSourceStreamReader):
    """The offset has all files that were there, so a later one is new whatever its name or time.

    The driver lists files; tasks read them. Offsets of earlier versions have the last name read (``after``): what sorts up
    to it counts as read.
    """

    def __init__(self, path: str, mask: int, chunk: int, payload: str = "full", task_bytes: int = TASK_BYTES, compat: bool = False, columns: list[str] | None = None):
        self.path, self.mask, self.chunk, self.payload, self.task_bytes, self.compat, self.columns = path, mask, chunk, payload, task_bytes, compat, columns
        self.seen: set[str] = set()

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        self.seen.update(_files(self.path))  # a file that is gone stays read
        return {"seen": sorted(self.seen)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, seen = start.get("after", ""), set(start.get("seen", ()))
        new = {p for p in end.get("seen", ()) if p > after and p not in seen}
        there = _files(self.path)
        if end.get("after", "") > after:  # a batch that an earlier version planned
            new |= {p for p in there if after < p <= end["after"]}
        gone = new - set(there)
        if gone:
            raise FileNotFoundError(f"files of a planned batch are gone: {', '.join(sorted(gone)[:5])}")
        return _grouped({p: size for p, size in there.items() if p in new}, self.task_bytes)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, _Group)
        yield from read_files(partition.paths, self.mask, self.chunk, self.payload, self.compat, self.columns)

    def commit(self, end: dict) -> None:
        pass


class MarkupSource(DataSource):
    """Options: ``path``, ``events`` (a mask, or kinds' names with commas), ``payload`` (``full``: whole entities, or ``flat``),
    ``chunk`` (bytes of a piece), ``taskBytes`` (of small files that a task reads), ``compat`` (``true``: see ``Lexer``).

    A read with a ``schema`` of some of the columns has these alone, and only what they need is built."""

    @classmethod
    def name(cls) -> str:
        return "markup"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("path", T.StringType()), *payload_fields(self.options.get("payload", "full"))])

    def _arguments(self) -> tuple[str, int, int, str, int, bool]:
        if "path" not in self.options:
            raise ValueError("the markup source needs a path")
        events = self.options.get("events")
        mask = mask_of(None if events is None else int(events) if events.isdigit() else [e.strip() for e in events.split(",")])
        o = self.options
        return o["path"], mask, int(o.get("chunk", CHUNK)), o.get("payload", "full"), int(o.get("taskBytes", TASK_BYTES)), o.get("compat", "false").lower() == "true"

    def _columns(self, schema: T.StructType) -> list[str]:
        whole = {f.name: f.dataType for f in self.schema()}
        wrong = [f.name for f in schema if whole.get(f.name) != f.dataType]
        if wrong:
            raise ValueError(f"the markup source has no such columns: {', '.join(wrong)}")
        return schema.fieldNames()

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MarkupReader(*self._arguments(), self._columns(schema))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return MarkupStreamReader(*self._arguments(), self._columns(schema))


def register(spark: SparkSession) -> None:
    """Make ``format("markup")`` known to the session, with filters pushed into its scans."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MarkupSource)


__all__ = ["MarkupSource", "binary_documents", "kinds_in", "read_files", "register", "stream_documents"]
