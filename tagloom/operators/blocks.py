"""One document over many tasks: blocks of a document are lexed side by side, with the events of one reading of it all.

1. Each block is read from every state that it may begin in (``states``); a prefix scan of these maps gives the state
   that each block does begin in, and its place (byte, line, column).
2. So each block knows where its first construct or line ends. What is in front of that belongs to the block before,
   and the document is dealt out again as segments of whole constructs.
3. A segment's tags are folded against a stack that is not known yet: what remains are closing tags that found no
   element here, and elements that are still open. A second scan resolves these against what is open before.
4. Segments are lexed with their place, their stack and their first event's number.

A task holds a block or a segment, which is a block and the rest of its last construct, and of the elements open there
those that it closes, and the one that these stand in.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.prefix import exclusive_scan
from ..schema import ALL_EVENTS, mask_of
from ..session import written
from . import states, structure
from .events import _FLAT, AT_ONCE, _longs
from .lexer import BARE, CLOSE, FLAT, Lexer

BLOCK = 1 << 20  # characters, or bytes of a file
BLOCKS_A_TASK = 8

# ---- blocks


def text_blocks(df: DataFrame, keys: list[str], content: str = "content", size: int = BLOCK) -> DataFrame:
    """``keys, block_no, text``: documents of a row each in blocks of ``size`` characters. Null documents have no block."""
    slim = df.select(*[F.col(f"`{k}`") for k in keys], F.col(f"`{content}`").cast("string").alias("__text"))
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("block_no", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in enumerate(b.column("__text")):
                text = x.as_py() or ""
                for at in range(0, len(text), size):
                    yield pa.RecordBatch.from_arrays([*[b.column(k).slice(i, 1) for k in keys], _longs([at // size]), pa.array([text[at : at + size]])], schema.names)

    return slim.mapInArrow(run, schema)


def file_blocks(spark: SparkSession, path: str | list[str], size: int = BLOCK) -> DataFrame:
    """``path, block_no, text`` of UTF-8 files in blocks of ``size`` bytes, each read by its range; a character belongs to the block it begins in."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    ranges = files.where("length > 0").select("path", F.explode(F.expr(f"sequence(0L, (length - 1) div {size})")).alias("block_no"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.markup import open_input

        for b in batches:
            for path, no in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_input(path) as f:
                    f.seek(no * size)
                    raw = f.read(size + 3)
                first = 0
                while no and first < min(3, len(raw)) and raw[first] & 0xC0 == 0x80:
                    first += 1
                last = min(size, len(raw))
                while last < len(raw) and raw[last] & 0xC0 == 0x80:
                    last += 1
                text = raw[first:last].decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([path]), _longs([no]), pa.array([text], pa.string())], ["path", "block_no", "text"])

    # ranges are small rows with much work: a stated number of tasks is not put together at run time
    n = ranges.agg(F.count("*")).first()[0]
    return ranges.repartition(_tasks(n), F.col("path"), F.col("block_no")).mapInArrow(run, "path string, block_no bigint, text string")


def _tasks(n_blocks: int) -> int:
    return max(1, -(-n_blocks // BLOCKS_A_TASK))


def _tasks_of(read: DataFrame) -> int:
    """Tasks by the characters of blocks, which may be far smaller than ``BLOCK``; no fewer than there are cores, if blocks suffice."""
    n, size = read.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return max(_tasks(-(-size // BLOCK)), min(_tasks(n), read.sparkSession.sparkContext.defaultParallelism))


# ---- places and states


class _Measure(NamedTuple):
    """Bytes, line breaks, and UTF-16 units behind the last of these."""

    bytes: int = 0
    breaks: int = 0
    tail: int = 0


def _measured(text: str) -> _Measure:
    tail = text[text.rfind("\n") + 1 :]
    return _Measure(len(text.encode()), text.count("\n"), len(tail.encode("utf-16-le")) // 2)


def _further(m: _Measure, n: _Measure) -> _Measure:
    return _Measure(m.bytes + n.bytes, m.breaks + n.breaks, n.tail if n.breaks else m.tail + n.tail)


def _after(a: tuple[states.Block, _Measure], b: tuple[states.Block, _Measure]) -> tuple[states.Block, _Measure]:
    return states.compose(a[0], b[0]), _further(a[1], b[1])


class _Read(NamedTuple):
    """What is known of a block, or of consecutive ones, wherever they stand."""

    number: int
    block: states.Block
    size: _Measure


def _joined(run: Iterable[_Read]) -> _Read:
    return reduce(lambda a, b: _Read(a.number, *_after(a[1:], b[1:])), run)


class _Place(NamedTuple):
    """State and place where a block begins, and the last block before it where a segment does."""

    state: str
    at: _Measure
    owner: int


def _places(before: _Place | None, run: Iterable[_Read]) -> Iterator[_Place | None]:
    """The place of each block; None of a document's first, where a segment begins whatever the block holds."""
    for number, block, size in run:
        yield before
        state, at, owner = before or ("T", _Measure(), number)
        way = block.way(state)
        before = _Place(way.end, _further(at, size), owner if way.last is None else way.last)


def _cut(before: _Place | None, own: _Read) -> tuple:
    if before is None:
        return 0, False, 0, 0, 0, None
    way = own.block.way(before.state)
    return way.cut, way.skipping, *before.at, before.owner


def _summaries(df: DataFrame, keys: list[str], order: str, of: Callable[[dict], Any]) -> DataFrame:
    """``keys, order, size, summary``: what ``of`` gives of each row, pickled, and its characters."""
    schema = T.StructType([*[df.schema[k] for k in [*keys, order]], T.StructField("size", T.LongType()), T.StructField("summary", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            own = [pickle.dumps(of(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in [*keys, order]], _longs([len(r["text"]) for r in rows]), pa.array(own, pa.binary())], schema.names)

    return df.mapInArrow(run, schema)


def _placed(read: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, block_no, cut, skipping, byte, line, column, owner``: where a block begins, where in it a segment does (-1: nowhere), and the segment before that."""
    by = [*keys, "block_no"]
    more = "cut int, skipping boolean, byte bigint, line bigint, column bigint, owner bigint"
    schema = T.StructType([*[read.schema[k] for k in by], *T._parse_datatype_string(more)])
    kinds = [pa.int32(), pa.bool_(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [pickle.loads(x) for x in b.column("before").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in by], *[pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)]], schema.names)

    return exclusive_scan(read, keys, "block_no", _joined, _places, _cut).mapInArrow(run, schema)


def _segments(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``keys, segment, text, skipping, byte, line, column``: the document again, as runs of whole constructs; and in how many tasks."""
    by = [*keys, "block_no"]
    read = written(_summaries(blocks, keys, "block_no", lambda r: _Read(r["block_no"], states.read_block(r["text"], r["block_no"]), _measured(r["text"]))))
    tasks = _tasks_of(read)
    placed = _placed(read, keys)
    own = blocks.join(placed, by)
    head = F.when(F.col("cut") < 0, F.col("text")).otherwise(F.expr("substring(text, 1, cut)"))
    own = own.withColumns({"head": head, "tail": F.when(F.col("cut") >= 0, F.expr("substring(text, cut + 1)"))})
    units = F.octet_length(F.encode(F.substring_index("head", "\n", -1), "UTF-16LE")) / 2
    breaks = F.char_length("head") - F.char_length(F.translate("head", "\n", ""))
    place = F.struct(
        "skipping", (F.col("byte") + F.octet_length("head")).alias("byte"), (F.col("line") + breaks).alias("line"),
        (F.when(breaks > 0, 0).otherwise(F.col("column")) + units).cast("bigint").alias("column"),
    )
    none = F.lit(None).cast("struct<skipping:boolean,byte:bigint,line:bigint,column:bigint>")
    pieces = F.array(
        F.struct(F.col("owner").alias("segment"), F.col("block_no").alias("at"), F.col("head").alias("piece"), none.alias("place")),
        F.struct(F.col("block_no").alias("segment"), F.col("block_no").alias("at"), F.col("tail").alias("piece"), place.alias("place")),
    )
    found = own.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*").where("piece is not null and segment is not null and (piece <> '' or place is not null)")
    found = found.repartition(tasks, *keys, "segment")
    whole = found.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("x"), F.max("place").alias("place"))
    return whole.select(*keys, "segment", F.concat_ws("", F.transform("x", lambda x: x["piece"])).alias("text"), "place.*"), tasks


# ---- nesting


class Level(NamedTuple):
    """What follows a closing tag that no element here answers to (None: nothing of that kind): texts of whatever is open then, events, elements."""

    closing: str | None
    texts: int
    events: int
    opened: tuple[tuple, ...]


class Nesting(NamedTuple):
    """What a run of constructs does to a stack of open elements. At a document's start (``root``) nothing is open below.

    What is known before a run may leave out the elements that lie below all that the run closes: ``below`` is their number.
    """

    root: bool
    levels: tuple[Level, ...]
    below: int = 0


NOTHING = Nesting(False, (Level(None, 0, 0, ()),))
START = NOTHING._replace(root=True)


class _Stack:
    """A nesting that others are put behind, in time by what they hold and close, not by what is open."""

    def __init__(self, begun: Nesting) -> None:
        self.root, self.below = begun.root, begun.below
        *self.levels, (self.closing, self.texts, self.events, opened) = begun.levels
        self._open(opened)

    def _open(self, opened: Iterable[tuple]) -> None:
        self.opened: list[tuple] = []
        self.names: dict[str, int] = {}  # how many elements of a name are open
        self._push(opened)

    def _push(self, opened: Iterable[tuple]) -> None:
        for own in opened:
            self.opened.append(own)
            self.names[own[0]] = self.names.get(own[0], 0) + 1

    def nesting(self) -> Nesting:
        return Nesting(self.root, (*self.levels, Level(self.closing, self.texts, self.events, tuple(self.opened))), self.below)

    def add(self, b: Nesting) -> Nesting:
        """Puts ``b`` behind. What was there before, at a document's start: all that ``b`` closes, and the element that lies below."""
        events, low = self.events, len(self.opened)  # elements up to there are as they were, but for the texts of the last
        was: list[tuple] = []  # those beyond, inner ones first
        last: tuple | None = None  # the last as it was

        def add_texts(n: int) -> None:
            nonlocal last
            if n and self.opened:
                if len(self.opened) == low and last is None:
                    last = self.opened[-1]
                name, own, had, *rest = self.opened[-1]
                self.opened[-1] = (name, own, had + n, *rest)
            else:
                self.texts += n

        for level in b.levels:
            name = level.closing
            if name is not None:
                if self.names.get(name):
                    at = len(self.opened) - 1
                    while self.opened[at][0] != name:
                        at -= 1
                    self.events += len(self.opened) - at
                    for own in self.opened[at:]:
                        self.names[own[0]] -= 1
                    if at < low:
                        was += [last or self.opened[low - 1], *reversed(self.opened[at : low - 1])]
                        low, last = at, None
                    del self.opened[at:]
                elif self.root:  # it closes nothing and is a text
                    self.events += 1
                    add_texts(1)
                else:
                    self.levels.append(Level(self.closing, self.texts, self.events, tuple(self.opened)))
                    self.closing, self.texts, self.events = name, 0, 0
                    self._open(())
                    low = 0
            add_texts(level.texts)
            self.events += level.events
            self._push(level.opened)
        if low:
            was.append(last or self.opened[low - 1])
        return Nesting(True, (Level(None, 0, events, tuple(reversed(was))),), self.below + max(0, low - 1))


def nested(a: Nesting, b: Nesting) -> Nesting:
    """``a`` and ``b`` behind it. Closing tags of ``b`` take elements of ``a`` that no open question lies above."""
    return _joined_nestings([a, b])


def _joined_nestings(run: Iterable[Nesting]) -> Nesting:
    run = iter(run)
    stack = _Stack(next(run))
    for b in run:
        stack.add(b)
    return stack.nesting()


def _open_before(before: Nesting | None, run: Iterable[Nesting]) -> Iterator[Nesting]:
    """Of what is open before each of consecutive segments, as much as it closes or writes into."""
    stack = _Stack(before or START)
    for own in run:
        yield stack.add(own)


class _Folder(Lexer):
    """Reads a segment whose stack is not known, down to its ``Nesting``."""

    def __init__(self) -> None:
        super().__init__(CLOSE, False, FLAT)

    def nesting(self, row: dict) -> Nesting:
        _begin(self, row)
        self.levels: list[Level] = []
        self.closing: str | None = None
        self.texts = 0
        self._read(row["text"], True)
        self._leave()
        return Nesting(False, tuple(self.levels))

    def _leave(self) -> None:
        self.levels.append(Level(self.closing, self.texts, self.seq, tuple(map(tuple, self.stack))))

    def _closed(self, s: str, i: int, name: str, end: int) -> int:
        if self.open_names.get(name):
            return super()._closed(s, i, name, end)
        self._leave()
        self.stack, self.open_names = [], {}
        self.closing, self.texts, self.seq = name, 0, 0
        return end

    def _add_text(self, s: str, i: int, stop: int, value: str | None = None) -> None:
        self.texts += not self.stack
        super()._add_text(s, i, stop, value)


def _begin(lexer: Lexer, row: dict, before: Nesting = START) -> None:
    """Put a lexer at a segment's place, with what is open there."""
    lexer.reset()
    lexer.begun = row["byte"] > 0
    lexer.skipping = row["skipping"]
    lexer.byte, lexer.line, lexer.column = row["byte"], row["line"], row["column"]
    (level,) = before.levels
    lexer.seq, lexer.below = level.events, before.below
    for own in level.opened:
        lexer._push(list(own))


# ---- events


def split_documents(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Segments of documents with all that lexing them needs, for ``split_relation`` and its like; ``keys`` name a document.

    ``blocks`` has ``keys``, ``block_no`` (ascending within a document; numbers may be left out) and ``text``; cuts fall
    anywhere between characters. Null and empty blocks have nothing, and repeated numbers are in no defined order. Null
    keys are documents of their own, one for all rows that have them. Other columns are not looked at.
    """
    blocks = blocks.select(*keys, F.col("block_no").cast("bigint").alias("block_no"), "text").where("text <> '' and block_no is not null")
    blocks = blocks.select(*[F.struct(F.col(f"`{k}`").alias("of")).alias(k) for k in keys], "block_no", "text")  # nulls join and group like other values
    segments, tasks = _segments(blocks, keys)
    segments = written(segments)
    nestings = written(_summaries(segments, keys, "segment", lambda r: _Folder().nesting(r)))
    before = exclusive_scan(nestings, keys, "segment", _joined_nestings, _open_before)
    by = [*keys, "segment"]
    out = written(segments.repartition(tasks, *by).join(before.hint("merge"), by))  # in these tasks, however small either side is
    return out.select(*[F.col(k)["of"].alias(k) for k in keys], *[c for c in out.columns if c not in keys])


def _lexed_segments(split: DataFrame, keys: list[str], lexer_of: Callable[[], Lexer], columns: Callable[[list], list[pa.Array]], fields: list[T.StructField], read: Callable) -> DataFrame:
    schema = T.StructType([*[split.schema[k] for k in keys], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = lexer_of()
        names = schema.names
        for b in batches:
            for i, row in enumerate(b.to_pylist()):
                _begin(lexer, row, pickle.loads(row["before"]))
                found = read(lexer, row["text"])
                for at in range(0, len(found), AT_ONCE):
                    some = found[at : at + AT_ONCE]
                    here = pa.array([i] * len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[b.column(k).take(here) for k in keys], *columns(some)], names)

    return split.mapInArrow(run, schema)


def split_relation(split: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The events of one kind, as ``events.relation`` has them of whole documents."""
    columns, ddl = _FLAT[kind]
    fields = [T.StructField("seq", T.LongType()), *T._parse_datatype_string(ddl)]
    mask = mask_of(kind)
    return _lexed_segments(split, keys, lambda: Lexer(mask, False, FLAT), lambda found: [_longs([n for n, _, _ in found]), *columns(found)], fields, lambda lexer, text: lexer._read(text, True))


def split_events(split: DataFrame, keys: list[str], events=None) -> DataFrame:
    """``keys, seq, event_mask`` of all events that are asked for."""
    mask = mask_of(events) if events is not None else int(ALL_EVENTS)
    fields = list(T._parse_datatype_string("seq bigint, event_mask int"))
    return _lexed_segments(
        split, keys, lambda: Lexer(mask, False, BARE), lambda found: [_longs([n for n, _, _ in found]), pa.array([m for _, m, _ in found], pa.int32())], fields, lambda lexer, text: lexer._read(text, True)
    )


def split_parents(split: DataFrame, keys: list[str]) -> DataFrame:
    """``structure.element_parents`` of split documents."""
    return _lexed_segments(split, keys, structure.ParentLexer, structure.parent_columns, structure.parent_fields(), structure.ParentLexer.continued)
