"""Events of documents as DataFrames: the tagged union, and one flat relation for each kind."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TAG_KINDS, TEXT_KINDS, EventType, event_fields, mask_of
from .lexer import BARE, EMPTY, FLAT, FULL, OPEN, Attr, AttributeLexer, Lexer, ProcInst, Tag, TextNode

AT_ONCE = 20_000  # events of a batch

_POSITION = pa.struct([("line", pa.int64()), ("character", pa.int64())])
_OFFSETS = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_TEXT = pa.struct([("start", _POSITION), ("end", _POSITION), ("value", pa.string()), ("byte_offsets", _OFFSETS)])
_ATTR = pa.struct([("name", _TEXT), ("value", _TEXT), ("type", pa.int32()), ("byte_offsets", _OFFSETS)])
_NO_TEXT = EMPTY
_NO_ATTR = Attr(EMPTY, EMPTY, 0, 0, 0)
_NO_TAG = Tag("", (), (), False, (0, 0), (0, 0), (0, 0), (0, 0), 0, 0)
_NO_PI = ProcInst(EMPTY, EMPTY, (0, 0), (0, 0), 0, 0)


def _longs(values: list) -> pa.Array:
    return pa.array(values, pa.int64())


def _struct(columns: dict[str, pa.Array], missing: np.ndarray | None = None) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=None if missing is None else pa.array(missing))


def _positions(at: list) -> pa.StructArray:
    return _struct({"line": _longs([x[0] for x in at]), "character": _longs([x[1] for x in at])})


def _ranges(items: list) -> pa.StructArray:
    return _struct({"start": _longs([x.byte_start for x in items]), "end": _longs([x.byte_end for x in items])})


def _texts(nodes: list[TextNode], missing: np.ndarray | None = None) -> pa.StructArray:
    return _struct(
        {
            "start": _positions([x.start for x in nodes]),
            "end": _positions([x.end for x in nodes]),
            "value": pa.array([x.value for x in nodes], pa.string()),
            "byte_offsets": _ranges(nodes),
        },
        missing,
    )


def _attributes(attrs: list[Attr], missing: np.ndarray | None = None) -> pa.StructArray:
    return _struct(
        {
            "name": _texts([x.name for x in attrs]),
            "value": _texts([x.value for x in attrs]),
            "type": pa.array([x.type for x in attrs], pa.int32()),
            "byte_offsets": _ranges(attrs),
        },
        missing,
    )


def _lists(lists: list[tuple], build: Callable[[list], pa.Array]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), build([y for x in lists for y in x]))


def _tags(tags: list[Tag], missing: np.ndarray | None = None) -> pa.StructArray:
    return _struct(
        {
            "name": pa.array([x.name for x in tags], pa.string()),
            "attributes": _lists([x.attributes for x in tags], _attributes),
            "text_nodes": _lists([x.text_nodes for x in tags], _texts),
            "self_closing": pa.array([x.self_closing for x in tags], pa.bool_()),
            "open_start": _positions([x.open_start for x in tags]),
            "open_end": _positions([x.open_end for x in tags]),
            "close_start": _positions([x.close_start for x in tags]),
            "close_end": _positions([x.close_end for x in tags]),
            "byte_offsets": _ranges(tags),
        },
        missing,
    )


def _instructions(items: list[ProcInst], missing: np.ndarray | None = None) -> pa.StructArray:
    return _struct(
        {
            "start": _positions([x.start for x in items]),
            "end": _positions([x.end for x in items]),
            "target": _texts([x.target for x in items]),
            "content": _texts([x.content for x in items]),
            "byte_offsets": _ranges(items),
        },
        missing,
    )


ENTITIES = ("text", "attribute", "tag", "proc_inst")


def event_columns(found: list[tuple[int, int, object]], entities: tuple[str, ...] = ENTITIES) -> list[pa.Array]:
    """The columns of ``event_fields`` for lexed events, of the entities that are asked for."""

    def of(kind: type, nothing: object, build: Callable) -> pa.StructArray:
        missing = np.array([not isinstance(e, kind) for _, _, e in found], bool)
        return build([e if isinstance(e, kind) else nothing for _, _, e in found], missing)

    names = {int(e): e.name for e in EventType}
    return [
        _longs([n for n, _, _ in found]),
        pa.array([names[m] for _, m, _ in found], pa.string()),
        pa.array([m for _, m, _ in found], pa.int32()),
        *[of(*_BUILD[e]) for e in ENTITIES if e in entities],
    ]


_BUILD = {"text": (TextNode, _NO_TEXT, _texts), "attribute": (Attr, _NO_ATTR, _attributes), "tag": (Tag, _NO_TAG, _tags), "proc_inst": (ProcInst, _NO_PI, _instructions)}


def _text_columns(found: list) -> list[pa.Array]:
    nodes = [e for _, _, e in found]
    return [
        pa.array([x.value for x in nodes], pa.string()),
        *[_longs(v) for v in ([x.start[0] for x in nodes], [x.start[1] for x in nodes], [x.end[0] for x in nodes], [x.end[1] for x in nodes])],
        _longs([x.byte_start for x in nodes]),
        _longs([x.byte_end for x in nodes]),
    ]


def _tag_columns(found: list) -> list[pa.Array]:
    tags = [e for _, _, e in found]
    return [
        pa.array([x.name for x in tags], pa.string()),
        _longs([len(x.attributes) for x in tags]),
        _longs([len(x.text_nodes) for x in tags]),
        pa.array([x.self_closing for x in tags], pa.bool_()),
        pa.array([x.implicit for x in tags], pa.bool_()),
        *[_longs([getattr(x, f)[k] for x in tags]) for f in ("open_start", "open_end", "close_start", "close_end") for k in (0, 1)],
        _longs([x.byte_start for x in tags]),
        _longs([x.byte_end for x in tags]),
    ]


def _attribute_columns(found: list) -> list[pa.Array]:
    attrs = [e for _, _, e in found]
    return [
        pa.array([x.name.value for x in attrs], pa.string()),
        pa.array([x.value.value for x in attrs], pa.string()),
        pa.array([x.type for x in attrs], pa.int32()),
        *[_longs([getattr(getattr(x, f), e)[k] for x in attrs]) for f in ("name", "value") for e in ("start", "end") for k in (0, 1)],
        _longs([x.byte_start for x in attrs]),
        _longs([x.byte_end for x in attrs]),
    ]


def _value_columns(found: list) -> list[pa.Array]:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
    return [pa.array(x, k) for x, k in zip(zip(*found), kinds)]


def _instruction_columns(found: list) -> list[pa.Array]:
    items = [e for _, _, e in found]
    return [
        pa.array([x.target.value for x in items], pa.string()),
        pa.array([x.content.value for x in items], pa.string()),
        *[_longs([getattr(x, e)[k] for x in items]) for e in ("start", "end") for k in (0, 1)],
        _longs([x.byte_start for x in items]),
        _longs([x.byte_end for x in items]),
    ]


_SPAN = "start_line bigint, start_char bigint, end_line bigint, end_char bigint, byte_start bigint, byte_end bigint"
_FLAT: dict[str, tuple[Callable, str]] = {k: (_text_columns, f"value string, {_SPAN}") for k in TEXT_KINDS}
_FLAT |= {
    k: (
        _tag_columns,
        "name string, n_attributes bigint, n_text_nodes bigint, self_closing boolean, implicit boolean, open_start_line bigint, open_start_char bigint,"
        " open_end_line bigint, open_end_char bigint, close_start_line bigint, close_start_char bigint, close_end_line bigint, close_end_char bigint,"
        " byte_start bigint, byte_end bigint",
    )
    for k in TAG_KINDS
}
_FLAT["Attribute"] = (
    _attribute_columns,
    "name string, value string, attr_type int, name_start_line bigint, name_start_char bigint, name_end_line bigint, name_end_char bigint,"
    " value_start_line bigint, value_start_char bigint, value_end_line bigint, value_end_char bigint, byte_start bigint, byte_end bigint",
)
_FLAT["ProcessingInstruction"] = (_instruction_columns, f"target string, content string, {_SPAN}")


def _lexed(
    df: DataFrame, content: str, keep: list[str] | None, lexer_of: Callable[[], Lexer], columns: Callable[[list], list[pa.Array]], fields: list[T.StructField], read: Callable = Lexer.parse
) -> DataFrame:
    """``keep`` and ``fields`` of what ``read`` gives of each document: they are lexed where they are, without a shuffle."""
    keep = [c for c in df.columns if c != content] if keep is None else keep
    slim = df.select(F.col(f"`{content}`").alias("__content"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    schema = T.StructType([*[T.StructField(f"__k{i}", slim.schema[f"__k{i}"].dataType) for i in range(len(keep))], *fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = lexer_of()
        for b in batches:
            found: list = []
            rows: list[int] = []

            def flush() -> pa.RecordBatch:
                at = pa.array(rows, pa.int64())
                return pa.RecordBatch.from_arrays([*[b.column(f"__k{i}").take(at) for i in range(len(keep))], *columns(found)], names)

            for i, x in enumerate(b.column("__content")):
                own = read(lexer, x.as_py() if x.is_valid else None)
                found += own
                rows += [i] * len(own)
                if len(found) >= AT_ONCE:
                    yield flush()
                    found, rows = [], []
            if found:
                yield flush()

    out = slim.mapInArrow(run, schema)
    return out.withColumnsRenamed({f"__k{i}": c for i, c in enumerate(keep)})


def markup_events(df: DataFrame, content: str = "content", keep: list[str] | None = None, events=None, compat: bool = False, entities: tuple[str, ...] | list[str] = ENTITIES) -> DataFrame:
    """Every event of every document as a row: ``keep`` columns, then ``event_fields``.

    Of the entity columns only ``entities`` are built and returned; what isn't read needn't be built.

    ``content`` is a string or binary column. ``events`` (a mask, kinds' names, or several) is applied while lexing.
    ``seq`` counts a document's events of all kinds, so ordering by it gives the order of completion whatever the
    mask. Null and empty documents have no events; rows are documents, repeated or not.
    """
    entities = tuple(entities)
    fields = [f for f in event_fields() if f.name not in ENTITIES or f.name in entities]
    mask, detail = mask_of(events), FULL if entities else BARE
    return _lexed(df, content, keep, lambda: Lexer(mask, compat, detail), lambda found: event_columns(found, entities), fields)


def relation(df: DataFrame, kind: str, content: str = "content", keep: list[str] | None = None, compat: bool = False) -> DataFrame:
    """The events of one kind with flat columns: ``keep``, ``seq``, then the kind's own."""
    columns, ddl = _FLAT[kind]
    fields = [T.StructField("seq", T.LongType()), *T._parse_datatype_string(ddl)]
    # older consumers get declarations with the code of CDATA: both are asked for by their own kind here
    return _lexed(df, content, keep, lambda: Lexer(mask_of(kind), compat, FLAT), lambda found: [_longs([n for n, _, _ in found]), *columns(found)], fields)


def text_events(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Text runs: split at line breaks, continuation lines without leading blanks, and closing tags without an element."""
    return relation(df, "Text", content, keep)


def comments(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "Comment", content, keep)


def cdata(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "Cdata", content, keep)


def doctypes(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "Doctype", content, keep)


def declarations(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "Declaration", content, keep)


def processing_instructions(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "ProcessingInstruction", content, keep)


def open_tag_starts(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "OpenTagStart", content, keep)


def open_tags(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    return relation(df, "OpenTag", content, keep)


def close_tags(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Elements as they close, inner ones first; ``implicit`` if an outer closing tag closed them."""
    return relation(df, "CloseTag", content, keep)


def attributes(df: DataFrame, content: str = "content", keep: list[str] | None = None, places: bool = True) -> DataFrame:
    """Attributes; without ``places`` only ``keep, seq, name, value, attr_type``, and no place is looked up."""
    if places:
        return relation(df, "Attribute", content, keep)
    fields = list(T._parse_datatype_string("seq bigint, name string, value string, attr_type int"))
    return _lexed(df, content, keep, lambda: AttributeLexer(False), _value_columns, fields)


def tag_attributes(events: DataFrame, keep: list[str]) -> DataFrame:
    """``keep, seq, tag_name, name, value, attr_type, byte_start, byte_end`` from OpenTag rows of ``markup_events``.

    ``seq`` is that of the attribute's own event: attributes come right before their tag.
    """
    tags = events.where("event_type = 'OpenTag'")
    out = tags.select(*keep, "seq", F.col("tag.name").alias("tag_name"), F.size("tag.attributes").alias("__n"), F.posexplode("tag.attributes").alias("__i", "a"))
    return out.select(
        *keep, (F.col("seq") - F.col("__n") + F.col("__i")).alias("seq"), "tag_name", F.col("a.name.value").alias("name"), F.col("a.value.value").alias("value"),
        F.col("a.type").alias("attr_type"), F.col("a.byte_offsets.start").alias("byte_start"), F.col("a.byte_offsets.end").alias("byte_end"),
    )


def unclosed_elements(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, name, byte_start, byte_end`` of elements still open at a document's end, which have no closing event.

    They are what is left on the lexer's stack, so rows are documents, repeated or not, and nothing is shuffled.
    """

    def read(lexer: Lexer, text: bytes | str | None) -> list[tuple[str, int, int]]:
        lexer.open_document(text)
        return lexer.unclosed()

    def columns(found: list[tuple[str, int, int]]) -> list[pa.Array]:
        return [pa.array([x[0] for x in found], pa.string()), _longs([x[1] for x in found]), _longs([x[2] for x in found])]

    fields = list(T._parse_datatype_string("name string, byte_start bigint, byte_end bigint"))
    return _lexed(df, content, keep, lambda: Lexer(OPEN, False, FLAT), columns, fields, read)
