"""SQL table functions: ``markup_events(content, mask[, compat])`` with flat rows, ``markup_entities`` with whole entities.

They give rows, not Arrow tables: Spark has no lateral join with table functions of the latter kind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..operators.events import ENTITIES, event_columns
from ..operators.lexer import Attr, Lexer, ProcInst, Tag, TextNode
from ..schema import EventType, event_fields, mask_of

DDL = (
    "seq bigint, event_type string, event_mask int, name string, value string, attr_type int, self_closing boolean, implicit boolean,"
    " start_line bigint, start_char bigint, end_line bigint, end_char bigint, byte_start bigint, byte_end bigint"
)
_KINDS = {"bigint": (pa.int64(), T.LongType()), "int": (pa.int32(), T.IntegerType()), "string": (pa.string(), T.StringType()), "boolean": (pa.bool_(), T.BooleanType())}
FLAT_FIELDS = [(name, *_KINDS[kind]) for name, kind in (x.split() for x in DDL.split(", "))]
PAYLOADS = ("full", "flat")


def flat_row(seq: int, mask: int, e: object) -> tuple:
    """An event as one flat row: name and value are what its kind has of them."""
    kind = EventType(mask).name
    if isinstance(e, TextNode):
        return (seq, kind, mask, None, e.value, None, None, None, *e.start, *e.end, e.byte_start, e.byte_end)
    if isinstance(e, Attr):
        end = e.name.end if e.type == 0 else e.value.end
        return (seq, kind, mask, e.name.value, e.value.value, e.type, None, None, *e.name.start, *end, e.byte_start, e.byte_end)
    if isinstance(e, ProcInst):
        return (seq, kind, mask, e.target.value, e.content.value, None, None, None, *e.start, *e.end, e.byte_start, e.byte_end)
    assert isinstance(e, Tag)
    end = e.close_end if kind == "CloseTag" and e.close_end != (0, 0) else e.open_end
    return (seq, kind, mask, e.name, None, None, e.self_closing, e.implicit, *e.open_start, *end, e.byte_start, e.byte_end)


def payload_fields(payload: str) -> list[T.StructField]:
    """Columns of an event: ``full`` has its entity as in ``schema.event_fields``, ``flat`` what ``DDL`` says."""
    if payload not in PAYLOADS:
        raise ValueError(f"a payload is one of {', '.join(PAYLOADS)}")
    return event_fields() if payload == "full" else [T.StructField(name, kind) for name, _, kind in FLAT_FIELDS]


def payload_columns(found: list, payload: str, columns: list[str] | None = None) -> dict[str, pa.Array]:
    """The same columns for lexed events, as Arrow arrays: those that are asked for, if it is said."""
    names = [f.name for f in payload_fields(payload) if columns is None or f.name in columns]
    if payload == "full" or not set(names) - {"seq", "event_type", "event_mask"}:
        entities = tuple(e for e in ENTITIES if e in names)
        built = dict(zip(["seq", "event_type", "event_mask", *entities], event_columns(found, entities)))
        return {c: built[c] for c in names}
    rows = list(zip(*[flat_row(*e) for e in found])) or [()] * len(FLAT_FIELDS)
    return {name: pa.array(list(c), kind) for c, (name, kind, _) in zip(rows, FLAT_FIELDS) if name in names}


def entity_row(seq: int, mask: int, e: object) -> tuple:
    """An event as a row of ``event_fields``: of its four entity columns one is set."""
    own = [_text_row(e), None, None, None] if isinstance(e, TextNode) else [None, None, None, None]
    if isinstance(e, Attr):
        own[1] = _attribute_row(e)
    elif isinstance(e, Tag):
        own[2] = (
            e.name, [_attribute_row(x) for x in e.attributes], [_text_row(x) for x in e.text_nodes], e.self_closing,
            e.open_start, e.open_end, e.close_start, e.close_end, (e.byte_start, e.byte_end),
        )
    elif isinstance(e, ProcInst):
        own[3] = (e.start, e.end, _text_row(e.target), _text_row(e.content), (e.byte_start, e.byte_end))
    return (seq, EventType(mask).name, mask, *own)


def _text_row(x: TextNode) -> tuple:
    return (x.start, x.end, x.value, (x.byte_start, x.byte_end))


def _attribute_row(x: Attr) -> tuple:
    return (_text_row(x.name), _text_row(x.value), x.type, (x.byte_start, x.byte_end))


class _Events:
    row = staticmethod(flat_row)

    def __init__(self):
        self.lexers: dict[tuple[int, bool], Lexer] = {}

    def eval(self, content: str, mask: int, compat: bool = False):
        key = mask_of(mask), bool(compat)
        for event in self.lexers.setdefault(key, Lexer(*key)).parse(content):
            yield self.row(*event)


class _Entities(_Events):
    row = staticmethod(entity_row)


def register(spark: SparkSession, name: str = "markup_events", entities: str = "markup_entities") -> None:
    """Make ``SELECT .. FROM docs, LATERAL markup_events(docs.content, 1023)`` work in this session's SQL."""
    spark.udtf.register(name, udtf(_Events, returnType=DDL))
    spark.udtf.register(entities, udtf(_Entities, returnType=T.StructType(event_fields())))
