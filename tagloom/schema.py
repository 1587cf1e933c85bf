"""Event kinds, attribute kinds and the fixed schema of events."""

from __future__ import annotations

from enum import IntEnum, IntFlag

from pyspark.sql import types as T


class EventType(IntFlag):
    """Kinds of events; a mask is their union. The bits."""

    Text = 1
    ProcessingInstruction = 2
    Declaration = 4
    Doctype = 8
    Comment = 16
    OpenTagStart = 32
    Attribute = 64
    OpenTag = 128
    CloseTag = 256
    Cdata = 512


class AttributeType(IntEnum):
    """How an attribute is written. The codes."""

    NoValue = 0
    JSX = 1
    NoQuotes = 2
    SingleQuoted = 4
    DoubleQuoted = 8


ALL_EVENTS = EventType(1023)
EVENT_NAMES = [e.name for e in EventType]
TEXT_KINDS = ("Text", "Declaration", "Doctype", "Comment", "Cdata")
TAG_KINDS = ("OpenTagStart", "OpenTag", "CloseTag")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


POSITION = _struct(line=T.LongType(), character=T.LongType())
BYTE_OFFSETS = _struct(start=T.LongType(), end=T.LongType())
TEXT = _struct(start=POSITION, end=POSITION, value=T.StringType(), byte_offsets=BYTE_OFFSETS)
ATTRIBUTE = _struct(name=TEXT, value=TEXT, type=T.IntegerType(), byte_offsets=BYTE_OFFSETS)
TAG = _struct(
    name=T.StringType(),
    attributes=T.ArrayType(ATTRIBUTE),
    text_nodes=T.ArrayType(TEXT),
    self_closing=T.BooleanType(),
    open_start=POSITION,
    open_end=POSITION,
    close_start=POSITION,
    close_end=POSITION,
    byte_offsets=BYTE_OFFSETS,
)
PROC_INST = _struct(start=POSITION, end=POSITION, target=TEXT, content=TEXT, byte_offsets=BYTE_OFFSETS)


def event_fields() -> list[T.StructField]:
    """Columns of an event, besides those that identify its document."""
    return [
        T.StructField("seq", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_mask", T.IntegerType()),
        T.StructField("text", TEXT),
        T.StructField("attribute", ATTRIBUTE),
        T.StructField("tag", TAG),
        T.StructField("proc_inst", PROC_INST),
    ]


def mask_of(events: int | str | EventType | list | tuple | set | None) -> int:
    """The bitmask of a mask, a kind's name or several of either; None is every kind. Unknown kinds raise an error."""
    if events is None:
        return int(ALL_EVENTS)
    if isinstance(events, str):
        if events not in EventType.__members__:
            raise ValueError(f"unknown event kind {events!r}; there are {', '.join(EVENT_NAMES)}")
        return int(EventType[events])
    if isinstance(events, int):
        if not 0 <= int(events) <= int(ALL_EVENTS):
            raise ValueError(f"a mask has bits up to {int(ALL_EVENTS)}")
        return int(events)
    mask = 0
    for e in events:
        mask |= mask_of(e)
    return mask


def kinds_in(mask: int) -> list[str]:
    """Names of the kinds that a mask asks for, in the order of their bits."""
    return [e.name for e in EventType if mask & e]
