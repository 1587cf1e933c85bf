"""What events look like as JSON and as strings, and the text that an entity spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _offsets(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"))


def _text(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), _offsets(x["byte_offsets"]).alias("byteOffsets"))


def _attribute(x: Column) -> Column:
    return F.struct(_text(x["name"]).alias("name"), _text(x["value"]).alias("value"), x["type"].alias("type"), _offsets(x["byte_offsets"]).alias("byteOffsets"))


def text_json(x: Column) -> Column:
    """JSON of a text, keys in their fixed order."""
    return F.when(x.isNotNull(), F.to_json(_text(x)))


def attribute_json(x: Column) -> Column:
    return F.when(x.isNotNull(), F.to_json(_attribute(x)))


def proc_inst_json(x: Column) -> Column:
    s = F.struct(
        x["start"].alias("start"), x["end"].alias("end"), _text(x["target"]).alias("target"), _text(x["content"]).alias("content"), _offsets(x["byte_offsets"]).alias("byteOffsets")
    )
    return F.when(x.isNotNull(), F.to_json(s))


def tag_json(x: Column) -> Column:
    s = F.struct(
        x["open_start"].alias("openStart"), x["open_end"].alias("openEnd"), x["close_start"].alias("closeStart"), x["close_end"].alias("closeEnd"),
        x["name"].alias("name"), F.transform(x["attributes"], _attribute).alias("attributes"), F.transform(x["text_nodes"], _text).alias("textNodes"),
        x["self_closing"].alias("selfClosing"), _offsets(x["byte_offsets"]).alias("byteOffsets"),
    )
    return F.when(x.isNotNull(), F.to_json(s))


def event_json() -> Column:
    """JSON of an event row's entity, whichever it is."""
    return F.coalesce(text_json(F.col("text")), attribute_json(F.col("attribute")), tag_json(F.col("tag")), proc_inst_json(F.col("proc_inst")))


def attribute_string(x: Column) -> Column:
    """``name="value"``; the braces of an expression are kept inside the quotes."""
    value = x["value"]["value"]
    return F.when(x["type"] == 1, F.concat(x["name"]["value"], F.lit('="{'), value, F.lit('}"'))).otherwise(F.concat(x["name"]["value"], F.lit('="'), value, F.lit('"')))


def proc_inst_string(x: Column) -> Column:
    return F.concat(F.lit("<? "), x["target"]["value"], F.lit(" "), x["content"]["value"], F.lit(" ?>"))


def text_string(x: Column) -> Column:
    return x["value"]


def attribute_type_name(x: Column) -> Column:
    return F.when(x == 0, "NoValue").when(x == 1, "JSX").when(x == 2, "NoQuotes").when(x == 4, "SingleQuoted").when(x == 8, "DoubleQuoted")


def slice_bytes(content: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets of a document."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), (start + 1).cast("int"), (end - start).cast("int")), "UTF-8")


def slice_position(content: Column, line: Column, start: Column, end: Column) -> Column:
    """The text between two UTF-16 columns of a line."""
    row = F.element_at(F.split(content, "\n"), (line + 1).cast("int"))
    units = F.encode(row, "UTF-16LE")
    return F.decode(F.substring(units, (2 * start + 1).cast("int"), (2 * (end - start)).cast("int")), "UTF-16LE")
