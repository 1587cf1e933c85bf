"""Markup written from columns: the inverse of the event relations, as expressions.

There are no escapes in this grammar (references stay as they are), so a value is written in a form that can hold it, and
what no form can hold is null: better no document than another one. What is written is read back as it was.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AttributeType
from .scalars import NAME_START

_NAME = f"^[{NAME_START}][^=>/\\x00-\\x20]*$"


def _where(holds: Column, written: Column) -> Column:
    return F.when(holds, written)


def _plain(name: Column | str) -> Column:
    return F.lit(name) if isinstance(name, str) else name


def attribute(name: Column | str, value: Column | None = None, style: AttributeType | None = None) -> Column:
    """`` name="value"`` with the blank in front. Without a ``style`` the first of double quotes, single quotes and braces that can hold it.

    A null value is an attribute without one (as is no column), unless a style asks for a value.
    """
    name = _plain(name)
    whole = F.concat(F.lit(" "), _where(name.rlike(_NAME), name))
    if value is None:
        return whole
    v = value.cast("string")
    # braces end with the first that closes them, so a value between them has none of its own
    forms = {
        AttributeType.DoubleQuoted: _where(~v.contains('"'), F.concat(F.lit('"'), v, F.lit('"'))),
        AttributeType.SingleQuoted: _where(~v.contains("'"), F.concat(F.lit("'"), v, F.lit("'"))),
        AttributeType.JSX: _where(~v.rlike(r"[{}]"), F.concat(F.lit("{"), v, F.lit("}"))),
        AttributeType.NoQuotes: _where(v.rlike(r"^[^\x00-\x20>=\"'{][^ \t\n>]*$") & ~v.endswith("/"), v),
    }
    if style == AttributeType.NoValue:
        return whole
    if style is not None:
        return F.concat(whole, F.lit("="), forms[style])
    written = F.concat(whole, F.lit("="), F.coalesce(*[forms[k] for k in (AttributeType.DoubleQuoted, AttributeType.SingleQuoted, AttributeType.JSX)]))
    return F.when(v.isNull(), whole).otherwise(written)


def tag(name: Column | str, *attributes: Column, closed: bool = False) -> Column:
    """An opening tag, or an empty element. A blank goes before the slash, which no attribute takes along."""
    name = _plain(name)
    return F.concat(F.lit("<"), _where(name.rlike(_NAME), name), *attributes, F.lit(" />" if closed else ">"))


def element(name: Column | str, attributes: list[Column], *content: Column) -> Column:
    return F.concat(tag(name, *attributes), *content, F.lit("</"), _plain(name), F.lit(">"))


def fragment(*content: Column) -> Column:
    return F.concat(F.lit("<>"), *content, F.lit("</>"))


def text(value: Column) -> Column:
    """A text of one line or several, without anything that begins markup or ends in doing so."""
    v = value.cast("string")
    return _where(~v.rlike(f"<[!/?>{NAME_START}]") & ~v.endswith("<"), v)


def cdata(value: Column) -> Column:
    """Any text: where it holds the end of a section, that is divided between two."""
    return F.concat(F.lit("<![CDATA["), F.replace(value.cast("string"), F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


def comment(value: Column) -> Column:
    """A comment ends at the first ``-->``, also one that its own end makes with dashes before it."""
    v = value.cast("string")
    return _where(~F.concat(v, F.lit("--")).contains("-->"), F.concat(F.lit("<!--"), v, F.lit("-->")))


def instruction(target: Column | str, content: Column) -> Column:
    """An instruction ends at the first '>'; blanks around its content are not kept."""
    target, v = _plain(target), content.cast("string")
    holds = target.rlike(r"^[^>\x00-\x20]+$") & ~v.contains(">") & ~v.rlike(r"^[\x00-\x20]")
    return _where(holds, F.concat(F.lit("<?"), target, F.lit(" "), v, F.lit("?>")))


def declaration(keyword: str, content: Column) -> Column:
    v = content.cast("string")
    return _where(~v.contains(">") & ~v.rlike(r"^[\x00-\x20]") & (v != ""), F.concat(F.lit(f"<!{keyword} "), v, F.lit(">")))


def doctype(name: Column | str, *declarations: Column) -> Column:
    """A doctype with inner declarations in lines of their own."""
    inner = [F.concat(F.lit("\n  "), d) for d in declarations]
    name = _plain(name)
    return F.concat(F.lit("<!DOCTYPE "), _where(name.rlike(r"^[^>!\x00-\x20]+$"), name), F.lit(" ["), *inner, F.lit("\n]>"))
