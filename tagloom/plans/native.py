"""Events by Catalyst alone: tokens by one regular expression, relations by projections over them.

For documents within the expression's grammar these equal the exact lexer's. They need neither Python nor a shuffle.
Braces of expression attributes may nest to any depth: where they nest deeper than ``DEPTH``, which a regular expression
can follow, each brace gets a mark with its depth first, and a pair is a brace and the next one with an equal mark. What runs over a document's tokens in order (places, the stack of
open elements) is folded inside its row, by blocks of about the square root of their number: a fold copies what it has
gathered with each step, and by blocks that is little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import NAME_START

DEPTH = 8
# fixed values: characters that no text is to hold; one that does is followed by another mark, so marks stay apart
MARK, MARK_END, ESCAPED = "\ufdd0", "\ufdd1", "\ufdd2"
_NESTED = r"\{[^{}]*+\}"
for _ in range(DEPTH - 1):
    _NESTED = rf"\{{(?:[^{{}}]++|{_NESTED})*+\}}"


def _marked_braces(group: int) -> str:
    """Marked braces: a brace, its mark, and what follows up to an equal mark and a brace."""
    return rf"\{{({MARK}\d++{MARK_END})(?s:.*?)\{group}\}}"


# one alternative for each kind of token, in order; what begins but doesn't end is a lone '<'
def _token(braces: str) -> str:
    kinds = [
        r"<!--.*?-->",
        r"(?i:<!\[CDATA\[).*?\]\]>",
        r"(?i:<!doctype)[\x00-\x20]*+[^ \n\t\r>]*+[^!>]*+(?:![^>]*+>[^!>]*+)*+>",
        r"<!(?!--|(?i:\[CDATA\[|doctype))[^>]*+>",
        r"<\?[^>]*+>",
        r"</[^>]*+>",
        r"<>",
        rf"<[{NAME_START}](?:=[\x00-\x20]*+\"[^\"]*+\"|=[\x00-\x20]*+'[^']*+'|=[\x00-\x20]*+{braces}|[^>=]++|=(?![\x00-\x20]*+[{{\"']))*+>",
        rf"(?:[^<]++|<<|<(?![!/?>{NAME_START}<])(?!\z))(?:[^<]++|<<|<(?![!/?>{NAME_START}<])(?!\z))*+",
        r"<",
    ]
    return "(?s)" + "|".join(kinds)


def _attribute(braces: str) -> str:
    """An attribute, or a slash and the character that goes with it."""
    return (
        r"(?s)/[^>]|([^=>\x00-\x20/][^=> \t\n]*+|(?==))(?:[\x00-\x20]*+=[\x00-\x20]*+(?:\"([^\"]*+)\"|'([^']*+)'|"
        + braces
        + r"|([^> \t\n\"'{=][^> \t\n]*+)|(?=>)|=)|(?=[\x00-\x20>]))"
    )


def _deep(text: Column) -> Column:
    """Whether braces may nest deeper than ``DEPTH``: a text without that many opening ones cannot."""
    return F.char_length(text) - F.char_length(F.translate(text, "{", "")) > DEPTH


def _bind(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` evaluated once: a lambda's variable is, while a column may be put in wherever it is used."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(array: str, merge: str, zero: str) -> str:
    """For each element of an array what all elements before it come to, by ``merge`` of a and x.

    Blocks are merged first, then the blocks before each block, then each element's own block up to it.
    """
    fold = f"aggregate({{0}}, {{1}}, (a, x) -> {merge})"
    each = fold.format("slice(block, 1, j)", "element_at(pre, k + 1)")
    body = f"flatten(transform(blocks, (block, k) -> transform(block, (y, j) -> {each})))"
    body = _bind(f"transform(sums, (y, b) -> {fold.format('slice(sums, 1, b)', zero)})", "pre", body)
    body = _bind(f"transform(blocks, block -> {fold.format('block', zero)})", "sums", body)
    body = _bind("transform(sequence(0, cast((size(v) - 1) div w as int)), b -> slice(v, b * w + 1, w))", "blocks", body)
    return _bind(array, "v", _bind("cast(ceil(sqrt(size(v))) as int)", "w", body))


def _mark(text: str) -> str:
    """A text with a mark at each brace: how deep its pair lies, from running sums over the braces before it."""
    pieces = f"regexp_extract_all(replace({text}, '{MARK}', '{MARK}{ESCAPED}'), '[{{}}]|[^{{}}]++', 0)"
    steps = "transform(ps, x -> case x when '{' then 1 when '}' then -1 else 0 end)"
    mark = f"case x when '{{' then concat('{{{MARK}', 1000000000 + d[i], '{MARK_END}') when '}}' then concat('{MARK}', 999999999 + d[i], '{MARK_END}}}') else x end"
    marked = f"concat_ws('', transform(ps, (x, i) -> {mark}))"
    return _bind(pieces, "ps", f"if(size(ps) = 0, '', {_bind(_before(steps, 'a + x', '0'), 'd', marked)})")


def _unmark(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, f"{MARK}[0-9]+{MARK_END}", ""), F.lit(f"{MARK}{ESCAPED}"), F.lit(MARK))


def _without_bom(text: Column) -> Column:
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def token_array(content: str = "content") -> Column:
    """The document's tokens in order; from the first '<' on that begins what never ends, nothing is a token."""

    def ended(found: Column) -> Column:
        lone = F.array_position(found, "<")
        return F.when(lone > 0, F.slice(found, 1, (lone - 1).cast("int"))).otherwise(found)

    text = F.col(f"`{content}`").cast("string")
    plain = F.regexp_extract_all(_without_bom(text), F.lit(_token(_NESTED)), F.lit(0))
    marked = F.regexp_extract_all(_without_bom(F.expr(_mark(f"cast(`{content}` as string)"))), F.lit(_token(_marked_braces(1))), F.lit(0))
    found = F.when(_deep(text), F.transform(marked, _unmark)).otherwise(plain)
    # bound to a lambda's variable the expression is evaluated once, wherever it is used
    return F.element_at(F.transform(F.array(found), ended), 1)


def token_kind(token: Column) -> Column:
    """What a token is: the name of an event kind, or of what gives several."""
    head = F.lower(F.substring(token, 1, 9))
    return (
        F.when(~token.startswith("<"), "Text")
        .when(token.startswith("<!--"), "Comment")
        .when(head == "<![cdata[", "Cdata")
        .when(head == "<!doctype", "Doctype")
        .when(token.startswith("<!"), "Declaration")
        .when(token.startswith("<?"), "ProcessingInstruction")
        .when(token.startswith("</"), "CloseTag")
        .when((token == "<>") | token.rlike(f"^<[{NAME_START}]"), "OpenTag")
        .otherwise("Text")
    )


def tokens(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, token, kind``: a row per token; nothing is shuffled."""
    keep = [c for c in df.columns if c != content] if keep is None else keep
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode_outer(token_array(content)).alias("token_no", "token")).where("token is not null")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("token_no").cast("bigint").alias("token_no"), "token", token_kind(F.col("token")).alias("kind"))


def _of_kind(df: DataFrame, content: str, keep: list[str] | None, test: Column, *columns: Column) -> DataFrame:
    """``keep`` and ``columns`` of tokens that pass ``test`` on ``token``: each token is a row first, and rows are filtered."""
    keep = [c for c in df.columns if c != content] if keep is None else keep
    out = df.select(*[F.col(f"`{c}`") for c in keep], F.posexplode_outer(token_array(content)).alias("token_no", "token")).where(test)
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("token_no").cast("bigint").alias("token_no"), *columns)


def tag_name(token: Column) -> Column:
    return F.regexp_extract(token, r"^<([^>/ \n\t\r]*)", 1)


def closing_name(token: Column) -> Column:
    """The last word between '</' and '>', words being parted by blanks and what blanks follow them."""
    inner = F.regexp_extract(token, r"(?s)^</(.*)>$", 1)
    return F.regexp_extract(F.regexp_replace(inner, r" [\x00-\x20]*$", ""), r"(?s)((?:[^ ])*)$", 1)


def _is_open(token: Column) -> Column:
    return (token == "<>") | token.rlike(f"^<[{NAME_START}]")


def _attribute_tokens(token: str = "token") -> Column:
    """Everything between a tag's name and its end, as attributes in order."""

    def found(text: Column, braces: str) -> Column:
        inner = F.regexp_extract(text, r"(?s)^<[^>/ \n\t\r]*+(.*)$", 1)
        return F.filter(F.regexp_extract_all(inner, F.lit(_attribute(braces)), F.lit(0)), lambda x: ~x.startswith("/"))

    marked = F.transform(found(F.expr(_mark(token)), _marked_braces(4)), _unmark)
    return F.when(_deep(F.col(token)), marked).otherwise(found(F.col(token), _NESTED))


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def self_closing(token: str = "token") -> str:
    """SQL over a token's name: a slash before the '>', unless it belongs to the name of an attribute without a value."""

    def bare(text: str, braces: str) -> str:
        value = rf"(?s)=[\x00-\x20]*+(?:\"[^\"]*+\"|'[^']*+'|{braces})"
        return f"regexp_replace({text}, {_quoted(value)}, {_quoted(chr(61) + chr(39) * 2)})"

    deep = f"char_length({token}) - char_length(translate({token}, '{{', '')) > {DEPTH}"
    values = f"if({deep}, {bare(_mark(token), _marked_braces(1))}, {bare(token, _NESTED)})"
    named = r"(?s)[\x00-\x20][^=> \t\n/\"'][^=> \t\n\"']*/>$"
    return f"(endswith({token}, '/>') and not rlike({values}, {_quoted(named)}))"


def open_tags(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, name, self_closing``."""
    t = F.col("token")
    return _of_kind(df, content, keep, _is_open(t), tag_name(t).alias("name"), F.expr(self_closing()).alias("self_closing"))


def open_tag_counts(df: DataFrame, content: str = "content") -> DataFrame:
    """``name, n``: opening tags by name, summed before they are shuffled."""
    return open_tags(df, content, []).groupBy("name").agg(F.count("*").alias("n"))


def attributes(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, tag_name, attr_no, name, value, attr_type``."""
    keep = [c for c in df.columns if c != content] if keep is None else keep
    t = F.col("token")
    tags = _of_kind(df, content, keep, _is_open(t) & t.rlike(r"[\x00-\x20/]"), tag_name(t).alias("tag_name"), _attribute_tokens().alias("__found"))
    cols = [F.col(f"`{c}`") for c in keep]
    found = tags.select(*cols, "token_no", "tag_name", F.posexplode_outer("__found").alias("attr_no", "a")).where("a is not null")
    a = F.col("a")
    name = F.regexp_extract(a, r"^([^= \t\n>]*)", 1)
    value = F.regexp_replace(a, r"(?s)^[^= \t\n>]*+[\x00-\x20]*+=?[\x00-\x20]*+", "")
    has = a.contains("=")
    kind = (
        F.when(~has, 0).when(value.startswith("{"), 1).when(value.startswith("'"), 4).when(value.startswith('"'), 8).otherwise(2)
    )
    bare = F.when(~has, "").when(kind.isin(1, 4, 8), F.expr("substring(v, 2, char_length(v) - 2)")).otherwise(F.col("v"))
    return (
        found.withColumn("v", value)
        .select(*cols, "token_no", "tag_name", F.col("attr_no").cast("bigint").alias("attr_no"), name.alias("name"), bare.alias("value"), kind.cast("int").alias("attr_type"))
    )


def text_lines(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, line_no, value``: text runs split at line breaks, without those of orphan closing tags."""
    keep = [c for c in df.columns if c != content] if keep is None else keep
    cols = [F.col(f"`{c}`") for c in keep]
    found = df.select(*cols, token_array(content).alias("__all"))

    def entry(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("__all", i))
        return F.struct(i.cast("bigint").alias("no"), x.alias("token"), F.coalesce(token_kind(before) == "Declaration", F.lit(False)).alias("bare"))

    runs = F.filter(F.transform("__all", entry), lambda x: token_kind(x["token"]) == "Text")
    runs = found.select(*cols, F.explode_outer(runs).alias("r")).where("r is not null")
    lines = runs.select(*cols, F.col("r.no").alias("token_no"), F.col("r.bare").alias("bare"), F.posexplode(F.split("r.token", "\n")).alias("line_no", "line"))
    # blanks in front are passed over behind a line break and behind a declaration
    value = F.when((F.col("line_no") == 0) & ~F.col("bare"), F.col("line")).otherwise(F.regexp_replace("line", r"^[\x00-\x20]+", ""))
    return lines.select(*cols, "token_no", F.col("line_no").cast("bigint").alias("line_no"), value.alias("value")).where("value <> ''")


def comments(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    t = F.col("token")
    return _of_kind(df, content, keep, t.startswith("<!--"), F.expr("substring(token, 5, char_length(token) - 7)").alias("value"))


def cdata(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    t = F.col("token")
    return _of_kind(df, content, keep, t.rlike(r"^(?i:<!\[CDATA\[)"), F.expr("substring(token, 10, char_length(token) - 12)").alias("value"))


def doctypes(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    t = F.col("token")
    value = F.regexp_extract(t, r"^(?i:<!doctype)[\x00-\x20]*+([^ \n\t\r>]*)", 1)
    return _of_kind(df, content, keep, t.rlike(r"^(?i:<!doctype)"), value.alias("value"))


def declarations(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, value``: those inside a doctype with their keyword, others without it."""
    t = F.col("token")
    behind = F.regexp_extract_all(F.regexp_replace(t, r"^(?i:<!doctype)[\x00-\x20]*+[^ \n\t\r>]*+", ""), F.lit(r"(?s)!([^>]*+)>"), F.lit(1))
    bare = F.regexp_extract(t, r"(?s)^<!(?:[> \-\[]|[^> \-\[]+)?[\x00-\x20]*+([^>]*)>$", 1)
    alone = F.array(F.when((bare == "") & (t != "<!>"), ">").otherwise(bare))
    doctype = t.rlike(r"^(?i:<!doctype)")
    other = t.startswith("<!") & ~t.startswith("<!--") & ~t.rlike(r"^(?i:<!\[CDATA\[)")
    return _of_kind(df, content, keep, other, F.explode(F.when(doctype, behind).otherwise(alone)).alias("value"))


def processing_instructions(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, token_no, target, content``."""
    t = F.col("token")
    blank = t.rlike(r"(?s)^<\?[^> \n\t\r]*[ \n\t\r]")
    target = F.when(blank, F.regexp_extract(t, r"^<\?([^> \n\t\r]*)", 1)).otherwise(F.expr("substring(token, 3)"))
    value = F.when(blank, F.regexp_extract(t, r"(?s)^<\?[^> \n\t\r]*+[\x00-\x20]*+(.*?).?>$", 1)).otherwise("")
    return _of_kind(df, content, keep, t.startswith("<?"), target.alias("target"), value.alias("content"))


# one tag's step of the stack of open elements; of an outer fold over blocks of tags, each block's results are one entry
_STEP = """
  (acc, x) -> case
    when x.k = 's' then struct(acc.st as st, array_append(acc.closed, struct(x.n as name, x.i as open_no, x.i as close_no, false as implicit)) as closed, acc.orphans as orphans)
    when x.k = 'o' then struct(array_append(acc.st, struct(x.n as n, x.i as i)) as st, acc.closed as closed, acc.orphans as orphans)
    when exists(acc.st, y -> y.n = x.n) then struct(
      slice(acc.st, 1, size(acc.st) - cast(array_position(transform(reverse(acc.st), y -> y.n), x.n) as int)) as st,
      concat(acc.closed, transform(
        slice(reverse(acc.st), 1, cast(array_position(transform(reverse(acc.st), y -> y.n), x.n) as int)),
        (y, k) -> struct(y.n as name, y.i as open_no, x.i as close_no, k + 1 < cast(array_position(transform(reverse(acc.st), y -> y.n), x.n) as int) as implicit))) as closed,
      acc.orphans as orphans)
    else struct(acc.st as st, acc.closed as closed, array_append(acc.orphans, struct(x.n as name, x.i as at)) as orphans)
  end
"""
_CLOSED, _ORPHAN = "struct<name:string,open_no:bigint,close_no:bigint,implicit:boolean>", "struct<name:string,at:bigint>"
_FOLD = f"""
aggregate(
  transform(sequence(0, cast(floor((size(t) - 1) / __w) as int)), b -> slice(t, b * __w + 1, __w)),
  struct(cast(array() as array<struct<n:string,i:bigint>>) as st, cast(array() as array<array<{_CLOSED}>>) as closed, cast(array() as array<array<{_ORPHAN}>>) as orphans),
  (all, part) -> element_at(transform(
    array(aggregate(part, struct(all.st as st, cast(array() as array<{_CLOSED}>) as closed, cast(array() as array<{_ORPHAN}>) as orphans), {_STEP})),
    r -> struct(r.st as st, array_append(all.closed, r.closed) as closed, array_append(all.orphans, r.orphans) as orphans)), 1),
  all -> struct(all.st as st, flatten(all.closed) as closed, flatten(all.orphans) as orphans))
"""


def _width(array: Column) -> Column:
    """Elements of a block: the square root of an array's, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(array)))).cast("int")


def _folded(df: DataFrame, content: str, keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c != content] if keep is None else keep
    found = df.select(*[F.col(f"`{c}`") for c in keep], token_array(content).alias("__all"))

    def entry(x: Column, closed: Column) -> Column:
        closing = x["t"].startswith("</")
        kind = F.when(closing, "c").when(closed, "s").otherwise("o")
        return F.struct(kind.alias("k"), F.when(closing, closing_name(x["t"])).otherwise(tag_name(x["t"])).alias("n"), x["i"].alias("i"))

    placed = F.transform("__all", lambda x, i: F.struct(x.alias("t"), i.cast("bigint").alias("i")))
    found = found.withColumn("__tags", F.filter(placed, lambda x: x["t"].startswith("</") | _is_open(x["t"])))
    closed = F.expr(f"transform(transform(__tags, tok -> tok.t), tok -> {self_closing('tok')})")
    tags = F.zip_with("__tags", closed, entry)
    folded = found.select(*[F.col(f"`{c}`") for c in keep], tags.alias("t")).where("size(t) > 0")
    return folded.withColumn("__w", _width(F.col("t"))).withColumn("__folded", F.expr(_FOLD)), keep


def close_tags(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, close_order, name, open_no, close_no, implicit``: elements in the order in which they close."""
    out, keep = _folded(df, content, keep)
    cols = [F.col(f"`{c}`") for c in keep]
    return out.select(*cols, F.posexplode_outer("__folded.closed").alias("close_order", "c")).where("c is not null").select(*cols, F.col("close_order").cast("bigint").alias("close_order"), "c.*")


def orphan_closings(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, name, token_no``: closing tags that close nothing, which are text."""
    out, keep = _folded(df, content, keep)
    cols = [F.col(f"`{c}`") for c in keep]
    return out.select(*cols, F.explode_outer("__folded.orphans").alias("o")).where("o is not null").select(*cols, F.col("o.name").alias("name"), F.col("o.at").alias("token_no"))


def unclosed_elements(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``keep, name, token_no``: elements that are open at the end."""
    out, keep = _folded(df, content, keep)
    cols = [F.col(f"`{c}`") for c in keep]
    return out.select(*cols, F.explode_outer("__folded.st").alias("s")).where("s is not null").select(*cols, F.col("s.n").alias("name"), F.col("s.i").alias("token_no"))


def token_offsets(df: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``byte_start, byte_end, start_line, start_char``; rows are documents, repeated or not.

    Sums run over a document's tokens inside its row, without a shuffle. The byte order mark counts three bytes and a column.
    """
    keep = [c for c in df.columns if c != content] if keep is None else keep
    cols = [F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)]
    bom = F.col(f"`{content}`").cast("string").startswith("\ufeff")
    out = df.select(*cols, F.when(bom, 1).otherwise(0).alias("__bom"), token_array(content).alias("__t")).where("size(__t) > 0")
    units = "cast(octet_length(encode({0}, 'UTF-16LE')) / 2 as bigint)"
    # of each token, and of runs of tokens alike: bytes, line breaks, units, and units up to the last line break (-1: none)
    breaks, tail = "cast(char_length(x) - char_length(translate(x, '\n', '')) as bigint)", units.format("substring_index(x, '\n', -1)")
    last = f"if(contains(x, '\n'), {units.format('x')} - {tail}, -1L)"
    measured = f"transform(__t, x -> struct(cast(octet_length(x) as bigint) as b, {breaks} as n, {units.format('x')} as u, {last} as last))"
    out = out.withColumn("__m", F.expr(measured))
    merge = "struct(a.b + x.b as b, a.n + x.n as n, a.u + x.u as u, if(x.last < 0, a.last, a.u + x.last) as last)"
    sums = _before("__m", merge, "struct(0L as b, 0L as n, 0L as u, -1L as last)")
    out = out.withColumn("__s", F.expr(sums))
    zipped = F.arrays_zip("__t", F.transform("__m", lambda x: x["b"]).alias("__b"), "__s")
    out = out.select(*[F.col(f"__k{i}") for i in range(len(keep))], "__bom", F.posexplode(zipped).alias("token_no", "x"))
    x, bom = F.col("x"), F.col("__bom")
    start = x["__s"]["b"] + 3 * bom
    char = F.when(x["__s"]["last"] < 0, x["__s"]["u"] + bom).otherwise(x["__s"]["u"] - x["__s"]["last"])
    return out.select(
        *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("token_no").cast("bigint").alias("token_no"), x["__t"].alias("token"), token_kind(x["__t"]).alias("kind"),
        start.alias("byte_start"), (start + x["__b"]).alias("byte_end"), x["__s"]["n"].alias("start_line"), char.alias("start_char"),
    )
