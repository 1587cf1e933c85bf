"""Queries over ``pages``, ``documents`` and documents written from other tables, with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import render, scalars, writer
from .functions.udtf import register as register_udtf
from .operators import blocks, events, slices, structure
from .plans import native
from .schema import AttributeType, EventType

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, dealt evenly where one small file would be one task."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.repartition(spark.sparkContext.defaultParallelism) if len(pages.inputFiles()) == 1 else pages


# ---- the SQL side: tokens of well-formed-enough pages

_TOKEN = (
    r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?>|<![^>]*>|</[^>]*>|<[A-Za-z_:](?:\"[^\"]*\"|''[^'']*''|[^>\"''])*>|[^<]+|<"
).replace(r"\"", '"')
_TOKENS = f"""
tokens as (
  select page_id, i - 1 as token_no, t[i] as token from (
    select page_id, t, unnest(range(1, len(t) + 1)) as i from (select page_id, regexp_extract_all(html, '{_TOKEN}') as t from pages)))"""
_OFFSETS = f"""{_TOKENS},
offsets as (
  select *, coalesce(sum(octet_length(encode(token))) over (partition by page_id order by token_no rows between unbounded preceding and 1 preceding), 0)::bigint as byte_start
  from tokens)"""
_FOLD = f"""
tags as (
  select page_id, list_filter(list_transform(regexp_extract_all(html, '{_TOKEN}'), lambda x, i: {{'t': x, 'i': i - 1}}), lambda x: regexp_matches(x.t, '^</?[A-Za-z_:]')) as t from pages),
walked(page_id, t, pos, st, closed, orphans) as (
  select page_id, t, 1, cast([] as struct(n varchar, i bigint)[]), cast([] as struct(name varchar, open_no bigint, close_no bigint, implicit boolean)[]), cast([] as struct(name varchar, token_no bigint)[]) from tags
  union all
  select page_id, t, pos + 1,
    case when x.t like '</%' then case when k is null then st else st[:len(st) - k] end
         when x.t like '%/>' then st
         else list_append(st, {{'n': n, 'i': x.i}}) end,
    case when x.t like '</%' and k is not null
         then list_concat(closed, list_transform(list_reverse(st)[:k], lambda y, j: {{'name': y.n, 'open_no': y.i, 'close_no': x.i, 'implicit': j < k}}))
         when x.t like '%/>' then list_append(closed, {{'name': n, 'open_no': x.i, 'close_no': x.i, 'implicit': false}})
         else closed end,
    case when x.t like '</%' and k is null then list_append(orphans, {{'name': n, 'token_no': x.i}}) else orphans end
  from (
    select *, case when x.t like '</%' then nullif(coalesce(list_position(list_reverse(list_transform(st, lambda y: y.n)), n), 0), 0) end as k
    from (select *, t[pos] as x, regexp_extract(t[pos].t, '^</?([^>/ \\n\\t\\r]*)', 1) as n from walked where pos <= len(t)))),
done as (select * from walked where pos > len(t))"""


_PLACES = f"""{_TOKENS},
measured as (
  select *, octet_length(encode(token)) as b, len(token) - len(replace(token, chr(10), '')) as br, len(token) as u, len(string_split(token, chr(10))[-1]) as tail from tokens),
summed as (
  select *, coalesce(sum(b) over w, 0)::bigint as byte_start, coalesce(sum(br) over w, 0)::bigint as start_line, coalesce(sum(u) over w, 0)::bigint as units from measured
  window w as (partition by page_id order by token_no rows between unbounded preceding and 1 preceding)),
broken as (
  select *, arg_max(units + u - tail, token_no) filter (where br > 0) over (partition by page_id order by token_no rows between unbounded preceding and 1 preceding) as since from summed),
places as (
  select page_id, token_no, token, byte_start, (byte_start + b)::bigint as byte_end, start_line, (units - coalesce(since, 0))::bigint as start_char,
    (start_line + br)::bigint as end_line, (case when br > 0 then tail else units - coalesce(since, 0) + u end)::bigint as end_char from broken)"""
# attributes of the tables' tags stand one behind the other, on the tag's line
_ATTRIBUTE_PLACES = """
named as (
  select *, regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as tag_name, regexp_extract_all(token, ' [^= >]+="[^"]*"') as l from places where regexp_matches(token, '^<[A-Za-z_:]')),
listed as (select *, unnest(range(1, len(l) + 1)) as k from named),
cut_attributes as (
  select *, regexp_extract(l[k], ' ([^= >]+)="([^"]*)"', 1) as name, regexp_extract(l[k], ' ([^= >]+)="([^"]*)"', 2) as value,
    coalesce(list_sum(list_transform(l[:k - 1], lambda x: len(x))), 0)::bigint + 2 + len(tag_name) as chars,
    coalesce(list_sum(list_transform(l[:k - 1], lambda x: octet_length(encode(x)))), 0)::bigint + 2 + octet_length(encode(tag_name)) as octets from listed),
attribute_places as (
  select page_id, token_no, k, tag_name, name, value, start_line as line, (start_char + chars)::bigint as name_start, (start_char + chars + len(name))::bigint as name_end,
    (start_char + chars + len(name) + 2)::bigint as value_start, (start_char + chars + len(name) + 2 + len(value))::bigint as value_end,
    (byte_start + octets)::bigint as byte_start, (byte_start + octets + octet_length(encode(name)))::bigint as name_byte_end,
    (byte_start + octets + octet_length(encode(name)) + 2)::bigint as value_byte_start, (byte_start + octets + octet_length(encode(name)) + 2 + octet_length(encode(value)))::bigint as value_byte_end
  from cut_attributes)"""
_TEXT_PLACES = """
text_lines as (select *, unnest(range(1, len(l) + 1)) as k from (select *, string_split(token, chr(10)) as l from places where token not like '<%')),
cut_lines as (
  select *, case when k = 1 then l[k] else regexp_replace(l[k], '^[\\x00-\\x20]+', '') end as value, case when k = 1 then start_char else 0 end as base,
    byte_start + coalesce(list_sum(list_transform(l[:k - 1], lambda x: octet_length(encode(x)) + 1)), 0) as spot from text_lines),
text_places as (
  select page_id, token_no, k, value, (start_line + k - 1)::bigint as line, (base + len(l[k]) - len(value))::bigint as c0, (base + len(l[k]))::bigint as c1,
    (spot + octet_length(encode(l[k])) - octet_length(encode(value)))::bigint as b0, (spot + octet_length(encode(l[k])))::bigint as b1, false as orphan from cut_lines where value <> ''
  union all
  select o.page_id, o.o.token_no, 1, '</' || o.o.name || '>', p.start_line, p.start_char, p.end_char, p.byte_start, p.byte_end, true
  from (select page_id, unnest(orphans) as o from done) o join places p on p.page_id = o.page_id and p.token_no = o.o.token_no)"""
# the element that is innermost where a text stands: the top of the stack between two tags
_OWNED = """
owners as (
  select page_id, st[len(st)].i as owner, coalesce(case when pos > 1 then t[pos - 1].i end, -1) as after, coalesce(case when pos <= len(t) then t[pos].i end, 9223372036854775807) as before
  from walked where len(st) > 0),
owned as (
  select x.*, o.owner from text_places x join owners o on x.page_id = o.page_id and x.token_no > o.after and (x.token_no < o.before or (x.orphan and x.token_no = o.before))),
elements as (
  select d.page_id, c.name as name, c.open_no as open_no, c.close_no as close_no, c.implicit as implicit, a.start_line as l0, a.start_char as c0, a.end_line as l1, a.end_char as c1, a.byte_start as b0,
    c.open_no = c.close_no as self_closing, z.start_line as l2, z.start_char as c2, z.end_line as l3, z.end_char as c3, a.byte_end as open_end, z.byte_end as close_end
  from (select page_id, unnest(closed) as c from done) d
  join places a on a.page_id = d.page_id and a.token_no = d.c.open_no join places z on z.page_id = d.page_id and z.token_no = d.c.close_no)"""


# ---- tokens and relations over pages


@query(f"with {_TOKENS} select regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as name, count(*) as n from tokens where regexp_matches(token, '^<[A-Za-z_:]') group by 1")
def open_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.open_tag_counts(_pages(spark, sf_dir), "html")


@query(
    f"with {_OFFSETS} select page_id, regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as name,"
    " len(regexp_extract_all(token, ' [^= >]+=\"[^\"]*\"'))::bigint as n_attributes, token like '%/>' as self_closing, byte_start, (byte_start + octet_length(encode(token)))::bigint as byte_end"
    " from offsets where regexp_matches(token, '^<[A-Za-z_:]')"
)
def open_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.open_tags(_pages(spark, sf_dir), "html")
    return out.select("page_id", "name", "n_attributes", "self_closing", "byte_start", "byte_end")


@query(f"with {_OFFSETS} select page_id, regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as name, byte_start, 0::bigint as byte_end from offsets where regexp_matches(token, '^<[A-Za-z_:]')")
def open_tag_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.open_tag_starts(_pages(spark, sf_dir), "html").select("page_id", "name", "byte_start", "byte_end")


@query(f"with recursive {_FOLD} select page_id, c.name as name, c.open_no as open_no, c.close_no as close_no, c.implicit as implicit from (select page_id, unnest(closed) as c from done)")
def close_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.close_tags(_pages(spark, sf_dir), "html").select("page_id", "name", "open_no", "close_no", "implicit")


@query(
    f"with recursive {_FOLD} select page_id, c.name as name, count(*) as n, count(*) filter (where c.implicit) as n_implicit"
    " from (select page_id, unnest(closed) as c from done) group by all"
)
def close_tags_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events.close_tags(_pages(spark, sf_dir), "html")
    return out.groupBy("page_id", "name").agg(F.count("*").alias("n"), F.count_if("implicit").alias("n_implicit"))


@query(f"with recursive {_FOLD} select page_id, o.name as name, o.token_no as token_no from (select page_id, unnest(orphans) as o from done)")
def orphan_closings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.orphan_closings(_pages(spark, sf_dir), "html")


@query(f"with recursive {_FOLD} select page_id, s.n as name, s.i as token_no from (select page_id, unnest(st) as s from done)")
def unclosed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.unclosed_elements(_pages(spark, sf_dir), "html")


@query(f"with recursive {_FOLD} select page_id, s.n as name, count(*) as n from (select page_id, unnest(st) as s from done) group by all")
def unclosed_elements_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.unclosed_elements(_pages(spark, sf_dir), "html").groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query(
    f"with recursive {_FOLD}, {_OFFSETS.lstrip()}, lines as ("
    " select page_id, byte_start, l, k, coalesce(list_sum(list_transform(l[:k - 1], lambda x: octet_length(encode(x)) + 1)), 0)::bigint as before"
    " from (select page_id, byte_start, l, unnest(range(1, len(l) + 1)) as k from (select page_id, byte_start, string_split(token, chr(10)) as l from offsets where token not like '<%'))),"
    " cut as (select page_id, byte_start + before as spot, l[k] as line, case when k = 1 then l[k] else regexp_replace(l[k], '^[\\x00-\\x20]+', '') end as value from lines)"
    " select page_id, value, (spot + octet_length(encode(line)) - octet_length(encode(value)))::bigint as byte_start, (spot + octet_length(encode(line)))::bigint as byte_end from cut where value <> ''"
    " union all select o.page_id, '</' || o.o.name || '>', f.byte_start, (f.byte_start + octet_length(encode(f.token)))::bigint"
    " from (select page_id, unnest(orphans) as o from done) o join offsets f on f.page_id = o.page_id and f.token_no = o.o.token_no"
)
def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.text_events(_pages(spark, sf_dir), "html").select("page_id", "value", "byte_start", "byte_end")


@query(
    f"with {_TOKENS}, lines as (select page_id, l[k] as line, k from (select page_id, l, unnest(range(1, len(l) + 1)) as k from (select page_id, string_split(token, chr(10)) as l from tokens where token not like '<%')))"
    " select page_id, case when k = 1 then line else regexp_replace(line, '^[\\x00-\\x20]+', '') end as value from lines where case when k = 1 then line else regexp_replace(line, '^[\\x00-\\x20]+', '') end <> ''"
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.text_lines(_pages(spark, sf_dir), "html").select("page_id", "value")


@query(f"with {_OFFSETS} select page_id, token[5:-4] as value, byte_start, (byte_start + octet_length(encode(token)))::bigint as byte_end from offsets where token like '<!--%'")
def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.comments(_pages(spark, sf_dir), "html").select("page_id", "value", "byte_start", "byte_end")


@query(f"with {_TOKENS} select page_id, token_no, token[5:-4] as value from tokens where token like '<!--%'")
def comment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.comments(_pages(spark, sf_dir), "html")


@query(
    f"with {_OFFSETS} select page_id, regexp_extract(token, '(?i)^<!doctype\\s*([^ \\n\\t\\r>]*)', 1) as value, byte_start, (byte_start + octet_length(encode(token)))::bigint as byte_end"
    " from offsets where lower(token) like '<!doctype%'"
)
def doctypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.doctypes(_pages(spark, sf_dir), "html").select("page_id", "value", "byte_start", "byte_end")


_ATTRIBUTES_SQL = f"""with {_OFFSETS}, found as (
  select page_id, regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as tag_name, unnest(regexp_extract_all(token, ' ([^= >]+)="([^"]*)"')) as a
  from offsets where regexp_matches(token, '^<[A-Za-z_:]'))
select page_id, tag_name, regexp_extract(a, ' ([^= >]+)="([^"]*)"', 1) as name, regexp_extract(a, ' ([^= >]+)="([^"]*)"', 2) as value, 8 as attr_type from found"""


@query(_ATTRIBUTES_SQL)
def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.attributes(_pages(spark, sf_dir), "html").select("page_id", "tag_name", "name", "value", "attr_type")


@query(_ATTRIBUTES_SQL)
def attributes_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.markup_events(_pages(spark, sf_dir), "html", events="OpenTag", entities=["tag"])
    return events.tag_attributes(found, ["page_id"]).select("page_id", "tag_name", "name", "value", "attr_type")


@query(f"with {_PLACES} select page_id, token_no, byte_start, byte_end, start_line, start_char from places")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = native.token_offsets(_pages(spark, sf_dir), "html")
    return out.select("page_id", "token_no", "byte_start", "byte_end", "start_line", "start_char")


@query(
    f"with {_TOKENS} select case when token not like '<%' then 'Text' when token like '<!--%' then 'Comment' when lower(token) like '<!doctype%' then 'Doctype'"
    " when token like '</%' then 'CloseTag' else 'OpenTag' end as kind, count(*) as n from tokens group by 1"
)
def token_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.tokens(_pages(spark, sf_dir), "html", []).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    f"with {_TOKENS} select case when token like '<!--%' then 'Comment' else 'Doctype' end as event_type, case when token like '<!--%' then 16 else 8 end as event_mask, count(*) as n"
    " from tokens where token like '<!--%' or lower(token) like '<!doctype%' group by all"
)
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask of two kinds gives the union of their relations."""
    found = events.markup_events(_pages(spark, sf_dir), "html", events=EventType.Comment | EventType.Doctype, entities=[])
    return found.groupBy("event_type", "event_mask").agg(F.count("*").alias("n"))


@query(
    f"""with recursive {_FOLD}, {_TOKENS.lstrip()}, n as (
  select 'OpenTag' as event_type, count(*) as n from tokens where regexp_matches(token, '^<[A-Za-z_:]')
  union all select 'OpenTagStart', count(*) from tokens where regexp_matches(token, '^<[A-Za-z_:]')
  union all select 'CloseTag', sum(len(closed)) from done
  union all select 'Comment', count(*) from tokens where token like '<!--%'
  union all select 'Doctype', count(*) from tokens where lower(token) like '<!doctype%'
  union all select 'Attribute', count(*) from ({_ATTRIBUTES_SQL})
  union all select 'Text', (select sum(len(orphans)) from done) + count(*) from (
    select case when k = 1 then l[k] else regexp_replace(l[k], '^[\\x00-\\x20]+', '') end as v from (
      select l, unnest(range(1, len(l) + 1)) as k from (select string_split(token, chr(10)) as l from tokens where token not like '<%'))) where v <> '')
select event_type, n::bigint as n from n"""
)
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten relations, counted by kind."""
    return events.markup_events(_pages(spark, sf_dir), "html", entities=[]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(f"select count(*) as n_pages, count(*) filter (where array_to_string(regexp_extract_all(html, '{_TOKEN}'), '') = html) as n_lossless from pages")
def lossless_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a page, joined, are the page."""
    pages = _pages(spark, sf_dir)
    return pages.agg(F.count("*").alias("n_pages"), F.count_if(F.concat_ws("", native.token_array("html")) == F.col("html")).alias("n_lossless"))


@query(f"with {_TOKENS} select page_id, token as slice from tokens where lower(token) like '<!doctype%' or token like '<!--%'")
def slices_of_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an entity is found again by its byte offsets."""
    pages = _pages(spark, sf_dir)
    spans = [kind(pages, "html").select("page_id", "byte_start", "byte_end") for kind in (events.doctypes, events.comments)]
    return slices.slices(pages, spans[0].unionByName(spans[1]), ["page_id"], "html", ("byte_start", "byte_end")).select("page_id", "slice")


@query(f"with {_PLACES}, {_ATTRIBUTE_PLACES.lstrip()} select page_id, name, value, '\"' || value || '\"' as quoted from attribute_places")
def slices_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of an attribute's value is found again by its line and columns, with the quotes around it one column further."""
    pages = _pages(spark, sf_dir)
    spans = events.attributes(pages, "html").select("page_id", "name", F.col("value_start_line").alias("line"), (F.col("value_start_char") - 1).alias("a"), (F.col("value_end_char") + 1).alias("z"))
    found = slices.slices(pages, spans, ["page_id"], "html", ("line", "a", "z"), "quoted")
    return found.select("page_id", "name", F.expr("substring(quoted, 2, char_length(quoted) - 2)").alias("value"), "quoted")


@query(
    "with lines as ("
    " select doc_id, l[k] as line, k, coalesce(list_sum(list_transform(l[:k - 1], lambda x: octet_length(encode(x)) + 1)), 0)::bigint as before"
    " from (select doc_id, l, unnest(range(1, len(l) + 1)) as k from (select doc_id, string_split(text, chr(10)) as l from documents))),"
    " cut as (select *, case when k = 1 then line else regexp_replace(line, '^[\\x00-\\x20]+', '') end as value from lines)"
    " select doc_id, value, (before + octet_length(encode(line)) - octet_length(encode(value)))::bigint as byte_start from cut where value <> ''"
)
def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without markup are text: all of their lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return events.text_events(docs, "text").select("doc_id", "value", "byte_start")


@query(
    f"with {_TOKENS} select n.page_id, n.names from (select page_id, string_agg(regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1), ' ' order by token_no) as names from tokens"
    " where regexp_matches(token, '^<[A-Za-z_:]') group by 1) n"
)
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function: names of a page's tags in their order."""
    register_udtf(spark)
    _pages(spark, sf_dir).createOrReplaceTempView("markup_pages")
    found = spark.sql("select p.page_id, e.seq, e.name from markup_pages p, lateral markup_events(p.html, 128) e")
    names = F.array_sort(F.collect_list(F.struct("seq", "name")))
    return found.groupBy("page_id").agg(F.array_join(F.transform(names, lambda x: x["name"]), " ").alias("names"))


def _json_place(line: str, character: str) -> str:
    return f"{{'line': {line}, 'character': {character}}}"


def _json_text(line: str, c0: str, c1: str, value: str, b0: str, b1: str) -> str:
    return f"{{'start': {_json_place(line, c0)}, 'end': {_json_place(line, c1)}, 'value': {value}, 'byteOffsets': {{'start': {b0}, 'end': {b1}}}}}"


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}, {_ATTRIBUTE_PLACES.lstrip()}, {_TEXT_PLACES.lstrip()}, {_OWNED.lstrip()},
  of_tags as (
    select page_id, token_no, list({{'name': {_json_text("line", "name_start", "name_end", "name", "byte_start", "name_byte_end")},
      'value': {_json_text("line", "value_start", "value_end", "value", "value_byte_start", "value_byte_end")},
      'type': 8, 'byteOffsets': {{'start': byte_start, 'end': value_byte_end + 1}}}} order by k) as attributes from attribute_places group by all),
  of_texts as (select page_id, owner, list({_json_text("line", "c0", "c1", "value", "b0", "b1")} order by token_no, k) as nodes from owned group by all),
  none as (select attributes[:0] as no_attributes, (select nodes[:0] from of_texts limit 1) as no_nodes from of_tags limit 1)
  select e.page_id, to_json({{'openStart': {_json_place("l0", "c0")}, 'openEnd': {_json_place("l1", "c1")},
    'closeStart': {_json_place("if(implicit or self_closing, 0, l2)", "if(implicit or self_closing, 0, c2)")},
    'closeEnd': {_json_place("if(implicit or self_closing, 0, l3)", "if(implicit or self_closing, 0, c3)")},
    'name': name, 'attributes': coalesce(attributes, no_attributes), 'textNodes': coalesce(nodes, no_nodes), 'selfClosing': self_closing,
    'byteOffsets': {{'start': b0, 'end': if(implicit or self_closing, open_end, close_end)}}}})::varchar as json
  from elements e cross join none left join of_tags a on a.page_id = e.page_id and a.token_no = e.open_no left join of_texts x on x.page_id = e.page_id and x.owner = e.open_no"""
)
def elements_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed elements as JSON, with places, attributes and text nodes."""
    found = events.markup_events(_pages(spark, sf_dir), "html", events="CloseTag", entities=["tag"])
    return found.select("page_id", render.tag_json(F.col("tag")).alias("json"))


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}, {_TEXT_PLACES.lstrip()}, {_OWNED.lstrip()}
  select page_id, name, self_closing, implicit, l0 as open_start_line, c0 as open_start_char, l1 as open_end_line, c1 as open_end_char,
    if(implicit or self_closing, 0, l2)::bigint as close_start_line, if(implicit or self_closing, 0, c2)::bigint as close_start_char,
    if(implicit or self_closing, 0, l3)::bigint as close_end_line, if(implicit or self_closing, 0, c3)::bigint as close_end_char,
    b0 as byte_start, if(implicit or self_closing, open_end, close_end)::bigint as byte_end from elements"""
)
def element_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed elements with all their places."""
    return events.close_tags(_pages(spark, sf_dir), "html").drop("seq", "n_attributes", "n_text_nodes")


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}, {_TEXT_PLACES.lstrip()}, {_OWNED.lstrip()},
  of_texts as (select page_id, owner, count(*) as n_text_nodes, string_agg(value, '|' order by token_no, k) as texts, min(b0) as first_byte from owned group by all)
  select e.page_id, e.name, e.b0 as byte_start, coalesce(n_text_nodes, 0)::int as n_text_nodes, coalesce(texts, '') as texts, first_byte from elements e
  left join of_texts x on x.page_id = e.page_id and x.owner = e.open_no"""
)
def elements_with_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed elements with the contents of their own text nodes, in order."""
    tag = F.col("tag")
    nodes = tag["text_nodes"]
    found = events.markup_events(_pages(spark, sf_dir), "html", events="CloseTag", entities=["tag"])
    return found.select(
        "page_id", tag["name"].alias("name"), tag["byte_offsets"]["start"].alias("byte_start"), F.size(nodes).alias("n_text_nodes"),
        F.array_join(F.transform(nodes, lambda x: x["value"]), "|").alias("texts"), F.array_min(F.transform(nodes, lambda x: x["byte_offsets"]["start"])).alias("first_byte"),
    )


@query(
    f"""with {_PLACES}, {_ATTRIBUTE_PLACES.lstrip()}
  select page_id, name, value, 8 as attr_type, line as name_start_line, name_start as name_start_char, line as name_end_line, name_end as name_end_char, line as value_start_line,
    value_start as value_start_char, line as value_end_line, value_end as value_end_char, byte_start, (value_byte_end + 1)::bigint as byte_end from attribute_places"""
)
def attribute_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes with the places of their names and values."""
    return events.attributes(_pages(spark, sf_dir), "html").drop("seq")


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}, {_TEXT_PLACES.lstrip()}
  select page_id, value, line as start_line, c0 as start_char, line as end_line, c1 as end_char, b0 as byte_start, b1 as byte_end from text_places"""
)
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text runs with lines, columns and bytes."""
    return events.text_events(_pages(spark, sf_dir), "html").drop("seq")


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}
  select d.page_id, d.s.n as name, p.byte_start, p.byte_end from (select page_id, unnest(st) as s from done) d join places p on p.page_id = d.page_id and p.token_no = d.s.i"""
)
def unclosed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that are open at the end of their page, with the bytes of their opening tags."""
    return events.unclosed_elements(_pages(spark, sf_dir), "html")


@query(
    f"select regexp_extract(value, '^/?([^/?#]*)', 1) as target, count(*) as n_links, count(distinct page_id) as n_pages from ({_ATTRIBUTES_SQL}) where tag_name = 'a' and name = 'href' group by 1"
)
def link_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition: an aggregate over the attribute relation."""
    found = native.attributes(_pages(spark, sf_dir), "html").where("tag_name = 'a' and name = 'href'")
    target = F.regexp_extract("value", "^/?([^/?#]*)", 1)
    return found.groupBy(target.alias("target")).agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


@query(
    f"with {_TOKENS} select a.value as lang, count(*) as n_pages, sum(c.n)::bigint as n_paragraphs from ({_ATTRIBUTES_SQL}) a"
    " join (select page_id, count(*) as n from tokens where regexp_matches(token, '^<p[> ]') group by 1) c using (page_id) where a.tag_name = 'html' and a.name = 'lang' group by 1"
)
def paragraphs_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition: a join of two event relations."""
    pages = _pages(spark, sf_dir)
    langs = native.attributes(pages, "html").where("tag_name = 'html' and name = 'lang'").select("page_id", F.col("value").alias("lang"))
    counts = native.open_tags(pages, "html").where("name = 'p'").groupBy("page_id").agg(F.count("*").alias("n"))
    return langs.join(counts, "page_id").groupBy("lang").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_paragraphs"))


# ---- structure: parents, and ranges within ranges

_PARENTS = f"""{_FOLD}, {_PLACES.lstrip()},
parents as (
  select page_id, t[pos].i as token_no, len(st)::bigint as depth, st[len(st)].n as parent_name, st[len(st)].i as parent_no from walked where pos <= len(t) and t[pos].t not like '</%')"""


@query(
    f"""with recursive {_PARENTS}
  select p.page_id, regexp_extract(x.token, '^<([^>/ \\n\\t\\r]*)', 1) as name, x.byte_start, x.byte_end, depth, parent_name, y.byte_start as parent_start
  from parents p join places x on x.page_id = p.page_id and x.token_no = p.token_no left join places y on y.page_id = p.page_id and y.token_no = p.parent_no"""
)
def element_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every opening tag with its depth and the element it stands in."""
    return structure.element_parents(_pages(spark, sf_dir), "html")


@query(
    f"""with recursive {_FOLD}, {_PLACES.lstrip()}, {_TEXT_PLACES.lstrip()},
  spans as (
    select d.page_id, c.name as name, a.byte_start as a, if(c.implicit or c.open_no = c.close_no, a.byte_end, z.byte_end) as z from (select page_id, unnest(closed) as c from done) d
    join places a on a.page_id = d.page_id and a.token_no = d.c.open_no join places z on z.page_id = d.page_id and z.token_no = d.c.close_no)
  select s.page_id, s.name as element, s.a as element_start, count(*) as n_texts, sum(t.b1 - t.b0)::bigint as text_bytes
  from spans s join text_places t on s.page_id = t.page_id and s.a <= t.b0 and t.b1 <= s.z group by all"""
)
def texts_within_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join by containment: all texts of each closed element, however deep they stand."""
    pages = _pages(spark, sf_dir)
    elements = events.close_tags(pages, "html").select("page_id", "name", "byte_start", "byte_end")
    texts = events.text_events(pages, "html").select("page_id", "byte_start", "byte_end")
    found = structure.contained(elements, texts, ["page_id"])
    n = (F.col("inner.byte_end") - F.col("inner.byte_start")).alias("n")
    found = found.select("page_id", F.col("outer.name").alias("element"), F.col("outer.byte_start").alias("element_start"), n)
    return found.groupBy("page_id", "element", "element_start").agg(F.count("*").alias("n_texts"), F.sum("n").alias("text_bytes"))


@query(
    f"""with recursive {_PARENTS},
  spans as (
    select d.page_id, c.name as name, a.token_no as token_no, a.byte_start as a, z.byte_end as z from (select page_id, unnest(closed) as c from done) d
    join places a on a.page_id = d.page_id and a.token_no = d.c.open_no join places z on z.page_id = d.page_id and z.token_no = d.c.close_no where not c.implicit)
  select s.page_id, s.name as ancestor, x.name as descendant, count(*) as n, max(q.depth - p.depth)::bigint as levels from spans s
  join spans x on s.page_id = x.page_id and s.a <= x.a and x.z <= s.z and (s.a, s.z) <> (x.a, x.z)
  join parents p on p.page_id = s.page_id and p.token_no = s.token_no join parents q on q.page_id = x.page_id and q.token_no = x.token_no group by all"""
)
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements within elements, counted by both names, with the most levels between them."""
    pages = _pages(spark, sf_dir)
    closed = events.close_tags(pages, "html").where("not implicit").select("page_id", "name", "byte_start", "byte_end")
    depths = structure.element_parents(pages, "html").select("page_id", "byte_start", "depth")
    spans = closed.join(depths, ["page_id", "byte_start"])
    found = structure.contained(spans, spans, ["page_id"])
    levels = F.max(F.col("inner.depth") - F.col("outer.depth")).alias("levels")
    return found.groupBy("page_id", F.col("outer.name").alias("ancestor"), F.col("inner.name").alias("descendant")).agg(F.count("*").alias("n"), levels)


# ---- one document of all pages, lexed by blocks

_ONE = "pages as (select 0 as page_id, string_agg(html, '' order by page_id) as html from pages)"
_ONE_TOKENS = f"{_ONE}, {_TOKENS.lstrip()}"
_ONE_FOLD = f"""{_ONE}, {_OFFSETS.lstrip()},
tags as materialized (
  select row_number() over (order by token_no) as pos, token, byte_start, (byte_start + octet_length(encode(token)))::bigint as byte_end, regexp_extract(token, '^</?([^>/ \\n\\t\\r]*)', 1) as n
  from offsets where regexp_matches(token, '^</?[A-Za-z_:]')),
walked(pos, st, closed) as (
  select 0::bigint, cast([] as struct(n varchar, a bigint)[]), cast([] as struct(n varchar, a bigint)[])
  union all
  select x.pos,
    case when x.token like '</%' then case when k is null then st else st[:len(st) - k] end when x.token like '%/>' then st else list_append(st, {{'n': x.n, 'a': x.byte_start}}) end,
    case when x.token like '</%' and k is not null then list_reverse(st)[:k] when x.token like '%/>' then [{{'n': x.n, 'a': x.byte_start}}] else [] end
  from (select x.*, st, nullif(coalesce(list_position(list_reverse(list_transform(st, lambda y: y.n)), x.n), 0), 0) as k from walked w join tags x on x.pos = w.pos + 1) x)"""


def _one_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as one document: their pieces of 1,000 characters are its blocks, in the order of pages."""
    pieces = blocks.text_blocks(_pages(spark, sf_dir), ["page_id"], "html", 1000)
    document = pieces.select(F.lit(0).alias("document"), (F.col("page_id") * (1 << 20) + F.col("block_no")).alias("block_no"), "text")
    return blocks.split_documents(document, ["document"])


@query(
    f"with {_ONE}, {_OFFSETS.lstrip()} select regexp_extract(token, '^<([^>/ \\n\\t\\r]*)', 1) as name,"
    " len(regexp_extract_all(token, ' [^= >]+=\"[^\"]*\"'))::bigint as n_attributes, byte_start, (byte_start + octet_length(encode(token)))::bigint as byte_end"
    " from offsets where regexp_matches(token, '^<[A-Za-z_:]')"
)
def one_document_open_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blocks.split_relation(_one_document(spark, sf_dir), ["document"], "OpenTag")
    return found.select("name", "n_attributes", "byte_start", "byte_end")


@query(f"with recursive {_ONE_FOLD} select c.n as name, c.a as byte_start, row_number() over (partition by pos order by c.a desc) < len(closed) as implicit from (select pos, closed, unnest(closed) as c from walked)")
def one_document_close_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that close anywhere in the document, each with its first byte: nesting goes across all blocks."""
    return blocks.split_relation(_one_document(spark, sf_dir), ["document"], "CloseTag").select("name", "byte_start", "implicit")


@query(
    f"with recursive {_ONE_FOLD} select x.n as name, x.byte_start, len(w.st)::bigint as depth, w.st[len(w.st)].n as parent_name, w.st[len(w.st)].a as parent_start"
    " from tags x join walked w on w.pos = x.pos - 1 where x.token not like '</%'"
)
def one_document_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.split_parents(_one_document(spark, sf_dir), ["document"]).drop("document", "byte_end")


@query(
    f"""with recursive {_ONE_FOLD}, n as (
  select 128 as event_mask, count(*) as n from tags where token not like '</%'
  union all select 32, count(*) from tags where token not like '</%'
  union all select 256, sum(len(closed)) from walked
  union all select 16, count(*) from offsets where token like '<!--%'
  union all select 8, count(*) from offsets where lower(token) like '<!doctype%'
  union all select 64, sum(len(regexp_extract_all(token, ' ([^= >]+)="([^"]*)"'))) from tags where token not like '</%'
  union all select 1, (select count(*) from tags x join walked w on w.pos = x.pos where x.token like '</%' and len(w.closed) = 0) + count(*) from (
    select case when k = 1 then l[k] else regexp_replace(l[k], '^[\\x00-\\x20]+', '') end as v from (
      select l, unnest(range(1, len(l) + 1)) as k from (select string_split(token, chr(10)) as l from offsets where token not like '<%'))) where v <> '')
select event_mask, n::bigint as n, (select sum(n) from n)::bigint as n_all, (select sum(n) - 1 from n)::bigint as last_seq from n"""
)
def one_document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of events of the one document, counted; events are numbered through from 0."""
    found = blocks.split_events(_one_document(spark, sf_dir), ["document"])
    by_kind = found.groupBy("event_mask").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    kinds = Window.partitionBy()  # a row for each kind
    return by_kind.select("event_mask", "n", F.sum("n").over(kinds).alias("n_all"), F.max("last").over(kinds).alias("last_seq"))


# ---- documents written from the tables: kinds that pages don't have


def _rows(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of a conversation as an element with its text as CDATA, behind which is what ends a section."""
    turns = _rows(spark, sf_dir, "conversations")
    said = F.concat("text", F.lit("]]>"), "role")
    return turns.select("conv_id", "turn", writer.element("turn", [writer.attribute("by", F.col("role"))], writer.cdata(said)).alias("content"))


@query(
    """with turns as (
  select conv_id, turn, text, role, len('<turn by="' || role || '">') as c0, string_split(text, chr(10)) as l from conversations where text is not null and role is not null),
placed as (select *, (len(l) - 1)::bigint as n, case when len(l) > 1 then len(l[-1]) else c0 + 9 + len(text) end + 5 as c1 from turns)
select conv_id, turn, text || ']]' as value, 0::bigint as start_line, c0::bigint as start_char, n as end_line, c1::bigint as end_char from placed
union all select conv_id, turn, '>' || role, n, c1::bigint, n, (c1 + 9 + 1 + len(role) + 3)::bigint from placed"""
)
def cdata_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.cdata(_turns(spark, sf_dir)).drop("seq", "byte_start", "byte_end")


@query("select conv_id, turn, text || ']]>' || role as said, role as by from conversations where text is not null and role is not null")
def turns_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written is read back: sections joined in their order, and the attribute."""
    turns, keys = _turns(spark, sf_dir), ["conv_id", "turn"]
    parts = native.cdata(turns).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("token_no", "value"))).alias("x"))
    said = parts.select(*keys, F.array_join(F.transform("x", lambda x: x["value"]), "").alias("said"))
    return said.join(native.attributes(turns).select(*keys, F.col("value").alias("by")), keys)


def _ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as an instruction: with content, as nothing but a target, or cut short by its content's '>'."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    whole = writer.instruction("ledger", F.concat(F.lit("order="), k, F.lit(" customer="), c))
    kind = F.when(F.col("o_orderkey") % 3 == 0, whole).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("<?"), k, F.lit("?>")))
    short = F.concat(F.lit("<?sum "), k, F.lit(">"), c, F.lit("?>"))
    return _rows(spark, sf_dir, "orders").select("o_orderkey", F.concat("o_orderstatus", F.coalesce(kind, short)).alias("content"))


_LEDGER = """
  select o_orderkey, octet_length(encode(o_orderstatus))::bigint as byte_start,
    case o_orderkey % 3 when 0 then 'ledger' when 1 then o_orderkey::varchar || '?>' else 'sum' end as target,
    case o_orderkey % 3 when 0 then 'order=' || o_orderkey || ' customer=' || o_custkey when 1 then '' else left(o_orderkey::varchar, len(o_orderkey::varchar) - 1) end as content,
    case o_orderkey % 3 when 0 then 11 + len('order=' || o_orderkey || ' customer=' || o_custkey) when 1 then 4 + len(o_orderkey::varchar) else 7 + len(o_orderkey::varchar) end as size
  from orders"""


@query(f"select o_orderkey, target, content, byte_start, (byte_start + size)::bigint as byte_end from ({_LEDGER})")
def processing_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.processing_instructions(_ledgers(spark, sf_dir)).select("o_orderkey", "target", "content", "byte_start", "byte_end")


@query(f"select o_orderkey, target, content from ({_LEDGER})")
def processing_instruction_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.processing_instructions(_ledgers(spark, sf_dir)).drop("token_no")


def _catalogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a doctype with two declarations, and two more behind it."""
    inner = [writer.declaration("ENTITY", F.concat(F.lit("name '"), "p_name", F.lit("'"))), writer.declaration("ELEMENT", F.concat("p_brand", F.lit(" (size,"), "p_type", F.lit("*)")))]
    outer = F.concat(writer.declaration("ATTLIST", F.concat(F.lit("size "), F.col("p_size").cast("string"))), F.lit("\n<!"), F.lower("p_type"), F.lit(">"))
    return _rows(spark, sf_dir, "part").select("p_partkey", F.concat(writer.doctype(F.concat(F.lit("part"), F.col("p_partkey").cast("string")), *inner), outer).alias("content"))


_DECLARED = """select p_partkey, unnest(['ENTITY name ''' || p_name || '''', 'ELEMENT ' || p_brand || ' (size,' || p_type || '*)', 'size ' || p_size, '>']) as value from part"""


@query(_DECLARED)
def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.declarations(_catalogues(spark, sf_dir)).select("p_partkey", "value")


@query(_DECLARED)
def declaration_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.declarations(_catalogues(spark, sf_dir)).select("p_partkey", "value")


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a tag with attributes in every form; every other one ends in a slash that its last value takes."""
    k, c, p = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    parts = [
        writer.attribute("key", k), writer.attribute("of:customer", c, AttributeType.SingleQuoted), writer.attribute("note", F.concat(F.lit('"'), p, F.lit('"'))),
        writer.attribute("both", F.concat(F.lit("'"), p, F.lit('"'), k)), writer.attribute("open", F.when(F.col("o_orderstatus") == "O", F.lit("yes"))), writer.attribute("bare"),
    ]
    slash = F.when(F.col("o_orderkey") % 2 == 0, F.lit("/>")).otherwise(F.lit(">"))
    nested = F.concat(F.lit("\nrule={x => { return "), k, F.lit(" } }once="), c, slash)
    return _rows(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("<order"), *parts, nested).alias("content"))


_FORMS = """select o_orderkey, unnest([
    {'n': 'key', 'v': o_orderkey::varchar, 't': 8}, {'n': 'of:customer', 'v': o_custkey::varchar, 't': 4}, {'n': 'note', 'v': '"' || o_orderpriority || '"', 't': 4},
    {'n': 'both', 'v': '''' || o_orderpriority || '"' || o_orderkey, 't': 1}, {'n': 'open', 'v': if(o_orderstatus = 'O', 'yes', ''), 't': if(o_orderstatus = 'O', 8, 0)}, {'n': 'bare', 'v': '', 't': 0},
    {'n': 'rule', 'v': 'x => { return ' || o_orderkey || ' } ', 't': 1}, {'n': 'once', 'v': o_custkey || if(o_orderkey % 2 = 0, '/', ''), 't': 2}]) as a from orders"""


@query(f"select o_orderkey, a.n as name, a.v as value, a.t::int as attr_type from ({_FORMS})")
def attribute_syntaxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.attributes(_forms(spark, sf_dir), places=False).drop("seq")


@query(f"select o_orderkey, a.n as name, a.v as value, a.t::int as attr_type from ({_FORMS})")
def attribute_syntax_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.attributes(_forms(spark, sf_dir)).select("o_orderkey", "name", "value", "attr_type")


@query(
    f"select o_orderkey, a.t::int as attr_type, ['NoValue', 'JSX', 'NoQuotes', '', 'SingleQuoted', '', '', '', 'DoubleQuoted'][a.t + 1] as type_name,"
    f" a.n || '=\"' || if(a.t = 1, '{{' || a.v || '}}', a.v) || '\"' as string from ({_FORMS})"
)
def attribute_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.markup_events(_forms(spark, sf_dir), events="Attribute", entities=["attribute"])
    a = F.col("attribute")
    return found.select("o_orderkey", a["type"].alias("attr_type"), render.attribute_type_name(a["type"]).alias("type_name"), render.attribute_string(a).alias("string"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as a fragment: an element with a text, a blank, an empty element."""
    name, at = F.col("c_name"), F.col("c_nationkey").cast("string")
    card = writer.fragment(writer.element("card", [writer.attribute("nation", at)], writer.text(name)), F.lit(" "), writer.tag(F.lower("c_mktsegment"), closed=True))
    return _rows(spark, sf_dir, "customer").select("c_custkey", card.alias("content"))


@query(
    """with cards as (select *, len('<card nation="' || c_nationkey || '">') as tag, len(lower(c_mktsegment)) + 4 as segment from customer),
placed as (select *, 2 + tag + len(c_name) + 7 as behind from cards)
select c_custkey, 'card' as name, false as self_closing, 2::bigint as open_start_char, (2 + tag)::bigint as open_end_char, (2 + tag + len(c_name))::bigint as close_start_char from placed
union all select c_custkey, lower(c_mktsegment), true, (behind + 1)::bigint, (behind + 1 + segment)::bigint, 0 from placed
union all select c_custkey, '', false, 0, 2, (behind + 1 + segment)::bigint from placed"""
)
def element_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.close_tags(_cards(spark, sf_dir)).select("c_custkey", "name", "self_closing", "open_start_char", "open_end_char", "close_start_char")


@query(
    """select s_suppkey, '🎏' || s_nationkey as value, 0::bigint as value_start_line, (2 * (s_suppkey % 4) + 12)::bigint as value_start_char, 0::bigint as value_end_line,
    (2 * (s_suppkey % 4) + 14 + len(s_nationkey::varchar))::bigint as value_end_char, (4 * (s_suppkey % 4) + 6)::bigint as byte_start from supplier"""
)
def astral_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns count UTF-16 units, offsets bytes: characters beyond the first plane before and within a value."""
    flag = writer.attribute("flag", F.concat(F.lit("🎏"), F.col("s_nationkey").cast("string")), AttributeType.JSX)
    content = F.concat(F.expr("repeat('🐚', cast(s_suppkey % 4 as int))"), writer.tag("port", flag))
    found = events.attributes(_rows(spark, sf_dir, "supplier").select("s_suppkey", content.alias("content")))
    return found.select("s_suppkey", "value", "value_start_line", "value_start_char", "value_end_line", "value_end_char", "byte_start")


@query(
    """select s_suppkey, unnest([s_name || ' < ' || s_nationkey, s_nationkey || ' ', '<<' || s_name || '>', '</quay' || chr(10) || '>', s_nationkey || '; ']) as value from supplier"""
)
def text_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by lines; '<' that begins nothing; what closes nothing; an end that is the beginning of nothing."""
    name, at = F.col("s_name"), F.col("s_nationkey").cast("string")
    content = F.concat(name, F.lit(" < "), at, F.lit("\n\n\t"), at, F.lit(" <pier><<"), name, F.lit("></quay\n>\n</pier>"), at, F.lit("; <"))
    return events.text_events(_rows(spark, sf_dir, "supplier").select("s_suppkey", content.alias("content"))).select("s_suppkey", "value")


@query(
    """with l as (select *, 'order=' || o_orderkey || ' customer=' || o_custkey as c from orders where o_orderkey % 3 = 0)
  select o_orderkey, '<? ledger ' || c || ' ?>' as string, to_json({'start': {'line': 0, 'character': 1}, 'end': {'line': 0, 'character': 12 + len(c)},
    'target': {'start': {'line': 0, 'character': 3}, 'end': {'line': 0, 'character': 9}, 'value': 'ledger', 'byteOffsets': {'start': 3, 'end': 9}},
    'content': {'start': {'line': 0, 'character': 10}, 'end': {'line': 0, 'character': 10 + len(c)}, 'value': c, 'byteOffsets': {'start': 10, 'end': 10 + len(c)}},
    'byteOffsets': {'start': 1, 'end': 12 + len(c)}})::varchar as json from l"""
)
def instruction_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.markup_events(_ledgers(spark, sf_dir), events="ProcessingInstruction", entities=["proc_inst"])
    p = F.col("proc_inst")
    return found.where(p["target"]["value"] == "ledger").select("o_orderkey", render.proc_inst_string(p).alias("string"), render.proc_inst_json(p).alias("json"))


@query(
    """with cards as (select *, 2 + len('<card nation="' || c_nationkey || '">') as a, 2 + len('<card nation="' || c_nationkey || '">') + len(c_name) as z from customer)
  select c_custkey, to_json({'start': {'line': 0, 'character': a}, 'end': {'line': 0, 'character': z}, 'value': c_name, 'byteOffsets': {'start': a, 'end': z}})::varchar as json from cards"""
)
def text_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = events.markup_events(_cards(spark, sf_dir), events="Text", entities=["text"]).where("text.value <> ' '")
    return found.select("c_custkey", render.text_json(F.col("text")).alias("json"))


# ---- scanner functions over whole documents

_NAME_CHARS = r"A-Za-z_0-9.\x{B7}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{37D}\x{37F}-\x{1FFF}\x{200C}-\x{200D}\x{203F}-\x{2040}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}-"


@query(
    "select doc_id, length(text) as points, (length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))::bigint as units, unicode(text) as code,"
    " regexp_matches(text, '^[\\p{L}_:]') as starts_name, regexp_matches(text, '^[" + _NAME_CHARS + "]') as in_name, string_split(text, 'e')[1] as before_e,"
    " octet_length(encode(left(text, 1)))::int as lead_bytes, lower(left(text, 1)) in ('a', 'e', 'i', 'o', 'u') as vowel from documents where text <> ''"
)
def scanner_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("text")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text <> ''")
    first = F.substring(s, 1, 1)
    lead = F.conv(F.hex(F.substring(F.encode(s, "UTF-8"), 1, 1)), 16, 10).cast("int")
    return docs.select(
        "doc_id", scalars.n_code_points(s).cast("bigint").alias("points"), scalars.utf16_length(s).alias("units"), scalars.to_char_code(s).alias("code"),
        scalars.is_name_start_char(s).alias("starts_name"), scalars.is_name_char(s).alias("in_name"), scalars.take_until(s, "e").alias("before_e"),
        scalars.code_point_bytes(lead).alias("lead_bytes"), scalars.ascii_contains("aeiouAEIOU", first).alias("vowel"),
    )


@query(
    "select doc_id, regexp_extract(text, '^[^.,;]*') as phrase, regexp_extract(text, '^[^.,;]*[.,;]?') as phrase_and_stop, regexp_replace(' ' || chr(9) || text, '^[\\x00-\\x20]+', '') as trimmed,"
    " regexp_matches(text, '[^\\x00-\\x20]') as has_more, lower(source) = lower(upper(source)) as same_source, length(text) as n_pieces,"
    " case when octet_length(encode(right(text, 1))) > 1 then left(hex(encode(right(text, 1))), 2 * octet_length(encode(right(text, 1))) - 2) end as cut_off from documents where text <> ''"
)
def scanner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans up to one of several characters, blanks passed over, and what is left of a character that the last byte is cut from."""
    s, raw = F.col("text"), F.encode(F.col("text"), "UTF-8")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").where("text <> ''")
    cut = F.substring(raw, F.lit(1), F.octet_length(raw) - 1)
    return docs.select(
        "doc_id", scalars.take_until_one_found(s, [".", ",", ";"]).alias("phrase"), scalars.take_until_one_found(s, [".", ",", ";"], True).alias("phrase_and_stop"),
        scalars.skip_whitespace(F.concat(F.lit(" \t"), s)).alias("trimmed"), scalars.has_more_than_whitespace(s).alias("has_more"),
        scalars.ascii_compare(F.col("source"), F.upper("source")).alias("same_source"), F.size(scalars.code_points(s)).cast("bigint").alias("n_pieces"), F.hex(scalars.remaining_bytes(cut)).alias("cut_off"),
    )


@query("select o_orderkey, (o_orderkey % 4294967296)::bigint as small, o_orderkey as wide, o_orderkey as line, o_custkey as character, o_orderpriority as word from orders")
def wire_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, places and strings read back from little-endian bytes."""

    def little(x: Column, n: int) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(n)]))

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    word = F.encode("o_orderpriority", "UTF-8")
    raw = F.concat(little(k, 4), little(k, 8), little(c, 8), word)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority").withColumn("raw", raw)
    b, at = F.col("raw"), scalars.read_position(F.col("raw"), 4)
    return orders.select(
        "o_orderkey", scalars.read_u32(b).alias("small"), scalars.read_u64(b, 4).cast("bigint").alias("wide"), at["line"].alias("line"), at["character"].alias("character"),
        scalars.read_string(b, F.lit(20), F.octet_length(b) - 20).alias("word"),
    )
