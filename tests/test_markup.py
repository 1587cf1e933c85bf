"""Events in Spark: relations, the Catalyst-only path against the lexer, sources, SQL and streams."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions import render, scalars, udtf
from tagloom.operators import events, slices
from tagloom.operators import lexer as lexer_module
from tagloom.operators.lexer import Attr, Lexer
from tagloom.plans import native
from tagloom.schema import event_fields
from tagloom.sources import markup
from tagloom.streaming import chunks, sinks
from sheets import CASES, SHEETS

SF = "/root/testdata/sf0.001"
ONE, TWO = CASES[9], CASES[10]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, c, "x") for i, c in enumerate(CASES)] + [(900, None, "y")], "doc_id int, content string, seq string").cache()


def test_the_tagged_union(spark, docs):
    out = events.markup_events(docs, keep=["doc_id"])
    assert out.schema.fields[1:] == event_fields()
    rows = out.orderBy("doc_id", "seq").collect()
    want = [(i, n, m) for i, c in enumerate(CASES) for n, m, _ in Lexer().parse(c)]
    assert [(r.doc_id, r.seq, r.event_mask) for r in rows] == want
    assert all(sum(x is not None for x in (r.text, r.attribute, r.tag, r.proc_inst)) == 1 for r in rows)
    tags = iter([r.tag for r in rows if r.doc_id < len(SHEETS) and r.event_type == "CloseTag"])
    for sheet in SHEETS:
        for _, m, e in sheet.expected():
            if m == 256:
                tag = next(tags)
                assert [a.value.value for a in tag.attributes] == [a[1][0] for a in e[1]] and [tuple(t.start) for t in tag.text_nodes] == [t[1] for t in e[2]] and tag.byte_offsets.end == e[9]
    few = events.markup_events(docs, keep=["doc_id"], entities=["tag"])
    assert few.columns == ["doc_id", "seq", "event_type", "event_mask", "tag"] and few.where("tag is not null").count() == sum(r.tag is not None for r in rows)
    clash = events.markup_events(docs)  # a column named seq beside the event's own
    assert clash.columns[:3] == ["doc_id", "seq", "seq"] and clash.count() == len(want)
    assert events.markup_events(docs.limit(0)).count() == 0


def test_flat_relations_agree_with_the_union(docs):
    union = events.markup_events(docs, keep=["doc_id"])
    for kind in ("Text", "Comment", "Cdata", "Doctype", "Declaration"):
        flat = events.relation(docs, kind, keep=["doc_id"]).select("doc_id", "seq", "value", "start_char", "byte_end").collect()
        t = F.col("text")
        want = union.where(F.col("event_type") == kind).select("doc_id", "seq", t["value"], t["start"]["character"], t["byte_offsets"]["end"]).collect()
        assert sorted(map(tuple, flat)) == sorted(map(tuple, want))
    found = events.tag_attributes(union, ["doc_id"]).select("doc_id", "seq", "name", "value", "byte_start").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, events.attributes(docs, keep=["doc_id"]).select("doc_id", "seq", "name", "value", "byte_start").collect()))


def _bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("source", ["cases", "pages"])
def test_catalyst_path_equals_the_lexer(spark, docs, source):
    if source == "pages":
        if not os.path.isdir(SF):
            pytest.skip("no test tables here")
        docs = spark.read.parquet(f"{SF}/pages.parquet").selectExpr("page_id as doc_id", "html as content")
    else:
        docs = docs.select("doc_id", "content")
    for mine, exact in ((native.comments, events.comments), (native.cdata, events.cdata), (native.doctypes, events.doctypes), (native.declarations, events.declarations)):
        assert _bag(mine(docs).select("doc_id", "value")) == _bag(exact(docs).select("doc_id", "value"))
    assert _bag(native.processing_instructions(docs).select("doc_id", "target", "content")) == _bag(events.processing_instructions(docs).select("doc_id", "target", "content"))
    assert _bag(native.open_tags(docs).select("doc_id", "name", "self_closing")) == _bag(events.open_tags(docs).select("doc_id", "name", "self_closing"))
    assert _bag(native.attributes(docs).select("doc_id", "name", "value", "attr_type")) == _bag(events.attributes(docs).select("doc_id", "name", "value", "attr_type"))
    orphans = native.orphan_closings(docs).select("doc_id", F.concat(F.lit("</"), "name", F.lit(">")).alias("value"))
    assert _bag(native.text_lines(docs).select("doc_id", "value").unionByName(orphans)) == _bag(events.text_events(docs).select("doc_id", "value"))
    assert _bag(native.close_tags(docs).select("doc_id", "name", "implicit")) == _bag(events.close_tags(docs).select("doc_id", "name", "implicit"))
    assert _bag(native.unclosed_elements(docs).select("doc_id", "name")) == _bag(events.unclosed_elements(docs).select("doc_id", "name"))


def test_token_offsets(docs):
    rows = native.token_offsets(docs.select("doc_id", "content")).where("kind in ('OpenTag', 'Comment', 'ProcessingInstruction')").collect()
    want = set()
    for i, c in enumerate(CASES):
        for _, m, e in Lexer().parse(c):
            if m in (128, 16, 2):
                start = e.open_start if m == 128 else e.start
                want.add((i, e.byte_start, *start))
    assert {(r.doc_id, r.byte_start, r.start_line, r.start_char) for r in rows} == want


def test_what_is_folded_in_rows_needs_no_shuffle(docs):
    """Places and stacks are found inside a document's row; many documents, also equal ones, are rows of their own."""
    twice = docs.select("doc_id", "content").unionAll(docs.select("doc_id", "content"))
    for relation in (native.token_offsets, native.close_tags, native.orphan_closings, native.unclosed_elements, events.unclosed_elements):
        out = relation(twice)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert _bag(out) == sorted(2 * _bag(relation(docs.select("doc_id", "content"))), key=str)
    assert events.unclosed_elements(docs.select("content", "seq"), keep=[]).count() == events.unclosed_elements(docs.select("doc_id", "content")).count() > 0


def test_many_tags(spark):
    import time

    n = 20_000
    doc = "<a>" + "".join(f"<b{k % 7}>\nt</b{k % 7}><i/></z>" for k in range(n)) + "<p>"
    df = spark.createDataFrame([(1, doc), (3, None), (4, "")], "doc_id int, content string")
    began = time.perf_counter()
    closed = native.close_tags(df).orderBy("close_order").collect()
    assert len(closed) == 2 * n and [r.close_no for r in closed] == sorted(r.close_no for r in closed)
    assert native.orphan_closings(df).count() == n and {r.name for r in native.unclosed_elements(df).collect()} == {"a", "p"}
    places = native.token_offsets(df.where("doc_id = 1")).where("kind = 'OpenTag'").select("byte_start", "start_line", "start_char").collect()
    assert time.perf_counter() - began < 60
    assert sorted(map(tuple, places)) == sorted((e.byte_start, *e.open_start) for _, _, e in Lexer(128).parse(doc))


def test_braces_of_any_depth(spark):
    """Balanced or not, within expressions, texts and quotes: the Catalyst path reads what the lexer reads."""
    rnd, docs = random.Random(5), []
    for depth in (1, 2, 8, 9, 33, 40, 200, 1000):
        deep = "{x" * depth + "}" * depth
        docs += [f"<fen a={deep}>t</fen>", f"}}}}{{<fen a={deep} b={deep[:-1]}}}/>{{<tarn c='{deep[:-1]}' d={{}}>", f"<fen a={deep[:-1]}>", f"<!--{deep[1:]}--><fen {deep}={deep}>{deep}</fen>"]
    docs += ["".join(rnd.choice(["{", "}", "{" * 12, "}" * 12, "<a b={", ">", "} c={", "x", "\ufdd0", "\ufdd11\ufdd2", "</a>"]) for _ in range(60)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, content string")
    assert _bag(native.attributes(df).select("doc_id", "name", "value", "attr_type")) == _bag(events.attributes(df).select("doc_id", "name", "value", "attr_type"))
    assert _bag(native.open_tags(df).select("doc_id", "name", "self_closing")) == _bag(events.open_tags(df).select("doc_id", "name", "self_closing"))
    assert _bag(native.close_tags(df).select("doc_id", "name", "implicit")) == _bag(events.close_tags(df).select("doc_id", "name", "implicit"))
    places = native.token_offsets(df).where("kind = 'OpenTag'").select("doc_id", "byte_start", "byte_end", "start_char")
    assert _bag(places) == _bag(events.open_tags(df).select("doc_id", "byte_start", "byte_end", "open_start_char"))


def test_json_and_strings(spark):
    df = spark.createDataFrame([("low water",), ("<p a={b} c='d'/>",), ("<?ferry at=noon?>",)], "content string")
    rows = events.markup_events(df).select("event_type", render.event_json().alias("j"), render.attribute_string(F.col("attribute")).alias("a"), render.proc_inst_string(F.col("proc_inst")).alias("p")).collect()
    text = json.loads(rows[0].j)
    assert list(text) == ["start", "end", "value", "byteOffsets"] and text["value"] == "low water" and text["end"] == {"line": 0, "character": 9} and text["byteOffsets"] == {"start": 0, "end": 9}
    assert [r.a for r in rows if r.a] == ['a="{b}"', 'c="d"'] and [r.p for r in rows if r.p] == ["<? ferry at=noon ?>"]
    tag = json.loads(next(r.j for r in rows if r.event_type == "CloseTag"))
    assert list(tag) == ["openStart", "openEnd", "closeStart", "closeEnd", "name", "attributes", "textNodes", "selfClosing", "byteOffsets"]


def test_slices(spark):
    doc = "\n\n🦆é<ferry to='é/🦆'>w</ferry>"
    df = spark.createDataFrame([(doc,)], "content string")
    found = events.attributes(df, keep=["content"])
    row = found.select(
        render.slice_position(F.col("content"), F.col("value_start_line"), F.col("value_start_char"), F.col("value_end_char")).alias("a"),
        render.slice_bytes(F.col("content"), F.col("byte_start"), F.col("byte_end")).alias("b"),
    ).first()
    assert (row.a, row.b) == ("é/🦆", "to='é/🦆'")


def test_slices_meet_their_document_once(spark):
    texts = [(k, s.text) for k, s in enumerate(SHEETS)]
    docs = spark.createDataFrame([*texts, (900, None), (None, "x")], "doc_id bigint, content string")
    at = events.attributes(docs).selectExpr("doc_id", "name", "value", "value_start_line as line", "value_start_char as a", "value_end_char as z", "byte_start", "byte_end", "attr_type")
    found = slices.slices(docs, at, ["doc_id"], "content", ("line", "a", "z"))
    rows = found.where("attr_type <> 0 and not contains(value, '\n')").collect()
    assert len(rows) > 50 and all(r.slice == r.value for r in rows)
    rows = slices.slices(docs, at, ["doc_id"], "content", ("byte_start", "byte_end"), "whole").collect()
    by_id = dict(texts)
    assert found.columns == [*at.columns, "slice"] and all(r.whole == by_id[r.doc_id].encode()[r.byte_start : r.byte_end].decode() and r.whole.startswith(r.name) for r in rows)
    odd = spark.createDataFrame([(0, None, 2), (900, 0, 1), (None, 0, 1), (901, 0, 1), (0, 0, 0), (0, 10**9, 10**9 + 1)], "doc_id bigint, a bigint, z bigint")
    got = slices.slices(docs, odd, ["doc_id"], "content", ("a", "z")).collect()
    assert sorted([(r.doc_id, r.a, r.slice) for r in got], key=str) == sorted([(0, None, None), (900, 0, None), (None, 0, None), (901, 0, None), (0, 0, ""), (0, 10**9, "")], key=str)
    plan = slices.slices(docs, at, ["doc_id"], "content", ("line", "a", "z"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_scanner_functions(spark):
    s = F.col("s")
    df = spark.createDataFrame([("🦆waters of the low fen🦆",)], "s string")
    row = df.select(
        F.size(scalars.code_points(s)).alias("n"), scalars.n_code_points(s).alias("m"), scalars.utf16_length(s).alias("u"), scalars.take_until(s, "t").alias("t"), scalars.take_until(s, "t", True).alias("ti"),
        scalars.take_until_one_found(s, ["a", "i"]).alias("o"), scalars.skip_whitespace(F.lit("\n\t  a b")).alias("w"), scalars.to_char_code(s).alias("c"), scalars.ascii_compare(F.lit("DocType"), F.lit("dOCtYPE")).alias("q"),
        scalars.ascii_contains("<>", F.lit(">")).alias("k"), scalars.code_point_bytes(F.lit(0xF0)).alias("b"), F.hex(scalars.remaining_bytes(F.lit(b"ab\xf0\x9f"))).alias("r"), scalars.remaining_bytes(F.lit("é".encode())).alias("r0"),
    ).first()
    whole = "🦆waters of the low fen🦆"
    assert tuple(row) == (len(whole), len(whole), len(whole) + 2, whole[: whole.index("t")], whole[: whole.index("t") + 1], whole[: whole.index("a")], "a b", ord("🦆"), True, True, 4, "F09F", None)
    names = spark.createDataFrame([(c,) for c in "aZ_:1-.é·🚀"], "c string").select("c", scalars.is_name_start_char(F.col("c")).alias("s"), scalars.is_name_char(F.col("c")).alias("n")).collect()
    assert [r.c for r in names if r.s] == list("aZ_:é🚀") and [r.c for r in names if r.n] == list("aZ_1-.é·🚀")


def test_numbers_in_bytes(spark):
    raw = (7).to_bytes(4, "little") + (2**40 + 5).to_bytes(8, "little") + (3).to_bytes(8, "little") + (2**64 - 1).to_bytes(8, "little") + "né".encode()
    b = F.col("b")
    row = spark.createDataFrame([(raw,)], "b binary").select(
        scalars.read_u32(b).alias("a"), scalars.read_u64(b, 4).alias("c"), scalars.read_position(b, F.lit(4)).alias("p"), scalars.read_u64(b, 20).alias("m"), scalars.read_string(b, 28, 3).alias("s")
    ).first()
    assert (row.a, int(row.c), tuple(row.p), int(row.m), row.s) == (7, 2**40 + 5, (2**40 + 5, 3), 2**64 - 1, "né")


def _journal(folder):
    """An opener whose handlers write a file for each batch and partition, and skip those that are there."""

    class Handler:
        def __init__(self, path):
            self.path, self.seen = path, []

        def __call__(self, kind, row):
            self.seen.append([row["doc_id"] if "doc_id" in row else row["path"], row["seq"], kind])

        def close(self):
            with open(self.path, "w") as f:
                json.dump(self.seen, f)

    def opener(batch, partition):
        path = f"{folder}/{batch}-{partition}.json"
        return None if os.path.exists(path) else Handler(path)

    return opener


def test_push_handles_documents_whole_and_in_order(spark, docs, tmp_path):
    folder = tmp_path / "handled"
    folder.mkdir()
    rows = events.markup_events(docs, keep=["doc_id"])
    for _ in range(2):  # the second time all is there already
        sinks.push(rows, _journal(str(folder)), ["doc_id"])
    parts = [json.loads(p.read_text()) for p in folder.iterdir()]
    assert len(parts) > 1
    found = {}
    for part in parts:
        assert part == sorted(part)
        for doc, seq, kind in part:
            found.setdefault(doc, []).append((seq, kind))
        assert not any(doc in {d for d, _, _ in other} for other in parts if other is not part for doc, _, _ in part)
    assert found == {i: [(n, m) for n, m, _ in Lexer().parse(c)] for i, c in enumerate(CASES) if Lexer().parse(c)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(ONE)
    (tmp_path / "streamed").mkdir()
    stream = events.markup_events(markup.stream_documents(spark, str(tmp_path / "in")), keep=["path"])
    q = sinks.push_stream(stream, _journal(str(tmp_path / "streamed")), str(tmp_path / "c"), ["path"])
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = [x for p in (tmp_path / "streamed").iterdir() for x in json.loads(p.read_text())]
    assert [m for _, _, m in got] == [m for _, m, _ in Lexer().parse(ONE)]


def test_streams_of_many_files_have_offsets_of_one_size(spark, tmp_path):
    folder, wrote = tmp_path / "in", 0
    folder.mkdir()

    def run():
        stream = events.markup_events(markup.stream_documents(spark, str(folder), max_files=400), keep=["path"], events="OpenTag", entities=[])
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(300)

    for more in (700, 500):  # the second run begins anew from the checkpoint
        for k in range(wrote, wrote + more):
            (folder / f"{k * 7919 % 10_000:05}.xml").write_text(f"<fen no='{k}'/>")
        wrote += more
        run()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == found.select("path").distinct().count() == wrote
    sizes = {p.stat().st_size for p in (tmp_path / "c" / "offsets").iterdir() if not p.name.startswith(".")}
    assert len(sizes) >= 1 and max(sizes) - min(sizes) < 64


def test_table_function(spark, docs):
    udtf.register(spark)
    rows = spark.sql("select name, value, attr_type, byte_start, byte_end from markup_events('<p a=\"b\">c</p>', 64 + 1)").collect()
    assert [tuple(r) for r in rows] == [("a", "b", 8, 3, 8), (None, "c", None, 9, 10)]
    docs.select("doc_id", "content").createOrReplaceTempView("some_docs")
    got = spark.sql("select d.doc_id, e.* from some_docs d, lateral markup_entities(d.content, 1023) e")
    want = events.markup_events(docs, keep=["doc_id"])
    assert got.schema.names == want.schema.names and got.count() == want.count() and got.exceptAll(want).count() == 0
    older = spark.sql("select value, event_mask from markup_events('<q>< 3</q><!p q>', 5, true)").collect()
    assert [tuple(r) for r in older] == [(" 3", 1), ("q", 512)]


def test_markup_source_pushes_kinds_into_the_scan(spark, tmp_path):
    for k, c in enumerate(CASES):
        (tmp_path / f"d{k:03}.xml").write_bytes(c.encode())
    markup.register(spark)
    df = spark.read.format("markup").option("path", str(tmp_path)).option("chunk", "3").load()
    want = [(n, m) for c in CASES for n, m, _ in Lexer().parse(c)]
    assert sorted((r.seq, r.event_mask) for r in df.select("seq", "event_mask").collect()) == sorted(want)
    some = df.where("event_type in ('Comment', 'Cdata')")
    assert some.count() == sum(m in (16, 512) for _, m in want)
    plan = some._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter" not in plan, plan  # all of it is the scan's
    assert df.where("event_type = 'Nothing'").count() == 0
    assert spark.read.format("markup").option("path", str(tmp_path)).option("events", "Text, Comment").load().select("event_type").distinct().count() == 2
    assert markup.binary_documents(spark, str(tmp_path)).count() == sum(map(bool, CASES))  # empty files have no row


def test_the_read_schema_decides_what_is_built(spark, tmp_path, monkeypatch):
    for k, c in enumerate(CASES):
        (tmp_path / f"d{k:03}.xml").write_bytes(c.encode())
    markup.register(spark)
    for payload, parts in (("full", ["tag", "text, event_type", "seq, event_mask, path", "attribute, proc_inst"]), ("flat", ["name", "value, byte_end, path", "event_type"])):
        source = spark.read.format("markup").option("path", str(tmp_path)).option("payload", payload)
        whole = source.load()
        for part in parts:
            fields = [whole.schema[c] for c in part.split(", ")]
            some = source.schema(T.StructType(fields)).load()
            assert some.columns == part.split(", ") and some.exceptAll(whole.select(*some.columns)).count() == 0 and some.count() == whole.count()
    with pytest.raises(Exception, match="no such columns"):
        source.schema("title string").load().collect()
    built = []
    monkeypatch.setattr(lexer_module, "Attr", lambda *a: built.append(a) or Attr(*a))
    paths = [str(p) for p in tmp_path.iterdir()]

    def count(*columns):
        built.clear()
        for _ in markup.read_files(paths, 128, payload="flat" if columns == ("name",) else "full", columns=list(columns)):
            pass
        return len(built)

    assert count("name") == count("text", "seq") == count("event_type") == 0 < count("tag")


def test_markup_source_as_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.xml").write_text(ONE)
    markup.register(spark)
    stream = spark.readStream.format("markup").option("path", str(folder)).load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
    try:
        q.processAllAvailable()
        (folder / "b.xml").write_text(TWO)
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(Lexer().parse(ONE)) + len(Lexer().parse(TWO))


def test_markup_stream_reads_files_that_sort_before_earlier_ones(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "a").mkdir(parents=True)
    markup.register(spark)
    late = [("part-00007.xml", ONE), ("part-00001.xml", TWO), ("a/z.xml", ONE), ("part-00009.xml", TWO)]
    for k, (name, content) in enumerate(late):
        (folder / name).write_text(content)
        stream = spark.readStream.format("markup").option("path", str(folder)).load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).start(str(tmp_path / "out"))
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = spark.read.parquet(str(tmp_path / "out")).groupBy("path").count().collect()
        assert {r["path"]: r["count"] for r in got} == {str(folder / n): len(Lexer().parse(c)) for n, c in late[: k + 1]}
    reader = markup.MarkupStreamReader(str(folder), 1023, 64, "flat", 1)
    old, end = {"after": str(folder / "part-00001.xml")}, reader.latestOffset()
    new = [p.paths for p in reader.partitions(old, end)]
    assert new == [[str(folder / "part-00007.xml")], [str(folder / "part-00009.xml")]] and reader.partitions(end, end) == []
    assert [p.paths for p in reader.partitions(reader.initialOffset(), old)] == [[str(folder / "a/z.xml")], [str(folder / "part-00001.xml")]]
    (folder / "part-00007.xml").unlink()
    assert reader.latestOffset() == end
    with pytest.raises(FileNotFoundError):
        reader.partitions(reader.initialOffset(), end)


def test_markup_source_gives_whole_entities(spark, tmp_path):
    """A large generated document and small ones: the source's entities are the lexer's, by batch and by stream alike."""
    big = "<list>" + "".join(f'<plant no="{k}" name=\'é{k}\'>row {k}<mark/> of <b>bed</b>\n  next</plant>' for k in range(3000)) + "</list>"
    for k, c in enumerate([*CASES, big]):
        (tmp_path / f"d{k:03}.xml").write_bytes(c.encode())
    markup.register(spark)
    docs = spark.createDataFrame([(f"{tmp_path}/d{k:03}.xml", c) for k, c in enumerate([*CASES, big])], "path string, content string")
    want = events.markup_events(docs)
    got = spark.read.format("markup").option("path", str(tmp_path)).option("chunk", "1000").load()
    assert got.schema == want.schema and got.rdd.getNumPartitions() == 1
    split = spark.read.format("markup").option("path", f"file://{tmp_path}").option("taskBytes", "300").load()
    assert split.rdd.getNumPartitions() > 5
    count = want.count()
    for df in (got, split):
        assert df.count() == count and df.exceptAll(want).count() == 0
    older = spark.read.format("markup").option("path", str(tmp_path)).option("compat", "true").load()
    assert older.exceptAll(events.markup_events(docs, compat=True)).count() == 0 and older.exceptAll(want).count() > 0
    stream = spark.readStream.format("markup").option("path", str(tmp_path)).option("events", "CloseTag").load()
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path.parent / "c9")).trigger(availableNow=True).start(str(tmp_path.parent / "out9"))
    q.awaitTermination(120)
    closed = spark.read.parquet(str(tmp_path.parent / "out9"))
    assert closed.count() == want.where("event_type = 'CloseTag'").count() and closed.exceptAll(want).count() == 0


@pytest.mark.parametrize("size", [7, 64])
def test_chunks_in_a_stream_equal_whole_documents(spark, docs, tmp_path, size):
    payload = "flat" if size == 7 else "full"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    cut = chunks.cut_documents(docs.select("doc_id", "content"), "doc_id", "content", size)
    for k, late in enumerate((1, 0)):  # odd chunks come before even ones
        cut.where(F.col("seq") % 2 == late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del k
    stream = spark.readStream.schema(cut.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = chunks.chunked_events(stream, payload=payload)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(300)
    found = spark.read.parquet(str(tmp_path / "out"))
    if payload == "full":
        whole = events.markup_events(docs, keep=["doc_id"])
        assert found.count() == whole.count() and found.exceptAll(whole).count() == 0
        return
    got = found.select("doc_id", "seq", "event_mask", "value", "byte_start").collect()
    want = []
    for i, c in enumerate(CASES):
        for n, m, e in Lexer().parse(c):
            r = udtf.flat_row(n, m, e)
            want.append((i, n, m, r[4], r[12]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


class _Handle:
    """State of one key in memory, as a stateful processor sees it."""

    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, []

    def getValueState(self, name, _):
        store = self.values

        class Value:
            exists = lambda self: name in store
            get = lambda self: store[name]
            clear = lambda self: store.pop(name, None)

            def update(self, v):
                store[name] = v

        return Value()

    def getMapState(self, name, *_):
        store = self.maps.setdefault(name, {})

        class Map:
            containsKey = lambda self, k: k in store
            getValue = lambda self, k: store[k]
            removeKey = lambda self, k: store.pop(k)
            clear = lambda self: store.clear()

            def updateValue(self, k, v):
                store[k] = v

        return Map()

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


class _Clock:
    def __init__(self, now):
        self.getCurrentProcessingTimeInMs = self.getCurrentWatermarkInMs = lambda: now


def test_late_copies_of_chunks_and_idle_documents():
    import pandas as pd

    def rows(*numbered):
        return iter([pd.DataFrame([(n, c, last) for n, c, last in numbered], columns=["seq", "chunk", "is_last"])])

    handle = _Handle()
    p = chunks.ChunkProcessor(1023, "doc_id", 500, "flat")
    p.init(handle)
    feed = lambda now, *numbered: [len(f) for f in p.handleInputRows((7,), rows(*numbered), _Clock(now))]
    raw = ONE.encode()
    n = len(Lexer().parse(ONE))
    assert feed(0, (1, raw[9:], True)) == [0] and feed(10, (0, raw[:9], False)) == [n]
    assert handle.timers == [510] and not handle.maps["waiting"]
    assert feed(20, (0, raw[:9], False), (1, raw[9:], True)) == [0] and feed(30, (1, raw[9:], True)) == [0]
    assert [len(f) for f in p.handleExpiredTimer((7,), _Clock(600), None)] == [0] and not handle.values
    assert feed(700, (0, raw[:9], False)) == [2] or handle.values  # after its time it is a new document
    assert handle.timers[-1] == 1200


def test_state_goes_when_the_watermark_has_passed(spark, tmp_path):
    """Finished documents and such as wait for a lost chunk: no state is left, and late copies give nothing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda minute: datetime.datetime(2024, 5, 1, 0, minute)
    batches = [
        [(1, 0, b"<fen>", False, at(0)), (1, 1, b"</fen>", True, at(1)), (2, 0, b"<moor>", False, at(1)), (2, 2, b"</moor>", True, at(2))],  # of 2 a chunk is lost
        [(3, 0, b"<tarn/>", True, at(40))],
        [(4, 0, b"<bog/>", True, at(41))],
        [(1, 0, b"<fen>", False, at(0)), (2, 1, b"late", False, at(1)), (5, 0, b"<lea/>", True, at(59))],
        [(6, 0, b"<lea/>", True, at(59))],
    ]
    schema = "doc_id bigint, seq bigint, chunk binary, is_last boolean, ts timestamp"
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        out = chunks.chunked_events(stream, payload="flat", event_time="ts", delay="10 minutes", idle_ms=60_000)
        q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(300)
        progress.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    got = sorted((r.doc_id, r.seq, r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).where("event_type in ('OpenTag', 'CloseTag')").collect())
    assert [(d, k) for d, _, k in got] == [(1, "OpenTag"), (1, "CloseTag"), (2, "OpenTag"), *[(d, k) for d in (3, 4, 5, 6) for k in ("OpenTag", "CloseTag")]]
    assert progress[-1] <= 2 * progress[0], progress  # that of 5 and 6 at most


def test_late_chunks_in_their_own_time():
    import pandas as pd

    def rows(*numbered):
        return iter([pd.DataFrame([(n, c, last, pd.Timestamp(t, unit="ms")) for n, c, last, t in numbered], columns=["seq", "chunk", "is_last", "ts"])])

    handle = _Handle()
    p = chunks.ChunkProcessor(1023, "doc_id", 500, "flat", False, "ts")
    p.init(handle)
    feed = lambda mark, *numbered: [len(f) for f in p.handleInputRows((7,), rows(*numbered), _Clock(mark))]
    assert feed(0, (1, b"</a>", True, 2000)) == [0] and handle.timers == [2500]
    assert feed(100, (0, b"<a>", False, 1000)) == [3] and handle.timers == [2500]  # an earlier chunk shortens nothing
    assert feed(2000, (0, b"<a>", False, 1500)) == [0] and feed(2100, (0, b"<a>", False, 3000)) == [0] and handle.timers == [3500]
    assert [len(f) for f in p.handleExpiredTimer((7,), _Clock(3600), None)] == [0] and not handle.values
    assert feed(3600, (0, b"<a>", False, 3500)) == [0] and not handle.values
