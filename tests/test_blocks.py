"""One document over many tasks: any cuts give the events of the whole document."""

import pickle
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.operators import blocks, events, states
from tagloom.operators.lexer import FLAT, Lexer
from tagloom.plans import prefix
from tagloom.schema import EventType

# pieces of all constructs, whole and broken, so that cuts and joins of them meet every state
PIECES = [
    "<li>", "</li>", "<b k='1' m=\"2\"", "<c", "/>", ">", " ", "\n", "<!--", "-->", "-", "<![CDATA[", "]]>", "]", "<?p q", "?>", "<!DOCTYPE w [", "<!ENTITY e>", "<!", "!",
    "{", "}", "={", "=", "'", '"', "/", "words", "<", "<<", "</", "é", "👅", "<>", "</>", "d=e/", "f=g ", "\t", "b>", "</b>", "h",
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join)


def cut(text, places):
    places = sorted({p % len(text) for p in places} - {0}) if text else []
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)]) if b > a]


def in_process(pieces):
    """The same steps without Spark, folded from the left."""
    at, segments, nest, out = (states.UNCHANGED, blocks._Measure()), [], blocks.START, []
    for k, piece in enumerate(pieces):
        own = (states.read_block(piece), blocks._measured(piece))
        way = own[0].way(at[0].way("T").end)
        where, skipping = (0, False) if k == 0 else (way.cut, way.skipping)
        head = piece if where < 0 else piece[:where]
        if head:
            segments[-1]["text"] += head
        if where >= 0:
            place = blocks._after(at, (states.UNCHANGED, blocks._measured(head)))[1]
            segments.append({"text": piece[where:], "skipping": skipping, "byte": place.bytes, "line": place.breaks, "column": place.tail})
        at = blocks._after(at, own)
    for row in segments:
        lexer = Lexer(1023, False, FLAT)
        blocks._begin(lexer, row, nest)
        out += lexer._read(row["text"], True)
        nest = blocks.nested(nest, blocks._Folder().nesting(row))
    return out


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 1000), max_size=8))
def test_cuts_change_nothing(text, places):
    assert in_process(cut(text, places)) == Lexer(1023, False, FLAT).parse(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.lists(st.integers(0, 1000), max_size=6), st.integers(0, 6))
def test_maps_of_states_compose_in_any_grouping(text, places, k):
    maps = [states.read_block(x) for x in cut(text, places)]
    left, right = states.UNCHANGED, states.UNCHANGED
    for m in maps[:k]:
        left = states.compose(left, m)
    for m in maps[k:]:
        right = states.compose(right, m)
    whole = states.compose(left, right)
    for state in [*states.PLAIN, "J1", "J2", "J7"]:
        end = state
        for m in maps:
            end = m.way(end).end
        assert whole.way(state).end == end == states.compose(right, states.UNCHANGED).way(left.way(state).end).end


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<a>", "<b>", "<c/>", "</a>", "</b>", "</x>", "t", "<a k='v'>"]), max_size=30), st.integers(0, 30), st.integers(0, 30))
def test_nestings_merge_in_any_grouping(pieces, i, j):
    place = {"skipping": False, "byte": 0, "line": 0, "column": 0}
    i, j = sorted((min(i, len(pieces)), min(j, len(pieces))))
    a, b, c = (blocks._Folder().nesting({"text": "".join(x), **place}) for x in (pieces[:i], pieces[i:j], pieces[j:]))
    assert blocks.nested(blocks.nested(a, b), c) == blocks.nested(a, blocks.nested(b, c))
    assert blocks.nested(blocks.NOTHING, a) == a == blocks.nested(a, blocks.NOTHING)


@pytest.mark.parametrize("text", ["}" * 400_000, "<a " + "}" * 200_000 + " b" * 50_000, "<a x={" * 50_000, "- -" * 100_000, "<<<" * 100_000, "} a='x' " * 40_000])
def test_hard_blocks_take_linear_time(text):
    states.read_block(text)  # by squares these would take minutes


def odd_documents():
    rnd = random.Random(11)
    docs = [(k, "".join(rnd.choice(PIECES) for _ in range(rnd.randint(20, 120)))) for k in range(30)]
    return docs + [(100, None), (101, ""), (102, "x"), (None, "<q>null key</q> <r"), (103, "<a title='" + "long " * 300 + "'>t</a>"), (104, "﻿<a>\n  b</a>"), (105, "<a>" * 40 + "</b>" * 3 + "</a>" * 41)]


@pytest.fixture(scope="module")
def split(spark):
    df = spark.createDataFrame(odd_documents(), "doc_id bigint, content string")
    return df, blocks.split_documents(blocks.text_blocks(df, ["doc_id"], size=13), ["doc_id"])


@pytest.mark.parametrize("kind", [e.name for e in EventType])
def test_relations_of_split_documents(split, kind):
    df, segments = split
    want = events.relation(df, kind)
    got = blocks.split_relation(segments, ["doc_id"], kind)
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_numbers_of_split_documents(split):
    df, segments = split
    want = events.markup_events(df, entities=[]).select("doc_id", "seq", "event_mask")
    assert sorted(map(tuple, blocks.split_events(segments, ["doc_id"]).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_document_is_no_event(spark):
    none = spark.createDataFrame([], "doc_id bigint, block_no bigint, text string, cut int, segment string")
    assert blocks.split_events(blocks.split_documents(none, ["doc_id"]), ["doc_id"]).count() == 0


def test_files_by_ranges(spark, tmp_path):
    texts = {"a.xml": "<r>" + "<é k='👅'>ü\n </é>" * 200 + "</r>", "b.xml": "👅" * 50, "c.xml": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    found = blocks.file_blocks(spark, str(tmp_path), size=37).withColumn("path", F.substring_index("path", "/", -1))
    assert found.count() > 100 and found.agg(F.max(F.octet_length("text"))).first()[0] <= 40
    got = blocks.split_relation(blocks.split_documents(found, ["path"]), ["path"], "CloseTag")
    want = events.relation(spark.createDataFrame(list(texts.items()), "path string, content string"), "CloseTag")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_what_is_known_before_a_segment_is_what_it_closes():
    place = {"skipping": False, "byte": 0, "line": 0, "column": 0}
    own = [blocks._Folder().nesting({"text": x, **place}) for x in ["<html><body>"] * 3000 + ["<p>t</p></x>"] * 100 + ["</body>", "t</html></body>"]]
    before = list(blocks._open_before(None, own))
    assert [len(b.levels[0].opened) for b in before] == [0, *[1] * 3099, 2, 3]
    assert before[-1].below == 5996 and [x[0] for x in before[-1].levels[0].opened] == ["html", "body", "html"]
    # in runs it is the same
    whole = list(blocks._open_before(None, [blocks._joined_nestings(own[a : a + 64]) for a in range(0, len(own), 64)]))
    assert [x for k, b in enumerate(whole) for x in blocks._open_before(b, own[64 * k : 64 * k + 64])] == before


def test_runs_of_a_scan_follow_rows_not_numbers(spark):
    n = 4 * prefix.WIDTH
    df = spark.range(n).selectExpr("0 as document", "id * 1000000007 as block_no", "cast('' as binary) as summary")
    one = pickle.dumps(1)
    df = df.withColumn("summary", F.lit(bytearray(one)))
    folded = spark.sparkContext.accumulator(0)

    def fold(run):
        folded.add(1)
        return sum(run)

    def walk(before, run):
        for x in run:
            yield before or 0
            before = (before or 0) + x

    got = prefix.exclusive_scan(df, ["document"], "block_no", fold, walk).orderBy("block_no").collect()
    assert [pickle.loads(r.before) for r in got] == list(range(n))
    assert folded.value < n / 8  # a run for each number's range would be one for each row


def test_small_blocks_are_not_tasks_of_a_few_rows(spark):
    read = spark.range(100_000).selectExpr("id as block_no", "1000L as size")
    assert blocks._tasks_of(read) <= 12 + spark.sparkContext.defaultParallelism
