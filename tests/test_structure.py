"""Parents, depths and joins by containment against plain loops."""

import random

import pytest

from tagloom.operators import blocks, events, structure
from test_blocks import odd_documents


def by_brute_force(rows):
    """Parents of opening tags from the events of whole documents, by a plain stack of first bytes."""
    out, stack, key = [], [], object()
    for doc, seq, kind, name, a, z, closing in rows:
        if doc != key:
            key, stack = doc, []
        if kind == "OpenTag":
            out.append((doc, name, a, z, len(stack), *(stack[-1] if stack else (None, None))))
            if not closing:
                stack.append((name, a))
        elif (name, a) in stack:
            stack.remove((name, a))
    return out


@pytest.mark.parametrize("how", ["whole", "split"])
def test_parents(spark, how):
    df = spark.createDataFrame(odd_documents(), "doc_id bigint, content string")
    found = events.markup_events(df, events=["OpenTag", "CloseTag"], entities=["tag"])
    rows = found.selectExpr("doc_id", "seq", "event_type", "tag.name", "tag.byte_offsets.start", "tag.byte_offsets.end", "tag.self_closing").collect()
    want = by_brute_force(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
    if how == "whole":
        got = structure.element_parents(df)
    else:
        got = blocks.split_parents(blocks.split_documents(blocks.text_blocks(df, ["doc_id"], size=29), ["doc_id"]), ["doc_id"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [1, 7, 1 << 22])
@pytest.mark.parametrize("nested", [True, False])
def test_containment(spark, width, nested):
    rnd = random.Random(3)

    def ranges(lo, hi, depth):
        out = [(lo, hi)]
        if depth and hi - lo > 3:
            mid = rnd.randint(lo, hi)
            out += ranges(lo, mid, depth - 1) + ranges(mid, hi, depth - 1)
        return out

    rows = []
    for doc in (1, 2):
        found = ranges(0, 60, 4) if nested else [tuple(sorted((rnd.randint(0, 60), rnd.randint(0, 60)))) for _ in range(40)]
        rows += [(doc, f"r{k}", a, z) for k, (a, z) in enumerate(found)]
    rows += [rows[0], (None, "null", 0, 9), (1, "open", None, 3), (3, "alone", 0, 5)]
    outer, inner = rows[::2], rows[1::2] + rows[:6]
    schema = "doc_id bigint, outer string, byte_start bigint, byte_end bigint"
    got = structure.contained(spark.createDataFrame(outer, schema), spark.createDataFrame(inner, schema.replace("outer", "inner")), ["doc_id"], width=width)
    want = [
        (o[0], o[1], i[1]) for o in outer for i in inner
        if o[0] is not None and o[0] == i[0] and None not in (o[2], i[2]) and o[2] <= i[2] and i[3] <= o[3] and o[2:] != i[2:]
    ]
    assert sorted((r.doc_id, r.outer.outer, r.inner.inner) for r in got.collect()) == sorted(want) and want


def test_containment_plans_no_inequality_join(spark):
    df = spark.createDataFrame([(1, 0, 9)], "doc_id bigint, byte_start bigint, byte_end bigint")
    plan = structure.contained(df, df, ["doc_id"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert structure.contained(df.limit(0), df, ["doc_id"]).count() == structure.contained(df, df.limit(0), ["doc_id"]).count() == 0
