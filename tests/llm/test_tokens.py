"""Encoding, the separator scan and packing."""

import functools
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import packing, tokens


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def plain(text, specials_as_text=False):
    t = tokenizer()
    t.encode_special_tokens = specials_as_text
    return t.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aAȩ́́ \t\n\x1c\x1f\x85　​'sΣσ1-<|endoftext|>👅", max_size=30))
def test_ids_equal_the_tokenizer_s(text):
    assert tokens.encoder().ids([text])[0].tolist() == plain(text)
    assert tokens.encoder(tokens.VOCABULARY, True).ids([text])[0].tolist() == plain(text, True)


def test_special_strings_are_told_by_their_case():
    for text in ("<|ENDOFTEXT|>", "<|endoftext|>", "A <|EndOfText|>, b <|endoftext|>c"):
        assert tokens.encoder().ids([text])[0].tolist() == plain(text)


def test_memory_is_bounded_in_bytes():
    e = tokens.Encoder(limit=50_000)
    for k in range(40):
        e.ids([f"{chr(97 + k % 26) * 5000} 漢{'字' * 3000} " + " ".join(f"w{k}x{i}" for i in range(300))])
        assert e.known.size < 50_000 + 300 * 300 and max(map(len, e.known), default=0) <= tokens.LONG
    assert e.ids(["字" * 3000 + " a" * 3])[0].tolist() == plain("字" * 3000 + " a" * 3)


@pytest.mark.parametrize("limit", [3, 700])
def test_a_full_memory_is_emptied(limit):
    e = tokens.Encoder(limit=limit)
    for text in ("a b c d e", "f g", "a f", "one two three four", "it's, it.", "e..., f.,", "A b f g one", "We're. I'd!"):
        assert e.ids([text])[0].tolist() == plain(text)


def test_ids_of_the_corpus_equal_the_tokenizer_s(sf):
    import duckdb

    texts = [r[0] for r in duckdb.sql(f"select text from '{sf}/documents.parquet' where text is not null").fetchall()]
    got = tokens.Encoder(limit=500).ids(texts)
    assert all(g.tolist() == plain(t) for g, t in zip(got, texts))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_scan_of_blocks_equals_a_whole_scan(spark, monkeypatch, size):
    monkeypatch.setattr(tokens, "SUPER", 3)
    rng = np.random.default_rng(size)
    rows, want = [], []
    for f in range(4):
        ids = rng.choice([1, 2, 3, 9], 60, p=[0.3, 0.3, 0.1, 0.3] if f < 3 else [0.5, 0.4, 0.1, 0]).astype("<u4")
        rows += [(f, k, ids[a : a + size].tobytes()) for k, a in enumerate(range(0, len(ids), size))]
        ends = np.flatnonzero(ids == 9)
        want += [(f, k, int(n)) for k, n in enumerate(np.diff(np.append(-1, ends)) - 1)]
    blocks = spark.createDataFrame(rows, "file int, block bigint, ids binary").repartition(5)
    got = tokens.document_counts(tokens.stitch(tokens.scan_separators(blocks, 9))).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("block", [1, 5, 1 << 18])
def test_a_flat_file_is_cut_into_byte_ranges(spark, tmp_path, block):
    """Files that nothing but their ids is known of: large, empty, without a separator, ending in an open document."""
    rng = np.random.default_rng(block)
    want, rows = [], []
    for f, n in enumerate([400, 0, 30, 1]):
        ids = rng.choice([1, 2, 9], n, p=[0.5, 0.3, 0.2] if f != 2 else [0.5, 0.5, 0]).astype("<u2")
        (tmp_path / f"{f}.bin").write_bytes(ids.tobytes())
        rows.append((f, f"file:{tmp_path}/{f}.bin" if f % 2 else f"{tmp_path}/{f}.bin"))
        want += [(f, k, int(x)) for k, x in enumerate(np.diff(np.append(-1, np.flatnonzero(ids == 9))) - 1)]
    files = spark.createDataFrame(rows, "file int, path string")
    got = tokens.document_counts(tokens.stitch(tokens.scan_token_files(files, 9, "<u2", block))).collect()
    assert sorted(map(tuple, got)) == want
    (tmp_path / "0.bin").write_bytes(b"odd")
    with pytest.raises(Exception, match="doesn't divide"):
        tokens.scan_token_files(files, 9, "<u2", block).collect()


def test_token_counts(spark, sf):
    odd = spark.createDataFrame(
        [(1, None, 0, "x"), (2, "", 0, "x"), (None, "a b", 1, "x"), (3, "word " * 270_000, 0, "x"), (3, "word " * 270_000, 0, "x"), (4, "<|endoftext|>", 0, None)],
        "doc_id bigint, text string, file int, ordinal string",
    ).coalesce(1)
    corpus = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "n_chars")
    for df in (odd, corpus, odd.limit(0)):
        want = [(r.doc_id, len(plain(r.text or "", True))) for r in df.collect()]
        assert sorted(((r.doc_id, r.n_tokens) for r in tokens.token_counts(df).collect()), key=str) == sorted(want, key=str)


def brute_best_fit(lengths, capacity, limit):
    bins, out, closed = [], [], 0
    for x in lengths:
        fits = [b for b in bins if b[1] >= x]
        if fits:
            b = min(fits, key=lambda b: b[1])
        else:
            if len(bins) >= limit and x < capacity:
                bins.remove(min(bins, key=lambda b: b[1]))
            b = [closed, capacity]
            closed += 1
            bins.append(b)
        out.append(b[1])
        b[1] -= x
        bins = [b for b in bins if b[1]]
    return closed, out


def test_columns_of_the_result_replace_those_of_the_pieces(spark):
    df = spark.range(50).selectExpr("id", "id % 9 + 1 as length", "'x' as sequence_id", "id as offset", "1 as __seed")
    for window in (1, 7):
        out = packing.best_fit(df, capacity=10, window=window)
        assert out.columns == ["id", "length", "__seed", "sequence_id", "offset"] and out.count() == 50
        assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 10").count() == 0


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_best_fit_takes_the_space_that_brute_force_takes(limit):
    rng = np.random.default_rng(limit)
    lengths = rng.integers(1, 101, 2000).tolist()
    p = packing.BestFit(100, limit)
    placed = [p.place(x) for x in lengths]
    n, free = brute_best_fit(lengths, 100, limit)
    assert p.n_bins == n and [100 - at for _, at in placed] == free


def check_packing(pieces, docs, capacity=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert sum(len(x) for x in by_doc.values()) == len(pieces)
    for doc_id, text in docs:
        ids = np.array([*plain(text or ""), 0], "<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(math.ceil(len(ids) / capacity)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * capacity and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert sum(r.length for r in own) == len(ids)
    return len(by_sequence)


def test_documents_are_packed(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack_documents(df).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert n <= math.ceil(sum(r.length for r in rows) / 2048) * 1.002 + 1


def test_odd_documents_are_packed(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a", 5), (3, "word " * 10_000, 5), (4, "a b c", 5)], "doc_id bigint, text string, length int")
    check_packing(packing.pack_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    repeated = packing.pack_documents(df.union(df)).collect()
    assert len(repeated) == 2 * packing.pack_documents(df).count()
    assert packing.pack_documents(df.limit(0)).count() == 0
    several = packing.best_fit(spark.range(1000).selectExpr("id", "id % 90 + 1 as length"), capacity=100, group=200)
    assert several.select("sequence_id").distinct().count() <= math.ceil(several.agg({"length": "sum"}).first()[0] / 100) + 20
    for bad in (None, 0, 101):
        with pytest.raises(Exception, match="a piece has"):
            packing.best_fit(spark.createDataFrame([(bad,)], "length bigint"), capacity=100).collect()


def test_plain_online_packing_of_the_table_closes_the_fullest(spark, sf):
    """Arrivals one by one into so few bins that these fill up: against a plain list of open bins, last filled last."""
    pieces = packing.token_pieces(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).cache()
    rows = sorted(packing.best_fit(pieces, open_bins=12, window=1, group=10**9).collect(), key=lambda r: (r.sequence_id, r.offset))
    order = F.xxhash64(F.lit(packing.SEED), *pieces.columns)
    arrivals = [r.length for r in pieces.orderBy(order).collect()]
    bins, made, closed = [], [], 0
    for length in arrivals:
        fit = [b for b in reversed(bins) if b[0] >= length]  # of equals the one that was filled last
        if fit:
            b = min(fit, key=lambda b: b[0])
            bins = [x for x in bins if x is not b]
        else:
            if len(bins) == 12 and length < 2048:  # a full bin takes no place
                fullest = min(reversed(bins), key=lambda b: b[0])
                bins = [x for x in bins if x is not fullest]
                closed += 1
            b = [2048, []]
            made.append(b)
        b[0] -= length
        b[1].append(length)
        if b[0]:
            bins.append(b)
    got = defaultdict(list)
    for r in rows:
        got[r.sequence_id].append(r.length)
    assert closed > 100 and sorted(map(sorted, got.values())) == sorted(sorted(b[1]) for b in made)
