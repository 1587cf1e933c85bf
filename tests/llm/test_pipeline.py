"""The pipeline's stages against plain readings of their own inputs, and the entry module's guard."""

import os
import subprocess
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tagloom.llm import langid, simhash, toxicity
from tagloom.llm._base import table
from test_dedup import roots
from test_tokens import check_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Each stage's result, written and read again."""
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_the_stages_are_these():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "temperature_mixing", "best_fit_packing"]


def test_language_stage(spark, sf, stages):
    docs = table(spark, sf, "documents")
    net = langid.fit_on(docs)
    everything = docs.collect()
    langs, scores = langid.predict(net, pa.array([r.text for r in everything], pa.string()))
    want = [tuple(r) for r, lang, s in zip(everything, langs, scores) if lang != "und" and s >= corpus_pipeline.LEAST_SCORE]
    assert Counter(rows(stages[0])) == Counter(want) and stages[0].columns == COLUMNS


def test_toxicity_stage(spark, sf, stages):
    model = toxicity.fit_on(table(spark, sf, "documents"), table(spark, sf, "labels"))
    want = [tuple(r) for r in stages[0].collect() if 1 - model.grades(np.array([model.score(r.text)]))[0, 0] <= toxicity.THRESHOLD]
    assert Counter(rows(stages[1])) == Counter(want) and stages[1].columns == COLUMNS


def test_dedup_stage(stages):
    docs = stages[1].collect()
    x = np.array([simhash.fingerprint(r.text) for r in docs], np.uint64)
    root = roots(len(x), zip(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)))
    least = {}
    for k, r in zip(root, docs):
        least[k] = min(least.get(k, r), r, key=lambda r: r.doc_id)
    assert Counter(rows(stages[2])) == Counter(tuple(r) for r in least.values()) and stages[2].columns == COLUMNS


def test_mixing_stage(stages):
    before, after = Counter(rows(stages[2])), Counter(rows(stages[3]))
    assert set(before) == set(after) and stages[3].columns == COLUMNS
    tokens = lambda c: {s: sum(n * len((r[1] or "").split()) for r, n in c.items() if r[3] == s) for s in {r[3] for r in c}}
    was, now = tokens(before), tokens(after)
    ratio = {s: now[s] / was[s] for s in was}
    assert max(ratio.values()) <= corpus_pipeline.MAX_REPEATS + 1e-6 and min(ratio.values()) >= 1
    # the fewer tokens a source has, the more often it is taken, but for the rows that don't fit at its budget's end
    ordered = [ratio[s] for s in sorted(was, key=was.get)]
    assert all(a >= b - 0.2 for a, b in zip(ordered, ordered[1:])) and ratio[max(was, key=was.get)] == 1


def test_packing_stage(stages):
    docs = stages[3].select("doc_id", "text").collect()
    copies = Counter(r.doc_id for r in docs)
    pieces = stages[4].collect()
    seen: Counter = Counter()
    first = []
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.piece, r.sequence_id, r.offset)):
        seen[r.doc_id, r.piece] += 1
        if seen[r.doc_id, r.piece] == 1:
            first.append(r)
    assert all(n == copies[d] for (d, _), n in seen.items())
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    once = {r.doc_id: r.text for r in docs}
    check_documents(first, once)


def check_documents(pieces, texts):
    """Every document's pieces, whatever the sequences hold of others."""
    moved = [Piece(r.doc_id, r.piece, r.start, r.length, r.ids_crc32, k) for k, r in enumerate(pieces)]
    check_packing(moved, list(texts.items()))


class Piece:
    def __init__(self, doc_id, piece, start, length, ids_crc32, k):
        self.doc_id, self.piece, self.start, self.length, self.ids_crc32 = doc_id, piece, start, length, ids_crc32
        self.sequence_id, self.offset = k, 0


def test_run_is_the_stages(spark, sf, stages):
    key = lambda df: Counter((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(stages[4])


def test_odd_documents_pass_through_all_stages(spark, sf):
    schema = table(spark, sf, "documents").schema
    odd = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "the of and to in is was " * 30, "en", None, 5), (4, "x", "en", "a", 1), (5, "the of and thing " * 30_000, None, "b", 9), (5, "the of and thing " * 30_000, None, "b", 9)]
    docs = spark.createDataFrame(odd, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() > 0
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_the_rest_stands_without_this_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'open_tags' in q and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql()"
    import shutil

    shutil.copytree(os.path.join(root, "tagloom"), tmp_path / "tagloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "tests"), tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    # what the caller put on the path stays, but for this repository
    kept = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(root)]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join(kept)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
    some = ["tests/test_lexer.py", "tests/test_markup.py", "tests/test_queries.py"]
    few = "sheet or tagged_union or entry or open_tag or comments or descendants"
    subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", "-k", few, *some], cwd=tmp_path, env=env, check=True)


def test_texts_of_unknown_scripts_go_and_clean_ones_stay(spark, sf):
    docs = table(spark, sf, "documents")
    net = langid.fit_on(docs)
    foreign = ["Это обычный русский текст о погоде и о людях. " * 8, "这是一段关于天气和城市的中文文字，没有任何已知语言。" * 12, "Η γλώσσα αυτή είναι ελληνικά. " * 8]
    more = spark.createDataFrame([(-1 - k, t, "xx", "s", len(t)) for k, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in langid.keep_identified(docs.unionByName(more), net, least=corpus_pipeline.LEAST_SCORE).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
