"""The toxicity stage over long texts and labels that teach nothing; words of long texts come piece by piece."""

import os
import random
import subprocess
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tagloom.llm import simhash, toxicity

WORDS = ["ΟΔΟΣ", "Straße", "a", "İx", "word's", "end.", "ΑΣ", "x1_y", "\u0301e", "-", "日本語", "to"]
GAPS = [" ", "\n", "\t \r", "\xa0", "\u2028", "\x0b", "\x1c", ", "]

# 300 documents of 700 KB in one row group, read by two tasks under a heap of one gigabyte
CODE = """
import sys
import pyarrow as pa, pyarrow.parquet as pq
from pyspark.sql import SparkSession
path = sys.argv[1]
for part in range(2):
    ids = range(300 * part, 300 * part + 300)
    texts = [f"{k} " + f"the{k % 7} thing " * 70_000 for k in ids]
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * 300, "source": ["s"] * 300, "n_chars": [len(t) for t in texts]}
    pq.write_table(pa.table(columns), f"{path}/documents.parquet/{part}.parquet", use_dictionary=False)
pq.write_table(pa.table({"doc_id": pa.array(range(20), pa.int64()), "quality": pa.array([1] * 20, pa.int32()), "toxic": pa.array([k % 2 for k in range(20)], pa.int32())}), f"{path}/labels.parquet")
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"{path}/shared").getOrCreate()
import corpus_pipeline
stage = dict(corpus_pipeline.STAGES)["toxicity"]
stage(spark, spark.read.parquet(f"{path}/documents.parquet"), path).write.parquet(f"{path}/out")
print("rows", spark.read.parquet(f"{path}/out").count())
"""


def test_the_toxicity_stage_reads_long_texts_in_a_small_heap(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    (tmp_path / "documents.parquet").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE, str(tmp_path)], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows ")[1]) == 600  # 20 labels teach nothing, so nothing goes


def test_the_language_stage_learns_from_long_texts_in_a_small_heap(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    (tmp_path / "documents.parquet").mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": root}
    code = CODE.replace('["toxicity"]', '["language_id"]')
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], cwd=root, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows ")[1]) == 600


def test_labels_that_teach_nothing_call_nothing_toxic():
    texts = [f"some words {k}" for k in range(20)]
    model = toxicity.fit(texts, np.arange(20) % 2 == 1)
    assert not model.weights and (1 - model.grades(np.array([model.score(t) for t in [*texts, None]]))[:, 0] <= toxicity.THRESHOLD).all()


def odd_text(seed):
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice(GAPS) for _ in range(rng.randrange(60)))


@pytest.mark.parametrize("piece", [1, 2, 7, 40])
def test_words_counted_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    for text in [None, "", " ", "x" * 100, *map(odd_text, range(200))]:
        assert toxicity.text_words(text) == Counter(toxicity._word.findall((text or "").lower()))


@pytest.mark.parametrize("piece", [1, 2, 7, 40])
@pytest.mark.parametrize("words", [1, 3])
def test_fingerprints_by_pieces(monkeypatch, piece, words):
    monkeypatch.setattr(simhash, "BYTES_AT_ONCE", piece)
    for text in [None, "", " \n", "x" * 100, "a b", *map(odd_text, range(200))]:
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[k : k + words]) for k in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64)
        bits = [2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h) for k in range(64)]
        assert simhash.fingerprint(text, words) == sum(1 << k for k, bit in enumerate(bits) if bit)


@pytest.mark.parametrize("of", [toxicity.text_words, simhash.fingerprint])
def test_memory_for_words_does_not_follow_the_text(of):
    text = " ".join(str(k % 1000) for k in range(1_000_000))
    tracemalloc.start()
    of(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * len(text)
