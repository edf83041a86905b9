import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import pii
from fieldbook.llm.jaccard import jaccard_join
from fieldbook.llm.substring import substring_dedup


def test_stages_take_effect(spark, data):
    folder = data.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_copies", "repeats", "personal_data", "packing"]
    good = steps["quality"](spark, docs, folder).cache()
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} < before
    assert good.join(labels.where("quality = 0"), "doc_id").count() <= 3
    single = steps["near_copies"](spark, good, folder).cache()
    assert single.columns == columns
    assert single.count() == jaccard_join(good).select("component_id").distinct().count()
    assert jaccard_join(single).where("doc_id <> component_id").count() == 0
    cut = steps["repeats"](spark, single, folder).cache()
    want = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup(single).collect()}
    text = {r["doc_id"]: r["text"] for r in single.collect()}
    assert cut.columns == columns
    for r in cut.collect():
        n, kept = want[r["doc_id"]]
        assert r["text"] == (kept if n else text[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    clean = steps["personal_data"](spark, cut, folder).cache()
    assert clean.columns == columns and clean.count() == cut.count()
    assert not any(pii.base_spans(r["text"]) for r in clean.collect())
    packed = steps["packing"](spark, clean, folder)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_stages_take_odd_tables(spark, data, docs):
    odd = docs.withColumn("_score", F.lit("x")).withColumn("n_words", F.lit(1)).withColumn("c0", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, odd, data)
        assert got.columns == odd.columns and got.count() > 0
        assert stage(spark, odd.limit(0), data).count() == 0


def test_run(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 0


HELD = """
import random, re, sys
from pathlib import Path
import pyarrow as pa
from fieldbook.llm import jaccard, substring

def mb():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

rng = random.Random(5)
words = [f"w{i}" for i in range(20_000)]
batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array([" ".join(rng.choices(words, k=400)) for _ in range(4000)])], ["id", "mark", "text"])
before = mb()
for _ in range(2):
    rows = sum(b.num_rows for b in jaccard._blocks(list(range(12)), 5)(iter([batch.select(["id", "text"])])))
    assert rows and sum(b.num_rows for b in substring._blocks(list(range(12)), 50)(iter([batch])))
print(mb() - before)
"""


def test_workers_give_memory_back():
    """A worker serves many stages; what a stage freed must not stay with it, beside its executor."""
    if not Path("/proc/self/smaps_rollup").exists():
        pytest.skip("needs Linux")
    held = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert float(held.stdout) < 25
