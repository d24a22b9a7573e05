from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from tallybird.llm.secret_ledger import scan_versions
from test_decontaminate import holds
from test_mixing import brute as mixed
from test_ngram_join import brute as classes

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def stages(spark, data_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{data_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data_dir).write.parquet(f"{folder}/{k}")
        out.append((docs, spark.read.parquet(f"{folder}/{k}")))
        docs = out[-1][1]
    return out


def test_columns(stages):
    for before, after in stages[:-1]:
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in before.schema]


def test_rejected_documents_go(spark, stages, data_dir):
    before, after = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert kept < {r["doc_id"] for r in before.collect()}
    assert sum(i in kept for i in good) >= 0.9 * len(good)


def test_one_of_each_class_stays(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({c for _, c, _ in classes(rows)})


def test_contaminated_documents_go(spark, stages, data_dir):
    before, after = stages[2]
    items = [r["text"] for r in spark.read.parquet(f"{data_dir}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after.collect()}
    for row in before.collect():
        if any(item in row["text"] for item in items):
            assert row["doc_id"] not in kept
        elif row["doc_id"] not in kept:
            assert any(holds(row["text"], item) for item in items)


def test_secrets_are_cut_out(stages):
    before, after = stages[3]
    assert after.count() == before.count()
    assert scan_versions(after).where("findings IS NOT NULL").count() == 0


def test_the_mixture(stages):
    before, after = stages[4]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in after.collect()]
    assert sorted(got, key=repr) == sorted((m for m in mixed(rows) if m[4] > 0), key=repr)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)]], ids=["no labels", "one kind"])
def test_without_a_classifier_documents_stay(spark, tmp_path, labels):
    text = "A document with some words number {} that nobody has labelled as good or bad so far."
    rows = [(k, text.format(chr(97 + k) * 9) if k else None, "en", "s", 1) for k in range(5)] + [(None, "no id " * 9, None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "an item of the benchmark")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.quality(spark, docs, str(tmp_path)).count() == 6
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert set(docs.columns) <= set(mixed.columns)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_the_rest_works_without_this_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['tallybird', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'rfm_segments' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
