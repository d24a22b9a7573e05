from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallybird.operators import forest_table as forest


def _data(spark, n, parts=4):
    """Label 1 mostly where a is large or b is 2; c tells nothing, d never varies."""
    draw = lambda k: (F.xxhash64("id", F.lit(k)) % 1000 + 1000) % 1000 / 1000.0
    return spark.range(0, n, 1, parts).select(
        F.col("id").alias("customer_id"), draw(1).alias("a"), F.floor(draw(2) * 3).alias("b"), draw(3).alias("c"),
        F.lit(7).alias("d"), ((draw(1) > 0.6) | (F.floor(draw(2) * 3) == 2)).cast("int").alias("sure"), draw(4).alias("noise"),
    ).withColumn("churned", F.when(F.col("noise") < 0.1, 1 - F.col("sure")).otherwise(F.col("sure")))


COLUMNS = ["a", "b", "c", "d"]


def _nodes(spark, model):
    return rows(model.nodes(spark).select("tree", "node", "depth", "feature", "bin", "n0", "n1", "gain"))


def test_levels_and_subtrees_give_the_same_trees(spark, tmp_path):
    df = _data(spark, 1500)
    fits = [
        forest.fit_forest_table(df, COLUMNS, f"{tmp_path}/{small}", trees=6, small=small) for small in (10**9, 200)
    ]
    one, other = (_nodes(spark, m) for m in fits)
    assert one == other and max(r[2] for r in one) > 8
    # neither do they depend on the layout of the rows
    third = forest.fit_forest_table(df.repartition(3, "c"), COLUMNS, f"{tmp_path}/3", trees=6, small=400)
    assert _nodes(spark, third) == one
    for model in fits:
        assert tuple(forest.forest_checks(spark, model).first()) == (6, 6, 0, 1.0)


def test_nodes_hold_what_reaches_them(spark, tmp_path):
    """Counts and shares against a walk of every row through the table, one row and node at a time."""
    df = _data(spark, 300)
    model = forest.fit_forest_table(df, COLUMNS, f"{tmp_path}/m", trees=3, small=100)
    nodes = {(r["tree"], r["node"]): r for r in model.nodes(spark).collect()}
    assert len(nodes) == model.nodes(spark).count()
    data = df.withColumn("key", F.xxhash64("customer_id")).collect()
    seen, share = {}, {}
    for r in data:
        put = [int(np.searchsorted(model.edges[k], float(r[c]))) for k, c in enumerate(COLUMNS)]
        found = []
        for tree in range(3):
            times = int(forest.draws(np.array([r["key"]]), tree, model.seed)[0])
            name = forest.root(tree, model.seed)
            while True:
                node = nodes[tree, name]
                n = seen.setdefault((tree, name), [0, 0])
                n[r["churned"]] += times
                if node["feature"] < 0:
                    break
                name = int(forest.child(np.array([name]), np.array([put[node["feature"]] > node["bin"]]))[0])
            found.append(node["n1"] * model.weight[1] / (node["n0"] * model.weight[0] + node["n1"] * model.weight[1]))
        share[r["customer_id"]] = np.mean(found)
    assert {k: v for k, v in seen.items() if sum(v)} == {k: [r["n0"], r["n1"]] for k, r in nodes.items()}
    scored = dict(rows(forest.score_forest_table(model, df)))
    assert scored == pytest.approx(share)


def test_best_cut_is_the_least_impure_one():
    rng = np.random.default_rng(3)
    weight = np.array([0.7, 1.9])
    gini = lambda n: (w := n * weight).sum() - (w**2).sum() / w.sum()
    for _ in range(50):
        hist = rng.integers(0, 4, (1, forest.BINS, 2)) * (rng.random((1, forest.BINS, 1)) < 0.1)
        filled = np.flatnonzero(hist[0].sum(1))
        cut, gain = forest.cuts(hist, weight)
        if len(filled) < 2:
            assert gain[0] == -1
            continue
        whole = hist[0].sum(0)
        gains = [gini(whole) - gini(left := hist[0, : b + 1].sum(0)) - gini(whole - left) for b in range(filled[0], filled[-1])]
        assert gain[0] == pytest.approx(max(gains), abs=1e-9)
        assert gains[cut[0] - filled[0]] == pytest.approx(max(gains), abs=1e-9)


def test_learns_stores_and_reads_back(spark, tmp_path):
    df = _data(spark, 4000)
    train, test = df.where("customer_id % 4 > 0"), df.where("customer_id % 4 = 0")
    model = forest.fit_forest_table(train, COLUMNS, f"{tmp_path}/m", trees=25, small=1000)
    scored = forest.score_forest_table(model, test, keep=["sure"]).toPandas()
    assert ((scored["churn_probability"] > 0.5) == (scored["sure"] == 1)).mean() > 0.93
    importance = dict(rows(forest.forest_importance(spark, model)))
    assert importance["d"] == 0 and min(importance["a"], importance["b"]) > importance["c"] * 0.8
    copy = forest.save_forest_table(spark, forest.load_forest_table(spark, f"{tmp_path}/m"), f"{tmp_path}/copy")
    assert rows(forest.score_forest_table(copy, test)) == rows(forest.score_forest_table(model, test))


def test_files_of_few_nodes(spark, tmp_path, monkeypatch):
    df = _data(spark, 800)
    model = forest.fit_forest_table(df, COLUMNS, f"{tmp_path}/m", trees=4)
    monkeypatch.setattr(forest, "FILE_NODES", 20)
    cut_up = forest.save_forest_table(spark, model, f"{tmp_path}/cut")
    assert cut_up.bits >= 2
    assert rows(forest.score_forest_table(cut_up, df)) == rows(forest.score_forest_table(model, df))


def test_cuts_from_rows_are_those_from_sums():
    rng = np.random.default_rng(5)
    weight = np.array([0.7, 1.9])
    for nodes, size, bins in ((1, 1, 1), (1, 50, 64), (40, 60, 3), (300, 4000, 64), (7, 900, 2)):
        place = np.sort(np.append(np.arange(nodes), rng.integers(0, nodes, size)))
        value, label = rng.integers(0, bins, len(place)).astype(np.uint8), rng.integers(0, 2, len(place))
        times = rng.integers(1, 11, len(place))
        hist = forest.histograms(value[:, None], label, times, place, np.zeros(nodes, int), nodes)
        shuffled = rng.permutation(len(place))
        marks = (times * 2 + label).astype(np.uint32)
        found = forest.sorted_cuts(value[shuffled], marks[shuffled], place[shuffled], hist.sum(1).astype(int), weight)
        for ours, theirs in zip(found, forest.cuts(hist, weight)):
            assert (ours == theirs).all()  # to the last bit: ties decide about trees


def test_files_above_and_below(spark, tmp_path, monkeypatch):
    """Nodes made level by level in a file of their own, subtrees in several; and rows of one partition are
    scored by many tasks."""
    df = _data(spark, 900)
    model = forest.fit_forest_table(df, COLUMNS, f"{tmp_path}/m", trees=4, small=60)
    monkeypatch.setattr(forest, "FILE_NODES", 20)
    cut_up = forest.save_forest_table(spark, model, f"{tmp_path}/cut")
    assert cut_up.bits >= 2
    scored = forest.score_forest_table(model, df.coalesce(1))
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows(forest.score_forest_table(cut_up, df)) == rows(scored)


def test_odd_inputs(spark, tmp_path):
    df = _data(spark, 60)
    # nulls, NaN, unknown labels, equal keys, repeated rows, columns of other meaning
    odd = df.withColumn("a", F.when(F.col("customer_id") % 5 == 0, None).when(F.col("customer_id") % 7 == 0, float("nan")).otherwise(F.col("a")))
    odd = odd.withColumn("churned", F.when(F.col("customer_id") == 3, None).when(F.col("customer_id") == 4, 9).otherwise(F.col("churned")))
    odd = odd.unionByName(odd).withColumn("key", F.lit("x")).withColumn("label", F.lit(None).cast("int"))
    model = forest.fit_forest_table(odd, COLUMNS, f"{tmp_path}/odd", trees=3, small=20)
    assert tuple(forest.forest_checks(spark, model).first())[:3] == (3, 3, 0)
    scored = forest.score_forest_table(model, odd, keep=["key"]).toPandas()
    assert len(scored) == 120 and scored["churn_probability"].between(0, 1).all()
    # no row, one label, one value: no node, or one leaf per tree
    nothing = forest.fit_forest_table(df.limit(0), COLUMNS, f"{tmp_path}/none", trees=2)
    assert nothing.nodes(spark).count() == 0
    assert {r[1] for r in rows(forest.score_forest_table(nothing, df))} == {None}
    for k, other in enumerate((df.withColumn("churned", F.lit(1)), df.select("customer_id", "churned", *[F.lit(2).alias(c) for c in COLUMNS]))):
        for small in (10, 1000):
            leaf = forest.fit_forest_table(other, COLUMNS, f"{tmp_path}/leaf{k}-{small}", trees=2, small=small)
            assert [r[3] for r in _nodes(spark, leaf)] == [-1, -1]
    shallow = forest.fit_forest_table(df, COLUMNS, f"{tmp_path}/shallow", trees=2, small=10, deepest=2)
    assert max(r[2] for r in _nodes(spark, shallow)) == 2


def test_subtrees_finished_together_are_those_finished_alone():
    rng = np.random.default_rng(11)
    weight, nodes, depths = np.array([0.8, 1.3]), [-5, 3, 77], [2, 4, 3]
    lines, alone = [], []
    for node, depth, n in zip(nodes, depths, (400, 1, 900)):
        bins, label = rng.integers(0, 9, (n, 4)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8)
        times = rng.integers(1, 4, n).astype(np.uint8)
        packed = np.concatenate([bins, label[:, None], times[:, None]], axis=1)
        lines += [(node, depth, part.tobytes()) for part in np.array_split(packed, 3) if len(part)]
        alone += forest.grow(bins, label, times, 6, node, depth, weight, 2, 12).to_pylist()
    lines = [lines[k] for k in rng.permutation(len(lines))]  # blocks of several tasks, in any order
    table = pa.table(
        {"tree": pa.array([6] * len(lines), pa.int32()), "bundle": [0] * len(lines)}
        | {name: [line[k] for line in lines] for k, name in enumerate(("node", "depth", "rows"))}
    )
    together = forest._finish(4, 2, weight, 12)(table).to_pylist()
    assert sorted(together, key=lambda r: r["node"]) == sorted(alone, key=lambda r: r["node"])


def test_bundles_hold_neighbours_of_few_draws(tmp_path):
    draws = [30, 90, 10, 10, 250, 5, 60, 400]
    lines = [(0, k, 1, -1, -1, n, 0, 0.0, forest.HANDED, 0, 0, 0, 0) for k, n in enumerate(draws)]
    lines.append((1, 9, 0, -1, -1, 0, 0, 0.0, forest.HANDED, 0, 0, 0, 0))  # a root that is handed over at once
    pq.write_table(pa.Table.from_batches([forest._batch(list(zip(*lines)))]), tmp_path / "level")
    tops = forest._tops((f"{tmp_path}/level",), 100)
    assert tops[0]["bundle"].tolist() == [0, 0, 1, 1, 1, 3, 3, 4]
    assert tops[1]["bundle"].tolist() == [0]
