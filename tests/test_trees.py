"""Hash trees against comparing all rows, and canonical digests of pages."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import incremental, trees


def state(spark, rows):
    return spark.createDataFrame(rows, "page_id string, sha256 string")


def test_diff_equals_all_rows(spark, tmp_path):
    r = random.Random(2)
    rows = {f"page:{i}": str(r.random()) for i in range(3000)}
    for n, edits in enumerate((0, 1, 5, 400)):
        other = dict(rows)
        for k in r.sample(sorted(rows), edits):
            if r.random() < 0.4:
                other[k] = "changed"
            else:
                del other[k]
                other[f"{k}-new"] = "x"
        a, b = state(spark, list(rows.items())), state(spark, list(other.items()))
        trees.write_state(a, str(tmp_path / f"a{n}"))
        trees.write_state(b, str(tmp_path / f"b{n}"))
        got = trees.tree_diff(spark, str(tmp_path / f"a{n}"), str(tmp_path / f"b{n}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, incremental.changes(a, b).collect()))
        ranges = trees.differing(spark, str(tmp_path / f"a{n}"), str(tmp_path / f"b{n}"))
        assert len(ranges) <= 2 * edits
        if edits == 1:  # only folders of the ranges that differ are read
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert plan.count("PartitionFilters: [") >= 2 and all("range#" in p.split("]")[0] and ranges[0] in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])


def test_empty_states_and_depths(spark, tmp_path):
    paths = [str(tmp_path / x) for x in "abc"]
    trees.write_state(state(spark, []), paths[0])
    trees.write_state(state(spark, [("p", "1"), (None, "2")]), paths[1])
    assert {tuple(r) for r in trees.tree_diff(spark, paths[0], paths[1]).collect()} == {("p", "added"), (None, "added")}
    assert trees.tree_diff(spark, paths[0], paths[0]).count() == 0
    trees.write_state(state(spark, [("p", "1")]), paths[2], digits=3)
    with pytest.raises(ValueError, match="different depths"):
        trees.differing(spark, paths[1], paths[2])


def test_page_digest(spark):
    rows = spark.createDataFrame([(1, {"b": 1, "a": 2}, (1, None), ["x"])], "id int, m map<string,int>, s struct<p:int,q:string>, l array<string>")
    same = spark.createDataFrame([(1, ["x"], {"a": 2, "b": 1}, (None, 1))], "id int, l array<string>, m map<string,int>, s struct<q:string,p:int>")
    digest = lambda df, *no: df.select(trees.page_digest(df, *no).alias("d")).first().d
    assert digest(rows) == digest(same)
    assert digest(rows) != digest(rows.withColumn("l", F.array(F.lit("y"))))
    assert digest(rows, "l") == digest(same.drop("l"))
    assert digest(rows) != digest(rows.withColumn("s", F.lit(None).cast("struct<p:int,q:string>")))
