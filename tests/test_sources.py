"""Result tables, layouts and readers of files of many kinds."""

import pytest
from pyspark.sql import functions as F

from strandweave.sources import results as R


def test_results_round_trip(spark, tmp_path):
    lay = R.Layout(str(tmp_path))
    df = spark.createDataFrame([("s", 0.3, [1.0, 2.0]), ("t", 0.1, None), ("u", None, [3.0])], "subject_id string, jaccard double, v array<double>")
    for measure in ("l1", "l2"):
        R.save_result(df, lay, "partition_quality", dataset="n30", stage="raw", completeness="complete", measure=measure)
    R.save_result(df.limit(1), lay, "partition_quality", dataset="n30", stage="raw", completeness="complete", measure="l2")
    got = R.read_result(spark, lay, "partition_quality", dataset="n30", stage="raw", completeness="complete", measure="l1").collect()
    assert [r.subject_id for r in got] == ["t", "s", "u"] and got[1].measure == "l1"
    assert R.read_result(spark, lay, "partition_quality").count() == 4
    R.save_result(df, lay, "summary", csv=True, dataset="n30")
    back = R.read_result(spark, lay, "summary", csv=True, dataset="n30")
    assert {(r.subject_id, r.jaccard, r.v) for r in back.collect()} == {("s", 0.3, "[1.0,2.0]"), ("t", 0.1, None), ("u", None, "[3.0]")}
    with pytest.raises(ValueError):
        R.save_result(df, lay, "summary", colour="red")
    assert lay.reduced("q", clusters=5).endswith("results/q/dropped_clusters=5")
    with pytest.raises(ValueError):
        lay.reduced("q", 1, 1)


def test_catalogue_and_schemas():
    c = R.catalogue()
    assert len(c) == 36 and {x["kind"] for x in c} == {"observations", "labels", "bad_labels"}
    one = next(x for x in c if x["stage"] == "resampled_1min" and x["completeness"] == "sparse" and x["kind"] == "observations")
    assert one["columns"][-2:] == ["old_id", "original_index"] and one["path"] == "/data/completeness=sparse/stage=resampled_1min"


def test_files_of_partitions_and_runs(spark, tmp_path):
    for name in ("a-b-wrong-clusters-3", "a-b-shifted-and-wrong-cluster-0", "c-shifted-end-idx-12"):
        spark.createDataFrame([(0, 5)], "segment_id int, cluster_id int").coalesce(1).write.parquet(str(tmp_path / f"{name}-labels.parquet"))
    got = {(r.subject_id, r.clustering_desc, r.cluster_id) for r in R.read_partition_files(spark, str(tmp_path / "*-labels.parquet")).collect()}
    assert got == {("a-b", "wrong-clusters-3", 5), ("a-b", "shifted-and-wrong-cluster-0", 5), ("c", "shifted-end-idx-12", 5)}
    (tmp_path / "runs.csv").write_text("Name\na-b\nzz\n")
    df = spark.createDataFrame([("a-b", 1), ("c", 2)], "subject_id string, v int")
    assert [r.v for r in R.of_runs(df, R.read_runs(spark, str(tmp_path / "runs.csv"))).collect()] == [1]
    (tmp_path / "x-labels.csv").write_text(',id,start idx,correlation achieved\n0,7,3,"[0.1, 0.2]"\n')
    r = R.read_csv_labels(spark, str(tmp_path / "x-labels.csv")).first()
    assert (r.subject_id, r.id, r.start_idx, r.correlation_achieved) == ("x", 7, 3, "[0.1, 0.2]")
    (tmp_path / "out.csv").write_text("Name,swc\nsub-1:extra,0.5\n")
    assert R.read_runs_of_clusterer(spark, str(tmp_path / "out.csv")).first().subject_id == "sub-1"
    (tmp_path / "m.txt").write_text("1 2 3\n4 5 6\n")
    assert [r["values"] for r in R.read_matrix(spark, str(tmp_path / "m.txt"), sep=" ").orderBy("row").collect()] == [[1, 2, 3], [4, 5, 6]]
    (tmp_path / "p.csv").write_text(",c_iob,loc_iob\n0,-0.2,0.6\n1,-0.3,0.5\n")
    assert R.parameter(R.read_parameters(spark, str(tmp_path / "p.csv")), "loc_iob") == [0.6, 0.5]
    two = R.combined({"a": spark.range(1), "b": spark.range(2).withColumn("x", F.lit(1))})
    assert {(r.variant, r.x) for r in two.collect()} == {("a", None), ("b", 1)}
    with pytest.raises(ValueError):
        R.combined({})
