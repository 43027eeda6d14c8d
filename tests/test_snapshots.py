"""Snapshots: what is exported comes back, and nothing that was changed, added or taken away is taken over."""

import pytest

from foliary.sources import snapshots as sn

MADE = {"chunker": "c1", "space": "m/4"}
NEEDS = {"chunks": ["chunker"], "vectors": ["chunker", "space"]}


@pytest.fixture
def snapshot(spark, tmp_path):
    chunks = spark.createDataFrame([(i, None if i == 3 else f"text {i}") for i in range(50)], "id int, content string").repartition(3)
    vectors = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(20)], "id int, v array<double>").repartition(2)
    path = str(tmp_path / "snap")
    manifest = sn.export(spark, path, {"chunks": chunks, "vectors": vectors, "none": chunks.limit(0)}, MADE)
    assert {(r["table"], r["n"] > 0) for r in manifest.collect()} == {("chunks", True), ("vectors", True)}
    return path, chunks, vectors


def test_tables_come_back(spark, snapshot, tmp_path):
    path, chunks, vectors = snapshot
    assert sn.take_over(spark, path, f"{tmp_path}/here", MADE, NEEDS) == ["chunks", "none", "vectors"]
    assert sn.differences(spark.read.parquet(f"{tmp_path}/here/chunks"), chunks, ["id", "content"]).count() == 0
    assert spark.read.parquet(f"{tmp_path}/here/vectors").count() == 20
    with pytest.raises(Exception, match="exists"):
        sn.take_over(spark, path, f"{tmp_path}/here", MADE, NEEDS)
    assert sn.take_over(spark, path, f"{tmp_path}/here", MADE, NEEDS, replace=True)


def test_other_fingerprints_are_refused_or_left_out(spark, snapshot, tmp_path):
    path, *_ = snapshot
    other = MADE | {"space": "n/4"}
    with pytest.raises(sn.SnapshotMismatch):
        sn.take_over(spark, path, f"{tmp_path}/here", other, NEEDS)
    assert sn.take_over(spark, path, f"{tmp_path}/here", other, NEEDS, force=True) == ["chunks", "none"]
    assert not (tmp_path / "here" / "vectors").exists()


@pytest.mark.parametrize("harm", ["change", "add", "drop"])
def test_harm_is_found_before_anything_is_taken(spark, snapshot, tmp_path, harm):
    path, chunks, _ = snapshot
    files = sorted((tmp_path / "snap/data/chunks").glob("part-*.parquet"))
    for f in (tmp_path / "snap/data/chunks").glob(".*.crc"):
        f.unlink()
    if harm == "drop":
        files[0].unlink()
    else:
        spark.createDataFrame([(1, "text one")], "id int, content string").coalesce(1).write.parquet(f"{tmp_path}/one")
        (tmp_path / "one").joinpath(next((tmp_path / "one").glob("part-*")).name).rename(files[0] if harm == "change" else files[0].with_name("part-x.parquet"))
    with pytest.raises(sn.SnapshotMismatch):
        sn.take_over(spark, path, f"{tmp_path}/here", MADE, NEEDS)
    assert not (tmp_path / "here").exists()


def test_bags_differ_by_how_often_rows_occur(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "k int, v string")
    assert sorted((r.k, r.left, r.right) for r in sn.differences(a, b, ["k", "v"]).collect()) == [(1, 2, 1), (3, 0, 1)]
    assert sn.differences(a, a, ["k", "v"]).count() == 0
