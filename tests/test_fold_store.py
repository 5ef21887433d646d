import os

import pytest
from pyspark.sql import functions as F

from rankflow.operators.folds import split_folds
from rankflow.sinks import fold_store
from rankflow.sinks.fold_store import FoldStore, write_fold_store

FOLDS = "fold int, split string, query_id string"


def size(path):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def rows(spark, n_queries=20, n_rows=50):
    text = F.sha2(F.concat_ws("|", "id", F.lit("text")), 512)
    made = spark.range(n_queries * n_rows).withColumn("text", F.concat(text, F.reverse(text)))
    return made.withColumn("query_id", F.concat(F.lit("q"), (F.col("id") % n_queries).cast("string")))


def cross_validation(spark, n_queries=20, n_folds=5):
    members = [
        (f, "test" if q % n_folds == f else "training", f"q{q}") for q in range(n_queries) for f in range(n_folds)
    ]
    return spark.createDataFrame(members, FOLDS)


def same(a, b):
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def test_rows_are_written_once_and_read_per_fold(spark, tmp_path):
    data, folds = rows(spark), cross_validation(spark)
    write_fold_store(data, folds, str(tmp_path / "store"))
    data.write.option("compression", "zstd").parquet(str(tmp_path / "once"))
    split_folds(data, folds).write.partitionBy("fold", "split").parquet(str(tmp_path / "copies"))
    store = FoldStore(spark, str(tmp_path / "store"))
    want = split_folds(data, folds)
    assert same(store.all(), want)
    assert size(tmp_path / "store") < 1.15 * size(tmp_path / "once") < 0.4 * size(tmp_path / "copies")
    for fold in range(5):
        for split in fold_store.SPLITS:
            part = store.part(fold, split)
            assert same(part, want.where((F.col("fold") == fold) & (F.col("split") == split)).drop("fold", "split"))
    assert store.part(5, "test").isEmpty()
    with pytest.raises(ValueError, match="split"):
        store.part(0, "dev")


def test_a_part_opens_its_folders_only(spark, tmp_path):
    write_fold_store(rows(spark), cross_validation(spark), str(tmp_path / "store"))
    store = FoldStore(spark, str(tmp_path / "store"))
    opened = store.part(2, "test").select(F.input_file_name().alias("f")).distinct().collect()
    folders = {r.f.split(f"{fold_store.FOLDER}=")[1].split("/")[0] for r in opened}
    assert len(folders) == 1 and len({r[0] for r in store.patterns.select(fold_store.FOLDER).collect()}) == 5
    plan = store.part(2, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and f"{fold_store.FOLDER}#" in plan.split("PartitionFilters: [")[1]


def test_more_bitmaps_than_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fold_store, "FOLDERS", 3)
    members = [(f, "test" if (q * 7 + f) % 3 else "training", f"q{q}") for q in range(20) for f in range(0, 70, q + 1)]
    folds = spark.createDataFrame([*members, members[0], (0, "test", None), (69, "test", "unknown")], FOLDS)
    data = rows(spark, n_queries=25)
    write_fold_store(data, folds, str(tmp_path / "store"))
    store = FoldStore(spark, str(tmp_path / "store"))
    want = split_folds(data, folds.distinct())
    assert same(store.all(), want)
    for fold in (0, 30, 31, 69):
        for split in fold_store.SPLITS:
            expected = want.where((F.col("fold") == fold) & (F.col("split") == split)).drop("fold", "split")
            assert same(store.part(fold, split), expected)


def test_awkward_folds(spark, tmp_path):
    data = rows(spark, 2, 3)
    write_fold_store(data, cross_validation(spark).limit(0), str(tmp_path / "none"))
    assert FoldStore(spark, str(tmp_path / "none")).all().isEmpty()
    for strange in [(0, "dev", "q0"), (-1, "test", "q0"), (None, "test", "q0")]:
        with pytest.raises(ValueError, match="fold"):
            write_fold_store(data, spark.createDataFrame([strange], FOLDS), str(tmp_path / "bad"))
