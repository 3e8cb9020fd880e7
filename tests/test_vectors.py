"""Vector tables: schema, dimension, repeated appends."""

import pytest
from pyspark.sql import functions as F

from quarrylog.sources import vectors


def rows(spark, *r):
    return spark.createDataFrame(r, "content string, embedding array<double>, doc_id string")


def test_appends_are_checked_and_can_be_repeated(spark, tmp_path):
    folder = str(tmp_path / "kb")
    assert vectors.create(spark, folder, dimension=2) and not vectors.create(spark, folder, dimension=2)
    assert vectors.read(spark, folder).count() == 0
    with pytest.raises(ValueError):
        vectors.create(spark, folder, dimension=3)
    with pytest.raises(ValueError):
        vectors.create(spark, folder, vectors.ISSUES, 2)
    assert vectors.append(rows(spark, ("a", [1.0, 2.0], "d1"), ("b", [0.5, -1.0], "d2")), folder, "one") == 2
    assert vectors.append(rows(spark, ("c", [1.0, 0.0], "d3")), folder, "two") == 1
    assert vectors.append(rows(spark, ("c", [1.0, 0.0], "d3")), folder, "two") == 1
    for bad in ([1.0], None, [1.0, float("nan")], [1.0, None], [1.0, float("inf")]):
        with pytest.raises(Exception, match="finite values"):
            vectors.append(rows(spark, ("x", [1.0, 1.0], "d"), ("y", bad, "d")), folder, "bad")
    got = vectors.read(spark, folder)
    assert sorted((r["content"], list(r["embedding"]), r["doc_id"], r["kb_id"]) for r in got.collect()) == [("a", [1.0, 2.0], "d1", None), ("b", [0.5, -1.0], "d2", None), ("c", [1.0, 0.0], "d3", None)]
    assert got.schema == vectors.read(spark, folder).where(F.lit(True)).schema
