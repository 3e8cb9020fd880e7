"""Pruned nearest vectors against all products, and how many products are left."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylog.operators import pruned, vector

SCHEMA = "vec_id long, v array<float>, label int"


def clustered(n, dim, centres, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    v = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return [(i, [float(x) for x in r], i % 3) for i, r in enumerate(v.astype(np.float32))]


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("least", "same"), [(0.84, None), (0.84, "label"), (None, None), (None, "label"), (0.999, "label")])
def test_equals_all_products(spark, least, same):
    data = clustered(700, 16, 12, 0.06, 1)
    data += [(900, data[0][1], 0), (901, data[0][1], 0), (902, None, 0), (903, [0.0] * 16, 1), (904, [1.0] * 3, 1), (905, [float("nan")] * 16, 1), (906, data[5][1], None), (None, data[6][1], 1)]
    library = spark.createDataFrame(data, SCHEMA)
    queries = library.where("vec_id % 4 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")
    got, _ = pruned.nearest(queries, library, 3, least, same, True)
    want = vector.knn_by_tiles(queries, library, 3, -1.0 if least is None else least, same, True)
    assert rows(got) == rows(want) and len(rows(got)) >= (4 if least == 0.999 else 50)


def test_few_products_on_clusters(spark):
    """Below a tenth of all products, with a least score and without one."""
    library = spark.createDataFrame(clustered(4000, 32, 60, 0.03, 2), SCHEMA)
    queries = library.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for least in (0.84, None):
        _, work = pruned.nearest(queries, library, 3, least)
        assert work.agg(F.sum("n")).first()[0] < 0.1 * 200 * 4000


def test_hot_cells_are_cut(spark, monkeypatch):
    """A third of the library is one vector, asked for by a third of the queries; blocks stay bounded and ties go by id."""
    monkeypatch.setattr(pruned, "BLOCK", 50)
    monkeypatch.setattr(pruned, "ASKED", 20)
    data = clustered(400, 8, 5, 0.05, 3)
    data = [(i, data[0][1] if i % 3 == 0 else v, 1) for i, v, _ in data]
    library = spark.createDataFrame(data, SCHEMA)
    queries = library.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for least in (0.9, None):
        got, work = pruned.nearest(queries, library, 2, least, None, True)
        assert rows(got) == rows(vector.knn_by_tiles(queries, library, 2, -1.0 if least is None else least, None, True))
        assert work.agg(F.max("n")).first()[0] <= 100


def test_nothing_to_find(spark):
    library = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, [1.0, 0.0], 1)], SCHEMA)
    asked = lambda df: df.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "label")
    for q, lib in ((asked(some), library), (asked(library), some), (asked(some), some.where("false"))):
        assert pruned.nearest(q, lib, 3, 0.5, "label")[0].count() == 0
        assert pruned.nearest(q, lib, 3)[0].count() == 0
