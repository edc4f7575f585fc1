"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from voxlake.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def ordered(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(9) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = ordered(catalogue.QUERIES[name](spark, DATA).toPandas()), ordered(duck.execute(catalogue.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got.columns:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        assert np.all(same), c


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_whole_volume(spark, tmp_path):
    rng, depth = np.random.default_rng(5), 437
    spark.createDataFrame([(i, rng.random(64).tolist()) for i in range(depth)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    shapes = {"scale_nearest_up": (655, 12, 12), "scale_nearest_down": (218, 4, 4), "affine_transpose": (8, 8, depth), "affine_mirror": (depth + 20, 8, 8), "voronoi": (depth, 8, 8), "triplanar_vote": (depth, 8, 8)}
    got = {name: catalogue.QUERIES[name](spark, str(tmp_path)).toPandas() for name in shapes}
    for name, shape in shapes.items():
        at = got[name][["z", "y", "x"]].to_numpy()
        assert len(at) == np.prod(shape) and len(set(map(tuple, at.tolist()))) == len(at) and (at.max(0) + 1).tolist() == list(shape)
    seeds = np.array([(z, z // 10 % 8, z // 20 % 8) for z in range(0, depth, 10)])
    found = got["voronoi"]
    d2 = ((found[["z", "y", "x"]].to_numpy()[:, None] - seeds) ** 2).sum(2)
    assert (found["seed"].to_numpy() == d2.argmin(1)).all()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
