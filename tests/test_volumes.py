"""Small exact arrays, and results that must not depend on how a volume is cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.functions import voxel
from voxlake.operators import blocks, evaluation, gather, kernels, keyed, labels, objects, reduction, slices
from voxlake.operators.blocks import Grid
from voxlake.operators.handles import BlockArray, map_all, pad_to_multiple
from voxlake.plans import flows
from voxlake.sources import paths, volumes

YX = ("y", "x")
ZYX = ("z", "y", "x")


def to_df(spark, a, axes=ZYX):
    rows = [(*map(int, p), float(a[tuple(p)])) for p in np.argwhere(np.ones(a.shape, bool))]
    return spark.createDataFrame(rows, ", ".join(f"{x} long" for x in axes) + ", v double")


def to_array(df, shape, axes=ZYX):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[tuple(r[a] for a in axes)] = r.v
    return out


def test_split_query():
    assert paths.split_query("a/b") == ("a/b", None)
    assert paths.split_query("a/b?slices=[3,:2]") == ("a/b", (3, slice(None, 2)))
    assert paths.split_query("v?slices=[0:1,0,-1:,::2]")[1] == (slice(0, 1), 0, slice(-1, None), slice(None, None, 2))
    with pytest.raises(ValueError):
        paths.split_query("a?slices=3")
    assert paths.file_name("gs://b/c/d.zarr/?slices=[1]") == "d.zarr"
    assert paths.encoded("a/b c") == "a%2Fb%20c"


@pytest.mark.parametrize("query", ["[1:3,:,2]", "[::2,-2:,:]", "[-1,0,1:5:3]"])
def test_sliced_equals_numpy(spark, query):
    a = np.arange(4 * 3 * 6, dtype=float).reshape(4, 3, 6)
    indices = paths.split_query(f"p?slices={query}")[1]
    expected = a[indices]
    axes = [x for x, i in zip(ZYX, indices) if not isinstance(i, int)]
    got = to_array(paths.sliced(to_df(spark, a), indices, a.shape, ZYX), expected.shape, axes)
    assert (got == expected).all()


def test_slices_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    to_df(spark, np.arange(64.0).reshape(4, 4, 4)).write.parquet(path)
    plan = paths.sliced(spark.read.parquet(path), (slice(1, 3), 2, slice(None)), (4, 4, 4), ZYX)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(z,1)" in plan and "LessThan(z,3)" in plan and "EqualTo(y,2)" in plan


def test_coord_map(spark):
    got = to_array(volumes.coord_map(spark, (2, 3), lambda y, x: (x - y).cast("double"), YX), (2, 3), YX)
    assert (got == [[0, 1, 2], [-1, 0, 1]]).all()


def test_scale_two(spark):
    a = np.array([[1.0, 2], [3, 4]])
    got = to_array(gather.scale_nearest(spark, to_df(spark, a, YX), 2, (2, 2), axes=YX), (4, 4), YX)
    assert (got == a.repeat(2, 0).repeat(2, 1)).all()


@pytest.mark.parametrize("scale", [(0.5, 2, 2), (2, 0.5, 0.5), (2, 2, 2), (0.5, 0.5, 0.5)])
def test_scale_corner(spark, scale):
    a = np.zeros((3, 3, 3))
    a[:2, :2, :2] = 1
    expected = np.zeros((5, 5, 5))
    expected[tuple(slice(0, int(2 * s)) for s in scale)] = 1
    assert (to_array(gather.scale_nearest(spark, to_df(spark, a), scale, (3, 3, 3), (5, 5, 5)), (5, 5, 5)) == expected).all()


def test_affine(spark):
    a = to_df(spark, np.array([[1.0, 2], [3, 4]]), YX)
    swap = gather.affine_nearest(spark, a, [[0, 1], [1, 0]], [0, 0], (2, 2), (2, 2), YX)
    assert (to_array(swap, (2, 2), YX) == [[1, 3], [2, 4]]).all()
    mirror = gather.affine_nearest(spark, a, [[1, 0], [0, -1]], [0, 2], (2, 2), (2, 2), YX)
    assert (to_array(mirror, (2, 2), YX) == [[2, 1], [4, 3]]).all()
    outside = gather.affine_nearest(spark, a, [[1, 0], [0, 1]], [-1, 0], (2, 2), (3, 2), YX, cval=9.0)
    assert (to_array(outside, (3, 2), YX) == [[9, 9], [1, 2], [3, 4]]).all()


def test_block_reduce(spark):
    assert reduction.block_reduce(to_df(spark, np.ones((3, 2)), YX), (2, 3), (3, 2), "max", YX).count() == 0
    ones = reduction.block_reduce(to_df(spark, np.ones((3, 3, 6))), (2, 3, 3), (3, 3, 6), "min")
    assert (to_array(ones, (1, 1, 2)) == 1).all()
    line = reduction.block_reduce(to_df(spark, np.arange(1.0, 6), ("x",)), (2,), (5,), "mean", ("x",))
    assert sorted(r.v for r in line.collect()) == [1.5, 3.5]
    with pytest.raises(ValueError):
        reduction.block_reduce(line, (1,), (2,), "median", ("x",))


def test_best_level():
    assert reduction.best_level([0, 1, 2], 2) == 2
    assert reduction.best_level([0, 1, 3], 2) == 1
    assert reduction.best_level([], 3) == 0


@pytest.mark.parametrize("cell", [None, 3])
def test_voronoi(spark, cell):
    seeds = spark.createDataFrame([(0, 2, 2), (1, 0, 1), (2, 0, 0)], "seed int, y long, x long")
    points = volumes.coordinates(spark, (3, 3), YX)
    got = {(r.y, r.x): r.seed for r in gather.nearest_seed(spark, points, seeds, YX, cell=cell).collect()}
    expected = [[2, 1, 1], [2, 1, 0], [None, 0, 0]]
    assert all(got[y, x] == expected[y][x] for y in range(3) for x in range(3) if (y, x) != (2, 0))


@pytest.mark.parametrize("cell", [0.5, 1, 7, 1000])
def test_nearest_seed_of_any_cell(spark, cell, monkeypatch):
    rng = np.random.default_rng(2)
    at, seeds = rng.integers(-30, 200, (60, 2)), rng.integers(-50, 400, (9, 2))
    rows = [(int(y), int(x), i % 7) for i, (y, x) in enumerate(at)] + [(3, 3, 0), (3, 3, 0)]
    points = spark.createDataFrame(rows, "y long, x long, seen int")
    table = spark.createDataFrame([(k, int(y), int(x)) for k, (y, x) in enumerate(seeds)] + [(9, *map(int, seeds[0]))], "seed int, y long, x long")
    got = sorted(map(tuple, gather.nearest_seed(spark, points, table, YX, cell=cell).collect()))
    assert got == sorted((y, x, n, int(((seeds - (y, x)) ** 2).sum(1).argmin())) for y, x, n in rows)
    monkeypatch.setattr(gather, "SEEDS_AT_ONCE", 3)
    assert sorted(map(tuple, gather.nearest_seed(spark, points, table, YX).collect())) == got
    assert {r.seed for r in gather.nearest_seed(spark, points, table.limit(0), YX, cell=cell).collect()} == {None}


def brute_labels(mask):
    label, shape = {}, mask.shape
    for p in map(tuple, np.argwhere(mask)):
        if p in label:
            continue
        first = int(np.ravel_multi_index(p, shape))
        todo = [p]
        label[p] = first
        while todo:
            q = todo.pop()
            for k in range(mask.ndim):
                for d in (-1, 1):
                    n = (*q[:k], q[k] + d, *q[k + 1 :])
                    if 0 <= n[k] < shape[k] and mask[n] and n not in label:
                        label[n] = first
                        todo.append(n)
    return label


@pytest.mark.parametrize("chunks", [(9, 7, 8), (4, 3, 2), ((2, 7), (3, 1, 3), (5, 3))])
def test_label_does_not_depend_on_chunks(spark, chunks):
    mask = np.random.default_rng(1).random((9, 7, 8)) < 0.35
    grid = Grid(mask.shape, chunks)
    df = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)], "z long, y long, x long")
    got = {(r.z, r.y, r.x): r.lbl for r in labels.label(spark, df, grid).collect()}
    assert got == brute_labels(mask)


def test_empty_mask(spark):
    empty = spark.createDataFrame([], "z long, y long, x long")
    grid = Grid((4, 4, 4), (2, 2, 2))
    found = labels.label(spark, empty, grid)
    assert found.count() == 0
    assert objects.objects_global(found, grid).count() == 0
    assert labels.dense_ids(found).count() == 0


def test_objects_do_not_depend_on_chunks(spark):
    mask = np.random.default_rng(3).random((8, 8, 8)) < 0.2
    df = spark.createDataFrame([tuple(map(int, p)) for p in np.argwhere(mask)], "z long, y long, x long")
    seen = []
    for chunks in ((8, 8, 8), (3, 8, 5)):
        grid = Grid(mask.shape, chunks)
        found = objects.count_by_size(objects.objects_global(labels.label(spark, df, grid), grid), grid)
        seen.append(sorted((r.lbl, round(r.cz, 9), r.nvoxel, r.edge_contact, round(r.ncells, 9)) for r in found.collect()))
    assert seen[0] == seen[1]


def test_border_weight_brute_force(spark):
    def weight(c, shape, a=3.0, b=-0.5, m=2.0):
        out = 1.0
        for x, n in zip(c, shape):
            half = n / 2
            out /= min(max(a + abs((x + half) % n - (half - 0.5)) * b, 1), m)
        return out

    points = [(0.0, 3.5), (1.25, 9.0), (7.5, 0.1)]
    df = spark.createDataFrame(points, "y double, x double")
    got = df.select("y", "x", voxel.border_weight([F.col("y"), F.col("x")], [8, 10]).alias("w")).collect()
    for r in got:
        assert r.w == pytest.approx(weight((r.y, r.x), (8, 10)))


def test_half_rounding(spark):
    values = np.random.default_rng(5).random(500).tolist() + [0.0, 1.0, 0.45, 1e-6, 6.1e-5]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", voxel.half_rounded(F.col("v")).alias("h"))
    assert all(r.h == float(np.float16(r.v)) for r in df.collect())


def test_irregular_grid(spark):
    grid = Grid((5, 4), ((2, 3), 3), YX)
    assert grid.numblocks == (2, 2) and grid.chunksize == (2, 3)
    rows = grid.with_blocks(volumes.coordinates(spark, (5, 4), YX)).select("*", grid.start(0).alias("s"), grid.stop(1).alias("e")).collect()
    assert all(r.by == (r.y >= 2) and r.bx == (r.x >= 3) and r.s == (2 if r.y >= 2 else 0) and r.e == (4 if r.x >= 3 else 3) for r in rows)
    assert grid.table(spark).count() == 4
    with pytest.raises(ValueError):
        Grid((5,), ((2, 2),), ("y",))


def test_map_and_zip_blocks(spark):
    grid = Grid((4, 4), (2, 2), YX)
    df = to_df(spark, np.arange(16.0).reshape(4, 4), YX)
    sums = blocks.map_blocks(df, grid, lambda p: p.groupby(["by", "bx"], as_index=False)["v"].sum(), "by int, bx int, v double")
    assert sorted(r.v for r in sums.collect()) == [10, 18, 42, 50]
    both = blocks.zip_blocks(df, df.where("v > 11"), grid, lambda a, b: a.iloc[:1].assign(n=len(a) * 100 + len(b))[["by", "bx", "n"]], "by int, bx int, n long")
    assert sorted(r.n for r in both.collect()) == [400, 400, 402, 402]


def test_intensity_box_equals_padded_numpy(spark):
    a = np.random.default_rng(2).random((5, 7))
    got = reduction.intensity_by_box(to_df(spark, a, YX), Grid((5, 7), (4, 4), YX), 3, 1.0, 0.5).collect()
    for r in got:
        y, x = r.by * 4 + r.iy * 3, r.bx * 4 + r.ix * 3
        part = a[y : min(y + 3, r.by * 4 + 4), x : min(x + 3, r.bx * 4 + 4)]
        assert r.ncells == pytest.approx((part * (part > 0.5)).sum()) and r.cy == y + 1.5


def test_flow_with_stages(spark, tmp_path):
    v = to_df(spark, np.random.default_rng(4).random((6, 6, 6)) / 3)
    grid = Grid((6, 6, 6), (3, 6, 6))
    first = flows.cells_per_block(spark, v, grid, stages=f"file://{tmp_path}/s")
    again = flows.cells_per_block(spark, v.where("v < 0"), grid, stages=f"file://{tmp_path}/s")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect())) != []


def test_slices_and_vote(spark):
    a = np.random.default_rng(6).random((6, 2, 3)) - 0.5
    df = to_df(spark, a)
    three = slices.stacked(df, 2, 6)
    assert three.count() == 2 * 6
    assert (to_array(slices.unstacked(three, 2, 6), a.shape) == a).all()
    order = slices.PLANES["zy"]
    assert (to_array(slices.transposed(slices.transposed(df, order), slices.inverse(order)), a.shape) == a).all()
    seg = {(r.z, r.y, r.x): r.seg for r in slices.vote([df, df]).collect()}
    assert all(seg[p] == (a[p] > 0) for p in seg)


def test_dice_and_mae(spark):
    a = spark.createDataFrame([(0, 0, 0), (0, 0, 1)], "z long, y long, x long")
    assert evaluation.dice(a, a.where("x = 0")).first().dice == pytest.approx(2 / 3)
    assert evaluation.dice(a.limit(0), a.limit(0)).first().dice is None
    assert evaluation.mean_absolute_error(spark.createDataFrame([(1, 2), (5, 2)], "a int, b int"), "a", "b").first().mae == 2


def test_ordered_keys(spark):
    d = spark.createDataFrame([(0, "file1.npy", 1), (1, "file2.npy", 2), (2, "file3.npy", 3)], "pos int, k string, v int")

    def show(x):
        return [(r.k, r.v) for r in x.orderBy("pos").collect()]

    assert show(keyed.put(d, "file4.npy", 4))[-1] == ("file4.npy", 4)
    assert show(keyed.put(d, "file2.npy", 9))[1] == ("file2.npy", 9)
    assert show(keyed.remove(d, "file1.npy")) == [("file2.npy", 2), ("file3.npy", 3)]
    assert show(keyed.rename(d, "file2.npy", "b"))[1] == ("b", 2)
    assert show(keyed.reorder(d, ["file3.npy", "file1.npy", "file2.npy"]))[0] == ("file3.npy", 3)
    assert show(keyed.subset(d, ["file3.npy", "file1.npy"])) == [("file3.npy", 3), ("file1.npy", 1)]
    assert [k for k, _ in show(keyed.trim_common(d))] == ["1", "2", "3"]
    assert [k for k, _ in show(keyed.common_keys(d, d.where("v > 1"), d.where("v < 3")))] == ["file2.npy"]
    for wrong in (lambda: keyed.remove(d, "x"), lambda: keyed.rename(d, "file1.npy", "file2.npy"), lambda: keyed.subset(d, ["x"]), lambda: keyed.drop_columns(d, ["x"]), lambda: keyed.add_columns(d, {"v": F.lit(1)})):
        with pytest.raises(KeyError):
            wrong()


def test_put_into_empty(spark):
    d = spark.createDataFrame([], "pos int, k string, v int")
    assert [tuple(r) for r in keyed.put(d, "a", 1).collect()] == [(0, "a", 1)]


def test_distance_transform():
    mask = np.random.default_rng(7).random((5, 6, 4)) < 0.7
    background = np.argwhere(~mask)
    got = kernels.distance_transform(mask)
    for p in np.argwhere(mask):
        assert got[tuple(p)] == pytest.approx(np.sqrt(((background - p) ** 2).sum(1).min()))


def test_watershed_invariants():
    yy, xx = np.mgrid[:15, :30]
    mask = ((yy - 7) ** 2 + (xx - 8) ** 2 <= 36) | ((yy - 7) ** 2 + (xx - 20) ** 2 <= 36)
    out = kernels.watershed(mask, 5.0)
    assert ((out > 0) == mask).all() and len(np.unique(out)) == 3
    assert out[7, 8] != out[7, 20]
    three = kernels.watershed_3sizes(mask, 60, 1.0, None, 100, 5.0, 60)
    assert ((three > 0) == mask).all() and np.unique(three).tolist() == [0, 1, 2]
    assert not kernels.watershed(np.zeros((3, 3), bool)).any()


def test_watershed_numbers_middle_components_first():
    mask = np.zeros((12, 30), bool)
    mask[0:2, 0:2] = mask[0:3, 8:12] = mask[5:7, 0:2] = mask[5:12, 8:30] = True
    out = kernels.watershed_3sizes(mask, 5, 1.0, None, 20, 1.5, 3)
    # the middle component first, then the small ones in scan order, then the large one
    assert (out[0, 8], out[0, 0], out[5, 0], out[8, 15]) == (1, 2, 3, 4) and np.unique(out).tolist() == [0, 1, 2, 3, 4]
    assert not kernels.watershed_3sizes(np.zeros((2, 2), bool)).any()


def test_map_all(spark):
    import pandas as pd

    grid = Grid((4, 4), (2, 2), YX)
    df = to_df(spark, np.arange(16.0).reshape(4, 4), YX)

    def sums(block, parts):
        return pd.DataFrame({"by": [block[0]], "bx": [block[1]], "n": [sum(len(p) * 10**k for k, p in enumerate(parts))]})

    frames, ddl = [df, df.where("v > 3"), df.where("v > 11")], "by int, bx int, n long"
    assert sorted(r.n for r in map_all(frames, grid, sums, ddl, missing="empty").collect()) == [24, 24, 244, 244]
    assert sorted(r.n for r in map_all(frames, grid, sums, ddl, missing="drop").collect()) == [244, 244]
    with pytest.raises(Exception, match="no block"):
        map_all(frames, grid, sums, ddl).collect()


def test_handle(spark):
    a = np.arange(24.0).reshape(4, 6)
    grid = Grid((4, 6), ((1, 3), 4), YX)
    handle = BlockArray(to_df(spark, a, YX), grid)
    assert handle.properties() == {"repr_format": "blocks of voxels", "ndim": 2, "numblocks": (2, 2), "chunksize": (1, 4), "is_numpy": False, "dtype": "double"}
    assert handle.block_indices() == [(0, 0), (0, 1), (1, 0), (1, 1)] and handle.slices_list()[3] == (slice(1, 4), slice(4, 6))
    assert (handle.to_numpy() == a).all() and handle.total().first().total == a.sum() and handle.rechunked((2, 2)).numblocks == (2, 3)
    back = BlockArray.from_blocks(spark, {i: a[s] for i, s in zip(handle.block_indices(), handle.slices_list())}, grid)
    assert (back.to_numpy() == a).all()
    padded = pad_to_multiple(handle, 5, spark)
    assert padded.grid.shape == (5, 10) and padded.grid.chunks == ((1, 3, 1), 4) and (padded.to_numpy() == np.pad(a, ((0, 1), (0, 4)))).all()
    for wrong in (lambda: handle.to_numpy(most=3), lambda: handle.column("none"), lambda: BlockArray.from_blocks(spark, {i: a for i in handle.block_indices()}, grid)):
        with pytest.raises(ValueError):
            wrong()


def test_polynomial_bias(spark, tmp_path):
    y, x = np.mgrid[:6, :5] / np.array([5, 4]).reshape(2, 1, 1)
    a = 3 + 2 * y - x + y * x + 0.5 * x * x + np.random.default_rng(3).random((6, 5))
    grid = Grid(a.shape, (3, 5), YX)
    terms = np.stack([np.ones(30), y.ravel(), x.ravel(), (y * y).ravel(), (y * x).ravel(), (x * x).ravel()], 1)
    want = (terms @ np.linalg.lstsq(terms, a.ravel(), rcond=None)[0]).reshape(a.shape) / a.mean()
    field = flows.obtain_bias(spark, lambda: flows.polynomial_bias(to_df(spark, a, YX), grid), f"file://{tmp_path}/bias")
    assert np.allclose(to_array(field.withColumnRenamed("b", "v"), a.shape, YX), want)
    again = flows.obtain_bias(spark, lambda: 1 / 0, f"file://{tmp_path}/bias")
    assert again.count() == 30


def test_production_resumes(spark, tmp_path):
    v = volumes.coord_map(spark, (8, 8, 8), lambda z, y, x: F.lit(1000) + 40 * ((F.floor(z / 2) + F.floor(y / 2) + F.floor(x / 2)) % 2) + 300 * ((z == 7) & (y == 7)).cast("int"))
    grid, how = Grid((4, 4, 4), (2, 4, 4)), flows.Production(counting=flows.Counting(threshold=985.0))
    first = flows.production(spark, v, grid, how, stages=f"file://{tmp_path}/run")
    assert {r.v for r in first["reduced"].collect()} == {1000, 1040, 1300, 1340} and first["corrected"].where("v = 0").count() == 4
    again = flows.production(spark, v.where("v < 0"), grid, how, stages=f"file://{tmp_path}/run")
    assert sorted(map(tuple, again["totals"].collect())) == sorted(map(tuple, first["totals"].collect())) != []


def test_blobs():
    a = np.zeros((17, 17))
    a[8, 8] = 1
    found = kernels.blobs_dog(kernels.gaussian(a, 1.2) * 6, threshold=0.05)
    assert len(found) == 1 and found[0][:2].tolist() == [8, 8]


def test_spline_interpolates():
    a = np.random.default_rng(8).random((9, 7))
    c = kernels.spline_prefilter(a)
    p = np.pad(c, 1, mode="reflect")
    w = [1 / 6, 4 / 6, 1 / 6]
    back = sum(w[i] * w[j] * p[i : i + 9, j : j + 7] for i in range(3) for j in range(3))
    assert np.allclose(back, a)
    assert kernels.spline_depth(3) == 14 and kernels.spline_depth(1) == 0


def test_spline_blocks_join(spark):
    a = np.random.default_rng(9).random((40, 3, 3))
    got = to_array(kernels.spline_by_block(to_df(spark, a), Grid(a.shape, (17, 3, 3))), a.shape)
    assert np.allclose(got, kernels.spline_prefilter(a), atol=1e-6)
