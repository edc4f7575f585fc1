"""The query catalogue: every registered query with its SQL counterpart."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlake.functions import voxel
from voxlake.operators import blocks, evaluation, gather, kernels, keyed, labels, objects, reduction, slices
from voxlake.operators.blocks import Grid
from voxlake.operators.handles import BlockArray, map_all, pad_to_multiple
from voxlake.plans import flows
from voxlake.plans.subjects import subjects
from voxlake.session import read_table
from voxlake.sources import arrays, ome, paths, pyramids, volumes
from voxlake.storage import cached, shared_dir
from voxlake.tools import chunks_to_text, dumps_numpy, loads_numpy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CHUNKS = (64, 8, 4)
THRESHOLD = 0.2
AXES = volumes.AXES

#: The volume, its depth, its mask with linear ids, components, and chunk keys, as SQL.
_V = "vol as (select vec_id as z, (p - 1) // 8 as y, (p - 1) % 8 as x, f::double as v from (select vec_id, unnest(embedding) as f, generate_subscripts(embedding, 1) as p from embeddings))"
_DIM = "dim as (select max(z) + 1 as d from vol)"
_FG = f"fg as (select (z * 8 + y) * 8 + x as id, z, y, x, z // 64 as bz, y // 8 as by_, x // 4 as bx from vol where v > {THRESHOLD}::double)"
_EDGES = (
    "e as (select a.id as s, b.id as t from fg a join fg b on a.z = b.z and abs(a.y - b.y) + abs(a.x - b.x) = 1 "
    "union all select a.id, b.id from fg a join fg b on a.y = b.y and a.x = b.x and b.z = a.z + 1 "
    "union all select b.id, a.id from fg a join fg b on a.y = b.y and a.x = b.x and b.z = a.z + 1)"
)
_INNER = "ei as (select e.s, e.t from e join fg a on a.id = e.s join fg b on b.id = e.t where a.bz = b.bz and a.by_ = b.by_ and a.bx = b.bx)"


def _components(name: str, edges: str) -> str:
    return f"{name}_(id, l) as (select id, id from fg union select {edges}.t, {name}_.l from {name}_ join {edges} on {edges}.s = {name}_.id where {name}_.l < {edges}.t), {name} as (select id, min(l) as lbl from {name}_ group by id)"


_LABELS = f"with recursive {_V}, {_DIM}, {_FG}, {_EDGES}, {_components('cc', 'e')}, os as (select z, y, x, bz, by_, bx, lbl from cc join fg using (id))"
_LOCAL = f"with recursive {_V}, {_FG}, {_EDGES}, {_INNER}, {_components('lc', 'ei')}"
_OBJECTS = "lc as (select lbl, avg(z) as cz, avg(y) as cy, avg(x) as cx, count(*) as nvoxel, bool_or(z = 0 or z = d - 1 or y = 0 or y = 7 or x = 0 or x = 7) as edge from os, dim group by lbl)"


def _distance(c: str, n: str) -> str:
    return f"abs(((({c}) + {n} / 2.0) % ({n})) - ({n} / 2.0 - 0.5))"


def _weight(parts: list[tuple[str, str]]) -> str:
    return " * ".join(f"(1 / least(greatest(3.0::double + {_distance(c, n)} * -0.5::double, 1), 2))" for c, n in parts)


def query(name: str, sql: str | None = None):
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes.embedding_volume(spark, sf_dir)


def _grid(spark: SparkSession, sf_dir: str, chunks: tuple = CHUNKS) -> Grid:
    return Grid(volumes.volume_shape(spark, sf_dir), chunks)


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(spark, sf_dir).where(voxel.above(F.col("v"), THRESHOLD)).select(*AXES)


def _labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    grid = _grid(spark, sf_dir)
    return labels.label(spark, _mask(spark, sf_dir), grid), grid


def _rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# scans ----------------------------------------------------------------------------------------------


@query("scan_voxels", f"with {_V} select z, y, x, v from vol")
def scan_voxels(spark, sf_dir):
    return _volume(spark, sf_dir)


@query("slice_roi", f"with {_V}, {_DIM} select z - 10 as z, y - 2 as y, x - 5 as x, v from vol where z >= 10 and z < 200 and y >= 2 and y < 6 and x >= 5")
def slice_roi(spark, sf_dir):
    _, indices = paths.split_query("volume?slices=[10:200,2:6,-3:]")
    return paths.sliced(_volume(spark, sf_dir), indices, volumes.volume_shape(spark, sf_dir), AXES)


@query("slice_step", f"with {_V} select z // 5 as z, x // 2 as x, v from vol where z % 5 = 0 and y = 3 and x % 2 = 0")
def slice_step(spark, sf_dir):
    _, indices = paths.split_query("volume?slices=[::5,3,::2]")
    return paths.sliced(_volume(spark, sf_dir), indices, volumes.volume_shape(spark, sf_dir), AXES)


@query("checkerboard", "select a.i as z, b.i as y, c.i as x, cast((a.i // 5 + b.i // 4 + c.i // 2) % 2 as integer) as v from range(20) a(i), range(16) b(i), range(8) c(i)")
def checkerboard(spark, sf_dir):
    return volumes.checkerboard(spark, (20, 16, 8), (5, 4, 2))


@query(
    "synthetic_balls",
    "select 0::bigint as c, a.i as z, b.i as y, c.i as x, cast(floor(least(greatest(1200 - 15 * (0.0::double + ((a.i % 32 - 15.5::double) * (a.i % 32 - 15.5::double) + 0.0002::double * a.i * a.i) "
    "+ ((b.i % 32 - 15.5::double) * (b.i % 32 - 15.5::double) + 0.0002::double * b.i * b.i) + ((c.i % 32 - 15.5::double) * (c.i % 32 - 15.5::double) + 0.0002::double * c.i * c.i)), 0), 1200)) as integer) as v "
    "from range(40) a(i), range(48) b(i), range(64) c(i)",
)
def synthetic_balls(spark, sf_dir):
    return volumes.synthetic_balls(spark, (1, 40, 48, 64))


@query("coord_map", "select a.i as y, b.i as x, (b.i - a.i) as v from range(20) a(i), range(30) b(i)")
def coord_map(spark, sf_dir):
    return volumes.coord_map(spark, (20, 30), lambda y, x: x - y, ("y", "x"))


@query("event_image", "select user_id as y, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as x, round(sum(value), 6) as v from events group by 1, 2")
def event_image(spark, sf_dir):
    return _rounded(volumes.event_image(spark, sf_dir), "v", digits=6)


@query("normalised_pair", f"with {_V} select z, y, x, cast(floor(least(greatest(v / 0.3::double, 0), 1) * 255) as integer) as im, cast(v > 0 as integer) as seg from vol")
def normalised_pair(spark, sf_dir):
    v = _volume(spark, sf_dir)
    return volumes.normalised_pair(v, v, 0.3)


# element-wise ---------------------------------------------------------------------------------------


@query("threshold_mask", f"with {_V} select z, y, x, cast(v > {THRESHOLD}::double as integer) as bs from vol")
def threshold_mask(spark, sf_dir):
    return _volume(spark, sf_dir).select(*AXES, voxel.above(F.col("v"), THRESHOLD).cast("int").alias("bs"))


@query("threshold_count_by_block", f"with {_V} select cast(z // 64 as integer) as bz, cast(y // 8 as integer) as \"by\", cast(x // 4 as integer) as bx, count(*) as n from vol where v > {THRESHOLD}::double group by all")
def threshold_count_by_block(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return grid.with_blocks(_mask(spark, sf_dir)).groupBy(*grid.keys).agg(F.count("*").alias("n"))


@query("clip_scale_u8", f"with {_V} select z, y, x, cast(floor(least(greatest(v / 0.3::double, 0), 1) * 255) as integer) as u8 from vol")
def clip_scale_u8(spark, sf_dir):
    return _volume(spark, sf_dir).select(*AXES, voxel.to_uint8(F.col("v"), 0.3).alias("u8"))


@query("masked_intensity", f"with {_V} select z, y, x, case when v > 0.1::double then v else 0 end as v from vol")
def masked_intensity(spark, sf_dir):
    return _volume(spark, sf_dir).select(*AXES, voxel.masked(F.col("v"), 0.1).alias("v"))


#: A sixteen-bit image and a coarse bias field made from the volume.
_IMAGE = f"{_V}, im as (select z, y, x, cast(floor((v + 1) * 1000) as bigint) as v from vol), bias as (select z // 4 as z, y // 4 as y, x // 4 as x, sum(v)::double / count(*)::double / 1000.0::double as b from im group by all)"


def _image(spark, sf_dir):
    return _volume(spark, sf_dir).withColumn("v", F.floor((F.col("v") + 1) * 1000).cast("long"))


def _bias(spark, sf_dir):
    box = [F.expr(f"cast({a} div 4 as bigint)").alias(a) for a in AXES]
    return _image(spark, sf_dir).groupBy(*box).agg((F.sum("v").cast("double") / F.count("*").cast("double") / 1000.0).alias("b"))


@query("bias_divide", f"with {_IMAGE} select im.z, im.y, im.x, cast(floor(least(greatest(im.v / bias.b, 0), 65535)) as integer) as v from im join bias on im.z // 4 = bias.z and im.y // 4 = bias.y and im.x // 4 = bias.x")
def bias_divide(spark, sf_dir):
    return flows.apply_bias(_image(spark, sf_dir), _bias(spark, sf_dir), (4, 4, 4))


@query("pixel_multiplier", f"with {_IMAGE} select im.z, im.y, im.x, round((1.0::double - cast(im.v > 1100 as integer)) / bias.b, 9) as m from im join bias on im.z // 4 = bias.z and im.y // 4 = bias.y and im.x // 4 = bias.x")
def pixel_multiplier(spark, sf_dir):
    negative = _image(spark, sf_dir).withColumn("v", (F.col("v") > 1100).cast("int"))
    return _rounded(flows.pixel_multiplier(negative, _bias(spark, sf_dir), (4, 4, 4)), "m")


_HALF = "case when v = 0 then 0 else round_even(v / pow(2.0::double, greatest(floor(log2(abs(v))), -14) - 10), 0) * pow(2.0::double, greatest(floor(log2(abs(v))), -14) - 10) end"


@query("half_precision", f"with {_V} select z, y, x, round({_HALF}, 12) as h from vol")
def half_precision(spark, sf_dir):
    return _volume(spark, sf_dir).select(*AXES, F.round(voxel.half_rounded(F.col("v")), 12).alias("h"))


@query(
    "masked_normalised",
    f"with {_IMAGE}, m as (select z, y, x, 1.0::double / b as m from bias), s as (select im.z, im.y, im.x, least(greatest(im.v::double * m.m / 1500.0::double, 0), 1) as v from im join m on im.z // 4 = m.z and im.y // 4 = m.y and im.x // 4 = m.x) "
    f"select z, y, x, round({_HALF}, 12) as v from s",
)
def masked_normalised(spark, sf_dir):
    multiplier = _bias(spark, sf_dir).select(*AXES, (1.0 / F.col("b")).alias("m"))
    return _rounded(flows.normalised(_image(spark, sf_dir), multiplier, (4, 4, 4), 1500.0), "v", digits=12)


# reductions -----------------------------------------------------------------------------------------


def _reduce_sql(fn: str, size: tuple[int, int, int]) -> str:
    a, b, c = size
    return f"with {_V}, {_DIM} select z // {a} as z, y // {b} as y, x // {c} as x, round({fn}, 9) as v from vol, dim where z < d // {a} * {a} and y < {8 // b * b} and x < {8 // c * c} group by 1, 2, 3"


def _reduce(how: str, size: tuple[int, int, int]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(reduction.block_reduce(_volume(spark, sf_dir), size, volumes.volume_shape(spark, sf_dir), how), "v")

    return run


query("block_reduce_max", _reduce_sql("max(v)", (3, 3, 2)))(_reduce("max", (3, 3, 2)))
query("block_reduce_min", _reduce_sql("min(v)", (2, 3, 3)))(_reduce("min", (2, 3, 3)))
query("block_reduce_mean", _reduce_sql("avg(v)", (7, 2, 4)))(_reduce("mean", (7, 2, 4)))
query("block_reduce_sum", _reduce_sql("sum(v)", (16, 4, 4)))(_reduce("sum", (16, 4, 4)))


@query("block_reduce_any", f"with {_V}, {_DIM} select z // 4 as z, y // 4 as y, x // 4 as x, max(cast(v > {THRESHOLD}::double as integer)) as v from vol, dim where z < d // 4 * 4 group by 1, 2, 3")
def block_reduce_any(spark, sf_dir):
    mask = _volume(spark, sf_dir).withColumn("v", voxel.above(F.col("v"), THRESHOLD).cast("int"))
    return reduction.block_reduce(mask, (4, 4, 4), volumes.volume_shape(spark, sf_dir), "any")


@query("downsample_2level", _reduce_sql("max(v)", (4, 4, 4)))
def downsample_2level(spark, sf_dir):
    return _rounded(reduction.downsample(_volume(spark, sf_dir), volumes.volume_shape(spark, sf_dir), 2), "v")


@query("downsample_region", f"with {_V} select (z - 8) // 4 as z, (y - 1) // 2 as y, x // 2 as x, round(max(v), 9) as v from (select z, y // 2 as y, x // 2 as x, v from vol where y % 2 = 0 and x % 2 = 0) where z >= 8 and z < 88 and y >= 1 and y < 3 group by 1, 2, 3")
def downsample_region(spark, sf_dir):
    z, y, x = volumes.volume_shape(spark, sf_dir)
    level = reduction.best_level([0, 1], 1)
    stored = reduction.pyramid_level(_volume(spark, sf_dir), level)
    return _rounded(reduction.downsample(stored, (z, y // 2, x // 2), (2, 2, 2), "max", level, (slice(8, 88), slice(2, 6), slice(None))), "v")


@query("pyramid_level", f"with {_V} select z, y // 2 as y, x // 2 as x, v from vol where y % 2 = 0 and x % 2 = 0")
def pyramid_level(spark, sf_dir):
    return reduction.pyramid_level(_volume(spark, sf_dir), 1)


@query("pyramid", f"with {_V} select k as level, z, y // (1 << k) as y, x // (1 << k) as x, v from vol, (values (0), (1), (2)) l(k) where y % (1 << k) = 0 and x % (1 << k) = 0")
def pyramid(spark, sf_dir):
    return reduction.pyramid(_volume(spark, sf_dir), 2)


@query("block_sum", f"with {_V} select cast(z // 64 as integer) as bz, cast(y // 8 as integer) as \"by\", cast(x // 4 as integer) as bx, round(sum(v), 9) as total from vol group by all")
def block_sum(spark, sf_dir):
    return _rounded(blocks.block_sum(_volume(spark, sf_dir), _grid(spark, sf_dir)), "total")


@query(
    "sum_intensity_block",
    f"with {_V}, {_DIM} select cast(z // 64 as integer) as bz, cast(y // 8 as integer) as \"by\", cast(x // 4 as integer) as bx, z // 64 * 64 + (least(z // 64 * 64 + 64, any_value(d)) - z // 64 * 64) / 2.0::double as cz, y // 8 * 8 + 4.0::double as cy, x // 4 * 4 + 2.0::double as cx, "
    "round(sum(case when v > 0.05::double then v else 0 end) * 0.008::double, 9) as ncells from vol, dim group by z // 64, y // 8, x // 4",
)
def sum_intensity_block(spark, sf_dir):
    return _rounded(reduction.intensity_by_block(_volume(spark, sf_dir), _grid(spark, sf_dir), threshold=0.05), "ncells")


@query(
    "sum_intensity_box",
    f"with {_V}, b as (select z // 64 as bz, y // 8 as by_, x // 4 as bx, z % 64 // 3 as iz, y % 8 // 3 as iy, x % 4 // 3 as ix, v from vol) select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, cast(iz as integer) as iz, cast(iy as integer) as iy, cast(ix as integer) as ix, "
    "bz * 64 + (iz + 0.5::double) * 3 as cz, by_ * 8 + (iy + 0.5::double) * 3 as cy, bx * 4 + (ix + 0.5::double) * 3 as cx, round(sum(case when v > 0.05::double then v else 0 end) * 0.008::double, 9) as ncells from b group by bz, by_, bx, iz, iy, ix",
)
def sum_intensity_box(spark, sf_dir):
    return _rounded(reduction.intensity_by_box(_volume(spark, sf_dir), _grid(spark, sf_dir), 3, threshold=0.05), "ncells")


@query("event_block_reduce", "with e as (select user_id as y, cast(floor(epoch(ts - timestamp '2024-01-01') / 3600) as bigint) as x, sum(value) as v from events group by 1, 2), d as (select max(user_id) + 1 as n from events) select y // 4 as y, x // 24 as x, round(sum(v), 6) as v from e, d where y < n // 4 * 4 group by 1, 2")
def event_block_reduce(spark, sf_dir):
    users = read_table(spark, sf_dir, "events").agg(F.max("user_id") + 1).first()[0]
    return _rounded(reduction.block_reduce(volumes.event_image(spark, sf_dir), (4, 24), (users, 720), "sum", ("y", "x")), "v", digits=6)


@query("sparse_grid_boxes", "select l_partkey // 50 as z, l_suppkey // 10 as y, (year(l_shipdate) - 1992) // 2 as x, round(sum(l_quantity), 6) as v from lineitem group by 1, 2, 3")
def sparse_grid_boxes(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("z"), F.col("l_suppkey").alias("y"), (F.year("l_shipdate") - 1992).cast("long").alias("x"), F.col("l_quantity").alias("v"))
    whole = (50 * (1 << 40), 10 * (1 << 40), 2 * (1 << 20))
    return _rounded(reduction.block_reduce(rows, (50, 10, 2), whole, "sum"), "v", digits=6)


# labels and objects ---------------------------------------------------------------------------------


@query("label_voxels", f"{_LABELS} select z, y, x, lbl from os")
def label_voxels(spark, sf_dir):
    return _labels(spark, sf_dir)[0]


@query("label_sizes", f"{_LABELS} select lbl, count(*) as nvoxel from os group by lbl")
def label_sizes(spark, sf_dir):
    return objects.label_sizes(_labels(spark, sf_dir)[0])


@query("seam_edges", f"{_LOCAL} select distinct b.lbl as a, a.lbl as b from fg p join fg q on (q.z = p.z + 1 and q.y = p.y and q.x = p.x or q.z = p.z and q.y = p.y + 1 and q.x = p.x or q.z = p.z and q.y = p.y and q.x = p.x + 1) join lc a on a.id = p.id join lc b on b.id = q.id where (p.bz, p.by_, p.bx) <> (q.bz, q.by_, q.bx)")
def seam_edges(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return labels.seam_edges(labels.local_labels(_mask(spark, sf_dir), grid), grid)


@query(
    "label_offsets",
    f"{_LOCAL}, n as (select bz, by_, bx, count(distinct lbl) as n from lc join fg using (id) group by all) select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, n, cast(coalesce(sum(n) over (order by bz, by_, bx rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from n",
)
def label_offsets(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return labels.label_counts(labels.local_labels(_mask(spark, sf_dir), grid), grid)


@query("dense_remap", f"{_LABELS} select lbl, row_number() over (order by lbl) as dense from (select distinct lbl from os)")
def dense_remap(spark, sf_dir):
    return labels.dense_ids(_labels(spark, sf_dir)[0])


@query(
    "os_to_lc_block",
    f"{_LABELS} select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, lbl, round(avg(z), 9) as cz, round(avg(y), 9) as cy, round(avg(x), 9) as cx, count(*) as nvoxel, "
    "bool_or(z = bz * 64 or z = least(bz * 64 + 64, d) - 1 or y = 0 or y = 7 or x = bx * 4 or x = bx * 4 + 3) as edge_contact from os, dim group by bz, by_, bx, lbl",
)
def os_to_lc_block(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    return _rounded(objects.objects_by_block(found, grid), "cz", "cy", "cx")


@query(
    "os_to_lc_global",
    f"{_LABELS}, {_OBJECTS} select cast(floor(cz / 64) as integer) as bz, cast(floor(cy / 8) as integer) as \"by\", cast(floor(cx / 4) as integer) as bx, lbl, round(cz, 9) as cz, round(cy, 9) as cy, round(cx, 9) as cx, nvoxel, edge as edge_contact from lc",
)
def os_to_lc_global(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    return _rounded(objects.objects_global(found, grid), "cz", "cy", "cx")


@query(
    "os_to_lc_fragments",
    f"{_LABELS}, part as (select bz, by_, bx, lbl, count(*) as n, sum(z) as sz, sum(y) as sy, sum(x) as sx from os group by all having count(*) > 1) select lbl, round(sum(sz)::double / sum(n), 9) as cz, round(sum(sy)::double / sum(n), 9) as cy, round(sum(sx)::double / sum(n), 9) as cx, cast(sum(n) as bigint) as nvoxel from part group by lbl",
)
def os_to_lc_fragments(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    return _rounded(objects.objects_global(found, grid, 1, by_fragment=True).select("lbl", "cz", "cy", "cx", "nvoxel"), "cz", "cy", "cx")


@query("object_bbox", f"{_LABELS} select lbl, min(z) as z0, min(y) as y0, min(x) as x0, max(z) + 1 as z1, max(y) + 1 as y1, max(x) + 1 as x1 from os group by lbl")
def object_bbox(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    return objects.bounding_boxes(found, grid)


@query("object_voxels", f"{_LABELS} select lbl, string_agg(z || ':' || y || ':' || x, ',' order by z, y, x) as voxels from os group by lbl")
def object_voxels(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    return objects.voxel_lists(found, grid).select("lbl", F.array_join(F.transform("voxels", lambda p: F.concat_ws(":", p.z, p.y, p.x)), ",").alias("voxels"))


@query("size_classes", f"{_LABELS}, s as (select lbl, count(*) as n from os group by lbl) select case when n < 2 then 'small' else 'big' end as class, z, y, x, lbl from os join s using (lbl)")
def size_classes(spark, sf_dir):
    small, big = objects.split_by_size(_labels(spark, sf_dir)[0], 2)
    return small.withColumn("class", F.lit("small")).unionByName(big.withColumn("class", F.lit("big")))


_NCELLS = f"case when nvoxel <= 0 then 0 else (case when edge then {_weight([('cz', 'd'), ('cy', '8'), ('cx', '8')])} else 1 end) + (case when nvoxel > 2 then (nvoxel - 2) * 0.25::double else 0 end) end"


@query("cc_by_size", f"{_LABELS}, {_OBJECTS} select lbl, round({_NCELLS}, 9) as ncells from lc, dim")
def cc_by_size(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    return _rounded(flows.count_cells(spark, _volume(spark, sf_dir), grid).select("lbl", "ncells"), "ncells")


@query(
    "cc_edge_penalized",
    f"{_LABELS}, b as (select bz, by_, bx, lbl, avg(z) - bz * 64 as cz, avg(y) as cy, avg(x) - bx * 4 as cx, least(bz * 64 + 64, any_value(d)) - bz * 64 as nz from os, dim group by bz, by_, bx, lbl) "
    f"select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, lbl, round({_weight([('cz', 'nz'), ('cy', '8'), ('cx', '4')])}, 9) as ncells from b",
)
def cc_edge_penalized(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    counted = objects.count_edge_penalized(objects.objects_by_block(found, grid), grid)
    return _rounded(counted.select(*grid.keys, "lbl", "ncells"), "ncells")


_TOTALS = f"{_LABELS}, {_OBJECTS}, t as (select floor(cz / 64) as bz, floor(cy / 8) as by_, floor(cx / 4) as bx, sum({_NCELLS}) as n, any_value(d) as d from lc, dim group by 1, 2, 3)"


@query(
    "cc_block_total",
    f"{_TOTALS} select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, bz * 64 + (least(bz * 64 + 64, d) - bz * 64 + 1) / 2.0::double as cz, by_ * 8 + 4.5::double as cy, bx * 4 + 2.5::double as cx, round(n, 9) as ncells from t",
)
def cc_block_total(spark, sf_dir):
    return _rounded(flows.cells_per_block(spark, _volume(spark, sf_dir), _grid(spark, sf_dir)), "ncells")


@query("density_log2", f"{_TOTALS} select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, round(log2(n + 1), 9) as density from t")
def density_log2(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    totals = flows.cells_per_block(spark, _volume(spark, sf_dir), grid)
    return _rounded(totals.select(*grid.keys, voxel.log_density(F.col("ncells")).alias("density")), "density")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume to mask to objects to cells per block."""
    return cc_block_total(spark, sf_dir)


# gathers --------------------------------------------------------------------------------------------


def _scale_sql(s: float) -> str:
    """The input voxel under each output voxel's centre, for a scale of all axes."""
    at = ", ".join(f"cast(least(greatest(floor(({1 / s!r})::double * (o{a}.i + 0.5::double)), 0), {n} - 1) as bigint) as {a}" for a, n in zip("zyx", ("d", 8, 8), strict=True))
    return f"with {_V}, {_DIM}, oz as (select unnest(range(cast(floor(d * {s!r}::double) as bigint))) as i from dim), o as (select oz.i as oz, oy.i as oy, ox.i as ox, {at} from dim, oz, range({int(8 * s)}) oy(i), range({int(8 * s)}) ox(i)) select oz as z, oy as y, ox as x, v from o join vol using (z, y, x)"


def _scaled(s: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return gather.scale_nearest(spark, _volume(spark, sf_dir), s, volumes.volume_shape(spark, sf_dir))

    return run


query("scale_nearest_up", _scale_sql(1.5))(_scaled(1.5))
query("scale_nearest_down", _scale_sql(0.5))(_scaled(0.5))


@query("affine_transpose", f"with {_V} select x as z, y, z as x, v from vol")
def affine_transpose(spark, sf_dir):
    shape = volumes.volume_shape(spark, sf_dir)
    swap = [[0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [1.0, 0.0, 0.0]]
    return gather.affine_nearest(spark, _volume(spark, sf_dir), swap, [0.0] * 3, shape, (8, 8, shape[0]))


@query("affine_mirror", f"with {_V}, {_DIM} select z, y, 7 - x as x, v from vol union all select d + k as z, y, x, 0 as v from dim, range(20) k(k), range(8) y(y), range(8) x(x)")
def affine_mirror(spark, sf_dir):
    shape = volumes.volume_shape(spark, sf_dir)
    matrix = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, -1.0]]
    return gather.affine_nearest(spark, _volume(spark, sf_dir), matrix, [0.0, 0.0, 8.0], shape, (shape[0] + 20, 8, 8), cval=0.0)


#: Planes from one seed to the next, and the cells in which seeds are looked for.
_SEED_STEP, _SEED_CELL = 10, 14


@query(
    "voronoi",
    f"with {_V}, {_DIM}, seeds as (select cast(i // {_SEED_STEP} as bigint) as seed, i as sz, (i // {_SEED_STEP}) % 8 as sy, (i // {_SEED_STEP} // 2) % 8 as sx from (select unnest(range(0, d, {_SEED_STEP})) as i from dim)) "
    "select z, y, x, arg_min(seed, ((z - sz) ** 2 + (y - sy) ** 2 + (x - sx) ** 2) * 100000 + seed) as seed from vol, seeds group by z, y, x",
)
def voronoi(spark, sf_dir):
    depth = volumes.volume_shape(spark, sf_dir)[0]
    seeds = spark.range(0, depth, _SEED_STEP).select(F.expr(f"id div {_SEED_STEP}").alias("seed"), F.col("id").alias("z")).select("seed", "z", F.expr("seed % 8").alias("y"), F.expr("seed div 2 % 8").alias("x"))
    return gather.nearest_seed(spark, _volume(spark, sf_dir).select(*AXES), seeds, cell=_SEED_CELL)


@query(
    "split_by_seeds",
    f"{_LABELS}, seed as (select id, z, y, x, lbl, row_number() over (partition by lbl order by id) - 1 as k from cc join fg using (id) where id % 2 = 0), n as (select lbl, count(*) as n from seed group by lbl) "
    "select os.z, os.y, os.x, os.lbl, coalesce(case when any_value(n.n) between 2 and 10 then arg_min(seed.k, ((os.z - seed.z) ** 2 + (os.y - seed.y) ** 2 + (os.x - seed.x) ** 2) * 1000 + seed.k) end, 0)::integer as part "
    "from os left join n using (lbl) left join seed using (lbl) group by os.z, os.y, os.x, os.lbl",
)
def split_by_seeds(spark, sf_dir):
    found, grid = _labels(spark, sf_dir)
    seeds = labels.with_ids(_mask(spark, sf_dir), grid).where("id % 2 = 0").select(F.col("id").alias("seed"), *AXES)
    return gather.split_by_seeds(found, seeds)


# slices ---------------------------------------------------------------------------------------------


@query("stacked_slices", f"with {_V}, {_DIM} select a.z, a.y, a.x, a.v as v0, b.v as v1, c.v as v2 from vol a join vol b on b.z = a.z + 2 and b.y = a.y and b.x = a.x join vol c on c.z = a.z + 4 and c.y = a.y and c.x = a.x")
def stacked_slices(spark, sf_dir):
    return slices.stacked(_volume(spark, sf_dir), 2, volumes.volume_shape(spark, sf_dir)[0])


@query("unstacked_slices", f"with {_V} select z, y, x, v from vol")
def unstacked_slices(spark, sf_dir):
    depth = volumes.volume_shape(spark, sf_dir)[0]
    return slices.unstacked(slices.stacked(_volume(spark, sf_dir), 2, depth), 2, depth)


@query("transpose_axes", f"with {_V} select y as z, x as y, z as x, v from vol")
def transpose_axes(spark, sf_dir):
    return slices.transposed(_volume(spark, sf_dir), slices.PLANES["xz"])


@query(
    "triplanar_vote",
    f"with {_V}, {_DIM}, p as (select z, y, x, v as a, -v + 0.01::double as b, v * v - 0.02::double as c from vol), s as (select stddev_pop(a) as sa, stddev_pop(b) as sb, stddev_pop(c) as sc from p), "
    "w as (select p.*, case when z in (0, d - 1) then 0 else sin(pi() * z / (d - 1)) end as wz, case when y in (0, 7) then 0 else 0.5::double * sin(pi() * y / 7) end as wy, case when x in (0, 7) then 0 else sin(pi() * x / 7) end as wx from p, dim) "
    "select z, y, x, wz + wy + wx > 0 and (a / sa * wz + b / sb * wy + c / sc * wx) > 0 as seg from w, s",
)
def triplanar_vote(spark, sf_dir):
    v, depth = _volume(spark, sf_dir), volumes.volume_shape(spark, sf_dir)[0]
    parts = [v, v.withColumn("v", 0.01 - F.col("v")), v.withColumn("v", F.col("v") * F.col("v") - 0.02)]
    return slices.vote(parts, [1.0, 0.5, 1.0], [("z", depth), ("y", 8), ("x", 8)])


# evaluation, sets, keyed collections ----------------------------------------------------------------


@query("dice", f"with {_V} select cast(sum(cast(v > 0.1::double and v > 0.05::double and x > 0 as integer)) as bigint) as common, cast(sum(cast(v > 0.1::double as integer)) as bigint) as n_a, cast(sum(cast(v > 0.05::double and x > 0 as integer)) as bigint) as n_b, round(2.0::double * sum(cast(v > 0.1::double and x > 0 as integer)) / (sum(cast(v > 0.1::double as integer)) + sum(cast(v > 0.05::double and x > 0 as integer))), 12) as dice from vol")
def dice(spark, sf_dir):
    v = _volume(spark, sf_dir)
    return _rounded(evaluation.dice(v.where(voxel.above(F.col("v"), 0.1)), v.where(voxel.above(F.col("v"), 0.05) & (F.col("x") > 0))), "dice", digits=12)


@query("mae", f"with {_V}, n as (select z, count(*) filter (where v > 0.1::double) as counted, count(*) filter (where v > 0.12::double) as truth from vol group by z) select round(avg(abs(counted - truth)), 9) as mae from n")
def mae(spark, sf_dir):
    n = _volume(spark, sf_dir).groupBy("z").agg(F.count_if(F.col("v") > 0.1).alias("counted"), F.count_if(F.col("v") > 0.12).alias("truth"))
    return _rounded(evaluation.mean_absolute_error(n, "counted", "truth"), "mae")


@query("kde_grid", "with s as (select count(*) as n, stddev_samp(value) * pow(count(*), -0.2) as h from events) select cast(i as integer) as i, round(0.0::double + i / 100.0::double * 200.0::double, 9) as x, round(sum(exp(-0.5::double * pow((i / 100.0::double * 200.0::double - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) as density from events, s, range(101) g(i) group by i")
def kde_grid(spark, sf_dir):
    return _rounded(evaluation.density_curve(read_table(spark, sf_dir, "events"), "value", 0.0, 200.0), "x", "density")


@query("setdiff_rows", "select c_nationkey as k, c_mktsegment as m from customer where c_acctbal > 0 except select c_nationkey, c_mktsegment from customer where c_acctbal > 6000")
def setdiff_rows(spark, sf_dir):
    rows = read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("m"), "c_acctbal")
    return keyed.setdiff_rows(rows.where("c_acctbal > 0").select("k", "m"), rows.where("c_acctbal > 6000").select("k", "m"))


@query("unique_rows", "select c_nationkey as k, c_mktsegment as m, count(*) as n from customer group by all")
def unique_rows(spark, sf_dir):
    return keyed.unique_rows(read_table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("m")), "k", "m")


@query("mask_xor", f"with {_V} select z, y, x from vol where (v > 0.1::double) <> (x > 3)")
def mask_xor(spark, sf_dir):
    return _volume(spark, sf_dir).where(voxel.xor(voxel.above(F.col("v"), 0.1), F.col("x") > 3)).select(*AXES)


@query("unique_inverse", "select o_orderkey as id, o_custkey as v, dense_rank() over (order by o_custkey) - 1 as inverse from orders")
def unique_inverse(spark, sf_dir):
    return keyed.unique_with_inverse(read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("v")), "v")


_ENTRIES = "d as (select n_nationkey as pos, n_name as k, n_regionkey as v from nation)"


def _entries(spark, sf_dir):
    return read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("k"), F.col("n_regionkey").alias("v"))


@query("key_semijoin", "select p_partkey as pos, p_name as k, p_size as v from part where p_partkey in (select l_partkey from lineitem where l_quantity > 45) and p_name in (select p_name from part where p_size > 25)")
def key_semijoin(spark, sf_dir):
    part, lines = read_table(spark, sf_dir, "part"), read_table(spark, sf_dir, "lineitem")
    first = part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("k"), F.col("p_size").alias("v"))
    sold = part.join(lines.where("l_quantity > 45"), part.p_partkey == lines.l_partkey, "left_semi")
    common = keyed.common_keys(first, part.where("p_size > 25").select(F.col("p_name").alias("k")))
    return common.join(sold.select(F.col("p_partkey").alias("pos")), "pos", "left_semi").select("pos", "k", "v")


@query("ordered_subset", f"with {_ENTRIES}, w as (select k, cast(row_number() over (order by k desc) - 1 as integer) as pos from (select k from d where pos % 3 = 0)) select w.pos, d.k, d.v from w join d using (k)")
def ordered_subset(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    names = sorted((r.k for r in entries.where("pos % 3 = 0").select("k").collect()), reverse=True)
    return keyed.subset(entries, names)


@query("key_edits", f"with {_ENTRIES}, r as (select min(k) as a, max(k) as z from d), p as (select pos as gone from d, r where d.k = r.z), c as (select count(*) as n from d) select cast(case when pos > gone then pos - 1 else pos end as integer) as pos, case when k = a then 'first of all' else k end as k, v from d, r, p where k <> z union all select cast(n - 1 as integer), 'last of all', 7 from c")
def key_edits(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    ends = entries.agg(F.min("k").alias("a"), F.max("k").alias("z")).first()
    return keyed.put(keyed.rename(keyed.remove(entries, ends.z), ends.a, "first of all"), "last of all", 7)


@query("trimmed_keys", "with d as (select r_regionkey as pos, 'vol_' || r_name || '.npy' as k, length(r_name) as v from region) select pos, replace(replace(k, 'vol_', ''), '.npy', '') as k, v from d")
def trimmed_keys(spark, sf_dir):
    entries = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("vol_"), "r_name", F.lit(".npy")).alias("k"), F.length("r_name").cast("long").alias("v"))
    return keyed.trim_keys(entries, "vol_", ".npy")


@query("key_helpers", f"with {_ENTRIES}, e as (select max(pos) as last from d) select 'at 1' as what, k as shown from d where pos = 1 union all select 'at -2', k from d, e where pos = last - 1 union all select 'popped', cast(v as varchar) from d where pos = 3 union all select 'default', '-1' union all select 'left', cast(count(*) - 1 as varchar) from d union all select 'cleared', '0' union all select 'first ' || cast(pos as varchar), k from d where pos < 3")
def key_helpers(spark, sf_dir):
    entries = _entries(spark, sf_dir)
    name = keyed.key_at(entries, 3)
    left, popped = keyed.pop(entries, name)
    _, default = keyed.pop(left, name, -1)
    rows = [("at 1", keyed.key_at(entries, 1)), ("at -2", keyed.key_at(entries, -2)), ("popped", str(popped)), ("default", str(default)), ("left", str(left.count())), ("cleared", str(keyed.clear(entries).count()))]
    rows += [(f"first {r.pos}", r.k) for r in keyed.first_rows(keyed.ordered(entries), 3, "pos").collect()]
    return spark.createDataFrame(rows, "what string, shown string")


@query("reordered_keys", f"with {_ENTRIES} select cast(row_number() over (order by k desc) - 1 as bigint) as pos, k, v from d")
def reordered_keys(spark, sf_dir):
    entries = _entries(spark, sf_dir).withColumn("pos", F.col("pos").cast("long"))
    return keyed.reorder(entries, sorted((r.k for r in entries.collect()), reverse=True))


@query("trimmed_common_keys", "select r_regionkey as pos, r_name as k, length(r_name) as v from region")
def trimmed_common_keys(spark, sf_dir):
    entries = read_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.concat(F.lit("vol_"), "r_name", F.lit("!.npy")).alias("k"), F.length("r_name").cast("long").alias("v"))
    return keyed.trim_common(entries)


@query("column_sets", "select r_regionkey + 1 as more, r_name from region")
def column_sets(spark, sf_dir):
    regions = read_table(spark, sf_dir, "region")
    added = keyed.add_columns(regions, {"more": F.col("r_regionkey") + 1})
    return keyed.drop_columns(keyed.keep_columns(added, ["more", "r_name", "r_regionkey"]), ["r_regionkey"])


@query("path_names", "select page_id, url_encode(url) as encoded, regexp_extract(regexp_replace(split_part(url, '?', 1), '/+$', ''), '[^/]*$') as name from pages")
def path_names(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", paths.encoded_column(F.col("url")).alias("encoded"), paths.file_name_column(F.col("url")).alias("name"))


@query("subject_names", "with s as (select s_suppkey as id, s_name || case s_suppkey % 3 when 0 then 'oldBlaze' when 1 then 'Blaze' else '' end as subject_id, s_name from supplier) select id, subject_id, s_name as short_id, cast(case when id % 3 = 2 then 1 else 0 end as integer) as channel from s")
def subject_names(spark, sf_dir):
    ending = F.when(F.col("s_suppkey") % 3 == 0, "oldBlaze").when(F.col("s_suppkey") % 3 == 1, "Blaze").otherwise("")
    table = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", ending).alias("subject_id"))
    return subjects(table).select("id", "subject_id", "short_id", "channel")


# handles, storage and files -------------------------------------------------------------------------


@query(
    "volume_handle",
    f"with {_V}, {_DIM} select 'ndim' as property, '3' as shown union all select 'numblocks', cast((d + 63) // 64 as varchar) || ',1,2' from dim union all select 'chunksize', least(64, d) || ',8,4' from dim union all select 'dtype', 'double' "
    "union all select 'blocks', cast((d + 63) // 64 * 2 as varchar) from dim union all select 'slices', cast((d + 63) // 64 * 2 as varchar) from dim union all select 'is_numpy', 'False' union all select 'total', cast(round(sum(v), 6) as varchar) from vol",
)
def volume_handle(spark, sf_dir):
    handle = BlockArray(_volume(spark, sf_dir), _grid(spark, sf_dir))
    shown = handle.properties()
    rows = [(k, chunks_to_text(v) if isinstance(v, tuple) else str(v)) for k, v in shown.items() if k != "repr_format"]
    rows += [("blocks", str(len(handle.block_indices()))), ("slices", str(len(handle.slices_list())))]
    total = handle.total().select(F.lit("total").alias("property"), F.round("total", 6).cast("string").alias("shown"))
    return spark.createDataFrame(rows, "property string, shown string").unionByName(total)


@query("block_arrays", "select a.i as z, b.i as y, c.i as x, cast((a.i * 6 + b.i) * 4 + c.i as double) as v from range(5) a(i), range(6) b(i), range(4) c(i)")
def block_arrays(spark, sf_dir):
    """Arrays by block to a volume, to a dense array, and back."""
    grid = Grid((5, 6, 4), ((2, 3), 4, 4))
    dense = volumes.coord_map(spark, grid.shape, lambda z, y, x: ((z * 6 + y) * 4 + x).cast("double"))
    array = BlockArray(dense, grid).to_numpy()
    parts = dict(zip(BlockArray(dense, grid).block_indices(), [loads_numpy(dumps_numpy(array[s])) for s in BlockArray(dense, grid).slices_list()]))
    return BlockArray.from_blocks(spark, parts, grid).rechunked((5, 3, 2)).frame()


@query("mapped_blocks", f"with {_V} select cast(z // 64 as integer) as bz, cast(y // 8 as integer) as \"by\", cast(x // 4 as integer) as bx, count(*) as n, round(sum(v), 9) as a, round(sum(2 * v), 9) as b, round(sum(v * v), 9) as c from vol group by all")
def mapped_blocks(spark, sf_dir):
    v, grid = _volume(spark, sf_dir), _grid(spark, sf_dir)

    def sums(block, parts):
        import pandas as pd

        return pd.DataFrame({**{k: [b] for k, b in zip(grid.keys, block)}, "n": [len(parts[0])], **{name: [p["v"].sum()] for name, p in zip("abc", parts)}})

    frames = [v, v.withColumn("v", 2 * F.col("v")), v.withColumn("v", F.col("v") * F.col("v"))]
    return _rounded(map_all(frames, grid, sums, "bz int, `by` int, bx int, n long, a double, b double, c double"), "a", "b", "c")


@query("pad_to_multiple", f"with {_V}, {_DIM}, o as (select unnest(range((d + 6) // 7 * 7)) as z from dim) select z, y.i as y, x.i as x, coalesce(v, 0) as v from o, range(14) y(i), range(14) x(i) left join vol on vol.z = o.z and vol.y = y.i and vol.x = x.i")
def pad_multiple(spark, sf_dir):
    return pad_to_multiple(BlockArray(_volume(spark, sf_dir), _grid(spark, sf_dir)), 7, spark).frame()


query("block_reduce_median", _reduce_sql("median(v)", (4, 2, 2)))(_reduce(F.median, (4, 2, 2)))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/voxlake/{name}-{uuid.uuid4().hex}"


@query("ome_zarr_levels", f"with {_V} select k as level, z, y // (1 << k) as y, x // (1 << k) as x, v from vol, (values (0), (1)) l(k) where y % (1 << k) = 0 and x % (1 << k) = 0")
def ome_zarr_levels(spark, sf_dir):
    """A volume written as OME-Zarr with Blosc chunks and read back, all levels."""
    path = _folder(spark, "image")
    ome.write_image(spark, path, _volume(spark, sf_dir), volumes.volume_shape(spark, sf_dir), (64, 4, 4), 1, dtype="<f8")
    both = [ome.read_image(spark, path, k).withColumn("level", F.lit(k)) for k in (0, 1)]
    return both[0].unionByName(both[1])


@query("ome_zarr_slice", f"with {_V} select z - 70 as z, x // 2 as x, v from vol where z >= 70 and z < 100 and y = 3 and x % 2 = 0")
def ome_zarr_slice(spark, sf_dir):
    path = _folder(spark, "image")
    ome.write_image(spark, path, _volume(spark, sf_dir), volumes.volume_shape(spark, sf_dir), (16, 4, 4), dtype="<f8", options={"compressor": {"id": "blosc", "cname": "zstd", "clevel": 3, "shuffle": 1}})
    return ome.read_image(spark, f"{path}?slices=[70:100,3,::2]")


@query("ome_zarr_labels", f"{_LABELS} select z, y, x, cast(lbl as double) as v from os where lbl <> 0")
def ome_zarr_labels(spark, sf_dir):
    path, (found, grid) = _folder(spark, "image"), _labels(spark, sf_dir)
    ome.write_image(spark, path, _volume(spark, sf_dir), grid.shape, (64, 8, 8), dtype="<f4", labels=found, label_dtype="<i8")
    return ome.read_image(spark, path, label="label", sparse=True)


@query("stored_pyramid", f"with {_V} select z - 5 as z, y // 2 as y, x // 2 as x, v from vol where z >= 5 and z < 40 and y % 2 = 0 and x % 2 = 0")
def stored_pyramid(spark, sf_dir):
    path = _folder(spark, "pyramid")
    pyramids.write_pyramid(spark, path, _volume(spark, sf_dir), volumes.volume_shape(spark, sf_dir), 1)
    return pyramids.read_level(spark, f"{path}?slices=[5:40,:,:]", pyramids.highest_level(spark, path))


@query("slice_files", f"with {_V} select z, y, x, cast(floor(least(greatest(v / 0.3::double, 0), 1) * 255) as integer) as v from vol")
def slice_files(spark, sf_dir):
    """Every plane as a PNG file, and the volume that the files give."""
    folder = _folder(spark, "slices")
    planes = _volume(spark, sf_dir).select(*AXES, voxel.to_uint8(F.col("v"), 0.3).alias("v"))
    arrays.write_slices(planes, folder, volumes.PLANE).count()
    return arrays.recover_volumes(spark, f"{folder}/*.png").select(*AXES, "v")


@query("training_set", f"with {_V}, p as (select z, y, x, cast(floor(least(greatest(v / 0.3::double, 0), 1) * 255) as integer) as v, cast(v > 0 as integer) as lbl from vol) select z, y, x, v, lbl from p")
def training_set(spark, sf_dir):
    """Cases of a two-dimensional training set, written as files and read back."""
    folder, v = _folder(spark, "dataset"), _volume(spark, sf_dir).withColumn("volume", F.lit("vol"))
    images = v.withColumn("v", voxel.to_uint8(F.col("v"), 0.3))
    arrays.write_training_set(spark, folder, images, v.withColumn("lbl", (F.col("v") > 0).cast("int")), volumes.PLANE)
    read = [arrays.recover_volumes(spark, f"{folder}/{part}/*.png") for part in ("imagesTr", "labelsTr")]
    number = F.regexp_extract("volume", r"(\d+)$", 1).cast("long")
    pixels = read[0].select(number.alias("z"), "y", "x", "v")
    return pixels.join(read[1].select(F.col("z"), "y", "x", F.col("v").alias("lbl")), ["z", "y", "x"])


@query("cached_stage", f"with {_V} select z, sum(v > 0)::bigint as n from vol group by z")
def cached_stage(spark, sf_dir):
    """A stage that is computed once: the second call reads what the first committed."""
    path = _folder(spark, "stage")
    cached(spark, lambda: _volume(spark, sf_dir).groupBy("z").agg(F.count_if(F.col("v") > 0).alias("n")), path)
    return cached(spark, _volume(spark, sf_dir).limit(0), path)


#: The production flow on the volume reduced by two: artefacts masked, bias corrected, threshold, labels, objects, counts.
_SMALL = f"{_IMAGE}, {_DIM}, small as (select z // 2 as z, y // 2 as y, x // 2 as x, max(im.v) as v from im, dim where z < d // 2 * 2 group by 1, 2, 3), field as (select z // 4 as z, y // 4 as y, x // 4 as x, sum(v)::double / count(*)::double / 1000.0::double as b from small group by all), fixed as (select s.z, s.y, s.x, floor(least(greatest(case when s.v > 1250 then 0 else s.v end::double / f.b, 0), 65535)) as v from small s join field f on s.z // 4 = f.z and s.y // 4 = f.y and s.x // 4 = f.x)"
_FLOW_FG = "fg as (select (z * 4 + y) * 4 + x as id, z, y, x, z // 32 as bz, y // 4 as by_, x // 2 as bx from fixed where v > 1050)"
_FLOW_CELLS = f"(case when edge then {_weight([('cz', 'd2'), ('cy', '4'), ('cx', '4')])} else 1 end) + (case when nvoxel > 2 then (nvoxel - 2) * 0.25::double else 0 end)"


@query(
    "production_flow",
    f"with recursive {_SMALL}, {_FLOW_FG}, {_EDGES}, {_components('cc', 'e')}, os as (select z, y, x, lbl from cc join fg using (id)), "
    "lc as (select lbl, avg(z) as cz, avg(y) as cy, avg(x) as cx, count(*) as nvoxel, bool_or(z = 0 or z = d // 2 - 1 or y = 0 or y = 3 or x = 0 or x = 3) as edge, any_value(d // 2) as d2 from os, dim group by lbl), "
    f"t as (select floor(cz / 32) as bz, floor(cy / 4) as by_, floor(cx / 2) as bx, sum({_FLOW_CELLS}) as n, any_value(d2) as d2 from lc group by 1, 2, 3) "
    "select cast(bz as integer) as bz, cast(by_ as integer) as \"by\", cast(bx as integer) as bx, bz * 32 + (least(bz * 32 + 32, d2) - bz * 32 + 1) / 2.0::double as cz, by_ * 4 + 2.5::double as cy, bx * 2 + 1.5::double as cx, round(n, 9) as ncells from t",
)
def production_flow(spark, sf_dir):
    depth = volumes.volume_shape(spark, sf_dir)[0] // 2
    how = flows.Production(counting=flows.Counting(threshold=1050.0))
    found = flows.production(spark, _image(spark, sf_dir), Grid((depth, 4, 4), (32, 4, 2)), how, stages=_folder(spark, "run"))
    return _rounded(found["totals"], "ncells")


# neighbourhood kernels ------------------------------------------------------------------------------


@query(
    "edt",
    f"with {_V}, b as (select z, y, x, z // 16 as bz, y // 8 as by_, x // 8 as bx, v > {THRESHOLD}::double as f from vol) select cast(p.bz as integer) as bz, cast(p.by_ as integer) as \"by\", cast(p.bx as integer) as bx, p.z, p.y, p.x, round(sqrt(min((p.z - q.z) ** 2 + (p.y - q.y) ** 2 + (p.x - q.x) ** 2)), 9) as distance from b p join b q on p.bz = q.bz and p.by_ = q.by_ and p.bx = q.bx and not q.f where p.f group by p.bz, p.by_, p.bx, p.z, p.y, p.x",
)
def edt(spark, sf_dir):
    return _rounded(kernels.edt_by_block(_mask(spark, sf_dir), _grid(spark, sf_dir, (16, 8, 8))), "distance")


@query("watershed_3sizes")
def watershed_3sizes(spark, sf_dir):
    mask = _volume(spark, sf_dir).where(voxel.above(F.col("v"), 0.02)).select(*AXES)
    return kernels.watershed_by_block(mask, _grid(spark, sf_dir), size1=5, size2=40, least2=10)


@query("blob_dog")
def blob_dog(spark, sf_dir):
    return kernels.blobs_by_block(_volume(spark, sf_dir).withColumn("v", voxel.clipped(F.col("v") * 3, 0, 1)), _grid(spark, sf_dir))


@query("spline_prefilter")
def spline_prefilter(spark, sf_dir):
    return kernels.spline_by_block(_volume(spark, sf_dir), _grid(spark, sf_dir))
