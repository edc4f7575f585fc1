import json

import numpy as np
import pytest

from voxlake import storage, tools
from voxlake.__main__ import main
from voxlake.plans.subjects import subject, subjects
from voxlake.sources import arrays, codecs, metadata, ome, pyramids
from voxlake.streaming.event_image import event_stream, hourly_image


def grid(spark, n=4):
    return spark.range(n * n * n).selectExpr(f"id div {n * n} as z", f"id div {n} % {n} as y", f"id % {n} as x", "cast(id as double) as v")


def test_cached_is_computed_once(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "a")

    path = f"file://{tmp_path}/stage"
    assert storage.cached(spark, make, path).count() == 5
    assert storage.cached(spark, make, path, partitions=2).count() == 5
    assert len(calls) == 1
    assert storage.stage_state(storage.Files(spark, path)).commit is not None


def test_uncommitted_is_wiped(spark, tmp_path):
    files = storage.Files(spark, f"file://{tmp_path}/stage").make()
    files.write_text("left.txt", "x")
    assert storage.stage_begin(files).commit is None and files.names() == []
    storage.stage_commit(files)
    files.write_text("kept.txt", "x")
    assert storage.stage_begin(files).commit is not None and "kept.txt" in files.names()


def test_cached_without_path_persists(spark):
    df = storage.cached(spark, spark.range(3))
    assert df.is_cached and df.count() == 3
    df.unpersist()


def test_files(spark, tmp_path):
    root = storage.Files(spark, f"file://{tmp_path}/a").make()
    root.write_text("t.txt", "né\n2")
    root.copy_to("t.txt", root["b"].make(), "u.txt")
    assert root["b"].read_text("u.txt") == "né\n2"
    with storage.temporary_folder(spark) as t:
        assert t.exists()
    assert not t.exists()


def test_pyramid_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    v = grid(spark)
    pyramids.write_pyramid(spark, path, v, (4, 4, 4), 2, labels=v.where("v > 60").selectExpr("z", "y", "x", "cast(v as bigint) as lbl"))
    assert pyramids.highest_level(spark, path) == 2
    assert sorted(map(tuple, pyramids.read_level(spark, path).select("z", "y", "x", "v").collect())) == sorted(map(tuple, v.collect()))
    assert pyramids.read_level(spark, path, 1).count() == 4 * 2 * 2
    assert pyramids.read_level(spark, path, 2).count() == 4
    assert pyramids.read_level(spark, f"{path}?slices=[1:3,0,:]").count() == 8
    assert pyramids.read_level(spark, path, label="label").count() == 3
    meta = pyramids.read_metadata(spark, path)
    assert meta["shape"] == [4, 4, 4] and meta["multiscales"][0]["datasets"][2]["coordinateTransformations"][0]["scale"] == [1, 4, 4]


def test_metadata_checks():
    assert [a["name"] for a in metadata.checked_axes(None, 2)] == ["y", "x"]
    assert metadata.default_axes(3) == "zyx"
    for wrong in (
        lambda: metadata.checked_axes(None, 3),
        lambda: metadata.checked_axes("zyx", 2),
        lambda: metadata.checked_axes("yxz"[::-1] + "c", 4),
        lambda: metadata.checked_datasets([], 2),
        lambda: metadata.checked_datasets([{}], 2),
        lambda: metadata.plate_metadata(["A", "A"], ["1"], ["A/1"]),
        lambda: metadata.plate_metadata(["A"], ["1-"], ["A/1-"]),
        lambda: metadata.plate_metadata(["A"], ["1"], []),
        lambda: metadata.plate_metadata(["A"], ["1"], ["B/1"]),
        lambda: metadata.plate_metadata(["A"], ["1"], ["A/1"], [{"id": "x"}]),
        lambda: metadata.well_metadata([{"acquisition": 1}]),
    ):
        with pytest.raises(ValueError):
            wrong()
    plate = metadata.plate_metadata(["A", "B"], ["1"], ["B/1"], [{"id": 0}], 2, "p")["plate"]
    assert plate["wells"][0] == {"path": "B/1", "rowIndex": 1, "columnIndex": 0}
    assert metadata.well_metadata(["0"])["well"]["images"] == [{"path": "0"}]
    assert metadata.label_metadata({1: [0, 0, 0, 255]}, {1: {"kind": "cell"}})["image-label"]["properties"][0]["kind"] == "cell"


@pytest.mark.parametrize("sparse", [True, False])
def test_zarr_source(spark, tmp_path, sparse):
    a = np.zeros((5, 4, 3), "u2")
    a[4, 3, 2], a[0, 1, 0] = 65535, 7
    arrays.write_zarr(a, str(tmp_path / "z"), (2, 3, 3), "0")
    spark.dataSource.register(arrays.ZarrSource)
    df = spark.read.format("zarr2").option("level", "0").option("sparse", str(sparse)).load(str(tmp_path / "z"))
    got = {(r.z, r.y, r.x): r.v for r in df.collect()}
    assert len(got) == (2 if sparse else a.size)
    assert all(a[p] == v for p, v in got.items()) and got[4, 3, 2] == 65535


def test_zarr_zip(spark, tmp_path):
    import zipfile

    a = np.arange(6.0).reshape(2, 3)
    arrays.write_zarr(a, str(tmp_path / "z"), (2, 2))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for f in (tmp_path / "z").iterdir():
            z.write(f, f.name)
    spark.dataSource.register(arrays.ZarrSource)
    assert {(r.y, r.x): r.v for r in spark.read.format("zarr2").load(str(tmp_path / "z.zip")).collect()} == {tuple(p): a[tuple(p)] for p in np.argwhere(a >= 0).tolist()}
    assert arrays.plain_or_zip(str(tmp_path / "none")) is None


def test_zarr_codec_is_refused(tmp_path):
    arrays.write_zarr(np.zeros((2, 2)), str(tmp_path / "z"), (2, 2))
    meta = json.loads((tmp_path / "z/.zarray").read_text())
    (tmp_path / "z/.zarray").write_text(json.dumps(meta | {"compressor": {"id": "lzma"}}))
    with pytest.raises(ValueError):
        arrays.array_metadata(arrays.store_of(str(tmp_path / "z")), "")


@pytest.mark.parametrize("codec", ["lz4", "zstd", "zlib", "snappy"])
@pytest.mark.parametrize("shuffle", [0, 1, 2])
@pytest.mark.parametrize("n", [0, 7, 1000, 70_001])
def test_blosc_round_trip(codec, shuffle, n):
    raw = (np.arange(n) // 7 % 900).astype("<u2").tobytes() + b"x" * (n % 2)
    frame = codecs.blosc_encoded(raw, 2, codec, 3, shuffle, block=1 << 14)
    assert codecs.blosc_decoded(frame) == raw
    assert n < 1000 or len(frame) < len(raw) // 2
    noise = np.random.default_rng(1).bytes(n)
    assert codecs.blosc_decoded(codecs.blosc_encoded(noise, 4, codec, 3, shuffle)) == noise


def test_blosc_frames_by_hand():
    values = np.array([1, 2, 3, 258] * 2, "<u2")
    head = lambda flags, size, block, all_: bytes([2, 1, flags, 2]) + np.array([size, block, all_], "<u4").tobytes()
    # byte shuffle, one stream for each byte of an element, both stored as they are
    low, high = bytes([1, 2, 3, 2] * 2), bytes([0, 0, 0, 1] * 2)
    streams = b"".join(np.array([8], "<i4").tobytes() + s for s in (low, high))
    assert codecs.blosc_decoded(head(0x21, 16, 16, 44) + np.array([20], "<i4").tobytes() + streams) == values.tobytes()
    # the frame is a copy
    assert codecs.blosc_decoded(head(0x22, 16, 16, 32) + values.tobytes()) == values.tobytes()
    # bit shuffle: row k holds bit k of all elements
    rows = bytes(sum(((int(v) >> k) & 1) << i for i, v in enumerate(values)) for k in range(16))
    assert codecs.shuffled(values.tobytes(), 2, True) == rows and codecs.unshuffled(rows, 2, True) == values.tobytes()
    assert codecs.blosc_decoded(head(0x34, 16, 16, 40) + np.array([20, 16], "<i4").tobytes() + rows) == values.tobytes()
    with pytest.raises(ValueError):
        codecs.blosc_decoded(head(0x10, 16, 16, 40) + bytes(24))


@pytest.mark.parametrize("compressor", [None, {"id": "zlib", "level": 1}, {"id": "zstd", "level": 1}, {"id": "lz4"}, {"id": "blosc", "cname": "lz4", "shuffle": 2}])
def test_image_round_trip(spark, tmp_path, compressor):
    path, v = str(tmp_path / "i"), grid(spark, 5)
    files = ome.write_image(spark, path, v, (5, 5, 5), (2, 3, 4), 1, dtype="<u2", options={"compressor": compressor}, labels=v.where("v > 99").selectExpr("z", "y", "x", "cast(v as int) as lbl"), name="n")
    assert files > 3 * 2 * 2
    assert sorted(map(tuple, ome.read_image(spark, path).collect())) == sorted(map(tuple, v.collect()))
    assert ome.read_image(spark, path, 1).count() == 5 * 3 * 3
    assert sorted(r.v for r in ome.read_image(spark, path, label="label", sparse=True).collect()) == list(range(100, 125))
    meta = ome.attributes(path)["multiscales"][0]
    assert meta["name"] == "n" and [d["path"] for d in meta["datasets"]] == ["0", "1"] and ome.attributes(f"{path}/labels") == {"labels": ["label"]}


def test_slices_read_their_chunks_only(spark, tmp_path):
    path, v = str(tmp_path / "i"), grid(spark, 8)
    ome.write_image(spark, path, v, (8, 8, 8), (2, 4, 8), dtype="<u2")
    source = lambda **o: arrays.ZarrSource({"path": path, "level": "0", "chunksPerTask": "1"} | o).reader(None)
    assert len(source().partitions()) == 8 and len(source(slices="[2:4,:,3]").partitions()) == 2 and len(source(slices="[-1,5:,::2]").partitions()) == 1
    assert len(source(slices="[8:,:,:]").partitions()) == 1 and source(slices="[8:,:,:]").partitions()[0].value == []
    got = ome.read_image(spark, f"{path}?slices=[-1,5:,::2]")
    assert sorted(map(tuple, got.collect())) == [(y, x, 7 * 64 + (y + 5) * 8 + 2 * x) for y in range(3) for x in range(4)]
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThan, LessThanOrEqual

    pushed = source(pushdown="true")
    filters = [GreaterThan(("z",), 3), LessThan(("z",), 6), EqualTo(("y",), 1), LessThanOrEqual(("v",), 1.0)]
    assert list(pushed.pushFilters(filters)) == filters and len(pushed.partitions()) == 1
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert ome.read_image(spark, path).where("z = 3 and y > 5").count() == 16
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_image_options(spark, tmp_path):
    assert ome.full_chunks((4, 4), (3, 9, 2)) == (3, 4, 2) and ome.storage_options({"a": 1}, 1) == [{"a": 1}] * 2 and ome.storage_options([{}, {"b": 2}], 1)[1] == {"b": 2}
    for wrong in (lambda: ome.full_chunks((1, 1), (1,)), lambda: ome.storage_options([{}], 1)):
        with pytest.raises(ValueError):
            wrong()
    assert ome.smoke_test(spark, str(tmp_path / "s")) and not (tmp_path / "s").exists()
    with pytest.raises(FileExistsError):
        ome.smoke_test(spark, str(tmp_path))


def test_dice_command(spark, tmp_path, capsys):
    v = grid(spark)
    ome.write_image(spark, str(tmp_path / "a"), v.selectExpr("z", "y", "x", "cast(v > 31 as int) as v"), (4, 4, 4), (4, 4, 4), dtype="|u1")
    b = np.zeros((4, 4, 4))
    b[3] = 1
    np.save(tmp_path / "b.npy", b)
    assert main(["dice", str(tmp_path / "a"), f"file://{tmp_path}/b.npy"], spark) == pytest.approx(2 * 16 / 48)
    assert "0.66" in capsys.readouterr().out


def test_tools(tmp_path):
    import io

    a = np.arange(6).reshape(2, 3)
    assert (tools.loads_numpy(tools.dumps_numpy(a)) == a).all() and tools.ImageFormat["BLOCKS"].value == 2
    assert tools.chunks_of_text(tools.chunks_to_text((2, 3, 4))) == (2, 3, 4)
    assert tools.expected_ndim(True, True) == tools.expected_ndim(False, False) == 3 and tools.ensure_ndim(4, False, True) == 4
    with pytest.raises(ValueError):
        tools.ensure_ndim(3, False, True)
    assert tools.viewer_arguments((2.0, 1.0), (10, 5)) == {"translate": (-4.0, -2.0), "scale": (2.0, 1.0)}
    one, two = io.StringIO(), io.StringIO()
    both = tools.Tee(one, two)
    assert both.write("ab") == 2 and one.getvalue() == two.getvalue() == "ab"
    both.flush()
    (tmp_path / "m").write_bytes(b"mask")
    arrays.copy_mask(str(tmp_path / "m"), [str(tmp_path / "x/1"), str(tmp_path / "2")])
    assert (tmp_path / "x/1").read_bytes() == (tmp_path / "2").read_bytes() == b"mask"
    with pytest.raises(FileExistsError):
        arrays.copy_mask(str(tmp_path / "m"), [str(tmp_path / "2")])
    with pytest.raises(FileNotFoundError):
        arrays.copy_mask(str(tmp_path / "none"), [])


def test_npz(spark, tmp_path):
    a = np.arange(6.0).reshape(1, 2, 3)
    np.savez(tmp_path / "a.npz", probabilities=a, other=a * 0)
    assert sum(r.v for r in arrays.read_npz(spark, f"file://{tmp_path}/*.npz", "probabilities").collect()) == 15


def test_npy(spark, tmp_path):
    a = np.arange(-3.0, 3).reshape(1, 2, 3)
    np.save(tmp_path / "a.npy", a)
    assert sum(r.v for r in arrays.read_npy(spark, f"file://{tmp_path}/*.npy").collect()) == a.sum()
    assert sum(r.v for r in arrays.read_npy(spark, f"file://{tmp_path}/*.npy", binary=True).collect()) == 2
    assert (arrays.first_existing([str(tmp_path / "no.npy"), str(tmp_path / "a.npy")], (1,)) == a).all()
    assert arrays.first_existing([str(tmp_path / "no.npy")], (2,)).tolist() == [0, 0]


@pytest.mark.parametrize("shape", [(5, 4), (3, 2, 3)])
def test_png_round_trip(shape):
    a = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    assert (arrays.decode_png(arrays.encode_png(a)) == a).all()


def test_slices_round_trip(spark, tmp_path):
    v = grid(spark).selectExpr("z", "y", "x", "cast(v as int) as v")
    written = arrays.write_slices(v, str(tmp_path / "s"), (4, 4)).collect()
    assert len(written) == 4 and arrays.slice_name(written[0].path)[0] == "volume"
    back = arrays.recover_volumes(spark, f"file://{tmp_path}/s/*.png")
    assert sorted(tuple(r) for r in back.select("z", "y", "x", "v").collect()) == sorted(map(tuple, v.collect()))


#: Ids, thresholds of a plaque and largest intensities of some specimens.
SPECIMENS = [("o22", 400.0, 1000.0), ("o23", 400.0, 1000.0), ("F1A1Te4Blaze", 3000.0, 7500.0), ("M7A1oldBlaze", 3000.0, 7500.0)]


def test_subjects(spark):
    table = spark.createDataFrame(SPECIMENS, "subject_id string, plaque_threshold double, max_threshold double")
    rows = {r.subject_id: (r.short_id, r.channel) for r in subjects(table).collect()}
    assert rows == {"o22": ("o22", 1), "o23": ("o23", 1), "F1A1Te4Blaze": ("F1A1Te4", 0), "M7A1oldBlaze": ("M7A1", 0)}
    assert subject(table, "o23")["max_threshold"] == 1000.0
    with pytest.raises(KeyError):
        subject(table, "o24")


def test_hourly_image(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1, 2.0), ("2024-01-01 00:50:00", 1, 3.0), ("2024-01-01 05:00:00", 2, 1.0), ("2024-01-01 12:00:00", 2, 1.0)]
    spark.createDataFrame(rows, "ts string, user_id long, value double").selectExpr("cast(ts as timestamp) as ts", "user_id", "value").repartition(1).write.parquet(str(tmp_path / "e"))
    query = hourly_image(event_stream(spark, str(tmp_path / "e"))).writeStream.format("memory").queryName("hourly").outputMode("append").start()
    try:
        query.processAllAvailable()
        got = {(r.y, r.v, r.n) for r in spark.table("hourly").collect()}
    finally:
        query.stop()
    assert (1, 5.0, 2) in got and (2, 1.0, 1) in got and len(got) == 2
