import struct
import zlib

import numpy as np
import pytest

from voxelloom.operators import matching as M
from voxelloom.sources import arrays as A
from voxelloom.sources import files
from voxelloom.streaming import overlaps


@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "int32", "float32", "float64"])
def test_tiff_and_npy_round_trip(dtype):
    a = (np.random.default_rng(0).random((3, 5, 7)) * 100).astype(dtype)
    for back in (A.read_tiff(A.write_tiff(a)), A.read_npy(A.write_npy(a)), A.read_array("x", A.write_tiff(a)), A.read_array("x", A.write_npy(a))):
        assert back.dtype == a.dtype and (back == a).all()
    assert (A.read_tiff(A.write_tiff(a[0])) == a[0]).all()


def test_big_endian_compressed_tiles():
    a = np.arange(6 * 10, dtype=">u2").reshape(6, 10)
    blocks = []
    for y in (0, 4):
        for x in (0, 8):
            b = np.zeros((4, 8), ">u2")
            part = a[y : y + 4, x : x + 8]
            b[: part.shape[0], : part.shape[1]] = part
            blocks.append(zlib.compress(b.tobytes()))
    n = len(blocks)
    body = b"".join(blocks)
    offsets = [8 + sum(map(len, blocks[:k])) for k in range(n)]
    table = 8 + len(body)
    lists = table + 2 + 9 * 12 + 4
    tags = [(256, 4, 1, 10), (257, 4, 1, 6), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (322, 4, 1, 8), (323, 4, 1, 4), (324, 4, n, lists), (325, 4, n, lists + 4 * n), (339, 3, 1, 1 << 16)]
    data = struct.pack(">2sHI", b"MM", 42, table) + body + struct.pack(">H", 9) + b"".join(struct.pack(">HHII", *t) for t in tags) + struct.pack(">I", 0)
    data += struct.pack(f">{n}I", *offsets) + struct.pack(f">{n}I", *map(len, blocks))
    assert (A.read_tiff(data) == a).all()


def test_damage_is_an_error():
    for bad in (b"", b"II*", b"nonsense", b"MM\x00*\x00\x00\x00\x00"):
        with pytest.raises((ValueError, struct.error)):
            A.read_array("x", bad)
    with pytest.raises(ValueError):
        A.read_array("x", A.write_npy(np.zeros(3)), ".tif")
    assert A._unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])


def test_folder_to_voxels_and_back(spark, tmp_path):
    a, b = np.arange(24.0).reshape(2, 3, 4), np.eye(3)
    (tmp_path / "1img.tif").write_bytes(A.write_tiff(a.astype("float32")))
    (tmp_path / "label2.npy").write_bytes(A.write_npy(b * 2.7))
    (tmp_path / "notes.txt").write_text("x")
    listed = {r.name: (r.number, r.role) for r in files.listing(spark, str(tmp_path)).collect()}
    assert listed == {"1img.tif": (1, "image"), "label2.npy": (2, "label")}
    v = files.read_voxels(spark, str(tmp_path))
    assert v.filter("volume_id = '1img'").selectExpr("sum(value)").first()[0] == a.sum() and v.count() == 33
    assert {r.value for r in files.read_voxels(spark, str(tmp_path), (".npy",), True).collect()} == {0.0, 2.0}
    out = files.write_volumes(v, str(tmp_path / "out"), suffix=".tif").collect()
    assert sorted(r.n_instances for r in out) == [1, 23]
    back = A.read_tiff((tmp_path / "out" / "1img.tif").read_bytes())
    assert (back == a).all()
    blocks = files.to_blocks(v, 2)
    assert sorted(map(tuple, files.from_blocks(blocks).collect())) == sorted(map(tuple, v.collect()))
    with pytest.raises(ValueError):
        files.require_pairs(files.listing(spark, str(tmp_path)).filter("role = 'image'"))


def test_running_overlap_of_a_stream(spark, tmp_path):
    rows = [(k % 5, k % 5 if k % 7 else 0) for k in range(200)]
    frame = spark.createDataFrame(rows, "t int, p int")
    frame.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = overlaps.start_scores(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, M.match(frame, [0.6, 0.7, 0.8, 0.9]).collect()))


def test_training_folder(spark, tmp_path):
    rng = np.random.default_rng(2)
    images = {n: rng.random((2, 3, 4)).astype("float32") for n in (1, 2, 10)}
    for n, a in images.items():
        (tmp_path / f"{n}img.tif").write_bytes(A.write_tiff(a))
        (tmp_path / f"{n}heat_mask.npy").write_bytes(A.write_npy(a * 9 - 4))
    (tmp_path / "1integer.tif").write_bytes(A.write_tiff((images[1] * 5).astype("int32")))
    (tmp_path / "10integer_b.npy").write_bytes(A.write_npy((images[10] * 5).astype("int32")))
    (tmp_path / "10integer_a.npy").write_bytes(A.write_npy((images[10] * 7).astype("int32")))
    files.write_factors(spark, str(tmp_path), [1, 2.005, 0.3333])
    voxels, pairs, factors = files.read_training(spark, str(tmp_path))
    assert {(r.number, r.image, r.label, r.integer) for r in pairs.collect()} == {(1, "1img.tif", "1heat_mask.npy", "1integer.tif"), (2, "2img.tif", "2heat_mask.npy", None), (10, "10img.tif", "10heat_mask.npy", "10integer_a.npy")}
    got = {(r.number, r.z, r.y, r.x): r for r in voxels.collect()}
    assert len(got) == 72
    for (n, *p), r in got.items():
        v = images[n][tuple(p)]
        assert r.image == pytest.approx(float(v)) and r.heat == np.trunc(v * 9 - 4)
        assert r.integer == {1: int(v * 5), 2: None, 10: int(v * 7)}[n]
    assert factors.first().factors == [1.0, 2.0, 0.33]
    plain = files.read_training(spark, str(tmp_path), label_to_int=False)[0]
    assert any(r.heat != int(r.heat) for r in plain.collect())
    a, b = files.read_both(spark, str(tmp_path), str(tmp_path))
    assert a.count() == b.count() == 72
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        files.read_training(spark, str(tmp_path / "empty"))


def test_other_sinks(spark, tmp_path):
    v = spark.createDataFrame([("a", 0, 0, x, float(x), x % 3) for x in range(5)], "volume_id string, z int, y int, x int, value double, label int")
    root = str(tmp_path / "out")
    row = files.write_predicted(v, root, "2020-01-02_03-04-05").first()
    assert row.n_instances == 2 and row.file.endswith("/preds/a_labels_predicted_2020-01-02_03-04-05.tif")
    assert files.write_predicted(v, root).first().file != row.file
    steps = [t.first().file for t in files.write_steps(root, v, v)]
    assert [s.rsplit("/", 1)[-1] for s in steps] == ["a_input_image_preprocessed.tif", "a_inference_output.tif"]
    files.write_losses(spark.createDataFrame([(2, "train", 0.5), (1, "train", 0.75), (1, "val", 0.9)], "step int, part string, loss double"), root)
    assert (tmp_path / "out" / "train_losses.txt").read_text() == "0.75\n0.5\n" and (tmp_path / "out" / "val_losses.txt").read_text() == "0.9\n"
