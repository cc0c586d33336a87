"""TIFF and zarr files: what is written is read again, whatever the layout; headers hold what was said."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.sources import chunks, ngff, tiff


@pytest.mark.parametrize("compression", ["", "lzw", "deflate"])
@pytest.mark.parametrize("dtype", ["uint8", "int16", "uint16", "float32", "float64"])
def test_tiff_round_trip(tmp_path, compression, dtype):
    r = np.random.default_rng(3)
    planes = (r.normal(size=(2, 45, 70)) * 50 + 100).astype(dtype)
    data = tiff.encoded([tiff.pyramid(p, 2) for p in planes], tiff.metadata((2, 45, 70), dtype, {"x": 0.25}), (0.25, 0.25), 16, compression)
    (tmp_path / "a.ome.tif").write_bytes(data)
    assert (tiff.load(str(tmp_path / "a.ome.tif")) == planes).all()
    rows = tiff.header_rows(str(tmp_path / "a.ome.tif"))
    assert [(x["page"], x["level"], x["height"], x["width"]) for x in rows] == [(p, k, 45 >> k, 70 >> k) for p in range(2) for k in range(3)]
    assert rows[0]["dtype"] == dtype and dict(rows[0]["pixel"]) == {"x": 0.25}


def test_lzw_of_long_and_plain_data():
    r = np.random.default_rng(1)
    for data in (b"", b"a", b"ab" * 40_000, r.integers(0, 256, 30_000, np.uint8).tobytes(), bytes(100_000)):
        assert tiff._unlzw(tiff._lzw(data)) == data


def test_tiff_of_other_order_and_differences(tmp_path):
    image = (np.arange(24).reshape(4, 6) * 300).astype(">u2")
    diff = image.copy()
    diff[:, 1:] -= image[:, :-1]
    data = zlib.compress(diff.tobytes())
    tags = [(256, 3, 6), (257, 3, 4), (258, 3, 16), (259, 3, 8), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 4), (279, 4, len(data)), (317, 3, 2)]
    body = b"MM" + struct.pack(">HI", 42, 8 + len(data) + len(data) % 2) + data + b"\0" * (len(data) % 2)
    body += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags) + b"\0\0\0\0"
    (tmp_path / "b.tif").write_bytes(body)
    assert (tiff.load(str(tmp_path / "b.tif"))[0] == image).all()
    with pytest.raises(ValueError):
        tiff.directories(open(__file__, "rb"))


def test_ome_metadata(tmp_path):
    text = tiff.metadata((1, 4, 6), "uint16", {"x": 0.5, "y": 0.25}, {"x": 10.0, "y": -3.5, "z": 2.0}, 30.0, [{"label": "red", "color": -16776961}])
    got = tiff.ome(text)
    assert (got["pixel"], got["position"], got["rotation"]) == ({"x": 0.5, "y": 0.25}, {"x": 10.0, "y": -3.5, "z": 2.0}, 30.0)
    assert got["channels"] == [{"label": "red", "color": -16776961}]
    radians = text.replace("Angle: 30.0 degrees", "Angle: 1.5707963267948966 rad").replace('PositionXUnit="µm"', 'PositionXUnit="mm"')
    assert tiff.ome(radians)["rotation"] == pytest.approx(90) and tiff.ome(radians)["position"]["x"] == 10_000
    companion = '<OME xmlns="o"><Image><Pixels SizeX="6" PhysicalSizeX="2.0" PhysicalSizeXUnit="nm"><TiffData><UUID>urn:1</UUID></TiffData></Pixels></Image><Image><Pixels PhysicalSizeX="3.0"><TiffData><UUID>urn:2</UUID></TiffData></Pixels></Image></OME>'
    (tmp_path / "all.companion.ome").write_text(companion)
    only = '<OME xmlns="o" UUID="urn:2"><BinaryOnly MetadataFile="all.companion.ome" UUID="urn:0"/></OME>'
    (tmp_path / "c.ome.tif").write_bytes(tiff.encoded([[np.zeros((4, 6), np.uint8)]], only))
    assert dict(tiff.header_rows(str(tmp_path / "c.ome.tif"))[0]["pixel"]) == {"x": 3.0}


def test_tiff_with_spark(spark, tmp_path):
    r = np.random.default_rng(5)
    images = {f"{tmp_path}/i{k}.tif": r.integers(0, 60_000, (1 + k, 20 + k, 33)) for k in range(3)}
    rows = [(path, *map(int, at), float(image[at])) for path, image in images.items() for at in np.ndindex(image.shape)]
    df = spark.createDataFrame(rows, "path string, c int, y int, x int, value double").withColumns({"px": F.lit(0.5), "x0": F.lit(4.0), "y0": F.lit(-2.0)})
    assert tiff.save(df, "uint16", levels=1, tile=8).count() == 3
    header = tiff.headers(spark.createDataFrame([(p,) for p in images], "path string"))
    assert {(h.page, h.level) for h in header.collect()} == {(p, k) for p in range(3) for k in range(2)}
    first = header.where("page = 0 AND level = 0").first()
    assert first.pixel == {"x": 0.5, "y": 0.5} and first.position == {"x": 4.0, "y": -2.0} and first.tags["ImageWidth"] == "33"
    got = {(p.path, p.page, p.y, p.x): p.value for p in tiff.pixels(tiff.segments(header)).collect()}
    assert got == {(path, c, y, x): v for path, c, y, x, v in rows}
    assert tiff.pixels(tiff.segments(header, -1)).where("level = 1").count() == sum(i.shape[0] * (i.shape[1] // 2) * 16 for i in images.values())


def test_crc32c_and_blosc():
    assert chunks.crc32c(b"123456789") == 0xE3069283 and chunks.crc32c(b"") == 0
    r = np.random.default_rng(4)
    for n in (1, 7, 1000, 70_001):
        data = r.integers(0, 256, n, np.uint8).tobytes()
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (0x82F63B78 if crc & 1 else 0)
        assert chunks.crc32c(data) == crc ^ 0xFFFFFFFF
    import pyarrow as pa

    plain = np.arange(3000, dtype="<u4").tobytes()
    shuffled = np.frombuffer(plain, np.uint8).reshape(-1, 4).T.tobytes()
    blocks, size = [], 8000
    for a in range(0, len(plain), size):
        own = np.frombuffer(plain[a : a + size], np.uint8).reshape(-1, 4).T.tobytes()
        packed = pa.Codec("lz4_raw").compress(own).to_pybytes()
        blocks.append(struct.pack("<i", len(packed)) + packed)
    starts = np.cumsum([16 + 4 * len(blocks), *(len(b) for b in blocks)])
    body = struct.pack(f"<{len(blocks)}i", *starts[:-1]) + b"".join(blocks)
    head = struct.pack("<BBBBiii", 2, 1, 0x01 | 0x10 | 1 << 5, 4, len(plain), size, 16 + len(body))
    assert chunks.unblosc(head + body) == plain
    assert chunks.unblosc(struct.pack("<BBBBiii", 2, 1, 0x02, 4, len(shuffled), size, 16 + len(shuffled)) + shuffled) == shuffled


@pytest.mark.parametrize("compressor", [None, {"id": "zlib", "level": 1}, {"id": "zstd"}, {"id": "gzip"}])
def test_zarr_version_2(spark, tmp_path, compressor):
    import gzip
    import json

    import zstandard

    image = np.random.default_rng(6).integers(0, 900, (5, 9)).astype(">i2")
    folder = tmp_path / "a.zarr" / "0"
    folder.mkdir(parents=True)
    (folder / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [5, 9], "chunks": [3, 4], "dtype": ">i2", "compressor": compressor, "fill_value": 7, "order": "C", "filters": None, "dimension_separator": "."}))
    pack = {None: lambda b: b, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress, "gzip": gzip.compress}[compressor and compressor["id"]]
    for cy in range(2):
        for cx in range(3):
            if (cy, cx) != (1, 2):  # one that is not stored
                block = np.zeros((3, 4), ">i2")
                part = image[cy * 3 : cy * 3 + 3, cx * 4 : cx * 4 + 4]
                block[: part.shape[0], : part.shape[1]] = part
                (folder / f"{cy}.{cx}").write_bytes(pack(block.tobytes()))
    image[3:, 8:] = 7
    got = {(p.y, p.x): p.value for p in chunks.pixels(chunks.chunks(spark, str(tmp_path))).collect()}
    assert got == {(y, x): float(image[y, x]) for y in range(5) for x in range(9)}


def test_zarr_shards(spark, tmp_path):
    import json

    import zstandard

    image = np.random.default_rng(7).integers(0, 9000, (6, 10)).astype("<u2")
    folder = tmp_path / "s.zarr"
    folder.mkdir()
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 0}}, {"name": "crc32c"}]
    index = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "crc32c"}]
    sharding = {"name": "sharding_indexed", "configuration": {"chunk_shape": [3, 2], "codecs": inner, "index_codecs": index, "index_location": "end"}}
    meta = {"zarr_format": 3, "node_type": "array", "shape": [6, 10], "data_type": "uint16", "fill_value": 3, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [6, 4]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [sharding]}
    (folder / "zarr.json").write_text(json.dumps(meta))
    for cx in range(3):
        whole = np.full((6, 4), 3, "<u2")
        whole[:, : min(4, 10 - 4 * cx)] = image[:, 4 * cx : 4 * cx + 4]
        out, places = b"", []
        for y in (0, 3):
            for x in (0, 2):
                if (cx, y, x) == (0, 3, 2):
                    places += [(1 << 64) - 1] * 2
                    continue
                data = zstandard.ZstdCompressor().compress(np.ascontiguousarray(whole[y : y + 3, x : x + 2]).tobytes())
                data += struct.pack("<I", chunks.crc32c(data))
                places += [len(out), len(data)]
                out += data
        table = struct.pack(f"<{len(places)}Q", *places)
        (folder / "c" / "0").mkdir(parents=True, exist_ok=True)
        (folder / "c" / "0" / str(cx)).write_bytes(out + table + struct.pack("<I", chunks.crc32c(table)))
    image[3:, 2:4] = 3
    got = {(p.y, p.x): p.value for p in chunks.pixels(chunks.chunks(spark, str(folder))).collect()}
    assert got == {(y, x): float(image[y, x]) for y in range(6) for x in range(10)}
    raw = bytearray((folder / "c" / "0" / "1").read_bytes())
    raw[2] ^= 1
    (folder / "c" / "0" / "1").write_bytes(raw)
    with pytest.raises(Exception, match="checksum"):
        chunks.pixels(chunks.chunks(spark, str(folder))).count()


@pytest.mark.parametrize("version", ["0.4", "0.5"])
def test_pyramid_of_chunks(spark, tmp_path, version):
    image = np.random.default_rng(8).integers(0, 60_000, (2, 20, 12))
    path = f"file://{tmp_path}/p.ome.zarr"
    df = spark.createDataFrame([(path, *map(int, at), float(image[at])) for at in np.ndindex(image.shape)], "array string, c long, y long, x long, value double").withColumn("z", F.lit(0).cast("long"))
    channels = [{"label": "a", "color": "FF0000"}, {"label": "b", "color": "00FF00"}]
    chunks.save_pyramid(spark, df, [2, 1, 20, 12], [1, 1, 8, 8], "uint16", levels=3, pixel={"x": 0.5, "y": 0.5}, at={"x": 3.0}, channels=channels, version=version)
    found = ngff.images(spark, str(tmp_path)).first()
    assert (found.label, found.dims, found.version) == ("p", ["c", "z", "y", "x"], version) and [c.label for c in found.channels] == ["a", "b"]
    assert [list(x.scale) for x in found.levels] == [[1, 1, 0.5 * f, 0.5 * f] for f in (1, 2, 4)] and list(found.levels[1].translation) == [0, 0, 0.25, 3.25]
    for k in range(3):
        got = {(p.c, p.y, p.x): p.value for p in chunks.pixels(chunks.chunks(spark, str(tmp_path), level=k)).collect()}
        f = 1 << k
        means = image.reshape(2, 20 // f, f, 12 // f, f).mean(axis=(2, 4))
        assert set(got) == set(np.ndindex(means.shape)) and all(abs(got[p] - means[p]) <= 1 for p in got)
