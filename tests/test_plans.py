"""Settings, timing, files of jobs, crates, video, and an operation from image files to a stitched store."""

import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftwork.operators import kernels, labels, matching
from weftwork.plans import pipeline, settings, timing
from weftwork.sources import chunks, crate, files, source, tiff, video
from weftwork.streaming import arrivals


def test_settings(tmp_path):
    base = settings.defaults(settings.template())
    assert base["registration"]["method"] == "phase" and "input" not in base["input_output"]
    mine = settings.updated(base, {"registration": {"method": "peaks"}, "more": {"a": 1}})
    assert mine["registration"]["method"] == "peaks" and base["registration"]["method"] == "phase" and mine["more"] == {"a": 1}
    settings.write(str(tmp_path / "s.yml"), settings.native({"a": np.float64(1.5), "b": (np.arange(2), None), "c": {"d": np.int64(3)}}))
    assert settings.read(str(tmp_path / "s.yml")) == {"a": 1.5, "b": [[0, 1], None], "c": {"d": 3}}
    (tmp_path / "bad.yml").write_text("a: !!python/object/apply:os.getcwd []")
    with pytest.raises(Exception):
        settings.read(str(tmp_path / "bad.yml"))
    by = settings.sections([{"name": "b", "type": "Float", "section_id": "s", "cli_order": 2}, {"name": "a", "type": "float", "section_id": "s", "cli_order": ""}])
    assert [i["name"] for i in by["s"]] == ["a", "b"] and by["s"][1]["type"] == "float"
    form = settings.form_field(settings.TEMPLATE["fusion"][0], "fusion", {"fusion": "max"})
    assert (form["entry"], form["value"], form["choices"]["sum"]) == ("menu", "max", "sum")
    assert settings.choices({"a": "A"})["key"]("a") == "A" and settings.choices([1]) == [1] and settings.path_of("x") == {"path": "x"}
    with pytest.raises(ValueError):
        settings.form_field({"name": "a", "type": "unheard"}, "s", {})


def test_timing(tmp_path, spark):
    assert timing.line("a", 3.21, 1) == "Time a: 3.2 (1.0) seconds" and timing.line("a", 90, 30) == "Time a: 1.5 (0.5) minutes" and timing.line("a", 7200, 0) == "Time a: 2.0 (0.0) hours"
    timing.start_log(str(tmp_path / "log" / "x.log"))
    with timing.Timer("fuse image") as timer:
        pass
    logging.shutdown()
    text = (tmp_path / "log" / "x.log").read_text()
    assert timer.line in text
    stats = files.log_statistics(spark.createDataFrame([(x,) for x in (text.strip(), "x Time fuse image: 2.0 (1) minutes", "no time")], "value string")).first()
    assert (stats.keyword, stats.n) == ("fuse image", 2) and stats.total == pytest.approx(120, abs=1)


def test_crates(spark, tmp_path):
    whole = json.loads(crate.folder(["a.ome.zarr"], "settings.yml"))
    assert {"@id": "a.ome.zarr/"} in whole["@graph"][1]["hasPart"] and whole["@graph"][-1]["@type"] == "image_acquisition"
    assert crate.acquisition(properties={"@type": "other"})["@type"] == ["other", "image_acquisition"]
    crate.write(spark, str(tmp_path), crate.store("a"))
    assert json.loads((tmp_path / "ro-crate-metadata.json").read_text())["@graph"][1]["resultOf"] == {"@id": "#acquisition-001"}


def test_video(spark, tmp_path):
    frames = spark.createDataFrame([(f, y, x, (f + y + x) / 10) for f in range(3) for y in range(4) for x in range(5)], "frame int, y int, x int, value double")
    assert video.from_frames(frames, str(tmp_path / "v.y4m"), fps=2) == 3
    got = list(video.read(str(tmp_path / "v.y4m")))
    assert len(got) == 3 and got[2].shape == (4, 5) and got[2][3, 4] == round(0.9 * 255)
    assert video.fitted(np.ones((2, 6)), 4, 3).tolist() == [[0] * 3, [1] * 3, [1] * 3, [0] * 3]
    with video.Video(str(tmp_path / "w.y4m"), scale=0.5) as out:
        out.write(np.full((4, 6), 300.0))
    assert next(iter(video.read(str(tmp_path / "w.y4m")))).tolist() == [[255] * 3] * 2
    assert video.from_frames(frames.limit(0), str(tmp_path / "none.y4m")) == 0


def test_file_tables(spark, tmp_path):
    for name in ("S2_b10.tif", "S2_b9.tif", "S1_b1.tif", "none.tif"):
        (tmp_path / name).write_bytes(b"x")
    found = files.listing(spark, str(tmp_path), "*.tif")
    assert [r.path.rsplit("/", 1)[1] for r in found.where(F.col("path").contains("S2")).collect()] == ["S2_b9.tif", "S2_b10.tif"]
    assert {(r.fileset, r.path.rsplit("/", 1)[1]) for r in files.filesets(found, "S").collect()} == {(2, "S2_b10.tif"), (2, "S2_b9.tif"), (1, "S1_b1.tif")}
    assert {r.fileset for r in files.filesets(found.where(F.col("path").contains("none")), "S").collect()} == {0}
    assert files.listed(spark, [f"{tmp_path}/S*.tif"]).count() == 3
    (tmp_path / "m.json").write_text('[{"label": "a", "x": 1.5},\n {"label": "b", "x": 2.5}]')
    assert sorted(r.x for r in files.read_metadata(spark, "m.json", ["x"], f"{tmp_path}/in.tif").collect()) == [1.5, 2.5]
    with pytest.raises(ValueError):
        files.read_metadata(spark, "m.txt")
    (tmp_path / "o.ome.zarr").mkdir()
    assert not files.output_exists(spark, f"{tmp_path}/o", "ome.zarr")
    (tmp_path / "o.ome.zarr" / "zarr.json").write_text("{}")
    assert files.output_exists(spark, f"{tmp_path}/o", "ome.zarr") and not files.output_exists(spark, f"{tmp_path}/o", ".ome.zarr, .ome.tiff")
    with pytest.raises(Exception, match="unknown image format"):
        source.described(spark, spark.createDataFrame([("a.png",)], "path string")).collect()


def test_file_labels(spark):
    def of(*paths):
        rows = spark.createDataFrame([(0, k, p) for k, p in enumerate(paths)], "fileset int, file long, path string")
        return [r.label for r in labels.file_labels(rows).orderBy("file").collect()]

    assert of("a/S000_001_000.ome.zarr", "a/S000_000_001.ome.zarr", "a/S000_000_000.ome.zarr") == ["001_000", "000_001", "000_000"]
    assert of("r1/t_5.tif", "r2/t_5.tif") == ["r1", "r2"]
    assert of("a/x.tif", "a/y.tif") == ["x", "y"] and of("a/x3.tif") == [""]  # nothing to tell apart


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:04:59", "a", 2.0), ("2024-01-01 00:05:00", "a", 4.0)]
    spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/in")
    query = arrivals.windowed_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.n, r.total) for r in spark.table("counted").collect()) == [(1, 4.0), (2, 3.0)]


def test_match_metrics(spark):
    fixed = spark.createDataFrame([(0, k, [float(x), float(y)]) for k, (x, y) in enumerate(((0, 0), (0, 10), (10, 0)))], "set int, idx long, vector array<double>")
    moving = spark.createDataFrame([(0, k, [float(x), float(y)]) for k, (x, y) in enumerate(((10, 1), (0, 1), (40, 40), (0, 11)))], "set int, idx long, vector array<double>")
    found = matching.match_assign(fixed, moving, "set", 5.0)
    sizes = spark.createDataFrame([(0, 3, 4), (1, 2, 2)], "set int, n1 int, n2 int")
    got = {r.set: r for r in matching.match_metrics(found, sizes, "set", 5.0).collect()}
    assert (got[0].n_matches, got[0].match_rate, got[0].distance, got[0].norm_distance) == (3, 1.0, 1.0, 0.2)
    assert (got[1].n_matches, got[1].distance) == (0, float("inf"))


def test_operation_from_files_to_store(spark, tmp_path):
    scene = kernels.gaussian(np.random.default_rng(9).random((68, 68)), 0.7) * 1000
    for s in range(2):
        for r in range(2):
            for c in range(2):
                image = (scene if s == 0 else scene.T)[28 * r : 28 * r + 40, 28 * c : 28 * c + 40].astype(np.float32)
                (tmp_path / f"S{s:03d}_{r:03d}_{c:03d}.ome.tif").write_bytes(tiff.encoded([[image]], tiff.metadata((1, 40, 40), "float32", {"x": 0.5, "y": 0.5}), None, 16))
    at = {"position": {"y": "fn[-2] * 13", "x": "fn[-1] * 14.5"}}
    operation = {"operation": "register match S", "input": {"path": f"{tmp_path}/S*.ome.tif", "source_metadata": at}, "registration": {"method": "peaks", "overlap_threshold": 0.1}, "fusion": {"fusion": "mean", "chunk_size": 32}, "output": f"{tmp_path}/out", "n_set_workers": 2}
    bad = {"operation": "register", "input": f"{tmp_path}/none*.tif", "output": f"{tmp_path}/out2"}
    settings.write(str(tmp_path / "p.yml"), {"general": {"break_on_error": False}, "operations": [operation, bad]})
    done = pipeline.run(spark, settings.read(str(tmp_path / "p.yml")))
    assert done == {"0 register match S/0": "done", "0 register match S/1": "done"}
    for s in range(2):
        folder = f"{tmp_path}/out/{s}/registered.ome.zarr"
        got = {(p.y, p.x): p.value for p in chunks.pixels(chunks.chunks(spark, folder, 0)).collect()}
        want = scene if s == 0 else scene.T
        inner = [(y, x) for y in range(6, 60) for x in range(6, 60)]
        assert np.mean([abs(got[p] - want[p]) for p in inner]) < 0.1 * want.std()
        assert json.loads(open(f"{folder}/ro-crate-metadata.json").read())["@graph"][1]["name"] == "registered"
    assert pipeline.match_label("register match S") == (True, "S") and pipeline.match_label("register match") == (True, None) and pipeline.match_label("stack") == (False, None)


def test_intensity_registration():
    scene = kernels.gaussian(np.random.default_rng(11).random((60, 60)), 1.5)
    moving = kernels.turned(scene, 5.0, 1.5, -2.0)
    degrees, dy, dx, quality = kernels.intensity(scene[8:52, 8:52], np.nan_to_num(moving, nan=scene.mean())[8:52, 8:52])
    assert degrees == pytest.approx(-5, abs=0.7) and quality > 0.9


def test_volume_points_and_thresholds():
    z, y, x = np.indices((13, 14, 25))
    volume = sum((np.sqrt((z - c) ** 2 + (y - b) ** 2 + (x - a) ** 2) <= 2).astype(float) for c, b, a in ((6, 5, 5), (6, 7, 18)))
    assert sorted(map(tuple, kernels.volume_points(volume, 1, 3, 5, 0.2))) == [(6, 5, 5), (6, 7, 18)]
    image = np.zeros((32, 48))
    image[4:8, 5:9], image[20:24, 30:34] = 255, 200
    assert sorted(map(tuple, kernels.points_by_thresholds(image))) == [(5.5, 6.5), (21.5, 31.5)]
    flat = np.array([[0, 0, 1.0], [2, 0, 1], [2, 3, 1], [0, 3, 1]])
    assert np.prod([np.linalg.norm(kernels.oriented_box_3d(flat)[0] - kernels.oriented_box_3d(flat)[k]) for k in (1, 3, 4)]) == pytest.approx(0, abs=1e-9)
