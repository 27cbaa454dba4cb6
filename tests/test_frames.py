"""Images, features, the network, scoring, sources and plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewell.functions import scalars
from framewell.operators import features, images, mlp, pixels, scoring
from framewell.plans import tools
from framewell.sources import frames as frame_sources
from framewell.sources import marked_file, model_file

RNG = np.random.default_rng(8)


def make_frames(spark, n, w, h, video="v", skip=(), seed=1):
    rng = np.random.default_rng(seed)
    data = [None if i in skip else rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for i in range(n)]
    rows = [(video, i, 40.0 * i, w, h, None if d is None else bytearray(d.tobytes())) for i, d in enumerate(data)]
    return spark.createDataFrame(rows, images.FRAMES), data


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()[0]


def test_scalars(spark):
    code = lambda ms: one(spark, scalars.timecode(F.lit(float(ms))))
    assert [code(x) for x in (59999, 61500, 3661500)] == ["00:00:59:0999", "00:01:01:60500", "01:01:3601:60500"]
    assert one(spark, scalars.timecode(F.lit(3661500.0), corrected=True)) == "01:01:01:0500"
    assert one(spark, scalars.fourcc(F.lit(1196444237))) == "MJPG"
    assert one(spark, scalars.input_list(F.lit(" a.avi,\tb.avi ,c"))) == ["a.avi", "b.avi", "c"]
    assert one(spark, scalars.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, scalars.lerp(F.lit(10), F.lit(21), F.lit(0.5))) == 15
    assert one(spark, scalars.sigmoid(F.lit(0.0))) == 0.5 and one(spark, scalars.sigmoid_slope(F.lit(0.5))) == 0.25


def test_rotations(spark):
    image = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    turned = image
    for _ in range(4):
        turned = images.rotate(turned, 90)
    assert (turned == image).all()
    assert (images.rotate(image, 90)[2, 1] == image[5 - 1 - 1, 2]).all()  # out(x, y) = in(y, H - 1 - x)
    p = spark.createDataFrame([("v", 0, x, y, *map(int, image[y, x])) for y in range(5) for x in range(7)], "video_id string, fn bigint, x int, y int, b int, g int, r int")
    for angle in (0, 90, 180, 270):
        out = images.rotate(image, angle)
        for r in pixels.rotate(p, angle, 7, 5).collect():
            assert tuple(out[r["y"], r["x"]]) == (r["b"], r["g"], r["r"])
    with pytest.raises(ValueError):
        images.rotate(image, 45)


@pytest.mark.parametrize("alpha", [-1.0, 0.0, 0.5, 2.0])
def test_both_grains_agree(spark, alpha):
    image = RNG.integers(0, 256, (24, 24, 3), dtype=np.uint8)
    p = spark.createDataFrame([("v", 0, x, y, *map(int, image[y, x])) for y in range(24) for x in range(24)], "video_id string, fn bigint, x int, y int, b int, g int, r int")
    out = images.undistort(image, alpha, 1.1, 0.02, 0.9)
    rows = pixels.remap(p, pixels.undistort_lut(spark, 24, 24, alpha), 24, 24, 1.1, 0.02, 0.9).collect()
    assert len(rows) == 576
    near = [max(abs(int(out[r["y"], r["x"]][k]) - r[c]) for k, c in enumerate("bgr")) <= 1 for r in rows]
    assert sum(near) >= 570  # single precision moves a few pixels at the border
    assert tuple(out[12, 12]) == (0, 0, 0)  # the centre has no source


def test_sizes(spark):
    s = spark.createDataFrame([(1920, 1080, 90), (1920, 1080, 0)], "w int, h int, r int")
    w, h = pixels.working_size(F.col("w"), F.col("h"), F.lit(1.0), F.lit(1.0), F.col("r"))
    assert [tuple(r) for r in s.select(w, h).collect()] == [(1080, 1080), (1920, 1080)]
    assert pixels.crop_box(24, 24, 24, 16) == (0, 4, 24, 16)
    with pytest.raises(ValueError):
        pixels.crop_box(24, 10, 24, 16)


def test_resize_blur_unsharp():
    flat = np.full((20, 30, 3), 77, np.uint8)
    assert (images.resize(flat, 11, 9) == 77).all() and (images.unsharp(flat) == 77).all()
    assert np.allclose(images.blur(flat), 77, atol=1e-3)
    ramp = np.repeat(np.arange(0, 64, 4, dtype=np.uint8)[None, :, None], 4, 0).repeat(3, 2)
    assert images.resize(ramp, 8, 2).shape == (2, 8, 3)
    assert (images.resize(ramp, 8, 2)[0, :, 0] == np.arange(2, 64, 8)).all()
    spot = np.zeros((31, 31, 3), np.uint8)
    spot[15, 15] = 255
    b = images.blur(spot)[:, :, 0]
    assert np.allclose(b, b.T) and np.isclose(b.sum(), 255, rtol=1e-3) and b[15, 5] == 0 < b[15, 6]
    assert images.blur(np.zeros((1, 2, 3), np.uint8)).shape == (1, 2, 3)


def test_undistort_plan(spark):
    a, _ = make_frames(spark, 3, 24, 20, skip=(1,))
    b, _ = make_frames(spark, 2, 24, 20, seed=2)
    out = tools.undistort([a, b], images.Undistort(alpha=0.5)).orderBy("fn").collect()
    assert [(r["fn"], r["width"], r["height"], len(r["data"])) for r in out] == [(i, 24, 20, 24 * 20 * 3) for i in (0, 2, 3, 4)]
    with pytest.raises(ValueError):
        tools.undistort([a], images.Undistort(rotation=45))


def test_interpolate_plan(spark):
    f, data = make_frames(spark, 9, 6, 5)
    m = spark.createDataFrame([("v", 3), ("v", 4)], "video_id string, fn bigint")
    out = tools.interpolate(f, m).orderBy("out_fn").collect()
    assert [r["kind"] for r in out] == ["copy"] * 3 + ["blend"] * 3 + ["copy"] * 2
    assert bytes(out[3]["data"]) == data[2].tobytes() and bytes(out[6]["data"]) == data[7].tobytes()
    mid = np.clip(data[2].astype(np.float32) * np.float32(0.5) + data[6].astype(np.float32) * np.float32(0.5), 0, 255).astype(np.uint8)
    assert bytes(out[5]["data"]) == mid.tobytes()
    assert images.preview(f, m).count() == 9


def test_interpolate_holds_a_damaged_tail(spark):
    """The marks go beyond the last readable frame; those on readable frames still count."""
    f, data = make_frames(spark, 10, 6, 5, skip=(9,))
    m = spark.createDataFrame([("v", i) for i in (7, 8, 9)], "video_id string, fn bigint")
    out = tools.interpolate(f, m).orderBy("out_fn").collect()
    assert [r["kind"] for r in out] == ["copy"] * 7 + ["hold"] * 2
    assert all(bytes(r["data"]) == data[6].tobytes() for r in out[7:])


def brute_blocks(data, fn):
    """Feature vectors of one frame, pixel by pixel."""
    light = [np.clip(d.astype(np.float32) @ np.array(scalars.LUMA, np.float32) / np.float32(255), None, None) for d in data]
    h, w = light[0].shape
    out = []
    for y in range(4, h - 4, 8):
        for x in range(4, w - 4, 8):
            v = np.zeros(257, np.float32)
            for f in range(4):
                for i in range(8):
                    for j in range(8):
                        v[j + i * 8 + f * 64] = light[max(fn - f, 0)][y - 4 + i, x - 4 + j]
            v[256] = -1
            out.append(v)
    return out


def test_blocks_are_brute_force(spark):
    f, data = make_frames(spark, 5, 25, 17)
    rows = features.blocks_of(features.planes(f)).orderBy("fn", "by", "bx").collect()
    for fn in range(5):
        own = [np.array(r["features"], np.float32) for r in rows if r["fn"] == fn]
        assert len(own) == 3 * 2
        assert np.allclose(own, brute_blocks(data, fn), atol=1e-6)
    sizes = [(1920, 1080), (65, 49), (24, 24), (8, 8)]
    grid = features.block_grid(spark.createDataFrame(sizes, "width int, height int")).groupBy("width").count().collect()
    assert {r["width"]: r["count"] for r in grid} == {1920: 239 * 134, 65: 48, 24: 4}


def test_network():
    m = mlp.Model.init((4, 3, 2), seed=2, dtype=np.float64)
    x, t = RNG.normal(size=4), np.array([0.2, 0.9])
    loss = lambda k: 0.5 * ((t - k.classify(x)) ** 2).sum()
    expected = []
    for layer, w in enumerate(m.weights):  # numerical gradients
        g = np.zeros_like(w)
        for i in np.ndindex(w.shape):
            old = w[i]
            w[i] = old + 1e-6
            up = loss(m)
            w[i] = old - 1e-6
            down = loss(m)
            w[i] = old
            g[i] = (up - down) / 2e-6
        expected.append(w - 0.1 * g)
    m.step(x, t)
    assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(m.weights, expected))
    assert (m.num_layers, m.layer_size(1), m.get(0, 99, 0)) == (3, 3, 0.0)
    m.set(0, 0, 0, 5.0)
    assert m.get(0, 0, 0) == 5.0
    with pytest.raises(ValueError):
        mlp.Model((3, 1))
    with pytest.raises(ValueError):
        m.classify(np.zeros(7))


def test_scores_and_model_file(spark, tmp_path):
    m = mlp.Model.patterned((5, 4, 3, 1))
    d = spark.createDataFrame([(i, [float(x) for x in RNG.normal(size=5)]) for i in range(30)], "fn bigint, features array<float>")
    out = mlp.score(d, m).withColumn("sql", mlp.score_sql(F.col("features"), m)).collect()
    assert all(abs(r["output"] - r["sql"]) < 1e-6 for r in out)
    model_file.save(m, spark, str(tmp_path / "m"))
    back = model_file.load(spark, str(tmp_path / "m"))
    assert back.layer_counts == m.layer_counts and all(np.allclose(a, b, rtol=1e-5) for a, b in zip(back.weights, m.weights))
    assert model_file.dumps(m).split("\n")[:8] == ["nn", "4", "0.1", "1", "5", "4", "3", "1"]
    for bad in ("", "xx 3", "nn 2 0.1 1 2 1", "nn 3 0.1 1 2 2 1 0.5"):
        with pytest.raises(ValueError):
            model_file.loads(bad)
    model_file.write_table(m, spark, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 * 4 + 4 * 3 + 3


def test_classify_and_train(spark):
    f, data = make_frames(spark, 40, 24, 24, skip=(5,))
    m = mlp.Model.init((257, 8, 8, 1), seed=4)
    m.weights[-1] -= m.weights[-1].mean()
    long = mlp.score(features.blocks_of(features.planes(f)), m)
    key = lambda d: sorted((r["fn"], r["blocks"], r["positive"]) for r in d.collect())
    assert key(scoring.frame_scores(long)) == key(scoring.score_frames(f, m))
    marked = {r["fn"] for r in tools.classify(f, m).collect()}
    assert marked == {r["fn"] for r in scoring.frame_scores(long).where("positive > 0").collect()}
    with pytest.raises(ValueError):
        tools.classify(f, None)
    small, _ = make_frames(spark, 3, 8, 8)
    assert tools.classify(small, m).count() == 0
    before = [w.copy() for w in m.weights]
    marks = spark.createDataFrame([("v", i) for i in range(0, 40, 2)], "video_id string, fn bigint")
    tools.train(f, marks, m)
    assert any((a != b).any() for a, b in zip(before, m.weights))


def test_sampling(spark):
    for n, k in ((9, 0), (10, 1), (19, 1), (29, 2), (30, 3), (12345, 1234)):
        f = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("fn"))
        v = spark.createDataFrame([("v", n)], "video_id string, n_frames bigint")
        s = scoring.sample(v, f)
        assert s.count() == s.distinct().count() == k
        trained = {r["fn"] for r in scoring.trained_frames(s, v).collect()}
        assert trained == {r["s"] + 1 for r in s.collect() if r["s"] + 1 < n}


def test_sources(spark, tmp_path):
    f, data = make_frames(spark, 4, 5, 3)
    (tmp_path / "avi").mkdir()
    (tmp_path / "avi" / "a.avi").write_bytes(frame_sources.build_avi([d.tobytes() for d in data], 5, 3, 20.0))
    path = str(tmp_path / "avi")
    rows = frame_sources.read_avi(spark, path).orderBy("fn").collect()
    assert [(r["fn"], r["msec"], bytes(r["data"])) for r in rows] == [(i, 50.0 * i, d.tobytes()) for i, d in enumerate(data)]
    head = frame_sources.read_avi_metadata(spark, path).first()
    assert (head["width"], head["height"], head["fps"], head["declared_frames"]) == (5, 3, 20.0, 4)
    with pytest.raises(ValueError):
        frame_sources.parse_avi(b"RIFFxxxxWAVE")
    (tmp_path / "m.txt").write_text("3 1\n\n 7\t3\n99 -1\n")
    m = marked_file.read(spark, str(tmp_path / "m.txt"), "v", 10)
    assert sorted(r["fn"] for r in m.collect()) == [1, 3, 7]
    marked_file.write(m, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1", "3", "7"]
    frame_sources.write_frames(f, str(tmp_path / "frames"))
    assert spark.read.parquet(str(tmp_path / "frames")).count() == 4
    joined = frame_sources.concat_inputs([f, f.where("fn < 2"), f])
    assert sorted(r["fn"] for r in joined.collect()) == list(range(10))
    assert frame_sources.frame_count(make_frames(spark, 4, 2, 2, skip=(0,))[0]).first()["n_frames"] == 3


def test_image_folder(spark, tmp_path):
    import struct
    import zlib

    def png(r, g, b):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        row = b"\0" + bytes((r, g, b)) * 2
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 1, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(row)) + chunk(b"IEND", b"")

    (tmp_path / "b.png").write_bytes(png(10, 20, 30))
    (tmp_path / "a.png").write_bytes(png(1, 2, 3))
    (tmp_path / "c.png").write_bytes(b"broken")
    rows = frame_sources.read_images(spark, str(tmp_path), "v").orderBy("fn").collect()
    assert [r["fn"] for r in rows] == [0, 1, 2]
    assert bytes(rows[0]["data"]) == bytes((3, 2, 1)) * 2 and bytes(rows[1]["data"]) == bytes((30, 20, 10)) * 2 and rows[2]["data"] is None


def test_avi_sink(spark, tmp_path):
    """Parts, rows of an odd number of bytes, several videos, an unreadable frame; order within files."""
    import os

    f, data = make_frames(spark, 23, 5, 3, "a", skip=(4,))
    g, other = make_frames(spark, 7, 4, 2, "b", seed=2)
    path = str(tmp_path / "out")
    frame_sources.write_avi(f.unionByName(g).repartition(5), path, 20.0, part_bytes=300)
    back = frame_sources.read_avi(spark, path).withColumns({"v": F.regexp_extract("video_id", "video_id=(.)", 1), "part": F.regexp_extract("video_id", r"part=(\d+)", 1).cast("int")})
    rows = back.orderBy("v", "part", "fn").collect()
    assert len({r["part"] for r in rows if r["v"] == "a"}) > 2
    assert [bytes(r["data"]) for r in rows if r["v"] == "a"] == [d.tobytes() for d in data if d is not None]
    assert [bytes(r["data"]) for r in rows if r["v"] == "b"] == [d.tobytes() for d in other]
    heads = frame_sources.read_avi_metadata(spark, path).collect()
    assert sum(r["declared_frames"] for r in heads) == 29 and {r["fps"] for r in heads} == {20.0}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".txt"):
                content = open(os.path.join(folder, name), "rb").read()
                assert int.from_bytes(content[4:8], "little") + 8 == len(content) <= 300 + 400
    with pytest.raises(FileExistsError):
        frame_sources.write_avi(g, path)
    frame_sources.write_avi(g, path, overwrite=True)
    assert frame_sources.read_avi(spark, path).count() == 7
    with pytest.raises(ValueError):
        frame_sources.write_avi(f.unionByName(make_frames(spark, 1, 6, 3, "a")[0]), str(tmp_path / "odd"))


def test_avi_parts_joined(spark, tmp_path):
    """More than ten parts, ids that look like numbers or need escaping or are empty, an unreadable frame left out."""
    f, data = make_frames(spark, 23, 5, 3, "007", skip=(4,))
    g, other = make_frames(spark, 7, 4, 2, "a/b=c d", seed=2)
    h, empty = make_frames(spark, 3, 4, 2, "", seed=3)
    path = str(tmp_path / "out")
    frame_sources.write_avi(f.unionByName(g).unionByName(h).repartition(5), path, 20.0, part_bytes=120)
    assert frame_sources.read_avi(spark, path).where("fn = 0").count() > 13
    rows = frame_sources.read_avi(spark, path, joined=True).orderBy("video_id", "fn").collect()
    for video, held in (("007", [d for d in data if d is not None]), ("a/b=c d", other), ("", empty)):
        assert [(r["fn"], r["msec"], bytes(r["data"])) for r in rows if r["video_id"] == video] == [(i, 50.0 * i, d.tobytes()) for i, d in enumerate(held)]
    assert len(rows) == 32
    heads = frame_sources.read_avi_metadata(spark, path, joined=True).collect()
    assert sorted((r["video_id"], r["width"], r["height"], r["fps"], r["declared_frames"]) for r in heads) == [("", 4, 2, 20.0, 3), ("007", 5, 3, 20.0, 22), ("a/b=c d", 4, 2, 20.0, 7)]


def test_avi_queries_beyond_one_file(spark, monkeypatch):
    """With more than a file's frames the queries still give one video, numbered throughout."""
    from framewell import queries
    from framewell.sources import fixtures

    write = frame_sources.write_avi
    monkeypatch.setattr(frame_sources, "write_avi", lambda frames, path, part_bytes: write(frames, path, part_bytes=9000))
    sf_dir = "/root/testdata/sf0.001"
    assert [tuple(r) for r in queries.avi_metadata(spark, sf_dir).collect()] == [(0, 24, 24, 25.0, 0, 0, 55)]
    expected = fixtures.pixels(spark, sf_dir).drop("video_id")
    found = queries.avi_round_trip(spark, sf_dir)
    assert found.exceptAll(expected).count() == expected.exceptAll(found).count() == 0


def test_other_decoder_and_seek(spark, tmp_path):
    (tmp_path / "x.raw").write_bytes(bytes(range(24)))
    decode = lambda content: ({"width": 2, "height": 1, "fps": 10.0}, (None if i == 6 else content[i : i + 6] for i in range(0, 24, 6)))
    f = frame_sources.read_videos(spark, str(tmp_path / "x.raw"), decode)
    assert [(r["fn"], r["msec"], r["data"] and r["data"][0]) for r in f.orderBy("fn").collect()] == [(0, 0.0, 0), (1, 100.0, None), (2, 200.0, 12), (3, 300.0, 18)]
    assert [r["fn"] for r in frame_sources.seek(f, 2).collect()] == [2]
    assert frame_sources.seek(f, 0, 9, "none").count() == 0


def test_paths_and_files(spark, tmp_path):
    from framewell.sources import paths

    f, data = make_frames(spark, 3, 24, 24)
    one, out = str(tmp_path / "in.avi"), str(tmp_path / "out")
    open(one, "wb").write(frame_sources.build_avi([d.tobytes() for d in data], 24, 24))
    with pytest.raises(FileNotFoundError):
        paths.check(spark, [one, one + "x"])
    with pytest.raises(ValueError):
        paths.check(spark, [one], "file:" + one, overwrite=True)
    tools.undistort_files(spark, f" {one} , {one}", out, images.Undistort(width=16, height=16, alpha=0.5))
    assert frame_sources.read_avi(spark, out).count() == 6
    with pytest.raises(FileExistsError):
        tools.undistort_files(spark, one, out)


def test_another_classifier(spark):
    """Training and scoring take what has step() and classify()."""

    class Mean:
        seen, total = 0, 0.0

        def step(self, x, target):
            self.seen, self.total = self.seen + 1, self.total + float(target[0])

        def classify(self, x):
            return np.full((len(x), 1), self.total / max(self.seen, 1))

    f, _ = make_frames(spark, 30, 24, 24)
    marks = f.select("video_id", "fn")
    learned = tools.train(f, marks, Mean())
    assert learned.seen == 3 * 4 and learned.total == learned.seen
    assert tools.classify(f, learned).count() == 30
    assert tools.classify(f, Mean()).count() == 0


def test_training_is_the_loop(spark):
    d = [(i, [float(x) for x in RNG.normal(size=5)], float(i % 2)) for i in range(50)]
    m, n = (mlp.Model.init((5, 4, 3, 1), seed=2) for _ in range(2))
    mlp.train(m, spark.createDataFrame(d, "fn bigint, features array<float>, label double").repartition(7), ["fn"])
    for _, x, t in d:
        n.step(np.asarray(x, np.float32), np.asarray([t], np.float32))
    assert all((a == b).all() for a, b in zip(m.weights, n.weights))


def test_progress(spark):
    from framewell.operators import progress

    f, _ = make_frames(spark, 9, 2, 2, skip=(3, 5))
    passed, seen = progress.observed(f)
    assert passed.count() == 9
    assert progress.log(seen) == {"frames": 9, "unreadable": 2, "first_fn": 0, "last_fn": 8}
