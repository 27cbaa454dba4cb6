"""Run repair against a plain loop, and its laws."""

import random

import pytest
from pyspark.sql import functions as F

from framewell.operators import marks, repair
from framewell.streaming import stateful


def loop(values, marked):
    """The repair, frame by frame: (value, kind) of each output frame."""
    n, out, c = len(values), [], 0
    prev = None
    while c < n:
        if not marked[c]:
            out.append((values[c], "copy"))
            prev = values[c]
            c += 1
            continue
        b = c
        while b + 1 < n and marked[b + 1]:
            b += 1
        if b + 2 < n:
            s, k = values[b + 2], b - c + 1
            p = s if prev is None else prev
            for i in range(k + 1):
                a = i / (k + 2)
                out.append((int(max(0.0, min(255.0, p * (1 - a) + s * a))), "blend"))
            prev = values[c]
            c = b + 3
        else:
            out += [(values[i] if prev is None else prev, "hold") for i in range(c, b + 1)]
            c = b + 1
    return out


def cases(n, seed):
    rng = random.Random(seed)
    out = []
    for v in range(n):
        k = rng.randint(1, 40)
        p = rng.choice([0.0, 0.1, 0.3, 0.6, 1.0])
        out.append((f"v{v}", [rng.randrange(256) for _ in range(k)], [rng.random() < p for _ in range(k)]))
    return out


def tables(spark, videos):
    rows = [(v, i, x, m, len(values)) for v, values, flags in videos for i, (x, m) in enumerate(zip(values, flags))]
    f = spark.createDataFrame(rows, "video_id string, fn bigint, value int, marked boolean, n_frames bigint")
    return f, f.where("marked").select("video_id", "fn"), f.select("video_id", "n_frames").distinct()


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_repair_is_the_loop(spark, chunk):
    videos = cases(120, chunk) + [("gold", list(range(9)), [i in (3, 4) for i in range(9)]), ("chain", list(range(14)), [i in (5, 7, 8) for i in range(14)])]
    f, m, n = tables(spark, videos)
    found = {}
    for r in repair.repair(f.select("video_id", "fn", "value"), m, n, chunk=chunk).collect():
        found.setdefault(r["video_id"], []).append((r["out_fn"], r["value"], r["kind"]))
    for v, values, flags in videos:
        got = sorted(found.get(v, []))
        assert [x[0] for x in got] == list(range(len(got)))
        assert [x[1:] for x in got] == loop(values, flags), v


def test_golden_segments(spark):
    f, m, n = tables(spark, [("a", [0] * 9, [i in (3, 4) for i in range(9)]), ("b", [0] * 14, [i in (5, 7, 8) for i in range(14)])])
    found = sorted(tuple(r) for r in repair.segments(m, n).collect())
    assert found == [("a", 3, 4, 2, 6, 3, 4), ("b", 5, 5, 4, 7, 2, 3), ("b", 8, 8, 5, 10, 2, 3)]


def test_marks_out_of_range_go_alone(spark):
    videos = [("tail", list(range(10)), [i in (2, 8, 9) for i in range(10)]), ("head", list(range(8)), [i in (0, 1) for i in range(8)])]
    f, m, n = tables(spark, videos)
    m = m.unionByName(spark.createDataFrame([("tail", 10), ("tail", 11), ("tail", 30), ("head", -1), ("head", -2), ("none", 0)], "video_id string, fn bigint"))
    assert sorted(tuple(r) for r in repair.segments(m, n).collect()) == [("head", 0, 1, None, 3, 3, 4), ("tail", 2, 2, 1, 4, 2, 3), ("tail", 8, 9, 7, None, 2, None)]
    for v, values, flags in videos:
        out = repair.repair(f.select("video_id", "fn", "value"), m, n).where(F.col("video_id") == v).orderBy("out_fn").collect()
        assert [(r["value"], r["kind"]) for r in out] == loop(values, flags)


def test_unmarked_input_is_its_output(spark):
    f, m, n = tables(spark, [("a", list(range(20)), [False] * 20)])
    out = repair.repair(f.select("video_id", "fn", "value"), m, n).orderBy("out_fn").collect()
    assert [(r["out_fn"], r["value"], r["kind"]) for r in out] == [(i, i, "copy") for i in range(20)]


def test_arrays_blend_like_values(spark):
    f, m, n = tables(spark, [("a", list(range(0, 200, 20)), [i in (3, 4) for i in range(10)])])
    one = repair.repair(f.select("video_id", "fn", "value"), m, n).orderBy("out_fn").collect()
    two = repair.repair(f.select("video_id", "fn", F.array("value", "value").alias("value")), m, n, blend=repair.lerp_arrays).orderBy("out_fn").collect()
    assert [[r["value"]] * 2 for r in one] == [list(r["value"]) for r in two]


def test_stream_step_is_the_loop():
    for v, values, flags in cases(400, 11):
        r, out = stateful.Repair(), []
        for i, (x, m) in enumerate(zip(values, flags)):
            r = stateful.Repair(r.state())
            out += r.push(i, x, len(values), m)
        assert [x[1:] for x in out] == loop(values, flags)
        assert [x[0] for x in out] == list(range(len(out)))


def test_stream_is_batch(spark, tmp_path):
    videos = cases(12, 4)
    f, m, n = tables(spark, videos)
    path = str(tmp_path / "in")
    f.repartition(1).write.parquet(path)
    stream = spark.readStream.schema(f.schema).parquet(path).select("video_id", "fn", "value", "n_frames", "marked")
    out = stateful.drain(stateful.repair(stream), str(tmp_path / "run"))
    batch = repair.repair(f.select("video_id", "fn", "value"), m, n)
    key = lambda d: sorted(tuple(r) for r in d.select("video_id", "out_fn", "value", "kind").collect())
    assert key(out) == key(batch)


def session_loop(keys, n):
    fn, has = 0, set()
    for k in keys:
        if fn >= n or k == "q":
            break
        if k == " ":
            has ^= {fn}
            fn += 1
        elif k in "bv":
            fn = max(0, fn - (1 if k == "b" else 5))
        elif k == "n":
            fn = min((m for m in has if m > fn), default=fn)
        elif k == "p":
            fn = max((m for m in has if m < fn), default=fn)
        elif k == "s":
            fn = 0
        else:
            fn += 1
    return sorted(has)


def test_session_is_the_loop(spark):
    rng = random.Random(3)
    logs = {f"v{i}": [rng.choice("  xbvnpsB") if rng.random() < 0.98 else "q" for _ in range(rng.randint(0, 80))] for i in range(60)}
    keys = spark.createDataFrame([(v, i, k) for v, log in logs.items() for i, k in enumerate(log)], "video_id string, seq bigint, key string")
    found = {}
    for r in marks.session(keys, 20).collect():
        found.setdefault(r["video_id"], []).append(r["fn"])
    assert {v: sorted(x) for v, x in found.items()} == {v: s for v, log in logs.items() if (s := session_loop(log, 20))}
    more = marks.session(keys.where("video_id = 'none'"), 20, spark.createDataFrame([("w", 4)], "video_id string, fn bigint"))
    assert [tuple(r) for r in more.collect()] == [("w", 4)]


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_ordered_operations(spark, chunk):
    from framewell.operators import ordered

    rng = random.Random(chunk)
    rows = [(v, fn, rng.randrange(100), rng.random() < 0.3) for v in "abc" for fn in sorted(rng.sample(range(60), 25))]
    d = spark.createDataFrame(rows, "video_id string, fn bigint, value int, flag boolean")
    by = {v: [r for r in rows if r[0] == v] for v in "abc"}
    for r in ordered.history(d, "video_id", "fn", "value", 4, chunk).collect():
        line = by[r["video_id"]]
        at = [x[1] for x in line].index(r["fn"])
        assert [r[f"h{i}"] for i in range(4)] == [line[max(at - i, 0)][2] for i in range(4)]
    for r in ordered.nearest(d, "video_id", "fn", F.col("flag"), chunk).collect():
        at = [x[1] for x in by[r["video_id"]] if x[3]]
        assert r["previous_marked"] == max((x for x in at if x < r["fn"]), default=None)
        assert r["next_marked"] == min((x for x in at if x > r["fn"]), default=None)
    for r in ordered.running_count(d, "video_id", "fn", F.col("flag"), "n", chunk).collect():
        assert r["n"] == sum(x[3] for x in by[r["video_id"]] if x[1] <= r["fn"])
