"""SQL of the frame operators' queries, for DuckDB."""

SERIES = "series AS (SELECT event_id AS fn, event_type = 'error' AS marked, trunc(least(255, value))::INTEGER AS value, floor(epoch_us(ts) / 1000.0) AS msec FROM events)"
ISLANDS = SERIES + """, islands AS (
  SELECT min(fn) AS a, max(fn) AS b FROM (SELECT fn, fn - row_number() OVER (ORDER BY fn) AS run FROM series WHERE marked) GROUP BY run
)"""
SEGMENTS = ISLANDS + """, numbered AS (SELECT a, b, row_number() OVER (ORDER BY a) AS k FROM islands), total AS (SELECT max(fn) + 1 AS n FROM series),
fold AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS c, NULL::BIGINT AS last, NULL::BIGINT AS st, NULL::BIGINT AS b, NULL::BIGINT AS prev, NULL::BIGINT AS src, false AS emitted
  UNION ALL
  SELECT i.k,
    CASE WHEN i.b < f.c THEN f.c WHEN i.b + 2 < n THEN i.b + 3 ELSE i.b + 1 END,
    CASE WHEN i.b < f.c THEN f.last ELSE greatest(i.a, f.c) END,
    greatest(i.a, f.c), i.b,
    CASE WHEN f.last IS NOT NULL AND greatest(i.a, f.c) = f.c THEN f.last WHEN greatest(i.a, f.c) > 0 THEN greatest(i.a, f.c) - 1 END,
    CASE WHEN i.b + 2 < n THEN i.b + 2 END, i.b >= f.c
  FROM fold f JOIN numbered i ON i.k = f.k + 1 CROSS JOIN total
), segments AS (
  SELECT st, b, prev, src, CASE WHEN src IS NOT NULL THEN b - st + 2 ELSE b - st + 1 END AS n, CASE WHEN src IS NOT NULL THEN b - st + 3 END AS div FROM fold WHERE emitted
)"""
REPAIR = "WITH RECURSIVE " + SEGMENTS + """, made AS (
  SELECT st AS place, i, CASE WHEN s.src IS NULL THEN coalesce(p.value, o.value) ELSE
    trunc(greatest(0.0, least(255.0, coalesce(p.value, q.value)::DOUBLE * (1 - i::DOUBLE / div) + q.value::DOUBLE * (i::DOUBLE / div))))::INTEGER END AS value,
    CASE WHEN s.src IS NULL THEN 'hold' ELSE 'blend' END AS kind
  FROM (SELECT *, unnest(range(n)) AS i FROM segments) s
  LEFT JOIN series p ON p.fn = s.prev LEFT JOIN series q ON q.fn = s.src LEFT JOIN series o ON o.fn = s.st + s.i
), taken AS (SELECT unnest(range(st, coalesce(src, b) + 1)) AS fn FROM segments),
every AS (
  SELECT place, i, value, kind FROM made
  UNION ALL SELECT fn, 0, value, 'copy' FROM series WHERE fn NOT IN (SELECT fn FROM taken)
)
SELECT row_number() OVER (ORDER BY place, i) - 1 AS out_fn, value, kind FROM every"""

IMAGE = """cut AS (SELECT (count(*) // 9) * 9 AS n FROM embeddings),
pixels AS (
  SELECT vec_id // 9 AS fn, (8 * (vec_id % 3) + i % 8)::INTEGER AS x, (8 * ((vec_id % 9) // 3) + i // 8)::INTEGER AS y,
    trunc(greatest(0.0, least(255.0, embedding[i + 1]::DOUBLE * 400 + 128)))::INTEGER AS b,
    trunc(greatest(0.0, least(255.0, embedding[(i + 1) % 64 + 1]::DOUBLE * 400 + 128)))::INTEGER AS g,
    trunc(greatest(0.0, least(255.0, embedding[(i + 2) % 64 + 1]::DOUBLE * 400 + 128)))::INTEGER AS r
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings, cut WHERE vec_id < n)
)"""

BLOCKS = """hist AS (
  SELECT vec_id AS fn, embedding AS h0,
    coalesce(lag(embedding, 1) OVER w, first_value(embedding) OVER w) AS h1,
    coalesce(lag(embedding, 2) OVER w, first_value(embedding) OVER w) AS h2,
    coalesce(lag(embedding, 3) OVER w, first_value(embedding) OVER w) AS h3
  FROM embeddings WINDOW w AS (ORDER BY vec_id)
)"""


STREAM_REPAIR = "WITH RECURSIVE " + SERIES + """, videos AS (SELECT 'v' || (fn // 500) AS video_id, fn % 500 AS fn, marked, value FROM series),
numbered AS (
  SELECT video_id, min(fn) AS a, max(fn) AS b, row_number() OVER (PARTITION BY video_id ORDER BY min(fn)) AS k
  FROM (SELECT video_id, fn, fn - row_number() OVER (PARTITION BY video_id ORDER BY fn) AS run FROM videos WHERE marked) GROUP BY video_id, run
), total AS (SELECT video_id, max(fn) + 1 AS n FROM videos GROUP BY video_id),
fold AS (
  SELECT video_id, n, 0::BIGINT AS k, 0::BIGINT AS c, NULL::BIGINT AS last, NULL::BIGINT AS st, NULL::BIGINT AS b, NULL::BIGINT AS prev, NULL::BIGINT AS src, false AS emitted FROM total
  UNION ALL
  SELECT f.video_id, f.n, i.k,
    CASE WHEN i.b < f.c THEN f.c WHEN i.b + 2 < f.n THEN i.b + 3 ELSE i.b + 1 END,
    CASE WHEN i.b < f.c THEN f.last ELSE greatest(i.a, f.c) END,
    greatest(i.a, f.c), i.b,
    CASE WHEN f.last IS NOT NULL AND greatest(i.a, f.c) = f.c THEN f.last WHEN greatest(i.a, f.c) > 0 THEN greatest(i.a, f.c) - 1 END,
    CASE WHEN i.b + 2 < f.n THEN i.b + 2 END, i.b >= f.c
  FROM fold f JOIN numbered i ON i.video_id = f.video_id AND i.k = f.k + 1
), segments AS (
  SELECT video_id, st, b, prev, src, CASE WHEN src IS NOT NULL THEN b - st + 2 ELSE b - st + 1 END AS n, b - st + 3 AS div FROM fold WHERE emitted
), made AS (
  SELECT s.video_id, st AS place, i, CASE WHEN s.src IS NULL THEN coalesce(p.value, o.value) ELSE
    trunc(greatest(0.0, least(255.0, coalesce(p.value, q.value)::DOUBLE * (1 - i::DOUBLE / div) + q.value::DOUBLE * (i::DOUBLE / div))))::INTEGER END AS value,
    CASE WHEN s.src IS NULL THEN 'hold' ELSE 'blend' END AS kind
  FROM (SELECT *, unnest(range(n)) AS i FROM segments) s
  LEFT JOIN videos p ON p.video_id = s.video_id AND p.fn = s.prev LEFT JOIN videos q ON q.video_id = s.video_id AND q.fn = s.src LEFT JOIN videos o ON o.video_id = s.video_id AND o.fn = s.st + s.i
), taken AS (SELECT video_id, unnest(range(st, coalesce(src, b) + 1)) AS fn FROM segments),
every AS (
  SELECT video_id, place, i, value, kind FROM made
  UNION ALL SELECT v.video_id, v.fn, 0, value, 'copy' FROM videos v LEFT JOIN taken t ON t.video_id = v.video_id AND t.fn = v.fn WHERE t.fn IS NULL
)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY place, i) - 1 AS out_fn, value, kind FROM every"""


def _layer(name: str, of: str, n_in: int, n_out: int, layer: int) -> str:
    w = f"((i * 31 + j * 17 + {7 * layer}) % 201 - 100) / 1000.0::DOUBLE"
    return f"{name} AS (SELECT fn, list_transform(range({n_out}), lambda j: 1 / (1 + exp(-list_sum(list_transform(range({n_in}), lambda i: v[i + 1] * {w}))))) AS v FROM {of})"


SCORES = BLOCKS + ", l0 AS (SELECT fn, list_transform(h0 || h1 || h2 || h3 || [-1.0::FLOAT], lambda x: x::DOUBLE) AS v FROM hist), " + ", ".join(_layer(f"l{k + 1}", f"l{k}", a, b, k) for k, (a, b) in enumerate(((257, 16), (16, 16), (16, 1)))) + ", scored AS (SELECT fn, v[1] AS output FROM l3)"
FRAME_SCORES = SCORES + """, centred AS (SELECT fn // 9 AS fn, output - (SELECT avg(output) FROM scored) + 0.5 AS output FROM scored),
frames AS (SELECT fn, count(*) AS blocks, count(*) FILTER (output > 0.5) AS positive, avg(output) AS mean_output FROM centred GROUP BY fn)"""

_GEOMETRY = "geometry AS (SELECT * FROM (VALUES (1920, 1080), (640, 480), (64, 48), (65, 49), (24, 24), (16, 16), (9, 9), (8, 8)) AS t(width, height))"


def _tone(t: str, gain: float, bias: float, gamma: float) -> str:
    return f"trunc(greatest(0.0, least(255.0, (pow({t}, {gamma}::DOUBLE) * {gain}::DOUBLE + ({bias})::DOUBLE) * 255)))::INTEGER"


def _lut(fw: int, fh: int, alpha: float) -> str:
    a = f"({fw}::DOUBLE / {fh})"
    return f"""grid AS (SELECT (t % {fw})::INTEGER AS x, (t // {fw})::INTEGER AS y FROM range({fw * fh}) r(t)),
centred AS (SELECT x, y, x::DOUBLE / {fw} * {a} - {a} / 2 AS dx, y::DOUBLE / {fh} - 0.5::DOUBLE AS dy FROM grid),
radial AS (SELECT *, sqrt(dx * dx + dy * dy) AS rd FROM centred),
ratio AS (SELECT *, (rd / nullif(1 - {alpha}::DOUBLE * rd * rd, 0)) / nullif(rd, 0) AS k FROM radial),
lut AS (SELECT x, y, (dx * k + {a} / 2) * {fw} / {a} AS ux, (dy * k + 0.5::DOUBLE) * {fh} AS uy FROM ratio)"""


def _remap() -> str:
    def value(c: str) -> str:
        v = [f"p{i}.{c}::DOUBLE / 255" for i in range(4)]
        t = f"({v[0]} * (1 - ox) + {v[1]} * ox) * (1 - oy) + ({v[2]} * (1 - ox) + {v[3]} * ox) * oy"
        return f"CASE WHEN t.x IS NULL THEN 0 ELSE {_tone(t, 1.0, 0.0, 1.0)} END AS {c}"

    joins = " ".join(f"LEFT JOIN pixels p{i} ON p{i}.fn = p.fn AND p{i}.x = {x} AND p{i}.y = {y}" for i, (x, y) in enumerate((("x0", "y0"), ("x1", "y0"), ("x0", "y1"), ("x1", "y1"))))
    return f"""WITH {IMAGE}, {_lut(24, 24, 0.5)}, near AS (
  SELECT x, y, ux - floor(ux) AS ox, uy - floor(uy) AS oy, trunc(ux) AS sx, trunc(uy) AS sy FROM lut
), taps AS (
  SELECT x, y, ox, oy, greatest(sx, 0) AS x0, least(sx + 1, 23) AS x1, greatest(sy, 0) AS y0, least(sy + 1, 23) AS y1
  FROM near WHERE sx >= -1 AND sx < 24 AND sy >= -1 AND sy < 24
)
SELECT p.fn, p.x, p.y, {value('b')}, {value('g')}, {value('r')} FROM pixels p LEFT JOIN taps t ON t.x = p.x AND t.y = p.y {joins}"""


def _axis(name: str, n: int, m: int) -> str:
    """Two source places and a weight for each of m places along n pixels."""
    return f"{name} AS (SELECT i, greatest(floor(t), 0)::INTEGER AS lo, least(floor(t) + 1, {n - 1})::INTEGER AS hi, (t - floor(t))::FLOAT AS o FROM (SELECT i, (i + 0.5::DOUBLE) * {n} / {m} - 0.5::DOUBLE AS t FROM range({m}) r(i)))"


def _resized(width: int, height: int, red: str = "false") -> str:
    """The 24x24 image in another size, in single precision; all red where the condition holds."""

    def value(c: str) -> str:
        row = lambda a, b: f"({a}.{c}::FLOAT * (1::FLOAT - v.o) + {b}.{c}::FLOAT * v.o)"
        out = f"round_even(({row('a', 'b')} * (1::FLOAT - u.o) + {row('d', 'e')} * u.o)::DOUBLE, 0)::INTEGER"
        return f"CASE WHEN {red} THEN {255 if c == 'r' else 0} ELSE {out} END AS {c}"

    joins = " ".join(f"JOIN pixels {p} ON {p}.x = u.{x} AND {p}.y = v.{y}" + (f" AND {p}.fn = a.fn" if p != "a" else "") for p, x, y in (("a", "lo", "lo"), ("b", "lo", "hi"), ("d", "hi", "lo"), ("e", "hi", "hi")))
    return f"WITH {IMAGE}, {IMAGE_MARKS}, {_axis('u', 24, width)}, {_axis('v', 24, height)} SELECT a.fn, u.i::INTEGER AS x, v.i::INTEGER AS y, {value('b')}, {value('g')}, {value('r')} FROM u CROSS JOIN v {joins}"


IMAGE_MARKS = "bad AS (SELECT vec_id // 9 AS fn FROM embeddings, cut WHERE vec_id < n AND vec_id % 9 = 0 AND label IN (0, 1))"


def _unsharp() -> str:
    """Two passes of 19 taps, mirrored at the edges, each summed in order in single precision."""

    def blurred(c: str) -> str:
        place = "abs(p + i - 9)"
        return f"list_transform(range(24), lambda p: list_reduce(list_transform(range(19), lambda i: k[i + 1] * {c}[CASE WHEN {place} >= 24 THEN 46 - {place} ELSE {place} END + 1]), lambda s, t: s + t)) AS {c}"

    three = ", ".join(blurred(c) for c in "bgr")
    lists = lambda by: ", ".join(f"list({c}::FLOAT ORDER BY {by}) AS {c}" for c in "bgr")
    flat = ", ".join(f"unnest({c}) AS {c}" for c in "bgr")
    sharp = ", ".join(f"greatest(0, least(255, round_even(1.5::DOUBLE * p.{c} - 0.5::DOUBLE * greatest(0, least(255, round_even(s.{c}::DOUBLE, 0))), 0)))::INTEGER AS {c}" for c in "bgr")
    return f"""WITH {IMAGE}, taps AS (SELECT i, exp(-0.5::DOUBLE * ((i - 9) / 3.0::DOUBLE) ** 2) AS t FROM range(19) r(i)),
kernel AS (SELECT list((t / (SELECT sum(t) FROM taps))::FLOAT ORDER BY i) AS k FROM taps),
columns_ AS (SELECT fn, x, {lists('y')} FROM pixels GROUP BY fn, x),
down AS (SELECT fn, x, {three} FROM columns_, kernel),
cells AS (SELECT fn, x, unnest(range(24)) AS y, {flat} FROM down),
rows_ AS (SELECT fn, y, {lists('x')} FROM cells GROUP BY fn, y),
across AS (SELECT fn, y, {three} FROM rows_, kernel),
soft AS (SELECT fn, y, unnest(range(24)) AS x, {flat} FROM across)
SELECT p.fn, p.x, p.y, {sharp} FROM pixels p JOIN soft s ON s.fn = p.fn AND s.x = p.x AND s.y = p.y"""


def _interpolated() -> str:
    """The repair of the 24x24 video, blended pixel by pixel in single precision."""
    series = "series AS (SELECT i AS fn, i IN (SELECT fn FROM bad) AS marked FROM cut, range((SELECT n // 9 FROM cut)) r(i))"
    mixed = ", ".join(f"CASE WHEN p.fn IS NULL THEN q.{c} ELSE trunc(greatest(0::FLOAT, least(255::FLOAT, p.{c}::FLOAT * (1 - m.alpha)::FLOAT + q.{c}::FLOAT * m.alpha::FLOAT)))::INTEGER END AS {c}" for c in "bgr")
    return f"""WITH RECURSIVE {IMAGE}, {IMAGE_MARKS}, {SEGMENTS.replace(SERIES, series)}, made AS (
  SELECT st AS place, i, CASE WHEN src IS NULL THEN coalesce(prev, st + i) ELSE coalesce(prev, src) END AS one, coalesce(src, prev, st + i) AS two,
    CASE WHEN src IS NULL THEN 0::DOUBLE ELSE i::DOUBLE / div END AS alpha, CASE WHEN src IS NULL THEN 'hold' ELSE 'blend' END AS kind
  FROM (SELECT *, unnest(range(n)) AS i FROM segments)
), taken AS (SELECT unnest(range(st, coalesce(src, b) + 1)) AS fn FROM segments),
every AS (
  SELECT * FROM made UNION ALL SELECT fn, 0, fn, fn, 0::DOUBLE, 'copy' FROM series WHERE fn NOT IN (SELECT fn FROM taken)
), numbered_out AS (SELECT row_number() OVER (ORDER BY place, i) - 1 AS out_fn, * FROM every)
SELECT m.out_fn, m.kind, q.x, q.y, {mixed} FROM numbered_out m JOIN pixels q ON q.fn = m.two LEFT JOIN pixels p ON p.fn = m.one AND p.x = q.x AND p.y = q.y"""


def _rotate(x: str, y: str) -> str:
    return f"WITH {IMAGE} SELECT fn, ({x})::INTEGER AS x, ({y})::INTEGER AS y, b, g, r FROM pixels"


def oracle_sql() -> dict[str, str]:
    lerp = lambda c: f"trunc(greatest(0.0, least(255.0, p.{c}::DOUBLE * (1 - 0.25::DOUBLE) + s.{c}::DOUBLE * 0.25::DOUBLE)))::INTEGER AS {c}"
    h = lambda at, name: f"round({at}::DOUBLE, 4) AS {name}"
    return {
        "repair_series": REPAIR,
        "mark_islands": f"WITH {ISLANDS} SELECT a, b, b - a + 1 AS n_frames FROM islands",
        "repair_segments": f"WITH RECURSIVE {SEGMENTS} SELECT * FROM segments",
        "nearest_marks": f"WITH {SERIES} SELECT fn, max(CASE WHEN marked THEN fn END) OVER (ORDER BY fn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_marked, min(CASE WHEN marked THEN fn END) OVER (ORDER BY fn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_marked FROM series",
        "toggle_marks": "SELECT user_id AS fn FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) % 2 = 1",
        "mark_join": f"WITH {SERIES} SELECT fn, value, marked FROM series",
        "mark_semi": f"WITH {SERIES} SELECT fn, value FROM series WHERE marked",
        "mark_anti": f"WITH {SERIES} SELECT fn, value FROM series WHERE NOT marked",
        "trained_frames": f"WITH {SERIES}, total AS (SELECT max(fn) + 1 AS n FROM series), ranked AS (SELECT fn, row_number() OVER (ORDER BY ((fn + 12345) * 1103515245 + 12345) % 2147483648, fn) AS k FROM series) SELECT fn + 1 AS fn FROM ranked, total WHERE k <= floor(n::FLOAT * 0.1::FLOAT) AND fn + 1 < n",
        "timecode": f"WITH {SERIES}, t AS (SELECT fn, msec - (SELECT min(msec) FROM series) AS ms FROM series), s AS (SELECT fn, ms, floor(ms / 1000) AS s FROM t), m AS (SELECT *, floor(s / 60) AS m FROM s), h AS (SELECT *, floor(m / 60) AS h FROM m), r AS (SELECT fn, ms, s - 60 * (m - 60 * h) AS s, m - 60 * h AS m, h FROM h) SELECT fn, printf('%02d:%02d:%02d:%04d', h::BIGINT, m::BIGINT, s::BIGINT, floor(ms - 1000 * s)::BIGINT) AS timecode FROM r",
        "fourcc": "SELECT code::INTEGER AS code, chr((code & 255)::INTEGER) || chr(((code >> 8) & 255)::INTEGER) || chr(((code >> 16) & 255)::INTEGER) || chr(((code >> 24) & 255)::INTEGER) AS name FROM (VALUES (1196444237), (875967080), (1145656920), (875967048)) AS t(code)",
        "input_concat": f"WITH {SERIES}, total AS (SELECT count(*) AS n, count(*) // 2 AS half FROM series) SELECT CASE WHEN fn >= half THEN fn - half ELSE fn + n - half END AS fn, value FROM series, total",
        "frame_counts": f"WITH {SERIES} SELECT 'v-' || (value % 7) AS video_id, count(*) AS n_frames FROM series WHERE NOT marked GROUP BY 1",
        "block_history": f"WITH {BLOCKS} SELECT fn, 257 AS n, {h('h0[1]', 'h0')}, {h('h1[1]', 'h1')}, {h('h2[1]', 'h2')}, {h('h3[1]', 'h3')}, {h('h3[64]', 'last')}, -1.0::DOUBLE AS bias FROM hist",
        "block_grid": f"WITH {_GEOMETRY} SELECT width, height, (((width - 1) // 8) * ((height - 1) // 8))::BIGINT AS blocks, 8 * ((width - 1) // 8 - 1) AS last_x, 8 * ((height - 1) // 8 - 1) AS last_y FROM geometry WHERE width > 8 AND height > 8",
        "luminance": f"WITH {IMAGE} SELECT fn, x, y, round((0.2126::DOUBLE * b + 0.7512::DOUBLE * g + 0.0722::DOUBLE * r) / 255, 4) AS luma FROM pixels",
        "rotate_90": _rotate("23 - y", "x"),
        "rotate_180": _rotate("23 - x", "23 - y"),
        "rotate_270": _rotate("y", "23 - x"),
        "working_size": f"WITH {_GEOMETRY} SELECT width, height, rotation, trunc((CASE WHEN rotation IN (90, 270) THEN height ELSE width END)::FLOAT * 0.75::FLOAT)::INTEGER AS fw, trunc(height::FLOAT * 0.5::FLOAT)::INTEGER AS fh FROM geometry, (VALUES (0), (90), (180), (270)) AS r(rotation)",
        "undistort_lut": f"WITH {_lut(64, 48, 0.5)} SELECT x, y, round(ux, 4) + 0.0 AS ux, round(uy, 4) + 0.0 AS uy FROM lut",
        "undistort_remap": _remap(),
        "tone_curve": f"WITH {IMAGE} SELECT fn, x, y, " + ", ".join(f"{_tone(f'{c}::DOUBLE / 255', 1.2, -0.05, 0.8)} AS {c}" for c in "bgr") + " FROM pixels",
        "aspect_crop": f"WITH {IMAGE} SELECT fn, x, y - 4 AS y, b, g, r FROM pixels WHERE y BETWEEN 4 AND 19",
        "pixel_lerp": f"WITH {IMAGE} SELECT p.fn, p.x, p.y, {lerp('b')}, {lerp('g')}, {lerp('r')} FROM pixels p JOIN pixels s ON s.fn = p.fn + 1 AND s.x = p.x AND s.y = p.y",
        "resize": _resized(40, 30),
        "preview": _resized(9, 9, "a.fn IN (SELECT fn FROM bad)"),
        "unsharp": _unsharp(),
        "interpolate_frames": _interpolated(),
        "avi_round_trip": f"WITH {IMAGE} SELECT fn, x, y, b, g, r FROM pixels",
        "avi_metadata": f"WITH {IMAGE} SELECT 0 AS fourcc, 24 AS width, 24 AS height, 25.0::DOUBLE AS fps, 0 AS format, 0 AS iso_speed, count(DISTINCT fn) AS declared_frames FROM pixels",
        "seek": f"WITH {SERIES} SELECT fn, value FROM series WHERE fn BETWEEN 500 AND 599",
        "progress_log": f"WITH {SERIES} SELECT count(*) AS frames, count(*) FILTER (marked OR value IS NULL) AS unreadable, min(fn) AS first_fn, max(fn) AS last_fn FROM series",
        "input_list": "SELECT event_id, unnest([0, 1, 2, 3])::INTEGER AS place, unnest([event_type, user_id::VARCHAR, '', '']) AS name FROM events",
        "sigmoid_slope": "SELECT event_id, round(v, 6) AS v, round(v * (1 - v), 6) AS slope FROM (SELECT event_id, 1 / (1 + exp(-0.5::DOUBLE * (value / 100 - 2))) AS v FROM events)",
        "output_size": f"WITH {_GEOMETRY}, asked(set_width, set_height) AS (VALUES (0, 0), (320, 0), (0, 200), (320, 200)) SELECT width, height, rotation, set_width, set_height, coalesce(nullif(set_width, 0), CASE WHEN rotation IN (90, 270) THEN height ELSE width END) AS out_width, coalesce(nullif(set_height, 0), CASE WHEN rotation IN (90, 270) THEN width ELSE height END) AS out_height FROM geometry, (VALUES (0), (90), (180), (270)) AS r(rotation), asked",
        "mlp_score": f"WITH {SCORES} SELECT fn, round(output, 4) AS output FROM scored",
        "frame_scores": f"WITH {FRAME_SCORES} SELECT fn, blocks, positive, round(mean_output, 4) AS mean_output, round(positive::DOUBLE / blocks, 4) AS fraction, trunc(positive::DOUBLE / blocks * 100)::INTEGER AS percent FROM frames",
        "classified_marks": f"WITH {FRAME_SCORES} SELECT fn FROM frames WHERE positive::DOUBLE / blocks > 0.5",
        "marking_session": """WITH RECURSIVE keys AS (
  SELECT (event_id // 100)::VARCHAR AS video_id, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) AS n,
    CASE event_type WHEN 'error' THEN ' ' WHEN 'view' THEN 'n' WHEN 'signup' THEN 'b' WHEN 'purchase' THEN 'p' ELSE 'x' END AS key
  FROM events
), session AS (
  SELECT DISTINCT video_id, 0::BIGINT AS n, 0::BIGINT AS fn, []::BIGINT[] AS marks FROM keys
  UNION ALL
  SELECT s.video_id, k.n,
    CASE WHEN s.fn >= 60 THEN s.fn WHEN key = 'b' THEN greatest(s.fn - 1, 0)
      WHEN key = 'n' THEN coalesce(list_min(list_filter(marks, lambda m: m > s.fn)), s.fn)
      WHEN key = 'p' THEN coalesce(list_max(list_filter(marks, lambda m: m < s.fn)), s.fn) ELSE s.fn + 1 END,
    CASE WHEN key = ' ' AND s.fn < 60 THEN CASE WHEN list_contains(marks, s.fn) THEN list_filter(marks, lambda m: m <> s.fn) ELSE list_append(marks, s.fn) END ELSE marks END
  FROM session s JOIN keys k ON k.video_id = s.video_id AND k.n = s.n + 1
), done AS (SELECT video_id, arg_max(marks, n) AS marks FROM session GROUP BY video_id)
SELECT video_id, unnest(marks) AS fn FROM done""",
        "marked_file_round_trip": f"WITH {SERIES} SELECT fn FROM series WHERE marked",
        "model_file_round_trip": "SELECT layer::INTEGER AS layer, i::INTEGER AS i, j::INTEGER AS j, round(((i * 31 + j * 17 + layer * 7) % 201 - 100) / 1000.0::DOUBLE, 4) AS w FROM (SELECT 0 AS layer, i, j FROM range(5) a(i), range(4) b(j) UNION ALL SELECT 1, i, j FROM range(4) a(i), range(3) b(j) UNION ALL SELECT 2, i, j FROM range(3) a(i), range(2) b(j))",
        "stream_repair": STREAM_REPAIR,
        "stream_history": f"WITH {SERIES}, v AS (SELECT 'v' || (fn // 500) AS video_id, fn % 500 AS fn, value FROM series) SELECT video_id, fn, value AS h0, coalesce(lag(value, 1) OVER w, first_value(value) OVER w) AS h1, coalesce(lag(value, 2) OVER w, first_value(value) OVER w) AS h2, coalesce(lag(value, 3) OVER w, first_value(value) OVER w) AS h3 FROM v WINDOW w AS (PARTITION BY video_id ORDER BY fn)",
    }
