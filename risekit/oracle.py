"""DuckDB SQL of the rise-curve queries."""

from __future__ import annotations

from risekit.queries import GATE_JITTER, GATE_PER_MINUTE, SESSION_HOURS, SLOPE_MINUTES

_ORDER = "PARTITION BY user_id ORDER BY ts"
_SMOOTH = f"SELECT event_id, user_id, ts, value, median(value) OVER ({_ORDER} ROWS 4 PRECEDING) AS smoothed FROM events"
_RISEN = f"""WITH s AS ({_SMOOTH}),
f AS (SELECT *, first_value(smoothed) OVER ({_ORDER}) AS base, epoch_us(ts) AS us, (epoch_us(ts) - first_value(epoch_us(ts)) OVER ({_ORDER})) / 3600000000.0 AS h FROM s),
r AS (SELECT *, CASE WHEN base <> 0 THEN (smoothed - base) / base * 100.0 END AS rise FROM f)"""
_FRAME = f"PARTITION BY user_id ORDER BY us RANGE {round(SLOPE_MINUTES * 60_000_000)} PRECEDING"
_PROFILE = """WITH p AS (
  SELECT user_id AS frame_id, row_number() OVER w - 1 AS y, value AS v, count(*) OVER (PARTITION BY user_id) AS n,
         abs(value - coalesce(lag(value) OVER w, value)) AS e
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


def _smooth(column: str, window: int) -> str:
    half = window // 2
    return f"avg({column}) OVER (PARTITION BY frame_id ORDER BY y ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"


_EDGE = f"""{_PROFILE},
ea AS (SELECT frame_id, y, n, v, e, {_smooth('e', 5)} AS s, floor(n * 0.10::DOUBLE)::INT AS a,
             greatest(floor(n * 0.10::DOUBLE)::INT + 1, floor(n * 0.90::DOUBLE)::INT) AS z FROM p),
eb AS (SELECT *, max(s) OVER f AS top, avg(s) FILTER (y >= a AND y < z) OVER f AS base,
             coalesce(lag(s) OVER (PARTITION BY frame_id ORDER BY y), s) AS l, coalesce(lead(s) OVER (PARTITION BY frame_id ORDER BY y), s) AS r
      FROM ea WINDOW f AS (PARTITION BY frame_id)),
ec AS (SELECT *, s >= base + (top - base) * 0.20::DOUBLE AS strong,
             (s - base) * 1.2::DOUBLE + (s - least(l, r)) * 0.8::DOUBLE + (y - a)::DOUBLE / greatest(1, z - a) * 0.25::DOUBLE AS s1,
             (s - base) * 0.8::DOUBLE + (s - least(l, r)) * 0.4::DOUBLE + (y - a)::DOUBLE / greatest(1, z - a) * 0.15::DOUBLE AS s2
      FROM eb WHERE y >= a AND y < z),
ed AS (SELECT frame_id, top, y, row_number() OVER (PARTITION BY frame_id ORDER BY strong DESC, CASE WHEN strong THEN s1 ELSE s2 END DESC, y) AS k FROM ec),
edge AS (SELECT frame_id, CASE WHEN top > 0 THEN y END::INT AS surface FROM ed WHERE k = 1)"""
_BAND = f"""
ba AS (SELECT frame_id, y, n, {_smooth('v', 7)} AS s, greatest(1, floor(n * 0.05::DOUBLE)::INT) AS a, least(n - 1, floor(n * 0.95::DOUBLE)::INT) AS z,
             greatest(2, n // 20) AS w FROM p),
bb AS (SELECT *, sum(s) OVER (PARTITION BY frame_id ORDER BY y) AS pre, sum(s) OVER f AS total,
             max(s) FILTER (y >= a AND y < z) OVER f - min(s) FILTER (y >= a AND y < z) OVER f AS spread,
             lag(s) OVER (PARTITION BY frame_id ORDER BY y) AS l, lead(s) OVER (PARTITION BY frame_id ORDER BY y) AS r
      FROM ba WINDOW f AS (PARTITION BY frame_id)),
bc AS (SELECT x.*, (SELECT avg(s) FROM ba q WHERE q.frame_id = x.frame_id AND q.y BETWEEN greatest(0, x.y - x.w) AND greatest(greatest(0, x.y - x.w), x.y - 1)) AS before,
             (SELECT avg(s) FROM ba q WHERE q.frame_id = x.frame_id AND q.y BETWEEN least(x.n - 1, x.y + 1) AND least(x.n - 1, x.y + x.w)) AS after
      FROM bb x WHERE n >= 10 AND z - a >= 5 AND spread >= 55 AND y >= a AND y < z),
bd AS (SELECT *, pre / y - (total - pre) / (n - y) AS step,
             (pre / y - (total - pre) / (n - y)) * 1.1::DOUBLE + greatest(0, before - after) * 0.8::DOUBLE + greatest(0, coalesce(l, s) - coalesce(r, s)) * 0.25::DOUBLE AS score FROM bc),
be AS (SELECT frame_id, max(score) AS best, arg_max(y, (score, -y)) AS row, arg_max(step, (score, -y)) AS contrast FROM bd GROUP BY frame_id),
bf AS (SELECT frame_id, min(y) AS first, any_value(contrast) AS contrast FROM bd JOIN be USING (frame_id) WHERE y <= row AND score >= best * 0.85::DOUBLE AND contrast >= 55 GROUP BY frame_id),
band AS (SELECT f.frame_id, first::INT AS band_top, coalesce(contrast, 0.0) AS band_contrast FROM (SELECT DISTINCT frame_id FROM p) f LEFT JOIN bf USING (frame_id))"""
_COMBINED = f"""{_EDGE}, {_BAND},
snap AS (SELECT frame_id, arg_max(y, (e, -y)) AS y, max(e) AS top FROM p JOIN band USING (frame_id)
         WHERE y BETWEEN band_top - greatest(3, n * 3 // 100) AND band_top + greatest(3, n * 3 // 100) GROUP BY frame_id),
combined AS (SELECT frame_id, CASE WHEN band_top IS NOT NULL THEN CASE WHEN top > 0 THEN snap.y ELSE band_top END ELSE surface END::INT AS surface,
             CASE WHEN band_top IS NOT NULL THEN 'band' WHEN surface IS NOT NULL THEN 'edge' ELSE 'none' END AS method
      FROM band JOIN edge USING (frame_id) LEFT JOIN snap USING (frame_id))"""
def _bottom(surfaces: str, p: str = "p") -> str:
    """low (frame_id, bottom): the lower edge below the surfaces of a table, in the profiles of p."""
    return f"""
ja AS (SELECT {p}.frame_id, y, n, {_smooth('e', 5)} AS s, surface FROM {p} JOIN {surfaces} USING (frame_id)),
jb AS (SELECT *, greatest(0, coalesce(surface, 0) + 1, floor(n * 0.35::DOUBLE)::INT) AS a FROM ja),
jc AS (SELECT *, greatest(a + 1, n - 1) AS z FROM jb),
jd AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY frame_id ORDER BY y), s) AS l, coalesce(lead(s) OVER (PARTITION BY frame_id ORDER BY y), s) AS r,
             avg(s) FILTER (y >= a AND y <= z) OVER f AS base, max(s) FILTER (y >= a AND y <= z) OVER f AS top FROM jc WINDOW f AS (PARTITION BY frame_id)),
je AS (SELECT frame_id, n, base, top, y, a, z, (s - base) * 1.35::DOUBLE + (s - least(l, r)) * 0.75::DOUBLE + (z - y)::DOUBLE / greatest(1, z - a + 1) * 0.15::DOUBLE - (y - a)::DOUBLE / greatest(1, z - a + 1) * 0.05::DOUBLE AS score
      FROM jd WHERE y >= a AND y <= z),
low AS (SELECT f.frame_id, coalesce(bottom, f.n - 1)::INT AS bottom FROM (SELECT DISTINCT frame_id, n FROM {p}) f
LEFT JOIN (SELECT frame_id, arg_max(y, (score, -y)) AS bottom FROM je WHERE top > base GROUP BY frame_id) USING (frame_id))"""


_BOTTOM = _bottom("combined")
_SEGMENTS = """WITH seg AS (
  SELECT l_suppkey || '-' || strftime(l_shipdate, '%Y%m') AS frame_id, l_orderkey * 10 + l_linenumber AS idx,
         l_partkey % 200 AS x1, l_orderkey % 100 AS y1,
         CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 200 + l_quantity::BIGINT % 6 ELSE l_partkey % 200 + l_quantity::BIGINT * 2 END AS x2,
         CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey % 100 + l_quantity::BIGINT * 2 ELSE l_orderkey % 100 + l_quantity::BIGINT % 4 END AS y2
  FROM lineitem)"""


_LINES = """SELECT l_suppkey || '-' || strftime(l_shipdate, '%Y') AS frame, l_orderkey * 10 + l_linenumber AS idx, l_partkey % 60 AS x, l_orderkey % 40 AS y,
         l_orderkey % 20 AS high, l_quantity::BIGINT AS n, l_linenumber % 2 = 0 AS upright, l_suppkey % 10 AS kind,
         CASE WHEN l_suppkey % 2 = 0 AND l_orderkey % 40 < 20 THEN 200 ELSE 60 END + l_partkey % 40 AS v,
         CASE WHEN l_quantity::BIGINT >= 40 AND l_suppkey % 10 NOT IN (3, 7) THEN 255 ELSE 0 END AS edge,
         CASE WHEN l_quantity::BIGINT >= 25 AND l_suppkey % 10 <> 7 THEN 255 ELSE 0 END AS edge_relaxed FROM lineitem"""


def _frames(line: str, width: int, height: int, walls: bool, moved: int) -> str:
    """Measurements of frames: pixels of line, all four attempts of each frame, the first with a surface or the last."""
    mx, my = max(3, width // 20), max(2, height // 30)
    return f"""WITH line AS ({line}),
sg AS (SELECT frame, idx, x AS x1, CASE WHEN upright THEN high ELSE y END AS y1, CASE WHEN upright THEN x + n % 4 ELSE x + n % 20 END AS x2,
              CASE WHEN upright THEN least(39, high + n) ELSE y + n % 3 END AS y2, level FROM line, (VALUES (0), (1)) q (level) WHERE {walls} AND kind NOT IN (3, 7) AND (level = 1 OR n >= 35)),
w AS (SELECT frame, level, idx, (x1 + x2) // 2 AS x, least(y1, y2) AS top, greatest(y1, y2) AS bottom FROM sg WHERE y1 <> y2 AND abs(x1 - x2) <= greatest(4, abs(y1 - y2) * 0.09::DOUBLE)),
k AS (SELECT a.frame, a.level, a.x AS l, b.x AS r, greatest(a.top, b.top) AS top, least(a.bottom, b.bottom) AS bottom,
             row_number() OVER (PARTITION BY a.frame, a.level ORDER BY least(a.bottom, b.bottom) - greatest(a.top, b.top) DESC, a.x, a.idx, b.x, b.idx) AS i
      FROM w a JOIN w b USING (frame, level) WHERE b.x - a.x >= 10 AND least(a.bottom, b.bottom) - greatest(a.top, b.top) >= CASE WHEN level = 0 THEN 16 // 2 ELSE floor(40 * 0.4::DOUBLE * 0.6::DOUBLE) // 2 END),
tries AS (SELECT frame, level AS attempt, l, r, top, bottom FROM k WHERE i = 1
          UNION ALL SELECT frame, attempt, {mx}, {width - mx}, {my}, {height - my} FROM (SELECT DISTINCT frame FROM line), (VALUES (2), (3)) q (attempt)),
c AS (SELECT frame || '#' || attempt AS frame_id, frame, attempt, l, r, l + greatest(3, (r - l) // 10) AS first, r - l - 2 * greatest(3, (r - l) // 10) AS wide, top, bottom - top AS n FROM tries),
d AS (SELECT *, first + wide // 4 AS mid, greatest(1, wide // 2) AS half FROM c WHERE wide > 0 AND n > 0),
px AS (SELECT frame_id, y - top AS y, CASE WHEN attempt % 2 = 0 THEN edge ELSE edge_relaxed END AS e, x >= mid AND x < mid + half AS central, v
       FROM d JOIN line USING (frame) WHERE x >= first AND x < first + wide AND y >= top AND y < top + d.n),
pr AS (SELECT frame_id, y, sum(e)::DOUBLE AS e, sum(e) FILTER (central)::DOUBLE AS se, median(v) FILTER (central)::DOUBLE AS v FROM px GROUP BY 1, 2),
al AS (SELECT frame_id, n, unnest(range(n)) AS y FROM d),
p AS (SELECT frame_id, y, n, coalesce(v, 0)::DOUBLE AS v, coalesce(e, 0)::DOUBLE AS e FROM al LEFT JOIN pr USING (frame_id, y)),
ps AS (SELECT frame_id, y, n, coalesce(se, 0)::DOUBLE AS e FROM al LEFT JOIN pr USING (frame_id, y)){_COMBINED.removeprefix(_PROFILE)}, {_bottom("combined", "ps")},
hz AS (SELECT frame_id, arg_max((y1 + y2) // 2 - d.top, (abs(x1 - x2), (y1 + y2) // 2)) AS line
       FROM d JOIN combined USING (frame_id) JOIN sg ON sg.frame = d.frame AND sg.level = d.attempt % 2
       WHERE least(x1, x2) >= mid AND greatest(x1, x2) < mid + half AND half >= 3 AND n >= 3 AND abs(x1 - x2) >= greatest(8, half // 4)
         AND abs(y1 - y2) <= greatest(2, abs(x1 - x2) * 0.03::DOUBLE) AND (y1 + y2) // 2 - d.top > surface + 2 AND (y1 + y2) // 2 - d.top <= n - 1 GROUP BY frame_id),
every AS (SELECT frame, attempt, method, band_top, band_contrast, c.surface, l, r, d.top, coalesce(line, low.bottom) AS low
          FROM d JOIN combined c USING (frame_id) JOIN band USING (frame_id) JOIN low USING (frame_id) LEFT JOIN hz USING (frame_id)
          WHERE c.surface IS NOT NULL OR attempt = 3 QUALIFY row_number() OVER (PARTITION BY frame ORDER BY c.surface IS NULL, attempt) = 1)
SELECT frame AS frame_id, attempt::INT AS attempt, coalesce(method, 'none') AS method, band_top, round_even(band_contrast, 4) AS band_contrast, surface,
       CASE WHEN surface IS NOT NULL THEN l END::INT AS jar_left, CASE WHEN surface IS NOT NULL THEN r END::INT AS jar_right,
       CASE WHEN surface IS NOT NULL THEN top + {moved} END::INT AS jar_top, (top + surface + {moved})::INT AS dough_top,
       CASE WHEN surface IS NOT NULL THEN top + low + {moved} END::INT AS jar_bottom, (low - surface)::INT AS level
FROM (SELECT DISTINCT frame FROM line) LEFT JOIN every USING (frame)"""


_FRAMES = _frames(_LINES, 60, 40, True, 0)
_REGIONS = _frames(f"SELECT * REPLACE (x - 10 AS x, y - 5 AS y) FROM ({_LINES}) WHERE x >= 10 AND x < 55 AND y >= 5 AND y < 35", 45, 30, False, 5)


def _fold(reset: bool, per_minute: float = GATE_PER_MINUTE, session_hours: float = SESSION_HOURS) -> str:
    """The fold, row by row for all series at once: lists hold the last heights and rises."""
    is_reset = "e.event_type = 'error'" if reset else "FALSE"
    return f"""
WITH RECURSIVE o AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, value, row_number() OVER ({_ORDER}) AS rn FROM events),
f AS (
  SELECT NULL::BIGINT AS event_id, user_id, 0::BIGINT AS rn, []::DOUBLE[] AS heights, []::DOUBLE[] AS rises, 0::BIGINT AS n,
         NULL::DOUBLE AS base, 0::BIGINT AS start_us, NULL::DOUBLE AS acc_h, NULL::BIGINT AS acc_us, 0 AS rejects, 0 AS collapses,
         '' AS status, NULL::DOUBLE AS smoothed, NULL::DOUBLE AS rise_raw, FALSE AS new_session, NULL::BIGINT AS session_us, '' AS event_type
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT event_id, user_id, rn,
         CASE WHEN act = 'reset' OR act = 'open' OR act = 'confirmed' THEN [] WHEN act = 'reject' THEN heights ELSE hs END,
         CASE WHEN act IN ('reset', 'open', 'confirmed') THEN [] WHEN act = 'take' THEN list_slice(list_append(rises, rise), -5, -1) ELSE rises END,
         CASE WHEN act IN ('reset', 'open', 'confirmed') THEN 0 WHEN act = 'take' THEN n + 1 ELSE n END,
         CASE WHEN act = 'reset' THEN NULL WHEN act IN ('open', 'confirmed') THEN sm ELSE base END,
         CASE WHEN act = 'reset' THEN 0 WHEN act IN ('open', 'confirmed') THEN us ELSE start_us END,
         CASE WHEN act IN ('reset', 'reject') THEN acc_h ELSE sm END,
         CASE WHEN act IN ('reset', 'reject') THEN acc_us ELSE us END,
         CASE WHEN act = 'reset' THEN rejects WHEN act = 'reject' THEN rejects + 1 ELSE 0 END,
         CASE WHEN act = 'collapse' THEN collapses + 1 WHEN act = 'reject' THEN collapses ELSE 0 END,
         CASE act WHEN 'reject' THEN 'no_reading:implausible' WHEN 'collapse' THEN 'no_reading:collapse' ELSE 'ok' END,
         CASE WHEN act IN ('reset', 'reject') THEN NULL ELSE sm END,
         CASE WHEN act IN ('reset', 'reject') THEN NULL WHEN act IN ('open', 'confirmed') THEN 0.0 ELSE rise END,
         act IN ('reset', 'open', 'confirmed'),
         CASE WHEN act IN ('open', 'confirmed') THEN us WHEN act = 'take' THEN start_us END, event_type
  FROM (
    SELECT *, CASE WHEN is_reset THEN 'reset' WHEN gated AND rejects < 2 THEN 'reject' WHEN NOT active THEN 'open'
                   WHEN n >= 5 AND recent > 20 AND rise < recent * 0.75::DOUBLE THEN CASE WHEN collapses + 1 < 3 THEN 'collapse' ELSE 'confirmed' END
                   ELSE 'take' END AS act
    FROM (
      SELECT *, CASE WHEN base <> 0 THEN (sm - base) / base * 100.0::DOUBLE ELSE 'NaN'::DOUBLE END AS rise, list_median(rises) AS recent
      FROM (
        SELECT *, list_median(hs) AS sm, active AND acc_h IS NOT NULL AND ((us - acc_us) <= 0 OR abs(value - acc_h) > {per_minute}::DOUBLE * ((us - acc_us) / 60000000.0::DOUBLE) + {GATE_JITTER}::DOUBLE) AS gated
        FROM (
          SELECT e.event_id, f.user_id, e.rn, e.us, e.value, e.event_type, {is_reset} AS is_reset, f.heights, f.rises, f.n, f.base, f.start_us, f.acc_h, f.acc_us, f.rejects, f.collapses,
                 list_slice(list_append(f.heights, e.value), -5, -1) AS hs,
                 f.base IS NOT NULL AND NOT (f.n > 0 AND (e.us - f.start_us) / 3600000000.0::DOUBLE > {session_hours}) AS active
          FROM f JOIN o e ON e.user_id = f.user_id AND e.rn = f.rn + 1)))))"""


def _blur(value: str, line: str, along: str) -> str:
    w = f"OVER (PARTITION BY frame_id, {line} ORDER BY {along})"
    return f"""(coalesce(lag({value}, 2) {w}, CASE WHEN lag({value}) {w} IS NULL THEN lead({value}, 2) {w} ELSE {value} END)
  + 4.0::DOUBLE * coalesce(lag({value}) {w}, lead({value}) {w}) + 6.0::DOUBLE * {value} + 4.0::DOUBLE * coalesce(lead({value}) {w}, lag({value}) {w})
  + coalesce(lead({value}, 2) {w}, CASE WHEN lead({value}) {w} IS NULL THEN lag({value}, 2) {w} ELSE {value} END)) / 16.0::DOUBLE"""


_SLOPES = f"""{_fold(False)},
t AS (SELECT *, (acc_us - session_us) / 3600000000.0::DOUBLE AS h FROM f WHERE rn > 0 AND status = 'ok' AND NOT new_session),
sl AS (SELECT event_id, user_id, session_us, acc_us, CASE WHEN count(*) OVER q >= 4 THEN regr_slope(rise_raw, h) OVER q END AS slope, max(rise_raw) OVER s AS top
       FROM t WINDOW q AS (PARTITION BY user_id, session_us ORDER BY acc_us RANGE {round(SLOPE_MINUTES * 60_000_000)} PRECEDING), s AS (PARTITION BY user_id, session_us ORDER BY acc_us)),
x AS (SELECT event_id, count(*) OVER l >= 3 AND bool_and(slope <= 0.5) OVER l AND top >= 25 AS now FROM sl WHERE slope IS NOT NULL
      WINDOW l AS (PARTITION BY user_id, session_us ORDER BY acc_us ROWS 2 PRECEDING)),
y AS (SELECT sl.event_id, slope, bool_or(coalesce(now, FALSE)) OVER (PARTITION BY user_id, session_us ORDER BY acc_us) AS peaked FROM sl LEFT JOIN x USING (event_id))"""
_STATUS = f"""{_fold(False)},
r AS (SELECT f.*, e.ts FROM f JOIN events e ON e.event_id = f.event_id WHERE rn > 0)
SELECT 'monitor/' || user_id || CASE WHEN status = 'ok' THEN '/state' ELSE '/measurement_status' END AS topic, status <> 'ok' AS "none", status = 'ok' AS retain,
       CASE WHEN status = 'ok' THEN CASE WHEN new_session THEN 0.0::DOUBLE ELSE round_even(greatest(0, least(500, rise_raw)), 1) END END AS rise_percent,
       CASE WHEN status = 'ok' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' END AS last_update FROM r"""


_GRAY = "SELECT vec_id AS frame_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings"


def _at(dx: int, dy: int) -> str:
    """The pixel beside (x, y) of a frame of 8 by 8 in the list e; beyond the border the last one repeats."""
    return f"e[least(7, greatest(0, y + {dy})) * 8 + least(7, greatest(0, x + {dx})) + 1]"


def _strength(dx: int, dy: int) -> str:
    return f"CASE WHEN x + {dx} BETWEEN 0 AND 7 AND y + {dy} BETWEEN 0 AND 7 THEN ms[(y + {dy}) * 8 + x + {dx} + 1] ELSE 0 END"


_GX = f"({_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)})"
_GY = f"({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)})"
_EDGES = f"""WITH RECURSIVE f AS ({_GRAY}),
p AS (SELECT frame_id, e, unnest(range(64)) % 8 AS x, unnest(range(64)) // 8 AS y FROM f),
g AS (SELECT frame_id, x, y, {_GX} AS gx, {_GY} AS gy FROM p),
l AS (SELECT frame_id, list(abs(gx) + abs(gy) ORDER BY y, x) AS ms FROM g GROUP BY frame_id),
n AS (SELECT frame_id, x, y, abs(gx) + abs(gy) AS m,
        CASE WHEN abs(gy) < abs(gx) * 0.41421356237309503::DOUBLE THEN abs(gx) + abs(gy) > {_strength(-1, 0)} AND abs(gx) + abs(gy) >= {_strength(1, 0)}
             WHEN abs(gy) > abs(gx) * 2.41421356237309503::DOUBLE THEN abs(gx) + abs(gy) > {_strength(0, -1)} AND abs(gx) + abs(gy) >= {_strength(0, 1)}
             WHEN (gx >= 0) = (gy >= 0) THEN abs(gx) + abs(gy) > {_strength(-1, -1)} AND abs(gx) + abs(gy) > {_strength(1, 1)}
             ELSE abs(gx) + abs(gy) > {_strength(1, -1)} AND abs(gx) + abs(gy) > {_strength(-1, 1)} END AS across FROM g JOIN l USING (frame_id)),
c AS (SELECT frame_id, x, y, m FROM n WHERE across AND m > 140),
r AS (SELECT frame_id, x, y FROM c WHERE m > 280 UNION SELECT c.frame_id, c.x, c.y FROM r JOIN c ON c.frame_id = r.frame_id AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1)
SELECT frame_id, x, y FROM r"""
_HOUGH = f"""WITH f AS ({_GRAY}),
p AS (SELECT frame_id, unnest(range(64)) % 8 AS x, unnest(range(64)) // 8 AS y, unnest(e) AS v FROM f),
k AS (SELECT a AS angle, round(cos(pi() * a / 180) * 65536)::BIGINT AS c, round(sin(pi() * a / 180) * 65536)::BIGINT AS s FROM (SELECT unnest(range(180)) AS a)),
d AS (SELECT frame_id, x, y, angle, (x * c + y * s + 32768) >> 16 AS dist, (y * c - x * s + 32768) >> 16 AS t FROM p, k WHERE v > 10),
q AS (SELECT frame_id, angle, dist, count(*) AS votes FROM d GROUP BY 1, 2, 3 HAVING count(*) >= 5),
b AS (SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM q o WHERE o.frame_id = q.frame_id AND abs(o.angle - q.angle) <= 1 AND abs(o.dist - q.dist) <= 1 AND (o.votes, -o.angle, -o.dist) > (q.votes, -q.angle, -q.dist))),
o AS (SELECT d.*, coalesce((t - lag(t) OVER w > 1)::INT, 1) AS fresh FROM d JOIN b USING (frame_id, angle, dist) WINDOW w AS (PARTITION BY frame_id, angle, dist ORDER BY t, x, y)),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY frame_id, angle, dist ORDER BY t, x, y) AS run FROM o),
e AS (SELECT frame_id, angle, dist, run, arg_min(x, (t, x, y)) AS x1, arg_min(y, (t, x, y)) AS y1, arg_max(x, (t, x, y)) AS x2, arg_max(y, (t, x, y)) AS y2 FROM u GROUP BY 1, 2, 3, 4)
SELECT frame_id, ((angle * 1048576 + dist + 524288) * 1048576 + run)::BIGINT AS idx, x1::INT AS x1, y1::INT AS y1, x2::INT AS x2, y2::INT AS y2 FROM e WHERE greatest(abs(x2 - x1), abs(y2 - y1)) >= 4"""


def oracle_sql() -> dict[str, str]:
    return {
        "rolling_median": f"SELECT event_id, round_even(smoothed, 4) AS smoothed FROM ({_SMOOTH})",
        "rise_percent": f"""{_RISEN}
SELECT event_id, user_id, ts, round_even(smoothed, 4) AS smoothed, round_even(rise, 4) AS rise_raw,
       CASE WHEN rise IS NOT NULL THEN round_even(greatest(0, least(500, rise)), 1) END AS rise_percent,
       round_even(CASE WHEN count(*) OVER q >= 4 THEN greatest(-100, least(500, regr_slope(rise, h) OVER q)) END, 4) AS rise_rate
FROM r WINDOW q AS ({_FRAME})""",
        "window_slope": f"""WITH r AS (SELECT *, epoch_us(ts) AS us, (epoch_us(ts) - first_value(epoch_us(ts)) OVER ({_ORDER})) / 3600000000.0 AS h FROM events)
SELECT event_id, round_even(CASE WHEN count(*) OVER q >= 4 THEN regr_slope(value, h) OVER q END, 4) AS slope FROM r WINDOW q AS ({_FRAME})""",
        "lag_gate": f"""SELECT event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) <= 0
  OR abs(value - lag(value) OVER w) > {GATE_PER_MINUTE}::DOUBLE * ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0::DOUBLE) + {GATE_JITTER}::DOUBLE, FALSE) AS implausible
FROM events WINDOW w AS ({_ORDER})""",
        "collapse_candidates": f"""{_RISEN},
c AS (SELECT *, CASE WHEN count(rise) OVER q >= 5 THEN median(rise) OVER q END AS m FROM r WINDOW q AS ({_ORDER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
SELECT event_id, round_even(m, 4) AS recent_median, coalesce(m > 20 AND rise < m * 0.75::DOUBLE, FALSE) AS collapse FROM c""",
        "flat_run_peak": f"""{_RISEN},
sl AS (SELECT *, round_even(CASE WHEN count(*) OVER q >= 4 THEN regr_slope(rise, h) OVER q END, 6) AS slope, max(rise) OVER ({_ORDER}) AS top FROM r WINDOW q AS ({_FRAME})),
x AS (SELECT *, count(*) OVER l >= 3 AND bool_and(slope <= 0.5) OVER l AND top >= 25 AS now FROM sl WHERE slope IS NOT NULL WINDOW l AS ({_ORDER} ROWS 2 PRECEDING))
SELECT event_id, bool_or(now) OVER ({_ORDER}) AS peaked FROM x""",
        "peak_forecast": """WITH per AS (SELECT user_id, min(ts) AS start, max(value) * 1.2::DOUBLE AS lim, 0.01::DOUBLE AS rate, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0::DOUBLE / 2 AS middle FROM events GROUP BY user_id),
s AS (SELECT user_id, any_value(start) AS start, any_value(lim) AS lim, any_value(rate) AS rate, any_value(middle) AS middle,
             sum(pow(lim / (1.0::DOUBLE + exp(-rate * ((epoch_us(ts) - epoch_us(start)) / 3600000000.0::DOUBLE - middle))) - value, 2)) AS sse
      FROM events JOIN per USING (user_id) GROUP BY user_id)
SELECT user_id, round_even(greatest(0, least(500, lim * 0.97::DOUBLE)), 0) AS predicted_peak, round_even(middle - ln(1.0::DOUBLE / 0.97::DOUBLE - 1.0) / rate, 6) AS eta_hours,
       date_trunc('second', make_timestamp(epoch_us(start) + round_even((middle - ln(1.0::DOUBLE / 0.97::DOUBLE - 1.0) / rate) * 3600000000.0::DOUBLE, 0)::BIGINT)) AS peak_eta,
       round_even(sse, 2) AS sse FROM s""",
        "moving_average": f"{_PROFILE} SELECT frame_id, y::INT AS y, round_even({_smooth('v', 7)}, 4) AS m FROM p",
        "moving_average_blocks": f"{_PROFILE} SELECT frame_id, y::INT AS y, round_even({_smooth('v', 7)}, 4) AS m FROM p",
        "step_contrast": f"""{_PROFILE}, q AS (SELECT *, sum(v) OVER (PARTITION BY frame_id ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above, sum(v) OVER (PARTITION BY frame_id) AS total FROM p)
SELECT frame_id, y::INT AS y, round_even(above / y - (total - above) / (n - y), 4) AS step FROM q WHERE y > 0""",
        "moving_average_embeddings": f"""WITH p AS (SELECT vec_id AS frame_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS y FROM embeddings)
SELECT frame_id AS vec_id, y, round_even({_smooth('v', 5)}, 6) AS m FROM p""",
        "edge_surface": f"{_EDGE} SELECT frame_id, surface FROM edge",
        "band_top": f"{_PROFILE}, {_BAND} SELECT frame_id, band_top, round_even(band_contrast, 4) AS band_contrast FROM band",
        "combined_surface": f"{_COMBINED} SELECT frame_id, surface, method FROM combined",
        "bottom_from_energy": f"{_EDGE}, {_bottom('edge')} SELECT frame_id, bottom FROM low",
        "row_reductions": "SELECT l_orderkey AS y, round_even(sum(l_quantity), 2) AS row_sum, round_even(median(l_quantity), 2) AS row_median FROM lineitem GROUP BY l_orderkey",
        "histogram_median": """WITH h AS (SELECT l_suppkey AS frame_id, (l_quantity * 5)::INT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY frame_id ORDER BY bin) AS so_far, sum(n) OVER (PARTITION BY frame_id) AS total FROM h WHERE bin BETWEEN 0 AND 255),
m AS (SELECT frame_id, coalesce(min(bin) FILTER (so_far >= total / 2), 128) AS median_bin FROM r GROUP BY frame_id)
SELECT frame_id, median_bin, round_even(greatest(10.0, median_bin * 0.66::DOUBLE * 0.6::DOUBLE), 4) AS lower,
       round_even(greatest(greatest(10.0, median_bin * 0.66::DOUBLE * 0.6::DOUBLE) + 20.0, median_bin * 1.33::DOUBLE), 4) AS upper FROM m""",
        "blurred_energy": f"""WITH q AS (SELECT vec_id AS frame_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding)))::INT AS i FROM embeddings),
p AS (SELECT frame_id, i % 8 AS x, i // 8 AS y, v FROM q), b1 AS (SELECT *, {_blur('v', 'y', 'x')} AS b FROM p), b2 AS (SELECT frame_id, x, y, {_blur('b', 'x', 'y')} AS s FROM b1),
d AS (SELECT frame_id, y, abs(coalesce(lead(s) OVER c, s) - coalesce(lag(s) OVER c, s)) AS e FROM b2 WINDOW c AS (PARTITION BY frame_id, x ORDER BY y))
SELECT frame_id, y, round_even(sum(e), 6) AS energy FROM d GROUP BY frame_id, y""",
        "edge_pixels": _EDGES,
        "hough_segments": _HOUGH,
        "wall_pairs": f"""{_SEGMENTS},
w AS (SELECT frame_id, idx, ((x1 + x2) // 2)::INT AS x, least(y1, y2) AS top, greatest(y1, y2) AS bottom FROM seg WHERE abs(y1 - y2) > 0 AND abs(x1 - x2) <= greatest(4, abs(y1 - y2) * 0.09::DOUBLE)),
j AS (SELECT a.frame_id, a.x AS "left", b.x AS "right", greatest(a.top, b.top) AS top, least(a.bottom, b.bottom) AS bottom, a.idx AS ia, b.idx AS ib FROM w a JOIN w b USING (frame_id) WHERE b.x - a.x >= 10),
k AS (SELECT *, bottom - top AS overlap, row_number() OVER (PARTITION BY frame_id ORDER BY bottom - top DESC, "left", ia, "right", ib) AS i FROM j WHERE bottom - top >= 8)
SELECT frame_id, "left", "right", top, bottom, overlap FROM k WHERE i = 1""",
        "lowest_horizontal": f"""{_SEGMENTS},
h AS (SELECT frame_id, ((y1 + y2) // 2)::INT AS y, abs(x1 - x2) AS length FROM seg WHERE abs(x1 - x2) > 0 AND abs(y1 - y2) <= greatest(2, abs(x1 - x2) * 0.03::DOUBLE))
SELECT frame_id, arg_max(y, (length, y)) AS bottom FROM h WHERE y > 12 AND y <= 90 GROUP BY frame_id""",
        "measured_frames": _FRAMES,
        "measured_regions": _REGIONS,
        "frame_cycle": f"""WITH RECURSIVE m AS ({_FRAMES}),
events AS (SELECT row_number() OVER () AS event_id, split_part(frame_id, '-', 1)::BIGINT AS user_id, make_timestamp(split_part(frame_id, '-', 2)::BIGINT, 1, 1, 0, 0, 0.0) AS ts, level::DOUBLE AS value, '' AS event_type
           FROM m WHERE level IS NOT NULL),
{_fold(False, 1e9, 87_660).replace("WITH RECURSIVE ", "", 1).lstrip()}
SELECT 'monitor/' || user_id || CASE WHEN status = 'ok' THEN '/state' ELSE '/measurement_status' END AS topic,
       CASE WHEN status = 'ok' THEN CASE WHEN new_session THEN 0.0::DOUBLE ELSE round_even(greatest(0, least(500, rise_raw)), 1) END::VARCHAR ELSE 'none' END AS shown, status = 'ok' AS retain FROM f WHERE rn > 0
UNION ALL SELECT 'monitor/' || split_part(frame_id, '-', 1) || '/measurement_status', 'none', FALSE FROM m WHERE level IS NULL
UNION ALL SELECT 'monitor/' || frame_id || '/diagnostics', concat_ws(' ', method, round_even(coalesce(band_contrast, 0), 0)::INT, coalesce(band_top::VARCHAR, '-'), coalesce(surface::VARCHAR, '-'), coalesce(dough_top::VARCHAR, '-'),
       coalesce(jar_bottom::VARCHAR, '-'), coalesce((jar_bottom - jar_top)::VARCHAR, '-'), coalesce((jar_bottom - dough_top)::VARCHAR, '-')), TRUE FROM m""",
        "rise_fold": f"""{_fold(False)}
SELECT event_id, user_id, status, round_even(smoothed, 4) AS smoothed, round_even(rise_raw, 4) AS rise_raw, new_session, make_timestamp(session_us) AS session_start FROM f WHERE rn > 0""",
        "rise_stream": f"""{_fold(False)}
SELECT user_id AS series_id, (SELECT ts FROM events e WHERE e.event_id = f.event_id) AS ts, status, round_even(smoothed, 4) AS smoothed, round_even(rise_raw, 4) AS rise_raw, new_session FROM f WHERE rn > 0""",
        "rise_resets": f"""{_fold(True)}
SELECT event_id, event_type, status, new_session, CASE WHEN status = 'ok' THEN CASE WHEN new_session THEN 0.0::DOUBLE ELSE round_even(greatest(0, least(500, rise_raw)), 1) END END AS rise_percent FROM f WHERE rn > 0""",
        "rise_slopes": f"""{_SLOPES}
SELECT f.event_id, status, CASE WHEN slope IS NOT NULL THEN round_even(greatest(-100, least(500, slope)), 1) END AS rise_rate, coalesce(peaked, FALSE) AS peaked, new_session, make_timestamp(session_us) AS session_start
FROM f LEFT JOIN y ON y.event_id = f.event_id WHERE rn > 0""",
        "fit_check": """WITH c AS (SELECT user_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 60 / 3600000000.0::DOUBLE AS h,
  sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) / sum(value) OVER (PARTITION BY user_id) * 100.0::DOUBLE AS y FROM events),
s AS (SELECT user_id, count(*) AS samples, max(y) AS top, greatest(max(y) * 1.5::DOUBLE, 30) AS lim, greatest(max(h), 1) AS middle FROM c GROUP BY user_id)
SELECT user_id, samples, samples >= 5 AND top >= 5 AS fittable, round_even(sse, 2) AS start_sse, TRUE AS better, TRUE AS "level", TRUE AS lowest, TRUE AS error_holds
FROM s JOIN (SELECT user_id, sum(pow(lim / (1.0::DOUBLE + exp(-(h - middle))) - y, 2)) AS sse FROM c JOIN s USING (user_id) GROUP BY user_id) USING (user_id)""",
        "fitted_latch": f"""{_SLOPES},
g AS (SELECT event_id, count(*) OVER s AS samples, max(rise_raw) OVER s AS top FROM t WINDOW s AS (PARTITION BY user_id, session_us ORDER BY acc_us))
SELECT event_id, samples, samples >= 8 AND top >= 5 AS gate, TRUE AS "within", TRUE AS latch, coalesce(peaked, FALSE) AS without_fit, TRUE AS at_least FROM g JOIN y USING (event_id)""",
        "rise_restored": f"""{_fold(False)},
r AS (SELECT f.*, e.ts FROM f JOIN events e ON e.event_id = f.event_id WHERE rn > 0)
SELECT user_id AS series_id, ts, status, round_even(smoothed, 4) AS smoothed, round_even(rise_raw, 4) AS rise_raw, new_session FROM r
WHERE epoch_us(ts) >= (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events)""",
        "reading_status": _STATUS,
        "sent_messages": _STATUS,
        "snapshot_stream": "SELECT page_id, strlen(coalesce(html, ''))::BIGINT + 1 AS bytes, sha256(coalesce(html, '') || chr(10)) AS sha256, 1 AS attempts FROM pages",
        "debug_messages": f"""{_COMBINED}, {_BOTTOM},
m AS (SELECT frame_id, c.surface, method, band_top, band_contrast, bottom FROM combined c JOIN band USING (frame_id) JOIN low USING (frame_id))
SELECT 'monitor_' || frame_id || '/diagnostics' AS topic, TRUE AS retain, method, round_even(band_contrast, 0)::INT AS band_contrast, band_top AS band_top_row, surface AS final_row,
       surface + 10 AS dough_top_px, CASE WHEN surface IS NOT NULL THEN bottom + 10 END AS jar_bottom_px, CASE WHEN surface IS NOT NULL THEN bottom END AS jar_height_px,
       bottom - surface AS dough_height_px FROM m""",
        "debug_discovery": """WITH d AS (SELECT DISTINCT 'monitor_' || user_id AS d FROM events),
k(kind, key, source, unit, category, field) AS (VALUES ('camera', 'debug_image', 'debug_image', NULL, NULL, NULL), ('sensor', 'detection_method', 'diagnostics', NULL, 'diagnostic', 'method'),
  ('sensor', 'band_contrast', 'diagnostics', NULL, 'diagnostic', 'band_contrast'), ('sensor', 'dough_top_px', 'diagnostics', 'px', 'diagnostic', 'dough_top_px'),
  ('sensor', 'jar_bottom_px', 'diagnostics', 'px', 'diagnostic', 'jar_bottom_px'), ('sensor', 'jar_height_px', 'diagnostics', 'px', 'diagnostic', 'jar_height_px'),
  ('sensor', 'dough_height_px', 'diagnostics', 'px', 'diagnostic', 'dough_height_px'))
SELECT 'homeassistant/' || kind || '/' || d || '/' || key || '/config' AS topic, d || '/' || source AS source, d || '_' || key AS unique_id, unit AS unit_of_measurement, category AS entity_category,
       CASE WHEN field IS NOT NULL THEN '{{ value_json.' || field || ' }}' END AS value_template, TRUE AS retain FROM d, k""",
        "reading_json": f"""{_RISEN}
SELECT 'monitor/' || user_id || '/state' AS topic, TRUE AS retain, CASE WHEN rise IS NOT NULL THEN round_even(greatest(0, least(500, rise)), 1) END AS rise_percent, NULL::DOUBLE AS rise_rate,
       CASE WHEN rise > 400 THEN 'ON' ELSE 'OFF' END AS peaked, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS last_update FROM r""",
        "discovery": """WITH d AS (SELECT DISTINCT 'monitor_' || user_id AS d FROM events),
k(kind, key, device_class) AS (VALUES ('sensor', 'rise_percent', NULL), ('sensor', 'rise_rate', NULL), ('sensor', 'predicted_peak_percent', NULL),
  ('sensor', 'peak_eta', 'timestamp'), ('sensor', 'session_start', 'timestamp'), ('binary_sensor', 'peaked', NULL), ('button', 'reset', NULL))
SELECT 'homeassistant/' || kind || '/' || d || '/' || key || '/config' AS topic, d || '_' || key AS unique_id, device_class, TRUE AS retain FROM d, k""",
        "snapshot_urls": """SELECT page_id, CASE WHEN page_id % 3 = 0 AND trim(url) <> '' THEN url WHEN page_id % 2 = 0 THEN 'http://proxy/snapshot'
  WHEN page_id % 5 <> 0 THEN 'http://cam' || (page_id % 7) || '/api/jar/latest.jpg?quality=90&height=1080&width=1920' END AS snapshot_url FROM pages""",
        "state_import": """SELECT user_id, CASE WHEN user_id % 10 = 0 THEN 0 ELSE count(*) END AS n_samples,
  CASE WHEN user_id % 10 <> 0 THEN round_even(arg_min(value, ts), 4) END AS baseline, CASE WHEN user_id % 10 <> 0 THEN min(ts) END AS session_start FROM events GROUP BY user_id""",
        "retention": "SELECT event_id, ts FROM events WHERE (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 3600000000.0 > 48.0",
        "rotating_log": f"""{_COMBINED}
SELECT strftime(make_timestamp(frame_id * 86400000000), '%Y%m%d') AS day, (frame_id % 2)::INT AS batch, strftime(make_timestamp(frame_id * 86400000000), '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS time, method, surface AS final_row FROM combined""",
        "diagnostics_lines": f"""WITH m AS ({_FRAMES}), t AS (SELECT *, make_timestamp(split_part(frame_id, '-', 2)::BIGINT, 2, 3, 4, 5, 6.5) AS ts FROM m)
SELECT strftime(ts, '%Y%m%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS time, frame_id || '.jpg' AS image, method, band_contrast, band_top AS band_top_row, surface AS final_row,
       jar_left AS jar_left_px, jar_right AS jar_right_px, jar_top AS jar_top_px, dough_top AS dough_top_px, jar_bottom AS jar_bottom_px, (jar_bottom - 20)::INT AS session_start_surface_px FROM t""",
    }
