"""SQL with the results of the queries, for another engine: in long form, from rows by pixel and year."""

from __future__ import annotations

import uuid

from terrachron.functions.dims import ARCHETYPES, CLASS_TO_STATE, SECOND_TO_STATE, STATES
from terrachron.functions.geo import A, BANDS, FLAT, K0

P, MIN_OBSERVED, BLOCK, SPOTS = 2, 4, 10, 5
KEY = "region, r, c"


def case(col: str, table: dict, other: str = "0") -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN {value(v)}" for k, v in table.items()) + f" ELSE {other} END"


NAME = {k: v for k, v in STATES.items()}
NAMES = "names(state, name) AS (VALUES " + ", ".join(f"({k}, '{v}')" for k, v in STATES.items()) + ")"

OBS = """
n AS (SELECT l_partkey k, year(l_shipdate) y, count(*) cnt, CAST(sum(l_linenumber) AS BIGINT) s FROM lineitem GROUP BY 1, 2),
yy AS (SELECT DISTINCT year(l_shipdate) y FROM lineitem),
g AS (SELECT p_partkey k, CAST(floor(p_partkey / 50.0) AS INT) r, CAST(p_partkey % 50 AS INT) c, y FROM part CROSS JOIN yy),
b AS (SELECT g.k, g.r, g.c, g.y, coalesce(cnt, 0) cnt, coalesce(s, 0) s,
  CAST((floor(r / 8.0) + floor(c / 8.0)) % 8 AS INT) a, CAST((floor(r / 8.0) * 3 + floor(c / 8.0) + 3) % 8 AS INT) b,
  CAST(1995 + (floor(r / 4.0) * 2 + floor(c / 4.0)) % 9 AS INT) t0
  FROM g LEFT JOIN n ON g.k = n.k AND g.y = n.y),
z AS (SELECT *, CASE WHEN cnt = 0 OR (k % 97 = 0 AND y < 1999) THEN -1 WHEN cnt % 11 = 0 THEN -2 WHEN cnt % 7 = 0 THEN CAST(s % 8 AS INT) WHEN y >= t0 THEN b ELSE a END ix FROM b),
obs AS (SELECT CAST(floor(r / 20.0) AS INT) region, CAST(r - 20 * floor(r / 20.0) AS INT) r, c, CAST(y AS INT) AS year,
  CASE ix WHEN -1 THEN 0 WHEN -2 THEN 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 5 WHEN 4 THEN 7 WHEN 5 THEN 8 WHEN 6 THEN 9 ELSE 11 END AS src FROM z)"""
OBS2 = (
    OBS
    + """,
obs2 AS (SELECT region, r, c, year, CASE WHEN src IN (0, 10) THEN 0 WHEN ((r + 20 * region) * 7 + c * 3 + year) % 5 = 0 THEN 30
  WHEN src = 1 THEN 80 WHEN src IN (2, 4, 11) THEN 30 WHEN src = 5 THEN 40 WHEN src = 7 THEN 50 WHEN src = 8 THEN 60 WHEN src = 9 THEN 70 ELSE 0 END AS src
  FROM obs WHERE year IN (1998, 1999))"""
)
ST = OBS + f", st AS (SELECT {KEY}, year, {case('src', CLASS_TO_STATE)} AS s FROM obs)"
ST2 = OBS2 + f", st AS (SELECT {KEY}, year, {case('src', CLASS_TO_STATE)} AS s FROM obs), st2 AS (SELECT {KEY}, year, {case('src', SECOND_TO_STATE)} AS s FROM obs2)"


def events(source: str = "st", x: str = "") -> str:
    """CTE ev: facts of each pixel from the long table ``source``."""
    return f"""
lim{x} AS (SELECT min(year) y0, max(year) y1 FROM {source}),
last{x} AS (SELECT {KEY}, s AS fin FROM {source}, lim{x} WHERE year = y1),
br{x} AS (SELECT {KEY}, any_value(fin) fin, coalesce(max(year) FILTER (WHERE s <> fin OR s = 0), any_value(y0) - 1) lb, count(*) FILTER (WHERE s <> 0) observed,
  coalesce(arg_min(s, year) FILTER (WHERE s <> 0), 0) first_state, any_value(y1) y1, any_value(y1 - y0 + 1) t
  FROM {source} JOIN last{x} USING ({KEY}), lim{x} GROUP BY {KEY}),
pc{x} AS (SELECT {KEY}, s, count(*) k FROM {source} JOIN br{x} USING ({KEY}) WHERE year <= lb AND s <> 0 GROUP BY {KEY}, s),
pm{x} AS (SELECT {KEY}, arg_min(s, (-k, s)) fr, max(k) nm, sum(k) np FROM pc{x} GROUP BY {KEY}),
e0{x} AS (SELECT br{x}.*, CAST(y1 - lb AS INT) trail, coalesce(fr, 0) fr, coalesce(nm, 0) nm, coalesce(np, 0) np, coalesce(k, 0) nf
  FROM br{x} LEFT JOIN pm{x} USING ({KEY}) LEFT JOIN pc{x} ON pc{x}.region = br{x}.region AND pc{x}.r = br{x}.r AND pc{x}.c = br{x}.c AND pc{x}.s = br{x}.fin),
e1{x} AS (SELECT *, (fin <> 0 AND trail >= {P} AND trail < observed AND fr <> 0 AND fr <> fin AND nm > nf AND observed >= {MIN_OBSERVED}) AS event FROM e0{x}),
pu{x} AS (SELECT {KEY}, count(*) k FROM {source} JOIN e1{x} USING ({KEY}) WHERE event AND s IN (fr, fin) GROUP BY {KEY}),
ev{x} AS (SELECT e1{x}.region, e1{x}.r, e1{x}.c, observed, fin, trail, first_state, t, event, CASE WHEN event THEN lb + 1 ELSE 0 END yoc, CASE WHEN event THEN fr ELSE 0 END from_state,
  CASE WHEN event THEN fin ELSE 0 END to_state, CASE WHEN event THEN nm / np ELSE 0 END pre_mode_frac, CASE WHEN event THEN k / observed ELSE 0 END purity
  FROM e1{x} LEFT JOIN pu{x} USING ({KEY}))"""


EV = ST + ", " + events()
TR = (
    EV
    + f""",
seen AS (SELECT *, lag(s) OVER (PARTITION BY {KEY} ORDER BY year) AS ls FROM st WHERE s <> 0),
runs AS (SELECT {KEY}, s, row_number() OVER (PARTITION BY {KEY} ORDER BY year) rn, count(*) OVER (PARTITION BY {KEY}) m FROM seen WHERE ls IS NULL OR ls <> s),
sg AS (SELECT {KEY}, CAST(sum(s * 8 ** (m - rn)) AS BIGINT) sig, count(*) - 1 switches FROM runs GROUP BY {KEY}),
ns AS (SELECT {KEY}, count(*) n_states, max(k) mk FROM (SELECT {KEY}, s, count(*) k FROM st WHERE s <> 0 GROUP BY {KEY}, s) GROUP BY {KEY}),
t0 AS (SELECT ev.*, coalesce(sig, 0) sig, coalesce(switches, 0) switches, coalesce(n_states, 0) n_states, observed - coalesce(mk, 0) excursion
  FROM ev LEFT JOIN sg USING ({KEY}) LEFT JOIN ns USING ({KEY})),
px AS (SELECT *, CASE WHEN observed < {MIN_OBSERVED} THEN 0 WHEN switches = 0 THEN 1 WHEN event AND switches >= 3 THEN 8 WHEN event AND switches = 2 AND n_states = 2 THEN 3
  WHEN event AND switches = 2 AND n_states = 3 THEN 4 WHEN event AND switches = 1 THEN 3
  WHEN NOT event AND fin <> 0 AND fin = first_state AND switches = 2 THEN CASE WHEN excursion < 2 THEN 2 ELSE 5 END
  WHEN switches >= 3 AND n_states = 2 AND NOT event THEN 6 ELSE 7 END archetype FROM t0)"""
)


def scores(x: str = "", base: str = "px") -> str:
    return f"""
gr{x} AS (SELECT region, max(r) + 1 h, max(c) + 1 w FROM st GROUP BY 1),
sp{x} AS (SELECT a.region, a.r, a.c, a.to_state, count(b.r) neighbours FROM {base} a LEFT JOIN {base} b ON a.region = b.region AND b.event AND a.to_state = b.to_state
  AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 AND (a.r <> b.r OR a.c <> b.c) WHERE a.event GROUP BY ALL),
sp2{x} AS (SELECT sp{x}.*, (3 - CAST(r = 0 AS INT) - CAST(r = h - 1 AS INT)) * (3 - CAST(c = 0 AS INT) - CAST(c = w - 1 AS INT)) - 1 AS inside FROM sp{x} JOIN gr{x} USING (region)),
sup{x} AS (SELECT *, CASE WHEN inside > 0 THEN neighbours / inside ELSE 0 END support FROM sp2{x}),
sc0{x} AS (SELECT p.*, CASE WHEN event THEN least(trail / least({P} + 2, t - 1), CAST(1 AS DOUBLE)) * CAST(0.3 AS DOUBLE) + pre_mode_frac * CAST(0.2 AS DOUBLE) + purity * CAST(0.2 AS DOUBLE) + support * CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END score
  FROM {base} p LEFT JOIN sup{x} USING ({KEY})),
sc{x} AS (SELECT *, CASE WHEN NOT event THEN 0 WHEN score >= CAST(0.75 AS DOUBLE) - 1e-9 THEN 3 WHEN score >= CAST(0.5 AS DOUBLE) - 1e-9 THEN 2 ELSE 1 END tier FROM sc0{x})"""


SC = TR + ", " + scores()
SIG = f""",
hist AS (SELECT region, sig, any_value(n_states) states, count(*) pixels, sum(count(*)) OVER (PARTITION BY region) total FROM px WHERE observed >= {MIN_OBSERVED} GROUP BY region, sig),
rare0 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY pixels, sig) rank, sum(pixels) OVER (PARTITION BY region ORDER BY pixels, sig ROWS UNBOUNDED PRECEDING) so_far
  FROM hist WHERE states >= 2 AND pixels / total < CAST(0.005 AS DOUBLE)),
rare AS (SELECT * FROM rare0 WHERE rank = 1 OR so_far <= floor(total * CAST(0.02 AS DOUBLE)))"""
AN = SC + SIG + f", pa AS (SELECT sc.*, (rare.sig IS NOT NULL AND observed >= {MIN_OBSERVED}) AS anomaly FROM sc LEFT JOIN rare USING (region, sig))"
VOL = ", vol AS (SELECT region, yoc, from_state, to_state, count(*) pixels FROM ev WHERE event GROUP BY ALL)"
PEAK = ", py AS (SELECT region, yoc, sum(pixels) k FROM vol GROUP BY ALL), pk AS (SELECT region, arg_min(yoc, (-k, yoc)) y FROM py GROUP BY 1)"
TREND = f", {NAMES}, fr AS (SELECT region, year, count(*) FILTER (WHERE s <> 0) observed, {', '.join(f'count(*) FILTER (WHERE s = {k}) n{k}' for k in STATES)} FROM st GROUP BY 1, 2), tr AS (SELECT region, year, state, name, {case('state', {k: k for k in STATES}).replace('THEN ', 'THEN n')} / nullif(observed, 0) AS fraction FROM fr CROSS JOIN names)"
DELTA = ", de AS (SELECT region, state, name, max(fraction) FILTER (WHERE year = (SELECT max(year) FROM tr)) - max(fraction) FILTER (WHERE year = (SELECT min(year) FROM tr)) AS delta FROM tr GROUP BY ALL)"
FL = ", fl AS (SELECT a.region, a.r, a.c, a.s AS s0, b.s AS s6 FROM st a JOIN st b USING (region, r, c) WHERE a.year = (SELECT min(year) FROM st) AND b.year = (SELECT max(year) FROM st))"
TM = FL + ", tm AS (SELECT region, s0 from_state, s6 to_state, count(*) pixels, count(*) / sum(count(*)) OVER (PARTITION BY region) AS fraction FROM fl WHERE s0 <> 0 AND s6 <> 0 GROUP BY region, s0, s6)"
BL = f", bl AS (SELECT *, CAST(floor(r / {BLOCK}.0) AS INT) br, CAST(floor(c / {BLOCK}.0) AS INT) bc FROM {{0}})"
FEATS = BL.format("px") + ", ft AS (SELECT region, br, bc, " + ", ".join(
    [f"count(*) FILTER (WHERE first_state = {k}) / count(*) AS first_{v}" for k, v in STATES.items()]
    + [f"count(*) FILTER (WHERE fin = {k}) / count(*) AS final_{v}" for k, v in STATES.items()]
) + ", count(*) FILTER (WHERE event) / count(*) AS changed, round(avg(CASE WHEN event THEN (yoc - 1995) / 6 ELSE 0 END), 9) AS change_timing, sum(switches) / 6 / count(*) AS volatility FROM bl GROUP BY ALL)"
FNAMES = [*(f"first_{v}" for v in STATES.values()), *(f"final_{v}" for v in STATES.values()), "changed", "change_timing", "volatility"]
PAIR = ST2 + ", pr AS (SELECT region, a.year, a.s AS a, b.s AS b, count(*) pixels FROM st a JOIN st2 b USING (region, r, c, year) WHERE a.s <> 0 AND b.s <> 0 GROUP BY ALL)"
CHECK = (
    ST2 + ", " + events() + TR[len(EV) :] + ", " + scores() + """,
ck AS (SELECT sc.*, st.s AS here, st2.s AS other, (event AND yoc <= 1999) AS done FROM sc JOIN st USING (region, r, c) JOIN st2 USING (region, r, c) WHERE st.year = 1999 AND st2.year = 1999 AND st2.s <> 0),
base AS (SELECT region, here AS state, count(*) pixels, count(*) FILTER (WHERE other = here) / count(*) AS baseline FROM ck WHERE NOT event AND here <> 0 GROUP BY ALL HAVING count(*) >= 50)"""
)
QUART = ", qs AS (SELECT region, count(*) events, quantile_cont(score, 0.25) q1, quantile_cont(score, 0.5) q2, quantile_cont(score, 0.75) q3 FROM {0} GROUP BY region)"
BIN = "CASE WHEN score <= q1 THEN 1 WHEN score <= q2 THEN 2 WHEN score <= q3 THEN 3 ELSE 4 END"
POINTS = "p AS (SELECT c_custkey id, (c_custkey * 37) % 3600 / 10 - 180 AS lon, (c_custkey * 53) % 1600 / 10 - 80 AS lat FROM customer)"
BOXES = POINTS + ", bx AS (SELECT id, lon west, lat south, lon + (id % 80 + 1) / 10 AS east, lat + (id % 90 + 1) / 10 AS north FROM (SELECT id, least(lon, 170) AS lon, least(lat, 70) AS lat FROM p))"
ZONE = "least(CAST(floor(({0} + 180) / 6) AS INT) + 1, 60)"
BANDNO = "least(CAST(floor(({0} + 80) / 8) AS INT), 19)"
BAND = f"substr('{BANDS}', {BANDNO} + 1, 1)"
TILE = f"lpad(CAST({ZONE.format('lon')} AS VARCHAR), 2, '0') || {BAND.format('lat')}"
TILES = BOXES + f""",
bz AS (SELECT *, {BANDNO.format('south')} b0, {BANDNO.format('north')} b1, {ZONE.format('west')} z0, {ZONE.format('east')} z1 FROM bx),
bt AS (SELECT *, unnest(range(b0, b1 + 1)) bb FROM bz), tl0 AS (SELECT *, unnest(range(z0, z1 + 1)) zz FROM bt),
tl AS (SELECT *, lpad(CAST(zz AS VARCHAR), 2, '0') || substr('{BANDS}', CAST(bb AS INT) + 1, 1) tile, CAST((bb - b0) * (z1 - z0 + 1) + zz - z0 AS INT) seq FROM tl0)"""
AREA = "round((east - west) * (north - south) * CAST(111.32 AS DOUBLE) * CAST(111.32 AS DOUBLE) * cos(radians((south + north) / 2)), 6)"
SCENES = "sn AS (SELECT event_id scene_id, CAST(ts AS DATE) AS day, value cloud FROM events WHERE value < 20)"
LABEL = "array_to_string(list_transform(range(CAST(floor(log2(sig) / 3) AS INT), -1, -1), lambda i: ['water','vegetation','crops','built','bare','snow_ice'][(sig >> CAST(3 * i AS BIGINT)) & 7]), '→')"
HOT = BL.format("sc") + f""",
hb AS (SELECT region, br, bc, count(*) FILTER (WHERE event) / count(*) change_fraction, avg(score) FILTER (WHERE event) ms FROM bl GROUP BY ALL),
hr AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY change_fraction DESC, br, bc) AS rank FROM hb),
hp AS (SELECT region, br, bc, arg_min(pair, (-k, pair)) pair FROM (SELECT region, br, bc, from_state * 100 + to_state pair, count(*) k FROM bl WHERE event GROUP BY ALL) GROUP BY ALL),
hy AS (SELECT region, br, bc, arg_min(yoc, (-k, yoc)) yoc FROM (SELECT region, br, bc, yoc, count(*) k FROM bl WHERE event GROUP BY ALL) GROUP BY ALL),
hs AS (SELECT region, br, bc, CAST(rank AS INT) AS rank, {BLOCK * 10} block_m, change_fraction, {case('CAST(floor(pair / 100) AS INT)', NAME, "''")} dominant_from, {case('pair % 100', NAME, "''")} dominant_to, yoc dominant_year, round(ms, 6) mean_score,
  CAST(br * {BLOCK} + {BLOCK / 2} AS DOUBLE) AS row, CAST(bc * {BLOCK} + {BLOCK / 2} AS DOUBLE) AS col FROM hr JOIN hp USING (region, br, bc) JOIN hy USING (region, br, bc) WHERE rank <= {SPOTS} AND change_fraction > 0)"""


def number(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
E1 = (1 - (1 - E2) ** 0.5) / (1 + (1 - E2) ** 0.5)
# The series of the meridian's arc and of the latitude at its foot.
ARC = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, -(3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024), 15 * E2**2 / 256 + 45 * E2**3 / 1024, -35 * E2**3 / 3072)
FOOT = (3 * E1 / 2 - 27 * E1**3 / 32, 21 * E1**2 / 16 - 55 * E1**4 / 32, 151 * E1**3 / 96, 1097 * E1**4 / 512)


def projected(name: str, source: str) -> str:
    """CTE ``name``: ``source`` (lon, lat, zone) with the grid's x and y."""
    arc = " + ".join(f"{number(a)} * {f'sin({2 * j} * f)' if j else 'f'}" for j, a in enumerate(ARC))
    return f"""
{name}0 AS (SELECT *, radians(lat) AS f FROM {source}),
{name}1 AS (SELECT *, {number(A)} / sqrt(1 - {number(E2)} * sin(f) ** 2) AS n, tan(f) ** 2 AS t, {number(EP2)} * cos(f) ** 2 AS c, cos(f) * radians(lon - (zone * 6 - 183)) AS a, {number(A)} * ({arc}) AS m FROM {name}0),
{name} AS (SELECT * EXCLUDE (f, n, t, c, a, m),
  {number(K0)} * n * (a + (1 - t + c) * a ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - {number(58 * EP2)}) * a ** 5 / 120) + 500000 AS x,
  {number(K0)} * (m + n * tan(f) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a ** 4 / 24 + (61 - 58 * t + t * t + 600 * c - {number(330 * EP2)}) * a ** 6 / 720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END AS y FROM {name}1)"""


def unprojected(name: str, source: str) -> str:
    """CTE ``name``: ``source`` (x, y, zone, north) with lon and lat."""
    foot = " + ".join(f"{number(a)} * sin({2 * j} * mu)" for j, a in enumerate(FOOT, 1))
    return f"""
{name}0 AS (SELECT *, (y - CASE WHEN north THEN 0 ELSE 10000000 END) / {number(K0 * A * ARC[0])} AS mu FROM {source}),
{name}1 AS (SELECT *, mu + {foot} AS p FROM {name}0),
{name}2 AS (SELECT *, {number(EP2)} * cos(p) ** 2 AS c, tan(p) ** 2 AS t, {number(A)} / sqrt(1 - {number(E2)} * sin(p) ** 2) AS n, {number(A * (1 - E2))} / (1 - {number(E2)} * sin(p) ** 2) ** CAST(1.5 AS DOUBLE) AS ra FROM {name}1),
{name}3 AS (SELECT *, (x - 500000) / (n * {number(K0)}) AS d FROM {name}2),
{name} AS (SELECT * EXCLUDE (mu, p, c, t, n, ra, d),
  degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + {number(8 * EP2)} + 24 * t * t) * d ** 5 / 120) / cos(p)) + (zone * 6 - 183) AS to_lon,
  degrees(p - n * tan(p) / ra * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - {number(9 * EP2)}) * d ** 4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - {number(252 * EP2)} - 3 * c * c) * d ** 6 / 720)) AS to_lat FROM {name}3)"""


def q(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


TIERS = "count(*) FILTER (WHERE event) events, " + ", ".join(f"count(*) FILTER (WHERE tier = {k}) AS {n}, count(*) FILTER (WHERE tier = {k}) * 100 / greatest(count(*) FILTER (WHERE event), 1) AS {n}_pct" for k, n in ((1, "low"), (2, "medium"), (3, "high")))
BOTH = "greatest(count(*) FILTER (WHERE s0 <> 0 AND s6 <> 0), 1)"
WIDE = ", ".join(f"coalesce(max(s) FILTER (WHERE year = {1995 + i}), 0) AS s{i}" for i in range(7))

SQL: dict[str, str] = {
    "observations": q(OBS, "SELECT * FROM obs"),
    "second_product": q(OBS2, "SELECT * FROM obs2"),
    "scan_window": q(OBS, "SELECT * FROM obs WHERE r BETWEEN 3 AND 11 AND c BETWEEN 10 AND 30 AND year IN (1996, 1998)"),
    "coregistration_check": q(OBS, ", x AS (SELECT region, year, count(*) pixels, max(r) + 1 h, max(c) + 1 w FROM obs GROUP BY ALL) SELECT *, min(pixels) OVER k = max(pixels) OVER k AND min(h) OVER k = max(h) OVER k AND min(w) OVER k = max(w) OVER k AS aligned FROM x WINDOW k AS (PARTITION BY region)"),
    "mosaic_first_nonzero": q(OBS, ", x AS (SELECT *, 1 AS k FROM obs WHERE c < 30 UNION ALL SELECT region, r, c, year, CASE WHEN src = 0 THEN 2 ELSE src END, 2 FROM obs WHERE c >= 20) SELECT region, r, c, year, coalesce(arg_min(src, k) FILTER (WHERE src <> 0), 0) AS src FROM x GROUP BY ALL"),
    "resample_nearest": q(OBS, "SELECT a.region, a.r, a.c, a.year, coalesce(b.src, 0) AS src FROM obs a LEFT JOIN obs b ON a.region = b.region AND a.year = b.year AND b.r = a.r // 3 * 3 AND b.c = a.c // 3 * 3"),
    "wc_tiles": q(BOXES, ", x AS (SELECT *, unnest(range(CAST(floor(south / 3) * 3 AS INT), CAST(ceil(north / 3) * 3 AS INT), 3)) la FROM bx), y AS (SELECT *, unnest(range(CAST(floor(west / 3) * 3 AS INT), CAST(ceil(east / 3) * 3 AS INT), 3)) lo FROM x) SELECT id, CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(la) AS VARCHAR), 2, '0') || CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lo) AS VARCHAR), 3, '0') AS tile FROM y"),
    "best_scene": q(SCENES, ", wk AS (SELECT DISTINCT date_trunc('week', CAST(ts AS DATE)) AS st FROM events) SELECT strftime(st, '%Y-%m-%d') AS start, arg_min(scene_id, (cloud, scene_id)) AS scene_id, min(cloud) AS cloud FROM wk JOIN sn ON day BETWEEN st AND st + INTERVAL 6 DAY GROUP BY st"),
    "evidence_pairs": q(SC + HOT, ", p1 AS (SELECT CAST(0.1 AS DOUBLE) AS px), sn AS (SELECT event_id AS scene_id, DATE '1993-01-01' + CAST(event_id * 13 % 2900 AS INT) AS day, value AS cloud, (event_id * 37 % 2000) / 100 AS w, (event_id * 11 % 40) / 100 - CAST(0.3 AS DOUBLE) AS s FROM events WHERE value < 20), "
        "y AS (SELECT region, rank, dominant_year AS year, region + bc * px AS w, br * px AS s, px FROM hs, p1), "
        + ", ".join(f"{n} AS (SELECT region, rank, arg_min(scene_id, (cloud, scene_id)) AS id FROM y JOIN sn ON day BETWEEN make_date(year + {a[0]}, {a[1]}, {a[2]}) AND make_date(year + {b[0]}, {b[1]}, {b[2]}) AND y.w < sn.w + CAST(0.4 AS DOUBLE) AND sn.w < y.w + px AND y.s < sn.s + CAST(0.3 AS DOUBLE) AND sn.s < y.s + px GROUP BY ALL)" for n, a, b in (("b1", (-1, 1, 1), (-1, 6, 30)), ("b2", (-2, 1, 1), (-1, 6, 30)), ("a1", (1, 1, 1), (1, 12, 31)), ("a2", (0, 7, 1), (1, 12, 31))))
        + ", o AS (SELECT y.region, y.rank, year, coalesce(b1.id, b2.id) AS before, coalesce(a1.id, a2.id) AS after FROM y LEFT JOIN b1 USING (region, rank) LEFT JOIN b2 USING (region, rank) LEFT JOIN a1 USING (region, rank) LEFT JOIN a2 USING (region, rank)) SELECT region, rank, year, CASE WHEN after IS NOT NULL THEN before END AS before, CASE WHEN before IS NOT NULL THEN after END AS after FROM o"),
    "raster_layers": q(AN, "SELECT region, r, c, yoc AS year_of_change, from_state, to_state, CAST(floor(score * 100 + 1e-9) AS INT) AS confidence, tier AS confidence_tier, archetype, CAST(anomaly AS INT) AS anomaly FROM pa"),
    "raster_tiles": q(AN, ", l AS (SELECT region, r, c, CAST(yoc AS INT) AS year_of_change, CAST(from_state AS INT) AS from_state, CAST(to_state AS INT) AS to_state, CAST(floor(score * 100 + 1e-9) AS INT) AS confidence, CAST(tier AS INT) AS confidence_tier, CAST(archetype AS INT) AS archetype, CAST(anomaly AS INT) AS anomaly FROM pa),"
        " u AS (SELECT * FROM l UNPIVOT INCLUDE NULLS (v FOR layer IN (year_of_change, from_state, to_state, confidence, confidence_tier, archetype, anomaly)))"
        " SELECT region, CAST(r // 16 AS INT) AS tr, CAST(c // 16 AS INT) AS tc, layer, CAST(max(r % 16) + 1 AS INT) AS height, CAST(max(c % 16) + 1 AS INT) AS width, CAST(coalesce(sum(v), 0) AS BIGINT) AS total FROM u GROUP BY ALL"),
    "overlay_colors": q(ST, ", k(state, colour) AS (VALUES (1, '#419bdf'), (2, '#397d49'), (3, '#e49635'), (4, '#c4281b'), (5, '#a59b8f'), (6, '#b39fe1')) SELECT year, state, count(*) AS pixels, colour, "
        + ", ".join(f"CAST(('0x' || substr(colour, {i}, 2)) AS INT) AS {n}" for i, n in ((2, "red"), (4, "green"), (6, "blue"))) + " FROM st JOIN k ON s = state GROUP BY year, state, colour"),
    "remap_states": q(ST, f"SELECT {KEY}, year, s AS state FROM st"),
    "remap_states_alt": q(ST2, f"SELECT {KEY}, year, s AS state FROM st2"),
    "state_predicate": q(ST, "SELECT region, year, count(*) AS pixels FROM st WHERE s = 2 GROUP BY ALL"),
    "jointly_observed": q(ST + FL, "SELECT region, count(*) AS pixels FROM fl WHERE s0 <> 0 AND s6 <> 0 GROUP BY 1"),
    "analysed_pixels": q(EV, f"SELECT region, count(*) AS pixels FROM ev WHERE observed >= {MIN_OBSERVED} GROUP BY 1"),
    "change_layer": q(EV, f"SELECT {KEY}, to_state AS layer FROM ev"),
    "target_grid": q(POINTS, ", b AS (SELECT id, 500000 + (id * 7919 % 100000) / 4 AS x0, 4000000 + (id * 104729 % 100000) / 4 AS y0 FROM p), d AS (SELECT *, x0 + 1000 + id % 77 / 2 AS x1, y0 + 1500 + id % 55 / 4 AS y1 FROM b) SELECT id, floor(x0 / 10) * 10 AS x0, ceil(y1 / 10) * 10 AS y1, CAST(round((ceil(x1 / 10) * 10 - floor(x0 / 10) * 10) / 10) AS INT) AS width, CAST(round((ceil(y1 / 10) * 10 - floor(y0 / 10) * 10) / 10) AS INT) AS height FROM d"),
    "utm_zone": q(POINTS, f"SELECT id, {ZONE.format('lon')} AS zone FROM p"),
    "lat_band": q(POINTS, f"SELECT id, {BAND.format('lat')} AS band FROM p"),
    "tile_id": q(POINTS, f"SELECT id, {TILE} AS tile FROM p"),
    "tiles_for_bbox": q(TILES, "SELECT id, tile, seq FROM tl"),
    "tile_ranges": q(POINTS, f", x AS (SELECT DISTINCT {BAND.format('lat')} AS band, {ZONE.format('lon')} AS zone FROM p) SELECT band, zone, CAST(-80 + 8 * (strpos('{BANDS}', band) - 1) AS INT) AS south, CAST(CASE WHEN band = 'X' THEN 84 ELSE -72 + 8 * (strpos('{BANDS}', band) - 1) END AS INT) AS north, -186 + 6 * zone AS west, -180 + 6 * zone AS east FROM x"),
    "bbox_intersect": q(TILES, f", m AS (SELECT id, tile, west, south, east, north, -186 + 6 * zz AS tw, -180 + 6 * zz AS te, -80 + 8 * bb AS ts, CASE WHEN bb = 19 THEN 84 ELSE -72 + 8 * bb END AS tn FROM tl), k AS (SELECT id, tile, greatest(west, tw - CAST(0.003 AS DOUBLE)) AS west, greatest(south, ts - CAST(0.003 AS DOUBLE)) AS south, least(east, te + CAST(0.003 AS DOUBLE)) AS east, least(north, tn + CAST(0.003 AS DOUBLE)) AS north FROM m) SELECT id, tile, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north FROM k WHERE west < east AND south < north"),
    "epsg_code": q(POINTS, f"SELECT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + {ZONE.format('lon')} AS epsg FROM p"),
    "aoi_area": q(BOXES, f"SELECT id, {AREA} AS km2, {AREA} <= 1500 AS allowed FROM bx"),
    "grid_area": q(ST, ", x AS (SELECT region, max(r) + 1 h, max(c) + 1 w FROM st GROUP BY 1) SELECT *, h * w * 100 / 1000000 AS km2 FROM x"),
    "overlay_grid": q(POINTS, ", x AS (SELECT id, id * 13 % 5000 + 1 AS h, id * 29 % 7000 + 1 AS w FROM p) SELECT id, greatest(CAST(round_even(h * least(CAST(1 AS DOUBLE), CAST(1600 AS DOUBLE) / greatest(h, w)), 0) AS INT), 1) AS height, greatest(CAST(round_even(w * least(CAST(1 AS DOUBLE), CAST(1600 AS DOUBLE) / greatest(h, w)), 0) AS INT), 1) AS width FROM x"),
    "bbox_name": q(BOXES, "SELECT id, 'bbox_' || translate(printf('%.3f_%.3f_%.3f_%.3f', west, south, east, north), '-.', 'mp') AS name FROM bx"),
    "display_name": q(POINTS, "SELECT id, printf('AOI %.3f°%s %.3f°%s', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS name FROM p"),
    "name_check": r"SELECT c_custkey, regexp_matches(lower(c_name), '^[a-z0-9_\-]{1,64}$') AS as_lower, regexp_matches(c_name, '^[a-z0-9_\-]{1,64}$') AS as_is FROM customer",
    "fingerprint": q(BOXES, "SELECT id, substr(sha256(printf('%.3f,%.3f,%.3f,%.3f', west, south, east, north)), 1, 16) AS fingerprint FROM bx"),
    "state_fractions": q(ST + TREND, "SELECT region, state, name, fraction FROM tr WHERE year = (SELECT max(year) FROM tr)"),
    "fraction_trends": q(ST + TREND, "SELECT * FROM tr"),
    "fraction_deltas": q(ST + TREND + DELTA, "SELECT * FROM de"),
    "top_deltas": q(ST + TREND + DELTA, ", x AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(delta) DESC, state) AS rank FROM de WHERE abs(delta) >= CAST(0.001 AS DOUBLE)) SELECT region, CAST(rank AS INT) AS rank, name, delta FROM x WHERE rank <= 4"),
    "visible_trends": q(ST + TREND, ", k AS (SELECT region, state FROM tr GROUP BY ALL HAVING max(fraction) > CAST(0.05 AS DOUBLE)) SELECT tr.* FROM tr JOIN k USING (region, state)"),
    "transition_matrix": q(ST + TM, "SELECT * FROM tm"),
    "top_transitions": q(ST + TM, ", x AS (SELECT *, CAST(row_number() OVER (PARTITION BY region ORDER BY pixels DESC, from_state, to_state) AS INT) AS rank FROM tm WHERE from_state <> to_state) SELECT * FROM x WHERE rank <= 5"),
    "raw_change": q(ST + TM, "SELECT region, CAST(sum(pixels) AS BIGINT) AS pixels, CAST(coalesce(sum(pixels) FILTER (WHERE from_state <> to_state), 0) AS BIGINT) AS changed, coalesce(sum(pixels) FILTER (WHERE from_state <> to_state), 0) / sum(pixels) AS fraction FROM tm GROUP BY 1"),
    "stable_change": q(ST + FL, ", k AS (SELECT region, r, c, count(*) FILTER (WHERE st.s = s6 AND year >= (SELECT max(year) - 1 FROM st)) = 2 AS held FROM st JOIN fl USING (region, r, c) GROUP BY ALL) SELECT region, count(*) FILTER (WHERE s0 <> 0 AND s6 <> 0 AND s0 <> s6 AND held) AS changed, count(*) FILTER (WHERE s0 <> 0 AND s6 <> 0) AS pixels FROM fl JOIN k USING (region, r, c) GROUP BY 1"),
    "present_states": q(ST + ", " + NAMES, "SELECT DISTINCT region, s AS state, coalesce(name, 'nodata') AS name FROM st LEFT JOIN names ON s = state"),
    "pixel_history": q(ST, f"SELECT {KEY}, {WIDE} FROM st GROUP BY {KEY}"),
    "observed_years": q(EV, f"SELECT {KEY}, CAST(observed AS INT) AS observed FROM ev"),
    "trailing_run": q(EV, f"SELECT {KEY}, fin, trail FROM ev"),
    "change_events": q(EV, f"SELECT {KEY}, yoc, from_state, to_state, pre_mode_frac, purity FROM ev WHERE event"),
    "change_volumes": q(EV + VOL, "SELECT * FROM vol"),
    "yearly_change_totals": q(EV + VOL, ", x AS (SELECT region, yoc, CAST(sum(pixels) AS BIGINT) AS pixels, arg_min(from_state * 10 + to_state, (-pixels, from_state, to_state)) AS k FROM vol GROUP BY ALL) SELECT region, yoc, pixels, k // 10 AS dominant_from, k % 10 AS dominant_to FROM x"),
    "volumes_by_destination": q(EV + VOL, "SELECT region, yoc, to_state, sum(pixels) * 100 / 1000000 AS km2 FROM vol GROUP BY ALL"),
    "peak_period": q(EV + VOL + PEAK, "SELECT region, y - 1 AS start, y AS stop FROM pk"),
    "signatures": q(TR, f"SELECT {KEY}, sig FROM px"),
    "signature_labels": q(TR + SIG, f"SELECT region, sig, CASE WHEN sig <= 0 THEN 'unobserved' ELSE {LABEL} END AS label FROM hist"),
    "signature_stats": q(TR + SIG, "SELECT region, sig, CAST(states AS INT) AS states, pixels, pixels / total AS fraction FROM hist"),
    "top_signatures": q(TR + SIG, ", x AS (SELECT region, sig, pixels, pixels / total AS fraction, CAST(row_number() OVER (PARTITION BY region ORDER BY pixels DESC, sig) AS INT) AS rank FROM hist) SELECT * FROM x WHERE rank <= 10"),
    "switch_count": q(TR, f"SELECT {KEY}, CAST(switches AS INT) AS switches FROM px"),
    "first_state": q(TR, f"SELECT {KEY}, first_state FROM px"),
    "distinct_states": q(TR, f"SELECT {KEY}, CAST(n_states AS INT) AS n_states, CAST(excursion AS INT) AS excursion FROM px"),
    "archetypes": q(TR, f"SELECT {KEY}, archetype FROM px"),
    "archetype_fractions": q(TR, f", x AS (SELECT region, count(*) FILTER (WHERE observed >= {MIN_OBSERVED}) AS k FROM px GROUP BY 1) SELECT region, archetype, {case('archetype', ARCHETYPES, chr(39) * 2)} AS name, count(*) AS pixels, count(*) / nullif(k, 0) AS fraction FROM px JOIN x USING (region) WHERE archetype <> 0 GROUP BY region, archetype, k"),
    "stable_changed_share": q(TR, f"SELECT region, count(*) FILTER (WHERE archetype IN (1, 2)) / count(*) AS stable, count(*) FILTER (WHERE archetype IN (3, 4, 8)) / count(*) AS changed FROM px WHERE observed >= {MIN_OBSERVED} GROUP BY 1"),
    "rare_signatures": q(TR + SIG, "SELECT region, sig, pixels, CAST(rank AS INT) AS rank, CAST(so_far AS BIGINT) AS so_far FROM rare"),
    "anomaly_pixels": q(TR + SIG, f"SELECT {KEY}, sig FROM px JOIN rare USING (region, sig) WHERE observed >= {MIN_OBSERVED}"),
    "spatial_support": q(SC, f"SELECT {KEY}, to_state, neighbours, inside, support FROM sup"),
    "confidence_scores": q(SC, f"SELECT {KEY}, round(score, 9) AS score FROM sc WHERE event"),
    "confidence_tiers": q(SC, f"SELECT {KEY}, tier FROM sc"),
    "tier_summary": q(SC, f"SELECT region, {TIERS} FROM sc GROUP BY 1"),
    "event_fraction": q(AN + FL, f"SELECT region, count(*) FILTER (WHERE event) AS events, count(*) FILTER (WHERE s0 <> 0 AND s6 <> 0) AS pixels, count(*) FILTER (WHERE event) / {BOTH} AS fraction FROM pa JOIN fl USING (region, r, c) GROUP BY 1"),
    "change_fractions": q(AN + FL, f"SELECT region, count(*) FILTER (WHERE event) / {BOTH} AS event_fraction, count(*) FILTER (WHERE anomaly) / {BOTH} AS anomaly_fraction, round(coalesce(avg(score) FILTER (WHERE event), 0), 6) AS mean_score FROM pa JOIN fl USING (region, r, c) GROUP BY 1"),
    "block_features": q(TR + FEATS, "SELECT * FROM ft"),
    "scaled_features": q(TR + FEATS, "SELECT region, br, bc, " + ", ".join(f"round(coalesce(({f} - avg({f}) OVER k) / nullif(round(stddev_pop({f}) OVER k, 12), 0), 0), 6) AS {f}" for f in FNAMES) + " FROM ft WINDOW k AS (PARTITION BY region)"),
    "densest_block": q(TR + FEATS, ", x AS (SELECT region, br, bc, changed AS fraction, row_number() OVER (PARTITION BY region ORDER BY changed DESC, br, bc) k FROM ft) SELECT region, br, bc, fraction FROM x WHERE k = 1"),
    "hotspots": q(SC + HOT, "SELECT * FROM hs"),
    "cluster_pixels": q(TR + FEATS, f"SELECT region, r, c, CAST(floor(changed * 4) AS INT) + 1 AS layer FROM bl JOIN ft USING (region, br, bc)"),
    "product_agreement": q(PAIR, "SELECT region, year, CAST(sum(pixels) AS BIGINT) AS pixels, coalesce(sum(pixels) FILTER (WHERE a = b), 0) / sum(pixels) AS agreement FROM pr GROUP BY ALL"),
    "product_confusion": q(PAIR, "SELECT * FROM pr"),
    "product_iou": q(PAIR, f", {NAMES} SELECT region, year, state, CAST(coalesce(sum(pixels) FILTER (WHERE a = state), 0) AS BIGINT) AS first_pixels, CAST(coalesce(sum(pixels) FILTER (WHERE b = state), 0) AS BIGINT) AS second_pixels, coalesce(sum(pixels) FILTER (WHERE a = state AND b = state), 0) / sum(pixels) AS iou FROM pr JOIN names ON a = state OR b = state GROUP BY ALL"),
    "state_baseline": q(CHECK, "SELECT * FROM base"),
    "relative_agreement": q(CHECK, ", x AS (SELECT region, to_state AS state, count(*) k, count(*) FILTER (WHERE other = to_state) e FROM ck WHERE done GROUP BY ALL), y AS (SELECT region, CAST(sum(k) AS BIGINT) AS events, CAST(sum(k) FILTER (WHERE baseline >= 0.05) AS BIGINT) AS evaluated, sum(e) FILTER (WHERE baseline >= 0.05) AS e, sum(baseline * k) FILTER (WHERE baseline >= 0.05) AS d FROM x LEFT JOIN base USING (region, state) GROUP BY region) SELECT region, events, evaluated, e / evaluated AS agreement, round(d / evaluated, 6) AS baseline, round(e / d, 6) AS ratio FROM y WHERE events >= 50 AND d > 0"),
    "score_quartiles": q(SC + ", se AS (SELECT * FROM sc WHERE event)" + QUART.format("se"), "SELECT region, events, round(q1, 9) AS q1, round(q2, 9) AS q2, round(q3, 9) AS q3 FROM qs"),
    "relative_by_quartile": q(CHECK + ", se AS (SELECT * FROM ck WHERE done)" + QUART.format("se"), f", x AS (SELECT region, {BIN} AS bin, to_state AS state, count(*) k, count(*) FILTER (WHERE other = to_state) e FROM se JOIN qs USING (region) WHERE events >= 100 GROUP BY ALL), y AS (SELECT region, bin, CAST(sum(k) AS BIGINT) AS events, CAST(sum(k) FILTER (WHERE baseline >= 0.05) AS BIGINT) AS evaluated, sum(e) FILTER (WHERE baseline >= 0.05) AS e, sum(baseline * k) FILTER (WHERE baseline >= 0.05) AS d FROM x LEFT JOIN base USING (region, state) GROUP BY region, bin) SELECT region, bin, events, evaluated, e / evaluated AS agreement, round(d / evaluated, 6) AS baseline, round(e / d, 6) AS ratio FROM y WHERE events >= 20 AND d > 0"),
    "holdout_rates": q(ST + ", hst AS (SELECT * FROM st WHERE year <= (SELECT max(year) - 2 FROM st)), " + events("hst", "h") + ", " + scores("h", "evh") + ", se AS (SELECT * FROM sch WHERE event)" + QUART.format("se"),
        f", v AS (SELECT region, r, c, bool_and(s = to_state) AS lasts FROM se JOIN st USING (region, r, c) WHERE year > (SELECT max(year) - 2 FROM st) GROUP BY ALL), x AS (SELECT region, {BIN} AS bin, lasts FROM se JOIN qs USING (region) JOIN v USING (region, r, c) WHERE events >= 50), y AS (SELECT * FROM x UNION ALL SELECT region, 0, lasts FROM x) SELECT region, bin, count(*) AS events, count(*) FILTER (WHERE lasts) / count(*) AS verified FROM y GROUP BY ALL"),
    "benchmark_rows": q(AN + FL + TM[len(FL):] + VOL + PEAK + TREND + DELTA, f""",
b1 AS (SELECT region, (max(r) + 1) * (max(c) + 1) * 100 / 1000000 AS area_km2, count(*) FILTER (WHERE event) / {BOTH} AS event_fraction, count(*) FILTER (WHERE anomaly) / {BOTH} AS anomaly_fraction,
  round(coalesce(avg(score) FILTER (WHERE event), 0), 6) AS mean_confidence, count(*) FILTER (WHERE event) AS events, count(*) FILTER (WHERE tier = 3) * 100 / greatest(count(*) FILTER (WHERE event), 1) AS high_confidence_pct,
  count(*) FILTER (WHERE archetype IN (1, 2) AND observed >= {MIN_OBSERVED}) / nullif(count(*) FILTER (WHERE observed >= {MIN_OBSERVED}), 0) AS stable FROM pa JOIN fl USING (region, r, c) GROUP BY region),
b2 AS (SELECT region, coalesce(sum(pixels) FILTER (WHERE from_state <> to_state), 0) / sum(pixels) AS raw_fraction FROM tm GROUP BY 1),
b3 AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY abs(delta) DESC, state) k FROM de)
SELECT b1.*, raw_fraction, name AS biggest_delta_state, delta AS biggest_delta, y AS peak_year FROM b1 LEFT JOIN b2 USING (region) LEFT JOIN (SELECT * FROM b3 WHERE k = 1) USING (region) LEFT JOIN pk USING (region)"""),
    "product_paths": q(POINTS, f", t AS (SELECT DISTINCT {TILE} AS tile FROM p) SELECT tile, year, 'products/' || tile || '/' || tile || '_' || year || '.tif' AS path FROM t CROSS JOIN (VALUES (2017), (2018), (2019)) AS k(year)"),
    "stale_regions": q(OBS, ", k AS (SELECT region, max(r) + 1 AS h, max(c) + 1 AS w FROM obs GROUP BY 1), m AS (SELECT region, max(r) + 1 AS h, max(c) + 1 AS w, count(*) AS n FROM obs WHERE year = 1995 AND NOT (region % 2 = 1 AND r = 3) GROUP BY 1) SELECT region FROM k LEFT JOIN m USING (region, h, w) WHERE n IS NULL OR n <> h * w"),
    "single_tile": q(POINTS, f"SELECT id, {TILE} AS tile FROM p"),
    "aoi_names": q(BOXES, f"SELECT id, 'aoi_' || substr(sha1(unhex('{uuid.NAMESPACE_URL.hex}') || encode(printf('%.4f,%.4f,%.4f,%.4f,(2017, 2018, 2019)', west, south, east, north))), 1, 10) AS name FROM bx"),
    "utm_round_trip": q(POINTS, f", z AS (SELECT *, {ZONE.format('lon')} AS zone FROM p), {projected('u', 'z')}, w AS (SELECT *, lat >= 0 AS north FROM u), {unprojected('v', 'w')} SELECT id, zone, round(x, 3) AS x, round(y, 3) AS y, round(to_lon, 6) AS lon, round(to_lat, 6) AS lat FROM v"),
    "projected_boxes": q(BOXES, f", z AS (SELECT id, west, south, least(east, west + 4) AS east, least(north, 80) AS north FROM bx), k AS (SELECT *, {ZONE.format('((west + east) / 2)')} AS zone FROM z),"
        " g AS (SELECT id, zone, west + (east - west) * i / 2 AS lon, south + (north - south) * j / 2 AS lat FROM k CROSS JOIN range(3) AS gi(i) CROSS JOIN range(3) AS gj(j) WHERE i <> 1 OR j <> 1), "
        + projected("u", "g") + " SELECT id, any_value(zone) AS zone, round(min(x), 3) AS x0, round(min(y), 3) AS y0, round(max(x), 3) AS x1, round(max(y), 3) AS y1 FROM u GROUP BY id"),
    "hotspot_places": q(SC + HOT, ', w AS (SELECT region, rank, 500000 + "col" * 10 AS x, 4100000 - "row" * 10 AS y, 33 AS zone, true AS north FROM hs), ' + unprojected("v", "w") + " SELECT region, rank, round(to_lon, 6) AS lon, round(to_lat, 6) AS lat FROM v"),
    "tier_percentages": q(SC, ", x AS (SELECT region, tier, count(*) AS k FROM sc WHERE event GROUP BY ALL), ne AS (SELECT region, sum(k) AS events FROM x GROUP BY 1), kinds(tier, name) AS (VALUES (1, 'low'), (2, 'medium'), (3, 'high')), y AS (SELECT region, name, coalesce(k, 0) * 100 / events AS pct FROM ne CROSS JOIN kinds LEFT JOIN x USING (region, tier))"
        " SELECT region, name AS tier, CAST(floor(pct) AS BIGINT) AS pct_floor, CAST(floor(pct + CAST(0.5 AS DOUBLE)) AS BIGINT) AS pct_round, floor(pct * 10 + CAST(0.5 AS DOUBLE)) / 10 AS pct_tenth FROM y"),
    "state_names": q(ST + ", " + NAMES, "SELECT DISTINCT s AS state, coalesce(name, 'nodata') AS name FROM st LEFT JOIN names ON s = state"),
    "flagship": q(SC, "SELECT from_state, to_state, yoc, archetype, tier, count(*) AS pixels FROM sc WHERE event GROUP BY ALL"),
}
SQL["first_evidence"] = f"SELECT * FROM ({SQL['evidence_pairs']}) WHERE rank <= 3"
