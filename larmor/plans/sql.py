"""DuckDB SQL for the registered queries, over the driver tables."""

from __future__ import annotations

import math

import numpy as np

from larmor.functions import kernels
from larmor.operators import lines
from larmor.plans import queries as q


def r(x: str, digits: int) -> str:
    return f"(CASE WHEN round({x}, {digits}) = 0 THEN 0.0 ELSE round({x}, {digits}) END)"


SIG = "SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) AS t, value AS v, user_id, event_type FROM events"
LINE = "SELECT vec_id, label, CAST(i - 1 AS INTEGER) AS n, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) g(i)"
COIL = "SELECT vec_id, label, CAST(c AS INTEGER) AS coil, CAST(embedding[c + 1] AS DOUBLE) AS re, CAST(embedding[c + 9] AS DOUBLE) AS im FROM embeddings, range(0, 8) g(c)"
SAMPLE = "SELECT l_orderkey, l_linenumber, l_quantity - 25 AS kx, round(l_discount * 100) - 5 AS ky, l_tax AS kw, l_extendedprice AS re, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS kt, l_returnflag, l_linestatus FROM lineitem"
BASE = f"sig AS ({SIG}), line AS ({LINE}), cx AS ({COIL}), pt AS ({SAMPLE})"
FRAMED = BASE + ", span AS (SELECT min(t) AS lo, max(t) AS hi FROM sig), framed AS (SELECT sig.*, (t - lo) * 10 / (hi - lo) * (1.0 - 1e-9) AS tf FROM sig, span), fr AS (SELECT *, CAST(floor(tf) AS INTEGER) AS frame FROM framed)"


def near(source: str, half: int) -> str:
    """Ranks, shifted windows and the ascending values in them."""
    return f""", ranked AS (SELECT *, row_number() OVER (ORDER BY t, event_id) - 1 AS i, count(*) OVER () AS n_all FROM {source}),
    edge AS (SELECT *, least({half}, (n_all - 1) // 2) AS f, greatest(0, least(i - least({half}, (n_all - 1) // 2), n_all - 1 - 2 * least({half}, (n_all - 1) // 2))) AS lo FROM ranked),
    near AS (SELECT a.event_id, list(b.v ORDER BY b.v) AS w FROM edge a JOIN ranked b ON b.i BETWEEN a.lo AND a.lo + 2 * a.f GROUP BY a.event_id)"""


def stat(fraction: float) -> str:
    return f"w[least(len(w), CAST(floor(len(w) * {fraction}) AS BIGINT) + 1)]"


def phase(direction: int) -> str:
    slope = "" if not direction else f" AND {'' if direction == 1 else 'NOT '}(hi.v - lo.v >= 0)"
    return f"""WITH {BASE}{near('sig', 7)}, g AS (SELECT *, greatest(0, least(i - 2, n_all - 5)) AS a FROM ranked)
    SELECT event_id, CAST(g.v >= {stat(0.25)} AND g.v < {stat(0.75)}{slope} AS INTEGER) AS weight
    FROM g JOIN near USING (event_id) JOIN (SELECT i, v FROM ranked) lo ON lo.i = a JOIN (SELECT i, v FROM ranked) hi ON hi.i = a + 4"""


CUT = "cut AS (SELECT v AS cut FROM (SELECT v, row_number() OVER (ORDER BY v, event_id) - 1 AS i, count(*) OVER () AS n FROM sig) WHERE i = CAST(floor(n * 0.6) AS BIGINT))"
ENCODES = "types AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS INTEGER) AS encode FROM (SELECT DISTINCT event_type FROM events)), enc AS (SELECT * FROM sig JOIN types USING (event_type))"
BAND = "banded AS (SELECT vec_id, n, x, CASE WHEN n >= 32 THEN 0 WHEN n >= 16 THEN 1 WHEN n >= 8 THEN 2 ELSE 3 END AS band FROM line)"


def kernel(d: str, kind: str) -> str:
    half = kernels.HALF_WIDTH[kind]
    x = f"(abs({d}) / {half!r})"
    if kind == "triangle":
        value = f"1.0 - {x}"
    elif kind in ("polynomial", "polynomial_2"):
        # Fixed values, from the constant up.
        c = (1.0, 0.04522831, -3.36020304, 1.12417012, 2.82448025, -1.63447764) if kind == "polynomial" else (1.0, 0.03056504, -3.01961845, 0.6679865, 2.77924058, -1.45923643)
        value = " + ".join(f"{v!r} * pow({x}, {i})" for i, v in enumerate(c))
    else:
        place = f"CAST(floor(least(abs({d}), {half!r}) * 600) AS BIGINT)"
        value = f"ktab[{place} + 1] + (abs({d}) * 600 - {place}) * (ktab[{place} + 2] - ktab[{place} + 1])"
    return f"(CASE WHEN {x} <= 1 THEN {value} ELSE 0.0 END)"


def i0(x: str) -> str:
    terms = ", ".join(repr(1 / math.factorial(k) ** 2) for k in range(31))
    return f"list_sum(list_transform(range(0, 31), lambda k: ([{terms}])[k + 1] * pow({x} * {x} / 4.0, k)))"


MOVED = "moved AS (SELECT * REPLACE (kx + 0.25 AS kx) FROM pt)"


def stencil(source: str, kind: str, columns: str) -> str:
    half = kernels.HALF_WIDTH[kind]
    if kind == "kaiser_bessel":
        source = f"(SELECT * FROM {source}, (SELECT {kernels.kaiser_bessel_table(half, 1.5)!r} AS ktab))"
    return f"""SELECT {columns}, CAST(cx AS INTEGER) AS ckx, CAST(cy AS INTEGER) AS cky, {kernel('(cx - (kx + 32))', kind)} * {kernel('(cy - (ky + 8))', kind)} AS weight
    FROM (SELECT *, unnest(range(CAST(greatest(ceil(ky + 8 - {half}), 0) AS BIGINT), CAST(least(floor(ky + 8 + {half}), 15) AS BIGINT) + 1)) AS cy
        FROM (SELECT *, unnest(range(CAST(greatest(ceil(kx + 32 - {half}), 0) AS BIGINT), CAST(least(floor(kx + 32 + {half}), 63) AS BIGINT) + 1)) AS cx FROM {source}))"""


def scatter(kind: str) -> str:
    return f"WITH {BASE}, {MOVED}, st AS ({stencil('(SELECT * FROM moved WHERE kw <> 0)', kind, 're * kw AS val')}) SELECT ckx, cky, {r('sum(val * weight)', 1)} AS re FROM st GROUP BY ckx, cky"


def gram(centred: bool) -> str:
    pairs = "SELECT a.coil AS i, b.coil AS j, a.re * b.re + a.im * b.im AS pr, a.im * b.re - a.re * b.im AS pi, a.re AS ar, a.im AS ai, b.re AS br, b.im AS bi FROM cx a JOIN cx b USING (vec_id)"
    if not centred:
        return f"WITH {BASE}, p AS ({pairs}) SELECT i, j, {r('sum(pr)', 5)} AS re, {r('sum(pi)', 5)} AS im FROM p GROUP BY i, j"
    re = "(sum(pr) - (sum(ar) * sum(br) + sum(ai) * sum(bi)) / count(*)) / (count(*) - 1)"
    im = "-(sum(pi) - (sum(ai) * sum(br) - sum(ar) * sum(bi)) / count(*)) / (count(*) - 1)"
    return f"WITH {BASE}, p AS ({pairs}) SELECT i, j, {r(re, 7)} AS re, {r(im, 7)} AS im FROM p GROUP BY i, j"


def matrix(values: np.ndarray) -> str:
    rows = ", ".join(f"({i}, {j}, {float(v.real)!r}, {float(v.imag)!r})" for i, line in enumerate(np.asarray(values, complex)) for j, v in enumerate(line))
    return f"mat AS (SELECT * FROM (VALUES {rows}) m(r, c, mre, mim))"


def frames_matrix(values: np.ndarray) -> str:
    return f"WITH {BASE}, {matrix(values)} SELECT vec_id, CAST(r AS INTEGER) AS frame, {r('sum(mre * x)', 6)} AS re FROM line JOIN mat ON c = n WHERE mre <> 0 GROUP BY vec_id, r"


def dft(sign: str) -> str:
    angle = f"({sign}{2 * math.pi / 64!r} * ((n * k) % 64))"
    return f"WITH {BASE} SELECT vec_id, CAST(k AS INTEGER) AS k, {r(f'sum(x * cos({angle})) / 8.0', 5)} AS re, {r(f'sum(x * sin({angle})) / 8.0', 5)} AS im FROM line, range(0, 64) g(k) GROUP BY vec_id, k"


def taps(name: str) -> str:
    low = lines.LOW_PASS[name]
    rows = ", ".join(f"({f}, {a!r}, {b!r})" for f, (a, b) in enumerate(zip(low, lines.high_pass(low), strict=True)))
    return f"taps AS (SELECT * FROM (VALUES {rows}) t(f, a, b))"


def wave(name: str) -> str:
    return f"""WITH {BASE}, {taps(name)}, m AS (SELECT vec_id, p, sum(x * a) AS lo, sum(x * b) AS hi FROM range(0, 32) g(p), taps, line WHERE n = (2 * p - f + 64) % 64 GROUP BY vec_id, p)
    SELECT vec_id, CAST(p AS INTEGER) AS n, {r('lo', 6)} AS x FROM m UNION ALL SELECT vec_id, CAST(p + 32 AS INTEGER), {r('hi', 6)} FROM m"""


def unwave(name: str) -> str:
    return f"""WITH {BASE}, {taps(name)} SELECT vec_id, CAST(q AS INTEGER) AS n, {r('sum(x * c)', 6)} AS x FROM (
        SELECT vec_id, (2 * (n % 32) - f + 64) % 64 AS q, x, CASE WHEN n < 32 THEN a ELSE b END AS c FROM line, taps) GROUP BY vec_id, q"""


def convolve(weights: dict[int, float], periodic: bool) -> str:
    rows = ", ".join(f"({d}, {w!r})" for d, w in weights.items())
    place, keep = ("(n + d + 64) % 64", "") if periodic else ("n + d", "WHERE n + d >= 0 AND n + d < 64")
    return f"WITH {BASE}, taps AS (SELECT * FROM (VALUES {rows}) t(d, w)) SELECT vec_id, CAST({place} AS INTEGER) AS n, {r('sum(x * w)', 6)} AS x FROM line, taps {keep} GROUP BY vec_id, {place}"


def gauss(sigma: float, reach: int, normalised: bool) -> dict[int, float]:
    w = {d: math.exp(-(d**2) / (2 * sigma**2)) for d in range(-reach, reach + 1)}
    total = sum(w.values()) if normalised else 1.0
    return {d: v / total for d, v in w.items()}


def soft(x: str, t: str) -> str:
    return f"(CASE WHEN abs({x}) <= {t} THEN 0.0 ELSE {x} * (1.0 - {t} / abs({x})) END)"


SURE = f"""{BAND}, tops AS (SELECT band, 0.08 / 8 * sqrt(2 * ln(count(*))) AS top FROM banded GROUP BY band),
    tried AS (SELECT band, j, top * j / 39.0 AS t FROM tops, range(0, 40) g(j)),
    cost AS (SELECT band, j, t, round(count(*) * {0.08**2!r} - {2 * 0.08**2!r} * sum(CAST(abs(x) < t AS INTEGER)) + sum(least(abs(x), t) * least(abs(x), t)), 9) AS c FROM banded JOIN tried USING (band) GROUP BY band, j, t),
    steps AS (SELECT *, lag(c) OVER (PARTITION BY band ORDER BY j) AS before FROM cost),
    chosen AS (SELECT band, coalesce(min(j) FILTER (WHERE c >= before), 40) - 1 AS j FROM steps GROUP BY band), best AS (SELECT band, t AS threshold FROM chosen JOIN tried USING (band, j))"""
VOLUME = "vol AS (SELECT CAST(vec_id // 8 AS BIGINT) AS volume, vec_id % 8 AS z, n // 8 AS y, n % 8 AS xx, x AS re, x * n / 64.0 AS im FROM line)"
TV = f"""{VOLUME}, moved AS (SELECT volume, z, y, xx, re, im FROM vol
    UNION ALL SELECT volume, (z + d) % 8, y, xx, -re / 6, -im / 6 FROM vol, (VALUES (1), (7)) m(d)
    UNION ALL SELECT volume, z, (y + d) % 8, xx, -re / 6, -im / 6 FROM vol, (VALUES (1), (7)) m(d)
    UNION ALL SELECT volume, z, y, (xx + d) % 8, -re / 6, -im / 6 FROM vol, (VALUES (1), (7)) m(d)),
    tv AS (SELECT volume, z, y, xx, sum(re) AS re, sum(im) AS im FROM moved GROUP BY volume, z, y, xx)"""


def voxels(source: str, re: str = "re") -> str:
    return f"SELECT volume, CAST(z AS INTEGER) AS z, CAST(y AS INTEGER) AS y, CAST(xx AS INTEGER) AS x, {r(re, 6)} AS re, {r('im', 6)} AS im FROM {source}"


def cut_bands(table: str, share: str = "1.0") -> str:
    t = f"(threshold * {share})"
    return f"WITH {BASE}, {table} SELECT vec_id, n, {r(soft('x', t), 6)} AS x FROM banded JOIN best USING (band)"


def density_loop(rounds: int, acceleration: float) -> str:
    """Fixed point with kernels widened on the way back."""
    half, wide = 2.0, f"(sqrt(kx * kx + ky * ky) / 128.0 * {acceleration - 1.0!r} + 1.0)"

    def reach(source: str, factor: str) -> str:
        inner = f"(SELECT *, unnest(range(CAST(greatest(ceil(ky + 8 - {half} * {factor}), 0) AS BIGINT), CAST(least(floor(ky + 8 + {half} * {factor}), 15) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(greatest(ceil(kx + 32 - {half} * {factor}), 0) AS BIGINT), CAST(least(floor(kx + 32 + {half} * {factor}), 63) AS BIGINT) + 1)) AS cx FROM {source}))"
        return f"SELECT l_orderkey, l_linenumber, w, cx, cy, {kernel(f'((cx - (kx + 32)) / {factor})', 'polynomial')} * {kernel(f'((cy - (ky + 8)) / {factor})', 'polynomial')} AS weight FROM {inner}"

    steps, last = [f"w0 AS (SELECT l_orderkey, l_linenumber, kx, ky, 1.0::DOUBLE AS w FROM moved)"], "w0"
    for i in range(1, rounds + 1):
        steps.append(f"g{i} AS (SELECT cx, cy, sum(w * weight) AS g FROM ({reach(last, '1.0')}) GROUP BY cx, cy), d{i} AS (SELECT l_orderkey, l_linenumber, sum(g * weight) AS d FROM ({reach(last, wide)}) JOIN g{i} USING (cx, cy) GROUP BY l_orderkey, l_linenumber), w{i} AS (SELECT l_orderkey, l_linenumber, kx, ky, CASE WHEN abs(coalesce(d, 0.0)) < 1e-3 THEN 0.0 ELSE w / d END AS w FROM {last} LEFT JOIN d{i} USING (l_orderkey, l_linenumber))")
        last = f"w{i}"
    return f"WITH {BASE}, {MOVED}, {', '.join(steps)} SELECT l_orderkey, l_linenumber, {r(f'abs(w) * pow({wide}, 3) * 1e6', 3)} AS w FROM {last}"


def residual() -> str:
    near = stencil("(SELECT * FROM moved WHERE kw <> 0)", "triangle", "l_orderkey, l_linenumber, l_returnflag, re * kw AS val")
    return f"""WITH {BASE}, {MOVED}, st AS MATERIALIZED ({near}), grid AS (SELECT l_returnflag, ckx, cky, sum(val * weight) AS g FROM st GROUP BY l_returnflag, ckx, cky),
    got AS (SELECT l_returnflag, l_orderkey, l_linenumber, sum(g * weight) AS b FROM st JOIN grid USING (l_returnflag, ckx, cky) GROUP BY l_returnflag, l_orderkey, l_linenumber),
    both_ AS (SELECT l_returnflag, re AS d, coalesce(b, 0.0) AS b FROM moved LEFT JOIN got USING (l_returnflag, l_orderkey, l_linenumber)),
    fit AS (SELECT l_returnflag, sum(d * d) / sum(d * b) AS s FROM both_ GROUP BY l_returnflag)
    SELECT l_returnflag, {r('1.25 * sum((d - s * b) * (d - s * b)) / 1e9', 2)} AS residual FROM both_ JOIN fit USING (l_returnflag) GROUP BY l_returnflag"""


def oracle_sql() -> dict[str, str]:
    w = f"WITH {BASE} "
    rank = "row_number() OVER (ORDER BY {}) - 1"
    gather = f"""WITH {BASE}, {MOVED}, st AS ({stencil('(SELECT * FROM moved WHERE kw <> 0)', 'triangle', 're * kw AS val')}), grid AS (SELECT ckx, cky, sum(val * weight) AS g FROM st GROUP BY ckx, cky),
    looks AS ({stencil('moved', 'triangle', 'l_orderkey, l_linenumber')}), got AS (SELECT l_orderkey, l_linenumber, sum(g * weight) AS re FROM looks JOIN grid USING (ckx, cky) GROUP BY l_orderkey, l_linenumber)
    SELECT l_orderkey, l_linenumber, {r('coalesce(got.re, 0.0)', 1)} AS re FROM moved LEFT JOIN got USING (l_orderkey, l_linenumber)"""
    dcf = f"""WITH {BASE}, {MOVED}, st AS ({stencil('moved', 'triangle', 'l_orderkey, l_linenumber')}), grid AS (SELECT ckx, cky, sum(weight) AS g FROM st GROUP BY ckx, cky),
    got AS (SELECT l_orderkey, l_linenumber, sum(g * weight) AS d FROM st JOIN grid USING (ckx, cky) GROUP BY l_orderkey, l_linenumber)
    SELECT l_orderkey, l_linenumber, {r('CASE WHEN abs(coalesce(d, 0.0)) < 1e-3 THEN 0.0 ELSE 1.0 / d END', 8)} AS w FROM moved LEFT JOIN got USING (l_orderkey, l_linenumber)"""
    norm = "norm AS (SELECT *, sqrt(sum(re * re + im * im) OVER (PARTITION BY vec_id)) AS s FROM cx)"
    unit = "unit AS (SELECT vec_id, coil, CASE WHEN s > 0 THEN re / s ELSE 0.0 END AS ur, CASE WHEN s > 0 THEN im / s ELSE 0.0 END AS ui FROM norm)"
    moments = ["1.0", "kz", "ky", "kx"]
    cells = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {r(f'sum({a} * {b})', 0)} AS value FROM p" for i, a in enumerate(moments) for j, b in [*enumerate(moments), (-1, "re")])
    since, beta = "(frame * 3.0 / 6 - arrival)", "(0.25 * (1 + 2 * arrival))"
    gamma = lambda b: f"pow({since}, 2) * exp(-{since} / {b}) / (2 * {b} * {b})"
    bolus = f"CASE WHEN {since} > 0 THEN density * ({gamma(beta)} + 0.25 * {gamma(f'(4 * {beta})')}) ELSE 0.0 END"
    width = "(0.5 * (3.0 * pow(abs(kr) / kmax, 2.0) + 1.0))"
    ell = lambda c, a: f"(({c} - 16.0) / 32.0 / {a!r})"
    e2 = " + ".join(f"{ell(c, a)} * {ell(c, a)}" for c, a in (("x", 0.5), ("y", 0.35), ("z", 0.25)))
    return {
        "gate_time_frames": f"WITH {FRAMED} SELECT frame, count(*) AS n, {r('sum(v * v)', 4)} AS energy FROM fr GROUP BY frame",
        "gate_hist_frames": w + f"SELECT event_id, CAST(i * 10 // n_all AS INTEGER) AS frame FROM (SELECT event_id, {rank.format('v, event_id')} AS i, count(*) OVER () AS n_all FROM sig)",
        "gate_resp_quantile": w + ", q AS (SELECT quantile_cont(v, 0.0) AS a, quantile_cont(v, 1.0) AS b FROM sig), lim AS (SELECT a - (b - a) / 7 / 2 AS lo, b + (b - a) / 7 / 2 AS hi FROM q) SELECT event_id, CAST(floor((v - lo) * 8 / (hi - lo) * (1.0 - 1e-9)) AS INTEGER) AS frame FROM sig, lim",
        "gate_retro_rr": w + f", gaps AS (SELECT (t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 1e6 AS gap FROM sig), g AS (SELECT gap FROM gaps WHERE gap IS NOT NULL), m AS (SELECT quantile_cont(gap, 0.5) * 2 AS rr FROM g) SELECT {r('any_value(rr)', 4)} AS rr, {r('quantile_cont(gap, 0.5) * 2', 4)} AS rr_clipped FROM g, m WHERE gap < rr * 1.3",
        "resp_thresh": f"WITH {BASE}{near('sig', 7)} SELECT event_id, CAST(v >= {stat(0.5)} AS INTEGER) AS weight FROM sig JOIN near USING (event_id)",
        "resp_phase_both": phase(0), "resp_phase_rise": phase(1), "resp_phase_fall": phase(2),
        "resp_hard": w + f", {CUT} SELECT event_id, CAST(v > cut AS INTEGER) AS weight FROM sig, cut",
        "resp_soft": w + f", {CUT}, top AS (SELECT max(v) AS top FROM sig) SELECT event_id, {r('CASE WHEN v >= cut THEN 1.0 ELSE exp(-(3.0 / top) * (cut - v)) END', 6)} AS weight FROM sig, cut, top",
        "resp_drift": f"WITH {BASE}{near('sig', 7)} SELECT event_id, {r('v - w[len(w) // 2 + 1]', 6)} AS corrected FROM sig JOIN near USING (event_id)",
        "dc_moving_average": w + f"SELECT event_id, {r('avg(v) OVER (ORDER BY t, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)', 6)} AS average FROM sig",
        "tornado_view_share": f"WITH {FRAMED}, km AS (SELECT CAST(max(abs(user_id)) AS DOUBLE) AS kmax FROM sig), wide AS (SELECT tf, {width.replace('kr', 'user_id')} AS width FROM framed, km) SELECT CAST(f AS INTEGER) AS frame, count(*) AS n, {r('sum(1.0 / width)', 4)} AS share FROM wide, range(0, 10) g(f) WHERE abs(tf - (f + 0.5)) < width GROUP BY f",
        "slice_reset_time": w + f", k AS (SELECT event_id, t, ({rank.format('t, event_id')}) // 50 AS block, {rank.format('t, event_id')} AS i FROM sig) SELECT event_id, block, t - first_value(t) OVER (PARTITION BY block ORDER BY i) AS since FROM k",
        "pregate": f"WITH {FRAMED}{near('fr', 7)}, kept AS (SELECT frame, 1.0 + user_id / 100.0 AS kw, count(*) OVER (PARTITION BY frame) AS points FROM fr JOIN near USING (event_id) WHERE v >= {stat(0.5)}) SELECT frame, count(*) AS points, {r('sum(kw * 1e6 / points)', 3)} AS kw FROM kept GROUP BY frame",
        "weight_combined": f"WITH {FRAMED}{near('fr', 7)} SELECT frame, {r(f'sum(CAST(v >= {stat(0.5)} AS INTEGER) * (CASE WHEN frame % 2 = 0 THEN 1.0 ELSE 0.5 END) * v)', 4)} AS signal FROM fr JOIN near USING (event_id) GROUP BY frame",
        "temporal_resolution": w + f"SELECT {r('(max(t) - min(t)) / 10', 3)} AS resolution FROM sig",
        "projection_range": w + f"SELECT event_id, i FROM (SELECT event_id, {rank.format('t, event_id')} AS i FROM sig) WHERE i >= 100 AND i < 400",
        "frame_counts_by_signal": w + "SELECT event_type, CAST(i * 6 // n_all AS INTEGER) AS frame, count(*) AS n FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n_all FROM sig) GROUP BY event_type, i * 6 // n_all",
        "range_stats": w + "SELECT event_type, min(v) AS v_min, max(v) AS v_max, min(t) AS t_min, max(t) AS t_max, count(*) AS n FROM sig GROUP BY event_type",
        "encode_subframe": w + f", {ENCODES} SELECT CAST(encode // 2 AS INTEGER) AS encode, event_type, count(*) AS n FROM enc WHERE encode <= 4 AND encode % 2 = 0 GROUP BY encode, event_type",
        "skip_encodes": w + f", {ENCODES} SELECT encode, count(*) AS n FROM enc WHERE encode NOT IN (1, 3) GROUP BY encode",
        "encodes_to_coils": w + f", {ENCODES} SELECT 0 AS encode, CAST(encode * 4 + user_id % 4 AS INTEGER) AS coil, count(*) AS n FROM enc GROUP BY encode, user_id % 4",
        "complex_difference": w + f", {ENCODES}, d AS (SELECT CAST(floor(t / 86400e6) AS BIGINT) AS day, encode, sum(v) AS re, sum(v * v) AS im FROM enc GROUP BY 1, 2) SELECT a.day, CAST(a.encode - 1 AS INTEGER) AS encode, {r('a.re - b.re', 4)} AS re, {r('a.im - b.im', 4)} AS im FROM d a JOIN d b ON a.day = b.day AND b.encode = 0 WHERE a.encode > 0",
        "demodulate": w + f"SELECT l_returnflag, {r(f'sum(re * cos({6.283185307179586 * 0.013!r} * kt))', 1)} AS re, {r(f'sum(re * sin({6.283185307179586 * 0.013!r} * kt))', 1)} AS im FROM pt GROUP BY l_returnflag",
        "mod_time": w + f"SELECT event_id, {r('(t / 1e6) % 3600.0', 4)} AS time FROM sig",
        "scale_fov": w + f"SELECT l_returnflag, {r('sum(kx * -2.0)', 2)} AS kx, {r('sum(ky * 0.5)', 2)} AS ky, 2.0::DOUBLE AS fovx, 0.5::DOUBLE AS fovy FROM pt GROUP BY l_returnflag",
        "complex_parts": w + f"SELECT vec_id, coil, {r('sqrt(re * re + im * im)', 6)} AS magnitude, {r('atan2(im, re)', 6)} AS phase, {r('re * re + im * im', 6)} AS norm FROM cx",
        "psf_source": w + "SELECT coil, CAST(count(*) AS DOUBLE) AS re, 0.0::DOUBLE AS im FROM cx GROUP BY coil",
        "add_phase": w + f"SELECT n, {r(f'sum(x * cos({math.pi / 64!r} * n))', 5)} AS re, {r(f'sum(x * sin({math.pi / 64!r} * n))', 5)} AS im FROM line GROUP BY n",
        "checkerboard": w + f"SELECT vec_id, n, {r('x * (2 * ((n + vec_id) % 2) - 1)', 6)} AS x FROM line",
        "flip": w + f"SELECT vec_id, CAST(63 - n AS INTEGER) AS n, {r('x', 6)} AS x FROM line",
        "unravel": w + "SELECT event_id, CAST(event_id % 7 AS INTEGER) AS a, CAST(event_id // 7 % 11 AS INTEGER) AS b, CAST(event_id // 77 AS INTEGER) AS c FROM sig",
        "circle_mask": w + "SELECT vec_id, CAST(count(*) FILTER (WHERE pow((n % 8 - 3.5) / 4.0, 2) + pow((n // 8 - 3.5) / 4.0, 2) <= 1) AS BIGINT) AS inside FROM line GROUP BY vec_id",
        "hole_fill_mask": w + "SELECT vec_id, CAST(coalesce(max(n) FILTER (WHERE x > 0.15) - min(n) FILTER (WHERE x > 0.15) + 1, 0) AS BIGINT) AS filled FROM line GROUP BY vec_id",
        "coil_rejection": w + f", p AS (SELECT label, sum(CASE WHEN n >= 16 AND n < 48 THEN abs(x) ELSE 0.0 END) / sum(abs(x)) AS f FROM line GROUP BY label) SELECT label, {r('f', 6)} AS fraction, CAST(f >= 0.5 AS INTEGER) AS keep FROM p",
        "fov_box": w + ", h AS (SELECT n, CAST(vec_id % 64 AS INTEGER) AS y FROM line WHERE abs(x) > (SELECT max(abs(x)) FROM line) * 0.9), b AS (SELECT min(n) AS n_min, max(n) AS n_max, min(y) AS y_min, max(y) AS y_max FROM h) SELECT *, CAST(least(ceil(greatest(32 - n_min, n_max - 32) * 2 / 16.0) * 16, 64) AS INTEGER) AS n_size, CAST(least(ceil(greatest(32 - y_min, y_max - 32) * 2 / 16.0) * 16, 64) AS INTEGER) AS y_size FROM b",
        "crop_pad": w + f"SELECT vec_id, CAST(k AS INTEGER) AS n, {r('coalesce(x, 0.0)', 6)} AS x FROM (SELECT DISTINCT vec_id FROM line) CROSS JOIN range(0, 48) g(k) LEFT JOIN (SELECT vec_id, n - 8 AS k, x FROM line WHERE n >= 16 AND n < 48) USING (vec_id, k)",
        "k_radius": w + f"SELECT l_returnflag, count(*) AS n, {r('sum(re)', 1)} AS re FROM pt WHERE kx * kx + ky * ky < 144 GROUP BY l_returnflag",
        "zero_weight_skip": w + f"SELECT l_linestatus, count(*) AS n, {r('sum(re * kw)', 1)} AS weighted FROM pt WHERE kw <> 0 GROUP BY l_linestatus",
        "intensity_bias": w + f", b AS (SELECT n, avg(abs(x)) AS bias FROM line GROUP BY n) SELECT vec_id, n, {r('CASE WHEN bias = 0 THEN 0.0 ELSE x / bias END', 5)} AS x FROM line JOIN b USING (n)",
        "composite_difference": w + f", m AS (SELECT n, avg(x) AS m FROM line GROUP BY n) SELECT vec_id, n, {r('x - m', 6)} AS x FROM line JOIN m USING (n)",
        "normalise_to_max": w + f", top AS (SELECT max(sqrt(re * re + im * im)) AS top FROM cx) SELECT vec_id, coil, {r('re / top', 6)} AS re, {r('im / top', 6)} AS im FROM cx, top",
        "reset_density": w + f"SELECT l_returnflag, {r('sum(least(kw * 3, 0.1))', 3)} AS kw FROM pt GROUP BY l_returnflag",
        "grid_scatter_tri": scatter("triangle"), "grid_scatter_poly": scatter("polynomial"), "grid_scatter_poly_2": scatter("polynomial_2"), "grid_scatter_kb": scatter("kaiser_bessel"),
        "degrid_gather": gather, "dcf_step": dcf,
        "low_pass_grid": w + f", st AS (SELECT re * kw * exp(-(kx * kx + ky * ky) / 200.0) AS val, kx, unnest(range(CAST(greatest(ceil(kx + 32 - 1.0), 0) AS BIGINT), CAST(least(floor(kx + 32 + 1.0), 63) AS BIGINT) + 1)) AS cx, CAST(floor(ky + 8) AS BIGINT) AS cy FROM pt WHERE kw <> 0) SELECT CAST(cx AS INTEGER) AS ckx, CAST(cy AS INTEGER) AS cky, {r('sum(val * ' + kernel('(cx - (kx + 32))', 'triangle') + ' * (2.0 * (cx % 2) - 1) * (2.0 * (cy % 2) - 1))', 1)} AS re FROM st WHERE cy >= 0 AND cy < 16 GROUP BY cx, cy",
        "bessel_i0": w + f"SELECT event_id, {r(i0('(v / 100.0)'), 6)} AS i0 FROM sig",
        "coil_gramian": gram(False), "coil_covariance": gram(True),
        "coil_sos": w + f"SELECT vec_id, {r('sqrt(sum(re * re + im * im))', 6)} AS sos FROM cx GROUP BY vec_id",
        "coil_normalise": w + f", {norm}, {unit} SELECT vec_id, coil, {r('ur', 6)} AS re, {r('ui', 6)} AS im FROM unit",
        "coil_argmax": w + f"SELECT coil, {r('sum(re * re + im * im)', 4)} AS energy FROM cx GROUP BY coil ORDER BY sum(re * re + im * im) DESC, coil LIMIT 1",
        "coil_combine": w + f", {norm}, {unit} SELECT vec_id, {r('sum(re * ur + im * ui)', 6)} AS re, {r('sum(im * ur - re * ui)', 6)} AS im FROM cx JOIN unit USING (vec_id, coil) GROUP BY vec_id",
        "coil_phase_reference": w + f", {norm}, ref AS (SELECT vec_id, atan2(im, re) AS a FROM cx WHERE coil = 0) SELECT vec_id, coil, {r('CASE WHEN s > 0 THEN (re * cos(a) + im * sin(a)) / s ELSE 0.0 END', 6)} AS re, {r('CASE WHEN s > 0 THEN (im * cos(a) - re * sin(a)) / s ELSE 0.0 END', 6)} AS im FROM norm JOIN ref USING (vec_id)",
        "array_energy": w + f"SELECT label, {r('sum(re * re + im * im)', 4)} AS energy FROM cx GROUP BY label",
        "conj_sum": w + f"SELECT {r('sum(a.re * b.re + a.im * b.im)', 5)} AS re, {r('sum(a.im * b.re - a.re * b.im)', 5)} AS im FROM cx a JOIN cx b ON a.vec_id = b.vec_id AND a.coil = (b.coil + 1) % 8",
        "apply_matrix": w + f", {matrix(q.MATRIX)} SELECT vec_id, CAST(r AS INTEGER) AS coil, {r('sum(mre * re - mim * im)', 6)} AS re, {r('sum(mre * im + mim * re)', 6)} AS im FROM cx JOIN mat ON c = coil GROUP BY vec_id, r",
        "dft_line": dft("-"), "idft_line": dft(""),
        "haar_forward": wave("db2"), "haar_inverse": unwave("db2"), "db4_forward": wave("db4"), "db4_inverse": unwave("db4"),
        "subband_energy": w + f", {BAND} SELECT band, {r('sum(x * x)', 4)} AS energy, count(*) AS n FROM banded GROUP BY band",
        "diff_transform": w + f"SELECT vec_id, n, {r('CASE WHEN n = 0 THEN sum(x) OVER (PARTITION BY vec_id) ELSE lag(x) OVER (PARTITION BY vec_id ORDER BY n) - x END', 6)} AS x FROM line",
        "time_difference_matrix": frames_matrix(lines.difference_matrix(64)), "time_wavelet_matrix": frames_matrix(lines.haar_matrix(64)),
        "inverse_time_difference": frames_matrix(np.linalg.inv(lines.difference_matrix(64))), "inverse_time_wavelet": frames_matrix(lines.haar_matrix(64).T),
        "gaussian_line": convolve(gauss(1.0, 5, True), False), "gaussian_unnorm": convolve(gauss(2.0, 6, False), False),
        "laplacian_periodic": convolve({-1: -0.5, 0: 1.0, 1: -0.5}, True),
        "block_sums": w + f"SELECT label, CAST(n // 8 AS INTEGER) AS block, {r('sum(x)', 4)} AS x FROM line GROUP BY label, n // 8",
        "soft_threshold": w + f"SELECT vec_id, n, {r(soft('x', '0.1'), 6)} AS x FROM line",
        "hard_threshold": w + f"SELECT vec_id, n, {r('CASE WHEN abs(x) <= 0.1 THEN 0.0 ELSE x END', 6)} AS x FROM line",
        "soft_threshold_grouped": w + f", m AS (SELECT *, CASE WHEN sqrt(re * re + im * im) <= 0.1 THEN 0.0 ELSE 1.0 - 0.1 / sqrt(re * re + im * im) END AS f FROM cx) SELECT vec_id, coil, {r('re * f', 6)} AS re, {r('im * f', 6)} AS im FROM m",
        "soft_threshold_split": w + f"SELECT vec_id, coil, {r(soft('re', '0.1'), 6)} AS re, {r(soft('(im * 2.0)', '0.1') + ' / 2.0', 6)} AS im FROM cx",
        "threshold_fraction": w + f"SELECT {r('quantile_cont(abs(x), 0.3)', 6)} AS threshold FROM line",
        "noise_mad": w + f", {BAND} SELECT band, {r('quantile_cont(abs(x), 0.5) / 0.6745', 6)} AS noise FROM banded GROUP BY band",
        "visu_threshold": w + f", {BAND} SELECT band, {r('quantile_cont(abs(x), 0.5) / 0.6745 / 8.0 * sqrt(2.0 * ln(count(*) / 8.0))', 6)} AS threshold FROM banded GROUP BY band",
        "bayes_threshold": w + f", {BAND}, v AS (SELECT band, var_pop(x) / 2.0 - {0.02**2!r} AS l, max(abs(x)) AS m FROM banded GROUP BY band) SELECT band, {r(f'CASE WHEN l > 0 THEN {0.02**2!r} / sqrt(l) ELSE m END', 6)} AS threshold FROM v",
        "sure_threshold": f"WITH {BASE}, {SURE} SELECT band, {r('threshold', 6)} AS threshold FROM best",
        "multiband_sure": cut_bands(SURE), "multiband_fraction": cut_bands(f"{BAND}, best AS (SELECT band, quantile_cont(abs(x), 0.3) AS threshold FROM banded GROUP BY band)", "0.5"),
        "multiband_bayes": cut_bands(f"{BAND}, v AS (SELECT band, var_pop(x) / 2.0 - {0.02**2!r} AS l, max(abs(x)) AS m FROM banded GROUP BY band), best AS (SELECT band, CASE WHEN l > 0 THEN {0.02**2!r} / sqrt(l) ELSE m END AS threshold FROM v)"),
        "l2_gradient_tv": w + f", {TV} {voxels('tv')}", "l2_gradient_phase": w + f", {VOLUME} {voxels('vol', '0.0')}",
        "l2_scale": w + f", {TV}, e AS (SELECT 'none' AS kind, sum(re * re + im * im) AS e FROM vol UNION ALL SELECT 'phase', sum(im * im) FROM vol UNION ALL SELECT 'tv', sum(re * re + im * im) FROM tv) SELECT kind, p AS per_volume, {r('CASE WHEN p THEN 0.1 * sqrt(2 / e) ELSE 0.1 * 2 / e END * 1e6', 4)} AS scale FROM e, (VALUES (false), (true)) m(p)",
        "normalised_blur": w + f", b AS (SELECT a.vec_id, a.n, sum(b.x * exp(-(b.n - a.n) * (b.n - a.n) / 8.0)) AS s, sum(CASE WHEN b.x > 0 THEN exp(-(b.n - a.n) * (b.n - a.n) / 8.0) ELSE 0 END) AS m FROM line a JOIN line b ON a.vec_id = b.vec_id AND abs(a.n - b.n) <= 6 GROUP BY a.vec_id, a.n) SELECT vec_id, n, {r('CASE WHEN m > 0 THEN s / m ELSE 0.0 END', 5)} AS x FROM b",
        "dcf_loop": density_loop(2, 3.0), "kspace_residual": residual(),
        "shot_signal": w + f"SELECT o_orderpriority, count(*) AS n, {r('sum(kw * o_totalprice)', 0)} AS signal FROM pt JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority",
        "coil_rejection_disc": w + f", p AS (SELECT label, sum(CASE WHEN pow((n // 8 - 4) / 8.0, 2) + pow((n % 8 - 4) / 8.0, 2) < 0.3 * 0.3 THEN abs(x) ELSE 0.0 END) / sum(abs(x)) AS f FROM line GROUP BY label) SELECT label, {r('f', 6)} AS fraction, CAST(f >= 0.3 AS INTEGER) AS keep FROM p",
        "fov_sphere": w + ", h AS (SELECT n, CAST(vec_id % 64 AS INTEGER) AS y FROM line WHERE abs(x) > (SELECT max(abs(x)) FROM line) * 0.5 AND pow(2.0 * n / 64 - 1, 2) + pow(2.0 * (vec_id % 64) / 64 - 1, 2) <= 1), b AS (SELECT min(n) AS n_min, max(n) AS n_max, min(y) AS y_min, max(y) AS y_max FROM h) SELECT *, CAST(least(ceil(greatest(32 - n_min, n_max - 32) * 2 / 16.0) * 16, 64) AS INTEGER) AS n_size, CAST(least(ceil(greatest(32 - y_min, y_max - 32) * 2 / 16.0) * 16, 64) AS INTEGER) AS y_size FROM b",
        "poly_moments": w + f", p AS (SELECT kx, ky, kw * 100 AS kz, re FROM pt) {cells}",
        "fista_momentum": w + f"SELECT vec_id, n, {r(f'{1 + 4 / 6!r} * x - {4 / 6!r} * (x * 0.5)', 6)} AS x FROM line",
        "ellipsoid_phantom": f"SELECT density, count(*) AS n FROM (SELECT CASE WHEN {e2} < 0.75 THEN 1 WHEN {e2} < 1 THEN 4 ELSE 0 END AS density FROM range(0, 32) a(x), range(0, 32) b(y), range(0, 32) c(z)) GROUP BY density",
        "bolus_curve": w + f", s AS (SELECT event_id % 7 / 10.0 AS arrival, v AS density, f AS frame FROM sig, range(0, 6) g(f)) SELECT CAST(frame AS INTEGER) AS frame, {r(f'sum({bolus})', 4)} AS signal FROM s GROUP BY frame",
    }
