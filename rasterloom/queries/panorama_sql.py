"""DuckDB SQL for the queries of panorama.py, written from the definitions and not from the Spark code."""

from __future__ import annotations

import math

from rasterloom.queries.panorama import BENT, CURVES, GRIDS, HANDLES, HUES, LENS, PAIRS, ROWS, SHEAR, SLIDE, STROKES, TONE
from rasterloom.queries.raster_sql import BACK, FRAME, LUMA, OKLAB, RGB, clip, cubic, d, dec, dot, enc, final, gathered, gauss_kernel, gauss_pass, luma, window_mean


def blur(src: str, dst: str, cols: list[str], sigma: float) -> str:
    k = gauss_kernel(sigma, 3)
    one = lambda ax: ", ".join(f"{gauss_pass(c, ax, k)} AS {c}" for c in cols)
    return f"{dst}x AS MATERIALIZED (SELECT * REPLACE ({one('x')}) FROM {src}), {dst} AS MATERIALIZED (SELECT * REPLACE ({one('y')}) FROM {dst}x)"


def sheared(channels: str) -> str:
    """A frame whose places move right by a cubic of their height, read bilinearly where it doesn't stretch and by a cubic, held within the four pixels around, where it does."""
    t = "((y + 0.5) / h)"
    pull = f"({d(SHEAR)} * (-pow({t}, 3) + 1.5 * pow({t}, 2) + 0.5 * {t}))"
    cr = ["(-pow(t, 3) + 2 * t * t - t) / 2", "(3 * pow(t, 3) - 5 * t * t + 2) / 2", "(-3 * pow(t, 3) + 4 * t * t + t) / 2", "(pow(t, 3) - t * t) / 2"]
    lin = ["0", "1 - t", "t", "0"]
    weights = ", ".join(f"({a} + ({b} - ({a})) * share) AS k{i}" for i, (a, b) in enumerate(zip(lin, cr, strict=True)))
    value = lambda c: f"CASE WHEN share > 0 THEN least(greatest(s{c}, lo{c}), hi{c}) ELSE s{c} END AS {c}"
    sums = ", ".join(f"sum(wt * f.{c}) AS s{c}, min(f.{c}) FILTER (core) AS lo{c}, max(f.{c}) FILTER (core) AS hi{c}" for c in channels)
    return f"""p0 AS (SELECT y, x, w, h, x + 0.5 - w * {pull} AS fx FROM f),
    p1 AS (SELECT *, (coalesce(lead(fx) OVER u, fx) - coalesce(lag(fx) OVER u, fx)) / greatest(least(y + 1, h - 1) - greatest(y - 1, 0), 1) AS s FROM p0 WINDOW u AS (PARTITION BY x ORDER BY y)),
    p2 AS (SELECT *, 2 / (2 + s * s + sqrt(pow(2 + s * s, 2) - 4)) AS small, least(greatest(least(greatest(fx, 0), w) - 0.5, 0), w - 1) AS gx FROM p1),
    p3 AS (SELECT *, {clip(f"(1 / sqrt(small) - {d(1.01)}) / {d(0.24)}")} AS e, floor(gx) AS x0, gx - floor(gx) AS t FROM p2),
    p4 AS (SELECT *, CASE WHEN small < {d(1 / 1.01**2)} THEN e * e * (3 - 2 * e) ELSE 0 END AS share FROM p3),
    p5 AS (SELECT *, {weights} FROM p4),
    p6 AS (SELECT y, x, w, h, x0, share, unnest([{{'i': 0, 'j': 0, 'wt': k0}}, {{'i': 1, 'j': 0, 'wt': k1}}, {{'i': 2, 'j': 0, 'wt': k2}}, {{'i': 3, 'j': 0, 'wt': k3}}, {{'i': 1, 'j': 1, 'wt': 0}}, {{'i': 2, 'j': 1, 'wt': 0}}]) AS k FROM p5),
    p7 AS (SELECT y, x, share, least(greatest(x0 + k.i - 1, 0), w - 1) AS cx, least(y + k.j, h - 1) AS cy, CAST(k.wt AS DOUBLE) AS wt, k.i IN (1, 2) AS core FROM p6),
    q AS (SELECT y, x, {', '.join(map(value, channels))} FROM (SELECT p7.y, p7.x, any_value(share) AS share, {sums} FROM p7 JOIN f ON f.x = cx AND f.y = cy GROUP BY p7.y, p7.x))"""


def through(points: list[dict], x: str, linear: bool = False) -> str:
    """A curve through points, with the slope of each one's neighbours or straight, flat beyond its ends."""
    xs, ys = [p["x"] for p in points], [p["y"] for p in points]
    n = len(xs)
    slope = [(ys[min(i + 1, n - 1)] - ys[max(i - 1, 0)]) / (xs[min(i + 1, n - 1)] - xs[max(i - 1, 0)]) for i in range(n)]
    out = f"CASE WHEN {x} <= {d(xs[0])} THEN {d(ys[0])} WHEN {x} >= {d(xs[-1])} THEN {d(ys[-1])}"
    for i in range(n - 1):
        w = xs[i + 1] - xs[i]
        t = f"(({x} - {d(xs[i])}) / {d(w)})"
        here = f"{d(ys[i])} + {d(ys[i + 1] - ys[i])} * {t}"
        if not linear:
            here = f"(2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) * {d(ys[i])} + (pow({t}, 3) - 2 * pow({t}, 2) + {t}) * {d(w * slope[i])} + (3 * pow({t}, 2) - 2 * pow({t}, 3)) * {d(ys[i + 1])} + (pow({t}, 3) - pow({t}, 2)) * {d(w * slope[i + 1])}"
        out += f" WHEN {x} <= {d(xs[i + 1])} THEN {here}"
    return f"({out} END)"


def round_about(points: list[dict]) -> list[dict]:
    return [{"x": p["x"] + k, "y": p["y"]} for k in (-360, 0, 360) for p in points]


def hue(a: str, b: str) -> str:
    return f"(CASE WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END)"


def guarded(chroma: str, guard: float) -> str:
    t = clip(f"({chroma} - {d(0.001 * guard)}) / {d(0.005 * guard - 0.001 * guard)}")
    return f"({t} * {t} * (3 - 2 * {t}))"


def recoloured(pre: str, dh="0", sat="1", ev="0", pastel="0", temp="0", tint="0", vib="0") -> str:
    """The picture with its terms done. pre ends with n, which holds ll, la, lb of the picture and what the terms are told by."""
    lab = ("n2l", "n2a", "n2b")
    back = ", ".join(f"pow({dot(row, lab)}, 3) AS c{i}" for i, row in enumerate(BACK))
    rgb = ", ".join(f"greatest({dot(row, ('c0', 'c1', 'c2'))}, 0) * gain AS n{c}" for c, row in zip("rgb", RGB, strict=True))
    return final(f"""{pre}, r0 AS (SELECT *, {dh} AS dh, greatest({sat}, 0) AS sk, {clip(ev, -2, 2)} AS ev, {clip(pastel, -1)} AS ps, {clip(temp, -1)} AS tm, {clip(tint, -1)} AS ti, {clip(vib, -1)} AS vb FROM n),
    r1 AS (SELECT *, pow(2::DOUBLE, ev) AS gain, atan2(lb, la) + radians(dh) AS hh, sqrt(la * la + lb * lb) * sk AS ch FROM r0),
    r2 AS (SELECT *, ch * greatest(1 + vb * (1 - {clip(f"ch / {d(0.3)}")}), 0) AS cc, greatest(ll, 1 / cbrt(gain)) AS lw FROM r1),
    r3 AS (SELECT *, ll + ps * (lw - ll) AS n2l, (cc * cos(hh) + ti * {d(0.08)}) * (1 - ps) AS n2a, (cc * sin(hh) + tm * {d(0.08)}) * (1 - ps) AS n2b FROM r2),
    r4 AS (SELECT *, {back} FROM r3), r5 AS (SELECT y, x, a, {rgb} FROM r4), q AS (SELECT y, x, nr AS r, ng AS g, nb AS b, a FROM r5)""")


def recolours() -> dict[str, str]:
    out = {}
    ev = f"({clip(f'log2(greatest({LUMA}, 1e-7::DOUBLE) / {d(0.18)})', -8, 6)})"
    wide = lambda ax: ", ".join(f"{window_mean(c, ax, 1)} AS {c}" for c in ("sa", "sb"))
    index = f"n AS (SELECT *, {hue('sa', 'sb')} AS hi, {clip('sqrt(sa * sa + sb * sb) / 0.3::DOUBLE * 100', 0, 100)} AS si, {ev} AS ei, {guarded('least(sqrt(sa * sa + sb * sb), sqrt(la * la + lb * lb))', 10)} AS gt FROM n1)"
    pre = f"{OKLAB}, m0 AS (SELECT *, la AS sa, lb AS sb FROM k), m1 AS (SELECT * REPLACE ({wide('x')}) FROM m0), n1 AS (SELECT * REPLACE ({wide('y')}) FROM m1), {index}"
    out["recolor__curves"] = recoloured(
        pre, f"{clip(through(round_about(CURVES['hue_hue']), 'hi'), -60, 60)} * gt", f"1 + {clip(through(round_about(CURVES['hue_sat']), 'hi'), -100, 100)} / 100 * gt",
        clip(through(CURVES["sat_lum"], "si"), -2, 2), f"{clip(through(CURVES['lum_pastel'], 'ei'), -100, 100)} / 100", f"{clip(through(CURVES['lum_temp'], 'ei'), -100, 100)} / 100",
    )

    pre = f"{OKLAB}, n1 AS (SELECT *, la AS sa, lb AS sb FROM k), {index}"
    grid = ", ".join(d(v) for row in GRIDS["huelum_sat"] for v in row)
    v = clip("(ei + 6) / 9 * 4", 0, 4)
    cell = lambda r, c: f"([{grid}])[CAST({r} * 12 + {c} + 1 AS BIGINT)]"
    pre += f", g0 AS (SELECT *, CAST(floor(hi / 30) AS BIGINT) % 12 AS g0c, (CAST(floor(hi / 30) AS BIGINT) + 1) % 12 AS g1c, hi / 30 - floor(hi / 30) AS fu, floor({v}) AS g0r, least(floor({v}) + 1, 4) AS g1r, {v} - floor({v}) AS fv FROM n)"
    pre += f", g1 AS (SELECT *, {cell('g0r', 'g0c')} + ({cell('g0r', 'g1c')} - {cell('g0r', 'g0c')}) * fu AS up, {cell('g1r', 'g0c')} + ({cell('g1r', 'g1c')} - {cell('g1r', 'g0c')}) * fu AS lo FROM g0)"
    dh, sat, lift = "0", "(1 + (up + (lo - up) * fv) / 100 * gt)", "0"
    for p in PAIRS:
        a, b = p["a"], p["b"]
        apart = (a["h"] - b["h"] + 540) % 360 - 180
        turn = p["sep"] / 100 * 30
        turn = (1 if apart >= 0 else -1) * (max(turn, -abs(apart) / 2) if turn < 0 else min(turn, (180 - abs(apart)) / 2))
        e = p["lum"] / 100 * 0.5
        e = max(e, -abs(a["ev"] - b["ev"]) / 2) if e < 0 else e
        e = e if a["ev"] >= b["ev"] else -e
        gap = lambda h: f"least(abs(hi - {d(h)}), 360 - abs(hi - {d(h)}))"
        wa, wb = (f"(CASE WHEN {gap(c['h'])} >= {p['width']} THEN 0 ELSE 0.5 * (1 + cos({d(math.pi)} * {gap(c['h'])} / {p['width']})) END * gt)" for c in (a, b))
        dh, lift = f"{dh} + {d(turn)} * {wa} - {d(turn)} * {wb}", f"{lift} + {d(e)} * {wa} - {d(e)} * {wb}"
        sat += f" * (1 + {d(p['sat'] / 200)} * {wa}) * (1 - {d(p['sat'] / 200)} * {wb})"
    out["recolor__pairs"] = recoloured(pre.replace(", g0 AS (SELECT", ", g0 AS (SELECT", 1) + ", nn AS (SELECT * FROM g1)", dh, sat, lift).replace("FROM n),\n    r1", "FROM nn),\n    r1")

    # the lookup's colours are those of the picture with its channels in another order
    other = OKLAB.replace("FROM f)", "FROM (SELECT y, x, b AS r, r AS g, g AS b FROM f))").replace("k1 AS", "o1 AS").replace("FROM k1", "FROM o1").replace(", k AS", ", o AS")
    around = lambda ax: ", ".join(f"{window_mean(c, ax, 4)} AS {c}" for c in ("aa", "ab"))
    pre = f"{OKLAB}, {other}, m0 AS (SELECT k.*, o.la AS sa, o.lb AS sb, k.la AS aa, k.lb AS ab FROM k JOIN o USING (y, x)), m1 AS (SELECT * REPLACE ({around('x')}) FROM m0), m2 AS (SELECT * REPLACE ({around('y')}) FROM m1)"
    pre += f", m3 AS (SELECT *, {hue('sa', 'sb')} AS hi, {guarded('sqrt(sa * sa + sb * sb)', 30)} AS gt, {hue('aa', 'ab')} AS ah, {guarded('sqrt(aa * aa + ab * ab)', 30)} AS ag, {clip('v * 100', 0, 100)} AS di, {clip(f'{LUMA} * 100', 0, 100)} AS mi FROM m2)"
    curve = through(round_about(ROWS["hue_hue"]), "CAST(u.g AS DOUBLE)", True)
    pre += f", s0 AS (SELECT u.g AS g, {clip(curve, -100, 100)} AS s FROM (SELECT unnest(range(360)) AS g) u), s1 AS (SELECT g, (s - avg(s) OVER ()) / 100 AS s FROM s0), s2 AS (SELECT 0 AS g, 0::DOUBLE AS acc UNION ALL SELECT g + 1, sum(s) OVER (ORDER BY g) FROM s1)"
    pre += ", n AS (SELECT m3.*, p.acc + (p2.acc - p.acc) * (hi - floor(hi)) AS sp FROM m3 JOIN s2 p ON p.g = least(CAST(floor(hi) AS BIGINT), 359) JOIN s2 p2 ON p2.g = p.g + 1)"
    out["recolor__rows"] = recoloured(pre, f"{clip('sp', -60, 60)} * gt", ev=clip(through(ROWS["depth_lum"], "di", True), -2, 2), tint=f"{through(ROWS['mask_tint'], 'mi', True)} / 100", vib=f"{through(round_about(ROWS['around_vib']), 'ah', True)} / 100 * ag")
    return out


def denoised(block: int) -> str:
    h2 = (0.008 + 0.10 * (0.6 if block else 0.4) ** 2) ** 2
    n = 2 * block + 1
    return final(f"""sz AS (SELECT max(w) AS w, max(h) AS h FROM f), o AS (SELECT * FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
    t AS (SELECT ty, tx, w, h FROM sz, (SELECT unnest(range(-{block}, CAST(h AS BIGINT) + {block})) AS ty FROM sz), (SELECT unnest(range(-{block}, CAST(w AS BIGINT) + {block})) AS tx FROM sz)),
    e AS (SELECT ty, tx, dy, dx, (pow(p.r - n.r, 2) + pow(p.g - n.g, 2) + pow(p.b - n.b, 2)) / 3 AS e FROM t CROSS JOIN o
      JOIN f p ON p.y = least(greatest(ty, 0), t.h - 1) AND p.x = least(greatest(tx, 0), t.w - 1)
      JOIN f n ON n.y = least(greatest(ty + dy, 0), t.h - 1) AND n.x = least(greatest(tx + dx, 0), t.w - 1)),
    e1 AS (SELECT ty, tx, dy, dx, sum(e) OVER (PARTITION BY dy, dx, ty ORDER BY tx ROWS BETWEEN {block} PRECEDING AND {block} FOLLOWING) AS e FROM e),
    e2 AS (SELECT ty, tx, dy, dx, exp(-sum(e) OVER (PARTITION BY dy, dx, tx ORDER BY ty ROWS BETWEEN {block} PRECEDING AND {block} FOLLOWING) / {d(n * n * h2)}) AS k FROM e1),
    j AS (SELECT f.y, f.x, {', '.join(f'any_value(f.{c}) AS {c}, sum(k * n.{c}) / sum(k) AS m{c}' for c in 'rgb')}, any_value(f.a) AS a, pow(least(count(*) FILTER (k > 0.36) / 49.0::DOUBLE / 0.66::DOUBLE, 1), 2) AS bl
      FROM f JOIN e2 ON e2.ty = f.y AND e2.tx = f.x JOIN f n ON n.y = least(greatest(f.y + dy, 0), f.h - 1) AND n.x = least(greatest(f.x + dx, 0), f.w - 1) GROUP BY f.y, f.x),
    q AS (SELECT y, x, {', '.join(f'{c} + (m{c} - {c}) * bl AS {c}' for c in 'rgb')}, a FROM j)""")


def extremes() -> str:
    at = lambda i: 1.6 * 2 ** (i / 3)
    steps = [f"l0i AS (SELECT y, x, pow(greatest({LUMA}, 0), {d(1 / 2.2)}) AS v FROM f)", blur("l0i", "l0", ["v"], math.sqrt(1.6**2 - 0.25))]
    for i in range(1, 6):
        steps.append(blur(f"l{i - 1}", f"l{i}", ["v"], math.sqrt(at(i) ** 2 - at(i - 1) ** 2)))
    near = "lag({0}) OVER (PARTITION BY {1} ORDER BY {2}), lead({0}) OVER (PARTITION BY {1} ORDER BY {2})"
    for i in range(5):
        steps.append(f"d{i} AS (SELECT b.y, b.x, b.v - a.v AS v FROM l{i} a JOIN l{i + 1} b USING (y, x))")
        for s, fn in (("h", "greatest"), ("l", "least")):
            steps.append(f"d{i}{s} AS (SELECT y, x, v, {fn}({near.format('v', 'y', 'x')}) AS side, {fn}(v, {near.format('v', 'y', 'x')}) AS line FROM d{i})")
            steps.append(f"e{i}{s} AS (SELECT y, x, v, {fn}(side, {near.format('line', 'x', 'y')}) AS ring, {fn}(line, {near.format('line', 'x', 'y')}) AS whole FROM d{i}{s})")
    parts = []
    for i in (1, 2, 3):
        parts.append(f"""SELECT {i} AS level, h.y, h.x, round(h.v, 6) AS response FROM e{i}h h JOIN e{i}l l USING (y, x) JOIN e{i - 1}h ah USING (y, x) JOIN e{i - 1}l al USING (y, x) JOIN e{i + 1}h bh USING (y, x) JOIN e{i + 1}l bl USING (y, x) JOIN sz ON h.y BETWEEN 1 AND sz.h - 2 AND h.x BETWEEN 1 AND sz.w - 2
          WHERE abs(h.v) >= {d(0.013 / 2)} AND (h.v > greatest(h.ring, ah.whole, bh.whole) OR h.v < least(l.ring, al.whole, bl.whole))""")
    return f"WITH f AS ({FRAME}), sz AS (SELECT max(h) AS h, max(w) AS w FROM f), {', '.join(steps)} {' UNION ALL '.join(parts)}"


def sightings() -> str:
    """Where the second of two cameras truly sees each part that both see."""
    rows = []
    for k in range(4):
        w = [0.03 * k, -0.25 * k, 0.02 * k]
        n = math.sqrt(sum(v * v for v in w)) or 1.0
        x, y, z = (v / n for v in w)
        s, c = math.sin(n if k else 0.0), math.cos(n if k else 0.0)
        # Rodrigues' formula
        rows.append([[c + x * x * (1 - c), x * y * (1 - c) - z * s, x * z * (1 - c) + y * s], [y * x * (1 - c) + z * s, c + y * y * (1 - c), y * z * (1 - c) - x * s], [z * x * (1 - c) - y * s, z * y * (1 - c) + x * s, c + z * z * (1 - c)]])
    views = " UNION ALL ".join(f"SELECT p_partkey AS part, {k} AS f, {', '.join(f'u * {d(r[0])} + v * {d(r[1])} + {d(r[2])} AS c{i}' for i, r in enumerate(m))}, {d(600 + 7 * k)} AS focal FROM ray" for k, m in enumerate(rows))
    return f"""WITH ray AS (SELECT p_partkey, CAST(p_partkey * 7919 % 1973 AS DOUBLE) / 986.5::DOUBLE - 1 AS u, CAST(p_partkey * 104729 % 1487 AS DOUBLE) / 1487::DOUBLE - 0.5 AS v FROM part), cam AS ({views}),
    seen AS (SELECT part, f, focal * c0 / c2 AS x, focal * c1 / c2 AS y FROM cam WHERE c2 > 0.2 AND abs(focal * c0 / c2) <= 400 AND abs(focal * c1 / c2) <= 300)
    SELECT a.part, CAST(a.f AS BIGINT) AS a, CAST(b.f AS BIGINT) AS b, round(b.x + 1e-9::DOUBLE, 3) AS x, round(b.y + 1e-9::DOUBLE, 3) AS y FROM seen a JOIN seen b ON a.part = b.part AND b.f = a.f + 1"""


def bands() -> str:
    frames = "fr AS (SELECT 0 AS k, y, x, CASE WHEN x < 70 THEN r ELSE 0 END AS r, CASE WHEN x < 70 THEN g ELSE 0 END AS g, CASE WHEN x < 70 THEN b ELSE 0 END AS b, CASE WHEN x < 50 THEN 1::DOUBLE ELSE 0::DOUBLE END AS m FROM f UNION ALL SELECT 1, y, x, CASE WHEN x >= 30 THEN b ELSE 0 END, CASE WHEN x >= 30 THEN r ELSE 0 END, CASE WHEN x >= 30 THEN g ELSE 0 END, CASE WHEN x >= 50 THEN 1::DOUBLE ELSE 0::DOUBLE END FROM f)"
    soft = blur("fr", "bl", ["r", "g", "b", "m"], 5.0).replace("PARTITION BY y", "PARTITION BY k, y").replace("PARTITION BY x", "PARTITION BY k, x")
    value = lambda c: f"greatest(sum((fr.{c} - bl.{c}) * fr.m) / sum(fr.m) + CASE WHEN sum(bl.m) > 1e-6 THEN sum(bl.{c} * bl.m) / sum(bl.m) ELSE 0 END, 0) AS {c}"
    return final(f"{frames}, {soft}, q AS (SELECT fr.y, fr.x, {', '.join(map(value, 'rgb'))}, 1::DOUBLE AS a FROM fr JOIN bl USING (k, y, x) GROUP BY fr.y, fr.x)")


def opened(radius: float) -> list[tuple[int, int, float]]:
    """The lens's opening at a radius: a bulging polygon, darker in its middle."""
    r, seg, bulge, dark, out = max(radius, 0.6), math.pi / LENS["blades"], LENS["blade_curve"] / 100, LENS["bubble"] / 100, []
    for dy in range(-math.ceil(r + 1), math.ceil(r + 1) + 1):
        for dx in range(-math.ceil(r + 1), math.ceil(r + 1) + 1):
            d_ = math.sqrt(dx * dx + dy * dy)
            side = math.cos(seg) / math.cos((math.atan2(dy, dx) % (2 * seg)) - seg)
            limit = r * (side * (1 - bulge) + bulge)
            w = max(0.0, min(1.0, 1 + limit - d_)) * (1 - dark + dark * min(1.0, d_ / limit) ** 3)
            if d_ <= r + 1 and w > 0:
                out.append((dx, dy, w))
    total = sum(w for _, _, w in out)
    return [(dx, dy, w / total) for dx, dy, w in out]


def focused() -> str:
    """Slices of depth of a frame whose shorter side is 100."""
    rows = []
    for k in range(16):
        centre = (2 * k + 1) / 16 - 1
        r = max(0.0, LENS["aperture"] / 100 * 3 * (abs(centre) - 1 / 16))
        split = LENS["fringe"] / 100 * 0.35 * (1 if centre > 0 else -1)
        radii = {"r": r * (1 + split), "g": r, "b": r * (1 - split), "a": r}
        for c, radius in radii.items():
            for dx, dy, w in opened(radius) if max(radii.values()) >= 0.5 else [(0, 0, 1.0)]:
                rows.append(f"({k}, '{c}', {dx}, {dy}, {w!r}::DOUBLE)")
    off = "2 * (pow(x / w - 0.5, 2) + pow(y / h - 0.5, 2))"
    signed = f"v - {clip(f'{d(LENS['focus'] / 100)} + {d(LENS['field_curve'] / 100 * 0.6)} * {off}')}"
    return final(f"""taps AS (SELECT * FROM (VALUES {', '.join(rows)}) t(k, c, dx, dy, tw)), s0 AS (SELECT *, {signed} AS sg FROM f),
    s1 AS (SELECT * FROM (SELECT y, x, r, g, b, k, greatest(0, 1 - abs(sg - ((2 * k + 1) / 16::DOUBLE - 1)) * 8) * a AS cv FROM s0, (SELECT unnest(range(16)) AS k)) WHERE cv > 0),
    s2 AS (SELECT f.y, f.x, taps.k, taps.c, sum(tw * cv * CASE c WHEN 'r' THEN s1.r WHEN 'g' THEN s1.g WHEN 'b' THEN s1.b ELSE 1 END) AS q FROM f CROSS JOIN taps JOIN s1 ON s1.k = taps.k AND s1.x = least(greatest(f.x + dx, 0), w - 1) AND s1.y = least(greatest(f.y + dy, 0), h - 1) GROUP BY ALL),
    s3 AS (SELECT y, x, k, {', '.join(f"coalesce(max(q) FILTER (c = '{c}'), 0) AS q{c}" for c in 'rgba')} FROM s2 GROUP BY y, x, k),
    s4 AS (SELECT *, least(qa, greatest(0, 1 - coalesce(sum(qa) OVER (PARTITION BY y, x ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS seen FROM s3 WHERE qa > 0),
    q AS (SELECT y, x, {', '.join(f'sum(q{c} * seen / qa) / greatest(sum(seen), 1e-6) AS {c}' for c in 'rgb')}, least(sum(seen), 1) AS a FROM s4 GROUP BY y, x)""")


def layered() -> str:
    """Four strokes, each pixel's coverage the mean of sixteen places in it; the last is a copy of another place."""
    covers = []
    for i, s in enumerate(STROKES):
        (px, py), r = s["points"][0], f"({d(s['radius'])} * least(w, h))"
        t = clip(f"(sqrt(pow(x + sx - {d(px)} * w, 2) + pow(y + sy - {d(py)} * h, 2)) - {d(s['hardness'])} * {r}) / ({d(1 - s['hardness'])} * {r})")
        covers.append(f"{d(s.get('flow', 1.0))} * avg(1 - {t} * {t} * (3 - 2 * {t})) AS c{i}")
    steps = f"pl AS (SELECT (i + 0.5) / 4::DOUBLE AS sx, (j + 0.5) / 4::DOUBLE AS sy FROM (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)), cv AS (SELECT y, x, w, h, {', '.join(covers)} FROM f CROSS JOIN pl GROUP BY ALL)"
    s = STROKES[3]
    steps += f", {gathered(f'x + 0.5 + {d(s['src_dx'])} * w', f'y + 0.5 + {d(s['src_dy'])} * h')}".replace("q AS (SELECT g3.y", "el AS (SELECT g3.y")
    steps += ", p0 AS (SELECT cv.*, 0::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b, 0::DOUBLE AS a, el.r AS er, el.g AS eg, el.b AS eb, el.a AS ea FROM cv LEFT JOIN el USING (y, x))"
    for i, s in enumerate(STROKES):
        if s.get("erase"):
            steps += f", p{i + 1} AS (SELECT * REPLACE (a * (1 - c{i}) AS a) FROM p{i})"
            continue
        lay = [f"least(greatest(e{c}, 0), 1)" for c in "rgb"] if "src_dx" in s else [d(int(s["color"][k : k + 2], 16) / 255) for k in (1, 3, 5)]
        when = f"c{i} <= 0" + (" OR coalesce(ea, 0) <= 0" if "src_dx" in s else "")
        full = f"(c{i} + a * (1 - c{i}))"
        steps += f", p{i + 1} AS (SELECT * REPLACE ({', '.join(f'CASE WHEN {when} THEN {c} ELSE ({v} * c{i} + {c} * a * (1 - c{i})) / greatest({full}, 1e-6) END AS {c}' for c, v in zip('rgb', lay, strict=True))}, CASE WHEN {when} THEN a ELSE {full} END AS a) FROM p{i})"
    return final(f"{steps}, q AS (SELECT y, x, r, g, b, a FROM p{len(STROKES)})")


def toned() -> dict[str, str]:
    # Tri-X, a step more development, nine tenths of the contrast
    slope, foot, soft, most = 0.651 * 1.2 * 0.9, -1.40 - 0.12, 0.30, 2.8
    dens = lambda x: f"(-0.35::DOUBLE * ln(exp({d(slope * soft)} * ln(1 + exp(({x} - {d(foot)}) / {d(soft)})) / {d(-0.35)}) + {d(math.exp(-most / 0.35))}))"
    light = lambda c: clip(f"pow(10::DOUBLE, 1.65::DOUBLE * ({dens(f'log10(greatest({c} * {d(2**0.3)}, 1e-6) / 0.18::DOUBLE)')} - {dens('0.7447275::DOUBLE')}))")
    pre = f"t0 AS (SELECT y, x, a, {', '.join(f'{light(c)} AS {c}' for c in 'rgb')} FROM f), t1 AS (SELECT *, {LUMA} AS yy FROM t0)"
    out = {"tone_profile__stock": final(f"{pre}, q AS (SELECT y, x, {', '.join(f'greatest(yy + ({c} - yy) * {d(1.2)}, 0) AS {c}' for c in 'rgb')}, a FROM t1)")}
    stops = lambda c: clip(f"log2(greatest({c}, 1e-12) / 0.18::DOUBLE)", -7, 3)
    shown = lambda c: f"({enc(f'least({c}, 1)')})"
    value = lambda c: dec(clip(f"{shown(c)} + ({clip(cubic(stops(c), [tuple(p) for p in TONE['points']]))} - {shown(c)}) * {d(0.8)}"))
    pre = f"t0 AS (SELECT y, x, a, {', '.join(f'greatest({c}, 0) * {d(2**-0.2)} AS {c}' for c in 'rgb')} FROM f)"
    out["tone_profile__custom"] = final(f"{pre}, q AS (SELECT y, x, {', '.join(f'{value(c)} AS {c}' for c in 'rgb')}, a FROM t0)")

    def bent(points, x):
        """Straight lines, of slope 1 beyond the points and from white on."""
        (x0, y0), (x1, y1) = points[0], points[-1]
        lines = " ".join(f"WHEN {x} <= {d(b[0])} THEN {d(a[1])} + {d((b[1] - a[1]) / (b[0] - a[0]))} * ({x} - {d(a[0])})" for a, b in zip(points, points[1:], strict=False))
        return f"(CASE WHEN {x} < {d(x0)} THEN {d(y0)} + {x} - {d(x0)} {lines} ELSE {d(y1)} + {x} - {d(x1)} END)"

    low, high = "least(er, eg, eb)", "greatest(er, eg, eb)"
    value = lambda x: f"greatest({bent(BENT['rgb'], x)}, 0)"
    # the outer channels lie at the ends of the line between them, so one expression serves all three; from white on a channel stays, as the curve leaves white there
    line = lambda c: f"(CASE WHEN {high} - {low} > 1e-6 AND e{c} <> {low} AND e{c} <> {high} THEN {dec(f'({value(low)} + ({value(high)} - {value(low)}) * (e{c} - {low}) / ({high} - {low}))')} WHEN {c} >= 1 THEN {c} ELSE {dec(value(f'e{c}'))} END)"
    shown = ", ".join(f"{enc(f'greatest({c}, 0)')} AS e{c}" for c in "rgb")
    out["curves__hue"] = final(f"c0 AS (SELECT *, {shown} FROM f), c1 AS (SELECT y, x, a, {', '.join(f'{line(c)} AS {c}' for c in 'rgb')} FROM c0), q AS (SELECT y, x, r, {dec(f'greatest({bent(BENT['g'], enc('greatest(g, 0)'))}, 0)')} AS g, b, a FROM c1)")
    # a handle's curve is found by halving its parameter
    (p0, p1, p2), hs = HANDLES["rgb"], HANDLES["rgb_h"]
    third = lambda a, b, m, side: [side * (b[0] - a[0]) / 3, side * m * (b[0] - a[0]) / 3]
    ends = [(p0, hs[0]["r"], hs[1]["l"], p1), (p1, hs[1]["r"], third(p1, p2, (p2[1] - p1[1]) / (p2[0] - p1[0]), -1), p2)]
    parts = []
    for a, r, l, b in ends:
        bez = lambda u, k, a=a, r=r, l=l, b=b: f"(pow(1 - {u}, 3) * {d(a[k])} + 3 * {u} * pow(1 - {u}, 2) * {d(a[k] + r[k])} + 3 * {u} * {u} * (1 - {u}) * {d(b[k] + l[k])} + pow({u}, 3) * {d(b[k])})"
        half = lambda v, bez=bez: f"list_reduce([{{'l': 0::DOUBLE, 'h': 1::DOUBLE}}] || list_transform(range(60), lambda i: {{'l': 0::DOUBLE, 'h': 1::DOUBLE}}), lambda s, i: CASE WHEN {bez('((s.l + s.h) / 2)', 0)} < {v} THEN {{'l': (s.l + s.h) / 2, 'h': s.h}} ELSE {{'l': s.l, 'h': (s.l + s.h) / 2}} END)"
        parts.append((half, bez))
    found = lambda c: f"CASE WHEN e{c} <= {d(p1[0])} THEN {parts[0][0](f'e{c}')}.l ELSE {parts[1][0](f'e{c}')}.l END AS u{c}"
    value = lambda c: f"CASE WHEN {c} >= 1 THEN {c} WHEN e{c} <= 0 THEN 0 WHEN e{c} <= {d(p1[0])} THEN {dec(parts[0][1](f'u{c}', 1))} ELSE {dec(parts[1][1](f'u{c}', 1))} END AS {c}"
    (b0, b1), (m0, m1) = HANDLES["b"], HANDLES["b_m"]
    e = enc("greatest(b, 0)")
    hermite = f"((2 * pow({e}, 3) - 3 * pow({e}, 2) + 1) * {d(b0[1])} + (pow({e}, 3) - 2 * pow({e}, 2) + {e}) * {d(m0)} + (3 * pow({e}, 2) - 2 * pow({e}, 3)) * {d(b1[1])} + (pow({e}, 3) - pow({e}, 2)) * {d(m1)})"
    out["curves__handles"] = final(f"c0 AS (SELECT *, {shown} FROM f), c1 AS (SELECT *, {', '.join(map(found, 'rgb'))} FROM c0), c2 AS (SELECT y, x, a, {', '.join(map(value, 'rgb'))} FROM c1), q AS (SELECT y, x, r, g, {dec(f'greatest(CASE WHEN {e} >= 1 THEN {d(b1[1])} + {e} - 1 ELSE {hermite} END, 0)')} AS b, a FROM c2)")

    t = clip(f"(sqrt(la * la + lb * lb) / greatest(ll, 0.15::DOUBLE) - {d(0.006)}) / {d(0.04)}")
    grey = f"greatest(r * {d(0.3)} + g * {d(0.59)} + b * {d(0.11)}, 0) * pow(2::DOUBLE, {clip(through(round_about(HUES), 'hi'), -2, 2)} * ({t} * {t} * (3 - 2 * {t})))"
    out["black_white__hues"] = final(f"{OKLAB}, h0 AS (SELECT *, {hue('la', 'lb')} AS hi FROM k), h1 AS (SELECT *, {grey} AS gy FROM h0), q AS (SELECT y, x, {', '.join(f'{c} + (gy - {c}) * {d(0.9)} AS {c}' for c in 'rgb')}, a FROM h1)")
    return out


def oracle_sql() -> dict[str, str]:
    out = recolours() | toned()
    out["dof"], out["paint"] = focused(), layered()
    discs = {n: ", ".join(f"({dy}, {dx})" for dy in range(-n, n + 1) for dx in range(-n, n + 1) if dy * dy + dx * dx <= n * n) for n in (6, 9)}
    near = "o AS (SELECT * FROM (VALUES {0}) t(dy, dx)), j AS (SELECT f.y, f.x, f.a AS a, {1} AS k FROM f CROSS JOIN o JOIN f n ON n.y = f.y + o.dy AND n.x = f.x + o.dx)"
    rank = "[CAST(floor((count(*) - 1) * {0}::DOUBLE + 0.5) AS BIGINT) + 1]"
    out["median_mask__wide"] = final(f"{near.format(discs[9], clip('n.v'))}, q AS (SELECT y, x, list_sort(list(k)){rank.format(0.3)} AS v FROM j GROUP BY y, x)", "v")
    lit = "{'k': " + luma("n.r", "n.g", "n.b") + ", 'r': n.r, 'g': n.g, 'b': n.b}"
    out["median__wide"] = final(f"{near.format(discs[6], lit)}, m AS (SELECT y, x, any_value(a) AS a, list_sort(list(k)){rank.format(0.5)} AS m FROM j GROUP BY y, x), q AS (SELECT y, x, m.r AS r, m.g AS g, m.b AS b, a FROM m)")
    for name, inside in (("grid_warp__slide", False), ("grid_warp__off", True)):
        sx, sy = f"x + 0.5 - {d(SLIDE)} * w", f"y + 0.5 + {d(SLIDE)} * h"
        sx, sy = (sx, sy) if inside else (clip(sx, 0, 1e9).replace(d(1e9), "w"), clip(sy, 0, 1e9).replace(d(1e9), "h"))
        out[name] = final(gathered(sx, sy, inside=inside))
    out["grid_warp__shear"] = out["layer_warp"] = final(sheared("rgba"))
    out["layer_warp_mask"] = final(sheared("v"), "v")
    out["layer_warp__room"] = final("sz AS (SELECT max(w) AS w, max(h) AS h, CAST(floor(max(w) / 10 + 0.5) AS BIGINT) AS px, CAST(floor(max(h) / 10 + 0.5) AS BIGINT) AS py FROM f), ys AS (SELECT unnest(range(CAST(h AS BIGINT) + 2 * py)) AS y FROM sz), xs AS (SELECT unnest(range(CAST(w AS BIGINT) + 2 * px)) AS x FROM sz), q AS (SELECT CAST(ys.y AS INTEGER) AS y, CAST(xs.x AS INTEGER) AS x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM ys CROSS JOIN xs CROSS JOIN sz LEFT JOIN f ON f.y = ys.y - py AND f.x = xs.x - px)")
    out["nlm_denoise"], out["nlm_denoise__patches"] = denoised(0), denoised(2)
    out["detect__extremes"] = extremes()
    out["match__bundle"], out["match__multiband"] = sightings(), bands()
    a, b, c = "100 + n * pow(255 * ma, 2) / 100", "100 + n * pow(255 * mb, 2) / 100", "-n * 255 * ma * 255 * mb / 100"
    out["match__gains"] = f"""WITH hours AS (SELECT user_id, event_type, hour(ts) AS h, avg(value) / 500::DOUBLE AS v FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL),
    o AS (SELECT p.user_id AS pano, CAST(count(*) AS DOUBLE) AS n, avg(p.v) AS ma, avg(q.v) AS mb FROM hours p JOIN hours q ON p.user_id = q.user_id AND p.h = q.h AND p.event_type = 'click' AND q.event_type = 'view' GROUP BY 1),
    s AS (SELECT *, {a} AS aa, {b} AS bb, {c} AS ab FROM o)
    SELECT pano, 'click' AS frame, round(100 * (bb - ab) / (aa * bb - ab * ab) + 1e-9::DOUBLE, 6) AS gain FROM s UNION ALL SELECT pano, 'view', round(100 * (aa - ab) / (aa * bb - ab * ab) + 1e-9::DOUBLE, 6) FROM s"""
    return out


