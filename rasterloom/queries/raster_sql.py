"""DuckDB SQL for the raster queries, written from the definitions and not from the Spark code."""

from __future__ import annotations

import re


def d(v) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


FRAME = """SELECT CAST(floor(event_id / CAST(100 AS DOUBLE)) AS INTEGER) AS y, CAST(event_id % 100 AS INTEGER) AS x,
  value / CAST(500 AS DOUBLE) AS r, CAST(user_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) AS g,
  CAST((event_id * 7919) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS b,
  CASE WHEN event_type = 'error' THEN CAST(0.5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS a,
  CAST((event_id * 104729) % 1013 AS DOUBLE) / CAST(1012 AS DOUBLE) AS v,
  CAST(100 AS DOUBLE) AS w, ceil((SELECT count(*) FROM events) / CAST(100 AS DOUBLE)) AS h FROM events"""
#: Several pictures of scene light, told apart by y.
SCENE_FRAME = """SELECT CAST((event_id % 3) * 500000000 + floor(floor(event_id / CAST(3 AS DOUBLE)) / CAST(100 AS DOUBLE)) AS INTEGER) AS y, CAST(CAST(floor(event_id / CAST(3 AS DOUBLE)) AS BIGINT) % 100 AS INTEGER) AS x,
  value / CAST(500 AS DOUBLE) * CAST(4.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS r, CAST(user_id % 97 AS DOUBLE) / CAST(97 AS DOUBLE) * CAST(4.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS g,
  CAST((event_id * 7919) % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) * CAST(4.5 AS DOUBLE) - CAST(0.5 AS DOUBLE) AS b,
  CASE event_type WHEN 'error' THEN CAST(0.5 AS DOUBLE) WHEN 'signup' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS a FROM events"""
LUMA = "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)"


def luma(r, g, b):
    return f"({d(0.2126)} * ({r}) + {d(0.7152)} * ({g}) + {d(0.0722)} * ({b}))"


def enc(x):
    return f"(CASE WHEN ({x}) <= {d(0.0031308)} THEN ({x}) * {d(12.92)} ELSE {d(1.055)} * pow(({x}), {d(1 / 2.4)}) - {d(0.055)} END)"


def dec(x):
    return f"(CASE WHEN ({x}) <= {d(0.04045)} THEN ({x}) / {d(12.92)} ELSE pow((({x}) + {d(0.055)}) / {d(1.055)}, {d(2.4)}) END)"


def clip(x, lo=0, hi=1):
    return f"least(greatest(({x}), {d(lo)}), {d(hi)})"


def smooth(x, lo, hi):
    t = clip(f"(({x}) - {d(lo)}) / ({d(hi)} - {d(lo)})")
    return f"({t} * {t} * (3 - 2 * {t}))"


def smoother(x, lo, hi):
    t = clip(f"(({x}) - {d(lo)}) / ({d(hi)} - {d(lo)})")
    return f"({t} * {t} * {t} * ({t} * ({t} * 6 - 15) + 10))"


def contrast(x, gamma):
    p = 0.46135613
    return f"(CASE WHEN ({x}) >= 1 THEN ({x}) WHEN ({x}) <= {d(p)} THEN {d(p)} * pow(greatest(({x}) / {d(p)}, 0), {d(gamma)}) ELSE 1 - {d(1 - p)} * pow((1 - ({x})) / {d(1 - p)}, {d(gamma)}) END)"


def final(ctes: str, channels="rgba", digits=6, frm="q") -> str:
    cols = ", ".join(f"round({c} + {d(1e-9)}, {digits}) + {d(0)} AS {c}" for c in channels)
    return f"WITH f AS ({FRAME}){', ' + ctes if ctes else ''} SELECT y, x, {cols} FROM {frm}"


def image(r, g, b, a="a", pre="", src="f", digits=6):
    """A query whose channels are expressions over src; pre holds further steps."""
    return final(f"{pre + ', ' if pre else ''}q AS (SELECT y, x, {r} AS r, {g} AS g, {b} AS b, {a} AS a FROM {src})", digits=digits)


def field(v, pre="", src="f", digits=6):
    return final(f"{pre + ', ' if pre else ''}q AS (SELECT y, x, {v} AS v FROM {src})", "v", digits)


def each(fn, **kw):
    return image(*(fn(c) for c in "rgb"), **kw)


LMS = ((0.41222147, 0.53633254, 0.05144599), (0.2119035, 0.68069955, 0.10739696), (0.08830246, 0.28171884, 0.6299787))
LAB = ((0.21045426, 0.79361779, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))
BACK = ((1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855))
RGB = ((4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147))


def dot(row, v):
    return "(" + " + ".join(f"{d(k)} * ({c})" for k, c in zip(row, v, strict=True)) + ")"


OKLAB = f"k1 AS (SELECT *, cbrt({dot(LMS[0], 'rgb')}) AS l1, cbrt({dot(LMS[1], 'rgb')}) AS l2, cbrt({dot(LMS[2], 'rgb')}) AS l3 FROM f), k AS (SELECT *, {dot(LAB[0], ('l1', 'l2', 'l3'))} AS ll, {dot(LAB[1], ('l1', 'l2', 'l3'))} AS la, {dot(LAB[2], ('l1', 'l2', 'l3'))} AS lb FROM k1)"


def unlab(src, l, a, b):
    """Steps from OkLab expressions over src to columns nr, ng, nb in u3."""
    return f"u1 AS (SELECT *, {l} AS xl, {a} AS xa, {b} AS xb FROM {src}), u2 AS (SELECT *, " + ", ".join(f"pow({dot(row, ('xl', 'xa', 'xb'))}, 3) AS c{i}" for i, row in enumerate(BACK)) + " FROM u1), u3 AS (SELECT *, " + ", ".join(f"{dot(row, ('c0', 'c1', 'c2'))} AS n{c}" for c, row in zip("rgb", RGB, strict=True)) + " FROM u2)"


SAT = "hs AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM f), hs2 AS (SELECT *, CASE WHEN mx - mn < 1e-6 OR mx < 1e-6 THEN 0 WHEN mx = r THEN 60 * ((g - b) / (mx - mn)) WHEN mx = g THEN 60 * ((b - r) / (mx - mn) + 2) ELSE 60 * ((r - g) / (mx - mn) + 4) END AS hue0, CASE WHEN mx - mn < 1e-6 OR mx < 1e-6 THEN 0 ELSE (mx - mn) / mx END AS sat FROM hs), hs3 AS (SELECT *, CASE WHEN hue0 < 0 THEN hue0 + 360 ELSE hue0 END AS hue FROM hs2)"


def exposure():
    g = 2.0**0.5
    cg, ccg = 2 ** (0.3 * 0.85), 2 ** (0.2 * 0.85)
    y = luma("r0", "g0", "b0")
    pre = f"""e0 AS (SELECT y, x, a, r * {d(g)} AS r0, g * {d(g)} AS g0, b * {d(g)} AS b0 FROM f),
    e1 AS (SELECT *, {y} AS l, {contrast(enc(y), cg)} AS dd FROM e0),
    e2 AS (SELECT *, dd + {d(0.1 * 0.12)} * {smooth('dd', 0.3, 1)} + {d(-0.15 * 0.12)} * (1 - {smooth('dd', 0, 0.5)}) AS n FROM e1),
    e3 AS (SELECT *, n + {d(0.35)} * (1 - {smooth('dd', 0, 0.55)}) * {d(0.5)} * greatest({d(0.5)} - n, 0) AS n2 FROM e2),
    e4 AS (SELECT *, n2 + {d(-0.4)} * {smooth('dd', 0.35, 1)} * ({d(0.06)} + {d(0.45)} * greatest(n2 - {d(0.5)}, 0)) AS n3 FROM e3),
    e5 AS (SELECT *, CASE WHEN l > 1e-6 THEN {dec('greatest(n3, 0)')} / l ELSE 1 END AS s FROM e4),
    e6 AS (SELECT y, x, a, r0 * s AS r, g0 * s AS g, b0 * s AS b FROM e5),
    e7 AS (SELECT *, {", ".join(f"{dec(contrast(enc(f'greatest({c}, 0)'), ccg))} AS c{c}" for c in "rgb")} FROM e6),
    e8 AS (SELECT *, {luma('r', 'g', 'b')} AS y0, {luma('cr', 'cg', 'cb')} AS y1 FROM e7)"""
    return image(*(f"CASE WHEN y0 > 1e-6 AND y1 > 1e-6 THEN c{c} * (y0 / y1) ELSE {c} END" for c in "rgb"), pre=pre, src="e8")


def hexcone(hue):
    s = (hue % 360) / 60
    k = 1 - abs(s % 2 - 1)
    return [(1, k, 0), (k, 1, 0), (0, 1, k), (0, k, 1), (k, 0, 1), (1, 0, k)][int(s) % 6]


def push(hue, sat):
    c = hexcone(hue)
    y = 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]
    return [(v - y) * sat / 100 * 0.15 for v in c]


SEEN = clip(enc(f"greatest({LUMA}, 0)"))
WS, WH = f"(1 - {smooth('sn', 0, 0.5)})", smooth("sn", 0.5, 1)
WM = clip(f"1 - {WS} - {WH}")


def blend_channel(mode, b, t):
    screen = f"1 - 2 * (1 - {b}) * (1 - {t})"
    return {
        "normal": t, "multiply": f"{b} * {t}", "screen": f"1 - (1 - {b}) * (1 - {t})", "add": f"{b} + {t}",
        "overlay": f"CASE WHEN {b} <= 0.5 THEN 2 * {b} * {t} ELSE {screen} END", "hard_light": f"CASE WHEN {t} <= 0.5 THEN 2 * {b} * {t} ELSE {screen} END",
        "vivid_light": f"CASE WHEN {t} <= 0 THEN 0 WHEN {t} <= 0.5 THEN greatest(1 - (1 - {b}) / (2 * {t}), 0) WHEN {t} >= 1 THEN 1 ELSE least({b} / (2 * (1 - {t})), 1) END",
        "linear_light": f"{b} + 2 * {t} - 1",
        "soft_light": f"CASE WHEN {t} <= 0.5 THEN {b} - (1 - 2 * {t}) * {b} * (1 - {b}) ELSE {b} + (2 * {t} - 1) * ((CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END) - {b}) END",
        "darken": f"least({b}, {t})", "lighten": f"greatest({b}, {t})", "difference": f"abs({b} - {t})", "exclusion": f"{b} + {t} - 2 * {b} * {t}",
        "color_burn": f"CASE WHEN {t} <= 0 THEN 0 ELSE 1 - least((1 - {b}) / {t}, 1) END", "color_dodge": f"CASE WHEN {t} >= 1 THEN 1 ELSE least({b} / (1 - {t}), 1) END",
    }.get(mode)


def blend(mode):
    pre = "p0 AS (SELECT y, x, r, g, b, a AS ba, b AS tr, r AS tg, g AS tb, g AS ta FROM f), p1 AS (SELECT *, 0.8::DOUBLE * least(greatest(ta, 0), 1) AS aa FROM p0)"
    if blend_channel(mode, "r", "tr"):
        pre += ", p2 AS (SELECT *, " + ", ".join(f"{blend_channel(mode, c, 't' + c)} AS m{c}" for c in "rgb") + " FROM p1)"
    else:
        lum = lambda p: f"(0.3::DOUBLE * {p}r + 0.59::DOUBLE * {p}g + 0.11::DOUBLE * {p}b)"
        sat = lambda p: f"(greatest({p}r, {p}g, {p}b) - least({p}r, {p}g, {p}b))"
        fit = lambda p, s: ", ".join(f"CASE WHEN {sat(p)} > 0 THEN ({p}{c} - least({p}r, {p}g, {p}b)) * ({s}) / {sat(p)} ELSE 0 END AS s{c}" for c in "rgb")
        step = {"hue": fit("t", sat("")), "saturation": fit("", sat("t")), "color": "tr AS sr, tg AS sg, tb AS sb", "luminosity": "r AS sr, g AS sg, b AS sb"}[mode]
        goal = lum("t") if mode == "luminosity" else lum("")
        pre += f", h1 AS (SELECT *, {step} FROM p1), h2 AS (SELECT *, ({goal}) - {lum('s')} AS dl FROM h1), h3 AS (SELECT * EXCLUDE (sr, sg, sb), sr + dl AS sr, sg + dl AS sg, sb + dl AS sb FROM h2), h4 AS (SELECT *, {lum('s')} AS la, least(sr, sg, sb) AS lo, greatest(sr, sg, sb) AS hi FROM h3), h5 AS (SELECT *, "
        pre += ", ".join(f"CASE WHEN lo < 0 THEN la + (s{c} - la) * la / greatest(la - lo, 1e-6) ELSE s{c} END AS d{c}" for c in "rgb")
        pre += " FROM h4), p2 AS (SELECT *, " + ", ".join(f"CASE WHEN hi > 1 THEN la + (d{c} - la) * (1 - la) / greatest(hi - la, 1e-6) ELSE d{c} END AS m{c}" for c in "rgb") + " FROM h5)"
    pre += ", p3 AS (SELECT *, aa + ba * (1 - aa) AS oa FROM p2)"
    return image(*(f"CASE WHEN ba >= 1 THEN {c} + (m{c} - {c}) * aa WHEN oa > 1e-6 THEN ((1 - ba) * aa * t{c} + (1 - aa) * ba * {c} + aa * ba * m{c}) / oa ELSE 0 END" for c in "rgb"), "oa", pre=pre, src="p3")


def stops(t, a, b, m):
    k = f"(CASE WHEN {t} <= {d(m)} THEN 0.5 * {t} / {d(m)} ELSE 0.5 + 0.5 * ({t} - {d(m)}) / {d(1 - m)} END)"
    return [f"({d(u)} + {d(v - u)} * {k})" for u, v in zip(a, b, strict=True)]


def hexd(s):
    return [int(s[i : i + 2], 16) / 255 for i in (1, 3, 5)]


def window_mean(c, axis, r):
    """A box mean with the edge value standing for places beyond."""
    size = "w" if axis == "x" else "h"
    part = "y" if axis == "x" else "x"
    return f"(sum({c}) OVER (PARTITION BY {part} ORDER BY {axis} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) + greatest({r} - {axis}, 0) * first({c}) OVER (PARTITION BY {part} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) + greatest({axis} + {r} - {size} + 1, 0) * last({c}) OVER (PARTITION BY {part} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {d(2 * r + 1)}"


def gauss_pass(c, axis, k):
    part, r = ("y" if axis == "x" else "x"), len(k) // 2
    w = f"OVER (PARTITION BY {part} ORDER BY {axis}"
    parts = []
    for i, kv in enumerate(k):
        o = i - r
        v = c if o == 0 else f"coalesce({'lag' if o < 0 else 'lead'}({c}, {abs(o)}) {w}), {'first' if o < 0 else 'last'}({c}) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
        parts.append(f"{d(kv)} * {v}")
    return "(" + " + ".join(parts) + ")"


def gauss_kernel(sigma, reach=2.5):
    import math

    r = math.ceil(reach * sigma)
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    s = sum(k)
    return [v / s for v in k]


def disc_rank(half, pct):
    reach = {dy: int((half * half - dy * dy) ** 0.5 + 1e-9) for dy in range(-half, half + 1)}
    offs = [(dy, dx) for dy, m in reach.items() for dx in range(-m, m + 1)]
    values = ", ".join(f"({a}, {b})" for a, b in offs)
    return f"o AS (SELECT * FROM (VALUES {values}) t(dy, dx)), j AS (SELECT f.y, f.x, n.v FROM f CROSS JOIN o JOIN f n ON n.y = f.y + o.dy AND n.x = f.x + o.dx), q AS (SELECT y, x, list_sort(list(v))[CAST(floor((count(*) - 1) * {d(pct)} + 0.5) AS BIGINT) + 1] AS v FROM j GROUP BY y, x)"


def gathered(sx, sy, channels="rgba", inside=True, keys="f", size="f"):
    """Bilinear samples at edges sx, sy over the rows of keys."""
    cols = ", ".join(f"sum(wt * f.{c}) AS {c}" for c in channels)
    outs = ", ".join((f"CASE WHEN g0.inn THEN {c} ELSE 0 END AS {c}" if inside else c) for c in channels)
    return f"""g00 AS (SELECT y, x, w, h, {sx} AS fx, {sy} AS fy FROM {keys}), g0 AS (SELECT *, fx BETWEEN 0 AND w AND fy BETWEEN 0 AND h AS inn, least(greatest(fx - 0.5, 0), w - 1) AS gx, least(greatest(fy - 0.5, 0), h - 1) AS gy FROM g00),
    g1 AS (SELECT *, CAST(floor(gx) AS INTEGER) AS x0, CAST(floor(gy) AS INTEGER) AS y0, CAST(least(floor(gx) + 1, w - 1) AS INTEGER) AS x1, CAST(least(floor(gy) + 1, h - 1) AS INTEGER) AS y1, gx - floor(gx) AS tx, gy - floor(gy) AS ty FROM g0),
    g2 AS (SELECT y, x, x0 AS cx, y0 AS cy, (1 - tx) * (1 - ty) AS wt FROM g1 UNION ALL SELECT y, x, x1, y0, tx * (1 - ty) FROM g1 UNION ALL SELECT y, x, x0, y1, (1 - tx) * ty FROM g1 UNION ALL SELECT y, x, x1, y1, tx * ty FROM g1),
    g3 AS (SELECT g2.y, g2.x, {cols} FROM g2 JOIN f ON f.x = cx AND f.y = cy GROUP BY g2.y, g2.x),
    q AS (SELECT g3.y, g3.x, {outs} FROM g3 JOIN g0 ON g0.y = g3.y AND g0.x = g3.x)"""


def build() -> dict[str, str]:
    s: dict[str, str] = {}
    s["exposure"] = exposure()
    s["exposure__gain"] = each(lambda c: f"{c} * 2")
    s["exposure__masked"] = image(*(f"{c} + (2 * {c} - {c}) * {clip('v')}" for c in "rgb"))
    dt = (7500 - 6500) / 6500
    s["white_balance"] = image(f"r * {d(1 + 0.4 * dt)}", f"g * {d(1 - 0.45 * 20 / 150)}", f"b * {d(1 - 0.4 * dt)}")
    k = 2**0.25
    rows = [(1.2 * k, -0.1 * k, 0), (0, k, 0.3 * k), (0, 0, 0.9 * k)]
    s["color_checker"] = image(*(f"{c} + ({dot(row, 'rgb')} - {c}) * {d(0.8)}" for c, row in zip("rgb", rows, strict=True)))
    dt = (5500 - 6500) / 6500
    gains = [(1 + 0.4 * dt) * 2**0.3, 2**0.3, (1 - 0.4 * dt) * 2**0.3]
    s["standard_color"] = image(
        *(f"yy + ({c} - yy) * ff" for c in "rgb"),
        pre=f"s0 AS (SELECT y, x, a, r * {d(gains[0])} AS r, g * {d(gains[1])} AS g, b * {d(gains[2])} AS b FROM f), s1 AS (SELECT *, CASE WHEN {LUMA} > 1e-6 THEN {dec(contrast(enc(LUMA), 2 ** (0.25 * 0.85)))} / {LUMA} ELSE 1 END AS sc FROM s0), s2 AS (SELECT y, x, a, r * sc AS r, g * sc AS g, b * sc AS b FROM s1), s3 AS (SELECT *, {LUMA} AS yy, (1 + {d(0.2)}) * (1 + {d(0.3)} * (1 - {clip('(greatest(r, g, b) - least(r, g, b)) / greatest(abs(greatest(r, g, b)), 1e-6)')})) AS ff FROM s2)",
        src="s3",
    )
    kb, kw = 0.05, 0.075

    def knee(n, k):
        return f"(CASE WHEN {n} >= {d(k)} THEN {n} WHEN {n} <= {d(-k)} THEN 0 ELSE ({n} + {d(k)}) * ({n} + {d(k)}) / {d(4 * k)} END)"

    lv = ", ".join(f"({enc(f'greatest({c}, 0)')} - {d(0.1)}) / {d(0.9 - 0.1)} AS {c}" for c in "rgb")
    s["levels"] = image(
        *(f"CASE WHEN {c} <= 0 THEN {c} ELSE {dec(f'pow({c}, {d(1 / 1.4)})')} END" for c in "rgb"),
        pre=f"l0 AS (SELECT y, x, a, {lv} FROM f), l1 AS (SELECT y, x, a, {', '.join(f'{knee(c, kb)} AS {c}' for c in 'rgb')} FROM l0), l2 AS (SELECT y, x, a, {', '.join(f'1 - ' + knee(f'(1 - {c})', kw) + f' + greatest({c} - 1, 0) AS {c}' for c in 'rgb')} FROM l1)",
        src="l2",
    )
    sh, hl = push(40, 50), push(-120, 30)
    s["color_balance"] = image(*(f"({c} + {d(sh[i])} * {WS} + {d(hl[i])} * {WH}) * (1 + {d(0.08)} * {WM} + {d(-0.04)} * {WH})" for i, c in enumerate("rgb")), pre=f"t0 AS (SELECT *, {SEEN} AS sn FROM f)", src="t0")
    sh, hl = push(220, 60), push(40, 40)
    mid = 0.5 - 0.2 * 0.35
    wh = smooth("sn", mid - 0.35, mid + 0.35)
    s["split_tone"] = image(*(f"{c} + {d(sh[i])} * (1 - {wh}) + {d(hl[i])} * {wh}" for i, c in enumerate("rgb")), pre=f"t0 AS (SELECT *, {SEEN} AS sn FROM f)", src="t0")
    s["channel_gain"] = image("r", "g * 1.5::DOUBLE", "b")
    for m, wgt in (("shadows", WS), ("midtones", WM), ("highlights", WH), ("bell", f"0.35::DOUBLE + 0.65::DOUBLE * (4 * {clip(LUMA)} * (1 - {clip(LUMA)}))")):
        s[f"tone_mask__{m}"] = image("mm", "mm", "mm", d(1), pre=f"t0 AS (SELECT *, {SEEN} AS sn FROM f), t1 AS (SELECT *, {wgt} AS mm FROM t0)", src="t1")
    vg = f"greatest(1 + {d(-0.6)} * {smooth('dd', 0.4 * 0.4, 0.4 * 1.6)}, 0)"
    s["vignette"] = image(*(f"{c} * {vg}" for c in "rgb"), pre="t0 AS (SELECT *, sqrt((x - w / 2) * (x - w / 2) + (y - h / 2) * (y - h / 2)) / sqrt(w * w / 4 + h * h / 4) AS dd FROM f)", src="t0")
    toe = lambda c: f"(CASE WHEN {c} < {d(0.05)} THEN greatest({d(0.05)} - {d(0.05)} * tanh(({d(0.05)} - {c}) / {d(0.05)}), 0) ELSE {c} END)"
    kn = lambda c: f"(CASE WHEN {c} > {d(0.7 * 0.6)} THEN least({d(0.7 * 0.6)} + {d(0.7 * 0.4)} * tanh(({c} - {d(0.7 * 0.6)}) / {d(0.7 * 0.4)}), {d(0.7)}) ELSE {c} END)"
    s["soft_clip"] = image(*(f"CASE WHEN m > {d(0.7 * 0.6)} THEN CASE WHEN {c} = m THEN {kn('m')} ELSE least({c} * ({kn('m')} / m), {kn('m')}) END ELSE {c} END" for c in "rgb"), pre=f"t0 AS (SELECT y, x, a, {', '.join(f'{toe(c)} AS {c}' for c in 'rgb')} FROM f), t1 AS (SELECT *, greatest(r, g, b) AS m FROM t0)", src="t1")
    s["soft_clip__channel"] = each(kn)
    import math

    kl = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (0, 0.694, 0.251)]
    lms = [sum(a * b for a, b in zip(row, kl, strict=True)) ** (1 / 3) for row in LMS]
    ka, kb2 = (sum(a * b for a, b in zip(row, lms, strict=True)) for row in LAB[1:])
    kc = math.hypot(ka, kb2)
    ua, ub = ka / kc, kb2 / kc
    al = f"(la * {d(ua)} + lb * {d(ub)})"
    s["chroma_key"] = field(clip(f"(sqrt(pow(greatest({d(kc)} - al, 0), 2) + pow(la - al * {d(ua)}, 2) + pow(lb - al * {d(ub)}, 2)) - {d(0.1)}) / {d(0.2)}"), pre=f"{OKLAB}, k2 AS (SELECT *, {al} AS al FROM k)", src="k2")
    s["chroma_key_despill"] = image(*(f"CASE WHEN al > 0 THEN n{c} ELSE {c} END" for c in "rgb"), pre=f"{OKLAB}, k2 AS (SELECT *, {al} AS al FROM k), " + unlab("k2", "ll", f"la - {d(0.8)} * al * {d(ua)}", f"lb - {d(0.8)} * al * {d(ub)}"), src="u3")
    s["channel_extract"] = image(LUMA, LUMA, LUMA)
    mix = [[0.8, 0.2, 0], [0, 1, -0.3], [0.5, 0, 1]]
    s["channel_mixer"] = image(*(dot([v / sum(row) for v in row], "rgb") for row in mix))
    s["color_transform"] = each(enc)
    s["color_grade"] = image(
        *(f"(CASE WHEN mn >= 0 THEN n{c} WHEN yy <= 0 THEN 0 ELSE yy + (n{c} - yy) * (yy / (yy - mn)) END) * {d(2**0.2)}" for c in "rgb"),
        pre=f"{OKLAB}, c0 AS (SELECT *, sqrt(la * la + lb * lb) AS ch, atan2(lb, la) + {d(math.radians(20))} AS hh FROM k), c1 AS (SELECT *, greatest(ch * {d(1.15)} * (1 + {d(0.25)} * (1 - least(ch / {d(0.3)}, 1))), 0) AS cc FROM c0), " + unlab("c1", "ll", "cc * cos(hh)", "cc * sin(hh)") + f", v1 AS (SELECT *, {luma('nr', 'ng', 'nb')} AS yy, least(nr, ng, nb) AS mn FROM u3)",
        src="v1",
    )
    s["gamut_map"] = image(*(f"CASE WHEN mn >= 0 THEN {c} WHEN yy <= 0 THEN {c} + (0 - {c}) * {d(0.7)} ELSE {c} + (yy + ({c} - yy) * (yy / (yy - mn)) - {c}) * {d(0.7)} END" for c in "rgb"), pre=f"t0 AS (SELECT *, {LUMA} AS yy, least(r, g, b) AS mn FROM f)", src="t0")
    d0 = lambda c: f"(CASE WHEN {c} <= {d(0.76)} THEN {c} ELSE {d(0.76)} + {d(0.24)} * (1 - exp(-({c} - {d(0.76)}) / {d(0.24)})) END)"
    s["tone_profile"] = image(
        *(f"greatest(yy + ({c} - yy) * {d(1.1)}, 0)" for c in "rgb"),
        pre=f"t0 AS (SELECT y, x, a, {', '.join(f'{enc(f'greatest({c}, 0) * {d(2**0.3)}')} AS {c}' for c in 'rgb')} FROM f), t1 AS (SELECT y, x, a, {', '.join(f'{d0(c)} AS {c}' for c in 'rgb')} FROM t0), t2 AS (SELECT y, x, a, {', '.join(clip(f'{c} + ({c} * {c} * (3 - 2 * {c}) - {c}) * {d(0.34)}') + f' AS {c}' for c in 'rgb')} FROM t1), t3 AS (SELECT y, x, a, {', '.join(dec(f'({c} - {d(0.2)} * {c} * pow(1 - {c}, 3))') + f' AS {c}' for c in 'rgb')} FROM t2), t4 AS (SELECT *, {LUMA} AS yy FROM t3)",
        src="t4",
    )
    s["lift"] = image("r", "g", "b", d(1))
    s["fill"] = image(*map(d, hexd("#336699")), d(1))
    c, sn = math.cos(math.radians(30)), math.sin(math.radians(30))
    lin = lambda co, si: f"t0 AS (SELECT *, {clip(f'((((x + 0.5) / w - 0.5) * (w / h)) * {d(co)} + ((y + 0.5) / h - 0.5) * {d(si)}) / ({d(abs(co))} * (w / h) + {d(abs(si))}) + 0.5')} AS t FROM f)"
    s["gradient"] = image(*stops("t", (0, 0, 0, 1), (1, 1, 1, 0.5), 0.4), pre=lin(c, sn), src="t0")
    s["gradient__radial"] = image(*stops("t", (0, 0, 0, 1), (1, 1, 1, 1), 0.5), pre=f"t0 AS (SELECT *, {clip('sqrt(pow((x + 0.5) / w - 0.5, 2) + pow((y + 0.5) / h - 0.5, 2)) / 0.5')} AS t FROM f)", src="t0")
    s["gradient__tone"] = image(*stops("t", (*hexd("#102030"), 1), (*hexd("#f0e0d0"), 1), 0.5), pre=f"t0 AS (SELECT *, {clip(LUMA)} AS t FROM f)", src="t0")
    lo, md, hi = hexd("#101040"), hexd("#c04040"), hexd("#ffffc0")
    s["gradient_map"] = image(*(f"{ch} + ((CASE WHEN t <= {d(0.4)} THEN {d(lo[i])} + {d(md[i] - lo[i])} * (t / {d(0.4)}) ELSE {d(md[i])} + {d(hi[i] - md[i])} * ((t - {d(0.4)}) / {d(0.6)}) END) - {ch}) * {d(0.8)}" for i, ch in enumerate("rgb")), pre=f"t0 AS (SELECT *, {clip(LUMA)} AS t FROM f)", src="t0")
    s["fx_color_overlay"] = image(*(f"{ch} + ({d(v)} - {ch}) * {d(0.4)}" for ch, v in zip("rgb", hexd("#ff8000"), strict=True)))
    c, sn = math.cos(math.radians(90)), math.sin(math.radians(90))
    s["fx_gradient_overlay"] = image(*(f"{ch} + ({v} - {ch}) * {d(0.6)}" for ch, v in zip("rgb", stops("t", (0, 0, 0), (1, 1, 1), 0.5), strict=True)), pre=lin(c, sn), src="t0")
    s["to_display"] = each(lambda c: enc(clip(c)))
    s["to_display__gamma"] = each(lambda c: f"pow({clip(c)}, {d(1 / 2.2)})")
    s["to_scene"] = image(*(f"{dec(clip(c))} + greatest({o} - 1, 0)" for c, o in zip("rgb", "brg", strict=True)))
    s["luma_chroma_split"] = each(lambda c: f"{c} - {LUMA}")
    s["luma_chroma_join"] = image(*(f"{LUMA} + {o}" for o in "brg"))
    s["invert"] = each(lambda c: f"{c} + ((1 - {clip(c)}) - {c}) * {d(0.7)}")
    s["desaturate"] = each(lambda c: f"{c} + ({LUMA} - {c}) * {d(0.6)}")
    s["alpha_association__extract"] = image("a", "a", "a", d(1))
    s["alpha_association__premultiply"] = each(lambda c: f"{c} * a")
    s["alpha_association__unpremultiply"] = each(lambda c: f"CASE WHEN a > 1e-6 THEN {c} / a ELSE {c} END")
    s["alpha_association__replace"] = image("r", "g", "b", clip("v"))
    s["luminance_extract"] = field(LUMA)
    s["luminance_range_mask"] = field(f"{smooth('yy', 0.3 - 0.1, 0.3)} * (1 - {smooth('yy', 0.6, 0.6 + 0.1)})", pre=f"t0 AS (SELECT *, {LUMA} AS yy FROM f)", src="t0")
    s["invert_mask"] = field("1 - v")
    s["remap"] = field(clip(f"{d(0.1)} + pow({clip(f'(v - {d(0.2)}) / {d(0.8 - 0.2)}')}, {d(1 / 1.5)}) * {d(0.9 - 0.1)}"))
    s["conditional"] = image("r + (b - r) * v", "g + (r - g) * v", "b + (g - b) * v", "a + (g - a) * v")
    s["channel_join"] = image("v", LUMA, d(0), clip("v"))
    win = lambda x, lo, hi, so: f"{smoother(x, lo - so, lo)} * (1 - {smoother(x, hi, hi + so)})"
    s["range_mask"] = field(f"{win('sn', 0.3, 0.8, 0.2)} * {win('sat', 0.2, 1.0, 0.2)} * (1 - {smooth('least(abs(hue - 60), 360 - abs(hue - 60))', 80, 116)})", pre=f"{SAT}, t0 AS (SELECT *, {SEEN} AS sn FROM hs3)", src="t0", digits=5)
    near = f"pow({clip(f'((1 - v) - {d(0.1)}) / {d(0.9)}')}, {d(1 / 1.2)})"
    s["range_mask__depth"] = field(f"{win('sn', 0.3, 1.0, 0.15)} * {win('sat', 0.0, 1.0, 0.15)} * {near}", pre=f"{SAT}, t0 AS (SELECT *, {SEEN} AS sn FROM hs3)", src="t0")
    tl = [c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in hexd("#8090a0")]
    s["color_range_mask"] = field("1 - " + smooth("dd", 0.3, 0.3 + 0.3), pre="t0 AS (SELECT *, sqrt(" + " + ".join(f"({c} - {d(v)}) * ({c} - {d(v)})" for c, v in zip("rgb", tl, strict=True)) + ") AS dd FROM f)", src="t0")
    s["hue_range_mask"] = field(f"(1 - {smoother('least(abs(hh - 120), 360 - abs(hh - 120))', 45, 105)}) * {smoother('ch', 0.01, 0.05)}", pre=f"{OKLAB}, c0 AS (SELECT *, sqrt(la * la + lb * lb) AS ch, degrees(atan2(lb, la)) AS h0 FROM k), c1 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hh FROM c0)", src="c1", digits=5)
    c, sn = math.cos(math.radians(60)), math.sin(math.radians(60))
    s["linear_mask"] = field("1 - " + smooth("t", 0.4 - 0.25, 0.4 + 0.25), pre=f"t0 AS (SELECT *, ((x + 0.5) / w - 0.5) * {d(c)} + ((y + 0.5) / h - 0.5) * {d(sn)} + 0.5 AS t FROM f)", src="t0")
    lvl = ((0.72 + 0.055) / 1.055) ** 2.4
    fc = [lvl * (1 - 0.1 + 0.1 * v) for v in hexcone(220)]
    s["fog"] = image(*(f"c{c} + ({d(v)} - c{c}) * ff" for c, v in zip("rgb", fc, strict=True)), pre=f"t0 AS (SELECT *, {clip(f'((1 - {clip(clip('1 - v'))}) - {d(0.1)}) / {d(0.9)}')} AS xx FROM f), t1 AS (SELECT *, 1 - exp({d(-3 * 0.6)} * pow(xx, {d(10 ** (10 / 50))})) AS ff, {LUMA} AS yy FROM t0), t2 AS (SELECT *, {', '.join(f'{c} + (yy - {c}) * {d(0.3)} * xx AS c{c}' for c in 'rgb')} FROM t1)", src="t2")
    s["merge"] = image(*(f"CASE WHEN a >= 1 THEN {o} * fa + {c} * (1 - fa) WHEN oa > 1e-6 THEN ({o} * fa + {c} * a * (1 - fa)) / oa ELSE 0 END" for c, o in zip("rgb", "brg", strict=True)), "oa", pre=f"t0 AS (SELECT *, {clip(f'g * {d(0.7)}')} AS fa FROM f), t1 AS (SELECT *, fa + a * (1 - fa) AS oa FROM t0)", src="t1")
    for m in ("normal", "multiply", "screen", "add", "overlay", "hard_light", "vivid_light", "linear_light", "soft_light", "darken", "lighten", "difference", "exclusion", "color_burn", "color_dodge", "hue", "saturation", "color", "luminosity"):
        s[f"blend__{m}"] = blend(m)
    hh = {"luma": LUMA, "red": "r", "green": "g", "blue": "b", "alpha": "a", "hue": "CASE WHEN ch > 1e-6 THEN hh / 360 ELSE 0 END", "chroma": f"ch / {d(0.4)}", "saturation": "CASE WHEN greatest(r, g, b) > 1e-6 THEN greatest((greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 0) ELSE 0 END"}
    for m, e in hh.items():
        s[f"measure__{m}"] = field(e, pre=f"{OKLAB}, c0 AS (SELECT *, sqrt(la * la + lb * lb) AS ch, degrees(atan2(lb, la)) AS h0 FROM k), c1 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS hh FROM c0)", src="c1", digits=5)
    s["measure__smooth"] = field(window_mean("v1", "y", 1), pre=f"t0 AS (SELECT y, x, w, h, {LUMA} AS v0 FROM f), t1 AS (SELECT *, {window_mean('v0', 'x', 1)} AS v1 FROM t0)", src="t1")
    for m, o in (("gt", ">"), ("ge", ">="), ("lt", "<"), ("le", "<=")):
        s[f"compare__{m}"] = field(f"CASE WHEN v {o} {d(0.4)} THEN {d(1)} ELSE {d(0)} END")
    eq = clip(f"1 - abs(v - {d(0.4)}) / {d(0.001)}")
    s["compare__eq"], s["compare__neq"] = field(eq), field(f"1 - {eq}")
    s["compare__soft"] = field(smooth("v", 0.4 - 0.15, 0.4 + 0.15))
    for m, e in (("and", f"least(v, {LUMA})"), ("or", f"greatest(v, {LUMA})"), ("xor", f"abs(v - {LUMA})"), ("subtract", clip(f"v - {LUMA}"))):
        s[f"logic__{m}"] = field(e)
    for m, e in (("add", f"v + {LUMA}"), ("subtract", f"v - {LUMA}"), ("multiply", f"v * {LUMA}"), ("divide", f"CASE WHEN abs({LUMA}) > 1e-9 THEN v / {LUMA} ELSE 0 END"), ("min", f"least(v, {LUMA})"), ("max", f"greatest(v, {LUMA})"), ("difference", f"abs(v - {LUMA})"), ("power", f"pow(greatest(v, 0), {LUMA})")):
        s[f"math__{m}"] = field(f"({e}) * {d(0.5)} + {d(0.1)}")
    gain = 2**0.5
    px = lambda c: f"(greatest({c}, 0) * {d(gain)})"
    gp = 0.18**1.7
    s["view_transform__sigmoid"] = each(lambda c: dec(f"(pow({px(c)}, {d(1.7)}) / (pow({px(c)}, {d(1.7)}) + {d(gp)}))"))
    hb = lambda c: f"(({c} * ({d(0.15)} * {c} + {d(0.05)}) + {d(0.004)}) / ({c} * ({d(0.15)} * {c} + {d(0.5)}) + {d(0.06)}) - {d(0.02 / 0.3)})"
    wt = 0.18 * 2**6
    hw = (wt * (0.15 * wt + 0.05) + 0.004) / (wt * (0.15 * wt + 0.5) + 0.06) - 0.02 / 0.3
    s["view_transform__filmic"] = each(lambda c: clip(f"{hb(px(c))} / {d(hw)}"))
    s["view_transform__aces"] = each(lambda c: clip(f"({px(c)} * ({d(2.51)} * {px(c)} + {d(0.03)})) / ({px(c)} * ({d(2.43)} * {px(c)} + {d(0.59)}) + {d(0.14)})"))
    ins = ((0.842479062253094, 0.0784335999999992, 0.0792237451477643), (0.0423282422610123, 0.878468636469772, 0.0791661274605434), (0.0423756549057051, 0.0784336, 0.879142973793104))
    outs = ((1.19687900512017, -0.0980208811401368, -0.0990297440797205), (-0.0528968517574562, 1.15190312990417, -0.0989611768448433), (-0.0529716355144438, -0.0980434501171241, 1.15107367264116))
    pl = lambda t: clip(f"15.5::DOUBLE * pow({t}, 6) - 40.14::DOUBLE * pow({t}, 5) + 31.96::DOUBLE * pow({t}, 4) - 6.868::DOUBLE * pow({t}, 3) + 0.4298::DOUBLE * {t} * {t} + 0.1191::DOUBLE * {t} - 0.00232::DOUBLE")
    s["view_transform__agx"] = image(*(f"least(pow(greatest({dot(row, 'rgb')}, 0), {d(2.2)}), 1)" for row in outs), pre=f"t0 AS (SELECT y, x, a, {', '.join(f'greatest({px(c)}, 1e-10) AS {c}' for c in 'rgb')} FROM f), t1 AS (SELECT y, x, a, {', '.join(f'({clip(f'log2({dot(row, 'rgb')})', -12.47393, 4.026069)} - {d(-12.47393)}) / {d(4.026069 + 12.47393)} AS {c}' for c, row in zip('rgb', ins, strict=True))} FROM t0), t2 AS (SELECT y, x, a, {', '.join(f'{pl(c)} AS {c}' for c in 'rgb')} FROM t1)", src="t2")
    rx, ry = 0.35 * math.sqrt(1.5), 0.35 / math.sqrt(1.5)
    c, sn = math.cos(math.radians(-30)), math.sin(math.radians(-30))
    rm = f"m0 AS (SELECT *, ((x + 0.5) / w - 0.5) * (w / least(w, h)) AS nx, ((y + 0.5) / h - 0.5) * (h / least(w, h)) AS ny FROM f), m1 AS (SELECT *, (nx * {d(c)} - ny * {d(sn)}) / {d(rx)} AS ux, (nx * {d(sn)} + ny * {d(c)}) / {d(ry)} AS uy FROM m0)"
    disc = "(sqrt(ux * ux + uy * uy) - 1)"
    bx = lambda a, b: f"(sqrt(pow(greatest(abs(ux) - {d(a)}, 0), 2) + pow(greatest(abs(uy) - {d(b)}, 0), 2)) + least(greatest(abs(ux) - {d(a)}, abs(uy) - {d(b)}), 0))"

    def hull(pts):
        out = []
        for (ax, ay), (bx_, by_) in zip(pts, pts[1:] + pts[:1], strict=True):
            n = math.hypot(bx_ - ax, by_ - ay)
            out.append(f"(ux - {d(ax)}) * {d((by_ - ay) / n)} + (uy - {d(ay)}) * {d(-(bx_ - ax) / n)}")
        return f"greatest({', '.join(out)})"

    top, arm, off = 1 - 0.5 * 0.8, 0.1 + 0.5 * 0.55, 0.15 + 0.5 * 1.25
    shapes = {"ellipse": disc, "rectangle": bx(1, 1), "triangle": hull([(0, -1 - 1 / 3), (1, 1 - 1 / 3), (-1, 1 - 1 / 3)]), "trapeze": hull([(-top, -1), (top, -1), (1, 1), (-1, 1)]), "cross": f"least({bx(1, arm)}, {bx(arm, 1)})", "crescent": f"greatest({disc}, -(sqrt(pow(ux + {d(off)}, 2) + uy * uy) - 1))", "semicircle": f"greatest({disc}, -uy)"}
    for m, e in shapes.items():
        s[f"radial_mask__{m}"] = field("1 - " + smooth("dd", -0.3, 0.0), pre=f"{rm}, m2 AS (SELECT *, {e} AS dd FROM m1)", src="m2")
    pm = "t0 AS (SELECT y, x, w, h, a, r * a AS r, g * a AS g, b * a AS b FROM f)"
    box = lambda ax, src, dst: f"{dst} AS (SELECT y, x, w, h, {', '.join(f'{window_mean(ch, ax, 2)} AS {ch}' for ch in 'rgba')} FROM {src})"
    un = [f"CASE WHEN a > 1e-6 THEN greatest({ch} / a, 0) ELSE 0 END" for ch in "rgb"]
    s["blur__box"] = image(*un, pre=f"{pm}, {box('x', 't0', 't1')}, {box('y', 't1', 't2')}", src="t2")

    def gauss(src, chans, sigma, keep=""):
        k = gauss_kernel(sigma)
        return f"gx AS (SELECT y, x, w, h{keep}, {', '.join(f'{gauss_pass(ch, 'x', k)} AS {ch}' for ch in chans)} FROM {src}), gy AS (SELECT y, x, w, h{keep}, {', '.join(f'{gauss_pass(ch, 'y', k)} AS {ch}' for ch in chans)} FROM gx)"

    s["blur__gaussian"] = image(*un, pre=f"{pm}, {gauss('t0', 'rgba', 0.8)}", src="gy")
    s["denoise"] = image(*(f"f0.{ch} + (gy.{ch} - f0.{ch}) * {d(0.2)}" for ch in "rgb"), "f0.a", pre=gauss("f", "rgb", 0.6 + 2.4 * 0.2), src="f f0 JOIN gy USING (y, x)")
    s["high_pass"] = image(*(clip(f"(f0.{ch} - gy.{ch}) * 0.5 + 0.5") for ch in "rgb"), "f0.a", pre=gauss("f", "rgb", 1.0), src="f f0 JOIN gy USING (y, x)")
    lim = 0.5 * 0.04**0.6
    eight = "o AS (SELECT * FROM (VALUES (-1,-1),(-1,0),(-1,1),(0,-1),(0,1),(1,-1),(1,0),(1,1)) t(dy, dx))"
    s["hot_pixel"] = image(*(f"CASE WHEN x > 0 AND y > 0 AND x < w - 1 AND y < h - 1 AND abs({c} - m{c}) > {d(lim)} THEN m{c} ELSE {c} END" for c in "rgb"), pre=f"{eight}, j AS (SELECT f.y, f.x, {', '.join(f'list_sort(list(n.{c})) AS l{c}' for c in 'rgb')} FROM f CROSS JOIN o JOIN f n ON n.y = f.y + o.dy AND n.x = f.x + o.dx GROUP BY f.y, f.x), j2 AS (SELECT f.*, {', '.join(f'(l{c}[4] + l{c}[5]) / 2 AS m{c}' for c in 'rgb')} FROM f JOIN j ON f.y = j.y AND f.x = j.x)", src="j2")
    three = lambda ch, ax: gauss_pass(ch, ax, [0.25, 0.5, 0.25])
    diff = lambda ch, ax: gauss_pass(ch, ax, [-0.5, 0.0, 0.5])
    s["edge_field"] = field(clip("sqrt(gx1 * gx1 + gy1 * gy1) / 0.5"), pre=f"t0 AS (SELECT y, x, w, h, {enc(LUMA)} AS v FROM f), t1 AS (SELECT *, {diff('v', 'x')} AS dx1, {three('v', 'x')} AS sx1 FROM t0), t2 AS (SELECT *, {three('dx1', 'y')} AS gx1, {diff('sx1', 'y')} AS gy1 FROM t1)", src="t2")
    s["edge_field__laplacian"] = field(clip(f"(abs(hx + hy) / 1 - {d(0.1)}) / {d(0.5)}"), pre=f"t0 AS (SELECT y, x, w, h, {enc(LUMA)} AS v FROM f), t1 AS (SELECT *, {gauss_pass('v', 'x', [1.0, -2.0, 1.0])} AS hx, {gauss_pass('v', 'y', [1.0, -2.0, 1.0])} AS hy FROM t0)", src="t1")
    s["median_mask"] = final(disc_rank(1, 0.5), "v")
    s["median_mask__low"] = final(disc_rank(2, 0.2), "v")
    ext = lambda fn, ax, src, dst: f"{dst} AS (SELECT y, x, {fn}(v) OVER (PARTITION BY {'y' if ax == 'x' else 'x'} ORDER BY {ax} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM {src})"
    er = lambda fn, src, dst: f"{ext(fn, 'x', src, dst + '0')}, {ext(fn, 'y', dst + '0', dst)}"
    s["morphology__erode"] = final(er("min", "f", "q"), "v")
    s["morphology__dilate"] = final(er("max", "f", "q"), "v")
    s["morphology__open"] = final(f"{er('min', 'f', 'm')}, {er('max', 'm', 'q')}", "v")
    s["morphology__close"] = final(f"{er('max', 'f', 'm')}, {er('min', 'm', 'q')}", "v")
    s["morphology__round"] = final(disc_rank(2, 1.0), "v")
    s["depth_normals"] = image(
        "(-gx / ln + 1) * 0.5", "(-gy / ln + 1) * 0.5", "(1 / ln + 1) * 0.5", d(1),
        pre=f"t0 AS (SELECT *, 1 - {clip('v')} AS z FROM f), t1 AS (SELECT *, z - lag(z) OVER (PARTITION BY y ORDER BY x) AS l0, lead(z) OVER (PARTITION BY y ORDER BY x) - z AS r0, z - lag(z) OVER (PARTITION BY x ORDER BY y) AS u0, lead(z) OVER (PARTITION BY x ORDER BY y) - z AS d0 FROM t0), t2 AS (SELECT *, {', '.join(f'CASE WHEN abs({c}0) <= 0.4::DOUBLE THEN {c}0 END AS {c}1' for c in 'lrud')} FROM t1), t3 AS (SELECT *, 2 * coalesce((l1 + r1) / 2, l1, r1, 0) AS gx, 2 * coalesce((u1 + d1) / 2, u1, d1, 0) AS gy FROM t2), t4 AS (SELECT *, sqrt(gx * gx + gy * gy + 1) AS ln FROM t3)",
        src="t4",
    )
    s["crop_rotate__flip"] = final("q AS (SELECT CAST(w - 1 - x AS INTEGER) AS y, CAST(h - 1 - y AS INTEGER) AS x, r, g, b, a FROM f)")
    s["crop_rotate__cut"] = final("q AS (SELECT CAST(y - floor(0.2 * h + 0.5) AS INTEGER) AS y, CAST(x - 10 AS INTEGER) AS x, r, g, b, a FROM f WHERE x >= 10 AND x < 60 AND y >= floor(0.2 * h + 0.5) AND y < floor(0.2 * h + 0.5) + floor(0.4 * h + 0.5))")
    c, sn = math.cos(math.radians(-10)), math.sin(math.radians(-10))
    s["crop_rotate__angle"] = final(gathered(f"w / 2 + (x + 0.5 - w / 2) * {d(c)} - (y + 0.5 - h / 2) * {d(sn)}", f"h / 2 + (x + 0.5 - w / 2) * {d(sn)} + (y + 0.5 - h / 2) * {d(c)}"))
    s["mask_crop"] = final(gathered(f"{d(0.105)} * w + x + 0.5", f"{d(0.2)} * h + y + 0.5", "v", keys="(SELECT * FROM f WHERE x < 50 AND y < floor(h * 0.5 + 0.5))"), "v")
    c, sn = math.cos(math.radians(15)), math.sin(math.radians(15))
    dx, dy = f"(x + 0.5 - {d(0.03)} * w - w / 2)", f"(y + 0.5 - {d(-0.02)} * h - h / 2)"
    s["transform"] = final(gathered(f"w / 2 + ({dx} * {d(c)} + {dy} * {d(sn)}) / {d(0.9)}", f"h / 2 + ({dy} * {d(c)} - {dx} * {d(sn)}) / {d(0.9)}"))
    shx = lambda v: clip(f"({v} - 0.5) * 10", -3, 3)
    s["displacement_map"] = final(gathered(f"x + 0.5 - {shx('v')}", f"y + 0.5 - {shx(LUMA)}", inside=False))
    s["area_downscale"] = final("q AS (SELECT CAST(floor(y / 4.0) AS INTEGER) AS y, CAST(floor(x / 4.0) AS INTEGER) AS x, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM f GROUP BY ALL)")
    fr = "WITH s AS (SELECT event_type AS f, CAST(hour(ts) AS INTEGER) AS y, CAST(day(ts) AS INTEGER) AS x, round(avg(value), 6) AS v FROM events GROUP BY ALL)"
    for m, e in (("mean", "avg(v)"), ("median", "median(v)"), ("max", "max(v)"), ("min", "min(v)")):
        s[f"stack__{m}"] = f"{fr} SELECT y, x, round({e} + 1e-9::DOUBLE, 5) AS v FROM s GROUP BY y, x"
    bw = f"greatest(0.4::DOUBLE * r + 0.5::DOUBLE * g + 0.11::DOUBLE * b, 0)"
    s["black_white"] = each(lambda c: f"{c} + ({bw} - {c}) * {d(0.8)}")
    px0, py0 = "((x + 0.5) / w)", "((y + 0.5) / h)"
    s["selection_mask"] = field(f"(CASE WHEN {px0} BETWEEN 0.1::DOUBLE AND 0.7::DOUBLE AND {py0} BETWEEN 0.1::DOUBLE AND 0.8::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * (1 - CASE WHEN pow(({px0} - 0.45::DOUBLE) / 0.15::DOUBLE, 2) + pow(({py0} - 0.55::DOUBLE) / 0.35::DOUBLE, 2) <= 1 THEN 1 ELSE 0 END)")
    s["smart_mask"] = field(smooth("v", 0.4 - 0.1, 0.4 + 0.1))
    s["matte_mask"] = field(clip("v"))
    s["inpaint"] = image(*(f"{c} + ({o} - {c}) * {clip('v')}" for c, o in zip("rgb", "brg", strict=True)))
    vr = "sqrt((x - (w - 1) / 2) * (x - (w - 1) / 2) + (y - (h - 1) / 2) * (y - (h - 1) / 2)) / sqrt((w - 1) * (w - 1) / 4 + (h - 1) * (h - 1) / 4)"
    s["lens_correct__falloff"] = image(*(f"{c} * (1 + {d(0.4)} * {smooth('rr', 0.3, 1.0)})" for c in "rgb"), pre=f"t0 AS (SELECT *, {vr} AS rr FROM f)", src="t0")
    def veil(k, src):
        """Steps from src's colours to v1, with luma's veil taken (r1, g1, b1), and for k below 0 laid on black too."""
        a = 0.10 * k
        dark = f"WHEN l <= 1e-6 THEN {{0}} + {dec(f'({enc('greatest(l, 0)')} - {d(a)}) / {d(1 - a)}')} - l" if k < 0 else ""
        return f"v0 AS (SELECT *, {LUMA} AS l FROM {src}), v1 AS (SELECT *, {', '.join(f'CASE {dark.format(c)} WHEN l > 1e-6 AND {enc('l')} < 1 THEN {c} * ({dec(f'greatest(({enc('l')} - {d(a)}) / {d(1 - a)}, 0)')} / l) ELSE {c} END AS {c}1' for c in 'rgb')} FROM v0)"

    def haze(k, src="v1"):
        """Steps from r1, g1, b1 of src to w2, with colour's veil taken at the luma there is (r2, g2, b2)."""
        a = 0.15 * k
        shown = lambda c: enc(f"greatest({c}1, 0)")
        fade = smooth(enc("greatest(l1, 0)"), 0.12, 0.40)
        return f"w0 AS (SELECT *, {luma('r1', 'g1', 'b1')} AS l1, {', '.join(f'CASE WHEN {shown(c)} < 1 THEN {dec(f'greatest(({shown(c)} - {d(a)}) / {d(1 - a)}, 0)')} ELSE {c}1 END AS c{c}' for c in 'rgb')} FROM {src}), w1 AS (SELECT *, {luma('cr', 'cg', 'cb')} AS l2 FROM w0), w2 AS (SELECT *, {', '.join(f'CASE WHEN l1 > 1e-6 AND l2 > 1e-6 THEN {c}1 + (c{c} * (l1 / l2) - {c}1) * {fade} ELSE {c}1 END AS {c}2' for c in 'rgb')} FROM w1)"

    s["detail__dehaze"] = image("r2", "g2", "b2", pre=f"{veil(0.3, 'f')}, {haze(0.3)}", src="w2")
    sat0 = f"s0 AS (SELECT y, x, a, {', '.join(f'{LUMA} + ({c} - {LUMA}) * {d(1.2)} AS {c}' for c in 'rgb')} FROM f)"
    s["standard_color__dehaze"] = image("r2", "g2", "b2", pre=f"{sat0}, {veil(-0.25, 's0')}, {haze(-0.25)}", src="w2")
    # each half goes so much of its way, by the tone that comes in and the channel
    band = f"({WS} * {d(0.5)} + {WM} + {WH} * {d(1.5)})"
    step = lambda new, old, c: f"CASE WHEN {band} * {d(0.8 if c == 'r' else 1)} * ({new} - {old}) <> 0 THEN greatest({old} + {band} * {d(0.8 if c == 'r' else 1)} * ({new} - {old}), 0) ELSE {old} END"
    first = f"n0 AS (SELECT *, {SEEN} AS sn FROM f)"
    half = f"p0 AS (SELECT y, x, a, sn, {', '.join(f'{step(c + '1', c, c)} AS {c}1' for c in 'rgb')} FROM v1)"
    s["detail__weighed"] = image(*(step(c + "2", c + "1", c) for c in "rgb"), pre=f"{first}, {veil(0.4, 'n0')}, {half}, {haze(0.4, 'p0')}", src="w2")
    offs = [(a, b) for a in range(-4, 5) for b in range(-4, 5)]
    s["distance_field"] = final(f"o AS (SELECT * FROM (VALUES {', '.join(str(v) for v in offs)}) t(dy, dx)), i AS (SELECT y, x, {clip('v')} >= 0.5 AS k FROM f), j AS (SELECT i.y, i.x, i.k, min(CASE WHEN n.k <> i.k THEN sqrt(dy * dy + dx * dx) END) AS dd FROM i CROSS JOIN o JOIN i n ON n.y = i.y + dy AND n.x = i.x + dx GROUP BY ALL), q AS (SELECT y, x, {clip(f'0.5 + 0.5 * ' + clip(f'(CASE WHEN k THEN 1 ELSE -1 END) * (coalesce(dd, 1e6) - 0.5) / 3', -1, 1))} AS v FROM j)", "v")
    cat = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))
    cat_back = ((1.86206786, -1.01125463, 0.14918677), (0.38752654, 0.62144744, -0.00897398), (-0.01584150, -0.03412294, 1.04996444))
    xyz = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    xyz_back = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
    cones = [[sum(m * v for m, v in zip(row, (wx / wy, 1.0, (1 - wx - wy) / wy), strict=True)) for row in cat] for wx, wy in ((0.44757, 0.40745), (0.3127, 0.329))]
    gains = [0.8 * to / of + 0.2 for of, to in zip(*cones, strict=True)]
    s["chromatic_adapt"] = image(*(dot(row, ("x2", "y2", "z2")) for row in xyz_back), pre=f"t0 AS (SELECT y, x, a, {', '.join(f'{dot(row, 'rgb')} AS {n}' for row, n in zip(xyz, ('x0', 'y0', 'z0'), strict=True))} FROM f), t1 AS (SELECT *, {', '.join(f'{dot(row, ('x0', 'y0', 'z0'))} * {d(k)} AS {n}' for row, n, k in zip(cat, ('l', 'm', 's'), gains, strict=True))} FROM t0), t2 AS (SELECT *, {', '.join(f'{dot(row, ('l', 'm', 's'))} AS {n}' for row, n in zip(cat_back, ('x2', 'y2', 'z2'), strict=True))} FROM t1)", src="t2")
    pv = 0.7447275
    level = lambda v: [c / (0.2126 * v[0] + 0.7152 * v[1] + 0.0722 * v[2]) for c in v]
    sep, warm = level((1.22, 1.0, 0.72)), level((1.0, 0.975, 0.92))
    wsh = smooth("d2", 0.9 - 0.4, 0.9 + 0.4)
    tints = [f"((1 + ({d(a)} - 1) * 0.5::DOUBLE * (1 - {wsh})) + ({d(b)} - (1 + ({d(a)} - 1) * 0.5::DOUBLE * (1 - {wsh}))) * 0.3::DOUBLE)" for a, b in zip(sep, warm, strict=True)]
    s["paper"] = image(*(f"(CASE WHEN yy <= 1e-6 THEN pow(10::DOUBLE, -d2) ELSE greatest({c}, 0) * (pow(10::DOUBLE, -d2) / yy) END) * {tn}" for c, tn in zip("rgb", tints, strict=True)), pre=f"t0 AS (SELECT *, {luma("greatest(r, 0)", "greatest(g, 0)", "greatest(b, 0)")} AS yy FROM f), t1 AS (SELECT *, -log10({clip('yy', 1e-6, 1)}) AS d0 FROM t0), t2 AS (SELECT *, greatest({d(1.16)} * (d0 - {d(pv)} + {d(1.65 * 0.301 * 0.5)}) + {d(pv)}, 0) AS d1 FROM t1), t3 AS (SELECT *, {clip(f'{d(-0.25)} * ln(exp(-d1 / 0.25::DOUBLE) + {d(math.exp(-2.1 / 0.25))})', 0, 2.1)} AS d2 FROM t2)", src="t3")
    s["noise_estimate"] = f"""WITH f AS ({FRAME}), t0 AS (SELECT *, {LUMA} AS yy FROM f WHERE (floor(x / 5.0) + 1) * 5 <= w AND (floor(y / 5.0) + 1) * 5 <= h), t1 AS (SELECT floor(x / 5.0) AS tx, floor(y / 5.0) AS ty, {enc('yy')} AS l, {enc('abs(r - yy)')} + {enc('abs(b - yy)')} AS c FROM t0),
    t2 AS (SELECT least(floor(avg(l) * 8), 7) AS bin, stddev_pop(l) AS ls, stddev_pop(c) AS cs FROM t1 GROUP BY tx, ty), t3 AS (SELECT bin, list_sort(list(ls))[CAST(floor((count(*) - 1) * 0.1::DOUBLE + 0.5) AS BIGINT) + 1] AS ls, list_sort(list(cs))[CAST(floor((count(*) - 1) * 0.1::DOUBLE + 0.5) AS BIGINT) + 1] AS cs FROM t2 GROUP BY bin)
    SELECT 0 AS frame_id, round((SELECT avg(v) FROM (SELECT ls AS v FROM t3 ORDER BY ls LIMIT 2)), 6) AS luma_sigma, round((SELECT avg(v) FROM (SELECT cs AS v FROM t3 ORDER BY cs LIMIT 2)), 6) AS chroma_sigma"""
    s["stack__hdr"] = f"""{fr}, e AS (SELECT f, CAST(row_number() OVER (ORDER BY f) AS DOUBLE) AS e FROM (SELECT DISTINCT f FROM s)), k AS (SELECT y, x, v / {d(500)} AS v, e, (1 - {smooth(f'(v / {d(500)})', 0.8, 0.95)}) * e * e / ({d((3 / 40000) ** 2)} + abs(v / {d(500)}) / 40000) AS wt FROM s JOIN e USING (f)),
    t AS (SELECT y, x, sum(wt * v / e) AS sv, sum(wt) AS sw, max(v / e) AS mb FROM k GROUP BY y, x) SELECT y, x, round((SELECT median(e) FROM e) * CASE WHEN sw > 0 THEN sv / sw ELSE mb END + 1e-9::DOUBLE, 5) AS v FROM t"""
    s["blur__gaussian_8"] = image(*un, pre=f"{pm}, {gauss('t0', 'rgba', 8.0)}", src="gy", digits=5)
    # wide: means of squares of two, a blur of half the width, drawn up between their centres
    small = f"{pm}, sm AS (SELECT CAST(floor(y / 2.0) AS INTEGER) AS y, CAST(floor(x / 2.0) AS INTEGER) AS x, ceil(max(w) / 2) AS w, ceil(max(h) / 2) AS h, {', '.join(f'avg({ch}) AS {ch}' for ch in 'rgba')} FROM t0 GROUP BY ALL)"
    near = lambda v, n: f"least(greatest(({v} + 0.5) / 2 - 0.5, 0), ceil({n} / 2) - 1)"
    up = f"u0 AS (SELECT y, x, {near('x', 'w')} AS gx, {near('y', 'h')} AS gy, ceil(w / 2) AS sw, ceil(h / 2) AS sh FROM f), u1 AS (SELECT *, gx - floor(gx) AS tx, gy - floor(gy) AS ty, floor(gx) AS x0, floor(gy) AS y0, least(floor(gx) + 1, sw - 1) AS x1, least(floor(gy) + 1, sh - 1) AS y1 FROM u0)"
    mix = lambda ch: f"(p00.{ch} * (1 - tx) + p01.{ch} * tx) * (1 - ty) + (p10.{ch} * (1 - tx) + p11.{ch} * tx) * ty AS {ch}"
    joins = " ".join(f"JOIN gy p{i}{j} ON p{i}{j}.y = u1.y{i} AND p{i}{j}.x = u1.x{j}" for i in (0, 1) for j in (0, 1))
    s["blur__wide"] = image(*un, pre=f"{small}, {gauss('sm', 'rgba', 7.0)}, {up}, u2 AS (SELECT u1.y, u1.x, {', '.join(map(mix, 'rgba'))} FROM u1 {joins})", src="u2", digits=5)
    taps = [(math.floor(math.cos(math.radians(30)) * k + 1e-9), math.floor(math.sin(math.radians(30)) * k + 1e-9)) for k in range(-3, 4)]
    s["blur__motion"] = image(*un, pre=f"{pm}, o AS (SELECT * FROM (VALUES {', '.join(map(str, taps))}) t(ox, oy)), m0 AS (SELECT k.y, k.x, {', '.join(f'avg(s.{ch}) AS {ch}' for ch in 'rgba')} FROM t0 k CROSS JOIN o JOIN t0 s ON s.x = least(greatest(k.x + ox, 0), k.w - 1) AND s.y = least(greatest(k.y + oy, 0), k.h - 1) GROUP BY k.y, k.x)", src="m0")
    # a table of three steps a side: each channel is linear between its steps, and the table's values are products of such
    half_ = lambda v: f"(CASE WHEN {v} < 0.5 THEN {v} * 0.5 ELSE 0.25 + ({v} - 0.5) * 1.5 END)"
    er_, eg_, eb_ = (clip(enc(f"greatest({c}, 0)")) for c in "rgb")
    new = (half_(eb_), f"({er_} * {d(0.9)} + {d(0.05)})", f"({eg_} * (1 - {d(0.2)} * {er_}))")
    s["lut"] = image(*(f"{c} + ({dec(clip(v))} - {c}) * {d(0.8)}" for c, v in zip("rgb", new, strict=True)))
    s["depth_map"] = s["export_layer"] = s["output"] = image("r", "g", "b")
    s["render_slice"] = f"WITH f AS ({FRAME}), t AS (SELECT *, {LUMA} AS yy FROM f), m AS (SELECT *, {smooth('yy', 0.2, 0.3)} * (1 - {smooth('yy', 0.6, 0.7)}) AS k FROM t) SELECT y, round(avg({luma('r + r * k', 'g + g * k', 'b + b * k')}), 6) AS luma, count(*) AS n FROM m GROUP BY y"
    return s


def selfguided(tag, src, col, out, r, eps=0.005):
    """Steps to a column out over src: col led by its own box means, rows and then columns, twice."""
    both = lambda names, ax: ", ".join(f"{window_mean(n, ax, r)} AS {n}" for n in names)
    var = "greatest(_c - _m * _m, 0)"
    return (
        f"{tag}1 AS (SELECT *, {col} AS _m, {col} * {col} AS _c FROM {src}), {tag}2 AS (SELECT * REPLACE ({both(('_m', '_c'), 'x')}) FROM {tag}1), {tag}3 AS (SELECT * REPLACE ({both(('_m', '_c'), 'y')}) FROM {tag}2), "
        f"{tag}4 AS (SELECT *, {var} / ({var} + {d(eps)}) AS _a FROM {tag}3), {tag}5 AS (SELECT *, _m * (1 - _a) AS _b FROM {tag}4), {tag}6 AS (SELECT * REPLACE ({both(('_a', '_b'), 'x')}) FROM {tag}5), {tag}7 AS (SELECT * REPLACE ({both(('_a', '_b'), 'y')}) FROM {tag}6), "
        f"{tag} AS (SELECT * EXCLUDE (_m, _c, _a, _b), _a * {col} + _b AS {out} FROM {tag}7)"
    )


def contrast_scales(scales):
    """Steps to k: f with l, dd and a factor for each channel (fr, fg, fb) from scales of (strength, box radius, weights or None)."""
    steps, at = [f"k0 AS (SELECT *, {LUMA} AS l, {enc(LUMA)} AS dd, {SEEN} AS sn, 1.0::DOUBLE AS fr, 1.0::DOUBLE AS fg, 1.0::DOUBLE AS fb FROM f)"], "k0"
    for i, (strength, r, weight) in enumerate(scales):
        steps.append(selfguided(f"sg{i}", at, "dd", "base", r))
        raw = "(dd - base)"
        soft = f"({raw} / (1 + abs({raw} / (CASE WHEN {raw} > 0 THEN {d(0.16)} ELSE {d(0.6)} END))))"
        ratio = f"({dec(f'greatest(dd + {d(2.5 * strength)} * {soft}, dd * {d(0.45)})')} / l)"
        if weight:
            ratio = f"(CASE WHEN {weight} = 1 THEN {ratio} ELSE greatest(1 + {weight} * ({ratio} - 1), {dec(f'dd * {d(0.45)}')} / l) END)"
        steps.append(f"kk{i} AS (SELECT * EXCLUDE (base) REPLACE ({', '.join(f'CASE WHEN l > 1e-6 THEN f{c} * {ratio} ELSE f{c} END AS f{c}' for c in 'rgb')}) FROM sg{i})")
        at = f"kk{i}"
    return ", ".join(steps) + f", k AS (SELECT * FROM {at})"


def opaque(src, dst, base, top, mode, k, out):
    """A step that lays columns top* over base* (each with its alpha) in a mode by k times the top's alpha, as out*."""
    a = f"(({k}) * {clip(f'{top}a')})"
    if mode == "luminosity":
        lum = lambda q: f"(0.3::DOUBLE * {q}r + 0.59::DOUBLE * {q}g + 0.11::DOUBLE * {q}b)"
        pre = f"{dst}0 AS (SELECT *, {lum(top)} - {lum(base)} AS _dl FROM {src}), {dst}1 AS (SELECT *, {', '.join(f'{base}{c} + _dl AS _s{c}' for c in 'rgb')} FROM {dst}0), {dst}2 AS (SELECT *, {lum('_s')} AS _la, least(_sr, _sg, _sb) AS _lo, greatest(_sr, _sg, _sb) AS _hi FROM {dst}1), {dst}3 AS (SELECT *, {', '.join(f'CASE WHEN _lo < 0 THEN _la + (_s{c} - _la) * _la / greatest(_la - _lo, 1e-6) ELSE _s{c} END AS _d{c}' for c in 'rgb')} FROM {dst}2), "
        new = {c: f"(CASE WHEN _hi > 1 THEN _la + (_d{c} - _la) * (1 - _la) / greatest(_hi - _la, 1e-6) ELSE _d{c} END)" for c in "rgb"}
        drop, src = " EXCLUDE (_dl, _sr, _sg, _sb, _la, _lo, _hi, _dr, _dg, _db)", f"{dst}3"
    else:
        pre, drop, new = "", "", {c: f"({blend_channel(mode, base + c, top + c)})" for c in "rgb"}
    return f"{pre}{dst} AS (SELECT *{drop}, {', '.join(f'{base}{c} + ({new[c]} - {base}{c}) * {a} AS {out}{c}' for c in 'rgb')}, {a} + {clip(f'{base}a')} * (1 - {a}) AS {out}a FROM {src})"


def blurred(src, dst, cols, sigma):
    """Steps that blur columns in place by a small gaussian."""
    k = gauss_kernel(sigma)
    one = lambda ax: ", ".join(f"{gauss_pass(c, ax, k)} AS {c}" for c in cols)
    return f"{dst}x AS (SELECT * REPLACE ({one('x')}) FROM {src}), {dst} AS (SELECT * REPLACE ({one('y')}) FROM {dst}x)"


def colour_guided(src, targets, r, eps, clamped):
    """Steps to gq: targets led by three guide columns ur, ug, ub: box means of products, a solve of three by three, box means of the coefficients."""
    mean = window_mean if clamped else (lambda c, ax, n: f"avg({c}) OVER (PARTITION BY {'y' if ax == 'x' else 'x'} ORDER BY {ax} ROWS BETWEEN {n} PRECEDING AND {n} FOLLOWING)")
    g = ("ur", "ug", "ub")
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    cols = {f"p{i}{j}": f"{g[i]} * {g[j]}" for i, j in pairs} | {f"p{i}_{q}": f"{g[i]} * {q}" for i in range(3) for q in targets} | {f"m{i}": g[i] for i in range(3)} | {f"m_{q}": q for q in targets}
    both = lambda names, ax: ", ".join(f"{mean(n, ax, r)} AS {n}" for n in names)
    out = [f"g0 AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {src})", f"g1 AS (SELECT * REPLACE ({both(cols, 'x')}) FROM g0)", f"g2 AS (SELECT * REPLACE ({both(cols, 'y')}) FROM g1)"]
    out.append("g3 AS (SELECT *, " + ", ".join(f"p{i}{j} - m{i} * m{j}{f' + {d(eps)}' if i == j else ''} AS s{i}{j}" for i, j in pairs) + ", " + ", ".join(f"p{i}_{q} - m{i} * m_{q} AS v{i}_{q}" for i in range(3) for q in targets) + " FROM g2)")
    s_ = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(cols_):
        (a, b, c), (e, f, h), (i, j, k) = cols_
        return f"({a} * ({f} * {k} - {h} * {j}) - {b} * ({e} * {k} - {h} * {i}) + {c} * ({e} * {j} - {f} * {i}))"

    full = [[s_(i, j) for j in range(3)] for i in range(3)]
    swap = lambda n, q: [[f"v{i}_{q}" if j == n else full[i][j] for j in range(3)] for i in range(3)]  # noqa: E731  Cramer's rule
    coef = [f"a{n}_{q}" for n in range(3) for q in targets]
    out.append("g4 AS (SELECT *, " + ", ".join(f"{det(swap(n, q))} / {det(full)} AS a{n}_{q}" for n in range(3) for q in targets) + " FROM g3)")
    out.append("g5 AS (SELECT *, " + ", ".join(f"m_{q} - a0_{q} * m0 - a1_{q} * m1 - a2_{q} * m2 AS b_{q}" for q in targets) + " FROM g4)")
    coef += [f"b_{q}" for q in targets]
    out += [f"g6 AS (SELECT * REPLACE ({both(coef, 'x')}) FROM g5)", f"g7 AS (SELECT * REPLACE ({both(coef, 'y')}) FROM g6)"]
    out.append("gq AS (SELECT *, " + ", ".join(f"a0_{q} * ur + a1_{q} * ug + a2_{q} * ub + b_{q} AS q_{q}" for q in targets) + " FROM g7)")
    return ", ".join(out)


def cubic(x, points):
    """A monotone cubic through points, of slope 1 beyond them."""
    n = len(points)
    h = [b[0] - a[0] for a, b in zip(points, points[1:], strict=False)]
    slope = [(b[1] - a[1]) / w for a, b, w in zip(points, points[1:], h, strict=False)]
    m = [slope[0], *(0.0 if a * b <= 0 else (a + b) / 2 for a, b in zip(slope, slope[1:], strict=False)), slope[-1]]
    for i, sl in enumerate(slope):
        if sl == 0:
            m[i] = m[i + 1] = 0.0
        elif (r := ((m[i] / sl) ** 2 + (m[i + 1] / sl) ** 2) ** 0.5) > 3:
            m[i], m[i + 1] = 3 * m[i] / r, 3 * m[i + 1] / r
    out = f"CASE WHEN {x} < {d(points[0][0])} THEN {d(points[0][1])} + {x} - {d(points[0][0])} "
    for i in range(n - 1):
        t = f"(({x} - {d(points[i][0])}) / {d(h[i])})"
        hermite = f"({d(points[i][1])} * (2 * pow({t}, 3) - 3 * pow({t}, 2) + 1) + {d(m[i] * h[i])} * (pow({t}, 3) - 2 * pow({t}, 2) + {t}) + {d(points[i + 1][1])} * (3 * pow({t}, 2) - 2 * pow({t}, 3)) + {d(m[i + 1] * h[i])} * (pow({t}, 3) - pow({t}, 2)))"
        out += f"WHEN {x} <= {d(points[i + 1][0])} THEN {hermite} "
    return f"({out} ELSE {d(points[-1][1])} + {x} - {d(points[-1][0])} END)"


def neighbourly(s: dict[str, str]) -> None:
    """Nodes with neighbourhoods and those of several steps. Radii that follow the frame's size are those of frames of 100 rows and more."""
    import math

    scale = "r * fr", "g * fg", "b * fb"
    s["clarity"] = image(*scale, pre=contrast_scales([(0.3, 2, None), (0.4, 3, None)]), src="k")
    weight = f"({WS} + {WM} * {d(0.6)} + {WH})"
    s["detail__texture"] = image(*scale, pre=contrast_scales([(0.3, 2, weight), (-0.2, 3, None)]), src="k")
    a = 0.10 * 0.3
    lifted = ", ".join(f"CASE WHEN {LUMA} > 1e-6 AND {enc(LUMA)} < 1 THEN {c} * ({dec(f'greatest(({enc(LUMA)} - {d(a)}) / {d(1 - a)}, 0)')} / {LUMA}) ELSE {c} END AS {c}" for c in "rgb")
    a2 = 0.15 * 0.3
    clear = lambda c: f"(CASE WHEN {enc(c)} < 1 THEN {dec(f'greatest(({enc(c)} - {d(a2)}) / {d(1 - a2)}, 0)')} ELSE {c} END)"
    textured = contrast_scales([(0.2, 2, None)]).replace("FROM f)", "FROM z0)", 1)
    s["detail"] = image(
        *(f"CASE WHEN l1 > 1e-6 AND l2 > 1e-6 THEN r{c} + (c{c} * (l1 / l2) - r{c}) * {smooth(enc('l1'), 0.12, 0.40)} ELSE r{c} END" for c in "rgb"),
        pre=f"z0 AS (SELECT * REPLACE ({lifted}) FROM f), {textured}, z1 AS (SELECT y, x, a, r * fr AS rr, g * fg AS rg, b * fb AS rb FROM k), z2 AS (SELECT *, {luma('rr', 'rg', 'rb')} AS l1, {', '.join(f'{clear('r' + c)} AS c{c}' for c in 'rgb')} FROM z1), z3 AS (SELECT *, {luma('cr', 'cg', 'cb')} AS l2 FROM z2)",
        src="z3",
    )
    size = 0.6 * math.sqrt(3)
    pre, at = f"h0 AS (SELECT *, {', '.join(f'{enc(c)} AS e{c}' for c in 'rgb')} FROM f)", "h0"
    for c in "rgb":
        pre += f", {selfguided(f'lo{c}', at, f'e{c}', f'l{c}', 1)}, {selfguided(f'hi{c}', f'lo{c}', f'e{c}', f'h{c}', 2)}"
        at = f"hi{c}"
    s["sharpen"] = image(*(f"{c} + {d(0.8)} * ({c} - {dec(f'greatest(l{c} + (h{c} - l{c}) * {d(size - 1)}, 0)')})" for c in "rgb"), pre=pre, src=at)
    disp = f"d0 AS (SELECT y, x, w, h, a, r AS xr, g AS xg, b AS xb, {', '.join(f'{enc(clip(c))} AS d{c}' for c in 'rgb')}, a AS da FROM f)"
    back = lambda q: [f"CASE WHEN x{c} > 1 THEN x{c} + ({dec(clip(q + c))} - 1) ELSE {dec(clip(q + c))} END" for c in "rgb"]
    un = lambda q, n: f"{', '.join(f'CASE WHEN {q}a > 1e-6 THEN greatest({q}{c} / {q}a, 0) ELSE 0 END AS {n}{c}' for c in 'rgb')}, {q}a AS {n}a"
    soft = f"s0 AS (SELECT *, {', '.join(f'(1 - {clip('d' + c)}) * a AS i{c}' for c in 'rgb')}, a AS ia FROM d0), {blurred('s0', 's1', ['ir', 'ig', 'ib', 'ia'], 0.8)}, s2 AS (SELECT *, {un('i', 'j')} FROM s1)"
    s["sharpening"] = image(*back("n"), "na", pre=f"{disp}, {soft}, {opaque('s2', 'o1', 'd', 'j', 'vivid_light', 1, 't')}, {opaque('o1', 'o2', 'd', 't', 'overlay', d(0.4), 'v')}, {opaque('o2', 'o3', 'd', 'v', 'luminosity', 1, 'u')}, {opaque('o3', 'o4', 'v', 'u', 'normal', 1, 'n')}", src="o4")
    inv = f"s0 AS (SELECT *, {', '.join(f'(1 - {clip('d' + c)}) AS i{c}, (1 - {clip('d' + c)}) AS k{c}' for c in 'rgb')} FROM d0), {blurred('s0', 's1', ['kr', 'kg', 'kb'], 1.0)}, s2 AS (SELECT *, {', '.join(f'{clip(f'(i{c} - k{c}) * 0.5 + 0.5')} * a AS p{c}' for c in 'rgb')}, a AS pa FROM s1), {blurred('s2', 's3', ['pr', 'pg', 'pb', 'pa'], 0.6)}, s4 AS (SELECT *, {un('p', 'j')} FROM s3)"
    s["skin_soften"] = image(*back("n"), "na", pre=f"{disp}, {inv}, {opaque('s4', 'o1', 'd', 'j', 'vivid_light', 1, 't')}, {opaque('o1', 'o2', 'd', 't', 'normal', d(0.5), 'n')}", src="o2")
    guide = ", ".join(f"{enc(c)} AS u{c}" for c in "rgb")
    s["guided_filter_mask"] = field(clip("q_tt"), pre=f"t0 AS (SELECT *, {clip('v')} AS tt, {guide} FROM f), {colour_guided('t0', ['tt'], 2, 0.01, False)}", src="gq")
    s["guided_filter"] = image(*(dec(f"q_t{c}") for c in "rgb"), pre=f"t0 AS (SELECT *, {guide}, {', '.join(f'{enc(c)} AS t{c}' for c in 'rgb')} FROM f), {colour_guided('t0', ['tr', 'tg', 'tb'], 2, 0.02, True)}", src="gq")
    s["median__luminance"] = final(f"o AS (SELECT * FROM (VALUES (0,0),(-1,0),(1,0),(0,-1),(0,1)) t(dy, dx)), j AS (SELECT f.y, f.x, n.r, n.g, n.b, {luma('n.r', 'n.g', 'n.b')} AS l FROM f CROSS JOIN o JOIN f n ON n.y = f.y + o.dy AND n.x = f.x + o.dx), m AS (SELECT y, x, list_sort(list({{'l': l, 'r': r, 'g': g, 'b': b}}))[CAST(floor((count(*) - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) + 1] AS m FROM j GROUP BY y, x), q AS (SELECT f.y, f.x, m.m.r AS r, m.m.g AS g, m.m.b AS b, f.a FROM f JOIN m ON f.y = m.y AND f.x = m.x)")
    # a trapezoid, wider below by k, drawn into the frame: places are divided by what grows with the depth
    k, z = 1 + 2 * 0.3 / 4, 1.05
    xx, yy = f"((x + 0.5 - w / 2) / {d(z)} + w / 2)", f"((y + 0.5 - h / 2) / {d(z)} + h / 2)"
    deep = f"(1 + {d(k - 1)} * {yy} / h)"
    s["perspective"] = final(gathered(f"w / 2 + ({xx} - w / 2) / {deep}", f"h * {d(k)} * ({yy} / h) / {deep}"))
    s["curves"] = image(*(f"{c} * sc" for c in "rgb"), pre=f"c0 AS (SELECT * REPLACE ({', '.join(f'{dec(cubic(enc(c), [(0, 0), (0.4, 0.5), (1, 1)]))} AS {c}' for c in 'rgb')}) FROM f), c1 AS (SELECT *, CASE WHEN {LUMA} > 1e-6 THEN {dec(cubic(enc(LUMA), [(0, 0.05), (1, 0.95)]))} / {LUMA} ELSE 1 END AS sc FROM c0)", src="c1")
    rr = "(sqrt((x - (w - 1) / 2) * (x - (w - 1) / 2) + (y - (h - 1) / 2) * (y - (h - 1) / 2)) / sqrt((w - 1) * (w - 1) / 4 + (h - 1) * (h - 1) / 4))"
    parts = []
    for c, extra in zip("rgb", (0.02 + 30 / 20000, 0.02, 0.02), strict=True):
        sc = f"(1 + {d(extra)} * {rr} * {rr})"
        one = gathered(f"(w - 1) / 2 + (x - (w - 1) / 2) * {sc} + 0.5", f"(h - 1) / 2 + (y - (h - 1) / 2) * {sc} + 0.5", c, inside=False)
        for name in ("g00", "g0", "g1", "g2", "g3", "q"):
            one = re.sub(rf"\b{name}\b", f"{name}_{c}", one)
        parts.append(one)
    s["lens_correct"] = image(*(f"q_{c}.{c} * (1 + {d(0.25)} * {smooth('rr', 0.5, 1.0)})" for c in "rgb"), pre=", ".join(parts) + f", f1 AS (SELECT *, {rr} AS rr FROM f)", src="f1 JOIN q_r USING (y, x) JOIN q_g USING (y, x) JOIN q_b USING (y, x)").replace("SELECT y, x, q_r.r", "SELECT f1.y, f1.x, q_r.r").replace("a AS a FROM f1 JOIN", "f1.a AS a FROM f1 JOIN")
    near = [f"coalesce(abs(v2 - {fn}(v2) OVER (PARTITION BY {p_} ORDER BY {ax})), 0)" for p_, ax in (("y", "x"), ("x", "y")) for fn in ("lag", "lead")]
    s["model_denoise"] = image(
        *(f"CASE WHEN greatest(r, g, b) >= 1 THEN {c} ELSE {dec(clip(f'yn + (s{c} - ys) + ((d{c} - v2) - (s{c} - ys)) * 0.5'))} END" for c in "rgb"),
        pre=f"m0 AS (SELECT *, {clip('b')} AS dr, {clip('r')} AS dg, {clip('g')} AS db, {', '.join(f'{enc(c)} AS s{c}' for c in 'rgb')} FROM f), m1 AS (SELECT *, {luma('dr', 'dg', 'db')} AS v2, {luma('sr', 'sg', 'sb')} AS ys FROM m0), m2 AS (SELECT *, greatest({', '.join(near)}) AS gr FROM m1), m3 AS (SELECT *, ys + (v2 - ys) * {d(0.7)} + (ys - v2) * {d(0.7 * 0.2)} * {smooth('gr', 0.01, 0.08)} AS yn FROM m2)",
        src="m3",
    )
    zone = f"({clip(f'{clip(f'log2(greatest({dec('greatest(base, 0)')}, 1e-9) / {d(0.18)})', -8, 6)}', -4, 4)} + 4)"
    ev = {2: 0.5, 5: -0.7}
    gain = " ".join(f"WHEN z <= {i + 1} THEN {d(ev.get(i, 0))} + {d(ev.get(i + 1, 0) - ev.get(i, 0))} * (z - {i})" for i in range(8))
    s["tone_eq"] = image(*(f"{c} * pow(2::DOUBLE, CASE {gain} ELSE 0 END)" for c in "rgb"), pre=f"e0 AS (SELECT *, {enc(LUMA)} AS dd FROM f), {selfguided('e1', 'e0', 'dd', 'base', 2)}, e2 AS (SELECT *, {zone} AS z FROM e1)", src="e2")
    kx, ky = "(w / least(w, h))", "(h / least(w, h))"
    px, py = f"((x + 0.5) / w * {kx})", f"((y + 0.5) / h * {ky})"
    along = clip(f"({px} - 0.1 * {kx}) / (0.8 * {kx})")
    s["brush_mask"] = field("1 - " + smooth("dd", 0.1, 0.2), pre=f"b0 AS (SELECT *, sqrt(pow({px} - (0.1 * {kx} + {along} * 0.8 * {kx}), 2) + pow({py} - 0.5 * {ky}, 2)) AS dd FROM f)", src="b0")
    (sx, sy), (ex, ey) = [(sat * math.cos(math.radians(h_)), sat * math.sin(math.radians(h_))) for h_, sat in ((30, 0.5), (60, 0.8))]
    wb = f"(1 - {smooth('away', 0, 1 / 3)})"
    cone = "(CASE WHEN k6 = 0 THEN {0} WHEN k6 = 1 THEN {1} WHEN k6 = 2 THEN {2} WHEN k6 = 3 THEN {3} WHEN k6 = 4 THEN {4} ELSE {5} END)"
    faces = {"r": ("1", "xx", "0", "0", "xx", "1"), "g": ("xx", "1", "1", "xx", "0", "0"), "b": ("0", "0", "xx", "1", "1", "xx")}
    s["color_bend"] = image(
        *(f"CASE WHEN yy <= 0 OR wt <= 0 THEN {c} ELSE m{c} * (yy / greatest({luma('mr', 'mg', 'mb')}, 1e-6)) END" for c in "rgb"),
        pre=f"{SAT}, t0 AS (SELECT *, {LUMA} AS yy, sat * cos(radians(hue)) AS px, sat * sin(radians(hue)) AS py FROM hs3), t1 AS (SELECT *, sqrt(pow(px - {d(sx)}, 2) + pow(py - {d(sy)}, 2)) AS away FROM t0), t2 AS (SELECT *, {wb} AS wt FROM t1), t3 AS (SELECT *, px + wt * {d(ex - sx)} AS nx, py + wt * {d(ey - sy)} AS ny FROM t2), t4 AS (SELECT *, {clip('sqrt(nx * nx + ny * ny)')} AS ns, CASE WHEN atan2(ny, nx) < 0 THEN degrees(atan2(ny, nx)) + 360 ELSE degrees(atan2(ny, nx)) END AS nh FROM t3), t5 AS (SELECT *, nh / 60 - 6 * floor(nh / 360) AS h6 FROM t4), t6 AS (SELECT *, floor(h6) AS k6, 1 - abs(h6 - 2 * floor(h6 / 2) - 1) AS xx FROM t5), t7 AS (SELECT *, {', '.join(f'1 + ns * ({cone.format(*faces[c])} - 1) AS m{c}' for c in 'rgb')} FROM t6)",
        src="t7",
    )


def noise(x, y):
    """Three octaves of noise from a hash of the lattice around a place, as nested expressions."""
    h0 = lambda i, j: f"(({i}) * 374761393 + ({j}) * 668265263)"
    h1 = lambda i, j: f"((xor({h0(i, j)}, {h0(i, j)} >> 13) & 4294967295) * 1274126177)"
    at = lambda i, j: f"((xor({h1(i, j)}, {h1(i, j)} >> 16) & 65535) / {d(65535)})"
    out = []
    for k in range(3):
        u, v = f"({x} * {d(2.1**k)})", f"({y} * {d(2.1**k)})"
        i, j = f"CAST(floor({u}) AS BIGINT)", f"CAST(floor({v}) AS BIGINT)"
        sx, sy = (f"(({w} - floor({w})) * ({w} - floor({w})) * (3 - 2 * ({w} - floor({w}))))" for w in (u, v))
        row = lambda jj, i=i, sx=sx: f"({at(i, jj)} + ({at(i + ' + 1', jj)} - {at(i, jj)}) * {sx})"
        out.append(f"({row(j)} + ({row(j + ' + 1')} - {row(j)}) * {sy}) * {d(0.5 ** (k + 1))}")
    return "(" + " + ".join(out) + f") / {d(0.875)}"


def measured(s: dict[str, str]) -> None:
    """Bands of detail, noise, histograms, shifts, fits and crops."""
    pre, at = f"b0 AS (SELECT *, {LUMA} AS l, {enc(LUMA)} AS dd, {SEEN} AS sn FROM f)", "b0"
    radii = {"fine": 1, "small": 2, "medium": 3, "large": 7}
    for k, r in radii.items():
        pre += f", {selfguided(k, at, 'dd', f'c_{k}', r)}"
        at = k
    bands = {"fine": "(dd - c_fine)", "medium": "(c_small - c_medium)", "large": "(c_medium - c_large)"}
    soft = lambda v: f"({v} / (1 + abs({v} / (CASE WHEN {v} > 0 THEN {d(0.16)} ELSE {d(0.6)} END))))"
    change = f"({d(2.5 * 0.4)} * {soft(bands['fine'])} + {d(-0.6)} * {bands['medium']} + {d(2.5 * 0.3)} * {soft(bands['large'])})"
    ratio = f"({dec('greatest(dd + ch, dd * 0.45::DOUBLE)')} / l)"
    weigh = lambda c: f"(({WS} + {WM} * 1.5::DOUBLE + {WH}) * {d(0.5 if c == 'b' else 1)})"
    s["detail_eq"] = image(*(f"CASE WHEN l <= 1e-6 OR ch = 0 THEN {c} WHEN {weigh(c)} = 1 THEN {c} * {ratio} ELSE {c} * greatest(1 + {weigh(c)} * ({ratio} - 1), {dec('dd * 0.45::DOUBLE')} / l) END" for c in "rgb"), pre=f"{pre}, b9 AS (SELECT *, {change} AS ch FROM {at})", src="b9")
    view = dec(clip("0.5::DOUBLE + 3 * (c1 - c2)"))
    s["detail_eq__band"] = image(view, view, view, pre=f"b0 AS (SELECT *, {enc(LUMA)} AS dd FROM f), {selfguided('b1', 'b0', 'dd', 'c1', 1)}, {selfguided('b2', 'b1', 'dd', 'c2', 2)}", src="b2")
    lvl = ((0.72 + 0.055) / 1.055) ** 2.4
    fc = [lvl * (1 - 0.1 + 0.1 * v) for v in hexcone(220)]
    wave = f"greatest(least(w, h) / {d(1.5 + 4)}, 1)"
    s["fog__texture"] = image(*(f"{c} + ({d(v)} - {c}) * ff" for c, v in zip("rgb", fc, strict=True)), pre=f"t0 AS (SELECT *, {clip('v')} AS xx, x / {wave} + {d(2 * 7.77)} AS u, y / {wave} + {d(2 * 3.33)} AS q FROM f), t1 AS (SELECT *, {noise('u', 'q')} AS n FROM t0), t2 AS (SELECT *, {clip(f'(1 - exp({d(-3 * 0.7)} * xx)) * (1 + {d(0.8 * 0.85)} * (n * 2 - 1))')} AS ff FROM t1)", src="t2")
    chroma = "least(sqrt(la * la + lb * lb), sqrt(sa * sa + sb * sb))"
    both = lambda ax: ", ".join(f"{window_mean(c, ax, 1)} AS {c}" for c in ("sa", "sb"))
    s["chroma_histogram"] = f"WITH f AS ({FRAME}), {OKLAB}, c0 AS (SELECT y, x, w, h, la, lb, la AS sa, lb AS sb FROM k), c1 AS (SELECT * REPLACE ({both('x')}) FROM c0), c2 AS (SELECT * REPLACE ({both('y')}) FROM c1), c3 AS (SELECT CAST(least(floor({chroma} / 0.5::DOUBLE * 500), 499) AS INTEGER) AS bin, w * h AS n FROM c2) SELECT bin, round(count(*) / max(n), 9) AS share FROM c3 GROUP BY bin"
    s["region_coverage"] = f"WITH f AS ({FRAME}), l AS (SELECT y, x, w, h, floor(v * 3.999::DOUBLE) AS k FROM f), t AS (SELECT k AS target FROM l WHERE x = floor(0.5 * w) AND y = floor(0.5 * h)) SELECT CAST(floor(y * 16 / h) AS INTEGER) AS gy, CAST(floor(x * 16 / w) AS INTEGER) AS gx, CAST(floor(sum(CASE WHEN k = target THEN 1 ELSE 0 END) * 255 / CAST(count(*) AS DOUBLE)) AS INTEGER) AS covered FROM l, t GROUP BY ALL"
    soft = lambda ax: window_mean("l", ax, 3)
    moves = "(VALUES (0, 0, 0), (1, 3, -2), (2, -5, 4)) t(frame_id, mx, my)"
    s["stack__shifts"] = f"""WITH f AS ({FRAME}), b0 AS (SELECT y, x, w, h, {LUMA} AS l FROM f), b1 AS (SELECT * REPLACE ({soft('x')} AS l) FROM b0), b2 AS (SELECT * REPLACE ({soft('y')} AS l) FROM b1),
    m AS (SELECT frame_id, y + my AS y, x + mx AS x, l FROM b2 CROSS JOIN {moves} WHERE x + mx BETWEEN 0 AND w - 1 AND y + my BETWEEN 0 AND h - 1),
    t AS (SELECT frame_id, y, x, l > median(l) OVER (PARTITION BY frame_id) AS bit FROM m),
    c AS (SELECT dx, dy FROM (SELECT unnest(range(-8, 9)) AS dx), (SELECT unnest(range(-8, 9)) AS dy)),
    e AS (SELECT a.frame_id, dx, dy, avg(CASE WHEN a.bit <> b.bit THEN 1 ELSE 0 END) AS e FROM t a CROSS JOIN c JOIN t b ON b.frame_id = 0 AND b.y = a.y - dy AND b.x = a.x - dx GROUP BY ALL)
    SELECT CAST(frame_id AS INTEGER) AS frame_id, CAST(arg_min(dx, e) AS INTEGER) AS dx, CAST(arg_min(dy, e) AS INTEGER) AS dy FROM e GROUP BY frame_id"""
    # every rectangle of rows top to foot without a hole: the widest gap between the holes' columns
    s["match__auto_crop"] = f"""WITH f AS ({FRAME}), sz AS (SELECT CAST(max(w) AS BIGINT) AS w, CAST(max(h) AS BIGINT) AS h FROM f), hole AS (SELECT y, x FROM f WHERE a < 1 AND r < 0.02::DOUBLE),
    ys AS (SELECT unnest(range(h)) AS y FROM sz), span AS (SELECT a.y AS top, b.y AS foot FROM ys a JOIN ys b ON a.y <= b.y),
    cut AS (SELECT top, foot, x FROM span JOIN hole ON hole.y BETWEEN top AND foot UNION SELECT top, foot, -1 FROM span UNION SELECT top, foot, w FROM span CROSS JOIN sz),
    gap AS (SELECT top, foot, x, lead(x) OVER (PARTITION BY top, foot ORDER BY x) AS after FROM cut),
    whole AS (SELECT top, foot, x + 1 AS x0, after AS x1, (foot - top + 1) * (after - x - 1) AS area FROM gap WHERE after > x + 1),
    best AS (SELECT * FROM whole WHERE area = (SELECT max(area) FROM whole)),
    inner_ AS (SELECT greatest((x1 - CASE WHEN x1 < w THEN 1 ELSE 0 END) - (x0 + CASE WHEN x0 > 0 THEN 1 ELSE 0 END), 0) / w::DOUBLE AS rw, greatest((foot + 1 - CASE WHEN foot + 1 < h THEN 1 ELSE 0 END) - (top + CASE WHEN top > 0 THEN 1 ELSE 0 END), 0) / h::DOUBLE AS rh, top, x0 FROM best CROSS JOIN sz)
    SELECT round(rw * rh, 9) AS area FROM inner_ WHERE rw > 0 AND rh > 0 ORDER BY top, x0 LIMIT 1"""
    good = ", ".join(f"{d(round(v, 6))} AS h{i}" for i, v in enumerate((1.02, -0.13, 40.0, 0.08, 0.97, -25.0, 0.00004, -0.00002)))
    s["match__fit"] = f"SELECT p_partkey // 300 AS a, p_partkey // 300 + 1 AS b, count(*) AS n, count(*) FILTER (p_partkey % 3 <> 0) AS inliers, {good} FROM part GROUP BY p_partkey // 300"
    s["match__strongest"] = "SELECT event_type AS frame_id, event_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 250) DESC, event_id) AS k FROM events) WHERE k <= 100"
    grade = f"{OKLAB}, c0 AS (SELECT *, sqrt(la * la + lb * lb) AS ch, atan2(lb, la) AS hh FROM k), c1 AS (SELECT *, greatest(ch * 1.4::DOUBLE, 0) AS cc FROM c0), {unlab('c1', 'll', 'cc * cos(hh)', 'cc * sin(hh)')}, v1 AS (SELECT *, {luma('nr', 'ng', 'nb')} AS yy, least(nr, ng, nb) AS mn FROM u3), v2 AS (SELECT y, x, a, r, g, b, {', '.join(f'(CASE WHEN mn >= 0 THEN n{c} WHEN yy <= 0 THEN 0 ELSE yy + (n{c} - yy) * (yy / (yy - mn)) END) * {d(2**0.4)} AS z{c}' for c in 'rgb')} FROM v1)"
    seen = lambda e: enc(f"greatest({e}, 0)")
    change = f"{grade}, i0 AS (SELECT *, {', '.join(f'{seen('z' + c)} - {seen(c)} AS d{c}' for c in 'rgb')}, {seen(luma('zr', 'zg', 'zb'))} AS yo, {seen(LUMA)} AS yi FROM v2), i1 AS (SELECT *, yo - yi AS dl FROM i0), i2 AS (SELECT *, least(abs(dl) / {{0}}, 1) AS tl0, least(sqrt(pow(dr - dl, 2) + pow(dg - dl, 2) + pow(db - dl, 2)) / {{0}}, 1) AS tc0 FROM i1)".replace("{0}", d(0.15))
    for mode, tl, tc in (("luma", "tl0", "0"), ("color", "0", "tc0"), ("both", "tl0", "tc0")):
        paints = zip((1.0, 0.55, 0.12), (0.2, 0.55, 1.0), (0.95, 0.25, 0.85), strict=True)
        s[f"view__influence_{mode}"] = image(*(dec(clip(f"yo * 0.35::DOUBLE * (1 - least({tl} + {tc}, 1)) + (CASE WHEN {tl} + {tc} > 0 THEN ((CASE WHEN dl >= 0 THEN {d(u)} ELSE {d(v)} END) * {tl} + {d(w_)} * {tc}) / ({tl} + {tc}) ELSE 0 END) * least({tl} + {tc}, 1)")) for u, v, w_ in paints), pre=change, src="i2")
    s["view__influence_isolate"] = image(*(dec(clip(f"0.5::DOUBLE + 2 * d{c}")) for c in "rgb"), pre=change, src="i2")
    edge = "(1 - " + smooth("((x + 0.5) / w - 0.5 + 0.5)", 0.7 - 0.1, 0.7 + 0.1) + ")"
    s["view__cut"] = f"WITH f AS ({FRAME}), t0 AS (SELECT *, a * {edge} AS aa FROM f), bx AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM t0 WHERE aa >= 0.5), q AS (SELECT CAST(y - y0 AS INTEGER) AS y, CAST(x - x0 AS INTEGER) AS x, r, g, b, aa AS a FROM t0, bx WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1) SELECT y, x, {', '.join(f'round({c} + {d(1e-9)}, 6) AS {c}' for c in 'rgba')} FROM q"
    whole = "CAST(CAST(floor({0} + 0.5) AS BIGINT) AS VARCHAR)"
    s["exif__texts"] = (
        "WITH t AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS n, CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 2 = 0 THEN p_size / 4::DOUBLE ELSE 1 / (p_size * 5::DOUBLE) END AS s FROM part) "
        f"SELECT p_partkey, CASE WHEN s <= 0 THEN '' WHEN s >= 1 AND abs(s - round(s)) < 0.05 THEN concat({whole.format('s')}, 's') WHEN s >= 1 THEN printf('%.1fs', round_even(s * 10, 0) / 10) ELSE concat('1/', {whole.format('(1 / s)')}) END AS shutter, "
        f"CASE WHEN floor(n / 8 * 10 + 0.5) % 10 = 0 THEN concat('f/', {whole.format('n / 8')}) ELSE printf('f/%.1f', floor(n / 8 * 10 + 0.5) / 10) END AS aperture, concat({whole.format('n * 3.7::DOUBLE')}, ' mm') AS focal, "
        "CASE WHEN n = 25 THEN '0 EV' ELSE printf('%+.1f EV', sign(n - 25) * floor(abs(n - 25) / 8 * 10 + 0.5) / 10) END AS bias FROM t"
    )


def grainy(s: dict[str, str]) -> None:
    """Fields of noise: a hash a pixel, blurred, brought to mean 0 and deviation 1."""

    def hashed(seed):
        h0 = f"((x + {7919 * seed}) * CAST(374761393 AS BIGINT) + y * CAST(668265263 AS BIGINT))"
        h1 = f"((xor({h0}, {h0} >> 13) & 4294967295) * 1274126177)"
        return f"((xor({h1}, {h1} >> 16) & 65535) / {d(65535)} - 0.5::DOUBLE)"

    def fields(seeds, sigma):
        names = [f"n{c}" for c in "rgb"]
        own = ", ".join(f"{hashed(k)} AS {n}" for n, k in zip(names, seeds, strict=True))
        level = ", ".join(f"({n} - avg({n}) OVER ()) / stddev_pop({n}) OVER () AS {n}" for n in names)
        return f"w0 AS (SELECT *, {own} FROM f), {blurred('w0', 'w1', names, sigma)}, w2 AS (SELECT * REPLACE ({level}) FROM w1)"

    s["noise"] = image(*(clip(f"0.5::DOUBLE + n{c} * 0.15::DOUBLE") for c in "rgb"), d(1), pre=fields((0, 1, 2), 0.4), src="w2")
    held = clip(LUMA)
    k = f"({d(0.4 * 0.1)} * (0.35::DOUBLE + 0.65::DOUBLE * 4 * {held} * (1 - {held})) * ({WS} * 1.5::DOUBLE + {WM} + {WH}))"
    s["grain"] = image(*(f"{c} + {k} * n{c}" for c in "rgb"), pre=f"{fields((1, 1, 1), 0.5)}, w3 AS (SELECT *, {SEEN} AS sn FROM w2)", src="w3")


#: Queries whose radii follow the frame's size, with SQL for frames of 100 rows and more.
BY_SIZE = ("tone_eq", "chroma_histogram", "color_console", "halation", "stack__shifts")


def lit(s: dict[str, str]) -> None:
    """Light and effects: halation, effects of a layer's coverage, means by likeness, bands of hue. Radii are those of frames of 100 rows and more."""
    import math

    cut = 0.18 * 2 ** (0.2 * 4)
    near = blurred("h0", "h1", ["dim"], 8.0)
    pre = f"h0 AS (SELECT *, {LUMA} AS yy, greatest({LUMA} - {d(cut)}, 0) AS ov, CASE WHEN {LUMA} < {d(cut)} THEN {LUMA} ELSE 0 END AS dim FROM f), {near}, h2 AS (SELECT *, ov / greatest(yy, 1e-6) * (1 - 0.5::DOUBLE * (1 - sqrt(1 - {clip(f'dim / {d(cut)}')}))) AS kk FROM h1), "
    pre += f"h3 AS (SELECT *, {', '.join(f'{c} * kk AS {q}{c}' for q in ('w_', 'n_', 'b_') for c in 'rgb')} FROM h2), {blurred('h3', 'h4', ['w_r', 'w_g', 'w_b'], 8.0)}, {blurred('h4', 'h5', ['n_r', 'n_g', 'n_b'], 3.6)}, {blurred('h5', 'h6', ['b_r', 'b_g', 'b_b'], 10.0)}, "
    halo = {c: f"(w_{c} * 0.6::DOUBLE + greatest(w_{c} - n_{c}, 0) * 0.4::DOUBLE)" for c in "rgb"}
    pre += f"h7 AS (SELECT *, {luma(halo['r'], halo['g'], halo['b'])} AS lh, {luma('b_r', 'b_g', 'b_b')} * 0.2::DOUBLE AS gl FROM h6)"
    tint = [1 + (v - 1) * 0.7 for v in hexcone(18)]
    s["halation"] = image(*(f"greatest({c} + lh * {d(v)} + gl, 0)" for c, v in zip("rgb", tint, strict=True)), pre=pre, src="h7")
    hh = 0.008 + 0.10 * 0.4 * 0.4
    offs = ", ".join(f"({i}, {j})" for i in range(-3, 4) for j in range(-3, 4))
    s["nlm_denoise"] = image(*(dec(f"s{c} / sw") for c in "rgb"), pre=f"o AS (SELECT * FROM (VALUES {offs}) t(dy, dx)), e AS (SELECT *, {', '.join(f'{enc(c)} AS e{c}' for c in 'rgb')} FROM f), j AS (SELECT e.y, e.x, e.a, n.er, n.eg, n.eb, exp(-(pow(n.er - e.er, 2) + pow(n.eg - e.eg, 2) + pow(n.eb - e.eb, 2)) / 3 / {d(hh * hh)}) AS k FROM e CROSS JOIN o JOIN e n ON n.x = least(greatest(e.x + dx, 0), e.w - 1) AND n.y = least(greatest(e.y + dy, 0), e.h - 1)), m AS (SELECT y, x, a, {', '.join(f'sum(k * e{c}) AS s{c}' for c in 'rgb')}, sum(k) AS sw FROM j GROUP BY y, x, a)", src="m")

    def room(pad):
        """The frame's coverage on a frame with room around it."""
        return f"sz AS (SELECT max(w) AS fw, max(h) AS fh FROM f), xs AS (SELECT unnest(range(CAST(fw AS BIGINT) + {2 * pad})) AS x FROM sz), ys AS (SELECT unnest(range(CAST(fh AS BIGINT) + {2 * pad})) AS y FROM sz), rm AS (SELECT ys.y, xs.x, fw + {2 * pad} AS w, fh + {2 * pad} AS h, coalesce({clip('f.a')}, 0) AS cv FROM xs CROSS JOIN ys CROSS JOIN sz LEFT JOIN f ON f.x = xs.x - {pad} AND f.y = ys.y - {pad})"

    def back(pad, gain):
        return f"sp AS (SELECT CAST(y - {pad} AS INTEGER) AS y, CAST(x - {pad} AS INTEGER) AS x, {clip(f'cv * {gain}')} AS sv FROM bl WHERE x >= {pad} AND y >= {pad} AND x < w - {pad} AND y < h - {pad})"

    pad, sh = 7, math.sqrt(2)
    at = lambda v, size: f"least(greatest({v} - {d(sh)}, 0), {size} - 1)"
    tap = lambda i, j: f"CASE WHEN ({'tx' if j else '1 - tx'}) * ({'ty' if i else '1 - ty'}) > 0 THEN p{i}{j}.cv * ({'tx' if j else '1 - tx'}) * ({'ty' if i else '1 - ty'}) ELSE 0 END"
    joins = " ".join(f"JOIN rm p{i}{j} ON p{i}{j}.y = least(m1.y0 + {i}, m1.h - 1) AND p{i}{j}.x = least(m1.x0 + {j}, m1.w - 1)" for i in (0, 1) for j in (0, 1))
    moved = f"m0 AS (SELECT y, x, w, h, {at('x', 'w')} AS gx, {at('y', 'h')} AS gy FROM rm), m1 AS (SELECT *, floor(gx) AS x0, floor(gy) AS y0, gx - floor(gx) AS tx, gy - floor(gy) AS ty FROM m0), mv AS (SELECT m1.y, m1.x, m1.w, m1.h, {' + '.join(tap(i, j) for i in (0, 1) for j in (0, 1))} AS cv FROM m1 {joins})"
    s["fx_shadow"] = image(*(f"({c} * a) / greatest(oa, 1e-6)" for c in "rgb"), "oa", pre=f"{room(pad)}, {moved}, {blurred('mv', 'bl', ['cv'], 1.5)}, {back(pad, 2)}, q0 AS (SELECT f.*, sv * 0.75::DOUBLE AS k FROM f JOIN sp USING (y, x)), q1 AS (SELECT *, a + k * (1 - a) AS oa FROM q0)", src="q1")
    inverted = "iv AS (SELECT * REPLACE (1 - cv AS cv) FROM rm)"
    s["fx_glow"] = image(*(f"{c} + ({v} - {c}) * {clip('sv * 0.75::DOUBLE * a')}" for c, v in zip("rgb", (1, 0, 0), strict=True)), pre=f"{room(5)}, {inverted}, {blurred('iv', 'bl', ['cv'], 1.5)}, {back(5, 2)}, q0 AS (SELECT f.*, sv FROM f JOIN sp USING (y, x))", src="q0")
    c, sn = math.cos(math.radians(135)), -math.sin(math.radians(135))
    side = lambda fn, part, ax: f"coalesce({fn}(sv) OVER (PARTITION BY {part} ORDER BY {ax}), sv)"
    slope = f"-(({side('lead', 'y', 'x')} - {side('lag', 'y', 'x')}) * {d(c)} + ({side('lead', 'x', 'y')} - {side('lag', 'x', 'y')}) * {d(sn)}) * 4"
    s["fx_bevel"] = image(*(f"CASE WHEN a <= 0 OR abs(li) < 1e-4 THEN {ch} ELSE {ch} + ((CASE WHEN li > 0 THEN 1 ELSE 0 END) - {ch}) * least(abs(li), 1) * 0.75::DOUBLE * a END" for ch in "rgb"), pre=f"{room(4)}, {blurred('rm', 'bl', ['cv'], 1.0)}, {back(4, 1)}, b1 AS (SELECT *, {slope} AS li FROM sp), q0 AS (SELECT f.*, li FROM f JOIN b1 USING (y, x))", src="q0")
    wide = lambda ax: ", ".join(f"{window_mean(q, ax, 1)} AS {q}" for q in ("sa", "sb"))
    hue = "(CASE WHEN atan2(sb, sa) < 0 THEN degrees(atan2(sb, sa)) + 360 ELSE degrees(atan2(sb, sa)) END)"
    gap = "least(abs(hi - 120), 360 - abs(hi - 120))"
    pre = f"{OKLAB}, n0 AS (SELECT *, la AS sa, lb AS sb FROM k), n1 AS (SELECT * REPLACE ({wide('x')}) FROM n0), n2 AS (SELECT * REPLACE ({wide('y')}) FROM n1), n3 AS (SELECT *, sqrt(sa * sa + sb * sb) AS ci, sqrt(la * la + lb * lb) AS cz, {hue} AS hi FROM n2), n4 AS (SELECT *, (1 - {smooth(gap, 40, 80)}) * {smooth('least(ci, cz)', 0.01, 0.05)} AS ee FROM n3), n5 AS (SELECT *, atan2(lb, la) + radians({clip('15 * ee', -90, 90)}) AS hx, least(cz * greatest(1 + 0.3::DOUBLE * ee, 0), 1.5) AS cx, {clip('0.3::DOUBLE * ee', -2, 2)} AS ev FROM n4), {unlab('n5', 'll', 'cx * cos(hx)', 'cx * sin(hx)')}"
    s["color_console"] = image(*(f"CASE WHEN ee = 0 THEN {ch} ELSE greatest(n{ch}, 0) * pow(2::DOUBLE, ev) END" for ch in "rgb"), pre=pre, src="u3")


def oracle_sql() -> dict[str, str]:
    from rasterloom.queries.raster import SCENE

    found = build()
    neighbourly(found)
    measured(found)
    lit(found)
    grainy(found)
    return found | {f"scene__{k}": found[k].replace(FRAME, SCENE_FRAME) for k in SCENE}
