"""Colour by colour: curves that say what changes (hue, saturation, light and more) for pixels picked by hue, saturation, light, depth, surroundings or a mask."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY
from rasterloom.frame import Rel
from rasterloom.functions import eq
from rasterloom.functions import tone as t
from rasterloom.functions.tone import num
from rasterloom.operators.geometry import resized
from rasterloom.operators.node import Param, node, number
from rasterloom.operators.spatial import COLOURS, box_columns

# A full chroma, how far warmth and tint move, and of pairs of colours the most turn, the most light and the most of them.
FULL, REACH = 0.3, 0.08
PAIR_TURN, PAIR_EV, MOST_PAIRS = 30.0, 0.5, 3
#: What can change, with the bounds of each; and by what pixels are picked.
CHANGES = {"hue": 60.0, "sat": 100.0, "lum": 2.0, "pastel": 100.0, "temp": 100.0, "tint": 100.0, "vib": 100.0}
ROWS = ("hue", "sat", "lum", "depth", "around", "mask")
CYCLIC = ("hue", "around")


def parsed(text: str) -> dict:
    try:
        found = json.loads(text) if text else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def gate(chroma: Column, guard: float) -> Column:
    """How much of a hue counts at a chroma: nothing for neutral colours."""
    low, high = 0.001 * guard, 0.005 * max(guard, 1.0)
    x = t.clamp((chroma - num(low)) / num(max(high - low, 1e-6)))
    return x * x * (num(3) - num(2) * x)


def within(v: Column, bound: float) -> Column:
    return F.least(F.greatest(v, num(-bound)), num(bound))


class Terms:
    """What is asked of a pixel, from its original colour, before any of it is done."""

    def __init__(self):
        self.sums = {k: num(0) for k in CHANGES if k != "sat"}
        self.scale = num(1)

    def add(self, change: str, v: Column) -> None:
        """v is within the change's bounds and weighted."""
        if change == "sat":
            self.scale = self.scale * (num(1) + v)
        else:
            self.sums[change] = self.sums[change] + v

    def fold(self, change: str, v: Column, weight: Column) -> None:
        held = within(v, CHANGES[change])
        self.add(change, (held if change in ("hue", "lum") else held / num(100)) * weight)


def surface(text: dict, change: str) -> list[list[float]] | None:
    """Five rows by twelve columns, or None if that isn't there or all zero."""
    rows = text.get(f"huelum_{change}")
    if not isinstance(rows, list) or len(rows) != 5 or any(not isinstance(r, list) or len(r) != 12 for r in rows):
        return None
    rows = [[float(v) if isinstance(v, int | float) else 0.0 for v in r] for r in rows]
    return rows if any(abs(v) > 1e-6 for r in rows for v in r) else None


def on_surface(rows: list[list[float]], hue: Column, ev: Column) -> Column:
    """Bilinear over hue, all around, and light from -6 to 3."""
    table = F.array(*[num(v) for r in rows for v in r])
    u, v = hue / num(30), F.least(F.greatest((ev + num(6)) / num(9) * num(4), num(0)), num(4))
    c0, r0 = F.floor(u) % 12, F.floor(v)
    c1, r1 = (c0 + 1) % 12, F.least(r0 + 1, F.lit(4))
    fu, fv = u - F.floor(u), v - r0
    at = lambda r, c: F.element_at(table, (r * 12 + c + 1).cast("int"))
    top, low = at(r0, c0) + (at(r0, c1) - at(r0, c0)) * fu, at(r1, c0) + (at(r1, c1) - at(r1, c0)) * fu
    return top + (low - top) * fv


def pairs_of(text: str) -> list[dict]:
    try:
        found = json.loads(text) if text else []
    except ValueError:
        found = []
    out = []
    for item in found[:MOST_PAIRS] if isinstance(found, list) else []:
        if not isinstance(item, dict) or not all(isinstance(item.get(k), dict) for k in "ab"):
            continue
        get = lambda o, k, d: float(o[k]) if isinstance(o.get(k), int | float) and math.isfinite(o[k]) else d
        pair = {f"{k}_hue": get(item[k], "h", 0.0) % 360 for k in "ab"} | {f"{k}_ev": get(item[k], "ev", 0.0) for k in "ab"}
        pair |= {"width": min(90.0, max(5.0, get(item, "width", 30.0)))} | {k: min(100.0, max(-100.0, get(item, k, 0.0))) / 100 for k in ("sep", "sat", "lum")}
        if pair["sep"] or pair["sat"] or pair["lum"]:
            out.append(pair)
    return out


def fold_pair(terms: Terms, pair: dict, hue: Column, weight: Column) -> None:
    """Two picked colours part or meet in hue, saturation and light, never past each other's opposite or each other."""
    apart = (pair["a_hue"] - pair["b_hue"] + 540) % 360 - 180
    turn = pair["sep"] * PAIR_TURN
    turn = max(turn, -abs(apart) / 2) if turn < 0 else min(turn, (180 - abs(apart)) / 2)
    turn = turn if apart >= 0 else -turn
    lift = pair["lum"] * PAIR_EV
    lift = max(lift, -abs(pair["a_ev"] - pair["b_ev"]) / 2) if lift < 0 else lift
    lift = lift if pair["a_ev"] >= pair["b_ev"] else -lift

    def belongs(centre: float) -> Column:
        d = t.hue_gap(hue, centre)
        return F.when(d >= pair["width"], num(0)).otherwise(num(0.5) * (num(1) + F.cos(num(math.pi / pair["width"]) * d))) * weight

    a, b = belongs(pair["a_hue"]), belongs(pair["b_hue"])
    terms.add("hue", num(turn) * a - num(turn) * b)
    terms.add("lum", num(lift) * a - num(lift) * b)
    terms.scale = terms.scale * (num(1) + num(0.5 * pair["sat"]) * a) * (num(1) - num(0.5 * pair["sat"]) * b)


def spread_table(points: list[eq.Point]) -> list[float]:
    """Offsets by degree of a curve read as how far hues are pulled apart: its mean taken away, summed up."""
    s = [min(100.0, max(-100.0, eq.value_at(points, float(d)))) for d in range(360)]
    out = [0.0]
    for v in s:
        out.append(out[-1] + (v - sum(s) / 360) / 100)
    return out


@node(
    "recolor", masked=True, takes=("by", "ref", "depth"), curves=Param(""), neutral_guard=number(10), smoothing=number(50), around_radius=number(15, 2, 50), by_mask=Param(""), hue_hue_mode=Param(""), surfaces=Param(""), pairs=Param(""), eq_interp=Param("")
)
def recolor(inputs, p):
    """Every curve reads the original pixel; what they ask for is then done once: hue turned and chroma scaled at constant light, vibrance, warmth and tint, a mix toward white, and light as a gain."""
    rel, given = inputs["in"], parsed(p["curves"])
    cells = {(row, change): eq.read(given.get(f"{row}_{change}") or []) for row in ROWS for change in CHANGES}
    cells = {k: v for k, v in cells.items() if len(v) > 1}
    rows = {row for (row, _), v in cells.items() if eq.active(v)}
    rows -= {"depth"} if "depth" not in inputs else set()
    rows -= {"mask"} if "by" not in inputs or inputs["by"].kind != FIELD else set()
    grids = {c: s for c in CHANGES if (s := surface(parsed(p["surfaces"]), c))}
    pairs = pairs_of(p["pairs"])
    if not rows and not grids and not pairs:
        return rel

    guard, short = min(100.0, p["neutral_guard"]), min(rel.width, rel.height)
    lab = lambda *rgb: t.to_oklab(*[F.greatest(c, num(0)) for c in rgb])
    df = rel.df.withColumns(dict(zip(("_l", "_ua", "_ub"), lab(*map(F.col, COLOURS)), strict=True)))
    ref = inputs.get("ref")
    if ref is not None and ref.kind == IMAGE and ref.same_size(rel):
        other = ref.df.select(*KEY, *[F.col(c).alias(f"_r{c}") for c in COLOURS])
        df = df.hint("merge").join(other, KEY, "left")
        _, a, b = lab(*[F.coalesce(f"_r{c}", num(0)) for c in COLOURS])
        df = df.withColumn("_pa", a).withColumn("_pb", b)
    else:
        df = df.withColumn("_pa", F.col("_ua")).withColumn("_pb", F.col("_ub"))
    df = df.withColumn("_la", F.col("_pa")).withColumn("_lb", F.col("_pb"))
    radius = int(short * 0.02 * min(1.0, p["smoothing"] / 100))
    if radius:
        df = box_columns(df, ["_la", "_lb"], radius, rel.width, rel.height, True)
    if "around" in rows:
        df = df.withColumn("_aa", F.col("_ua")).withColumn("_ab", F.col("_ub"))
        df = box_columns(df, ["_aa", "_ab"], max(1, int(short * min(50.0, max(2.0, p["around_radius"])) / 100)), rel.width, rel.height, True)
    for row, port in (("depth", "depth"), ("mask", "by")):
        if row in rows:
            plane = inputs[port] if inputs[port].same_size(rel) else resized(inputs[port], rel.width, rel.height)
            df = df.hint("merge").join(plane.df.select(*KEY, F.col("v").alias(f"_x_{row}")), KEY, "left")
            df = df.withColumn(f"_x_{row}", t.clamp(F.coalesce(f"_x_{row}", num(0)) * num(100), 0, 100))

    def hue_of(a: str, b: str) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when(h < 0, h + num(360)).otherwise(h)

    chroma = F.hypot("_la", "_lb")
    light = t.luma(*map(F.col, COLOURS))
    df = df.withColumns({
        "_x_hue": hue_of("_la", "_lb"), "_x_sat": t.clamp(chroma / num(FULL) * num(100), 0, 100), "_x_lum": t.clamp(F.log2(F.greatest(light, num(1e-7)) / num(0.18)), -8, 6),
        "_g_hue": gate(F.least(chroma, F.hypot("_pa", "_pb")), guard),
    })
    if "around" in rows:
        df = df.withColumn("_x_around", hue_of("_aa", "_ab")).withColumn("_g_around", gate(F.hypot("_aa", "_ab"), guard))

    terms = Terms()
    spread = p["hue_hue_mode"] == "spread" and eq.active(cells.get(("hue", "hue"), []))
    for (row, change), points in cells.items():
        if row not in rows:
            continue
        curve = eq.bent(eq.around(points, 360.0) if row in CYCLIC else points, p["eq_interp"])
        weight = F.col(f"_g_{row}") if row in CYCLIC else num(1)
        x = F.col(f"_x_{row}")
        if spread and (row, change) == ("hue", "hue"):
            table, i = F.array(*map(num, spread_table(curve))), F.least(F.floor(x).cast("int"), F.lit(359))
            at, after = F.element_at(table, i + 1), F.element_at(table, i + 2)
            terms.fold("hue", at + (after - at) * (x - F.floor(x)), weight)
        else:
            terms.fold(change, eq.value(curve, x), weight)
    for change, rows_ in grids.items():
        terms.fold(change, on_surface(rows_, F.col("_x_hue"), F.col("_x_lum")), F.col("_g_hue"))
    for pair in pairs:
        fold_pair(terms, pair, F.col("_x_hue"), F.col("_g_hue"))

    df = df.withColumns({"_dh": terms.sums["hue"], "_k": F.greatest(terms.scale, num(0)), "_ev": within(terms.sums["lum"], 2)} | {f"_{c}": within(terms.sums[c], 1) for c in ("pastel", "temp", "tint", "vib")})
    df = df.withColumn("_gain", F.pow(num(2), F.col("_ev"))).withColumn("_h", F.atan2("_ub", "_ua") + F.radians("_dh")).withColumn("_c", F.hypot("_ua", "_ub") * F.col("_k"))
    muted = num(1) - t.clamp(F.col("_c") / num(FULL))
    df = df.withColumn("_c", F.col("_c") * F.greatest(num(1) + F.col("_vib") * muted, num(0)))
    white = F.greatest(F.col("_l"), num(1) / F.cbrt("_gain"))
    rest = num(1) - F.col("_pastel")
    new = (F.col("_l") + F.col("_pastel") * (white - F.col("_l")), (F.col("_c") * F.cos("_h") + F.col("_tint") * num(REACH)) * rest, (F.col("_c") * F.sin("_h") + F.col("_temp") * num(REACH)) * rest)
    df = df.withColumns(dict(zip(("_n0", "_n1", "_n2"), new, strict=True)))
    out = t.from_oklab((F.col("_n0"), F.col("_n1"), F.col("_n2")))
    return Rel(df, rel.kind, rel.width, rel.height).image(*[F.greatest(c, num(0)) * F.col("_gain") for c in out])
