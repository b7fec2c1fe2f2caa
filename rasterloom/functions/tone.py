"""Scalar functions of tone and colour, as column expressions over doubles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

# Published weights and matrices, and the constants of the tone controls.
LUMA = (0.2126, 0.7152, 0.0722)
OKLAB_LMS = ((0.41222147, 0.53633254, 0.05144599), (0.2119035, 0.68069955, 0.10739696), (0.08830246, 0.28171884, 0.6299787))
OKLAB_LAB = ((0.21045426, 0.79361779, -0.004072047), (1.9779985, -2.4285922, 0.4505937), (0.025904037, 0.78277177, -0.80867577))
LAB_LMS = ((1.0, 0.39633778, 0.21580376), (1.0, -0.105561346, -0.06385417), (1.0, -0.08948418, -1.2914855))
LMS_RGB = ((4.0767417, -3.3077116, 0.23096994), (-1.268438, 2.6097574, -0.34131938), (-0.0041960863, -0.7034186, 1.7076147))
PIVOT = 0.46135613
CONTRAST_GAMMA = 0.85
WHEEL_PUSH = 0.15


def num(value: float) -> Column:
    return F.lit(float(value))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, num(low)), num(high))


def luma(r: Column, g: Column, b: Column) -> Column:
    return num(LUMA[0]) * r + num(LUMA[1]) * g + num(LUMA[2]) * b


def encode(v: Column) -> Column:
    """Linear to sRGB."""
    return F.when(v <= 0.0031308, v * num(12.92)).otherwise(num(1.055) * F.pow(v, num(1 / 2.4)) - num(0.055))


def decode(v: Column) -> Column:
    """sRGB to linear."""
    return F.when(v <= 0.04045, v / num(12.92)).otherwise(F.pow((v + num(0.055)) / num(1.055), num(2.4)))


def encode_display(v: Column) -> Column:
    """Linear to sRGB as a display has it, 0 to 1."""
    return encode(clamp(v))


def decode_display(v: Column) -> Column:
    """sRGB as a display has it, 0 to 1, to linear."""
    return decode(clamp(v))


def ramp(v: Column, low: float, high: float) -> Column:
    """Smoothstep; a hard step where low is not below high."""
    if low >= high:
        return F.when(v < low, num(0)).otherwise(num(1))
    t = clamp((v - num(low)) / num(high - low))
    return t * t * (num(3) - num(2) * t)


def quintic(v: Column, low: float, high: float) -> Column:
    if high <= low:
        return F.when(v < low, num(0)).otherwise(num(1))
    t = clamp((v - num(low)) / num(high - low))
    return t * t * t * (t * (t * num(6) - num(15)) + num(10))


def contrast(d: Column, gamma: float) -> Column:
    """Power curves on both sides of middle gray; values over 1 stay."""
    low = num(PIVOT) * F.pow(F.greatest(d / num(PIVOT), num(0)), num(gamma))
    high = num(1) - num(1 - PIVOT) * F.pow(F.greatest(num(1) - d, num(0)) / num(1 - PIVOT), num(gamma))
    return F.when(d >= 1.0, d).when(d <= PIVOT, low).otherwise(high)


def contrast_gamma(amount: float) -> float:
    return 2.0 ** (max(-1.0, min(1.0, amount / 100)) * CONTRAST_GAMMA)


def balance_gains(temperature: float, tint: float) -> tuple[float, float, float]:
    dt = max(-0.9, min(3.0, (temperature - 6500) / 6500))
    return 1 + 0.4 * dt, max(1 - 0.45 * tint / 150, 0.05), max(1 - 0.4 * dt, 0.05)


def matrix(m: Sequence[Sequence[float]], v: Triple) -> Triple:
    return tuple(num(row[0]) * v[0] + num(row[1]) * v[1] + num(row[2]) * v[2] for row in m)  # type: ignore[return-value]


def to_oklab(r: Column, g: Column, b: Column) -> Triple:
    return matrix(OKLAB_LAB, tuple(F.cbrt(c) for c in matrix(OKLAB_LMS, (r, g, b))))  # type: ignore[arg-type]


def from_oklab(lab: Triple) -> Triple:
    return matrix(LMS_RGB, tuple(c * c * c for c in matrix(LAB_LMS, lab)))  # type: ignore[arg-type]


def chroma_hue(lab: Triple) -> tuple[Column, Column]:
    """OkLab chroma and hue in degrees, 0 to 360."""
    h = F.degrees(F.atan2(lab[2], lab[1]))
    return F.sqrt(lab[1] * lab[1] + lab[2] * lab[2]), F.when(h < 0, h + num(360)).otherwise(h)


def hue_gap(h: Column, centre: float) -> Column:
    """Distance of two hues in degrees, up to 180."""
    d = F.abs(h - num(centre % 360))
    return F.least(d, num(360) - d)


def hue_sat(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """HSV hue in degrees and saturation."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    flat = (d < 1e-6) | (high < 1e-6)
    safe = F.when(flat, num(1)).otherwise(d)
    h = F.when(high == r, num(60) * ((g - b) / safe)).when(high == g, num(60) * ((b - r) / safe + num(2))).otherwise(num(60) * ((r - g) / safe + num(4)))
    h = F.when(h < 0, h + num(360)).otherwise(h)
    return F.when(flat, num(0)).otherwise(h), F.when(flat, num(0)).otherwise(d / F.when(flat, num(1)).otherwise(high))


def hexcone(h: Column) -> Triple:
    """Full-strength colour of a hue in degrees."""
    s = h / num(60)
    s = s - num(6) * F.floor(s / num(6))
    x = num(1) - F.abs(s - num(2) * F.floor(s / num(2)) - num(1))
    k = F.floor(s)
    one, zero = num(1), num(0)
    r = F.when((k == 0) | (k == 5), one).when((k == 1) | (k == 4), x).otherwise(zero)
    g = F.when((k == 1) | (k == 2), one).when((k == 0) | (k == 3), x).otherwise(zero)
    b = F.when((k == 3) | (k == 4), one).when((k == 2) | (k == 5), x).otherwise(zero)
    return r, g, b


def hexcone_of(hue: float) -> tuple[float, float, float]:
    s = (hue % 360) / 60
    x = 1 - abs(s % 2 - 1)
    return [(1, x, 0), (x, 1, 0), (0, 1, x), (0, x, 1), (x, 0, 1), (1, 0, x)][min(5, int(s))]


def wheel(hue: float, sat: float) -> tuple[float, float, float]:
    """What a colour wheel adds: the hue without its luma, by strength."""
    rgb = hexcone_of(hue)
    y = sum(w * c for w, c in zip(LUMA, rgb, strict=True))
    return tuple((c - y) * sat / 100 * WHEEL_PUSH for c in rgb)  # type: ignore[return-value]


def seen(y: Column, ev: float = 0.0) -> Column:
    """Tone as it is seen: display-encoded, 0 to 1."""
    return clamp(encode(F.greatest(y, num(0)) * num(2.0**ev)))


def tonal(d: Column) -> Triple:
    """Weights of shadows, midtones and highlights."""
    s, h = num(1) - ramp(d, 0, 0.5), ramp(d, 0.5, 1)
    return s, clamp(num(1) - s - h), h


def inside_gamut(rgb: Triple) -> Triple:
    """Negative channels brought to zero at constant luma."""
    y, low = luma(*rgb), F.least(*rgb)
    k = y / F.when(y - low == 0, num(1)).otherwise(y - low)
    return tuple(F.when(low >= 0, c).when(y <= 0, num(0)).otherwise(y + (c - y) * k) for c in rgb)  # type: ignore[return-value]


#: The multipliers of the lattice hash.
LATTICE = (374761393, 668265263, 1274126177)


def lattice_hash(ix: Column, iy: Column) -> Column:
    """A number from 0 to 1 for each point of a lattice: of a product of 64 bits only the lower 32 are needed, so none overflows."""
    h = ix.cast("long") * F.lit(LATTICE[0]).cast("long") + iy.cast("long") * F.lit(LATTICE[1]).cast("long")
    low = F.lit(0xFFFFFFFF).cast("long")
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 13)).bitwiseAND(low) * F.lit(LATTICE[2]).cast("long")
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16)).bitwiseAND(F.lit(0xFFFF).cast("long")) / num(65535)


def value_noise(x: Column, y: Column) -> Column:
    """Hashes of the four points of the lattice around a place, smoothly between them."""
    ix, iy = F.floor(x), F.floor(y)
    fx, fy = x - ix, y - iy
    sx, sy = fx * fx * (num(3) - num(2) * fx), fy * fy * (num(3) - num(2) * fy)
    row = lambda j: lattice_hash(ix, j) + (lattice_hash(ix + 1, j) - lattice_hash(ix, j)) * sx
    return row(iy) + (row(iy + 1) - row(iy)) * sy


def fractal_noise(x: Column, y: Column) -> Column:
    """Three octaves of value noise, from 0 to 1."""
    return sum((value_noise(x * num(2.1**k), y * num(2.1**k)) * num(0.5 ** (k + 1)) for k in range(3)), num(0)) / num(0.875)


def soft_low(n: Column, k: float) -> Column:
    """A quadratic knee of half-width k at zero."""
    if k <= 0:
        return n
    return F.when(n >= k, n).when(n <= -k, num(0)).otherwise((n + num(k)) * (n + num(k)) / num(4 * k))


def hex_display(text: str) -> tuple[float, float, float]:
    """A #rrggbb colour as display values."""
    digits = text.strip().lstrip("#")
    if len(digits) != 6:
        raise ValueError(f"bad hex colour {text!r}")
    return tuple(int(digits[i : i + 2], 16) / 255 for i in (0, 2, 4))  # type: ignore[return-value]


def hex_linear(text: str) -> tuple[float, float, float]:
    """A #rrggbb colour in linear light."""
    v = hex_display(text)
    return tuple(c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in v)  # type: ignore[return-value]


def tanh(c: Column) -> Column:
    return F.tanh(c)


def radians(degrees: float) -> float:
    return math.radians(degrees)
