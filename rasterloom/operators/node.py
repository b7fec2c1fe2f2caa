"""What every node has: declared parameters, ports, and the rules for disabled nodes and masks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from rasterloom.frame import FIELD, IMAGE, KEY, Rel
from rasterloom.functions.tone import clamp


class EngineError(ValueError):
    """A node can't run: a port is missing, sizes disagree, or a parameter is no choice."""


@dataclass(frozen=True)
class Param:
    default: float | bool | str
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()
    strict: bool = False

    def read(self, value, name: str, owner: str):
        """The value in force. Numbers that may not be negative are held at zero or above; other bounds are for controls only."""
        if isinstance(self.default, bool):
            return bool(value)
        if isinstance(self.default, str):
            if not self.choices:
                return str(value)
            said = str(value).strip().lower()
            if said in self.choices:
                return said
            if self.strict:
                raise EngineError(f"{owner}: {name} can't be {value!r}")
            return self.default
        number = float(value)
        if number != number or number in (float("inf"), float("-inf")):
            raise EngineError(f"{owner}: {name} must be finite")
        return max(0.0, number) if self.low is not None and self.low >= 0 else number


def choice(default: str, *others: str, strict: bool = False) -> Param:
    return Param(default, choices=(default, *others), strict=strict)


def number(default: float, low: float = 0.0, high: float = 100.0) -> Param:
    return Param(float(default), low, high)


@dataclass(frozen=True)
class Spec:
    name: str
    function: Callable[[dict[str, Rel], dict], Rel]
    params: dict[str, Param] = field(default_factory=dict)
    needs: tuple[str, ...] = ("in",)
    takes: tuple[str, ...] = ()
    gives: str = IMAGE
    masked: bool = False


REGISTRY: dict[str, Spec] = {}


def node(name: str, /, needs=("in",), takes=(), gives=IMAGE, masked=False, params: dict[str, Param] | None = None, **declared: Param):
    def register(function):
        REGISTRY[name] = Spec(name, function, {**(params or {}), **declared}, tuple(needs), tuple(takes) + (("mask",) if masked else ()), gives, masked)
        return function

    return register


def blend_by_mask(original: Rel, result: Rel, mask: Rel, weight: float = 1.0) -> Rel:
    """original + (result - original) * mask on all channels."""
    both = original.joined(result, "n_", "inner")
    both = both.hint("merge").join(mask.df.select(*KEY, F.col("v" if mask.kind == FIELD else "r").alias("m")), KEY, "left")
    m = clamp(F.coalesce(F.nanvl("m", F.lit(0.0)), F.lit(0.0))) * F.lit(float(weight))
    cols = {c: F.col(c) + (F.col(f"n_{c}") - F.col(c)) * m for c in original.channels}
    return Rel(both, original.kind, original.width, original.height).image(*cols.values())


def run(name: str, inputs: dict[str, Rel], params: dict | None = None, enabled: bool = True, mask_weight: float = 1.0, mask_off: bool = False) -> Rel:
    """Run one node. A disabled one hands through its first picture, or else its first field as grey."""
    spec = REGISTRY.get(name)
    if spec is None:
        raise EngineError(f"no node {name!r}")
    given = params or {}
    if unknown := set(given) - set(spec.params):
        raise EngineError(f"{name} has no parameter {sorted(unknown)[0]!r}")
    values = {k: p.read(given.get(k, p.default), k, name) for k, p in spec.params.items()}
    if not enabled:
        ordered = [inputs[p] for p in (*spec.needs, *spec.takes) if p in inputs]
        for kind in (IMAGE, FIELD):
            for rel in ordered:
                if rel.kind == kind:
                    grey = kind == FIELD and spec.gives == IMAGE
                    return rel.image(F.col("v"), F.col("v"), F.col("v"), F.lit(1.0)) if grey else rel
        raise EngineError(f"{name}: nothing to hand through")
    for port in spec.needs:
        if port not in inputs:
            raise EngineError(f"{name}: {port} isn't connected")
    result = spec.function(inputs, values)
    if not spec.masked or "mask" not in inputs or mask_off:
        return result
    original, mask = inputs["in"], inputs["mask"]
    if not mask.same_size(original):
        return original
    return blend_by_mask(original, result, mask, mask_weight) if result.same_size(original) else result
