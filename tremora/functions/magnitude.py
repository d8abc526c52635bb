"""Magnitude homogenisation to Mw as Column builders.

A conversion scheme is an ordered list of rules (type prefixes, formula, method name). The rules of a
scheme are tried first and the default scheme's rules after them, so a scheme only lists what it changes.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    prefixes: tuple[str, ...]
    formula: Callable[[Column], Column]
    method: str


def _line(slope: float, offset: float) -> Callable[[Column], Column]:
    return lambda x: F.lit(slope) * x + F.lit(offset)


def _exponential(offset: float, slope: float, shift: float) -> Callable[[Column], Column]:
    return lambda x: F.exp(F.lit(offset) + F.lit(slope) * x) + F.lit(shift)


def surface_wave_mw(ms: Column) -> Column:
    return F.when(ms <= 6.1, _line(0.67, 2.07)(ms)).otherwise(_line(0.99, 0.08)(ms))


def _body_wave_via_surface(mb: Column) -> Column:
    return surface_wave_mw(F.when(mb < 5.9, _line(1.644, -3.753)(mb)).otherwise(_line(2.763, -10.301)(mb)))


def _unchanged(x: Column) -> Column:
    return x


# Published conversion relations and the method names reported with them.
DEFAULT_RULES = (
    Rule(("ms",), surface_wave_mw, "scordilis_ms"),
    Rule(("mb",), _line(0.85, 1.03), "scordilis_mb"),
    Rule(("ml",), _unchanged, "assume_ml"),
    Rule(("md", "mc"), _unchanged, "assume_md"),
)
SCHEMES: dict[str, tuple[Rule, ...]] = {
    "scordilis": (),
    "digiacomo": (
        Rule(("ms",), _exponential(-0.222, 0.233, 2.863), "digiacomo_ms"),
        Rule(("mb",), _exponential(-4.664, 0.859, 4.555), "digiacomo_mb"),
    ),
    "peru": (
        Rule(("mb",), _line(0.9588, 0.458), "peru_cahuari_mb"),
        Rule(("ms",), _line(0.7044, 1.702), "peru_cahuari_ms"),
        Rule(("ml", "md", "mc"), _line(0.9879, 0.3316), "peru_cahuari_mld"),
    ),
    "igp_national": (Rule(("mb",), _body_wave_via_surface, "igp_mb_ms_mw"),),
}
METHOD_MARKS = (("ms", 80), ("mb", 70), ("ml", 40), ("md", 30))


def clean_type(kind: Column) -> Column:
    return F.lower(F.trim(F.coalesce(kind, F.lit(""))))


def _starts_with_any(kind: Column, prefixes: tuple[str, ...]) -> Column:
    test = kind.startswith(prefixes[0])
    for prefix in prefixes[1:]:
        test = test | kind.startswith(prefix)
    return test


def to_mw(magnitude: Column, kind: Column, scheme: str = "scordilis") -> Column:
    """struct(mw, method); moment magnitudes pass through, unknown schemes use the default."""
    k = clean_type(kind)
    rules = SCHEMES.get(scheme, ()) + DEFAULT_RULES

    def chain(value: Callable[[Rule], Column], direct: Column, missing: Column, rest: Column) -> Column:
        expression = F.when(magnitude.isNull(), missing).when(k.startswith("mw"), direct)
        for rule in rules:
            expression = expression.when(_starts_with_any(k, rule.prefixes), value(rule))
        return expression.otherwise(rest)

    return F.struct(
        chain(lambda r: r.formula(magnitude), magnitude, F.lit(None).cast("double"), magnitude).alias("mw"),
        chain(lambda r: F.lit(r.method), F.lit("direct"), F.lit("none"), F.lit("assume_unknown")).alias("method"),
    )


def method_rank(method: Column) -> Column:
    m = F.coalesce(method, F.lit(""))
    expression = F.when(m == "direct", 100)
    for mark, rank in METHOD_MARKS:
        expression = expression.when(m.contains(mark), rank)
    return expression.when(m.startswith("assume"), 10).otherwise(0)


def source_rank(source: Column, priority: tuple[str, ...]) -> Column:
    """Position in the priority list; sources outside it share the last rank."""
    place = F.array_position(F.array(*[F.lit(p) for p in priority]), F.lower(F.coalesce(source, F.lit(""))))
    return F.when(place > 0, place - 1).otherwise(len(priority)).cast("int")
