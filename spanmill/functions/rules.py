"""Rules given as data, compiled to column expressions: no rule is interpreted per row.

A condition is ``{"all": [...]}``, ``{"any": [...]}``, ``{"not": {...}}`` or a
test ``{"path": "a.b", "op": ..., "value": ...}``. A missing or null field fails
every test. Unknown operators raise an error when a rule is compiled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(path: str) -> Column:
    """A field as a number; what is none counts as 0."""
    return F.coalesce(F.col(path).try_cast("double"), F.lit(0.0))


TESTS = {
    "eq": lambda p, v: F.col(p) == v,
    "neq": lambda p, v: F.col(p) != v,
    "in": lambda p, v: F.col(p).isin(*v),
    "not_in": lambda p, v: ~F.col(p).isin(*v),
    "gt": lambda p, v: F.col(p).isNotNull() & (number(p) > v),
    "gte": lambda p, v: F.col(p).isNotNull() & (number(p) >= v),
    "lt": lambda p, v: F.col(p).isNotNull() & (number(p) < v),
    "lte": lambda p, v: F.col(p).isNotNull() & (number(p) <= v),
    "truthy": lambda p, v: F.col(p).isNotNull() & ~F.col(p).cast("string").isin("", "0", "0.0", "false"),
    "falsy": lambda p, v: F.col(p).isNotNull() & F.col(p).cast("string").isin("", "0", "0.0", "false"),
}


def condition(rule: dict) -> Column:
    """The boolean column of a condition; never null."""
    if "all" in rule:
        return reduce(lambda a, b: a & b, map(condition, rule["all"]), F.lit(True))
    if "any" in rule:
        return reduce(lambda a, b: a | b, map(condition, rule["any"]), F.lit(False))
    if "not" in rule:
        return ~condition(rule["not"])
    if rule["op"] not in TESTS:
        raise ValueError(f"unknown operator {rule['op']}")
    return F.coalesce(TESTS[rule["op"]](rule["path"], rule.get("value")), F.lit(False))


def value(spec) -> Column:
    """The column of a value: a literal, ``{"path", "cast"}``, ``{"len"}``, ``{"template", "paths"}``, ``{"base", "cap", "scale", "path"}`` or ``{"cases": [{"when", "then"}], "default"}``."""
    if not isinstance(spec, dict):
        return F.lit(spec)
    if "cases" in spec:
        out = value(spec.get("default"))
        for case in reversed(spec["cases"]):
            out = F.when(condition(case["when"]), value(case["then"])).otherwise(out)
        return out
    if "template" in spec:
        return F.format_string(spec["template"], *[F.col(p) for p in spec["paths"]])
    if "base" in spec:
        return F.lit(spec["base"]) + F.least(F.lit(spec["cap"]), spec["scale"] * number(spec["path"]))
    if "len" in spec:
        return F.length(F.col(spec["len"]))
    return F.col(spec["path"]).try_cast(spec["cast"]) if "cast" in spec else F.col(spec["path"])


def first_match(rules: list[tuple[str, dict]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    return F.coalesce(*[F.when(condition(r), F.lit(name)) for name, r in rules], F.lit(default))


def all_matches(rules: list[tuple[str, dict]]) -> Column:
    """The names of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(condition(r), F.lit(name)) for name, r in rules]))


def stepped(x: Column, cuts: list[float], names: list[str], closed: bool = True) -> Column:
    """The name of the first cut that is not exceeded (or, if not closed, not reached); the last name above all cuts."""
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        out = F.when(x <= cut if closed else x < cut, F.lit(name)).otherwise(out)
    return F.when(x.isNotNull(), out)
