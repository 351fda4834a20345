"""Strict records: a JSON value held against a schema at any depth, with the place of its first fault.

A fault is the text `place|problem`, with the place below the value; callers put their own place in front by `concat`,
which stays NULL where there is no fault. So the expression keeps a few nodes per field and plans stay small.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType, VariantType


@dataclass(frozen=True)
class Rules:
    """What a schema does not say. Places are dotted names; `[]` stands for the members of a list."""

    nullable: frozenset[str] = frozenset()
    required: frozenset[str] = frozenset()
    filled: frozenset[str] = frozenset()  # not the empty string
    choices: dict[str, tuple[str, ...]] = field(default_factory=dict)
    shapes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # of values of any type: allowed type names
    only_true: frozenset[str] = frozenset()


def bind(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with the value computed once: what a lambda's argument holds is not computed again."""
    return F.get(F.transform(F.array(value), function), F.lit(0))


def split_fault(text: Column) -> Column:
    """struct(problem, at) of a fault; NULL where there is none. The last bar parts them: names may hold others."""
    return F.when(text.isNotNull(), F.struct(
        F.substring_index(text, "|", -1).alias("problem"),
        F.nullif(F.regexp_extract(text, r"(?s)^(.*)\|[^|]*$", 1), F.lit("")).alias("at")))


def fault(value: Column, kind: StructType, rules: Rules, place: str = "") -> Column:
    """The first fault of an object (VARIANT), else NULL. Objects and lists are walked to their ends.

    Problems: "wrong type" (null included, where it is not allowed), "unknown field", "missing", "unknown value".
    """
    unknown = F.get(F.array_except(F.json_object_keys(F.to_json(value)), F.lit([f.name for f in kind.fields])), F.lit(0))
    checks = [F.concat(unknown, F.lit("|unknown field"))]
    for f in kind.fields:
        checks += _field_faults(value, f.name, f.dataType, rules, f"{place}.{f.name}" if place else f.name)
    return F.coalesce(*checks)


def _shapes(kind: DataType, rules: Rules, place: str) -> tuple[str, ...] | None:
    """How the type names of allowed values begin; None: any value."""
    if isinstance(kind, VariantType):
        return rules.shapes.get(place)
    names = {StructType: "OBJECT<", ArrayType: "ARRAY<", StringType: "STRING", BooleanType: "BOOLEAN"}
    if type(kind) not in names:
        raise ValueError(f"no rule for {kind.simpleString()} at {place}")
    return (names[type(kind)],)


def _field_faults(value: Column, name: str, kind: DataType, rules: Rules, place: str) -> list[Column]:
    def found(problem: str) -> Column:
        return F.lit(f"{name}|{problem}")

    def given(type_name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", type_name)

    shape, allowed = F.schema_of_variant(given("variant")), _shapes(kind, rules, place)
    checks = []
    if place in rules.required:
        checks.append(F.when(shape.isNull(), found("missing")))
    if allowed:
        nullable = ("VOID",) if place in rules.nullable else ()
        checks.append(F.when(~shape.rlike(f"^({'|'.join(allowed + nullable)})"), found("wrong type")))
    if place in rules.filled:
        checks.append(F.when(given("string") == "", found("missing")))
    if place in rules.choices:
        checks.append(F.when(~given("string").isin(*rules.choices[place]), found("unknown value")))
    if place in rules.only_true:
        checks.append(F.when(~given("boolean"), found("unknown value")))
    if isinstance(kind, StructType):
        checks.append(F.when(shape.startswith("OBJECT<"), F.concat(
            F.lit(name + "."), bind(given("variant"), lambda child: fault(child, kind, rules, place)))))
    elif isinstance(kind, ArrayType):
        checks.append(_member_fault(given("array<variant>"), name, kind.elementType, rules, place + "[]"))
    return checks


def _member_fault(members: Column, name: str, kind: DataType, rules: Rules, place: str) -> Column:
    """The first fault of the members of a list; NULL if it is no list."""
    fits = "^(" + "|".join(_shapes(kind, rules, place) or (".",)) + ")"

    def of_type(x: Column) -> Column:
        return F.coalesce(F.schema_of_variant(x), F.lit("VOID")).rlike(fits)

    if not isinstance(kind, StructType):
        # Members of plain types: the first that is of another type.
        other = F.array_position(F.transform(members, of_type), False)
        return F.when(other > 0, F.concat(F.lit(name + "["), (other - 1).cast("string"), F.lit("]|wrong type")))
    found = F.transform(members, lambda x, i: F.concat(
        F.lit(name + "["), i.cast("string"), F.when(of_type(x), F.concat(F.lit("]."), fault(x, kind, rules, place)))
        .otherwise("]|wrong type")))
    return F.get(F.array_compact(found), F.lit(0))
