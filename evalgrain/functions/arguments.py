"""Tool-call arguments, kept as VARIANT: a JSON null is a value, a missing path is SQL NULL."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import BooleanType, StringType

# Fixed values.
REDACTED = "<redacted>"
TRUNCATION_MARK = "…[truncated at "
VALUE_LIMIT = 500
LIST_LIMIT = 20
SECRET_KEY = (
    r"(?i)(api[-_]?key|access[-_]?token|token|secret|password|passwd|credential"
    r"|authorization|cookie|session[-_]?key)"
)


def argument_value(arguments: Column, path: Column) -> Column:
    """Value at a dotted path; SQL NULL when absent.

    A digit segment indexes a list unless the value is an object with that key.
    The path may differ per row.
    """
    def step(value: Column, segment: Column) -> Column:
        key = F.try_variant_get(value, F.concat(F.lit("$['"), segment, F.lit("']")), "variant")
        item = F.when(
            segment.rlike("^[0-9]{1,9}$"),
            F.try_variant_get(
                value,
                F.concat(F.lit("$["), _index(segment), F.lit("]")), "variant"))
        return F.coalesce(key, item)

    return F.aggregate(F.split(path, r"\."), arguments, step)


def _index(segment: Column) -> Column:
    """The segment as a list index; rows whose segment is no number never use it."""
    return F.when(segment.rlike("^[0-9]{1,9}$"), segment.cast("int").cast("string")) \
        .otherwise(F.lit("0"))


def is_present(value: Column) -> Column:
    return value.isNotNull()


def value_kind(value: Column) -> Column:
    """BOOLEAN, NUMBER, STRING, VOID, ARRAY or OBJECT."""
    schema = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.regexp_replace(schema, "^(BIGINT|DECIMAL|DOUBLE|FLOAT)$", "NUMBER")


def as_object(value: Column) -> Column:
    """The value when it is a JSON object, else NULL."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def value_incomplete(value: Column) -> Column:
    """A redacted or shortened value, at any depth, proves nothing."""
    text = F.to_json(value)
    in_value = r'(?<!\\)"(?:<redacted>|(?:[^"\\]|\\.)*…\[truncated at (?:[^"\\]|\\.)*)"(?!:)'
    return F.coalesce(text.rlike(in_value), F.lit(False))


def json_equal(left: Column, right: Column) -> Column:
    """Scalar equality by JSON type: booleans are not numbers, 1 equals 1.0."""
    kind_left, kind_right = value_kind(left), value_kind(right)
    whole_left = F.schema_of_variant(left) == "BIGINT"
    whole_right = F.schema_of_variant(right) == "BIGINT"

    def as_type(name: str) -> Column:
        return F.try_variant_get(left, "$", name) == F.try_variant_get(right, "$", name)

    same = (
        F.when(kind_left != kind_right, F.lit(False))
        .when(whole_left & whole_right, as_type("bigint"))
        .when(kind_left == "NUMBER", as_type("double"))
        .when(kind_left == "BOOLEAN", as_type("boolean"))
        .when(kind_left == "STRING", as_type("string"))
        .otherwise(F.to_json(left) == F.to_json(right))
    )
    return F.coalesce(same, F.lit(False))


_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _masked(text: str) -> str:
    """JSON with the values of secret keys masked; every other token is kept as it is written, numbers too."""
    out, depth, hidden, secret = [], 0, None, False
    tokens = _TOKEN.findall(text)
    for token, after in zip(tokens, [*tokens[1:], ""]):
        starts, ends = token in ("{", "["), token in ("}", "]")
        if hidden is None and secret and token != ":":
            out.append(json.dumps(REDACTED))
            secret = False
            hidden = depth if starts else None
        elif hidden is None:
            out.append(token)
            if after == ":":
                secret = re.search(SECRET_KEY, json.loads(token)) is not None
        depth += starts - ends
        if ends and depth == hidden:
            hidden = None
    return "".join(out)


def _shortened(value):
    if isinstance(value, dict):
        return {k: _shortened(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_shortened(v) for v in value[:LIST_LIMIT]]
    if isinstance(value, str) and len(value) > VALUE_LIMIT:
        return f"{value[:VALUE_LIMIT]}{TRUNCATION_MARK}{VALUE_LIMIT} of {len(value)} chars]"
    return value


@F.pandas_udf(StringType())
def _masked_json(batch: pd.Series) -> pd.Series:
    return batch.map(_masked, na_action="ignore")


@F.pandas_udf(StringType())
def _shown_json(batch: pd.Series) -> pd.Series:
    return batch.map(
        lambda text: json.dumps(_shortened(json.loads(text)), ensure_ascii=False, separators=(",", ":")),
        na_action="ignore")


def redact_arguments(arguments: Column) -> Column:
    """Mask values under secret-looking keys at any depth; all else stays whole.

    Nested JSON cannot be rebuilt by SQL expressions, so documents in which
    such a key may occur pass through one Arrow batch function; the others have
    nothing to mask and stay in the JVM.
    """
    text = F.to_json(arguments)
    return F.coalesce(F.parse_json(_masked_json(F.when(text.rlike(SECRET_KEY), text))), arguments)


def display_arguments(arguments: Column) -> Column:
    """Masked arguments for showing: long strings and lists are shortened, as JSON text. Not for scoring."""
    return _shown_json(F.to_json(redact_arguments(arguments)))


@F.pandas_udf(BooleanType())
def regex_found(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Whether the pattern of the row occurs in its text; NULL where either is NULL or the pattern is broken."""
    compiled = {}
    for one in pattern.dropna().unique():
        try:
            compiled[one] = re.compile(one)
        except re.error:
            compiled[one] = None
    return pd.Series([
        None if t is None or compiled.get(p) is None else compiled[p].search(t) is not None
        for t, p in zip(text, pattern)], dtype=object)
