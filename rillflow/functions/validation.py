"""JSON Schema checks of JSON text, compiled to Column predicates over parsed variants.

Supported: type, properties, required, enum, pattern, minimum, maximum, minLength, maxLength, minItems, maxItems, items
(by a pandas function) and nested objects. An unknown keyword is refused when the validator is built.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYWORDS = frozenset(
    "type properties required enum pattern minimum maximum minLength maxLength minItems maxItems items $schema title description".split()
)
TYPES = frozenset("object array string integer number boolean null".split())


class InvalidSchema(ValueError):
    """The schema can't be compiled."""


def checked_schema(schema: Mapping[str, Any]) -> Mapping[str, Any]:
    if not isinstance(schema, Mapping):
        raise InvalidSchema("a schema is an object")
    if unknown := set(schema) - KEYWORDS:
        raise InvalidSchema(f"unsupported keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    if not set([kinds] if isinstance(kinds, str) else kinds) <= TYPES:
        raise InvalidSchema(f"unknown type {kinds}")
    if "pattern" in schema:
        try:
            re.compile(schema["pattern"])
        except re.error as e:
            raise InvalidSchema(str(e)) from e
    for part in schema.get("properties", {}).values():
        checked_schema(part)
    if "items" in schema:
        checked_schema(schema["items"])
    return schema


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and math.isfinite(value) and value == int(value)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    plain = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
    return isinstance(value, plain[kind])


def problem(value: Any, schema: Mapping[str, Any], path: str = "$") -> str | None:
    """The first rule of the schema that a parsed value breaks, None if there is none."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_is(value, k) for k in kinds):
            return f"{path}: not {' or '.join(kinds)}"
    if "enum" in schema and not any(value == e and isinstance(value, bool) == isinstance(e, bool) for e in schema["enum"]):
        return f"{path}: not in enum"
    if isinstance(value, str):
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"{path}: pattern"
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", math.inf):
            return f"{path}: length"
    if _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{path}: range"
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0) or len(value) > schema.get("maxItems", math.inf):
            return f"{path}: number of items"
        for i, item in enumerate(value if "items" in schema else ()):
            if found := problem(item, schema["items"], f"{path}[{i}]"):
                return found
    if isinstance(value, dict):
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name, part in schema.get("properties", {}).items():
            if name in value and (found := problem(value[name], part, f"{path}.{name}")):
                return found
    return None


def validation_error(text: Column, schema: Mapping[str, Any]) -> Column:
    """struct(kind, message): ParseError or ValidationFailed; null for text that satisfies the schema."""
    compiled = dict(checked_schema(schema))

    @F.pandas_udf("struct<kind:string,message:string>")
    def check(texts: pd.Series) -> pd.DataFrame:
        kinds, messages = [], []
        for t in texts:
            try:
                found = problem(json.loads(t), compiled) if t is not None else "$: null"
                kinds.append("ValidationFailed" if found else None)
                messages.append(found)
            except ValueError as e:
                kinds.append("ParseError")
                messages.append(str(e))
        return pd.DataFrame({"kind": kinds, "message": messages})

    out = check(text)
    return F.when(out["kind"].isNotNull(), out)


#: Names of JSON types in the schema of a variant.
_VARIANT = {"string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "array": ["ARRAY"], "object": ["OBJECT"]}


def valid_flat(text: Column, schema: Mapping[str, Any]) -> Column:
    """Whether text is a JSON object that satisfies a schema of scalar properties, without leaving the JVM.

    Only type, properties, required, enum, pattern, minimum, maximum and the lengths of scalar properties are taken.
    """
    checked_schema(schema)
    if schema.get("type", "object") != "object":
        raise InvalidSchema("a flat schema describes an object")
    doc = F.try_parse_json(text)
    holds = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    # Whether a property is there: null is, absent isn't; is_variant_null tells the two apart.
    for name in schema.get("required", ()):
        part = F.try_variant_get(doc, f"$.{name}", "variant")
        holds = holds & part.isNotNull()
    for name, rule in schema.get("properties", {}).items():
        holds = holds & _valid_scalar(F.try_variant_get(doc, f"$.{name}", "variant"), rule)
    return holds


def _valid_scalar(part: Column, rule: Mapping[str, Any]) -> Column:
    kind = F.schema_of_variant(part)
    text, number = F.try_variant_get(part, "$", "string"), F.try_variant_get(part, "$", "double")
    is_text = kind == "STRING"
    is_number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    tests: list[Column] = []
    kinds = rule.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = F.lit(False)
        for k in kinds:
            if k == "integer":
                fits = fits | (is_number & (number == F.floor(number)))
            elif k == "number":
                fits = fits | is_number
            else:
                fits = fits | kind.rlike("^(" + "|".join(_VARIANT[k]) + ")")
        tests.append(fits)
    if "enum" in rule:
        if not all(isinstance(e, str) for e in rule["enum"]):
            raise InvalidSchema("a flat enum holds strings")
        tests.append(is_text & text.isin(*rule["enum"]))
    if "pattern" in rule:
        tests.append(~is_text | text.rlike(rule["pattern"]))
    for name, test in (("minLength", F.char_length(text) >= rule.get("minLength", 0)), ("maxLength", F.char_length(text) <= rule.get("maxLength", 0))):
        if name in rule:
            tests.append(~is_text | test)
    for name, test in (("minimum", number >= rule.get("minimum", 0)), ("maximum", number <= rule.get("maximum", 0))):
        if name in rule:
            tests.append(~is_number | test)
    if unsupported := set(rule) & {"items", "minItems", "maxItems", "properties", "required"}:
        raise InvalidSchema(f"not for a flat schema: {sorted(unsupported)}")
    holds: Column = F.lit(True)
    for t in tests:
        holds = holds & F.coalesce(t, F.lit(False))
    return part.isNull() | holds


def with_schema_validation(df: DataFrame, text: Column, schema: Mapping[str, Any]) -> tuple[DataFrame, DataFrame]:
    """The rows that satisfy the schema, and the others with err."""
    judged = df.withColumn("err", validation_error(text, schema))
    return judged.where("err IS NULL").drop("err"), judged.where("err IS NOT NULL")
