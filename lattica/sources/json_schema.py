"""Constraints from JSON Schema and OpenAPI documents (as parsed JSON)."""

from __future__ import annotations

from functools import reduce
from typing import Any

from ..functions.maths import multiple_of
from ..plans.constraints import Anything, Bound, Constraint, Field, Items, Kind, Nothing, OneOf, OrNull, Pattern, Record, Passes, Value, meet

KINDS = {"string": "string", "integer": "int", "number": "number", "boolean": "bool"}
#: Levels of a recursive schema that are followed; a value below them is refused. Schemas without recursion are followed to their end.
DEPTH = 16


#: What only null fits.
ONLY_NULL = OrNull(Nothing("only null is allowed"))


def _length(name: str, n: int) -> Passes:
    from pyspark.sql import functions as F

    return Passes(f"{name} {n}", (lambda c: F.char_length(c) >= n) if name == "minLength" else (lambda c: F.char_length(c) <= n))


def _deeper() -> Passes:
    from pyspark.sql import functions as F

    return Passes(f"within {DEPTH} levels of recursion", lambda c: F.lit(False))


def _multiple(n: float) -> Passes:
    return Passes(f"multipleOf {n}", lambda c: multiple_of(c, n))


def constraint(schema: Any, root: Any = None, depth: int = 0, within: tuple[str, ...] = ()) -> Constraint:
    """The constraint of a schema: $ref within the document, type, enum, const, allOf, anyOf, oneOf, bounds, lengths, patterns, items,
    properties with required, additionalProperties and patternProperties, and default among the values of an enum."""
    root = schema if root is None else root
    if schema is True or schema == {}:
        return Anything()
    if schema is False:
        return Nothing("nothing is allowed")
    parts: list[Constraint] = []
    if "$ref" in schema:
        names = [k.replace("~1", "/").replace("~0", "~") for k in schema["$ref"].removeprefix("#").split("/")[1:]]
        if depth > DEPTH and schema["$ref"] in within:
            return _deeper()
        parts.append(constraint(reduce(lambda d, k: d[k], names, root), root, depth + 1, (*within, schema["$ref"])))
    if "const" in schema:
        parts.append(_any_of([ONLY_NULL if schema["const"] is None else Value(schema["const"])]))
    if "enum" in schema:
        values = [v for v in schema["enum"] if v is not None]
        default = values.index(schema["default"]) if schema.get("default") in values else None
        parts.append(_any_of([*map(Value, values), *([ONLY_NULL] if None in schema["enum"] else [])], default))
    for word in ("anyOf", "oneOf"):
        if word in schema:
            parts.append(_any_of([constraint(s, root, depth + 1, within) for s in schema[word]]))
    parts += [constraint(s, root, depth + 1, within) for s in schema.get("allOf", [])]
    names = schema.get("type")
    names = [n for n in (names if isinstance(names, list) else [names]) if n is not None]
    kinds = [k for n in names if (k := ONLY_NULL if n == "null" else _typed(schema, n, root, depth, within)) is not None]
    if kinds:
        parts.append(_any_of(kinds))
    elif "properties" in schema or "additionalProperties" in schema or "patternProperties" in schema:
        parts.append(_record(schema, root, depth, within))
    for word, operator in (("minimum", ">="), ("maximum", "<="), ("exclusiveMinimum", ">"), ("exclusiveMaximum", "<")):
        if isinstance(schema.get(word), int | float) and not isinstance(schema[word], bool):
            parts.append(Bound(operator, schema[word]))
    if "multipleOf" in schema:
        parts.append(_multiple(schema["multipleOf"]))
    if "pattern" in schema:
        parts.append(Pattern(schema["pattern"]))
    parts += [_length(w, schema[w]) for w in ("minLength", "maxLength") if w in schema]
    if parts and all(isinstance(p, OrNull) or not isinstance(p, Value | OneOf | Kind | Record | Items | Nothing) for p in parts):
        # Bounds, patterns and lengths say nothing about null.
        null = any(isinstance(p, OrNull) for p in parts)
        both = reduce(meet, [p.inner if isinstance(p, OrNull) else p for p in parts], Anything())
        return OrNull(both) if null else both
    return reduce(meet, parts, Anything())


def _any_of(branches: list[Constraint], default: int | None = None) -> Constraint:
    """One of the branches; null fits if it fits one of them. Nothing fits none at all."""
    inner, null = [b.inner if isinstance(b, OrNull) else b for b in branches], any(isinstance(b, OrNull) for b in branches)
    live = [b for b in inner if not isinstance(b, Nothing)]
    out = Nothing("only null is allowed" if null else "no value is allowed") if not live else live[0] if len(live) == 1 else OneOf(tuple(live), default)
    return OrNull(out) if null else out


def _typed(schema: dict, name: str, root: Any, depth: int, within: tuple[str, ...]) -> Constraint | None:
    if name == "array":
        inner = schema.get("items", True)
        prefix = tuple(constraint(s, root, depth + 1, within) for s in schema.get("prefixItems", []))
        element = None if inner is False else constraint(inner, root, depth + 1, within)
        return Items(element, prefix, schema.get("minItems", 0), schema.get("maxItems"), bool(schema.get("uniqueItems")))
    if name == "object":
        return _record(schema, root, depth, within)
    return Kind(KINDS[name]) if name in KINDS else None


def _record(schema: dict, root: Any, depth: int, within: tuple[str, ...]) -> Record:
    required = set(schema.get("required", []))
    fields = {n: Field(constraint(s, root, depth + 1, within), n not in required) for n, s in schema.get("properties", {}).items()}
    fields |= {n: Field(Anything()) for n in sorted(required - set(fields))}
    patterns = [(p, constraint(s, root, depth + 1, within)) for p, s in schema.get("patternProperties", {}).items()]
    more = schema.get("additionalProperties", True)
    rest = constraint(more, root, depth + 1, within) if isinstance(more, dict) else Anything()
    return Record(tuple(fields.items()), more is False, tuple(patterns), schema.get("minProperties", 0), schema.get("maxProperties"), rest)


def definitions(document: dict) -> dict[str, Constraint]:
    """The named schemas of an OpenAPI document, of version 3 (components) or 2 (definitions)."""
    named = document.get("components", {}).get("schemas") or document.get("definitions") or {}
    return {name: constraint(schema, document) for name, schema in named.items()}
