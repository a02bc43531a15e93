"""JSON Schema as column expressions over VARIANT values, in the JVM.

A subset: type, enum and const of scalars, required, properties, additionalProperties false, items, minItems, maxItems, minLength, maxLength, minimum, maximum, pattern (a regular expression of Java). A schema that says more of this kind, such as an enum of objects, has no expression. Errors come in one order: of the value itself, of what it lacks, of its properties by name, of what it has beside them by name, of its items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = (str, int, float, bool, type(None))
NUMBERS = ("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def expressible(schema: dict) -> bool:
    """Whether errors_of() can tell all that the schema says."""
    inner = [*(schema.get("properties") or {}).values(), *([schema["items"]] if "items" in schema else [])]
    listed = [*schema.get("enum", []), *([schema["const"]] if "const" in schema else [])]
    return all(isinstance(x, SCALARS) for x in listed) and all(isinstance(s, dict) and expressible(s) for s in inner)


def parsed(payload: Column) -> Column:
    """JSON as a variant; null for what is no JSON, or has a name twice in an object."""
    return F.try_parse_json(payload)


def _kind(v: Column, name: str) -> Column:
    said = F.schema_of_variant(v)
    number = said.isin(*NUMBERS) | F.startswith(said, F.lit("DECIMAL"))
    return {
        "object": F.startswith(said, F.lit("OBJECT")), "array": F.startswith(said, F.lit("ARRAY")), "string": said == "STRING", "boolean": said == "BOOLEAN", "null": said == "VOID",
        "number": number, "integer": number & F.coalesce(F.try_variant_get(v, "$", "double") % 1 == 0, F.lit(False)),
    }[name]


def _equals(v: Column, value: object) -> Column:
    """Whether a variant is this scalar; true and false are no numbers."""
    if value is None:
        return _kind(v, "null")
    kind, cast = ("boolean", "boolean") if isinstance(value, bool) else ("string", "string") if isinstance(value, str) else ("number", "double")
    return _kind(v, kind) & F.coalesce(F.try_variant_get(v, "$", cast) == F.lit(float(value) if cast == "double" else value), F.lit(False))


def errors_of(schema: dict, v: Column, at: Column | None = None) -> Column:
    """The errors of a variant under a schema, an array of texts. at: where it lies, as a JSON pointer."""
    at = F.lit("#") if at is None else at
    none = F.array().cast("array<string>")
    told = lambda bad, text: F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(at, F.lit(f" {text}")))).otherwise(none)
    out = []
    if "enum" in schema:
        out.append(told(~reduce(lambda a, b: a | b, [_equals(v, x) for x in schema["enum"]], F.lit(False)), "is not one of the listed values"))
    if "const" in schema:
        out.append(told(~_equals(v, schema["const"]), "is not the required value"))
    held, known = F.try_variant_get(v, "$", "map<string,variant>"), schema.get("properties") or {}
    is_object = _kind(v, "object")
    has = lambda k: F.coalesce(F.map_contains_key(held, k), F.lit(False))
    out += [told(is_object & ~has(k), f"lacks {k}") for k in schema.get("required", [])]
    out += [F.when(is_object & has(k), errors_of(known[k], held[k], F.concat(at, F.lit(f"/{k}")))).otherwise(none) for k in sorted(known)]
    if schema.get("additionalProperties") is False:
        more = F.array_sort(F.array_except(F.map_keys(held), F.array(*[F.lit(k) for k in known]).cast("array<string>")))
        out.append(F.when(is_object, F.transform(more, lambda k: F.concat(at, F.lit(" has "), k, F.lit(", which is not allowed")))).otherwise(none))
    if {"items", "minItems", "maxItems"} & set(schema):
        items, is_array = F.try_variant_get(v, "$", "array<variant>"), _kind(v, "array")
        if "items" in schema:
            out.append(F.when(is_array, F.flatten(F.transform(items, lambda x, i: errors_of(schema["items"], x, F.concat(at, F.lit("/"), i.cast("string")))))).otherwise(none))
        out += [told(is_array & bad, f"has too {word} items") for name, word, bad in (("minItems", "few", F.size(items) < schema.get("minItems", 0)), ("maxItems", "many", F.size(items) > schema.get("maxItems", 0))) if name in schema]
    if {"minLength", "maxLength", "pattern"} & set(schema):
        text = F.when(_kind(v, "string"), F.try_variant_get(v, "$", "string"))
        out += [told(bad, f"is too {word}") for name, word, bad in (("minLength", "short", F.length(text) < schema.get("minLength", 0)), ("maxLength", "long", F.length(text) > schema.get("maxLength", 0))) if name in schema]
        if "pattern" in schema:
            out.append(told(~text.rlike(schema["pattern"]), "does not match the pattern"))
    number = F.when(_kind(v, "number"), F.try_variant_get(v, "$", "double"))
    out += [told(bad, f"is too {word}") for name, word, bad in (("minimum", "small", number < float(schema.get("minimum", 0))), ("maximum", "large", number > float(schema.get("maximum", 0)))) if name in schema]
    every = F.concat(*out) if out else none
    if not schema.get("type"):
        return every
    names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
    fits = reduce(lambda a, b: a | b, [_kind(v, n) for n in names])
    return F.when(fits, every).otherwise(F.array(F.concat(at, F.lit(f" is not of type {' or '.join(names)}"))))
