"""Text of records: leaves of JSON, search terms, tokens."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 64
MAX_REPO_TEXT = 4000


def accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters that they are without, by canonical decomposition."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x250)}
    pairs = {a: b for a, b in pairs.items() if a != b and b.isalpha()}
    return "".join(pairs), "".join(pairs.values())


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, *accents()))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, folded, in order."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def lexical_terms(query: Column) -> Column:
    """The words of a query: runs without white space and quotes, in lower case, distinct, the first 64 in the order they come."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(query, F.lit(""))), F.lit(r'[^\s"]+'), F.lit(0))), 1, MAX_TERMS)


def fts_text(payload: Column, text: Column) -> Column:
    """What full text search reads: the payload's field text where it has one, else the record's text."""
    return F.coalesce(F.get_json_object(payload, "$.text"), text)


def number_text(value: int | float) -> str:
    """A number as JavaScript writes it, which is how texts were indexed: the shortest digits that stand for the double, with an exponent below 1e-6 and from 1e21 on."""
    try:
        x = float(value)
    except OverflowError:
        x = float("inf") if value > 0 else float("-inf")
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0"
    mantissa, _, power = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole.lstrip("0")) if whole.strip("0") else -(len(part) - len(part.lstrip("0")))
    point += int(power or 0)
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        out = digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = f"0.{'0' * -point}{digits}"
    else:
        e = point - 1
        out = f"{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if e > 0 else '-'}{abs(e)}"
    return f"-{out}" if x < 0 else out


def _leaf(value: object) -> str:
    if value is True or value is False:
        return "true" if value else "false"
    return number_text(value) if isinstance(value, (int, float)) else str(value)


def _is_index(key: str) -> bool:
    return key.isascii() and key.isdecimal() and str(int(key)) == key and int(key) < 2**32 - 1


def leaves(value: object, path: str = "") -> list[str]:
    """`path: value` for each leaf in the order of the document; nulls have none. Keys that are whole numbers come first, in ascending order."""
    return [f"{p}: {_leaf(v)}" for p, v in leaf_items(value, path)]


def leaf_items(value: object, path: str = "") -> list[tuple[str, object]]:
    """Path and value of each leaf. Goes into depth with a stack of its own, so that no payload is too deep."""
    out, stack = [], [(path, value)]
    while stack:
        path, value = stack.pop()
        if value is None:
            continue
        if isinstance(value, dict):
            numbers = sorted((k for k in value if _is_index(k)), key=int)
            items = [(k, value[k]) for k in [*numbers, *[k for k in value if not _is_index(k)]]]
        elif isinstance(value, list):
            items = [(str(i), v) for i, v in enumerate(value)]
        else:
            out.append((path, value))
            continue
        stack += [(f"{path}.{k}" if path else k, v) for k, v in reversed(items)]
    return out


def text_of(payload: Column) -> Column:
    """The leaves of a JSON payload, one a line; null for what isn't JSON. A JSON parser that keeps the order of keys isn't among the built-in functions."""

    def one(p: str | None) -> str | None:
        try:
            return None if p is None else "\n".join(leaves(json.loads(p)))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def of(payloads: pd.Series) -> pd.Series:
        return pd.Series([one(p) for p in payloads], dtype=object)

    return of(payload)


def leaves_of(payload: str | None) -> list[tuple[str, str, str]]:
    """Path, value (as text) and type of each leaf of a JSON payload; none for what isn't JSON."""
    kinds = {bool: "boolean", int: "number", float: "number", str: "string"}
    try:
        return [] if payload is None else [(path, _leaf(v), kinds[type(v)]) for path, v in leaf_items(json.loads(payload))]
    except (ValueError, RecursionError):
        return []


def leaf_rows(payload: Column) -> Column:
    """The leaves of a JSON payload as an array of path, value and type, for F.inline()."""

    @F.pandas_udf("array<struct<path: string, value: string, type: string>>")
    def of(payloads: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("path", "value", "type"), x, strict=True)) for x in leaves_of(p)] for p in payloads], dtype=object)

    return of(payload)


def repo_text(repo: Column, card: Column) -> Column:
    """Searchable text of a repo: its name, and its card's name, description and skills, cut at 4000 characters."""
    skill = "array<struct<name: string, description: string, tags: array<string>>>"
    parsed = F.from_json(card, f"name string, description string, skills {skill}")
    parts = F.concat(
        F.array(F.regexp_replace(repo, r"[-_.]+", " "), parsed["name"], parsed["description"]),
        F.coalesce(F.flatten(F.transform(parsed["skills"], lambda s: F.concat(F.array(s["name"], s["description"]), F.coalesce(s["tags"], F.array().cast("array<string>"))))), F.array().cast("array<string>")),
    )
    return F.substring(F.array_join(F.array_compact(parts), "\n"), 1, MAX_REPO_TEXT)
