"""The gate: which records are served, by the verdicts of their types' checkers."""

from __future__ import annotations

import hashlib
import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import schemas
from palimpsest.model import KEY

#: Bytes of the largest file that rules get.
MAX_FILE = 25 << 20


def checker_of(type: Column, checkers: dict[str, str], other: str) -> Column:
    """The checker of a type; `other` for types without one, and for null."""
    chosen = F.lit(other)
    for t, c in sorted(checkers.items()):
        chosen = F.when(type == t, c).otherwise(chosen)
    return chosen


def judged(records: DataFrame, verdicts: DataFrame, checker: Column) -> DataFrame:
    """Records beside the verdict on this very version by their checker: columns of records and `reason`, inner join."""
    r = records.withColumn("checker", checker)
    return r.join(verdicts.select(*KEY, "cid", "checker", "reason"), [*KEY, "cid", "checker"])


def allowed(records: DataFrame, verdicts: DataFrame | None, checker: Column) -> DataFrame:
    """Records with a verdict that lets them in; all without a gate."""
    if verdicts is None:
        return records
    good = verdicts.where("reason IS NULL").select(*KEY, "cid", "checker")
    return records.withColumn("checker", checker).join(good, [*KEY, "cid", "checker"], "left_semi").drop("checker")


def allows(records: DataFrame, verdicts: DataFrame | None, checker: Column, publisher: str, repo: str, id: str, cid: str) -> bool:
    """Whether one version of a record is served."""
    one = records.where((F.col("publisher") == publisher.lower()) & (F.col("repo") == repo) & (F.col("id") == id) & (F.col("cid") == cid))
    return verdicts is None or bool(allowed(one, verdicts, checker).take(1))


def refused(records: DataFrame, verdicts: DataFrame, checker: Column) -> DataFrame:
    """Records that the gate leaves out, and why, in key order."""
    return judged(records, verdicts, checker).where("reason IS NOT NULL").orderBy(*KEY)


def unchecked(records: DataFrame, verdicts: DataFrame, checker: Column) -> DataFrame:
    """Records without a verdict on this version by their present checker."""
    return records.withColumn("checker", checker).join(verdicts.select(*KEY, "cid", "checker"), [*KEY, "cid", "checker"], "left_anti")


@dataclass
class Rule:
    """validate(record, context) gives True to let in, or a reason. name: stands before the reason."""

    name: str
    validate: Callable[[dict, dict], Any]
    params: dict = field(default_factory=dict)
    description: str = ""


@dataclass
class Checks:
    schema: dict | None = None
    rules: list[Rule] = field(default_factory=list)


@dataclass
class Gates:
    """ids by type, and for types that aren't listed."""

    by_type: dict[str, str]
    other: str
    listed: bool


def short_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:32]


def _identity(c: Checks) -> list:
    return [c.schema, [[r.name, r.params] for r in c.rules]]


def gates_of(base: Checks, types: dict[str, Checks]) -> Gates | None:
    """None if nothing is checked. Descriptions don't count, so that rewording one rechecks nothing."""
    if not base.schema and not base.rules and not any(c.schema or c.rules for c in types.values()):
        return None
    ids = {t: short_hash([_identity(base), t, _identity(c)]) for t, c in types.items()}
    return Gates(ids, short_hash([_identity(base), sorted(types)]), bool(types))


def mismatches(schema: dict, value: Any, at: str = "#") -> list[str]:
    """Errors of one value, as schemas.errors_of() tells them of a column: for what is published here, and for schemas that have no expression."""
    import re

    kinds = {"object": dict, "array": list, "string": str, "number": (int, float), "integer": int, "boolean": bool, "null": type(None)}
    wanted = schema.get("type")
    if wanted:
        names = [wanted] if isinstance(wanted, str) else wanted
        fits = lambda n: isinstance(value, kinds[n]) and not (n in ("number", "integer") and isinstance(value, bool)) or n == "integer" and isinstance(value, float) and value.is_integer()
        if not any(fits(n) for n in names):
            return [f"{at} is not of type {' or '.join(names)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at} is not one of the listed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at} is not the required value")
    if isinstance(value, dict):
        out += [f"{at} lacks {k}" for k in schema.get("required", []) if k not in value]
        known = schema.get("properties", {})
        out += [e for k in sorted(known) if k in value for e in mismatches(known[k], value[k], f"{at}/{k}")]
        if schema.get("additionalProperties") is False:
            out += [f"{at} has {k}, which is not allowed" for k in sorted(set(value) - set(known))]
    if isinstance(value, list):
        if "items" in schema:
            out += [e for i, v in enumerate(value) for e in mismatches(schema["items"], v, f"{at}/{i}")]
        out += [f"{at} has too {w} items" for w, bad in (("few", len(value) < schema.get("minItems", 0)), ("many", len(value) > schema.get("maxItems", float("inf")))) if bad]
    if isinstance(value, str):
        out += [f"{at} is too {w}" for w, bad in (("short", len(value) < schema.get("minLength", 0)), ("long", len(value) > schema.get("maxLength", float("inf")))) if bad]
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at} does not match the pattern")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at} is too {w}" for w, bad in (("small", value < schema.get("minimum", float("-inf"))), ("large", value > schema.get("maximum", float("inf")))) if bad]
    return out


def reason_of(record: dict, base: Checks, types: dict[str, Checks], context: dict | None = None) -> str | None:
    """Why a record is refused, or None: is its type listed, base schema, type's schema, base rules, type's rules; the first refusal counts. context["file"] is what the record's file holds, or a function that fetches it, which is called only if the schemas let the record in and there are rules."""
    if types and record.get("type") not in types:
        return f"type {record.get('type')} is not listed"
    own = types.get(record.get("type"), Checks())
    for schema in (base.schema, own.schema):
        if schema and (errors := mismatches(schema, record.get("payload"))):
            return "; ".join(errors[-3:])
    rules = [*base.rules, *own.rules]
    if not rules:
        return None
    context = dict(context or {})
    if callable(context.get("file")):
        context["file"] = context["file"]()
    if len(context.get("file") or b"") > MAX_FILE:
        return f"its file is over {MAX_FILE >> 20} MB"
    for rule in rules:
        try:
            said = rule.validate(record, {**context, "params": rule.params})
        except Exception as e:  # a rule that fails refuses
            said = str(e)
        if said is not True:
            return f"{rule.name}: {said if isinstance(said, str) else 'refused'}"
    return None


def said_by_columns(type: Column, payload: Column, base: Checks, types: dict[str, Checks]) -> Column:
    """Why a record is refused as far as types and schemas tell, or null; in the JVM. The first refusal counts."""
    value = schemas.parsed(payload)

    def of(schema: dict) -> Column:
        wrong = schemas.errors_of(schema, value)
        return F.when(F.size(wrong) > 0, F.array_join(F.slice(wrong, F.greatest(F.size(wrong) - 2, F.lit(1)), F.lit(3)), "; "))

    why = [F.when(value.isNull(), "its payload is not JSON")]
    if types:
        why.append(F.when(~F.coalesce(type.isin(list(types)), F.lit(False)), F.concat(F.lit("type "), F.coalesce(type, F.lit("None")), F.lit(" is not listed"))))
    if base.schema:
        why.append(of(base.schema))
    why += [F.when(type == t, of(c.schema)) for t, c in sorted(types.items()) if c.schema]
    return F.coalesce(*why, F.lit(None).cast("string"))


def said_by_rules(batch: DataFrame, base: Checks, types: dict[str, Checks], fetch: Callable[[str], bytes | None] | None) -> DataFrame:
    """key, cid, checker and reason by what Python has to tell: rules, and schemas without an expression. batch: with __src and, where no fetch() is given, __file."""

    @F.pandas_udf("done boolean, reason string")
    def why(publisher: pd.Series, repo: pd.Series, id: pd.Series, cid: pd.Series, type: pd.Series, payload: pd.Series, src: pd.Series, file: pd.Series) -> pd.DataFrame:
        out = []
        for p, r, i, c, t, text, s, f in zip(publisher, repo, id, cid, type, payload, src, file, strict=True):

            def content(s=s, f=f):
                if s is not None and f is None and fetch:
                    f = fetch(s)
                if s is not None and f is None and with_files:
                    raise FileNotFoundError(s)
                return f

            try:
                out.append((True, reason_of({"id": i, "type": t, "cid": c, "payload": json.loads(text)}, base, types, {"publisher": p, "repo": r, "file": content})))
            except (TypeError, ValueError, RecursionError):
                out.append((True, "its payload is not JSON"))
            except Exception:  # not the record's fault: a later run tries again
                out.append((False, None))
        return pd.DataFrame(out, columns=["done", "reason"])

    with_files = fetch is not None or "__file" in batch.columns
    batch = batch if "__file" in batch.columns else batch.withColumn("__file", F.lit(None).cast("binary"))
    said = batch.select(*KEY, "cid", "checker", why(*KEY, "cid", "type", "payload", "__src", "__file").alias("said"))
    return said.where("said.done").select(*KEY, "cid", "checker", "said.reason")


def check_missing(
    records: DataFrame, verdicts: DataFrame, checker: Column, base: Checks, types: dict[str, Checks], most: int | None = None, seed: int | None = None, files: DataFrame | Callable[[str], bytes | None] | None = None
) -> DataFrame:
    """Verdicts on unchecked records: key, cid, checker and reason.

    Types and schemas are column expressions and judge all records in the JVM. Only records that they let in and whose type has rules go to Python, and only these get their files. files: cid and content, a table that those records alone are joined with, or a function that reads one, called in the task when a record's rules come to it, so that a task holds one file at a time.

    most: only so many, in random order, so that records that can't be checked don't hold up the rest; None: all, with no order. A payload that is no JSON is refused. A record whose file is missing, or whose check can't be carried out, gets no verdict, and is unchecked as before.
    """
    batch = unchecked(records, verdicts, checker)
    if most is not None:
        batch = batch.orderBy(F.rand(random.randrange(1 << 30) if seed is None else seed)).limit(most)
    told = [base, *types.values()]
    in_columns = all(c.schema is None or schemas.expressible(c.schema) for c in told)
    ruled = F.lit(bool(base.rules)) | F.coalesce(F.col("type").isin([t for t, c in types.items() if c.rules]), F.lit(False)) if any(c.rules for c in told) else F.lit(False)
    judged = batch.withColumn("reason", said_by_columns(F.col("type"), F.col("payload"), base, types) if in_columns else F.lit(None).cast("string"))
    out = [*KEY, "cid", "checker", "reason"]
    if in_columns and not any(c.rules for c in told):
        return judged.select(*out)
    asks = F.col("reason").isNull() & (ruled if in_columns else F.lit(True))
    left = judged.where(asks).drop("reason").withColumn("__src", F.get_json_object("payload", "$.src"))
    if isinstance(files, DataFrame):
        left = left.join(files.select(F.col("cid").alias("__cid"), F.substring("content", 1, MAX_FILE + 1).alias("__file")), F.col("__src") == F.col("__cid"), "left").drop("__cid")
    # Schemas have spoken: a rule is all that is left to hear.
    rules = (Checks(None, base.rules), {t: Checks(None, c.rules) for t, c in types.items()}) if in_columns else (base, types)
    return judged.where(~asks).select(*out).unionByName(said_by_rules(left, *rules, files if callable(files) else None))


def with_verdicts(verdicts: DataFrame, new: DataFrame) -> DataFrame:
    """verdicts with the new ones in place of those on the same records."""
    return verdicts.join(new.select(*KEY), KEY, "left_anti").unionByName(new.select(verdicts.columns))
