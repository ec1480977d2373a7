"""JSON of many makers brought to one schema: what the corpus has is looked at first, and what doesn't fit is told."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Other names of a document's fields, in the order in which they are tried.
SYNONYMS = {
    "name": ("title", "headline"),
    "description": ("abstract", "summary", "overview", "desc"),
    "author": ("authors",),
    "entities_involved": ("entities",),
    "keywords": ("tags",),
    "properties_and_metrics": ("metrics", "properties"),
    "sections": ("chapters", "parts"),
    "references_or_sources": ("references", "citations", "sources"),
}
#: Kinds that a field may have; people are objects with a name, or names alone.
KINDS = ("string", "double", "array<string>", "people")
PEOPLE = "array<struct<type:string,name:string>>"


def observed(rows: DataFrame, column: str = "v") -> dict[str, str]:
    """Names and types of the top-level fields of all objects in a variant column, by one aggregate over the corpus."""
    found = rows.agg(F.schema_of_variant_agg(column)).first()[0] or ""
    m = re.fullmatch(r"OBJECT<(.*)>", found, re.S)
    out, depth, start = {}, 0, 0
    text = f"{m.group(1)}," if m else ""
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, _, kind = text[start:i].strip().partition(": ")
            out[name.strip("`")] = kind
            start = i + 1
    return out


def plan(fields: dict[str, str], seen: dict[str, str], synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, list[str]]:
    """For each wanted field the names that the corpus has for it, its own first."""
    synonyms = SYNONYMS if synonyms is None else synonyms
    return {f: [n for n in (f, *synonyms.get(f, ())) if n in seen] for f in fields}


def _typed(value: Column, kind: str) -> Column:
    """value (variant) as a kind, or null. Lists are taken for lists, and a single value for a list of one."""
    at = lambda v, t: F.try_variant_get(v, "$", t)
    many = F.coalesce(at(value, "array<variant>"), F.array(value))
    scalar = ~F.schema_of_variant(value).rlike("^(?:ARRAY|OBJECT)")
    if kind == "string":
        return F.when(scalar, at(value, "string"))
    if kind == "double":
        return F.when(scalar, F.regexp_replace(F.replace(at(value, "string"), F.lit(","), F.lit(".")), r"[%\s]", "").try_cast("double"))
    if kind == "array<string>":
        texts = F.transform(many, lambda x: F.when(~F.schema_of_variant(x).rlike("^(?:ARRAY|OBJECT)"), at(x, "string")))
        return F.when(~F.exists(texts, lambda x: x.isNull()), texts)
    person = lambda x: F.struct(
        F.coalesce(F.try_variant_get(x, "$['@type']", "string"), F.try_variant_get(x, "$.type", "string"), F.lit("Person")).alias("type"),
        F.coalesce(F.try_variant_get(x, "$.name", "string"), F.when(~F.schema_of_variant(x).rlike("^(?:ARRAY|OBJECT)"), at(x, "string"))).alias("name"),
    )
    people = F.transform(many, person)
    return F.when(~F.exists(people, lambda p: p["name"].isNull()), people)


def coerced(rows: DataFrame, fields: dict[str, str], key: list[str], column: str = "v", names: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key and a column for each field; key, field, found, value of what a row has but couldn't be made to fit).

    rows: key columns and a variant. fields: kinds by name. A field is the first of its names that isn't null in the row; names
    that no row has aren't looked for (names: of plan(), made here if not given). JSON nulls count as absent.
    """
    for kind in fields.values():
        if kind not in KINDS:
            raise ValueError(f"{kind} is none of {KINDS}")
    names = plan(fields, observed(rows, column)) if names is None else names
    raw = {f: F.coalesce(*[_there(column, n) for n in names[f]]) if names[f] else F.lit(None).cast("variant") for f in fields}
    held = rows.select(*key, *[v.alias(f"__{f}") for f, v in raw.items()])
    typed = held.select("*", *[_typed(F.col(f"__{f}"), kind).alias(f) for f, kind in fields.items()])
    lost = F.array_compact(F.array(*[F.when(F.col(f"__{f}").isNotNull() & F.col(f).isNull(), F.struct(F.lit(f).alias("field"), F.schema_of_variant(f"__{f}").alias("found"), F.to_json(f"__{f}").alias("value"))) for f in fields]))
    return typed.select(*key, *fields), typed.select(*key, F.explode(lost).alias("l")).select(*key, "l.*")


def _there(column: str, name: str) -> Column:
    v = F.try_variant_get(column, f"$['{name}']", "variant")
    return F.when(~F.is_variant_null(v), v)
