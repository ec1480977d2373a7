"""Merging a new extraction into the stored one: full outer joins on normalised keys, one rule for each entity; nothing is lost.

Stored rows keep their order and new ones follow: seq = the stored seq, else a million and the new seq. If a document has no
rows of an entity on one side, the other side's stay as they are, which a full outer join gives by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.bibliography import citation_number
from scriptorium.functions.text import is_valid_scalar, strip
from scriptorium.operators.outline import sort_key

Rule = Callable[[Column, Column], Column]


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c.cast("string")) == "")


def fill(old: Column, new: Column) -> Column:
    """The stored value unless it is blank."""
    return F.when(blank(old), new).otherwise(old)


def newer(old: Column, new: Column) -> Column:
    """The new value unless it is blank."""
    return F.when(blank(new), old).otherwise(new)


def longer(old: Column, new: Column) -> Column:
    return F.when(old.isNull() | (F.length(new) > F.length(old)), F.coalesce(new, old)).otherwise(old)


def more_rows(old: Column, new: Column) -> Column:
    return F.when(F.coalesce(F.size(new), F.lit(-1)) > F.coalesce(F.size(old), F.lit(-1)), new).otherwise(old)


def upsert(old: DataFrame, new: DataFrame, key: Callable[[DataFrame], Column], rules: dict[str, Rule], seq: str = "seq", doc: str = "doc_id") -> DataFrame:
    """old and new full outer on (doc, key); columns without a rule keep the stored value if it is there. Keys are unique first: the first row of each. Rows without a key stay as they are."""
    sides = []
    for df in (old, new):
        k = df.withColumn("__key", F.nullif(key(df), F.lit("")))
        first = F.row_number().over(Window.partitionBy(doc, "__key").orderBy(seq))
        # null keys meet nothing in the join, so rows without a key go through it as they are
        sides.append(k.withColumn("__r", first).where((F.col("__r") == 1) | F.col("__key").isNull()).drop("__r").withColumn("__side", F.lit(1)))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    met = a.join(b, (F.col(f"a.{doc}") == F.col(f"b.{doc}")) & (F.col("a.__key") == F.col("b.__key")), "full_outer")
    cols = [F.coalesce(F.col(f"a.{doc}"), F.col(f"b.{doc}")).alias(doc), F.coalesce(F.col(f"a.{seq}"), F.lit(1_000_000) + F.col(f"b.{seq}")).cast("long").alias(seq)]
    for c in old.columns:
        if c not in (doc, seq):
            x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
            rule = rules.get(c, lambda p, q: F.coalesce(p, q))
            cols.append(F.when(F.col("a.__side").isNull(), y).when(F.col("b.__side").isNull(), x).otherwise(rule(x, y)).alias(c))
    return met.select(*cols)


def alnum(c: Column) -> Column:
    """Letters and digits of any script, in lower case; of a text without any, the text."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), F.lit("")), strip(c))


def authors(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, lambda d: alnum(F.col("name")), {c: fill for c in ("affiliation", "identifier", "email")})


def sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """By name; a longer summary that says something wins, new pages win. Ordered by place."""

    def summary(x: Column, y: Column) -> Column:
        empty = x.contains("Penjelasan ide")
        return F.when(((F.length(y) > F.length(x)) & ~y.contains("Penjelasan ide")) | (empty & ~blank(y)), y).otherwise(x)

    out = upsert(old, new, lambda d: F.lower(strip(F.regexp_replace("section_name", r"^\s*#+\s*", ""))), {"summary": summary, "page_start": newer, "page_end": newer})
    return out.orderBy("doc_id", *sort_key(F.col("section_name"), F.col("page_start")), "seq")


def metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    key = lambda d: F.nullif(F.concat_ws("::", F.lower(strip(F.coalesce("category", F.lit("")))), F.lower(strip(F.coalesce("name", F.lit(""))))), F.lit("::"))
    return upsert(old, new, key, {"value": fill, "unit_code": fill, "page_number": newer})


def tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """By number, else by the first 40 characters of the caption; the table with more rows wins as a whole."""
    low = F.lower(strip(F.coalesce("caption", F.lit(""))))
    number = F.regexp_extract(low, r"(?:tabel|table)\s+(\d+)", 1)
    wrapped = lambda d: d.select("doc_id", "seq", F.struct(*[c for c in d.columns if c not in ("doc_id", "seq")]).alias("t"), F.when(number != "", F.concat(F.lit("table_"), number)).otherwise(F.left(low, F.lit(40))).alias("k"))
    out = upsert(wrapped(old), wrapped(new), lambda d: F.col("k"), {"t": lambda x, y: F.when(F.size(y["rows"]) > F.size(x["rows"]), y).otherwise(x)})
    return out.select("doc_id", "seq", "t.*")


def citations(old: DataFrame, new: DataFrame) -> DataFrame:
    """By number, else by the first 50 letters and digits; the longer string wins. Ordered by number, others last."""
    number = F.regexp_extract("citation", r"^\s*(\[\d+\])", 1)
    out = upsert(old, new, lambda d: F.when(number != "", number).otherwise(F.left(alnum(F.col("citation")), F.lit(50))), {"citation": longer})
    return out.orderBy("doc_id", citation_number(F.col("citation")), "seq")


def nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    rules: dict[str, Rule] = {c: fill for c in old.columns if c in ("label", "type", "description", "source_page")}
    if "same_as" in old.columns:
        rules["same_as"] = lambda x, y: F.when(F.coalesce(F.size(x), F.lit(0)) > 0, x).otherwise(y)
    return upsert(old, new, lambda d: F.col("node_id"), rules)


def edges(old: DataFrame, new: DataFrame) -> DataFrame:
    key = lambda d: F.concat_ws("::", "src", "type", "dst")
    return upsert(old, new, key, {c: (lambda x, y: y) for c in old.columns if c not in ("doc_id", "seq", "src", "dst", "type")})


def procedures(old: DataFrame, new: DataFrame) -> DataFrame:
    key = lambda d: F.coalesce(F.col("step_number").cast("string"), F.lower("name"))
    return upsert(old, new, key, {c: (lambda x, y: y) for c in old.columns if c not in ("doc_id", "seq")})


def terms(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, lambda d: F.lower(strip(F.col("name"))), {"description": longer})


def formulas(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, lambda d: F.lower(F.coalesce(F.nullif(strip(F.col("expression")), F.lit("")), strip(F.col("name")) if "name" in d.columns else F.lit(""))), {c: (lambda x, y: y) for c in old.columns if c not in ("doc_id", "seq")})


#: The fields of a document of which the longer counts.
SCALARS = ("name", "headline", "alternate_name", "description", "date_published", "doi", "in_language", "genre", "learning_resource_type", "license")


def documents(old: DataFrame, new: DataFrame, scalars: tuple[str, ...] = SCALARS) -> DataFrame:
    """One row a document: the longer of valid scalars, the stored one of equal length; a dated id stays, the new publisher wins, keywords are united. Columns that only `new` has come along.

    export.packaged() makes tags, linked data and package anew.
    """
    from scriptorium.functions.metadata import keyword_union

    def scalar(x: Column, y: Column) -> Column:
        return F.when(~F.coalesce(is_valid_scalar(y), F.lit(False)), fill(x, y)).when(~F.coalesce(is_valid_scalar(x), F.lit(False)), y).when((F.length(y) > F.length(x)) & ~y.contains("undated"), y).otherwise(x)

    rules: dict[str, Rule] = {c: scalar for c in scalars}
    rules |= {"publisher": newer, "id": lambda x, y: F.when(x.isNotNull() & ~x.contains("undated"), x).otherwise(F.coalesce(y, x))}
    rules["keywords"] = lambda x, y: keyword_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))
    one = lambda d: d.withColumn("seq", F.lit(1)) if "seq" not in d.columns else d
    both = lambda d, e: d.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in e.schema if f.name not in d.columns])
    return upsert(one(both(old, new)), one(both(new, old)), lambda d: F.col("doc_id").cast("string"), rules).drop("seq")
