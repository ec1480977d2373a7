"""Joins of word sets that share a number of words, within a group such as a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rare_prefixes(sets: DataFrame, least: int, group: str = "doc_id", item: str = "seq", words: str = "words") -> DataFrame:
    """group, item, word, i, n, f: the words by which a set can first meet another one.

    A group's words are ordered by how many of its sets have them, rare ones first; i is a word's place among the n words of
    its set that any other set has, f the number of sets that have it. Two sets with `least` words in common have one of
    them among the first n - least + 1 of each; the last words of a set, which are the most common, meet nothing.
    """
    w = sets.select(group, item, F.explode(F.array_distinct(words)).alias("word"))
    shared = w.groupBy(group, "word").agg(F.count("*").alias("f")).where("f > 1")
    w = w.join(shared.hint("merge"), [group, "word"])
    own = Window.partitionBy(group, item)
    w = w.withColumn("i", F.row_number().over(own.orderBy("f", "word")) - 1).withColumn("n", F.count("*").over(own))
    return w.where(F.col("i") <= F.col("n") - least)


def candidates(prefixes: DataFrame, least: int, may: Column | None = None, carry: list[str] | None = None, group: str = "doc_id", item: str = "seq", split: int = 512) -> DataFrame:
    """group, a, b (a before b): pairs of sets that meet by a word of their prefixes and may still share `least` words from there on.

    prefixes: of rare_prefixes, with the columns `carry`; may: a condition over a.* and b.* that a pair must meet. A word of
    very many sets is dealt over tasks: its sets on the one side by parts of about `split`, those on the other once for
    each part.
    """
    carry = carry or []
    parts = F.ceil(F.col("f") / split).cast("int")
    a = prefixes.withColumn("part", F.pmod(F.xxhash64(item), parts).cast("int")).alias("a")
    b = prefixes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(group, "word", "part", F.col(item), "i", "n", *carry).alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a.word") == F.col("b.word")) & (F.col("a.part") == F.col("b.part"))
    left = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    met = a.join(b.hint("merge"), same & (F.col(f"a.{item}") < F.col(f"b.{item}")) & (left >= least) & (may if may is not None else F.lit(True)))
    return met.select(F.col(f"a.{group}").alias(group), F.col(f"a.{item}").alias("a"), F.col(f"b.{item}").alias("b")).distinct()


def overlapping(sets: DataFrame, least: int, may: Column | None = None, carry: list[str] | None = None, group: str = "doc_id", item: str = "seq", words: str = "words") -> DataFrame:
    """group, a, b, shared (sorted): all pairs of sets of a group with `least` words in common. Sets with fewer words, and rows whose words are null, meet nothing."""
    keep = [group, item, *(carry or [])]
    firsts = rare_prefixes(sets, least, group, item, words)
    firsts = firsts.join(sets.select(*keep).hint("merge"), [group, item]) if carry else firsts
    met = candidates(firsts, least, may, carry, group, item)
    x = sets.select(group, F.col(item).alias("a"), F.col(words).alias("__x"))
    y = sets.select(group, F.col(item).alias("b"), F.col(words).alias("__y"))
    # merged, as all of them grow with the rows: what looks small when compressed would be broadcast through the driver
    out = met.join(x.hint("merge"), [group, "a"]).join(y.hint("merge"), [group, "b"])
    return out.select(group, "a", "b", F.array_sort(F.array_intersect("__x", "__y")).alias("shared")).where(F.size("shared") >= least)
