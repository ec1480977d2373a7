"""Line dedup: content-defined chunks of lines, removed where they repeat.

Lines are hashed, and chunks are laid over the hashes of the lines that have words. A rolling hash over the last `window`
of them chooses where a chunk ends, so that an insertion moves only the boundaries near it. A passage that repeats between
other lines shares no boundary with them at its two ends; so that it goes whole, each line also begins the shortest chunk
of `run_words` words from it on, and ends the shortest one up to it. All such chunks within a repeated passage repeat as
well, cover it, and don't depend on what stands around it or on how it is laid out in lines.

Chunks are counted over all documents by the hashes of their lines. The first occurrence (least doc_id, then position)
stays; the lines of others go. Bytes are compared before that: a line hash that stands for two different lines of repeated
chunks is replaced by one that tells them apart.

Only built-in functions are used. What is shuffled for counting are hashes of lines; each text is shuffled once, to meet the
intervals that go.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm._common import materialize, text_key


@dataclass(frozen=True)
class Params:
    """A chunk ends at one of `every` boundary values of the rolling hash and counts if it has more than one line and `least_words` words; run_words: words that a repeated passage has at least; hash_bits: of a line's hash (tests take fewer)."""

    window: int = 2
    every: int = 3
    least_words: int = 8
    run_words: int = 50
    hash_bits: int = 64


def words_in(text: Column) -> Column:
    """Number of words parted by \x20 and \x09-\x0D."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def worded_lines(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, key, i, s, w, h: a row for each line that has words; docs: doc_id, key, text."""
    out = docs.select("doc_id", "key", F.posexplode(lines_of(F.col("text"))).alias("i", "s")).withColumn("w", words_in(F.col("s"))).where("w > 0")
    return out.withColumn("h", _hash(F.col("s"), p))


def chunks(lines: DataFrame, p: Params) -> DataFrame:
    """doc_id, key, a, b, k1, k2: each chunk as lines [a, b) and 128 bits of the hashes of its lines. lines: doc_id, key, i, w, h, e (boundary hash)."""
    doc = Window.partitionBy("doc_id", "key")
    at = doc.orderBy("i")
    rolling = F.col("e")
    for k in range(1, p.window):
        rolling = rolling * 31 % 1000003 + F.coalesce(F.lag("e", k).over(at), F.lit(0))
    out = lines.withColumn("last", (F.pmod(rolling % 1000003, F.lit(p.every)) == 0).cast("int"))
    upto = F.sum("w").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumns({"to": upto, "c": F.sum("last").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("last")})
    out = out.withColumn("from", F.col("to") - F.col("w"))
    one = F.struct("i", "h", "w")
    # places in words, not in rows, so that a frame ends with the line that fills it
    onward = F.collect_list(one).over(doc.orderBy("from").rangeBetween(Window.currentRow, p.run_words - 1))
    back = F.collect_list(one).over(doc.orderBy("to").rangeBetween(-(p.run_words - 1), Window.currentRow))
    # c is asked for, so that both uses of the lines are the same exchange
    runs = out.where("c >= 0").select("doc_id", "key", "i", onward.alias("x"), back.alias("y"))
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, l: s + l["w"])  # noqa: E731, E741
    ends = lambda x: F.struct(x[0]["i"].alias("a"), (F.element_at(x, -1)["i"] + 1).alias("b"), *_keys(F.transform(x, lambda l: l["h"])))  # noqa: E731, E741
    found = F.array(*[F.when(total(F.col(x)) >= p.run_words, ends(F.col(x))) for x in ("x", "y")])
    runs = runs.select("doc_id", "key", F.explode(F.array_compact(F.array_distinct(found))).alias("r"))
    own = out.groupBy("doc_id", "key", "c").agg(F.array_sort(F.collect_list(one)).alias("x")).where((F.size("x") > 1) & (total(F.col("x")) >= p.least_words))
    return runs.unionByName(own.select("doc_id", "key", ends(F.col("x")).alias("r"))).select("doc_id", "key", "r.*")


def _keys(hashes: Column) -> list[Column]:
    return [F.xxhash64(hashes).alias("k1"), F.xxhash64(F.lit(1), hashes).alias("k2")]


def occurrences(rows: DataFrame) -> DataFrame:
    """doc_id, key, a, b, c of every chunk that stands more than once: c is the line from which on it goes, null for the first one."""
    place = F.struct("doc_id", "key", "a", "b")
    first = rows.groupBy("k1", "k2").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f <> l").select("k1", "k2", "f")
    first = materialize(first, "repeated-chunks")
    same = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("key") == F.col("f.key"))
    # a chunk that overlaps its own first occurrence loses only the lines behind that
    c = F.when(same & (F.col("a") == F.col("f.a")), F.lit(None)).when(same, F.greatest("a", "f.b")).otherwise(F.col("a"))
    return rows.join(first, ["k1", "k2"]).select("doc_id", "key", "a", "b", c.alias("c")).distinct()


def merged(spans: DataFrame, lo: str, hi: str, name: str) -> DataFrame:
    """doc_id, key and an array of the disjoint intervals [lo, hi) that the spans of a document cover."""
    doc = Window.partitionBy("doc_id", "key").orderBy(lo, hi)
    reached = F.max(hi).over(doc.rowsBetween(Window.unboundedPreceding, -1))
    out = spans.where(F.col(lo) < F.col(hi)).select("doc_id", "key", lo, hi, (F.coalesce(reached, F.lit(-1)) < F.col(lo)).cast("int").alias("new"))
    out = out.withColumn("island", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.groupBy("doc_id", "key", "island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    return out.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias(name))


def _inside(i: Column, spans: str) -> Column:
    return F.exists(spans, lambda r: (i >= r["lo"]) & (i < r["hi"]))


def dedup_lines(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """docs with repeated chunks cut out of text, and the added columns n_lines and n_removed (lines; those of these names are replaced).

    No row goes: a text of nothing but repeats becomes empty. A text without repeats keeps its bytes. A null text stays null.
    A document is a doc_id with a text: rows that share a doc_id and differ in text are ordered by a hash of it; equal rows
    are one document and are cut alike. Rows whose doc_id is null are neither counted nor changed. Lines without words
    don't count; within a chunk they go with it, at its ends they stay. An empty table gives an empty result.
    """
    p = p or Params()
    base = docs.drop("n_lines", "n_removed")
    known, unknown = base.where(F.col("doc_id").isNotNull()), base.where(F.col("doc_id").isNull())
    keyed = known.withColumn("__key", text_key(F.col("text")))
    lines = worded_lines(keyed.select("doc_id", F.col("__key").alias("key"), "text"), p)
    again: DataFrame | None = None
    turn = 0
    while True:
        own = lines.withColumn("e", F.conv(F.substring(F.md5("s"), 1, 8), 16, 10).cast("long"))
        rows = materialize(chunks(_told_apart(own, again).select("doc_id", "key", "i", "w", "h", "e"), p), "line-chunks")
        found = occurrences(rows)
        marks = merged(found, "a", "b", "__seen").join(merged(found.where("c is not null"), "c", "b", "__gone"), ["doc_id", "key"], "left")
        marks = materialize(marks.withColumnsRenamed({"doc_id": "__id", "key": "__of"}), "repeated-intervals")
        # a merge at every size: texts are shuffled once, and marked documents serve both the comparison and the result
        marked = keyed.join(marks.hint("merge"), (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__of")), "left").drop("__id", "__of")
        marked = materialize(marked, "marked-documents")
        told = marked.where(F.col("__seen").isNotNull()).select(F.posexplode(lines_of(F.col("text"))).alias("i", "s"), "__seen")
        told = told.where(_inside(F.col("i"), "__seen")).withColumn("w", words_in(F.col("s"))).where("w > 0").select(_hash(F.col("s"), p).alias("h"), "s")
        # equal lines meet within each task first
        clash = _told_apart(told, again).select("h", "s").distinct().groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
        clash = materialize(clash, "line-hashes-of-several")
        if clash.isEmpty():
            break
        turn += 1
        clash = clash.withColumn("turn", F.lit(turn))
        again = clash if again is None else again.unionByName(clash)
    n_lines = F.size(lines_of(F.col("text")))
    gone = F.coalesce(F.aggregate("__gone", F.lit(0), lambda s, r: s + r["hi"] - r["lo"]), F.lit(0))
    left = F.filter(lines_of(F.col("text")), lambda s, i: ~_inside(i, "__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    # generated columns: a later filter on them would else be pushed below, and the texts cut again for each use
    made = F.inline(F.array(F.struct(text.alias("text"), n_lines.alias("n_lines"), gone.alias("n_removed"))))
    out = marked.select(*[c for c in base.columns if c != "text"], made).select(*base.columns, "n_lines", "n_removed")
    return out.unionByName(unknown.withColumns({"n_lines": n_lines, "n_removed": F.lit(0)}))


def _hash(line: Column, p: Params) -> Column:
    return F.shiftright(F.xxhash64(line), 64 - p.hash_bits) if p.hash_bits < 64 else F.xxhash64(line)


def _told_apart(lines: DataFrame, again: DataFrame | None) -> DataFrame:
    """lines with another hash where theirs, in any turn, stood for several lines."""
    if again is None:
        return lines
    last = again.groupBy("h").agg(F.max("turn").alias("turn"))
    return lines.join(last, "h", "left").withColumn("h", F.when(F.col("turn").isNull(), F.col("h")).otherwise(F.xxhash64("turn", "s"))).drop("turn")


def oracle(p: Params | None = None, docs: str = "documents") -> str:
    """DuckDB SQL for doc_id, text, n_lines, n_removed; doc_ids are unique."""
    p = p or Params()
    rolling = "e"
    for k in range(1, p.window):
        rolling = f"(({rolling}) * 31 % 1000003 + coalesce(lag(e, {k}) OVER o, 0))"
    word = r"'[^\x20\x09-\x0D]+'"
    n = p.run_words - 1
    return f"""
WITH a AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs} WHERE text IS NOT NULL
), l AS (
  SELECT doc_id, i, s, w, ('0x' || substr(md5(s), 1, 8))::BIGINT AS e FROM (SELECT *, length(regexp_extract_all(s, {word}))::BIGINT AS w FROM a) WHERE w > 0
), t AS (
  SELECT *, (({rolling}) % 1000003 % {p.every} = 0)::INT AS last, (sum(w) OVER o)::BIGINT AS upto FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, upto - w AS start, sum(last) OVER (PARTITION BY doc_id ORDER BY i) - last AS c FROM t
), r AS (
  SELECT doc_id, list(i) OVER x AS xi, list(s) OVER x AS xs, sum(w) OVER x AS xw, list(i) OVER y AS yi, list(s) OVER y AS ys, sum(w) OVER y AS yw FROM c
  WINDOW x AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND {n} FOLLOWING), y AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {n} PRECEDING AND CURRENT ROW)
), k AS (
  SELECT doc_id, list_min(xi) AS a, list_max(xi) AS b, xs AS k FROM r WHERE xw >= {p.run_words}
  UNION SELECT doc_id, list_min(yi), list_max(yi), ys FROM r WHERE yw >= {p.run_words}
  UNION SELECT doc_id, min(i), max(i), list(s ORDER BY i) FROM c GROUP BY doc_id, c HAVING count(*) > 1 AND sum(w) >= {p.least_words}
), m AS (
  SELECT doc_id, a, b, first_value(doc_id) OVER f AS fd, first_value(a) OVER f AS fa, first_value(b) OVER f AS fb FROM k WINDOW f AS (PARTITION BY k ORDER BY doc_id, a)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(a, fb + 1) ELSE a END, b + 1)) AS i FROM m WHERE doc_id <> fd OR a <> fa
), x AS (
  SELECT a.doc_id, string_agg(s, chr(10) ORDER BY a.i) FILTER (WHERE g.i IS NULL) AS text, count(*)::INT AS n_lines, count(g.i)::INT AS n_removed
  FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR coalesce(x.n_removed, 0) = 0 THEN d.text ELSE coalesce(x.text, '') END AS text,
  coalesce(x.n_lines, 1)::INT AS n_lines, coalesce(x.n_removed, 0)::INT AS n_removed
FROM {docs} d LEFT JOIN x ON d.doc_id = x.doc_id"""
