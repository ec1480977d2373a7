"""Tables: parsing, what counts as one, and fragments put together."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators import flat
from scriptorium.functions.text import EDGES, MARKED, is_formula, let, sanitize_for_extraction, strip, strip_markdown

#: Column names of descriptive tables.
DESCRIPTIVE = (
    "deskripsi description keterangan fungsi function kelebihan kekurangan advantages disadvantages pros cons strength weakness opportunity threat features fitur spesifikasi"
    " specification rekomendasi recommendation alasan reason komponen component kegunaan catatan notes remarks role"
).split()
#: Headers of plots, not of tables.
AXES = "α β γ δ θ λ μ σ τ ω 0 1 2 x y z d n c l a b m k r".split()
PLOT_LABELS = ("coordinates", "layer", "tokens n", "check", "compared against", "add-one", "add-1", "add-half", "point", "points")
FIGURE_LINE = r"(?i)^(?:Figure|Fig\.|Gambar|Bagan|Chart|Grafik|Plot|Diagram)\s+\d+"
INTRODUCES = r"(?i)^(?:Tabel|Table)\s+\d+\s+(?:shows|presents|illustrates|displays|summarizes|provides|compares|is|was|were|menunjukkan|menyajikan|menjelaskan|memperlihatkan)\b"
#: Captions that no cleaning changes: plain words with single spaces between them, no decimal that may be torn apart.
PLAIN = r"^(?!.*\d ?\. ?\d)[A-Za-z0-9(][A-Za-z0-9().,]*(?: [A-Za-z0-9().,]+)*\z"
RULE = r"^[|\s\-:]+$"

words_of = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def cells_of(rows: Column) -> Column:
    return F.filter(F.transform(F.flatten(rows), lambda c: strip(c)), lambda c: c != "")


def mean_words(rows: Column) -> Column:
    cells = cells_of(rows)
    return F.aggregate(cells, F.lit(0), lambda s, c: s + words_of(c)) / F.nullif(F.size(cells), F.lit(0))


def is_descriptive(headers: Column, rows: Column) -> Column:
    named = F.exists(headers, lambda h: F.exists(F.array(*[F.lit(k) for k in DESCRIPTIVE]), lambda k: F.lower(h).contains(k)))
    return (F.size(headers) > 0) & (F.size(rows) > 0) & (named | F.coalesce(mean_words(rows) > 4.0, F.lit(False)))


def is_valid_table(headers: Column, rows: Column, allow_descriptive: bool = True) -> Column:
    """Two headers that say something, none a formula or over 12 words, not mostly formulas, no plot's axes or labels; a single row needs three columns."""
    real = F.filter(F.transform(headers, lambda h: strip(h)), lambda h: (h != "") & ~h.rlike(r"^[\-:\s]+$"))
    parts = F.struct(headers.alias("headers"), rows.alias("rows"), real.alias("real"), cells_of(rows).alias("cells"))
    return let(parts, lambda p: _valid(p["headers"], p["rows"], p["real"], p["cells"], allow_descriptive))


def _valid(headers: Column, rows: Column, real: Column, cells: Column, allow_descriptive: bool) -> Column:
    formulas = F.size(F.filter(cells, is_formula)) / F.nullif(F.size(cells), F.lit(0))
    ok = (F.size(headers) >= 2) & (F.size(rows) >= 1) & (F.size(real) >= 2) & (F.size(cells) > 0)
    ok = ok & ~F.exists(real, is_formula) & ~F.exists(real, lambda h: words_of(h) > 12) & (F.coalesce(formulas, F.lit(0.0)) <= 0.4)
    ok = ok & ~F.forall(real, lambda h: F.lower(h).isin(*AXES) | (F.length(h) <= 1)) & ~F.exists(real, lambda h: F.lower(h).isin(*PLOT_LABELS))
    ok = ok & ((F.size(rows) > 1) | (F.size(real) >= 3))
    if not allow_descriptive:
        prose = F.size(F.filter(cells, lambda c: (words_of(c) > 10) | c.rlike(r"\.\s+[A-Z]"))) / F.nullif(F.size(cells), F.lit(0))
        ok = ok & (is_descriptive(headers, rows) | ((mean_words(rows) <= 7.0) & (prose <= 0.2)))
    return F.coalesce(ok, F.lit(False))


def align_caption(caption: Column, language: Column) -> Column:
    """Table and Page in English documents, Tabel and Halaman in others."""
    en = F.regexp_replace(F.regexp_replace(caption, r"(?i)\bTabel\b", "Table"), r"(?i)\bHalaman\s+(\d+)", "Page $1")
    other = F.regexp_replace(F.regexp_replace(caption, r"(?i)\bTable\b", "Tabel"), r"(?i)\bPage\s+(\d+)", "Halaman $1")
    return F.when(language == "en", en).otherwise(other)


def parse_markdown(text: Column, page: Column, language: Column) -> Column:
    """struct(caption, page_number, headers, rows, table_type) of a table with bars; null for figures, formulas and what is no table."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: strip(x)), lambda x: x != "")
    parts = lambda ls: F.struct(ls.alias("lines"), F.transform(F.slice(ls, 1, 6), lambda x: strip_markdown(x)).alias("head"), F.filter(ls, lambda x: x.contains("|")).alias("bars"))
    split = lambda x: F.transform(F.split(strip(x, "|"), r"\|"), lambda c: strip_markdown(c))

    def cells(p: Column) -> Column:
        bars = p["bars"]
        start = F.when(F.get(bars, F.lit(1)).rlike(RULE), 3).otherwise(2)
        rows = F.filter(F.transform(F.slice(bars, start, F.greatest(F.size(bars), F.lit(1))), split), lambda r: F.exists(r, lambda c: c != ""))
        return F.struct(p.alias("p"), split(F.get(bars, F.lit(0))).alias("headers"), rows.alias("rows"))

    return let(let(let(lines, parts), cells), lambda c: _parsed(c["p"]["lines"], c["p"]["head"], c["p"]["bars"], c["headers"], c["rows"], page, language))


def _parsed(lines: Column, head: Column, bars: Column, headers: Column, rows: Column, page: Column, language: Column) -> Column:
    captions = F.filter(F.transform(head, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].rlike(r"(?i)^(?:Tabel|Table)\s+\d+\b") & ~s["x"].contains("|") & ~s["x"].rlike(INTRODUCES))
    at = F.get(captions, F.lit(0))["i"]
    caption = F.get(captions, F.lit(0))["x"]
    upto = F.slice(head, F.lit(1), F.coalesce(at, F.lit(5)) + 1)
    bad = F.exists(upto, lambda x: x.rlike(FIGURE_LINE) | is_formula(x))
    after = strip_markdown(F.get(lines, at + 1))
    goes_on = (after != "") & ~after.contains("|") & ~after.rlike(r"(?i)^(?:Table|Tabel|Figure|Gambar|BAB|Section|\d+\.)")
    open_end = caption.rlike(r"(?i)(?:\b(?:for|of|in|with|and|to|the|on|by|at|from|under|between|among)|-)$") | (~caption.endswith(".") & (F.length(caption) < 80))
    caption = F.when(F.coalesce(goes_on & open_end, F.lit(False)), F.concat_ws(" ", caption, after)).otherwise(caption)
    named = F.filter(headers, lambda h: (h != "") & ~h.rlike(r"^[\-:\s]+$"))
    made = F.concat(F.lit("Table "), F.when(F.size(named) > 0, F.array_join(F.slice(named, 1, 2), " - ")).otherwise("Data"), F.lit(" (Page "), page.cast("string"), F.lit(")"))
    ok = ~F.coalesce(bad, F.lit(False)) & (F.size(bars) >= 2) & is_valid_table(headers, rows)
    kind = F.when(is_descriptive(headers, rows), "descriptive").otherwise("quantitative")
    return F.when(ok, F.struct(align_caption(F.coalesce(caption, made), language).alias("caption"), page.alias("page_number"), headers.alias("headers"), rows.alias("rows"), kind.alias("table_type")))


def flat_tables(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_seq, page_number, caption, headers, rows of table chunks without bars: columns set apart by gaps, by single spaces, or rows run together in one line."""

    def parse(frames):
        for f in frames:
            out = []
            for doc, seq, page, text in zip(f["doc_id"], f["chunk_seq"], f["page_idx"], f["text"], strict=True):
                got = flat.parse(re.sub(r"^DATA TABEL / METRIK SPESIFIK:[ \t]*\n?", "", text or ""))
                if got:
                    out.append((doc, seq, page, got[0], got[1], got[2]))
            yield pd.DataFrame(out, columns=["doc_id", "chunk_seq", "page_number", "caption", "headers", "rows"])

    rows = chunks.where((F.col("chunk_type") == "table") & ~F.col("text").contains("|")).select("doc_id", "chunk_seq", "page_idx", "text")
    return rows.mapInPandas(parse, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, chunk_seq long, page_number int, caption string, headers array<string>, rows array<array<string>>")


def merge_key(caption: Column, headers: Column) -> Column:
    token = F.array_join(F.filter(F.transform(headers, lambda h: F.regexp_replace(F.lower(h), "[^a-zA-Z0-9]", "")), lambda t: t != ""), "|")
    plain = F.left(strip(F.regexp_replace(F.lower(caption), r"\(?\s*(?:halaman|page)\s+\d+\s*\)?", "")), F.lit(30))
    number = F.regexp_extract(F.lower(caption), r"\b(?:table|tabel)\s*([0-9ivxlcdm]+)\b", 1)
    count = F.size(headers).cast("string")
    numbered = let(number, lambda n: F.when(n != "", F.concat(F.lit("tbl_"), n, F.lit("_"), count)))
    return F.coalesce(numbered, let(F.struct(token.alias("token")), lambda s: _key_of_names(s["token"], plain, count)))


def _key_of_names(token: Column, plain: Column, count: Column) -> Column:
    return F.when(token != "", F.concat(token, F.lit("::"), plain)).otherwise(F.concat(F.lit("cols_"), count, F.lit("::"), plain))


def consolidate(tables: DataFrame, language: Column | None = None) -> DataFrame:
    """doc_id, caption, page_number, headers, rows, table_type, first_seq: fragments of one key on pages that follow each other are one table.

    tables: doc_id, seq, caption, page_number, headers, rows. The first fragment's caption and headers stay, rows that repeat
    its headers go, and the page is the last fragment's.
    """
    language = F.lit("en") if language is None else language
    # one look at all cells of a fragment (a star for nulls): without a marker only their ends are trimmed
    marked = lambda cells: F.coalesce(F.array_join(cells, "\n", "*").rlike(MARKED), F.lit(True))
    each = lambda cells, f: F.transform(cells, lambda c: f(c))
    ends = lambda c: strip(c, EDGES)
    rows = tables.withColumn("headers", F.when(marked(F.col("headers")), each("headers", strip_markdown)).otherwise(each("headers", ends)))
    rows = rows.withColumn("rows", let(F.col("rows"), lambda rs: F.when(marked(F.flatten(rs)), F.transform(rs, lambda r: each(r, strip_markdown))).otherwise(F.transform(rs, lambda r: each(r, ends)))))
    named = lambda c: F.when(c == "", F.when(language == "en", "Table Data").otherwise("Tabel Data Dokumen")).otherwise(align_caption(c, language))
    rows = rows.withColumn("caption", let(let(F.coalesce("caption", F.lit("")), lambda c: F.when(c.rlike(PLAIN), c).otherwise(strip_markdown(sanitize_for_extraction(c)))), named))
    rows = rows.withColumn("key", merge_key(F.col("caption"), F.col("headers")))
    w = Window.partitionBy("doc_id", "key").orderBy("page_number", "seq")
    rows = rows.withColumn("island", F.sum(F.when(F.col("page_number") - F.lag("page_number").over(w) <= 1, 0).otherwise(1)).over(w))
    part = F.struct("page_number", "seq", "caption", "headers", "rows")
    out = rows.groupBy("doc_id", "key", "island").agg(F.array_sort(F.collect_list(part)).alias("p"), F.min("seq").alias("first_seq"), F.max("page_number").alias("page_number"))
    first = F.get("p", F.lit(0))
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-zA-Z0-9]", "")
    # the headers are brought to letters once a table; most rows differ from them in the first cell
    other = lambda r, own: (plain(F.get(r, F.lit(0))) != F.get(own, F.lit(0))) | (F.transform(r, plain) != own)
    more = let(F.transform(first["headers"], plain), lambda own: F.flatten(F.transform(F.slice("p", 2, 1 << 30), lambda x: F.filter(x["rows"], lambda r: other(r, own)))))
    out = out.select("doc_id", first["caption"].alias("caption"), "page_number", first["headers"].alias("headers"), F.when(F.size("p") > 1, F.concat(first["rows"], more)).otherwise(first["rows"]).alias("rows"), "first_seq")
    out = out.where(~F.col("caption").rlike(FIGURE_LINE))
    return out.withColumn("table_type", F.when(is_descriptive(F.col("headers"), F.col("rows")), "descriptive").otherwise("quantitative"))
