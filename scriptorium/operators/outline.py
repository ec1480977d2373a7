"""Outlines: heading candidates, monotonic order, sections and their pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import let, strip, strip_markdown, worded
from scriptorium.session import stored

#: Roman numbers of major headings.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii")
#: Names that are no sections.
FORBIDDEN = r"daftar pustaka|references|bibliography|kata pengantar|daftar isi|table of contents|lampiran|appendix|daftar tabel|daftar gambar"
AFFILIATION = r"department|faculty|fakultas|departemen|universit|institut|school of|program studi|prodi|jurusan|laborator|college|academy|centre|center|email|correspondence|@|zip code|postal code"
PLACEHOLDERS = ("section", "bab", "chapter", "bagian", "seksi", "documentsection", "main section", "subbab", "heading", "judul bab", "")
KNOWN = r"(?i)^(?:abstract|abstrak|executive summary|ringkasan eksekutif|introduction|pendahuluan|background|related work|methods?|methodology|metode|results?(?: and discussion)?|hasil(?: dan pembahasan)?|discussion|pembahasan|conclusions?|kesimpulan|acknowledg(?:e?ments?))$"
NUMBERED = r"^(?:[1-9]|1\d|2\d)\.(?:\d+(?:\.\d+)*\.?)?\s+\p{Lu}"
#: Words of running text, and of clauses, that no heading has.
NARRATIVE_WORDS = (
    "students", "tutors", "groups", "articles", "hours", "weeks", "days", "months", "sessions", "samples", "participants", "patients", "respondents", "analysed", "analyzed", "assessed", "explained",
    "evaluated", "conducted", "achieved", "observed", "suggests", "indicates", "improves", "demonstrates", "guiding", "removes the need", "suit more",
)
CLAUSE_WORDS = ("whose", "which is", "we present", "we introduce", "we show", "demonstrate", "demonstrates", "instantiation")
NARRATIVE, CLAUSE = worded(*NARRATIVE_WORDS), worded(*CLAUSE_WORDS) + r"|\(\s*§"


def heading_candidates(lines: DataFrame) -> DataFrame:
    """doc_id, page, seq, heading: numbered, Roman, chapter and known headings among the lines (doc_id, page_idx, line_no, line).

    Lines from a bibliography's heading on don't count; a heading that ends in a connective or hyphen takes the next line
    (eight words at most, not numbered); each name counts once.
    """
    doc = Window.partitionBy("doc_id").orderBy("page_idx", "line_no")
    refs = F.col("line").rlike(r"(?i)^(?:\d+\.?\s*)?(?:references|daftar pustaka|bibliography|rujukan)\s*$").cast("int")
    rows = lines.withColumn("refs", F.max(refs).over(doc)).withColumn("after", F.lead("line").over(doc)).where("refs = 0")
    line = F.col("line")
    shape = line.rlike(NUMBERED) | line.rlike(r"(?i)^(?:I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s+\p{Lu}") | line.rlike(r"^(?:BAB|CHAPTER)\s+[IVX\d]+") | line.rlike(r"^[A-Z]\.\s+\p{Lu}") | line.rlike(KNOWN)
    fits = (F.length(line) <= 120) & (F.size(F.split(line, r"\s+")) <= 14) & ~line.contains("|") & ~line.rlike(r"[.;,:]$") & ~line.rlike(r"\.\s+\p{L}+\s+\p{Ll}.*\.\s") & (F.size(F.regexp_extract_all(line, F.lit(r"(\d+(?:\.\d+)?)"), 1)) <= 3)
    opens = line.rlike(r"(?i)(?:\b(?:and|of|for|the|in|on|with|to|dan|untuk|pada|dengan)|-)$")
    takes = opens & F.col("after").isNotNull() & (F.size(F.split("after", r"\s+")) <= 8) & ~F.col("after").rlike(r"^\d")
    rows = rows.where(shape & fits).withColumn("heading", F.when(takes, F.concat_ws(" ", F.regexp_replace(line, "-$", ""), "after")).otherwise(line))
    first = Window.partitionBy("doc_id", F.lower("heading")).orderBy("page_idx", "line_no")
    rows = rows.withColumn("r", F.row_number().over(first)).where("r = 1")
    return rows.select("doc_id", F.col("page_idx").alias("page"), F.row_number().over(doc).alias("seq"), "heading")


def major_number(heading: Column) -> Column:
    """1 to 29 of `n. Name`, or of a Roman number to XII; null for subsections and others."""
    arabic = F.regexp_extract(heading, r"^([1-9]|1\d|2\d)\.\s+.+$", 1)
    roman = F.lower(F.regexp_extract(heading, r"(?i)^(I|II|III|IV|V|VI|VII|VIII|IX|X|XI|XII)\.\s+.+$", 1))
    return F.when(arabic != "", arabic.cast("int")).when(roman != "", F.array_position(F.array(*[F.lit(r) for r in ROMAN]), roman).cast("int"))


def monotonic_outline(candidates: DataFrame) -> DataFrame:
    """doc_id, page, seq, heading, major, kind (major, sub, other), place: by number, each major takes its first candidate not before the page of the last one taken; subsections before their parent's page go.

    The fold runs within the row of a document, over its sorted candidates.
    """
    sub = F.col("heading").rlike(r"^([1-9]|1\d|2\d)\.\d+") | (F.col("heading").rlike(r"^[A-Z]\.\s+") & major_number(F.col("heading")).isNull())
    rows = candidates.withColumn("major", F.when(~sub, major_number(F.col("heading"))))
    rows = rows.withColumn("kind", F.when(sub, "sub").when(F.col("major").isNotNull(), "major").otherwise("other"))
    item = F.struct("major", "seq", "page")
    majors = rows.where("kind = 'major'").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    zero = F.struct(F.lit(1).alias("page"), F.lit(0).alias("major"), F.array().cast("array<int>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        take = (x["major"] != s["major"]) & (x["page"] >= s["page"])
        return F.when(take, F.struct(x["page"].cast("int").alias("page"), x["major"].alias("major"), F.concat(s["taken"], F.array(x["seq"].cast("int"))).alias("taken"))).otherwise(s)

    taken = majors.select("doc_id", F.explode(F.aggregate("c", zero, step, lambda s: s["taken"])).alias("seq"))
    kept = rows.where("kind = 'major'").join(taken, ["doc_id", "seq"], "left_semi")
    parents = kept.select("doc_id", F.col("major").alias("parent"), F.col("page").alias("parent_page"))
    subs = rows.where("kind = 'sub'").withColumn("parent", F.nullif(F.regexp_extract("heading", r"^([1-9]|1\d|2\d)\.\d+", 1), F.lit("")).cast("int"))
    subs = subs.join(parents, ["doc_id", "parent"], "left").where("parent_page IS NULL OR page >= parent_page").select(*kept.columns)
    out = kept.unionByName(subs).unionByName(rows.where("kind = 'other'").select(*kept.columns))
    order = F.when(F.col("kind") == "major", 0).when(F.col("kind") == "sub", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(order, F.when(F.col("kind") == "major", F.col("major")), "seq")
    return out.withColumn("place", F.row_number().over(w)).select("doc_id", "page", "seq", "heading", "major", "kind", "place")


def filter_sections(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, seq, section_name, summary, page_start) whose names can be headings; summaries of those without a name go to weak ones in order."""
    name, summary = strip_markdown(F.col("section_name")), strip_markdown(F.col("summary"))
    rows = sections.withColumns({"section_name": name, "summary": summary}).withColumn("low", F.lower("section_name"))
    n, low = F.col("section_name"), F.col("low")
    doc = Window.partitionBy("doc_id")
    second = F.min_by(F.col("page_start"), F.when(n.rlike(r"^2[.:\s]") & ~low.rlike(AFFILIATION), F.col("seq"))).over(doc)
    major = lambda d: n.rlike(rf"^{d}[.:\s]") & ~n.rlike(r"^\d+\.\d+")
    words = F.size(F.split(n, r"\s+"))
    orphan = low.isin(*PLACEHOLDERS) | (words > 14)
    bad = low.rlike(FORBIDDEN) | low.rlike("email|correspondence|@") | (low.rlike(AFFILIATION) & ((F.regexp_count(n, F.lit(",")) >= 2) | n.rlike(r"\b\d{4,7}\b")))
    no = ~n.rlike(r"[a-zA-Z]{2,}") | n.rlike(CLAUSE) | n.contains(";") | n.rlike(r"\.\s+[A-Za-z]") & ~n.rlike(r"^\S+\.\s") | (n.rlike(NARRATIVE) & (words >= 3)) | n.rlike(r"^\p{Ll}|^\d+\s+[a-z]")
    early = major("(?:[3-9]|1\\d|2\\d)") & (F.coalesce("page_start", F.lit(1)) < F.coalesce("second", F.lit(3)))
    rows = rows.withColumn("second", second).withColumn("orphan", orphan & ~bad).withColumn("bad", bad | (~orphan & (no | early)))
    first = F.row_number().over(Window.partitionBy("doc_id", "bad", "orphan", major("1")).orderBy("seq"))
    rows = rows.withColumn("twice", major("1") & (first > 1))
    text = F.col("summary")
    scrubbed = strip(F.regexp_replace(text, r"https?://\S+", ""))
    kept = rows.where(~F.col("bad") & ~F.col("orphan") & ~F.col("twice")).withColumn("summary", F.when(F.lower(text).rlike("doi.org|http"), scrubbed).otherwise(text))
    weak = F.length("summary") < 20
    kept = kept.withColumn("turn", F.when(weak, F.row_number().over(Window.partitionBy("doc_id", weak).orderBy("seq"))))
    given = rows.where(F.col("orphan") & ~F.col("bad") & (F.col("summary") != ""))
    long_name = F.when(words > 14, F.concat_ws(": ", n, text)).otherwise(text)
    given = given.select("doc_id", long_name.alias("gift"), F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")).alias("turn"))
    out = kept.join(given, ["doc_id", "turn"], "left")
    return out.withColumn("summary", F.coalesce("gift", "summary")).select(*sections.columns)


def sort_key(name: Column, page: Column) -> list[Column]:
    """Page, then number parts; abstracts first, unnumbered names last."""
    low = F.lower(strip(name))
    digits = F.split(F.regexp_extract(low, r"^[\d.]*", 0), r"\.", 4)
    number = lambda d, g: F.coalesce(F.get(d, F.lit(g)).try_cast("int"), F.lit(0))
    first = low.isin("abstract", "abstrak", "executive summary", "ringkasan eksekutif")
    place = lambda d: F.when(number(d, 0).between(1, 29), F.struct(number(d, 0).alias("a"), number(d, 1).alias("b"), number(d, 2).alias("c"))).otherwise(F.struct(F.lit(999).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c")))
    # one struct, so that the name is looked at once; structs are ordered field by field
    return [F.coalesce(F.nullif(page, F.lit(0)), F.lit(1)), F.when(first, F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))).otherwise(let(digits, place))]


def page_ends(sections: DataFrame) -> DataFrame:
    """Sections in order with page_end: the page before the next one's start (the same if that is no later), where it is missing or before the start."""
    rows = sections.withColumn("page_start", F.coalesce(F.nullif("page_start", F.lit(0)), F.lit(1)))
    w = Window.partitionBy("doc_id").orderBy(*sort_key(F.col("section_name"), F.col("page_start")), "seq")
    after = F.lead("page_start").over(w)
    end = F.when(after.isNull(), F.col("page_start")).otherwise(F.greatest("page_start", after - 1))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("page_end", F.when(F.col("page_end").isNull() | (F.col("page_end") < F.col("page_start")), end).otherwise(F.col("page_end")))


def take_summaries(found: DataFrame, given: DataFrame) -> DataFrame:
    """Sections found by rule with the summary and key points of the first given section of that name, upper and lower case alike; others keep their own.

    Both: doc_id, seq, section_name, summary, key_points.
    """
    name = F.lower(F.coalesce("section_name", F.lit("")))
    first = given.groupBy("doc_id", name.alias("__name")).agg(F.min_by(F.struct("summary", "key_points"), "seq").alias("__given"))
    rows = found.withColumn("__name", name).join(first, ["doc_id", "__name"], "left")
    take = lambda c: F.when(F.col("__given").isNull(), F.col(c)).otherwise(F.col(f"__given.{c}"))
    return rows.select(*[take(c).alias(c) if c in ("summary", "key_points") else F.col(c) for c in found.columns])


def resolve_pages(headings: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with the names and pages of their headings; unmatched headings are added.

    A heading meets the last section of its number (digits, Roman, or `bab` and a word), else the last one of its name, else the
    first one with which it shares its first 20 characters, or all of the shorter name (of six at least). Of headings that meet one
    section the last counts. headings: doc_id, seq, page, heading. sections: doc_id, seq, section_name, summary, page_start.
    """
    none = lambda c: F.nullif(c, F.lit(""))
    number = lambda c: F.coalesce(none(F.regexp_extract(c, r"^(\d+(?:\.\d+)*)", 1)), none(F.lower(F.regexp_extract(c, r"(?i)^([ivxlcdm]+)\.", 1))), none(F.lower(F.regexp_extract(c, r"(?i)^(bab\s+\w+)", 1))))
    plain = lambda c: F.lower(strip(F.regexp_replace(c, r"^\d+(?:\.\d+)*\.?\s*", "")))
    heading = strip(F.col("heading"))
    h = headings.where(~F.lower(heading).isin(*PLACEHOLDERS)).select("doc_id", F.col("seq").alias("hseq"), F.col("page").alias("hpage"), heading.alias("heading"), number(heading).alias("no"), plain(heading).alias("hname"))
    s = sections.select("doc_id", "seq", number(F.col("section_name")).alias("no"), plain(F.col("section_name")).alias("nm"))
    h, s = stored(h), stored(s)  # four branches and three read them
    by_no = h.join(s.where("no IS NOT NULL").select("doc_id", "no", "seq"), ["doc_id", "no"]).select("doc_id", "hseq", "seq", F.lit(0).alias("p"))
    by_name = h.join(s.select("doc_id", F.col("nm").alias("hname"), "seq"), ["doc_id", "hname"]).select("doc_id", "hseq", "seq", F.lit(1).alias("p"))
    begin = lambda d, c: d.where(F.length(c) > 5).withColumn("six", F.left(F.col(c), F.lit(6)))
    either = F.startswith("hname", F.left(F.col("nm"), F.lit(20))) | F.startswith("nm", F.left(F.col("hname"), F.lit(20)))
    prefix = begin(h, "hname").join(begin(s, "nm").select("doc_id", "six", "nm", "seq"), ["doc_id", "six"]).where(either).select("doc_id", "hseq", "seq", F.lit(2).alias("p"))
    w = Window.partitionBy("doc_id", "hseq").orderBy("p", F.when(F.col("p") < 2, -F.col("seq")).otherwise(F.col("seq")))
    match = by_no.unionByName(by_name).unionByName(prefix).withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "hseq", "seq")
    found = h.join(match, ["doc_id", "hseq"], "left")
    last = found.where("seq IS NOT NULL").groupBy("doc_id", "seq").agg(F.max_by(F.struct("heading", "hpage"), "hseq").alias("h"))
    updated = sections.join(last, ["doc_id", "seq"], "left").select("doc_id", "seq", F.coalesce("h.heading", "section_name").alias("section_name"), "summary", F.coalesce("h.hpage", "page_start").alias("page_start"))
    new = found.where("seq IS NULL").select("doc_id", (F.col("hseq") + 1_000_000).alias("seq"), F.col("heading").alias("section_name"), F.lit("").alias("summary"), F.col("hpage").alias("page_start"))
    return updated.unionByName(new)
