"""Text functions, column to column. Patterns are Java's; `(?U)` where white space or words are Unicode."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures of PDF fonts.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
#: Fixed value: what a parser puts before table chunks.
TABLE_PREFIX = "DATA TABEL / METRIK SPESIFIK:"
#: Fixed value: what stands after a cut context.
TRUNCATED = "\n[...konteks dipotong...]"
#: Nouns that run into the word before them in titles.
TITLE_NOUNS = ("GAP", "MODEL", "SYSTEM", "STUDY", "REVIEW", "ANALYSIS", "FRAMEWORK", "APPROACH", "OPTIMIZATION", "ALGORITHM", "ARCHITECTURE")
#: Scalars that stand for nothing.
PLACEHOLDERS = ("null", "none", "undated", "unknown", "n/a", "tanpa judul", "untitled")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: within higher-order functions common expressions aren't shared."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Replace by each (pattern, replacement) in turn."""
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


def worded(*phrases: str) -> str:
    """A pattern for any of the phrases as whole words, in any case and with any white space."""
    either = "|".join(re.escape(p).replace("\\ ", r"\s+") for p in phrases)
    return rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{either})(?![\p{{L}}\p{{N}}_])"


def first_true(flags: Column) -> Column:
    """Place (from 1) of the first true in an array of booleans; null without one."""
    return F.nullif(F.array_position(flags, True), F.lit(0).cast("bigint")).cast("int")


#: Unicode's white space, as Java's `(?U)\\s` has it.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column, chars: str | None = None) -> Column:
    """Both ends without Unicode white space, or without the given characters."""
    return F.trim(text, F.lit(WHITE_SPACE if chars is None else chars))


#: What a text holds that strip_markdown changes within it, and what it takes off its ends.
MARKED, EDGES = r"[*_`#~<\t]|  ", " \t\r\n-–—:;"


def strip_markdown(text: Column) -> Column:
    """Fences, paired and stray markers and HTML tags go; runs of spaces become one; edges lose white space and punctuation."""
    steps = (
        (r"```[a-zA-Z]*\n?", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"[*_`#~]+", " "),
        (r"<[^>]+>", ""),
        (r"[ \t]+", " "),
    )
    # a text without a marker, a tag, a tab or two spaces in a row is left as it is by every step
    return strip(let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(MARKED), chain(t, *steps)).otherwise(t)), EDGES)


def fix_ligatures(text: Column) -> Column:
    """Ligatures as letters, and decimals that white space has torn apart."""
    out = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), F.coalesce(text, F.lit("")))
    return chain(out, (r"(\d+)\s+\.\s*(\d+)", "$1.$2"), (r"(\d+)\s*\.\s+(\d+)", "$1.$2"))


def sanitize_for_extraction(text: Column) -> Column:
    out = chain(F.coalesce(text, F.lit("")), (r"DATA TABEL / METRIK SPESIFIK:\s*", ""), (r"(?m)^#+\s*", ""), (r"\*\*([^*]+)\*\*", "$1"))
    return strip(fix_ligatures(out))


def fix_title_spacing(title: Column) -> Column:
    nouns = "|".join(TITLE_NOUNS)
    return strip(chain(F.coalesce(title, F.lit("")), (r"\bTHE([A-Z]{3,})\b", "THE $1"), (rf"\b([A-Z]{{3,}})({nouns})\b", "$1 $2"), (r"(?i)\b(DEPLOYMENT)(GAP)\b", "$1 $2")))


def clean_title(title: Column, authors: Column | None = None) -> Column:
    """A title without quotes, a running head (`NAME et al:`), author names at its end and `by X`. authors: array of names."""

    def headless(out: Column) -> Column:
        head = F.lower(F.rtrim(F.substring_index(out, ":", 1)))
        running = out.contains(":") & (head.endswith("et al") | head.endswith("et al."))
        return F.when(running, strip(F.substring(out, F.instr(out, ":") + 1, F.length(out)))).otherwise(out)

    out = fix_title_spacing(let(strip(strip_markdown(title), "\"'"), headless))
    # whatever joins a name to the title goes with it
    bare = lambda t: strip(F.regexp_replace(t, r"(?i)(?:[\s,&–—-]|\b(?:by|and)\b)+$", ""))

    def without(t: Column, name: Column) -> Column:
        n = strip(name)
        return F.when((F.length(n) > 3) & F.lower(t).endswith(F.lower(n)), bare(F.left(t, F.length(t) - F.length(n)))).otherwise(t)

    if authors is not None:
        out = F.aggregate(F.coalesce(authors, F.array().cast("array<string>")), out, without)
    return strip(F.regexp_replace(out, r"\s+by(?:\s+\p{Lu}[\p{L}.]*)+$", ""))


#: What a line of front matter begins with, and headings that end an abstract.
FRONT_WORDS = ("copyright", "received", "revised", "accepted", "published", "available online", "license", "open access", "cc by", "diterbitkan", "doi", "http", "https", "volume", "volumen", "vol", "no")
FRONT_SIGNS = ("©", "(c)", "nº")
ABSTRACT_WORDS = ("abstract", "abstrak", "ringkasan eksekutif", "ringkasan")
KEYWORD_LABELS = ("keywords", "keyword", "key words", "key word", "index terms", "index term", "kata kunci", "palabras clave")
OPENING_SECTIONS = ("introduction", "pendahuluan", "section 1")


def clean_abstract(text: Column) -> Column:
    """An abstract without what stands before it (its heading, rights, dates, stacked header lines of 90 characters at most) and after it (keywords, introduction), line by line."""
    lines = F.transform(F.split(strip_markdown(text), "\n"), lambda x: strip(F.regexp_replace(x, r"^#+", "")))
    heading = worded(*ABSTRACT_WORDS)

    def opened(lines: Column, at: Column) -> Column:
        rest = F.transform(F.slice(lines, F.coalesce(at, F.lit(1)), F.size(lines)), lambda x, i: F.when(i == 0, strip(F.regexp_replace(x, rf"^(?:{heading}[\s:.*#–—-]*)+", ""))).otherwise(x))
        return F.when(at.isNotNull(), rest).otherwise(lines)

    signs = "|".join(re.escape(x) for x in FRONT_SIGNS)
    dated = r"^(?:\p{L}{3,9}\.?\s\d{1,2},?\s\d{4}|\d{4}-\d\d-\d\d|\d{1,2}\s\p{L}{3,9}\s\d{4})$"
    front = lambda x: (x == "") | ((F.length(x) <= 90) & (x.rlike("^" + worded(*FRONT_WORDS)) | x.rlike(f"(?i)^(?:{signs})") | x.rlike(dated)))
    begun = lambda lines: let(first_true(F.transform(lines, lambda x: ~front(x))), lambda begin: F.when(begin <= 9, F.slice(lines, F.coalesce(begin, F.lit(1)), F.size(lines))).otherwise(lines))
    number = r"^(?:\d{1,2}\.?\s+|[IVX]+\.\s+|BAB\s+[IVX\d]+\W*)?"
    ends = lambda x: x.rlike(rf"^{worded(*KEYWORD_LABELS)}\s*[:–—-]") | x.rlike(number + worded(*OPENING_SECTIONS)) | x.rlike(r"^BAB\s+[IVX\d]+")
    ended = lambda lines: let(first_true(F.transform(lines, ends)), lambda stop: F.when(stop.isNotNull(), F.slice(lines, F.lit(1), stop - 1)).otherwise(lines))
    lines = let(lines, lambda x: let(first_true(F.transform(x, lambda y: y.rlike("^" + heading))), lambda at: opened(x, at)))
    return strip(F.array_join(let(let(lines, begun), ended), "\n"))


#: What only formulas hold.
TEX_COMMANDS = ("\\hat", "\\frac", "\\sum", "\\prod", "\\int", "\\leq", "\\geq", "\\approx", "\\equiv")
OPERATORS = ("argmax", "argmin")
OPERATOR_CALLS = ("Pr(", "E[")


def is_formula(text: Column) -> Column:
    """Whether a line is an equation and no data: operators, a chain of equalities, a letter's exponent, or a one-letter function or index."""
    held = [text.contains(x) for x in (*TEX_COMMANDS, *OPERATOR_CALLS)]
    chain_of = F.exists(F.slice(F.split(text, "="), 2, F.greatest(F.size(F.split(text, "=")) - 2, F.lit(0))), lambda x: strip(x) != "")
    letter = r"(?<!\p{L})"
    shapes = [rf"{letter}[fghpqFGHPQ]\([\w\s,=|+^ˆ-]+\)", r"[\^ˆ]\p{L}", rf"{letter}[xyzXYZ]\s?[nN_]\s?(?:[+-]\s?)?\d*(?!\p{{L}})", rf"{letter}[pqPQ][kmn]\s*[+-]\s*e[ikIK0-9](?!\p{{L}})", worded(*OPERATORS)]
    return F.coalesce(reduce(lambda a, b: a | b, [*held, chain_of, *(text.rlike(x) for x in shapes)]), F.lit(False))


def context_limit(provider: Column, model: Column) -> Column:
    """Characters of context that a model takes."""
    p, m = F.lower(F.coalesce(provider, F.lit("ollama"))), F.lower(F.coalesce(model, F.lit("")))
    return F.when(p.isin("gemini", "openai", "groq", "openrouter", "deepseek"), 24000).when(m.rlike(r"1\.5b|0\.5b"), 4000).when(m.rlike("7b|8b|14b"), 14000).otherwise(8000)


def truncate(text: Column, limit: Column | int) -> Column:
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, limit), F.lit(TRUNCATED)))


def strip_citation_marks(text: Column, preserve_exponents: bool = False) -> Column:
    """Bracket citations become a space; superscript digits after a letter, dot or comma go (exponents of units too, unless preserved)."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[\s*\d+\s*(?:[,\-–—]\s*\d+\s*)*\]", " ")
    before = r"(?<=[A-Za-z]{3}|[.,])" if preserve_exponents else r"(?<=[A-Za-z.,])"
    return F.regexp_replace(out, before + r"[¹²³⁴⁵⁶⁷⁸⁹⁰]+(?:[,\-–—][¹²³⁴⁵⁶⁷⁸⁹⁰]+)*(?=[^\p{L}\p{N}_]|$)", "")


def slug(text: Column, most: int = 50) -> Column:
    out = strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "-"), "-")
    return F.regexp_replace(F.left(out, F.lit(most)), "-+$", "")


def redact(message: Column) -> Column:
    """Keys, bearer tokens and file paths out of a message."""
    return chain(
        F.coalesce(message, F.lit("")),
        (r"(?i)bearer\s+[A-Za-z0-9._\-]+", "Bearer [REDACTED]"),
        (r"sk-[A-Za-z0-9_\-]{8,}", "[REDACTED]"),
        (r"AIza[A-Za-z0-9_\-]{10,}", "[REDACTED]"),
        (r"gsk_[A-Za-z0-9]{8,}", "[REDACTED]"),
        (r"[A-Za-z]:\\[^\s\"']+", "[PATH]"),
        (r"/(?:home|root|usr|var|tmp|etc|opt|Users)/[^\s\"']+", "[PATH]"),
    )


def safe_file_name(name: Column) -> Column:
    """Whether an upload's name is plain: no folders, no `..`, no odd characters."""
    return F.coalesce(name.rlike(r"^[\w\-. ()+,&\[\]]+$") & ~name.contains("..") & ~name.contains("/") & ~name.contains("\\"), F.lit(False))


def attachment_name(name: Column) -> Column:
    out = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._\-]+", "_")
    return F.when(strip(out, "_.") == "", F.lit("document")).otherwise(strip(out, "_"))


def escape_html(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), F.coalesce(text, F.lit("")))


def escape_literal(text: Column) -> Column:
    """For Turtle and Cypher strings in double quotes."""
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), F.coalesce(text, F.lit("")))


def is_valid_scalar(value: Column) -> Column:
    return value.isNotNull() & (strip(value) != "") & ~F.lower(strip(value)).isin(*PLACEHOLDERS)


def title_case(text: Column) -> Column:
    """Each run of letters begins in upper case and goes on in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substring(r, 2, 1 << 30)))), "")


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
