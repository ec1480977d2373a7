"""Authors of a first page, with their affiliations and ORCIDs.

The lines up to the abstract are labelled together: each line says how much it looks like a title or prose, names,
affiliations, an address (e-mail, ORCID, link) or a note, labels say what may follow what, and the best sequence is found by
dynamic programming. Then names are met with affiliations by their footnote marks, or where there are none by place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import strip

LABELS = ("prose", "names", "affiliation", "address", "note")
#: What a label costs after another one (rows: before), from what title pages look like.
STEPS = (
    (0.0, 0.3, 0.8, 1.2, 1.0),
    (1.2, 0.2, 0.0, 0.3, 0.4),
    (1.5, 0.4, 0.0, 0.2, 0.3),
    (1.5, 0.4, 0.3, 0.0, 0.3),
    (1.0, 1.0, 0.5, 0.3, 0.0),
)
#: A page begins with its title, or what a journal prints above it.
BEGINS = (0.0, 1.2, 1.2, 1.5, 0.8)
END = r"(?i)^(?:#+\s*)?(?:abstra[ck]t|keywords?|kata\s+kunci|(?:(?:1|I)[.:]?\s+)?(?:introduction|pendahuluan)|(?:1|I)[.:]\s+\p{L})"
PLACES = r"(?i)universit|institut|\b(?:departe?ment|faculty|fakultas|laborator(?:y|ies|ium)|lab|school|academy|akademi|cent(?:er|re)|college|hospital|jurusan|politeknik|polytechnic|corporation|inc\.|ltd)\b"
ADDRESS = r"(?i)@|https?:|www\.|\borcid\b|\bdoi\b|^arxiv"
NOTE = r"(?i)\bcorrespond|\bequal(?:ly)?\s+contribut|\bmembers?\s+of\b|\breceived\b|\baccepted\b|\bcopyright\b|\bpublished\b|©|^(?:vol\b|vol\.|volume|issn|journal)"
MARK = r"\d+|[∗*†‡§¶#]|[¹²³⁴⁵⁶⁷⁸⁹⁰]+"
MEMBER = r"(?i),?\s*\b(?:(?:graduate\s+)?student\s+|senior\s+|life\s+)?(?:member|fellow)\b(?:\s*,?\s*(?:IEEE|ACM|IET|AAAI)\b)?"
TITLES = r"(?i)^(?:prof|dr|ir|mr|mrs|ms)\.\s*"
DEGREES = r"(?i),\s*(?:ph\.?\s?d|m\.?\s?sc|m\.?\s?t|s\.?\s?t|m\.?\s?eng|b\.?\s?sc)\b\.?"
PERSON = r"^\p{Lu}[\p{L}.'’\-]*(?:\s+(?:\p{Lu}[\p{L}.'’\-]*|de|del|da|di|van|von|der|den|bin|binti|al|el|la|le)){1,4}$"
ORCID = r"(?i)(?:orcid(?:\.org/|:?\s*))?\b(\d{4}-\d{4}-\d{4}-\d{3}[\dX])\b"


def _folded(x: Column) -> Column:
    """Superscript digits as digits."""
    return F.translate(x, "¹²³⁴⁵⁶⁷⁸⁹⁰∗", "1234567890*")


def parts_of(line: Column) -> Column:
    """The names that a line may hold, still with their marks: parted by commas, semicolons and words for `and`, but not between marks."""
    plain = F.regexp_replace(F.regexp_replace(_folded(line), MEMBER, ""), DEGREES, "")
    plain = F.regexp_replace(plain, r"(?<=[\d*†‡§¶#])\s*,\s*(?=[\d*†‡§¶#](?:[\s,*†‡§¶#\d]|$))", "+")
    bits = F.split(plain, r"\s*(?:,|;|&|\band\b|\bdan\b|\bund\b)\s*")
    return F.filter(F.transform(bits, lambda b: strip(b)), lambda b: b != "")


def name_of(part: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(part, ORCID, ""), r"[\d*†‡§¶#+\^()\[\]]", " ")
    return F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(strip(bare), TITLES, ""), r"\s+", " ")), r"[,.;]+$", "")


def is_name(part: Column) -> Column:
    return let(name_of(part), lambda n: n.rlike(PERSON) & (F.length(n) <= 45) & n.rlike(r"\p{L}{2,}"))


def marks_of(part: Column) -> Column:
    return F.regexp_extract_all(_folded(F.regexp_replace(part, ORCID, "")), F.lit(r"(\d+|[*†‡§¶#])"), 1)


def scores(line: Column) -> Column:
    """How well a line fits each label, as an array in their order."""
    # what several labels look at is found once
    names = let(parts_of(line), lambda parts: F.struct((F.size(F.filter(parts, is_name)) / F.greatest(F.size(parts), F.lit(1))).alias("named"), F.size(parts).alias("n")))
    return let(F.struct(names.alias("names"), line.rlike(PLACES).alias("place"), line.rlike(ADDRESS).alias("address"), line.rlike(NOTE).alias("note")), lambda f: _scores(line, f))


def _scores(line: Column, f: Column) -> Column:
    named, place, address, note = f["names"]["named"], f["place"], f["address"], f["note"]
    words = F.size(F.split(strip(line), r"\s+"))
    number = lambda ok, yes, no: F.when(ok, F.lit(yes)).otherwise(F.lit(no))
    listed = number((f["names"]["n"] > 1) & (named == 1), 1.0, 0.0)
    marked = number(line.rlike(r"\p{L}(?:\s?(?:" + MARK + r"))+(?:,|\s|$)"), 0.5, 0.0)
    lead = number(line.rlike(r"^\s*[(\[]?(?:\d+|[*†‡§¶#])[)\]]?\s*\p{Lu}"), 0.5, 0.0)
    return F.array(
        F.lit(0.6) + number(words > 8, 0.8, 0.0) + number(line.rlike(r"(?i)\b(?:of|for|the|in|on|with|towards?|using|pada|untuk|dalam|terhadap)\b"), 0.7, 0.0) - number(place | address | note, 1.5, 0.0),
        2.0 * named - 1.0 + listed + F.when(named == 1, marked).otherwise(0.0) - number(place | note, 2.0, 0.0) - number(address & ~line.rlike(ORCID), 2.0, 0.0),
        number(place, 2.0, -1.0) + lead - number(note, 1.0, 0.0) - number(address & ~place, 1.0, 0.0),
        number(address, 2.0, -1.5) - number(named == 1, 1.0, 0.0),
        number(note, 2.0, -1.5),
    )


def labelled(lines: Column, most: int = 25) -> Column:
    """The label (its number) of each line up to the abstract, `most` lines at most: the best sequence by dynamic programming over the lines."""
    return _best(F.transform(head_lines(lines, most), scores))


def _best(own: Column) -> Column:
    n = len(LABELS)
    table = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in STEPS])
    begins = F.array(*[F.lit(float(x)) for x in BEGINS])
    kinds = F.sequence(F.lit(0), F.lit(n - 1))
    none = F.struct(F.array().cast("array<double>").alias("best"), F.array().cast("array<array<int>>").alias("path"))

    def step(state: Column, own: Column) -> Column:
        """state: the best score of a sequence that ends with each label, and the sequence; own: the scores of the next line."""
        first = F.struct(F.transform(kinds, lambda k: own[k] - begins[k]).alias("best"), F.transform(kinds, lambda k: F.array(k)).alias("path"))
        came = F.transform(kinds, lambda k: F.array_max(F.transform(kinds, lambda j: F.struct((state["best"][j] - table[j][k]).alias("s"), (-j).alias("j")))))
        best = lambda came: F.zip_with(came, kinds, lambda c, k: c["s"] + own[k])
        path = lambda came: F.zip_with(came, kinds, lambda c, k: F.concat(state["path"][-c["j"]], F.array(k)))
        return F.when(F.size(state["best"]) == 0, first).otherwise(let(came, lambda came: F.struct(best(came).alias("best"), path(came).alias("path"))))

    end = lambda s: F.when(F.size(s["best"]) > 0, F.get(s["path"], (F.array_position(s["best"], F.array_max(s["best"])) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(own, none, step, end)


def head_lines(lines: Column, most: int = 25) -> Column:
    """Lines that aren't blank, up to an abstract, keywords or a first section."""
    ls = F.filter(F.transform(lines, lambda x: strip(x)), lambda x: x != "")
    stop = F.array_position(F.transform(ls, lambda x: x.rlike(END)), True).cast("int")
    return F.slice(F.when(stop > 0, F.slice(ls, F.lit(1), stop - 1)).otherwise(ls), 1, most)


def affiliations_of(line: Column) -> Column:
    """array of struct(mark, name): a line may hold several, each after its mark."""
    cut = F.split(_folded(line), r"\s*[;,.]?\s+(?=[(\[]?(?:\d{1,2}|[*†‡§¶#])[)\]]?\s*\p{Lu}\p{L})")
    one = lambda x: F.struct(
        F.nullif(F.regexp_extract(x, r"^\s*[(\[]?(\d{1,2}|[*†‡§¶#])[)\]]?\s*(?=\p{L})", 1), F.lit("")).alias("mark"),
        F.regexp_replace(strip(F.regexp_replace(x, r"^\s*[(\[]?(?:\d{1,2}|[*†‡§¶#])[)\]]?\s*(?=\p{L})", "")), r"[,;]+$", "").alias("name"),
    )
    return F.filter(F.transform(cut, one), lambda a: a["name"] != "")


def authors(first_page: Column) -> Column:
    """array of struct(name, affiliations, orcid) in the order of the page, each name once.

    An author's affiliations are those with one of its marks. Where an author has no mark, or no affiliation has it, they are
    the ones without a mark that stand below its line before further names; if there are none, the ones below all names; the
    lines above names don't count. An ORCID belongs to the name in whose part or line it stands alone; else the ORCIDs of the
    page go to its authors in order if there are as many.
    """
    lines = head_lines(F.split(F.coalesce(first_page, F.lit("")), "\n"))
    # each is computed once and read by what follows: an array around it binds it as a variable of the function
    return let(let(lines, lambda ls: F.struct(ls.alias("ls"), _best(F.transform(ls, scores)).alias("ks"))), _authors)


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _authors(page: Column) -> Column:
    rows = F.zip_with(page["ls"], page["ks"], lambda x, k: F.struct(x.alias("x"), k.alias("k")))
    rows = F.transform(rows, lambda r, i: F.struct(r["x"].alias("x"), r["k"].alias("k"), i.alias("i")))
    kind = lambda name: (lambda r: r["k"] == LABELS.index(name))
    people = F.flatten(F.transform(F.filter(rows, kind("names")), lambda r: F.transform(F.filter(parts_of(r["x"]), is_name), lambda p: F.struct(name_of(p).alias("name"), marks_of(p).alias("marks"), F.nullif(F.regexp_extract(p, ORCID, 1), F.lit("")).alias("orcid"), r["i"].alias("i")))))
    people = F.filter(people, lambda p: F.length(p["name"]) > 0)
    places = F.flatten(F.transform(F.filter(rows, kind("affiliation")), lambda r: F.transform(affiliations_of(r["x"]), lambda a: F.struct(a["mark"].alias("mark"), a["name"].alias("name"), r["i"].alias("i")))))
    orcids = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.regexp_extract_all(r["x"], F.lit(ORCID), 1))))
    return let(F.struct(people.alias("people"), places.alias("places"), orcids.alias("orcids")), _met)


def _met(found: Column) -> Column:
    people, places = found["people"], found["places"]
    names = lambda xs: F.array_distinct(F.transform(xs, lambda a: a["name"]))

    def affiliations(p: Column) -> Column:
        by_mark = F.filter(places, lambda a: a["mark"].isNotNull() & F.array_contains(p["marks"], a["mark"]))
        below = F.filter(places, lambda a: a["mark"].isNull() & (a["i"] > p["i"]))
        next_names = F.array_min(F.transform(F.filter(people, lambda q: q["i"] > p["i"]), lambda q: q["i"]))
        own = F.filter(below, lambda a: next_names.isNull() | (a["i"] < next_names))
        return F.when(F.size(by_mark) > 0, names(by_mark)).when(F.size(own) > 0, names(own)).otherwise(names(below))

    def orcid(p: Column, i: Column) -> Column:
        in_order = F.when(F.size(found["orcids"]) == F.size(people), F.get(found["orcids"], i))
        return F.coalesce(p["orcid"], in_order)

    rows = F.transform(people, lambda p, i: F.struct(p["name"].alias("name"), affiliations(p).alias("affiliations"), F.concat(F.lit("https://orcid.org/"), F.upper(orcid(p, i))).alias("orcid")))
    seen = F.transform(people, lambda p: F.lower(p["name"]))
    return F.filter(F.transform(rows, lambda r, i: F.struct(r.alias("r"), (F.array_position(seen, F.lower(r["name"])) - 1 == i).alias("first"))), lambda x: x["first"])["r"]
