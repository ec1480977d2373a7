"""Knowledge graphs: nodes and edges, health, authority records, contradictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens, worded
from scriptorium.operators.overlap import overlapping
from scriptorium.session import stored

#: Relation types; others count as the last.
RELATIONS = ("causes", "requires", "contradicts", "supports", "contains", "precedes", "similar_to", "derived_from", "instance_of", "influences")
#: Words of opposite meaning, English and Indonesian.
ANTONYMS = {
    "increase": "decrease", "improve": "worsen", "enable": "disable", "create": "destroy", "support": "oppose", "accelerate": "decelerate", "strengthen": "weaken",
    "expand": "contract", "advance": "retreat", "cause": "prevent", "require": "exclude", "allow": "forbid", "faster": "slower", "better": "worse", "higher": "lower",
    "more": "less", "above": "below", "before": "after", "growth": "decline", "positive": "negative",
    "meningkat": "menurun", "kenaikan": "penurunan", "pertumbuhan": "kontraksi", "mempercepat": "memperlambat", "memperkuat": "memperlemah", "mendukung": "menentang",
    "positif": "negatif", "untung": "rugi", "surplus": "defisit", "ekspansi": "resesi", "menaikkan": "menurunkan", "optimal": "buruk", "berhasil": "gagal",
}
#: Words that deny, and words that weigh one thing against another.
NEGATIONS = ("not", "never", "no", "none", "doesn't", "cannot", "can't", "without", "fails to", "lack", "lacks", "absence", "tidak", "bukan", "tanpa", "gagal", "tak", "belum", "tiada", "kehilangan")
TRADE_OFFS = ("while", "whereas", "sedangkan", "namun", "tetapi", "trade-off", "tradeoff", "balance", "membandingkan", "compared", "compares", "compare", "despite", "although", "walaupun", "meskipun")
NEGATION, TRADE_OFF = worded(*NEGATIONS), worded(*TRADE_OFFS)


def relation(kind: Column) -> Column:
    low = F.lower(kind)
    return F.when(low.isin(*RELATIONS), low).otherwise("influences")


def health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, n_nodes, n_edges, n_orphans, density, connectivity, score. nodes: doc_id, node_id; edges: doc_id, src, dst."""
    ends = edges.select("doc_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct().withColumn("linked", F.lit(1))
    n = nodes.select("doc_id", "node_id").distinct().join(ends, ["doc_id", "node_id"], "left")
    n = n.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count(F.when(F.col("linked").isNull(), 1)).alias("n_orphans"))
    e = edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    out = n.join(e, "doc_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    size = F.col("n_nodes").cast("double")
    return out.select(
        "doc_id",
        "n_nodes",
        "n_edges",
        "n_orphans",
        F.when(F.col("n_nodes") > 1, F.bround(F.col("n_edges") / (size * (size - 1)), 4)).otherwise(0.0).alias("density"),
        F.when(F.col("n_nodes") > 0, F.bround(F.col("n_edges") / size, 2)).otherwise(0.0).alias("connectivity"),
        F.greatest(F.lit(0.0), F.bround(1 - 0.5 * F.col("n_orphans") / size, 2)).alias("score"),
    )


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select("doc_id", F.col("src").alias("node_id")).unionByName(edges.select("doc_id", F.col("dst").alias("node_id")))
    return nodes.join(ends, ["doc_id", "node_id"], "left_anti")


def resolve(rows: DataFrame, text: str, dimension: DataFrame, key: list[str], longest: int = 6, exact_first: bool = False) -> DataFrame:
    """The dimension's record of least priority whose pattern stands in the text as words; rows without one go.

    Word n-grams of the text (up to the longest pattern) are joined by equality with the patterns, instead of each row with
    each pattern. exact_first: a pattern that is the whole text comes before others.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_.\-]+"), lambda w: w != "")
    clean = F.transform(words, lambda w: F.regexp_replace(w, r"^[.\-]+|[.\-]+$", ""))
    spans = [_grams(n) for n in range(1, longest + 1)]
    grams = rows.withColumn("w", clean).select(*key, F.lower(F.trim(F.col(text))).alias("__whole"), F.explode(F.array_distinct(F.flatten(F.array(*spans)))).alias("__gram"))
    known = dimension.withColumn("__gram", F.array_join(F.filter(F.split("pattern", r"[^\p{L}\p{N}_.\-]+"), lambda w: w != ""), " "))
    met = grams.join(known, "__gram")
    order = [F.when(F.col("pattern") == F.col("__whole"), 0).otherwise(1)] if exact_first else []
    w = Window.partitionBy(*key).orderBy(*order, "priority")
    return met.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__gram", "__whole")


def _grams(n: int) -> Column:
    at = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))


def enrich(nodes: DataFrame, institutions: DataFrame, concepts: DataFrame) -> DataFrame:
    """nodes with same_as extended by authority addresses (organisations: ROR; all: Wikidata and MeSH); what was there stays, nothing twice."""
    key = ["doc_id", "node_id"]
    orgs = nodes.where(F.lower("type").rlike("organi[sz]ation|university|institut"))
    ror = resolve(orgs, "label", institutions, key).select(*key, F.array(F.concat(F.lit("https://ror.org/"), F.col("ror"))).alias("a"))
    wiki = resolve(nodes, "label", concepts, key, exact_first=True)
    wiki = wiki.select(*key, F.array_compact(F.array(F.concat(F.lit("https://www.wikidata.org/wiki/"), F.col("wikidata")), F.concat(F.lit("https://meshb.nlm.nih.gov/record/ui?ui="), F.col("mesh")))).alias("b"), "domain")
    empty = F.array().cast("array<string>")
    out = nodes.join(ror, key, "left").join(wiki, key, "left")
    return out.withColumn("same_as", F.array_union(F.array_union(F.coalesce("same_as", empty), F.coalesce("a", empty)), F.coalesce("b", empty))).drop("a", "b")


def claims_with_words(claims: DataFrame) -> DataFrame:
    """doc_id, seq, tag, text with words (distinct, four letters or more)."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\b([a-z]{4,})\b"), 1))
    return claims.withColumn("words", words)


def _opposites() -> dict[str, list[str]]:
    """Each word with its opposites, both ways."""
    out: dict[str, list[str]] = {}
    for a, b in ANTONYMS.items():
        out.setdefault(a, []).append(b)
        out.setdefault(b, []).append(a)
    return {w: sorted(set(v)) for w, v in out.items()}


#: Words that name parts of a document, and so say nothing of what claims have in common.
PARTS_OF_DOCUMENTS = ("metric", "section", "table", "document")


def opposed_claims(claims: DataFrame) -> DataFrame:
    """doc_id, seq, own, against, words, nexts, head, last, trade of the claims that have words with opposites, each found once a claim.

    own: such words; against: their opposites; nexts: by word the one of three letters or more behind it, where it stands
    first before such a word; head and last: the first word and the last; trade: whether the claim weighs things.
    """
    pairs = _opposites()
    table = F.create_map(*[c for w, o in pairs.items() for c in (F.lit(w), F.array(*[F.lit(x) for x in o]))])
    low = F.lower("text")
    own = F.array_intersect(F.array_distinct(tokens(F.col("text"))), F.array(*[F.lit(w) for w in pairs]))
    c = claims.select("doc_id", "seq", low.alias("low"), own.alias("own")).where(F.size("own") > 0)
    ws = F.filter(F.split("low", r"\s+"), lambda w: w != "")
    c = c.select("*", ws.alias("ws"), F.array_distinct(F.regexp_extract_all("low", F.lit(r"\b([a-z]{4,})\b"), 1)).alias("words"))
    bare = F.transform("ws", lambda w: F.regexp_replace(w, r"^[^a-z0-9_]+", ""))
    heads = F.transform("ws", lambda w: F.regexp_extract(w, "^([a-z]{3,})", 1))
    steps = F.zip_with(F.slice(bare, 1, F.size("ws") - 1), F.slice(heads, 2, F.size("ws")), lambda w, n: F.struct(w.alias("w"), n.alias("n")))
    steps = F.when(F.size("ws") > 1, steps)
    firsts = F.transform("own", lambda w: F.get(F.filter("steps", lambda s: (s["w"] == w) & (s["n"] != "")), F.lit(0))["n"])
    c = c.select("*", steps.alias("steps"), F.get(heads, F.lit(0)).alias("head"), F.element_at(bare, -1).alias("last"))
    return c.select(
        "doc_id", "seq", "own",
        F.array_distinct(F.flatten(F.transform("own", lambda w: table[w]))).alias("against"),
        F.array_except("words", F.array(*[F.lit(w) for w in PARTS_OF_DOCUMENTS])).alias("words"),
        F.map_from_arrays("own", firsts).alias("nexts"), F.coalesce("head", F.lit("")).alias("head"), F.coalesce("last", F.lit("")).alias("last"),
        F.col("low").rlike(TRADE_OFF).alias("trade"),
    )


def antonym_conflicts(claims: DataFrame, least_shared: int = 4) -> DataFrame:
    """doc_id, seq_a, seq_b, word, antonym, shared: claims of a document (a before b) with opposite words and four other words in common, trade-offs aside.

    claims: doc_id, seq, tag, text; doc_id and seq tell claims apart. Only claims that have a word with an opposite take part; they meet
    by their rarest common words, if one has what the other has the opposite of, and pairs that can't reach the number of common
    words never arise. What follows a word is found once a claim.
    """
    c = stored(opposed_claims(claims)).where("not trade")
    met = overlapping(c, least_shared, F.arrays_overlap("a.against", "b.own"), ["own", "against"])
    side = lambda x: c.select("doc_id", F.col("seq").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in ("own", "against", "nexts", "head", "last")])
    met = met.join(side("a").hint("merge"), ["doc_id", "a"]).join(side("b").hint("merge"), ["doc_id", "b"])
    opposite = F.create_map(*[x for w, o in _opposites().items() for x in (F.lit(w), F.array(*[F.lit(y) for y in o]))])
    met = met.withColumn("word", F.explode("a_own")).withColumn("antonym", F.explode(F.array_intersect(opposite[F.col("word")], F.col("b_own"))))

    def behind(w: Column) -> Column:
        """The word behind w in both claims as one text."""
        over = F.when((F.col("a_last") == w) & (F.col("b_head") != ""), F.col("b_head"))
        return F.coalesce(F.try_element_at("a_nexts", w), over, F.try_element_at("b_nexts", w), F.lit(""))

    a, b = behind(F.col("word")), behind(F.col("antonym"))
    other = (a != "") & (b != "") & ~a.contains(b) & ~b.contains(a)
    shared = F.array_except("shared", F.array("word", "antonym"))
    out = met.withColumn("shared", shared).where((F.size("shared") >= least_shared) & ~other)
    return out.select("doc_id", F.col("a").alias("seq_a"), F.col("b").alias("seq_b"), "word", "antonym", "shared")


def negation_conflicts(sections: DataFrame, least_shared: int = 4) -> DataFrame:
    """doc_id, seq_a, seq_b, n_shared: sections of a document of which one denies and one affirms, with four words in common.

    doc_id and seq tell sections apart. Sections meet by their rarest common words, as claims do.
    """
    c = stored(claims_with_words(sections).select("doc_id", "seq", "words", F.lower("text").rlike(NEGATION).alias("negative")))
    met = overlapping(c, least_shared, F.col("a.negative") != F.col("b.negative"), ["negative"])
    return met.select("doc_id", F.col("a").alias("seq_a"), F.col("b").alias("seq_b"), F.size("shared").cast("long").alias("n_shared"))
