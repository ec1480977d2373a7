from pyspark.sql import functions as F

from scriptorium.functions import bibliography, enrichment, metadata, text, units


def test_strip_markdown(value):
    assert value(text.strip_markdown, "## **Bold** and _it_ <b>x</b> `c` -") == "Bold and it x c"
    assert value(text.strip_markdown, "") == ""


def test_ligatures_and_torn_decimals(value):
    assert value(text.fix_ligatures, "eﬃcient ﬁre 97 .5 and 0. 656") == "efficient fire 97.5 and 0.656"


def test_truncate_marks_the_cut(value):
    assert value(lambda c: text.truncate(c, 3), "abcdef") == "abc" + text.TRUNCATED
    assert value(lambda c: text.truncate(c, 6), "abcdef") == "abcdef"


def test_context_limits(value):
    assert value(text.context_limit, "gemini", "x") == 24000
    assert value(text.context_limit, "ollama", "qwen2.5:1.5b") == 4000
    assert value(text.context_limit, "ollama", "llama3.1:8b") == 14000
    assert value(text.context_limit, "ollama", "qwen2.5:3b") == 8000


def test_abstract_keeps_keywords_within_a_sentence(value):
    got = value(text.clean_abstract, "Received: 1 May 2020\nAccepted: 2 May 2020\nWe search keywords based on rules. It works.\nKeywords: a, b")
    assert got == "We search keywords based on rules. It works."


def test_citation_marks(value):
    assert value(text.strip_citation_marks, "Smith et al.¹² found [3, 4] it") == "Smith et al. found   it"
    assert value(text.strip_citation_marks, "an area of 5 km² here") == "an area of 5 km here"
    assert value(lambda c: text.strip_citation_marks(c, True), "an area of 5 km² here") == "an area of 5 km² here"


def test_title_case_and_spacing(value):
    assert value(text.title_case, "e-methanol r2d2") == "E-Methanol R2D2"
    assert value(text.fix_title_spacing, "THEDEPLOYMENTGAP") == "THE DEPLOYMENT GAP"


def test_redaction_and_names(value):
    assert value(text.redact, "Bearer abc.def sk-12345678901 /home/me/x.pdf") == "Bearer [REDACTED] [REDACTED] [PATH]"
    assert value(text.safe_file_name, "paper (1).pdf") is True
    assert value(text.safe_file_name, "../etc/passwd") is False


def test_languages(value):
    samples = {
        "id": "Penelitian ini adalah untuk hasil yang baik dan dengan metode dari data",
        "en": "The study of the method is for the research and this was in the field",
        "es": "El estudio de la investigación con los resultados para una como este",
        "zh": "本研究提出了一种新的方法用于数据分析",
        "ja": "これはとても良い研究です",
        "ar": "هذه دراسة جديدة حول البيانات",
    }
    for k, v in samples.items():
        assert value(metadata.language, v) == k
    assert value(metadata.language, "") == "id"


def test_dates_by_tier(value):
    assert value(metadata.publication_date, "Copyright: ©2026 x\nAvailable online: 31 March 2026") == "2026-03-31"
    assert value(metadata.publication_date, "Received: 3 Mei 2021") == "2021-05-03"
    assert value(metadata.publication_date, "as in Smith (2019) we show") is None
    assert value(lambda c: metadata.publication_date(F.lit(""), c), "12 Agustus 1987") == "1987-08-12"
    assert value(lambda a, b: metadata.publication_date(a, b), "no year here", "2020-01-02") is None


def test_doi_never_from_references(value):
    assert value(metadata.doi, "Title\nDOI: 10.1234/abc.5.", "x") == "10.1234/abc.5"
    assert value(metadata.doi, "Title", "Body\nReferences\n[1] doi: 10.9999/other") is None


def test_genre_and_publisher(value):
    assert value(metadata.genre, "A doctoral dissertation.\nReferences\nproceedings") == "Thesis"
    assert value(metadata.genre, "Nothing.\nReferences\nPhD thesis") is None
    assert value(metadata.publisher, "Publisher: Acme Press\nElsevier")["name"] == "Acme Press"
    assert value(metadata.publisher, "Journal of Applied Data Systems\n")["inferred"] is True


def test_keywords(value):
    assert value(metadata.keywords, "Keywords: solar cell; fuel cell, biomass\n1. Introduction\nx") == ["solar cell", "fuel cell", "biomass"]
    assert value(metadata.keywords, "No such block") == []


def test_document_id(value):
    assert value(metadata.document_id, "2024-01-02", "A Title: Part 2!", "x.pdf") == "doc:2024-01-02/a-title-part-2"
    assert value(metadata.document_id, "", "", "My File.pdf") == "doc:undated/my-file"


def test_units(value):
    for unit, dim in {"kg": "Mass", "mg/dL": "CompoundDimension", "kWh": "Energy", "€/kWh": "CompoundDimension", "km²": "Area", "GHz": "Frequency", "GWh/year": "CompoundDimension", "Mbps": "DataRate"}.items():
        assert value(units.dimension, unit) == dim, unit
    assert value(units.dimension, "invalidWord") is None
    assert value(lambda c: units.dimension(c, True), "kg") == "MagneticField"
    assert value(lambda c: units.dimension(c, True), "Mbps") is None


def test_unit_table(spark):
    assert units.unit_table(spark).where("unit = 'kg'").first()["dimension"] == "Mass"


def test_references(value):
    joined = "[1] Smith, J. A study of things, 2001 [2] Doe, A. Another study of things, 2002"
    assert value(lambda c: bibliography.unpack(F.array(c)), joined) == ["[1] Smith, J. A study of things, 2001.", "[2] Doe, A. Another study of things, 2002."]
    bio = "[1] Smith, J. A study of things, 2001. JOHN SMITH (Member, IEEE) received the B.S. degree"
    assert "Member" not in value(lambda c: bibliography.unpack(F.array(c)), bio)[0]
    text_ = "Smith, J. (2001). A long title of a study in a journal.\nDoe, A. (2002). Another long title of a\nstudy in a journal, 12-14."
    assert len(value(bibliography.references, text_)) == 2


def test_reference_reconciliation(spark):
    df = spark.createDataFrame([(["A wholly other reference, 1999."], ["one reference, 2001", "two references, 2002"])], ["p", "f"])
    got = df.select(bibliography.reconcile(F.col("p"), F.col("f")).alias("x")).first()["x"]
    assert got == ["one reference, 2001", "two references, 2002", "A wholly other reference, 1999."]


def test_model_answers():
    assert enrichment.repair_json('```json\n{title: "A", "list": [1, 2,],}\n```') == {"title": "A", "list": [1, 2]}
    assert enrichment.repair_json('{"a": {"b": "c') == {"a": {"b": "c"}}
    assert enrichment.repair_json("no json") is None


def test_endpoints():
    assert enrichment.endpoint_is_safe("https://api.example.com/v1")
    for url in ("http://127.0.0.1", "http://169.254.169.254/latest", "http://10.0.0.1", "http://100.64.1.1", "file:///etc/passwd", "http://x.local"):
        assert not enrichment.endpoint_is_safe(url)


def test_synonyms(spark):
    df = spark.createDataFrame([('{"headline": "T"}',), ("broken",)], ["j"])
    assert [r["t"] for r in df.select(enrichment.field(F.col("j"), "title").alias("t")).collect()] == ["T", None]
