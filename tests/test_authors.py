import pytest

from scriptorium.functions import authors

COMMON = """Selective State Spaces for Long Sequences
of Measurements

Albert Gu*1 and Tri Dao†1,2, Senior Member, IEEE
1 Machine Learning Department, Carnegie Mellon University
2 Department of Computer Science, Princeton University
agu@cs.cmu.edu, tri@tridao.me
* Corresponding author

Abstract
Foundation models. Anna Prosa and Otto Text, University of Nowhere, are not authors."""
BELOW = """Decentralised Composting in Cities
Maria de Souza
Universidade Federal do Rio, Institute of Biology
maria@ufrj.br
Hans van der Berg
Technical University of Delft
hans@tudelft.nl
Keywords: compost"""
SHARED = """JOURNAL OF WATER, Vol. 12, 2024
Kajian Kualitas Air pada Sungai Kapuas
Hafiz Adianto1, Fitri Imansyah², S. Kortmann
Universitas Tanjungpura, Pontianak
https://orcid.org/0000-0002-1825-0097
Received: 3 May 2024
ABSTRAK
Teks."""
ORCIDS = """A Short Title
Ana Lima (ORCID: 0000-0001-0000-0001), Jo Ek (0000-0002-0000-000x)
1 University of A
Abstract x"""
SEMICOLONS = """On the Growth of Reeds
Dr. Ines Alvarez; Prof. Karl Maria Weber, Ph.D.
Faculty of Forestry, University of Zagreb"""


def found(value, text):
    return [(a["name"], a["affiliations"], a["orcid"]) for a in value(authors.authors, text)]


def test_marks_lead_to_affiliations(value):
    cmu, princeton = "Machine Learning Department, Carnegie Mellon University", "Department of Computer Science, Princeton University"
    assert found(value, COMMON) == [("Albert Gu", [cmu], None), ("Tri Dao", [cmu, princeton], None)]


def test_affiliations_below_each_name(value):
    assert found(value, BELOW) == [("Maria de Souza", ["Universidade Federal do Rio, Institute of Biology"], None), ("Hans van der Berg", ["Technical University of Delft"], None)]


def test_one_affiliation_for_all_and_an_orcid_of_nobody_in_particular(value):
    here = ["Universitas Tanjungpura, Pontianak"]
    assert found(value, SHARED) == [("Hafiz Adianto", here, None), ("Fitri Imansyah", here, None), ("S. Kortmann", here, None)]


def test_orcids_and_titles(value):
    assert [(n, o) for n, _, o in found(value, ORCIDS)] == [("Ana Lima", "https://orcid.org/0000-0001-0000-0001"), ("Jo Ek", "https://orcid.org/0000-0002-0000-000X")]
    assert [(n, a) for n, a, _ in found(value, SEMICOLONS)] == [("Ines Alvarez", ["Faculty of Forestry, University of Zagreb"]), ("Karl Maria Weber", ["Faculty of Forestry, University of Zagreb"])]


@pytest.mark.parametrize("text", [None, "", "\n\n", "Abstract\nAlbert Gu", "A study of rivers and of lakes in the north"])
def test_pages_without_authors(value, text):
    assert found(value, text) == []
