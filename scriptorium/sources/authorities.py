"""Authority records: institutions and concepts by the words that name them. Either table can be replaced by any DataFrame of the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values, in order of priority: pattern, name, ROR id, country.
INSTITUTIONS = """
universitas indonesia | Universitas Indonesia | 01p2s5n88 | ID
institut teknologi bandung | Institut Teknologi Bandung | 04sbc6a41 | ID
itb | Institut Teknologi Bandung | 04sbc6a41 | ID
universitas gadjah mada | Universitas Gadjah Mada | 03t83re46 | ID
ugm | Universitas Gadjah Mada | 03t83re46 | ID
institut teknologi sepuluh nopember | Institut Teknologi Sepuluh Nopember | 00a7b4455 | ID
its | Institut Teknologi Sepuluh Nopember | 00a7b4455 | ID
universitas diponegoro | Universitas Diponegoro | 00b86a877 | ID
undip | Universitas Diponegoro | 00b86a877 | ID
universitas airlangga | Universitas Airlangga | 04nrqd972 | ID
unair | Universitas Airlangga | 04nrqd972 | ID
institut pertanian bogor | IPB University | 04tsh1a33 | ID
ipb | IPB University | 04tsh1a33 | ID
ipb university | IPB University | 04tsh1a33 | ID
universitas brawijaya | Universitas Brawijaya | 0126zqb35 | ID
ub | Universitas Brawijaya | 0126zqb35 | ID
universitas padjadjaran | Universitas Padjadjaran | 02crv6q28 | ID
unpad | Universitas Padjadjaran | 02crv6q28 | ID
universitas sebelas maret | Universitas Sebelas Maret | 01m5gqw36 | ID
uns | Universitas Sebelas Maret | 01m5gqw36 | ID
universitas hasanuddin | Universitas Hasanuddin | 01m5x5189 | ID
unhas | Universitas Hasanuddin | 01m5x5189 | ID
universitas sumatera utara | Universitas Sumatera Utara | 03947b198 | ID
usu | Universitas Sumatera Utara | 03947b198 | ID
universitas tanjungpura | Universitas Tanjungpura | 03f0b2f63 | ID
untan | Universitas Tanjungpura | 03f0b2f63 | ID
universitas andalas | Universitas Andalas | 03x3t5924 | ID
unand | Universitas Andalas | 03x3t5924 | ID
universitas syiah kuala | Universitas Syiah Kuala | 0286t4f65 | ID
usk | Universitas Syiah Kuala | 0286t4f65 | ID
unsyiah | Universitas Syiah Kuala | 0286t4f65 | ID
universitas udayana | Universitas Udayana | 0014x2067 | ID
unud | Universitas Udayana | 0014x2067 | ID
universitas jember | Universitas Jember | 00z2b8v12 | ID
unej | Universitas Jember | 00z2b8v12 | ID
universitas lampung | Universitas Lampung | 03c399r89 | ID
unila | Universitas Lampung | 03c399r89 | ID
universitas sriwijaya | Universitas Sriwijaya | 044v2r952 | ID
unsri | Universitas Sriwijaya | 044v2r952 | ID
universitas riau | Universitas Riau | 05c8q3411 | ID
unri | Universitas Riau | 05c8q3411 | ID
universitas mulawarman | Universitas Mulawarman | 04k25z018 | ID
unmul | Universitas Mulawarman | 04k25z018 | ID
universitas lambung mangkurat | Universitas Lambung Mangkurat | 0296g5720 | ID
ulm | Universitas Lambung Mangkurat | 0296g5720 | ID
universitas sam ratulangi | Universitas Sam Ratulangi | 013sfx274 | ID
unsrat | Universitas Sam Ratulangi | 013sfx274 | ID
universitas negeri yogyakarta | Universitas Negeri Yogyakarta | 03sp19r91 | ID
uny | Universitas Negeri Yogyakarta | 03sp19r91 | ID
universitas pendidikan indonesia | Universitas Pendidikan Indonesia | 02v6h0v47 | ID
upi | Universitas Pendidikan Indonesia | 02v6h0v47 | ID
telkom university | Telkom University | 03v330230 | ID
binus university | Bina Nusantara University | 02m0t9685 | ID
binus | Bina Nusantara University | 02m0t9685 | ID
badan riset dan inovasi nasional | Badan Riset dan Inovasi Nasional | 054hwh503 | ID
brin | Badan Riset dan Inovasi Nasional | 054hwh503 | ID
massachusetts institute of technology | Massachusetts Institute of Technology | 0547t3q72 | US
mit | Massachusetts Institute of Technology | 0547t3q72 | US
stanford university | Stanford University | 00f54p054 | US
harvard university | Harvard University | 03vek6s52 | US
carnegie mellon university | Carnegie Mellon University | 05x2bcf33 | US
cmu | Carnegie Mellon University | 05x2bcf33 | US
princeton university | Princeton University | 00hx57361 | US
university of california, berkeley | University of California, Berkeley | 01an7q238 | US
uc berkeley | University of California, Berkeley | 01an7q238 | US
cornell university | Cornell University | 05bnh6r03 | US
university of oxford | University of Oxford | 052gg0110 | GB
oxford university | University of Oxford | 052gg0110 | GB
university of cambridge | University of Cambridge | 013meh722 | GB
cambridge university | University of Cambridge | 013meh722 | GB
eth zurich | ETH Zurich | 05a28rw58 | CH
national university of singapore | National University of Singapore | 046rm7j60 | SG
nus | National University of Singapore | 046rm7j60 | SG
nanyang technological university | Nanyang Technological University | 02e7zfz27 | SG
ntu | Nanyang Technological University | 02e7zfz27 | SG
tsinghua university | Tsinghua University | 03cve4549 | CN
peking university | Peking University | 02v51f717 | CN
university of tokyo | The University of Tokyo | 057zh3y96 | JP
elsevier | Elsevier | 01ggx4157 | NL
springer nature | Springer Nature | 05697k177 | DE
ieee | Institute of Electrical and Electronics Engineers | 01k5qnb77 | US
acm | Association for Computing Machinery | 02d2k5257 | US
wiley | Wiley | 01t87vg90 | US
nature publishing group | Nature Portfolio | 02b55f691 | GB
w3c | World Wide Web Consortium | 02b55f691 | US
crossref | Crossref | 02t43z281 | US
orcid | ORCID | 047f03g78 | US
"""
#: Fixed values, in order of priority: pattern, Wikidata id, domain, MeSH id if any.
CONCEPTS = """
knowledge graph | Q33002955 | Computer Science
linked data | Q515701 | Computer Science
semantic web | Q54837 | Computer Science
schema.org | Q3475355 | Computer Science
retrieval-augmented generation | Q123565622 | Computer Science
rag | Q123565622 | Computer Science
ontology | Q324254 | Computer Science
json-ld | Q6109033 | Computer Science
rdf | Q54872 | Computer Science
machine learning | Q2539 | Computer Science
deep learning | Q197536 | Computer Science
neural network | Q192776 | Computer Science
convolutional neural network | Q13129841 | Computer Science
cnn | Q13129841 | Computer Science
transformer | Q85810444 | Computer Science
state space model | Q108251548 | Computer Science
mamba | Q108251548 | Computer Science
reinforcement learning | Q830687 | Computer Science
support vector machine | Q328709 | Computer Science
svm | Q328709 | Computer Science
large language model | Q115305900 | Computer Science
llm | Q115305900 | Computer Science
internet of things | Q251649 | Computer Science
iot | Q251649 | Computer Science
graph neural network | Q97358752 | Computer Science
natural language processing | Q30642 | Computer Science
nlp | Q30642 | Computer Science
vector database | Q117749453 | Computer Science
qdrant | Q117749453 | Computer Science
formal verification | Q782977 | Computer Science
model checking | Q1142517 | Computer Science
smt solver | Q7394627 | Computer Science
bounded model checking | Q4949980 | Computer Science
esbmc | Q782977 | Computer Science
microcontroller | Q165668 | Electrical Engineering
arduino | Q175925 | Electrical Engineering
esp32 | Q27044455 | Electrical Engineering
lorawan | Q25052959 | Telecommunications
diabetes mellitus | Q12206 | Medicine | D003920
hypertension | Q110786 | Medicine | D006973
polymerase chain reaction | Q176996 | Biochemistry | D016133
pcr | Q176996 | Biochemistry | D016133
covid-19 | Q84263196 | Medicine | D000086382
crispr | Q15086884 | Genetics | D000078385
myocardial infarction | Q12152 | Cardiology | D009203
battery energy storage system | Q810931 | Energy Engineering
bess | Q810931 | Energy Engineering
photovoltaic | Q193135 | Energy
solar cell | Q48299 | Energy
greenhouse gas | Q167336 | Environmental Science
fuel cell | Q180253 | Energy
renewable energy | Q12705 | Environmental Science
peatland | Q1056754 | Earth Science
peat soil | Q18481 | Earth Science
e-methanol | Q14982 | Chemical Engineering
methanol synthesis | Q14982 | Chemical Engineering
carbon capture and storage | Q836371 | Environmental Science
pyrolysis | Q181938 | Chemical Engineering
electrolysis | Q131362 | Chemistry
biomass | Q18848 | Energy
"""


def _rows(text: str, columns: int) -> list[tuple[object, ...]]:
    parts = [[x.strip() for x in line.split("|")] for line in text.strip().splitlines()]
    return [(i, *p, *[None] * (columns - len(p))) for i, p in enumerate(parts)]


def institutions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(INSTITUTIONS, 4), "priority int, pattern string, name string, ror string, country string")


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_rows(CONCEPTS, 4), "priority int, pattern string, wikidata string, domain string, mesh string")
