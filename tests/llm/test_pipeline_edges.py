"""Every stage on empty tables, nulls, repeated rows, ties and clashing names; context of personal data; joins beyond the broadcast."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import mixing, pii, skew
from seamline.llm.words import word_count

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, own string, copies int, member long, size int"
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = list(STAGES)[:-1]


def documents(spark, rows):
    return spark.createDataFrame([(*r, "r", "o", 1, 2, 3) for r in rows], SCHEMA)


def prose(seed, n=90):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 7))) for _ in range(n))


ROWS = [
    (1, prose(1), "en", "a", 9), (1, prose(1), "en", "a", 9), (2, prose(1), "en", None, 9), (3, None, None, None, None), (4, "", "en", "b", 0), (None, prose(2), "en", "b", 5),
    (5, prose(3) + " mail a.b@example.org", "de", "b", 7), (6, "two words", "en", "a", 3), (7, prose(4, 20_000), "en", "c", 1), (3, None, None, None, None),
]


@pytest.mark.parametrize("name", FILTERS)
def test_stages_keep_all_columns(spark, name):
    docs = documents(spark, ROWS)
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert {r.doc_id for r in got.collect()} <= {r[0] for r in ROWS}
    assert STAGES[name](spark, documents(spark, ROWS).limit(0), SF).collect() == []


def test_what_stages_decide(spark):
    docs = documents(spark, ROWS)
    ids = lambda name: sorted((r.doc_id for r in STAGES[name](spark, docs, SF).collect()), key=str)
    assert not {3, 4, 6} & set(ids("quality"))
    assert ids("near_duplicates") == [1, 3, 4, 5, 6, 7, None]
    clean = {r.doc_id: r for r in STAGES["personal_data"](spark, docs, SF).collect()}
    assert clean[5].text.endswith("mail <EMAIL>") and clean[5].n_chars == len(clean[5].text) and clean[3].text is None and clean[3].n_chars is None
    assert len(ids("personal_data")) == len(ROWS)
    taken = ids("mixing")
    assert taken.count(3) == 4 and taken.count(4) in (1, 2) and all(taken.count(i) <= 4 for i in taken)


def test_last_stage(spark):
    docs = documents(spark, [r for r in ROWS if r[0] != 7])
    got = STAGES["pieces"](spark, docs, SF).collect()
    assert len(got) == len(ROWS) - 1 and all(r.piece_ids == [] for r in got if r.doc_id in (3, 4)) and all(r.piece_ids for r in got if r.doc_id in (1, 2, 5, 6))
    assert STAGES["pieces"](spark, docs.limit(0), SF).collect() == []


def test_context_decides_other_kinds(spark):
    iban, ssn = "DE89370400440532013000", "123-45-6789"
    texts = [f"x {iban} y", f"bank account {iban}", f"order number {iban}", f"bank order {iban}", f"x {ssn}", f"my ssn {ssn}", f"ssn of part {ssn}", "invoice ip 10.0.0.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans.split(":")[0], r.scores) for r in pii.pii_report(df, "doc_id", "text").collect()}
    assert got == {0: ("iban", "0.6"), 1: ("iban", "0.8"), 2: ("", ""), 3: ("iban", "0.6"), 4: ("", ""), 5: ("ssn", "0.5"), 6: ("", ""), 7: ("ip", "0.6")}
    clean = {r.doc_id: r.text for r in pii.redact(df, "text").collect()}
    assert iban not in clean[0] + clean[1] and iban in clean[2] and ssn in clean[4] and ssn not in clean[5]
    empty = pii.pii_report(df.limit(0), "doc_id", "text")
    assert empty.collect() == [] and empty.columns[-2:] == ["spans", "scores"]


def test_mixing_beyond_the_broadcast(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), " ".join(["w"] * r.choice([0, 5, 5, 5, 9, 40]))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    taken = lambda: sorted((x.row.doc_id, x.copies) for x in mixing.mix(df, "doc_id", F.col("source"), word_count(F.col("text"))).collect())
    plain = taken()
    monkeypatch.setattr(mixing, "fits_broadcast", lambda _: False)
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    assert taken() == plain and len(plain) == 900
