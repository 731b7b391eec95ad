"""Quotation linking and the corpus pipeline."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from seamline.llm import quotes
from seamline.llm.ranking import number_rows

MESSAGES = [
    (1, 0, "user", "How do I sort a large table?\nIt has many rows."),
    (1, 1, "assistant", "Use an external merge sort.\n\nIt spills to disk."),
    (1, 2, "user", "On Monday, Bot wrote:\n> Use an external merge sort.\nThanks, that is what I need."),
    (1, 3, "user", "Another question entirely here."),
    (1, 4, "assistant", "> > Use an external merge sort.\n> Thanks, that is what I need.\nYou are welcome, dear user."),
    (2, 0, "user", "> It spills to disk.\nWhere does it spill to?"),
    (2, 1, "user", "> never said by anyone\nHm."),
    (3, None, "user", None), (3, None, "user", None), (None, 0, "x", ""), (4, 0, "user", ">" * 3), (4, 1, "user", "long " * 30_000),
]


def test_quote_links(spark):
    df = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").withColumn("body", F.lit("clash")).withColumn("position", F.lit(1))
    got = quotes.link_quotes(df).collect()
    assert len(got) == len(MESSAGES)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 2].body == "Thanks, that is what I need."
    assert (by[1, 2].parent_conv, by[1, 2].parent_turn, by[1, 2].n_quoted, by[1, 2].n_linked) == (1, 1, 1, 1)
    assert (by[1, 4].parent_turn, by[1, 4].root_turn, by[1, 4].n_quoted, by[1, 4].n_linked) == (2, 1, 2, 2)
    assert by[1, 4].body == "You are welcome, dear user."
    assert (by[2, 0].parent_conv, by[2, 0].parent_turn) == (1, 1)
    assert by[2, 1].parent_conv is None and by[2, 1].n_quoted == 1 and by[2, 1].n_linked == 0
    assert [t for _, t in sorted((r.position, r.turn) for r in got if r.conv_id == 1)] == [0, 1, 2, 4, 3]
    assert quotes.link_quotes(df.where("false")).count() == 0
    assert quotes.link_quotes(df.limit(0)).columns == ["conv_id", "turn", "role", "body", "n_quoted", "n_linked", "parent_conv", "parent_turn", "root_turn", "position"]


def test_number_rows_with_nulls(spark):
    rows = [(None, None, i) for i in range(5)] + [("a", None, 1), ("a", 1, 0), ("a", 0, 9)]
    df = spark.createDataFrame(rows, "g string, b long, o long")
    got = number_rows(df, ["g"], "b", ["o"], "n").collect()
    assert sorted(r.n for r in got if r.g is None) == [1, 2, 3, 4, 5]
    assert [r.o for r in sorted((r for r in got if r.g == "a"), key=lambda r: r.n)] == [1, 9, 0]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf).persist())
        if name != "pieces":
            assert frames[-1].columns == docs.columns, name
    quality, single, private, mixed, pieces = [f.collect() for f in frames[1:]]
    assert 0 < len(single) <= len(quality) < before
    assert len(private) == len(single) and all(r.n_chars == len(r.text) for r in private)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", r.text) for r in private)
    ids = [r.doc_id for r in mixed]
    assert {r.doc_id for r in private} >= set(ids) and max(map(ids.count, ids)) <= 2
    assert len(pieces) == len(mixed) and all(r.piece_ids for r in pieces)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").join(docs.where(F.size(F.split("text", " ")) > 60), "doc_id").collect()}
    assert len(good & {r.doc_id for r in quality}) >= 0.95 * len(good)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
