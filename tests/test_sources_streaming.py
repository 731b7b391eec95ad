"""Readers, sinks, state, and the driver contract."""

import importlib
import json
import sys

import pytest
from pyspark.sql import functions as F

from seamline.sources import readers, sinks
from seamline.streaming import state


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    (tmp_path / "w.json").write_text(json.dumps({"data": [{"a": 1}], "valid": [{"a": 3}], "other": [{"a": 9}]}))
    (tmp_path / "l.json").write_text('[{"a": 4}, null, {"a": 5}]')
    assert readers.jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    assert [r.a for r in readers.strict_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").collect()] == [1, 2]
    with pytest.raises(Exception, match="bad.jsonl:2"):
        readers.strict_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    assert sorted(r.a for r in readers.records(spark, str(tmp_path / "w.json"), "a int").collect()) == [1, 3]
    assert sorted(r.a for r in readers.records(spark, str(tmp_path / "l.json"), "a int").collect()) == [4, 5]


def test_text_readers(spark, tmp_path):
    row = lambda i, t, last: "\t".join([str(i), t, *["_"] * 7, last])
    (tmp_path / "t.tok").write_text("\n".join([
        "# newdoc id = d1", row(1, "Hello", "Seg=B-seg"), row(2, ",", "_"), row(3, "World", "Seg=B-seg"), "short line", "# newdoc id = d2", row(1, "Bye", "Seg=B-seg"), "# newdoc id = d3",
    ]))
    got = {r.doc_id: r.tokens for r in readers.token_documents(spark, str(tmp_path / "t.tok"), "dev").collect()}
    assert got == {"d1": [["Hello", ","], ["World"]], "d2": [["Bye"]]}
    (tmp_path / "n.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# a\n", "b"]}, {"cell_type": "code", "source": "x = 1"}]}))
    (tmp_path / "bad.ipynb").write_text("{")
    books = {r.valid: r for r in readers.notebooks(spark, str(tmp_path)).collect()}
    assert books[True].cell_types == ["markdown", "code"] and books[True].cell_texts == ["# a\nb", "x = 1"] and False in books
    (tmp_path / "ids.txt").write_text("b\n\n a \n")
    assert [(r.id) for r in readers.id_list(spark, str(tmp_path / "ids.txt")).orderBy("position").collect()] == ["b", "a"]
    (tmp_path / "c.jsonl").write_text('"one"\n"t\\"wo"\n')
    assert [r.text for r in readers.cached_strings(spark, str(tmp_path / "c.jsonl")).orderBy("position").collect()] == ["one", 't"wo']
    (tmp_path / "run.log").write_text("Avg NFE: 3.5\nother\navg nfe = 4.5\n")
    assert readers.log_averages(spark, str(tmp_path / "run.log"), ["avg nfe"]).first()["avg nfe"] == 4.5


def test_label_layouts(spark):
    rows = [([1, 2, 3], [0, 1, 0], None, None), ([1, 2], None, [1], None), (None, None, None, ["a b", "c"])]
    df = spark.createDataFrame(rows, "input_ids array<int>, boundary_labels array<int>, boundary_positions array<int>, segments array<string>")
    assert [r.boundary_labels for r in readers.unify_labels(df).collect()] == [[0, 1, 0], [0, 1], [0, 1, 1]]
    with pytest.raises(Exception, match="neither"):
        readers.unify_labels(spark.createDataFrame([([1], None, None, None)], df.schema)).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "train"), (2, "x", "valid")], "a int, b string, split string")
    assert sinks.write_counted(df, str(tmp_path / "o")) == 2
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "o").glob("*.json"))
    sinks.write_jsonl(df, str(tmp_path / "s"), ["split"])
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=train", "split=valid"]
    with pytest.raises(Exception, match="forbidden"):
        sinks.append_guarded(df, str(tmp_path / "g"), ["X"])
    sinks.append_guarded(df, str(tmp_path / "h"), ["humaneval"])
    sinks.append_guarded(df, str(tmp_path / "h"), ["humaneval"])
    assert spark.read.json(str(tmp_path / "h")).count() == 4
    assert sinks.markdown(df.orderBy("a"), ["a", "b"]).splitlines()[2:] == ["| 1 |  |", "| 2 | x |"]
    m = sinks.subset_manifest(spark, "half", "equidistant", 1, 10, [0, 5])
    m.coalesce(1).write.json(str(tmp_path / "m"))
    assert [r.idx for r in readers.manifest(spark, str(tmp_path / "m")).orderBy("position").collect()] == [0, 5]


def test_carry_and_revisit(spark):
    rows = [("u", 0, [0.1], [[1.0, 0.0]], [1.0, 0.0], 0.5), ("u", 1, [0.2, 0.3], [[2.0, 0.0], [0.0, 1.0]], [0.0, 1.0], -1.0), ("u", 2, [0.4], [[0.0, 3.0]], [1.0, 1.0], 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, s array<double>, v array<array<double>>, h array<double>, g double")
    got = [[round(x, 6) for x in r.carried_scores] for r in state.carry_scores(df, "k", "t", "s", "v", "h", "g", 2.0).orderBy("t").collect()]
    assert got == [[0.1], [1.2, 0.3], [0.4]]
    plan = lambda gate, mode="gated": spark.range(1).select(state.revisit_plan(F.lit(10), F.lit(20), F.lit(30), F.lit(8), F.lit(gate), mode).alias("p")).first().p
    assert (plan(0.5).revisit_start, plan(0.5).overlap_tokens) == (16, 4)
    assert plan(1.0).overlap_tokens == 0 and plan(0.99).overlap_tokens == 1 and plan(0.9, "fixed").overlap_tokens == 8
    s = spark.range(1).select(state.window_summary(F.array(*[F.array(F.lit(float(i)), F.lit(1.0)) for i in range(4)]), F.lit(1), F.lit(3)).alias("w")).first().w
    assert s == [1.5, 1.0, 2.0, 1.0]


def test_stream_equals_batch(spark):
    from seamline.plans import catalogue

    sf = "/root/testdata/sf0.001"
    a, b = (catalogue.QUERIES[n](spark, sf) for n in ("q05_running_offsets", "q45_kv_state_stream"))
    assert sorted(map(str, a.select("event_id", "step_index", "offset").collect())) == sorted(map(str, b.select("event_id", "step_index", "offset").collect()))


def test_resume_by_key(spark):
    todo = spark.createDataFrame([(1,), (2,), (3,)], "request_id int")
    assert [r.request_id for r in state.unfinished(todo, todo.where("request_id = 2")).orderBy("request_id").collect()] == [1, 3]


def test_entry_without_training_data_operators(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("seamline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "seamline.llm", None)
    real = importlib.import_module

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline":
                raise ModuleNotFoundError(name, name="corpus_pipeline")

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    assert real is importlib.import_module
    names = set(entry.queries())
    assert "q01_boundary_overlap" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= names
