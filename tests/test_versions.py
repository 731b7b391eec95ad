"""Streams of several batches against batch results, also when a batch fails half way and is run again."""

import pytest
from pyspark.sql import functions as F

from seamline.operators import scans
from seamline.plans import metrics, stateful
from seamline.plans.boundaries import _trace
from seamline.streaming import state, versions

SF = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def pieces(spark, tmp_path):
    """A table of the smallest scale as files in order, one a batch; whole keys are spread over all of them."""

    def cut(name, order, n=4):
        rows = spark.read.parquet(f"{SF}/{name}.parquet").orderBy(order).toPandas()
        for k in range(n):
            part = rows.iloc[k * len(rows) // n : (k + 1) * len(rows) // n]
            spark.createDataFrame(part, spark.read.parquet(f"{SF}/{name}.parquet").schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-{k}"))
        schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
        return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-*"))

    return cut


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def failing(sink, at, after):
    """``sink``, failing once in batch ``at``, after its work or before its state is written."""
    failed = []

    def run(batch, number):
        if number == at and not failed:
            failed.append(number)
            if after:
                sink(batch, number)
            raise RuntimeError("lost")
        sink(batch, number)

    return run


def run_with_a_failure(stream, sink, checkpoint, after):
    with pytest.raises(Exception, match="lost"):
        versions.run_to_end(stream(), failing(sink, 2, after), checkpoint)
    return versions.run_to_end(stream(), sink, checkpoint)


@pytest.mark.parametrize("after", [True, False])
def test_leaderboard_after_a_failure(spark, pieces, tmp_path, after):
    stream, folder = pieces("lineitem", "l_orderkey"), str(tmp_path / "board")
    last = run_with_a_failure(stream, stateful.supplier_sink(spark, SF, folder), f"{folder}/checkpoint", after)
    got = versions.Versions(f"{folder}/ranking", stateful.PLACES).before(spark, last + 1)
    assert last == 3 and rows(got) == rows(metrics.q31_rank_records(spark, SF))


@pytest.mark.parametrize("after", [True, False])
def test_sessions_after_a_failure(spark, pieces, tmp_path, after):
    stream, folder = pieces("events", "event_id"), str(tmp_path / "sessions")
    sink = versions.sessions_sink(folder, "user_id", "event_id", "block_length", 128)
    run_with_a_failure(lambda: stateful.blocks_of_events(stream()), sink, f"{folder}/checkpoint", after)
    assert rows(versions.results_of(spark, f"{folder}/results", stateful.SESSIONS)) == rows(stateful.q79_count_sessions(spark, SF))


def test_offsets_of_hot_keys_by_batch(spark, pieces, tmp_path, monkeypatch):
    stream, folder = pieces("events", "event_id"), str(tmp_path / "offsets")
    monkeypatch.setattr(scans, "HOT_ROWS", 3)
    sink = versions.offsets_sink(folder, "user_id", "event_id", "block_length", state.OFFSETS)
    versions.run_to_end(stateful.blocks_of_events(stream()), sink, f"{folder}/checkpoint")
    assert rows(versions.results_of(spark, f"{folder}/results", state.OFFSETS)) == rows(_trace(spark, SF))


def test_keyed_state_equals_batch(spark, pieces, tmp_path):
    stream = stateful.blocks_of_events(pieces("events", "event_id")())
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = state.stream_offsets(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o"))
        query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER)
    assert rows(spark.read.schema(state.OFFSETS).parquet(str(tmp_path / "o"))) == rows(_trace(spark, SF).withColumn("block_length", F.col("block_length").cast("long")))
