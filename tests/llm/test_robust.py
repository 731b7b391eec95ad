"""Hostile files, ties between rows of one key, and false-discovery control, each against a plain statement."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from seamline.llm import media, mixing, secrets
from seamline.llm.words import word_count


def patched(kind: bytes, at: int, value: int) -> bytes:
    """A good file with one count of one box overwritten."""
    file = bytearray(media.mux(media.padded(bytes(20_000))))
    file[file.index(kind) + 4 + at : file.index(kind) + 8 + at] = struct.pack(">I", value)
    return bytes(file)


HOSTILE = [(b"stsz", 8, 4_294_967_280), (b"stsz", 4, 0), (b"stsc", 8, 7), (b"stco", 4, 2**32 - 1), (b"stts", 4, 2**31), (b"stss", 8, 0), (b"stss", 8, 999_999), (b"stco", 8, 2**31)]


@pytest.mark.parametrize(("kind", "at", "value"), HOSTILE)
def test_hostile_counts_are_errors(kind, at, value):
    with pytest.raises((ValueError, KeyError, IndexError, struct.error)):
        view, track = media.first_track(patched(kind, at, value))
        media.probed(view, track), media.digested(view, track)


def test_large_chunks_cost_nothing():
    """Only as many places are made as there are samples, whatever a run of chunks claims."""
    for at in (12, 24):
        view, track = media.first_track(patched(b"stsc", at, 4_294_967_295))
        assert len(track.sizes) == len(track.offsets) == 35


def test_hostile_files_in_columns(spark):
    rows = [(i, bytearray(patched(*h))) for i, h in enumerate(HOSTILE)] + [(90, None), (91, bytearray()), (92, bytearray(media.mux(media.padded(b"x"))))]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = {r.id: r for r in media.examine(df, "media", ["id"]).collect()}
    assert len(got) == len(rows) and all(got[i].error and got[i].payload_sha256 is None and got[i].codec is None for i in got if i != 92)
    assert got[92].error is None and got[92].payload_bytes == 576


def test_ties_of_one_key_do_not_depend_on_order(spark):
    texts = [f"w{i} " * 20 for i in range(30)]
    rows = [(7, "s", t, {"a": 1}) for t in texts] + [(k, "t", "one two", None) for k in range(40)]
    takes = []
    for seed, parts in ((1, 1), (2, 7)):
        shuffled = random.Random(seed).sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, "k long, source string, text string, m map<string,int>").repartition(parts)
        got = mixing.mix(df, "k", F.col("source"), word_count(F.col("text"))).select("row.text", "row.k", "copies").collect()
        takes.append(sorted((r.text, r.k, r.copies) for r in got))
    assert takes[0] == takes[1] and {c for t, _, c in takes[0] if t in texts} != {1}


def test_discoveries_match_benjamini_hochberg(spark):
    r = random.Random(4)
    tokens = [(r.randrange(3), min(secrets.LAST_BIN, int(-r.choice([r.uniform(-9, 0), r.uniform(-1, 0)]) * secrets.BINS_PER_UNIT))) for _ in range(500)]
    rows = [([{"stratum": s, "bin": b} for s, b in tokens[i : i + 9]],) for i in range(0, 500, 9)]
    scanned = spark.createDataFrame(rows, "tokens array<struct<stratum:int,bin:int>>")
    got = secrets.discovery_bins(scanned, 0.01)
    for stratum in range(3):
        bins = sorted((b for s, b in tokens if s == stratum), reverse=True)
        held = [b for k, b in enumerate(bins, 1) if 10 ** (-b / secrets.BINS_PER_UNIT) <= 0.01 * max(j for j, c in enumerate(bins, 1) if c == b) / len(bins)]
        assert {b for b in bins if b >= got[stratum]} == {b for b in bins if held and b >= min(held)}
    assert got[3] == secrets.LAST_BIN + 1


def test_touching_spans():
    r = random.Random(5)
    for _ in range(300):
        spans = sorted((a, r.randrange(3), a + r.randint(1, 9)) for a in (r.randrange(60) for _ in range(r.randrange(8))))
        covered = secrets.merged(spans)
        for _ in range(20):
            s = r.randrange(60)
            e = s + r.randint(1, 9)
            assert secrets.touches(covered, s, e) == any(a < e and s < b for a, _, b in spans)
