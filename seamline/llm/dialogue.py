"""Conversation structure repair: the cheapest edits that give an order of roles ``(s?(ua)+)?``.

A time-major NumPy tensor program: conversations are bucketed by length, the state costs of all conversations of a
bucket are updated a turn at a time from the last turn to the first and all are stored, and the edits are traced
from the first turn to the last, again for all conversations at once.

States: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's. Conversations are read
whole by one task up to ``LONG_ROWS`` turns and ``LONG_BYTES`` of text. Longer ones are cut into blocks: a block's
program is solved for each state behind it, which gives a 4 x 4 matrix of costs; the matrices of a conversation
give the costs behind each block, and the blocks are then traced from each state before them. Results are the same.

Defined cases: a null role or text is read as one space, a null conversation is a conversation, a null turn stands
first; turns of one number go by role, then text; repeated rows are duplicates; roles other than those that begin
with s, u or a can be rerolled or deleted, never kept; a conversation whose rows only name it, or none at all, has
zeros, no edits and the hash of the empty string; an empty table gives no rows. Columns with other names, or with the
names of results, do not matter: the four columns are chosen by name and nothing else is read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from seamline.llm.ranking import number_by_ranges
from seamline.llm.skew import salted_join
from seamline.llm.texts import as_bytes
from seamline.llm.words import BLANKS
from seamline.session import durable, stored, table

#: Conversations beyond either bound are solved in blocks of BLOCK turns.
LONG_ROWS = 4_096
LONG_BYTES = 8_000_000
BLOCK = 2_048
#: Characters of a text by which ranges are dealt; their bounds come to the driver.
PREFIX = 200
#: Turns and bytes that a task gathers before it solves them, and cells of a tensor at most.
GATHERED_ROWS = 20_000
GATHERED_BYTES = 16_000_000
CELLS = 4_000_000

STATES = 4
NO_WAY = 1 << 40
ROLES = ("user", "assistant")
#: The state after a user's or an assistant's turn, whichever may stand next, and which of the two that is.
NEXT = np.array([2, 2, 3, 2])
SAYS = np.array([0, 0, 1, 0])
#: A step is 3 * role (system, user, assistant, other) + fault; PAD fills the time after a conversation's end.
FINE, GONE, CUT = 0, 1, 2
PAD = 12
DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: Inserts before one turn: a third would come back to the state after the first.
INSERTS = 2

RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Machine:
    """Tables of costs by step and state."""

    def __init__(self, costs: Costs):
        self.insert = costs.insert
        self.delete = np.full(PAD + 1, costs.delete, np.int64)
        self.rerole = np.full(PAD + 1, NO_WAY, np.int64)
        self.keep = np.full((PAD + 1, STATES), NO_WAY, np.int64)
        self.keep_to = np.zeros((PAD + 1, STATES), np.int64)
        self.delete[PAD] = 0
        for role in range(4):
            for fault, extra in ((FINE, 0), (CUT, costs.truncated)):
                step = 3 * role + fault
                self.rerole[step] = costs.rerole + extra
                for state, to in ((0, 1),) if role == 0 else ((0, 2), (1, 2), (3, 2)) if role == 1 else ((2, 3),) if role == 2 else ():
                    self.keep[step, state], self.keep_to[step, state] = extra, to
        #: Costs of each state behind the last turn: inserts complete a pair.
        self.end = self.with_inserts(np.array([[0, NO_WAY, NO_WAY, 0]], np.int64))[0]

    def with_inserts(self, cost: np.ndarray) -> np.ndarray:
        """``cost`` (... x state), or less by inserts before going on."""
        out = cost
        for _ in range(INSERTS):
            out = np.minimum(cost, out[..., NEXT] + self.insert)
        return out

    def solve(self, steps: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Backward costs, time x conversation x state, of ``steps`` (time x conversation); ``end``: those behind the last."""
        cost = np.empty((len(steps) + 1, *end.shape), np.int64)
        cost[-1] = end
        for t in range(len(steps) - 1, -1, -1):
            step, then = steps[t], cost[t + 1]
            kept = np.take_along_axis(then, self.keep_to[step], axis=1) + self.keep[step]
            least = np.minimum(np.minimum(then + self.delete[step, None], kept), then[:, NEXT] + self.rerole[step, None])
            cost[t] = np.where((step == PAD)[:, None], then, self.with_inserts(least))
        return cost

    def trace(self, steps: np.ndarray, cost: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edits (time x slot x conversation; 0: none) and the states behind the last turn.

        Of equally cheap edits the least in ASCII is taken: D, I, K, R. Each leads to one state only.
        """
        edits = np.zeros((len(steps), INSERTS + 1, steps.shape[1]), np.uint8)
        lanes, state = np.arange(steps.shape[1]), state.copy()
        for t, step in enumerate(steps):
            now, then, at = cost[t], cost[t + 1], edits[t]
            open_ = step != PAD
            for slot in range(INSERTS + 1):
                left = now[lanes, state]
                deleted = open_ & (then[lanes, state] + self.delete[step] == left)
                inserted = open_ & ~deleted & (now[lanes, NEXT[state]] + self.insert == left)
                other = open_ & ~deleted & ~inserted
                to = self.keep_to[step, state]
                kept = other & (then[lanes, to] + self.keep[step, state] == left)
                at[slot] = np.select([deleted, inserted, kept, other], [DELETE, INSERT, KEEP, REROLE], 0)
                state = np.where(kept, to, np.where(inserted | (other & ~kept), NEXT[state], state))
                open_ = inserted
                if not open_.any():
                    break
        return edits, state

    def closing(self, state: int) -> int:
        """Inserts behind the last turn."""
        n = 0
        while self.end[state]:
            n, state = n + 1, NEXT[state]
        return n


def strings_of(edits: np.ndarray) -> list[bytes]:
    """Each conversation's edits without the empty slots."""
    flat = edits.reshape(-1, edits.shape[2]).T
    ends = np.cumsum((flat != 0).sum(axis=1))
    joined = flat[flat != 0].tobytes()
    return [joined[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


def time_major(steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Steps of conversations as time x conversation, the rest of the time padded."""
    t = np.arange(max(1, lengths.max(initial=0)))[:, None]
    inside = t < lengths
    return np.where(inside, steps[np.where(inside, starts + t, 0)] if len(steps) else PAD, PAD)


def buckets(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Indices of conversations, those of one power of two together, as many as CELLS allow."""
    power = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for p in np.unique(power):
        own = np.flatnonzero(power == p)
        most = max(1, CELLS // (STATES * (1 << int(p))))
        yield from (own[a : a + most] for a in range(0, len(own), most))


def repair_steps(machine: Machine, steps: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Cost and edits of each conversation."""
    cost, audits = np.zeros(len(starts), np.int64), [b""] * len(starts)
    for own in buckets(lengths):
        grid = time_major(steps, starts[own], lengths[own])
        costs = machine.solve(grid, np.broadcast_to(machine.end, (len(own), STATES)))
        cost[own] = costs[0, :, 0]
        edits, state = machine.trace(grid, costs, np.zeros(len(own), np.int64))
        for k, made, s in zip(own.tolist(), strings_of(edits), state.tolist(), strict=True):
            audits[k] = made + b"I" * machine.closing(s)
    return cost, audits


def lines_of(audit: bytes, rows: Iterator[tuple[bytes, bytes]], state: int = 0) -> Iterator[tuple[str, bytes, bytes]]:
    """(edit, role, text) of every turn of the repaired conversation; ``rows``: role and text of each turn before."""
    for edit in audit:
        if edit == DELETE:
            next(rows)
            continue
        said = (ROLES[SAYS[state]].encode(), b"")
        if edit == KEEP:
            said = next(rows)
            state = {b"s": 1, b"u": 2, b"a": 3}[said[0][:1]]
        else:
            if edit == REROLE:
                said = (said[0], next(rows)[1])
            state = NEXT[state]
        yield chr(edit), *said


def prepared(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None) -> DataFrame:
    """conv_key (never null), conv, turn, role, text, step (without duplicates), blank. Rows not ``present`` have step null."""
    rows = df.select(
        F.coalesce(F.concat(F.lit("="), df[conv].cast("string")), F.lit("")).alias("conv_key"), df[conv].alias("conv"), df[turn].cast("long").alias("turn"),
        F.coalesce(df[role].cast("string"), F.lit(" ")).alias("role"), F.coalesce(df[text].cast("string"), F.lit(" ")).alias("text"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("there"),
    )
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    fault = F.when(blank, GONE).when(F.col("text").rlike(r"[.!?]" + BLANKS + r"*\z"), FINE).otherwise(CUT)
    rows = rows.withColumn("step", F.when(F.col("there"), 3 * initial + fault).cast("int"))
    return rows.withColumn("blank", F.coalesce((F.col("step") % 3) == GONE, F.lit(False))).drop("there")


def order() -> list:
    return ["conv_key", F.col("turn").asc_nulls_first(), "role", "text"]


def batches_of_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, from batches in order of conv_key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < GATHERED_ROWS and sum(b.nbytes for b in held) < GATHERED_BYTES:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        codes = key_codes(whole)
        last = int(np.searchsorted(codes, codes[-1]))
        if last:
            yield whole.slice(0, last)
        held = whole.slice(last).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def key_codes(rows: pa.Table) -> np.ndarray:
    """0, 1, ... by conversation, in order of rows."""
    return rows.column("conv_key").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def distinct_before(rows: pa.Table, codes: np.ndarray) -> np.ndarray:
    """Whether a row's conversation, role and text were seen before."""
    key = codes.astype(np.int64)
    for name in ("role", "text"):
        own = rows.column(name).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, key = np.unique(key * (own.max(initial=0) + 1) + own, return_inverse=True)
    _, first = np.unique(key, return_index=True)
    seen = np.ones(len(key), bool)
    seen[first] = False
    return seen


def facts(rows: pa.Table) -> tuple[pa.Table, np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Rows that are there, their steps, counts by conversation, and where each conversation's rows start and how many they are."""
    codes = key_codes(rows)
    n = int(codes.max(initial=-1)) + 1
    first = np.searchsorted(codes, np.arange(n))
    there = rows.column("step").is_valid().to_numpy()
    conv = rows.column("conv").take(pa.array(first))
    rows, codes = rows.filter(pa.array(there)), codes[there]
    steps = rows.column("step").to_numpy().astype(np.int64)
    blank = rows.column("blank").to_numpy(zero_copy_only=False).astype(bool)
    copies = distinct_before(rows, codes) & ~blank
    steps = np.where(copies, steps // 3 * 3 + GONE, steps)
    by = lambda flags: np.bincount(codes, weights=flags, minlength=n).astype(np.int64)
    role = steps // 3
    follows = codes[1:] == codes[:-1]
    legal = ((role[:-1] == 0) & (role[1:] == 1)) | ((role[:-1] == 1) & (role[1:] == 2)) | ((role[:-1] == 2) & (role[1:] == 1))
    illegal = np.bincount(codes[1:], weights=follows & ~legal, minlength=n).astype(np.int64)
    numbered = rows.column("turn").is_valid().to_numpy()
    turns, owner = rows.column("turn").drop_null().to_numpy(), codes[numbered]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (turns[1:] != turns[:-1])] if len(turns) else np.zeros(0, bool)
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(low, owner, turns)
    np.maximum.at(high, owner, turns)
    distinct = np.bincount(owner, weights=new, minlength=n).astype(np.int64)
    gaps = np.where(distinct > 0, high - np.where(distinct > 0, low, 0) + 1 - distinct, 0)
    lengths = np.bincount(codes, minlength=n)
    counts = {"conv": conv, "gaps": gaps, "blank": by(blank), "duplicate": by(copies), "truncated": by(steps % 3 == CUT), "illegal": illegal}
    return rows, steps, counts, np.cumsum(lengths) - lengths, lengths


def schema_of(rows: DataFrame, fields: str) -> StructType:
    return StructType([StructField("conv", rows.schema["conv"].dataType), *StructType.fromDDL(fields).fields])


def gathered(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_key").sortWithinPartitions(*order())


def solved_whole(rows: DataFrame, costs: Costs) -> DataFrame:
    """One row a conversation: conv and RESULT. Each conversation is read whole by one task."""
    schema = schema_of(rows, RESULT)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(costs)
        for part in batches_of_conversations(batches):
            own, steps, counts, starts, lengths = facts(part)
            cost, audits = repair_steps(machine, steps, starts, lengths)
            roles, texts = (as_bytes(own.column(c).combine_chunks()) for c in ("role", "text"))
            digests = []
            for k, audit in enumerate(audits):
                span = slice(int(starts[k]), int(starts[k] + lengths[k]))
                said = zip(roles[span].to_pylist(), texts[span].to_pylist(), strict=True)
                digests.append(hashlib.sha256(b"\n".join(r + b":" + t for _, r, t in lines_of(audit, said))).hexdigest())
            values = [*counts.values(), cost, [a.decode() for a in audits], digests]
            arrays = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else pa.array(v) for v in values]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return gathered(rows).mapInArrow(run, schema)


def turns_whole(rows: DataFrame, costs: Costs) -> DataFrame:
    """One row a turn of the repaired conversations: conv, position, edit, role, text."""
    schema = schema_of(rows, "position long, edit string, role string, text string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(costs)
        for part in batches_of_conversations(batches):
            own, steps, counts, starts, lengths = facts(part)
            _, audits = repair_steps(machine, steps, starts, lengths)
            roles, texts = (as_bytes(own.column(c).combine_chunks()) for c in ("role", "text"))
            made, owner = [], []
            for k, audit in enumerate(audits):
                span = slice(int(starts[k]), int(starts[k] + lengths[k]))
                said = zip(roles[span].to_pylist(), texts[span].to_pylist(), strict=True)
                turns = list(lines_of(audit, said))
                made += [(at, e, r.decode(), t.decode()) for at, (e, r, t) in enumerate(turns)]
                owner += [k] * len(turns)
            if made:
                columns = [counts["conv"].take(pa.array(owner)).combine_chunks(), *(pa.array(c) for c in zip(*made, strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return gathered(rows).mapInArrow(run, schema)


def positioned(rows: DataFrame) -> DataFrame:
    """Rows of long conversations with ``place``, from 0 in their order, and duplicates told; no task gathers a conversation.

    Equal rows are counted first, so that what is dealt by range are rows that differ; a row of several copies has the
    place of its first. First sights are minima, joined back with hot texts spread.
    """
    value = F.struct(F.coalesce("turn", F.lit(-(2**63))), F.col("turn").isNotNull())
    once = stored(rows.groupBy("conv_key", "conv", "turn", "role", "text", "step", "blank").agg(F.count("*").alias("copies")), "turns")
    once = once.withColumns({"at": value, "same": F.sha2(F.concat_ws("\x00", F.hex("conv_key"), F.hex("role"), "text"), 256)})
    sights = once.groupBy("same").agg(F.min("at").alias("first_at"))
    once = salted_join(once, sights, "same", F.col("at"), once.count())
    once = once.withColumn("seen", (F.col("at") > F.col("first_at"))).drop("at", "same", "first_at")
    near = [*order()[1:-1], F.substring("text", 1, PREFIX)]
    return number_by_ranges(once, ["conv_key"], order()[1:], "copies", "place", near).withColumn("place", F.col("place") - 1)


def solved_blocks(rows: DataFrame, costs: Costs) -> DataFrame:
    """Like ``solved_whole``, for long conversations: cut into blocks of BLOCK turns that are solved apart.

    One task sees a block's steps, or of a whole conversation one 4 x 4 matrix a block. The hash of a conversation's
    text cannot be split: its turns pass through one task, a batch at a time.
    """
    there, size = rows.where("step is not null"), BLOCK
    placed = stored(positioned(there), "placed")
    gone = (F.floor(F.col("step") / 3) * 3 + GONE).cast("int")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    every = placed.select("conv_key", "conv", "turn", "place", "step", "seen", copy)
    every = every.withColumn("place", F.col("place") + F.col("copy"))
    every = every.withColumn("step", F.when((F.col("copy") > 0) | F.col("seen"), gone).otherwise(F.col("step")))
    coded = stored(
        every.withColumn("block", F.floor(F.col("place") / size)).groupBy("conv_key", "block")
        .agg(F.array_sort(F.collect_list(F.struct("place", "step"))).alias("steps"))
        .select("conv_key", "block", F.transform("steps", lambda s: s["step"]).alias("steps")), "blocks",
    )
    matrices = coded.mapInArrow(lambda b: matrices_of(b, costs), "conv_key string, block long, matrix array<long>")
    behind = matrices.groupBy("conv_key").applyInPandas(lambda g: ends_of(g, costs), "conv_key string, block long, cost long, `end` array<long>")
    traced = stored(
        coded.join(behind, ["conv_key", "block"]).select("conv_key", "block", "cost", "steps", "end")
        .mapInArrow(lambda b: traces_of(b, costs), "conv_key string, block long, cost long, steps array<int>, edits array<string>, exits array<int>"), "traces",
    )
    entries = traced.select("conv_key", "block", "exits").groupBy("conv_key").applyInPandas(lambda g: entries_of(g, costs), "conv_key string, block long, entry int, closing int")
    chosen = stored(
        traced.join(entries, ["conv_key", "block"]).select(
            "conv_key", "block", "cost", "steps", "entry",
            F.concat(F.get("edits", F.col("entry")), F.repeat(F.lit("I"), F.col("closing"))).alias("edits"),
        ), "edits",
    )
    audits = chosen.groupBy("conv_key").agg(
        F.max(F.when(F.col("block") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "").alias("audit"),
    )
    hashed = placed_edits(placed, chosen, size).repartition("conv_key").sortWithinPartitions("conv_key", "place", "slot").select("conv_key", "line").mapInArrow(hashes_of, "conv_key string, repaired_sha256 string")
    counts = counted(placed)
    none = hashlib.sha256(b"").hexdigest()
    found = rows.groupBy("conv_key").agg(F.first("conv").alias("conv")).join(counts, "conv_key", "left").join(audits, "conv_key", "left").join(hashed, "conv_key", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.select(
        "conv", *[v.alias(c) for c, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256")
    )


def counted(placed: DataFrame) -> DataFrame:
    """gaps, blank, duplicate, truncated and illegal of long conversations; neighbours meet across ranges of places."""
    n, fault, role = F.col("copies"), F.col("step") % 3, F.floor(F.col("step") / 3)
    repeated = F.when(F.col("blank"), 0).when(F.col("seen"), n).otherwise(n - 1)
    turns = placed.groupBy("conv_key", "turn").agg(F.count("*")).where("turn is not null").groupBy("conv_key")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    base = placed.groupBy("conv_key").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"), F.sum(repeated).alias("duplicate"),
        F.sum(F.when((fault == CUT) & ~F.col("seen"), 1).otherwise(0)).alias("truncated"),
        F.sum(n - 1).alias("repeats"),
    )
    chunk = F.floor(F.col("place") / BLOCK)
    ends = placed.select("conv_key", role.alias("role"), "place", (F.col("place") + n).alias("then"))
    ahead = ends.select("conv_key", F.col("place").alias("then"), F.col("role").alias("next_role"))
    legal = F.concat("role", "next_role").isin("01", "12", "21")
    pairs = ends.join(ahead, ["conv_key", "then"]).withColumn("bad", (~legal).cast("long"))
    bad = pairs.groupBy("conv_key", chunk.alias("chunk")).agg(F.sum("bad").alias("bad")).groupBy("conv_key").agg(F.sum("bad").alias("bad"))
    out = base.join(gaps, "conv_key", "left").join(bad, "conv_key", "left")
    return out.select("conv_key", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.coalesce("bad", F.lit(0)) + F.col("repeats")).alias("illegal"))


def placed_edits(placed: DataFrame, chosen: DataFrame, size: int) -> DataFrame:
    """conv_key, place, slot, line: the repaired turns of long conversations, each with its role and text."""
    edits = chosen.mapInArrow(lambda b: edits_of(b, size), "conv_key string, place long, slot int, edit string, says string")
    both = edits.join(placed.select("conv_key", "place", "role", "text"), ["conv_key", "place"], "left")
    line = F.when(F.col("edit") == "K", F.concat_ws(":", "role", "text")).when(F.col("edit") == "R", F.concat_ws(":", "says", "text")).otherwise(F.concat("says", F.lit(":")))
    return both.select("conv_key", "place", "slot", line.alias("line"))


def block_grid(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    steps = batch.column(batch.schema.get_field_index("steps"))
    lengths = np.asarray(steps.value_lengths())
    return time_major(steps.flatten().to_numpy().astype(np.int64), np.cumsum(lengths) - lengths, lengths), lengths


def lanes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (batch.slice(a, 32) for a in range(0, batch.num_rows, 32))


def matrices_of(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Of each block, the cost from each state before it to each state behind it."""
    machine = Machine(costs)
    for batch in lanes(batches):
        grid, _ = block_grid(batch)
        ways = []
        for to in range(STATES):
            end = np.full((grid.shape[1], STATES), NO_WAY, np.int64)
            end[:, to] = 0
            ways.append(machine.solve(grid, machine.with_inserts(end))[0])
        matrix = np.stack(ways, axis=2).reshape(grid.shape[1], -1).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(matrix, pa.list_(pa.int64()))], names=["conv_key", "block", "matrix"])


def ends_of(group, costs: Costs):
    """The costs of each state behind each block, from the last block to the first."""
    machine = Machine(costs)
    group = group.sort_values("block")
    after, out = machine.end, []
    for matrix in reversed(group["matrix"].tolist()):
        out.append(after)
        after = (np.asarray(matrix).reshape(STATES, STATES) + after).min(axis=1)
    group["end"] = [e.tolist() for e in reversed(out)]
    group["cost"] = int(after[0])
    return group[["conv_key", "block", "cost", "end"]]


def traces_of(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """Edits and state behind, of each block from each state before it."""
    machine = Machine(costs)
    for batch in lanes(batches):
        grid, _ = block_grid(batch)
        end = np.asarray(batch.column(4).flatten().to_numpy()).reshape(-1, STATES)
        cost = machine.solve(grid, end)
        edits, exits = [], []
        for entry in range(STATES):
            made, state = machine.trace(grid, cost, np.full(grid.shape[1], entry))
            edits.append([s.decode() for s in strings_of(made)])
            exits.append(state.tolist())
        columns = [batch.column(k) for k in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(zip(*edits, strict=True)), pa.list_(pa.string())), pa.array(list(zip(*exits, strict=True)), pa.list_(pa.int32()))], names=["conv_key", "block", "cost", "steps", "edits", "exits"])


def entries_of(group, costs: Costs):
    """The state before each block, and the inserts behind the last."""
    machine = Machine(costs)
    group = group.sort_values("block")
    state, entry = 0, []
    for exits in group["exits"]:
        entry.append(state)
        state = int(exits[state])
    group["entry"], group["closing"] = entry, [0] * (len(entry) - 1) + [machine.closing(state)]
    return group[["conv_key", "block", "entry", "closing"]]


def edits_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """One row an edit that leaves or makes a turn: its place, the inserts before it first, and the role that it is given."""
    names, kinds = ("conv_key", "place", "slot", "edit", "says"), (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string())
    for batch in batches:
        rows = batch.select(["conv_key", "block", "steps", "entry", "edits"]).to_pylist()
        for row in rows:
            out, at, slot, state = [], 0, 0, row["entry"]
            for edit in row["edits"]:
                if edit != "D":
                    out.append((row["conv_key"], row["block"] * size + at, slot, edit, ROLES[SAYS[state]]))
                    state = row["steps"][at] // 3 + 1 if edit == "K" else int(NEXT[state])
                at, slot = (at, slot + 1) if edit == "I" else (at + 1, 0)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def hashes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, joined by newlines; rows come in order."""
    key, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["conv_key", "repaired_sha256"])

    for batch in batches:
        for k, line in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)).to_pylist(), strict=True):
            if k != key:
                if digest:
                    yield row()
                key, digest = k, hashlib.sha256(line)
            else:
                digest.update(b"\n" + line)
    if digest:
        yield row()


def split_by_size(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task may hold, and of all others, or None."""
    size = rows.groupBy("conv_key").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = durable(size.where((F.col("n") > LONG_ROWS) | (F.col("bytes") > LONG_BYTES)).select("conv_key", F.lit(True).alias("long")))
    if long.isEmpty():
        return rows, None
    marked = salted_join(rows, long, "conv_key", F.struct("turn", "role"), rows.count(), "left")
    return marked.where("long is null").drop("long"), marked.where("long").drop("long")


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """One row a conversation: conv, counts of faults, cost, audit and the hash of the repaired conversation."""
    rows = prepared(df, conv, turn, role, text, present)
    short, long = split_by_size(rows)
    found = solved_whole(short, costs)
    return found if long is None else found.unionByName(solved_blocks(long, costs))


def repaired_turns(df: DataFrame, conv: str, turn: str, role: str, text: str, costs: Costs = Costs()) -> DataFrame:
    """The repaired conversations, one row a turn: conv, position, edit (I, K or R), role, text.

    For conversations of up to ``LONG_ROWS`` turns and ``LONG_BYTES``; a longer one is an error here, ``repair`` takes it.
    """
    rows = prepared(df, conv, turn, role, text)
    short, long = split_by_size(rows)
    if long is not None:
        raise ValueError("a conversation is too long to be returned turn by turn")
    return turns_whole(short, costs)


def damaged(df: DataFrame) -> DataFrame:
    """Rows of conversations after the damage of the query, with ``there``: false for those that are dropped."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    rows = df.select("conv_id", "turn", "role", "text", kind.alias("kind"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"),
        (F.col("kind") != 0).alias("there"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair(rows, "conv_id", "turn", "role", "text", F.col("there")).withColumnRenamed("conv", "conv_id")
