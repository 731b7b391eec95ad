"""Records of changing shape: metric payloads, chat messages, prompts, lookups, schedules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.arrays import empty, let
from seamline.functions.text import before_starter_code, first_nonblank, strip, strip_html

#: Keys of metrics in order of preference, label weights, synonyms, stages.
PREFERRED = ("pass@1,none", "pass@1", "pass_at_1,none", "pass_at_1")
CONFIDENCE = {"gold": 1.0, "silver": 0.5, "ignore": 0.0}
DESCRIPTIONS = ("problem", "description", "question_content", "question", "prompt", "problem_statement", "content", "title")
STAGES = ((0.1, "stage_a"), (0.4, "stage_b"), (None, "stage_c"))


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(key: Column, values: dict, default) -> Column:
    return F.coalesce(F.try_element_at(literal_map(values), key), F.lit(default))


def confidence_weight(label: Column) -> Column:
    return lookup(label, CONFIDENCE, 0.5)


def metric(payload: Column, aliases: list[str]) -> Column:
    """A score of a map of task to map of metric: the first task named, preferred keys, else any pass@1 key."""
    lowered = F.transform_keys(payload, lambda k, _: F.lower(strip(k)))

    def score(tasks: Column) -> Column:
        task = F.coalesce(*[F.try_element_at(tasks, F.lit(a)) for a in aliases])
        return let(F.transform_keys(task, lambda k, _: F.lower(strip(k))), of)

    def of(metrics: Column) -> Column:
        near = F.map_filter(metrics, lambda k, _: F.contains(k, F.lit("pass@1")) | F.contains(k, F.lit("pass_at_1")))
        return F.coalesce(*[F.try_element_at(metrics, F.lit(k)) for k in PREFERRED], F.get(F.map_values(near), 0))

    return let(lowered, score)


def metric_or_missing(direct: Column, payloads: list[Column], aliases: list[str]) -> Column:
    """A value given directly, else from the first payload that has it, else -1."""
    return F.coalesce(direct, *[metric(p, aliases) for p in payloads], F.lit(-1.0))


def chat_messages(messages: Column, conversations: Column) -> Column:
    """Both arrays one after the other; null arrays are empty."""
    return F.concat(F.coalesce(messages, F.array()), F.coalesce(conversations, F.array()))


def message_role(m: Column, role: str = "role", sender: str = "from") -> Column:
    return F.lower(strip(F.coalesce(F.nullif(m[role], F.lit("")), m[sender], F.lit(""))))


def message_text(m: Column, content: str = "content", value: str = "value") -> Column:
    return strip(F.coalesce(F.nullif(m[content], F.lit("")), m[value], F.lit("")))


def last_text(messages: Column, roles: list[str]) -> Column:
    """The last text that is not empty among messages of the given roles; "" without one."""
    own = F.filter(messages, lambda m: message_role(m).isin(*roles) & (message_text(m) != ""))
    return F.coalesce(message_text(F.try_element_at(own, F.lit(-1))), F.lit(""))


def task_description(columns: list[Column], messages: Column) -> Column:
    """First filled description, else the last user message; without starter code and markup."""
    return strip_html(before_starter_code(F.coalesce(first_nonblank(*columns), last_text(messages, ["user", "human"]))))


def first_response(responses: Column) -> Column:
    return F.coalesce(F.get(F.get(responses, 0), 0), F.lit(""))


def delta_scores(raw: Column) -> Column:
    """String keys of a map as whole numbers; keys that are none, or scores that are not finite, raise."""
    bad = F.exists(F.map_entries(raw), lambda e: e["key"].try_cast("int").isNull() | e["value"].isNull() | F.isnan(e["value"]) | (F.abs(e["value"]) == float("inf")))
    checked = F.when(bad, F.raise_error(F.lit("delta scores need whole keys and finite values")).cast("map<string,double>")).otherwise(raw)
    return F.transform_keys(checked, lambda k, _: k.cast("int"))


def gate_target(on: Column, off: Column) -> Column:
    """1 if carrying scores higher; ties are 0."""
    return (on > off).cast("int")


def keep_or_adjust(delta: Column) -> Column:
    return F.when(delta == 0, "keep").otherwise("adjust")


def delta_class(delta: Column, deltas: tuple[int, ...] = (-2, -1, 0, 1, 2)) -> Column:
    """Index of a delta among the classes; any other delta raises."""
    at = F.array_position(F.array(*map(F.lit, deltas)), delta) - 1
    return F.when(at >= 0, at).otherwise(F.raise_error(F.lit("no such delta")).cast("long")).cast("int")


def progress_stage(progress: Column) -> Column:
    chain = None
    for limit, name in STAGES[:-1]:
        chain = F.when(progress < limit, name) if chain is None else chain.when(progress < limit, name)
    return chain.otherwise(STAGES[-1][1])


def teacher_forcing(progress: Column) -> Column:
    """1 up to 0.4 of the training, 0 from 0.7, linear between."""
    return linear_ramp(progress, 0.4, 0.7, 1.0, 0.0)


def linear_ramp(progress: Column, start: float, end: float, first: float, last: float) -> Column:
    """``first`` up to ``start``, ``last`` from ``end``, linear between."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (progress - start) / (end - start)))
    return first + share * (last - first)


def qa_prompt(question: Column, examples: Column, lead: str = "Q: ", cue: str = "A: Let's think step by step.") -> Column:
    """Worked examples (structs question, answer), then the question; parts by blank lines."""
    shown = F.transform(examples, lambda e: F.concat(F.lit(lead), strip(e["question"]), F.lit(f"\n{cue}\n"), strip(e["answer"])))
    asked = F.concat(F.lit(lead), strip(question), F.lit(f"\n{cue}"))
    return F.array_join(F.array_append(F.coalesce(shown, empty("string")), asked), "\n\n")


def sections(parts: list[tuple[str, Column]]) -> Column:
    """Struct (text, starts, ends): titled sections one after the other, with the offsets of their bodies.

    Blank sections are left out and have offsets -1.
    """
    text, starts, ends = F.lit(""), [], []
    for title, body in parts:
        some = F.coalesce(strip(body), F.lit("")) != ""
        head = F.concat(text, F.when(text == "", F.lit("")).otherwise(F.lit("\n\n")), F.lit(f"{title}:\n"))
        starts.append(F.when(some, F.length(head)).otherwise(-1))
        full = F.concat(head, strip(body))
        ends.append(F.when(some, F.length(full)).otherwise(-1))
        text = F.when(some, full).otherwise(text)
    return F.struct(text.alias("text"), F.array(*starts).alias("starts"), F.array(*ends).alias("ends"))


def first_tests(tests: Column, most: int = 3) -> Column:
    """The first test cases (structs input, output) as text."""
    shown = F.transform(F.slice(tests, F.lit(1), F.lit(most)), lambda t: F.concat(F.lit("Input:\n"), strip(t["input"]), F.lit("\nOutput:\n"), strip(t["output"])))
    return F.array_join(shown, "\n\n")


def token_span(ends: Column, start: Column, end: Column) -> Column:
    """Struct (first, last): the tokens that a character span covers, one at least, given the tokens' end offsets."""
    n = F.size(ends)
    before = F.size(F.filter(ends, lambda e: e <= start))
    upto = F.size(F.filter(ends, lambda e: e < end)) + 1
    first = F.least(before, F.greatest(n - 1, F.lit(0)))
    return F.struct(first.alias("first"), F.least(F.greatest(upto, first + 1), n).alias("last"))


def confident_transfer(confidence: Column, threshold: Column) -> Column:
    """0/1 of positions whose confidence reaches the threshold; the best one always."""
    top = F.array_max(confidence)
    best = F.array_position(confidence, top) - 1
    return F.transform(confidence, lambda c, i: ((c >= threshold) | (i == best)).cast("int"))


def ranked_transfer(confidence: Column, factor: float) -> Column:
    """0/1 of the best n positions, n being the greatest with its confidence at 1 - factor / (n + 1) or more; one at least, ties of the last one included."""
    ordered = F.sort_array(confidence, asc=False)
    good = F.transform(ordered, lambda c, i: c >= 1 - F.lit(factor) / (i + 2))
    misses = F.array_position(good, False)
    n = F.greatest(F.lit(1), F.when(misses > 0, misses - 1).otherwise(F.size(ordered)))
    least = F.get(ordered, n.cast("int") - 1)
    return F.transform(confidence, lambda c: (c >= least).cast("int"))


def degraded_length(length: Column, mode: str, strength: int, step: Column, remaining: Column, default: Column, draw: Column) -> Column:
    """A block length disturbed on purpose: early, late, jitter, oversegment, or random (by ``draw``, from 0 to below 1).

    Other modes, and a strength of 0, leave it as it is. The outcome is 1 at least and what remains at most.
    """
    if mode.lower() in ("none", "off", "") or strength <= 0:
        return length.cast("int")
    length = F.greatest(F.lit(1), F.least(length, remaining))
    moved = {
        "early": length - strength, "late": length + strength, "jitter": length + F.when(step % 2 == 0, strength).otherwise(-strength),
        "oversegment": F.floor(length / F.lit(max(2, strength))), "random": 1 + F.floor(draw * F.least(default, remaining)),
    }.get(mode.lower(), length)
    return F.greatest(F.lit(1), F.least(moved, remaining)).cast("int")


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def slug(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")


def option_text(options: dict[str, Column | str | float | bool | None], lists: tuple[str, ...] = ()) -> Column:
    """"name=value" parts joined by commas; null options are left out, commas inside those of ``lists`` become bars."""
    parts = []
    for name, value in options.items():
        if value is None:
            continue
        given = value if isinstance(value, Column) else F.lit(str(value))
        text = given.cast("string")
        parts.append(F.concat(F.lit(f"{name}="), F.replace(text, F.lit(","), F.lit("|")) if name in lists else text))
    return F.concat_ws(",", *parts)


def count_of(items: Column) -> Column:
    """Length of an array, 0 for null."""
    return F.coalesce(F.size(items), F.lit(0))


def as_json(columns: list[str]) -> Column:
    """A record as JSON, null fields included, in order of ``columns``."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def separator_tokens(tokenize: Callable[[str], list[int]], separator: str = "\n") -> Column:
    """Tokens of the separator between segments as a constant array: of the first of it, a line end and a blank that has any."""
    found = next((t for s in (separator, "\n", " ") if s and (t := tokenize(s))), [])
    return F.array(*map(F.lit, found)).cast("array<int>")
