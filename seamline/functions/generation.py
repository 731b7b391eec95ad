"""What goes into a model and what comes out: prompts by task and kind of model, texts cut at stop strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.answers import with_landing
from seamline.functions.arrays import let
from seamline.functions.text import rstrip

#: The task whose raw completions are cut at further stops, and those stops.
COMPLETED = "humaneval"
COMPLETION_STOPS = ("\n```", "\n###")
#: What is put around code to be completed, by style.
BODY_STYLES = ("body_comment", "humaneval_body_comment")
LEAD_STYLES = ("instruction_prefix", "humaneval_instruction_prefix")
BODY_COMMENT = "\n    # Complete the function body. Return only valid Python code for the body.\n"
LEAD = "Complete the following Python function. Return only the indented function body; do not include markdown, tests, or explanations.\n\n"


def first_stop(text: Column, stops: list[str]) -> Column:
    """Characters before the first stop; the text's length without one.

    Stops are looked for in turn, each in what those before it have left: one that begins earlier but reaches into a
    cut is gone with it. A stop's first place in the whole text decides, so that the text is read once a stop and cut once.
    """
    def nearer(left: Column, at: Column, size: int) -> Column:
        return let(F.struct(left.alias("left"), at.alias("at")), lambda x: F.when((x["at"] >= 0) & (x["at"] + size <= x["left"]), x["at"]).otherwise(x["left"]))

    out = F.length(text)
    for stop in filter(None, stops):
        out = nearer(out, F.instr(text, stop) - 1, len(stop))
    return out


def cut_at_first_stop(text: Column, stops: list[str]) -> Column:
    """``text`` before its first stop, white space at the end off; null stays null."""
    return rstrip(F.substring(text, F.lit(1), first_stop(text, stops).cast("int")))


def completes_code(task_id: Column, entry_point: Column, solution: Column, tests: Column, description: Column) -> Column:
    """Whether a record asks for code: by its task's name, or by the fields that it has."""
    named = F.coalesce(F.lower(task_id).startswith(COMPLETED), F.lit(False))
    return named | (entry_point.isNotNull() & solution.isNotNull()) | (tests.isNotNull() & description.isNotNull())


def generation_prompt(question: Column, is_code: Column, instruct: bool, style: str = "raw", chat: Callable[[Column], Column] | None = None) -> Column:
    """A prompt: code in its style, questions to an instructed model as a chat, all else as it is."""
    style = (style or "raw").strip().lower()
    code = F.concat(rstrip(question), F.lit(BODY_COMMENT)) if style in BODY_STYLES else F.concat(F.lit(LEAD), question) if style in LEAD_STYLES else question
    plain = chat(question) if instruct and chat is not None else question
    return F.when(is_code, code).otherwise(plain)


def generated_text(
    tokens: Column, stops: list[str], instruct: bool, task_id: Column, source: Column, gold: Column, specials: list[str], landing: bool = False, budget: int = 4
) -> Column:
    """Text of generated tokens (strings): special ones dropped, cut at the first stop, school maths brought to its answer line.

    Raw completions drop special tokens first and have further stops; elsewhere specials count as text for the stops
    and are dropped from what is left.
    """
    raw = F.coalesce(F.lower(task_id).startswith(COMPLETED), F.lit(False)) if instruct else F.lit(False)
    named = F.array(*map(F.lit, specials)) if specials else F.array().cast("array<string>")
    bare = F.array_join(F.filter(tokens, lambda t: ~F.array_contains(named, t)), "")
    plain = cut_at_first_stop(F.array_join(tokens, ""), stops)
    for s in specials:
        plain = F.replace(plain, F.lit(s), F.lit(""))
    landed = F.when(F.lower(source) == "gsm8k", with_landing(plain, gold, landing, budget)).otherwise(plain)
    return F.when(raw, cut_at_first_stop(bare, [*stops, *COMPLETION_STOPS])).otherwise(landed)


def with_prompt(prompt: Column, responses: Column) -> Column:
    """Every response with the prompt in front: what is run to judge a completion."""
    return F.transform(responses, lambda r: F.concat(prompt, r))
