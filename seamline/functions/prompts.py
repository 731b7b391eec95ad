"""Training prompts that code follows: a signature with its doc, or a task with tests. Places are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.arrays import empty, let, offsets_of_lengths
from seamline.functions.text import is_blank, rstrip, strip

#: What stands in for a missing part, and the frame of a task with tests.
NO_TASK = "Implement the requested function."
NO_TESTS = "# Synthetic tests unavailable"
NO_SIGNATURE = "def solve(...):"
TASK, TESTS, BEGIN = "[TASK]\n", "\n[TESTS]\n", "\n[BEGIN]\n"
SECTIONS = ("[TASK]", "[SIGNATURE]", "[PUBLIC_TESTS]", "[CODE]")
TOKEN = r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"


def filled_or(c: Column, default: str) -> Column:
    """Without white space around it; ``default`` for blank and null."""
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit(default))


def signature_or_name(given: Column, name: Column) -> Column:
    """A signature that is given, else one made of the function's name, else null."""
    held = F.nullif(strip(name), F.lit(""))
    return F.coalesce(F.nullif(strip(given), F.lit("")), F.when(held.isNotNull(), F.format_string("def %s(...):", held)))


def callable_tests(given: Column, task: Column) -> Column:
    """Stand-in tests that name the function of a signature and the task."""
    name = F.nullif(strip(F.regexp_extract(given, r"(?s)\Adef ([^(]*)", 1)), F.lit(""))
    return F.format_string(
        "assert callable(%s)\n# Task intent: %s\n# Return value must satisfy the described contract.",
        F.coalesce(name, F.lit("candidate")), filled_or(task, "implement the function"),
    )


def numbered_tests(tests: Column, most: int = 3) -> Column:
    """The first tests (structs input, output), one a line; line ends inside them are written as ``\\n``."""
    flat = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit("\\n"))
    shown = F.transform(F.slice(F.coalesce(tests, F.array().cast("array<struct<input:string,output:string>>")), F.lit(1), F.lit(most)),
                        lambda t, i: F.concat(F.lit("case_"), (i + 1).cast("string"), F.lit(": "), flat(t["input"]), F.lit(" -> "), flat(t["output"])))
    return F.array_join(shown, "\n")


def before_code(lead: Column, code: Column) -> Column:
    """Struct (text, code_start): code without line ends at its end, after what leads to it."""
    return let(lead, lambda x: F.struct(
        F.concat(x, F.regexp_replace(F.coalesce(code, F.lit("")), r"\n+\z", "")).alias("text"), F.length(x).alias("code_start")
    ))


def documented_prompt(given: Column, task: Column, code: Column) -> Column:
    """``before_code`` of a signature and the task as its doc."""
    doc = F.replace(filled_or(task, NO_TASK), F.lit('"""'), F.lit(r'\"\"\"'))
    head = rstrip(F.coalesce(F.nullif(given, F.lit("")), F.lit(NO_SIGNATURE)))
    return before_code(F.concat(head, F.lit('\n    """'), doc, F.lit('"""\n')), code)


def tested_prompt(task: Column, tests: Column, code: Column) -> Column:
    """``before_code`` of a task and its tests."""
    return before_code(F.concat(F.lit(TASK), filled_or(task, NO_TASK), F.lit(TESTS), filled_or(tests, NO_TESTS), F.lit(BEGIN)), code)


def section(title: str, body: Column) -> Column:
    """A titled body without line ends around it; "" for blank and null."""
    held = F.regexp_replace(body, r"\A\n+|\n+\z", "")
    return F.when(~is_blank(held), F.concat(F.lit(f"{title}\n"), held, F.lit("\n"))).otherwise("")


def sectioned_prompt(task: Column, given: Column, tests: Column, code: Column) -> Column:
    """``before_code`` of titled sections; the task's is there even without a task, blank others are not."""
    first, second, third, last = SECTIONS
    opening = F.coalesce(F.nullif(section(first, task), F.lit("")), F.lit(f"{first}\n\n"))
    return before_code(F.concat(opening, section(second, given), section(third, tests), F.lit(f"{last}\n")), code)


def joined_code(segments: Column) -> Column:
    """Segments as one text: on new lines, but for those that bring their own blank or follow a colon or blank."""

    def add(done: Column, s: Column) -> Column:
        tight = (done == "") | done.rlike(r"[\n: ]\z") | s.rlike(r"\A[\n \t]")
        return F.concat(done, F.when(tight, "").otherwise("\n"), F.regexp_replace(s, r"\n+\z", ""))

    some = F.filter(F.coalesce(segments, empty("string")), lambda s: ~is_blank(s))
    return F.aggregate(some, F.lit(""), add, lambda done: F.when(done != "", F.concat(rstrip(done), F.lit("\n"))).otherwise(""))


def bare_checks(tests: Column) -> Column:
    """Tests whose calls of check with one name begin their lines; without a line end at the end."""
    bare = F.regexp_replace(tests, r"(?m)^[ \t]+(check\([A-Za-z_][A-Za-z0-9_]*\)[ \t]*)$", "$1")
    return F.coalesce(F.regexp_replace(bare, r"\n\z", ""), F.lit(""))


def token_starts(text: Column) -> Column:
    """Where tokens begin, words with the blanks before them being tokens; for callers without a tokenizer."""
    return offsets_of_lengths(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.length))


def token_count(text: Column) -> Column:
    """How many tokens ``token_starts`` tells apart."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)))
