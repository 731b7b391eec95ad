"""Lengths of blocks from what a window of decoded tokens shows: sentences, steps, lines of code, scores.

A window is an array of token texts. A rule asks which beginning of the window first shows a boundary; the block ends
with the token that completes it. Beginnings are not written out where tokens and places of matches tell as much.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.arrays import let, running_sums

#: What ends a sentence, a clause and a step, and what a line of code begins with.
SENTENCE = r"[.?!](\s|$)"
CLAUSE = r"[,;](\s|$)"
MARKER = r"<<.*?>>|####"
CONNECTIVES = "therefore|thus|hence|so|since|because|we have|we get|it follows"
CODE_WORDS = "def|class|if|elif|else|for|while|return|with|try|except|finally|import|from|async|yield"
WINDOW_RATIO = 0.25

#: A keyword begins a line, or a line at the margin follows an indented one. Where the open form is nowhere in a window, the
#: closed one is in no beginning of it.
_MARGIN = r"(?:^|\n)[^\S\n][^\n]*\n\S"
_CODE = rf"(?U)\n[^\S\n]*(?:{CODE_WORDS})\b|{_MARGIN}"
_CODE_OPEN = rf"(?U)\n[^\S\n]*(?:{CODE_WORDS})|{_MARGIN}"
_CONNECTIVE = rf"(?iU)\b(?:{CONNECTIVES})\b"
#: Characters before a token in which a connective that ends in it can begin, and one more.
_REACH = max(map(len, CONNECTIVES.split("|"))) + 1


def beginnings(tokens: Column) -> Column:
    """The window's text up to each of its tokens."""
    each = let(tokens, lambda t: F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.array_join(F.slice(t, F.lit(1), i), "")))
    return F.when(F.size(tokens) > 0, each).otherwise(F.array().cast("array<string>"))


def first_with(texts: Column, pattern: str) -> Column:
    """1-based place of the first text in which the pattern is found; null without one."""
    return F.nullif(F.array_position(F.transform(texts, lambda x: x.rlike(pattern)), True), F.lit(0).cast("long"))


def sentence_length(tokens: Column, default: Column) -> Column:
    """Tokens up to the first sentence end, without one to the first clause end, else ``default``.

    A mark ends a sentence before a blank or at the end of what is there, which is a token's end: tokens tell it one by one.
    """
    return F.coalesce(first_with(tokens, "(?U)" + SENTENCE), first_with(tokens, "(?U)" + CLAUSE), default.cast("long"))


def step_length(tokens: Column, default: Column) -> Column:
    """Tokens up to the first marker, connective or line end. A connective that the window begins with hides later ones."""

    def reaching(window: Column, at: Column) -> Column:
        """1-based token in which the text up to character ``at`` ends."""
        return F.nullif(F.array_position(F.transform(window["ends"], lambda e: e >= at), True), F.lit(0).cast("long"))

    def matched(window: Column, pattern: str) -> Column:
        found = F.regexp_extract(window["text"], pattern, 0)
        return F.when(found != "", reaching(window, F.regexp_instr(window["text"], F.lit(pattern)) + F.length(found) - 1))

    def connective(window: Column) -> Column:
        """First token that a connective ends in or with; each token is looked at with as much before it as one can hold."""

        def here(end: Column, i: Column) -> Column:
            start = F.when(i > 0, F.get(window["ends"], i - 1)).otherwise(F.lit(0).cast("long"))
            cut = F.greatest(start - _REACH, F.lit(0))
            part = F.substr(window["text"], (cut + 1).cast("int"), (end - cut).cast("int"))
            return F.when(cut > 0, part.rlike(_CONNECTIVE.replace("(?iU)", r"(?iU)(?<=[\s\S])"))).otherwise(part.rlike(_CONNECTIVE))

        return F.nullif(F.array_position(F.transform(window["ends"], here), True), F.lit(0).cast("long"))

    def found(window: Column) -> Column:
        def inner(place: Column) -> Column:
            upto = F.substr(window["text"], F.lit(1), F.get(window["ends"], (place - 1).cast("int")).cast("int"))
            return F.when(~upto.rlike("^(?:" + _CONNECTIVE + ")"), place)

        marks = [matched(window, p) for p in MARKER.split("|")]
        return F.coalesce(F.least(*marks, let(connective(window), inner), first_with(window["tokens"], "\n")), default.cast("long"))

    window = F.struct(tokens.alias("tokens"), F.array_join(tokens, "").alias("text"), running_sums(F.transform(tokens, F.length)).alias("ends"))
    return F.when(F.size(tokens) > 0, let(window, found)).otherwise(default.cast("long"))


def code_length(tokens: Column, default: Column) -> Column:
    """Tokens up to the first that begins a new statement after a line end, by keyword or margin."""
    found = let(beginnings(tokens), lambda b: first_with(b, _CODE))
    return F.coalesce(F.when(F.array_join(tokens, "").rlike(_CODE_OPEN), found), default.cast("long"))


def first_tokens(text: Column, most: int, blank: str = "[ \\t\\n\\r]", solid: str = "[^ \\t\\n\\r]") -> Column:
    """The first ``most`` words of a text with the blanks before them; what follows is not looked at."""
    cut = F.regexp_extract(F.coalesce(text, F.lit("")), rf"\A(?:{blank}*+{solid}++){{0,{most}}}+", 0)
    return F.coalesce(F.regexp_extract_all(cut, F.lit(f"{blank}*+{solid}++"), F.lit(0)), F.array().cast("array<string>"))


RULES = {"nl": sentence_length, "math": step_length, "code": code_length}


def prior_length(tokens: Column, gen_length: int, generated: Column, default: Column, task: str, ratio: float = WINDOW_RATIO) -> Column:
    """Length of the next block by the task's rule, over the tokens still to come, at most what remains."""
    remaining = F.lit(gen_length) - generated
    size = F.greatest(F.least(F.lit(max(int(ratio * gen_length), 1)), remaining), F.lit(0)).cast("int")
    rule = RULES.get(task, sentence_length)
    return let(F.slice(tokens, F.lit(1), size), lambda window: F.least(rule(window, F.least(default, remaining)), remaining.cast("long")))


def planned_length(sizes: Column, block: Column, initial: int, gen_length: int, generated: Column) -> Column:
    """The planned size of a 0-based block, or the initial one beyond the plan, at most what remains; 0 at the end."""
    remaining = F.lit(gen_length) - generated
    return F.when(remaining <= 0, F.lit(0)).otherwise(F.least(F.coalesce(F.get(sizes, block), F.lit(initial)), remaining))


def endpoint_scores(scores: Column, lengths: Column) -> Column:
    """length, score, position of the candidate lengths whose last token has a score."""
    held = F.filter(lengths, lambda n: (n >= 1) & (n <= F.size(scores)))
    return F.transform(held, lambda n: F.struct(n.alias("length"), F.get(scores, n - 1).alias("score"), (n - 1).alias("position")))


def accepted_offsets(events: Column) -> Column:
    """Offsets of the events that were accepted."""
    return F.transform(F.filter(events, lambda e: e["accepted"]), lambda e: e["offset"])


def bucket_ranges(ranges: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
    """Inclusive ranges of task numbers, checked; three by default (fixed values)."""
    found = [(int(a), int(b)) for a, b in ranges or [(0, 49), (50, 99), (100, 163)]]
    for a, b in found:
        if a < 0 or b < a:
            raise ValueError(f"[{a}, {b}] is no range of task numbers")
    return found


def item_list(value: Column) -> Column:
    """Items of a list written with commas or bars, in brackets or not; null for blank, none for "[]"."""
    text = F.trim(value)
    inner = F.trim(F.regexp_replace(text, r"^\[([\s\S]*)\]$", "$1"))
    items = F.filter(F.transform(F.split(inner, r"[|,]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text != "", items)
