"""Segmentation of mathematical prose into steps, as array expressions.

A text is cut into records: displays, lines, sentences and clauses. Which of them belong to one step is told by their
neighbours alone, but for displays, whose ends are told by the parity of the fences before. So each record gets the sign
that stands in front of it, a line end or a mark, and the joined text is split at the marks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions import text as X
from seamline.functions.arrays import let, running_sums

#: Words that only lead to the next step; marks that open or close a display.
CONNECTORS = ("then", "thus", "hence", "therefore", "so", "so that", "finally", "next", "now")
DISPLAY = ("\\[", "\\]")
FENCE = "$$"
#: Stands in no record: lines end at it.
MARK = "\x1e"

INSIDE, LEAD, END, PROSE = 0, 1, 2, 3


def _records(part: Column, whole: Column) -> Column:
    """A record, and whether it closes the display of the one before: it begins with a fence that a sentence follows."""
    rest = X.lstrip(F.substr(part, F.lit(3)))
    closes = ~whole & part.startswith(FENCE) & rest.rlike(r"\A[A-Z0-9(\[]")
    return F.struct(F.when(closes, rest).otherwise(part).alias("text"), closes.alias("closes"))


def _line_records(line: Column) -> Column:
    """Sentences of a line; of a single sentence its clauses, unless there are none or it shows structure."""
    no, yes = F.lit(False), F.lit(True)
    one = lambda whole: F.array(_records(line, whole))
    each = lambda parts: F.transform(parts, lambda p: _records(p, no))
    single = let(X.reasoning_clauses(line), lambda c: F.when(F.size(c) > 1, each(c)).otherwise(one(X.is_math_structure(line))))
    split = let(X.sentences_of_paragraph(line), lambda s: F.when(F.size(s) > 1, each(s)).otherwise(single))
    return F.when(line.startswith("\\begin{") | line.startswith("\\end{"), one(yes)).otherwise(split)


def _paragraph_records(paragraph: Column) -> Column:
    shown = (paragraph == FENCE) | F.contains(paragraph, F.lit("$$\n")) | F.contains(paragraph, F.lit("\n$$")) | X.is_env_marker(paragraph)
    lines = F.flatten(F.transform(X.lines(paragraph), _line_records))
    return F.when(shown, F.array(F.struct(paragraph.alias("text"), F.lit(False).alias("closes")))).otherwise(lines)


def math_records(text: Column) -> Column:
    """Texts of the records in order; a display that the next record closes ends with its fence."""
    paragraphs = X.filled(F.transform(X.paragraphs(X.strip(X.normalize_newlines(text))), X.normalize_math_paragraph))
    found = F.flatten(F.transform(paragraphs, lambda p: let(p, _paragraph_records)))

    def closed(records: Column) -> Column:
        ends = lambda x, i: F.coalesce(F.get(records, i + 1)["closes"], F.lit(False)) & ~x["text"].endswith(FENCE)
        return F.transform(records, lambda x, i: F.when(ends(x, i), F.concat(x["text"], F.lit(f" {FENCE}"))).otherwise(x["text"]))

    return let(found, closed)


def _kinds(records: Column) -> Column:
    """Structs (text, kind); a lone "$" goes. Inside a display a record is what it is only to the display."""
    fences = F.transform(records, lambda x: (x == FENCE).cast("int"))

    def told(open_: Column) -> Column:
        leads = lambda x: x.isin(*DISPLAY) | X.is_env_marker(x, "begin") | F.regexp_replace(F.lower(x), "[,;:]+$", "").isin(*CONNECTORS)
        kind = lambda x, i: F.when((F.get(open_, i) - (x == FENCE).cast("int")) % 2 == 1, INSIDE).when(leads(x), LEAD).when(X.is_env_marker(x, "end"), END).otherwise(PROSE)
        return F.transform(records, lambda x, i: F.struct(x.alias("text"), kind(x, i).alias("kind")))

    return F.filter(let(running_sums(fences), told), lambda r: (r["text"] != "$") | (r["kind"] == INSIDE))


def _steps(records: Column) -> Column:
    """Records joined to steps: leads go with what follows, ends and leads that nothing follows with what precedes."""
    trailing = F.array_position(F.transform(F.reverse(records), lambda r: r["kind"] != LEAD), True)
    last = F.size(records) - F.when(trailing > 0, trailing).otherwise(F.size(records) + 1).cast("int")

    def joined(last_: Column) -> Column:
        before = lambda i: F.get(records, i - 1)["kind"]
        stays = lambda r, i: (r["kind"].isin(INSIDE, END)) | (before(i) == LEAD) | (i > last_)
        sign = lambda r, i: F.when(i == 0, "").when(stays(r, i), "\n").otherwise(MARK)
        return F.array_join(F.transform(records, lambda r, i: F.concat(sign(r, i), r["text"])), "")

    found = F.split(let(last, joined), MARK, -1)
    return F.filter(found, lambda s: ~X.is_blank(s) & ~X.is_env_marker(s))


def math_segments(text: Column) -> Column:
    """Steps of a solution: sentences, clauses, displays and structural lines; none for null and blank texts."""
    steps = let(math_records(text), lambda records: let(_kinds(records), _steps))
    return F.when(X.is_blank(text) | text.isNull(), F.array().cast("array<string>")).otherwise(steps)
