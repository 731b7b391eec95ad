"""Numeric and mathematical answers: extraction, normal forms, equality, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.text import repair_latex, rx, strip

STRICT = r"####\s*(-?[0-9.,]+)"
NUMBER = r"-?[$0-9.,]{2,}|-?[0-9]+"


def normalize_number(c: Column) -> Column:
    """Without leading "$", commas, and punctuation after the last digit; empty is null."""
    s = F.replace(F.regexp_replace(strip(c), r"\A\$+", ""), F.lit(","), F.lit(""))
    return F.nullif(F.regexp_replace(s, rx(r"(?<=\d)[.!?,:;]+\Z"), ""), F.lit(""))


def normalize_candidate(c: Column) -> Column:
    n = normalize_number(c)
    return F.when(~n.isin("-", ".", "-."), n)


def last_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0)), F.lit(-1))


def gsm8k_answer(c: Column) -> Column:
    """The first number after "####", else the last number-like run; null if there is none."""
    marked = F.regexp_extract(c, rx(STRICT), 1)
    return F.when(marked != "", normalize_number(marked)).otherwise(normalize_number(last_number(c)))


def gsm8k_correct(gold: Column, prediction: Column) -> Column:
    return F.coalesce(gsm8k_answer(gold) == gsm8k_answer(prediction), F.lit(False))


def tail_candidate(c: Column, budget: int = 4) -> Column:
    """A number from the last lines: of the last line with a cue word, else of the last closed sentence, else a numeric last line."""
    kept = F.filter(F.split(F.regexp_replace(c, rx(r"\s+\Z"), ""), "\r\n|[\n\r\x0b\x0c]", -1), lambda x: x.rlike(rx(r"\S")))
    kept = F.transform(kept, lambda x: F.regexp_replace(x, rx(r"\s+\Z"), ""))
    tail = F.slice(kept, F.greatest(F.size(kept) - max(1, budget), F.lit(0)) + 1, F.lit(max(1, budget)))
    cue = r"(?i)\A(?:final answer|answer|therefore|thus|hence|so)\b"

    def newest(parts: Column) -> Column:
        return F.try_element_at(F.filter(F.transform(parts, lambda x: normalize_candidate(last_number(x))), lambda v: v.isNotNull()), F.lit(-1))

    by_cue = newest(F.filter(F.transform(tail, strip), lambda x: x.rlike(rx(cue))))
    parts = F.transform(F.split(strip(F.array_join(tail, "\n")), rx(r"(?<=[.!?])\s+"), -1), strip)
    by_sentence = newest(F.filter(parts, lambda x: x.rlike(r"[.!?]\Z")))
    last = strip(F.try_element_at(kept, F.lit(-1)))
    by_line = F.when(last.rlike(rx(r"\A\$?-?[\d,]+(?:\.\d+)?\.?\z")), normalize_candidate(last))
    return F.coalesce(by_cue, by_sentence, by_line)


def with_landing(generated: Column, gold: Column, enabled: bool = True, budget: int = 4) -> Column:
    """Generated text with "#### n" added where it lacks one, the gold answer has one and the tail holds a number."""
    if not enabled:
        return generated
    bare = F.regexp_replace(generated, rx(r"\s+\Z"), "")
    fits = F.contains(gold, F.lit("####")) & (bare != "") & ~bare.rlike(rx(STRICT))
    return F.when(fits & tail_candidate(bare, budget).isNotNull(), F.concat(bare, F.lit("\n#### "), tail_candidate(bare, budget))).otherwise(generated)


def numeric(c: Column) -> Column:
    return gsm8k_answer(c).try_cast("double")


def margin_score(gold: Column, prediction: Column) -> Column:
    """1 for the exact number, else 0.2 + 0.6 / (1 + relative error); 0 where a side is no number."""
    error = F.abs(prediction - gold) / F.greatest(F.abs(gold), F.lit(1.0))
    return F.when(gold.isNull() | prediction.isNull(), 0.0).when(gold == prediction, 1.0).otherwise(0.2 + 0.6 / (1 + error))


def normalize_math_answer(c: Column) -> Column:
    s = strip(F.regexp_replace(c, rx(r"\s+"), " "))
    return F.nullif(F.regexp_replace(s, r"(?<!\\)[.!?,:;]+\Z", ""), F.lit(""))


def canonical_answer(c: Column) -> Column:
    """Simple fractions as a/b, without braces, thin spaces, commas and white space."""
    s = normalize_math_answer(repair_latex(c))
    s = F.regexp_replace(s, rx(r"\\frac\s*\{\s*([^{}]+?)\s*\}\s*\{\s*([^{}]+?)\s*\}"), "$1/$2")
    for gone in ("\\dfrac", "\\tfrac", "{", "}", "\\,", ","):
        s = F.replace(s, F.lit(gone), F.lit(""))
    return F.nullif(F.regexp_replace(s, rx(r"\s+"), ""), F.lit(""))


def last_boxed(c: Column) -> Column:
    r"""Content of the last ``\boxed{...}`` by matching braces, or of ``\boxed x`` up to "$"; null without one.

    Depth at each brace is a running count over the split text, so the work is linear.
    """
    spaced = F.substring_index(F.substring_index(c, "\\boxed ", -1), "$", 1)
    tail = F.substring_index(c, "\\boxed", -1)
    marks = F.regexp_extract_all(tail, F.lit(r"[{}]|[^{}]+"), F.lit(0))

    def step(state: Column, part: Column) -> Column:
        open_ = F.when(part == "{", 1).when(part == "}", -1).otherwise(0)
        depth = F.when(state["closed"], state["depth"]).otherwise(state["depth"] + open_)
        closed = state["closed"] | ((part == "}") & (depth == 0))
        return F.struct(depth.alias("depth"), closed.alias("closed"), F.when(state["closed"], state["text"]).otherwise(F.concat(state["text"], part)).alias("text"))

    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.lit("").alias("text"))
    found = F.aggregate(marks, start, step)
    braced = F.when(found["closed"], F.when(F.startswith(found["text"], F.lit("{")), F.substr(found["text"], F.lit(2), F.length(found["text"]) - 2)).otherwise(F.concat(F.lit("\\boxed"), found["text"])))
    return F.when(F.contains(c, F.lit("\\boxed ")), spaced).when(F.contains(c, F.lit("\\boxed")), braced)


def math_answer(c: Column) -> Column:
    """Boxed content, else what stands between the first and the last "$", else the text."""
    s = repair_latex(c)
    dollars = F.regexp_extract(s, r"(?s)\$(.*)\$", 1)
    between = F.when(s.rlike(r"(?s)\$.*\$"), normalize_math_answer(dollars))
    whole = F.when(~s.rlike(r"(?s)\$.*\$"), normalize_math_answer(strip(s)))
    return F.when(last_boxed(s).isNotNull(), normalize_math_answer(last_boxed(s))).otherwise(F.coalesce(between, whole))


def same_fraction(a: Column, b: Column) -> Column:
    """Equality of whole numbers, decimals and simple fractions, exactly, by cross-multiplication."""
    pattern = r"\A[-+]?\d+(?:\.\d+)?(?:/\d+)?\z"

    def part(x: Column, k: int) -> Column:
        side = F.try_element_at(F.split(x, "/", -1), F.lit(k))
        return (F.coalesce(side, F.lit("1")) if k == 2 else side).try_cast("decimal(18,6)")

    exact = part(a, 1) * part(b, 2) == part(b, 1) * part(a, 2)
    sound = a.rlike(pattern) & b.rlike(pattern) & (part(a, 2) != 0) & (part(b, 2) != 0)
    return (a == b) | F.coalesce(sound & exact, F.lit(False))


def math_correct(gold: Column, prediction: Column) -> Column:
    g, p = math_answer(gold), math_answer(prediction)
    same = (g == p) | F.coalesce(same_fraction(canonical_answer(g), canonical_answer(p)), F.lit(False))
    return F.coalesce(same, F.lit(False))


def percent(c: Column) -> Column:
    return F.bround(c * 100, 2)


#: What the canonical form of a LaTeX answer leaves out or rewrites, in order.
LATEX_EDITS = (
    ("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""),
    ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""),
)
LATEX_LATE_EDITS = (("\\%", ""), (" .", " 0."), ("{.", "{0."))


def braced_fractions(c: Column) -> Column:
    r"""``\frac12`` and ``\frac1{23}`` with braces around single characters."""
    c = F.regexp_replace(c, r"\\frac([^{\\])([^{])", r"\\frac{$1}{$2}")
    return F.regexp_replace(c, r"\\frac([^{\\])\{", r"\\frac{$1}{")


def braced_roots(c: Column) -> Column:
    return F.regexp_replace(c, r"\\sqrt([^{])", r"\\sqrt{$1}")


def slash_fraction(c: Column) -> Column:
    r"""``a/b`` of whole numbers without sign or leading zeros as ``\frac{a}{b}``."""
    whole = r"(-?[1-9][0-9]*|0)"
    return F.regexp_replace(c, rf"\A{whole}/{whole}\z", r"\\frac{$1}{$2}")


def without_units(c: Column) -> Column:
    r"""Cut at the one ``\text{ `` there is; texts with several stay."""
    parts = F.split(c, r"\Q\text{ \E", -1)
    return F.when(F.size(parts) == 2, F.get(parts, 0)).otherwise(c)


def canonical_latex(c: Column) -> Column:
    """Canonical form of a LaTeX answer, for equality as text."""
    for old, new in LATEX_EDITS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = without_units(c)
    for old, new in LATEX_LATE_EDITS:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.regexp_replace(c, r"\A\.", "0.")
    sides = F.split(c, "=", -1)
    c = F.when((F.size(sides) == 2) & (F.length(F.get(sides, 0)) <= 2), F.get(sides, 1)).otherwise(c)
    c = braced_fractions(F.replace(braced_roots(c), F.lit(" "), F.lit("")))
    return slash_fraction(F.when(c == "0.5", "\\frac{1}{2}").otherwise(c))


def same_latex(prediction: Column, target: Column) -> Column:
    """Null-safe equality of canonical forms."""
    return canonical_latex(prediction).eqNullSafe(canonical_latex(target))
