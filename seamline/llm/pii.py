"""Personal data: patterns propose spans, checksums confirm them, context words raise or lower the score.

DataFrame operations only. Each pattern's matches and the pieces of text between them come from two
passes of the same regular expression; lengths of both, summed up, are the spans' offsets in code points.
Patterns are written without needless backtracking (possessive quantifiers, runs entered at their first
character only), which changes no match and keeps long runs linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.arrays import running_sums
from seamline.session import texts

#: Characters before and after a span, up to the next span of the kind, in which context words count.
CONTEXT = 40
KEEP_SCORE = 0.5


#: Words that say that a number is something else.
OTHER_NUMBERS = r"\b(?:order|invoice|ticket|part|serial|model|product|article|version|tracking|sku|isbn|ref)\b"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. Base kinds keep every match that the validator confirms; others need their score."""

    name: str
    pattern: str
    hint: str | None
    base: bool
    score: float
    context: str
    tag: str
    against: str = OTHER_NUMBERS


#: In the order of listing. ``hint``: a character without which there is no match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, r"e-?mail|contact|@", "<EMAIL>"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", True, 0.6, r"\bip\b|address|host|server", "<IP>"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])", None, True, 0.8, r"card|visa|credit|debit", "<CARD>"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.6, r"phone|tel|mobile|call|fax", "<PHONE>"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, False, 0.6, r"iban|bank|account|konto", "<IBAN>"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", False, 0.3, r"ssn|social security", "<SSN>"),
)
CONTEXT_STEP = 0.2
#: A part of an address from 0 to 255, with any zeros before it.
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def digits_of(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of ``match`` pass Luhn's check."""
    d = digits_of(match)

    def step(total: Column, k: Column) -> Column:
        digit = F.substr(d, k, F.lit(1)).cast("int")
        twice = (F.length(d) - k) % 2 == 1
        return total + F.when(~twice, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0


def mod97(match: Column) -> Column:
    """Whether ``match`` passes the check of ISO 7064 MOD 97-10 as an account number."""
    plain = F.replace(match, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(rest: Column, k: Column) -> Column:
        code = F.ascii(F.substr(turned, k, F.lit(1)))
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    good = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1
    return F.when(F.length(plain).between(15, 34), good).otherwise(False)


def confirmed(kind: Kind, match: Column) -> Column:
    n = F.length(digits_of(match))
    if kind.name == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind.name == "card":
        return F.when(n.between(14, 19), luhn(match)).otherwise(False)
    if kind.name == "phone":
        return n.between(10, 15)
    if kind.name == "iban":
        return mod97(match)
    return F.lit(True)


def matches(kind: Kind, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    none = F.array().cast("array<string>")
    return found if kind.hint is None else F.when(F.contains(text, F.lit(kind.hint)), found).otherwise(none)


def steps_to(found: Column, pieces: Column) -> Column:
    """Code points from the start of each match to the start of the next, from the text's start at first."""
    return F.transform(found, lambda _, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))


def spans_of(kind: Kind, rank: int, pieces: Column, found: Column, starts: Column) -> Column:
    """Confirmed matches of a kind with their offsets and scores."""

    def span(x: Column, i: Column) -> Column:
        start = F.get(starts, i)
        around = F.concat_ws(" ", F.right(F.get(pieces, i), F.lit(CONTEXT)), F.left(F.get(pieces, i + 1), F.lit(CONTEXT)))
        near = lambda words: F.lower(around).rlike(words).cast("double") * CONTEXT_STEP
        score = F.round(F.lit(kind.score) + near(kind.context) - near(kind.against), 3)
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(x)).alias("end"), F.lit(kind.name).alias("kind"),
            x.alias("match"), score.alias("score"), F.lit(kind.base).alias("base"), confirmed(kind, x).alias("confirmed"),
        )

    return F.filter(F.transform(found, span), lambda s: s["confirmed"] & (s["base"] | (s["score"] >= KEEP_SCORE)))


def find_spans(df: DataFrame, text: str, into: str = "pii") -> DataFrame:
    """``df`` with an array of structs: start, rank, end, kind, match, score, base; by start, then rank.

    A null text has no spans. An existing column ``into`` is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    def own(kind: Kind, what: str) -> str:
        return f"{into}_{kind.name}_{what}"

    out = df
    for k in KINDS:
        out = out.withColumn(own(k, "matches"), matches(k, t))
    for k in KINDS:
        some = F.size(own(k, "matches")) > 0
        out = out.withColumn(own(k, "pieces"), F.when(some, F.split(t, k.pattern, -1)).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<int>")
    for k in KINDS:
        out = out.withColumn(own(k, "steps"), steps_to(F.col(own(k, "matches")), F.col(own(k, "pieces"))))
    for k in KINDS:
        steps = F.col(own(k, "steps"))
        out = out.withColumn(own(k, "starts"), F.when(F.size(steps) > 0, running_sums(steps, "int")).otherwise(none))
    lists = [spans_of(k, rank, *[F.col(own(k, x)) for x in ("pieces", "matches", "starts")]) for rank, k in enumerate(KINDS)]
    plain = [own(k, x) for k in KINDS for x in ("matches", "pieces", "steps", "starts")]
    return out.withColumn(into, F.array_sort(F.concat(*lists))).drop(*plain)


#: The tag of overlapping spans is that of the first of these kinds.
TAG_ORDER = ("email", "iban", "card", "phone", "ip", "ssn")


def cut_spans(text: Column, spans: Column) -> Column:
    """``text`` with every run of overlapping ``spans`` replaced by one tag."""
    tags = F.array(*[F.lit(next(k.tag for k in KINDS if k.name == n)) for n in TAG_ORDER])
    order = F.array(*[F.lit(n) for n in TAG_ORDER])
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("end"), F.lit(0).alias("tag"))

    def tag(state: Column) -> Column:
        return F.coalesce(F.get(tags, state["tag"] - 1), F.lit(""))

    def step(state: Column, s: Column) -> Column:
        place, inside = F.array_position(order, s["kind"]).cast("int"), s["start"] < state["end"]
        between = F.substr(text, state["end"] + 1, s["start"] - state["end"])
        return F.struct(
            F.when(inside, state["done"]).otherwise(F.concat(state["done"], tag(state), between)).alias("done"),
            F.when(inside, F.greatest(state["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(inside, F.least(state["tag"], place)).otherwise(place).alias("tag"),
        )

    return F.aggregate(spans, start, step, lambda x: F.concat(x["done"], tag(x), F.substr(text, x["end"] + 1, F.length(text))))


def redact(df: DataFrame, text: str) -> DataFrame:
    """``df`` with every span that ``find_spans`` reports in ``text`` replaced by its kind's tag.

    Overlapping spans get one tag. What this leaves is gone through once more, kind by kind, for matches
    that the spans had hidden. Numbers whose context did not confirm them stay. Null stays null.
    """
    columns, spans = df.columns, "spans_of_" + text
    df = find_spans(df, text, spans)
    some = F.size(spans) > 0
    df = df.withColumn(text, F.when(some, cut_spans(F.col(text), F.col(spans))).otherwise(F.col(text)))
    for name in TAG_ORDER:
        kind = next(k for k in KINDS if k.name == name)
        if kind.base:
            df = df.withColumn(text, F.when(some, replace_matches(kind, F.col(text))).otherwise(F.col(text)))
    return df.select(*columns)


def replace_matches(kind: Kind, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    put = F.transform(found, lambda m: F.when(confirmed(kind, m), F.lit(kind.tag)).otherwise(m))
    pieces = F.split(text, kind.pattern, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(put, i), F.lit("")))), "")
    some = text.rlike(kind.pattern) if kind.hint is None else F.contains(text, F.lit(kind.hint))
    return F.when(some, joined).otherwise(text)


def digest(spans: Column) -> Column:
    named = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(named, ",")


def pii_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, counts of the base kinds, base_sha256, spans, scores (of the spans in order).

    Repeated rows stay; null and empty texts have no spans; texts of any length are read whole; an empty table gives no
    rows; spans that begin together go by kind; other columns do not matter, whatever they are called.
    """
    found = find_spans(df.select(F.col(key), F.col(text).alias("text_of_row")), "text_of_row", "pii_of_row")
    spans = F.col("pii_of_row")
    base = F.filter(spans, lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        key, *[count(k.name) for k in KINDS if k.base], F.sha2(digest(base), 256).alias("base_sha256"), digest(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii_report(texts(spark, sf_dir), "doc_id", "text")
