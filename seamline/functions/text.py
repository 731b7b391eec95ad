"""Text normalisers, splitters and predicates as native expressions.

White space in patterns is Unicode-aware (``(?U)``), as the rules that are reproduced here are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open a line of code.
CODE_PREFIXES = (
    "def ", "async def ", "class ", "return ", "if ", "elif ", "else:", "for ", "while ", "try:", "except ", "with ", "import ",
    "from ", "public ", "private ", "protected ", "function ", "const ", "let ", "var ", "package ", "func ", "#include",
)
#: Families of sources.
TASK_FAMILIES = {"gum": "discourse", "codesearchnet": "code", "juice": "notebook", "lean_workbook": "formal_math", "proofnet": "formal_math"}
#: Categories of task text, first names, then patterns; a text can have several.
LABEL_SCHEMA = "task_usable_v1"


def rx(pattern: str) -> str:
    return "(?U)" + pattern


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, rx(r"^\s+|\s+$"), "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"\s+$"), "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rx(r"^\s+"), "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rx(r"\S"))


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def filled(parts: Column) -> Column:
    """Without parts that are null or white space only."""
    return F.filter(parts, lambda p: p.isNotNull() & ~is_blank(p))


def stripped_parts(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def normalize_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize_whitespace(c: Column) -> Column:
    return strip(F.regexp_replace(normalize_newlines(c), "[ \t]+", " "))


def strip_newlines(c: Column) -> Column:
    """Code cell text: line ends normalised, none at both ends."""
    return F.regexp_replace(normalize_newlines(c), "^\n+|\n+$", "")


def join_nonempty_lines(parts: Column) -> Column:
    return F.array_join(filled(parts), "\n")


def paragraphs(c: Column) -> Column:
    return F.split(c, rx(r"\n\s*\n+"), -1)


SENTENCE_END = r"""(?<=[.?!;:])\s+(?=[A-Z0-9$\\(\["'])"""


def sentences_of_paragraph(c: Column) -> Column:
    return stripped_parts(F.split(c, rx(SENTENCE_END), -1))


def sentences(c: Column) -> Column:
    """Sentences of all paragraphs; a paragraph has one at least."""
    return F.flatten(F.transform(stripped_parts(paragraphs(normalize_whitespace(c))), sentences_of_paragraph))


def normalize_math_paragraph(c: Column) -> Column:
    spaced = F.regexp_replace(normalize_newlines(c), r"([.?!])(?=[A-Z$\\])", "$1 ")
    return F.array_join(stripped_parts(F.transform(F.split(spaced, r"[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: F.regexp_replace(x, "[ \t]+", " "))), "\n")


def is_env_marker(c: Column, kind: str = "begin|end") -> Column:
    return strip(c).rlike(rf"\A\\(?:{kind})\{{[^{{}}]+\}}\z")


def is_final_answer(c: Column, legacy: bool = True) -> Column:
    r"""Whether a text states a final answer.

    With ``legacy``, the boxed pattern is what the labelled corpora were made with: it looks for "oxed{" at
    a word's beginning, so that real ``\boxed{`` is no final answer; without, it is.
    """
    s = strip(normalize_newlines(c))
    boxed = r"\boxed\s*\{" if legacy else r"\\boxed\s*\{"
    stated = s.rlike(rx(boxed)) | s.rlike(rx(r"\A\s*####\s*[^\n]+\Z")) | s.rlike(rx(r"(?i)\A\s*(?:final\s+answer|answer)\s*[:=]"))
    return (s != "") & (stated | s.rlike(rx(r"\A[-+]?\$?\d+(?:\.\d+)?(?:/\d+)?\$?\z")))


def is_math_structure(c: Column, legacy: bool = True) -> Column:
    s = strip(c)
    boxed = r"\boxed\s*\{" if legacy else r"\\boxed\s*\{"
    stated = s.rlike(rx(boxed)) | s.rlike(rx(r"\A\s*####\s*[^\n]+\Z")) | s.rlike(rx(r"(?i)\A\s*(?:final\s+answer|answer)\s*[:=]"))
    marks = s.rlike(r"=|\\boxed\{|\\frac|\\sum|\\int|\\begin\{|\\end\{")
    formula = s.rlike(rx(r"\d")) & s.rlike(r"[=+\-*/^<>]")
    return (s != "") & (s.isin("$$", "$", "\\[", "\\]") | is_env_marker(s) | stated | marks | formula)


def is_reasoning_step(c: Column, legacy: bool = True) -> Column:
    s = strip(normalize_newlines(c))
    return (s != "") & (is_final_answer(s, legacy) | is_math_structure(s, legacy) | (s.rlike(rx(r"\d")) & s.rlike(r"[=+\-*/^<>]")))


def is_code(c: Column) -> Column:
    s = strip(normalize_newlines(c))
    opens = F.lit(False)
    for p in CODE_PREFIXES:
        opens = opens | F.startswith(s, F.lit(p))
    marks = s.rlike(r"[{}();]") & ~F.endswith(s, F.lit("."))
    block = F.contains(s, F.lit("\n")) & s.rlike(r"def |class |return |import |from |\{")
    return (s != "") & (opens | marks | block)


def reasoning_clauses(c: Column) -> Column:
    """Clauses at connectives, in two passes; a cut counts only if a later part looks like a step."""
    def cut(parts: Column, pattern: str) -> Column:
        def one(p: Column) -> Column:
            found = stripped_parts(F.split(p, rx(pattern), -1))
            later = F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0)))
            return F.when((F.size(found) > 1) & F.exists(later, lambda p: is_reasoning_step(p)), found).otherwise(F.array(p))

        return F.flatten(F.transform(parts, one))

    first = cut(F.array(strip(c)), r"(?i),\s+(?=(?:which|so|thus|therefore|hence)\b)")
    return cut(first, r"\s+(?=(?:Then|Therefore|Thus|Hence|So|Next|Finally)\b)")


def task_family(source: Column) -> Column:
    known = F.create_map(*[F.lit(x) for p in TASK_FAMILIES.items() for x in p])
    return F.coalesce(F.try_element_at(known, F.lower(strip(F.coalesce(source, F.lit(""))))), F.lit("generic"))


def boundary_types(segments: Column, source: Column, cell_types: Column, has_docstring: Column) -> Column:
    """Labels of each segment's boundary, by family, position and cell type. Blank segments go first.

    A docstring alone changes no label: code that opens with one has an inner boundary there, as other text has.
    """
    inner, commit, final = F.lit("internal_step_boundary"), F.lit("safe_commit_boundary"), F.lit("final_answer_anchor")

    def labels(of: Column, s: Column, i: Column) -> Column:
        family = of["family"]
        kind = F.lower(strip(F.coalesce(F.get(of["cells"], i), F.lit(""))))
        ends = is_final_answer(s) | ((i == F.size(of["parts"]) - 1) & is_reasoning_step(s))
        return (
            F.when(family == "code", F.array(F.when((i > 0) | is_code(s), commit).otherwise(inner)))
            .when(family == "notebook", F.array(F.when(is_final_answer(s), final).when((kind == "code") | is_code(s), commit).otherwise(inner)))
            .when(family == "formal_math", F.array(F.when(ends, final).otherwise(inner)))
            .when(is_final_answer(s), F.array(inner, final))
            .otherwise(F.array(inner))
        )

    given = F.struct(filled(segments).alias("parts"), task_family(source).alias("family"), cell_types.alias("cells"))
    return F.transform(F.array(given), lambda of: F.transform(of["parts"], lambda s, i: labels(of, s, i)))[0]


#: Entities of the basic set; others stay as they are written.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))
#: Tags that end a line.
LINE_TAGS = (r"(?i)<\s*br\s*/?\s*>", r"(?i)</\s*(?:p|div|li|pre|code|h[1-6]|tr)\s*>", r"(?i)<\s*(?:pre|code)[^>]*>")


def strip_html(c: Column) -> Column:
    """Plain text of HTML: basic entities, line tags to line ends, other tags to blanks, lines squeezed."""
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    for tag in LINE_TAGS:
        c = F.regexp_replace(c, tag, "\n")
    c = F.replace(F.regexp_replace(c, "<[^>]+>", " "), F.lit("\u00a0"), F.lit(" "))
    return F.array_join(stripped_parts(lines(F.regexp_replace(normalize_newlines(c), "[ \t]+", " "))), "\n")


def longest_fenced_block(c: Column) -> Column:
    """The longest fenced code block, the first of equals; the whole text if there is none."""
    blocks = F.regexp_extract_all(c, F.lit(r"(?is)```(?:python|py)?\s*\n(.*?)```"), F.lit(1))
    ranked = F.transform(F.transform(blocks, strip), lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
    return F.coalesce(F.array_max(ranked)["b"], strip(c))


def before_starter_code(c: Column) -> Column:
    return strip(F.get(F.split(c, rx(r"(?i)\n\s*starter code\s*:"), 2), 0))


def without_fences(c: Column) -> Column:
    return F.array_join(F.filter(lines(c), lambda x: ~strip(x).rlike("^```")), "\n")


def csv_set(c: Column, pattern: str = ",") -> Column:
    """Distinct lower-cased parts of a separated list, blank ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(c, pattern, -1), lambda p: F.lower(strip(p))), lambda p: p != ""))


def overlap_text(c: Column) -> Column:
    """Lower-cased ASCII letters and digits, all else one blank; for exact overlap of problem texts."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]+", " "), rx(r"\s+"), " "))


def cut_at_stops(c: Column, stops: list[str]) -> Column:
    """Text before the first occurrence of each stop in turn, trailing white space off."""
    for s in stops:
        c = F.substring_index(c, s, 1)
    return rstrip(c)


def nonblank_lines(c: Column) -> Column:
    return F.size(filled(lines(c)))


def steps_of_lines(c: Column) -> Column:
    return stripped_parts(lines(c))


def plain_sentences(c: Column) -> Column:
    return stripped_parts(F.split(c, rx(r"(?<=[.?!])\s+"), -1))


def code_blocks(c: Column) -> Column:
    """Parts of code before each line that opens a definition or a control block."""
    words = "def|class|if|for|while|return|import|from"
    return filled(F.split(c, rf"\n(?=[ \t]*(?:{words})\b)", -1))


def first_nonblank(*columns: Column) -> Column:
    """The first value that is not blank, as it stands."""
    return F.coalesce(*[F.when(~is_blank(c), c) for c in columns])


def normalize_state_label(c: Column) -> Column:
    """The noun phrase of a label: leading articles and quantifiers off, "are in" and "is in" to "in"."""
    s = strip(c)
    for pattern in (r"(?i)\A(?:out\s+)?", r"(?i)\A(?:how many|how much)\s+", r"(?i)\A(?:the|a|an)\s+"):
        s = F.regexp_replace(s, rx(pattern), "")
    s = F.regexp_replace(F.regexp_replace(s, rx(r"(?i)\bare in\b"), " in"), rx(r"(?i)\bis in\b"), " in")
    s = F.regexp_replace(F.regexp_replace(s, rx(r"\s+"), " "), r"\A[ .:;,]+|[ .:;,]+\z", "")
    return F.nullif(s, F.lit(""))


def repair_latex(c: Column) -> Column:
    r"""Control characters that a bad escape left of ``\boxed`` and ``\frac``; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.replace(F.replace(c, F.lit("\x08oxed"), F.lit("\\boxed")), F.lit("\x0crac"), F.lit("\\frac"))


def human_size(n: Column) -> Column:
    """Bytes with a unit, two decimals; terabytes at most."""
    units, value = ("B", "KB", "MB", "GB", "TB"), n.cast("double")
    out = None
    for unit in units[:-1]:
        text = F.format_string(f"%.2f {unit}", value)
        out = F.when(value < 1024, text) if out is None else out.when(value < 1024, text)
        value = value / 1024
    return out.otherwise(F.format_string(f"%.2f {units[-1]}", value))


def step_of_path(c: Column) -> Column:
    """The step number in a checkpoint file's name; null without one."""
    return F.nullif(F.regexp_extract(c, r"boundary_head_step_(\d+)\.pt\z", 1), F.lit("")).cast("int")


def step_list(c: Column) -> Column:
    """Distinct positive steps of a comma or bar separated list, ascending; anything else raises."""
    bare = F.regexp_replace(strip(c), r"\A\[|\]\z", "")
    parts = stripped_parts(F.split(bare, "[|,]", -1))
    steps = F.transform(parts, lambda p: F.when(p.cast("int") > 0, p.cast("int")).otherwise(F.raise_error(F.lit("checkpoint steps must be positive integers"))))
    return F.array_sort(F.array_distinct(steps))


def parameter_name(c: Column) -> Column:
    """Two decimals with p for the point: 0.25 → 0p25."""
    return F.replace(F.format_string("%.2f", c.cast("double")), F.lit("."), F.lit("p"))


def truth(c: Column) -> Column:
    return F.lower(strip(c.cast("string"))).isin("1", "true", "yes", "on")
