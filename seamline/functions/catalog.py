"""Functions of the library by name in a session's catalog, for queries written in SQL.

Column functions become SQL functions whose bodies Catalyst inlines: a query in SQL runs the same expressions as one by
DataFrame, and nothing goes through Python. Kernels that need a parser become a table function, whose columns depend on
what it is asked for.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from seamline.functions import answers, arrays, maths, prior, records, scheduling, text
from seamline.functions.generation import first_stop

#: A string, a fraction (which SQL reads as a decimal unless it is marked), or the name of an operator that is written as a
#: function: quoted names are functions in SQL.
PARTS = re.compile(r"('(?:\\.|[^'\\])*')|(?<![\w.])([0-9]+\.[0-9]+(?:E-?[0-9]+)?)(?![\w.])|(?<![\w`])((?:[-+*/%=<>!&|^~]+|\b(?:and|or|not|in|case)\b)(?=\())", re.S)


@dataclass(frozen=True)
class Function:
    """A function of columns, with its parameters and type as in SQL."""

    parameters: str
    returns: str
    build: Callable[..., Column]

    def body(self) -> Column:
        names = [p.split()[0] for p in re.split(r",\s*(?![^<]*>)", self.parameters)]
        return self.build(*map(F.col, names))


FUNCTIONS = {
    "sm_sentences": Function("t STRING", "ARRAY<STRING>", text.sentences),
    "sm_overlap_text": Function("t STRING", "STRING", text.overlap_text),
    "sm_normalize_whitespace": Function("t STRING", "STRING", text.normalize_whitespace),
    "sm_is_code": Function("t STRING", "BOOLEAN", text.is_code),
    "sm_is_final_answer": Function("t STRING", "BOOLEAN", text.is_final_answer),
    "sm_is_reasoning_step": Function("t STRING", "BOOLEAN", text.is_reasoning_step),
    "sm_human_size": Function("n BIGINT", "STRING", text.human_size),
    "sm_math_segments": Function("t STRING", "ARRAY<STRING>", maths.math_segments),
    "sm_gsm8k_answer": Function("t STRING", "STRING", answers.gsm8k_answer),
    "sm_last_boxed": Function("t STRING", "STRING", answers.last_boxed),
    "sm_canonical_latex": Function("t STRING", "STRING", answers.canonical_latex),
    "sm_margin_score": Function("gold DOUBLE, prediction DOUBLE", "DOUBLE", answers.margin_score),
    "sm_running_sums": Function("a ARRAY<BIGINT>", "ARRAY<BIGINT>", arrays.running_sums),
    "sm_offsets_of_lengths": Function("a ARRAY<BIGINT>", "ARRAY<BIGINT>", arrays.offsets_of_lengths),
    "sm_budget_lengths": Function("a ARRAY<INT>, most INT", "ARRAY<INT>", arrays.budget_lengths),
    "sm_even_parts": Function("amount BIGINT, steps INT", "ARRAY<BIGINT>", arrays.even_parts),
    "sm_entropy": Function("p ARRAY<DOUBLE>", "DOUBLE", arrays.entropy),
    "sm_cosine": Function("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", arrays.cosine),
    "sm_confident_transfer": Function("c ARRAY<DOUBLE>, threshold DOUBLE", "ARRAY<INT>", records.confident_transfer),
    "sm_transfer_by_position": Function("c ARRAY<DOUBLE>, masked ARRAY<INT>, thresholds ARRAY<DOUBLE>, begin INT", "ARRAY<INT>", scheduling.transfer_by_position),
    "sm_sentence_length": Function("tokens ARRAY<STRING>, block INT", "BIGINT", prior.sentence_length),
}


def sql_of(column: Column) -> str:
    """A column as SQL: its text form, operators being written as quoted function names."""
    shown = str(column).removeprefix("Column<'").removesuffix("'>")
    return PARTS.sub(lambda m: m[1] or (f"{m[2]}D" if m[2] else f"`{m[3]}`"), shown)


def stops_function(stops: list[str]) -> Function:
    """Where a text is cut by given stop strings, as a function to register under a name of the caller's."""
    return Function("t STRING", "INT", lambda t: first_stop(t, stops).cast("int"))


class Parts:
    """Table function (text, kind, language): parts of code, one row each.

    ``kind``, a constant, is "segments" (position, segment, method; of any language that the library cuts, Python by
    default) or "phases" (position, phase, start, end, quality; of Python). Null, and code that cannot be cut, has none.
    """

    COLUMNS = {
        "segments": [("position", IntegerType()), ("segment", StringType()), ("method", StringType())],
        "phases": [("position", IntegerType()), ("phase", StringType()), ("start", IntegerType()), ("end", IntegerType()), ("quality", StringType())],
    }

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument, language: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not kind.isConstantExpression or kind.value not in Parts.COLUMNS:
            raise ValueError(f"the second argument must be one of {sorted(Parts.COLUMNS)}")
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument must be a text")
        if language is not None and kind.value == "phases":
            raise ValueError("phases are told of Python only")
        return AnalyzeResult(schema=StructType([StructField(*c) for c in Parts.COLUMNS[kind.value]]))

    def eval(self, text: str, kind: str, language: str = "python") -> Iterator[tuple]:
        from seamline.functions.kernels import code, phases

        if text is None:
            return
        if kind == "phases":
            for at, (phase, start, end, quality) in enumerate(phases.label(text)[0]):
                yield at, phase, start, end, quality
        else:
            found = code.segment_code(language or "", text)
            if found:
                method, _, segments = found
                yield from ((at, segment, method) for at, segment in enumerate(segments))


def register(spark: SparkSession, functions: dict[str, Function] | None = None) -> list[str]:
    """Puts functions (all by default) and the table function ``sm_parts`` into the session's catalog; gives their names.

    Functions of these names are replaced. They live as long as the session.
    """
    for name, f in (FUNCTIONS if functions is None else functions).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({f.parameters}) RETURNS {f.returns} RETURN {sql_of(f.body())}")
    spark.udtf.register("sm_parts", F.udtf(Parts))
    return [*(FUNCTIONS if functions is None else functions), "sm_parts"]
