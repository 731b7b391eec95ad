"""Phases of Python code: spans of statements, their phases, and the boundaries between them.

Offsets are code points. A syntax error gives one span over all code, with confidence "ignore".
"""

from __future__ import annotations

import ast
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.kernels.code import is_text, parsed

#: Phases in order of id, and names of calls and attributes that tell them.
PHASES = ("signature_or_doc", "normalize", "init_state", "enumerate_or_iterate", "check_or_verify", "update_state", "postprocess", "return_emit")
NORMALIZE_CALLS = {"abs", "bool", "dict", "enumerate", "filter", "float", "int", "list", "map", "set", "sorted", "str", "tuple", "zip"}
NORMALIZE_ATTRS = {"lower", "read", "readline", "replace", "rstrip", "split", "splitlines", "strip", "upper"}
MUTATING_ATTRS = {"add", "append", "clear", "discard", "extend", "insert", "pop", "remove", "reverse", "sort", "update"}
POSTPROCESS_CALLS = {"dict", "list", "repr", "set", "sorted", "str", "tuple"}
POSTPROCESS_ATTRS = {"format", "join"}
SURE = {"enumerate_or_iterate", "check_or_verify", "update_state", "postprocess", "return_emit"}

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
HELPERS = (*FUNCTIONS, ast.ClassDef)
LOOPS = (ast.For, ast.AsyncFor, ast.While)
CHECKS = (ast.If, ast.Assert, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.Raise)
ENDS_OPENING = (*LOOPS, ast.If, ast.Return, ast.Try, ast.Match)


@dataclass
class Span:
    phase: str
    start: int
    end: int
    confidence: str
    depth: int
    header: bool = False
    helper: bool = False


def called(node: ast.AST | None) -> tuple[set[str], set[str]]:
    """Names and attributes that are called anywhere in a node."""
    functions = [n.func for n in ast.walk(node) if isinstance(n, ast.Call)] if node is not None else []
    return {f.id for f in functions if isinstance(f, ast.Name)}, {f.attr for f in functions if isinstance(f, ast.Attribute)}


def normalizes(value: ast.AST | None) -> bool:
    names, attrs = called(value)
    return isinstance(value, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) or bool(names & NORMALIZE_CALLS or attrs & NORMALIZE_ATTRS)


def presents(value: ast.AST | None) -> bool:
    names, attrs = called(value)
    joined = isinstance(value, ast.BinOp) and any(isinstance(n, ast.Constant) and isinstance(n.value, str) for n in ast.walk(value))
    return isinstance(value, ast.JoinedStr) or joined or bool(names & POSTPROCESS_CALLS or attrs & POSTPROCESS_ATTRS)


def phase_of(node: ast.stmt, in_loop: bool, opening: bool) -> str:
    """``opening``: no control statement has come before in the block."""
    by_kind = (
        ((ast.Import, ast.ImportFrom, *HELPERS), "signature_or_doc"), ((ast.Return,), "return_emit"), (LOOPS, "enumerate_or_iterate"),
        (CHECKS, "check_or_verify"), ((ast.AugAssign,), "update_state"),
    )
    for kinds, phase in by_kind:
        if isinstance(node, kinds):
            return phase
    early = opening and not in_loop
    default = "update_state" if in_loop else "init_state" if opening else "postprocess"
    if isinstance(node, (ast.Assign, ast.AnnAssign)):
        if early:
            return "normalize" if normalizes(node.value) else "init_state"
        return "postprocess" if not in_loop and presents(node.value) else "update_state"
    if isinstance(node, ast.Expr):
        if is_text(node):
            return "signature_or_doc"
        value = node.value
        if isinstance(value, ast.Call) and isinstance(value.func, ast.Name) and value.func.id == "print":
            return "return_emit"
        if called(value)[1] & MUTATING_ATTRS and not early:
            return "update_state"
        if early and normalizes(value):
            return "normalize"
    return default


class Source:
    """Offsets of a text's lines; the tree's columns are bytes and are turned to code points."""

    def __init__(self, text: str):
        self.length, self.lines, self.starts = len(text), text.splitlines(keepends=True) or [""], [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line))

    def offset(self, line: int, column: int) -> int:
        line = max(1, min(line, len(self.lines)))
        return self.starts[line - 1] + len(self.lines[line - 1].encode()[:column].decode(errors="ignore"))

    def span(self, node: ast.stmt) -> tuple[int, int]:
        start, end = self.offset(node.lineno, node.col_offset), self.offset(node.end_lineno or node.lineno, node.end_col_offset or 0)
        return start, min(max(end, start + 1), self.length)

    def header(self, node: ast.stmt) -> tuple[int, int]:
        """From a statement's start to its body's first statement."""
        start, end = self.span(node)
        first = node.body[0]
        return start, min(end, max(self.offset(first.lineno, first.col_offset), start + 1))


def walk(source: Source, statements: list[ast.stmt], depth: int, in_loop: bool = False):
    opening = True
    for node in statements:
        phase = phase_of(node, in_loop, opening)
        if isinstance(node, (*LOOPS, ast.If)):
            loop = isinstance(node, LOOPS)
            yield Span(phase, *source.header(node), "gold" if loop else "silver", depth, header=True)
            yield from walk(source, node.body, depth + 1, in_loop or loop)
            yield from walk(source, node.orelse, depth + 1, in_loop)
        else:
            yield Span(phase, *source.span(node), "gold" if phase in SURE else "silver", depth, helper=isinstance(node, HELPERS))
        opening = opening and not isinstance(node, ENDS_OPENING)


def raw_spans(text: str, tree: ast.Module) -> list[Span]:
    """Spans in order of the walk: what precedes the longest function, its signature, doc and body, what follows."""
    source = Source(text)
    functions = [(b - a, k) for k, n in enumerate(tree.body) if isinstance(n, FUNCTIONS) for a, b in [source.span(n)]]
    if not functions:
        doc = [Span("signature_or_doc", *source.span(n), "silver", 0, helper=isinstance(n, HELPERS)) for n in tree.body]
        return doc + list(walk(source, tree.body, 0))
    at = max(functions)[1]
    target = tree.body[at]
    spans = [Span("signature_or_doc", *source.span(n), "silver", 0, helper=isinstance(n, HELPERS)) for n in tree.body[:at]]
    spans.append(Span("signature_or_doc", *source.header(target), "gold", 0))
    body = target.body
    if is_text(body[0]):
        spans.append(Span("signature_or_doc", *source.span(body[0]), "gold", 1))
        body = body[1:]
    spans += walk(source, body, 1)
    return spans + list(walk(source, tree.body[at + 1 :], 0))


def merged(spans: list[Span]) -> list[tuple[str, int, int, str]]:
    """Spans by place, each joined to the one before it if it has the same phase and touches it."""
    out: list[list] = []
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if out and out[-1][0] == s.phase and s.start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], s.end)
            out[-1][3] = "gold" if "gold" in (out[-1][3], s.confidence) else out[-1][3]
        else:
            out.append([s.phase, s.start, s.end, s.confidence])
    return [tuple(x) for x in out]


def boundary_kind(a: Span, b: Span) -> str | None:
    """Meaning of the boundary between adjacent spans; None where it is not safe to cut."""
    deeper = a.header and b.depth > a.depth
    if a.helper or b.helper:
        kind = "helper_def_boundary"
    elif deeper:
        return None
    elif b.phase == "return_emit" and (b.depth < a.depth or a.header):
        kind = "block_exit_to_return"
    else:
        kind = "same_phase_stmt_split" if a.phase == b.phase else "phase_change"
    return None if deeper or a.phase == b.phase == "signature_or_doc" else kind


def label(text: str) -> tuple[list[tuple], list[tuple]]:
    """Spans (phase, start, end, confidence), and edges (position, kind, left phase, right phase)."""
    if not text.strip():
        return [], []
    tree = parsed(text)
    if tree is None:
        return [("return_emit" if "return" in text else "init_state", 0, len(text), "ignore")], []
    raw = [s for s in raw_spans(text, tree) if s.end > s.start]
    edges = [(min(a.end, len(text)) - 1, kind, a.phase, b.phase) for a, b in zip(raw, raw[1:], strict=False) if (kind := boundary_kind(a, b))]
    return merged(raw), [e for e in edges if e[0] >= 0]


LABELS = "spans array<struct<phase:string,start:int,end:int,confidence:string>>, edges array<struct<position:int,kind:string,left_phase:string,right_phase:string>>"


def phase_labels(code: Column) -> Column:
    """Struct of spans and edges of Python code; none for null."""

    @F.pandas_udf(LABELS)
    def run(codes: pd.Series) -> pd.DataFrame:
        rows = [label(c or "") for c in codes]
        spans = [[dict(zip(("phase", "start", "end", "confidence"), s, strict=True)) for s in a] for a, _ in rows]
        edges = [[dict(zip(("position", "kind", "left_phase", "right_phase"), e, strict=True)) for e in b] for _, b in rows]
        return pd.DataFrame({"spans": spans, "edges": edges})

    return run(code)
