"""Completions of functions: extraction from programs, cleaning of generated text, prompts that are echoed.

Nothing here runs code; pass and fail are columns that come from elsewhere.
"""

from __future__ import annotations

import ast
import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seamline.functions.kernels.code import is_text, parsed, parses_as_completion

USES_STREAMS = re.compile(r"\b(?:input\s*\(|print\s*\(|sys\.stdin|stdin\.read|stdout\.write)")
FENCE = re.compile(r"^\s*```")
#: Fixed value: the signature that programs are wrapped in.
WRAPPED = "def solve_io(input_data: str) -> str:"
IMPORTS = {"math.": "import math", "re.": "import re", "heapq.": "import heapq", "itertools.": "import itertools", "collections.": "import collections", "bisect.": "import bisect", "sys.": "import sys"}
NAMED_IMPORTS = {"Counter(": "from collections import Counter", "defaultdict(": "from collections import defaultdict", "List[": "from typing import List"}
INDENT = "    "


def functions_of(tree: ast.Module) -> list[ast.FunctionDef]:
    """Public functions: methods of a class named Solution first, then those of the module."""
    members = [n for c in tree.body if isinstance(c, ast.ClassDef) and c.name == "Solution" for n in c.body]
    return [n for n in [*members, *tree.body] if isinstance(n, ast.FunctionDef) and not n.name.startswith("__")]


def signature(node: ast.FunctionDef) -> str:
    """One line, without self."""
    args = ast.parse(ast.unparse(node.args).join(("def f(", "): pass"))).body[0].args
    if args.args and args.args[0].arg == "self":
        args.args = args.args[1:]
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"def {node.name}({ast.unparse(args)}){returns}:"


def completion(source: str) -> tuple[str, str] | None:
    """(signature, indented body) of a program's function; None for programs that read or print, or that do not parse."""
    source = source.strip()
    tree = parsed(source) if source and not USES_STREAMS.search(source) else None
    found = functions_of(tree) if tree else []
    if not found:
        return None
    node = found[0]
    body = textwrap.dedent("\n".join(source.splitlines()[node.body[0].lineno - 1 : node.end_lineno])).rstrip()
    made = signature(node), textwrap.indent(body, INDENT)
    return made if body.strip() and parsed("\n".join(made)) else None


def largest_completion(source: str) -> tuple[str, str] | None:
    """(signature, body without docstring) of the longest function of a module."""
    tree = parsed(source)
    found = [n for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))] if tree else []
    if not found:
        return None
    node = max(found, key=lambda n: n.end_lineno - n.lineno)
    body = node.body[1:] if is_text(node.body[0]) else node.body
    if not body:
        return None
    lines = source.splitlines()
    return "\n".join(lines[node.lineno - 1 : node.body[0].lineno - 1]).strip(), "\n".join(lines[body[0].lineno - 1 : node.end_lineno])


def is_main_guard(node: ast.stmt) -> bool:
    return isinstance(node, ast.If) and ast.unparse(node.test) in ("__name__ == '__main__'", "'__main__' == __name__")


def without_main(source: str) -> str:
    """A module without its main block; what does not parse stays."""
    tree = parsed(source)
    if tree is None:
        return source.strip("\n")
    tree.body = [n for n in tree.body if not is_main_guard(n)]
    return ast.unparse(tree).strip("\n")


def wrapped(source: str) -> str:
    """A program as a function from its input to its output, by redirected streams."""
    body = textwrap.indent(without_main(source) or "pass", INDENT * 2)
    opening = ["import io", "import sys", "_original_stdin = sys.stdin", "_original_stdout = sys.stdout", "_stdout_capture = io.StringIO()", "sys.stdin = io.StringIO(input_data)", "sys.stdout = _stdout_capture", "try:"]
    closing = ["finally:", INDENT + "sys.stdin = _original_stdin", INDENT + "sys.stdout = _original_stdout", "return _stdout_capture.getvalue()"]
    return "\n".join([WRAPPED, *(INDENT + x for x in opening), body, *(INDENT + x for x in closing)]) + "\n"


def unfenced(text: str) -> str:
    return "\n".join(x for x in text.splitlines() if not FENCE.match(x))


def without_echo(text: str, prompt: str) -> str:
    """Generated text without the prompt it begins with, whole or by leading lines; without fences if nothing is echoed."""
    prompt = prompt.rstrip()
    if prompt and text.startswith(prompt):
        return text[len(prompt) :].lstrip("\n") or text
    pairs = zip(prompt.splitlines(), text.splitlines(), strict=False)
    shared = next((k for k, (a, b) in enumerate(pairs) if a.rstrip() != b.rstrip()), min(len(prompt.splitlines()), len(text.splitlines())))
    if prompt and shared:
        return "\n".join(text.splitlines()[shared:]).lstrip("\n") or text
    return unfenced(text)


def indented_body(text: str) -> str:
    """A body that parses under a signature: as it is, or dedented and indented anew, its first line aligned to the rest."""
    if parsed("def f():\n" + text) is not None:
        return text
    lines = text.splitlines()
    rest = [len(x) - len(x.lstrip(" ")) for x in lines[1:] if x.strip()]
    for first in ("", " " * min(rest, default=0)):
        tried = textwrap.indent(textwrap.dedent("\n".join([first + lines[0].lstrip(), *lines[1:]])), INDENT) if lines else ""
        if parsed("def f():\n" + tried) is not None:
            return tried
    return textwrap.indent(textwrap.dedent(text), INDENT)


def normalized_completion(text: str, prompt: str) -> str:
    """A generated completion as a body: fences and echo off, a repeated function opened, indentation made sound."""
    bare = without_echo(unfenced(text), prompt)
    tree = parsed(bare)
    if tree and functions_of(tree) and prompt.strip():
        node = functions_of(tree)[0]
        bare = "\n".join(bare.splitlines()[node.body[0].lineno - 1 : node.end_lineno])
    return indented_body(bare)


def with_imports(code: str) -> str:
    """Code with the standard imports that it uses and does not make."""
    wanted = [line for use, line in {**IMPORTS, **NAMED_IMPORTS}.items() if re.search(rf"(?<![\w.]){re.escape(use)}", code) and line not in code]
    return "\n".join([*wanted, code])


def closed(text: str) -> bool:
    """Whether brackets are balanced outside strings and the text parses alone or as a body."""
    plain = re.sub(r"'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", "", text)
    return all(plain.count(a) == plain.count(b) for a, b in ("()", "[]", "{}")) and parses_as_completion(text)


def completions(code: Column) -> Column:
    """Struct (signature, body) of ``completion``; null fields where there is none."""

    @F.pandas_udf("signature string, body string")
    def run(codes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([completion(c or "") or (None, None) for c in codes], columns=["signature", "body"])

    return run(code)
