"""Code segmentation: by syntax tree for Python, by indentation or brackets elsewhere.

A splitter cuts source lines into raw segments; ``coarse`` folds small ones into their neighbours;
``sound`` judges the outcome. ``segment_code`` tries a language's splitters in order.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CLOSERS = frozenset({"}", "};", "end"})
COMMENTS = ("#", "//", "/*", "*")
MIN_LINES, MIN_CHARS = 2, 40
MOST_SEGMENTS, AIM_SEGMENTS = 64, 48
TINY = frozenset({"...", "pass", "[]", "{}", "()"})
TRIPLE = re.compile(r"""(?i)[rubf]{0,2}("{3}|'{3})""")
BRACED = ("java", "javascript", "php", "go")

#: What opens a definition, by language (matched at the first line of substance).
DEFINITIONS = {
    "python": r"(?:def |async def |class )",
    "ruby": r"(?:def|class|module)\b",
    "javascript": r"(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function|class)\b|(?:(?:async|get|set)\s+)?[A-Za-z_$][\w$]*\s*\([^)]*\)\s*\{$",
    "java": r".*\b(?:class|interface|enum)\b|(?!(?:if|for|while|switch|catch)\b).*\(.*\{$",
    "php": r"(?:public|private|protected|static|final|abstract|\s)*function\b|.*\bclass\b",
    "go": r"(?:func |type )",
}
#: What opens a block that stays a segment of its own.
BLOCKS = {
    "python": r"(?:if|for|while|try|with|match)\b",
    "ruby": r"(?:if|for|while|begin|case)\b",
    "go": r"(?:if|for|switch|select)\b",
    None: r"(?:if|for|while|try|with|switch)\b",
}
SIMPLE = re.compile(
    r"(?:return|yield|raise|throw|break|continue|pass|import|from|using|package|require|const|let|var)\b"
    r"|(?:self\.)?[A-Za-z_][\w.]*\s*[+\-*/%]?=|[A-Za-z_][\w.]*\s*\("
)
CONTROL = re.compile(r"(?:if|else|elif|elsif|when|for|while|switch|case|try|catch|finally|with|return|throw|break|continue|rescue|ensure)\b")
RUBY_CONTINUES = re.compile(r"(?:end|else|elsif|when|rescue|ensure)\b")


def tidy(segments: Iterable[str]) -> list[str]:
    """Segments without blank ones and outer line ends; lone closers go to the segment before."""
    out: list[str] = []
    for s in segments:
        s = s.strip("\n")
        bare = s.strip()
        if bare in CLOSERS and out:
            out[-1] += "\n" + s
        elif bare:
            out.append(s)
    return out


def substance(segment: str) -> list[str]:
    """Stripped lines that are neither blank, comment nor lone closer."""
    lines = (x.strip() for x in segment.splitlines())
    return [x for x in lines if x and x != "{" and x not in CLOSERS and not x.startswith(COMMENTS)]


def opens(language: str, segment: str) -> bool:
    first = next(iter(substance(segment)), "")
    patterns = (DEFINITIONS.get(language), BLOCKS.get(language, BLOCKS[None]))
    return bool(first) and any(p and re.match(p, first) for p in patterns)


def big_enough(segment: str) -> bool:
    return len(substance(segment)) >= MIN_LINES or len(segment.strip()) >= MIN_CHARS


def folds(language: str, segment: str) -> bool:
    """Whether a segment is too slight to stand alone."""
    body = substance(segment)
    return len(body) <= 1 or bool(SIMPLE.match(body[0])) or not big_enough(segment)


def glue(left: str, right: str) -> str:
    return f"{left.rstrip()}\n{right.lstrip()}" if left and right else left or right


def coarse(language: str, segments: Iterable[str]) -> list[str]:
    """The signature, then blocks: slight segments join the block before them, or wait for one."""
    parts = tidy(segments)
    if len(parts) < 2:
        return parts
    out, waiting = parts[:1], ""
    for s in parts[1:]:
        if opens(language, s):
            held = waiting.strip()
            waiting = ""
            if held and big_enough(held):
                out.append(held)
            else:
                s = glue(held, s)
            out.append(s)
        elif folds(language, s) and len(out) > 1:
            out[-1] = glue(out[-1], s)
        else:
            waiting = f"{waiting}\n{s}" if waiting else s
    held = waiting.strip()
    if held and (len(out) == 1 or big_enough(held)):
        out.append(held)
    elif held:
        out[-1] = glue(out[-1], held)
    return tidy(out)


def without_docstrings(segment: str) -> str:
    """Lines of a segment that stand outside triple-quoted blocks of their own."""
    kept, closing = [], None
    for line in segment.replace("\r\n", "\n").replace("\r", "\n").splitlines():
        if closing:
            closing = None if closing in line else closing
            continue
        found = TRIPLE.match(line.lstrip())
        if not found:
            kept.append(line)
        elif found[1] not in line.lstrip()[found.end() :]:
            closing = found[1]
    return "\n".join(kept).strip()


def cleaned(language: str, segments: Iterable[str]) -> list[str]:
    """All but the first segment without inner docstrings (Python) or outer white space."""
    parts = tidy(segments)
    inner = without_docstrings if language == "python" else lambda s: s.replace("\r\n", "\n").replace("\r", "\n").strip()
    return tidy(parts[:1] + [x for x in map(inner, parts[1:]) if x])


def is_signature(segment: str, words: tuple[str, ...] = ("def ", "async def ")) -> bool:
    return any(x.strip().startswith(words) for x in segment.splitlines())


def sound(language: str, segments: list[str], method: str) -> bool:
    parts = [s.strip() for s in segments if s.strip()]
    if not 2 <= len(parts) <= MOST_SEGMENTS or sum(len(s) < 3 and s not in TINY for s in parts) > max(1, len(parts) // 4):
        return False
    if method == "ast" and (len(parts[0].splitlines()) > 12 or any(len(s.splitlines()) > 200 for s in parts[1:])):
        return False
    if language == "python" or method == "ast":
        return is_signature(parts[0])
    return method != "ruby_indent" or is_signature(parts[0], ("def ",))


def parsed(code: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def by_tree(code: str) -> list[str] | None:
    """A lone function's signature and statements; None for anything else."""
    tree = parsed(code)
    if tree is None or len(tree.body) != 1 or not isinstance(tree.body[0], (ast.FunctionDef, ast.AsyncFunctionDef)):
        return None
    lines, body = code.splitlines(), tree.body[0].body
    statements = body[1:] if is_text(body[0]) else body
    if not statements:
        return None
    spans = [(0, body[0].lineno - 1), *((s.lineno - 1, s.end_lineno) for s in statements)]
    parts = tidy(p for p in ("\n".join(lines[a:b]).strip() for a, b in spans) if p)
    return parts if sound("python", parts, "ast") else None


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def by_indent(code: str) -> list[str]:
    """Python by lines: a signature up to its colon, then a segment at each return to the body's indent."""
    lines = code.splitlines()
    seen = False
    for end, line in enumerate(lines):
        seen = seen or line.strip().startswith(("def ", "async def "))
        if seen and line.strip() and line.strip().split("#", 1)[0].rstrip().endswith(":"):
            break
    else:
        return []
    body = after_docstring(lines[end + 1 :])
    levels = [indent(x) for x in body if x.strip()]
    if not levels or min(levels) <= 0:
        return []
    groups: list[list[str]] = []
    for line in body:
        if line.strip() and (not groups or indent(line) == min(levels)):
            groups.append([line])
        elif groups:
            groups[-1].append(line)
    return tidy(["\n".join(lines[: end + 1]).strip(), *("\n".join(g).strip() for g in groups)])


def after_docstring(body: list[str]) -> list[str]:
    first = next((k for k, x in enumerate(body) if x.strip()), None)
    found = TRIPLE.match(body[first].lstrip()) if first is not None else None
    if not found:
        return body
    if found[1] in body[first].lstrip()[found.end() :]:
        return body[first + 1 :]
    return next((body[k + 1 :] for k in range(first + 1, len(body)) if found[1] in body[k]), body)


def countable(line: str) -> str:
    """A line without comments and with empty string literals."""
    for pattern, put in ((r"//.*$", ""), (r"#.*$", ""), (r"/\*.*?\*/", ""), (r"'(?:\\.|[^'\\])*'", "''"), (r'"(?:\\.|[^"\\])*"', '""')):
        line = re.sub(pattern, put, line)
    return line


def balance(line: str, pair: str) -> int:
    return line.count(pair[0]) - line.count(pair[1])


def by_ruby_indent(code: str) -> list[str]:
    """Ruby by lines: the signature, then a segment at each return to the body's indent; comments go with what follows."""
    lines = code.splitlines()
    start = next((k for k, x in enumerate(lines) if re.match(r"\s*def\b", x)), None)
    if start is None:
        return []
    depth, end = 0, start
    for end in range(start, len(lines)):
        depth += balance(countable(lines[end]), "()")
        if depth <= 0 and not lines[end].strip().endswith((",", "\\")):
            break
    body = lines[end + 1 :]
    levels = [indent(x) for x in body if x.strip() and not re.match(r"end\b", x.strip())]
    if not levels:
        return []
    base, groups, ahead, current = min(levels), [], [], []
    for line in body:
        bare = line.strip()
        if not bare or bare.startswith("#"):
            if current:
                current.append(line)
            elif bare or ahead:
                ahead.append(line)
            continue
        if indent(line) == base and current and not RUBY_CONTINUES.match(bare):
            groups.append(current)
            current = []
        current, ahead = (current or ahead) + [line], [] if not current else ahead
    groups.append(current)
    return tidy(["\n".join(lines[: end + 1]).strip(), *("\n".join(g).strip() for g in groups)])


def by_brackets(code: str, language: str) -> list[str]:
    """Segments where brackets are balanced down to the body and a line ends a statement or is blank."""
    groups: list[list[str]] = [[]]
    depth = {"{}": 0, "()": 0, "[]": 0}
    started = False
    for line in code.splitlines():
        groups[-1].append(line)
        bare, plain = line.strip(), countable(line)
        for pair in depth:
            depth[pair] += balance(plain, pair)
        if not started and language in BRACED and "{" in plain:
            started, cut = True, True
        elif not started and language == "ruby" and re.match(r"def\b", bare):
            started, cut = True, False
        elif not bare:
            cut = True
        elif language in BRACED:
            cut = depth["{}"] <= 1 and not depth["()"] and not depth["[]"] and bare.endswith((";", "}", "{"))
        elif language == "ruby":
            cut = bool(RUBY_CONTINUES.match(bare)) or bare.endswith(("do", "{", "}"))
        else:
            cut = bare.endswith(";")
        if cut:
            groups.append([])
    return [s for s in ("\n".join(g).strip() for g in groups) if s]


def fewer(segments: Iterable[str], most: int = AIM_SEGMENTS) -> list[str]:
    """Adjacent pairs joined, the cheapest first, until at most ``most`` are left.

    Cost: the signature least willingly, then control blocks, then long blocks; then lines, then characters.
    """
    parts = tidy(segments)

    def controls(s: str) -> bool:
        first = next((x.strip() for x in s.splitlines() if x.strip() and not x.strip().startswith(("//", "#"))), "")
        return bool(CONTROL.match(first))

    def cost(k: int) -> tuple[int, int, int, int]:
        a, b = parts[k], parts[k + 1]
        n, m = (max(1, len(s.splitlines())) for s in (a, b))
        return 1000 * (k == 0) + 100 * (controls(a) or controls(b)) + 50 * (n > 12 or m > 12), n + m, len(a) + len(b), k

    while len(parts) > most:
        k = min(range(len(parts) - 1), key=cost)
        parts = tidy([*parts[:k], f"{parts[k]}\n{parts[k + 1]}", *parts[k + 2 :]])
    return parts


def segment_code(language: str, code: str) -> tuple[str, str, list[str]] | None:
    """(method, quality, segments), or None where no splitter gives sound segments."""
    language = language.lower()
    if language == "python":
        tree = by_tree(code)
        tries: list[tuple[str, str, str, Callable[[], list[str]]]] = [("ast", "high", "ast", lambda: cleaned(language, coarse(language, tree)))] if tree else []
        tries.append(("heuristic", "fallback", "heuristic", lambda: cleaned(language, coarse(language, by_indent(code)))))
    else:
        tries = [("ruby_indent", "fallback", "ruby_indent", lambda: coarse(language, by_ruby_indent(code)))] if language == "ruby" else []
        tries.append(("heuristic", "fallback", "heuristic", lambda: coarse(language, by_brackets(code, language))))
    for method, quality, rule, split in tries:
        parts = split()
        if language not in ("python", "ruby") and len(parts) > MOST_SEGMENTS:
            method, quality, parts = "heuristic_coarsened", "coarsened", coarse(language, fewer(parts))
        if sound(language, parts, rule):
            return method, quality, parts
    return None


SEGMENTED = "method string, quality string, segments array<string>"


def segmented_code(language: Column, code: Column) -> Column:
    """Struct (method, quality, segments); null fields where the code cannot be segmented."""

    @F.pandas_udf(SEGMENTED)
    def run(languages: pd.Series, codes: pd.Series) -> pd.DataFrame:
        found = [segment_code(a or "", b or "") or (None, None, None) for a, b in zip(languages, codes, strict=True)]
        return pd.DataFrame(found, columns=["method", "quality", "segments"])

    return run(language, code)


def longest_valid(text: str, most: int = 100) -> str:
    """The run of lines that parses and has most substance; only the first ``most`` lines start or end one."""
    lines = text.splitlines()[:most]
    best, found = (0, 0), ""
    for a in range(len(lines)):
        for b in range(len(lines), a, -1):
            n = sum(bool(x.strip()) for x in lines[a:b])
            if n <= best[0]:
                break
            part = "\n".join(lines[a:b])
            if parsed(part) is not None:
                best, found = (n, b - a), part
                break
    return found


def needed_definitions(text: str, entry: str) -> str:
    """Imports, and the definitions and assignments that ``entry`` reaches by name; all of them without ``entry``."""
    code = longest_valid(text)
    tree = parsed(code)
    if tree is None:
        return code
    named: dict[str, ast.stmt] = {}
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            named[node.name] = node
        elif isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
            named[node.targets[0].id] = node
    uses = {k: {n.id for n in ast.walk(v) if isinstance(n, ast.Name)} & named.keys() for k, v in named.items()}
    reached, pending = set(), [entry] if entry in named else list(named)
    while pending:
        name = pending.pop()
        if name not in reached:
            reached.add(name)
            pending += uses[name] - reached
    keep = [n for n in tree.body if isinstance(n, (ast.Import, ast.ImportFrom)) or any(named[k] is n for k in reached)]
    return "\n".join(ast.unparse(n) for n in keep)


def function_body(text: str, entry: str) -> str | None:
    """Source lines of the entry function's body; None if it is not there."""
    tree = parsed(text)
    node = next((n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and n.name == entry), None) if tree else None
    return "\n".join(text.splitlines()[node.body[0].lineno - 1 : node.end_lineno]) if node else None


def parses_as_completion(text: str) -> bool:
    """Whether code parses as it is, or as the body of a function."""
    return parsed(text) is not None or parsed("def f():\n" + "\n".join("    " + x for x in text.splitlines())) is not None


def text_kernel(function: Callable, returns: str = "string") -> Callable[..., Column]:
    """A Column function of a row-wise one; null arguments are empty texts."""

    @F.pandas_udf(returns)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([function(*[x if x is not None else "" for x in row]) for row in zip(*columns, strict=True)], dtype=object)

    return run
