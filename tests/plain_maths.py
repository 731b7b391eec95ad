"""Segmentation of mathematical prose restated in plain Python: a text is read from its end to its beginning, step by step."""

import re

CONNECTORS = "then thus hence therefore so finally next now".split() + ["so that"]
MARKER = r"\\(begin|end)\{[^{}]+\}"
SENTENCE = re.compile(r"""(?<=[.?!;:])\s+(?=[A-Z0-9$\\(\["'])""")


def unix(text):
    return re.sub("\r\n?", "\n", text)


def parts_of(pattern, text):
    return [p for p in (x.strip() for x in re.split(pattern, text)) if p]


def squeezed(paragraph):
    spaced = re.sub(r"([.?!])(?=[A-Z$\\])", r"\1 ", unix(paragraph))
    return "\n".join(parts_of(r"\n", "\n".join(re.sub("[ \t]+", " ", x).strip() for x in spaced.splitlines())))


def final_answer(text, legacy=True):
    s = unix(text).strip()
    boxed = r"\boxed\s*\{" if legacy else r"\\boxed\s*\{"
    patterns = (boxed, r"\A\s*####\s*.+$", r"(?i)\A\s*(final\s+answer|answer)\s*[:=]", r"\A[-+]?\$?\d+(\.\d+)?(/\d+)?\$?\Z")
    return any(re.search(p, s) for p in patterns)


def structure(text, legacy=True):
    s = text.strip()
    stated = final_answer(s, legacy) and not re.fullmatch(r"[-+]?\$?\d+(\.\d+)?(/\d+)?\$?", unix(s).strip())
    marked = s in ("$$", "$", r"\[", r"\]") or re.fullmatch(MARKER, s) or re.search(r"=|\\boxed\{|\\frac|\\sum|\\int|\\begin\{|\\end\{", s)
    return bool(stated or marked or re.search(r"\d", s) and re.search(r"[=+\-*/^<>]", s))


def step(text, legacy=True):
    s = unix(text).strip()
    return bool(s) and (final_answer(s, legacy) or structure(s, legacy))


def clauses(text):
    out = [text.strip()]
    for pattern in (r"(?i),\s+(?=(?:which|so|thus|therefore|hence)\b)", r"\s+(?=(?:Then|Therefore|Thus|Hence|So|Next|Finally)\b)"):
        tried = [(p, parts_of(pattern, p)) for p in out]
        out = [x for p, found in tried for x in (found if any(step(f) for f in found[1:]) else [p])]
    return out


def records(text):
    found = []
    for paragraph in filter(None, map(squeezed, re.split(r"\n\s*\n+", unix(text).strip()))):
        if paragraph == "$$" or re.search(r"\$\$\n|\n\$\$", paragraph) or re.fullmatch(MARKER, paragraph):
            found.append(paragraph)
            continue
        for line in paragraph.split("\n"):
            alone, sentences = re.match(r"\\(begin|end)\{", line), parts_of(SENTENCE, line)
            options = [line] if alone else sentences if len(sentences) > 1 else clauses(line)
            for option in options:
                rest = option[2:].lstrip()
                whole = alone or (len(options) == 1 and structure(line))
                if option.startswith("$$") and not whole and re.match(r"[A-Z0-9(\[]", rest):
                    if found and not found[-1].endswith("$$"):
                        found[-1] += " $$"
                    option = rest
                found.append(option)
    return found


def segment_math(text):
    """Groups of records from the last to the first: a group is open as long as what stands before leads to it."""
    items, shown = [], None
    for r in records(text):
        if shown is not None:
            shown.append(r)
            if r == "$$":
                items.append(("prose", "\n".join(shown)))
                shown = None
        elif r == "$$":
            shown = [r]
        elif r != "$":
            env = re.fullmatch(MARKER, r)
            lead = r in (r"\[", r"\]") or re.sub("[,;:]+$", "", r.lower()) in CONNECTORS or bool(env and env[1] == "begin")
            items.append(("lead" if lead else "end" if env else "prose", r))
    if shown:
        items.append(("prose", "\n".join(shown)))
    groups, tail = [], []
    while items and items[-1][0] == "lead":
        tail.insert(0, items.pop()[1])
    while items:
        kind, r = items.pop()
        tail.insert(0, r)
        led = bool(items) and items[-1][0] == "lead"
        if led:
            while items and items[-1][0] == "lead":
                tail.insert(0, items.pop()[1])
        if kind != "end" or led or not items:
            groups.insert(0, tail)
            tail = []
    if tail:
        groups.insert(0, tail)
    return [g for g in map("\n".join, groups) if g.strip() and not re.fullmatch(MARKER, g.strip())]
