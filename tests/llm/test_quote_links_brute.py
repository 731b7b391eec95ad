"""Quotation linking against a linker in plain Python, on invented threads with nested, trimmed and re-wrapped quotes."""

import hashlib
import random
import re
import textwrap

from seamline.llm import quotes, skew
from seamline.llm.ranking import number_by_ranges

WORDS = ("the table of rows sort merge spill disk why how yes no large small query plan join hash key value stream window "
         "night river stone cloud paper green seven letters under above never again today").split()


def sentence(r, least=1):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(least, 14))).capitalize() + r.choice(".?!")


def quoted(text, r):
    """The text, or some of its lines or words, as a quotation; half of the time wrapped anew."""
    lines = [x for x in text.split("\n")]
    way = r.randrange(4)
    if way == 1:
        at = r.randrange(len(lines))
        lines = lines[at : at + r.randint(1, 2)]
    elif way == 2:
        words = " ".join(lines).split() or ["nothing"]
        at = r.randrange(len(words))
        lines = [" ".join(words[at : at + r.randint(1, 12)])]
    elif way == 3:
        lines = textwrap.wrap(re.sub(r"[> ]*>", "", " ".join(lines)), r.choice([12, 30, 60])) or [""]
    return "\n".join(("> " if r.random() < 0.8 else ">") + x for x in lines)


def threads(seed):
    r = random.Random(seed)
    rows, known = [], []
    for conv in [*range(14), None]:
        for turn in range(r.randint(1, 9)):
            body = "\n".join(" ".join(sentence(r) for _ in range(r.randint(1, 3))) for _ in range(r.randint(1, 4)))
            if known and r.random() < 0.7:
                near = [t for c, t in known if c == conv] or [known[0][1]]
                parts = []
                for _ in range(r.randint(1, 3)):
                    parts += [quoted(r.choice(near if r.random() < 0.8 else [t for _, t in known]), r), r.choice(["", sentence(r), "On Monday, A <a@b.example> wrote:"])]
                body = "\n".join([*parts, body] if r.random() < 0.8 else [body, *parts])
            at = None if r.random() < 0.05 else turn
            known.append((conv, body))
            rows.append((conv, at, r.choice(["user", "assistant"]), body.replace("\n", "\r\n") if r.random() < 0.1 else body))
    # repeated rows, a message told twice in one turn, and short words that stand everywhere
    rows += [rows[3], rows[3], (0, 99, "user", "> yes\nfine"), (0, 98, "user", "Well, yes."), (0, 98, "user", "But yes of course"), (5, 99, "user", "> zebra\nfine"), (6, 99, "user", "a zebra")]
    return rows


def split_levels(text):
    out = []
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        mark = re.match(r"[ \t]*((?:>[ \t]?)+)", line)
        out.append(((mark[1].count(">") if mark else 0), (line[mark.end() :] if mark else line).strip(" \t")))
    announcing = []
    for i, (level, content) in enumerate(out):
        after = out[i + 1 : i + 3]
        if after and not after[0][1]:
            after = after[1:]
        announcing.append(bool(content.endswith(":") and re.search(r"(wrote|said)[ \t]*$", content.split(":")[-2]) and after and after[0][0] > level))
    return out, announcing


def norm(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text.lower()).strip(" ")


def parse(text):
    if not re.search(r"(?:^|\n)[ \t]*>", text):
        return text, []
    lines, announcing = split_levels(text)
    body = "\n".join(c for (level, c), a in zip(lines, announcing, strict=True) if level == 0 and not a).strip(" \t\n")
    passages, current = [], None
    for (level, content), a in zip(lines, announcing, strict=True):
        if level == 0 or not content or a:
            current = None
        elif current is not None and current[0] == level:
            current[1].append(content)
        else:
            current = (level, [content])
            passages.append(current)
    return body, [(level, k, norm("\n".join(c))) for k, (level, c) in enumerate(passages)]


def link(rows):
    """(conv, turn, text) → n_quoted, n_linked, parent (conv, turn), by comparing every passage with every body."""
    messages = {}
    for conv, turn, _, text in rows:
        name = hashlib.md5("\x1f".join([f"c{conv}" if conv is not None else "none", "" if turn is None else str(turn), text or ""]).encode()).hexdigest()
        messages[name] = (conv, turn, *parse(text or ""))
    at = lambda n: -1 if messages[n][1] is None else messages[n][1]
    nulls_first = lambda n: tuple((v is not None, v or 0) for v in messages[n][:2]) + (n,)
    out = {}
    for name, (conv, _, _, passages) in messages.items():
        found = []
        for level, number, words in passages:
            holds = [n for n, (_, _, body, _) in messages.items() if f" {words} " in f" {norm(body)} "]
            near = [n for n in holds if messages[n][0] == conv and at(n) < at(name)]
            if near:
                found.append((False, level, number, max(near, key=lambda n: (at(n), n))))
            elif holds and (first := min(holds, key=nulls_first)) != name:
                found.append((True, level, number, first))
        best = min(found)[3] if found else None
        out[name] = (len(passages), len(found), messages[best][0] if best else None, messages[best][1] if best else None)
    return out, messages


def test_links_match_plain_python(spark):
    for seed in (1, 2):
        rows = threads(seed)
        want, messages = link(rows)
        expected = sorted(((messages[n][0], messages[n][1], messages[n][2], *want[n]) for n in want), key=str)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
        got = quotes.link_quotes(df).collect()
        assert len(got) == len(rows)
        ours = sorted({(r.conv_id, r.turn, r.body, r.n_quoted, r.n_linked, r.parent_conv, r.parent_turn) for r in got}, key=str)
        assert ours == sorted(set(expected), key=str)
        linked, quoted_ = sum(w[1] for w in want.values()), sum(w[0] for w in want.values())
        assert quoted_ > 60 and linked >= 0.7 * quoted_
        for conv in {r[0] for r in rows}:
            places = sorted(r.position for r in got if r.conv_id == conv)
            assert places == list(range(1, len(places) + 1))


def test_partial_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a large table?\nIt has many rows and\nthey do not fit in memory.\nyes"),
        (1, 1, "user", "> It has many rows and they\n> do not fit\nBuy more."), (1, 2, "user", "> yes\nok"), (2, 0, "user", "> yes\nok"),
    ]
    got = {(r.conv_id, r.turn): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1].n_linked, got[1, 1].parent_turn, got[1, 1].body) == (1, 0, "Buy more.")
    assert (got[1, 2].n_linked, got[1, 2].parent_turn) == (1, 0)
    assert (got[2, 0].n_linked, got[2, 0].parent_conv, got[2, 0].parent_turn) == (1, 1, 0)


def test_a_million_marks(spark):
    rows = [(1, 0, "user", "Deep words here."), (1, 1, "user", ">" * 1_000_000 + " Deep words here.\nSo deep."), (1, 2, "user", "> " * 500_000 + "x"), (1, 3, "user", " \t" * 500_000 + "> deep")]
    got = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].body, got[1].n_quoted, got[1].n_linked, got[1].parent_turn) == ("So deep.", 1, 1, 0)
    assert got[2].n_quoted == 1 and got[2].body == "" and got[3].n_linked == 1


def test_hot_passage_thread_and_turn(spark, monkeypatch):
    """One passage quoted by a third of all rows, one thread with as many replies, as many rows without a turn."""
    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    rows = [(1, 0, "user", "The quoted words.")] + [(1, k, "user", f"> The quoted words.\nReply {k}.") for k in range(1, 400)]
    rows += [(2, None, "user", f"Without a turn {k % 50}. The quoted words.") for k in range(400)] + [(3, k, "user", f"Other {k}.") for k in range(400)]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).collect()
    for conv, n in ((1, 400), (2, 400), (3, 400)):
        assert sorted(r.position for r in got if r.conv_id == conv) == list(range(1, n + 1))
    assert all((r.parent_conv, r.parent_turn, r.root_turn, r.position) == (1, 0, 0, r.turn + 1) for r in got if r.conv_id == 1 and r.turn)
    without = sorted((r.position, r.body) for r in got if r.conv_id == 2)
    assert len({body for _, body in without}) == 50 and all(without[k][1] == without[k + 1][1] for k in range(0, 400, 8))


def test_numbering_by_ranges(spark):
    rows = [(g, o, n) for g in (None, "a", "b") for o, n in ((None, 2), (1, 1), (5, 3), (9, 1))]
    df = spark.createDataFrame(rows, "g string, o long, n long").repartition(4)
    got = {(r.g, r.o): r.place for r in number_by_ranges(df, ["g"], ["o"], "n", "place").collect()}
    assert got == {(g, o): p for g in (None, "a", "b") for o, p in ((None, 1), (1, 3), (5, 4), (9, 7))}
