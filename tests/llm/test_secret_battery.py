"""Random spans against a plain restatement of the battery, its false-discovery control and the cutting of tokens; recall by encoding."""

import math
import random
import re
import uuid
from statistics import NormalDist

import numpy as np
import pytest

from seamline.llm import secrets as S

HEX, UP, LOW, DIG = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = [HEX, HEX.upper(), HEX + "ABCDEF", UP + "234567", LOW + "234567", LOW + DIG, UP + DIG, UP + LOW + DIG, UP + LOW + DIG + "+/", UP + LOW + DIG + "-_"]
ID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


def symbols(token):
    if ID.fullmatch(token) or ID.fullmatch(token.lower()) and token == token.upper():
        bare = token.replace("-", "")
        return bare[:12] + bare[13:16] + bare[17:]
    return token.rstrip("=")


def alphabet_of(body):
    kinds = any(c in DIG for c in body) + any(c in UP for c in body) + any(c in LOW for c in body)
    return next((k for k, a in enumerate(ALPHABETS) if set(body) <= set(a)), None) if kinds > 1 else None


def upper(z):
    return 1 - NormalDist().cdf(z) if z < 6 else math.exp(-z * z / 2) / z / math.sqrt(2 * math.pi)


def p_values(token):
    """(stratum, bin of the structured p, bin of the battery's p), or None."""
    body = symbols(token)
    k = alphabet_of(body)
    if len(body) < 20 or k is None:
        return None
    a = ALPHABETS[k]
    x, n, m = np.array([a.index(c) for c in body]), len(body), len(a)
    counts = np.bincount(x, minlength=m)
    chi = ((counts - n / m) ** 2 / (n / m)).sum()
    v = 2 / 9 / (m - 1)
    ps = [upper(((chi / (m - 1)) ** (1 / 3) - 1 + v) / v**0.5)]
    high = x >= m / 2
    n1, n2 = high.sum(), (~high).sum()
    mean = 2 * n1 * n2 / n + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    ps.append(min(1, 2 * upper(abs((np.diff(high.astype(int)) != 0).sum() + 1 - mean) / var**0.5)) if var > 1e-12 else 2.0 ** (1 - n))
    c = x - x.mean()
    ps.append(min(1, 2 * upper(abs((c[1:] * c[:-1]).sum() / (c * c).sum()) * n**0.5)))
    half = -sum(math.log(p) for p in ps)
    order = math.exp(-half) * (1 + half + half * half / 2)

    cls = lambda ch: 0 if ch in UP else 1 if ch in LOW else 2 if ch in DIG else 3
    share = {ch: S.LETTERS.get(ch.lower()) or S.DECIMALS.get(ch, 1.0) for ch in a}
    here = sorted({cls(ch) for ch in a})
    inside = lambda ch: 0.9 * share[ch] / sum(share[d] for d in a if cls(d) == cls(ch)) + 0.1 / sum(cls(d) == cls(ch) for d in a)
    log = math.log(inside(body[0]) / len(here))
    for p, q in zip(body, body[1:]):
        log += math.log(S.FOLLOWS[cls(p)][cls(q)] / sum(S.FOLLOWS[cls(p)][j] for j in here) * inside(q))
    ratio = -n * math.log(m) - log
    return k * 3 + sum(n >= s for s in (20, 32, 48)) - 1, -max(0, ratio) / math.log(10), math.log10(order)


def pieces(run):
    """Ways to cut a run between its paddings: whole, and between marks."""
    for part in re.finditer(r"[^=]+=*", run):
        if len(part[0]) >= 20:
            cuts = [[(part.start(), part[0])]]
            if not (ID.fullmatch(part[0]) or ID.fullmatch(part[0].lower()) and part[0] == part[0].upper()):
                cuts += [[(part.start() + m.start(), m[0]) for m in re.finditer(c, part[0])] for c in ("[^/+]+", "[^_-]+", "[^/+_-]+")]
            ways = []
            for cut in cuts:
                way = [(at, t, *p) for at, t in cut if len(t) >= 20 and (p := p_values(t))]
                if way and way not in ways:
                    ways.append(way)
            if ways:
                best = min(ways, key=lambda w: min(x[3] for x in w))
                yield from ((at, t, k, min(0.0, p + math.log10(sum(map(len, ways)))), o) for at, t, k, p, o in best)


def held(rows, at, rate):
    """Which of (stratum, bin) are discoveries: every stratum's greatest bin that Benjamini and Hochberg allow, and above."""
    least = {}
    for stratum in {r[0] for r in rows}:
        bins = sorted((r[at] for r in rows if r[0] == stratum), reverse=True)
        good = [b for b in bins if 10 ** (-b / 20) <= rate * sum(c >= b for c in bins) / len(bins)]
        least[stratum] = min(good, default=10**9)
    return least


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("etaoinshrdlucmfw", [12, 9, 8, 8, 7, 7, 6, 6, 6, 4, 4, 3, 3, 2, 2, 2], k=r.randint(2, 9)))
    shapes = [
        lambda: "_".join(word() for _ in range(5)) + str(r.randrange(99)), lambda: "".join(word().capitalize() for _ in range(5)) + "2", lambda: "/".join(word() for _ in range(6)) + "/v1",
        lambda: "20240" + "0" * 9 + str(r.randrange(10**9)) + "ab", lambda: "Ab1" * r.randint(7, 20), lambda: "-".join([word().upper() + "7"] * 6), lambda: word() * 9 + "1",
    ]
    texts = []
    for i in range(240):
        parts = [word() for _ in range(r.randrange(20))] + [r.choice(shapes)() for _ in range(r.randrange(4))]
        if r.random() < 0.5:
            parts.append("".join(r.choices(r.choice(ALPHABETS), k=r.choice([20, 24, 32, 40, 64, 100]))) + r.choice(["", "=", "=="]))
        if r.random() < 0.1:
            parts.append(r.choice([str, lambda u: str(u).upper()])(uuid.UUID(int=r.getrandbits(128), version=4)))
        r.shuffle(parts)
        texts.append((i, " ".join(parts) if i % 50 else None))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_random_spans_equal_plain_restatement(spark, seed):
    texts = corpus(seed)
    found = {}
    for i, text in texts:
        base = [(int(x[1]), int(x[2])) for x in (s.split(":") for s in (f"h:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text or "")))]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
            for at, t, k, p, o in pieces(m[0]):
                s, e = m.start() + at, m.start() + at + len(t)
                if not any(a < e and s < b for a, b in base):
                    found[i, s, e] = (k, min(2000, int(-p * 20)), min(2000, int(-max(o, -99.9) * 20)))
    random_, ordered = held(list(found.values()), 1, S.RATE), held(list(found.values()), 2, S.ORDER_RATE)
    want = {key for key, (k, p, o) in found.items() if p >= random_[k] and o < ordered[k]}
    got = set()
    for row in S.find_secrets(spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text").collect():
        got |= {(row.doc_id, int(a), int(b)) for kind, a, b in (x.split(":") for x in row.spans.split(",") if x) if kind == "random"}
    assert got == want and len(want) > 40 and any(o >= ordered[k] for k, _, o in found.values())


@pytest.mark.parametrize("alphabet", range(len(ALPHABETS)))
def test_recall_from_forty_characters(alphabet):
    r = random.Random(alphabet)
    for n in (40, 64, 128):
        hits = 0
        for _ in range(150):
            token = "".join(r.choices(ALPHABETS[alphabet], k=n))
            hits += any(p <= -4 and order > math.log10(0.9 * S.ORDER_RATE) for _, _, order, p in S.tested(token, 0, ([], [])))
        assert hits >= 0.9 * 150


def test_long_and_odd_tokens():
    r = random.Random(5)
    order, p = S.battery("".join(r.choices(ALPHABETS[7], k=200_000)))
    assert order > -3 and p < -1000
    assert S.battery("a1" * 50_000)[0] < -100 and S.battery("a" * 10 + "1" * 10)[0] < -2
    assert S.battery("f" * 19 + "1") is not None and S.battery("-" * 30) is None and S.battery("A" * 40) is None
    some = str(uuid.UUID(int=r.getrandbits(128), version=4))
    assert len(S.body_of(some)) == 30 and S.ENCODINGS[S.infer(S.body_of(some.upper()))][1] == HEX.upper()
