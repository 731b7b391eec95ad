"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens.

A token is a run of at least 20 characters of ``[A-Za-z0-9+/_=-]``, or such a part of a run between "=" or
other marks, that no base span touches. "=" stands at the end of a token only. Its encoding (hexadecimal of either
or mixed case, UUIDs by their free digits, base 32, base 36, letters and digits, base 64) is inferred from its
characters: the smallest alphabet that has them all. The battery, over the encoding's alphabet:

* uniformity: Pearson's chi-squared of symbol counts against even ones;
* runs: Wald and Wolfowitz's test of symbols in the upper and lower half of the alphabet;
* serial correlation of neighbouring symbols.

Fisher's method combines their p values into one, of a random token being as uneven or ordered. All tokens of the
corpus are held to false-discovery control twice, by stratum of length and alphabet (Benjamini and Hochberg on
histograms of log p), so that short tokens neither lower nor raise the bar for long ones:

* by the battery: tokens found not to be random go, of which at most ``ORDER_RATE`` are random all the same;
* by structured text, which short tokens of it could pass the battery as: a fixed chain of classes of characters
  (capitals, small letters, digits, marks) with uneven letters and digits. With t the log likelihood ratio of even
  symbols to that chain, such text has a ratio of t or more with probability exp(-t) at most, whatever its length.
  Tokens are reported of which at most ``RATE`` are structured.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned
each and count each; equal p values are decided alike; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.texts import map_texts
from seamline.session import durable, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: Parts of a run: with their padding; and, of these, whole, between marks that no alphabet has both of, and between any.
PADDED = re.compile(r"[^=]+=*")
CUTS = (re.compile(r".+"), re.compile(r"[^/+]+"), re.compile(r"[^_-]+"), re.compile(r"[^/+_-]+"))
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

RATE = 0.001
ORDER_RATE = 0.01
STRATA = (20, 32, 48)
BINS_PER_UNIT = 20
LAST_BIN = 2_000

HEX_LOWER, HEX_UPPER = "0123456789abcdef", "0123456789ABCDEF"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
BASE62 = UPPER + LOWER + DIGITS
#: Smaller alphabets first: a token is of the first that has all its characters.
ENCODINGS = (
    ("hex", HEX_LOWER),
    ("hex", HEX_UPPER),
    ("hex", HEX_LOWER + "ABCDEF"),
    ("base32", BASE32),
    ("base32", BASE32.lower()),
    ("base36", LOWER + DIGITS),
    ("base36", UPPER + DIGITS),
    ("base62", BASE62),
    ("base64", BASE62 + "+/"),
    ("base64url", BASE62 + "-_"),
)
#: Its free digits are all but the version's and the first of the variant's.
UUID = re.compile(r"([0-9a-f]{8})-([0-9a-f]{4})-[1-8]([0-9a-f]{3})-[89ab]([0-9a-f]{3})-([0-9a-f]{12})|([0-9A-F]{8})-([0-9A-F]{4})-[1-8]([0-9A-F]{3})-[89AB]([0-9A-F]{3})-([0-9A-F]{12})")
#: Structured text: how often a class of characters follows another (rows: capitals, small, digits, marks) ...
FOLLOWS = ((0.45, 0.40, 0.10, 0.05), (0.07, 0.85, 0.04, 0.04), (0.09, 0.08, 0.75, 0.08), (0.30, 0.40, 0.28, 0.02))
#: ... and letters and digits, in percent. A tenth of each class is even, for names and languages that differ.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1), strict=True))
DECIMALS = dict(zip("0123456789", (22.0, 18.0, 14.0, 8.0, 7.0, 7.0, 6.0, 6.0, 6.0, 6.0), strict=True))
FIELDS = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, base array<struct<start:int,rank:int,span:string>>, "
    "tokens array<struct<start:int,rank:int,span:string,stratum:int,bin:int,order_bin:int>>"
)


def log_tail(z: float) -> float:
    """ln P(Z >= z) of a standard normal; by its asymptote far out."""
    return math.log(0.5 * math.erfc(z / math.sqrt(2))) if z < 30 else -z * z / 2 - math.log(z * math.sqrt(2 * math.pi))


def either_tail(z: float) -> float:
    """ln P(|Z| >= z)."""
    return min(0.0, math.log(2) + log_tail(z))


def class_of(c: str) -> int:
    return 0 if c in UPPER else 1 if c in LOWER else 2 if c in DIGITS else 3


@cache
def structured(alphabet: str) -> tuple[dict[str, float], dict[str, float]]:
    """Gain in log likelihood, even symbols over structured text, of a first symbol and of each pair's second."""
    share = {c: LETTERS.get(c.lower()) or DECIMALS.get(c, 1.0) for c in alphabet}
    classes = {k: [c for c in alphabet if class_of(c) == k] for k in range(4)}
    classes = {k: cs for k, cs in classes.items() if cs}
    within = {c: 0.9 * share[c] / sum(share[d] for d in cs) + 0.1 / len(cs) for cs in classes.values() for c in cs}
    even = -math.log(len(alphabet))
    first = {c: even - math.log(within[c] / len(classes)) for c in alphabet}
    rows = {k: sum(FOLLOWS[k][j] for j in classes) for k in classes}
    return first, {c + d: even - math.log(FOLLOWS[class_of(c)][class_of(d)] / rows[class_of(c)] * within[d]) for c in alphabet for d in alphabet}


def body_of(token: str) -> str:
    """The symbols that are tested: without padding, of a UUID the free digits."""
    found = UUID.fullmatch(token)
    return "".join(g for g in found.groups() if g) if found else token.rstrip("=")


def infer(body: str) -> int | None:
    """Which of ``ENCODINGS`` a body is in; None for plain letters or digits, and where none has all its characters."""
    used = set(body)
    if sum(bool(used & set(s)) for s in (DIGITS, UPPER, LOWER)) < 2:
        return None
    return next((k for k, (_, a) in enumerate(ENCODINGS) if used <= set(a)), None)


def uniformity(x: list[int], k: int) -> float:
    """ln p of chi-squared being as great. Cube roots of it over its mean are close to normal (Wilson and Hilferty)."""
    n, counts = len(x), [0] * k
    for i in x:
        counts[i] += 1
    chi = max(0.0, k / n * sum(c * c for c in counts) - n)
    spread = 2 / (9 * (k - 1))
    return log_tail(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))


def runs(x: list[int], k: int) -> float:
    """ln p of as odd a number of runs of symbols in the upper and lower half; all in one half is as odd as that."""
    n, high = len(x), [2 * i >= k for i in x]
    a = sum(high)
    mean = 1 + 2 * a * (n - a) / n
    spread = (mean - 1) * (mean - 2) / (n - 1)
    if spread <= 0:
        return (1 - n) * math.log(2)
    found = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
    return either_tail(abs(found - mean) / math.sqrt(spread))


def serial(x: list[int]) -> float:
    """ln p of as strong a correlation of neighbours; one symbol throughout is as strong as can be."""
    n, middle = len(x), sum(x) / len(x)
    total = sum((i - middle) ** 2 for i in x)
    strength = abs(sum((p - middle) * (q - middle) for p, q in zip(x, x[1:], strict=False)) / total) if total else 1.0
    return either_tail(strength * math.sqrt(n))


def fisher(logs: list[float]) -> float:
    """ln p of several p values (as ln) being as small together."""
    half = -sum(logs)
    return -half + math.log(sum(half**i / math.factorial(i) for i in range(len(logs))))


def battery(token: str) -> tuple[float, float] | None:
    """log10 p of the battery (of random symbols), and of structured text; None where the token has no encoding or is short."""
    body = body_of(token)
    if len(body) < STRATA[0] or (k := infer(body)) is None:
        return None
    alphabet = ENCODINGS[k][1]
    place = {c: i for i, c in enumerate(alphabet)}
    x = [place[c] for c in body]
    order = fisher([uniformity(x, len(alphabet)), runs(x, len(alphabet)), serial(x)])
    first, pairs = structured(alphabet)
    gain = first[body[0]] + sum([pairs[body[i : i + 2]] for i in range(len(body) - 1)])
    return min(0.0, order) / math.log(10), -max(gain, 0.0) / math.log(10)


def stratum_of(token: str) -> int:
    """By length and alphabet."""
    body = body_of(token)
    return infer(body) * len(STRATA) + sum(len(body) >= s for s in STRATA) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, rank of the kind, end."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the sorted spans cover, in disjoint pieces."""
    starts, ends = [], []
    for start, _, end in spans:
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def touches(covered: tuple[list[int], list[int]], start: int, end: int) -> bool:
    """Whether a piece of ``merged`` reaches into [start, end)."""
    after = bisect.bisect_left(covered[0], end)
    return after > 0 and covered[1][after - 1] > start


def tested(run: str, at: int, base: tuple[list[int], list[int]]) -> list[tuple[int, str, float, float]]:
    """start, token, log10 of both p values of the tokens in a run of token characters that starts at ``at``.

    "=" ends a token that it pads and parts others. What lies between is tested whole, and in parts between
    marks; the parts are taken if one of them is less likely structured, or if the whole is in no alphabet.
    As the least structured of several is chosen, its p is multiplied by their number.
    """

    def tests(cuts: re.Pattern, part: str, start: int) -> list[tuple[int, str, float, float]]:
        found = []
        for m in cuts.finditer(part):
            s, e = start + m.start(), start + m.end()
            if m.end() - m.start() >= STRATA[0] and not touches(base, s, e):
                p = battery(m[0])
                if p is not None:
                    found.append((s, m[0], *p))
        return found

    out = []
    for m in PADDED.finditer(run):
        if len(m[0]) < STRATA[0]:
            continue
        if UUID.fullmatch(m[0]):
            out += tests(CUTS[0], m[0], at + m.start())
            continue
        ways = [w for cuts in CUTS if (w := tests(cuts, m[0], at + m.start()))]
        ways = [w for k, w in enumerate(ways) if w not in ways[:k]]
        if ways:
            chosen, more = min(ways, key=lambda w: min(t[3] for t in w)), math.log10(sum(map(len, ways)))
            out += [(s, token, order, min(0.0, p + more)) for s, token, order, p in chosen]
    return out


def bin_of(p: float) -> int:
    """Of log10 p."""
    return min(LAST_BIN, int(-p * BINS_PER_UNIT))


def scan(data: bytes | None) -> tuple:
    text = (data or b"").decode("utf-8", "surrogatepass")
    base = base_spans(text)
    named = [(s, r, f"{KINDS[r]}:{s}:{e}") for s, r, e in base]
    tokens, covered = [], merged(base)
    for m in TOKEN.finditer(text):
        for start, token, order, p in tested(m[0], m.start(), covered):
            end = start + len(token)
            tokens.append((start, 3, f"random:{start}:{end}", stratum_of(token), bin_of(p), bin_of(order)))
    kinds = [r for _, r, _ in base]
    digest = hashlib.sha256(",".join(x for _, _, x in named).encode()).hexdigest()
    as_rows = [dict(zip(("start", "rank", "span"), x, strict=True)) for x in named]
    as_tokens = [dict(zip(("start", "rank", "span", "stratum", "bin", "order_bin"), x, strict=True)) for x in tokens]
    return kinds.count(0), kinds.count(1), kinds.count(2), digest, as_rows, as_tokens


def discovery_bins(scanned: DataFrame, rate: float = RATE, field: str = "bin") -> list[int]:
    """By stratum, the least bin (of -log10 p) that is a discovery; beyond the last bin if none is.

    At most ``LAST_BIN`` + 1 counts a stratum come to the driver.
    """
    counts = scanned.select(F.explode("tokens").alias("t")).groupBy("t.stratum", F.col(f"t.{field}").alias("bin")).agg(F.count("*").alias("n")).collect()
    least = []
    for stratum in range(len(ENCODINGS) * len(STRATA)):
        bins = sorted(((r.bin, r.n) for r in counts if r.stratum == stratum), reverse=True)
        tested, above, first = sum(n for _, n in bins), 0, LAST_BIN + 1
        for at, n in bins:
            above += n
            if 10 ** (-at / BINS_PER_UNIT) <= rate * above / tested:
                first = at
        least.append(first)
    return least


def find_secrets(df: DataFrame, key: str, text: str, rate: float = RATE) -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256, spans, n_random. ``rate``: of structured tokens among those reported."""
    scanned = durable(map_texts(df, text, FIELDS, lambda: scan, [key]))
    least, ordered = (F.array(*map(F.lit, discovery_bins(scanned, r, f))) for r, f in ((rate, "bin"), (ORDER_RATE, "order_bin")))
    of = lambda bins, t: F.element_at(bins, t["stratum"] + 1)
    taken = F.filter("tokens", lambda t: (t["bin"] >= of(least, t)) & (t["order_bin"] < of(ordered, t)))
    plain = F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["span"].alias("span")))
    spans = F.array_sort(F.concat("base", plain))
    return scanned.select(
        key, "n_assign", "n_access", "n_hex", "base_sha256",
        F.array_join(F.transform(spans, lambda s: s["span"]), ",").alias("spans"),
        F.size(taken).cast("long").alias("n_random"),
    )


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(texts(spark, sf_dir), "doc_id", "text")
