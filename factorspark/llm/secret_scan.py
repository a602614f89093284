"""Secret scans: fixed patterns, and a battery of randomness tests for keys that no pattern names.

Base spans (assign, access, hex) come from the patterns alone. The method adds spans of kind ``random``. A candidate is a
run of 20 or more letters, digits and ``+ / _ = -`` that mixes letters and digits. Its encoding is inferred as the smallest
alphabet that holds it, and three tests take its symbols' numbers: chi-squared uniformity over the alphabet (in as many bins as its length
bears), Wald-Wolfowitz runs about the middle, and lag-one serial correlation. Fisher's method joins their p-values; a
token stays only if randomness is not rejected.

Not rejecting is weak evidence for short tokens, so ordinary text must be rejected too: under it, neighbouring letters and
digits change class (lower, upper, digit) at a rate of at most ``TEXT_CHANGES``, and the binomial tail of the changes seen
is the token's p-value. The tail falls with length. A document's candidates are tested together by Benjamini-Hochberg, in strata
of similar length so that many long tokens do not lend their power to short ones; the level is shared over the strata.

Defined results: null text counts as empty; a random span never overlaps a base span; whole texts are read.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, free, matches, ordered, span_table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of maximal runs, those of 24 or more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
TEXT_CHANGES, FALSE_DISCOVERIES, REJECT = 0.15, 0.001, 0.005
#: Alphabets in order of size.
ALPHABETS = (
    "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += matches("assign", ASSIGN, text, lambda m: len(m[2]) >= 6)
    if "AKIA" in text:
        out += matches("access", ACCESS, text, lambda m: len(m[0]) >= 20)
    return out + matches("hex", HEX, text)


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of chi-squared with k degrees of freedom (regularised incomplete gamma)."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-14:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * math.exp(a * math.log(x) - x - math.lgamma(a)))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 400):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, h * math.exp(a * math.log(x) - x - math.lgamma(a)))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(s: list[int], size: int) -> float:
    """Fisher-joined p-value of the three tests, under randomness over an alphabet of ``size``."""
    n = len(s)
    bins = max(2, min(size, n // 5))
    seen, room = [0] * bins, [0] * bins
    for v in range(size):
        room[v * bins // size] += 1
    for v in s:
        seen[v * bins // size] += 1
    chi = sum((o - n * r / size) ** 2 / (n * r / size) for o, r in zip(seen, room, strict=True))
    ps = [chi2_tail(chi, bins - 1)]
    up = [2 * v >= size for v in s]
    a, b = sum(up), n - sum(up)
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(x != y for x, y in zip(up, up[1:], strict=False))
        ps.append(two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    m = sum(s) / n
    total = sum((v - m) ** 2 for v in s)
    r = sum((x - m) * (y - m) for x, y in zip(s, s[1:], strict=False)) / total if total else 1.0
    ps.append(two_sided((r + 1 / n) * math.sqrt(n)))
    return chi2_tail(-2 * sum(math.log(max(p, 1e-300)) for p in ps), 2 * len(ps))


def text_tail(token: str) -> float:
    """P(as many class changes) in ordinary text; changes at separators do not count."""
    kind = [0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in token]
    pairs = [(x, y) for x, y in zip(kind, kind[1:], strict=False) if x < 3 and y < 3]
    n, k = len(pairs), sum(x != y for x, y in pairs)
    if not k:
        return 1.0
    # The terms as logarithms: each is the one before it times (n - i) / (i + 1) * q / (1 - q).
    i = np.arange(k, n, dtype=np.float64)
    odds = math.log(TEXT_CHANGES) - math.log1p(-TEXT_CHANGES)
    first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * odds + n * math.log1p(-TEXT_CHANGES)
    terms = first + np.r_[0.0, np.cumsum(np.log(n - i) - np.log(i + 1) + odds)]
    top = float(terms.max())
    return min(1.0, math.exp(min(0.0, top + math.log(float(np.exp(terms - top).sum())))))


def is_random(token: str) -> bool:
    symbols = token.rstrip("=")
    plain = symbols.replace("-", "")
    for letters in ALPHABETS:
        for form in (symbols, plain):
            if len(form) >= 16 and set(form) <= set(letters):
                at = {c: i for i, c in enumerate(letters)}
                return battery([at[c] for c in form], len(letters)) >= REJECT
    return False


def random_spans(text: str) -> list[Span]:
    found = []
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if any(c.isdigit() for c in token) and any(c.isalpha() for c in token) and is_random(token):
            found.append((text_tail(token), m.start(), m.end()))
    out: list[Span] = []
    strata: dict[int, list] = {}
    for f in found:
        strata.setdefault((f[2] - f[1]).bit_length(), []).append(f)
    for own in strata.values():
        own.sort()
        level = FALSE_DISCOVERIES / len(strata)
        passed = max((i for i, f in enumerate(own, 1) if f[0] <= level * i / len(own)), default=0)
        out += [("random", a, b) for _, a, b in own[:passed]]
    return out


def find(text: str) -> list[Span]:
    base = base_spans(text)
    return ordered([*base, *free(random_spans(text), base)], KINDS)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: all spans by start, then kind as listed."""
    return span_table(docs, lambda texts: [[(k, a, b, k in BASE) for k, a, b in find(t)] for t in texts], id_col, text_col)
