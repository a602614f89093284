"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

Base spans (email, ip, card, phone) come from the patterns alone. The field adds spans of the same kinds in other
spellings: addresses with a written-out "at" and "dot", telephone numbers without a plus. It is trained here, by gradient
steps on the exact likelihood (forward-backward in numpy), from a small labelled table that fixed templates spell out, and
decoded by Viterbi over padded batches of sequences.

A sequence is a stretch of tokens around digits, @ or a bracketed "at" (six tokens to either side, stretches that meet are
one). Elsewhere the field could only answer "other": every kind holds a digit or an at. Added spans must pass a plain check of their kind (a card its
Luhn sum, a telephone number 10 to 15 digits with a usual grouping, an address a host with a dot) and overlap no base span.

Defined results: null text counts as empty; whole texts are read; ties in Viterbi go to the tag listed first.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .spans import Span, free, matches, ordered, span_table

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
LOCAL = string.ascii_letters + string.digits + "._%+-"
HOST = re.compile(r"[A-Za-z0-9.-]*")
# The stated patterns, such that no start is tried twice: a match never begins within a run of digits, and what was taken is not given back.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
MARK = re.compile(r"[0-9@]|[\[({]\s?[aA][tT]\s?[\])}]")
AROUND = 60
#: Slots of the feature table, and tokens of a padded Viterbi batch; a longer sequence is a batch of its own.
HASHED, CELLS = 1 << 13, 1 << 15
EPOCHS, RATE, PENALTY = 60, 0.2, 1e-3


def digits(s: str) -> str:
    return DIGITS.sub("", s)


def luhn(s: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def good_card(s: str) -> bool:
    d = digits(s)
    return 14 <= len(d) <= 19 and luhn(d)


def small(part: str) -> bool:
    """Whether a run of digits, however long, is a number up to 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[Span]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each @ outwards in linear time."""
    out, done = [], 0  # nothing before ``done`` can be part of a later match
    at = text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1)[0]
        gap = host.find("..")
        host = (host if gap < 0 else host[:gap]).rstrip(".")
        done = at + 1
        if start < at and "." in host and host[0] != ".":
            done += len(host)
            out.append(("email", start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[Span]:
    out = emails(text)
    out += matches("ip", IP, text, lambda m: all(map(small, m[0].split("."))))
    out += matches("card", CARD, text, lambda m: good_card(m[0]))
    if "+" in text:
        out += matches("phone", PHONE, text, lambda m: 10 <= len(digits(m[0])) <= 15)
    return out


# The labelled table.


def labelled(n: int = 600, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sequences of (token, tag) from templates; about as many hard negatives as spans."""
    rnd = random.Random(seed)
    d = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(["an", "er", "mo", "ti", "ple", "so", "ka", "lin"]) for _ in range(rnd.randint(1, 4)))

    def card(valid: bool) -> str:
        while True:
            s = d(16)
            if luhn(s) == valid:
                return rnd.choice([s, " ".join(s[i : i + 4] for i in range(0, 16, 4)), "-".join(s[i : i + 4] for i in range(0, 16, 4))])

    at, dot = lambda: rnd.choice([" (at) ", " [at] ", "(at)", "[at]", " {at} "]), lambda: rnd.choice([" (dot) ", " [dot] ", "[dot]", ".", " dot "])
    makers = {
        "email": [lambda: f"{word()}.{d(2)}@{word()}{d(1)}.{word()}.com", lambda: f"{word()}@{word()}.org", lambda: f"{word()}{d(2)}{at()}{word()}{dot()}com", lambda: f"{word()}{at()}{word()}{dot()}net"],
        "ip": [lambda: ".".join(str(rnd.randrange(256)) for _ in range(4))],
        "card": [lambda: card(True)],
        "phone": [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(4)} {d(3)}"],
        "O": [lambda: d(rnd.randint(1, 9)), lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"${d(3)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: card(False), lambda: f"{d(4)}-{d(4)}", lambda: f"p. {d(3)}-{d(3)}", lambda: f"@{word()}", lambda: f"{d(20)}", lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(32)), lambda: f"({d(4)})", lambda: f"{d(3)},{d(3)},{d(3)}"],
    }
    out = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(rnd.randint(1, 3)):
            row += [(t, "O") for t in TOKEN.findall(" ".join(word() for _ in range(rnd.randint(2, 7))) + rnd.choice(["", ",", ".", ":"]))]
            kind = rnd.choice([*KINDS, "O", "O", "O", "O"])
            tokens = TOKEN.findall(rnd.choice(makers[kind])())
            row += [(t, "O" if kind == "O" else f"{'I' if i else 'B'}-{kind}") for i, t in enumerate(tokens)]
        row += [(t, "O") for t in TOKEN.findall(" ".join(word() for _ in range(rnd.randint(0, 5))))]
        out.append(row)
    return out


# The field.


def shape(token: str) -> str:
    if token.isdigit():
        return f"9{min(len(token), 20)}"
    if token.isalpha():
        return token.lower() if token.lower() in ("at", "dot", "com", "net", "org", "tel", "phone", "p") else ("X" if token.isupper() else "x") + str(min(len(token), 3))
    return token


@lru_cache(1 << 16)
def _slot(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % HASHED


def features(tokens: list[str]) -> np.ndarray:
    """(tokens, features) slots of the weights."""
    s = ["^^", "^"] + [shape(t) for t in tokens] + ["$", "$$", "$$$"]
    rows = []
    for i in range(2, len(tokens) + 2):
        rows.append([
            _slot(f"0{s[i]}"), _slot(f"-{s[i - 1]}"), _slot(f"+{s[i + 1]}"), _slot(f"a{s[i - 2]}|{s[i - 1]}|{s[i]}"), _slot(f"b{s[i - 1]}|{s[i]}|{s[i + 1]}"),
            _slot(f"c{s[i]}|{s[i + 1]}|{s[i + 2]}"), _slot(f"d{s[i]}|{s[i + 1]}|{s[i + 2]}|{s[i + 3]}"),
        ])
    return np.array(rows, np.int64).reshape(len(tokens), 7)


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    long = np.array([len(r) for r in rows])
    out = np.full((len(rows), int(long.max(initial=1)), 7), HASHED, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, long


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


@lru_cache(1)
def trained() -> tuple[np.ndarray, np.ndarray]:
    """(emission weights, transition weights) after Adam on the penalised log-likelihood of the labelled table."""
    rows = labelled()
    x, long = _padded([features([t for t, _ in r]) for r in rows])
    n, width, k = len(rows), x.shape[1], len(TAGS)
    y = np.zeros((n, width), np.int64)
    for i, r in enumerate(rows):
        y[i, : len(r)] = [TAGS.index(t) for _, t in r]
    real = np.arange(width)[None] < long[:, None]
    w, tr = np.zeros((HASHED + 1, k)), np.zeros((k, k))
    moments = [np.zeros_like(a) for a in (w, tr, w, tr)]
    at = np.arange(n)
    for epoch in range(1, EPOCHS + 1):
        e = w[x].sum(axis=2)
        fwd = np.zeros((n, width, k))
        fwd[:, 0] = e[:, 0]
        for t in range(1, width):
            step = _lse(fwd[:, t - 1, :, None] + tr[None], 1) + e[:, t]
            fwd[:, t] = np.where(real[:, t, None], step, fwd[:, t - 1])
        z = _lse(fwd[at, long - 1], 1)
        bwd = np.zeros((n, width, k))
        pair = np.zeros((k, k))
        for t in range(width - 2, -1, -1):
            nxt = e[:, t + 1] + bwd[:, t + 1]
            step = _lse(tr[None] + nxt[:, None, :], 2)
            bwd[:, t] = np.where(real[:, t + 1, None], step, 0)
            joint = np.exp(fwd[:, t, :, None] + tr[None] + nxt[:, None, :] - z[:, None, None]) * real[:, t + 1, None, None]
            pair += joint.sum(axis=0)
        node = np.exp(fwd + bwd - z[:, None, None]) * real[..., None]
        node[at[:, None], np.arange(width)[None], y] -= real
        g = np.zeros_like(w)
        for f in range(7):
            np.add.at(g, x[:, :, f][real], node[real])
        both = real[:, 1:]
        np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), -1.0)
        for i, (param, grad) in enumerate(((w, g / n), (tr, pair / n))):
            grad = grad + PENALTY * param / n
            moments[i] = 0.9 * moments[i] + 0.1 * grad
            moments[i + 2] = 0.99 * moments[i + 2] + 0.01 * grad**2
            param -= RATE * (moments[i] / (1 - 0.9**epoch)) / (np.sqrt(moments[i + 2] / (1 - 0.99**epoch)) + 1e-8)
        w[HASHED] = 0
    for j, tag in enumerate(TAGS):  # a span starts with B and stays of its kind
        if tag[0] == "I":
            tr[[i for i, other in enumerate(TAGS) if other[1:] != tag[1:] or other == "O"], j] = -1e4
    return w, tr


def viterbi(rows: list[np.ndarray], w: np.ndarray, tr: np.ndarray) -> list[list[int]]:
    """Best tags of each sequence, in padded batches of sequences of similar length."""
    out: list[list[int]] = [[] for _ in rows]
    order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
    start = np.array([-1e4 if t[0] == "I" else 0.0 for t in TAGS])
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * len(rows[order[b]]) <= CELLS:
            b += 1
        part, a = order[a:b], b
        x, long = _padded([rows[i] for i in part])
        e = w[x].sum(axis=2)
        score = e[:, 0] + start
        back = np.zeros(e.shape, np.int8)
        back[:, 0] = np.arange(len(TAGS))
        for t in range(1, e.shape[1]):
            step = score[:, :, None] + tr[None]
            best = step.argmax(axis=1)
            live = (t < long)[:, None]
            back[:, t] = np.where(live, best, np.arange(len(TAGS))[None])
            score = np.where(live, np.take_along_axis(step, best[:, None], 1).squeeze(1) + e[:, t], score)
        tag = score.argmax(axis=1)
        path = np.zeros(e.shape[:2], np.int64)
        for t in range(e.shape[1] - 1, -1, -1):
            path[:, t] = tag
            tag = back[np.arange(len(part)), t, tag]
        for i, p, n in zip(part, path, long, strict=True):
            out[i] = p[:n].tolist()
    return out


def stretches(text: str) -> list[tuple[int, list[re.Match]]]:
    """Token stretches around digits and at-signs."""
    areas: list[list[int]] = []
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if areas and a <= areas[-1][1]:
            areas[-1][1] = b
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        while a and text[a - 1].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum():
            b += 1
        out.append((a, list(TOKEN.finditer(text, a, b))))
    return out


def good(kind: str, s: str) -> bool:
    d = digits(s)
    if "\n" in s:
        return False
    if kind == "card":
        return good_card(s)
    if kind == "phone":
        return 10 <= len(d) <= 15 and len(re.findall(r"[0-9]+", s)) >= 3 and not re.search(r"[A-Za-z,:/@]", s)
    if kind == "ip":
        parts = s.split(".")
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    return bool(re.search(r"@|[\[({]\s?at\s?[\])}]", s, re.IGNORECASE) and re.search(r"\.|\bdot\b", s, re.IGNORECASE) and re.search(r"[A-Za-z]", s))


def find_all(texts: list[str], model: tuple[np.ndarray, np.ndarray], base: list[list[Span]] | None = None) -> list[list[Span]]:
    base = base or [base_spans(t) for t in texts]
    where, rows, tokens = [], [], []
    for i, text in enumerate(texts):
        for _, own in stretches(text):
            if own:
                where.append(i)
                tokens.append(own)
                rows.append(features([m[0] for m in own]))
    added: list[list[Span]] = [[] for _ in texts]
    for i, own, tags in zip(where, tokens, viterbi(rows, *model), strict=True):
        j = 0
        while j < len(tags):
            if TAGS[tags[j]][0] == "B":
                kind, k = TAGS[tags[j]][2:], j + 1
                while k < len(tags) and TAGS[tags[k]] == f"I-{kind}":
                    k += 1
                a, b = own[j].start(), own[k - 1].end()
                if good(kind, texts[i][a:b]):
                    added[i].append((kind, a, b))
                j = k
            else:
                j += 1
    return [ordered([*b, *free(x, b)], KINDS) for b, x in zip(base, added, strict=True)]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row: all spans by start then kind, those of the patterns marked as base."""
    model = tuple(a.astype(np.float32) for a in trained())

    def run(texts: list[str]) -> list[list[tuple[str, int, int, bool]]]:
        base = [base_spans(t) for t in texts]
        return [[(*s, s in named) for s in own] for own, named in zip(find_all(texts, model, base), map(set, base), strict=True)]

    return span_table(docs, run, id_col, text_col)
