"""Personal data by exact patterns and a semi-Markov conditional random field.

The patterns of the four base kinds give the base spans. The field adds what they don't meet: spelt-out mail
addresses, phone numbers without a country code, cards within longer runs of digits, keys, and secrets after a telling word.

``candidates`` is the one definition of where an entity may begin and end: shapes of bounded length, each of which looks at
its own characters and at most ``BEFORE`` before them. Tokens that aren't in a candidate can only be of no type, so the field
passes through "no type" between two stretches of touching candidates, and decoding each stretch by itself gives what decoding
the whole text would; no text that stands elsewhere changes a span. Within a stretch, dynamic programming
over (position, type) scores tokens and whole candidate spans by features of the span and of what stands beside it, and finds
the boundaries and types of greatest joint score. Base spans are constraints: they are the only way through their text.

The weights are learnt on the driver from generated sentences, by gradient steps on the conditional likelihood
(forward and backward sums over segmentations); seed and number of sentences are fixed, so runs agree.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
LABELS = ("none", *KINDS)
#: Characters before a span that its features see, and those of a secret's value, at most.
BEFORE, SECRET_CHARS = 24, 256
#: Parts of a spelt-out local part and of a spelt-out domain, and characters of a part, at most.
LOCAL_PARTS, DOMAIN_PARTS, PART_CHARS = 4, 5, 64

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGITS = {c: None for c in range(128) if not 48 <= c <= 57}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return s.translate(NOT_DIGITS) if s.isascii() else "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of local part, at sign and domain, found from the at signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches of four groups of digits joined by single dots, in one pass over the runs of digits and dots."""
    for run in DOTTED.finditer(text):
        begin, groups = run.start(), []
        at = begin
        for part in run.group().split("."):
            if part:
                groups.append((at, at + len(part)))
                if len(groups) == 4:
                    yield groups[0][0], groups[3][1]
                    groups = []
            else:
                groups = []
            at += len(part) + 1


def byte_parts(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start: what the patterns match and the checks let pass; a failing match is not retried."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", a, b) for a, b in addresses(text) if byte_parts(text[a:b])]
    for m in CARD.finditer(text):
        a, b = m.span()
        if 13 <= b - a <= 37 and 13 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            out.append(("card", a, b))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- where entities may be ---

DOT_WORD = r"(?:\x20dot\x20|\x20?[\[(]dot[\])]\x20?|\.)"
AT_WORD = re.compile(r"(?:\x20at\x20|\x20?[\[(]at[\])]\x20?|@)(?=[A-Za-z0-9])", re.I)
AT_SIGNS = (" at ", "at]", "at)", "@")
PART_BEFORE = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]{{1,{PART_CHARS}}}\Z")
DOT_BEFORE = re.compile(rf"{DOT_WORD}\Z", re.I)
PART = re.compile(rf"[A-Za-z0-9-]{{1,{PART_CHARS}}}(?![A-Za-z0-9-])")
DOT = re.compile(DOT_WORD, re.I)
COLONS = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,8}(?![0-9A-Za-z:])")
KEY_SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")
KEY = re.compile(rf"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{{12,20}}|gh[pousr]_[0-9A-Za-z]{{20,{SECRET_CHARS}}}|sk-[0-9A-Za-z]{{20,{SECRET_CHARS}}})(?![0-9A-Za-z])")
TOLD = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\s{0,2}\Z", re.I)
TELLING = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)\s{0,2}[=:]\s{0,2}[\"']?\Z", re.I)
SIGN = re.compile(r"[=:]")
VALUE = re.compile(rf"\s{{0,2}}[\"']?([^\s\"'<>]{{1,{SECRET_CHARS}}})(?![^\s\"'<>])")
TAIL = re.compile(r"[.,;:!?)\]}]*\Z")
CALL = re.compile(r"(?:tel|phone|call|fon|mobile|téléphone|teléfono)[.:]?\s{0,2}\Z", re.I)
RUN = re.compile(r"[+(]?[0-9][0-9 ().-]{5,}[0-9]")
GROUP = re.compile(r"[0-9]+")
GROUPED = re.compile(r"(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
PAIRS = re.compile(r"0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])")
CARDS = (
    re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])"),
    re.compile(r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}(?![0-9])"),
    re.compile(r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])"),
    re.compile(r"[0-9]{13,19}(?![0-9])"),
)


def spelt(text: str) -> Iterator[tuple[int, int]]:
    """Each choice of first and last part around an "at" that has a dotted name behind it."""
    low = text.lower()
    if not any(x in low for x in AT_SIGNS):
        return
    for m in AT_WORD.finditer(text):
        ends, at = [], m.end()
        for k in range(DOMAIN_PARTS):
            part = PART.match(text, at)
            if not part:
                break
            if k:
                ends.append(part.end())
            dot = DOT.match(text, part.end())
            if not dot:
                break
            at = dot.end()
        if not ends:
            continue
        at = m.start()
        for _ in range(LOCAL_PARTS):
            low_at = max(0, at - PART_CHARS - 1)
            part = PART_BEFORE.search(text[low_at:at])
            if not part:
                break
            begin = low_at + part.start()
            for end in ends:
                yield begin, end
            dot = DOT_BEFORE.search(text[max(0, begin - 7) : begin])
            if not dot:
                break
            at = begin - len(dot.group())


def is_ipv6(s: str) -> bool:
    groups = s.split(":")
    if "::" in s:
        return s.count("::") == 1 and ":::" not in s and len(groups) <= 9 and any(groups) and (groups[0] != "" or s.startswith("::")) and (groups[-1] != "" or s.endswith("::"))
    return len(groups) == 8 and all(groups)


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Phone numbers and cards within the runs of digits and separators."""
    for run in RUN.finditer(text):
        a, b = run.span()
        for g in GROUP.finditer(text, a, b):
            begin = g.start()
            starts = (begin - 1, begin) if begin > a and text[begin - 1] == "(" else (begin,)
            for s in starts:
                if m := GROUPED.match(text, s):
                    yield m.span()
            if m := PAIRS.match(text, begin):
                yield m.span()
            for shape in CARDS:
                if (m := shape.match(text, begin)) and luhn(digits_of(m.group())):
                    yield m.span()
        if CALL.search(text[max(0, a - BEFORE) : a]):
            n = 0
            for g in GROUP.finditer(text, a, b):
                n += len(g.group())
                if 7 <= n <= 15:
                    yield a, g.end()
                elif n > 15:
                    break


def candidates(text: str) -> list[tuple[int, int]]:
    """All spans that may be an entity, sorted; each depends on its own characters and a few before and behind it."""
    out = set(spelt(text))
    if text.count(":") > 1:
        out |= {m.span() for m in COLONS.finditer(text) if is_ipv6(m.group())}
    if any(x in text for x in KEY_SIGNS):
        out |= {m.span() for m in KEY.finditer(text)}
    for sign in SIGN.finditer(text):
        if TOLD.search(text[max(0, sign.start() - 16) : sign.start()]) and (m := VALUE.match(text, sign.end())):
            out.add(m.span(1))
            cut = TAIL.search(m.group(1))
            if 0 < cut.start() < len(m.group(1)):
                out.add((m.start(1), m.start(1) + cut.start()))
    out |= set(numbers(text))
    return sorted(out)


# --- the field ---

TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|\s+|.", re.S)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
AT_INSIDE = re.compile(r" at |[\[(]at[\])]|@", re.I)
FEATURES = ("bias", "email", "spelt", "ip", "ipv6", "card", "phone", "grouped", "pairs", "many_digits", "plain_digits", "luhn", "told_secret", "key", "told_phone", "mixed", "long", "short", "letters", "space", "newline", "left_joined", "right_joined", "quote", "edge_sign")


def span_features(text: str, a: int, b: int) -> list[int]:
    """Indices of the features that text[a:b] has as one segment."""
    s = text[a:b]
    if s.isspace():
        return [FEATURES.index("bias"), FEATURES.index("space")]
    digits = digits_of(s)
    n = len(digits)
    before, after = text[max(0, a - BEFORE) : a], text[b : b + 2]
    email = "@" in s and bool(EMAIL.fullmatch(s))
    good = {
        "bias": True,
        "email": email,
        "spelt": not email and len(s) > 6 and bool(AT_INSIDE.search(s)),
        "ip": n > 3 and bool(IP.fullmatch(s)) and byte_parts(s),
        "ipv6": ":" in s and is_ipv6(s),
        "card": 13 <= n <= 19 and bool(CARD.fullmatch(s)) and luhn(digits),
        "phone": 9 <= n <= 15 and bool(PHONE.fullmatch(s)),
        "grouped": n > 9 and bool(GROUPED.fullmatch(s)),
        "pairs": n == 10 and bool(PAIRS.fullmatch(s)),
        "many_digits": n >= 7,
        "plain_digits": n == len(s),
        "luhn": 13 <= n <= 19 and luhn(digits),
        "told_secret": bool(TELLING.search(before)),
        "key": len(s) > 15 and bool(KEY.fullmatch(s)),
        "told_phone": bool(CALL.search(before)),
        "mixed": 0 < n < len(s) and s.isalnum(),
        "long": len(s) >= 12,
        "short": len(s) < 6,
        "letters": s.isalpha(),
        "space": any(c.isspace() for c in s),
        "newline": "\n" in s,
        "left_joined": bool(before) and (before[-1].isalnum() or before[-1] in "@._%+-"),
        "right_joined": bool(after) and (after[0].isalnum() or (after[0] in "@.-_%+" and len(after) > 1 and after[1].isalnum())),
        "quote": '"' in s or "'" in s or "=" in s,
        "edge_sign": not s[-1].isalnum() or not (s[0].isalnum() or s[0] in "+("),
    }
    return [k for k, f in enumerate(FEATURES) if good[f]]


class Lattice:
    """Segments of a stretch of text: tokens, of no type, and candidates, of some type; a forced span is the only way through its text."""

    def __init__(self, text: str, start: int, end: int, spans: list[tuple[int, int]], forced: list[tuple[str, int, int]] = ()):
        edges = {start, end, *(m.start() + start for m in TOKEN.finditer(text[start:end]))}
        edges.update(x for s in spans for x in s)
        edges.update(x for _, *s in forced for x in s)
        self.at = sorted(edges)
        number = {p: i for i, p in enumerate(self.at)}
        shut = np.zeros(len(self.at) + 1, np.int64)
        for _, a, b in forced:
            shut[number[a]] += 1
            shut[number[b]] -= 1
        shut = np.cumsum(shut) > 0
        segs = [(i, i + 1, 0) for i in range(len(self.at) - 1) if not shut[i]]
        segs += [(number[a], number[b], -1) for a, b in spans if not shut[number[a] : number[b]].any()]
        segs += [(number[a], number[b], LABELS.index(kind)) for kind, a, b in forced]
        segs.sort(key=lambda s: (s[1], s[0]))
        self.segs = segs
        self.x = np.zeros((len(segs), len(FEATURES)), np.float32)
        allowed = np.zeros((len(segs), len(LABELS)), bool)
        for k, (i, j, label) in enumerate(segs):
            self.x[k, span_features(text, self.at[i], self.at[j])] = 1
            if label < 0:
                allowed[k, 1:] = True
            else:
                allowed[k, label] = True
        self.allowed = allowed

    def scores(self, w: np.ndarray) -> np.ndarray:
        return np.where(self.allowed, self.x @ w.T, -np.inf)


class Field:
    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    def decode(self, r: Lattice) -> list[tuple[str, int, int]]:
        """The typed segments of the best segmentation; a stretch begins and ends in text of no type."""
        t, y_all = self.t.tolist(), range(len(LABELS))
        none = [-np.inf] * len(LABELS)
        best = [none] * len(r.at)
        best[0] = [0.0, *none[1:]]
        back: list[list | None] = [None] * len(r.at)
        for k, ((i, j, label), s) in enumerate(zip(r.segs, r.scores(self.w).tolist(), strict=True)):
            if best[j] is none:
                best[j], back[j] = list(none), [None] * len(LABELS)
            from_, to, via = best[i], best[j], back[j]
            for y in (label,) if label >= 0 else y_all[1:]:
                prev = max(y_all, key=lambda p: from_[p] + t[p][y])  # noqa: B023
                v = from_[prev] + t[prev][y] + s[y]
                if v > to[y]:
                    to[y], via[y] = v, (k, prev)
        last = len(r.at) - 1
        out, j, y = [], last, max(y_all, key=lambda p: best[last][p] + t[p][0])
        while j > 0:
            k, prev = back[j][y]
            if y:
                out.append((LABELS[y], r.at[r.segs[k][0]], r.at[j]))
            j, y = r.segs[k][0], prev
        return out[::-1]

    def gradient(self, r: Lattice, gold: dict[tuple[int, int], int]) -> tuple[np.ndarray, np.ndarray, float]:
        """Of the log likelihood of the gold segmentation: (weights, transitions, likelihood)."""
        s = r.scores(self.w)
        n, m = len(r.at) - 1, len(LABELS)
        start, end = np.array([x[0] for x in r.segs]), np.array([x[1] for x in r.segs])
        alpha, beta = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        alpha[0, 0] = 0.0
        for j in range(1, n + 1):
            into = np.flatnonzero(end == j)
            alpha[j] = _lse((alpha[start[into]][:, :, None] + self.t[None] + s[into][:, None, :]).reshape(-1, m))
        beta[n] = self.t[:, 0]
        for i in range(n - 1, -1, -1):
            o = np.flatnonzero(start == i)
            beta[i] = _lse((self.t[None] + (s[o] + beta[end[o]])[:, None, :]).transpose(0, 2, 1).reshape(-1, m))
        z = _lse((alpha[n] + self.t[:, 0])[:, None])[0]
        p = np.exp(alpha[start][:, :, None] + self.t[None] + (s + beta[end])[:, None, :] - z)  # segment, before, label
        gw, gt = -p.sum(axis=1).T @ r.x, -p.sum(axis=0)
        gt[:, 0] -= np.exp(alpha[n] + self.t[:, 0] - z)
        j, y, like = 0, 0, -z
        segs = {(a, b): k for k, (a, b, _) in enumerate(r.segs) if r.allowed[k, 0] or (a, b) in gold}
        for k, (a, b, _) in enumerate(r.segs):
            if (a, b) in gold and r.allowed[k, gold[(a, b)]]:
                segs[(a, b)] = k
        ends = {a: (b, label) for (a, b), label in gold.items()}
        while j < n:
            b, label = ends.get(j, (j + 1, 0))
            k = segs[(j, b)]
            gw[label] += r.x[k]
            gt[y, label] += 1
            like += s[k, label] + self.t[y, label]
            j, y = b, label
        gt[y, 0] += 1
        return gw, gt, like + self.t[y, 0]


def _lse(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.full(x.shape[1], -np.inf)
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def generated(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with entities of every type and with numbers, names and telling words that are none."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    word = lambda: "".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 8)))
    hexa = lambda k: "".join(rng.choices("0123456789abcdef", k=k))

    def card(k: int) -> str:
        x = rng.choice("3456") + d(k - 2)
        return next(x + c for c in "0123456789" if luhn(x + c))

    def entity() -> tuple[str, str, str]:
        kind = rng.choice(KINDS)
        user, host = rng.choice([word(), f"{word()}.{d(2)}", f"{word()}_{word()}"]), rng.choice([f"mail{d(1)}.example", word(), f"{word()}.{word()}"])
        top = rng.choice(["com", "org", "net", "de", "fr"])
        if kind == "email":
            return kind, "", rng.choice([f"{user}@{host}.{top}", f"{word()} at {word()} dot {top}", f"{word()} [at] {word()} [dot] {top}", f"{word()}(at){word()}.{top}", f"{word()} dot {word()} at {word()} dot {top}"])
        if kind == "ip":
            return kind, "", rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(hexa(4) for _ in range(8))])
        if kind == "card":
            x = card(rng.choice([13, 15, 16, 16, 16, 19]))
            return kind, "", rng.choice([x, x, " ".join(x[i : i + 4] for i in range(0, len(x), 4)), "-".join(x[i : i + 4] for i in range(0, len(x), 4))])
        if kind == "phone":
            a, b, c = rng.choice("23456789") + d(2), d(3), d(4)
            return kind, rng.choice(["", "", "tel: ", "call "]), rng.choice([f"+1 ({a}) {b}-{c}", f"+{d(2)} {a} {b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{rng.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"])
        tell = rng.choice(["password=", "token = \"", "secret: ", "api_key=", "pwd=", ""])
        return kind, tell, rng.choice([hexa(rng.randint(16, 40)), f"{word()}{d(3)}{word()}"]) if tell else "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))

    def none() -> str:
        return rng.choice([d(rng.randint(1, 6)), f"{d(1)}.{d(2)}", f"19{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(3)},{d(3)}", f"x={d(2)}", f"{word()}{d(2)}", f"at {word()}", "@", f"@{word()}", f"${d(3)}.{d(2)}", f"{word()} = {word()}", f"{d(4)}-{d(4)}", f"{d(8)}", f"3{d(2)}.9{d(2)}.4{d(2)}.{d(2)}", hexa(8), f"secret: {word()}", f"the token = {word()}", f"password: {word()}", f"call {d(3)}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 4)):
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + ", "
            if rng.random() < 0.6:
                kind, tell, x = entity()
                text += tell
                spans.append((kind, len(text), len(text) + len(x)))
                text += x + rng.choice([" ", ", ", ". ", '" ' if tell.endswith('"') else "; "])
            else:
                text += none() + rng.choice([" ", ", ", ". "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(n: int = 240, rounds: int = 5, seed: int = 11) -> Field:
    field = Field(np.zeros((len(LABELS), len(FEATURES))), np.zeros((len(LABELS), len(LABELS))))
    cases = []
    for text, spans in generated(n, seed):
        every = sorted({*candidates(text), *((a, b) for _, a, b in base_spans(text))})
        r = Lattice(text, 0, len(text), every)
        at = {p: i for i, p in enumerate(r.at)}
        gold = {(at[a], at[b]): LABELS.index(kind) for kind, a, b in spans if (a, b) in set(every)}
        cases.append((r, gold))
    gw2, gt2 = np.full_like(field.w, 1e-2), np.full_like(field.t, 1e-2)
    for _ in range(rounds):
        for r, gold in cases:
            gw, gt, _ = field.gradient(r, gold)
            gw, gt = gw - 1e-3 * field.w, gt - 1e-3 * field.t
            gw2 += gw**2
            gt2 += gt**2
            field.w += 0.6 * gw / np.sqrt(gw2)
            field.t += 0.2 * gt / np.sqrt(gt2)
    return field


def forced_spans(base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans without overlaps: of those that overlap, one span over all, of the kind that begins first."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in sorted(base, key=lambda s: (s[1], -s[2])):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], b))
        else:
            out.append((kind, a, b))
    return out


def stretches(spans: list[tuple[int, int]], forced: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]], list[tuple[str, int, int]]]]:
    """(start, end, candidates, forced spans) of each run of candidates and forced spans that overlap or touch and has a candidate."""
    held: tuple[int, int, list, list] | None = None
    for a, b, kind in sorted([(a, b, "") for a, b in spans] + [(a, b, kind) for kind, a, b in forced]):
        if held is None or a > held[1]:
            if held and held[2]:
                yield held
            held = (a, b, [], [])
        if kind:
            held[3].append((kind, a, b))
        else:
            held[2].append((a, b))
        held = (held[0], max(held[1], b), held[2], held[3])
    if held and held[2]:
        yield held


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind as listed and then start."""
    base = base_spans(text)
    spans = candidates(text)
    if not spans:
        return base, base
    forced = forced_spans(base)
    fixed = set(forced)
    more = []
    for a, b, inside, held in stretches(spans, forced):
        more += [s for s in field.decode(Lattice(text, a, b, inside, held)) if s not in fixed]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): one row for each row of ``docs``; positions are code points, end exclusive.

    A null or empty text has no spans; a repeated row gets its row again; other columns, of whatever name, aren't read. Base
    spans stay as they are, and the field's spans don't overlap them. Time and memory grow with the length of a text, whatever
    is in it: candidates have bounded lengths, and at most a fixed number of them begins at one place.
    """
    field = trained()
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shape = lambda found: [{"kind": k, "start": a, "end": b} for k, a, b in found]

        def work(ids: list, texts: list[str]) -> pa.RecordBatch:
            found = [find(t, field) for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([shape(b) for b, _ in found], span), pa.array([shape(s) for _, s in found], span)], names=["doc_id", "base", "spans"])

        return work

    return map_texts(docs, make, f"doc_id {kind}, base {SPANS}, spans {SPANS}", id_col, text_col)


def digest(found: DataFrame) -> DataFrame:
    def joined(col: str):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
