"""Personal data: candidate spans scored by gradient-boosted trees, beside fixed base patterns.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and non-overlapping for each
kind. For what they miss, generators with high recall propose overlapping spans of the same kinds, of secrets (tokens of any
length, web tokens of three parts, named passwords) and of personal numbers (social security, IBAN); boosted trees score a
span from its format and the words around it; a span over its kind's calibrated threshold is added unless it overlaps a base
span, other than to hold it whole, or a longer one. The trees are trained on made spans, drawn from a seed: true forms of each
kind with separators, casing and context varied, and look-alikes (dates, versions, amounts, order numbers, words, pieces).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import boosting
from tallyspark.llm.common import read

KINDS = ("email", "ip", "card", "phone")
MORE = ("secret", "id")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A look-behind keeps runs of digits from being tried at each of their digits; the matches are the same.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """Looks back from each @, so that long runs of name characters cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base patterns' spans by kind, in code points, end exclusive."""
    found = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


#: What follows an e-mail's local part: a form of @, a name, and forms of dots with names.
_AFTER_LOCAL = r"(?:@|[\[(]\s?at\s?[\])]|\bat\b)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]\s?dot\s?[\])]|\bdot\b)\s?[A-Za-z]{2,24})+"
_MAIL = re.compile(_AFTER_LOCAL, re.I)
#: A group of an IPv6 address, and what may stand on either side of its gap.
_HEX = "[0-9A-Fa-f]{1,4}"
_SIDE = f"(?:{_HEX}(?::{_HEX}){{0,6}})?"
_NAMED = r"\b(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth)\b[\"']?\s*(?:[:=]|\bis\b)\s*[\"']?"
#: Generators of candidates: kind and pattern; they may overlap one another and the base. A group, if there is one, is the span.
GENERATORS = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?" + _AFTER_LOCAL, re.I)),
    ("ip", re.compile(rf"(?<![0-9A-Za-z:.])(?!::(?!{_HEX})|(?:{_HEX}::?){{8}}){_SIDE}::{_SIDE}(?![0-9A-Za-z:])|(?<![0-9A-Fa-f:])(?:{_HEX}:){{3,7}}:?{_HEX}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:00[1-9][0-9]{0,2}[ .-])?(?:\([0-9]{2,4}\)[ ]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?:[ .-]?[0-9]{2,4})?(?![0-9]|[.-][0-9])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_/+-])[0-9A-Za-z_/+-]{24,}+={0,2}(?![0-9A-Za-z_/+-])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z_.-])eyJ[0-9A-Za-z_-]{4,}+\.[0-9A-Za-z_-]{4,}+\.[0-9A-Za-z_-]*+")),
    ("secret", re.compile(_NAMED + r"(?P<span>[^\s\"',;<>]{5,}(?<![.!?)]))", re.I)),
    ("id", re.compile(r"(?<![0-9-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9-])")),
    ("id", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
)
_CUES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)\b", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|client|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|whatsapp|sms)\b", re.I),
    "secret": re.compile(r"\b(?:token|key|secret|password|passwd|passphrase|pwd|apikey|api_key|bearer|auth)\b", re.I),
    "id": re.compile(r"\b(?:ssn|social security|iban|account|tax id)\b", re.I),
}
_ALL = (*KINDS, *MORE)
_COUNTER_CUE = re.compile(r"\b(?:version|v|isbn|order|invoice|no|nr|page|total|item|article|ref|section|date|year|hash|commit|sha|md5|checksum)\b", re.I)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that the generators propose, whatever their length. A generator is skipped only where a part that each of its spans holds is nowhere in the text."""
    digits = _DIGIT.search(text) is not None
    possible = {"email": _MAIL.search(text) is not None, "ip": ":" in text, "card": digits, "phone": digits, "secret": True, "id": digits}
    found = []
    for kind, pattern in GENERATORS:
        if possible[kind]:
            part = "span" if "span" in pattern.groupindex else 0
            found += [(kind, *m.span(part)) for m in pattern.finditer(text)]
    return list(dict.fromkeys(found))


def _iban(span: str) -> bool:
    """The check of an IBAN: its rotated digits, with letters as numbers from 10 on, leave 1 at division by 97."""
    plain = span.replace(" ", "")
    return plain[:2].isalpha() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Small integers on the span's format and the 40 characters on either side."""
    span, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 40]
    digits = [c for c in span if c.isdigit()]
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    letters = sum(c.isalpha() for c in span)
    kinds = len(set(span.lower()))
    near = before[-20:]
    return [
        _ALL.index(kind),
        len(span) // 4,
        len(digits),
        len(groups),
        max(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        letters // 4,
        kinds,
        int(kind == "card" and luhn("".join(digits))),
        span.count("."),
        span.count("-"),
        sum(c.isspace() for c in span),
        int("(" in span or "[" in span),
        int("@" in span),
        sum(c.isupper() for c in span) // 2,
        int(all(c in "0123456789abcdefABCDEF" for c in span)),
        sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:], strict=False)),
        int(bool(_CUES[kind].search(near))) + int(bool(_CUES[kind].search(before))),
        int(bool(_COUNTER_CUE.search(near))),
        int(bool(re.search(r"[=:]\s*[\"']?$", before))),
        int(bool(re.match(r"\s*(?:%|€|EUR|USD|kg|km|cm|mm|GB|MB|°)", after))) + int(bool(re.search(r"[$€£]\s?$", before))),
        int(before[-1:].isalnum()) + 2 * int(after[:1].isalnum()),
        int(before[-1:] == ".") + 2 * int(after[:1] == "." and after[1:2].isalnum()),
        int(span.startswith("eyJ")) + 2 * int(kind == "id" and _iban(span)),
        int(len(digits) >= 8 and all(19 <= int(y) <= 20 for y in re.findall(r"(?<![0-9])([0-9]{2})[0-9]{2}[-./][0-9]{2}[-./][0-9]{2}", span)[:1])),
    ]


@dataclass
class Detector:
    model: boosting.Boosted
    limits: dict[str, float]

    def added(self, text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int]]:
        taken = [s for spans in base.values() for s in spans]
        found = [c for c in candidates(text) if not any(a < c[2] and c[1] < b and not (c[1] <= a and b <= c[2] and b - a < c[2] - c[1]) for a, b in taken)]
        if not found:
            return []
        scores = self.model.score(np.clip(np.array([features(text, *c) for c in found]), 0, 31))
        sure = [(c, s) for c, s in zip(found, scores.tolist(), strict=True) if s >= self.limits[c[0]]]
        kept: list[tuple[str, int, int]] = []
        for c, _ in sorted(sure, key=lambda x: (x[0][1] - x[0][2], -x[1], x[0])):
            if not any(a < c[2] and c[1] < b for _, a, b in kept):
                kept.append(c)
        return sorted(kept, key=lambda c: (_ALL.index(c[0]), c[1]))


_BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


class Made:
    """Made spans of every kind and look-alikes, drawn from a seed."""

    cues = {
        "email": ["email", "contact", "write to", "mail"],
        "ip": ["ip", "host", "client address"],
        "card": ["card", "visa", "credit card", "payment"],
        "phone": ["phone", "tel", "call", "mobile", "fax"],
        "secret": ["token =", "key:", "password =", "secret:", "api_key ="],
        "id": ["ssn", "social security", "iban", "account"],
    }

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[self.rng.integers(len(xs))]

    def draw(self, alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(len(alphabet), size=k))

    def number(self, k: int) -> str:
        return self.draw("0123456789", k)

    def word(self) -> str:
        return self.draw("aeioutrnslmdk", int(self.rng.integers(2, 9)))

    def words(self, k: int) -> str:
        return " ".join(self.word() for _ in range(k))

    def email(self) -> str:
        at, dot = self.pick([" at ", " (at) ", "[at]", " @ "]), self.pick([" dot ", " (dot) ", "[dot]", "."])
        return f"{self.word()}{at}{self.word()}{dot}{self.pick(['com', 'org', 'net', 'de'])}"

    def ip(self) -> str:
        groups = [f"{self.rng.integers(1, 65536):x}" for _ in range(8)]
        if self.rng.random() < 0.5:
            return ":".join(groups)
        k = self.rng.integers(5)
        head = ":".join(self.pick([["2001", "db8"], ["fe80"], groups[:1], groups[:2], groups[:3]]))
        return f"{head}::{':'.join(groups[8 - k :])}" if k or self.rng.random() < 0.5 else f"::{groups[0]}"

    def card(self) -> str:
        digits = self.pick(["4", "5", "6"]) + self.number(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        return self.pick([" ", "-", ".", ""]).join(digits[k : k + 4] for k in range(0, 16, 4))

    def phone(self) -> str:
        return self.pick(["({}) {}-{}", "{}-{}-{}", "{} {} {}", "{}.{}.{}", "0049 {} {} {}"]).format(self.number(3), self.number(3), self.number(4))

    def secret(self) -> str:
        kind = self.rng.random()
        if kind < 0.4:
            return self.draw("0123456789abcdef", self.pick([32, 40, 64, 128, 200]))
        if kind < 0.7:
            return self.draw(self.pick([_BASE64, _BASE64[:52]]), self.pick([24, 32, 40, 150, 400]))
        if kind < 0.85:
            return f"eyJ{self.draw(_BASE64, 20)}.eyJ{self.draw(_BASE64, self.pick([30, 80, 200]))}.{self.draw(_BASE64, 43)}"
        return self.word() + self.draw("0123456789!#$%", int(self.rng.integers(2, 5))) + self.draw(_BASE64, int(self.rng.integers(2, 9)))

    def id(self) -> str:
        if self.rng.random() < 0.5:
            return f"{self.number(3)}-{self.number(2)}-{self.number(4)}"
        country, rest = self.pick(["DE", "FR", "GB", "ES"]), self.number(self.pick([16, 18, 20]))
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        plain = f"{country}{check:02d}{rest}"
        return self.pick([plain, " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))])

    def look_alike(self) -> tuple[str, str]:
        """Words before, and a span that is none."""
        n, rng = self.number, self.rng
        return self.pick([
            lambda: ("", f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d} {rng.integers(24):02d}:{n(2)}:{n(2)}"),
            lambda: ("version", ".".join(n(self.pick([1, 2])) for _ in range(4))),
            lambda: ("isbn", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}"),
            lambda: ("order no", n(self.pick([10, 12, 16]))),
            lambda: ("invoice", " ".join(n(4) for _ in range(4))),
            lambda: ("", f"{n(3)} {n(3)} {n(3)} EUR"),
            lambda: ("page", f"{n(3)}-{n(3)}-{n(4)}"),
            lambda: ("section", f"{n(2)}.{n(3)}.{n(4)}"),
            lambda: ("", "-".join(self.word() for _ in range(6)) + n(1)),
            lambda: ("", "".join(self.word() for _ in range(6)) + n(1)),
            lambda: ("", "".join(self.word().capitalize() for _ in range(7))),
            lambda: ("", "/".join(self.word() for _ in range(self.pick([6, 12, 40])))),
            lambda: ("", self.pick("aeiou-_") * int(rng.integers(24, 200))),
            lambda: ("commit", self.draw("0123456789abcdef", 40)),
            lambda: ("checksum", self.draw("0123456789abcdef", 64)),
            lambda: ("", f"{self.word()} at {self.word()}.{self.pick([' ', chr(10)])}{self.word()}"),
            lambda: ("", f"{self.word()} is at {self.word()} dot {self.word()}"),
            lambda: ("", ":".join(n(2) for _ in range(4))),
            lambda: ("", f"{self.pick(['add', 'dead', 'face', 'a', 'b', self.word()])}::{self.pick(['bad', 'fade', 'c', 'e', self.word()])}"),
            lambda: ("", n(16)),
            lambda: ("", f"{n(3)} {n(3)} {n(4)} {self.word()}"),
            lambda: (self.pick(["the password is", "a token is", "secret:", "your password:", "the token ="]), f"{self.word()}{self.word()}"),
            lambda: (self.pick(["part", "item", "order no"]), f"{n(3)}-{n(2)}-{n(4)}"),
            lambda: (self.pick(["", "ref"]), f"{self.draw('ABCDEFGHIJ', 2)}{n(2)} " + " ".join(self.draw("ABCDEFGHIJ0123456789", 4) for _ in range(4))),
        ])()

    def text(self) -> tuple[str, str, int, int]:
        """A sentence, the kind of its span (empty for a look-alike), and the span's ends."""
        kind = self.pick(_ALL) if self.rng.random() < 0.5 else ""
        lead, span = ("", getattr(self, kind)()) if kind else self.look_alike()
        if kind and (kind in ("phone", "card", "id") or kind == "secret" and len(span) < 24 or self.rng.random() < 0.7):
            lead = self.pick(self.cues[kind])
        quote = '"' if kind == "secret" and self.rng.random() < 0.5 else ""
        head = f"{self.words(self.rng.integers(1, 6))} {lead + ' ' if lead else ''}{quote}"
        return f"{head}{span}{quote}{self.pick([' ', '. ', ', '])}{self.words(self.rng.integers(1, 6))}", kind, len(head), len(head) + len(span)


def _examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about n candidates in made sentences. A candidate is right if it has the span's kind and holds it whole, but for a mark at its end."""
    made, rows, labels = Made(seed), [], []
    while len(rows) < n:
        text, kind, start, end = made.text()
        for k, a, b in candidates(text):
            if b > start and a < end:
                rows.append(features(text, k, a, b))
                labels.append(k == kind and start - 2 <= a <= start and b >= end - 1)
    return np.clip(np.array(rows), 0, 31), np.array(labels, float)


def train(n: int = 8000, precision: float = 0.98, seed: int = 7) -> Detector:
    """Fits on n made spans; thresholds are set on as many others, so that each kind's precision there is at least `precision`."""
    model = boosting.fit(*_examples(n, seed))
    x, y = _examples(n, seed + 1)
    scores = model.score(x)
    return Detector(model, {k: boosting.threshold(scores[x[:, 0] == j], y[x[:, 0] == j], precision) for j, k in enumerate(_ALL)})


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(text: str | None, detector: Detector) -> tuple[int, int, int, int, str, str]:
    """Base counts by kind, the base spans' SHA-256, and all spans."""
    text = text or ""
    base = base_spans(text)
    flat = [(k, a, b) for k in KINDS for a, b in base[k]]
    spans = sorted(flat + detector.added(text, base), key=lambda s: (_ALL.index(s[0]), s[1]))
    return *(len(base[k]) for k in KINDS), hashlib.sha256(_line(flat).encode()).hexdigest(), _line(spans)


def redact_text(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping ones the first counts, and the rest up to the last end goes."""
    out, done = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= done:
            out += [text[done:a], f"<{kind}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """One row per row of docs: id, the base counts, base_sha256, spans ("kind:start:end,...", by kind, then start).

    Null texts are empty; spans may have any length, and long texts are read whole; repeated rows give repeated rows; an empty
    table gives an empty one. Other columns are not read, so their names may clash.
    """
    detector = detector or train()

    @F.pandas_udf(_FOUND)
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            yield pd.DataFrame([find(x, detector) for x in some], columns=[c.split()[0] for c in _FOUND.split(", ")])

    return docs.select(F.col(id_col), spans(F.col(text_col)).alias("f")).select(id_col, "f.*")


def redact(docs: DataFrame, text_col: str = "text", detector: Detector | None = None) -> DataFrame:
    """docs with every found span in text_col replaced by its kind in angle brackets; null texts stay null; all columns are kept."""
    detector = detector or train()

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([x if x is None else redact_text(x, find(x, detector)[5]) for x in some], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))


def op7_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(read(spark, sf_dir, "documents"))
