"""Personal data in text, also where it is disguised.

Plain detectors find e-mail addresses, IP addresses, card and phone numbers.
Two transducers then rewrite a text and keep, for every character they put
out, the span of source characters it stands for: the first maps look-alike
and compatibility characters and drops invisible ones, the second turns
spelled digits into digits and written-out "at" and "dot" into signs.  The
detectors run again on what comes out, and what they find there is mapped
back to the source text.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+){3,}")
_PARTS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "υ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " ",
    "․": ".", "。": ".", "·": ".", "ı": "i", "ℓ": "l",
}
# Words for digits and signs in the four languages of the corpus.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"plus": "+", "más": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "tiret": "-"}
AT_WORDS = ("at", "arroba", "arobase", "klammeraffe", "chez")
DOT_WORDS = ("dot", "point", "punkt", "punto", "period")
# First labels of the domains of mail providers; after one, a bare "at" is a sign.
PROVIDERS = ("gmail", "googlemail", "yahoo", "hotmail", "outlook", "live", "icloud", "aol", "gmx", "web", "proton", "protonmail", "orange", "laposte")
# Character references and escapes of the two signs.
AT_CODES, DOT_CODES = r"&#0{0,4}64;|&#x0{0,4}40;|&commat;|%40", r"&#0{0,4}46;|&#x0{0,4}2e;|&period;|%2e"

_INVISIBLE = "­​‌‍‎‏⁠﻿"
_STRANGE = re.compile("[" + _INVISIBLE + "".join(map(re.escape, LOOKALIKES))
                      + "٠-٩۰-۹०-९²³¹⁰-⁹₀-₉①-⑨﹒﹫！-～\U0001d400-\U0001d7ff]")
_WORDS = DIGIT_WORDS | SIGN_WORDS
_ONE = r"(?:" + "|".join(sorted(map(re.escape, _WORDS), key=len, reverse=True)) + r"|[0-9]+)"
#: Words or figures in a row, separated by spaces, commas, brackets or a hyphen; seven of them, or seven digits, are rewritten.
LEAST = 7
_BETWEEN = r"(?:[\s,()]{1,3}|-)"
_SPELLED = re.compile(r"\+?(?<![^\W_])" + _ONE + r"(?:" + _BETWEEN + _ONE + r")+(?![^\W_])", re.IGNORECASE)
_SPELLED_WORD = re.compile(r"[^\W\d_]+|[0-9]+|\+", re.IGNORECASE)
_AT, _DOT = "|".join(AT_WORDS), "|".join(DOT_WORDS)
_OPEN, _SHUT = r"\s{0,2}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,2}"
_SIGN_AT = rf"(?:{_OPEN}(?:{_AT}|@|a){_SHUT}|\s{{0,2}}@\s{{0,2}}|[_-](?:{_AT})[_-]|{AT_CODES})"
_WRITTEN_DOT = rf"{_OPEN}(?:{_DOT}|\.){_SHUT}|\s(?:{_DOT})\s|[_-](?:{_DOT})[_-]|{DOT_CODES}"
_SIGN_DOT = rf"(?:{_WRITTEN_DOT}|\s\.\s)"
#: Groups of figures with disguised dots between, as in an IP address.
_DOTTED = re.compile(rf"(?<![0-9])[0-9]+(?:(?:{_SIGN_DOT}|\.)[0-9]+){{3,}}", re.IGNORECASE)
_HIDDEN_DOT = re.compile(_SIGN_DOT, re.IGNORECASE)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_PROVIDER = rf"(?:{'|'.join(PROVIDERS)})\.{_LABEL}"
#: A clear "at" sign and any dots; or a bare "at" with written-out dots, before a provider of mail, or after a figure.
_CLOAKED = re.compile(rf"(?:{_SIGN_AT}(?={_LABEL}(?:{_SIGN_DOT}|\.){_LABEL})|\s(?:{_AT})\s(?={_LABEL}(?:{_WRITTEN_DOT}){_LABEL}|{_PROVIDER})"
                      rf"|(?<=[0-9])\s(?:{_AT})\s(?={_LABEL}\.{_LABEL}))", re.IGNORECASE)
_LOCAL_DOT = re.compile(rf"({_LABEL})({_SIGN_DOT})$", re.IGNORECASE)
_NEXT_LABEL = re.compile(rf"{_LABEL}", re.IGNORECASE)
_NEXT_DOT = re.compile(rf"{_SIGN_DOT}(?={_LABEL})", re.IGNORECASE)


#: What a text must hold for a transducer to change it; linear-time patterns over a whole column.
_HAS_STRANGE = _STRANGE.pattern.replace("\U0001d400", r"\x{1d400}").replace("\U0001d7ff", r"\x{1d7ff}")
_HAS_SPELLED = "(?i)" + _ONE + _BETWEEN + _ONE
_HAS_DOTTED = rf"(?i)[0-9]{_SIGN_DOT}[0-9]"
_HAS_CLOAKED = (rf"(?i){_SIGN_AT}{_LABEL}(?:{_SIGN_DOT}|\.)|\s(?:{_AT})\s{_LABEL}(?:{_SIGN_DOT}|\.)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for chain in _CHAIN.finditer(text):
        parts = [m.span() for m in _PARTS.finditer(text, *chain.span())]
        for i in range(0, len(parts) - 3, 4):
            if all(b - a <= 20 or not text[a:b].strip("0") or len(text[a:b].lstrip("0")) <= 3 for a, b in parts[i:i + 4]) \
                    and all(int(text[a:b].lstrip("0") or "0") <= 255 for a, b in parts[i:i + 4]):
                yield parts[i][0], parts[i + 3][1]


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the plain detectors find, by start, then kind."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, 1, b) for a, b in _ips(text)] + [(a, 2, b) for a, b in _cards(text)]
        if "+" in text:
            out += [(a, 3, b) for a, b in _phones(text)]
    return sorted(out)


class Traced:
    """A text whose characters know the span of the source they stand for."""

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None, changed: np.ndarray | None = None):
        n = len(text)
        self.text = text
        self.starts = np.arange(n) if starts is None else starts
        self.ends = np.arange(1, n + 1) if ends is None else ends
        self.changed = np.zeros(n, bool) if changed is None else changed

    def edit(self, edits: list[tuple[int, int, str]]) -> Traced:
        """Replace disjoint spans, given in order; each new character stands for the whole of its span."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a] if new else 0)]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1] if new else 0)]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        return Traced("".join(text), *(np.concatenate(x) for x in (starts, ends, changed)))


def _plain_character(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    value = unicodedata.digit(c, None)
    folded = str(value) if value is not None else unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() else c


def _folded(traced: Traced) -> Traced:
    edits = [(m.start(), m.end(), new) for m in _STRANGE.finditer(traced.text) if (new := _plain_character(m[0])) != m[0]]
    return traced.edit(edits) if edits else traced


def _written_out(traced: Traced) -> Traced:
    """Spelled digits as digits, disguised addresses with their signs."""
    text, edits = traced.text, []
    for m in _SPELLED.finditer(text):
        words = list(_SPELLED_WORD.finditer(text, *m.span()))
        digits = sum(len(w[0]) if w[0].isdigit() else w[0].lower() in DIGIT_WORDS for w in words)
        if not any(w[0].lower() in _WORDS for w in words) or max(digits, len(words)) < LEAST:
            continue
        for i, w in enumerate(words):
            end = words[i + 1].start() if i + 1 < len(words) else w.end()
            edits.append((w.start(), end, _WORDS.get(w[0].lower(), w[0])))
    spelled = edits[:]
    for m in _DOTTED.finditer(text):
        if not any(a < m.end() and b > m.start() for a, b, _ in spelled):
            edits += [(d.start(), d.end(), ".") for d in _HIDDEN_DOT.finditer(text, *m.span())]
    taken = {a for a, _, _ in edits}
    for m in _CLOAKED.finditer(text):
        a, b = m.span()
        if a == 0 or text[a - 1] not in _LOCAL:
            continue
        own = [(a, b, "@")] if text[a:b] != "@" else []
        at = a  # dots written out in the local part, right to left
        while d := _LOCAL_DOT.search(text, max(0, at - 80), _label_start(text, at)):
            own.append((d.start(2), d.end(2), "."))
            at = d.start(2)
        at = b
        while n := _NEXT_LABEL.match(text, at):
            if d := _NEXT_DOT.match(text, n.end()):
                own.append((d.start(), d.end(), "."))
                at = d.end()
            elif text[n.end():n.end() + 1] == ".":
                at = n.end() + 1
            else:
                break
        if not taken & {x for x, _, _ in own}:
            edits += own
            taken |= {x for x, _, _ in own}
    if not edits:
        return traced
    edits.sort()
    apart = [edits[0]]
    for e in edits[1:]:
        if e[0] >= apart[-1][1]:
            apart.append(e)
    return traced.edit(apart)


def _label_start(text: str, at: int) -> int:
    while at > 0 and text[at - 1] in _LOCAL:
        at -= 1
    return at


def may_hide(texts: pa.Array) -> list[bool]:
    """Whether each text may hold something that ``all_spans`` would rewrite."""
    flags = [pc.match_substring_regex(texts, p) for p in (_HAS_STRANGE, _HAS_SPELLED, _HAS_CLOAKED, _HAS_DOTTED)]
    return [bool(x) for x in pc.or_(pc.or_(flags[0], flags[1]), pc.or_(flags[2], flags[3])).to_pylist()]


def all_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The plain spans and those found only after rewriting.

    The latter overlap no plain span of their kind, or hold it whole and more,
    as where a look-alike has cut off the head of an address."""
    traced = _written_out(_folded(Traced(text)))
    if not traced.changed.any() and len(traced.text) == len(text):
        return plain
    out = list(plain)
    for a, kind, b in plain_spans(traced.text):
        start, end = int(traced.starts[a]), int(traced.ends[b - 1])
        altered = traced.changed[a:b].any() or end - start != b - a
        if altered and all(k != kind or y <= start or x >= end or (start <= x and y <= end and y - x < end - start) for x, k, y in out):
            out.append((start, kind, end))
    return sorted(out)


def as_string(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans)`` for each row of ``docs(doc_id, text, ...)``.

    The counts and ``base_spans`` are those of the plain detectors; ``spans``
    also has what was disguised.  Spans are ``kind:start:end`` in code points,
    end exclusive, by start and then kind, joined by commas.  A null or empty
    text has none.  Repeated rows are returned each.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans"]

    def run(batches):
        for batch in batches:
            counts, base, spans = ([], [], [], []), [], []
            for value, hidden in zip(batch.column("text"), may_hide(batch.column("text")), strict=True):
                text = value.as_py() or ""
                plain = plain_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in plain))
                base.append(as_string(plain))
                spans.append(as_string(all_spans(text, plain)) if hidden else base[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                 pa.array(spans, pa.string())], names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, spans string")


def masked(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with every span of personal data replaced by its kind in angle brackets."""
    def run(batches):
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                pieces, at = [], 0
                for a, kind, b in all_spans(text, plain_spans(text)):
                    if a >= at:
                        pieces += [text[at:a], f"<{KINDS[kind]}>"]
                    at = max(at, b)
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text string")
