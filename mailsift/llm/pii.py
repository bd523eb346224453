"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
URL schemes and identifier cues (password, token, account ...). A small
deterministic parser then expands each anchor to the boundaries of an email,
phone number, address with credentials or account value and validates it.
Digit runs (IP addresses, payment cards) start at any digit; they are found by
their grammar and validated (parts up to 255, Luhn).

Kinds, in order: email, ip, card, phone (the base: leftmost, non-overlapping
per kind, a match that fails validation is dropped and the search goes on
behind it), then url (a scheme with credentials before its host) and account
(a cue in any case, a separator and an IBAN with
right check digits, digits in groups, or an unbroken value with a digit). Base
spans stay as they are. A url may overlap them (the end of a password and the
host look like an email), and so may an account that is not inside spans found
before; added spans of one kind never overlap. The text loses the union of all.

Defined results: null text is an empty text; positions are code points, ends
exclusive; each row is judged by itself, so repeated rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from mailsift.llm.words import slices

KINDS = ("email", "ip", "card", "phone", "url", "account")
#: Identifier cues (fixed values), matched in any mixture of case.
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api key", "access key", "account", "acct", "iban", "login", "user id", "userid", "ssn", "passport")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGIT = re.compile("[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_CREDENTIALS = re.compile(r"[^\s/@:\"'<>]+(?::[^\s/@\"'<>]*)?@[^\s\"'<>]+")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_+/-]{5,}=*")
_CUED = re.compile(r"(?:[ _-]?(?:no|number|id|nr)\.?)?[ \t]*[=:#][ \t]*[\"']?(?=[A-Za-z0-9])", re.IGNORECASE)
#: Digit groups of two or more after a group of digits, which a few letters may lead.
_GROUPED = re.compile(r"(?:[A-Za-z]{1,3}[ -])?[A-Za-z]{0,4}[0-9]+(?:[ -][0-9]{2,})+(?![A-Za-z0-9_@])")
#: Groups of four, the last one may be shorter.
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:[ -]?[A-Za-z0-9]{4}){2,7}(?:[ -]?[A-Za-z0-9]{1,3})?")


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark, kind in (("@", "at"), ("+", "plus"), ("://", "scheme")):
        found.add_word(mark, (kind, len(mark)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _lower(text: str) -> str:
    """``text`` with A-Z in lower case, all positions unchanged."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email_end = phone_end = 0
    later = []
    for last, (anchor, size) in automaton.iter(_lower(text)):
        at = last - size + 1
        if anchor == "at":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            found = _EMAIL.match(text, start) if start < at else None
            if found:
                spans["email"].append(found.span())
                email_end = found.end()
        elif anchor == "plus":
            found = _PHONE.match(text, at) if at >= phone_end else None
            if found:
                phone_end = found.end()
                if 8 <= sum(c.isdigit() for c in found.group()) <= 15:
                    spans["phone"].append(found.span())
        else:
            later.append((anchor, at, last + 1))
    if _DIGIT.search(text):
        for found in _IP.finditer(text):
            if all(int(p) <= 255 for p in found.group().split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in found.group().split(".")):
                spans["ip"].append(found.span())
        for found in _CARD.finditer(text):
            digits = found.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans["card"].append(found.span())
    if later:
        taken = bytearray(len(text))
        for a, b in (s for k in KINDS[:4] for s in spans[k]):
            taken[a:b] = b"\1" * (b - a)
        for kind, parser in (("url", _url), ("account", _account)):
            before = 0  # end of the kind's last span
            for anchor, at, end in later:
                span = parser(text, at, end) if (anchor == "scheme") == (kind == "url") else None
                if span and span[0] >= before and taken.find(0, *span) >= 0:
                    spans[kind].append(span)
                    taken[span[0]:span[1]] = b"\1" * (span[1] - span[0])
                    before = span[1]
    return spans


def _url(text: str, at: int, end: int) -> tuple[int, int] | None:
    scheme, rest = _SCHEME.search(text, max(0, at - 16), at), _CREDENTIALS.match(text, end)
    return (scheme.start(), rest.end()) if scheme and rest else None


def _iban_end(text: str, at: int) -> int:
    """The end of the longest IBAN (by its check digits) at ``at``, or ``at``."""
    found = _IBAN.match(text, at)
    end = found.end() if found else at
    while end > at:
        code = text[at:end].replace(" ", "").replace("-", "")
        if len(code) < 15:
            return at
        whole = end == len(text) or not text[end].isalnum()
        if whole and text[end - 1].isalnum() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
        end -= 1
    return at


def _account(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The value after a cue: an IBAN, unbroken or in groups, else the longer of
    one unbroken value and groups of digits, of six characters at least."""
    if at and text[at - 1].isalnum():
        return None
    cued = _CUED.match(text, end)
    if not cued:
        return None
    start = cued.end()
    last = _iban_end(text, start)
    if last == start:
        found = [m.end() for m in (_VALUE.match(text, start), _GROUPED.match(text, start)) if m and m.end() - start >= 6 and _DIGIT.search(m.group())]
        last = max(found, default=start)
    return (start, last) if last > start else None


def redact(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with each span replaced by its kind (overlapping spans: their union by the first)."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    fields = [("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))]
    for batch in batches:
        for part in slices(batch):
            spans, texts = [], []
            for text in part.column("text").to_pylist():
                found = find_spans(text or "", automaton)
                flat = [(k, a, b) for k in KINDS for a, b in found[k]]
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in flat])
                texts.append(redact(text, found) if flat else text)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(spans, fields[0][1]), pa.array(texts, pa.string())], ["row", "spans", "redacted"])


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` and spans (kind, start, end; by kind, then
    start) and redacted (null for null text); columns of these names in
    ``docs`` are replaced."""
    kept = [c for c in docs.columns if c not in ("spans", "redacted")]
    packed = docs.selectExpr("struct(" + ", ".join(f"`{c}`" for c in kept) + ") AS row", f"`{text}` AS text")
    kind = packed.schema["row"].dataType.simpleString()
    out = packed.mapInArrow(_scan, f"row {kind}, spans array<struct<kind:string,start:int,end:int>>, redacted string")
    return out.select("row.*", "spans", "redacted")
