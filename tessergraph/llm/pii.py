"""Personal data by anchor expansion."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessergraph.llm.common import id_text, unused

KINDS = ("email", "url_login", "ipv4", "ipv6", "phone", "card", "iban", "national_id", "account")
_LOCAL, _HOST, _HEX = frozenset("._%+-'"), frozenset(".-"), frozenset("0123456789abcdefABCDEF:.")
_DIGITS = frozenset("0123456789")
_NUMBER = frozenset("0123456789 .-()+")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
#: Length by country of the IBAN registry.
_IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
_IPV4 = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)")
#: Digit groups that single blanks or hyphens join; a card is some groups on end.
_CARDS = re.compile(r"(?<![\d.])\d+(?:[ -]\d+)*")
_GROUP = re.compile(r"\d+")
_USUAL = re.compile(r"\d+|4,4,4,4(?:,[123])?|4,4,4,[123]|4,6,[45]")
_PLAIN = re.compile(r"(?<!\d)\d{16}(?!\d)")
_PHONE = re.compile(r"(?<![\d.\-+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d\-])")
_NATIONAL = re.compile(r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])")
_IBAN = re.compile(r"[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,29}")
#: Words that announce an identifier, by what follows.
_CUES = {
    "account": "account acct a/c acc konto kontonummer cuenta compte",
    "phone": "phone telephone tel call fax mobile cell telefon telefono teléfono téléphone tél handy",
    "national_id": "ssn passport passeport pasaporte reisepass",
}
_BETWEEN = re.compile(r"(?:[ .:#=]|(?:number|num|no|nr|is|me|at|us)\b){0,8}")
_AFTER = {
    "account": re.compile(r"\d(?:[ -]?\d){5,19}(?![\d.,]\d|\w)"), "phone": re.compile(r"\+?\(?\d(?:[ .\-()]{0,2}\d){8,14}(?![.,-]?\d|\w)"), "national_id": re.compile(r"(?:\d{9}|[A-Za-z]{0,2}\d{6,8})(?!\w)"),
}


def _automaton() -> ahocorasick.Automaton:
    """At-signs, schemes and the cues of identifiers: two digits in a row, a digit before a dot, two colons or one before a
    hexadecimal digit, IBAN countries, and words that announce an identifier."""
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("://", ":")
    for i in range(100):
        a.add_word(f"{i:02d}", "0")
    for i in range(10):
        a.add_word(f"{i}.", "0")
        for country in _IBAN_LENGTH:
            for x in {country, country.lower(), country.capitalize()}:
                a.add_word(f"{x}{i}", "I")
    for c in ":0123456789abcdefABCDEF":
        a.add_word(f":{c}", "6")
    for kind, words in _CUES.items():
        for w in words.split():
            for x in {w, w.capitalize(), w.upper()}:
                a.add_word(x, f"{len(x)} {kind}")
    a.make_automaton()
    return a


_AC = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _letter(c: str) -> bool:
    """A letter, digit or accent of a script that sets spaces between words."""
    return c.isascii() and c.isalnum() or "\x7f" < c < "\u2e80" and (c.isalnum() or "\u0300" <= c < "\u0370")


def _email(text: str, at: int) -> tuple[int, int] | None:
    lo, hi = at, at + 1
    while lo and (text[lo - 1] in _LOCAL or _letter(text[lo - 1])):
        lo -= 1
    while lo < at and text[lo] in ".'-%+":
        lo += 1
    while hi < len(text) and (text[hi] in _HOST or _letter(text[hi])):
        hi += 1
    while hi > at + 1 and text[hi - 1] in ".-":
        hi -= 1
    local, labels = text[lo:at], text[at + 1 : hi].split(".")
    if not local or len(local) > 64 or local[-1] == "." or ".." in local or len(labels) < 2 or hi - at > 254:
        return None
    if not all(x and len(x) <= 63 and x[0] != "-" and x[-1] != "-" for x in labels):
        return None
    top = labels[-1]
    return (lo, hi) if len(top) >= 2 and (top.isalpha() or top.lower().startswith("xn--")) else None


def _ipv6(text: str, at: int) -> tuple[int, int] | None:
    """An address of three groups or more with a digit around the colon ``at``."""
    lo = hi = at
    while lo and text[lo - 1] in _HEX:
        lo -= 1
    while hi < len(text) and text[hi] in _HEX:
        hi += 1
    while hi > at and (text[hi - 1] == "." or text[hi - 1] == ":" and text[hi - 2] != ":"):
        hi -= 1
    found = text[lo:hi]
    if not 6 <= hi - lo <= 45 or not _bounded(text, lo, hi) or sum(map(bool, found.split(":"))) < 3 or not any(c in _DIGITS for c in found):
        return None
    try:
        ipaddress.IPv6Address(found)
    except ValueError:
        return None
    return lo, hi


def _announced(text: str, end: int, kind: str, size: int) -> tuple[int, int] | None:
    """What follows the cue that ends before ``end``."""
    if end < len(text) and text[end].isalpha() or end - size and text[end - size - 1].isalnum():
        return None
    start = _BETWEEN.match(text, end).end()
    m = _AFTER[kind].match(text, start) if start > end else None
    return m.span() if m else None


def _login(text: str, at: int) -> tuple[int, int] | None:
    """The user part of scheme://user:password@host; ``at`` is the colon."""
    if not at or text[at - 1] not in _SCHEME:
        return None
    lo = hi = at + 3
    while hi < len(text) and not text[hi].isspace() and text[hi] not in "/?#\"'<>":
        hi += 1
    cut = text.rfind("@", lo, hi)
    return (lo, cut) if cut > lo and cut + 1 < hi else None


def _iban(text: str, at: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, at)
    if not m or (at and text[at - 1].isalnum()):
        return None
    need, hi, got = _IBAN_LENGTH[text[at : at + 2].upper()], at, 0
    while hi < m.end() and got < need:
        got += text[hi] != " "
        hi += 1
    code = text[at:hi].replace(" ", "")
    if code != code.upper() and code != code.lower():
        return None
    if got < need or (hi < len(text) and text[hi].isalnum()):
        return None
    return (at, hi) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def _cards(groups: list[tuple[int, int]], text: str) -> Iterator[tuple[int, int, str]]:
    """Whole groups of 13 to 19 digits in all that pass the Luhn test, from each group on, the longest first. Those spaced as
    cards are go before others, which might else cut them."""
    left = [groups]
    for usual in (True, False):
        rest = []
        for run in left:
            at = start = 0
            while at < len(run):
                digits, last = "", None
                for k in range(at, len(run)):
                    digits += text[slice(*run[k])]
                    if len(digits) > 19:
                        break
                    if len(digits) >= 13 and len(set(digits)) > 1 and (not usual or _USUAL.fullmatch(",".join(str(b - a) for a, b in run[at : k + 1]))) and luhn(digits):
                        last = k
                if last is None:
                    at += 1
                    continue
                yield run[at][0], run[last][1], "card"
                rest.append(run[start:at])
                at = start = last + 1
            rest.append(run[start:])
        left = rest


def _numbers(text: str, lo: int, hi: int) -> Iterator[tuple[int, int, str]]:
    """Identifiers in text[lo:hi], which neither begins nor ends inside a run of digits and number marks."""
    for m in _IPV4.finditer(text, lo, hi):
        if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m.group().split(".")):
            yield m.start(), m.end(), "ipv4"
    for m in _NATIONAL.finditer(text, lo, hi):
        yield m.start(), m.end(), "national_id"
    for m in _CARDS.finditer(text, lo, hi):
        if m.end() - m.start() >= 13:
            yield from _cards([g.span() for g in _GROUP.finditer(text, m.start(), m.end())], text)
    for m in _PLAIN.finditer(text, lo, hi):
        yield m.start(), m.end(), "card" if luhn(m.group()) else "account"
    for m in _PHONE.finditer(text, lo, hi):
        if 7 <= sum(c in _DIGITS for c in m.group()) <= 15:
            yield m.start(), m.end(), "phone"


def find_pii(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in characters, in order and without overlap; of overlapping finds the earlier start, then
    the longer, then the first in the order of KINDS stays."""
    found: list[tuple[int, int, str]] = []
    done = -1
    for end, what in _AC.iter(text):
        if what == "@":
            if span := _email(text, end):
                found.append((*span, "email"))
        elif what == ":":
            if span := _login(text, end - 2):
                found.append((*span, "url_login"))
        elif what == "I":
            if span := _iban(text, end - 2):
                found.append((*span, "iban"))
        elif what == "6":
            if span := _ipv6(text, end):
                found.append((*span, "ipv6"))
        elif what != "0":
            size, _, kind = what.partition(" ")
            if span := _announced(text, end + 1, kind, int(size)):
                found.append((*span, kind))
        elif end > done:
            lo = hi = end
            while lo and text[lo - 1] in _NUMBER:
                lo -= 1
            while hi < len(text) and text[hi] in _NUMBER:
                hi += 1
            done = hi
            if hi - lo >= 7:
                found += [x for x in _numbers(text, lo, hi) if _bounded(text, x[0], x[1])]
    if not found:
        return found
    out: list[tuple[int, int, str]] = []
    for span in sorted(set(found), key=lambda x: (x[0], -x[1], KINDS.index(x[2]))):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _bounded(text: str, lo: int, hi: int) -> bool:
    """Not part of a longer word."""
    return not (lo and (text[lo - 1].isalnum() or text[lo - 1] == "_")) and not (hi < len(text) and (text[hi].isalnum() or text[hi] == "_"))


def mask(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for lo, hi, kind in spans:
        out += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch], name: str = "spans") -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for lo in range(0, whole.num_rows, 1000):
            batch = whole.slice(lo, 1000)
            texts = batch.column("text").to_pylist()
            spans = [None if t is None else find_pii(t) for t in texts]
            masked = [t if not s else mask(t, s) for t, s in zip(texts, spans)]
            sizes = np.array([len(s) if s else 0 for s in spans])
            flat = [x for s in spans if s for x in s]
            items = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int32()), pa.array([x[2] for x in flat], pa.string())], fields=list(_SPANS.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), items, mask=pa.array([s is None for s in spans], pa.bool_()))
            rest = [batch.column(i) for i in range(batch.num_columns)]
            names = batch.schema.names
            yield pa.record_batch([pa.array(masked, pa.string()) if n == "text" else c for n, c in zip(names, rest)] + [lists], names=[*names, name])


def scan_pii(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, spans)``: every text with its personal data masked, and what was found where.

    ``spans`` holds ``start`` and ``end`` in characters of the original text and a ``kind`` of KINDS; each is masked as
    ``[KIND]``. Found are e-mail addresses, also with letters beyond ASCII of scripts that set spaces, user names in URLs,
    IPv4 and IPv6 addresses, phone numbers, payment cards (Luhn), other 16-digit account numbers, IBANs (mod 97) in either
    case, national ids, and numbers that a word such as "account", "call" or "ssn" announces. Anchors are searched in one
    pass of an Aho-Corasick automaton, so texts without anchors cost no more than that; there is no shuffle.

    Row for row: null ids and repeated rows are kept. A null text stays null with null ``spans``; an empty text has no
    spans. Texts of any length are read whole. Other columns are ignored. An empty table gives an empty result.
    """
    return id_text(docs).mapInArrow(_scan, "doc_id long, text string, spans array<struct<start:int,end:int,kind:string>>")


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` set to the new length where something was masked;
    all columns and rows are kept. Otherwise as :func:`scan_pii`."""
    spans = unused(docs, "spans")
    schema = docs.select(*docs.columns, F.lit(None).cast("array<struct<start:int,end:int,kind:string>>").alias(spans)).schema
    out = docs.mapInArrow(lambda batches: _scan(batches, spans), schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
