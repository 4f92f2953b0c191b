"""Secret scans with recursive decoding."""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessergraph.llm.common import id_text

#: name, cues of which one must occur (in lower case), pattern, group of the secret, least entropy in bits a character
RULES = [
    ("aws_access_key", ("akia", "asia"), re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])"), 0, 2.5),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"(?<![0-9A-Za-z])gh[pousr]_[A-Za-z0-9]{36,}"), 0, 3.0),
    ("slack_token", ("xox",), re.compile(r"(?<![0-9A-Za-z])xox[abeoprs]-[0-9A-Za-z-]{10,}"), 0, 2.5),
    ("google_api_key", ("aiza",), re.compile(r"(?<![0-9A-Za-z_-])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), 0, 3.0),
    ("stripe_key", ("k_live_",), re.compile(r"(?<![0-9A-Za-z])[rs]k_live_[0-9A-Za-z]{24,}"), 0, 3.0),
    ("jwt", ("eyj",), re.compile(r"(?<![0-9A-Za-z_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 3.0),
    ("private_key", ("private key",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"), 0, 0.0),
    (
        "assigned_secret",
        ("token", "secret", "passw", "api_key", "apikey", "api-key", "access_key", "auth_key"),
        re.compile(r"(?i)(?:token|secret(?:[_-]?key)?|passw(?:or)?d|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?\s{0,3}(?:[:=]|=>|:=)\s{0,3}[\"']?([A-Za-z0-9_\-+/=.~!@$^&*]{12,})"),
        1,
        2.8,
    ),
]
_STOP = re.compile(r"[^\s\"'<>]+")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}={0,2}")
#: Base64 over several lines, as base64 and MIME wrap it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}(?:[ \t]*\r?\n[ \t>]*[A-Za-z0-9+/_\-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_\-]+")
_HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Za-z])")
_CODED = re.compile(r"%[0-9A-Fa-f]{2}|\\[uxU]|&[#A-Za-z]|[A-Za-z0-9+/_\-]{16}")
_STRAY = re.compile("[\udc80-\udcff]")
#: First bytes of packed data that may lie anywhere; zlib's are too common for that and count at the start of a part only.
_PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: Unpacked data are read on in pieces of about this size, which end between encoded parts and overlap.
PIECE, OVERLAP = 16 << 20, 4096
_BETWEEN = re.compile(rb"[^A-Za-z0-9+/_\-=%\\&;#{}\s]")


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) if s else 0.0


class Layer:
    """A text and, for each of its characters, the span of the document that it came from; one span for all of it if ``lo``
    is a number."""

    def __init__(self, text: str, lo, hi, path: tuple[str, ...]):
        self.text, self.lo, self.hi, self.path = text, lo, hi, path

    def span(self, start: int, end: int) -> tuple[int, int]:
        if isinstance(self.lo, int):
            return self.lo, self.hi
        if isinstance(self.lo, range):
            return start, end
        return min(self.lo[start:end]), max(self.hi[start:end])


def _useful(text: str) -> bool:
    low = text.lower()
    return _CODED.search(text) is not None or any(c in low for _, cues, *_ in RULES for c in cues)


def _readings(raw: bytes) -> Iterator[tuple[str, list[int]]]:
    """Readings of bytes, and each character's first byte with the end of the last: UTF-8, where a stray byte is one character,
    and with NULs UTF-16, at even and odd places, which reads ASCII of either byte order. Those in which nothing could be
    found or decoded are left out."""
    text = raw.decode("utf-8", "surrogateescape")
    if _useful(text):
        sizes = np.array([1], np.int64).repeat(len(text)) if len(text) == len(raw) else np.array([len(c.encode("utf-8", "surrogateescape")) for c in text])
        yield _STRAY.sub("\ufffd", text), [0, *np.cumsum(sizes).tolist()]
    for odd in (0, 1) if b"\0" in raw else ():
        units = np.frombuffer(raw, "<u2", (len(raw) - odd) // 2, odd)
        text = np.where((units >= 0xD800) & (units < 0xE000), 0xFFFD, units).astype("<u4").tobytes().decode("utf-32-le")
        if _useful(text):
            yield text, list(range(odd, odd + 2 * len(units) + 1, 2))


def _from_bytes(raw: bytes, lo, hi, path: tuple[str, ...]) -> Iterator[Layer]:
    """Layers of bytes, each with its span or all with one: what they read as, and what packed data in them hold."""
    for text, at in _readings(raw):
        if isinstance(lo, int):
            yield Layer(text, lo, hi, path)
        else:
            yield Layer(text, [lo[a] for a in at[:-1]], [hi[b - 1] for b in at[1:]], path)
    starts = [m.start() for m in _PACKED.finditer(raw)]
    if raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2], "big") % 31 == 0:
        starts.insert(0, 0)
    for start in starts:
        span = (lo, hi) if isinstance(lo, int) else (min(lo[start:]), max(hi[start:]))
        name = {0x1F: "gzip", 0x42: "bz2", 0xFD: "xz", 0x28: "zstd", 0x78: "zlib"}[raw[start]]
        for piece in _pieces(_unpacked(name, raw[start:])):
            yield from _from_bytes(piece, *span, (*path, name))


def _unpacked(name: str, raw: bytes) -> Iterator[bytes]:
    """The content in parts of bounded size, as far as it can be unpacked, of all members that follow on each other."""
    make = {"gzip": lambda: zlib.decompressobj(31), "zlib": lambda: zlib.decompressobj(15), "bz2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}[name]
    while raw:
        d = make()
        try:
            if name == "zstd":
                for i in range(0, len(raw), 1 << 12):
                    yield d.decompress(raw[i : i + (1 << 12)])
                    if d.eof:
                        raw = d.unused_data + raw[i + (1 << 12) :]
                        break
                else:
                    return
            else:
                rest = raw
                while not d.eof:
                    out = d.decompress(rest, PIECE)
                    rest = d.unconsumed_tail if name in ("gzip", "zlib") else b""
                    if not out and not rest:
                        break
                    yield out
                if not d.eof:
                    return
                raw = d.unused_data
        except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError):
            return


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The same bytes in pieces that end where no encoded part can be, each with the end of the one before."""
    held, tail = [], b""
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= PIECE:
            last = held[-1]
            cut = max((m.end() for m in _BETWEEN.finditer(last, max(0, len(last) - 65536))), default=0) or max((m.end() for m in _BETWEEN.finditer(last)), default=0)
            if cut:
                whole = tail + b"".join(held[:-1]) + last[:cut]
                yield whole
                held, tail = [last[cut:]], whole[-OVERLAP:]
    whole = b"".join(held)
    if whole:
        yield tail + whole


def _percent(layer: Layer) -> Iterator[Layer]:
    """Unspaced runs with percent codes, decoded bytewise; and packed data in a run of codes."""
    for m in _STOP.finditer(layer.text):
        if "%" not in m.group() or not (codes := [c.span() for c in _PERCENT.finditer(layer.text, m.start(), m.end())]):
            continue
        out, lo, hi, at, heads = [], [], [], m.start(), []
        for start, end in [*codes, (m.end(), m.end())]:
            for i in range(at, start):
                b = layer.text[i].encode("utf-8", "surrogatepass")
                out.append(b)
                x, y = layer.span(i, i + 1)
                lo += [x] * len(b)
                hi += [y] * len(b)
            for i in range(start, end, 3):
                out.append(bytes([int(layer.text[i + 1 : i + 3], 16)]))
                x, y = layer.span(i, i + 3)
                lo.append(x), hi.append(y)
            bare = start > m.start() and layer.text[start - 1] == "x"
            if bare or layer.text[start : start + 3] == "%78":
                heads.append(len(lo) - (end - start) // 3 - bare)
            at = end
        raw, path = b"".join(out), (*layer.path, "url")
        yield from _from_bytes(raw, lo, hi, path)
        for head in heads:
            if int.from_bytes(raw[head : head + 2], "big") % 31 == 0 and raw[head + 1 : head + 2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
                for piece in _pieces(_unpacked("zlib", raw[head:])):
                    yield from _from_bytes(piece, min(lo[head:]), max(hi[head:]), (*path, "zlib"))


def _replaced(layer: Layer, codes: re.Pattern, decode, name: str, mark: str) -> Iterator[Layer]:
    """Unspaced runs with codes for characters, decoded; and packed data, if all of the run's characters are bytes."""
    for m in _STOP.finditer(layer.text):
        if mark not in m.group():
            continue
        out, lo, hi, at = [], [], [], m.start()
        for e in [*codes.finditer(layer.text, m.start(), m.end()), None]:
            stop = e.start() if e else m.end()
            for i in range(at, stop):
                x, y = layer.span(i, i + 1)
                out.append(layer.text[i]), lo.append(x), hi.append(y)
            if e:
                x, y = layer.span(e.start(), e.end())
                for c in decode(e):
                    out.append(c), lo.append(x), hi.append(y)
                at = e.end()
        if at > m.start() or len(out) != m.end() - m.start():
            text = "".join(out)
            yield Layer(text, lo, hi, (*layer.path, name))
            # Codes of bytes may spell UTF-16 or packed data.
            if max(map(ord, text)) < 256 and ("\0" in text or _PACKED.search(text.encode("latin-1"))):
                yield from _from_bytes(text.encode("latin-1"), lo, hi, (*layer.path, name))


def _escape(m: re.Match) -> str:
    code = int(next(g for g in m.groups() if g), 16)
    return chr(0xFFFD if code > 0x10FFFF or 0xD800 <= code < 0xE000 else code)


def _runs(text: str) -> Iterator[list[int] | range]:
    """Places of the characters of each run of base64: on one line, from the start or from after a mark that base64 and paths
    share; and over the lines of a wrapped block, also without the lines before the first two of equal length."""
    for m in _BASE64.finditer(text):
        end = m.start() + len(m.group().rstrip("="))
        yield range(m.start(), end)
        done = {m.start() % 4}
        for cut in re.finditer(r"[/_+\-]", m.group()):
            start = m.start() + cut.end()
            # A later start at the same place within four decodes to the end of what an earlier one does.
            if end - start >= 16 and start % 4 not in done and _plain(text[start : start + 64]):
                done.add(start % 4)
                yield range(start, end)
            if len(done) == 4:
                break
    for m in _WRAPPED.finditer(text):
        lines = [x.span() for x in _LINE.finditer(text, m.start(), m.end())]
        even = next((i for i in range(len(lines) - 1) if lines[i][1] - lines[i][0] == lines[i + 1][1] - lines[i + 1][0]), max(0, len(lines) - 2))
        for first in {0, even}:
            yield [i for a, b in lines[first:] for i in range(a, b)]


def _plain(start: str) -> bool:
    """Whether base64 seems to start here: it gives readable or packed data."""
    raw = _decoded(start[: len(start) // 4 * 4]) or b""
    return bool(_PACKED.match(raw)) or raw[:1] == b"\x78" or sum(32 <= b < 127 or b in b"\t\r\n" for b in raw.replace(b"\0", b"")) >= 0.8 * len(raw.replace(b"\0", b"")) > 0


def _decoded(body: str) -> bytes | None:
    body = body[:-1] if len(body) % 4 == 1 else body
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except binascii.Error:
        return None


def _base64(layer: Layer) -> Iterator[Layer]:
    for at in _runs(layer.text):
        raw = _decoded(layer.text[at.start : at.stop] if isinstance(at, range) else "".join(map(layer.text.__getitem__, at)))
        if not raw or not (_PACKED.search(raw) or raw[0] == 0x78 or next(_readings(raw), None)):
            continue
        path = (*layer.path, "base64")
        if isinstance(layer.lo, int):
            yield from _from_bytes(raw, layer.lo, layer.hi, path)
        else:
            # Byte i is spread over the characters from 4i/3, rounded down, to 4(i+1)/3, rounded up.
            spans = [layer.span(at[4 * i // 3], at[min(len(at), -(-4 * (i + 1) // 3)) - 1] + 1) for i in range(len(raw))]
            yield from _from_bytes(raw, [a for a, _ in spans], [b for _, b in spans], path)


def _hex(layer: Layer) -> Iterator[Layer]:
    for m in _HEX.finditer(layer.text):
        raw = bytes.fromhex(m.group())
        spans = [layer.span(m.start() + 2 * i, m.start() + 2 * i + 2) for i in range(len(raw))]
        yield from _from_bytes(raw, [a for a, _ in spans], [b for _, b in spans], (*layer.path, "hex"))


def _children(layer: Layer) -> Iterator[Layer]:
    text = layer.text
    if "%" in text:
        yield from _percent(layer)
    if "\\" in text:
        yield from _replaced(layer, _ESCAPE, _escape, "unicode", "\\")
    if "&" in text:
        yield from _replaced(layer, _ENTITY, lambda m: html.unescape(m.group()), "html", "&")
    yield from _base64(layer)
    yield from _hex(layer)


def find_secrets(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, rule, path, secret) of each secret in the text and in everything encoded in it.

    A worklist holds the layers still to read. Reading one scans it, whatever bytes it has, and adds what its URL codes,
    escapes, entities, base64 and hexadecimal parts decode to, and what those hold in gzip, zlib, bz2, xz or zstd; a part
    that was decoded before at the same place is not read again, so the list runs empty even if decoding gives back its
    input. Nothing limits how deep or how large a layer is: packed data are read in pieces. A secret found in several layers
    of one place counts once, with the shortest path.
    """
    found: dict[tuple[str, str], list[tuple[int, int, str]]] = {}
    seen: set[tuple] = set()
    work: list[Iterator[Layer]] = [iter([Layer(text, range(len(text)), range(1, len(text) + 1), ())])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        if layer.path:
            start = layer.lo if isinstance(layer.lo, int) else layer.lo[0]
            mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), start)
            if mark in seen:
                continue
            seen.add(mark)
        low = layer.text.lower()
        for rule, cues, pattern, group, bits in RULES:
            if any(c in low for c in cues):
                for m in pattern.finditer(layer.text):
                    secret = m.group(group)
                    if entropy(secret) >= bits:
                        _note(found.setdefault((rule, secret), []), (*layer.span(m.start(group), m.end(group)), ">".join(layer.path)))
        work.append(_children(layer))
    return sorted((a, b, rule, path, secret) for (rule, secret), hits in found.items() for a, b, path in hits)


def _note(hits: list[tuple[int, int, str]], new: tuple[int, int, str]) -> None:
    """Add a place, unless it overlaps one; of those the one with the fewest decodings stays."""
    steps = lambda path: len(path.split(">")) if path else 0
    for i, (a, b, path) in enumerate(hits):
        if a < new[1] and new[0] < b:
            if (steps(new[2]), new[2]) < (steps(path), path):
                hits[i] = new
            return
    hits.append(new)


_FIELDS = [("doc_id", pa.int64()), ("rule", pa.string()), ("path", pa.string()), ("depth", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("sha256", pa.string())]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for a, b, rule, path, secret in find_secrets(text) if text else ():
                rows.append((i, rule, path, len(path.split(">")) if path else 0, a, b, hashlib.sha256(secret.encode("utf-8", "surrogatepass")).hexdigest()))
        cols = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
        ids = batch.column("doc_id").take(pa.array(cols[0], pa.int64()))
        yield pa.record_batch([ids, *(pa.array(list(c), t) for c, (_, t) in zip(cols[1:], _FIELDS[1:]))], names=[n for n, _ in _FIELDS])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, rule, path, depth, start, end, sha256)``: one row for each secret of each document.

    ``path`` names the decodings that laid it bare, outermost first and joined by ``>``, ``depth`` their number;
    ``start`` and ``end`` are the characters of the document's own text that hold it (for compressed parts, all of
    the part). The secret itself is not returned, only its hash. See :func:`find_secrets`.

    No shuffle. Null ids are kept and repeated rows give repeated results. Null and empty texts have no secrets.
    Texts and layers of any length are read whole, in time that grows in proportion. Other columns are ignored. An empty
    table gives an empty result.
    """
    return id_text(docs).mapInArrow(_scan, "doc_id long, rule string, path string, depth int, start int, end int, sha256 string")
