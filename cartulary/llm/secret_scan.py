"""Operator 2, secret scans: a worklist that unwraps encoded layers until nothing new appears, rescanning each layer.

A layer is a text with, for each of its characters, the span in the original text that it came from. The worklist starts with
the document itself. From each layer it takes

* URL runs: whitespace-free runs holding ``%XX``, unquoted;
* Unicode runs: ``\\uXXXX``, ``\\xXX`` and ``&#N;`` escapes, replaced in their whitespace-free run;
* base64 runs of 16 or more characters (standard or URL alphabet), also wrapped over lines of one length or glued to a path before them, whose
  bytes are UTF-8 or UTF-16 text or a gzip, zlib, raw deflate, bzip2 or xz stream, which is inflated in turn.

A decoded layer joins the worklist unless a layer with the same text and the same source span was seen before (cycle detection);
so the loop ends at the fixpoint: every step is recorded once and each decoding shortens its run. Every layer is scanned
with the same rules. A hit in a decoded layer is mapped to the original span of its characters; for base64 and
compressed layers that is the whole encoded run (of a glued run, what is decoded of it). Spans are code points, end exclusive.

Rules (``kind``): assign, access, hex, leftmost and non-overlapping each. A hit in a decoded layer is named
``<layers>.<kind>``, for example ``base64.assign`` or ``url.base64.hex``. Inflating stops with an error at ``max_layer``
bytes for one layer: a guard against decompression bombs that skips that layer only and is counted in ``n_refused``.

Nulls and edges: a null text counts as empty and gives zero counts and empty strings; repeated rows give repeated results; a null
doc_id is returned as null; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import codecs
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from cartulary.llm.batches import map_rows, map_texts, no_tables

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
URL_RUN = re.compile(r"[^\s\"'<>]+")
URL_UNIT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPED_RUN = re.compile(r"\S+")
ESCAPE_UNIT = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Begins only where a run begins and gives nothing back, so that a run without line breaks is read once.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+(?:\r?\n[A-Za-z0-9+/_-]++)++={0,2}")
GLUE = re.compile(r"[/_-]")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
LEAST_RUN = 16
MAX_LAYER = 64 << 20


def scan(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the rules' hits, in the order of start, then kind."""
    found = []
    lower = text.lower()
    if any(h in lower for h in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    found.sort()
    return found


def _utf8(raw: bytes) -> tuple[str, list[tuple[int, int]]]:
    """The bytes as text, each part that isn't UTF-8 as one U+FFFD, and those parts' (start, end)."""
    bad: list[tuple[int, int]] = []

    def note(error: UnicodeDecodeError) -> tuple[str, int]:
        bad.append((error.start, error.end))
        return "\ufffd", error.end

    codecs.register_error("cartulary.note", note)
    return raw.decode("utf-8", "cartulary.note"), bad


def _byte_starts(text: str, bad: list[tuple[int, int]]) -> list[int]:
    """The byte that each character of such a text begins at."""
    starts, pos, k = [], 0, 0
    for ch in text:
        starts.append(pos)
        if k < len(bad) and bad[k][0] == pos:
            pos, k = bad[k][1], k + 1
        else:
            pos += len(ch.encode())
    return starts


def _replaced(run: str, units: re.Pattern, made: Callable[[str], tuple[str, list[int]]]) -> tuple[str, list[int]]:
    """The run with its units decoded, and for each new character its start in the run, with the end appended.

    made gives a unit's text and the place in the unit that each of its characters begins at.
    """
    out, at, last = [], [], 0
    for m in units.finditer(run):
        out.append(run[last : m.start()])
        at.extend(range(last, m.start()))
        text, starts = made(m[0])
        out.append(text)
        at.extend(m.start() + x for x in starts)
        last = m.end()
    out.append(run[last:])
    at.extend(range(last, len(run) + 1))
    return "".join(out), at


def _quoted_unit(unit: str) -> tuple[str, list[int]]:
    text, bad = _utf8(bytes.fromhex(unit.replace("%", "")))
    return text, [3 * x for x in _byte_starts(text, bad)]


def _escaped_unit(unit: str) -> tuple[str, list[int]]:
    if unit.startswith("&"):
        text = html.unescape(unit)
        return text, [0] * len(text)
    if unit.startswith("\\x"):
        raw = bytes.fromhex(unit.replace("\\x", ""))
        text, bad = _utf8(raw)
        if bad:  # no UTF-8: one character a byte
            return raw.decode("latin-1"), list(range(0, len(unit), 4))
        return text, [4 * x for x in _byte_starts(text, bad)]
    text = b"".join(int(x, 16).to_bytes(2, "big") for x in unit.split("\\u")[1:]).decode("utf-16-be", "surrogatepass")
    starts, pos = [], 0
    for ch in text:
        starts.append(pos)
        pos += 12 if ord(ch) > 0xFFFF else 6
    return text, starts


def _unquoted(run: str) -> tuple[str, list[int]]:
    return _replaced(run, URL_UNIT, _quoted_unit)


def _unescaped(run: str) -> tuple[str, list[int]]:
    return _replaced(run, ESCAPE_UNIT, _escaped_unit)


#: Name, what its units begin with, the runs they may stand in, its units, the decoder of a run.
ENCODINGS = (("url", ("%",), URL_RUN, URL_UNIT, _unquoted), ("unicode", ("\\u", "\\x", "&#"), ESCAPED_RUN, ESCAPE_UNIT, _unescaped))


def _format(raw: bytes) -> str | None:
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if len(raw) > 2 and raw[0] & 0x0F == 8 and raw[0] >> 4 < 8 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return "zlib"
    return "bzip2" if raw[:3] == b"BZh" else "xz" if raw[:6] == b"\xfd7zXZ\x00" else None


def _stream(name: str):
    if name == "bzip2":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(memlimit=256 << 20) if name == "xz" else zlib.decompressobj(-15 if name == "deflate" else 47)


def _inflate(raw: bytes, name: str, limit: int) -> bytes | None:
    """The bytes of a whole stream, of all its members where they follow one another; None if it is none. OverflowError beyond the limit."""
    out, size = [], 0
    while raw:
        stream = _stream(name)
        try:
            part = stream.decompress(raw, limit + 1 - size)
        except (zlib.error, lzma.LZMAError, OSError, EOFError):
            part = None
        if part is None or (not stream.eof and size + len(part) <= limit):
            return b"".join(out) if out else None
        out.append(part)
        size += len(part)
        if size > limit:
            raise OverflowError
        raw = stream.unused_data
        if raw and (name == "deflate" or _format(raw) != name):
            return None if name == "deflate" else b"".join(out)
    return b"".join(out)


def _readable(raw: bytes) -> str | None:
    codec = "utf-8"
    if b"\0" in raw:
        codec = next((c for c, k in (("utf-16-le", 1), ("utf-16-be", 0)) if 2 * raw[k::2].count(0) > len(raw) // 2), "utf-8")
    try:
        text = raw.decode(codec)
    except UnicodeDecodeError:
        return None
    return text if text and not CONTROL.search(text) else None


def _opened(data: bytes, limit: int) -> tuple[str, str] | None:
    """(names of the layers, text) of a base64 run's bytes."""
    name = "base64"
    while kind := _format(data):
        more = _inflate(data, kind, limit)
        if more is None:
            break
        name, data = f"{name}.{kind}", more
    text = _readable(data)
    if text is None and name == "base64" and (more := _inflate(data, "deflate", limit)):
        name, text = "base64.deflate", _readable(more)
    return (name, text) if text is not None else None


def _decoded(body: str) -> bytes:
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _glued(body: str, limit: int) -> tuple[str, str, int] | None:
    """(names, text, start) of what a run holds behind one of its separators. Each of the four alignments is decoded once."""
    starts = [m.end() for m in GLUE.finditer(body) if len(body) - m.end() >= LEAST_RUN]
    plain = body.replace("-", "+").replace("_", "/")
    for shift in range(4):
        own = [p for p in starts if p % 4 == shift]
        if not own:
            continue
        raw = _decoded(plain[shift:])
        text, bad = _utf8(raw)
        # all behind these bytes is text
        clean = max(bad[-1][1] if bad else 0, max((m.end() for m in re.finditer(rb"[\x00-\x08\x0e-\x1f\x7f]", raw)), default=0))
        for p in own:
            data = raw[(off := (p - shift) // 4 * 3) : off + 6]
            if off >= clean or _format(data):
                got = _opened(raw[off:], limit)
                if got and (off >= clean or "." in got[0]):
                    return *got, p
    return None


def _from_base64(run: str, limit: int) -> tuple[str, str, int] | None:
    """(names of the layers, text, its start in the run) behind a base64 run."""
    body = run.rstrip("=")
    try:
        got = _opened(_decoded(body.replace("-", "+").replace("_", "/")), limit)
        return (*got, 0) if got else _glued(body, limit)
    except binascii.Error:
        return None


def _joined(block: str) -> tuple[str, int] | None:
    """A wrapped run in one line, and how much of the block it is: lines as long as the first, then a shorter one or none."""
    end, parts = 0, []
    for m in re.finditer(r"[^\r\n]+", block):
        line = m[0]
        if parts and len(line) > len(parts[0]):
            break
        parts.append(line)
        end = m.end()
        if len(line) < len(parts[0]) or "=" in line:
            break
    return ("".join(parts), end) if len(parts) > 1 else None


def _base64_runs(layer: str, limit: int):
    """(start, end, names, text) of the layer's base64 runs; None for one that is too large."""
    taken = []
    for m in WRAPPED.finditer(layer):
        if whole := _joined(m[0]):
            try:
                if got := _from_base64(whole[0], limit):
                    if not got[2]:
                        taken.append((m.start(), m.start() + whole[1]))
                        yield *taken[-1], got[0], got[1]
            except OverflowError:
                yield None
    k = 0
    for m in BASE64.finditer(layer):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] <= m.start():
            continue
        try:
            if got := _from_base64(m[0], limit):
                yield m.start() + got[2], m.end(), got[0], got[1]
        except OverflowError:
            yield None


def unwrap(text: str, limit: int = MAX_LAYER) -> tuple[list[tuple[int, str, int]], int, int]:
    """(start, name, end) of all hits, base ones included; the number of decoded layers; the number of layers refused."""
    hits: dict[tuple[int, str, int], None] = {(s, KINDS[k], e): None for s, k, e in scan(text)}
    seen: set[tuple[int, int, bytes]] = set()
    layers = refused = 0
    # a layer: text, its starts in the original (None: the same; an int pair: the one span it all came from), the names so far
    work: list[tuple[str, object, str]] = [(text, None, "")]
    while work:
        layer, origin, name = work.pop()

        def place(start: int, end: int, origin=origin) -> tuple[int, int]:
            if origin is None:
                return start, end
            if isinstance(origin, tuple):
                return origin
            return origin[start], max(origin[end], origin[start] + 1)

        found: list[tuple[str, object, str]] = []
        for kind, signs, run, unit, decode in ENCODINGS:
            if not any(x in layer for x in signs) or not unit.search(layer):
                continue
            for m in run.finditer(layer):
                if unit.search(m[0]):
                    made, at = decode(m[0])
                    found.append((made, origin if isinstance(origin, tuple) else [place(m.start() + i, m.start() + i)[0] for i in at], kind))
        for got in _base64_runs(layer, limit):
            if got is None:
                refused += 1
            else:
                found.append((got[3], place(got[0], got[1]), got[2]))
        for made, where, kind in found:
            lo, hi = where if isinstance(where, tuple) else (where[0], where[-1])
            mark = (lo, hi, hashlib.blake2b(made.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            if mark in seen or made == layer:
                continue
            seen.add(mark)
            layers += 1
            full = f"{name}.{kind}" if name else kind
            for s, k, e in scan(made):
                lo, hi = where if isinstance(where, tuple) else (where[s], max(where[e], where[s] + 1))
                hits.setdefault((lo, f"{full}.{KINDS[k]}", hi))
            work.append((made, where, full))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(hits, key=lambda h: (h[0], order.get(h[1], 9), h[1], h[2])), layers, refused


def _digest(text: str | None, limit: int) -> tuple:
    hits, layers, refused = unwrap(text or "", limit)
    base = [h for h in hits if h[1] in KINDS]
    line = lambda rows: ",".join(f"{k}:{s}:{e}" for s, k, e in rows)
    counts = [sum(h[1] == k for h in base) for k in KINDS]
    return (*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(hits), layers, refused)


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_layer: int = MAX_LAYER) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_layers, n_refused."""
    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long, n_refused long"

    def make():
        no_tables()
        return lambda texts: list(zip(*[_digest(t, max_layer) for t in texts])) if texts else [[] for _ in range(7)]

    return map_texts(docs, make, schema, id_col, text_col)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


MASK = "[secret]"


def masked(text: str | None) -> str | None:
    """The text with each found span replaced by MASK; overlapping spans are joined first."""
    if not text:
        return text
    out, at = [], 0
    end = -1
    for s, _, e in unwrap(text)[0]:
        if s < end:
            if e > end:
                at = end = e
            continue
        out += [text[at:s], MASK]
        at = end = e
    return "".join([*out, text[at:]]) if out else text


def mask_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of docs, secrets masked in its text and n_chars counted again."""
    def make():
        no_tables()
        return lambda texts: [[masked(t) for t in texts]]

    done, names = map_rows(docs, make, "new string", "text")
    new = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return done.select(*[new.get(c, F.col(n)).alias(n) for c, n in zip(docs.columns, names, strict=True)]).toDF(*docs.columns)
