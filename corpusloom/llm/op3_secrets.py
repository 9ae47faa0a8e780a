"""Secret scans over texts and everything that is encoded in them.

A worklist starts with the text. Each layer is scanned, then unwrapped: escapes (percent, Unicode, HTML) all over it,
base64 stretches, wrapped over lines or not, at each of the four alignments, and hex digits at both, so that what is
glued to them does no harm, and gzip or zlib streams, at any place of any layer and member by member. What comes out is a
new layer, with a map from its bytes to those of the text, and goes on the worklist unless the same content was unwrapped
on the way to it (a cycle) or from the same place before. The list runs until nothing is left. The work is a constant
times the text for each level, levels of base64 shrink by a quarter and levels of hex by half.
"""

from __future__ import annotations

import binascii
import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import string_parts, text_of

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: A secret has so many bytes at least, all of them ASCII; base64 of that has LEAST_BASE64, hex twice as many.
LEAST_SECRET, LEAST_BASE64 = 12, 16
#: Against bombs: bytes that the compressed streams of one text may unfold to, all together; what is over is not scanned.
MOST_UNFOLDED = 64 << 20
#: Levels of escapes are each scanned: LEVELS of them as whole layers, then what changes around the escapes, as long as that
#: comes to LEVEL_BYTES a text. What is nested more deeply than that is undone at once.
LEVELS, LEVEL_BYTES = 16, 8 << 20
#: Bytes of a stream that must unfold to something, then bytes at a time; how often in all the bytes around false starts are read.
_PROBE, _FEED, _REREAD = 1 << 10, 1 << 16, 64

_ESCAPE = re.compile(rb"%[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|amp|lt|gt|quot|apos);")
_LAST_ESCAPE = re.compile(_ESCAPE.pattern + rb"\Z")
_LONGEST_ESCAPE = 10
_BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{16,}")
_WRAPPED = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++")
_LINE = re.compile(rb"[A-Za-z0-9+/_-]+")
_HEX_DIGITS = re.compile(rb"[0-9A-Fa-f]{24,}")
#: Bytes that no secret, escape, base64 or hex has in it, wrapped or not.
_APART = ~np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-\"': %\\&#;\r\n\t"))
_BASE64_URL = bytes.maketrans(b"-_", b"+/")
_PLAIN = re.compile(rb"[\x09\x0A\x0D\x20-\x7E]{12,}")
#: The start of a gzip stream, or one of the heads of a zlib stream (deflate, no dictionary, check bits that fit).
_STREAM = re.compile(b"|".join([rb"\x1f\x8b\x08", *(re.escape(bytes([c, f])) for c in range(0x08, 0x80, 0x10) for f in range(256) if (c << 8 | f) % 31 == 0 and not f & 0x20)]), re.S)


def base_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes: leftmost matches of each kind that do not overlap, those too short left out."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6] if b"=" in data or b":" in data else []
    if b"AKIA" in data:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    return sorted(out)


class _Layer:
    """A decoded content; byte k of it comes from the bytes first[k] to end[k] of the text. Both never fall."""

    def __init__(self, data: bytes, first: np.ndarray, end: np.ndarray, chain: frozenset[bytes], level: int = 0):
        self.data, self.first, self.end, self.chain, self.level = data, first, end, chain, level

    def source(self, lo: int, hi: int) -> tuple[int, int]:
        """The stretch of the text that bytes lo to hi come from."""
        return int(self.first[lo]), int(self.end[hi - 1])


def _character(escape: bytes) -> bytes:
    """What an escape stands for; empty: nothing that can be said alone."""
    if escape[:1] == b"%" or escape[:2] == b"\\x":
        return bytes([int(escape[-2:], 16)])
    if escape[:1] == b"\\":
        code = int(escape[2:], 16)
        return b"" if 0xD800 <= code < 0xE000 else chr(code).encode()
    return html.unescape(escape.decode()).encode("utf-8", "ignore")


def _once(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray] | None:
    """Each escape undone once: (content, first byte, last byte) of each byte; None where there is no escape."""
    out, first, last, at = [], [], [], 0
    half = None
    for m in _ESCAPE.finditer(data):
        lo, hi = m.span()
        new = _character(m.group())
        if not new:
            # two halves of a pair of surrogates are one character
            code = int(m.group()[2:], 16) if hi - lo == 6 else 0
            if 0xD800 <= code < 0xDC00:
                half = (code, lo, hi)
                continue
            if not 0xDC00 <= code < 0xE000 or half is None or half[2] != lo:
                continue
            new, lo = chr(0x10000 + ((half[0] - 0xD800) << 10) + code - 0xDC00).encode(), half[1]
        out += [data[at:lo], new]
        first += [np.arange(at, lo), np.full(len(new), lo)]
        last += [np.arange(at, lo), np.full(len(new), hi - 1)]
        at = hi
    if not out:
        return None
    out.append(data[at:])
    rest = np.arange(at, len(data))
    return b"".join(out), np.concatenate([*first, rest]), np.concatenate([*last, rest])


def _around_escapes(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The parts of a content, between bytes that keep them apart, with something that was an escape; the others are as they
    were. All of it where a stream may run over such bytes."""
    if _STREAM.search(data):
        return data, first, last
    chars = np.frombuffer(data, np.uint8)
    apart, new = _APART[chars], first != last
    part = np.cumsum(apart) - apart
    wanted = np.zeros(int(part[-1]) + 2, bool)
    wanted[part[new]] = True
    wanted[part[new & apart] + 1] = True
    keep = wanted[part]
    return chars[keep].tobytes(), first[keep], last[keep]


def _all_levels(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Escapes undone until none is left, in one pass: what an escape stands for goes back before what is still to be read,
    and an escape may also be completed by what was read last."""
    back: list[tuple[int, int, int]] = []
    out, first, last, at = bytearray(), [], [], 0
    while back or at < len(data):
        if back:
            c, s, e = back.pop()
        else:
            c, s, e = data[at], at, at
            at += 1
        out.append(c)
        first.append(s)
        last.append(e)
        m = _LAST_ESCAPE.search(bytes(out[-_LONGEST_ESCAPE:]))
        if m and (new := _character(m.group())):
            n = len(m.group())
            s, e = first[-n], last[-1]
            del out[-n:], first[-n:], last[-n:]
            back += [(x, s, e) for x in reversed(new)]
    return bytes(out), np.array(first, np.int64), np.array(last, np.int64)


def _inflated(data: bytes, at: int, most: int) -> tuple[bytes, int, bool] | None:
    """The content of the gzip or zlib stream at a place, all members of it, the place after it, and whether its first
    member ends there with the right checksum."""
    view, out, size, done, whole = memoryview(data), [], 0, at, False
    while done == at or data[done : done + 3] == b"\x1f\x8b\x08":
        unfold, place, got, feed = zlib.decompressobj(47), done, 0, _PROBE
        try:
            while not unfold.eof and place < len(data) and size < most:
                part = view[place : place + feed]
                place += len(part)
                while len(part) and size < most:
                    piece = unfold.decompress(part, most - size)
                    got, size = got + len(piece), size + len(piece)
                    out.append(piece)
                    part = unfold.unconsumed_tail
                if not got:
                    break
                feed = _FEED
        except zlib.error:
            pass
        if not got:
            break
        done = place - len(unfold.unused_data) if unfold.eof else place
        if not unfold.eof:
            break
        whole = True
    return (b"".join(out), done, whole) if size >= LEAST_SECRET else None


def _decoded(layer: _Layer, room: list[int]) -> Iterator[_Layer]:
    """What a layer holds in another form. room: how many bytes streams may still unfold to, and levels of escapes may have."""
    data = layer.data
    if b"%" in data or b"\\" in data or b"&" in data:
        deep = layer.level >= LEVELS
        got = _once(data) if not deep or room[1] > 0 else (_all_levels(data) if _ESCAPE.search(data) else None)
        if deep and got is not None:
            got = _around_escapes(*got)
            room[1] -= len(got[0])
        if got is not None and got[0]:
            yield _Layer(got[0], layer.first[got[1]], layer.end[got[2]], layer.chain, layer.level + 1)
    for content, lo, hi in _streams(data, room):
        yield _Layer(content, np.broadcast_to(layer.first[lo], len(content)), np.broadcast_to(layer.end[hi - 1], len(content)), layer.chain)
    stretches = [(m.group(), np.arange(*m.span())) for m in _BASE64.finditer(data)]
    for m in _WRAPPED.finditer(data):
        lines = [x.span() for x in _LINE.finditer(data, *m.span())]
        stretches.append((b"".join(data[lo:hi] for lo, hi in lines), np.concatenate([np.arange(lo, hi) for lo, hi in lines])))
    for chars, place in stretches:
        for raw, lo, hi, taken, given in _bytes_of(chars):
            if _STREAM.search(raw) or _PLAIN.search(raw) and (_ESCAPE.search(raw) or _BASE64.search(raw) or base_spans(raw)):
                group = lo + np.arange(len(raw)) // given * taken
                yield _Layer(raw, layer.first[place[group]], layer.end[place[np.minimum(group + taken, hi) - 1]], layer.chain)


def _bytes_of(chars: bytes) -> Iterator[tuple[bytes, int, int, int, int]]:
    """What base64 or hex characters stand for, at each alignment: (bytes, start, end, characters of a group, bytes of one)."""
    for m in _HEX_DIGITS.finditer(chars):
        for lo in (m.start(), m.start() + 1):
            hi = m.end() - (m.end() - lo) % 2
            if hi - lo >= 2 * LEAST_SECRET:
                yield binascii.a2b_hex(chars[lo:hi]), lo, hi, 2, 1
    chars = chars.translate(_BASE64_URL)
    for lo in range(4):
        n = len(chars) - lo
        n -= n % 4 == 1
        if n >= LEAST_BASE64 - 4:
            yield binascii.a2b_base64(chars[lo : lo + n] + b"=" * (-n % 4)), lo, lo + n, 4, 3


def _streams(raw: bytes, room: list[int]) -> list[tuple[bytes, int, int]]:
    """(content, start, end) of the compressed streams in bytes, leftmost ones that do not overlap. What neither ends as a
    stream does nor holds text may be a false start; it counts if there may be a stream in it, and hides none after it."""
    out, at, left = [], 0, _REREAD * len(raw)
    while room[0] > 0 and (m := _STREAM.search(raw, at)) is not None:
        at = m.start() + 1
        got = _inflated(raw, m.start(), room[0])
        if got is None:
            continue
        content, end, whole = got
        sure = whole or _PLAIN.search(content)
        if sure or _STREAM.search(content):
            out.append((content, m.start(), end))
            room[0] -= len(content)
        if sure:
            at = end
        elif left > 0:
            left -= end - m.start() + len(content)
        else:
            at = end
    return out


def find_secrets(data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all): sorted (start, kind, end) in bytes of the text; all also has what decoded layers hold."""
    base = base_spans(data)
    spans = set(base)
    if not (b"%" in data or b"\\" in data or b"&" in data or _BASE64.search(data) or _STREAM.search(data)):
        return base, base
    room = [MOST_UNFOLDED, LEVEL_BYTES]
    work = [_Layer(data, np.arange(len(data)), np.arange(1, len(data) + 1), frozenset([data]))]
    seen: set[tuple[bytes, int, int]] = set()
    while work:
        for inner in _decoded(work.pop(), room):
            place = (hashlib.sha256(inner.data).digest(), *inner.source(0, len(inner.data)))
            if inner.data in inner.chain or place in seen:
                continue
            seen.add(place)
            inner.chain = inner.chain | {inner.data}
            for lo, kind, hi in base_spans(inner.data):
                start, end = inner.source(lo, hi)
                spans.add((start, kind, end))
            work.append(inner)
    return base, sorted(spans)


def _joined(spans: list[tuple[int, int, int]], data: bytes) -> str:
    """kind:start:end in code points, comma-joined."""
    if not spans:
        return ""
    at = sorted({x for s, _, e in spans for x in (s, e)})
    code, count, last = {}, 0, 0
    for x in at:
        count += len(data[last:x].decode("utf-8", "ignore"))
        code[x], last = count, x
    return ",".join(f"{KINDS[k]}:{code[s]}:{code[e]}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    for b in batches:
        buf, offs = string_parts(b.column(1))
        counts, sha, joined = [[], [], []], [], []
        for k in range(b.num_rows):
            data = buf[offs[k] : offs[k + 1]].tobytes()
            base, spans = find_secrets(data)
            for kind in range(3):
                counts[kind].append(sum(s[1] == kind for s in base))
            sha.append(hashlib.sha256(_joined(base, data).encode()).hexdigest())
            joined.append(_joined(spans, data))
        yield pa.record_batch([b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(joined, pa.string())], names=names)


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of docs.

    The counts and base_sha256 are of the text itself; spans also has what its decoded layers hold, at the place in the
    text that it was decoded from (whole groups of base64 or hex, whole streams of compressed data). Null and empty texts have
    no span. Very long texts are scanned whole, in time that grows with their size; streams unfold to MOST_UNFOLDED bytes
    a text at most. Repeated rows stay; other columns are ignored, whatever their names; an empty table gives an empty
    result. A row is judged alone, so ties do not occur.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t")).mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
