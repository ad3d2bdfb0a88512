"""Secret scans: regular expressions over a text and over every layer that can be unwrapped from it.

A worklist holds layers. Each layer is scanned, then unwrapped in every way that
applies - URL escapes, Unicode escapes, base64, compressed bytes - and what
comes out is put on the worklist, until nothing new appears. A layer that was
seen before is not entered again, so cycles end. Every character of a layer
knows which characters of the original text it came from, so a hit deep down
is reported as a span of the original.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds of secret in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of under 24 digits fail in any case; a run is taken whole, so this finds what [0-9a-f]+ would.
HEX = re.compile(r"[0-9a-f]{24,}")

URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: Escapes of escapes many times over: cut to eight levels in one step, as each level would be a layer of its own.
CHAIN = re.compile(r"%(?:25){9,}|\\(?:u005[cC]){9,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: The same, going on over line breaks and indentation.
LINES64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
#: Printable characters as UTF-16, either byte first.
UTF16 = re.compile(rb"(?:[\x20-\x7e]\x00){12,}|(?:\x00[\x20-\x7e]){12,}")
#: A shorter run of printable characters holds no secret.
PRINTABLE = re.compile(rb"[\x20-\x7e]{12,}")
GZIP, ZSTD, BZIP, XZ = b"\x1f\x8b", b"\x28\xb5\x2f\xfd", b"BZh", b"\xfd7zXZ\x00"
ZLIB = (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
MAGIC = re.compile(b"|".join(map(re.escape, (GZIP, ZSTD, BZIP, XZ, *ZLIB))))

#: Contents of more bytes than this are scanned in windows of it, each of which begins with the last ``OVERLAP`` bytes of the one before.
MAX_LAYER_BYTES = 64 << 20
OVERLAP = 1 << 20
#: Bytes that a decompressor takes in at a time; zstd, whose output can't be bounded, gets a few.
PIECE, ZSTD_PIECE = 64 << 10, 256

SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, n_layers int"


def scan(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one layer, leftmost and non-overlapping per kind; matches that are too short are dropped."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def in_order(spans) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def packed(data: bytes) -> bool:
    """Whether the bytes begin as gzip, zlib, zstd, bzip2 or xz do."""
    return data[:2] == GZIP or data[:2] in ZLIB or data[:4] == ZSTD or data[:3] == BZIP or data[:6] == XZ


class Inflated:
    """The contents of compressed pieces of bytes, member after member, in pieces; ends at damage or at other bytes. ``used`` are the bytes taken in, ``whole`` says if the last member was complete."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.used, self.whole = iter(pieces), 0, False

    def _member(self, data: bytes):
        if data[:2] == GZIP or data[:2] in ZLIB:
            return zlib.decompressobj(31 if data[:2] == GZIP else 15)
        if data[:4] == ZSTD:
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj()
        return bz2.BZ2Decompressor() if data[:3] == BZIP else lzma.LZMADecompressor()

    def __iter__(self) -> Iterator[bytes]:
        data = b""
        while True:
            while len(data) < 6 and (more := next(self.pieces, None)) is not None:
                data += more
            start = data.lstrip(b"\0")  # members may be padded
            if not packed(start):
                return
            self.used += len(data) - len(start)
            data, d, self.whole = start, self._member(start), False
            step = ZSTD_PIECE if data[:4] == ZSTD else PIECE
            is_zlib = data[:2] == GZIP or data[:2] in ZLIB
            while not d.eof:
                if not data and getattr(d, "needs_input", True):
                    data = next(self.pieces, b"")
                head, data = data[:step], data[step:]
                try:
                    if is_zlib:
                        out = d.decompress(head, 1 << 20)
                        rest = d.unconsumed_tail
                    elif step == ZSTD_PIECE:
                        out, rest = d.decompress(head), b""
                    else:
                        if not d.needs_input:
                            head, data = b"", head + data
                        out, rest = d.decompress(head, 1 << 20), b""
                except Exception:  # damaged bytes raise many kinds of error; they're no layer
                    return
                self.used += len(head) - len(rest)
                data = rest + data
                if out:
                    yield out
                elif not head and not d.eof:  # nothing more comes in or out
                    return
            self.used -= len(d.unused_data)
            data = d.unused_data + data
            self.whole = True


def _pieces(data: bytes) -> Iterator[bytes]:
    return (data[i : i + PIECE] for i in range(0, len(data), PIECE))


def _head(parts: Iterator[bytes], size: int) -> bytes:
    """At least ``size`` bytes of ``parts``, or all that are left."""
    out, n = [], 0
    while n < size and (part := next(parts, None)) is not None:
        out.append(part)
        n += len(part)
    return b"".join(out)


def contents(data: bytes) -> Iterator[bytes]:
    """Windows of what is inside of compressed bytes, with all compressed layers undone; nothing if there is no such layer."""
    seen = {hashlib.blake2b(data, digest_size=16).digest()}
    parts = iter(Inflated(_pieces(data)))
    head = _head(parts, MAX_LAYER_BYTES)
    while head:
        if len(head) < MAX_LAYER_BYTES:  # all of it: as deep as it goes, until it repeats
            key = hashlib.blake2b(head, digest_size=16).digest()
            if key in seen:
                return
            seen.add(key)
            inner = iter(Inflated(_pieces(head)))
        else:
            inner = iter(Inflated(_pieces(head)))
        first = _head(inner, 1)
        if not first:
            break
        if len(head) < MAX_LAYER_BYTES:
            parts = chain([first], inner)
        else:
            parts = iter(Inflated(chain([head], parts)))
        head = _head(parts, MAX_LAYER_BYTES)
    while head:
        yield head
        more = _head(parts, MAX_LAYER_BYTES)
        head = head[-OVERLAP:] + more if more else b""


def decompressed(data: bytes, limit: int = MAX_LAYER_BYTES) -> bytes | None:
    """The contents of gzip, zlib, zstd, bzip2 or xz bytes, one layer; None for anything else, damaged or larger than ``limit``."""
    inside = Inflated(_pieces(data))
    out = _head(iter(inside), limit + 1)
    return out if inside.whole and len(out) <= limit else None


def as_text(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8 without control characters, else None."""
    try:
        s = data.decode()
    except UnicodeDecodeError:
        return None
    return s if s and not re.search(r"[\x00-\x08\x0e-\x1f\x7f]", s) else None


def readable(data: bytes) -> str | None:
    """Bytes as text if they are UTF-8, else character for byte if anything in them is long enough for a secret, else None."""
    if (s := as_text(data)) is not None:
        return s
    if UTF16.search(data):
        return data.replace(b"\0", b"").decode("latin-1")
    return data.decode("latin-1") if PRINTABLE.search(data) else None


class Layer:
    """A text and, for each of its characters, the span of the original it stands for (None: itself; a number each: one span for all)."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | int | None = None, ends: np.ndarray | int | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def origins(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray | int, np.ndarray | int]:
        """``origin`` of many spans that don't go back in the text."""
        if self.starts is None:
            return starts.astype(np.int32), ends.astype(np.int32)
        if isinstance(self.starts, int):
            return self.starts, self.ends
        return self.starts[starts], self.ends[ends - 1]

    def place(self) -> tuple[int, int]:
        if not self.text:
            return 0, 0
        return self.origin(0, 1)[0], self.origin(len(self.text) - 1, len(self.text))[1]


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match of ``pattern`` replaced by ``decode(match)``: pairs (text, its span within the match)."""
    parts, starts, ends, at, one = [], array("i"), array("i"), 0, isinstance(layer.starts, int)

    def keep(a: int, b: int) -> None:
        parts.append(layer.text[a:b])
        if not one:
            starts.frombytes((np.arange(a, b, dtype=np.int32) if layer.starts is None else layer.starts[a:b]).tobytes())
            ends.frombytes((np.arange(a + 1, b + 1, dtype=np.int32) if layer.starts is None else layer.ends[a:b]).tobytes())

    for m in pattern.finditer(layer.text):
        pieces = decode(m)
        if pieces is None:
            continue
        keep(at, m.start())
        for chars, a, b in pieces:
            parts.append(chars)
            if not one:
                s, e = layer.origin(m.start() + a, m.start() + b)
                starts.extend([s] * len(chars))
                ends.extend([e] * len(chars))
        at = m.end()
    if not parts:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), layer.starts, layer.ends) if one else Layer("".join(parts), np.frombuffer(starts, np.int32), np.frombuffer(ends, np.int32))


def _characters(raw: bytes) -> Iterator[tuple[str, int]]:
    """(character, its number of bytes) of UTF-8; a byte that belongs to none is a replacement character of its own."""
    at = 0
    while at < len(raw):
        lead = raw[at]
        n = 1 if lead < 0xC2 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        try:
            c = raw[at : at + n].decode()
        except UnicodeDecodeError:
            c, n = "\ufffd", 1
        yield c, n
        at += n


def _url(m: re.Match) -> list[tuple[str, int, int]] | None:
    out, at = [], 0
    for c, n in _characters(unquote_to_bytes(m[0])):
        out.append((c, 3 * at, 3 * (at + n)))
        at += n
    return out


def _magics(escape) -> re.Pattern:
    """Where compressed bytes may begin, each byte as it is or as one of ``escape(byte)``."""
    byte = lambda b: "(?:" + "|".join([re.escape(chr(b)), *escape(b)]) + ")"
    return re.compile("|".join("".join(map(byte, magic)) for magic in (GZIP, ZSTD, BZIP, XZ, *ZLIB)))


def _hex(b: int) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in f"{b:02x}")


#: How bytes are written in texts: where compressed ones may begin, and one byte (hexadecimal or octal digits, a letter after a backslash, or the byte as a character).
ESCAPES = [
    (_magics(lambda b: [f"%{_hex(b)}"]), re.compile(r"%([0-9A-Fa-f]{2})|()()([\x00-\xff])")),
    (_magics(lambda b: [rf"\\x{_hex(b)}", rf"\\u00{_hex(b)}", rf"\\{b:03o}"]), re.compile(r"\\(?:x|u00)([0-9A-Fa-f]{2})|\\([0-7]{1,3})|\\([abfnrtv\\'\"/])|([\x00-\xff])")),
]
LETTERS = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11}


def _escaped(layer: Layer) -> Iterator[Layer]:
    """A layer for each stretch of compressed bytes that are written as escapes, or as characters, other bytes among them standing for themselves.

    Bytes are taken as the decompressor asks for them, so a false start costs little.
    """
    for kind, (magics, token) in enumerate(ESCAPES):
        if not kind and "%" not in layer.text:
            continue
        done = 0
        for m in magics.finditer(layer.text):
            if m.start() < done:
                continue
            for plus in (" ", "+") if not kind else ("+",):  # quote_plus() writes blanks as +, quote() leaves no + at all
                ends, taken = array("i"), bytearray()

                def pieces(at: int = m.start(), plus: str = plus, ends: array = ends, taken: bytearray = taken, token: re.Pattern = token) -> Iterator[bytes]:
                    size = 64
                    while True:
                        out = bytearray()
                        while len(out) < size and (t := token.match(layer.text, at)):
                            h, octal, letter, c = t.groups()
                            out.append(int(h, 16) if h else int(octal, 8) & 255 if octal else LETTERS.get(letter, ord(letter)) if letter else ord(plus if c == "+" else c))
                            at = t.end()
                            ends.append(at)
                        if not out:
                            return
                        taken += out
                        yield bytes(out)
                        size = min(2 * size, PIECE)

                # read once for its length; what it holds is then read in windows
                inside = Inflated(pieces())
                n = sum(map(len, inside))
                if not n or not (inside.whole or n >= 12):
                    continue
                done = max(done, ends[inside.used - 1])
                whole = layer.origin(m.start(), ends[inside.used - 1])
                for window in contents(bytes(taken[: inside.used])):
                    if (text := readable(window)) is not None:
                        yield Layer(text, *whole)
                if inside.whole:
                    break


def _unicode(m: re.Match) -> list[tuple[str, int, int]] | None:
    code = int(m[1] or m[2] or m[3], 16)
    return [(chr(code), 0, len(m[0]))] if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _base64(layer: Layer) -> Iterator[Layer]:
    """Layers for each run of base64 that holds text or compressed text, at each of the four places where its groups of four may begin: what stands before it may belong to the alphabet too."""
    for pattern in (BASE64, LINES64):
        for m in pattern.finditer(layer.text):
            if pattern is BASE64:
                run, places = m[0].rstrip("="), np.arange(m.start(), m.end(), dtype=np.int32)
            else:
                places = np.fromiter((m.start() + t.start() for t in re.finditer(r"[^\s=]", m[0])), np.int32)
                run = "".join(m[0].split()).rstrip("=")
            run = run.replace("-", "+").replace("_", "/")
            for shift in range(4):
                yield from _decoded(layer, run[shift:], places[shift:], m.end(), shift)


def _decoded(layer: Layer, run: str, places, end: int, shift: int) -> Iterator[Layer]:
    if len(run) % 4 == 1:
        run = run[:-1]
    data = base64.b64decode(run + "=" * (-len(run) % 4))
    span = lambda a, b: (int(places[a * 4 // 3]), end if b == len(data) else int(places[-(-b * 4 // 3) - 1]) + 1)
    done = 0
    for m in MAGIC.finditer(data):
        if m.start() < done:
            continue
        rest = data[m.start() :]
        inside = Inflated(_pieces(rest))
        n = sum(map(len, inside))
        if not n or not (inside.whole or n >= 12):
            continue
        done = m.start() + inside.used
        whole = layer.origin(*span(m.start(), done))
        for window in contents(rest[: inside.used]):
            if (text := readable(window)) is not None:
                yield Layer(text, *whole)
    text = as_text(data)
    if text is not None and not text.isascii():  # characters can't be told apart: the run as a whole
        if not shift:
            yield Layer(text, *layer.origin(int(places[0]), end))
        return
    views = []
    if text is not None or PRINTABLE.search(data):
        views.append((data, 0, 1))
    if UTF16.search(data):
        views += [(data[k::2], k, 2) for k in (0, 1)]
    for view, first, step in views:
        a = first + step * np.arange(len(view))
        b = np.minimum(len(data), a + step)
        yield Layer(view.decode("latin-1"), *layer.origins(places[a * 4 // 3], np.where(b == len(data), end, places[np.minimum(len(places), -(-b * 4 // 3)) - 1] + 1)))


def unwrapped(layer: Layer) -> Iterator[Layer]:
    """Every layer one step below."""
    if found := _rewritten(layer, CHAIN, lambda m: [(m[0][0] + ("25" if m[0][0] == "%" else "u005c") * 8, 0, len(m[0]))]):
        yield found
        return
    if "%" in layer.text and (found := _rewritten(layer, URL, _url)):
        yield found
    if "\\" in layer.text and (found := _rewritten(layer, UNICODE, _unicode)):
        yield found
    yield from _escaped(layer)
    yield from _base64(layer)


def scan_layers(text: str) -> tuple[list, list, int]:
    """(spans of the text itself, those and the spans of all layers, number of layers)."""
    base = scan(text)
    spans, seen, work, n = set(base), {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}, [Layer(text)], 0
    while work:
        layer = work.pop()
        n += 1
        for below in unwrapped(layer):
            # the same text from another place is another layer: its spans differ
            key = hashlib.blake2b(below.text.encode("utf-8", "surrogatepass") + repr(below.place()).encode(), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            spans |= {(kind, *below.origin(s, e)) for kind, s, e in scan(below.text)}
            work.append(below)
    return in_order(base), in_order(spans), n


def _structs(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found], pa.list_(kind))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, base, spans, n_layers``; no shuffle, each document stands alone.

    ``base`` are the spans of the text as it stands, ``spans`` those and the ones found
    in unwrapped layers, as code points of the text, end exclusive, by start, then kind, then end; equal
    spans from several layers are one. A null or empty text has none; texts are scanned whole, at about 8 bytes for
    each character of a layer with escapes; repeated rows each get their row; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text"):
                got = [scan_layers(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _structs([g[0] for g in got]), _structs([g[1] for g in got]), pa.array([g[2] for g in got], pa.int32())], names=["doc_id", "base", "spans", "n_layers"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """The documents with every secret span replaced by ``mask`` (overlapping spans by one); ``n_chars``, where there is one, follows the text.

    All columns stay as they are, in their order; texts without secrets, null ones included, are not changed.
    """

    def cleaned(text: str | None) -> str | None:
        spans = scan_layers(text)[1] if text else []
        out, at = [], 0
        for _, s, e in sorted(spans, key=lambda x: x[1:]):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join(out) + text[at:] if spans else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.chunks(batch, "text"):
                old = part.column("text").to_pylist()
                new = [cleaned(t) for t in old]
                columns = {"text": pa.array(new, part.schema.field("text").type)}
                if "n_chars" in part.schema.names:
                    was = part.column("n_chars").to_pylist()
                    columns["n_chars"] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, was, strict=True)], part.schema.field("n_chars").type)
                yield pa.RecordBatch.from_arrays([columns.get(f.name, part.column(i)) for i, f in enumerate(part.schema)], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def digest(spans):
    """``kind:start:end``, comma-joined, of an array of spans in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(common.read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), "n_layers")
