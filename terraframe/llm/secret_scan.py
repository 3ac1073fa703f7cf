"""Secret scan with a recursive decoding worklist.

A text is scanned, and so is each layer that decoding uncovers: URL escapes and Unicode escapes are decoded over the whole
layer, stretches of base64 by themselves, from each of their first four characters, as others may stand right before; what
base64 or escaped bytes hold is unpacked where it is gzip, zlib or bzip2. New layers go on
the worklist, one at a time, until none is left; a layer whose text (of the same place) was met before is not taken again, which also ends
cycles. A secret found in a layer is mapped back through all layers to the span of the text that encodes it. Plain spans
of the text itself always stay.

Kinds: ``assign`` (a key word, an assignment sign, a value of 12 characters or more), ``access`` (an access key id of 18
or more), ``hex`` (16 hexadecimal digits or more). Spans are of the whole match, in code points, the end exclusive.

Defined results: a null text is an empty one and has no spans. Each row is scanned by itself, so order, copies and other
columns don't matter. Base64 is read line by line and, where lines follow one another, joined, from each line on; a secret
that a line break cuts may be listed by its parts, too. Compressed stretches are read to the end of their last member, in
pieces of about ``PIECE`` bytes that end where no secret and no encoding can go on, so an archive isn't held whole unless it
is one such stretch. Of decoded bytes, the runs of ``RUN`` printable characters or more are scanned, in UTF-8 or UTF-16: no secret is shorter.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraframe.llm._session import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WORDS = ("passw", "secret", "token", "api")
PIECE = 1 << 22
RUN_LEAST = 16
URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|\\u\{[0-9A-Fa-f]{1,6}\}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|[uU]\+[0-9A-Fa-f]{4,6}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 on lines that follow one another.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++")
LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: UTF-8 without control characters, of the length of the shortest secret or more.
RUN = re.compile(
    rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}){16,}+"
)
#: The same in UTF-16 of either byte order.
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){16,}+|(?:\x00[\t\n\r\x20-\x7e]){16,}+")
#: How gzip, bzip2 and zlib begin.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|[\x08\x18\x28\x38\x48\x58\x68\x78][\x01-\xff]")
#: Stretches of escaped bytes and of bytes that stand for themselves, where escapes are those of URLs or of string literals.
ESCAPED = (re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+"), re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\[0abtnvfr\\'\"]|[ -\[\]-~])+"))
TOKEN = (re.compile(r"%([0-9A-Fa-f]{2})()"), re.compile(r"\\(?:x([0-9A-Fa-f]{2})|([0abtnvfr\\'\"]))"))
NAMED = dict(zip("0abtnvfr\\'\"", b"\x00\x07\x08\t\n\x0b\x0c\r\\'\"", strict=True))
#: Bytes outside ASCII that show a stretch of escapes to hold more than text.
HIGH = (re.compile(r"%(?:[89A-Fa-f][0-9A-Fa-f]|1[Ff])"), re.compile(r"\\x(?:[89A-Fa-f][0-9A-Fa-f]|1[Ff])"))
#: Bytes that are in no secret and in no encoding.
BREAK = re.compile(rb"[\x00-\x08\x0e-\x1f!$()*,<>?@\[\]^`|~\x7f]")
SCHEMA = "doc_id long, spans array<struct<kind:string,start:int,end:int,plain:boolean>>"

Span = tuple[int, int, int]  # start, kind, end


def plain_spans(text: str) -> list[Span]:
    """Spans of the text as it stands, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A decoded text, and where in its parent each part stands. pieces: (start here, start there, end there, exact); the
    characters of an exact piece stand one to one, those of others all map to the whole piece."""

    def __init__(self, text: str, parent: Layer | None, pieces: list[tuple[int, int, int, bool]]):
        self.text, self.parent, self.pieces = text, parent, pieces
        self.starts = [p[0] for p in pieces]

    def up(self, start: int, end: int) -> tuple[int, int]:
        """The span of the outermost text that holds what encodes this one."""
        layer = self
        while layer.parent is not None:
            p = layer.pieces[bisect_right(layer.starts, start) - 1]
            q = layer.pieces[bisect_right(layer.starts, end - 1) - 1]
            start, end = (p[1] + start - p[0] if p[3] else p[1]), (q[1] + end - q[0] if q[3] else q[2])
            layer = layer.parent
        return start, end


def escapes(layer: Layer, pattern: re.Pattern, decode: Callable[[str], str]) -> Layer | None:
    """The layer with all matches of the pattern decoded, character by character."""
    parts, pieces, at, left = [], [], 0, 0
    for m in pattern.finditer(layer.text):
        got = decode(m[0])
        if got == m[0]:
            continue
        unit = 4 if m[0][:2] == "\\x" else 3  # characters of one escaped byte
        if m.start() > left:
            parts.append(layer.text[left : m.start()])
            pieces.append((at, left, m.start(), True))
            at += m.start() - left
        sizes = [len(c.encode()) * unit for c in got] if "\ufffd" not in got else []
        if sum(sizes) == len(m[0]):  # each character stands for its own escapes
            here = m.start()
            for i, size in enumerate(sizes):
                pieces.append((at + i, here, here + size, False))
                here += size
        elif got and len(m[0]) % len(got) == 0:
            w = len(m[0]) // len(got)
            pieces += [(at + i, m.start() + w * i, m.start() + w * i + w, False) for i in range(len(got))]
        elif got:
            pieces.append((at, m.start(), m.end(), False))
        parts.append(got)
        at, left = at + len(got), m.end()
    if not pieces:
        return None
    if left < len(layer.text):
        parts.append(layer.text[left:])
        pieces.append((at, left, len(layer.text), True))
    return Layer("".join(parts), layer, pieces)


def url_decode(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")


def unicode_decode(s: str) -> str:
    if s[0] == "&":
        codes = [int(s[3:-1], 16) if s[2] in "xX" else int(s[2:-1])]
    elif s[0] in "uU":
        codes = [int(s[2:], 16)]
    elif s[1] == "x":
        return bytes.fromhex(s.replace("\\x", "")).decode("utf-8", "replace")
    elif s[1] == "U":
        codes = [int(s[2:], 16)]
    elif s[2] == "{":
        codes = [int(s[3:-1], 16)]
    else:
        codes = [int(x, 16) for x in s.split("\\u")[1:]]
    if any(c > 0x10FFFF or c == 0 for c in codes):
        return s
    return "".join(map(chr, codes)).encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def decompressor(data: bytes):
    """What unpacks bytes that start like these, or None."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(data) > 2 and data[0] & 15 == 8 and (data[0] << 8 | data[1]) % 31 == 0:
        return zlib.decompressobj()
    return bz2.BZ2Decompressor() if data[:3] == b"BZh" else None


def unpack(data: bytes) -> Iterator[bytes]:
    """The contents of compressed bytes, member after member, of layers in one another; other bytes as they are. Sixty-four
    layers are read as one stream; what is still packed is taken up again after it, unless it was met before."""
    work, seen = [data], set()
    while work:
        data = work.pop()
        key = hashlib.blake2b(data, digest_size=16).digest()
        if key not in seen:
            seen.add(key)
            yield from members(iter([data]), 64, work)


def members(chunks: Iterator[bytes], depth: int, deeper: list[bytes]) -> Iterator[bytes]:
    """As unpack, of chunks; a member that breaks off gives what it has, and its bytes."""
    for data in chunks:
        while data:
            d = decompressor(data)
            if d is None:
                yield data
                break
            if not depth:
                deeper.append(b"".join([data, *chunks]))
                return
            raw, rest = [data], []

            def member(d=d, raw=raw, rest=rest):
                part = raw[0]
                try:
                    while True:
                        got = d.decompress(part, PIECE)
                        if got:
                            yield got
                        if d.eof:
                            rest.append(d.unused_data)
                            return
                        part = getattr(d, "unconsumed_tail", b"")
                        if not got and not part and getattr(d, "needs_input", True):
                            part = next(chunks, b"")
                            if not part:
                                return
                            raw.append(part)
                except (zlib.error, OSError, EOFError, ValueError):
                    return

            yield from members(member(), depth - 1, deeper)
            if not rest:
                yield b"\x00"
                yield from raw
            data = rest[0] if rest else b""


def pieces(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """chunks put together anew, in pieces that end at a BREAK."""
    held, size = [], 0
    for data in chunks:
        held.append(data)
        size += len(data)
        if size >= PIECE:
            last = None
            for last in BREAK.finditer(data):
                pass
            if last is not None:
                held[-1] = data[: last.end()]
                yield b"".join(held)
                held, size = [data[last.end() :]], len(data) - last.end()
    yield b"".join(held)


def printable(data: bytes) -> Iterator[tuple[int, str, int]]:
    """(place, text, bytes of a character, or 0 for UTF-8) of each run of text."""
    for m in RUN.finditer(data):
        yield m.start(), m[0].decode(), 0
    if b"\x00" in data:
        for m in WIDE.finditer(data):
            yield m.start(), m[0].replace(b"\x00", b"").decode(), 2


def packed(data: bytes) -> Iterator[tuple[int, str]]:
    """(place where it begins, run of text) of what the bytes hold compressed."""
    at = 0
    while (m := MAGIC.search(data, at)) is not None:
        at = m.start() + 1
        if decompressor(data[m.start() : m.start() + 4]) is None or not opens(data[m.start() :]):
            continue
        for piece in pieces(unpack(data[m.start() :])):
            for _, text, _ in printable(piece):
                yield m.start(), text


def packed_end(data: bytes) -> int:
    """Where the compressed members that the bytes begin with end."""
    left = data
    while (d := decompressor(left)) is not None:
        part = left
        try:
            while not d.eof and (part or not getattr(d, "needs_input", True)):
                d.decompress(part, PIECE)
                part = getattr(d, "unconsumed_tail", b"")
        except (zlib.error, OSError, EOFError, ValueError):
            break
        if not d.eof:
            return len(data)
        left = d.unused_data
    return len(data) - len(left)


def opens(data: bytes) -> bool:
    """Whether compressed bytes give anything. A chance header mostly fails at once; a block of bzip2 gives nothing before its
    end, and the name in a header may be long, so they are read on until something comes."""
    d, rest = decompressor(data), memoryview(data)
    try:
        while rest and not d.eof:
            if d.decompress(rest[: 1 << 16], RUN_LEAST):
                return True
            rest = rest[1 << 16 :]
    except (zlib.error, OSError, EOFError, ValueError):
        pass
    return False


def decoded(layer: Layer, body: str, places: range | list[int], packed_only: bool = False) -> Iterator[Layer]:
    """The layers that base64 holds; places: where its characters stand in the layer."""
    if len(body) % 4 == 1:
        body = body[:-1]
    if not body:
        return
    try:
        data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return
    for at, text in packed(data):
        yield Layer(text, layer, [(0, places[at * 4 // 3], places[len(body) - 1] + 1, False)])
    if packed_only:
        return
    for at, text, wide in printable(data):
        parts = []
        for i, c in enumerate(text):
            size = wide or len(c.encode())
            parts.append((i, places[at * 4 // 3], places[min(len(body), -(-(at + size) * 4 // 3)) - 1] + 1, False))
            at += size
        yield Layer(text, layer, parts)


def escaped_layers(layer: Layer) -> Iterator[Layer]:
    """The layers that are compressed bytes, written with escapes, hold. (Texts in escapes are decoded in place.)"""
    for run, token, high in zip(ESCAPED, TOKEN, HIGH):
        if high.search(layer.text) is None:
            continue
        for m in run.finditer(layer.text):
            if high.search(m[0]) is None:
                continue
            out, places, left = [], [], m.start()
            for t in token.finditer(layer.text, m.start(), m.end()):
                out.append(layer.text[left : t.start()].encode("latin-1"))
                out.append(bytes([int(t[1], 16) if t[1] else NAMED[t[2]]]))
                places += [*range(left, t.start()), t.start()]
                left = t.end()
            out.append(layer.text[left : m.end()].encode("latin-1"))
            places += [*range(left, m.end()), m.end()]
            data, ends = b"".join(out), {}
            for at, text in packed(data):
                if at not in ends:
                    ends[at] = at + packed_end(data[at:])
                yield Layer(text, layer, [(0, places[at], places[ends[at]], False)])


def base64_layers(layer: Layer) -> Iterator[Layer]:
    for m in BASE64.finditer(layer.text):
        body = m[0].rstrip("=")
        for skip in range(min(4, len(body))):  # word characters may stand right before it
            yield from decoded(layer, body[skip:], range(m.start() + skip, m.start() + len(body)))
    if "\n" not in layer.text:
        return
    for m in WRAPPED.finditer(layer.text):
        lines = list(LINE.finditer(layer.text, m.start(), m.end()))
        joined = "".join(x[0] for x in lines)
        if len(joined) < 16:
            continue
        places = [i for x in lines for i in range(x.start(), x.end())]
        at, met = 0, set()
        for x in lines[:-1]:  # lines whose starts are as far from a group of four decode to the same text
            fresh = at % 4 not in met
            met.add(at % 4)
            head = joined[at : at + 4].replace("-", "+").replace("_", "/")
            if fresh or len(head) == 4 and decompressor(base64.b64decode(head)) is not None:
                yield from decoded(layer, joined[at:], places[at:], not fresh)
            at += len(x[0])


def below(layer: Layer) -> Iterator[Layer]:
    """The layers that decoding uncovers in this one, one at a time."""
    found = [escapes(layer, URL, url_decode) if "%" in layer.text else None, escapes(layer, UNICODE, unicode_decode)]
    yield from (x for x in found if x is not None and x.text)
    yield from escaped_layers(layer)
    yield from base64_layers(layer)


def secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Spans of the text itself, and those that only decoding finds."""
    plain = plain_spans(text)
    if not ("%" in text or "\\" in text or "&#" in text or "U+" in text or "u+" in text or BASE64.search(text) or "\n" in text and WRAPPED.search(text)):
        return plain, []
    more, seen = set(), set()
    work = [iter([Layer(text, None, [])])]
    while work:
        layer = next(work[-1], None)
        if layer is None:
            work.pop()
            continue
        key = (*(layer.up(0, len(layer.text)) if layer.parent else (0, len(text))), hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            continue
        seen.add(key)
        if layer.parent is not None:
            for start, kind, end in plain_spans(layer.text):
                a, b = layer.up(start, end)
                more.add((a, kind, b))
        work.append(below(layer))
    return plain, sorted(more - set(plain))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and all spans, by start, kind as listed, and end; plain ones are of the text itself."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])

    def run(batches):
        for b in batches:
            out = []
            for text in b.column(1):
                plain, more = secrets(text.as_py() or "")
                out.append([{"kind": KINDS[k], "start": s, "end": e, "plain": p} for s, k, e, p in sorted([(*x, True) for x in plain] + [(*x, False) for x in more])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    plain = F.filter("spans", lambda s: s["plain"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(plain, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
