"""Secret scans with a recursive decoding worklist.

Three kinds of secrets are looked for in a text: ``assign`` (a password-like name given a
value), ``access`` (access key ids) and ``hex`` (long lower-case hexadecimal runs). The
text itself is layer zero. A worklist then unwraps nested encodings until nothing new
appears:

* percent-escapes (URL) and backslash escapes (``\\uXXXX``, ``\\xXX``) are replaced in
  place, every decoded character keeping the range of source characters it came from; an
  escaped escape mark that is itself escaped eight times or more is undone at once;
* base64 tokens (both alphabets) are decoded; bytes that are printable UTF-8 become a new
  layer, whose characters all stand for the whole token;
* base64 may also be wrapped over lines, or stand within a longer run of its characters (a
  path, a name): such runs are decoded at all four phases, and the printable stretches of
  what results become layers, whose characters stand for the source of their own bytes;
* gzip, zlib and bzip2 streams that begin anywhere in decoded bytes are inflated piece by
  piece, member after member and stream within stream; the printable stretches of every
  level become layers that stand for the source from the first stream on.

Each layer is rescanned, and findings are mapped to code points of the original text. A
layer whose content and place were seen before is not visited again, nor is a stream that
begins like one that it lies in, which ends cycles. Work grows with the text and what it
unwraps to; places are kept as a few numbers for each stretch, not for each character.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, prepare, tidied

#: Kinds in the order in which findings at one start are listed.
KINDS = ("assign", "access", "hex")

# The patterns of the three kinds and their shortest values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24

#: Words without which no ``assign`` can match.
_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_URL = re.compile(r"%(?:25){8,}(?=[0-9A-Fa-f]{2})|%[0-9A-Fa-f]{2}")
_URL_RUN = re.compile(rf"(?:{_URL.pattern})+")
_ESCAPE = re.compile(r"(\\(?:u005[cC]){8,}(?=[uUx]))|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
_ESCAPE_RUN = re.compile(r"(?:\\(?:u005[cC]){8,}(?=[uUx])|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
#: Runs of one plain form: their decoded characters stand evenly apart.
_PLAIN_URL = re.compile(r"(?:%[0-7][0-9A-Fa-f])+")
_PLAIN_ESCAPE = re.compile(r"(?:\\u00[0-7][0-9A-Fa-f])+")
_BLANK = re.compile(r"\s")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A line break in wrapped base64, as it is or escaped.
_WRAP = r"(?:\r?\n[\t\x20]*|(?:\\r)?\\n)"
_WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_WRAP}[A-Za-z0-9+/_-]+)*={{0,2}}")
_BREAK = re.compile(_WRAP)
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY&SY")
#: Bytes that end every finding and every encoded run.
_GAP = re.compile(rb"[^A-Za-z0-9_\"':=+/.%\\{}\t\r\n\x20-]|[.g-mo-su-xzG-MO-SU-XZ]\x20|\n\r?\n")
#: Nothing shorter holds a finding, plain or encoded.
_PRINTABLE = re.compile(rb"[\t\n\r\x20-\x7e]{12,}")

#: A level of compressed bytes of up to so many bytes is looked at whole; a longer one in several pieces, each cut where no finding and no encoding goes on.
CHUNK = 1 << 20
#: Bytes by which a compressed stream is told from others.
_HEAD = 1 << 16
#: Levels of over CHUNK bytes that are unwrapped within each other while they are read.
_NESTED = 100


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base finding in ``text``."""
    found = []
    low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    if any(h in low for h in _HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]  # maximal runs, as for HEX
    return sorted(found)


def _member(raw):
    """A decompressor for the gzip, zlib or bzip2 stream that ``raw`` begins with; None if it is none."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 2 and (raw[0] * 256 + raw[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return None


def _opens(head: bytes) -> bool:
    """Whether a stream begins here; text may begin like one, but doesn't go on to a valid end."""
    stream = _member(head)
    if stream is None:
        return False
    try:
        out = stream.decompress(head, 1 << 16)
    except (zlib.error, OSError, EOFError, ValueError):
        return False
    return stream.eof or len(out) >= 1 << 16 or head.translate(None, _CONTROL) != head or not head.isascii()


class _Level:
    """Bytes that arrive in pieces: their printable stretches go to ``found``, and so do those of all streams in them.

    What a stream holds is a level of its own. It waits in ``queue`` if it is small, so that
    nesting needs no recursion; ``heads`` tells the streams that this level lies in.
    """

    def __init__(self, found: list[str] | None, queue: deque, heads: frozenset = frozenset(), depth: int = 0):
        self.found, self.queue, self.heads, self.depth = found, queue, heads, depth
        self.kept: list[bytes] = []  # not yet searched for printable stretches
        self.size, self.wanted, self.old = 0, CHUNK, 0
        self.raw = b""  # not yet searched for streams
        self.open = None  # the stream that goes on: decompressor, what it holds

    def feed(self, data: bytes) -> None:
        if self.found is not None:
            self.kept.append(data)
            self.size += len(data)
            if self.size >= self.wanted:
                self._printable(False)
        self._streams(data, False)

    def close(self) -> None:
        self._streams(b"", True)
        if self.open:
            self.open[1].close()
            self.open = None
        if self.found is not None:
            self._printable(True)

    def _printable(self, ended: bool) -> None:
        held = b"".join(self.kept)
        cut = len(held) if ended else 0
        for reach in () if ended else (1 << 12, 1 << 16, len(held) - self.old + 3):
            at = max(0, len(held) - reach)
            cut = max((m.end() for m in _GAP.finditer(held, at)), default=0)
            if cut:
                break
        self.found += [m[0].decode("ascii") for m in _PRINTABLE.finditer(held, 0, cut)]
        self.kept, self.old = [held[cut:]], len(held) - cut
        self.size, self.wanted = self.old, max(CHUNK, 2 * self.old)

    def _streams(self, data: bytes, ended: bool) -> None:
        while True:
            if self.open:
                data = self._inflate(data)
                if self.open:
                    return
            self.raw, data = self.raw + data if self.raw else data, b""
            for m in _MAGIC.finditer(self.raw):
                if len(self.raw) - m.start() < _HEAD and not ended:
                    self.raw = self.raw[m.start() :]
                    return
                head = self.raw[m.start() : m.start() + _HEAD]
                mark = hashlib.blake2b(head, digest_size=16).digest()
                if mark not in self.heads and _opens(head):
                    self.open = _member(head), _Held(self, self.heads | {mark})
                    self.raw, data = b"", self.raw[m.start() :]
                    break
            else:
                self.raw = self.raw[-9:]  # may begin a stream
                return

    def _inflate(self, data: bytes) -> bytes:
        """Feeds the open stream; what is left once it has ended."""
        stream, held = self.open
        try:
            while True:
                out = stream.decompress(data, CHUNK)
                data = b"" if isinstance(stream, bz2.BZ2Decompressor) else stream.unconsumed_tail
                if out:
                    held.feed(out)
                if stream.eof:
                    data = stream.unused_data
                    break
                if not data and (stream.needs_input if isinstance(stream, bz2.BZ2Decompressor) else len(out) < CHUNK):
                    return b""
        except (zlib.error, OSError, EOFError, ValueError):
            data = data[1:]  # other streams may begin in what this one could not read
        held.close()
        self.open = None
        return data


class _Held:
    """What a stream holds: kept while it is small, then given to a level as it comes."""

    def __init__(self, above: _Level, heads: frozenset):
        self.above, self.heads, self.kept, self.size, self.level = above, heads, [], 0, None

    def feed(self, data: bytes) -> None:
        if self.level:
            self.level.feed(data)
            return
        self.kept.append(data)
        self.size += len(data)
        if self.size > CHUNK and self.above.depth < _NESTED:
            self.level = _Level(self.above.queue.found, self.above.queue, self.heads, self.above.depth + 1)
            self.level.feed(b"".join(self.kept))
            self.kept = []

    def close(self) -> None:
        if self.level:
            self.level.close()
        else:
            self.above.queue.append((b"".join(self.kept), self.heads))


class _Queue(deque):
    """Small levels that wait, and the stretches that were found."""

    def __init__(self):
        super().__init__()
        self.found: list[str] = []


def _unwrapped(raw) -> Iterator[str]:
    """The printable stretches of all streams in ``raw``, and of the streams in them."""
    queue = _Queue()

    def given():
        out, queue.found[:] = list(queue.found), []
        return out

    def of(level, data):
        for k in range(0, len(data), 4096):
            level.feed(bytes(data[k : k + 4096]))
            yield from given()
        level.close()
        yield from given()

    yield from of(_Level(None, queue), raw)
    while queue:
        data, heads = queue.popleft()
        yield from of(_Level(queue.found, queue, heads), data)


def _readable(raw: bytes) -> str | None:
    """The bytes as text if they are UTF-8 without control characters."""
    if raw and raw.translate(None, _CONTROL) == raw:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return None
    return None


_CONTROL = bytes(c for c in (*range(32), 127) if c not in (9, 10, 13))


def _decoded(body: str) -> bytes:
    """The bytes of base64 without padding; a last character that is only part of a byte is left out."""
    if len(body) % 4 == 1:
        body = body[:-1]
    if "-" in body or "_" in body:
        body = body.replace("-", "+").replace("_", "/")
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _from_base64(token: str) -> str | None:
    body = token.rstrip("=")
    if len(body) % 4 == 1:
        return None
    return _readable(_decoded(body))


def _islands(raw: bytes):
    """(text, start, end) of the printable stretches; bytes between them are in no finding."""
    for m in _PRINTABLE.finditer(raw):
        yield m[0].decode("ascii"), m.start(), m.end()


Place = Callable[[int, int], tuple[int, int]]


class _Source:
    """Where the characters of a text come from in another: stretches whose characters are ``step`` apart and ``width`` long there."""

    def __init__(self):
        self.at, self.first, self.step, self.width = (array("q") for _ in range(4))
        self.size = 0

    def add(self, n: int, first: int, step: int = 1, width: int = 1) -> None:
        if n:
            for held, x in ((self.at, self.size), (self.first, first), (self.step, step), (self.width, width)):
                held.append(x)
            self.size += n

    def __call__(self, a: int, b: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, a) - 1, bisect_right(self.at, b - 1) - 1
        return self.first[i] + (a - self.at[i]) * self.step[i], self.first[j] + (b - 1 - self.at[j]) * self.step[j] + self.width[j]


def _inside_base64(m: re.Match) -> Iterator[tuple[str, Place]]:
    """Layers anywhere in a run, and the places of their characters in the searched text."""
    run = m[0].rstrip("=")
    lines, lead, skipped = [0], [m.start()], 0  # where lines begin in the body, and what lies between a place there and in the text
    for cut in _BREAK.finditer(run):
        lines.append(cut.start() - skipped)
        skipped += cut.end() - cut.start()
        lead.append(m.start() + skipped)
    body = _BREAK.sub("", run)

    def place(k: int) -> int:
        return k + lead[bisect_right(lines, k) - 1]

    for phase in range(4):
        raw = _decoded(body[phase:])

        def source(a: int, b: int, phase=phase):
            return place(phase + a // 3 * 4), place(min(len(body), phase + (b - 1) // 3 * 4 + 4) - 1) + 1

        for text, first, _ in _islands(raw):
            yield text, lambda a, b, source=source, first=first: source(first + a, first + b)
        for found in _MAGIC.finditer(raw):
            if _opens(raw[found.start() : found.start() + _HEAD]):
                whole = source(found.start(), len(raw))
                for text in _unwrapped(memoryview(raw)[found.start() :]):
                    yield text, lambda a, b, whole=whole: whole
                break


def _url_runs(m: re.Match) -> Iterator[tuple[str, int, int, int]]:
    """(decoded, first, step, width) of the stretches of a percent-encoded run."""
    if _PLAIN_URL.fullmatch(m[0]):
        yield bytes.fromhex(m[0].replace("%", "")).decode("ascii"), m.start(), 3, 3
        return
    marks = [(x.start(), x.end()) for x in _URL.finditer(m[0])]
    raw = bytes(0x25 if b - a > 3 else int(m[0][a + 1 : b], 16) for a, b in marks)
    at = 0
    while at < len(raw):
        size = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4
        try:
            piece = raw[at : at + size].decode()
        except UnicodeDecodeError:
            size, piece = 1, "\ufffd"
        size = min(size, len(raw) - at)
        a, b = marks[at][0], marks[at + size - 1][1]
        yield piece, m.start() + a, 0, b - a
        at += size


def _escape_runs(m: re.Match) -> Iterator[tuple[str, int, int, int]]:
    """(decoded, first, step, width) of the stretches of a backslash-escaped run; marks beyond Unicode stay as they are."""
    if _PLAIN_ESCAPE.fullmatch(m[0]):
        yield bytes.fromhex(m[0].replace("\\u00", "")).decode("ascii"), m.start(), 6, 6
        return
    held = None  # a high surrogate that waits for its low one
    for e in _ESCAPE.finditer(m[0]):
        code = 0x5C if e[1] else int(next(g for g in e.groups()[1:] if g), 16)
        a, b = m.start() + e.start(), m.start() + e.end()
        if held and 0xDC00 <= code < 0xE000:
            yield chr(0x10000 + ((held[0] - 0xD800) << 10) + code - 0xDC00), held[1], 0, b - held[1]
            held = None
            continue
        if held:
            yield chr(held[0]), held[1], 0, held[2] - held[1]
            held = None
        if 0xD800 <= code < 0xDC00:
            held = code, a, b
        elif code > 0x10FFFF:
            yield e[0], a, 1, 1
        else:
            yield chr(code), a, 0, b - a
    if held:
        yield chr(held[0]), held[1], 0, held[2] - held[1]


def _substituted(text: str, low: int, high: int, pattern: re.Pattern, decode) -> tuple[str, Place]:
    """A range of ``text`` with each run of ``pattern`` decoded, and where its characters come from."""
    out, source, last = [], _Source(), low
    for m in pattern.finditer(text, low, high):
        out.append(text[last : m.start()])
        source.add(m.start() - last, last)
        for piece, first, step, width in decode(m):
            out.append(piece)
            source.add(len(piece), first, step, width)
        last = m.end()
    out.append(text[last:high])
    source.add(high - last, last)
    return "".join(out), source


def _windows(text: str, pattern: re.Pattern, reach: int = 512) -> list[list[int]]:
    """Ranges around the runs of ``pattern`` up to blanks, so that a long text is not copied whole for one escape."""
    ranges: list[list[int]] = []
    for m in pattern.finditer(text):
        end = ranges[-1][1] if ranges else 0
        if ranges and (m.end() + reach <= end or end == len(text)):
            continue
        a = max(end, m.start() - reach)
        while a > end and not text[a - 1].isspace():  # never beyond the range before: every character is passed once
            a -= 1
        blank = _BLANK.search(text, min(len(text), m.end() + reach))
        b = blank.start() if blank else len(text)
        if ranges and a <= end:
            ranges[-1][1] = b
        else:
            ranges.append([a, b])
    return ranges


def _children(text: str) -> Iterator[tuple[str, Place]]:
    """Layers one step below, and the places of their characters in ``text``."""
    for mark, pattern, decode in (("%", _URL_RUN, _url_runs), ("\\", _ESCAPE_RUN, _escape_runs)):
        if mark in text:
            for a, b in _windows(text, pattern):
                found = _substituted(text, a, b, pattern, decode)
                if found[0] != text[a:b]:
                    yield found
    for run in _WRAPPED.finditer(text):
        whole = False
        for m in _BASE64.finditer(text, *run.span()):
            inner = _from_base64(m[0])
            if inner is not None:
                whole |= m.span() == run.span()
                yield inner, lambda a, b, span=m.span(): span
        if not whole:
            yield from _inside_base64(run)


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base findings, and base ones with those of all decoded layers: sorted (start, kind number, end)."""
    base = scan(text)
    every, seen = set(base), set()
    # the worklist: of each layer on the way down, where it lies and what is still to be unwrapped in it
    work: list[tuple[Place, Iterator[tuple[str, Place]]]] = [(lambda a, b: (a, b), _children(text))]
    while work:
        above, rest = work[-1]
        inner, source = next(rest, (None, None))
        if inner is None:
            work.pop()
            continue
        if not inner:
            continue

        def place(a, b, above=above, source=source):
            return above(*source(a, b))

        mark = hashlib.blake2b(inner.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *place(0, len(inner))
        if mark in seen:
            continue
        seen.add(mark)
        for a, kind, b in scan(inner):
            start, end = place(a, b)
            every.add((start, kind, end))
        work.append((place, _children(inner)))
    return base, sorted(every)


def listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


_SCHEMA = "doc_id long, text string, n_assign long, n_access long, n_hex long, base string, spans string"


def scan_secrets(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """Findings of every whole text: ``doc_id, text, n_assign, n_access, n_hex, base, spans``.

    ``base`` lists the findings of the text itself as ``kind:start:end`` (code points, end
    exclusive) and ``spans`` those together with the mapped findings of decoded layers; both
    are comma-joined by start, then kind, then end; equal ones are listed once. Null and empty
    texts have none. A null id stays null. Rows that repeat give repeated results; an empty
    table gives an empty one. Other columns are ignored. No shuffle.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in parts(batches, "secret_text"):
            rows = [spans_of(x or "") for x in batch.column("secret_text").to_pylist()]
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in rows], pa.int64()) for kind in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("secret_id"), batch.column("secret_text"), *counts, pa.array([listed(b) for b, _ in rows], pa.string()), pa.array([listed(e) for _, e in rows], pa.string())], ["doc_id", "text", "n_assign", "n_access", "n_hex", "base", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("secret_id"), F.col(text).alias("secret_text")).mapInArrow(tidied(run), _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def redacted(text: str, found) -> str:
    """``text`` with every finding replaced by a mark; overlapping ones become one mark."""
    out, last = [], 0
    for a, _, b in sorted(found):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], "[SECRET]"]
        last = b
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``[SECRET]``; all columns and rows stay, null stays null."""
    prepare(docs.sparkSession)
    place = docs.columns.index(text)

    def run(batches):
        for batch in parts(batches, place):
            texts = [x and redacted(x, spans_of(x)[1]) for x in batch.column(place).to_pylist()]
            columns = [pa.array(texts, batch.schema.field(place).type) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidied(run), docs.schema)
