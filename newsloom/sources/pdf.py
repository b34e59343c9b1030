"""Text of PDF files: objects, compressed object streams, page trees, text operators and the fonts' maps to Unicode."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Gap between two strings of a line, in thousandths of the font's size, from which on they are two words; pages deep that a tree may be.
#: Codes up to which a range of a font's map is written out.
WORD_GAP, DEEPEST, NARROW = 180, 64, 256
_OBJECT, _TOKEN = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b"), re.compile(rb"[^\s()<>\[\]{}/%]+")
_SPACE = re.compile(rb"(?:\s|%[^\r\n]*)*")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name: /Type is Name("Type")."""


class Ref(int):
    """A reference to the object of a number."""


class Stream(dict):
    """A dictionary with the bytes that follow it."""

    raw = b""


class Operator(bytes):
    """A bare word: an operator of a page's content."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A (string) from its bracket on: nested brackets, escapes and octal codes."""
    out, depth, at = bytearray(), 1, at + 1
    while at < len(data):
        c = data[at : at + 1]
        if c == b"\\":
            if octal := re.compile(rb"[0-7]{1,3}").match(data, at + 1):
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
            elif ends := re.compile(rb"\r\n|\r|\n").match(data, at + 1):
                at = ends.end()
            else:
                out += _ESCAPES.get(data[at + 1 : at + 2], data[at + 1 : at + 2])
                at += 2
            continue
        depth += (c == b"(") - (c == b")")
        at += 1
        if not depth:
            break
        out += c
    return bytes(out), at


def value(data: bytes, at: int) -> tuple[object, int]:
    """The object that begins at a place, after blanks and comments, and where it ends; ValueError at the end of the data."""
    at = _SPACE.match(data, at).end()
    c = data[at : at + 1]
    if not c:
        raise ValueError("the data end")
    if data.startswith(b"<<", at):
        out, at = {}, at + 2
        while not data.startswith(b">>", at := _SPACE.match(data, at).end()):
            key, at = value(data, at)
            out[key], at = value(data, at)
        return out, at + 2
    if c == b"[":
        items, at = [], at + 1
        while not data.startswith(b"]", at := _SPACE.match(data, at).end()):
            item, at = value(data, at)
            items.append(item)
        return items, at + 1
    if c == b"(":
        return _string(data, at)
    if c == b"<":
        end = data.index(b">", at)
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), end + 1
    if c == b"/":
        m = _TOKEN.match(data, at + 1)
        text = m[0] if m else b""
        return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes.fromhex(x[1].decode()), text).decode("latin-1")), at + 1 + len(text)
    if ref := re.compile(rb"(\d+)\s+\d+\s+R\b").match(data, at):
        return Ref(ref[1]), ref.end()
    m = _TOKEN.match(data, at)
    if not m:
        return Operator(c), at + 1
    if re.fullmatch(rb"[+-]?\d+", m[0]):
        return int(m[0]), m.end()
    if re.fullmatch(rb"[+-]?(?:\d+\.\d*|\.\d+)", m[0]):
        return float(m[0]), m.end()
    return {b"true": True, b"false": False, b"null": None}.get(m[0], Operator(m[0])), m.end()


def _unpredict(data: bytes, columns: int, colours: int) -> bytes:
    """Rows of which each begins with the PNG filter that it was written by."""
    width = columns * colours
    before, out = bytes(width), bytearray()
    for at in range(0, len(data), width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(len(row)):
            left, up, corner = (row[i - colours] if i >= colours else 0), before[i], (before[i - colours] if i >= colours else 0)
            guess = left + up - corner
            nearest = min((abs(guess - x), n, x) for n, x in enumerate((left, up, corner)))[2]
            row[i] = (row[i] + (0, left, up, (left + up) // 2, nearest)[kind]) & 255
        out += row
        before = bytes(row.ljust(width, b"\0"))
    return bytes(out)


class File:
    """A file's objects by number, the last of equal numbers, whether its cross-references are right, wrong or missing."""

    def __init__(self, data: bytes):
        self.objects: dict[int, object] = {}
        self.trailers: list[dict] = []
        at = 0
        while m := _OBJECT.search(data, at):
            try:
                own, at = value(data, m.end())
                own, at = self._stream(data, own, at)
            except (ValueError, RecursionError):
                at = m.end()
                continue
            self.objects[int(m[1])] = own
        for m in re.finditer(rb"\btrailer\b", data):
            try:
                self.trailers.append(value(data, m.end())[0])
            except ValueError:
                continue
        for own in [x for x in self.objects.values() if isinstance(x, Stream)]:
            if own.get("Type") == "XRef":
                self.trailers.append(own)
            elif own.get("Type") == "ObjStm":
                self._unpack(own)

    def _stream(self, data: bytes, own: object, at: int) -> tuple[object, int]:
        start = re.compile(rb"\s*stream(?:\r\n|\n|\r)").match(data, at)
        if not isinstance(own, dict) or not start:
            return own, at
        size = own.get("Length")
        end = start.end() + size if type(size) is int and re.compile(rb"\s*endstream").match(data, start.end() + size) else data.find(b"endstream", start.end())
        end = end if end >= 0 else len(data)
        made = Stream(own)
        made.raw = data[start.end() : end]
        return made, end

    def _unpack(self, own: Stream) -> None:
        """The objects that a stream holds; those that stand in the file itself are newer."""
        try:
            data, first = self.bytes_of(own), self.of(own["First"])
            numbers = data[:first].split()
            for n, offset in zip(numbers[::2], numbers[1::2], strict=True):
                self.objects.setdefault(int(n), value(data, first + int(offset))[0])
        except (ValueError, KeyError, zlib.error):
            return

    def of(self, x: object) -> object:
        """What a reference stands for; anything else is itself."""
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(int(x))
        return None

    def bytes_of(self, own: object) -> bytes:
        """A stream's bytes, unpacked as far as its filters are known; zlib.error where they are broken from the start."""
        if not isinstance(own, Stream):
            return b""
        filters, parms = self.of(own.get("Filter")), self.of(own.get("DecodeParms"))
        filters, parms = (x if isinstance(x, list) else [x] for x in (filters, parms))
        data = own.raw
        for i, f in enumerate(map(self.of, filters)):
            how = self.of(parms[i]) if i < len(parms) else None
            if f == "FlateDecode":
                unpack = zlib.decompressobj()
                data = unpack.decompress(data)
            elif f == "ASCIIHexDecode":
                data = value(b"<" + data.split(b">")[0] + b">", 0)[0]
            elif f is not None:
                return b""
            if isinstance(how, dict) and self.of(how.get("Predictor", 1)) >= 10:
                data = _unpredict(data, self.of(how.get("Columns", 1)), self.of(how.get("Colors", 1)))
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in order, with what they inherit; of a file without a tree all pages by number."""
        root = next((self.of(t["Root"]) for t in reversed(self.trailers) if isinstance(self.of(t.get("Root")), dict)), None)
        root = root or next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), {})
        found = list(self._kids(self.of(root.get("Pages")), {}, 0, set()))
        yield from found or [x for _, x in sorted(self.objects.items()) if isinstance(x, dict) and x.get("Type") == "Page"]

    def _kids(self, node: object, above: dict, depth: int, seen: set[int]) -> Iterator[dict]:
        if not isinstance(node, dict) or depth > DEEPEST or id(node) in seen:
            return
        seen.add(id(node))
        own = above | {k: v for k, v in node.items() if k in ("Resources",)}
        kids = self.of(node.get("Kids"))
        if not isinstance(kids, list):
            yield own | node
            return
        for kid in kids:
            yield from self._kids(self.of(kid), own, depth + 1, seen)


def _after(first: str, steps: int) -> str:
    """The text so many steps after the first one of a range: its last character counts on; half of a surrogate pair is no character."""
    code = min(0x10FFFF, ord(first[-1]) + steps)
    return first[:-1] + ("\ufffd" if 0xD800 <= code < 0xE000 else chr(code))


class Font:
    """From a shown string's bytes to text: the font's own map, or the encoding that plain fonts have.

    Of a map's wide ranges only the bounds are kept, so that a font costs what its map is long, not what its ranges cover.
    """

    def __init__(self, file: File, font: object):
        font = font if isinstance(font, dict) else {}
        self.width, self.codes = 2 if font.get("Subtype") == "Type0" else 1, {}
        self.wide: list[tuple[int, int, str]] = []  # the last first; codes met after a range, or shown before, are in codes
        made = file.of(font.get("ToUnicode"))
        if isinstance(made, Stream):
            self._read(file.bytes_of(made))
        self.plain = self.width == 1

    def _read(self, data: bytes) -> None:
        for m in re.finditer(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", data):
            self.width = max(1, len(m[1]) // 2)
        text = lambda raw: bytes.fromhex(raw.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            self.codes |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{2})+)>", block)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, b, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<((?:[0-9A-Fa-f]{2})+)>|\[(.*?)\])", block, re.S):
                low, high = int(a, 16), int(b, 16)
                if many:
                    self.codes |= dict(zip(range(low, high + 1), map(text, re.findall(rb"<([0-9A-Fa-f]+)>", many)), strict=False))
                elif high - low < NARROW:
                    first = text(to)
                    self.codes |= {c: _after(first, c - low) for c in range(low, high + 1)}
                else:
                    self.codes = {c: t for c, t in self.codes.items() if not low <= c <= high}
                    self.wide.insert(0, (low, high, text(to)))

    def _of_range(self, code: int) -> str | None:
        for low, high, first in self.wide:
            if low <= code <= high:
                return self.codes.setdefault(code, _after(first, code - low))
        return None

    def text(self, raw: bytes) -> str:
        out = []
        for at in range(0, len(raw) - self.width + 1, self.width):
            code = int.from_bytes(raw[at : at + self.width], "big")
            out.append(self.codes.get(code) or self._of_range(code) or (bytes([code]).decode("cp1252", "replace") if self.plain else "�"))
        return "".join(out)


def page_text(file: File, page: dict) -> str:
    """A page's text in the order of its operators: a line for each baseline."""
    contents = file.of(page.get("Contents"))
    data = b"\n".join(file.bytes_of(file.of(c)) for c in (contents if isinstance(contents, list) else [contents]))
    resources = file.of(page.get("Resources"))
    named = file.of(resources.get("Font")) if isinstance(resources, dict) else {}
    fonts: dict[str, Font] = {}
    out, stack, font, at, line = [], [], Font(file, None), 0, None

    def show(raw: object) -> None:
        if isinstance(raw, bytes) and not isinstance(raw, Operator):
            out.append(font.text(raw))

    while True:
        try:
            x, at = value(data, at)
        except ValueError:
            break
        if not isinstance(x, Operator):
            stack.append(x)
            continue
        if x == b"Tf" and len(stack) >= 2 and isinstance(stack[-2], Name):
            if stack[-2] not in fonts:
                fonts[stack[-2]] = Font(file, file.of((named or {}).get(stack[-2])))
            font = fonts[stack[-2]]
        elif x in (b"Td", b"TD") and len(stack) >= 2:
            out.append("\n" if stack[-1] else " ")
        elif x == b"T*":
            out.append("\n")
        elif x == b"Tm" and len(stack) >= 6:
            out.append(" " if line == stack[-1] else "\n")
            line = stack[-1]
        elif x == b"Tj" and stack:
            show(stack[-1])
        elif x in (b"'", b'"') and stack:
            out.append("\n")
            show(stack[-1])
        elif x == b"TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, bytes):
                    show(part)
                elif isinstance(part, int | float) and part < -WORD_GAP:
                    out.append(" ")
        elif x == b"ET":
            out.append("\n")
            line = None
        elif x == b"ID":  # an image in the content: its bytes are no operators
            end = re.compile(rb"\sEI\b").search(data, at)
            at = end.end() if end else len(data)
        stack.clear()
    lines = (re.sub(r"[ \t]+", " ", s).strip() for s in "".join(out).split("\n"))
    return "\n".join(s for s in lines if s)


def read(data: bytes) -> tuple[list[str], str | None]:
    """(the pages' texts, error): what is wrong with a file that is none, is encrypted, or has no page."""
    if not data[:1024].lstrip().startswith(b"%PDF-"):
        return [], "not a PDF file"
    file = File(data)
    if any("Encrypt" in t for t in file.trailers):
        return [], "encrypted"
    texts, error = [], None
    for page in file.pages():
        try:
            texts.append(page_text(file, page))
        except zlib.error as e:
            texts.append("")
            error = f"page {len(texts)}: {e}"
    return texts, error or (None if texts else "no pages")


def pdf_texts(files: DataFrame, content: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Kept columns and pages (the texts, in order), text (of all pages, a line break between them) and error of each file.

    A file that is no PDF, is encrypted or has no page has no pages; a page that is broken has an empty text, and error says which was the last. Null
    files count as empty.
    """

    @F.pandas_udf("struct<pages:array<string>,error:string>")
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(x or b"") for x in data], columns=["pages", "error"])

    made = files.select(*keep, run(content).alias("__p"))
    return made.select(*keep, "__p.pages", F.array_join("__p.pages", "\n").alias("text"), "__p.error")
