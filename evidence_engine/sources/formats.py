"""Readers of single files: bytes in, located passages out. They run inside mapInPandas, one file at a time.

Each reader returns (file type, page count, character count, passages); a passage is a dict with suffix (of its id), page, text,
begin, end, location_type and location.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

# Fixed values.
CHUNK = 300
SENTENCE = re.compile(r"[A-Z0-9$\"'(][^.?!]*[.?!]+(?=\s|$)|\S[^.?!]*$")
NUMBERED = re.compile(r"(?:section\s+\d+|[0-9]+[.)]|rule\s+\d+|article\s+\d+)", re.IGNORECASE)
HEADING = re.compile(r"#{1,6}\s+(.+)")
ELEMENTS = ("article", "section", "h1", "h2", "h3", "p", "li", "tr")
DROPPED = ("script", "style", "meta", "noscript", "iframe", "object", "embed", "link", "applet", "svg")
EMPTY_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
JSON_DEPTH, JSON_PASSAGES, SMALL_OBJECT = 20, 1000, 6

Read = tuple[str, int, int, list[dict]]


def decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def passage(suffix: str, text: str, kind: str, location: str, page: int = 1, begin: int | None = None, end: int | None = None) -> dict:
    return {"suffix": suffix, "page": page, "text": text, "begin": begin, "end": end, "location_type": kind, "location": location}


def sentences(text: str) -> list[tuple[str, int]]:
    """(sentence, end) of a paragraph. Matches of 10 characters or fewer are left out; without any the whole text is one."""
    found = [(m[0].strip(), m.end()) for m in SENTENCE.finditer(text)]
    found = [(s, e) for s, e in found if len(s) > 10]
    return found or ([(text.strip(), len(text))] if text.strip() else [])


def paragraphs(text: str) -> list[str]:
    """Lines joined by spaces; an empty line ends a paragraph, a numbered heading begins one."""
    groups: list[list[str]] = [[]]
    for line in map(str.strip, text.splitlines()):
        if not line or NUMBERED.match(line):
            groups.append([])
        if line:
            groups[-1].append(line)
    return [" ".join(g) for g in groups if g]


def packed(paragraph: str, target: int = CHUNK) -> list[tuple[str, int]]:
    """(text, offset) of a paragraph's passages: whole, or sentences gathered until they have the target's characters."""
    if len(paragraph) <= target:
        return [(paragraph, 0)]
    out, held, offset = [], [], 0
    for sentence, end in sentences(paragraph):
        held.append(sentence)
        if len(" ".join(held)) >= target:
            out.append((" ".join(held), offset))
            held, offset = [], end
    return out + [(" ".join(held), offset)] * bool(held)


def prose(text: str, page: int, kind: str, location: Callable[[int], str], first: int = 1) -> list[dict]:
    """Passages of running text, numbered on from first within a page."""
    out, at = [], 0
    for k, paragraph in enumerate(paragraphs(text), 1):
        found = text.find(paragraph, at)
        begin = at if found < 0 else found
        for part, offset in packed(paragraph):
            lo = begin + offset
            out.append(passage(f"P{page}-C{first + len(out):03d}", part, kind, location(k), page, lo, lo + len(part)))
        at = begin + len(paragraph) + 1
    return out


def read_text(data: bytes) -> Read:
    text = decoded(data)
    return "txt", 1, len(text), prose(text, 1, "paragraph", lambda k: f"Paragraph {k}")


def read_csv(data: bytes) -> Read:
    out, header = [], []
    for n, row in enumerate(csv.reader(io.StringIO(decoded(data))), 1):
        filled = [c.strip() for c in row if c.strip()]
        if not filled:
            continue
        where = f"Row {n}"
        if n == 1:
            header, text, where = filled, "Columns: " + ", ".join(filled), "Row 1 (Header)"
        elif header and len(header) == len(row):
            text = " | ".join(f"{h}: {v}" for h, v in zip(header, row) if v.strip())
        else:
            text = " | ".join(filled)
        out.append(passage(f"ROW{n:04d}", text, "row", where))
    return "csv", 1, sum(len(p["text"]) for p in out), out


def read_markdown(data: bytes) -> Read:
    sections: list[tuple[str, list[str]]] = [("Document Root", [])]
    for line in filter(None, map(str.strip, decoded(data).splitlines())):
        heading = HEADING.fullmatch(line)
        if heading:
            sections.append((heading[1].strip(), []))
        sections[-1][1].append(line)
    out = []
    for title, lines in sections:
        if lines:
            out.append(passage(f"MD{len(out) + 1:03d}", "\n".join(lines), "heading", f"Section '{title}'"))
    return "md", 1, sum(len(p["text"]) for p in out), out


def leaves(node: object, path: str = "$", depth: int = 1) -> Iterator[tuple[str, str]]:
    """(path, text) of small flat objects and of scalars, depth first."""
    if depth > JSON_DEPTH:
        return
    if isinstance(node, dict) and not (len(node) <= SMALL_OBJECT and not any(isinstance(v, (dict, list)) for v in node.values())):
        for k, v in node.items():
            yield from leaves(v, f"{path}.{k}", depth + 1)
    elif isinstance(node, dict):
        yield path, f"Path {path}: " + " | ".join(f"{k}: {v}" for k, v in node.items())
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from leaves(v, f"{path}[{i}]", depth + 1)
    else:
        yield path, f"{path}: {node}"


def read_json(data: bytes) -> Read:
    out = []
    for path, text in leaves(json.loads(data.decode("utf-8", "replace"))):
        if len(out) == JSON_PASSAGES:
            break
        out.append(passage(f"JSON{len(out) + 1:03d}", text, "json_path", path))
    return "json", 1, sum(len(p["text"]) for p in out), out


class Elements(HTMLParser):
    """Texts of semantic elements in document order; an element's text includes that of the elements in it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None]] = []
        self.silent = 0
        self.all: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in EMPTY_TAGS:
            return
        here = None
        if tag in ELEMENTS and not self.silent:
            named = dict(attrs)
            here = {"tag": tag, "name": named.get("id") or next(iter((named.get("class") or "").split()), ""), "text": []}
            self.found.append(here)
        self.silent += tag in DROPPED
        self.open.append((tag, here))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while True:
                last, _ = self.open.pop()
                self.silent -= last in DROPPED
                if last == tag:
                    break

    def handle_data(self, data: str) -> None:
        text = data.strip()
        if text and not self.silent:
            self.all.append(text)
            for _, here in self.open:
                if here is not None:
                    here["text"].append(text)


def read_html(data: bytes) -> Read:
    parser = Elements()
    parser.feed(decoded(data))
    parser.close()
    out = []
    for e in parser.found:
        text = "".join(e["text"])
        if len(text) > 15:
            out.append(passage(f"HTML{len(out) + 1:03d}", text, "element", f"<{e['tag']}>" + (f" #{e['name']}" if e["name"] else "")))
    if not out and parser.all:
        return read_text("\n".join(parser.all).encode())
    return "html", 1, sum(len(p["text"]) for p in out), out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ElementTree.Element, breaks: bool = False) -> str:
    return "".join((e.text or "") if _local(e.tag) == "t" else "\n" if breaks and _local(e.tag) == "br" else "\t" if _local(e.tag) == "tab" else "" for e in node.iter())


def _numbered(names: list[str], pattern: str) -> list[str]:
    hits = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(hits)]


def read_docx(data: bytes) -> Read:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")).iter() if _local(e.tag) == "body")
    out = []
    for k, p in enumerate((e for e in body if _local(e.tag) == "p"), 1):
        if text := _texts(p, True).strip():
            out.append(passage(f"PARA{k:03d}-C{len(out) + 1:03d}", text, "paragraph", f"Paragraph {k}"))
    for t, table in enumerate((e for e in body if _local(e.tag) == "tbl"), 1):
        for r, row in enumerate((e for e in table if _local(e.tag) == "tr"), 1):
            cells = ["\n".join(_texts(p) for p in c if _local(p.tag) == "p").strip() for c in row if _local(c.tag) == "tc"]
            if any(cells):
                out.append(passage(f"TBL{t}-R{r}", " | ".join(filter(None, cells)), "table", f"Table {t}, Row {r}"))
    return "docx", 1, sum(len(p["text"]) for p in out), out


def read_pptx(data: bytes) -> Read:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        for k, name in enumerate(slides, 1):
            frames = [e for e in ElementTree.fromstring(z.read(name)).iter() if _local(e.tag) == "txBody"]
            lines = [_texts(p).strip() for f in frames for p in f if _local(p.tag) == "p"]
            if text := "\n".join(filter(None, lines)):
                out.append(passage(f"SLIDE{k:03d}-C{len(out) + 1:03d}", text, "slide", f"Slide {k}", k))
    return "pptx", max(1, len(slides)), sum(len(p["text"]) for p in out), out


def _cell(c: ElementTree.Element, shared: list[str]) -> object:
    value = next((e.text or "" for e in c if _local(e.tag) == "v"), None)
    kind = c.get("t")
    if kind == "inlineStr":
        return _texts(c)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return value == "1"
    if kind in ("str", "e"):
        return value
    number = float(value)
    return int(number) if re.fullmatch(r"-?\d+", value) else number


def _grid(sheet: ElementTree.Element, shared: list[str]) -> Iterator[tuple[int, list]]:
    rows: dict[int, dict[int, object]] = {}
    for n, row in enumerate((e for e in sheet.iter() if _local(e.tag) == "row"), 1):
        cells = rows.setdefault(int(row.get("r") or n), {})
        for k, c in enumerate((e for e in row if _local(e.tag) == "c"), 1):
            column = 0
            for ch in re.match(r"[A-Z]*", c.get("r") or "")[0]:
                column = 26 * column + ord(ch) - 64
            cells[column or k] = _cell(c, shared)
    width = max((max(c) for c in rows.values() if c), default=0)
    for n in sorted(rows):
        yield n, [rows[n].get(k) for k in range(1, width + 1)]


def read_xlsx(data: bytes) -> Read:
    out, chars = [], 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [_texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(e.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        sheets = _numbered(names, r"xl/worksheets/sheet(\d+)\.xml")
        for s, (title, name) in enumerate(zip(titles, sheets), 1):
            header: list[str] = []
            for n, row in _grid(ElementTree.fromstring(z.read(name)), shared):
                filled = [str(v).strip() for v in row if v is not None and str(v).strip()]
                if not filled:
                    continue
                if n == 1:
                    header = filled
                    out.append(passage(f"S{s}-R1", f"Sheet '{title}' Headers: {', '.join(header)}", "cell", f"{title}!Row 1", s))
                    continue
                pairs = [f"{h}: {v}" for h, v in zip(header, row) if v is not None] if header and len(header) == len(row) else filled
                text = f"[{title}] " + " | ".join(pairs)
                chars += len(text)
                out.append(passage(f"S{s}-R{n}", text, "cell", f"{title}!Row {n}", s))
    return "xlsx", max(1, len(titles)), chars, out


_OBJECT = re.compile(rb"(?P<n>\d+)\s+\d+\s+obj\b(?P<body>.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"^(?P<head>.*?>>)\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.DOTALL)
_LOOSE = re.compile(rb"<<(?P<head>.*?)>>\s*stream\r?\n(?P<body>.*?)\r?\n?endstream", re.DOTALL)
_REF = rb"(\d+)\s+\d+\s+R\b"
_LITERAL = rb"\((?:\\.|[^\\()])*\)"
_HEX = rb"<[0-9A-Fa-f\s]*>"
_SHOWN = re.compile(rb"/(?P<font>[^\s/\[\]()<>]+)\s+[-\d.]+\s+Tf\b|(?P<one>" + _LITERAL + b"|" + _HEX + rb")\s*(?P<op>Tj|'|\")|\[(?P<array>(?:" + _LITERAL + b"|" + _HEX + rb"|[^\]()])*)\]\s*TJ|(?P<line>T\*|T[dDm]\b|ET\b)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Thousandths of an em that a TJ array goes on by where a space is meant.
_GAP = -180


def _unescaped(raw: bytes) -> bytes:
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1][-1:] == b"\n" else _ESCAPES.get(m[1], m[1]), raw, flags=re.DOTALL)


def _shown(token: bytes) -> bytes:
    """The character codes of a string, written plainly or in hexadecimal."""
    if token[:1] == b"(":
        return _unescaped(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


class Pdf:
    """The objects of a PDF file: those that stand in it and those in its object streams. Encryption is not read."""

    def __init__(self, data: bytes):
        self.heads: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        for m in _OBJECT.finditer(data):
            stream = _STREAM.match(m["body"])
            self.heads[int(m["n"])] = stream["head"] if stream else m["body"]
            if stream:
                self.streams[int(m["n"])] = self.inflated(stream["head"], stream["body"])
        for n, head in list(self.heads.items()):
            first = re.search(rb"/First\s+(\d+)", head)
            if b"/ObjStm" in head and first:
                packed, at = self.streams.get(n, b""), int(first[1])
                places = [int(x) for x in packed[:at].split()]
                for number, lo, hi in zip(places[::2], places[1::2], [*places[3::2], len(packed) - at]):
                    self.heads.setdefault(number, packed[at + lo : at + hi])

    @staticmethod
    def inflated(head: bytes, body: bytes) -> bytes:
        if b"FlateDecode" not in head:
            return body
        try:
            return zlib.decompressobj().decompress(body)
        except zlib.error:
            return b""

    def value(self, head: bytes, key: bytes) -> bytes:
        """What a dictionary has under a key: a dictionary or array in it, or what a reference leads to."""
        m = re.search(rb"/" + key + rb"\s*(?:" + _REF + rb"|(?=[\[<]))", head)
        if not m:
            return b""
        if m[1]:
            return self.heads.get(int(m[1]), b"")
        depth, at = 0, m.end()
        for k in re.finditer(rb"<<|>>|\[|\]", head[at:]):
            depth += 1 if k[0] in (b"<<", b"[") else -1
            if not depth:
                return head[at : at + k.end()]
        return head[at:]

    def pages(self) -> list[int]:
        """Objects of the pages, in their order in the page tree."""
        found: list[int] = []
        seen: set[int] = set()

        def walk(n: int) -> None:
            if n in seen:
                return
            seen.add(n)
            head = self.heads.get(n, b"")
            if re.search(rb"/Type\s*/Pages\b", head):
                for kid in re.findall(_REF, self.value(head, b"Kids")):
                    walk(int(kid))
            elif re.search(rb"/Type\s*/Page\b", head):
                found.append(n)

        for n, head in self.heads.items():
            if re.search(rb"/Type\s*/Pages\b", head) and not re.search(rb"/Parent\b", head):
                walk(n)
        return found or [n for n, head in self.heads.items() if re.search(rb"/Type\s*/Page\b", head)]

    def fonts(self, page: int) -> dict[bytes, dict[bytes, str]]:
        """Character maps of a page's fonts by name; resources may be those of a node above."""
        head = self.heads[page]
        for _ in range(50):
            parent = re.search(rb"/Parent\s+" + _REF, head)
            if re.search(rb"/Resources\b", head) or not parent:
                break
            head = self.heads.get(int(parent[1]), b"")
        fonts = self.value(self.value(head, b"Resources"), b"Font")
        maps = {}
        for name, n in re.findall(rb"/([^\s/\[\]()<>]+)\s+" + _REF, fonts):
            to = re.search(rb"/ToUnicode\s+" + _REF, self.heads.get(int(n), b""))
            if to:
                maps[name] = character_map(self.streams.get(int(to[1]), b""))
        return maps

    def content(self, page: int) -> bytes:
        m = re.search(rb"/Contents\s*(?:" + _REF + rb"|\[([^\]]*)\])", self.heads[page])
        refs = [] if not m else [m[1]] if m[1] else re.findall(_REF, m[2])
        if len(refs) == 1 and int(refs[0]) not in self.streams:
            refs = re.findall(_REF, self.heads.get(int(refs[0]), b""))
        return b"\n".join(self.streams.get(int(n), b"") for n in refs)


def character_map(cmap: bytes) -> dict[bytes, str]:
    """Text by character code, from a font's map to Unicode."""
    said = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    hexed = rb"<\s*([0-9A-Fa-f]+)\s*>"
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {bytes.fromhex(a.decode()): said(b) for a, b in re.findall(hexed + rb"\s*" + hexed, block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, first, each in re.findall(hexed + rb"\s*" + hexed + rb"\s*(?:" + hexed + rb"|\[([^\]]*)\])", block):
            lo, hi, width = int(a, 16), min(int(b, 16), int(a, 16) + 0xFFFF), len(a) // 2
            texts = [said(x) for x in re.findall(hexed, each)] if each else [said(first)[:-1] + chr(ord(said(first)[-1]) + k) for k in range(hi - lo + 1)]
            out |= {(lo + k).to_bytes(width, "big"): t for k, t in enumerate(texts)}
    return out


def shown_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """The text that a content stream shows, line by line."""
    text, font = "", {}

    def told(token: bytes) -> str:
        codes = _shown(token)
        if not font:
            return codes.decode("cp1252", "replace")
        width = max(map(len, font))
        return "".join(font.get(codes[i : i + width], "") for i in range(0, len(codes), width))

    for x in _SHOWN.finditer(content):
        if x["font"] is not None:
            font = fonts.get(x["font"], {})
        elif x["line"] is not None:
            text += "\n" if text and not text.endswith("\n") else ""
        elif x["array"] is not None:
            for token in re.findall(_LITERAL + b"|" + _HEX + rb"|-?[\d.]+", x["array"]):
                text += told(token) if token[:1] in b"(<" else " " if float(token) < _GAP and not text.endswith((" ", "\n")) else ""
        else:
            text += ("\n" if x["op"] != b"Tj" else "") + told(x["one"])
    return text.strip()


def pdf_pages(data: bytes) -> list[str]:
    """The text of every page of a PDF, in order; of a file whose pages lead to none, that of every stream that shows text."""
    pdf = Pdf(data)
    pages = [shown_text(pdf.content(n), pdf.fonts(n)) for n in pdf.pages()]
    if any(pages):
        return pages
    streams = [pdf.inflated(m["head"], m["body"]) for m in _LOOSE.finditer(data)]
    return [shown_text(x, {}) for x in streams if b"BT" in x] or pages


def read_pdf(data: bytes) -> Read:
    pages = pdf_pages(data)
    out = [p for n, text in enumerate(pages, 1) for p in prose(text, n, "page", lambda _, n=n: f"Page {n}")]
    return "pdf", max(1, len(pages)), sum(map(len, pages)), out


READERS: dict[str, Callable[[bytes], Read]] = {
    "pdf": read_pdf, "docx": read_docx, "pptx": read_pptx, "xlsx": read_xlsx, "csv": read_csv, "md": read_markdown, "markdown": read_markdown,
    "json": read_json, "html": read_html, "htm": read_html, "txt": read_text,
}
