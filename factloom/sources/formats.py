"""Readers of file formats: each turns a file's bytes into records, and a registry picks the reader that bids most.

A record is (kind, text, fields): a place in the file is in fields (line, sheet, row, path, member). Files are read as Spark's binary files
and parsed where they are read, one at a time, so a task holds one file of at most `most_bytes`; a larger file gives one record of kind
"too_large", an unreadable one "unreadable", and an empty one no record. No file stops a scan.
"""
from __future__ import annotations

import csv
import email
import email.policy
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, format string, place int, kind string, text string, fields map<string,string>"
Record = tuple[str, str, dict[str, str]]
#: An archive is opened to this depth, to this many members and bytes in all; what is beyond is named by a record of kind "not_opened".
DEEPEST, MOST_MEMBERS, MOST_OPENED = 3, 1000, 256 << 20


def decoded(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 with replacement characters; line ends as \\n."""
    text = data.decode("utf-16", "replace") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data.decode("utf-8-sig", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _flat(text: str | None) -> str:
    return " ".join((text or "").split())


def plain(data: bytes) -> Iterator[Record]:
    """Paragraphs, or lines with a speaker: '[00:01:02] Name: text'."""
    said = re.compile(r"\s*(?:\[(\d{1,2}:\d\d(?::\d\d)?)\]\s*)?([A-Z][\w .'-]{0,40}):\s+(.+)")
    for i, block in enumerate(re.split(r"\n\s*\n", decoded(data))):
        lines = [m for m in map(said.fullmatch, block.strip().split("\n")) if m]
        if lines and len(lines) == len(block.strip().split("\n")):
            for m in lines:
                yield "utterance", m[3].strip(), {"speaker": m[2], "paragraph": str(i)} | ({"clock": m[1]} if m[1] else {})
        elif _flat(block):
            yield "paragraph", _flat(block), {"paragraph": str(i)}


def cues(data: bytes) -> Iterator[Record]:
    """Cues of VTT and SRT with start, end and speaker (<v Name> or 'Name: ')."""
    head = re.compile(r"^\s*((?:\d+:)?\d+:\d+[.,]\d+)\s*-->\s*((?:\d+:)?\d+:\d+[.,]\d+)")
    for block in re.split(r"\n\s*\n", decoded(data)):
        lines = block.strip().split("\n")
        at = next((i for i, x in enumerate(lines) if head.match(x)), None)
        if at is None:
            continue
        span, text = head.match(lines[at]), _flat(" ".join(lines[at + 1 :]))
        who = re.match(r"<v(?:\.\S+)?\s+([^>]+)>|([A-Z][\w .'-]{0,40}):\s", text)
        body = _flat(re.sub(r"<[^>]*>", "", text[who.end() :] if who else text))
        yield "utterance", body, {"start": span[1].replace(",", "."), "end": span[2].replace(",", ".")} | ({"speaker": (who[1] or who[2]).strip()} if who else {})


def _rows(rows: list[list[str]], where: dict[str, str]) -> Iterator[Record]:
    """Rows under the first row with two or more filled cells and no number; a row whose first filled cell is a total is of kind total."""
    header: list[str] | None = None
    for i, row in enumerate(rows):
        cells = [_flat(x) for x in row]
        filled = [x for x in cells if x]
        if not filled:
            continue
        if header is None and len(filled) > 1 and not any(re.fullmatch(r"[$\d.,%()-]+", x) for x in filled):
            header = [x or f"column_{j + 1}" for j, x in enumerate(cells)]
            yield "header", " | ".join(filled), where | {"row": str(i + 1)}
            continue
        names = header or []
        named = {names[j] if j < len(names) else f"column_{j + 1}": x for j, x in enumerate(cells) if x}
        kind = "total" if re.match(r"(grand |sub)?total\b", filled[0].lower()) else "row"
        yield kind, " | ".join(filled), where | {"row": str(i + 1)} | named


def table(data: bytes) -> Iterator[Record]:
    """Rows of CSV or TSV; the delimiter is the one of , ; tab | that its first line has most often."""
    text = decoded(data)
    first = text.split("\n", 1)[0]
    yield from _rows(list(csv.reader(io.StringIO(text), delimiter=max(",;\t|", key=first.count))), {})


def _message(m) -> Iterator[Record]:
    """A header record, and each line of the body as authored or quoted; attachments by name."""
    names = {"from": "From", "to": "To", "subject": "Subject", "date": "Date", "message_id": "Message-ID", "in_reply_to": "In-Reply-To", "references": "References"}
    yield "mail", _flat(str(m.get("Subject", ""))), {k: _flat(str(m[v])) for k, v in names.items() if m[v]}
    body = m.get_body(("plain", "html"))
    if body is not None:
        text = body.get_content()
        lines = [r[1] for r in page(text.encode())] if body.get_content_subtype() == "html" else text.split("\n")
        older = False
        for i, line in enumerate(lines):
            older = older or bool(re.match(r"\s*(-+\s*Original Message|On .{5,200} wrote:\s*$)", line))
            if _flat(line):
                yield "quoted" if older or line.lstrip().startswith(">") else "authored", _flat(line.lstrip("> ")), {"line": str(i + 1)}
    for part in m.iter_attachments():
        yield "attachment", part.get_filename() or "", {"type": part.get_content_type()}


def mail(data: bytes) -> Iterator[Record]:
    yield from _message(email.message_from_bytes(data, policy=email.policy.default))


def mailbox(data: bytes) -> Iterator[Record]:
    """Messages of an mbox, which start at 'From ' after an empty line; message is their number."""
    for i, part in enumerate(re.split(rb"(?:^|\r?\n\r?\n)From [^\r\n]*\r?\n", data)[1:]):
        for kind, text, fields in mail(re.sub(rb"(?m)^>(>*From )", rb"\1", part)):
            yield kind, text, fields | {"message": str(i + 1)}


def markdown(data: bytes) -> Iterator[Record]:
    """Headings, list items, table rows, code and paragraphs, each with the heading above it."""
    section, code, words = "", None, []

    def paragraph():
        if words:
            yield "paragraph", _flat(" ".join(words)), {"section": section}
            words.clear()

    for i, line in enumerate(decoded(data).split("\n")):
        where = {"section": section, "line": str(i + 1)}
        if line.lstrip().startswith("```"):
            yield from paragraph()
            if code is not None:
                yield "code", "\n".join(code), where
            code = [] if code is None else None
        elif code is not None:
            code.append(line)
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            yield from paragraph()
            section = m[2]
            yield "heading", section, {"level": str(len(m[1])), "line": str(i + 1)}
        elif m := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", line):
            yield from paragraph()
            yield "item", _flat(m[1]), where
        elif line.lstrip().startswith("|"):
            yield from paragraph()
            cells = [_flat(x) for x in line.strip().strip("|").split("|")]
            if not all(re.fullmatch(r":?-+:?", x) for x in cells):
                yield "row", " | ".join(cells), where
        elif line.strip():
            words.append(line)
        else:
            yield from paragraph()
    yield from paragraph()
    if code:
        yield "code", "\n".join(code), {"section": section}


class _Page(HTMLParser):
    """Text by block: an inner block ends the outer one's text, and what follows it goes on as a text of the outer one."""

    BLOCKS = {"p": "paragraph", "li": "item", "td": "cell", "th": "cell", "title": "title", "div": "paragraph", "body": "paragraph", "pre": "code", "blockquote": "paragraph"} | {f"h{i}": "heading" for i in range(1, 7)}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.text, self.hidden, self.found = [], [], 0, []

    def flush(self):
        if text := _flat("".join(self.text)):
            self.found.append((self.BLOCKS[self.open[-1]] if self.open else "paragraph", text, {"tag": self.open[-1]} if self.open else {}))
        self.text.clear()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.BLOCKS:
            self.flush()
            self.open.append(tag)
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.open:
            self.flush()
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)


def page(data: bytes) -> Iterator[Record]:
    """Blocks of HTML without scripts and styles; text of nested blocks is given once, by the innermost."""
    parser = _Page()
    parser.feed(decoded(data))
    parser.close()
    parser.flush()
    yield from parser.found


def rich_text(data: bytes) -> Iterator[Record]:
    """Paragraphs of RTF, without groups that hold no text."""
    out, stack, skip, i, text = [], [], False, 0, data.decode("latin-1")
    step = re.compile(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?.?|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+|\\", re.S)
    silent = ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator")
    while i < len(text):
        m = step.match(text, i)
        i = m.end()
        if m[6] == "{":
            stack.append(skip)
        elif m[6] == "}":
            skip = stack.pop() if stack else False
        elif m[3] in silent or m[5] == "*":
            skip = True
        elif not skip:
            word = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t"}.get(m[3], "")
            out.append(bytes.fromhex(m[1]).decode("cp1252", "replace") if m[1] else chr(int(m[2]) % 65536) if m[2] else word or (m[5] if m[5] in ("\\", "{", "}") else "") or m[7] or "")
    whole = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    for i, line in enumerate(x for x in whole.split("\n") if _flat(x)):
        yield "paragraph", _flat(line), {"paragraph": str(i)}


def calendar(data: bytes) -> Iterator[Record]:
    """Events of iCalendar: the summary, with the other properties as fields."""
    lines, now = re.sub(r"\n[ \t]", "", decoded(data)).split("\n"), None
    for line in lines:
        name, _, value = line.partition(":")
        name = name.split(";")[0].strip().upper()
        if (name, value.strip().upper()) == ("BEGIN", "VEVENT"):
            now = {}
        elif name == "END" and value.strip().upper() == "VEVENT" and now is not None:
            yield "event", now.get("summary", ""), now
            now = None
        elif now is not None and name and value:
            value = re.sub(r"\\([nN,;\\])", lambda m: "\n" if m[1] in "nN" else m[1], value)
            now[name.lower()] = f"{now[name.lower()]}; {value}" if name.lower() in now else value


def leaves(data: bytes) -> Iterator[Record]:
    """Leaves of JSON, or of each line of JSON lines, depth first, with their path; null leaves are empty texts."""
    text = decoded(data)
    try:
        values = [("$", json.loads(text))]
    except ValueError:
        values = [(f"${i}", json.loads(x)) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    stack = values[::-1]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{at}.{k}", v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{at}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            yield "leaf", "" if value is None else value if isinstance(value, str) else json.dumps(value), {"path": at}


def _tag(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _part(z: zipfile.ZipFile, name: str):
    if z.getinfo(name).file_size > MOST_OPENED:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def _said(e, tags: tuple[str, ...]) -> str:
    return _flat("".join((x.text or "") if _tag(x) in tags else " " for x in e.iter() if _tag(x) in (*tags, "tab", "br", "s", "line-break")))


def word(data: bytes) -> Iterator[Record]:
    """Headings, paragraphs and table rows of DOCX; deleted text of tracked changes is of kind deleted and in no other record."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml")
    section, place = "", 0

    def walk(e):
        for x in e:
            if _tag(x) in ("p", "tbl"):
                yield x
            elif _tag(x) not in ("sectPr",):
                yield from walk(x)

    for x in walk(body):
        place += 1
        where = {"section": section, "place": str(place)}
        if gone := _said(x, ("delText",)):
            yield "deleted", gone, where
        if _tag(x) == "tbl":
            for i, row in enumerate(r for r in x.iter() if _tag(r) == "tr"):
                cells = [_said(c, ("t",)) for c in row if _tag(c) == "tc"]
                if any(cells):
                    yield "row", " | ".join(cells), where | {"row": str(i + 1)}
        elif text := _said(x, ("t",)):
            style = next((_attr(s, "val") or "" for s in x.iter() if _tag(s) == "pStyle"), "")
            if re.match(r"(?i)heading|title", style):
                section = text
                yield "heading", text, {"place": str(place)}
            else:
                yield "paragraph", text, where


def slides(data: bytes) -> Iterator[Record]:
    """Paragraphs of PPTX by slide, and its notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [(int(m[2]), m[1], n) for n in z.namelist() if (m := re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)(\d+)\.xml", n))]
        for number, of, name in sorted(names, key=lambda x: (x[0], x[1] != "slides/slide")):
            for p in _part(z, name).iter():
                if _tag(p) == "p" and (text := _said(p, ("t",))):
                    yield "paragraph" if of.startswith("slides") else "note", text, {"slide": str(number)}


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref or "")[0]:
        n = n * 26 + ord(c) - 64
    return n


def workbook(data: bytes) -> Iterator[Record]:
    """Rows of each sheet of XLSX, under its header; cells are their stored values."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_said(s, ("t",)) for s in _part(z, "xl/sharedStrings.xml") if _tag(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        links = {_attr(r, "Id"): _attr(r, "Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
        for sheet in (s for s in _part(z, "xl/workbook.xml").iter() if _tag(s) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.startswith("{") and k.endswith("}id"))]
            rows = []
            for row in (r for r in _part(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}").iter() if _tag(r) == "row"):
                cells: list[str] = []
                for c in (c for c in row if _tag(c) == "c"):
                    cells += [""] * ((_column(c.get("r")) or len(cells) + 1) - 1 - len(cells))
                    value = next((v.text or "" for v in c if _tag(v) == "v"), "")
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else _said(c, ("t",)) if c.get("t") == "inlineStr" else value)
                rows += [[]] * (int(row.get("r", len(rows) + 1)) - 1 - len(rows)) + [cells]
            yield from _rows(rows, {"sheet": sheet.get("name", "")})


def open_document(data: bytes) -> Iterator[Record]:
    """Headings and paragraphs of ODT, rows of ODS by sheet; repeated empty cells and rows are not spelt out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _part(z, "content.xml")
    text = lambda e: _flat("".join(e.itertext()))
    inside: set[int] = set()
    for e in root.iter():
        if _tag(e) == "table":
            rows = []
            for r in (r for r in e.iter() if _tag(r) == "table-row"):
                cells = []
                for c in (c for c in r if _tag(c) == "table-cell"):
                    cells += [text(c)] * (min(int(_attr(c, "number-columns-repeated") or 1), 1000) if text(c) else 1)
                rows.append(cells)
            inside |= {id(x) for x in e.iter()}
            yield from _rows(rows, {"sheet": _attr(e, "name") or ""})
        elif _tag(e) in ("h", "p") and id(e) not in inside and text(e):
            yield "heading" if _tag(e) == "h" else "paragraph", text(e), {}


def archive(data: bytes, depth: int = 1, readers: dict | None = None) -> Iterator[Record]:
    """Records of the members of a ZIP, with the member's path; directories and macOS resource forks are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        opened = count = 0
        for info in z.infolist():
            if info.is_dir() or info.filename.startswith("__MACOSX/"):
                continue
            opened, count = opened + info.file_size, count + 1
            if depth > DEEPEST or count > MOST_MEMBERS or opened > MOST_OPENED or info.flag_bits & 1:
                yield "not_opened", info.filename, {"member": info.filename}
                continue
            for _, kind, text, fields in parse(info.filename, z.read(info), depth + 1, readers):
                yield kind, text, fields | {"member": info.filename + ("!" + fields["member"] if "member" in fields else "")}


#: Readers: name, parser, suffixes, and what the first bytes of a file must match to raise the bid.
READERS: dict[str, tuple[Callable, tuple[str, ...], bytes]] = {}


def register(name: str, parser: Callable[[bytes], Iterator[Record]], suffixes: tuple[str, ...], head: bytes = b"") -> None:
    """Adds a reader, or takes the place of the one of that name. head is a pattern for the first 4,096 bytes.

    read_files sends the readers of its session to the tasks.
    """
    READERS[name] = (parser, suffixes, head)


for _reader in (
    ("archive", archive, (".zip",), rb"PK\x03\x04"), ("word", word, (".docx",), rb"PK\x03\x04"), ("slides", slides, (".pptx",), rb"PK\x03\x04"), ("workbook", workbook, (".xlsx", ".xlsm"), rb"PK\x03\x04"),
    ("open_document", open_document, (".odt", ".ods"), rb"PK\x03\x04"), ("mail", mail, (".eml",), rb"(?i)(from|to|subject|date|received|message-id|return-path):"), ("mailbox", mailbox, (".mbox",), rb"From \S+"),
    ("table", table, (".csv", ".tsv"), rb""), ("markdown", markdown, (".md", ".markdown"), rb"#{1,6} "), ("page", page, (".html", ".htm"), rb"(?i)\s*<(!doctype html|html)"), ("rich_text", rich_text, (".rtf",), rb"\{\\rtf"),
    ("calendar", calendar, (".ics",), rb"BEGIN:VCALENDAR"), ("leaves", leaves, (".json", ".jsonl", ".ndjson"), rb"\s*[\[{]\s*[\"\[{\]}]"), ("cues", cues, (".vtt", ".srt"), rb"WEBVTT|\d+\r?\n\d+:\d+:\d+,"), ("plain", plain, (".txt", ".log"), rb""),
):
    register(*_reader)


def bids(path: str, data: bytes, readers: dict | None = None) -> list[tuple[str, float]]:
    """Readers by their bid, highest first, then by name: 0.6 for the suffix and 0.35 for the first bytes; plain text bids 0.1 on anything."""
    out = []
    for name, (_, suffixes, head) in (READERS if readers is None else readers).items():
        bid = 0.6 * path.lower().endswith(suffixes) + (0.35 if head and re.match(head, data[:4096]) else 0.0)
        out.append((name, round(max(bid, 0.1 if name == "plain" and b"\0" not in data[:4096] else 0.0), 2)))
    return sorted(((n, b) for n, b in out if b > 0), key=lambda x: (-x[1], x[0]))


def parse(path: str, data: bytes, depth: int = 1, readers: dict | None = None) -> list[tuple[str, str, str, dict[str, str]]]:
    """(format, kind, text, fields) of a file by the reader that bids most."""
    if not data:
        return []
    readers = READERS if readers is None else readers
    best = bids(path, data, readers)
    if not best:
        return [("none", "unreadable", "", {"error": "no reader"})]
    name = best[0][0]
    parser = readers[name][0]
    try:
        return [(name, *r) for r in (archive(data, depth, readers) if parser is archive else parser(data))]
    except Exception as e:  # whatever a damaged file makes a parser raise is told of, and the scan goes on
        return [(name, "unreadable", "", {"error": f"{type(e).__name__}: {e}"[:200]})]


def read_files(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """The records of all files under path, as SCHEMA has them; place counts a file's records from 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    large = files.filter(F.col("length") > most_bytes).select("path", F.lit("none").alias("format"), F.lit(0).alias("place"), F.lit("too_large").alias("kind"), F.lit("").alias("text"), F.create_map(F.lit("bytes"), F.col("length").cast("string")).alias("fields"))

    readers = dict(READERS)

    def records(batches):
        for batch in batches:
            for at, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(at, name, i, kind, text, fields) for i, (name, kind, text, fields) in enumerate(parse(at, bytes(data), 1, readers))]
                yield pd.DataFrame(rows, columns=["path", "format", "place", "kind", "text", "fields"])

    return files.filter(F.col("length") <= most_bytes).select("path", "content").mapInPandas(records, SCHEMA).unionByName(large)
