"""Documents from Markdown and HTML: sections with heading paths and anchors, plain text, and their chunks.

A text is read once into blocks (headings, code, prose); sections, plain text and chunks are made of blocks. Sections follow one
another through a stack of headings, which Column expressions cannot hold, so these run as Arrow functions over batches of
documents; a document is a row, never a group. Every scanner takes time linear in the text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import ENTITIES
from skerry.operators.chunking import LEAST, OVERLAP_PERCENT, TARGET

_BLANKS = re.compile(r"[ \t]+")
_GAPS = re.compile(r"\n{3,}")


def tidy(text: str) -> str:
    return _GAPS.sub("\n\n", _BLANKS.sub(" ", text.replace("\r", ""))).strip()


def unescape(text: str) -> str:
    """Named references of the fixed list, numeric ones, and &amp; last."""
    if "&" not in text:
        return text
    out, at = [], 0
    while (start := text.find("&", at)) >= 0:
        end = text.find(";", start, start + 12)
        name = text[start + 1 : end] if end > 0 else ""
        by = _referred(name)
        out.append(text[at:start] + (by if by is not None else "&"))
        at = end + 1 if by is not None else start + 1
    return ("".join(out) + text[at:]).replace("&amp;", "&")


def _referred(name: str) -> str | None:
    """The character of a reference's name; None for an unknown one and for amp, which comes last."""
    if not name.startswith("#"):
        return ENTITIES.get(name)
    digits, base = (name[2:], 16) if name[1:2] in ("x", "X") else (name[1:], 10)
    try:
        code = int(digits, base) if digits.isalnum() else 0
    except ValueError:
        return None
    return chr(code) if 0 < code < 0x110000 else None


# ---- Markdown: blocks


class Block(NamedTuple):
    """``heading`` (its level and raw text), ``code`` (the lines inside a fence) or ``prose`` (lines as written)."""

    kind: str
    level: int
    text: str


def _fence(line: str) -> tuple[str, str] | None:
    """(run of fence signs, what follows) of a line that may open or close a code block."""
    bare = line.lstrip(" \t")
    sign = bare[:1]
    if sign not in ("`", "~") or not bare.startswith(sign * 3):
        return None
    rest = bare.lstrip(sign)
    return bare[: len(bare) - len(rest)], rest.strip()


def _hashes(line: str) -> tuple[int, str] | None:
    """(level, text) of a line that starts with one to six hashes and a blank."""
    bare = line.lstrip(" ")
    if len(line) - len(bare) > 3 or not bare.startswith("#"):
        return None
    text = bare.lstrip("#")
    level = len(bare) - len(text)
    if level > 6 or not text.strip() or text[0] not in " \t":
        return None
    text = text.strip()
    shorn = text.rstrip("#")
    return level, (shorn.rstrip() if shorn != text and shorn[-1:] in (" ", "\t") else text)


def _underline(line: str) -> int:
    """1 or 2 for a line that makes the one above a heading, else 0."""
    bare = line.strip()
    if len(line) - len(line.lstrip(" ")) > 3 or not bare:
        return 0
    return 1 if not bare.strip("=") else 2 if len(bare) > 1 and not bare.strip("-") else 0


def _opens_block(line: str) -> bool:
    first = line.split(None, 1)[0]
    return first[0] in "#>|" or first in ("-", "*", "+") or (first[:-1].isdigit() and first[-1] in ".)")


def blocks(body: str) -> Iterator[Block]:
    """The blocks of a Markdown text. What looks like a heading inside a fence is code; an open fence runs to the end."""
    prose: list[str] = []
    code: list[str] | None = None
    opened = ""
    for line in body.split("\n"):
        fence = _fence(line)
        if code is not None:
            if fence and not fence[1] and fence[0].startswith(opened):
                yield Block("code", 0, "\n".join(code))
                code = None
            else:
                code.append(line)
            continue
        heading, level = _hashes(line), 0
        if not fence and not heading and prose and prose[-1].strip() and not _opens_block(prose[-1]):
            level = _underline(line)
        if level:
            heading = level, prose.pop().strip()
        if (fence or heading) and prose:
            yield Block("prose", 0, "\n".join(prose))
            prose = []
        if fence:
            opened, code = fence[0], []
        elif heading:
            yield Block("heading", *heading)
        else:
            prose.append(line)
    if code is not None:
        yield Block("code", 0, "\n".join(code))
    if prose:
        yield Block("prose", 0, "\n".join(prose))


# ---- Markdown: prose

_MARKS = re.compile(r"[\\`!\[\]*_~|\n]")
_ESCAPED = frozenset("\\`*_{}[]()#+-.!>~|")


def _bare_line(line: str) -> str | None:
    """A line without its marks of quotes and lists; None for rules and rows that only part tables."""
    text = line.strip(" \t")
    indent = len(line) - len(line.lstrip(" \t"))
    packed = text.replace(" ", "").replace("\t", "")
    if len(packed) > 2 and indent < 4 and packed[0] in "-*_" and not packed.strip(packed[0]):
        return None
    if "|" in packed and "-" in packed and not packed.strip("|:-"):
        return None
    if indent < 4:
        while text.startswith(">"):
            text = text[1:].removeprefix(" ").removeprefix("\t").lstrip(" \t")
    if text[:1] in ("-", "*", "+") and text[1:2] in (" ", "\t") and text[1:].strip():
        text = text[1:].lstrip(" \t")
        if text[:4].lower() in ("[ ] ", "[x] "):
            text = text[4:].lstrip(" \t")
    return text


class _Spans:
    """Where runs of backticks stand in a text, so that each finds its closing one at once."""

    def __init__(self, text: str):
        self.runs: dict[int, list[int]] = {}
        at = text.find("`")
        while at >= 0:
            end = at
            while text[end : end + 1] == "`":
                end += 1
            self.runs.setdefault(end - at, []).append(at)
            at = text.find("`", end)

    def closing(self, at: int, width: int, line_end: int) -> int:
        places = self.runs[width]
        i = bisect_left(places, at + width)
        return places[i] if i < len(places) and places[i] < line_end else -1


def inline(text: str) -> str:
    """Prose without the marks of code, links, images, emphasis and tables; escaped signs stand for themselves.

    Emphasis is undone in pairs: a run of signs opens before and closes after what is not blank. Single signs inside a word are
    letters, so identifiers keep their underscores.
    """
    out: list[str] = []
    waiting: dict[tuple[str, int], list[int]] = {}  # places in out of runs that may open
    tails: dict[int, int] = {}  # where a link's label ends -> where the link ends
    spans, n, at, bracket, line_end = _Spans(text), len(text), 0, -1, -1
    while at < n:
        mark = _MARKS.search(text, at)
        if mark is None:
            out.append(text[at:])
            break
        here = mark.start()
        out.append(text[at:here])
        sign, at = text[here], here + 1
        if sign == "\n":
            waiting = {k: v for k, v in waiting.items() if k[1] > 1}
            out.append(sign)
        elif sign == "\\" and text[at : at + 1] in _ESCAPED and at < n:
            out.append(text[at])
            at += 1
        elif sign == "|":
            out.append(" ")
        elif sign == "`":
            width = 1
            while text[here + width : here + width + 1] == "`":
                width += 1
            if line_end < here:
                line_end = text.find("\n", here)
                line_end = n if line_end < 0 else line_end
            close = spans.closing(here, width, line_end)
            code = text[here + width : close] if close >= 0 else "`" * width
            if close >= 0 and len(code) > 1 and code[0] == code[-1] == " " and code.strip():
                code = code[1:-1]
            out.append(code)
            at = (close if close >= 0 else here) + width
        elif sign == "]" and here in tails:
            at = tails.pop(here)
        elif sign == "[" or (sign == "!" and text[at : at + 1] == "["):
            label = here + (2 if sign == "!" else 1)
            if bracket < label:
                bracket = text.find("]", label)
                bracket = n if bracket < 0 else bracket
            after = text[bracket + 1 : bracket + 2]
            close = text.find(")" if after == "(" else "]", bracket + 2) if bracket < n and bracket not in tails and (after == "(" or (after == "[" and sign == "[")) else -1
            if close >= 0 and (bracket > label or sign == "!"):
                tails[bracket] = close + 1
                at = label
            else:
                out.append(sign)
        elif sign in "*_~":
            while text[at : at + 1] == sign:
                at += 1
            width, before, after = at - here, text[here - 1 : here] or " ", text[at : at + 1] or " "
            key = (sign, width)
            alone = width == 1
            lexical = lambda c: c.isalnum() or c == "_"
            closes = not before.isspace() and not (alone and lexical(after)) and bool(waiting.get(key))
            if closes and waiting[key][0] < len(out) - 1:
                out[waiting.pop(key)[0]] = ""
            else:
                opens = not after.isspace() and not (alone and lexical(before)) and (width < 4 if sign != "~" else width == 2) and key != ("~", 1)
                if opens:
                    waiting.setdefault(key, []).append(len(out))
                out.append(text[here:at])
        else:
            out.append(sign)
    return "".join(out)


def _prose(text: str) -> str:
    lines = [x for line in text.split("\n") if (x := _bare_line(line)) is not None]
    return "\n".join(_BLANKS.sub(" ", line).strip() for line in inline("\n".join(lines)).split("\n"))


def _plain(parts: list[Block]) -> str:
    shown = [b.text.join(("\n", "\n")) if b.kind == "code" else _prose(b.text) for b in parts]
    return _GAPS.sub("\n\n", "\n".join(shown)).strip()


def strip_markdown(text: str) -> str:
    """Prose without Markdown's marks; code keeps its text as it is, identifiers their underscores."""
    return _plain(list(blocks(text.replace("\r", ""))))


# ---- sections


class Anchors:
    """Anchors of a document's headings; repeats get -1, -2 and so on."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, heading: str) -> str:
        base = "".join(c for c in heading.strip().lower() if c.isalpha() or c.isnumeric() or c in " _-").replace(" ", "-")
        n = self.seen.get(base, 0)
        self.seen[base] = n + 1
        return f"{base}-{n}" if n else base


class Outline:
    """The sections of one document in their order, with heading paths and anchors.

    A path holds the headings above a section and its own. The first heading of level 1 stays out of the paths if it is the title.
    """

    def __init__(self, title: str | None):
        self.title, self.anchors, self.trail, self.sections = (title or "").lower(), Anchors(), [], []
        self.headed = False

    def add(self, level: int, heading: str | None, own: str | None, text: str) -> None:
        if not level:
            if text:
                self.sections.append({"heading_path": [], "anchor": "", "heading": None, "text": text})
            return
        named = bool(self.title) and level == 1 and not self.headed and heading.lower() == self.title
        self.headed = self.headed or level == 1
        self.trail = [x for x in self.trail if x[0] < level] + [(level, None if named else heading)]
        path = [h for _, h in self.trail if h]
        self.sections.append({"heading_path": path, "anchor": own or self.anchors(heading), "heading": heading, "text": text})


_CUSTOM = re.compile(r"\s*\{#([\w-]+)\}$")


def _heading_text(raw: str) -> tuple[str, str | None]:
    """(shown text, own anchor) of a raw heading."""
    own = _CUSTOM.search(raw)
    raw = raw[: own.start()] if own else raw
    plain = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", raw).replace("`", "")
    return tidy(plain.translate({ord("*"): None, ord("~"): None})), own.group(1) if own else None


def _front_matter(body: str) -> tuple[str | None, str]:
    """(title, what follows) of a text that may begin with a block between lines of three dashes."""
    if not body.startswith("---\n"):
        return None, body
    lines = body.split("\n")
    end = next((i for i, x in enumerate(lines[1:], 1) if x == "---"), None)
    if end is None:
        return None, body
    value = next((x[6:].strip() for x in lines[1:end] if x.startswith("title:")), "")
    if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
        value = value[1:-1]
    return value or None, "\n".join(lines[end + 1 :])


def from_markdown(text: str) -> dict:
    title, body = _front_matter(text.removeprefix("\ufeff").replace("\r", ""))
    # Modules and components of mixed Markdown are no text.
    body = "\n".join(" " if x.startswith(("import ", "export ")) else x for x in body.split("\n"))
    body = re.sub(r"</?[A-Z][A-Za-z0-9.]*(?:\s[^<>]*)?/?>", " ", body)
    parts: list[tuple[int, str | None, str | None, list[Block]]] = [(0, None, None, [])]
    for block in blocks(body):
        if block.kind == "heading":
            parts.append((block.level, *_heading_text(block.text), []))
        else:
            parts[-1][3].append(block)
    title = title or next((heading for level, heading, *_ in parts if level == 1), None)
    outline = Outline(title)
    for level, heading, own, inside in parts:
        outline.add(level, heading, own, _plain([Block("prose", 0, heading), *inside] if level else inside))
    return {"title": title, "text": _plain([Block("prose", 0, b.text) if b.kind == "heading" else b for _, b in _with_headings(parts)]), "sections": outline.sections}


def _with_headings(parts: list) -> Iterator[tuple[int, Block]]:
    for level, heading, _, inside in parts:
        if level:
            yield level, Block("heading", level, heading)
        for block in inside:
            yield level, block


# ---- HTML

#: Elements whose content is no text of the page, and those whose end parts paragraphs.
HIDDEN = frozenset(("script", "style", "nav", "header", "footer", "aside"))
PARTING = frozenset(("p", "li", "div", "tr", "pre", "h1", "h2", "h3", "h4", "h5", "h6"))
_AMP = "\ue000"


class _Page(HTMLParser):
    """Events of a page: text, breaks and headings, with the places where the page's regions begin and end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.title: list[str] = []
        self.events: list[tuple[str, object]] = []
        self.regions: dict[str, list[int]] = {}
        self.hidden: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.hidden:
            self.hidden += [tag] if tag == self.hidden[-1] else []
        elif tag in HIDDEN:
            self.hidden.append(tag)
        elif tag in ("main", "article", "body"):
            self.regions.setdefault(tag, [len(self.events)])
        elif tag == "title":
            self.in_title = not self.title
        elif tag in PARTING and tag[0] == "h":
            own = next((v for k, v in attrs if k == "id" and v), None)
            self.events.append(("open", (int(tag[1]), own)))
        elif tag == "br":
            self.events.append(("text", "\n"))
        else:
            own = next((v for k, v in attrs if k == "id" and v), None)
            self.events.append(("text", " "))
            if own:
                self.events.append(("id", own))

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            self.events.append(("text", " "))
        elif tag in self.regions:
            if len(self.regions[tag]) == 1:
                self.regions[tag].append(len(self.events))
        elif tag == "title":
            self.in_title = False
        elif tag in PARTING:
            self.events.append(("close", int(tag[1])) if tag[0] == "h" else ("text", "\n\n"))
        elif tag != "br":
            self.events.append(("text", " "))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in HIDDEN:
            self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.hidden:
            self.events.append(("text", data))

    def own_events(self) -> list[tuple[str, object]]:
        """Of the first main or article that ends, else of the body, else all."""
        ended = [self.regions[t] for t in ("main", "article") if len(self.regions.get(t, ())) == 2]
        begin, end = min(ended) if ended else (self.regions.get("body", [0]) + [len(self.events)])[:2]
        return self.events[begin:end]


def _flat(parts: list[str]) -> str:
    return tidy(unescape("".join(parts).replace(_AMP, "&")))


def from_html(page: str) -> dict:
    reader = _Page()
    # References are decoded by the fixed list, so the parser must not see them.
    reader.feed(page.replace(_AMP, "").replace("&", _AMP))
    reader.close()
    title = _flat(reader.title)
    outline = Outline(re.split(r"\s*[|·–—-]\s+", title)[0] or title)
    whole: list[str] = []
    level, heading, own, said = 0, None, None, []
    named: list[str] | None = None  # the words of a heading while it is open

    def end_section() -> None:
        body = _flat(said)
        outline.add(level, heading, own, "\n".join((heading, body)).strip() if level else body)

    for kind, value in reader.own_events():
        if kind == "open":
            if named is not None:  # a heading that the next one ends
                heading = _flat(named)
            end_section()
            (level, own), heading, said, named = value, None, [], []
            own = own.replace(_AMP, "&") if own else None
        elif kind == "close":
            whole.append("\n\n")
            if named is not None:
                heading, named = _flat(named).replace("\n", " "), None
        elif kind == "id":
            own = own or (value if named is not None else None)
        else:
            whole.append(value)
            (said if named is None else named).append(value)
    if named is not None:
        heading = _flat(named)
    end_section()
    return {"title": title, "text": _flat(whole), "sections": outline.sections}


def from_plain(text: str) -> dict:
    return {"title": None, "text": tidy(text), "sections": []}


def _parser(path: str) -> Callable[[str], dict]:
    low = path.lower()
    return from_markdown if low.endswith((".md", ".mdx")) else from_html if low.endswith((".html", ".htm")) else from_plain


_SECTION = pa.struct([("heading_path", pa.list_(pa.string())), ("anchor", pa.string()), ("heading", pa.string()), ("text", pa.string())])


def documents(files: DataFrame, id_col: str, path_col: str, text_col: str) -> DataFrame:
    """``doc_id, source_path, title, text, sections`` of files (null texts are empty) by the ending of their path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_parser(p or "")(t or "") for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = [pa.array([f["title"] for f in found], pa.string()), pa.array([f["text"] for f in found], pa.string()), pa.array([f["sections"] for f in found], pa.list_(_SECTION))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "source_path", "title", "text", "sections"])

    narrow = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("source_path"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    section = "struct<heading_path: array<string>, anchor: string, heading: string, text: string>"
    return narrow.mapInArrow(run, f"doc_id {kind}, source_path string, title string, text string, sections array<{section}>")


# ---- chunks


def place_of(parts: list[dict]) -> tuple[list[str], str]:
    """(heading path, anchor) true of all merged sections that have a body: their common path, and the anchor that owns it."""
    bodied = [p for p in parts if p["heading"] and tidy(p["text"]) != tidy(p["heading"])]
    if not bodied:
        return [], ""
    low, high = (f(p["heading_path"] for p in bodied) for f in (min, max))  # what these two share, all share
    path = low[: next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))]
    return path, next((p["anchor"] for p in bodied if p["heading_path"] == path), "") or ""


class Sizes(NamedTuple):
    """Words that a chunk should have, has at most, and by which windows inside a paragraph move."""

    target: int
    most: int
    step: int


def _groups(sections: list[dict], sizes: list[int]) -> Iterator[tuple[list[dict], int]]:
    """Sections that stand together, with their words: a small one joins its child, and a small first one what follows."""
    held: list[dict] = []
    n = 0
    for i, (section, size) in enumerate(zip(sections, sizes, strict=True)):
        held, n = [*held, section], n + size
        after = sections[i + 1]["heading_path"] if i + 1 < len(sections) else []
        parent = bool(after) and after[:-1] == section["heading_path"]
        if size >= LEAST or not (parent or i == 0):
            yield held, n
            held, n = [], 0
    if held:
        yield held, n


def _pieces(text: str, s: Sizes) -> Iterator[str]:
    """A long text in pieces of whole paragraphs; a paragraph that is too long alone in windows of words."""
    held: list[str] = []
    room = s.target
    for paragraph in re.split(r"\n{2,}", text):
        words = paragraph.split()
        if held and (len(words) > s.most or len(words) > room):
            yield "\n\n".join(held)
            held, room = [], s.target
        if len(words) > s.most:
            last = max(0, -(-(len(words) - s.target) // s.step))
            yield from (" ".join(words[k * s.step : k * s.step + s.target]) for k in range(last + 1))
        elif words:
            held.append(paragraph)
            room -= len(words)
    if held:
        yield "\n\n".join(held)


def section_chunks(sections: list[dict], target: int = TARGET, overlap_percent: int = OVERLAP_PERCENT) -> list[dict]:
    """Chunks of a document's sections: small ones join their child, else what precedes; large ones are packed by paragraph."""
    s = Sizes(target, int(target * 1.6), max(1, target - target * overlap_percent // 100))
    out: list[tuple[list[str], list[dict]]] = []
    for parts, n in _groups(sections, [len(x["text"].split()) for x in sections]):
        text = "\n".join(p["text"] for p in parts if p["text"])
        if 0 < n < LEAST and out:
            out[-1][0].append(tidy(text))
            out[-1][1].extend(parts)
        elif n:
            out.extend(([tidy(piece)], list(parts)) for piece in ((text,) if n <= s.most else _pieces(text, s)))
    return [{"text": "\n".join(texts), **dict(zip(("heading_path", "anchor"), place_of(parts), strict=True))} for texts, parts in out]


def chunks_of_documents(docs: DataFrame, target: int = TARGET, overlap_percent: int = OVERLAP_PERCENT) -> DataFrame:
    """``doc_id, chunk_no, title, heading_path, anchor, source_path, text``; documents below the least words give none."""
    target, overlap_percent = target or TARGET, overlap_percent or OVERLAP_PERCENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, r in enumerate(batch.to_pylist()):
                if len(tidy(r["text"] or "").split()) < LEAST:
                    continue
                whole = [{"heading_path": [], "anchor": "", "heading": None, "text": r["text"]}]
                for n, c in enumerate(section_chunks(r["sections"] or whole, target, overlap_percent)):
                    rows.append((i, n, c))
            at = pa.array([i for i, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array([n for _, n, _ in rows], pa.int32()), batch.column(2).take(at), pa.array([c["heading_path"] for *_, c in rows], pa.list_(pa.string())),
                    pa.array([c["anchor"] for *_, c in rows], pa.string()), batch.column(1).take(at), pa.array([c["text"] for *_, c in rows], pa.string()),
                ],
                names=["doc_id", "chunk_no", "title", "heading_path", "anchor", "source_path", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "source_path", "title", "text", "sections")
    return narrow.mapInArrow(run, f"doc_id {kind}, chunk_no int, title string, heading_path array<string>, anchor string, source_path string, text string")
