"""Markup residue: which markup a text carries, and its clean text with headings, lists, code and formulas kept.

A scanner takes code out first, so that samples inside it stay as they are, then formulas, then the marks of each
syntax. The method named for this problem (:mod:`skerry.llm.site_style`) prunes the branches of pages that one host shares; it can neither
name a record's markup nor keep its structure (the README has its figures), so it is not used here.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

#: Element names of HTML; anything else between angle brackets is no markup.
ELEMENTS = (
    "a abbr address article aside b blockquote body br button caption center cite code col dd del details dfn div dl dt em "
    "figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav "
    "ol option p pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th "
    "thead title tr tt u ul var video"
).split()

#: Elements that end a line of text.
BLOCKS = "address article aside blockquote body br caption center dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody tfoot thead title tr ul".split()

MATH = "equation|align|gather|multline|eqnarray|displaymath|math"


class Span:
    """A found span, as a pattern's match has it: ``group()`` is all of it, any other group what its marks enclose."""

    __slots__ = ("re", "string", "at", "inner")

    def __init__(self, finder: Enclosed, text: str, at: tuple[int, int], inner: tuple[int, int]):
        self.re, self.string, self.at, self.inner = finder, text, at, inner

    def group(self, name: str | int = 0) -> str:
        begin, end = self.inner if name else self.at
        return self.string[begin:end]


class Enclosed:
    """What two marks enclose, however long: used like a pattern, but in time linear in the text where a pattern would look for the end of
    every mark again.

    ``opening`` and ``closing`` match the places of the marks; a span runs from an opening mark to the nearest closing one behind what is at least
    one character, on one line if ``line``, and for ``equal`` marks to one of the same length.
    """

    def __init__(self, opening: str, closing: str, name: str = "body", line: bool = True, equal: bool = False):
        self.opening, self.closing, self.line, self.equal, self.groupindex = re.compile(opening), re.compile(closing), line, equal, {name: 1}

    def finditer(self, text: str) -> Iterator[Span]:
        closings: dict[int, list[tuple[int, int]]] = {}
        for m in self.closing.finditer(text):
            closings.setdefault(m.end() - m.start() if self.equal else 0, []).append(m.span())
        if not closings:
            return
        used = dict.fromkeys(closings, 0)
        done, line_end = 0, -1
        for m in self.opening.finditer(text):
            begin, inner = m.span()
            key = inner - begin if self.equal else 0
            if begin < done or key not in closings:
                continue
            ends, k = closings[key], used[key]
            while k < len(ends) and ends[k][0] <= inner:
                k += 1
            used[key] = k
            if k == len(ends):
                continue
            if self.line and line_end < begin:
                line_end = text.find("\n", begin)
                line_end = len(text) if line_end < 0 else line_end
            if self.line and ends[k][0] > line_end:
                continue
            done = ends[k][1]
            yield Span(self, text, (begin, done), (inner, ends[k][0]))

    def search(self, text: str) -> Span | None:
        return next(self.finditer(text), None)

    def sub(self, by: str | Callable[[Span], str], text: str) -> str:
        out, at = [], 0
        for span in self.finditer(text):
            out += [text[at : span.at[0]], span.group(1) if isinstance(by, str) else by(span)]
            at = span.at[1]
        return "".join(out) + text[at:] if out else text


BOLD = Enclosed(r"\*\*(?=[^\s*])", r"(?<=[^\s*])\*\*")
UNDERLINED = Enclosed(r"(?<!\w)__(?=[^\s_])", r"(?<=[^\s_])__(?!\w)")
QUOTED = Enclosed(r"'{2,3}(?=[^\s'])", r"(?<=[^\s'])'{2,3}(?!')")
TICKED = Enclosed(r"(?<!`)`{1,2}(?!`)", r"(?<!`)`{1,2}(?!`)", name="code", equal=True)

#: Code, by syntax; the group ``code`` is what the marks enclose.
CODE = [
    ("markdown", re.compile(r"^[ \t]{0,3}(?P<fence>`{3,}|~{3,})[^\n`]*\n(?P<code>.*?)(?:^[ \t]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)", re.S | re.M)),
    ("latex", re.compile(r"\\begin\{(?P<env>verbatim\*?|lstlisting|minted)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})?\n?(?P<code>.*?)\n?\\end\{(?P=env)\}", re.S)),
    ("html", re.compile(r"<pre\b[^<>]*>\s*(?:<code\b[^<>]*>)?(?P<code>.*?)(?:</code>\s*)?</pre>", re.S | re.I)),
    ("html", re.compile(r"<code\b[^<>]*>(?P<code>.*?)</code>", re.S | re.I)),
    ("wiki", re.compile(r"<(?P<tag>nowiki|syntaxhighlight|source)\b[^<>]*>(?P<code>.*?)</(?P=tag)>", re.S | re.I)),
    ("markdown", TICKED),
    ("latex", re.compile(r"\\verb\*?(?P<bar>[|!+])(?P<code>[^\n]*?)(?P=bar)")),
]
CODE_HINT = re.compile(r"`|~~~|<pre|<code|<nowiki|<syntaxhighlight|<source|\\begin\{(?:verb|lst|mint)|\\verb", re.I)

#: Formulas between their signs; a dollar before a digit or with a blank on its inner side is money.
FORMULA = [
    re.compile(r"\\begin\{(?P<env>(?:" + MATH + r")\*?)\}(?P<body>.*?)\\end\{(?P=env)\}", re.S),
    re.compile(r"\$\$(?P<body>[^$]+?)\$\$"),
    Enclosed(r"\\\[", r"\\\]", line=False),
    Enclosed(r"\\\(", r"\\\)", line=False),
    re.compile(r"(?<![\w\\$])\$(?P<body>[^\s$](?:[^$\n]*[^\s$\\])?)\$(?![\w$])"),
]

TAG = re.compile(r"<(?P<close>/?)(?P<name>" + "|".join(ELEMENTS) + r")(?:\s[^<>]*)?/?>", re.I)
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!doctype[^<>]*>", re.S | re.I)
REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")

WIKI = [
    re.compile(r"\[\[[^\[\]\n]+\]\]"),
    re.compile(r"\{\{[^{}\n]+\}\}"),
    re.compile(r"^[ \t]*(?:\{\||\|\}|\|-+(?:[ \t]+[^|\n]*)?$)", re.M),
    re.compile(r"^[ \t]*(?P<level>={1,6})[ \t]*[^=\s][^\n]*?(?P=level)[ \t]*$", re.M),
    QUOTED,
    re.compile(r"\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\](?!\()"),
    re.compile(r"^(?:(?=[:*#;]*[:;])[:*#;]+|\*{2,}|\*#[*#]*|#\*[*#]*)[ \t]+\S", re.M),
    re.compile(r"</?(?:ref|gallery)\b[^<>]*>|__(?:NO)?TOC__", re.I),
]

LATEX = [
    re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    re.compile(r"\\(?:begin|end)\{[^}\n]*\}"),
    re.compile(r"\\item\b"),
]

MARKDOWN = [
    re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+\S", re.M),
    re.compile(r"^(?=[^\n]*[^\s=\n-])[^\n]+\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M),
    BOLD,
    UNDERLINED,
    re.compile(r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])"),
    re.compile(r"(?<![\w_\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])"),
    re.compile(r"~~(?=[^\s~])[^~\n]*?[^\s~]~~"),
    re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]*(?:[ \t]+[\"'][^\n]*?[\"'])?\)"),
    re.compile(r"(?<!\])\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S", re.M),
    re.compile(r"^[ \t]{0,3}>[ \t]?\S", re.M),
    re.compile(r"^[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+\[[ xX]\][ \t]", re.M),
    re.compile(r"^[ \t]*[-+*][ \t]+\S[^\n]*\n[ \t]*[-+*][ \t]+\S", re.M),
    re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$", re.M),
    re.compile(r"\{#[\w-]+\}[ \t]*$", re.M),
    re.compile(r"<https?://[^\s<>]+>"),
]
MARKDOWN_HINT = re.compile(r"[*_~\[>|#]|\n[ \t]*[-+=]")

#: Stands for a piece that was taken out; private-use characters around its number.
HOLE = "\ue000{}\ue001"
HOLES = re.compile("\ue000(\\d+)\ue001")


def _take_out(text: str, kinds: set[str], kept: list[str] | None = None) -> str:
    """Replace code and formulas by holes; note the kinds of their marks."""

    def put(m: re.Match, block: bool) -> str:
        if kept is None:
            return "\ue000\ue001"
        kept.append(m.group("code" if "code" in m.re.groupindex else "body").strip("\n"))
        hole = HOLE.format(len(kept) - 1)
        return f"\n\n{hole}\n\n" if block else hole

    if CODE_HINT.search(text):
        for kind, pattern in CODE:

            def code(m: re.Match, kind: str = kind) -> str:
                kinds.add(kind)
                return put(m, "\n" in m.group())

            text = pattern.sub(code, text)
    if "$" in text or "\\" in text:
        for pattern in FORMULA:

            def formula(m: re.Match) -> str:
                kinds.add("latex")
                return put(m, m.group().startswith(("$$", "\\[", "\\begin")))

            text = pattern.sub(formula, text)
    return text


def kinds_of(text: str | None) -> list[str]:
    """The kinds of markup that a text carries, in the order of :data:`KINDS`."""
    if not text:
        return []
    kinds: set[str] = set()
    rest = _take_out(text.replace("\ue000", "").replace("\ue001", ""), kinds)
    if "html" not in kinds and (
        ("<" in rest and (TAG.search(rest) or COMMENT.search(rest))) or ("&" in rest and any(html.unescape(m) != m for m in REFERENCE.findall(rest)))
    ):
        kinds.add("html")
    if "latex" not in kinds and "\\" in rest and any(p.search(rest) for p in LATEX):
        kinds.add("latex")
    if "wiki" not in kinds and any(p.search(rest) for p in WIKI):
        kinds.add("wiki")
    if "markdown" not in kinds and (MARKDOWN_HINT.search(rest) or "{#" in rest):
        plain = rest
        if "wiki" in kinds:  # its own links, tables and bold are no Markdown
            for p in WIKI[:2] + WIKI[4:6]:
                plain = p.sub(" ", plain)
        if any(p.search(plain) for p in MARKDOWN):
            kinds.add("markdown")
    return [k for k in KINDS if k in kinds]


_BLOCK = re.compile(r"</?(?:" + "|".join(BLOCKS) + r")(?:\s[^<>]*)?/?>", re.I)
_CLEAN = [
    # HTML
    (COMMENT, ""),
    (re.compile(r"<(script|style)\b[^<>]*>.*?</\1>", re.S | re.I), ""),
    (re.compile(r"<li\b[^<>]*>", re.I), "\n- "),
    (re.compile(r"<t[dh]\b[^<>]*>", re.I), "\t"),
    (re.compile(r"<br\b[^<>]*>|</li>|</?tr\b[^<>]*>", re.I), "\n"),
    (_BLOCK, "\n\n"),
    (TAG, ""),
    # wiki
    (re.compile(r"^[ \t]*\{\|[^\n]*\n?|^[ \t]*\|\}[ \t]*\n?|^[ \t]*\|-+(?:[ \t]+[^|\n]*)?\n", re.M), ""),
    (re.compile(r"^[ \t]*(={1,6})[ \t]*([^=\s][^\n]*?)[ \t]*\1[ \t]*$", re.M), r"\n\2\n"),
    (re.compile(r"\[\[(?:File|Image):(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]", re.I), r"\1"),
    (re.compile(r"\[\[Category:[^\[\]\n]*\]\]", re.I), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}\n]+\}\}"), ""),
    (re.compile(r"\[https?://[^\s\]]+[ \t]+([^\]\n]*)\](?!\()"), r"\1"),
    (re.compile(r"\[(https?://[^\s\]]+)\](?!\()"), r"\1"),
    (re.compile(r"^(?:(?=[:*#;]*[:;])[:*#;]{2,}|\*{2,}|\*#[*#]*|#\*[*#]*)[ \t]+(?=\S)", re.M), "- "),
    (re.compile(r"^[:;][ \t]+(?=\S)", re.M), ""),
    (QUOTED, r"\1"),
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>|</?gallery\b[^<>]*>|__(?:NO)?TOC__", re.S | re.I), ""),
    # LaTeX
    (re.compile(r"~?\\(?:label|cite[tp]?|index)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}"), ""),
    (re.compile(r"~?\\(?:ref|eqref|pageref)\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}"), r"\n\n\1\n\n"),
    (re.compile(r"\\item(?:\[[^\]\n]*\])?[ \t]*"), "\n- "),
    (re.compile(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?"), "\n"),
    (re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}"), r"\1"),
    # Markdown
    (re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*\n?", re.M), ""),
    (re.compile(r"^(?=[^\n]*[^\s=\n-])([^\n]+)\n[ \t]{0,3}(?:={3,}|-{3,})[ \t]*$", re.M), r"\1\n"),
    (re.compile(r"^[ \t]{0,3}#{1,6}[ \t]+([^\n]*?)(?:[ \t]+#+)?[ \t]*$", re.M), r"\n\1\n"),
    (re.compile(r"[ \t]*\{#[\w-]+\}[ \t]*$", re.M), ""),
    (re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S[^\n]*\n?", re.M), ""),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+[\"'][^\n]*?[\"'])?\)"), r"\1"),
    (re.compile(r"(?<!\])\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    (re.compile(r"<(https?://[^\s<>]+)>"), r"\1"),
    (re.compile(r"^[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+\[[ xX]\][ \t]+", re.M), "- "),
    (re.compile(r"^[ \t]*[+*][ \t]+(?=\S)", re.M), "- "),
    (re.compile(r"^[ \t]{0,3}>[ \t]?", re.M), ""),
    (BOLD, r"\1"),
    (UNDERLINED, r"\1"),
    (re.compile(r"~~([^\s~](?:[^~\n]*?[^\s~])??)~~"), r"\1"),
    (re.compile(r"(?<![\w*\\])\*([^\s*](?:[^*\n]*?[^\s*])??)\*(?![\w*])"), r"\1"),
    (re.compile(r"(?<![\w_\\])_([^\s_](?:[^_\n]*?[^\s_])??)_(?![\w_])"), r"\1"),
    (re.compile(r"^[ \t]*\|(.*?)\|?[ \t]*$", re.M), lambda m: "\t".join(c.strip() for c in m.group(1).split("|"))),
]
_COMMAND = re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")


def clean(text: str | None) -> str | None:
    """The text without its markup. Headings stand on lines of their own, list items after a dash, table cells between
    tabs; code and formulas stay as they were between their marks. A text without markup stays as it is; null stays null."""
    if text is None:
        return None
    if not kinds_of(text):
        return text
    kept: list[str] = []
    rest = _take_out(text.replace("\ue000", "").replace("\ue001", ""), set(), kept)
    for pattern, by in _CLEAN:
        rest = pattern.sub(by, rest)
    while (again := _COMMAND.sub(r"\1", rest)) != rest:  # commands around commands
        rest = again
    rest = html.unescape(rest) if "&" in rest else rest
    rest = re.sub(r"[ \t]+\n", "\n", rest)
    rest = re.sub(r"\n{3,}", "\n\n", rest).strip()
    while HOLES.search(rest):
        rest = HOLES.sub(lambda m: kept[int(m.group(1))], rest)
    return rest


def _fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])


def find_markup(df: DataFrame, id_col: str = "chunk_id", fields: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """Distinct ``<id_col>, field_name, markup``: each kind of markup that a field of a record carries.

    Null, empty and unmarked fields give nothing, rows without id are left out, repeated deliveries count once; whole texts
    are scanned. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at, names, kinds = [], [], []
            for i, field in enumerate(fields):
                for row, text in enumerate(batch.column(1 + i).to_pylist()):
                    for kind in kinds_of(text):
                        at.append(row)
                        names.append(field)
                        kinds.append(kind)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(names, pa.string()), pa.array(kinds, pa.string())], names=["id", "field_name", "markup"])

    narrow = _fields(df, id_col, list(fields))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, field_name string, markup string").distinct().withColumnRenamed("id", id_col)


def clean_markup(df: DataFrame, id_col: str = "chunk_id", fields: tuple[str, ...] = ("text", "heading")) -> DataFrame:
    """``<id_col>`` and the clean text of each field, a row for every row with an id; null fields stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [pa.array([clean(t) for t in batch.column(1 + i).to_pylist()], pa.string()) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["id", *(f"f{i}" for i in range(len(fields)))])

    narrow = _fields(df, id_col, list(fields))
    done = narrow.mapInArrow(run, narrow.schema)
    return done.select(F.col("id").alias(id_col), *[F.col(f"f{i}").alias(f) for i, f in enumerate(fields)])
