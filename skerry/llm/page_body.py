"""The main body of page texts: a tree of each page, built with implied tags, visibility rules, and the rendering of what is visible.

No tags mark a page's regions and blocks; its lines imply them. Hidden are the header, asides, and lines that are frame by
themselves: by their form (cookie notices, sharing, paging and the like) or because their site repeats them where only frame stands. The
latter is counted over all pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A line is its site's frame if so many of its pages and this share of them repeat it, this share of the times outside the body.
REPEATS, REPEAT_SHARE, OUTSIDE = 4, 0.01, 0.9

#: Lines, and sites, that a Python worker remembers before it starts afresh.
REMEMBERED, SITES = 200_000, 256

#: Forms of frame lines in the languages of the pages, digits and the site's name masked as 0 and @S.
FRAME_FORMS = [
    # cookies and consent
    r".*\bcookies?\b.*(?:\b(?:accept|reject|manage|choices|settings|policy|continuing|agree|consent)\b|akzeptieren|ablehnen|einstellungen|accepter|refuser|personnaliser|aceptar|rechazar|configurar).*",
    r"(?:we|this (?:web)?site|@S) (?:uses?|stores?|sets?) .*(?:cookies?|on your device).*",
    r".*\b(?:process(?:es)? data to measure|stores? (?:small )?files on your device)\b.*",
    r"(?:@S|wir) (?:speichert|speichern|verwenden|verwendet|nutzen|nutzt) .*(?:daten|cookies).*",
    r"(?:@S|nous) (?:dépose|déposons|utilise|utilisons) .*(?:traceurs|cookies).*",
    r"(?:@S|usamos|utilizamos|guardamos)\b.*(?:cookies|dispositivo|medir|audiencia|visita).*",
    r"your privacy matters\b.*",
    # ways to the top, past the navigation, to an account
    r"(?:back|return) to (?:the )?top",
    r"(?:nach oben|zum seitenanfang|haut de page|retour en haut|volver arriba|ir arriba)",
    r"(?:skip to (?:the )?(?:main )?content|toggle (?:navigation|menu)|menu|zum inhalt(?: springen)?|aller au contenu|saltar al contenido|menü|menú)",
    r"(?:signed|logged) in as \S+|(?:angemeldet als|connecté en tant que|sesión iniciada como) \S+",
    # legal
    r"(?:copyright|©|\(c\)) ?(?:©|\(c\))? ?0.*",
    r".*\b(?:all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\b.*",
    r".*\bis a trading name of\b.*|.*\bregistered office\b.*",
    r"the (?:information|content) (?:on|of) this (?:web)?site is provided\b.*",
    r"(?:(?:terms(?: of (?:use|service))?|privacy(?: policy)?|imprint|accessibility|impressum|datenschutz|agb|mentions légales|confidentialité|aviso legal|privacidad|legal)(?: ?[|·/] ?|$)){1,8}",
    # letters, sharing, following
    r"(?:subscribe|sign up) (?:to|for) (?:our|the) .*|(?:newsletter abonnieren|s'abonner à .*|abonnez-vous .*|suscríbase .*|suscribirse .*)",
    r"(?:enjoying|like) this\? .*|join 0 (?:readers|others)\b.*",
    r"follow (?:us|@S)\b.*|(?:folgen sie|suivez-nous|síganos)\b.*",
    r"share (?:this|on)\b.*|(?:partager|teilen|compartir)(?: (?:sur|auf|en) .*)?",
    r"(?:print|seite drucken|drucken|imprimer|imprimir) ?[|·/] ?.*",
    r"(?:advertisement|anzeige|publicité|publicidad|sponsored)\b.*",
    # comments and rating
    r"(?:leave|post|write) a comment|loading comments.*|sort by: .*",
    r"0 (?:comments?|kommentare?|commentaires?|comentarios?)\b.*",
    r"was this (?:page|article) (?:helpful|useful)\b.*|0 (?:people|readers|users) found this\b.*|rate this\b.*",
    r"(?:report a problem|report an issue|edit this page|suggest an edit)\b.*",
    # about the page
    r"page 0 of 0|seite 0 von 0|page 0 sur 0|página 0 de 0",
    r"(?:last updated|last modified|zuletzt geändert|aktualisiert|mis à jour|actualizado)\b.*0.*",
    r"0 min(?:utes?)? read|0 min(?:uten)? lesezeit|lecture : 0 min.*|0 min de lectura",
    r"version 0(?:\.0)* ?[|·].*",
    r"(?:written by the @S|made with (?:care|love)) .*",
    r"(?:previous|next|vorheriger|nächster|précédent|suivant|anterior|siguiente)(?: (?:article|page|post|beitrag|artikel|seite|artículo|página))? ?: .*",
    r"(?:article|page) (?:suivante?|précédente?) ?: .*|(?:artículo|página) (?:siguiente|anterior) ?: .*",
    r"(?:read also|see also|lesen sie auch|auch interessant|à lire aussi|lire aussi|lea también|vea también) ?: .*",
    r"(?:\S+(?: \S+)? \(0\) *){2,}",
]

#: Lines that open a list of links to other pages, or to parts of this one.
ASIDE_FORMS = [
    r"(?:related|recommended|similar|popular|recent|more)(?: (?:articles?|posts?|pages?|reading|links?|guides?))?(?: (?:this|last) (?:week|month))?",
    r"you (?:may|might) also (?:like|enjoy)|on this (?:site|page)|see also|read next|in this section",
    r"ähnliche (?:beiträge|artikel)|das könnte (?:sie|dich) auch interessieren|beliebte? .{0,20}|auf dieser seite",
    r"articles (?:liés|similaires|connexes)|à lire aussi|sur ce site|sur le même sujet",
    r"artículos relacionados|también le puede interesar|en este sitio|lo más leído",
]

_FRAME = re.compile("|".join(f"(?:{f})" for f in FRAME_FORMS), re.I)
_ASIDE = re.compile("|".join(f"(?:{f})" for f in ASIDE_FORMS), re.I)
_DIGITS = re.compile(r"\d+")
_CRUMB = re.compile(r"\s*[>»/›]\s*")
_MENU = re.compile(r"\s*[|·•]\s*|\s{2,}")
_ENDED = re.compile(r"[.!?:;…][\"'”»)]*$")


@lru_cache(10_000)
def _named(name: str) -> re.Pattern:
    return re.compile(rf"\b{re.escape(name)}\b", re.I)


def masked(line: str, name: str) -> str:
    text = _DIGITS.sub("0", line.strip())
    return _named(name).sub("@S", text) if name and name in text.lower() else text


def key_of(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63


def site_name(site: str | None) -> str:
    labels = [x for x in (site or "").lower().removeprefix("www.").split(".") if x]
    return labels[-2] if len(labels) > 1 else labels[0] if labels else ""


def _slug(text: str) -> str:
    """As urls have it: accented letters are '-' too."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")


def title_line(lines: list[str], title: str | None, url: str | None) -> int | None:
    """Where the page's title stands as a line of its own; by its url where the title is not given."""
    if title and title.strip():
        want = title.strip()
        return next((i for i, x in enumerate(lines) if x.strip() == want), None)
    path = re.sub(r"[?#].*$", "", url or "").rstrip("/").rsplit("/", 1)[-1]
    path = _slug(re.sub(r"\.\w{2,5}$", "", path))
    return next((i for i, x in enumerate(lines) if path and _slug(x) == path), None)


def is_paragraph(line: str) -> bool:
    return bool(_ENDED.search(line)) and len(line.split()) >= 5


def is_form(mask: str, known: dict[str, bool] | None) -> bool:
    """Whether a masked line has a form of frame lines; what was asked before is remembered."""
    if known is None:
        return bool(_FRAME.fullmatch(mask))
    found = known.get(mask)
    if found is None:
        if len(known) > REMEMBERED:
            known.clear()
        found = known[mask] = bool(_FRAME.fullmatch(mask))
    return found


def is_frame(line: str, mask: str, title: str | None, learned: set[int] | frozenset, known: dict[str, bool] | None = None) -> bool:
    """Whether a line is frame by its form or by its site's habit, wherever it stands."""
    if is_form(mask, known) or key_of(mask) in learned:
        return True
    if title and title in line and line != title:
        rest = line.replace(title, " ").strip()
        parts = _CRUMB.split(line)
        if len(parts) > 1 and parts[-1].strip() == title:
            return True  # breadcrumb
        if re.fullmatch(r"[|–—·:-]\s*\S.{0,60}|\S.{0,60}\s*[|–—·:-]", rest) and "@S" in mask:
            return True  # window title
    if not _MENU.search(line):
        return False
    items = [x for x in _MENU.split(line.strip()) if x]
    return len(items) >= 3 and all(len(x.split()) <= 3 for x in items) and sum(key_of(masked(x, "")) in learned for x in items) * 2 > len(items)


#: Which blocks a line of each form stands in; the text lost the tags, so the lines imply them.
_ITEM = re.compile(r"\s*(?:[-*+•–]|\d{1,3}[.)])\s+\S")
_CELLS = re.compile(r"\s*\|\s*|\t+|\s{3,}")
_COMMAND = re.compile(r"(?:\s{4,}|[$>#%]\s|>>>\s)\S")
#: Tags whose content is not shown.
HIDDEN = frozenset(("header", "aside", "frame"))


class Node:
    """An element: a tag, what it holds, and for a leaf its line and number."""

    __slots__ = ("tag", "parent", "inside", "line", "number")

    def __init__(self, tag: str, parent: Node | None = None, line: str = "", number: int = 0):
        self.tag, self.parent, self.inside, self.line, self.number = tag, parent, [], line, number
        if parent is not None:
            parent.inside.append(self)


class TreeBuilder:
    """Builds a page's tree from its lines: implied tags are opened where a line needs them and closed where it cannot stand in them.

    The page begins in its header. The title line closes that and opens the main region; a list of links to other pages opens an aside in it, which a
    paragraph closes. Inside a region an item needs a list, a row of cells a table, a command a block of code, any other line a
    paragraph; blank lines close all of these. A line that is frame by itself is an element of its own wherever it stands.
    """

    IMPLIED = {"li": "ul", "tr": "table", "line": "pre"}

    def __init__(self) -> None:
        self.root = Node("page")
        self.region = Node("header", self.root)
        self.block: Node | None = None

    def blank(self) -> None:
        self.block = None

    def title(self, line: str, number: int) -> None:
        self.region, self.block = Node("main", self.root), None
        Node("h1", self.region, line, number)

    def add(self, line: str, number: int, opens_aside: bool, frame: bool) -> None:
        if self.region.tag != "header" and opens_aside:
            main = self.region if self.region.tag == "main" else self.region.parent
            self.region, self.block = Node("aside", main), None
        elif self.region.tag == "aside" and not frame and is_paragraph(line):
            self.region, self.block = self.region.parent, None
        if frame:
            self.block = None
            Node("frame", self.region, line, number)
            return
        tag = "li" if _ITEM.match(line) else "line" if _COMMAND.match(line) else "tr" if _CELLS.search(line) and len(_CELLS.split(line.strip())) > 2 else "p"
        holder = self.IMPLIED.get(tag)
        if holder is None:
            self.block = None
        elif self.block is None or self.block.tag != holder:
            self.block = Node(holder, self.region)
        Node(tag, self.block or self.region, line, number)


def visible_leaves(node: Node) -> Iterator[Node]:
    """The leaves that are shown, in their order: hidden elements hide all that they hold."""
    if node.tag not in HIDDEN:
        if node.number:
            yield node
        for child in node.inside:
            yield from visible_leaves(child)


def rendered(node: Node) -> str:
    """All visible text: blocks apart by an empty line, items with a dash each, the cells of a table in columns."""
    out: list[str] = []

    def block(n: Node) -> None:
        leaves = [x for x in n.inside if x.tag not in HIDDEN]
        if n.tag == "ul":
            out.append("\n".join("- " + re.sub(r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s+", "", x.line).strip() for x in leaves))
        elif n.tag == "table":
            rows = [[c.strip() for c in _CELLS.split(x.line.strip().strip("|"))] for x in leaves]
            widths = [max(len(r[i]) for r in rows if i < len(r)) for i in range(max(map(len, rows)))]
            out.append("\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=False)).rstrip() for r in rows))
        elif n.tag == "pre":
            out.append("\n".join(x.line.rstrip() for x in leaves))
        elif n.number:
            out.append(n.line.strip())
        elif n.tag not in HIDDEN:
            for child in leaves:
                block(child)

    block(node)
    return "\n\n".join(out)


def page_tree(text: str, title: str | None, url: str | None, site: str | None, learned: set[int] | frozenset = frozenset(), known: dict[str, bool] | None = None) -> Node | None:
    """The tree of a page, or None for one that has no line of its title: such a page is nothing but frame.

    ``known`` remembers which lines are frame, for pages of one site and title.
    """
    lines = text.split("\n")
    at = title_line(lines, title, url)
    if at is None:
        return None
    name, shown = site_name(site), lines[at].strip()
    builder = TreeBuilder()
    for i, line in enumerate(lines):
        if not line.strip():
            builder.blank()
        elif i == at:
            builder.title(line, i + 1)
        else:
            mask = masked(line, name)
            builder.add(line, i + 1, bool(_ASIDE.fullmatch(mask)), is_frame(line.strip(), mask, shown, learned, known))
    return builder.root


def body_lines(text: str | None, title: str | None, url: str | None, site: str | None, learned: set[int] | frozenset = frozenset(), known: dict[str, bool] | None = None) -> list[int]:
    """Numbers, from 1, of the lines of the page's own body."""
    tree = page_tree(text, title, url, site, learned, known) if text else None
    return [leaf.number for leaf in visible_leaves(tree)] if tree else []


def line_places(text: str | None, title: str | None, url: str | None, site: str | None, known: dict[str, bool] | None = None) -> dict[int, bool]:
    """Masked line (and item of a menu) -> whether it stands outside the body only: before the title or past the last paragraph."""
    if not text:
        return {}
    lines = text.split("\n")
    at, name = title_line(lines, title, url), site_name(site)
    stripped = [x.strip() for x in lines]
    masks = [masked(x, name) for x in lines]
    last = max((i for i, x in enumerate(stripped) if is_paragraph(x) and not is_form(masks[i], known)), default=-1)
    found: dict[int, bool] = {}
    for i, x in enumerate(stripped):
        if not x or i == at:
            continue
        outside = at is None or i < at or i > last
        found[key_of(masks[i])] = found.get(key_of(masks[i]), True) and outside
        if outside and (at is None or i < at):
            for item in _MENU.split(x):
                if item and item != x:
                    found.setdefault(key_of(masked(item, "")), True)
    return found


def site_frames(pages: DataFrame, least: int = REPEATS, share: float = REPEAT_SHARE, outside: float = OUTSIDE) -> DataFrame:
    """``site, frames``: keys of the lines that the site's pages repeat outside their bodies, over all its pages.

    A line costs a row a page and is combined by (site, line) before the shuffle, so a site of a third of all pages is no
    hot task; a site has at most its lines a page over ``share`` such keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bool] = {}
        for batch in batches:
            sites, keys, out = [], [], []
            for site, text, title, url in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for key, is_outside in line_places(text, title, url, site, known).items():
                    sites.append(site)
                    keys.append(key)
                    out.append(int(is_outside))
            yield pa.RecordBatch.from_arrays([pa.array(sites, pa.string()), pa.array(keys, pa.int64()), pa.array(np.array(out, np.int32))], names=["site", "key", "outside"])

    known = pages.where("site is not null")
    counted = known.select("site", "text", "title", "url").mapInArrow(run, "site string, key long, outside int")
    counted = counted.groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("outside").alias("n_outside"))
    total = known.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    often = counted.where(F.col("n") >= least).join(total, "site").where((F.col("n") >= share * F.col("pages")) & (F.col("n_outside") >= outside * F.col("n")))
    return often.groupBy("site").agg(F.collect_set("key").alias("frames"))


def _paged(pages: DataFrame, id_col: str) -> DataFrame:
    """``id, text, title, url, site, frames``: each page with the frame lines of its site."""
    narrow = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "text", "title", "url", "site")
    # A row a site, of which the run time knows the size before it chooses a join.
    return narrow.join(site_frames(pages), "site", "left").select("id", "text", "title", "url", "site", "frames")


class _Frames:
    """The frame lines of each site as a set, which is made once for pages of a site that follow one another."""

    def __init__(self) -> None:
        self.of: dict[str | None, frozenset] = {}

    def __call__(self, site: str | None, keys: pa.Scalar) -> frozenset:
        found = self.of.get(site)
        if found is None:
            if len(self.of) >= SITES:
                self.of.clear()
            found = self.of[site] = frozenset(keys.as_py() or ())
        return found


def main_body(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``<id_col>, line_no``: the lines of each page's own body, the visible leaves of its tree.

    Lines are split at newlines and counted from 1, blank ones too. A page of null or empty text, or without a line of its
    title (one of nothing but frame), gives no rows; rows without id are left out; a null site has no learned frame,
    a null title is sought by the url's last part. Rows that repeat an id give their lines once. Empty tables give no rows; other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frames = {}, _Frames()
        for batch in batches:
            rows, numbers = [], []
            for i, (text, title, url, site) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                found = body_lines(text, title, url, site, frames(site, batch.column(5)[i]), known)
                rows.extend([i] * len(found))
                numbers.extend(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())], names=["id", "line_no"])

    kind = pages.schema[id_col].dataType.simpleString()
    return _paged(pages, id_col).mapInArrow(run, f"id {kind}, line_no int").distinct().withColumnRenamed("id", id_col)


def body_texts(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``<id_col>, body``: the visible text of each page with an id, rendered from its tree; empty for a page of nothing but frame, null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, frames = {}, _Frames()
        for batch in batches:
            bodies = []
            for i, (text, title, url, site) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                tree = page_tree(text, title, url, site, frames(site, batch.column(5)[i]), known) if text else None
                bodies.append(rendered(tree) if tree else None if text is None else "")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bodies, pa.string())], names=["id", "body"])

    kind = pages.schema[id_col].dataType.simpleString()
    return _paged(pages, id_col).mapInArrow(run, f"id {kind}, body string").withColumnRenamed("id", id_col)
