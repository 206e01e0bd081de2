"""Text functions: every one is a Column of a Column, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, inside a character class.
WS = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

#: Words that the lexical index leaves out.
INDEX_STOPWORDS = (
    "the a an and or but of to in on at by for with from into is are was were be been being it its this that these those as their "
    "they them his her has have had not can will if we you your i how does did do what who why where when which"
).split()

#: Words that grounding does not grade.
GROUNDING_STOPWORDS = (
    "the a an and or but of to in on at by for with from into through is are was were be been being it its this that these those "
    "as their they them also can will which when where while his her has have had not often usually without what how who why do "
    "does did me tell about explain explained facts information overview history definition important work works known anything "
    "said much many each would could some such very more after before"
).split()

#: Suffixes in the order in which they are tried, and the least length of what must stay.
STEM_SUFFIXES = ("ization", "isation", "ication", "ation", "ition", "tion", "ing", "ed", "ate", "ize", "ise")
STEM_LEAST = 4

#: Shapes of credentials, applied in this order; a group 1 is kept.
SECRETS = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
    r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,}",
    r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{30,}\b",
    r"\bnpm_[A-Za-z0-9]{36}\b",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bAIza[0-9A-Za-z_-]{35}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"(?i)\b(Bearer\s+)[A-Za-z0-9._~+/-]{20,}=*",
    r"""(?i)\b((?:api[_-]?key|access[_-]?token|auth[_-]?token|secret|password|passwd)\s*[:=]\s*["']?)[^\s"']{6,}""",
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"

#: Named character references that are decoded; &amp; comes last.
ENTITIES = {
    "nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "copy": "©", "reg": "®", "trade": "™", "eacute": "é", "egrave": "è", "agrave": "à", "uuml": "ü",
    "ouml": "ö", "auml": "ä", "ntilde": "ñ", "ccedil": "ç",
}

#: Tags around text that a tool put into a user's turn.
HARNESS_TAGS = ("system-reminder", "command-name", "command-message", "command-args", "local-command-stdout", "local-command-stderr", "user-prompt-submit-hook")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WS}]+|[{WS}]+$", "")


def normalize_text(text: Column) -> Column:
    """Without carriage returns, runs of blanks and tabs as one blank, at most one empty line in a row, trimmed; null is empty."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "[ \t]+", " ")
    return trimmed(F.regexp_replace(one, "\n{3,}", "\n\n"))


def tokens(text: Column) -> Column:
    """The words of a text between white space, as of :func:`normalize_text`. The pattern asks for ASCII first, which is quicker."""
    return F.regexp_extract_all(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), F.lit(f"[!-~[^{WS}]]+"), F.lit(0))


def worded(text: Column) -> Column:
    """Whether a text has anything but white space."""
    return F.coalesce(text.rlike(f"[^{WS}]"), F.lit(False))


def _runs(text: Column, but: str = "") -> Column:
    """Whole runs of letters, digits and apostrophes, of 2 to 32 characters; a pattern sorts out the rest, so no word is looked at twice."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![a-z0-9']){but}[a-z0-9']{{2,32}}(?![a-z0-9'])"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Distinct lexical terms of a query, in order; stopwords are looked up like any word."""
    return F.array_distinct(_runs(text))


def index_terms(text: Column) -> Column:
    """Lexical terms of a record, with repeats, without stopwords."""
    return _runs(text, f"(?!(?:{'|'.join(INDEX_STOPWORDS)})(?![a-z0-9']))")


def stem(word: Column) -> Column:
    out = F.when(F.lit(False), word)
    for suffix in STEM_SUFFIXES:
        fits = word.endswith(suffix) & (F.length(word) >= STEM_LEAST + len(suffix))
        out = out.when(fits, F.substring(word, F.lit(1), F.length(word) - len(suffix)))
    out = out.when(word.endswith("e") & (F.length(word) > STEM_LEAST), F.substring(word, F.lit(1), F.length(word) - 1))
    return out.otherwise(word)


def without_possessive(word: Column) -> Column:
    cut = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(word.endswith("'s"), cut(2)).when(word.endswith("s'"), cut(1)).when(word.endswith("'"), cut(1)).otherwise(word)


def grounding_words(text: Column) -> Column:
    """The words of a query that grounding grades: distinct, in order."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), without_possessive)
    kept = F.filter(found, lambda w: (w != "") & ((F.length(w) >= 3) | w.rlike("[0-9]")) & ~w.isin(GROUNDING_STOPWORDS))
    return F.array_distinct(kept)


def redact(text: Column) -> tuple[Column, Column]:
    """(text without secrets and addresses, how many there were); each shape is sought in what the ones before left."""
    count = F.lit(0)
    for pattern in (*SECRETS, EMAIL):
        count = count + F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
        by = "[email]" if pattern is EMAIL else "$1[redacted]" if "\\b((?:" in pattern or "(Bearer" in pattern else "[redacted]"
        text = F.regexp_replace(text, pattern, by)
    return text, count


def clean_turn(text: Column) -> Column:
    for tag in HARNESS_TAGS:
        text = F.regexp_replace(text, rf"<{tag}>[\s\S]*?</{tag}>", "")
    return trimmed(F.regexp_replace(text, "\n{3,}", "\n\n"))


def short_title(text: Column) -> Column:
    """The first line that is not blank, cut to 80 characters with an ellipsis."""
    line = trimmed(F.coalesce(F.get(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trimmed(x) != ""), F.lit(0)), F.lit("")))
    return F.when(F.length(line) > 80, F.concat(F.regexp_replace(F.substring(line, 1, 79), f"[{WS}]+$", ""), F.lit("…"))).otherwise(line)


def slug_base(heading: Column) -> Column:
    """The anchor of a heading before repeats are numbered."""
    plain = F.regexp_replace(F.coalesce(heading, F.lit("")), "`([^`]*)`", "$1")
    plain = F.lower(trimmed(F.regexp_replace(plain, r"\[([^\]]+)\]\([^)]*\)", "$1")))
    return F.replace(F.regexp_replace(plain, r"[^\p{L}\p{N} _-]", ""), F.lit(" "), F.lit("-"))


def decode_entities(text: Column) -> Column:
    """Named references of :data:`ENTITIES` and &amp;. Numeric ones need code points: see ``operators.extract``."""
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def front_matter_value(text: Column, key: str) -> Column:
    """The value of ``key`` in a leading block between lines of three dashes; quotes around it are taken off."""
    block = F.regexp_extract(F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r", ""), r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    line = rf"(?m)^{key}:\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|(.+?))\s*$"
    found = [F.regexp_extract(block, line, i) for i in (1, 2, 3)]
    return F.when(block.rlike(line), F.coalesce(*[F.when(x != "", x) for x in found], F.lit("")))


def route(path: Column) -> Column:
    """The route of a source path: no extension, no ordering prefixes, index and readme pages as their folder."""
    out = F.regexp_replace(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")), r"^\./", "")
    out = F.regexp_replace(out, r"(?i)\.(md|mdx|html|txt)$", "")
    out = F.regexp_replace(out, r"(^|/)[0-9]+-", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)(^|/)(index|readme)$", "$1"), "/+$", "")


def preview(text: Column) -> Column:
    return F.substring(text, 1, 220)


def fnv1a32(word: Column, seed: int = 0) -> Column:
    """FNV-1a over the characters of an ASCII word, as a long from 0 to 2**32 - 1."""
    start = F.lit((0x811C9DC5 ^ seed) & 0xFFFFFFFF).cast("long")
    mask = F.lit(0xFFFFFFFF).cast("long")

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(F.ascii(c).cast("long"))
        # x * 0x01000193 without overflow: the low 32 bits of x * 0x193 and of x shifted by 24.
        return (x * F.lit(0x193) + F.shiftleft(x.bitwiseAND(F.lit(0xFF)), 24)).bitwiseAND(mask)

    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), start, step)


def glob_pattern(glob: str) -> str:
    """A regular expression that matches what a path glob does, in any case: ``**/``, ``**``, ``*``, ``?`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        rest = glob[i:]
        for sign, by in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if rest.startswith(sign):
                out, i = out + by, i + len(sign)
                break
        else:
            c = glob[i]
            if c == "{" and "}" in rest:
                out, depth = out + "(?:", depth + 1
            elif c == "}" and depth:
                out, depth = out + ")", depth - 1
            elif c == "," and depth:
                out += "|"
            else:
                out += "\\" + c if c in r"\.+^$()[]{}|" else c
            i += 1
    return f"(?i)^{out}$"


#: Fixed value: paths that a folder source takes unless told otherwise.
DEFAULT_GLOB = "**/*.{md,mdx,html,txt}"


def glob_match(path: Column, glob: str = DEFAULT_GLOB) -> Column:
    return path.rlike(glob_pattern(glob))
