"""Expressions that cut texts: windows, sentences, headings, packing. All stay in the JVM."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.words import squeeze

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["Inc", "Ltd", "Corp", "No", "Nos", "Mr", "Ms", "Dr", "Jr", "Sr", "St", "vs", "etc", "i.e", "e.g", "U.S", "Sec"]
HELD = "∎"  # stands for a full stop that ends nothing
CUT = "\u001f"

# Shapes of headings and noise lines in agreements.
ARTICLE = r"(?m)^(ARTICLE\s+(?:\d+|[IVXLC]+))\s*\n\s*(.+?)$"
SECTION = r"(?m)^(Section\s+\d+\.\d+)\.\s{1,4}(\S.+?)(?:\.\s|\s{2,})"
SUBSECTION = r"(?m)^\s*(\([a-z]\)|\([ivxlc]+\)|\(\d+\))\s+"
DEFINITION = "(?m)^[\"“]([^\"”]+)[\"”](?::|\\s+means?\\b)"
PAGE_LINE = r"(?m)^\d+\s*$|^\(NY\)\s+\d+/.*\.doc\s*$"
LEADERS = r"\.{5,}"
HEADING = r"(?imd)^\s*(?:(?:section|article|clause)\s+)?(?:[ivxlcdm]+|\d+(?:\.\d+)*|[a-z])[\).\s:-]{1,5}([A-Z][A-Za-z0-9 ,/&'().\-]{2,90})\s*$"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once, however often the body and the functions in
    it name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(text: Column) -> Column:
    """Page-number and footer lines go; at most one empty line in a row. CRLF becomes LF."""
    t = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), PAGE_LINE, "")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences ended by . ; : ! ? and white space, abbreviations and section numbers kept whole."""
    t = text
    for a in ABBREVIATIONS:
        t = F.regexp_replace(t, a.replace(".", r"\.") + r"\.", a.replace(".", HELD) + HELD)
    t = F.regexp_replace(t, r"(\d+)\.(\d+)\.", "$1" + HELD + "$2" + HELD)
    parts = F.split(t, r"(?<=[.;:!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(F.replace(s, F.lit(HELD), F.lit(".")), r"^\s+|\s+$", "")), lambda s: s != "")


def word_windows(text: Column, max_tokens: int, overlap: int = 15) -> Column:
    """Windows of whole words that hold about 0.9 x max_tokens, `overlap` words shared."""
    step = max(int(max_tokens * 0.9 / 1.4), overlap + 1)
    words = F.filter(F.split(squeeze(text), " "), lambda w: w != "")
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - step) / (step - overlap)).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k * (step - overlap) + 1, F.lit(step)), " "))


def pack(parts: Column, limit: int) -> Column:
    """Neighbouring parts joined by empty lines while their lengths (separators apart) stay
    within `limit`; a longer part stays alone."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        over = (F.length(a["cur"]) + F.length(p) > limit) & (a["cur"] != "")
        return F.struct(
            F.when(over, p).when(a["cur"] == "", p).otherwise(F.concat(a["cur"], F.lit("\n\n"), p)).alias("cur"),
            F.when(over, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def window(text: Column, start: Column, length: Column, margin: int) -> Column:
    """Text around a span (0-based start), `margin` characters on each side, trimmed."""
    lo = F.greatest(start - margin, F.lit(0))
    hi = F.least(start + length + margin, F.length(text))
    return F.trim(F.substring(text, lo + 1, hi - lo))


def aligned_window(text: Column, start: Column, length: Column, margin: int) -> Column:
    """`window` widened outwards to blanks or line ends; a side without one stays as it is."""
    lo = F.greatest(start - margin, F.lit(0))
    hi = F.least(start + length + margin, F.length(text))
    head, tail = F.substring(text, F.lit(1), lo), F.substring(text, hi + 1, F.length(text))
    left = F.when(F.rlike(head, F.lit("[ \\n]")), F.regexp_extract(head, r"[^ \n]*$", 0)).otherwise(F.lit(""))
    right = F.when(F.rlike(tail, F.lit("[ \\n]")), F.regexp_extract(tail, r"^[^ \n]*", 0)).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(left, F.substring(text, lo + 1, hi - lo), right), r"^\s+|\s+$", "")


BLOCK_TAGS = ("br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4")  # fixed values: tags that begin a line
# What a page is made of: a comment or declaration, an element whose content is no text, a tag, text.
_MARKUP = r"(?is)<!--.*?(?:-->|$)|<(?:script|style)\b.*?</(?:script|style)\s*>|<[!?/a-z][^>]*>|[^<]+|<"


def unescaped(text: Column) -> Column:
    """Character references resolved once: numbers, and the names that HTML defines."""
    names = F.create_map(*[F.lit(x) for k, v in sorted(html5.items()) if k.endswith(";") for x in (k[:-1], v)])
    number = lambda p: F.regexp_extract(p, r"^#([xX][0-9a-fA-F]{1,6}|[0-9]{1,7});?", 1)

    def resolved(p: Column) -> Column:
        n, name = number(p), F.regexp_extract(p, "^([A-Za-z][A-Za-z0-9]{1,31});", 1)
        point = F.when(F.rlike(n, F.lit("^[xX]")), F.conv(F.substring(n, 2, 7), 16, 10)).otherwise(F.conv(n, 10, 10)).cast("long")
        valid = (n != "") & (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, point)), 8, "0")), "UTF-32")
        named = F.try_element_at(names, name)
        rest = lambda skip: F.substring(p, skip + 1, F.length(p))
        tail = rest(F.length(F.regexp_extract(p, "^#[0-9a-fA-FxX]{1,7};?", 0)))
        return F.when(valid, F.concat(char, tail)).when((name != "") & named.isNotNull(), F.concat(named, rest(F.length(name) + 1))).otherwise(F.concat(F.lit("&"), p))

    done = F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")
    return F.when(F.contains(text, F.lit("&")), done).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Text of a page, well-formed or not: scripts, styles and comments dropped, line ends at
    block tags, references resolved, blanks and empty lines squeezed.

    The page is read as a run of markup and text; what cannot be either is text."""
    kind = lambda p: F.lower(F.regexp_extract(p, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
    dropped = lambda p: F.when(kind(p).isin("script", "style"), " ").otherwise(F.when(kind(p).isin(*BLOCK_TAGS) & (F.lower(F.substring(p, 1, 4)) != "</br"), "\n").otherwise(""))
    text = F.array_join(F.transform(F.regexp_extract_all(html, F.lit(_MARKUP), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit("<")) & (p != "<"), dropped(p)).otherwise(p)), "")
    rows = F.transform(F.split(F.regexp_replace(unescaped(text), r"[ \t\r\f\x0B]+", " "), "\n"), lambda r, i: F.when(i == 0, r).otherwise(F.ltrim(r)))
    return F.regexp_replace(F.regexp_replace(F.array_join(rows, "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def pieces(text: Column, pattern: str) -> Column:
    """[(at, heading, body)] of a text cut where `pattern` begins; `at` is 0-based.

    What stands before the first heading is a piece with heading ''.  A text without any is
    one such piece."""
    marked = F.regexp_replace(text, pattern, CUT + "$0")
    parts = F.split(marked, CUT)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,body:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        return F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p.alias("body")))).alias("out"))

    cut = F.aggregate(parts, start, step, lambda a: a["out"])
    return F.filter(cut, lambda x: F.regexp_replace(x["body"], r"\s+", "") != "")


def first_json(text: Column) -> Column:
    """The JSON value in free text: inside a code fence, or from the first { or [."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    return F.nullif(F.regexp_extract(body, r"(?s)[\[{].*[\]}]", 0), F.lit(""))


# How generated questions are marked, numbered, or stand alone on a line.
MARKED = r"(?:\*\*Question:\*\*|Q\d+[:.]\s*(?:\*\*Question:\*\*)?\s*)(.*?)(?:\n|$)"
NUMBERED = r"(?m)^\s*\d+\.\s+(.+?)$"
LINE = r"(?m)^(.*)$"


def questions(text: Column) -> Column:
    """Questions in generated text: marked ones, else numbered ones, else lines that ask; those
    of more than ten characters."""

    def found(pattern: str, edge: str, asks: bool) -> Column:
        every = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        bare = F.transform(every, lambda s: F.regexp_replace(s, f"^{edge}+|{edge}+$", ""))
        return F.filter(bare, lambda s: (F.length(s) > 10) & (F.endswith(s, F.lit("?")) | F.lit(not asks)))

    stages = [found(MARKED, r"[\s*]", False), found(NUMBERED, r"\s", True), found(LINE, r"[\s*\-]", True)]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in stages], F.when(text.isNotNull(), F.array().cast("array<string>")))


def breakpoints(likeness: Column, threshold: Column, least: int = 3) -> Column:
    """Positions after which a text breaks: likeness to the next sentence under the threshold
    and at least `least` sentences since the last break."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("out"))
    numbered = F.transform(likeness, lambda x, i: F.struct(i.alias("i"), x.alias("x")))

    def step(a: Column, e: Column) -> Column:
        hit = (e["x"] < threshold) & (e["i"] - a["last"] >= least)
        return F.struct(
            F.when(hit, e["i"] + 1).otherwise(a["last"]).alias("last"),
            F.when(hit, F.concat(a["out"], F.array(e["i"] + 1))).otherwise(a["out"]).alias("out"),
        )

    return F.aggregate(numbered, start, step, lambda a: a["out"])


def diverse(ranked: Column, k: int, limit: float = 0.5) -> Column:
    """First k of `ranked` (structs with an array field `w`) that are no more alike than
    `limit` to any taken before; an item without words is like nothing."""
    empty = F.slice(ranked, 1, 0)

    def step(a: Column, e: Column) -> Column:
        alike = F.exists(a, lambda p: (F.size(p["w"]) > 0) & (F.size(e["w"]) > 0) & (F.size(F.array_intersect(p["w"], e["w"])) / F.greatest(F.size(F.array_union(p["w"], e["w"])), F.lit(1)) > limit))
        return F.when((F.size(a) >= k) | alike, a).otherwise(F.concat(a, F.array(e)))

    return F.aggregate(ranked, empty, step)
