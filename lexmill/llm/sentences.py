"""Sentence boundaries across languages and scripts.

A text is parted at empty lines.  Within a paragraph, quotation marks and brackets are
paired first; then

* every run of terminators is a node of a lattice and every stretch between two nodes an arc,
  the sentence it would make.  An arc is scored by whether a sentence that begins there ends at
  its terminator (the word before: abbreviation, initial, number, item mark; what the mark
  stands in: decimals, an open quotation or bracket; the word after), by the likely ends it
  runs over, and by what it looks like as a sentence.  The best path gives the sentences;
* scripts without blanks are parted into words by the dictionary lattice (`lattice`).  In Thai,
  which has no mark, each gap between words is classified by the word that ends and the word
  that opens; in Chinese and Japanese the word after a closing quote tells whether the
  sentence goes on.

Positions are Unicode code points; sentences together cover all but outer white space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import lattice
from lexmill.tables import read

OPENING = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "〈": "〉", "《": "》", "【": "】", "［": "］", "‚": "‘", "‘": "’"}
CLOSING = set(OPENING.values()) | {'"'}
# Full stops that end a sentence whatever follows: ideographic, Indic, Arabic, Armenian,
# Ethiopic, Khmer, Burmese, Tibetan, Mongolian, Canadian syllabics, Hebrew (fixed values).
FULL = "。｡︒।॥۔։።፨។៕။༎།᠃᠉᙮׃"
MARKS = ".!?…！？．؟፧‼⁇⁈⁉⸮" + FULL
_EMPTY_LINE = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*| \s*")
_RUN = re.compile(f"[{MARKS}]+(?:\\s?\\.(?=\\s?\\.))*")
_ITEM = re.compile(r"^[\s\"“«(\[]*(?:(?:\d{1,3}|[A-Za-z]|[ivxlIVXL]{1,5})(?:\.\d{1,3})*[.)]?|[(\[](?:\d{1,3}|[A-Za-z]|[ivxl]{1,5})[)\]]|(?:§|Art|ART|Section|SECTION|Article|ARTICLE|Artikel|Artículo|Abschnitt|Clause)\.?\s*[\dIVXL]+(?:\.\d+)*)\.$")
_LAST_WORD = re.compile(r"[^\s(\[{“„«\"'’]+$")
# A company form that takes no stop may close a sentence; a capital or item number goes on.
_UNSTOPPED = re.compile(r"(?<= )plc(?=\s+(?:[\"“(]?[A-Z][\w'-]*\s|\d{1,3}\.\d{1,3}\s+[A-Z]))")
_THAI = re.compile("[฀-๿]")
_DEVANAGARI = re.compile("[ऀ-ॿ]")
_HAN = re.compile("[぀-ヿ㐀-鿿豈-﫿\U00020000-\U0002ffff]")

# Abbreviations after which a capital or a number goes on in the same sentence.
NEVER = set(
    """mr mrs ms dr prof hon rev st jr messrs mme mlle mm m me sr sra srta dra d dña hr fr frl herr ing dipl
    no nos nr núm num nº art arts sec secs para paras par pág págs pag pp p ch cl fig figs vol ed eds cf vs v viz approx ca
    abs bzw vgl ggf evtl inkl zzgl abzgl lit rn bd hrsg geb gez betr bspw ziff tit e.g i.e eg ie z.b u.a d.h i.d.r u.s.w
    p.ex p.ej p.a n jan feb mar apr jun jul aug sep sept oct nov dec exh app sched cap apdo avda dpto av bd tél tel c.-à-d réf
    रु डॉ श्री प्रो सं पृ د أ م ص ج""".split()
)
# Abbreviations that may also end a sentence: what follows decides.
MAYBE = set("inc co corp ltd llc llp plc gmbh ag kg s.a sa s.l s.r.l n.v b.v l.l.c l.p p.l.c al etc usw p.m a.m u.s u.k u.n e.u cie cía bros dept est ud uds u.a.m".split())
GOES_ON = {"co": {"kg", "kgaa", "ltd", "inc", "llc", "ohg"}}
NAMED = {"exhibit", "schedule", "annex", "appendix", "section", "part", "class", "series", "anlage", "anhang", "annexe", "anexo", "article", "clause", "tranche", "unit", "phase", "table", "figure", "option", "lot", "building"}
MONTHS = set(
    "januar februar märz april mai juni juli august september oktober november dezember jänner".split()
)


def words_of(text: str, known) -> list[tuple[int, int, str]]:
    """(start, end, word): lattice words of spaceless runs, other runs between blanks whole."""
    out = []
    for m in _TOKEN.finditer(text):
        if lattice.RUN.match(m.group()):
            out += [(m.start() + a, m.start() + b, m.group()[a:b]) for a, b, _ in lattice.words(m.group(), known)]
        else:
            out.append((m.start(), m.end(), m.group()))
    return out


_TOKEN = re.compile(f"[{lattice.SPACELESS}]+|[^\\s{lattice.SPACELESS}]+")
_THAI_OPEN, _THAI_LINK, _THAI_FINAL, _THAI_TITLE = (frozenset(x) for x in (lattice.THAI_OPEN, lattice.THAI_LINK, lattice.THAI_FINAL, lattice.THAI_TITLE))


def _thai_ends(text: str, depth: np.ndarray, known) -> list[int]:
    """Ends of Thai statements: gaps before an opening word, behind a blank or a final word."""
    tokens = words_of(text, known)
    ends = []
    for (_, e0, before), (s1, _, after) in zip(tokens, tokens[1:]):
        if depth[s1] or after not in _THAI_OPEN or before in _THAI_LINK or before in _THAI_TITLE:
            continue
        if s1 > e0 or before in _THAI_FINAL:
            ends.append(e0)
    return ends


def _goes_on(rest: str, known) -> bool:
    """Whether the first word after a closing quote is a particle that carries the sentence on."""
    run = lattice.RUN.match(rest)
    if not run:
        return False
    a, b, _ = lattice.words(run.group()[:24], known)[0]
    return rest[a:b] in _PARTICLES


_PARTICLES = frozenset(lattice.JAPANESE_PARTICLE + lattice.CHINESE_PARTICLE)


def pairs(text: str) -> np.ndarray:
    """How many paired quotations and brackets each position stands in (marks themselves: the
    inside of their pair). Marks without a partner in the paragraph count for nothing."""
    depth = np.zeros(len(text) + 2, dtype=np.int64)
    stack: list[tuple[str, int]] = []
    for i, ch in enumerate(text):
        if ch == '"':
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < len(text) else " "
            own = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == '"'), None)
            if own is not None and not (before.isspace() and not after.isspace()):
                depth[stack[own][1]] += 1
                depth[i + 1] -= 1
                del stack[own:]
            elif own is None and (before.isspace() or before in OPENING or not i or _HAN.match(before)):
                stack.append(('"', i))
        elif ch in CLOSING and any(OPENING[o] == ch for o, _ in stack if o != '"'):
            if ch == "’" and i + 1 < len(text) and text[i + 1].isalpha():
                continue
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] != '"' and OPENING[stack[k][0]] == ch)
            depth[stack[k][1]] += 1
            depth[i + 1] -= 1
            del stack[k:]
        elif ch in OPENING:
            if ch == "‘" and i and text[i - 1].isalnum():
                continue
            stack.append((ch, i))
    return np.cumsum(depth)[: len(text) + 1]


LOOK = 240  # characters next to a mark that rules on words read
_NEXT = re.compile(r"\S")


def _opens(rest: str) -> bool:
    """Whether `rest` (without leading blanks) can open a sentence."""
    ch = rest[0]
    if ch in OPENING or ch in "\"'’¿¡§*•–—-":
        inner = rest.lstrip("\"'’¿¡([{“„«‹‘‚「『（*•–—- \t")
        if ch in "–—-" or not inner:
            return bool(inner) and not inner[0].islower()
        return ch in "¿¡§•*" or not inner[0].islower() or _ITEM.match(rest.split(None, 1)[0].rstrip(".") + ".") is not None
    if ch.islower():
        word = re.match(r"\w+", rest).group()
        return any(c.isupper() for c in word[1:3])
    return ch.isalnum() or ch in "$€£¥#@%&" or not ch.isascii()


def _stops(text: str, start: int, at: int, end: int, after: int) -> bool:
    """Whether the marks text[at:end] end a sentence begun at `start`, with text going on at
    `after` (closing marks lie between end and after)."""
    marks, found = text[at:end], _NEXT.search(text, after)
    if not found:
        return True
    rest = text[found.start() : found.start() + LOOK]
    spaced = text[after].isspace()
    last = marks[-1]
    before = text[max(start, at - LOOK) : at]
    if last in FULL:
        return True
    if last in "！？" and not spaced:
        return True
    if last == "．" and not spaced:
        return not (before[-1:].isdigit() and rest[0].isdigit())
    if "…" in marks or marks.startswith("..") or ". ." in marks:
        return spaced and _opens(rest) and not rest[0].isdigit()
    if last in "!?؟！？":
        return _opens(rest) and (spaced or not rest[0].isdigit())
    # a single full stop
    found = _LAST_WORD.search(before)
    word = found.group() if found else ""
    bare = word.lower().strip("*_\"'’”»)")
    if not spaced:
        # A new sentence without a blank: a word of lower-case letters or digits, then a capital.
        if after > end:
            return _opens(rest)
        if not rest[0].isupper() and not _HAN.match(rest[0]):
            return False
        if len(word) > 1 and word[-1].isalpha() and word[-2:].islower() and "." not in word and bare not in NEVER and bare not in MAYBE and "@" not in word and "/" not in word:
            following = re.match(r"\w+", rest).group()
            return len(following) == 1 or following[1:].islower() or any(c.islower() for c in following)
        return bool(word) and (word[-1].isdigit() or word[-1] in "%)") and len(rest) > 1 and rest[1].islower()
    if not _opens(rest):
        return False
    head = text[start:end].strip() if end - start < LOOK else ""
    if head and _ITEM.match(head) and (len(head) < 12) and not (before.strip().lower() in NAMED):
        return False
    first = re.match(r"[^\s]+", rest).group()
    lower = first.lower().strip(".,;:\"'“”»«()")
    if after > end:  # a closing quote or bracket after the mark, and a capital after that
        return True
    plain = bare.rstrip(".")
    if plain in GOES_ON and lower in GOES_ON[plain]:
        return False
    if _DEVANAGARI.search(word):
        return len(plain) > 3 and plain not in NEVER
    if word.endswith(")"):  # "Section 6.10(b)."
        return True
    if plain in MAYBE:
        if first[0].isdigit():  # an item number with a capital behind it opens a sentence
            return re.match(r"\d{1,3}(?:\.\d{1,3})*[.)]?\s+[^\W\d_]", rest) is not None and rest[len(first) :].lstrip()[:1].isupper()
        return first[0] not in "$€£"
    earlier = before[: len(before) - len(word)].split()
    if len(plain) == 1 and word[:1].isupper() and earlier and earlier[-1].strip(".,(").lower() in NAMED:
        return not first[0].isdigit() or "." in first
    if plain in NEVER:
        return False
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", plain):  # letters with stops between, as in "z.B"
        return not first[0].isdigit()
    if len(plain) == 1 and plain.isalpha() and plain.isascii() and first[0].isascii():
        return False  # an initial, or the second half of "z. B." or "p. a."
    if plain.isdigit() and len(plain) < 3 and lower in MONTHS:
        return False
    return True


SKIPPED = 3  # likely ends that an arc may run over


def _nodes(text: str, depth: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """(start of the marks, their end, end of the sentence with closing marks, whether a
    pair closes there) of every run of terminators at which a sentence can end."""
    out, closers = [], CLOSING | {"'", "*", "_"}
    for m in _RUN.finditer(text):
        at, end = m.start(), m.end()
        while end > at and text[end - 1].isspace():
            end -= 1
        after, level = end, depth[at]
        while after < len(text) and text[after] in closers and (text[after] not in "'*_" or text[at - 1 : at].isalnum()):
            if text[after] in "'*_" and after + 1 < len(text) and not text[after + 1].isspace():
                break
            if text[after] == '"' and depth[after] == 0:
                break
            after += 1
            level = depth[after - 1] - 1 if text[after - 1] not in "'*_" else level
        if text[after : after + 2] in (" »", "\u00a0»", "\u202f»") and depth[at]:
            after += 2
            level = depth[at] - 1
        if level <= 0:
            out.append((at, end, after, bool(depth[at] > 0)))
    return out


def _ends_at(text: str, depth: np.ndarray, start: int, node: tuple[int, int, int, bool], known) -> bool:
    """Whether a sentence that begins at `start` ends at the node."""
    at, end, after, closed = node
    found = _NEXT.search(text, after)
    if closed and found:
        rest = text[found.start() : found.start() + LOOK]
        opened = _opened(text, depth, at, start)
        whole = not text[start:opened].strip()
        if text[opened : opened + 1] in "([（［【" and not whole:
            return False
        if _HAN.match(rest[0]) or _HAN.match(text[at - 1 : at]):
            led = text[max(start, opened - LOOK) : opened].rstrip()[-1:] in ("：", ":", "，", ",")
            return (led or whole) and not _goes_on(rest, known)
        if not text[after].isspace() and not rest[0].isupper():
            return False
    return _stops(text, start, at, end, after)


def _looks(text: str, start: int, end: int) -> float:
    """What is odd about a stretch as a sentence: it begins in lower case, or is an item mark
    alone."""
    first = _NEXT.search(text, start, end)
    if not first:
        return 2.0
    alone = end - start < 16 and _ITEM.match(text[start:end].strip()) is not None
    return 0.5 * text[first.start()].islower() + 0.5 * alone


def _paragraph(text: str, known) -> list[int]:
    """Ends of the sentences of one paragraph (the last end is the paragraph's): the best path
    through the lattice of its terminators."""
    depth = pairs(text)
    ends: list[int] = []
    if len(_THAI.findall(text)) * 2 > sum(c.isalpha() for c in text):
        ends = _thai_ends(text, depth, known)
    nodes = [] if _heading(text) else _nodes(text, depth)
    # best[k]: score and node before, for a path that ends a sentence at node k - 1 (0: the start).
    best: list[tuple[float, int] | None] = [(0.0, -1)] + [None] * len(nodes)
    final = (-1e9, 0)
    for k in range(len(nodes) + 1):
        if best[k] is None:
            continue
        score, start, skipped = best[k][0], nodes[k - 1][2] if k else 0, 0
        for j in range(k, len(nodes)):
            if nodes[j][0] < start or not _ends_at(text, depth, start, nodes[j], known):
                continue
            arc = score + 2 - 2 * skipped - _looks(text, start, nodes[j][2])
            if best[j + 1] is None or arc > best[j + 1][0]:
                best[j + 1] = (arc, k)
            skipped += 1
            if skipped > SKIPPED:
                break
        else:
            left = score - 2 * skipped - (_looks(text, start, len(text)) if start < len(text) else 0)
            if left > final[0]:
                final = (left, k)
    k = final[1]
    while k > 0:
        ends.append(nodes[k - 1][2])
        k = best[k][1]
    ends += [m.end() for m in _UNSTOPPED.finditer(text) if not depth[m.start()]]
    return sorted(set(ends) | {len(text)})


def _opened(text: str, depth: np.ndarray, at: int, start: int) -> int:
    """Position of the mark that opened the outermost pair around `at`."""
    i = at
    while i > start and depth[i - 1] > 0:
        i -= 1
    return i


def _heading(text: str) -> bool:
    """A short paragraph without a sentence's end mark is one unit."""
    bare = text.strip()
    return bool(bare) and bare[-1] not in MARKS and bare[-1] not in "\"'”’»“」』）)" and len(bare.split()) <= 7 and len(bare) <= 80 and not _HAN.search(bare) and not _THAI.search(bare) and not re.search(r"[!?]\s", bare)


def sentences(text: str | None, known=None) -> list[tuple[int, int]]:
    """(start, end) of every sentence; none for null or blank text.

    `known`: a `lattice.dictionary`; the default one when None."""
    if not text or not text.strip():
        return []
    if known is None:
        known = lattice.dictionary(*lattice.paths())
    out, at = [], 0
    bounds = [(m.start(), m.end()) for m in _EMPTY_LINE.finditer(text)]
    for stop, restart in [*bounds, (len(text), len(text))]:
        if stop > at:
            part, start = text[at:stop], 0
            for end in _paragraph(part, known):
                piece = part[start:end]
                left = len(piece) - len(piece.lstrip())
                right = len(piece.rstrip())
                if right > left:
                    out.append((at + start + left, at + start + right))
                start = end
        at = max(at, restart)
    return out


def splitter(files=(None, None)):
    """Function for mapInArrow: (id, text) -> (chunk_id, char_start, char_end). `files`: see
    `lattice.dictionary`."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lattice.dictionary(*files)
        for batch in batches:
            take, first, last = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for a, b in sentences(text, known):
                    take.append(i)
                    first.append(a)
                    last.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, type=pa.int64())), pa.array(first, type=pa.int32()), pa.array(last, type=pa.int32())],
                names=["chunk_id", "char_start", "char_end"],
            )

    return split


def split_sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, char_start, char_end) for `chunks(chunk_id, text)`.

    Repeated rows give their sentences once; null ids, null and blank texts none; an empty
    table gives no rows; further columns are ignored."""
    rows = chunks.where("chunk_id is not null and text is not null").select("chunk_id", "text")
    # Repeats are dropped among the narrow results, so no text is ever shuffled.
    return rows.mapInArrow(splitter(lattice.paths(chunks.sparkSession)), "chunk_id long, char_start int, char_end int").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(read(spark, sf_dir, "chunk"))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences per chunk."""
    return p6_found(spark, sf_dir).groupBy("chunk_id").agg(F.count("*").alias("sentences"))
