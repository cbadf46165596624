"""Splitting oversized items at natural boundaries, by lexical cohesion.

Sentence vectors are summed into blocks that slide along the text; where the likeness of
the blocks on both sides has a valley, the topic changes.  Words are taken with their vowel
signs; scripts without blanks are parted into words by the dictionary lattice.  Each piece
ends at the deepest valley of its size window; the next begins at a word, at least OVERLAP
tokens earlier.  Without a sentence end in the window the last word end serves, without that
the last character end.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import lattice
from lexmill.llm import tokens as T
from lexmill.tables import read

LIMIT, OVERLAP = 1024, 64
BLOCK = 4  # sentences on each side of a gap
DIMS = 256  # hashed words of a sentence vector
_GAP = re.compile("(?<=[.!?।؟…\"')\\]”»:;])(?=\\s+\\S)|(?<=[。！？」』])(?=\\S)|(?<=\\S)(?=[ \\t]*\\r?\\n\\s*\\S)")
_SPACE = re.compile(r"(?<=\S)(?=\s)")
_THAI_SPACE = re.compile("(?<=[฀-໿က-႟ក-៿])(?=\\s+\\S)")
_PLAIN = re.compile("[a-z0-9]{2,}")
_INDIC = re.compile("[ऀ-෿]")
_OTHER = re.compile(f"{_INDIC.pattern}|{lattice.RUN.pattern}")
_MARKED = re.compile("[\\w" + "".join(c for c in map(chr, range(0x300, 0x10000)) if unicodedata.category(c)[0] == "M") + "]+")
# Words too common to tell one topic from another (fixed values): English function words.
_COMMON = set("the of and to in or any for by be that as is on with this shall such not it an at from all may will its are if has have which other no each".split())


class Dims(dict):
    """word -> place in a sentence vector, remembered within a worker up to a bound; -1 for
    words that say nothing."""

    LIMIT = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        at = -1 if word in _COMMON else xxhash.xxh32_intdigest(word) % DIMS
        self[word] = at
        return at


_DIMS = Dims()


def _terms(low: str, start: int, end: int, known) -> list[str]:
    """The words of a stretch with Indic or spaceless scripts: Indic words with their vowel
    signs, lattice words of more than a letter (a letter where there is no more)."""
    out = []
    for w in _MARKED.findall(low, start, end):
        if not _OTHER.search(w):
            out += [w] if len(w) > 1 else []
            continue
        at = 0
        for m in lattice.RUN.finditer(w):
            out += [w[at : m.start()]] if m.start() - at > 1 else []
            run = m.group()
            for a, b, sure in lattice.words(run, known):
                if sure:
                    out.append(run[a:b])
                else:  # what no dictionary holds is compared by pairs of letters
                    out += [run[i : i + 2] for i in range(a, max(a + 1, b - 1))]
            at = m.end()
        out += [w[at:]] if len(w) - at > 1 or _INDIC.search(w[at:]) else []
    return out


def valleys(text: str, gaps: list[int], known=None) -> np.ndarray:
    """Depth of the cohesion valley at each gap (character positions between sentences).

    `known`: a `lattice.dictionary` for spaceless scripts; the default one when None."""
    ends = [0, *gaps, len(text)]
    low = text.lower()
    if len(low) != len(text):  # a few letters change their number in lower case
        low = text
    other = _OTHER.search(low)
    if other and known is None:
        known = lattice.dictionary(*lattice.paths())
    plain = _PLAIN if low.isascii() else _MARKED
    found = [_terms(low, a, b, known) if other else plain.findall(low, a, b) for a, b in zip(ends, ends[1:])]
    at = np.fromiter(map(_DIMS.__getitem__, chain.from_iterable(found)), dtype=np.int64)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    rows = np.bincount(row[at >= 0] * DIMS + at[at >= 0], minlength=len(found) * DIMS).reshape(len(found), DIMS).astype(np.float32)
    total = np.concatenate((np.zeros((1, DIMS), np.float32), np.cumsum(rows, axis=0)))
    g = np.arange(1, len(ends) - 1)
    left = total[g] - total[np.maximum(g - BLOCK, 0)]
    right = total[np.minimum(g + BLOCK, len(rows))] - total[g]
    norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    like = np.divide(np.einsum("ij,ij->i", left, right), norm, out=np.zeros(len(g)), where=norm > 0)
    return _climb(like) + _climb(like[::-1])[::-1] - 2 * like


def _climb(like: np.ndarray) -> np.ndarray:
    """The height reached from each place by going left for as long as it does not fall."""
    out = like.copy()
    for i in range(1, len(like)):
        if like[i - 1] >= like[i]:
            out[i] = out[i - 1]
    return out


def _places(pattern: re.Pattern, text: str) -> np.ndarray:
    return np.fromiter((m.start() for m in pattern.finditer(text)), dtype=np.int64)


def cut_text(enc, text: str, limit: int = LIMIT, overlap: int = OVERLAP, known=None) -> list[tuple[int, int, int, int]]:
    """[(char_start, char_end, tokens, tokens shared with the piece before)]; one piece for a
    text within the limit, none for an empty one. Pieces cover the text without a gap.

    Pieces are within the limit unless one character alone is larger. Neighbours share at
    least `overlap` tokens, or fewer where the piece before holds no more characters."""
    if not text:
        return []
    toks = T.encode_array(enc, text)
    if len(toks) <= limit:
        return [(0, len(text), len(toks), 0)]
    byte_at = np.concatenate(([0], np.cumsum(T.byte_lengths(enc)[toks])))  # byte position before each token
    if text.isascii():
        tok_char, whole = byte_at, np.ones(len(byte_at), dtype=bool)
    else:
        lead = (np.frombuffer(T.as_utf8(text), dtype=np.uint8) & 0xC0) != 0x80
        char_of = np.concatenate(([0], np.cumsum(lead)))  # characters begun before each byte
        tok_char, whole = char_of[byte_at], np.concatenate((lead, [True]))[byte_at]
    char_tok = np.flatnonzero(whole)  # token bounds that part characters
    starts = tok_char[char_tok]

    def bounds(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the character positions that lie at a token bound, and their tokens."""
        k = np.minimum(np.searchsorted(starts, places), len(starts) - 1)
        hit = starts[k] == places
        return places[hit], char_tok[k[hit]]

    places = _places(_GAP, text)
    if _THAI_SPACE.search(text):
        places = np.union1d(places, _places(_THAI_SPACE, text))
    gaps, gap_tok = bounds(places[(places > 0) & (places < len(text))])
    depth = valleys(text, gaps.tolist(), known) if len(gaps) else np.zeros(0)
    _, word_tok = bounds(_places(_SPACE, text))
    clean = np.zeros(len(toks) + 1, dtype=bool)  # cuts before a blank: both sides keep their tokens
    clean[word_tok] = True

    def last_in(a: np.ndarray, low: int, high: int) -> int | None:
        i = int(np.searchsorted(a, high, side="right")) - 1
        return int(a[i]) if i >= 0 and a[i] > low else None

    def size_of(a: int, b: int) -> int:
        if (a == 0 or clean[a]) and (b == len(toks) or clean[b]):
            return b - a
        return len(T.encode_array(enc, text[int(tok_char[a]) : int(tok_char[b])]))

    out, start, done, shared = [], 0, 0, 0
    while True:
        room = limit
        while True:
            least = int(char_tok[np.searchsorted(char_tok, done, side="right")])  # one character more
            if len(toks) - start <= room:
                end = len(toks)
            else:
                low, high = max(done, start + limit // 2), start + room
                i, j = np.searchsorted(gap_tok, low, side="right"), np.searchsorted(gap_tok, high, side="right")
                if j > i:
                    end = int(gap_tok[i:j][np.lexsort((gap_tok[i:j], depth[i:j]))[-1]])
                else:
                    end = last_in(word_tok, low, high) or last_in(char_tok, done, high) or least
            n = size_of(start, end)
            if n <= limit:
                break
            if end > least:
                room = min(room, end - start) - max(1, n - limit)
                continue
            # Not even one more character fits: the overlap gives way, a character at a time.
            later = int(char_tok[np.searchsorted(char_tok, start, side="right")])
            if later > done:
                break
            start, shared, room = later, done - later, limit
        out.append((int(tok_char[start]), int(tok_char[end]), n, shared))
        if end == len(toks):
            return out
        done = end
        back = end
        if overlap:
            back = last_in(word_tok, start, end - overlap)
            if back is None or end - back > 2 * overlap:
                back = last_in(char_tok, start, end - overlap)
            if back is None:  # the piece is smaller than the overlap: all but its first character
                back = last_in(char_tok[: np.searchsorted(char_tok, start, side="right") + 1], start, end) or end
        start, shared = back, end - back


def cutter(path: str, limit: int, overlap: int, whole: bool, with_text: bool, files=(None, None)):
    """Function for mapInArrow: (id, loaded_at, text) -> pieces. `whole`: also texts within
    the limit, as one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, known = T.encoding(path), lattice.dictionary(*files)
        for batch in batches:
            at, rows, kept = [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = cut_text(enc, text, limit, overlap, known) if text else []
                if len(found) > 1 or whole:
                    at += [i] * len(found)
                    rows += [(k, *p) for k, p in enumerate(found)]
                    if with_text:
                        kept += [text[p[0] : p[1]] for p in found]
            cols = np.array(rows, dtype=np.int32).reshape(-1, 5)
            take = pa.array(at, type=pa.int64())
            arrays = [batch.column(0).take(take), batch.column(1).take(take), *[pa.array(cols[:, j]) for j in range(5)]]
            names = ["doc_id", "loaded_at", "piece", "char_start", "char_end", "tokens", "shared"]
            if with_text:
                arrays.append(pa.array(kept, type=pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def cut_documents(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False, with_text: bool = True) -> DataFrame:
    """Pieces of `docs(doc_id, text, loaded_at)`: (doc_id, piece, char_start, char_end,
    tokens, shared[, text]); see `cut_text`.

    Documents within the limit give rows only with `whole`.  A document delivered again
    counts once, by its last text; null and empty texts and null ids give no rows.  A byte
    holds at most one token, so texts of at most `limit` bytes are known to fit unread."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select("doc_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), "text")
    last = rows.groupBy("doc_id").agg(F.count("*").alias("c"), F.max("loaded_at").alias("at")).where("c > 1").select("doc_id", "at")
    long = rows.where("text <> ''") if whole else rows.where(F.octet_length("text") > limit)
    kinds = "doc_id long, loaded_at timestamp_ntz, piece int, char_start int, char_end int, tokens int, shared int" + (", text string" if with_text else "")
    found = long.mapInArrow(cutter(T.tokenizer_path(spark), limit, overlap, whole, with_text, lattice.paths(spark)), kinds)
    found = found.join(last, "doc_id", "left").where(F.col("at").isNull() | F.col("loaded_at").eqNullSafe(F.col("at")))
    columns = [c for c in found.columns if c not in ("at", "loaded_at")]
    # Rows delivered twice at one moment are told apart by nothing; one of each stays.
    return found.groupBy("doc_id", "piece").agg(*[F.max_by(c, F.struct("char_end", "char_start")).alias(c) for c in columns if c not in ("doc_id", "piece")])


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_documents(read(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents larger than the limit: those the operator cuts."""
    return cut_documents(read(spark, sf_dir, "documents"), with_text=False).select("doc_id").distinct()
