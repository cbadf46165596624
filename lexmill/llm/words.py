"""Word ids of a text: what counts as the same word in every near-duplicate operator.

Case, spacing, punctuation, markup signs, Unicode forms and end-of-line hyphens are
folded away.  A word is a 32-bit hash (never 0); id 0 stands where a sentence ends, so
that operators can disregard sentence order.  Two different words that share a hash
only matter inside one compared pair of texts, where it is a 1-in-4e9 event a word.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_HYPHEN = re.compile("(?<=\\w)[-\u00ad\u2010\u2011][ \t]*\r?\n\\s*(?=\\w)")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#\d{1,6});")
_STOP = re.compile("[.!?\u3002\uff01\uff1f\u0964\u061f][\"')\\]*_\u201d\u2019\u300d\u300f\u00bb]*(?:\\s+|$)")
_WIDE_STOP = re.compile("([\u3002\u0964])")
_SPACELESS = re.compile("([\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0002ffff])")

# ASCII: letters and digits stay; commas, hyphens, apostrophes and markup signs vanish
# (they stand inside words and numbers); all else parts words.
_ASCII = {c: " " for c in range(128) if not chr(c).isalnum()}
_ASCII.update({ord(c): None for c in ",-'*_`~#^"})
_ASCII.update({c: chr(c).lower() for c in range(65, 91)})
_ASCII.update({1: "\x01", 2: "\x02"})  # one to one, which keeps str.translate on its quick path
_TABLE = str.maketrans(_ASCII)
_TABLE_STOPS = str.maketrans(_ASCII | {ord(c): "." for c in ".!?"})
_INNER = set("\u2019\u2018\u00ad\u2010\u2011\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")


class _Folding(dict):
    """str.translate table for all of Unicode, filled as characters turn up."""

    def __missing__(self, point: int):
        ch = chr(point)
        if _SPACELESS.match(ch):
            to = f" {ch} "
        elif ch.isalnum() or ch.isspace() or point in (1, 2) or unicodedata.category(ch)[0] == "M":
            to = ch
        else:
            to = None if ch in _INNER or ch in ",-'*_`~#^" else " "
        self[point] = to
        return to


_FOLD = _Folding()


def split(text: str) -> list[str]:
    """Words of `text`, with "\\x01" where a sentence ends. Empty text: no words."""
    text = text.replace("\x02", " ")
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not text.isascii():
            text = _HYPHEN.sub("", text)
            text = _STOP.sub(" \x01 ", _WIDE_STOP.sub(r"\1 ", text)).casefold().translate(_FOLD)
            return text.split()
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text and _ENTITY.search(text):
        return split(html.unescape(text).replace("&", " "))
    return _STOP.sub(" \x01 ", text).translate(_TABLE).split()


class Ids(dict):
    """word -> id, remembered within a Python worker up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
            self |= {"\x01": 0, "\x02": -1}
        h = xxhash.xxh32_intdigest(word)
        h = h if h not in (0, 0xFFFFFFFF) else 1  # 0 and -1 are marks
        h = h - (1 << 32) if h >= 1 << 31 else h
        self[word] = h
        return h


def new_ids() -> Ids:
    ids = Ids()
    ids |= {"\x01": 0, "\x02": -1}
    return ids


def encode_batch(texts: list[str | None], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """Flat int32 ids of all texts (0 where a sentence ends) and the offsets of each text.

    ASCII texts go through the string methods together, one call for the whole batch."""
    plain, slow = [], {}
    for i, t in enumerate(texts):
        if not t:
            plain.append("")
        elif not t.isascii() or "-\n" in t or "-\r" in t or "- \n" in t or "<" in t or "&" in t or "\x02" in t:
            slow[i] = np.fromiter(map(ids.__getitem__, split(t)), dtype=np.int32)
            plain.append("")
        else:
            plain.append(t)
    big = (" \x02 ".join(plain) + " ").translate(_TABLE_STOPS)
    big = big.replace(". ", " \x01 ").replace(".", " ")
    words = pc.ascii_split_whitespace(pa.array([big.strip() or "\x02"])).values.dictionary_encode()
    known = np.fromiter(map(ids.__getitem__, words.dictionary.to_pylist()), dtype=np.int32)
    flat = known[words.indices.to_numpy()] if len(plain) > 1 or big.strip() else known[:0]
    marks = np.flatnonzero(flat == ids["\x02"])
    lengths = np.diff(np.concatenate(([-1], marks, [len(flat)]))) - 1
    flat = np.delete(flat, marks)
    if slow:
        starts = np.concatenate(([0], np.cumsum(lengths)))
        parts, at = [], 0
        for i, own in slow.items():
            parts += [flat[at : starts[i]], own]
            at = starts[i]
            lengths[i] = len(own)
        flat = np.concatenate([*parts, flat[at:]])
    return flat, np.concatenate(([0], np.cumsum(lengths)))


def encode(text: str, ids: Ids) -> np.ndarray:
    return encode_batch([text], ids)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of every non-empty sentence of a batch."""
    n = len(offsets) - 1
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    word = flat != 0
    before = np.concatenate(([False], word[:-1]))
    start_of_text = np.zeros(len(flat) + 1, dtype=bool)
    start_of_text[offsets] = True
    starts = np.flatnonzero(word & (~before | start_of_text[:-1]))
    after = np.concatenate((word[1:], [False]))
    ends = np.flatnonzero(word & (~after | start_of_text[1:])) + 1
    return starts, ends, text_of[starts] if len(flat) else starts


def text_keys(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit key of each text's words whatever the order of its sentences, and its number
    of words. Texts without words have key 0."""
    n = len(offsets) - 1
    keys, counts = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int64)
    starts, ends, text = spans(flat, offsets)
    if len(starts):
        at = np.arange(len(flat), dtype=np.int64)
        first = np.zeros(len(flat), dtype=np.int64)
        first[starts] = starts
        place = at - np.maximum.accumulate(first)
        with np.errstate(over="ignore"):
            w = mix(flat.astype(np.uint32).astype(np.uint64) + (place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(flat == 0, np.uint64(0), w), dtype=np.uint64)))
            sent = mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64))
            np.add.at(keys, text, sent)
        np.add.at(counts, text, ends - starts)
    return keys.view(np.int64), counts


HISTOGRAM = 32  # counters of a text's histogram, 4 bits each


def histograms(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2) int64: how many words of each text fall into each of HISTOGRAM classes, up
    to 15. The counts of two texts differ by no more than twice the words edited between
    them, in whatever order, so the difference refuses pairs without losing any."""
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    word = flat != 0
    of = (mix(flat[word].astype(np.uint32).astype(np.uint64)) % np.uint64(HISTOGRAM)).astype(np.int64)
    counts = np.bincount(text[word] * HISTOGRAM + of, minlength=n * HISTOGRAM).reshape(n, HISTOGRAM)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return np.ascontiguousarray(counts[:, 0::2] | counts[:, 1::2] << 4).view(np.int64).reshape(n, 2)


def histogram_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of the differences of counts, for rows of `histograms`."""
    x, y = (np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 16).astype(np.int16) for h in (a, b))
    return np.abs((x & 15) - (y & 15)).sum(axis=1) + np.abs((x >> 4) - (y >> 4)).sum(axis=1)


def _without_marks(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    word = flat != 0
    return flat[word], np.concatenate(([0], np.cumsum(word)))[offsets]


def common_words(a: np.ndarray, oa: np.ndarray, b: np.ndarray, ob: np.ndarray) -> np.ndarray:
    """For each pair of texts, the number of words both hold, repeated ones repeatedly."""

    def counted(flat, offsets):
        pair = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
        return np.unique((pair << np.uint64(32)) | flat.astype(np.uint32).astype(np.uint64), return_counts=True)

    (ka, ca), (kb, cb) = counted(a, oa), counted(b, ob)
    both, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    return np.bincount((both >> np.uint64(32)).astype(np.int64), weights=np.minimum(ca[i], cb[j]), minlength=len(oa) - 1).astype(np.int64)


GROUP = 512  # pairs whose bands are filled together


def banded_many(a: list[np.ndarray], b: list[np.ndarray], k: np.ndarray) -> np.ndarray:
    """Edit distance of each a[i] and b[i] where it is at most k[i], else k[i] + 1.

    Dynamic program over the 2k + 1 diagonals next to the main one, row by row, for GROUP
    pairs of like length at a time."""
    out = np.asarray(k, dtype=np.int64) + 1
    n, m = np.array([len(x) for x in a], dtype=np.int64), np.array([len(x) for x in b], dtype=np.int64)
    todo = np.flatnonzero(np.abs(n - m) <= k)
    todo = todo[np.lexsort((n[todo], k[todo]))]
    for at in range(0, len(todo), GROUP):
        rows = todo[at : at + GROUP]
        wide, tall = int(k[rows].max()), int(n[rows].max())
        band = 2 * wide + 1
        A = np.full((len(rows), tall), -2, dtype=np.int32)
        B = np.full((len(rows), tall + band), -3, dtype=np.int32)
        for i, r in enumerate(rows.tolist()):
            A[i, : len(a[r])] = a[r]
            B[i, wide : wide + len(b[r])] = b[r]
        step = np.arange(band, dtype=np.int32)
        row = np.where(step >= wide, step - wide, 1 << 20).astype(np.int32)[None, :].repeat(len(rows), axis=0)
        final = m[rows] - n[rows] + wide
        ends = n[rows]
        out_rows = row[np.arange(len(rows)), final]
        for i in range(1, tall + 1):
            new = row + (A[:, i - 1 : i] != B[:, i - 1 : i - 1 + band])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - step, axis=1) + step
            done = np.flatnonzero(ends == i)
            if len(done):
                out_rows[done] = row[done, final[done]]
        out[rows] = np.minimum(out_rows, k[rows] + 1)
    return out


def banded(a: np.ndarray, b: np.ndarray, k: int) -> int:
    """Edit distance of two id sequences if at most k, else k + 1."""
    return int(banded_many([a], [b], np.array([k]))[0])


def _starts(a: np.ndarray, words_b: np.ndarray) -> set[int]:
    """Where in b the sentences of a begin, by votes of their first words."""
    where: dict[int, list[int]] = {}
    for j, w in enumerate(words_b.tolist()):
        where.setdefault(w, []).append(j)
    out = set()
    for s in sentences_of(a):
        votes: dict[int, int] = {}
        for i, w in enumerate(s[:8].tolist()):
            for j in where.get(w, ()):
                votes[j - i] = votes.get(j - i, 0) + 1
        if votes:
            out.add(max(0, max(votes, key=lambda d: (votes[d], -d))))
    return out


def sentences_of(a: np.ndarray) -> list[np.ndarray]:
    cuts = np.flatnonzero(a == 0)
    return [s[s != 0] for s in np.split(a, cuts) if len(s[s != 0])]


def in_order_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The words of b, its sentences in the order of a's.

    b is parted at its own sentence marks and, as marks get lost, where a's sentences begin
    in it.  Each part, the longest first, is matched with the place in a that most of its
    words agree with; a word of a is matched once, so repeated sentences find a place each."""
    wa, wb = a[a != 0], b[b != 0]
    own = np.cumsum([len(s) for s in sentences_of(b)]).tolist()
    cuts = sorted({0, len(wb), *own, *(p for p in _starts(a, wb) if p < len(wb))})
    where: dict[int, list[int]] = {}
    for j, w in enumerate(wa.tolist()):
        where.setdefault(w, []).append(j)
    free = np.ones(len(wa), dtype=bool)
    placed = []
    for x, y in sorted(zip(cuts, cuts[1:]), key=lambda c: (c[0] - c[1], c[0])):
        votes: dict[int, int] = {}
        for i, w in enumerate(wb[x:y].tolist()):
            for j in where.get(w, ()):
                if free[j]:
                    votes[j - i] = votes.get(j - i, 0) + 1
        at = max(votes, key=lambda d: (votes[d], -abs(d - x))) if votes else x
        free[max(0, at) : max(0, at + y - x)] = False
        placed.append((at, x, y))
    return np.concatenate([wb[x:y] for _, x, y in sorted(placed)]) if placed else wb


def near_pairs(a: np.ndarray, oa: np.ndarray, b: np.ndarray, ob: np.ndarray, one_in: int = 8) -> np.ndarray:
    """Which pairs of texts (ids with sentence marks, and offsets) are near: at most about one
    word in `one_in` changed, added or dropped, sentence order apart.

    The bound of a pair is ceil(longer / one_in) words, none for texts of fewer than `one_in`
    words.  Texts without words are near nothing."""
    (wa, owa), (wb, owb) = _without_marks(a, oa), _without_marks(b, ob)
    na, nb = np.diff(owa), np.diff(owb)
    longer = np.maximum(na, nb)
    k = np.where(longer >= one_in, -(-longer // one_in), 0)
    ok = (np.minimum(na, nb) > 0) & (np.abs(na - nb) <= k) & (longer - common_words(wa, owa, wb, owb) <= k)
    rows = np.flatnonzero(ok)
    x = [wa[owa[r] : owa[r + 1]] for r in rows.tolist()]
    y = [wb[owb[r] : owb[r + 1]] for r in rows.tolist()]
    hit = banded_many(x, y, k[rows]) <= k[rows]
    for turned in (False, True):  # b in a's order, then a in b's
        left = np.flatnonzero(~hit)
        if len(left):
            full = [(a[oa[r] : oa[r + 1]], b[ob[r] : ob[r + 1]]) for r in rows[left].tolist()]
            own = [y[i] if turned else x[i] for i in left.tolist()]
            other = [in_order_of(q, p) if turned else in_order_of(p, q) for p, q in full]
            hit[left] = banded_many(own, other, k[rows[left]]) <= k[rows[left]]
    ok[rows] = hit
    return ok


def near(a: np.ndarray, b: np.ndarray, one_in: int = 8) -> bool:
    """`near_pairs` for one pair."""
    return bool(near_pairs(a, np.array([0, len(a)]), b, np.array([0, len(b)]), one_in)[0])
