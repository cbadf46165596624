"""Fixed word lists and names that results depend on, and the word expressions over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic in contract queries.
STOPWORDS = (
    "the a an of in to for and or is are that this by be as if any such its it "
    "should have has been not all with from on at which does do can may will would could "
    "there what how when where who why other each both than no nor so too very just about "
    "between into through during before after above below up down out off over then once here "
    "only own same but because until while "
    "clause agreement party parties upon under section shall herein hereof thereof pursuant provided "
    "respect written notice provide whether including without limitation connection accordance event "
    "otherwise provisions provision terms term"
).split()
# What the question templates of the first generation add.
TEMPLATE_WORDS = (
    "highlight parts contract related reviewed lawyer details one right "
    "set forth made date prior following subject"
).split()
# Label spellings and the names they stand for.
LABEL_NAMES = {
    "assignments": "assignment",
    "applicable law": "governing law",
    "choice of law": "governing law",
    "term and termination": "termination",
    "limitation of liabilities": "limitation of liability",
    "change in control": "change of control",
    "payment terms": "payment",
}
WORD = r"[\p{L}\p{N}_]+"


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokenize(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, in order. Null stays null."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def topical(text: Column) -> Column:
    """`tokenize` without stop words and words of one or two characters."""
    stop = _array(STOPWORDS)
    return F.filter(tokenize(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))


def keyword_set(text: Column) -> Column:
    return F.array_distinct(topical(text))


def query_keywords(text: Column) -> Column:
    """First-generation keywords: stop and template words go, short words stay."""
    stop = _array(STOPWORDS + TEMPLATE_WORDS)
    return F.array_distinct(F.filter(tokenize(text), lambda w: ~F.array_contains(stop, w)))


def overlap(keywords: Column, text: Column) -> Column:
    """Share of `keywords` among the words of `text`; 0 without keywords."""
    hit = F.size(F.array_intersect(keywords, tokenize(text)))
    return F.when(F.size(keywords) > 0, hit / F.size(keywords)).otherwise(F.lit(0.0))


def squeeze(text: Column) -> Column:
    """White space runs become one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_set(text: Column) -> Column:
    """Distinct lower-case words between white space; empty for blank text."""
    return F.array_distinct(F.filter(F.split(squeeze(F.lower(text)), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two word sets; null when either is empty."""
    whole = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / whole)


def word_count(text: Column) -> Column:
    s = squeeze(text)
    return F.when(s == "", F.lit(0)).otherwise(F.size(F.split(s, " ")))


def regex_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def estimated_tokens(words: Column) -> Column:
    """1.4 tokens a word, rounded down."""
    return F.floor(words * F.lit(1.4)).cast("int")


def stable_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16))


def content_hash(text: Column) -> Column:
    return F.sha1(F.encode(squeeze(text), "UTF-8"))


def label_name(label: Column) -> Column:
    """A label in lower case with blanks for separators, under its usual name."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), r"[_\-]+", " "), r"\s+", " ")
    names = F.create_map(*[F.lit(x) for pair in LABEL_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, plain), plain)


def clean_question(text: Column) -> Column:
    """A question without answer marks and separators."""
    t = F.regexp_replace(F.trim(text), r"[-: ]*Answer$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\(Y/N\)", ""), r"[_\-]+", " ")
    return squeeze(t)


def question_query(question: Column, subquestion: Column, text_type: Column, category: Column) -> Column:
    """One query text from a question's parts; parts that repeat earlier ones stay out."""
    q, t, c = clean_question(question), clean_question(text_type), clean_question(category)
    s = F.trim(subquestion)
    first = F.concat_ws(
        ". ",
        F.nullif(q, F.lit("")),
        F.when((s != "") & (s != "<NONE>"), F.concat(F.lit("focus: "), clean_question(s))),
        F.when((t != "") & ~F.contains(F.lower(q), F.lower(t)), F.concat(F.lit("clause type: "), t)),
    )
    return F.concat_ws(". ", F.nullif(first, F.lit("")), F.when((c != "") & ~F.contains(F.lower(first), F.lower(c)), F.concat(F.lit("category: "), c)))


def quoted_category(query: Column, otherwise: Column) -> Column:
    """What a templated query names in quotes, else `otherwise`."""
    return F.coalesce(F.nullif(F.regexp_extract(query, 'related to "([^"]+)"', 1), F.lit("")), otherwise)


def template_query(name: Column) -> Column:
    return F.format_string('Find provisions related to "%s".', name)


def task_label(config: Column, prefix: str) -> Column:
    bare = F.when(F.startswith(config, F.lit(prefix)), F.substring(config, len(prefix) + 1, 1 << 20)).otherwise(config)
    return F.initcap(F.regexp_replace(bare, "[_-]", " "))


def glob_match(text: Column, patterns: list[str]) -> Column:
    """Whether any shell pattern (* and ?) matches all of `text`."""
    out = F.lit(False)
    for p in patterns:
        rx = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c for c in p)
        out = out | F.rlike(text, F.lit(f"^{rx}$"))
    return out


def any_key(values: Column, *names: str) -> Column:
    """First value of a map whose key is one of `names`, case apart."""
    wanted = _array([n.lower() for n in names])
    found = F.map_values(F.map_filter(values, lambda k, v: F.array_contains(wanted, F.lower(k))))
    return F.try_element_at(found, F.lit(1))
