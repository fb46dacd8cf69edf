"""String and array functions over posts, all built from Spark expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Endings after which a word is cut at its apostrophe.
SUFFIXES = (
    "'s", "'d", "'ll", "'ve", "'re", "'m",
    "’s", "’d", "’ll", "’ve", "’re", "’m",
    "'s!", "'s:", "’s!", "’s:", "'s…", "’s…",
)

# A post whose body holds one of these is left out of the counts.
EXCLUDED_BODIES = ("#sex", "#job", "#jobs", "#hiring", "#porn")

# Number-like tokens. The legacy form has an unescaped dot, so it
# also drops every token of one or two characters and words such as mp3 or h1n1.
NUMBER = "[0-9]*[:./-]?[0-9]*[:./-]?[0-9]*"
LEGACY_NUMBER = "[0-9]*(:|.|/|-)?[0-9]*(:|.|/|-)?[0-9]*$"

# Links and markup replaced by a blank before display.
LINKS = r"(https?:\/\/[A-Za-z0-9_\/\.]+)|(&amp;)|(\n)"

WORD = "[#@]?[a-z0-9_]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def default_stop_words() -> list[str]:
    """Spark's English stop words; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def load_words(spark: SparkSession, path: str, limit: int = 20_000) -> list[str]:
    """Read a word list, one entry per line; refuses files above ``limit`` lines."""
    rows = spark.read.text(path).filter(F.length("value") > 0).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{path} has more than {limit} entries")
    return [row.value for row in rows]


# --- time --------------------------------------------------------------------

def post_date(time: Column | str) -> Column:
    return F.substring(_col(time), 1, 10)


def post_hour(time: Column | str) -> Column:
    return F.substring(_col(time), 1, 13)


def parse_date(text: Column | str) -> Column:
    """Date of a strict ``yyyy-MM-dd`` text, NULL for anything else."""
    text = _col(text)
    parsed = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.date_format(parsed, "yyyy-MM-dd") == text, parsed)


# --- tokens ------------------------------------------------------------------

def simple_tokens(text: Column | str) -> Column:
    """Lower-case words, tags and handles by one plain pattern; NULL stays NULL."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def lower_tokens(tokens: Column) -> Column:
    return F.transform(tokens, F.lower)


def drop_links(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.startswith("http"))


def drop_words(tokens: Column, words: Iterable[str]) -> Column:
    """Remove listed words and keep repeats of the others."""
    words = sorted(set(words))
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def _cut(raw: Column, suffixes: Sequence[str], lower: bool = False) -> Column:
    t = F.lower(raw) if lower else raw
    shape = "^[a-z0-9]*(?:" + "|".join(rf"\Q{s}\E" for s in suffixes) + r")(?:$|\s)"
    stem = F.when(F.contains(t, F.lit("'")), F.regexp_extract(t, "^(.*)'", 1))
    stem = stem.otherwise(F.regexp_extract(t, "^(.*)’", 1))
    # The plain search spares most tokens the pattern.
    has_mark = F.contains(raw, F.lit("'")) | F.contains(raw, F.lit("’"))
    return F.when(has_mark & t.rlike(shape), stem).otherwise(t)


def cut_suffixes(tokens: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Cut ``word's`` before its last apostrophe if the whole token has that form."""
    return F.transform(tokens, lambda t: _cut(t, suffixes)) if suffixes else tokens


def _is_number(t: Column, legacy: bool) -> Column:
    if legacy:
        return t.rlike(f"^(?:{LEGACY_NUMBER})$")
    # A number begins with a digit or one of - . / : so words skip the pattern.
    return (t == "") | ((t >= "-") & (t < ";") & t.rlike(f"^{NUMBER}$"))


def drop_numbers(tokens: Column, legacy: bool = False) -> Column:
    return F.filter(tokens, lambda t: ~_is_number(t, legacy))


def clean_tokens(
    tokens: Column,
    stop_words: Iterable[str] = (),
    suffixes: Sequence[str] = SUFFIXES,
    numbers: bool = False,
    legacy_numbers: bool = False,
    min_length: int = 0,
) -> Column:
    """Lower, cut suffixes, then drop links, stop words and (by default) numbers."""
    words = sorted(set(stop_words))

    def keep(t: Column) -> Column:
        wanted = ~t.startswith("http")
        if words:
            wanted = ~t.isin(words) & wanted
        if min_length:
            wanted = (F.length(t) >= min_length) & wanted
        return wanted if numbers else wanted & ~_is_number(t, legacy_numbers)

    lowered = F.transform(
        tokens, lambda t: _cut(t, suffixes, lower=True) if suffixes else F.lower(t))
    return F.filter(lowered, keep)


def token_set(*arrays: Column, min_length: int = 2) -> Column:
    """Distinct tokens of all non-NULL arrays in first-seen order."""
    merged = F.array_distinct(F.flatten(F.array_compact(F.array(*arrays))))
    return F.filter(merged, lambda t: F.length(t) >= min_length) if min_length else merged


def hashtags(tokens: Column | str) -> Column:
    return F.filter(_col(tokens), lambda t: t.startswith("#"))


def tags_and_handles(tokens: Column | str) -> Column:
    return F.filter(_col(tokens), lambda t: t.startswith("#") | t.startswith("@"))


def no_handles(tokens: Column | str) -> Column:
    return F.filter(_col(tokens), lambda t: ~t.startswith("@"))


def tag_texts(tags: Column | str) -> Column:
    """``#text`` of a hashtag struct array."""
    return F.transform(_col(tags), lambda t: F.concat(F.lit("#"), F.lower(t["text"])))


def mention_texts(mentions: Column | str) -> Column:
    """``@name`` of a mention struct array."""
    return F.transform(_col(mentions), lambda m: F.concat(F.lit("@"), F.lower(m["screen_name"])))


def entity_kind(term: Column | str) -> Column:
    term = _col(term)
    return (F.when(term.startswith("#"), "#")
            .when(term.startswith("@"), "@").otherwise("S"))


def tokens_text(tokens: Column | str) -> Column:
    return F.array_join(_col(tokens), " ")


def tokens_from_text(text: Column | str) -> Column:
    return F.split(_col(text), " ")


def token_pairs(tokens: Column | str) -> Column:
    """All unordered pairs of distinct tokens of one short array, each sorted.

    For arrays of any length use ``operators.counters.pair_counts``, which never
    holds all pairs of a post at once.
    """
    ordered = F.array_sort(F.array_distinct(_col(tokens)))
    return F.flatten(F.transform(ordered, lambda x, i: F.transform(
        F.slice(ordered, i + 2, F.size(ordered)),
        lambda y: F.struct(x.alias("tok1"), y.alias("tok2")))))


# --- search terms ------------------------------------------------------------

def parse_terms(terms: str | Iterable[str]) -> list[str]:
    """Comma text or list to lower-case, trimmed, distinct, sorted terms."""
    parts = terms.split(",") if isinstance(terms, str) else terms
    return sorted({p.strip().lower() for p in parts if p.strip()})


def query_key(terms: Column | str) -> Column:
    """MD5 of the normalised, sorted term list of a comma text."""
    terms = F.lit(terms) if isinstance(terms, str) else terms
    parts = F.transform(F.split(terms, ","), lambda t: F.lower(F.trim(t)))
    parts = F.array_sort(F.filter(parts, lambda t: t != ""))
    return F.md5(F.array_join(parts, ","))


# --- display text ------------------------------------------------------------

def scrub_links(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), LINKS, " ")


def cloud_tokens(text: Column | str, stop_words: Iterable[str] = ()) -> Column:
    """Words for a word cloud: ASCII only, handles gone, contractions cut."""
    plain = F.regexp_replace(_col(text), r"[^\x00-\x7F]", "")
    plain = F.regexp_replace(plain, r"[^A-Za-z0-9_\s#@']+", " ")
    plain = F.regexp_replace(plain, r"(^|[^A-Za-z0-9_])@[A-Za-z0-9_]+", "$1 ")
    words = F.regexp_extract_all(plain, F.lit(r"[#@]?[A-Za-z0-9_']+"), F.lit(0))
    words = F.transform(words, lambda w: F.when(w.rlike("^[#@]"), w).otherwise(F.lower(w)))
    words = F.transform(words, lambda w: F.regexp_replace(w, "'(s|d|ll|ve|re)", ""))
    words = F.filter(words, lambda w: F.length(w) > 1)
    return drop_words(words, stop_words)
