"""Text functions as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions import fixed


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits, two characters at least; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"), F.lit(0))


def clean_transcript(text: Column) -> Column:
    """Without filler tokens, hedge phrases, sentence-initial fillers and dangling commas, in this order."""
    t = reduce(lambda t, p: F.regexp_replace(t, p, ""), [fixed.FILLER_TOKENS, fixed.FILLER_PHRASES, fixed.SENTENCE_INITIAL], text)
    t = F.regexp_replace(t, ",(\\s*,)+", ",")
    t = F.regexp_replace(t, "^\\s*,\\s*", "")
    return F.trim(F.regexp_replace(t, "\\s{2,}", " "))


def sanitize_ocr(text: Column) -> Column:
    """URLs and handles that follow a word character become blanks; blanks collapse."""
    t = F.regexp_replace(text, "(?:https?://|www\\.)\\S+", " ")
    t = F.regexp_replace(t, "\\b@[A-Za-z0-9_]+\\b", " ")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def is_ocr_noise(text: Column) -> Column:
    """Blank, under five words without a letter, or with a boilerplate pattern."""
    t = F.trim(F.coalesce(text, F.lit("")))
    few = (F.size(F.split(t, "\\s+")) < 5) & ~t.rlike("[A-Za-z]")
    return (t == "") | few | reduce(lambda a, b: a | b, [t.rlike(p) for p in fixed.NOISE_PATTERNS])


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation to blanks, blanks collapsed (ASCII)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_\\s]", " "), "\\s+", " "))


def cluster_name(name: Column) -> Column:
    """Lower case, dashes and underscores to blanks, other punctuation deleted (ASCII)."""
    t = F.regexp_replace(F.lower(F.trim(name)), "[-_]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9_\\s]", ""), "\\s+", " "))


def singular(token: Column) -> Column:
    """The first plural rule that fits, if three characters remain; short tokens stay."""
    out = token
    for suffix, put in reversed(fixed.PLURAL_RULES):
        made = F.concat(F.substring(token, F.lit(1), F.length(token) - len(suffix)), F.lit(put))
        out = F.when(token.endswith(suffix), F.when(F.length(made) >= 3, made).otherwise(token)).otherwise(out)
    return F.when(F.length(token) <= 3, token).otherwise(out)


def lemma_key(name: Column) -> Column:
    """Singular tokens of a normalised name, in order."""
    parts = F.filter(F.split(normalize_name(name), "[\\s_-]+"), lambda t: t != "")
    return F.array_join(F.transform(parts, singular), " ")


def query_stem(word: Column) -> Column:
    """The query side's stemmer: ies to y; two letters off -ses, -xes, -ches, -shes; one off -s but not -ss."""
    w = F.lower(F.trim(word))
    off = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    two = w.endswith("ses") | w.endswith("xes") | w.endswith("ches") | w.endswith("shes")
    long = F.when(w.endswith("ies"), F.concat(off(3), F.lit("y"))).when(two, off(2)).when(w.endswith("s") & ~w.endswith("ss"), off(1)).otherwise(w)
    return F.when(F.length(w) > 3, long).otherwise(w)


def answer_stem(word: Column) -> Column:
    """The answer side's stemmer, with -ing, -ed, -es (and its e) and -s."""
    w = F.lower(word)
    off = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
    es = off(2)
    kept = es.endswith("e") | es.endswith("s") | es.endswith("x") | es.endswith("z") | es.endswith("ch") | es.endswith("sh")
    long = (
        F.when(w.endswith("ies"), F.concat(off(3), F.lit("y")))
        .when(w.endswith("tions"), off(5))
        .when(w.endswith("tion"), off(4))
        .when(w.endswith("ing"), off(3))
        .when(w.endswith("ed"), off(2))
        .when(w.endswith("es"), F.when(kept, es).otherwise(F.concat(es, F.lit("e"))))
        .when(w.endswith("s") & ~w.endswith("ss"), off(1))
        .otherwise(w)
    )
    return F.when(F.length(w) > 3, long).otherwise(w)


def content_stems(text: Column) -> Column:
    """Distinct stems of words of two characters or more that aren't stop words."""
    kept = F.filter(word_tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(fixed.ANSWER_STOPWORDS))
    return F.array_distinct(F.transform(kept, answer_stem))


def is_fragment(name: Column) -> Column:
    """A clause rather than a name: blank, a sentence end inside, a pronoun or conjunction first, a spaced semicolon or dash, over twelve words."""
    n = F.trim(F.coalesce(name, F.lit("")))
    ends = reduce(lambda a, b: a | b, [n.endswith(s) for s in fixed.ABBREVIATION_ENDS])
    opener = F.lower(n).rlike(f"^({'|'.join(fixed.FRAGMENT_OPENERS)})\\b")
    return (n == "") | (n.rlike("[.!?]\\s|\\.$") & ~ends) | opener | n.rlike("\\s[;—]\\s") | (F.size(F.split(n, "\\s+")) > 12)


def timestamp_text(seconds: Column) -> Column:
    """HH:MM:SS of seconds, rounded down."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def truncated(text: Column, limit: int | Column) -> Column:
    """At most `limit` characters, back to the last sentence end if that is past the middle."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    head = F.substring(text, F.lit(1), limit.cast("int"))
    last = F.length(head) - F.instr(F.reverse(head), " .")  # length up to the last ". ", its blank left out
    found = F.instr(F.reverse(head), " .") > 0
    return F.when(F.length(text) <= limit, text).otherwise(F.when(found & (last - 1 > F.floor(limit / 2)), F.substring(head, F.lit(1), last)).otherwise(head))


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision, of vectors that are already normalised."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
