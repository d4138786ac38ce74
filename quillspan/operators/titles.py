"""Titles of segments from what was shown, seen and said: the first source that has one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import fixed
from quillspan.functions import text as X
from quillspan.operators.segments import is_repetitive, stripped
from quillspan.operators.sequence import keyword_titles

MOST_WORDS, MOST_CHARACTERS = 8, 60
#: How much a word weighs by where it is, in the order of reading.
WEIGHTS = {"ocr_text": 3.0, "visual_context": 2.0, "transcript": 1.0}


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda w: w != "")


def heading(ocr: Column) -> Column:
    """The first line on a slide of one to eight words with a letter and no mark of boilerplate, or null."""
    lines = F.transform(F.split(F.coalesce(ocr, F.lit("")), "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"), lambda x: F.btrim(F.btrim(stripped(x), F.lit('"')), F.lit("'")))
    noise = lambda x: reduce(lambda a, b: a | b, [F.contains(F.lower(x), F.lit(m)) for m in fixed.SLIDE_BOILERPLATE])
    good = F.filter(lines, lambda x: F.size(_words(x)).between(1, MOST_WORDS) & x.rlike("\\p{L}") & ~noise(x))
    return F.get(good, F.lit(0))


def caption(seen: Column) -> Column:
    """The first eight words of a description's first sentence, unless it opens like filler; null without words."""
    clean = stripped(F.regexp_replace(stripped(seen), "^[\\s#>*_`\\-]+", ""))
    first = stripped(F.get(F.split(clean, "(?<=[.!?])\\s+"), F.lit(0)))
    filler = reduce(lambda a, b: a | b, [F.startswith(F.lower(first), F.lit(p)) for p in fixed.CAPTION_OPENERS])
    words = _words(first)
    return F.when((F.size(words) > 0) & ~filler, F.array_join(F.slice(words, 1, MOST_WORDS), " "))


def phrase(said: Column) -> Column:
    """The beginning of what was said, cleaned, from its first capitalised word on if it begins inside a word, cut before 60 characters; null if it is noise."""
    raw = stripped(said)
    clean = X.clean_transcript(raw)
    words = _words(clean)
    first = F.get(words, F.lit(0))
    cut_off = (F.length(first) <= 2) | ~first.rlike("^\\p{Lu}")
    places = F.filter(F.transform(words, lambda w, i: F.when(w.rlike("^\\p{Lu}") & (F.length(w) > 2), i)), lambda i: i.isNotNull())
    start = F.get(places, F.lit(0))
    from_there = F.array_join(F.slice(words, start + 1, F.size(words)), " ")
    t = F.when((F.size(words) > 0) & cut_off & (start > 0), from_there).otherwise(clean)
    head = stripped(F.substring(t, 1, MOST_CHARACTERS))
    head = F.when(F.length(t) > MOST_CHARACTERS, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(~is_repetitive(raw) & ~is_repetitive(clean) & (head != "") & ~is_repetitive(head), head)


def tidy(title: Column) -> Column:
    """Without marks, blanks collapsed, eight words at most; a stand-in if nothing is left."""
    words = _words(F.regexp_replace(F.coalesce(title, F.lit("")), fixed.TITLE_MARKS, ""))
    return F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, MOST_WORDS), " ")).otherwise(fixed.UNTITLED)


def titles(chunks: DataFrame, segment: str) -> DataFrame:
    """segment, title, source for chunks (segment, pos, ocr_text, visual_context, transcript).

    The first that a segment's chunks, in order of pos, have: a heading (ocr), a caption, keywords that weigh 3 on
    slides, 2 in descriptions and 1 in speech, a phrase; else none.
    """
    c = chunks.select(segment, "pos", *WEIGHTS)
    found = {"ocr": heading(F.col("ocr_text")), "caption": caption(F.col("visual_context")), "phrase": phrase(F.col("transcript"))}
    own = c.select(segment, "pos", *[v.alias(k) for k, v in found.items()])
    first = own.groupBy(segment).agg(*[F.min(F.when(F.col(k).isNotNull(), F.struct("pos", F.col(k).alias("t"))))["t"].alias(k) for k in found])
    fields = F.array(*[F.struct((F.col("pos") * len(WEIGHTS) + i).alias("pos"), F.lit(w).alias("weight"), F.coalesce(f, F.lit("")).alias("text")) for i, (f, w) in enumerate(WEIGHTS.items())])
    rows = c.select(F.col(segment).alias("lecture_id"), F.inline(fields))
    noise = {w for m in [*fixed.SLIDE_BOILERPLATE, *fixed.CAPTION_OPENERS] for w in m.split()}
    keywords = keyword_titles(rows, sorted({*fixed.TITLE_STOPWORDS, *noise, *fixed.CAPTION_WORDS})).select(F.col("lecture_id").alias("_segment"), F.col("title").alias("keywords"))
    d = first.join(keywords, F.col(segment).eqNullSafe(F.col("_segment")), "left")
    order = ["ocr", "caption", "keywords", "phrase"]
    source = reduce(lambda a, k: F.when(F.col(k).isNotNull(), k).otherwise(a), reversed(order), F.lit("none"))
    return d.select(segment, tidy(F.coalesce(*order)).alias("title"), source.alias("source"))
