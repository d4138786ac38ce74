"""Names inside texts: exact substring joins by an index of words, and of runs of characters in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.sources.scratch import written

#: Runs of so many characters are indexed; a token is looked for by a run of the longest that fits.
GRAMS = (1, 2, 4, 8, 16)
#: Names of five tokens or more are looked for by a run of so many tokens, from the second on.
RUN = 3


def grams(text: Column, q: int) -> Column:
    """The distinct runs of q characters of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)))


def _split(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))


def _run(tokens: Column, i: int | Column) -> Column:
    return F.xxhash64(F.array_join(F.slice(tokens, i, RUN), " "))


def _words_with(tokens: DataFrame, words: DataFrame, keys: list[str], carried: tuple[str, ...] = ()) -> DataFrame:
    """keys, _word, carried (columns of words), _token: the words that have each token inside.  Both are distinct.

    A token is looked for by the run of characters that the fewest tokens have, so a word's run meets no more
    tokens than share all their runs.  Words are cut into runs of those lengths only that tokens ask for.
    """
    size = reduce(lambda other, q: F.when(F.length("_token") >= q, q).otherwise(other), GRAMS[1:], F.lit(GRAMS[0]))
    sizes = sorted(r[0] for r in tokens.select(size).distinct().collect()) or [GRAMS[0]]
    own = reduce(lambda other, q: F.when(F.length("_token") >= q, grams(F.col("_token"), q)).otherwise(other), GRAMS[1:], grams(F.col("_token"), GRAMS[0]))
    runs = tokens.select(*keys, "_token", F.explode(own).alias("_gram"))
    rarest = runs.join(runs.groupBy(*keys, "_gram").agg(F.count(F.lit(1)).alias("_n")), [*keys, "_gram"])
    rarest = written(rarest.groupBy(*keys, "_token").agg(F.min(F.struct("_n", "_gram"))["_gram"].alias("_gram")), "rarest")
    every = words.filter(F.length("_word") >= sizes[0]).select(*keys, "_word", *carried, F.explode(F.array_distinct(F.concat(*[grams(F.col("_word"), q) for q in sizes]))).alias("_gram"))
    return every.join(rarest, [*keys, "_gram"]).filter(F.contains("_word", "_token")).select(*keys, "_word", *carried, "_token")


def _no_blanks(names: DataFrame) -> DataFrame:
    return names.withColumn("name", F.when(F.col("name").rlike("\\s"), F.raise_error(F.lit("a name has a blank"))).otherwise(F.col("name")))


def contained(texts: DataFrame, names: DataFrame, within: list[str] | None = None, words: bool = False) -> DataFrame:
    """within, text_id, name: the names (within, name) that occur in each text (within, text_id, text), as substrings.

    A token of a name is part of a word of the text, so names are looked for in the distinct
    words of a tenant, by runs of characters, and words lead to texts; names of five
    tokens or more meet texts by an equal run of tokens.  Pairs are tested, but for names that are one token: a word
    that has the token is in the text.  `within`: columns
    that have to be equal, as a tenant.  `words`: no name has a blank (else this fails), so runs
    of tokens need not be looked for.  Empty and null names and texts are left out.
    """
    keys = list(within or [])
    names = names.select(*keys, "name").filter("length(name) > 0").distinct()
    texts = texts.select(*keys, "text_id", "text").filter("length(text) > 0")
    # names are used several times and may be dear to make
    parts = written((_no_blanks(names) if words else names).withColumn("_t", F.array("name") if words else _split("name")), "names")
    least, most = parts.agg(F.min(F.size("_t")), F.max(F.size("_t"))).first()
    # inner tokens stand as whole words; of a name of one or two, any is part of a word
    inner = F.when(F.size("_t") > 2, F.slice("_t", F.lit(2), F.size("_t") - 2)).otherwise(F.col("_t"))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    few = parts.filter(F.size("_t") < RUN + 2).select(*keys, "name", F.coalesce(longest, F.substring("name", 1, 1)).alias("_token"))
    # a blank is looked for only if there is a name of blanks
    blanks = F.regexp_extract_all("text", F.lit("\\s"), F.lit(0)) if least == 0 else F.array().cast("array<string>")
    said = texts.select(*keys, "text_id", F.explode(F.array_distinct(F.concat(_split("text"), blanks))).alias("_word"))
    by_word = _words_with(few.select(*keys, "_token").distinct(), said.select(*keys, "_word").distinct(), keys).join(few, [*keys, "_token"])
    found = said.join(by_word.select(*keys, "name", "_word", (F.col("name") == F.col("_token")).alias("_sure")), [*keys, "_word"]).select(*keys, "text_id", "name", "_sure")
    if most is not None and most >= RUN + 2:
        many = parts.filter(F.size("_t") >= RUN + 2).select(*keys, "name", _run(F.col("_t"), 2).alias("_run"))
        runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - RUN + 1)), lambda i: _run(w, i))
        by_run = texts.select(*keys, "text_id", F.explode(F.array_distinct(F.transform(F.array(_split("text")), runs)[0])).alias("_run"))
        # runs lead to texts by digest: what two of them share is told apart below
        digest = F.xxhash64(*keys, "_run").alias("_at")
        found = found.union(by_run.select(digest, "text_id").join(many.select(*keys, "name", digest), "_at").select(*keys, "text_id", "name", F.lit(False)))
    if most is None or most < 2 and least == 1:
        return found.select(*keys, "text_id", "name").filter("name is not null").distinct()
    found = written(found.groupBy(*keys, "text_id", "name").agg(F.max("_sure").alias("_sure")), "found")
    tested = found.filter(~F.col("_sure")).join(texts, [*keys, "text_id"]).filter(F.contains("text", "name"))
    return found.filter("_sure").select(*keys, "text_id", "name").union(tested.select(*keys, "text_id", "name"))


def first_places(places: DataFrame, names: DataFrame, within: list[str]) -> DataFrame:
    """within, name, place: the least place of texts (within, place, text) that have each name (within, name) inside, for names without a blank (another makes this fail).

    Words of a tenant meet names with their least place, so texts are cut into words once and moved as words.
    """
    parts = written(_no_blanks(names.select(*within, "name").filter("length(name) > 0").distinct()), "names")
    said = places.filter("length(text) > 0").select(*within, "place", F.explode(F.array_distinct(_split("text"))).alias("_word")).groupBy(*within, "_word").agg(F.min("place").alias("place"))
    by_word = _words_with(parts.select(*within, F.col("name").alias("_token")), said, within, ("place",))
    return by_word.groupBy(*within, F.col("_token").alias("name")).agg(F.min("place").alias("place"))


def _sentences(text: str) -> Column:
    return F.split(text, "(?<=[.!?])\\s+")


def sentences(texts: DataFrame, within: list[str]) -> DataFrame:
    """within, text_id, nth, text: the sentences of each text, split after . ! or ? and blanks."""
    return texts.select(*within, "text_id", F.posexplode(_sentences("text")).alias("nth", "text"))


def evidence(relations: DataFrame, texts: DataFrame, indicators: str, within: list[str], words: bool = False) -> DataFrame:
    """relations (within, source, target; distinct) with tier, text_id and sentence of their best evidence among texts (within, text_id, text).

    Names count without regard to case and blanks at their ends.  3: the first sentence with both names
    has an indicator; 2: a sentence has both; 1: a text has both; 0: none.  Of the best
    tier the first text by text_id, in which the first sentence with both decides.  `words`: no name has a blank inside.
    """
    # relations are used several times and may be dear to make
    relations = written(relations, "relations")
    pairs = relations.select(*within, "source", "target", F.lower(F.trim("source")).alias("_a"), F.lower(F.trim("target")).alias("_b"))
    names = pairs.select(*within, F.col("_a").alias("name")).union(pairs.select(*within, F.col("_b").alias("name"))).distinct()
    low = texts.select(*within, "text_id", F.lower("text").alias("text"))
    in_text = written(contained(low, names, within, words), "in-text")
    one = pairs.join(in_text.withColumnRenamed("name", "_a"), [*within, "_a"])
    both = one.join(in_text.withColumnRenamed("name", "_b"), [*within, "text_id", "_b"])
    # a text is cut into sentences once, and only relations whose names it has meet it
    both = both.join(texts.select(*within, "text_id", _sentences("text").alias("_s")), [*within, "text_id"])
    has = lambda s: F.contains(F.lower(s), "_a") & F.contains(F.lower(s), "_b")
    both = both.withColumn("_nth", F.array_position(F.transform("_s", has), True).cast("int"))
    tier = F.when(F.col("_nth") == 0, 1).when(F.get("_s", F.col("_nth") - 1).rlike(indicators), 3).otherwise(2)
    both = both.withColumns({"_tier": tier, "_nth": F.when(F.col("_nth") > 0, F.col("_nth") - 1)})
    best = both.groupBy(*within, "source", "target").agg(F.min(F.struct((-F.col("_tier")).alias("t"), "text_id", F.col("_nth").alias("nth"))).alias("_best"))
    found = relations.join(best, [*within, "source", "target"], "left")
    return found.select(*relations.columns, F.coalesce(-F.col("_best.t"), F.lit(0)).alias("tier"), F.col("_best.text_id").alias("text_id"), F.col("_best.nth").alias("sentence"))
