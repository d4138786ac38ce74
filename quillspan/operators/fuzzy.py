"""The names that fit a query best: by stems, else by letters; exact over all names, without comparing every pair.

A score depends on the significant words alone, so queries and names meet as distinct
phrases.  Names that share a stem with the query meet in a join on stems.  Others can
only score if a word of theirs is alike to one of the query's, or the whole phrase is:
such strings meet by their rarest letters.  Alike to the share r of
their letters (twice the matching ones over both lengths) means at least r (m + n) / 2 letters in
common, counted with repeats, hence lengths not too different, and (prefix filtering) a
common one among the rarest m - ceil(r m / (2 - r)) + 1 letters of either.  What
passes these bounds is scored exactly.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from quillspan.functions import fixed
from quillspan.functions.text import query_stem

#: A name of one word has to be this much alike, a longer one this much.
ONE_WORD, PHRASE = 0.82, 0.72
#: Letters from rare to frequent: a guess that only decides how many pairs are looked at.
RARE_FIRST = "zqxjkvbpygfwmucldrhsnioate"


def significant(text: Column) -> Column:
    """The words of a query or name that can name something, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(fixed.ENTITY_STOPWORDS))


def _letters(text: Column) -> Column:
    """The letters of a string, each with the number of equal ones before it; repeats and rare letters first."""
    places = "".join(chr(ord("A") + i) for i in range(len(RARE_FIRST)))
    sorted_ = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    nth = lambda s, c, i: F.lpad((9999 - (i + 1 - F.array_position(s, c))).cast("string"), 4, "0")
    return F.array_sort(F.transform(F.array(sorted_), lambda s: F.transform(s, lambda c, i: F.concat(nth(s, c, i), F.translate(c, RARE_FIRST, places), c)))[0])


def possibly_alike(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a, b: the pairs of distinct strings a (text) and b (text) that may be alike to the share `least`; no pair that is gets lost."""

    def indexed(d: DataFrame, name: str) -> DataFrame:
        d = d.select(F.col("text").alias(name)).filter(f"length({name}) > 0").distinct().withColumn(f"_l{name}", _letters(F.col(name)))
        n = F.size(f"_l{name}")
        first = (n - F.ceil(n * (least / (2 - least)) - 1e-9) + 1).cast("int")
        return d.withColumn(f"_p{name}", F.slice(f"_l{name}", F.lit(1), first))

    x, y = indexed(a, "a"), indexed(b, "b")
    met = x.withColumn("_key", F.explode("_pa")).join(y.withColumn("_key", F.explode("_pb")), "_key")
    need = F.ceil((F.size("_la") + F.size("_lb")) * (least / 2) - 1e-9)
    met = met.filter((F.least(F.size("_la"), F.size("_lb")) >= need) & (F.size(F.array_intersect("_la", "_lb")) >= need))
    # a pair counts where it meets first
    return met.filter(F.array_min(F.array_intersect("_pa", "_pb")) == F.col("_key")).select("a", "b")


@pandas_udf(StructType([StructField(c, DoubleType()) for c in ("mean", "most", "whole")]))
def likeness(asked: pd.Series, own: pd.Series) -> pd.DataFrame:
    """Of the words of two phrases (blanks between): the mean and the largest of what each own word is alike to its nearest asked one, and what the phrases are."""
    alike = lambda a, b: SequenceMatcher(None, a, b).ratio()
    out = []
    for q, n in zip(asked, own, strict=True):
        nearest = [max(alike(a, b) for a in q.split(" ")) for b in n.split(" ")]
        out.append((sum(nearest) / len(nearest), max(nearest), alike(n, q)))
    return pd.DataFrame(out, columns=["mean", "most", "whole"], dtype=float)


def phrase_scores(asked: DataFrame, own: DataFrame) -> DataFrame:
    """asked, own, score (above 0) for distinct phrases asked (asked) and own (own) of significant words.

    1 if all stems of the name are asked; 0.7 and 0.3 times their share if some of several are; else how
    much the letters are alike, if that is enough.
    """
    asked, own = asked.filter("asked <> ''"), own.filter("own <> ''")
    stems = lambda c: F.array_distinct(F.transform(F.split(c, " "), query_stem))
    q = asked.select("asked", F.explode(stems("asked")).alias("stem"))
    n = own.select("own", stems("own").alias("_s")).select("own", F.size("_s").alias("_n"), F.explode("_s").alias("stem"))
    shared = q.join(n, "stem").groupBy("asked", "own").agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n"))
    recall = F.col("_k") / F.col("_n")
    by_stem = shared.select("asked", "own", F.when(recall == 1.0, 1.0).otherwise(0.70 + 0.30 * recall).alias("score"))
    words = lambda d, c: d.select(c, F.explode(F.array_distinct(F.split(c, " "))).alias("text"))
    near = possibly_alike(words(asked, "asked").select("text"), words(own, "own").select("text"), PHRASE)
    by_word = near.join(words(asked, "asked").withColumnRenamed("text", "a"), "a").join(words(own, "own").withColumnRenamed("text", "b"), "b").select("asked", "own")
    longer = own.filter(F.contains("own", F.lit(" "))).select(F.col("own").alias("text"))
    by_phrase = possibly_alike(asked.select(F.col("asked").alias("text")), longer, PHRASE).select(F.col("a").alias("asked"), F.col("b").alias("own"))
    pairs = by_word.union(by_phrase).distinct().join(by_stem, ["asked", "own"], "left_anti").withColumn("_x", likeness("asked", "own"))
    one, several = F.col("_x.most"), F.greatest("_x.mean", "_x.whole")
    score = F.when(F.contains("own", F.lit(" ")), F.when(several >= PHRASE, several)).otherwise(F.when(one >= ONE_WORD, one))
    return by_stem.union(pairs.select("asked", "own", score.alias("score")).filter("score is not null"))


def best_names(queries: DataFrame, names: DataFrame, k: int = 3, least: float = 0.0, within: list[str] | None = None) -> DataFrame:
    """query_id, node, name, score, rank: the k best nodes of each query (query_id, query) among names (node, name), from `least` on; scores to six digits, ties by name and node.

    `within`: columns of both that have to be equal, as a tenant.
    """
    keys = list(within or [])
    q = queries.select(*keys, "query_id", F.array_join(significant(F.col("query")), " ").alias("asked"))
    n = names.select(*keys, "node", "name", F.array_join(significant(F.col("name")), " ").alias("own"))
    # of equal phrases only the first k can be among the best
    n = n.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "own").orderBy("name", "node"))).filter(F.col("_r") <= k).drop("_r")
    s = phrase_scores(q.select("asked").distinct(), n.select("own").distinct()).withColumn("score", F.round("score", 6)).filter((F.col("score") > 0) & (F.col("score") >= least))
    w = Window.partitionBy(*keys, "asked").orderBy(F.desc("score"), "name", "node")
    both = s.join(q.select(*keys, "asked").distinct(), "asked").join(n, [*keys, "own"])
    best = both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return q.join(best, [*keys, "asked"]).select("query_id", "node", "name", "score", "rank")
