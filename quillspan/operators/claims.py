"""One-to-one matching of what was predicted with a gold standard: names, relations, prerequisites.

Items claim targets in turn, each the best one that is still free.  In rounds: an item
and a target that are each other's first choice among what is left belong together
whatever else happens, so all such pairs are settled at once.  The outcome is the same
as that of the loop over all items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions import text as X
from quillspan.operators.containment import contained
from quillspan.sources.scratch import written


def claimed(candidates: DataFrame) -> DataFrame:
    """item, target, choice: who gets what, for candidates (item, target, turn, choice).

    `turn` orders the items (one value each, no ties), `choice` the targets of an item (no
    ties); an item takes its least choice that no earlier turn took.  A round settles at
    least the earliest item that is left.
    """
    left, found = written(candidates.select("item", "target", "turn", "choice"), "claims"), []
    while not left.isEmpty():
        wants = left.groupBy("item").agg(F.min(F.struct("choice", "target")).alias("_w")).select("item", F.col("_w.target").alias("target"), F.col("_w.choice").alias("choice"))
        takes = left.groupBy("target").agg(F.min(F.struct("turn", "item")).alias("_t")).select("target", F.col("_t.item").alias("item"))
        found.append(written(wants.join(takes, ["item", "target"]), "claimed"))
        gone = found[-1]
        left = written(left.join(gone.select("item"), "item", "left_anti").join(gone.select("target"), "target", "left_anti"), "claims")
    none = candidates.select("item", "target", "choice").limit(0)
    return reduce(DataFrame.union, [none, *found])


def _without_spares(candidates: DataFrame, like: list[str]) -> DataFrame:
    """Candidates (item, like, target, turn, choice) less the items that come too late: of items with the same candidates no more can match than those have targets."""
    w = Window.partitionBy(*like, "target").orderBy("turn")
    most = candidates.groupBy(*like).agg(F.countDistinct("target").alias("_most"))
    return candidates.withColumn("_nth", F.row_number().over(w)).join(most, like).filter("_nth <= _most").drop("_nth", "_most")


def spellings(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name, key: what a normalised name is compared by: its own singular tokens, and those of the names that it is an alias of.

    aliases (alias, canonical), both normalised; an empty name has no key.
    """
    own = names.select("name").filter("name <> ''").distinct()
    other = own.join(aliases.select(F.col("alias").alias("name"), "canonical"), "name").filter("canonical <> ''")
    return own.select("name", X.lemma_key(F.col("name")).alias("key")).union(other.select("name", X.lemma_key(F.col("canonical")).alias("key"))).distinct()


def normalised_aliases(gold_aliases: DataFrame) -> DataFrame:
    """alias, canonical: normalised and distinct, blank ones left out, of gold_aliases (alias, canonical)."""
    a = gold_aliases.select(X.normalize_name(F.col("alias")).alias("alias"), X.normalize_name(F.col("canonical")).alias("canonical"))
    return a.filter("alias <> '' and canonical <> ''").distinct()


def matched_names(predicted: DataFrame, gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """item, target, stage for each predicted (item, turn, name): the gold concept that it claims, or null.

    gold (name) and aliases (alias, canonical) may repeat; a concept is a normalised gold name.  Stages, the first free
    concept counts, by name within one: EXACT, ALIAS, LEMMA, ALIAS_LEMMA.  Blank names match nothing.
    """
    p = predicted.select("item", "turn", X.normalize_name(F.coalesce("name", F.lit(""))).alias("name")).filter("name <> ''")
    g = gold.select(X.normalize_name(F.col("name")).alias("target")).filter("target <> ''").distinct()
    a = normalised_aliases(aliases).join(g.withColumnRenamed("target", "canonical"), "canonical", "left_semi")
    names = p.select("name").distinct().withColumn("key", X.lemma_key(F.col("name")))
    stage = lambda d, n: d.select("name", "target", F.lit(n).alias("stage"))
    exact = stage(names.join(g, F.col("name") == F.col("target")), 0)
    alias = stage(names.join(a, F.col("name") == F.col("alias")).withColumnRenamed("canonical", "target"), 1)
    lemma = stage(names.join(g.withColumn("key", X.lemma_key(F.col("target"))), "key"), 2)
    lemma_alias = stage(names.join(a.select(X.lemma_key(F.col("alias")).alias("key"), F.col("canonical").alias("target")).distinct(), "key"), 3)
    found = exact.union(alias).union(lemma).union(lemma_alias).groupBy("name", "target").agg(F.min("stage").alias("stage"))
    candidates = p.join(found, "name").select("item", "name", "target", "turn", F.struct("stage", F.col("target").alias("by_name")).alias("choice"))
    got = claimed(_without_spares(candidates, ["name"]))
    named = F.element_at(F.array(*map(F.lit, ["EXACT", "ALIAS", "LEMMA", "ALIAS_LEMMA"])), F.col("choice.stage") + 1)
    return predicted.join(got.select("item", "target", named.alias("stage")), "item", "left")


def _near(a: DataFrame, b: DataFrame) -> DataFrame:
    """p, g: names of a (name) and of b (name) of which one contains the other."""
    up = contained(a.select(F.col("name").alias("text_id"), F.col("name").alias("text")), b).select(F.col("text_id").alias("p"), F.col("name").alias("g"))
    down = contained(b.select(F.col("name").alias("text_id"), F.col("name").alias("text")), a).select(F.col("name").alias("p"), F.col("text_id").alias("g"))
    return up.union(down).distinct()


def _ends(d: DataFrame) -> DataFrame:
    return d.select(F.col("s").alias("name")).union(d.select(F.col("t").alias("name"))).filter("name <> ''").distinct()


def _by_keys(p: DataFrame, g: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The distinct (s, t, `on`) of p with the g's (gs, gt, `on`) whose ends have their keys."""
    asked = p.select("s", "t", *on).distinct()
    asked = asked.join(keys.select(F.col("name").alias("s"), F.col("key").alias("_ks")), "s").join(keys.select(F.col("name").alias("t"), F.col("key").alias("_kt")), "t")
    own = g.filter("gs <> '' and gt <> ''").withColumns({"_ks": X.lemma_key(F.col("gs")), "_kt": X.lemma_key(F.col("gt"))})
    return asked.join(own, ["_ks", "_kt", *on]).drop("_ks", "_kt").distinct()


OUTCOMES = ["FORWARD", "REVERSED", "FUZZY"]


def matched_relations(predicted: DataFrame, gold: DataFrame, aliases: DataFrame) -> DataFrame:
    """item, outcome, gold_source, gold_relation, gold_target for each predicted (item, turn, source, relation, target).

    Gold relations (source, relation, target) are distinct after names are normalised and
    each is claimed once, in order of its parts.  A prediction first claims a gold with
    its ends (by singular tokens or an alias) and type (FORWARD), then one with swapped ends
    (REVERSED).  If none is free but a gold of any type, claimed or not, joins the ends, it is a TYPE_MISMATCH;
    else it may claim one of its type whose ends contain its own or are contained in them
    (FUZZY), else it is UNMATCHED.  Empty names are inside no other.
    """
    norm = lambda c: X.normalize_name(F.coalesce(c, F.lit("")))
    p = predicted.select("item", "turn", norm("source").alias("s"), F.trim("relation").alias("rel"), norm("target").alias("t"))
    g = gold.select(norm("source").alias("gs"), F.trim("relation").alias("rel"), norm("target").alias("gt")).distinct()
    keys = spellings(_ends(p), normalised_aliases(aliases))
    swapped = g.select(F.col("gs").alias("gt"), F.col("gt").alias("gs"), "rel")
    target = F.struct("gs", "rel", "gt").alias("target")
    turned = F.struct(F.col("gt").alias("gs"), "rel", F.col("gs").alias("gt")).alias("target")
    forward = _by_keys(p, g, keys, ["rel"]).select("s", "rel", "t", target, F.lit(0).alias("stage"))
    reverse = _by_keys(p, swapped, keys, ["rel"]).select("s", "rel", "t", turned, F.lit(1).alias("stage"))
    # ends that a gold of any type joins, either way round; equal names count even if empty
    ends = g.select("gs", "gt").union(swapped.select("gs", "gt")).distinct()
    equal = p.select("s", "t").distinct().join(ends.select(F.col("gs").alias("s"), F.col("gt").alias("t")), ["s", "t"], "left_semi")
    joined = written(_by_keys(p, ends, keys, []).select("s", "t").union(equal).distinct(), "joined-ends")
    loose = p.select("s", "rel", "t").distinct().join(joined, ["s", "t"], "left_anti")
    gold_ends = _ends(g.select(F.col("gs").alias("s"), F.col("gt").alias("t")))
    near = written(_near(_ends(loose), gold_ends), "near-names")
    fuzzy = loose.join(near.select(F.col("p").alias("s"), F.col("g").alias("gs")), "s").join(near.select(F.col("p").alias("t"), F.col("g").alias("gt")), "t").join(g, ["gs", "rel", "gt"])
    fuzzy = fuzzy.select("s", "rel", "t", target, F.lit(2).alias("stage"))
    every = forward.union(reverse).union(fuzzy).groupBy("s", "rel", "t", "target").agg(F.min("stage").alias("stage"))
    candidates = p.join(every, ["s", "rel", "t"]).select("item", "s", "rel", "t", "target", "turn", F.struct("stage", F.col("target").alias("by_name")).alias("choice"))
    got = claimed(_without_spares(candidates, ["s", "rel", "t"]))
    rest = F.when(F.col("_joined").isNotNull(), "TYPE_MISMATCH").otherwise("UNMATCHED")
    named = F.element_at(F.array(*map(F.lit, OUTCOMES)), F.col("choice.stage") + 1)
    d = p.join(got.select("item", "target", named.alias("_named")), "item", "left").join(joined.withColumn("_joined", F.lit(True)), ["s", "t"], "left")
    return d.select("item", F.coalesce("_named", rest).alias("outcome"), F.col("target.gs").alias("gold_source"), F.col("target.rel").alias("gold_relation"), F.col("target.gt").alias("gold_target"))


def matched_prerequisites(predicted: DataFrame, gold: DataFrame, aliases: DataFrame, fuzzy: bool = False) -> DataFrame:
    """item, gold_item for each predicted (item, turn, confidence, source, target): the gold edge (gold_item, source, target) that it claims, or null.

    The most confident claims first (a missing confidence is 1), ties by turn; of several golds the least gold_item,
    which is also the gold's place.  Strict: ends agree by singular tokens or an alias.
    Fuzzy: else an edge whose ends contain its own or are contained in them.
    """
    norm = lambda c: X.normalize_name(F.coalesce(c, F.lit("")))
    turn = F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("c"), F.col("turn").alias("nth"))
    p = predicted.select("item", turn.alias("turn"), norm("source").alias("s"), norm("target").alias("t"))
    g = gold.select(F.col("gold_item").alias("target"), norm("source").alias("gs"), norm("target").alias("gt"))
    keys = spellings(_ends(p), normalised_aliases(aliases))
    found = _by_keys(p, g, keys, []).select("s", "t", "target", F.lit(0).alias("stage"))
    if fuzzy:
        near = written(_near(_ends(p), _ends(g.select(F.col("gs").alias("s"), F.col("gt").alias("t")))), "near-names")
        some = p.select("s", "t").distinct().join(near.select(F.col("p").alias("s"), F.col("g").alias("gs")), "s").join(near.select(F.col("p").alias("t"), F.col("g").alias("gt")), "t").join(g, ["gs", "gt"])
        found = found.union(some.select("s", "t", "target", F.lit(1).alias("stage")))
    found = found.groupBy("s", "t", "target").agg(F.min("stage").alias("stage"))
    # files of predictions are small for their rows, which a broadcast would hold whole
    candidates = p.hint("merge").join(found, ["s", "t"]).select("item", "s", "t", "target", "turn", F.struct("stage", F.col("target").alias("nth")).alias("choice"))
    got = claimed(_without_spares(candidates, ["s", "t"]))
    return predicted.select("item").hint("merge").join(got.select("item", F.col("target").alias("gold_item")), "item", "left")


def scores(matched: Column, predicted: Column, gold: Column) -> list[Column]:
    """tp, predicted, gold, precision, recall, f1: rates to four digits, 0 where nothing counts."""
    p = F.when(predicted == 0, 0.0).otherwise(matched / predicted)
    r = F.when(gold == 0, 0.0).otherwise(matched / gold)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rates = [F.round(c, 4).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"))]
    return [matched.alias("tp"), predicted.alias("predicted"), gold.alias("gold"), *rates]
