"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. A document's size is its number of words.  Sources weigh 1, 2, 3, 1, 2, 3, ...
   in code-point order (null last) and share all words; a target stops at
   `most_repeats` times its source's size, and the excess goes to the others.
2. Each source's documents fall into shards of about `shard_words` words (a
   document counts as one more) by md5 of their id and text, and lie in each shard in md5 order, as one stream of words cut
   into blocks of `block_words`.
3. Sources get whole blocks by highest quotients v / (2s + 1), and each source's
   blocks go to its shards in the same way.  Where only a bounded range of seats
   around the proportional share can decide, only those quotients are ranked.
4. A shard takes all its blocks as often as they go into its quota, and the rest
   as a run of blocks from a seeded start.  A document takes what those blocks
   hold of it, so no document is taken over `most_repeats` times.

All is DataFrame code.  Groups are spread: documents are numbered within shards
of bounded size, and everything above shards works on one row per shard or source.

Defined results: null text has size 0 and takes 0; null source is a source of
its own, last in order; repeated rows count as separate documents; an empty table
gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.shared import cut, same_keys, word_count

SEED = "mix-1"
#: Words of a block, and about how many words a shard holds.
BLOCK_WORDS, SHARD_WORDS, MOST_REPEATS = 64, 2_000_000, 3


def digest(seed: str, doc_id: Column, text: Column) -> Column:
    """The text counts too: rows with one id, or without one, spread."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def hashed(text: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, source_rows, target.

    The capped shares are min(cap, weight * level) for one level: with sources in
    order of cap / weight, the first k are at their caps for the least k for which
    the others, sharing what is left, are below theirs.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    s = s.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double")).withColumn("cap", (most_repeats * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("weights", F.sum("weight").over(every))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("open", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    s = s.withColumn("first_open", F.first("open", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "source_rows", F.least(F.col("cap"), F.coalesce(F.col("first_open") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], tie: list[Column]) -> DataFrame:
    """Add `seats` to parties (votes double, house long): highest quotients votes / (2s + 1) win the house's seats within each group.

    A party's seats differ from house * share by at most share * n / 2 + 1, n the
    number of parties, so quotients outside that range are decided without being
    listed; about 3 n are ranked.
    """
    w = Window.partitionBy(*group)
    p = parties.withColumn("_votes", F.sum("votes").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    share = F.when(F.col("_votes") > 0, F.col("votes") / F.col("_votes")).otherwise(0.0)
    p = p.withColumn("_sure", F.greatest(F.lit(0), F.floor(share * (F.col("house") - F.col("_n") / 2)) - 1).cast("long"))
    p = p.withColumn("_most", F.when(F.col("votes") > 0, F.ceil(share * (F.col("house") + F.col("_n") / 2)) + 2).otherwise(0).cast("long"))
    p = p.withColumn("_left", F.col("house") - F.sum("_sure").over(w)).withColumn("_tie", F.row_number().over(w.orderBy(*tie)))
    seats = p.filter(F.col("_most") > F.col("_sure")).select(*group, "_tie", "_left", "votes", F.explode(F.sequence("_sure", F.col("_most") - 1)).alias("_s"))
    won = seats.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.col("votes") / (2 * F.col("_s") + 1)), "_tie"))).filter(F.col("_rank") <= F.col("_left"))
    won = won.groupBy(*group, "_tie").agg(F.count(F.lit(1)).alias("_won"))
    return same_keys(p, won, [*group, "_tie"], "left").select(*parties.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("seats"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest(seed, F.col("doc_id"), F.col("text")).alias("digest"))
    return mix_sizes(cut(sizes, "mix-sizes"), block_words, shard_words, most_repeats, seed).drop("digest")


def mix_sizes(sizes: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """mix() for rows that have their sizes and digests: other columns are carried along (none may begin with an underscore)."""
    carried = [c for c in sizes.columns if c not in ("source", "size")]
    by_source = targets(sizes, most_repeats).withColumn("_shards", F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("source_rows")) / shard_words)).cast("long")).drop("source_rows")
    placed = same_keys(sizes, by_source, ["source"], "left").withColumn("_shard", F.pmod(hashed(F.col("digest")), F.col("_shards"))).drop("_shards")
    inside = Window.partitionBy("source", "_shard")
    placed = placed.withColumn("_start", F.sum("size").over(inside.orderBy(F.substring("digest", 9, 24), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    shards = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"))
    # blocks of each source, of all that the targets add up to
    house = by_source.select("source", F.col("target").alias("votes"), F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long").alias("house"))
    quotas = sainte_lague(house, [], [F.col("source").isNull(), F.col("source").cast("binary")])
    s = same_keys(shards, quotas.select("source", F.col("seats").alias("house")), ["source"]).withColumn("votes", F.col("_words").cast("double"))
    quota = sainte_lague(s, ["source"], [F.col("_shard")])
    words = F.least(F.col("seats") * block_words, most_repeats * F.col("_words"))
    rounds = F.when(F.col("_words") > 0, F.floor(words / F.col("_words"))).otherwise(0).cast("long")
    quota = quota.withColumn("_rounds", rounds).withColumn("_run", words - rounds * F.col("_words"))
    begin = F.pmod(hashed(F.md5(F.concat(F.lit(seed + ":start:"), F.coalesce(F.col("source"), F.lit("null")), F.lit(":"), F.col("_shard").cast("string")).cast("binary"))), F.greatest(F.lit(1), F.floor(F.col("_words") / block_words))) * block_words
    quota = quota.withColumn("_begin", begin).select("source", "_shard", "_words", "_rounds", "_run", "_begin")
    # a document's words within the run [begin, begin + run) on the ring of the shard's words
    common = lambda a, b: F.greatest(F.lit(0), F.least(F.col("_start") + F.col("size"), b) - F.greatest(F.col("_start"), a))
    end = F.col("_begin") + F.col("_run")
    taken = F.col("_rounds") * F.col("size") + common(F.col("_begin"), F.least(end, F.col("_words"))) + common(F.lit(0), end - F.col("_words"))
    out = same_keys(placed, quota, ["source", "_shard"], "left")
    return out.select(*carried, "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def taken_texts(text: Column, size: Column, taken: Column) -> Column:
    """The texts that a document gives to the mix: whole copies, then its first words for the rest."""
    begins = F.regexp_replace(text, "^[\\x20\\x09-\\x0D]+", "")
    pieces = F.split(begins, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])")
    rest = (taken % size).cast("int")
    head = F.regexp_replace(F.array_join(F.slice(pieces, F.lit(1), rest), ""), "[\\x20\\x09-\\x0D]+$", "")
    whole = F.array_repeat(text, F.floor(taken / size).cast("int"))
    return F.when(size > 0, F.when(rest > 0, F.concat(whole, F.array(head))).otherwise(whole)).otherwise(F.array().cast("array<string>"))


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, most_repeats: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """docs as the mix takes them, in the same columns: a row for each copy, and one with the first words where a document is taken in part; n_chars follows the text.

    The sizes alone are mixed; the texts move once, to their rows' decisions.  Equal rows share theirs out.
    """
    # the row travels as one column, so that no name of it can clash
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), F.xxhash64("doc_id", "text").alias("_hash"), "doc_id", "source", "text", F.struct("*").alias("_row"))
    sizes = keyed.select("doc_id", "source", F.col("_id").alias("row_id"), F.col("_hash").alias("row_hash"), word_count(F.col("text")).alias("size"), digest(seed, F.col("doc_id"), F.col("text")).alias("digest"))
    found = mix_sizes(cut(sizes, "mix-sizes"), block_words, shard_words, most_repeats, seed).filter("taken > 0")
    found = found.select(F.col("row_id").alias("_id"), F.col("row_hash").alias("_hash"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(1)))
    rows = keyed.select("_id", "_hash", "_row").withColumn("_nth", nth).join(found.withColumn("_nth", nth), ["_id", "_hash", "_nth"])
    rows = rows.withColumn("_text", F.explode(taken_texts(F.col("_row.text"), F.col("_size"), F.col("_taken"))))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("_row").getField(c).alias(c) for c in docs.columns])
