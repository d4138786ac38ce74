"""The prefix trie of conversations by prefix doubling: names instead of texts, joins in logarithmic rounds.

Turns get dense names (equal names: equal role and text).  Blocks of two, four,
eight ... turns at multiples of their length are named by the pairs of their halves'
names, one round for each doubling.  A prefix of d turns is composed from the blocks of
d's binary digits: rounds from the longest block down name the prefix of every d
whose lowest digit that block is, by the pair (prefix without it, block).  So equal names
at a depth mean equal prefixes, and nodes are groups of numbers.  Sums over
subtrees double as well: after round k a node has the sum over the 2^k levels from it down,
and hands it to its ancestor 2^k levels up, which it finds by its own least
member's prefix.  A round touches a turn a constant number of times; the number of rounds
is the logarithm of the longest conversation.

Skew: content is grouped as in exact_dedup; a conversation of any length is numbered
in ranges of the sorted turns, and no later key gathers its turns; names asked for by many go to every task
(lookup.attach).  Only a node's member list, a single hash by definition, passes through one task as a
stream of pieces that other tasks made.

Defined results: turns of one number are ordered by the SHA-256 of role and text;
repeated turns stay turns; rows without a conv_id belong to no conversation and are left
out; c%5 has the sign of c; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.exact_dedup import content_groups, winners
from quillspan.llm.lookup import attach, content_digest, numbered
from quillspan.llm.shared import cut

#: A rebuilt conversation begins with that of its group of five, for less than nine turns.
GROUP, HEAD = 5, 9
#: Characters of a piece of a member list.
PIECE = 1 << 20


def named(pairs: DataFrame, label: str) -> DataFrame:
    """Written pairs (.., a, b) with `name` in place of a, b: dense numbers, one for each distinct pair."""
    distinct = numbered(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n")), "name", f"{label}-names")
    return cut(attach(pairs, distinct, ["a", "b"], "_n").drop("a", "b", "_n"), f"{label}-named")


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, name, bytes): the turns in order, named by content; and (conv_id, size): their number."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    d = conversations.filter("conv_id is not null").select("conv_id", "turn", F.concat(F.length(role).cast("string"), F.lit(":"), role, text).alias("_text"), F.octet_length(text).cast("long").alias("bytes"))
    d = d.withColumn("_digest", content_digest(F.col("_text")))
    groups, exact = winners(d, "bytes", "contents")
    keys = ["_digest"]
    if not exact:  # two contents of one digest
        groups, keys = content_groups(d, "bytes"), ["_digest", "_text"]
    names = numbered(groups.drop("bytes"), "name", "turn-names")
    d = cut(attach(d, names, keys, "group_size").select("conv_id", "turn", "_digest", "name", "bytes"), "turns")
    # ranges of all turns in order, equal ones at random: their tasks' rows are numbered on
    d = d.withColumn("_any", F.rand(17)).repartitionByRange("conv_id", "turn", "_digest", "_any").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "_digest")
    d = numbered(d.select("conv_id", "name", "bytes"), "idx", "placed")
    starts = cut(d.groupBy("conv_id").agg(F.min("idx").alias("start"), F.count(F.lit(1)).alias("size")), "starts")
    placed = attach(d, starts, ["conv_id"], "size").withColumn("pos", F.col("idx") - F.col("start"))
    return cut(placed.select("conv_id", "pos", "name", "bytes"), "turns-placed"), starts.select("conv_id", "size")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEAD


def rebuilt(placed: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of all conversations, and their turns (conv_id, pos, name, bytes), each beginning with up to h turns of its group's first one."""
    convs = sizes.select("conv_id", F.col("size").alias("own")).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", head_length(F.col("conv_id")))
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("_theirs"))
    # at most nine conversations ask for one base
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("_theirs", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", "own", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")), "convs")
    heads = placed.filter(F.col("pos") < HEAD - 1).select(F.col("conv_id").alias("base"), "pos", "name", "bytes")
    front = convs.filter("taken > 0").join(heads, "base").filter("pos < taken").select("conv_id", "pos", "name", "bytes")
    own = attach(placed, convs.drop("base", "length").withColumnRenamed("own", "_own"), ["conv_id"], "_own").filter("pos >= h")
    return convs.select("conv_id", "length"), cut(front.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "name", "bytes")), "rebuilt")


def blocks(turns_: DataFrame) -> list[DataFrame]:
    """For k = 0, 1 ..: conv_id, at, name of the blocks of turns at * 2^k to (at + 1) * 2^k - 1."""
    found = [turns_.select("conv_id", F.col("pos").alias("at"), "name")]
    while True:
        half = [F.max(F.when(F.col("at") % 2 == i, F.col("name"))).alias(c) for i, c in enumerate("ab")]
        pairs = found[-1].groupBy("conv_id", F.shiftright("at", 1).alias("_at")).agg(*half).filter("a is not null and b is not null").withColumnRenamed("_at", "at")
        pairs = cut(pairs, "blocks")
        if pairs.isEmpty():
            return found
        found.append(named(pairs, f"blocks-{len(found)}"))


def prefixes(blocks_: list[DataFrame]) -> DataFrame:
    """conv_id, depth, name: every prefix of at least one turn, named."""
    found: list[DataFrame] = []
    for k in reversed(range(len(blocks_))):
        ends = blocks_[k].filter("at % 2 = 0").select("conv_id", (F.col("at") * (1 << k)).alias("before"), F.col("name").alias("b"))
        whole = ends.filter("before = 0").select("conv_id", F.lit(1 << k).cast("long").alias("depth"), F.col("b").alias("name"))
        if found:
            known = reduce(DataFrame.union, found).select("conv_id", F.col("depth").alias("before"), F.col("name").alias("a"))
            pairs = ends.filter("before > 0").join(known, ["conv_id", "before"]).select("conv_id", (F.col("before") + (1 << k)).alias("depth"), "a", "b")
            found.append(named(cut(pairs, "composed"), f"prefixes-{k}").select("conv_id", "depth", "name"))
        found.append(whole)
    return reduce(DataFrame.union, found)


def list_hashes(members: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: SHA-256 of the ascending, comma-joined conv_ids of each group of members (node, depth, conv_id)."""
    in_order = members.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").select("node", "depth", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, ids, size = None, None, [], 0
        out: list[list] = [[], [], [], []]

        def packed() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            made = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["node", "depth", "first", "piece"])
            for v in out:
                v.clear()
            return made

        def close() -> None:
            for v, x in zip(out, (*key, first, ",".join(ids)), strict=True):
                v.append(x)

        for batch in batches:
            for node, depth, conv in zip(*(batch[c].to_pylist() for c in ("node", "depth", "conv_id")), strict=True):
                if (node, depth) != key or size > PIECE:
                    if key is not None:
                        close()
                    key, first, ids, size = (node, depth), conv, [], 0
                word = str(conv)
                ids.append(word)
                size += len(word) + 1
            if out[0]:
                yield packed()
        if key is not None:
            close()
            yield packed()

    made = in_order.mapInArrow(joined, "node long, depth long, first long, piece string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for node, depth, piece in zip(*(batch[c].to_pylist() for c in ("node", "depth", "piece")), strict=True):
                if (node, depth) == key:
                    state.update(b"," + piece.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (node, depth), hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("node", "depth", "ends_sha256"), r, strict=True)) for r in done], _HASHES)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"node": key[0], "depth": key[1], "ends_sha256": state.hexdigest()}], _HASHES)

    return made.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(hashed, "node long, depth long, ends_sha256 string")


_HASHES = pa.schema([("node", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def subtree_sums(nodes: DataFrame, owners: DataFrame, columns: list[str], most_depth: int) -> DataFrame:
    """node, depth and the columns summed over subtrees, for nodes (node, depth, columns) and owners (conv_id, depth, node): the node of each prefix."""
    found, reach = nodes.select("node", "depth", *columns), 1
    up = owners.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_above"), F.col("node").alias("_owner"))
    while reach <= most_depth:
        given = found.filter(F.col("depth") >= reach)
        given = given.join(up, (F.col("node") == F.col("_conv")) & (F.col("depth") - reach == F.col("_above"))).select(F.col("_owner").alias("node"), F.col("_above").alias("depth"), *columns)
        found = cut(found.union(given).groupBy("node", "depth").agg(*[F.sum(c).alias(c) for c in columns]), "subtrees")
        reach *= 2
    return found


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id (its least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    conv_kind = conversations.schema["conv_id"].dataType
    convs, turns_ = rebuilt(*turns(conversations.withColumn("conv_id", F.col("conv_id").cast("long"))))
    named_ = prefixes(blocks(turns_)).union(convs.select("conv_id", F.lit(0).cast("long"), F.lit(0).cast("long")))
    named_ = cut(named_, "prefixes")
    groups = cut(named_.groupBy("depth", "name").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n_convs")), "groups")
    owners = cut(attach(named_, groups, ["depth", "name"], "n_convs").select("conv_id", "depth", "node"), "owners")
    most_depth = groups.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]

    last = turns_.select(F.col("conv_id").alias("node"), (F.col("pos") + 1).alias("depth"), "bytes")
    parents = owners.select(F.col("conv_id").alias("node"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent_conv_id"))
    nodes = groups.drop("name").join(last, ["node", "depth"], "left").join(parents, ["node", "depth"], "left")
    nodes = cut(nodes.withColumn("bytes", F.coalesce("bytes", F.lit(0))), "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("parent_conv_id").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes-children")
    own = nodes.select("node", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    sums = subtree_sums(own, owners, ["n_leaves", "saved_tokens"], most_depth)
    ends = owners.join(convs.withColumnRenamed("length", "depth"), ["conv_id", "depth"])
    found = nodes.join(sums, ["node", "depth"]).join(list_hashes(ends), ["node", "depth"], "left")
    return found.select(
        F.col("node").cast(conv_kind).alias("conv_id"),
        "depth",
        F.col("parent_conv_id").cast(conv_kind).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(_EMPTY_HASH)).alias("ends_sha256"),
    )
