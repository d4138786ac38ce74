"""Folds and joins over ordered utterances; the order is always a column.

A fold keeps one small struct per lecture while it walks that lecture's sorted
array inside the JVM; lectures are independent, so work spreads over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST, WANTED, MOST, GAP = 300, 700, 1200, 1.5


def nearest_in_interval(atoms: DataFrame, marks: DataFrame, slack: float = 2.0, bucket: float = 30.0) -> DataFrame:
    """atoms (lecture_id, seq, start, end) with the mark (lecture_id, mark_id, at) nearest to their middle within slack of them, or null.

    Marks and intervals meet in buckets of time, an equi-join; the exact interval is
    tested after.  Ties go to the earlier mark id.
    """
    lo, hi = F.col("start") - slack, F.col("end") + slack
    spread = atoms.withColumn("_b", F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))))
    placed = marks.withColumn("_b", F.floor(F.col("at") / bucket))
    near = spread.join(placed, ["lecture_id", "_b"]).filter((F.col("at") >= lo) & (F.col("at") <= hi))
    middle = (F.col("start") + F.col("end")) / 2
    best = near.groupBy("lecture_id", "seq").agg(F.min(F.struct(F.round(F.abs(F.col("at") - middle), 6).alias("d"), "mark_id", "at")).alias("_m"))
    return atoms.join(best, ["lecture_id", "seq"], "left").select("lecture_id", "seq", F.col("_m.mark_id").alias("mark_id"), F.col("_m.at").alias("at"))


def forward_fill(rows: DataFrame, group: str, order: str, columns: list[str]) -> DataFrame:
    """The last value that isn't blank so far, for each column on its own."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(F.when(F.trim(F.col(c)) != "", F.col(c)), ignorenulls=True).over(w) for c in columns})


def _folded(rows: DataFrame, fields: list[str], zero: Column, step) -> DataFrame:
    """lecture_id, s: the state after a fold over a lecture's rows sorted by their first field."""
    a = rows.groupBy("lecture_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("a"))
    return a.select("lecture_id", F.aggregate("a", zero, step).alias("s"))


def merge_atoms(atoms: DataFrame, least: int = LEAST, wanted: int = WANTED, most: int = MOST, gap: float = GAP) -> DataFrame:
    """lecture_id, seq, chunk: the number of the chunk that each utterance joins.

    Greedy from the left: past `most` characters a chunk that has `least` ends, a
    shorter one takes the utterance; from `least` on it ends at a pause over `gap`, or,
    with `wanted` reached, after a sentence end.
    """
    zero = F.expr("struct(cast(array() as array<int>) as out, cast(0 as int) as chunk, cast(0 as int) as now, cast(null as double) as last, false as stop)")

    def step(s: Column, x: Column) -> Column:
        n = F.length(x["text"])
        over = s["now"] + n > most
        pause = x["start"] - s["last"] > gap
        new = s["last"].isNotNull() & (s["now"] >= least) & (over | pause | ((s["now"] >= wanted) & s["stop"]))
        chunk = (s["chunk"] + F.when(new, 1).otherwise(0)).cast("int")
        return F.struct(F.concat(s["out"], F.array(chunk)).alias("out"), chunk.alias("chunk"), F.when(new, n).otherwise(s["now"] + n).cast("int").alias("now"), x["end"].alias("last"), F.coalesce(F.trim(x["text"]).rlike("[.!?]$"), F.lit(False)).alias("stop"))

    f = _folded(atoms, ["seq", "text", "start", "end"], zero, step)
    seqs = atoms.groupBy("lecture_id").agg(F.sort_array(F.collect_list("seq")).alias("q"))
    z = f.join(seqs, "lecture_id").select("lecture_id", F.explode(F.arrays_zip("q", "s.out")).alias("z"))
    return z.select("lecture_id", F.col("z.q").alias("seq"), F.col("z.out").alias("chunk"))


def similarity_threshold(sims: Column) -> tuple[Column, Column]:
    """The threshold of a lecture's adjacent similarities: mean less population deviation, within 0.3 and 0.85; 0.5 without any."""
    return F.coalesce(F.least(F.greatest(F.avg(sims) - F.stddev_pop(sims), F.lit(0.3)), F.lit(0.85)), F.lit(0.5)), F.count(sims)


def segment_boundaries(items: DataFrame, least: int = 3, most: int = 30) -> DataFrame:
    """items (lecture_id, seq, sim: similarity with the one before, null for the first, threshold) -> lecture_id, seq, segment.

    A segment's length starts at 1 and grows before the test: a low similarity ends it
    from `least` on, `most` ends it anyway.  Lectures of at most `least` items are one
    segment; a last segment that is too short joins the one before, again and again.
    """
    a = items.groupBy("lecture_id").agg(F.sort_array(F.collect_list(F.struct("seq", "sim", "threshold"))).alias("a"))
    zero = F.expr("struct(array(1) as starts, cast(1 as int) as n, cast(0 as int) as i)")

    def step(s: Column, x: Column) -> Column:
        n, i = s["n"] + 1, s["i"] + 1
        new = (i > 1) & (((x["sim"] < x["threshold"]) & (n >= least)) | (n >= most))
        return F.when(i == 1, F.struct(s["starts"].alias("starts"), F.lit(1).alias("n"), i.cast("int").alias("i"))).otherwise(
            F.struct(F.when(new, F.concat(s["starts"], F.array(i.cast("int")))).otherwise(s["starts"]).alias("starts"), F.when(new, 1).otherwise(n).cast("int").alias("n"), i.cast("int").alias("i"))
        )

    a = a.withColumn("_n", F.size("a")).withColumn("_s", F.when(F.col("_n") <= least, F.array(F.lit(1))).otherwise(F.aggregate("a", zero, step)["starts"]))
    # drop trailing starts while the last segment is too short
    keep = F.aggregate(F.reverse("_s"), F.struct(F.expr("cast(array() as array<int>)").alias("k"), F.col("_n").alias("end")), lambda s, x: F.when((F.size(s["k"]) == 0) & (s["end"] - x + 1 < least) & (x > 1), s).otherwise(F.struct(F.concat(F.array(x), s["k"]).alias("k"), s["end"].alias("end"))))["k"]
    b = a.withColumn("_k", keep).select("lecture_id", "_k", F.posexplode("a").alias("p", "x"))
    return b.select("lecture_id", F.col("x.seq").alias("seq"), F.size(F.filter("_k", lambda k: k <= F.col("p") + 1)).alias("segment"))


def extraction_windows(items: DataFrame, budget: int, overlap: int) -> DataFrame:
    """items (lecture_id, seq, tokens) -> lecture_id, window, first, last, tokens (places from 1).

    A window takes items while they fit (the first always); the next one starts
    `overlap` items before its end, at least one later; the last reaches the end.
    """
    a = items.groupBy("lecture_id").agg(F.sort_array(F.collect_list(F.struct("seq", "tokens"))).alias("a"))
    a = a.select("lecture_id", F.transform("a", lambda x: x["tokens"].cast("long")).alias("t"))
    # prefix sums, so that a window's end is a count
    sums = F.aggregate("t", F.expr("cast(array(0) as array<bigint>)"), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    a = a.withColumn("p", sums).withColumn("n", F.size("t"))
    zero = F.expr("struct(cast(array() as array<struct<first:int,last:int>>) as out, cast(1 as int) as at)")

    def step(s: Column, i: Column) -> Column:
        fit = F.size(F.filter(F.col("p"), lambda x: x <= F.element_at(F.col("p"), s["at"]) + budget)) - 1
        last = F.greatest(s["at"], F.least(fit, F.col("n"))).cast("int")
        after = F.when(last >= F.col("n"), F.col("n") + 1).otherwise(s["at"] + F.greatest(F.lit(1), last - s["at"] + 1 - overlap)).cast("int")
        return F.when(s["at"] != i, s).otherwise(F.struct(F.concat(s["out"], F.array(F.struct(s["at"].alias("first"), last.alias("last")))).alias("out"), after.alias("at")))

    w = a.select("lecture_id", "p", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.col("n")), zero, step)["out"]).alias("w", "x"))
    return w.select("lecture_id", (F.col("w") + 1).alias("window"), "x.first", "x.last", (F.element_at("p", F.col("x.last") + 1) - F.element_at("p", F.col("x.first"))).alias("tokens"))


def merge_adjacent(rows: DataFrame, seconds: float = 30.0) -> DataFrame:
    """rows (lecture_id, seq, segment, ts, score) -> lecture_id, seq, block.

    A block takes the next row of the same segment within `seconds` of the block's own
    (first) time, so a block never spans more than that.
    """
    zero = F.expr("struct(cast(array() as array<int>) as out, cast(0 as int) as b, cast(null as double) as ts, cast(null as string) as seg)")

    def step(s: Column, x: Column) -> Column:
        seg = x["segment"].cast("string")
        same = F.coalesce(s["seg"] == seg, F.lit(True)) & s["ts"].isNotNull() & (F.abs(x["ts"] - s["ts"]) <= seconds)
        b = F.when(same, s["b"]).otherwise(s["b"] + 1).cast("int")
        return F.struct(F.concat(s["out"], F.array(b)).alias("out"), b.alias("b"), F.when(same, s["ts"]).otherwise(x["ts"]).alias("ts"), F.when(same, s["seg"]).otherwise(seg).alias("seg"))

    f = _folded(rows, ["ts", "seq", "segment"], zero, step)
    q = rows.groupBy("lecture_id").agg(F.sort_array(F.collect_list(F.struct("ts", "seq"))).alias("q"))
    z = f.join(q, "lecture_id").select("lecture_id", F.explode(F.arrays_zip(F.col("q.seq").alias("seq"), F.col("s.out").alias("block"))).alias("z"))
    return z.select("lecture_id", "z.seq", "z.block")


def timeline_buckets(rows: DataFrame, n: int = 8) -> DataFrame:
    """At most n rows of a lecture over its time: all if there are few; else the first of each of n equal spans, or, with equal times, n rows a whole step apart."""
    w = Window.partitionBy("lecture_id")
    r = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_a": F.min("ts").over(w), "_z": F.max("ts").over(w), "_i": F.row_number().over(w.orderBy("ts", "seq")) - 1})
    span = F.least(F.floor((F.col("ts") - F.col("_a")) / ((F.col("_z") - F.col("_a")) / n)), F.lit(n - 1)).cast("long")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / n))
    stride = F.when((F.col("_i") % step == 0) & (F.col("_i") < n * step), F.floor(F.col("_i") / step)).cast("long")
    r = r.withColumn("bucket", F.when(F.col("_n") <= n, F.col("_i").cast("long")).when(F.col("_z") == F.col("_a"), stride).otherwise(span))
    first = F.row_number().over(Window.partitionBy("lecture_id", "bucket").orderBy("ts", "seq"))
    return r.filter("bucket is not null").withColumn("_f", first).filter("_f = 1").drop("_n", "_a", "_z", "_i", "_f")


def timeline_clusters(rows: DataFrame, top_k: int = 15, width: int = 8) -> DataFrame:
    """Runs of `width` neighbours at max(1, top_k // 2) even places of a lecture's time order; all rows of a short lecture."""
    k = max(1, top_k // 2)
    w = Window.partitionBy("lecture_id")
    r = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy("ts", "seq")) - 1})
    starts = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.least(F.floor(i * F.col("_n") / k), F.col("_n") - width))
    inside = F.exists(starts, lambda s: (F.col("_i") >= s) & (F.col("_i") < s + width))
    return r.filter((F.col("_n") <= width * k) | inside).drop("_n", "_i")


def keyword_titles(fields: DataFrame, stopwords: list[str], most: int = 6) -> DataFrame:
    """fields (lecture_id, pos, weight, text) -> lecture_id, title: heaviest words, earliest first on ties, spelt as first seen."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z'\\-]*"), F.lit(0))
    f = fields.select("lecture_id", "pos", "weight", F.posexplode(words).alias("_i", "word"))
    f = f.filter((F.length("word") >= 3) & ~F.lower("word").isin(stopwords))
    place = F.struct("pos", "_i", "word")
    g = f.groupBy("lecture_id", F.lower("word").alias("_w")).agg(F.sum("weight").alias("_s"), F.min(place).alias("_p"))
    w = Window.partitionBy("lecture_id").orderBy(F.desc("_s"), "_p.pos", "_p._i")
    g = g.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return g.groupBy("lecture_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_p.word"))), lambda x: x["word"]), " ").alias("title"))
