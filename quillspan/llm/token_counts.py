"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change inserts, deletes or revises one document's counts.  Changes become signed
deltas, summed by (source, lang, tokenizer) before anything is shuffled; a batch of
deltas is committed once under its id, and totals are the sums over committed
batches.  Sums are additive, so batches may be committed in any order.

A batch is one folder of Parquet; Spark's job commit writes its _SUCCESS last, so
a batch is wholly there or not there.  Committing an id again changes nothing, and a
commit that broke off is written anew.  compact() folds batches into one and
keeps their ids, so a late replay of any of them still changes nothing.

Defined results: null text has 0 tokens; null source and language are groups of
their own; repeated rows count each time; a group whose documents are all deleted
stays with zeros until compact() drops it; empty changes are a valid batch.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.llm.shared import cut, same_keys, scratch_dir, words_of
from quillspan.llm.subwords import ids_of

#: Tokenizers by version: text -> number of tokens.  A change of rules gets a new version.
TOKENIZERS = {
    "byte_bpe_50k@1": lambda t: len(ids_of(t)),
    "words@1": lambda t: len(words_of(t)),
}
#: What documents are first counted by, before their counts are revised: words between blanks of any kind.
FIRST = "words@0"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def counted(docs: DataFrame, versions: list[str]) -> DataFrame:
    """docs with counts: map<tokenizer version, number of tokens>; each text is read once."""

    @pandas_udf("array<long>")
    def count(texts: pd.Series) -> pd.Series:
        own = [{FIRST: lambda t: len(t.split()), **TOKENIZERS}[v] for v in versions]
        return pd.Series([[f(t) if t else 0 for f in own] for t in texts], dtype=object)

    return docs.withColumn("counts", F.map_from_arrays(F.array(*map(F.lit, versions)), count("text")))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of changes (op, source, lang, counts, old_source, old_lang, old_counts).

    op: insert (new values), delete (old values) or revise (both); other rows, null
    ops too, fail the batch rather than be lost.
    """
    fail = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null"))))
    new = F.struct(F.lit(1).alias("sign"), "source", "lang", "counts")
    old = F.struct(F.lit(-1).alias("sign"), F.col("old_source").alias("source"), F.col("old_lang").alias("lang"), F.col("old_counts").alias("counts"))
    signed = F.when(F.col("op") == "insert", F.array(new)).when(F.col("op") == "delete", F.array(old)).when(F.col("op") == "revise", F.array(new, old)).otherwise(fail)
    rows = changes.select(F.explode(signed).alias("_d")).select("_d.*").select("sign", "source", "lang", F.explode("counts").alias("tokenizer", "n"))
    return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n")).cast("long").alias("n_tokens"))


class TokenRollup:
    """The committed batches under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, batch: str) -> str:
        if not batch or "/" in batch:
            raise ValueError(f"bad batch id: {batch!r}")
        return f"{self.root}/batch={batch}"

    def _folders(self) -> list[str]:
        """Folders of finished batches."""
        if not self._files.exists(self._path(self.root)):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(self._path(self.root)) if f.isDirectory()]
        return sorted(n for n in names if self._files.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def _among(self, batches: list[str]) -> set[str]:
        """Those of some batch ids that a compaction holds; the list of all ids stays where it is."""
        found = [f"{self.root}/{n}" for n in self._folders() if n.startswith("ids-")]
        if not found or not batches:
            return set()
        return {r[0] for r in self.spark.read.schema("id string").parquet(*found).filter(F.col("id").isin(batches)).distinct().collect()}

    def committed(self, batch: str) -> bool:
        return self._files.exists(self._path(self._at(batch) + "/_SUCCESS")) or bool(self._among([batch]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes; False if that id is in already."""
        if self.committed(batch):
            return False
        deltas(changes).write.mode("overwrite").parquet(self._at(batch))
        return True

    def _live(self) -> list[str]:
        """The newest compaction, and the batches that it doesn't hold."""
        names = self._folders()
        sums = [n for n in names if n.startswith("sums-") and f"ids-{n[5:]}" in names]
        batches = [n[6:] for n in names if n.startswith("batch=")]
        merged = self._among(batches)
        return [f"{self.root}/{n}" for n in sums[-1:]] + [self._at(b) for b in batches if b not in merged]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens over all that is committed."""
        live = self._live()
        rows = self.spark.read.schema(DELTA).parquet(*live) if live else self.spark.createDataFrame([], DELTA)
        return rows.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> None:
        """Fold everything into one set of sums; its list of ids, written last, makes it count.  Then the folded batches go."""
        names = self._folders()
        old = [n for n in names if n.startswith(("ids-", "sums-"))]
        number = f"{1 + max([0, *(int(n.rpartition('-')[2]) for n in old)]):012d}"
        batches = [n[6:] for n in names if n.startswith("batch=")]
        merged = self._among(batches)
        self.totals().filter("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.root}/sums-{number}")
        new = [(b,) for b in batches if b not in merged]
        self.spark.createDataFrame(new, "id string").write.mode("overwrite").parquet(f"{self.root}/ids-{number}")
        for b in batches:
            self._files.delete(self._path(self._at(b)), True)


def maintained(docs: DataFrame, versions: list[str] | None = None) -> DataFrame:
    """Totals of docs (doc_id, text, lang, source), kept by deltas: source, lang, tokenizer, n_docs, n_tokens, n_own_docs, n_own_tokens.

    n_docs and n_tokens cover every row.  n_own_docs and n_own_tokens leave out exact
    copies: rows whose text a row with a smaller id has too.

    Batch `load` inserts every document, with counts by the blank rules of `words@0`.
    Batch `words@1` revises each document's counts to the tokenizers of `versions`:
    what `words@0` counted is taken back, and its groups, all zero then, go.  A
    replay of `load` changes nothing.  Batch `copies` deletes the copies, from the
    counts recorded for them.  Documents without text or id have no copies.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "text", "lang", "source")
    versions = versions or sorted(TOKENIZERS)
    counts = counted(d, [FIRST, *versions]).withColumn("digest", F.sha2("text", 256)).drop("text")
    ledger = cut(counts, "ledger")
    rollup = TokenRollup(spark, f"{scratch_dir(spark)}/token-rollup-{uuid.uuid4().hex}")
    none = "cast(null as string) {0}source", "cast(null as string) {0}lang", "cast(null as map<string,bigint>) {0}counts"
    first_counts, later = f"map('{FIRST}', counts['{FIRST}'])", f"map_filter(counts, (k, v) -> k <> '{FIRST}')"
    load = ledger.selectExpr("'insert' op", "source", "lang", f"{first_counts} counts", *[n.format("old_") for n in none])
    rollup.commit("load", load)
    rollup.commit("words@1", ledger.selectExpr("'revise' op", "source", "lang", f"{later} counts", "source old_source", "lang old_lang", f"{first_counts} old_counts"))
    rollup.commit("load", load)
    every = cut(rollup.totals(), "totals")
    # texts that more than one row has, with their least id; sums are made before rows with one text meet
    copied = ledger.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    copies = ledger.join(copied, "digest").filter("doc_id > first_id")
    rollup.commit("copies", copies.selectExpr("'delete' op", *[n.format("") for n in none], "source old_source", "lang old_lang", f"{later} old_counts"))
    own = rollup.totals().withColumnsRenamed({"n_docs": "n_own_docs", "n_tokens": "n_own_tokens"})
    return same_keys(every, own, ["source", "lang", "tokenizer"]).filter(F.col("tokenizer") != FIRST)
