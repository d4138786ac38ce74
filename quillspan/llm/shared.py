"""What the training-data operators share: scratch tables, word lists, samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
BLANKS = "[\\x20\\x09-\\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
_WORD = re.compile("[^\x20\x09-\x0d]+")
#: str.split() splits at these too; here they are parts of words.
_OTHER_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A local session without that setting (a test) gets a folder of its own; on a
    cluster it has to be set, as other machines don't see a folder of this one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/quillspan/{spark.sparkContext.applicationId}"


_WRITTEN: list[str] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start from files, so no lost executor recomputes what came before."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A place in the list of scratch tables, for drop_scratch."""
    return len(_WRITTEN)


def drop_scratch(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Remove the scratch tables written since a mark, but the last `but`; what was read from them can't be read again."""
    gone = _WRITTEN[since : len(_WRITTEN) - but]
    for at in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _WRITTEN[since : since + len(gone)] = []


def grouped(keys: list[str], work: Callable[[list[pa.RecordBatch]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function: work() on each run of rows with equal keys (numbers), for rows sorted by them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.stack([batch[c].to_numpy() for c in keys])
            starts = np.flatnonzero(np.concatenate([[True], (ids[:, 1:] != ids[:, :-1]).any(axis=0)]))
            for start, end in zip(starts, np.append(starts[1:], batch.num_rows), strict=True):
                name = tuple(ids[:, start])
                if name != last and waiting:
                    if (out := work(waiting)) is not None:
                        yield out
                    waiting = []
                last = name
                waiting.append(batch.slice(start, end - start))
        if waiting and (out := work(waiting)) is not None:
            yield out

    return run


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null equals null; the left's keys stay.  No two other columns may share a name."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def words_of(text: str) -> list[str]:
    """The runs of `[^\\x20\\x09-\\x0D]+` in a text."""
    return text.split() if not _OTHER_BLANKS.search(text) else _WORD.findall(text)


def word_array(text: Column) -> Column:
    """The same words as an array column; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Their number, without building them twice: pieces less the empty ones at the ends."""
    t = F.coalesce(text, F.lit(""))
    pieces = F.split(t, BLANKS)
    ends = lambda pattern: F.when(t.rlike(pattern), 1).otherwise(0)
    return F.when(~t.rlike("[^\\x20\\x09-\\x0D]"), F.lit(0)).otherwise(F.size(pieces) - ends("^[\\x20\\x09-\\x0D]") - ends("[\\x20\\x09-\\x0D]$(?!\\n)")).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def id_remainder(column: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; -1 for a null id."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % divisor, F.lit(-1))


class WordTable:
    """Rows of numbers for words, each made once: a bounded memo for one Python worker.

    make(words) gives the rows of new words as an array; past `limit` words the
    memo starts anew, so memory is bounded however many distinct words there are.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.make, self.limit = make, limit
        self.place: dict[str, int] = {}
        self.rows: np.ndarray | None = None

    def indices(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.place))
        if new:
            if len(self.place) > self.limit:
                self.place, self.rows, new = {}, None, list(set(words))
            made, start = self.make(new), len(self.place)
            if self.rows is None:
                self.rows = np.empty((max(1024, 2 * len(new)), *made.shape[1:]), made.dtype)
            if start + len(new) > len(self.rows):
                grown = np.empty((max(2 * len(self.rows), start + len(new)), *made.shape[1:]), made.dtype)
                grown[:start] = self.rows[:start]
                self.rows = grown
            self.rows[start : start + len(new)] = made
            self.place.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def look(self, words: list[str]) -> np.ndarray:
        at = self.indices(words)
        return self.rows[at] if self.rows is not None else self.make([])


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a Python worker keeps between tasks of one job: one thing at a time, made anew for another name."""
    if name not in _KEPT:
        _KEPT.clear()
        released()
        _KEPT[name] = make()
    return _KEPT[name]


def released() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers outlive their jobs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def chunks_of(texts: Iterable[str | None], most_words: int = 500_000, split: Callable[[str], list[str]] = words_of):
    """Yield (number of texts, words of all, words per text) for runs of whole texts of about most_words words."""
    words: list[str] = []
    counts: list[int] = []
    for text in texts:
        own = split(text) if text else []
        words += own
        counts.append(len(own))
        if len(words) >= most_words:
            yield len(counts), words, np.array(counts, np.int64)
            words, counts = [], []
    if counts:
        yield len(counts), words, np.array(counts, np.int64)


def sampled_per_class(df: DataFrame, label: str, key: str, per_class: int, most_rows: int | None = None) -> DataFrame:
    """At most per_class keys of each value of label, those of the least hashes: label, key, _share.

    Rows of one label and key count as one, whatever their number, so the sample is
    bounded by keys and not by rows, and null is a key too.  With many values each has fewer, at
    least one, so that about most_rows come out and no value is left out.  Only keys that can be among the
    least are ranked; one line for each value goes to the driver.
    """
    share = (F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)).alias("_share")
    keys = df.select(label, key).distinct().select(label, key, share)
    counts = [tuple(r) for r in keys.groupBy(label).agg(F.count(F.lit(1)), F.min("_share")).collect()]
    if not counts:
        return keys.limit(0)
    most = min(per_class, max(1, most_rows // len(counts))) if most_rows else per_class
    # some four times as many as wanted, the least one always
    limits = df.sparkSession.createDataFrame([(v, max(4.0 * most / c, least)) for v, c, least in counts], f"_label {df.schema[label].dataType.simpleString()}, _limit double")
    able = keys.join(F.broadcast(limits), F.col(label).eqNullSafe(F.col("_label"))).filter(F.col("_share") <= F.col("_limit")).drop("_label", "_limit")
    nth = F.row_number().over(Window.partitionBy(label).orderBy("_share", key))
    return able.withColumn("_nth", nth).filter(F.col("_nth") <= most).drop("_nth")
