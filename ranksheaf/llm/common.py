"""What the operators share: durable cuts of lineage, text normalisation, joins with hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a Java and RE2 class body.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: A side of at most this many narrow rows (ids, sums) may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The same for sides that hold strings or bitmaps, in bytes.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one is set only on one machine, and only where none is."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder in the shared store once nothing reads it any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder: a lost executor costs its running tasks only."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def durable_table(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Like durable(), as compressed Parquet, for wide rows and for loops; in a folder that its caller deletes, if given."""
    path = f"{folder or shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only become a-z. A pure ASCII string takes the built-in's fast path; others are mapped letter by letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    """Number of maximal runs that hold no ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def one_each(rows: DataFrame, more: list[str]) -> DataFrame:
    """One row per doc_id, that with the least hash of its text; rows of a frequent id are combined before the shuffle."""
    return rows.groupBy("doc_id", *more).agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """With a broadcast hint if its counted rows allow it; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def broadcast_if_small(df: DataFrame, strings: list[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if its rows, measured with the bytes of their strings, allow it; otherwise as it is, for a shuffled join."""
    size = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in strings), F.lit(64).cast("long")))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def join_with_hot_keys(left: DataFrame, right: DataFrame, key: list[str], weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join on null-free keys, unique in right, without a task that gets a hot key's rows whole.

    weight tells how many left rows a right row meets, total how many left rows there are. At most
    ``parts`` keys can hold a ``1 / parts`` share or more: those right rows are broadcast, a proven bound,
    and the left rows of these keys are never shuffled. The rest meets in a shuffled join.
    """
    share = max(total / parts, 1)
    hot = right.where(F.col(weight) > share).drop(weight)
    cold = right.where(F.col(weight) <= share).drop(weight)
    rest = left.join(F.broadcast(hot.select(*key)), key, "left_anti")
    columns = [*left.columns, *[c for c in right.columns if c not in key and c != weight]]
    return left.join(F.broadcast(hot), key).select(columns).unionByName(rest.join(cold, key).select(columns))
