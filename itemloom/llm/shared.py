"""Small helpers that the operators share: scratch tables and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes a query's shuffle files as soon as the query has ended.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The most bytes that Spark hands a Python worker at once (of 10,000 rows, whole
#: texts or sets would be some tens of MB, in the JVM and in Python).
BATCHED, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def scratch_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session has no such setting, a temporary folder of this machine is
    set once in local mode and used from then on; a cluster gets an error, as its
    executors wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        known = context.getCheckpointDir()
        if not known:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="itemloom-"))
            known = context.getCheckpointDir()
        root = known
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/itemloom/{name}-{uuid.uuid4().hex}"


_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back.

    Cuts the lineage, so that work above it isn't repeated and survives lost
    executors.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    # What is read again is the table, so the shuffle files behind it may go.
    held = {name: spark.conf.get(name, None) for name in (CLEANED, BATCHED)}
    spark.conf.set(CLEANED, "true")
    spark.conf.set(BATCHED, BATCH)
    try:
        df.write.parquet(path)
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete scratch tables that nothing will read any more."""
    for table in tables:
        if table is not None and (path := _places.pop(table, None)):
            jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], weigh: str, most: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces whose column ``weigh`` holds about ``most`` bytes at most."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(most, batch.column(weigh).nbytes)))
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def told_apart(documents: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, bool]:
    """(row: all columns, key long, body: the text or "", twin) of the documents,
    and whether no key is repeated.

    ``twin`` is 0, or 31 bits of the text's hash above 32 zero bits where the key
    is null or repeated, so (key, twin) names a text.
    """
    rows = documents.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    apart = F.shiftleft(F.shiftrightunsigned(F.xxhash64("body"), 33), 32)
    repeated = settle(rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(True).alias("repeated")), "repeated")
    if repeated.isEmpty():
        return rows.withColumn("twin", F.when(F.col("key").isNull(), apart).otherwise(F.lit(0).cast("long"))), True
    twin = F.when(F.col("repeated") | F.col("key").isNull(), apart).otherwise(F.lit(0).cast("long"))
    return rows.join(repeated, "key", "left").withColumn("twin", twin).drop("repeated"), False


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, body, label double) of at most ``most`` labelled keys that are ``usable``.

    Keys are taken in the order of a hash, so the same rows come at each run;
    of several labels of a key the largest counts.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
        .groupBy(key)
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    # At most ``most`` rows of two numbers.
    return documents.select(key, F.coalesce(F.col(text), F.lit("")).alias("body")).join(F.broadcast(picked), key)


def keep_shared(rows: DataFrame, *more: str) -> DataFrame:
    """Of (sign, key, ``more``: whole numbers), the rows whose sign another key has.

    Rows are sorted over ranges, so a sign with any number of
    rows is spread over tasks like the others. A range can't see its
    neighbours: the rows of its first and last sign stay too, and whoever
    groups the result by sign finds them alone.
    """
    names = ("sign", "key", *more)
    ordered = rows.select(*(F.col(c).cast("long").alias(c) for c in names)).repartitionByRange(shuffle_width(rows.sparkSession), *names).sortWithinPartitions(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64) for _ in names]
        begun, joined = False, False
        for batch in batches:
            columns = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
            sign = columns[0]
            again = np.zeros(len(sign), bool)
            again[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
            columns = [c[~again] for c in columns]
            sign = columns[0]
            if not len(sign):
                continue
            same = sign[1:] == sign[:-1]
            keep = np.zeros(len(sign), bool)
            keep[1:] |= same
            keep[:-1] |= same
            keep[0] |= joined or not begun
            joined, begun = (bool(same[-1]) if len(same) else joined), True
            held = [c[-1:] for c in columns]
            yield pa.RecordBatch.from_pydict({c: x[:-1][keep[:-1]] for c, x in zip(names, columns, strict=True)})
        yield pa.RecordBatch.from_pydict(dict(zip(names, held, strict=True)))

    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))
