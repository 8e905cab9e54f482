"""What the corpus operators share: session settings, staging in the shared folder, dense numbering."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import release, shared_dir, stage  # noqa: F401

#: Words of the word-based operators: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Bound what one Arrow batch may hold, so that very long texts can't fill a Python worker.

    The plans read these settings when they run, after the caller has them, so they stay set; smaller bounds of the session are kept.
    """
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 4 << 20)):
        have = spark.conf.get(f"spark.sql.execution.arrow.{name}")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    return spark


def ranges(docs: DataFrame, target: int) -> int:
    """How many ranges give each about ``target`` bytes of text, by a count over all of them; at least ``spark.sql.shuffle.partitions``."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // target))


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def per_text(
    df: DataFrame, keep: list[str], text: str, fields: pa.Schema, score: Callable[[list[bytes]], list[list]]
) -> DataFrame:
    """Columns ``keep`` and what ``score`` makes of the UTF-8 bytes of every text (null: empty), batch by batch.

    ``score`` returns one list for each field of ``fields``.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(score.__module__)
        for batch in batches:
            texts = [x or b"" for x in batch.column(len(keep)).cast(pa.binary()).to_pylist()]
            made = score(texts)
            columns = [pa.array(x, type=f.type) for x, f in zip(made, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + columns, names=[*keep, *fields.names]
            )

    from pyspark.sql.pandas.types import from_arrow_schema

    schema = source.drop("__text").schema
    for f in from_arrow_schema(fields):
        schema = schema.add(f.name, f.dataType)
    return source.mapInArrow(run, schema)


def spread(*keys: Column, buckets: int) -> Column:
    """A bucket number from 0 that depends on the keys alone, never on how the rows are laid out."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("long")


def numbered(df: DataFrame, order: list[str], name: str, label: str) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... over the whole table in the given order, without a single-task sort.

    The rows are range-partitioned and sorted, given positions, and staged; only one
    (partition, count) row a partition is summed up in order. Use it on narrow columns.
    """
    parts = df.repartitionByRange(*[F.col(c).asc_nulls_last() for c in order])
    at = stage(
        parts.sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in order]).withColumn(
            "__at", F.monotonically_increasing_id()
        ),
        label,
    ).withColumn("__part", F.shiftright("__at", 33))
    from pyspark.sql import Window

    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        at.groupBy("__part")
        .agg(F.count("*").alias("__n"))
        .select(F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return at.join(F.broadcast(offsets), "__part").withColumn(name, place).drop("__part", "__at", "__before")


_remembering: list[weakref.ref] = []
_owner: list[str] = []


def remembers(thing: object) -> None:
    """Says that ``thing`` remembers much in this process, which its ``clear`` gives back."""
    _remembering[:] = [r for r in _remembering if r() is not None]
    _remembering.append(weakref.ref(thing))


def only(owner: str) -> None:
    """Has what other operators remember given back: a Python worker serves one stage after the other."""
    if _owner != [owner]:
        _owner[:] = [owner]
        for r in _remembering:
            if (thing := r()) is not None:
                thing.clear()


class Memo(dict):
    """What ``make`` gives for a chunk of text, remembered for chunks of at most 64 bytes; emptied when full."""

    def __init__(self, make: Callable[[bytes], object], most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most
        remembers(self)

    def __missing__(self, chunk: bytes) -> object:
        value = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = value
        return value
