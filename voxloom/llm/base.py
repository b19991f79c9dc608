"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset a local master (tests) gets a temporary folder as checkpoint folder, any other
    master an error: executors would write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="voxloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write the frame as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch between the JVM and Python. A batch stands in both, and buffers double as
#: they grow, so Spark's default of 64 MB takes several hundred MB of an executor with two cores.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Set the batch size of this session where it has Spark's default."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, f"{BATCH_BYTES}b")


#: What workers keep between tasks, by name; workers are reused, so another operator's must go.
CACHES: dict[str, Callable[[], None]] = {}


def release(keep: str | None = None) -> None:
    """Drop what a reused worker holds of other operators."""
    for name, clear in CACHES.items():
        if name != keep:
            clear()


def map_rows(df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, keep: str | None = None) -> DataFrame:
    """Apply a generator over the rows of each partition, moved as Arrow batches.

    ``rows`` gets the iterator of value tuples of a partition and yields output tuples; memory
    holds one input batch and one output chunk at a time, and the cache named ``keep``.
    """
    names = [f.name for f in _struct(schema)]
    target = _arrow(schema)
    step = 2048

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(keep)

        def feed() -> Iterator[tuple]:
            for b in batches:
                # short slices, so that Python objects of one slice only are alive
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    yield from zip(*(c.to_pylist() for c in part.columns), strict=True)

        out: list[tuple] = []
        for row in rows(feed()):
            out.append(row)
            if len(out) >= step:
                yield _batch(out, names, target)
                out = []
        if out:
            yield _batch(out, names, target)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], target: pa.Schema) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, target.types, strict=True)], names=names)


def _struct(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_struct(schema))


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator reads, renamed, whatever else the table holds."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def order_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` ascending keys that exist in ``df`` and cut it into ranges of similar
    row counts; the first is the smallest key. One pass over the key column; what comes to the
    driver is as long as ``parts``."""
    probs = [i / parts for i in range(parts)]
    row = df.agg(F.min(key).alias("lo"), F.percentile_approx(key, probs, 20 * max(parts, 50)).alias("q")).first()
    if row is None or row["lo"] is None:
        return []
    return sorted({row["lo"], *(x for x in row["q"] or [] if x is not None)})


def range_of(key, cuts: list[int]):
    """Column: the number of the range of ascending ``cuts`` that ``key`` is in, 0 for null and
    for keys below the second cut. A binary search in built-in functions; the cuts are one literal."""
    if len(cuts) < 2:
        return F.lit(0)
    bounds = F.lit(np.array(cuts[1:], np.int64))
    n = len(cuts) - 1
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length()))])
    go = lambda at, step: F.when((at + step <= n) & (F.try_element_at(bounds, at + step) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), go)


@dataclass(frozen=True)
class Ranges:
    """Ranges of rows in ascending order of (key, hash). Keys below or between ``cuts`` share a range; an
    id with more rows than a range should hold, as null may be, has ranges of its own, by ``hash`` of
    the text. ``hash`` is 0 for all other ids."""

    cuts: list[int]
    shares: list[int]  # how many ranges each cut's rows are dealt over, by hash
    hot: list[int]

    @property
    def n(self) -> int:
        return max(1, sum(self.shares))

    def hash(self, key, text):
        """Column: 0 to 2**31 - 1 for rows of ids with ranges of their own, else 0."""
        if not self.hot:
            return F.lit(0).cast("long")
        return F.when(F.array_contains(F.lit(np.array(self.hot, np.int64)), key), F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 31))).otherwise(0)

    def number(self, key, hash_):
        """Column: the range of a row."""
        own = range_of(key, self.cuts)
        if not self.hot:
            return own
        first = F.lit(np.cumsum([0, *self.shares[:-1]]).astype(np.int64))
        share = F.lit(np.array(self.shares, np.int64))
        return (F.try_element_at(first, own + 1) + F.shiftright(hash_ * F.try_element_at(share, own + 1), 31)).cast("int")


def split_ranges(df: DataFrame, key: str, parts: int) -> Ranges:
    """Ranges of similar row counts over a key column without nulls: cuts at existing keys, and one more
    count over them, which finds the ids that fill more than a range. Two passes over the keys; what
    comes to the driver is as long as ``parts``."""
    cuts = order_cuts(df, key, parts)
    if not cuts:
        return Ranges([], [], [])
    found = df.groupBy(range_of(F.col(key), cuts).alias("r")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
    target = max(1, sum(r["n"] for r in found) // parts)
    # a key with many rows is a cut itself, but smaller keys of its range's end may share it with others
    heavy = {r["lo"]: r["n"] for r in found if r["n"] > 2 * target and r["lo"] == r["hi"]}
    mixed = [r for r in found if r["n"] > 2 * target and r["lo"] != r["hi"]]
    if mixed:
        inside = range_of(F.col(key), cuts).isin([r["r"] for r in mixed])
        heavy |= {r[key]: r["n"] for r in df.filter(inside).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") > target).limit(4 * parts).collect()}
    # a heavy id's range holds nothing else: the next id begins a new one
    cuts = sorted({*cuts, *heavy, *(k + 1 for k in heavy if k < (1 << 63) - 1)})
    shares = [-(-heavy[c] // target) if c in heavy else 1 for c in cuts]
    return Ranges(cuts, shares, sorted(heavy))
