"""What the operators share: the shared scratch folder, word hashes, grouped Arrow streams, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder (tests, a single machine).
LOCAL_SCRATCH = "file:///tmp/checkpoints"
#: Stored bytes that a task of a shuffle gets at most, on average.
TASK_BYTES = 64 << 20
MOST_PARTITIONS = 200_000


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SCRATCH
    return f"{base.rstrip('/')}/sedge-{spark.sparkContext.applicationId}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the application ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    p, files = _hadoop(spark, path)
    files.deleteOnExit(p)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor costs no more than its tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        p, files = _hadoop(t.sparkSession, t.scratch_path)
        files.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, *sources: DataFrame) -> int:
    """Tasks of a shuffle: the session's setting, and more where the files that the sources read are larger than TASK_BYTES for each."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = 0
    for source in sources:
        leaves = source._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(least, min(MOST_PARTITIONS, -(-size // TASK_BYTES))) if size < 1 << 60 else least  # beyond that Spark doesn't know the size


# --- words -----------------------------------------------------------------

MASK64 = (1 << 64) - 1
_MULTIPLIER = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words, kept between batches; emptied when it holds `bound` words."""

    def __init__(self, bound: int = 100_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` words in a row; a shorter text is one shingle, no words are none."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = out * np.uint64(_MULTIPLIER) + hashes[i : n - width + 1 + i]
    return np.unique(mixed(out))


# --- grouped Arrow streams -------------------------------------------------


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of batches sorted by keys, one at a time."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, bool)
        change[0] = tuple(c[0] for c in columns) != last
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        last = tuple(c[-1] for c in columns)
        if not starts:
            held.append(batch)
            continue
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        for a, b in zip(starts, [*starts[1:], n]):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def arrow_rows(schema: pa.Schema, bound: int = 20_000) -> tuple[Callable[..., None], Callable[[bool], Iterator[pa.RecordBatch]]]:
    """add(*values) gathers a row, take(last) gives full batches."""
    columns: list[list] = [[] for _ in schema]

    def add(*values):
        for column, value in zip(columns, values):
            column.append(value)

    def take(last: bool = False) -> Iterator[pa.RecordBatch]:
        if columns[0] and (last or len(columns[0]) >= bound):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            for column in columns:
                column.clear()
        if last:
            pa.default_memory_pool().release_unused()  # Python workers live on and share their executor's memory

    return add, take


# --- connected components --------------------------------------------------


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots: root is the smallest node of its component.

    Alternates large-star and small-star steps, each a shuffle on node ids that
    ends in a written table, until nothing changes. A hub's rows are aggregated
    before the shuffle and joined by Spark's own join, which splits hot keys.
    """
    pairs = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-0",
    )

    def sums(frame: DataFrame):
        return frame.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def star(frame: DataFrame, label: str, upward: bool) -> DataFrame:
        both = frame.select(F.col("a").alias("n"), F.col("b").alias("m"))
        if upward:
            both = both.union(frame.select(F.col("b").alias("n"), F.col("a").alias("m")))
        low = written(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low")), f"{name}-{label}-low")
        linked = both.join(low.hint("merge"), "n")
        if upward:
            out = linked.where("m > n").select(F.col("m").alias("a"), F.col("low").alias("b"))
        else:
            out = linked.select(F.col("m").alias("a"), F.col("low").alias("b")).union(low.select(F.col("n").alias("a"), F.col("low").alias("b")))
        out = written(out.where("a <> b").distinct(), f"{name}-{label}")
        free(low, frame)
        return out

    before = sums(pairs)
    for step in range(1, 200):
        pairs = star(star(pairs, f"large{step}", True), f"small{step}", False)
        now = sums(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
