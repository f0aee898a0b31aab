"""What the operators of this subpackage share: the columns they read, the
shared folder for tables between steps, joins that spread hot keys, and bounded
caches for Python tasks."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes about, that a Python task turns into Python values at a time.
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 512, 8_000_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share. A local session that
    names none (in tests) gets one of its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends
    there, so a lost executor never causes what stands above to run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and whole text; a null text counts as empty. Further columns,
    whatever their names, are left out of the scan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal doc_id, modulo divisor. A null id gives 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % divisor, F.lit(0))


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers that would not find it by themselves,
    once for each Spark application."""
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if str(root) in known or getattr(context, "_hearthline_shipped", False):
        return
    archive = f"{tempfile.mkdtemp(prefix='spark-')}/hearthline-package.zip"  # the driver serves it from there
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "hearthline").rglob("*.py")):
            z.write(path, path.relative_to(root))
    context.addPyFile(archive)
    context._hearthline_shipped = True


_worker_caches: list[Callable] = []


def worker_cache(f: Callable) -> Callable:
    """Like functools.cache, for large values that Python workers keep between tasks."""
    cached = functools.cache(f)
    _worker_caches.append(cached)
    return cached


def begin_task(*used: Callable) -> None:
    """Lets go of what other operators left in this worker, and gives the memory back."""
    for cached in _worker_caches:
        if cached not in used:
            cached.cache_clear()
    give_back()


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Returns freed memory, which allocators keep, to the system: executors hold workers beside their heap."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def small_batches(spark: SparkSession) -> None:
    """Texts are long: fewer of them go to a Python worker at once than Spark's default."""
    if spark.conf.get(_BATCH_ROWS) == "10000":
        spark.conf.set(_BATCH_ROWS, str(ROWS_AT_A_TIME))


def row_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Batches in slices of bounded rows and bytes, columns as lists."""
    for batch in batches:
        rows = max(1, min(ROWS_AT_A_TIME, BYTES_AT_A_TIME * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict], dict]], uses: tuple[Callable, ...] = ()) -> DataFrame:
    """mapInArrow over small slices of rows. make() is called once in each task
    and returns a function from columns (lists) to columns (lists or arrays);
    uses: the worker caches that it needs."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task(*uses)
        step = make()
        for rows in row_slices(batches):
            out = step(rows)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Keys longer than this are computed each time they are met; an entry's bytes besides its key.
LONGEST_KEY, ENTRY_BYTES = 64, 200


class BoundedCache(dict):
    """A dict that computes what it lacks and keeps two generations of at most
    about limit bytes: what is asked for again survives, and a task's memory
    follows neither the number nor the length of distinct keys (texts or pairs)."""

    def __init__(self, compute: Callable, limit: int):
        super().__init__()
        self.compute, self.limit, self.older, self.held = compute, limit, {}, 0

    def __missing__(self, key):
        if len(key) > LONGEST_KEY:
            return self.compute(key)
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        size = ENTRY_BYTES + 4 * len(key)
        if self.held + size > self.limit:
            self.older, self.held = self.copy(), 0
            self.clear()
        self[key] = value
        self.held += size
        return value


#: A key with more than this part of all rows (and more than FEW of them) is hot; it is dealt over SALTS places.
HOT_PART, FEW, SALTS = 1000, 256, 64


def is_hot(most: int, total: int) -> bool:
    """Whether a key of this many rows is hot among total ones."""
    return most > FEW and most * HOT_PART > total


def join_spread(rows: DataFrame, one: DataFrame, key: str, total: int, by: str, count: str = "count", how: str = "inner") -> DataFrame:
    """Joins rows with the one row of their key, hot keys dealt over many tasks by
    the column `by`. one counts the rows of its keys, which add up to total at
    most: so fewer than HOT_PART keys are hot, and these few may be sent to all tasks."""
    hot = (F.col(count) * HOT_PART > total) & (F.col(count) > FEW)
    heavy = F.broadcast(one.where(hot).select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(0).cast("int")
    dealt = rows.join(heavy, key, "left").withColumn("_salt", salt).drop("_hot")
    places = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(one.withColumn("_salt", F.explode(places)), [key, "_salt"], how).drop("_salt")


def column_udf(result: str, make: Callable[[], Callable[[pa.Array], list]], uses: tuple[Callable, ...] = ()) -> Callable[..., Column]:
    """A function of one column that runs on Arrow batches, while all other columns
    stay where they are. make() is called once in each task and returns a function
    from an Arrow array to as many values."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = SparkSession.active()
    ship_package(spark)
    small_batches(spark)
    kind = to_arrow_type(_parse_datatype_string(result))

    @F.arrow_udf(result)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        begin_task(*uses)
        step = make()
        for batch in batches:
            rows = max(1, min(ROWS_AT_A_TIME, BYTES_AT_A_TIME * len(batch) // max(1, batch.nbytes)))
            parts = [pa.array(step(batch.slice(at, rows)), type=kind) for at in range(0, len(batch), rows)]
            yield pa.concat_arrays(parts) if parts else pa.array([], type=kind)

    return run


def sum_vectors(df: DataFrame, key: str, vector: str) -> dict[str, list[float]]:
    """Sums of equally long vectors by a key with few values, added up on the executors."""
    parts = df.select(F.col(key).alias("k"), F.posexplode(vector).alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"))
    out: dict[str, dict[int, float]] = {}
    for k, i, v in parts.collect():
        out.setdefault(k, {})[i] = v
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}
