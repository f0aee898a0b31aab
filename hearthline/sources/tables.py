"""Parquet tables: staging between steps, snapshots instead of updates, subsets."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_prefix, clean_postcode

#: Raised when the layout or the meaning of processed tables changes.
TABLE_FORMAT = 1
#: Files of an ordered table: their names have five digits.
LEAST_FILES, MOST_FILES = 8, 100_000
#: Rows of an exported file, at most.
FILE_ROWS = 5_000_000


def shared_folder(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir. A local session without one gets
    its own; elsewhere a folder of one machine would lose data, so one has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that later steps start there."""
    path = f"{shared_folder(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_schema(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, those that lack as nulls, the others left out: additive evolution."""
    empty = df.sparkSession.createDataFrame([], schema)
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema if f.name in df.columns]
    return empty.unionByName(df.select(known), allowMissingColumns=True)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), order: Sequence[str] = ()) -> None:
    """Replaces a table; rows sorted within files serve row-group pruning."""
    sorted_rows = df.sortWithinPartitions(*order) if order else df
    sorted_rows.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A new snapshot: where changes has the key, its columns replace the table's, nulls too."""
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = table.join(new, key, "left")
    return joined.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def export_subset(table: DataFrame, path: str, prefixes: Sequence[str], column: str = "postcode_clean") -> int:
    """Copies the rows of some postcode prefixes (all where there are none), parted by outward code; their number."""
    return export_subsets({path: table}, prefixes, column)[path]


def export_subsets(subsets: dict[str, DataFrame], prefixes: Sequence[str], column: str = "postcode_clean") -> dict[str, int]:
    """Copies the rows of some postcode prefixes (all where there are none) of several
    tables, by path, and their numbers. Rows are ranged by postcode, so that an outward
    code has few files of bounded size in which postcodes are sorted, however many
    rows it has; they are counted as they are written."""
    counts = {}
    for path, table in subsets.items():
        postcode = clean_postcode(F.col(column))
        kept = table.where(any_prefix(postcode, prefixes)) if prefixes else table
        outward = F.when(F.length(postcode) > 3, F.left(postcode, F.length(postcode) - 3))
        seen = Observation()
        ranged = kept.withColumn("outward", outward).repartitionByRange("outward", column).sortWithinPartitions("outward", column)
        observed = ranged.observe(seen, F.count(F.lit(1)).alias("rows"))
        observed.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("outward").parquet(path)
        counts[path] = seen.get["rows"]
    return counts


def write_ordered_csv(df: DataFrame, path: str, key: str, files: int = 0, header: bool = True) -> None:
    """Writes rows in the order of key into many files, each by a task of its own: what
    a file holds comes before what the next one does, and names carry that order, as
    readers with an order of arrival expect. The key itself is not written."""
    n = min(max(files, LEAST_FILES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_FILES)
    df.repartitionByRange(n, key).sortWithinPartitions(key).drop(key).write.option("header", header).csv(path)


def fingerprint(spark: SparkSession, inputs: Sequence[str], settings: object = None) -> str:
    """What a table was made from: the paths, lengths and times of all files under the
    inputs (listed by Spark, contents unread), and the settings. A missing input counts as such."""
    seen: list[object] = [TABLE_FORMAT, settings]
    for path in inputs:
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except AnalysisException:
            seen.append((path, None))
            continue
        each = F.xxhash64("path", "length", "modificationTime")
        seen.append((path, *files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.bit_xor(each)).first()))
    return hashlib.sha256(repr(seen).encode()).hexdigest()[:24]


def _marked(spark: SparkSession, folder: str) -> str | None:
    """Where a finished table is; None if none was finished."""
    try:
        row = spark.read.schema("data string").json(f"{folder}/marker").first()
    except AnalysisException:
        return None
    return row and row["data"]


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False, version: str = "") -> DataFrame:
    """A processed table of the given version (a fingerprint): read where it is there as
    a whole, else, or where a refresh is asked for, made and written. Other versions
    stay beside it; a build has a folder of its own, and a marker written last says
    which one is the table, so that neither a broken build nor a running reader is
    mistaken or disturbed."""
    folder = f"{path}/{version or 'table'}"
    data = None if refresh else _marked(spark, folder)
    if data is None:
        data = f"{folder}/data-{uuid.uuid4().hex}"
        write_table(make(), data)
        spark.createDataFrame([(data,)], "data string").coalesce(1).write.mode("overwrite").json(f"{folder}/marker")
    return spark.read.parquet(data)


def _is_written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def table_or_file(spark: SparkSession, name: str, path: str) -> DataFrame:
    """The processed file where there is one, else the table of that name."""
    return spark.read.parquet(path) if _is_written(spark, path) else spark.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def profile(df: DataFrame) -> dict:
    """Columns, the first rows and the number of rows."""
    return {"columns": df.columns, "head": [r.asDict() for r in df.limit(5).collect()], "rows": df.count()}
