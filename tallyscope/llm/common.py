"""Helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII space, tab, newline, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

_own_dir: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where it is unset in local mode, as in tests."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="tallyscope-")
    return _own_dir[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it again. Survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result, in a folder of their own that goes when the result no longer needs them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.folder = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        """As the function of this name."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows that one row of flags stands for, and rows of flags that are broadcast at most (some 60 MB, for 400 million rows).
FLAGGED_ROWS, BROADCAST_FLAGS = 4096, 100_000


def reads_rows_as_they_are(docs: DataFrame) -> bool:
    """Is docs one table of files, or columns and rows chosen from it, so that each of its rows is one row of a file?"""
    plan = docs._jdf.queryExecution().analyzed().toString()
    nodes = [line.strip(" :+-").split(" ")[0] for line in plan.splitlines() if line.strip()]
    return nodes[-1] == "Relation" and set(nodes[:-1]) <= {"Project", "Filter", "SubqueryAlias"}


def numbered(docs: DataFrame) -> DataFrame:
    """kept (a struct of the columns of docs), file and row: where a row lies in the files that docs reads, which no lost executor changes.

    What is not read row by row from one table of Parquet files is written first.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept")
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    if reads_rows_as_they_are(docs):
        try:
            return docs.select(kept, *place)
        except AnalysisException:  # files without row numbers, or a column called _metadata
            pass
    return written(docs.select(kept), "rows").select("kept", *place)


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of a numbered table without the dropped ones (file, row), as they were before they were numbered.

    Dropped rows are bits of a few longs per FLAGGED_ROWS rows, so up to BROADCAST_FLAGS of these rows the texts stay where
    they are; with more, they are joined by shuffle.
    """
    word = F.floor(F.col("row") / 64)
    words = dropped.groupBy("file", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("row") % 64).cast("int"))).alias("bits"))
    per_row = FLAGGED_ROWS // 64
    listed = words.groupBy("file", F.floor(F.col("word") / per_row).alias("part")).agg(F.collect_list(F.struct((F.col("word") % per_row).cast("int").alias("at"), "bits")).alias("found"))
    bits_at = lambda i: F.aggregate("found", F.lit(0).cast("long"), lambda a, f: F.when(f["at"] == i, f["bits"]).otherwise(a))
    flags = written(listed.select("file", "part", F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), bits_at).alias("flags")), "flags")
    if flags.count() <= BROADCAST_FLAGS:
        flags = F.broadcast(flags)
    joined = rows.withColumn("part", F.floor(F.col("row") / FLAGGED_ROWS)).join(flags, ["file", "part"], "left")
    flag = F.getbit(F.get("flags", F.floor(F.col("row") % FLAGGED_ROWS / 64).cast("int")), (F.col("row") % 64).cast("int"))
    return joined.where(F.coalesce(flag, F.lit(0)) == 0).select("kept.*")


#: Equal rows are numbered in so many parts, each a task's.
EQUAL_PARTS = 256


def places_among_equals(rows: DataFrame, group: Column) -> DataFrame:
    """file, row and `place`, the number (from 0) of a row among those with the same group; written.

    Rows are counted by group and part first, so a group with a third of the rows is numbered in EQUAL_PARTS tasks.
    """
    some = rows.select("file", "row", group.alias("_group"), F.pmod(F.xxhash64("file", "row"), F.lit(EQUAL_PARTS)).alias("_part"))
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = some.groupBy("_group", "_part").count().select("_group", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_group", "_part").orderBy("file", "row")) - 1
    return written(some.withColumn("_place", place).join(starts, ["_group", "_part"]).select("file", "row", (F.col("_place") + F.col("_start")).alias("place")), "places")


def unused_name(columns: list[str], name: str) -> str:
    """name, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc32(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as no bytes."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `name`: the row's 0-based place in the whole table by `order`, without sorting the table in one task.

    Ranges are dealt to partitions, counted, and shifted by the counts before them (one row per partition).
    """
    dealt = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1 + F.col("_start")
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, place.cast("long")).drop("_range", "_start")
