"""Many small files into few containers, and the records they hold, each once.

A container is one block of bytes with an index of the files in it (path, offset, length,
checksum), so a file is found and cut out without reading the rest, and containers are read in
parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.ordered import BEFORE
from gazeloom.session import cut_lineage

TARGET_BYTES = 1 << 20
BYTES = "ISO-8859-1"
"""A character per byte: what a block of bytes is joined in."""

GAZE_COLUMNS = (
    "x", "y", "timestamp", "gaze_point_validity", "case", "radiologist", "fname", "x0", "y0", "win_width", "win_height", "doctor_mistake",
)


def pack_containers(files: DataFrame, ident: str, path: str, content: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Packs the files' bytes: (container_id, n_files, n_bytes, files, block).

    content is binary, packed as it is, or text, packed in UTF-8. files is an array of (ident, path,
    offset, length, checksum) by offset, block the files' bytes one after the other. A file with
    empty or null content keeps its place in the index with length 0; a file of more than
    target_bytes gets a container of its own. Repeated rows (same ident, path and content) are
    packed once; files that differ in one of them are all kept. A null ident or path is kept too. An
    empty table gives no containers; other columns are ignored.

    The distinct files, hashed to partitions, are written once, each with the bytes before it in its
    partition. With the partitions' totals, a row each, these are places in one stream of all bytes,
    and a container takes those files whose first byte lies in its stretch of target_bytes. So
    containers are full whatever the number of partitions is, and no task holds more than one.
    """
    data = F.col(content)
    if not isinstance(files.schema[content].dataType, T.BinaryType):
        data = F.encode(data.cast("string"), "UTF-8")
    given = files.select(F.col(ident).alias("ident"), F.col(path).alias("path"), F.coalesce(data, F.lit(b"")).alias("bytes"))
    sized = given.withColumn("_hash", F.sha2("bytes", 256)).dropDuplicates(["ident", "path", "_hash"])
    sized = sized.withColumn("length", F.length("bytes").cast("bigint")).withColumn("_large", F.col("length") > target_bytes)
    schema = T.StructType([*sized.schema.fields, *[T.StructField(n, T.LongType()) for n in ("_part", "_row", "_before")]])
    placed = cut_lineage(sized.sortWithinPartitions("path", "ident", "_hash").mapInArrow(_placed, schema))
    totals = placed.groupBy("_part").agg(F.sum(F.when(~F.col("_large"), F.col("length"))).alias("_n"))
    starts = totals.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(*BEFORE)), F.lit(0)).alias("_start"))  # a row per partition
    at = placed.join(F.broadcast(starts), "_part").withColumn("_at", F.col("_start") + F.col("_before"))
    own = F.concat_ws("-", F.lit("large"), "_part", "_row")
    at = at.withColumn("container_id", F.when(F.col("_large"), own).otherwise(F.floor(F.col("_at") / target_bytes).cast("string")))
    one = F.struct("_part", "_row", "_at", "ident", "path", "length", "bytes")
    packed = at.groupBy("container_id").agg(F.array_sort(F.collect_list(one)).alias("f"))  # a container's files
    first = F.col("f")[0]["_at"]
    index = F.transform(
        "f",
        lambda x: F.struct(
            x["ident"].alias("ident"), x["path"].alias("path"), (x["_at"] - first).alias("offset"), x["length"].alias("length"), F.crc32(x["bytes"]).alias("checksum")
        ),
    )
    return packed.select(
        "container_id",
        F.size("f").alias("n_files"),
        F.aggregate("f", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("n_bytes"),
        index.alias("files"),
        F.encode(F.array_join(F.transform("f", lambda x: F.decode(x["bytes"], BYTES)), ""), BYTES).alias("block"),
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number, the row's, and the bytes of the partition's files before it that aren't large."""
    part, row, upto = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.num_rows
        counted = np.where(batch.column("_large").to_numpy(zero_copy_only=False), 0, batch.column("length").to_numpy())
        ends = upto + np.cumsum(counted)
        added = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(row, row + n)), pa.array(ends - counted)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "_part", "_row", "_before"])
        row, upto = row + n, int(ends[-1]) if n else upto


def unpack_containers(containers: DataFrame) -> DataFrame:
    """The files of containers: (ident, path, content, intact); content is binary, intact if the checksum fits."""
    one = containers.select("block", F.inline("files"))
    cut = F.substring(F.col("block"), (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return one.select("ident", "path", cut.alias("content"), "checksum").select("ident", "path", "content", (F.crc32("content") == F.col("checksum")).alias("intact"))


def write_containers(containers: DataFrame, folder: str) -> None:
    """Writes containers to folder: blocks, one file per container, and index, one row per packed file by path.

    An index row names the file its block is in (file), so a lookup reads the index rows of its
    paths and the files these name, no other block.
    """
    containers.write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(f"{folder}/blocks")
    written = containers.sparkSession.read.parquet(f"{folder}/blocks")
    index = written.select("container_id", F.col("_metadata.file_name").alias("file"), F.inline("files"))
    index.repartitionByRange("path", "ident").sortWithinPartitions("path", "ident", "offset").write.mode("overwrite").parquet(f"{folder}/index")


def read_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The containers that write_containers wrote; unpack_containers gives their files, in parallel."""
    return spark.read.parquet(f"{folder}/blocks")


def find_files(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """The files of the given paths, as unpack_containers gives them; only the containers they are in are read."""
    found = spark.read.parquet(f"{folder}/index").where(F.col("path").isin(paths))
    places = [f"{folder}/blocks/{row['file']}" for row in found.select("file").distinct().collect()]  # at most a few per path
    if not places:
        return unpack_containers(read_containers(spark, folder).limit(0))
    return unpack_containers(spark.read.parquet(*places)).where(F.col("path").isin(paths))


def gaze_file_records(files: DataFrame) -> DataFrame:
    """The lines of preprocessed_raw_gaze files: (ident, path, line_no, line, fname, radiologist, ts_us).

    Lines end with LF, CRLF or CR; a header line and empty lines are no records, and a file may
    have none. The value of timestamp counts, not its spelling: ts_us is it in whole microseconds,
    null where it is no number. Fields a line lacks are null. A line is a record of its own
    whatever it holds: nothing is dropped. Content is text or its bytes in UTF-8; bytes that are
    none become replacement characters.
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = files.select("ident", "path", F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "line"))
    header = F.lit(",".join(GAZE_COLUMNS))
    rows = lines.where((F.col("line") != "") & (F.lower(F.trim("line")) != header))
    fields = F.transform(F.split("line", ","), lambda v: F.trim(v))
    field: dict[str, Column] = {n: F.get(fields, F.lit(i)) for i, n in enumerate(GAZE_COLUMNS)}
    seconds = field["timestamp"].try_cast("decimal(38,9)")
    return rows.select(
        "ident", "path", "line_no", "line", field["fname"].alias("fname"), field["radiologist"].alias("radiologist"),
        F.coalesce(F.round(seconds * 1_000_000, 0).cast("bigint"), F.round(field["timestamp"].try_cast("double") * 1_000_000).cast("bigint")).alias("ts_us"),
    )


RECORD = ["fname", "radiologist", "ts_us"]


def repeated_records(records: DataFrame) -> DataFrame:
    """The records that occur more than once: (fname, radiologist, ts_us, n). Lines without all three are none."""
    return records.dropna(subset=RECORD).groupBy(*RECORD).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def consolidate(files: DataFrame, ident: str, path: str, content: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Rewrites the files into containers in which every record occurs exactly once.

    The files are packed and written, read back from their containers (a file whose checksum fails
    raises an error), and each record stays in the first file (by path, ident and line) that has it; lines
    that lack a part of the record's key all stay. What stays of a file is packed again, under the
    file's path, as its original lines with line feeds.
    """
    records = gaze_file_records(intact_files(cut_lineage(pack_containers(files, ident, path, content, target_bytes))))
    where = F.struct("path", "ident", "line_no")
    keyed = records.where(F.col("fname").isNotNull() & F.col("radiologist").isNotNull() & F.col("ts_us").isNotNull())
    first = keyed.groupBy(*RECORD).agg(F.min_by(F.struct("path", "ident", "line_no", "line"), where).alias("r")).select("r.*")
    unkeyed = records.where(F.col("fname").isNull() | F.col("radiologist").isNull() | F.col("ts_us").isNull())
    kept = first.unionByName(unkeyed.select("path", "ident", "line_no", "line"))
    rest = kept.groupBy("ident", "path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content")
    )
    return pack_containers(rest, "ident", "path", "content", target_bytes)


def intact_files(containers: DataFrame) -> DataFrame:
    """The files of containers; an error where a checksum fails."""
    files = unpack_containers(containers)
    checked = F.when(F.col("intact"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("checksum of "), "path")))
    return files.select("ident", "path", checked.alias("content"))
