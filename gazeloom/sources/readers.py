"""Readers and writers of recordings: CSV, TSV, JSON metadata and ARFF relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gazeloom.operators.parse_errors import parse_records

GAZE_SCHEMA = "x double, y double, timestamp double, gaze_point_validity string, left_z double"
META_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("radiologist", "fname")]
    + [T.StructField(n, T.LongType()) for n in ("global_ind", "num_part", "num_img")]
    + [T.StructField(n, T.DoubleType()) for n in ("x0", "y0", "win_width", "win_height")]
)
# nullValue stands for values left out; it is no character, and the default, "", would turn texts without characters into null.
READ_OPTIONS = {"header": True, "escape": '"', "nullValue": "\uffff"}
TSV_SCHEMA = "X_coord double, Y_coord double, Confidence double, Pattern string"


def _part(path: Column, place: int) -> Column:
    """A path's part by its place from the end; 1 is the file. Regular expressions try every start of a long path, in every row."""
    return F.substring_index(F.substring_index(path, "/", -place), "/", 1)


def with_recording(df: DataFrame, path: Column | None = None) -> DataFrame:
    """Adds date, image and recording (date/image) from the path of each row's file, <date>/<image>/<file>."""
    path = F.col("_metadata.file_path") if path is None else path
    date, image = _part(path, 3), _part(path, 2)
    return df.withColumns({"date": date, "image": image}).withColumn("recording", F.concat_ws("/", "date", "image"))


def read_gaze_csv(spark: SparkSession, path: str, schema: str = GAZE_SCHEMA, multiline: bool = False) -> DataFrame:
    """Gaze files with a header line, of any number of recordings: path may be a pattern such as root/*/*/gaze.csv.

    Columns are taken by name, so files may have more or fewer; a missing one is null, as is a
    value left out; "" is a text without characters. A quote in a quoted value is doubled. multiline: values may hold line breaks, as write_csv_by_recording writes
    them; a quote that never closes then takes the rest of its file, not of its line.
    """
    wanted = T._parse_datatype_string(schema)
    found = spark.read.options(**READ_OPTIONS, multiLine=multiline).csv(path)
    columns = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return with_recording(found.select("*", "_metadata"), F.col("_metadata.file_path")).select("recording", "date", "image", *columns)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated training files, without the column Filename if they have it; parent is the folder's name."""
    rows = spark.read.option("header", True).option("sep", "\t").option("recursiveFileLookup", True).csv(path)
    rows = rows.withColumn("parent", _part(F.col("_metadata.file_path"), 2)).drop("Filename")
    numbers = [c for c in ("X_coord", "Y_coord", "Confidence") if c in rows.columns]
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def read_meta_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Metadata files, one object each: the readable ones as rows, and the paths of the others.

    Readable is a file that holds exactly one JSON object, without anything after it, that names an
    image. A value of another type than its column's is null.
    """
    text = spark.read.option("wholetext", True).text(path).select("value", F.col("_metadata.file_path").alias("path"))
    edits = parse_records(F.lit("meta"), F.col("value"), {}, ("meta",)).alias("_edits")
    rows = text.select("path", F.from_json("value", META_SCHEMA).alias("_meta"), edits)
    rows = with_recording(rows, F.col("path"))
    bad = F.coalesce(F.col("_edits.quotes") + F.col("_edits.texts") + F.col("_edits.delimiters") > 0, F.lit(True)) | F.col("_meta.fname").isNull()
    return rows.where(~bad).select("_meta.*", "date", "image", "recording"), rows.where(bad).select("recording", "path")


def arff_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of ARFF files: recording, line."""
    text = spark.read.text(path)
    return with_recording(text.select("value", "_metadata"), F.col("_metadata.file_path")).select("recording", F.col("value").alias("line"))


def read_arff(spark: SparkSession, path: str, attributes: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ARFF relations with numeric attributes in the given order, and their metadata (recording, name, value).

    A relation's order is that of its time attribute; the reader keeps no line numbers.
    """
    lines = arff_lines(spark, path)
    data = lines.where((F.trim("line") != "") & ~F.trim("line").rlike("^[@%]"))
    fields = F.split("line", ",")
    rows = data.select("recording", *[F.trim(F.get(fields, F.lit(i))).try_cast("double").alias(a) for i, a in enumerate(attributes)])
    marked = lines.where(F.col("line").rlike(r"^%\s*@METADATA"))
    words = F.split(F.regexp_replace("line", r"^%\s*@METADATA\s+", ""), r"\s+")
    return rows, marked.select("recording", F.get(words, F.lit(0)).alias("name"), F.get(words, F.lit(1)).try_cast("double").alias("value"))


def screen_metadata(metadata: DataFrame) -> DataFrame:
    """Metadata names in their present form: pixels as width_px, height_px, lengths in mm; metres of older files times 1000.

    Where a recording has both the older and the present name, the present one holds.
    """
    # Older names, what they became and the factor.
    older = {"PIXELX": ("width_px", 1.0), "PIXELY": ("height_px", 1.0), "DIMENSIONX": ("width_mm", 1000.0), "DIMENSIONY": ("height_mm", 1000.0), "DISTANCE": ("distance_mm", 1000.0)}
    name, value = F.col("name"), F.col("value")
    for old, (new, factor) in older.items():
        value = F.when(F.col("name") == old, F.col("value") * factor).otherwise(value)
        name = F.when(F.col("name") == old, new).otherwise(name)
    renamed = metadata.select("recording", name.alias("name"), value.alias("value"), F.col("name").isin(*older).alias("_older"))
    return renamed.groupBy("recording", "name").agg(F.min_by("value", "_older").alias("value"))


def write_arff(df: DataFrame, recording: str, order: str, attributes: list[str], metadata: dict[str, float], path: str, relation: str = "gaze_labels") -> None:
    """One ARFF file per recording below path, the rows by order."""
    head = [f"@RELATION {relation}", *[f"%@METADATA {k} {v}" for k, v in metadata.items()], "", *[f"@ATTRIBUTE {a} NUMERIC" for a in attributes], "", "@DATA"]
    rows = df.select(F.col(recording).alias("_r"), F.col(order).cast("double").alias("_o"), F.concat_ws(",", *[F.coalesce(F.col(a).cast("string"), F.lit("?")) for a in attributes]).alias("value"))
    heads = df.select(F.col(recording).alias("_r")).distinct().select("_r", F.posexplode(F.array(*[F.lit(h) for h in head])).alias("_p", "value"))
    lines = rows.select("_r", F.lit(1).alias("_part"), "_o", "value").unionByName(heads.select("_r", F.lit(0).alias("_part"), F.col("_p").cast("double").alias("_o"), "value"))
    lines.repartition("_r").sortWithinPartitions("_r", "_part", "_o").select("_r", "value").write.mode("overwrite").partitionBy("_r").text(path)


def tidy_arff_headers(lines: DataFrame) -> DataFrame:
    """Numbered lines (recording, line_no, line) with the comment on speeds left out and metadata lines moved below the relation's.

    Only metadata before the relation's line is moved.
    """
    text = F.trim("line")
    relation = F.lower(text).startswith("@relation")
    w = W.partitionBy("recording").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    seen = F.coalesce(F.max(relation.cast("int")).over(w), F.lit(0))
    metadata = text.rlike(r"^%\s*@METADATA")
    rows = lines.withColumn("_after", seen).where(~(text.startswith("%") & F.lower(text).contains("number after speed")))
    place = F.when(metadata & (F.col("_after") == 0), 2).when(relation, 1).when(F.col("_after") == 0, 0).otherwise(3)
    return rows.withColumn("_place", place).select(
        "recording", F.row_number().over(W.partitionBy("recording").orderBy("_place", "line_no")).alias("line_no"), "line"
    )


def write_by_recording(df: DataFrame, path: str, keys: list[str]) -> None:
    """Parquet, a folder per key; rows are brought together by key first, so that a folder has few files."""
    df.repartition(*keys).write.mode("append").partitionBy(*keys).parquet(path)


TEXT_OPTIONS = {"header": True, "nullValue": "", "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def write_csv_by_recording(df: DataFrame, path: str, keys: list[str], separator: str = ",") -> None:
    """Text files with a header line, a folder per key; a key's rows are brought together by key first."""
    rows = df.repartition(*keys).write.mode("overwrite").options(**TEXT_OPTIONS).option("sep", separator)
    rows.partitionBy(*keys).csv(path)


def write_meta_json(df: DataFrame, path: str) -> None:
    """One JSON file per row, as recordings' metadata is kept; nulls are left out."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def benchmark_files(spark: SparkSession, root: str) -> DataFrame:
    """The ARFF files in folders named benchmarks one level below root: (prefix, path). No file is read."""
    found = spark.read.format("binaryFile").load(f"{root}/*/benchmarks/*.arff").select("path")
    return found.select(F.regexp_extract("path", r"([^/]+)/benchmarks/[^/]+$", 1).alias("prefix"), "path")


NPZ_ROWS = 1 << 14
"""Rows of one array file, so that a recording of any length is in files of bounded size."""


def pack_npz(df: DataFrame, keys: list[str], order: str, features: list[str], label: str) -> DataFrame:
    """Array files X (float, rows by features) and Y (whole numbers; a null label is -1): (keys, part, content), NPZ_ROWS of order each."""
    import io

    import numpy as np
    import pandas as pd

    schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("part", T.LongType()), T.StructField("content", T.BinaryType())])

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group, file = group.sort_values("_o"), io.BytesIO()
        np.savez(file, X=group[features].to_numpy(float), Y=group[label].fillna(-1).to_numpy(np.int64))
        return group[[*keys, "part"]].head(1).assign(content=[file.getvalue()])

    rows = df.select(*keys, F.floor(F.col(order) / NPZ_ROWS).alias("part"), F.col(order).alias("_o"), *features, label)
    return rows.groupBy(*keys, "part").applyInPandas(pack, schema)


def unpack_npz(files: DataFrame, keys: list[str], features: list[str], label: str) -> DataFrame:
    """The rows of pack_npz: (keys, part, place, features, label), place counting within a file."""
    import io
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    kept = [*keys, "part"]
    schema = T.StructType([*[files.schema[k] for k in kept], T.StructField("place", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in features], T.StructField(label, T.LongType())])

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, row in frame.iterrows():
                with np.load(io.BytesIO(row["content"])) as arrays:
                    out = pd.DataFrame(arrays["X"], columns=features).assign(place=np.arange(len(arrays["X"])), **{label: arrays["Y"]})
                for k in kept:
                    out[k] = row[k]
                yield out[schema.names]

    return files.select(*kept, "content").mapInPandas(unpack, schema)
