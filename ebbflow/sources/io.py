"""Sources and sinks: typed CSV, Parquet and JSON, upserts by key, optional page decoders."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.series import keep_first, with_t_hours

HOURLY = "port STRING, datetime_ist TIMESTAMP_NTZ, height_m DOUBLE"
HEIGHT_COLUMNS = ("height_m", "combined_predicted_m", "predicted_height_m", "lsm_predicted_m", "water_level_height_m")


def read_hourly(spark: SparkSession, path: str, dedupe: bool = True) -> DataFrame:
    """Hourly observations from CSV (header), with ``t_hours``; of rows of one hour the first in the files is kept,
    by file name, and within a file by place (a null height counts as a row)."""
    raw = spark.read.schema(HOURLY).csv(path, header=True)
    if not dedupe:
        return with_t_hours(raw)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    placed = raw.select("*", place.alias("__place"))
    return with_t_hours(keep_first(placed, [F.col("port"), F.col("datetime_ist")], F.col("height_m"), F.col("__place")))


def read_events(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Observed events with state in title case; a missing column or a bad number is an error."""
    raw = spark.read.csv(path, header=True)
    missing = {"state", "datetime_ist", "height_m"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    out = raw.withColumns({"state": F.initcap(F.trim("state")), "datetime_ist": F.col("datetime_ist").cast("timestamp_ntz"), "height_m": F.col("height_m").cast("double")})
    for bound, op in ((start, ">="), (end, "<")):
        if bound:
            out = out.where(F.expr(f"datetime_ist {op} TIMESTAMP_NTZ '{bound}'"))
    return out


def height_column(df: DataFrame, wanted: str | None = None) -> str:
    """The height column by name, or the first of HEIGHT_COLUMNS that is there."""
    for c in [wanted] if wanted else HEIGHT_COLUMNS:
        if c in df.columns:
            return c
    raise ValueError("no height column")


def read_forecast(spark: SparkSession, path: str, port: str, wanted: str | None = None) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    return raw.select(F.lit(port).alias("port"), F.col("datetime_ist").cast("timestamp_ntz").alias("datetime_ist"), F.col(height_column(raw, wanted)).cast("double").alias("height_m"))


def read_model(spark: SparkSession, constants_path: str, summary_path: str, port: str) -> DataFrame:
    """A model table (see operators.harmonic.MODEL_SCHEMA) from harmonic constants and the run summary."""
    kinds = "name STRING, kind STRING, period_hours DOUBLE, speed_deg_per_hour DOUBLE, amplitude_m DOUBLE, phase_deg DOUBLE, A_cos DOUBLE, B_sin DOUBLE"
    level = spark.read.json(summary_path, multiLine=True).where(F.col("port") == port).select("mean_level_m").head()
    if level is None:
        raise ValueError(f"no summary for {port}")
    rows = spark.read.schema(kinds).csv(constants_path, header=True)
    return rows.select(F.lit(port).alias("port"), "*", F.lit(level[0]).alias("mean_level_m"), F.lit(0.0).alias("trend_m_per_year"), F.lit(False).alias("nodal"))


def write_csv(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """CSV export with three decimals where the column is height_m, sorted at the sink only."""
    out = df.withColumn("height_m", F.format_string("%.3f", "height_m")) if "height_m" in df.columns else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True)


def write_hourly(df: DataFrame, path: str) -> None:
    """Parquet partitioned by port and year, so time filters prune directories."""
    df.withColumn("year", F.year("datetime_ist")).repartition("port", "year").write.mode("overwrite").partitionBy("port", "year").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``old`` whose key ``new`` lacks, and all of ``new``."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def row_groups(df: DataFrame) -> list[tuple[str, int, int]]:
    """(file, first row, row after the last) of every filled Parquet row group, by file name and place.

    Footers are read through Spark's file systems, 16 at a time.
    """
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()

    def of_file(uri: str) -> list[tuple[str, int, int]]:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(at, conf))
        try:
            counts = [b.getRowCount() for b in reader.getRowGroups()]
        finally:
            reader.close()
        name = jvm.org.apache.hadoop.fs.Path(at.toString()).toUri().toString()  # as in _metadata.file_path
        return [(name, end - n, end) for n, end in zip(counts, accumulate(counts), strict=True) if n]

    with ThreadPoolExecutor(16) as pool:
        return sorted(g for found in pool.map(of_file, df.inputFiles()) for g in found)


def with_row_group(df: DataFrame, groups: list[tuple[str, int, int]]) -> DataFrame:
    """The rows of a Parquet table with ``row_group``, their group's number in ``groups``.

    Groups are found by file and by stretches of their mean length, at most twice as many as groups. A row of a file
    that isn't named there stays, without a number.
    """
    import pyarrow as pa

    width = max(1, sum(end - first for _, first, end in groups) // len(groups))
    cut = [(file, stretch, first, end, k) for k, (file, first, end) in enumerate(groups) for stretch in range(first // width, (end - 1) // width + 1)]
    names = ["__file", "__stretch", "__first", "__end", "row_group"]
    bounds = df.sparkSession.createDataFrame(pa.table(dict(zip(names, zip(*cut, strict=True), strict=True))))
    row = F.col("__row")
    placed = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    on = (F.col("__path") == F.col("__file")) & (F.floor(row / width) == F.col("__stretch")) & (row >= F.col("__first")) & (row < F.col("__end"))
    return placed.join(F.broadcast(bounds), on, "left").select(*df.columns, "row_group")


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)  # summaries: a row per port


def read_pages(spark: SparkSession, path: str, chars: bool = False) -> DataFrame:
    """Positioned words or characters of PDF pages, through pdfplumber where it is installed on the workers."""
    schema = "file string, page int, text string, x0 double, top double, size double"

    def decode(batches):
        import io

        import pandas as pd
        import pdfplumber

        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with pdfplumber.open(io.BytesIO(content)) as pdf:
                    for number, page in enumerate(pdf.pages):
                        for x in page.chars if chars else page.extract_words():
                            rows.append((name, number, x["text"], float(x["x0"]), float(x["top"]), float(x.get("size", 0.0))))
            yield pd.DataFrame(rows, columns=["file", "page", "text", "x0", "top", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(decode, schema)


def last_write(rows: DataFrame, order: Column) -> DataFrame:
    from ..operators.series import keep_last

    return keep_last(rows, [F.col("port"), F.col("datetime_ist")], F.col("height_m"), order)
