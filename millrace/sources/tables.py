"""Sources and sinks: Parquet tables, JSON documents with nested chunks, JSON-lines history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<chunk_id:string,section:string,text:string,page:int,flags:array<string>>"
DOCUMENT = f"name string, ingredient string, file string, pages int, chunks array<{CHUNK}>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one to a file, with defaults for missing fields; broken files give a row with name ''."""
    raw = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return raw.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("ingredient", F.lit("")).alias("ingredient"), F.coalesce("file", F.input_file_name()).alias("file"), F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("chunks", F.expr(f"cast(array() as array<{CHUNK}>)")).alias("chunks"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return read_documents(spark, path).select("name", "file", F.explode("chunks").alias("c")).select("name", "file", "c.*")


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def append_new(rows: DataFrame, path: str, key: str, reset: bool = False) -> int:
    """Appends rows whose key is not in the Parquet table at path yet, of equal keys the first in the order of rows; returns
    how many."""
    spark, columns = rows.sparkSession, rows.columns
    placed = rows.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("place"))
    rows = placed.groupBy(F.col(f"row.{key}").alias("key")).agg(F.min_by("row", "place").alias("first")).select("first.*")
    if not reset:
        try:
            rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
        except Exception as e:  # no table there yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    rows = rows.persist()
    try:
        n = rows.count()
        rows.write.mode("overwrite" if reset else "append").parquet(path)
    finally:
        rows.unpersist()
    return n


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, unique: bool = True) -> None:
    """df as a table in buckets by key, sorted in each: joins and groups on the key need no exchange. With unique, rows of a
    null key and keys of several rows are refused before anything is written."""
    if unique:
        wrong = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1)).limit(3).collect()
        if wrong:
            raise ValueError(f"{name}: {key} is not unique: {[r[key] for r in wrong]}")
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def document_files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """file, name, ingredient, pages, chunks, error: a row for each file, with what of it could be read; error says what is
    wrong with a broken one (null: nothing), so that no file stops the others. Files are read by Spark, as binary ones, from
    any store that it reads (it passes over files of no bytes); as a stream, each file once, by the offsets in the stream's checkpoint."""
    reader = spark.readStream if stream else spark.read
    raw = reader.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.json").load(path)
    body = raw.select(F.col("path").alias("at"), F.decode("content", "UTF-8").alias("body"))
    parsed = F.from_json("body", f"{DOCUMENT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    d = body.withColumn("d", parsed)
    empty = F.trim("body", F.lit(" \n\t\r")) == ""
    error = F.when(empty, "empty file").when(F.col("d").isNull() | F.col("d._corrupt").isNotNull(), F.concat(F.lit("no JSON document: "), F.substring("body", 1, 80))).when(F.coalesce(F.trim("d.name"), F.lit("")) == "", "no name")
    return d.select(
        F.coalesce("d.file", "at").alias("file"), F.coalesce("d.name", F.lit("")).alias("name"), F.coalesce("d.ingredient", F.lit("")).alias("ingredient"), F.coalesce("d.pages", F.lit(0)).alias("pages"),
        F.coalesce("d.chunks", F.expr(f"cast(array() as array<{CHUNK}>)")).alias("chunks"), error.alias("error"),
    )
