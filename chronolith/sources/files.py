"""Stores and folders: JSON entities with explicit schemas, directory listings, cached results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith.functions import clock as C
from chronolith.functions import text as T

EVIDENCE = "struct<video_id:string,timestamp_start:string,timestamp_end:string,screenshot_ids:array<string>>"
VIDEO = "struct<video_id:string,file_name:string,title:string,status:string,parent_video_id:string,duration_seconds:double,version:int,processed_at:string,functionalities:array<string>,use_cases:array<string>>"
USE_CASE = f"struct<use_case_id:string,name:string,status:string,actor:string,objective:string,flow:string,trigger:string,confidence:string,version:int,functionalities:array<string>,business_rules:array<string>,evidence:array<{EVIDENCE}>>"
EVENT = f"struct<date:string,action:string,entity:string,reason:string,previous_version_snapshot:{USE_CASE}>"
MEMORY = f"memory_version string, videos array<{VIDEO}>, actors array<string>, systems array<string>, functionalities array<string>, business_rules array<string>, use_cases array<{USE_CASE}>, relationships array<string>, analysis_history array<{EVENT}>"
CAPSULE = "struct<output:string,video_fuente:string,tema_canonico:string,tema:string,slug:string,origen:string,duracion_s:double,piel_max:double,fecha:string>"
PROCESSED = "struct<video:string,video_id:string,discovery:string,duration_seconds:double,objetivo:array<string>,capsulas:array<string>,casos_nuevos:array<string>,procesado:boolean,sin_casos_nuevos:boolean,registrado:string,actualizado:string,eliminado:string>"
REGISTRY = f"capsulas array<{CAPSULE}>, videos_procesados array<{PROCESSED}>, actualizado string"


def read_json_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document as one row; missing arrays are empty. A corrupt document is an error, not an empty store."""
    raw = spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)
    return raw.select(*[F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in raw.schema.fields])


def read_memory(spark: SparkSession, path: str) -> DataFrame:
    return read_json_store(spark, path, MEMORY)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return read_json_store(spark, path, REGISTRY)


def entities(store: DataFrame, key: str) -> DataFrame:
    """The rows of one array of a store, in order: its fields and ``ord``."""
    return store.select(F.posexplode(key).alias("ord", "e")).select("ord", "e.*")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: path, name, modified, size; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def with_extensions(files: DataFrame, extensions: list[str]) -> DataFrame:
    return files.where(F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)).isin(*[e.lower() for e in extensions]))


def latest(files: DataFrame) -> DataFrame:
    """The file modified last."""
    return files.agg(F.max_by(F.struct(*files.columns), F.struct("modified", "name")).alias("f")).where("f is not null").select("f.*")


def for_dates(files: DataFrame, dates: DataFrame) -> DataFrame:
    """For each date the first file whose name has it, or else the last one modified that day.

    A name's dates are taken out of it, so files and dates meet in an equi-join.
    """
    bare = F.regexp_replace(T.stem(F.col("name")), r"[-_.\s]", "")
    eight = F.regexp_extract_all(bare, F.lit(r"(?=(\d{8}))"), F.lit(1))
    named = files.select("name", "modified", F.explode(F.array_distinct(eight)).alias("d8"))
    iso, dmy = F.try_to_timestamp("d8", F.lit("yyyyMMdd")).cast("date"), F.try_to_timestamp("d8", F.lit("ddMMyyyy")).cast("date")
    by_name = named.select("name", "modified", F.explode(F.array_compact(F.array(iso, dmy))).alias("date"), F.lit(0).alias("rank")).distinct()
    by_day = files.select("name", "modified", F.to_date("modified").alias("date"), F.lit(1).alias("rank"))
    found = dates.join(by_name.unionByName(by_day), "date")
    newest = F.when(F.col("rank") == 1, -F.unix_micros(F.col("modified").cast("timestamp"))).otherwise(F.lit(0))
    w = Window.partitionBy("date").orderBy("rank", newest, "name")
    return found.withColumn("n", F.row_number().over(w)).where("n = 1").select("date", "name", "rank")


def first_by_folder(files: DataFrame, date: str) -> DataFrame:
    """The first file with the date in its name, by folder rank and name; files: folder_rank, name."""
    pattern = C.date_pattern(F.to_date(F.lit(date)))
    hits = files.where(F.regexp_like(T.stem(F.col("name")), pattern))
    return hits.agg(F.min(F.struct("folder_rank", "name")).alias("f")).where("f is not null").select("f.*")


def cached(spark: SparkSession, folder: str, parameters: dict, make) -> DataFrame:
    """The result of ``make()`` kept as Parquet under the hash of its parameters, and read from there the next time."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{folder.rstrip('/')}/{key}"
    files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file as a row: path, text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
