"""The versioned store of videos, use cases and their audit trail, on Parquet folders.

Every change writes new versions of the tables it touches beside the old ones; nothing is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.functions import text as T
from chronolith.operators import entities, reports
from chronolith.sources import files, sinks

VIDEOS = "video_id string, file_name string, title string, status string, parent_video_id string, duration_seconds double, version int, processed_at string, functionalities array<string>, use_cases array<string>, ord bigint"
USE_CASES = f"use_case_id string, name string, status string, actor string, objective string, flow string, trigger string, confidence string, version int, functionalities array<string>, business_rules array<string>, evidence array<{files.EVIDENCE}>, ord bigint"
OUTPUTS = "output string, video_fuente string, tema_canonico string, tema string, slug string, origen string, duracion_s double, piel_max double, fecha string, ord bigint"
PROCESSED = "video string, video_id string, discovery string, duration_seconds double, objetivo array<string>, capsulas array<string>, casos_nuevos array<string>, procesado boolean, sin_casos_nuevos boolean, registrado string, actualizado string, eliminado string, ord bigint"
AUDIT = "date string, action string, entity string, reason string, previous string"
SCHEMAS = {"videos": VIDEOS, "use_cases": USE_CASES, "audit": AUDIT, "outputs": OUTPUTS, "processed": PROCESSED}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len([s for s in fs.listStatus(path) if s.getPath().getName().startswith("v=")]) if fs.exists(path) else 0

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """The latest version of a table, or a given one; without any, no rows."""
        n = version or self._versions(name)
        if not n:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}/v={n:06d}")

    def save(self, **tables: DataFrame) -> None:
        for name, df in tables.items():
            columns = self.spark.createDataFrame([], SCHEMAS[name]).schema
            whole = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns.fields])
            sinks.save_version(whole, f"{self.folder}/{name}", self._versions(name) + 1)

    def _now(self):
        return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")

    def _logged(self, *events: DataFrame) -> DataFrame:
        out = self.table("audit")
        for e in events:
            out = out.unionByName(e)
        return out

    def import_memory(self, path: str) -> None:
        """Take over a store kept as one JSON document."""
        memory = files.read_memory(self.spark, path)
        history = memory.select(F.explode("analysis_history").alias("e")).select("e.date", "e.action", "e.entity", "e.reason", F.to_json("e.previous_version_snapshot").alias("previous"))
        self.save(videos=files.entities(memory, "videos"), use_cases=files.entities(memory, "use_cases"), audit=history)

    def videos_of(self, paths: list[str], seconds: dict[str, float] | None = None) -> DataFrame:
        """video_id, file_name, duration_seconds of files; lengths are given, as media aren't read here."""
        content = self.spark.read.format("binaryFile").load(paths)
        name = F.regexp_extract("path", r"([^/]*)$", 1)
        known = self.spark.createDataFrame(list((seconds or {}).items()), "file_name string, s double")
        out = content.select(entities.content_id(F.col("content")).alias("video_id"), name.alias("file_name"))
        return out.join(F.broadcast(known), "file_name", "left").select("video_id", "file_name", F.coalesce("s", F.lit(0.0)).alias("duration_seconds"))

    def check_videos(self, new: DataFrame) -> DataFrame:
        return entities.classify_videos(new, self.table("videos"))

    def register_videos(self, new: DataFrame) -> DataFrame:
        """Insert those whose content isn't known; the others stay as they are. Returns the new ones."""
        known = self.table("videos")
        fresh = new.dropDuplicates(["video_id"]).join(known, "video_id", "left_anti")
        given = lambda c, default: F.coalesce(c, default) if c in fresh.columns else default
        parent = given("parent_video_id", F.lit(None).cast("string"))
        fresh = fresh.withColumn("title", given("title", T.stem(F.col("file_name")))).withColumn("version", given("version", F.lit(1))).withColumn("parent_video_id", parent)
        fresh = fresh.withColumn("status", F.when(F.col("parent_video_id").isNull(), "PROCESSED").otherwise("NEW_VERSION")).withColumn("processed_at", self._now())
        fresh = fresh.withColumn("ord", F.monotonically_increasing_id() + F.lit(known.count()))
        none = F.array().cast("array<string>")
        fresh = fresh.withColumn("functionalities", given("functionalities", none)).withColumn("use_cases", given("use_cases", none))
        event = entities.audit_of(fresh, "CREATED", "video_id", F.concat(F.lit("Video registrado: "), "file_name"), self._now())
        self.save(videos=known.unionByName(fresh.select(*known.columns)), audit=self._logged(event))
        return fresh

    def match(self, candidates: DataFrame, blocked: bool = False) -> DataFrame:
        """Best stored use case of each candidate; every pair is compared unless ``blocked`` by words of the names."""
        words = entities.name_words() if blocked else None
        return entities.match_use_cases(candidates, self.table("use_cases"), words, words)

    def add_use_cases(self, candidates: DataFrame, force: bool = False) -> DataFrame:
        """Candidates (cand_id, fields, business_rules, evidence, confidence) become use cases, or evidence of their match."""
        store, now = self.table("use_cases"), self._now()
        matches = self.match(candidates)
        fresh, more = reports.added_use_cases(candidates, matches, store, force)
        made = fresh.withColumn("version", F.lit(1)).withColumn("status", F.lit("ACTIVE")).withColumn("ord", F.regexp_extract("use_case_id", r"(\d+)$", 1).cast("long"))
        items = more.select("use_case_id", F.posexplode("evidence").alias("ord", "item"))
        kept, _ = entities.add_evidence(store, items)
        created = entities.audit_of(made, "CREATED", "use_case_id", F.concat(F.lit("Nuevo caso de uso: "), "name"), now)
        noted = entities.audit_of(more, "EVIDENCE_ADDED", "use_case_id", F.lit("Nueva evidencia"), now)
        self.save(use_cases=kept.unionByName(made.select(*store.columns)), audit=self._logged(created, noted))
        return matches

    def add_evidence(self, evidence: DataFrame) -> DataFrame:
        """Append evidence (use_case_id, ord, item); returns the rows whose use case isn't there."""
        kept, lost = entities.add_evidence(self.table("use_cases"), evidence)
        noted = entities.audit_of(evidence.join(lost.select("use_case_id"), "use_case_id", "left_anti"), "EVIDENCE_ADDED", "use_case_id", F.lit("Nueva evidencia"), self._now())
        missing = lost.collect()
        self.save(use_cases=kept, audit=self._logged(noted))
        return self.spark.createDataFrame(missing, lost.schema)

    def update_use_cases(self, changes: DataFrame) -> None:
        new, events = entities.update_use_cases(self.table("use_cases"), changes, self._now())
        self.save(use_cases=new, audit=self._logged(events))

    def history(self, entity: str | None = None) -> DataFrame:
        return reports.history(self.table("audit"), entity)
