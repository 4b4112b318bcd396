"""The registry of produced outputs and processed videos, beside the store: more cases, records, guarded deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.functions import rules
from chronolith.functions import text as T
from chronolith.operators import entities, reports, topics
from chronolith.sources import files, transcripts
from chronolith.store import Store

#: The file of a discovery folder that lists its cases, and the kind of files that are videos; fixed values.
CASES_FILE = "03_casos_de_uso.md"
VIDEO_FILES = "*.mp4"


class Registry(Store):
    """Folders: ``videos`` of source files, ``made`` of outputs, ``discovery`` with a folder of reports for each video."""

    def __init__(self, spark, folder: str, videos: str | None = None, made: str | None = None, discovery: str | None = None):
        super().__init__(spark, folder)
        self.videos, self.made, self.discovery = videos, made, discovery

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _exists(self, name: str | None) -> bool:
        return bool(name) and self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._path(name))

    def _names(self, folder: str | None) -> DataFrame:
        found = files.listing(self.spark, folder, VIDEO_FILES) if self._exists(folder) else self.spark.createDataFrame([], "name string")
        return found.select("name")

    def import_registry(self, path: str) -> None:
        """Take over a registry kept as one JSON document."""
        old = files.read_registry(self.spark, path)
        self.save(outputs=files.entities(old, "capsulas"), processed=files.entities(old, "videos_procesados"))

    def outputs(self) -> DataFrame:
        """The registered outputs and those in the folder that aren't registered yet, after them by name."""
        known = self.table("outputs")
        there = self._names(self.made).where(F.col("name").rlike(f"^(?:{'|'.join(entities.OUTPUT_PREFIXES)})")).withColumnRenamed("name", "output")
        new = entities.missing_outputs(known.select("output").where("output is not null"), there)
        last = known.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
        new = entities.global_rank(new, ["output"], "place").crossJoin(F.broadcast(last)).withColumn("ord", F.col("last") + 1 + F.col("place"))
        today = F.date_format(F.current_date(), "yyyy-MM-dd")
        new = new.select("output", F.col("topic").alias("tema_canonico"), "slug", F.col("origin").alias("origen"), today.alias("fecha"), "ord")
        return known.unionByName(new, allowMissingColumns=True)

    def sync(self) -> DataFrame:
        self.save(outputs=self.outputs())
        return self.table("outputs")

    def record(self, topic: str, output: str | None, video: str | None, seconds: float | None, skin: float | None) -> None:
        """Register an output; an entry of the same name is replaced."""
        name = lambda path: path.rpartition("/")[2] if path else None
        known = self.table("outputs")
        row = self.spark.createDataFrame([(name(output), name(video), topic, seconds, skin)], "output string, video_fuente string, tema string, duracion_s double, piel_max double")
        row = row.withColumn("tema_canonico", F.coalesce(rules.canonical_topic(F.col("tema")), "tema")).withColumn("origen", F.lit("record")).withColumn("fecha", F.date_format(F.current_date(), "yyyy-MM-dd"))
        row = row.crossJoin(known.agg((F.coalesce(F.max("ord"), F.lit(-1)) + 1).alias("ord")))
        kept = known.where(~F.coalesce(F.col("output") == F.lit(name(output)), F.lit(False)))
        self.save(outputs=kept.unionByName(row, allowMissingColumns=True))

    def covered(self) -> DataFrame:
        return topics.covered_topics(self._topics(), "ord")

    def _topics(self) -> DataFrame:
        return self.outputs().select("output", F.col("tema_canonico").alias("topic"), F.coalesce("slug", F.lit("")).alias("slug"), "ord", "video_fuente")

    def cases(self) -> DataFrame:
        """Cases of every video's discovery report, and which of them are new (focus)."""
        videos = self._names(self.videos).select(T.stem(F.col("name")).alias("video"))
        if not self._exists(self.discovery):
            found = self.spark.createDataFrame([], "folder string, ord int, topic string, interval string, mentions int")
        else:
            texts = files.whole_texts(self.spark, f"{self.discovery.rstrip('/')}/*/{CASES_FILE}")
            found = transcripts.discovery_cases(texts.select(F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), "text"), "folder")
        return reports.open_cases(videos, found.select("folder").distinct(), found, self._topics())

    def more_cases(self) -> DataFrame:
        """New cases, one for each topic: the one of most mentions, then of the first video."""
        return topics.best_candidates(self.cases().where("focus = 'new'"), ["video", "interval"])

    def claims(self) -> DataFrame:
        """video (stem) and output: by the source the output names, or else by the most specific name."""
        stems = self._names(self.videos).select(T.stem(F.col("name")).alias("video"))
        made = self.outputs().where("output is not null").select("output", "video_fuente")
        key = lambda c: F.array_sort(T.tokens(c))
        told = made.where("video_fuente is not null and video_fuente <> ''").withColumn("k", key(T.stem(F.col("video_fuente"))))
        told = told.join(stems.withColumn("k", key(F.col("video"))), "k").select("video", "output")
        bare = F.regexp_replace(F.regexp_replace(T.stem(F.col("output")), f"^(?:{'|'.join(sorted(entities.OUTPUT_PREFIXES, key=len, reverse=True))})", ""), r"-\d{2}-\d{2}-\d{4}$", "")
        rest = made.where("video_fuente is null or video_fuente = ''").select("output", bare.alias("bare"))
        return told.unionByName(entities.most_specific(rest, stems, "output", "bare", "video", "video").select("video", "output")).distinct()

    def report(self, seconds: dict[str, float] | None = None) -> DataFrame:
        """A row for each video of the folder, as it is recorded."""
        names = self._names(self.videos).withColumn("stem", T.stem(F.col("name")))
        cases = self.cases()
        told = reports.video_report(names.select(F.col("stem").alias("video")), cases, self.claims(), self._topics().select("output", "topic"))
        folder = cases.groupBy("video").agg(F.min("folder").alias("discovery"))
        out = names.join(told.withColumnRenamed("video", "stem"), "stem").join(folder.withColumnRenamed("video", "stem"), "stem", "left")
        if self._exists(self.videos):
            ids = self.videos_of([f"{self.videos.rstrip('/')}/{VIDEO_FILES}"], seconds).withColumnRenamed("file_name", "name")
            out = out.join(ids, "name", "left")
        else:
            out = out.withColumn("video_id", F.lit(None).cast("string")).withColumn("duration_seconds", F.lit(None).cast("double"))
        return out.select(
            F.col("name").alias("video"), "video_id", "discovery", "duration_seconds", F.col("objective").alias("objetivo"), F.col("outputs").alias("capsulas"),
            F.col("new_cases").alias("casos_nuevos"), F.col("processed").alias("procesado"), F.col("nothing_new").alias("sin_casos_nuevos"),
        )

    def record_videos(self, seconds: dict[str, float] | None = None) -> DataFrame:
        """Keep the report of every video; what was registered of videos that are gone stays."""
        names = {"registrado": "registered", "actualizado": "updated"}
        old = self.table("processed").withColumnsRenamed(names)
        merged = entities.merge_by_name(old, self.report(seconds), "video", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        self.save(processed=merged.withColumnsRenamed({v: k for k, v in names.items()}))
        return self.table("processed")

    def identify(self, video: str, seconds: float | None = None) -> DataFrame:
        """Status of a file by the recorded videos; the last one of a family is its newest version."""
        new = self.videos_of([video], {video.rpartition("/")[2]: seconds} if seconds else None)
        known = self.table("processed").select("video_id", F.col("video").alias("file_name"), "duration_seconds", F.lit(None).cast("int").alias("version"), F.coalesce("ord", F.xxhash64("video")).alias("ord"))
        return entities.classify_videos(new, known, latest_is_last=True).drop("suggested_version")

    def delete_video(self, name: str, confirmed: bool) -> str:
        """What was decided; the file goes only where it is recorded, has nothing new, and ``confirmed`` is given."""
        name = name.rpartition("/")[2]
        at = f"{(self.videos or '.').rstrip('/')}/{name}"
        recorded = self.table("processed")
        asked = self.spark.createDataFrame([(name, self._exists(at), confirmed)], "video string, present boolean, confirmed boolean")
        mine = recorded.select("video", F.lit(True).alias("registered"), F.col("procesado").alias("processed"), F.col("casos_nuevos").alias("new_cases"))
        none = F.array().cast("array<string>")
        row = asked.join(mine, "video", "left").select("video", "present", "confirmed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("registered", "processed")], F.coalesce("new_cases", none).alias("new_cases"))
        decision = entities.deletable(row).first()["decision"]
        if decision == "DELETE":
            self._path(at).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(self._path(at), False)
            gone = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
            self.save(processed=recorded.withColumn("eliminado", F.when(F.col("video") == name, gone).otherwise(F.col("eliminado"))))
        return decision
