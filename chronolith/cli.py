"""Command line of the store, the registry and the gate; results are lines of JSON.

    python -m chronolith.cli --store FOLDER check-video --video FILE --seconds 61
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators import gate
from chronolith.sources import sinks
from chronolith.registry import Registry
from chronolith.store import Store


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronolith")
    top.add_argument("--store", default="store")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, *flags, required=()):
        p = sub.add_parser(name)
        for flag in (*required, *flags):
            many = flag.endswith("*")
            p.add_argument("--" + flag.rstrip("*"), required=flag in required, action="append" if many else "store", default=[] if many else None)
        return p

    fields = ("objective", "actor", "flow", "trigger", "functionality*")
    command("import", required=("memory",))
    command("check-video", "seconds", required=("video",))
    command("register-video", "seconds", "title", "functionalities", "use-cases", "parent-video-id", "version", required=("video",))
    command("match-use-case", *fields, required=("name",))
    p = command("add-use-case", *fields, "business-rule*", "screenshot*", "confidence", required=("name", "video", "ts-start", "ts-end"))
    p.add_argument("--force-new", action="store_true")
    command("add-evidence", "screenshot*", required=("use-case", "video", "ts-start", "ts-end"))
    command("update-use-case", "name", "objective", "flow", "business-rule*", "confidence", required=("use-case", "reason"))
    command("list-videos"), command("list-use-cases"), command("history", "entity")
    command("verify", required=("checks",))
    folders = ("videos", "made", "discovery")
    command("import-registry", required=("registry",))
    command("more-cases", *folders), command("list", "made"), command("identify", "seconds", required=("video",))
    command("record-videos", *folders, "seconds*"), command("deletable", *folders)
    command("delete-video", "videos", required=("name",)).add_argument("--yes", action="store_true")
    command("record", "output", "video", "dur", "skin", required=("topic",))
    return top


def _list(text: str | None) -> list[str] | None:
    return [x.strip() for x in text.split(",")] if text else None


def run(spark: SparkSession, argv: list[str]) -> tuple[int, list[str]]:
    """(exit code, lines of JSON) of a command."""
    a = _parser().parse_args(argv)
    store = Store(spark, a.store)
    shown = lambda df: [r["value"] for r in sinks.json_lines(df).collect()]
    if a.command in _REGISTRY:
        return _registry(spark, a, shown)
    if a.command == "import":
        store.import_memory(a.memory)
        return 0, []
    if a.command in ("check-video", "register-video"):
        name = a.video.rpartition("/")[2]
        new = store.videos_of([a.video], {name: float(a.seconds)} if a.seconds else None)
        if a.command == "check-video":
            return 0, shown(store.check_videos(new))
        extra = {"title": a.title, "parent_video_id": a.parent_video_id, "version": int(a.version) if a.version else None}
        new = new.withColumns({k: F.lit(v) for k, v in extra.items() if v is not None})
        lists = {"functionalities": _list(a.functionalities), "use_cases": _list(a.use_cases)}
        new = new.withColumns({k: F.array(*map(F.lit, v)) for k, v in lists.items() if v})
        ids = [r["video_id"] for r in new.select("video_id").collect()]
        store.register_videos(new)
        return 0, shown(store.table("videos").where(F.col("video_id").isin(ids)))
    if a.command in ("match-use-case", "add-use-case"):
        candidate = _candidate(spark, a)
        if a.command == "match-use-case":
            return 0, shown(store.match(candidate))
        return 0, shown(store.add_use_cases(candidate, a.force_new))
    if a.command == "add-evidence":
        rows = [(a.use_case, 0, (a.video, a.ts_start, a.ts_end, a.screenshot))]
        lost = store.add_evidence(spark.createDataFrame(rows, f"use_case_id string, ord bigint, item {_EVIDENCE}"))
        return _found(store, lost, a.use_case, shown)
    if a.command == "update-use-case":
        if store.table("use_cases").where(F.col("use_case_id") == a.use_case).isEmpty():
            return 1, [f'{{"error":"No existe {a.use_case}"}}']
        row = (a.use_case, a.reason, a.name, a.objective, a.flow, a.business_rule or None, a.confidence)
        store.update_use_cases(spark.createDataFrame([row], "use_case_id string, reason string, name string, objective string, flow string, business_rules array<string>, confidence string"))
        return 0, shown(store.table("use_cases").where(F.col("use_case_id") == a.use_case))
    if a.command == "verify":
        results = gate.verify(spark.read.schema("name string, exists boolean, seconds double, width int, height int, vcodec string, acodec string, people_samples int").json(a.checks))
        total = gate.overall(results)
        return (2 if total.first()["verdict"] == gate.FAIL else 0), shown(results) + shown(total)
    if a.command == "history":
        return 0, shown(store.history(a.entity))
    return 0, shown(store.table(a.command.removeprefix("list-").replace("-", "_")).orderBy("ord"))


_REGISTRY = ("import-registry", "more-cases", "list", "identify", "record-videos", "deletable", "delete-video", "record")


def _registry(spark: SparkSession, a, shown) -> tuple[int, list[str]]:
    registry = Registry(spark, a.store, *(getattr(a, f, None) for f in ("videos", "made", "discovery")))
    if a.command == "import-registry":
        registry.import_registry(a.registry)
        return 0, []
    if a.command == "list":
        return 0, shown(registry.sync().orderBy("ord").select("tema_canonico", "output"))
    if a.command == "identify":
        return 0, shown(registry.identify(a.video, float(a.seconds) if a.seconds else None))
    if a.command == "record":
        registry.record(a.topic, a.output, a.video, *(float(x) if x else None for x in (a.dur, a.skin)))
        return 0, []
    if a.command == "delete-video":
        decision = registry.delete_video(a.name, a.yes)
        return int(decision.startswith("BLOCKED")), [json.dumps({"video": a.name, "decision": decision})]
    if a.command == "record-videos":
        lengths = {name: float(n) for name, _, n in (x.rpartition("=") for x in a.seconds)}
        return 0, shown(registry.record_videos(lengths or None).orderBy("video"))
    registry.sync()
    if a.command == "deletable":
        return 0, shown(registry.report().orderBy(F.col("sin_casos_nuevos").desc(), "video"))
    return 0, shown(registry.cases().orderBy("video", "topic")) + shown(registry.more_cases().orderBy(F.col("mentions").desc(), "topic").withColumn("candidate", F.lit(True)))


_EVIDENCE = "struct<video_id:string,timestamp_start:string,timestamp_end:string,screenshot_ids:array<string>>"


def _candidate(spark: SparkSession, a) -> DataFrame:
    evidence = [(a.video, a.ts_start, a.ts_end, a.screenshot)] if a.command == "add-use-case" else []
    rules = a.business_rule if a.command == "add-use-case" else []
    confidence = (a.confidence or "MEDIUM") if a.command == "add-use-case" else None
    row = ("new", a.name, a.objective or "", a.actor or "", a.flow or "", a.trigger or "", a.functionality, rules, evidence, confidence)
    return spark.createDataFrame([row], f"cand_id string, name string, objective string, actor string, flow string, trigger string, functionalities array<string>, business_rules array<string>, evidence array<{_EVIDENCE}>, confidence string")


def _found(store: Store, lost: DataFrame, key: str, shown) -> tuple[int, list[str]]:
    if not lost.isEmpty():
        return 1, [f'{{"error":"No existe {key}"}}']
    return 0, shown(store.table("use_cases").where(F.col("use_case_id") == key))


def main() -> int:
    spark = SparkSession.builder.appName("chronolith").getOrCreate()
    code, lines = run(spark, sys.argv[1:])
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    raise SystemExit(main())
