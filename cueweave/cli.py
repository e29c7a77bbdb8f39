"""The engine from a shell: `cueweave process URL`, `process-sources FILE`, `process-both-sources`, `manifest`, `inspect`, `push-data`, `pull-data` and others."""

from __future__ import annotations

import argparse
import importlib
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.text import wanted_statuses
from .plans import process as way
from .sources import kernels, lists, manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cueweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *takes: str, profile: bool = False) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--config", "-c")
        c.add_argument("--kernels", action="append", default=[], help="a module that registers media kernels when it is imported")
        for t in takes:
            c.add_argument(t)
        if profile:
            c.add_argument("--force", action="store_true")
            c.add_argument("--profile", choices=sorted(config.PROFILES), default="no_voiceover")
        return c

    command("process", "url", profile=True)
    command("process-playlist", "url", profile=True)
    command("process-local", "path", profile=True)
    command("process-sources", "path", profile=True)
    c = command("process-both-sources", profile=True)
    c.add_argument("--plain", default="sources_no_voiceover.txt")
    c.add_argument("--voiced", default="sources_voiceover.txt")
    command("check-downloader", "url")
    command("check-asr", "path")
    command("manifest")
    command("inspect").add_argument("--limit", "-n", type=int, default=20)
    for name in ("push-data", "pull-data"):
        c = command(name)
        c.add_argument("--repo", help="root of the shared table")
        c.add_argument("--contributor")
        if name == "push-data":
            c.add_argument("--include", default="accepted,review")
        else:
            c.add_argument("--dest", default="data_cloud")
    return p


def _records(spark: SparkSession, folder: str):
    return manifest.read_records(spark, f"{folder}/manifests/all.jsonl", lines=True)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if all went well, 1 if some sources failed; those that didn't are kept."""
    a = parser().parse_args(args)
    for name in a.kernels:
        importlib.import_module(name)
    settings = config.load(a.config)
    spark = spark or SparkSession.builder.appName("cueweave").getOrCreate()
    folder = settings.workspace
    if a.command.startswith("process"):
        if a.command == "process-both-sources":
            failed = list(way.both(spark, a.plain, a.voiced, settings, folder, force=a.force).values())
        else:
            if a.command == "process-sources":
                rows = way.sources(spark, a.path)
            elif a.command == "process-local":
                rows = lists.local_items(spark, a.path).select(F.col("path").alias("url"), F.lit(False).alias("playlist"))
            else:
                rows = spark.createDataFrame([(a.url, a.command == "process-playlist")], "url string, playlist boolean")
            failed = [way.process(spark, rows, settings, a.profile, folder, force=a.force)[1]]
        bad = [r for f in failed for r in f.limit(100).collect()]
        for r in bad:
            print(f"- {r.stage} {r.item_id}: {r.error}")
        print(f"Done: {folder}")
        return int(bool(bad))
    if a.command in ("check-downloader", "check-asr"):
        name, column, value = ("fetch", "url", a.url) if a.command == "check-downloader" else ("transcribe", "normalized", a.path)
        r = kernels.run(spark.createDataFrame([(value, False)], f"{column} string, playlist boolean"), name, keys=[column], inputs=[column, "playlist"]).first()
        print("OK" if r.ok else f"FAILED: {r.error}")
        return int(not r.ok)
    if a.command == "manifest":
        rows = _records(spark, folder).persist()
        print(f"Wrote {rows.count()} records")
        manifest.publish(rows, f"{folder}/manifests-rebuilt")
        rows.unpersist()
    elif a.command == "inspect":
        for r in manifest.head(manifest.flat(_records(spark, folder)), a.limit).collect():
            print(f"[{r.verdict}] {r.item_id}/{r.segment_id} | {r.text}")
    elif a.command == "push-data":
        root = config.first_of(a.repo, os.environ.get("CUEWEAVE_SHARED"))
        if not root:
            raise SystemExit("name the shared table with --repo")
        statuses = spark.range(1).select(wanted_statuses(a.include).alias("s")).first().s
        manifest.push(_records(spark, folder), root, config.first_of(a.contributor, os.environ.get("USER"), "unknown"), statuses)
        print(f"Pushed: {root}")
    elif a.command == "pull-data":
        root = config.first_of(a.repo, os.environ.get("CUEWEAVE_SHARED"))
        if not root:
            raise SystemExit("name the shared table with --repo")
        manifest.pull(spark, root, a.contributor).write.mode("overwrite").parquet(a.dest)
        print(f"Pulled into: {a.dest}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
