"""The loop's commands on a command line: python -m curatrix CATALOG COMMAND ..., under spark-submit on a cluster.

Tables are Parquet folders. A run's model and summary are files under the catalog, so that its threshold is known to the queues.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from curatrix.functions import image
from curatrix.plans import commands
from curatrix.sources import fetch, manifests, sinks

#: Rows that are printed at most; more are written with --out.
PRINTED = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="curatrix", description=__doc__)
    p.add_argument("catalog")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: tuple, **options: type) -> None:
        c = sub.add_parser(name)
        for a in arguments:
            c.add_argument(a)
        for option, kind in options.items():
            flag = "--" + option.replace("_", "-")
            c.add_argument(flag, action="store_true") if kind is bool else c.add_argument(flag, type=kind)

    command("ingest", "folder", force=bool)
    command("download-avatars", retry_failed=bool, limit=int)
    command("download-collections", "wanted", "existing", "out", force=bool)
    command("fingerprint", "files", "out", size=int)
    command("build-dataset", "fingerprints", "collections", "path", seed=int)
    command("embed", "files", "out", size=int)
    command("train", "entries", "embeddings", "run_id", floor=float, epochs=int, size=int)
    command("evaluate", "scored", "thresholds", "baseline", eval_set=str)
    command("export-errors", "scored", "category", "path", threshold=float)
    command("score", "scored", "run_id", threshold=float, limit=int, no_relabel=bool)
    command("export-model", "run_id", threshold=float)
    command("check-picture", "input", run_id=str, threshold=float)
    command("summary", run_id=str)
    command("queue", "name", run_id=str, limit=int, out=str)
    command("label", "sha256", "label", notes=str)
    command("undo")
    command("vacuum", keep=int)
    return p


def _review(c: commands.Catalog, run_id: str | None) -> commands.Review:
    return commands.Review(c, commands.known_thresholds(c), run_id)


def run(spark: SparkSession, arguments: list[str]) -> str:
    """What a command prints; tables of a page or less as JSON lines."""
    a = parser().parse_args(arguments)
    c = commands.Catalog(spark, a.catalog)
    lines = lambda df: "\n".join(df.toJSON().collect())

    def table(path: str) -> DataFrame:
        return spark.read.parquet(path)

    def files(path: str) -> DataFrame:
        return spark.read.format("binaryFile").load(path)

    match a.command:
        case "ingest":
            return f"{commands.ingest(c, a.folder, force=a.force)} ingested"
        case "download-avatars":
            commands.download_avatars(c, fetch.http_get, a.retry_failed, a.limit)
            return lines(c.read("avatar_urls").groupBy("download_status").count().orderBy("download_status"))
        case "download-collections":
            commands.download_collections(c, table(a.wanted), table(a.existing), fetch.http_get, a.force).write.parquet(a.out)
            return a.out
        case "fingerprint":
            image.fingerprints(files(a.files), a.size or 128).write.parquet(a.out)
            return a.out
        case "embed":
            image.embeddings(files(a.files), commands.picture_config(a.size)).withColumnRenamed("path", "id").write.parquet(a.out)
            return a.out
        case "train":
            _, summary = commands.train_run(c, table(a.entries), table(a.embeddings), a.run_id, 0.995 if a.floor is None else a.floor, a.epochs or 15, a.size)
            return json.dumps(summary)
        case "check-picture":
            return json.dumps(commands.check_run(c, a.input, a.run_id, a.threshold))
        case "build-dataset":
            given = commands.build_dataset(c, table(a.fingerprints), table(a.collections), a.path, seed=7 if a.seed is None else a.seed)
            return lines(given.groupBy("split").count().orderBy("split"))
        case "evaluate":
            thresholds = {r["run_id"]: r["threshold"] for r in manifests.run_thresholds(table(a.thresholds)).collect()}  # one row a run
            return sinks.comparison_table(commands.evaluate(table(a.scored), thresholds, a.baseline, a.eval_set or "blind"))
        case "export-errors":
            sinks.write_jsonl(commands.export_errors(table(a.scored), a.threshold, a.category), a.path)
            return a.path
        case "score":
            commands.score(c, table(a.scored), a.run_id, a.threshold, a.limit, not a.no_relabel)
            return "scored"
        case "export-model":
            return commands.export_model(a.run_id, a.threshold)
        case "summary":
            return lines(_review(c, a.run_id).summary())
        case "queue":
            rows = _review(c, a.run_id).queue_grid(a.name, a.limit if a.out else a.limit or 9)[1].select("sha256", "label", "score", "seen_count")
            if a.out:
                sinks.write_jsonl(rows, a.out)
                return a.out
            if (a.limit or 0) > PRINTED:
                raise SystemExit(f"more than {PRINTED} rows are written with --out")
            return lines(rows)
        case "vacuum":
            return "\n".join(c.vacuum(a.keep or 1))
        case "label":
            _review(c, None).label(a.sha256, a.label, a.notes)
            return json.dumps({"sha256": a.sha256, "label": a.label})
        case _:
            _review(c, None).undo()
            return "undone"


if __name__ == "__main__":
    import sys

    print(run(SparkSession.builder.appName("curatrix").getOrCreate(), sys.argv[1:]))
