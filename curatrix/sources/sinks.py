"""Writing documents, datasets and state. Every write is a new version; the catalog's commits name those that hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.operators.accounts import export_payload, ordered_avatars


def write_document(one_row: DataFrame, path: str, column: str = "payload") -> None:
    """A document of one row as one text file."""
    one_row.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_bytes(spark: SparkSession, path: str, body: bytes) -> None:
    """A small file as it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(body))
    out.close()


def write_named(documents: DataFrame, folder: str) -> DataFrame:
    """The paths of documents (name, payload), each written as a file of its own under a folder that all tasks share. A file gets
    its name when it is whole, so a task that runs again writes the same."""

    def run(batches):
        import uuid

        import pandas as pd
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for batch in batches:
            for name, payload in zip(batch["name"], batch["payload"]):
                aside = f"{root}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(aside) as out:
                    out.write(payload.encode())
                files.move(aside, f"{root}/{name}")
            yield pd.DataFrame({"path": [f"{folder.rstrip('/')}/{n}" for n in batch["name"]]})

    return documents.select("name", "payload").mapInPandas(run, "path string")


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_entries(entries: DataFrame, path: str) -> None:
    """Dataset entries in a folder for each split."""
    entries.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("split").json(path)


def write_version(state: DataFrame, root: str, version: str) -> str:
    """A relation's next version beside the ones before; a version is never written twice."""
    path = f"{root.rstrip('/')}/version={version}"
    state.write.mode("errorifexists").parquet(path)
    return path


def comparison_table(rows: DataFrame) -> str:
    """Columns of fixed width; rows: a line for each run, so few."""
    head = list(rows.columns)
    body = [[f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows.collect()]
    width = [max(len(x) for x in column) for column in zip(head, *body)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width)).rstrip() for line in [head, *body])


#: Avatars that an export holds in one document; more are written as lines.
DOCUMENT_ROWS = 100_000


def write_export(avatars: DataFrame, exported_at: str, path: str, most: int = DOCUMENT_ROWS) -> bool:
    """The export as one document, as the contract has it, if it has at most so many avatars, which are counted; else as JSON
    lines in the same order. Returns whether it is one document."""
    whole = avatars.limit(most + 1).count() <= most
    if whole:
        write_document(export_payload(avatars, exported_at), path)
    else:
        write_jsonl(ordered_avatars(avatars), path)
    return whole
