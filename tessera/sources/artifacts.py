"""Sinks of whole artifacts: published files, stores, matrices, bundles and sealed reports. Logs and moves are in ledger.py.

What is published appears whole or not at all: it is written beside its place, synced and renamed. Paths are of a folder
that the driver sees, as these are the small documents and the files of one library; tables go through DataFrame writers.
"""

from __future__ import annotations

import csv
import hashlib
import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import same_sets


def sha256_of(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def publish(path: str | Path, data: bytes) -> str:
    """Writes a file whole and returns its digest."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.tmp")
    with beside.open("wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)
    return hashlib.sha256(data).hexdigest()


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


class Store:
    """Manifest rows that are replaced whole, settings that are updated by key, timings that are appended."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str) -> DataFrame | None:
        at = Path(f"{self.root}/{name}.json")
        return self.spark.read.parquet(json.loads(at.read_text())["table"]) if at.exists() else None

    def replace(self, name: str, rows: DataFrame) -> None:
        """The new table is written beside the old one, and one small file says which counts."""
        old = Path(f"{self.root}/{name}.json")
        n = json.loads(old.read_text())["version"] + 1 if old.exists() else 1
        table = f"{self.root}/{name}-{n}"
        rows.write.mode("overwrite").parquet(table)
        publish(old, canonical({"version": n, "table": table}))

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        old = self._read(name)
        self.replace(name, rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def read(self, name: str) -> DataFrame:
        got = self._read(name)
        return got if got is not None else self.spark.read.parquet(f"{self.root}/{name}")


def keep_contents(rows: DataFrame, root: str) -> DataFrame:
    """sha256 of the contents (column content) that are kept under their digests; what is there already is left alone. root is shared by all executors."""

    def run(batches):
        import pandas as pd

        for b in batches:
            names = []
            for data in b["content"]:
                name = hashlib.sha256(data).hexdigest()
                at = os.path.join(root, name[:2], name)
                if not os.path.exists(at):
                    os.makedirs(os.path.dirname(at), exist_ok=True)
                    beside = f"{at}.{os.getpid()}"
                    with open(beside, "wb") as f:
                        f.write(data)
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(beside, at)
                names.append(name)
            yield pd.DataFrame({"sha256": names})

    return rows.select("content").mapInPandas(run, "sha256 string")


def kept_contents(spark: SparkSession, root: str) -> DataFrame:
    """sha256, content of what is kept, without files that aren't what they are named by."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return d.select(F.regexp_extract("path", "([0-9a-f]{64})$", 1).alias("sha256"), "content").filter(F.sha2("content", 256) == F.col("sha256"))


def save_matrix(rows: DataFrame, path: str | Path, dtype: str = "<f2") -> tuple[str, list[str]]:
    """Writes vectors (id, v) in order of id as one matrix file, and returns its digest and ids; rows pass the driver one partition after the other."""
    path = Path(path)
    n, width = rows.count(), len(rows.first()["v"])
    head = np.lib.format.header_data_from_array_1_0(np.empty((0, width), dtype)) | {"shape": (n, width)}
    digest, ids, beside = hashlib.sha256(), [], path.with_name(f".{path.name}.tmp")
    with beside.open("wb") as f:
        np.lib.format.write_array_header_1_0(f, head)
        for r in rows.select("id", "v").sort("id").toLocalIterator(True):
            f.write(np.asarray(r["v"], dtype).tobytes())
            ids.append(r["id"])
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)
    with path.open("rb") as f:
        digest = hashlib.file_digest(f, "sha256")
    return digest.hexdigest(), ids


def export_bundle(tables: dict[str, DataFrame], root: str) -> dict:
    """Writes all tables and a manifest of their rows and schemas."""
    manifest = {}
    for name, df in tables.items():
        df.write.parquet(f"{root}/{name}")
        manifest[name] = {"rows": df.sparkSession.read.parquet(f"{root}/{name}").count(), "schema": df.schema.simpleString()}
    publish(f"{root}/bundle.json", canonical(manifest))
    return manifest


def restore_bundle(spark: SparkSession, root: str, to: str) -> dict[str, DataFrame]:
    """Copies a bundle into an empty folder and checks that what was restored is what was saved."""
    if Path(to).exists() and any(Path(to).iterdir()):
        raise ValueError(f"{to} isn't empty")
    out = {}
    for name, want in json.loads(Path(f"{root}/bundle.json").read_text()).items():
        there = spark.read.parquet(f"{root}/{name}")
        there.write.parquet(f"{to}/{name}")
        out[name] = spark.read.parquet(f"{to}/{name}")
        if out[name].count() != want["rows"] or out[name].schema.simpleString() != want["schema"] or not same_sets(there, out[name]).first()["same"]:
            raise ValueError(f"{name} isn't what was saved")
    return out


def export_memory(memory: DataFrame, path: str | Path, corpus: str, profile: str) -> str:
    rows = [r.asDict(True) for r in memory.sort(memory.columns[0]).toLocalIterator()]
    return publish(path, canonical({"corpus": corpus, "profile": profile, "memory": rows}))


def import_memory(spark: SparkSession, path: str | Path, schema: str, corpus: str, profile: str) -> DataFrame:
    """A saved memory, if it is of this corpus and profile."""
    d = json.loads(Path(path).read_text())
    if (d["corpus"], d["profile"]) != (corpus, profile):
        raise ValueError("a memory of another corpus or profile")
    return spark.createDataFrame([(json.dumps(r),) for r in d["memory"]], "t string").select(F.from_json("t", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def seal_report(report: dict, root: str | Path, artifacts: list[str]) -> dict:
    """Publishes a report with the digests of its artifacts and a seal over both."""
    body = report | {"artifacts": {a: sha256_of(Path(root) / a) for a in sorted(artifacts)}}
    body["seal"] = hashlib.sha256(canonical(body)).hexdigest()
    publish(Path(root) / "report.json", canonical(body))
    return body


def opened_report(root: str | Path) -> dict:
    """A sealed report, if the seal and all artifacts are as they were."""
    body = json.loads((Path(root) / "report.json").read_text())
    seal = body.pop("seal")
    if seal != hashlib.sha256(canonical(body)).hexdigest():
        raise ValueError("the report isn't what was sealed")
    for a, digest in body["artifacts"].items():
        if not (Path(root) / a).exists() or sha256_of(Path(root) / a) != digest:
            raise ValueError(f"{a} isn't what was sealed")
    return body


def report_files(rows: DataFrame, columns: list[str], summary: dict, root: str | Path, title: str) -> None:
    """rows.csv (a line for each row, every cell quoted), summary.json and report.md; rows pass the driver one partition after the other."""
    root = Path(root)
    root.mkdir(parents=True, exist_ok=True)
    beside = root / ".rows.csv.tmp"
    with beside.open("w", encoding="utf-8", newline="") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL)
        w.writerow(columns)
        for r in rows.select(*columns).toLocalIterator():
            w.writerow(["" if v is None else v for v in r])
    os.replace(beside, root / "rows.csv")
    publish(root / "summary.json", canonical(summary))
    lines = [f"# {title}", "", "| measure | value |", "|-|-:|", *(f"| {k} | {v} |" for k, v in sorted(summary.items()))]
    publish(root / "report.md", ("\n".join(lines) + "\n").encode())
