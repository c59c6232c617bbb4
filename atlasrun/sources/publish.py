"""Published builds: tables are staged, checked as written, and come into force together by one small manifest file.

A folder holds ``builds/<id>/<table>`` and ``manifests/<number>.json``. Readers resolve the manifest with the greatest number, so they see
all tables of one build or all of the one before; a build that breaks off or breaks a rule never has a manifest.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import remove_folder
from .artifacts import write_table

Tables = dict[str, DataFrame]
#: Violations that a refusal names.
NAMED = 5


class BuildRefused(ValueError):
    """A build broke its rules; ``violations`` is the folder of the table that lists them."""

    def __init__(self, message: str, violations: str):
        super().__init__(message)
        self.violations = violations


def _store(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def _numbers(spark: SparkSession, path: str) -> list[int]:
    store, place = _store(spark, path)
    folder = place(f"{path}/manifests")
    names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
    return sorted(int(n.removesuffix(".json")) for n in names if re.fullmatch(r"\d+\.json", n))


def _commit(spark: SparkSession, path: str, number: int, manifest: dict) -> None:
    """Writes the manifest beside its place and renames it: it is there whole or not at all, and never over another one."""
    store, place = _store(spark, path)
    goal, draft = place(f"{path}/manifests/{number:010d}.json"), place(f"{path}/manifests/.{manifest['build']}.draft")
    out = store.create(draft, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    if store.exists(goal) or not store.rename(draft, goal):
        store.delete(draft, False)
        raise ValueError(f"another build was published as number {number} meanwhile")


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest in force: ``build``, ``number``, ``tables`` (folder and rows of each) and ``header``."""
    numbers = _numbers(spark, path)
    if not numbers:
        return None
    text = spark.read.text(f"{path}/manifests/{numbers[-1]:010d}.json", wholetext=True).first().value
    return {"number": numbers[-1], **json.loads(text)}


def read_published(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the build in force."""
    current = manifest(spark, path)
    if current is None or table not in current["tables"]:
        raise ValueError(f"no published table {table} in {path}")
    return spark.read.parquet(current["tables"][table]["folder"])


def publish(spark: SparkSession, path: str, build: str, tables: Tables, order: dict[str, list[str]], rules: Callable[[Tables], DataFrame], header: dict | None = None) -> dict:
    """Stage the tables of a build, hold the rules against what was written, and put it in force.

    ``order`` has the sort columns of each table. ``rules`` makes violations (``rule, entity, detail``) from the staged tables; with
    any, the build is refused, its violations are kept in its folder, and the last build stays in force. A build id is used once; staging it again after a failure starts anew.
    """
    last = manifest(spark, path)
    if last is not None and last["build"] == build:
        raise ValueError(f"build {build} is in force already")
    folder = f"{path}/builds/{build}"
    remove_folder(spark, folder)
    staged: Tables = {}
    for name, table in tables.items():
        write_table(table, f"{folder}/{name}", order=order[name])
        staged[name] = spark.read.schema(table.schema).parquet(f"{folder}/{name}")
    rules(staged).select(*(F.col(c).cast("string") for c in ("rule", "entity", "detail"))).write.parquet(f"{folder}/_violations")
    found = spark.read.schema("rule string, entity string, detail string").parquet(f"{folder}/_violations")
    named = found.orderBy("rule", "entity", "detail").limit(NAMED).collect()
    if named:
        raise BuildRefused(f"build {build} broke {found.count()} times its rules: " + "; ".join(f"{r.rule} {r.entity} {r.detail}" for r in named), f"{folder}/_violations")
    done = {"build": build, "tables": {n: {"folder": f"{folder}/{n}", "rows": t.count()} for n, t in staged.items()}, "header": header or {}}
    number = last["number"] + 1 if last else 0
    _commit(spark, path, number, done)
    return {"number": number, **done}


def clean_builds(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes the builds of all but the last manifests, and those manifests; tells which. Staged builds without a manifest stay."""
    store, place = _store(spark, path)
    gone = []
    for number in _numbers(spark, path)[:-keep or None]:
        file = f"{path}/manifests/{number:010d}.json"
        build = json.loads(spark.read.text(file, wholetext=True).first().value)["build"]
        store.delete(place(file), False)  # first the manifest, so that nothing points to a removed table
        remove_folder(spark, f"{path}/builds/{build}")
        gone.append(build)
    return gone
