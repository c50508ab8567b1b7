"""Stages, gates, audits and manifests."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A step with the tables it reads and writes; ``run`` takes the session and a table reader, and returns its outputs."""

    name: str
    inputs: Sequence[str]
    outputs: Sequence[str]
    run: Callable[[SparkSession, Callable[[str], DataFrame]], Mapping[str, DataFrame]]


def order(stages: Sequence[Stage], given: Sequence[str]) -> list[Stage]:
    """The stages so that each comes after those whose tables it reads; ValueError for a cycle, a missing input or two writers."""
    maker: dict[str, Stage] = {}
    for s in stages:
        for t in s.outputs:
            if t in maker or t in given:
                raise ValueError(f"{t} has two writers")
            maker[t] = s
    out: list[Stage] = []
    state: dict[str, int] = {}

    def visit(s: Stage) -> None:
        if state.get(s.name) == 2:
            return
        if state.get(s.name) == 1:
            raise ValueError(f"{s.name} is part of a cycle")
        state[s.name] = 1
        for t in s.inputs:
            if t not in given:
                if t not in maker:
                    raise ValueError(f"{s.name} reads {t}, which nothing writes")
                visit(maker[t])
        state[s.name] = 2
        out.append(s)

    for s in stages:
        visit(s)
    return out


def run_stages(spark: SparkSession, stages: Sequence[Stage], given: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Run all stages in order, each table written below ``folder`` and read from there; the paths written."""
    tables, paths = dict(given), {}
    for s in order(stages, list(given)):
        made = s.run(spark, lambda t: tables[t])
        if set(made) != set(s.outputs):
            raise ValueError(f"{s.name} made {sorted(made)}, not {sorted(s.outputs)}")
        for t, df in made.items():
            paths[t] = f"{folder}/{t}"
            df.write.mode("overwrite").parquet(paths[t])
            tables[t] = spark.read.parquet(paths[t])
    return paths


def audit(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, n_issues, verdict): each check is a frame of what is wrong."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("n_issues")).select(F.lit(name).alias("check"), "n_issues")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("verdict", F.when(F.col("n_issues") == 0, "PASS").otherwise("FAIL"))


def gate(results: DataFrame, stage: str, needs: Sequence[str]) -> DataFrame:
    """(stage, verdict, failed): PASS if all needed checks passed, SKIP if one of them did not run, else FAIL."""
    r = results.where(F.col("check").isin(*needs))
    out = r.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("verdict") == "FAIL", F.col("check")))), ";").alias("failed"))
    return out.select(F.lit(stage).alias("stage"), F.when(F.col("failed") != "", "FAIL").when(F.col("n") < len(needs), "SKIP").otherwise("PASS").alias("verdict"), "failed")


def leakage(train: DataFrame, test: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on both sides of a split."""
    return train.select(*keys).distinct().join(test.select(*keys), list(keys), "left_semi")


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A small report table as Markdown."""
    head = rows.columns
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows.limit(limit).collect()]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *body])


def release_gate(tables: Mapping[str, DataFrame | None], required: Mapping[str, Sequence[str]]) -> list[tuple[str, str]]:
    """(table, issue) of what a release lacks: a table, a column, or any row."""
    out = []
    for name, columns in required.items():
        df = tables.get(name)
        if df is None:
            out.append((name, "missing"))
            continue
        out += [(name, f"column:{c}") for c in columns if c not in df.columns]
        if df.isEmpty():
            out.append((name, "empty"))
    return out


def package(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> DataFrame:
    """Write tables and return (table, path, bytes, sha256) of every file: what a release consists of."""
    from panelspark.sources.files import manifest

    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    files = manifest(spark, folder, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("table"), "path", "bytes", "sha256")
