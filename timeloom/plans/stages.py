"""Stages as DataFrame functions over tables, with fingerprints: a stage runs again only for videos whose inputs, version, model or prompt changed.

A stage with natural keys runs only for rows whose own fingerprint changed: it covers the row, what the other inputs say of it (rows of
the same key, or of its video if they lack the key), version, model and prompt. Fingerprints and rows are parts of one generation of the
stage's table, so a crash leaves both as they were.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.schemas import schema
from timeloom.sources import generations
from timeloom.sources.artifacts import read_table
from timeloom.sources.sinks import append_run, latest_runs


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"
    keys: tuple[str, ...] = ()  #: natural key of a row, in the first input and the output: rows whose fingerprint is the same aren't run again
    model: str = ""  #: name of the model that is asked
    prompt: str = ""  #: version or text of what it is asked

    @property
    def recipe(self) -> str:
        return json.dumps([self.version, self.model, self.prompt])


@contextmanager
def track(spark: SparkSession, root: str, videos: list[str], stage: str, fingerprint: str | None = None):
    """running, then done with seconds, or failed with the error."""
    began = time.monotonic()
    append_run(spark, root, videos, stage, "running")
    try:
        yield
    except Exception as e:
        append_run(spark, root, videos, stage, "failed", round(time.monotonic() - began, 1), str(e)[:2000])
        raise
    append_run(spark, root, videos, stage, "done", round(time.monotonic() - began, 1), None, fingerprint)


def fingerprints(stage: Stage, tables: dict[str, DataFrame]) -> DataFrame:
    """video_id, fingerprint of all rows of a stage's inputs, whatever their order, and of its version."""
    parts = [tables[t].select("video_id", F.xxhash64(F.to_json(F.struct(*[c for c in tables[t].columns if c != "video_id"])), F.lit(t)).alias("h")) for t in stage.inputs]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    total = F.sum(F.col("h").cast("decimal(38,0)")).cast("string")
    return d.groupBy("video_id").agg(F.sha2(F.concat_ws("|", total, F.count("*").cast("string"), F.lit(stage.recipe)), 256).alias("fingerprint"))


def run_stages(spark: SparkSession, root: str, stages: list[Stage], force: bool = False) -> dict[str, int]:
    """Walk the stages in order; returns how many videos each recomputed."""
    done: dict[str, int] = {}
    for stage in stages:
        tables = {t: read_table(spark, root, t) for t in stage.inputs}
        now = fingerprints(stage, tables)
        was = latest_runs(read_table(spark, root, "stage_runs")).filter(F.col("stage") == stage.name).filter("status = 'done'").select("video_id", F.col("fingerprint").alias("was"))
        todo = now.join(was, "video_id", "left").filter(F.lit(force) | ~F.col("fingerprint").eqNullSafe(F.col("was")))
        prints = {r[0]: r[1] for r in todo.select("video_id", "fingerprint").collect()}  # the list of videos to do, one row each
        done[stage.name] = len(prints)
        if not prints:
            continue
        chosen = spark.createDataFrame([(v,) for v in prints], "video_id string")
        with track(spark, root, list(prints), stage.name + ":run"):
            given = {t: d.join(chosen, "video_id", "left_semi") for t, d in tables.items()}
            number, parts = generations.head(spark, root, stage.name), {}
            if stage.keys:
                parts["prints"] = now = row_prints(stage, given)
            if stage.keys and not force:
                marked = reuse(now, generations.read(spark, root, stage.name, PRINTS, "prints", number))
                same, first = marked.filter("reused").select("video_id", "row_key"), stage.inputs[0]
                on = lambda d, how: d.withColumn("row_key", row_key(stage)).join(same, ["video_id", "row_key"], how).drop("row_key")
                kept = on(generations.read(spark, root, stage.name, schema(stage.name), number=number), "left_semi")
                given[first] = on(given[first], "left_anti")
                parts["rows"] = stage.run(given).unionByName(kept)
            else:
                parts["rows"] = stage.run(given)
            generations.commit(spark, root, stage.name, parts, chosen, number)
        append_run(spark, root, list(prints), stage.name, "done", fingerprint=prints)
    return done


PRINTS = T.StructType().add("video_id", "string").add("row_key", "string").add("print", "string")


def row_key(stage: Stage) -> Column:
    """The natural key as text; null parts are values of their own."""
    return F.to_json(F.struct(*stage.keys), {"ignoreNullFields": "false"})


def row_prints(stage: Stage, tables: dict[str, DataFrame]) -> DataFrame:
    """video_id, row_key, print of each natural key of the first input: whatever the order and number of its rows."""

    def sums(t: str, *by: str) -> DataFrame:
        d = tables[t]
        body = F.to_json(F.struct(*[c for c in d.columns if c != "video_id"]), {"ignoreNullFields": "false"})
        d = d.select("video_id", *[row_key(stage).alias(c) for c in by], F.xxhash64(body).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(1), body).cast("decimal(38,0)").alias("g"))
        text = F.concat_ws(",", F.sum("h").cast("string"), F.sum("g").cast("string"), F.count("*").cast("string"))
        return d.groupBy("video_id", *by).agg(text.alias(f"of_{t}"))

    first, *rest = stage.inputs
    out = sums(first, "row_key")
    for t in rest:
        by = ["row_key"] if set(stage.keys) <= set(tables[t].columns) else []
        out = out.join(sums(t, *by), ["video_id", *by], "left")
    parts = [F.coalesce(f"of_{t}", F.lit("-")) for t in stage.inputs]
    return out.select("video_id", "row_key", F.sha2(F.concat_ws("|", F.lit(stage.recipe), *parts), 256).alias("print"))


def reuse(now: DataFrame, was: DataFrame) -> DataFrame:
    """now (video_id, row_key, print) with `reused`: the row's key had the same print before."""
    before = was.select("video_id", "row_key", "print").distinct().withColumn("reused", F.lit(True))
    return now.join(before, ["video_id", "row_key", "print"], "left").withColumn("reused", F.coalesce("reused", F.lit(False)))
