"""Processing pipelines by name: what they accept and how they turn files into Markdown."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def chain(steps: Iterable[Step]) -> Step:
    """One step that applies the given ones in turn."""
    steps = tuple(steps)
    return lambda df: reduce(lambda d, step: d.transform(step), steps, df)


@dataclass(frozen=True)
class Pipeline:
    name: str
    formats: tuple[str, ...]
    run: Step


@dataclass
class Registry:
    """Named pipelines; the first registered is the default unless another is named."""

    default: str | None = None
    pipelines: dict[str, Pipeline] = field(default_factory=dict)

    def register(self, name: str, formats: Iterable[str], default: bool = False) -> Callable[[Step], Step]:
        def add(run: Step) -> Step:
            self.pipelines[name] = Pipeline(name, tuple(formats), run)
            if default or self.default is None:
                self.default = name
            return run

        return add

    def discover(self, package: str) -> list[str]:
        """Import every module of a package; modules register themselves when imported."""
        found = importlib.import_module(package)
        names = [m.name for m in pkgutil.iter_modules(found.__path__)]
        for n in names:
            importlib.import_module(f"{package}.{n}")
        return names

    def table(self, spark: SparkSession) -> DataFrame:
        """Rows (model, extensions)."""
        return spark.createDataFrame([(p.name, list(p.formats)) for p in self.pipelines.values()], "model string, extensions array<string>")

    def convert(self, tasks: DataFrame) -> DataFrame:
        """Rows (task_id, markdown, error): each task's file by its model's pipeline, in one plan for each model.

        A pipeline takes the tasks and returns rows (task_id, markdown). Tasks of unknown models, and those a pipeline
        returns nothing for, have an error and no Markdown; the batch never fails for one of them. A task that was delivered more
        than once is one task, and has one row.
        """
        from ..streaming.tasks import one_a_task

        tasks = one_a_task(tasks).withColumn("model", F.coalesce("model", F.lit(self.default)))
        parts = [p.run(tasks.where(F.col("model") == p.name)).select("task_id", "markdown") for p in self.pipelines.values()]
        done = reduce(DataFrame.unionByName, parts) if parts else tasks.select("task_id", F.lit(None).cast("string").alias("markdown")).limit(0)
        error = F.when(~F.col("model").isin(*self.pipelines), "unknown model").when(F.col("markdown").isNull(), "no result")
        done = done.groupBy("task_id").agg(F.min("markdown").alias("markdown"))
        return tasks.select("task_id", "model").join(done, "task_id", "left").select("task_id", "markdown", error.alias("error"))


def accepts(filename: Column, extensions: Column) -> Column:
    """The name ends in one of the extensions, in any case; a dot is not asked for. Null for unknown models."""
    return F.exists(extensions, lambda e: F.endswith(F.lower(filename), F.lower(e)))


def gated(requests: DataFrame, models: DataFrame) -> DataFrame:
    """Adds ``verdict`` to requests (model, filename): accepted, wrong extension or unknown model.

    The registry has a few rows and is broadcast; requests stay where they are.
    """
    joined = requests.join(F.broadcast(models), "model", "left")
    return joined.withColumn("verdict", F.when(F.col("extensions").isNull(), "unknown model").when(accepts(F.col("filename"), F.col("extensions")), "accepted").otherwise("wrong extension"))


def parsed(rows: DataFrame, column: str) -> DataFrame:
    """Rows (model, extensions) of a registry kept as a JSON map."""
    return rows.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("model", "extensions"))


def stored(models: DataFrame) -> DataFrame:
    """One row (models): rows (model, extensions) as a JSON map, in order; the registry's few rows become one value."""
    listed = F.sort_array(F.collect_list(F.struct("model", "extensions")))
    return models.agg(F.to_json(F.map_from_entries(listed)).alias("models"))
