"""Extensions: readers, converters, sources, checks and types that a project adds, as functions over DataFrames."""

from __future__ import annotations

import importlib.util
import shutil
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.checks import SEVERITIES, canonical
from sparkloom.sources.ingest import Reader


@dataclass
class Plugin:
    """What a plugin adds and what it needs: programs on the path, Python modules.

    converters: a format to a function of (path, content) to (path, content); sources: functions of a session to (entities,
    links); checks: a severity a name, and a function of the model's blocks to (check, entity, message); types: the
    attributes of each."""

    name: str
    programs: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    readers: tuple[Reader, ...] = ()
    converters: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    sources: tuple[Callable[[SparkSession], tuple[DataFrame, DataFrame]], ...] = ()
    checks: dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]] = field(default_factory=dict)
    types: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass
class Registry:
    """Plugins in the order of their registration; one that lacks something it needs is off and gives W-PLUGIN-DISABLED."""

    plugins: list[Plugin] = field(default_factory=list)
    findings: list[tuple[str, str, str]] = field(default_factory=list)

    def register(self, plugin: Plugin) -> bool:
        missing = [p for p in plugin.programs if shutil.which(p) is None] + [m for m in plugin.modules if importlib.util.find_spec(m) is None]
        taken = {c for p in self.plugins for c in p.checks} | set(SEVERITIES)
        clash = sorted(taken & set(plugin.checks))
        if missing or clash or plugin.name in {p.name for p in self.plugins}:
            why = f"lacks {', '.join(missing)}" if missing else f"its checks are taken: {', '.join(clash)}" if clash else "its name is taken"
            self.findings.append(("W-PLUGIN-DISABLED", plugin.name, why))
            return False
        self.plugins.append(plugin)
        return True

    def readers(self, own: tuple[Reader, ...]) -> tuple[Reader, ...]:
        """The plugins' readers before the engine's own."""
        return (*(r for p in self.plugins for r in p.readers), *own)

    def converted(self, files: DataFrame, format_: str) -> DataFrame | None:
        """Files by the first converter of their format; null where there is none."""
        return next((p.converters[format_](files) for p in self.plugins if format_ in p.converters), None)

    def contributed(self, spark: SparkSession) -> tuple[DataFrame, DataFrame] | None:
        """(entities, links) of all sources in turn, each in its canonical order; null without any."""
        made = [s(spark) for p in self.plugins for s in p.sources]
        if not made:
            return None
        every = lambda i: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (m[i] for m in made))
        return every(0).orderBy("id"), every(1).orderBy("from", "to", "relation")

    def checked(self, spark: SparkSession, model: dict[str, DataFrame]) -> DataFrame:
        """(check, entity, message, severity): the plugins' findings on a model and why plugins are off."""
        off = spark.createDataFrame([(c, n, m, SEVERITIES[c]) for c, n, m in self.findings], "check string, entity string, message string, severity string")
        found = [f(model).select("check", "entity", "message").where(F.col("check") == c).withColumn("severity", F.lit(s)) for p in self.plugins for c, (s, f) in p.checks.items()]
        return canonical(reduce(DataFrame.unionByName, found, off))

    def types(self, own: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
        return reduce(lambda a, p: {**p.types, **a}, self.plugins, own)


def merged_profiles(base: dict, override: dict, path: tuple[str, ...] = ()) -> dict:
    """Two profiles as one, keys in order: mappings merge, the pairs that a relation allows add up, all else is the
    override's."""
    out = {}
    for key in sorted({*base, *override}):
        if key not in override:
            out[key] = base[key]
        elif isinstance(base.get(key), dict) and isinstance(override[key], dict):
            out[key] = merged_profiles(base[key], override[key], (*path, key))
        elif len(path) == 2 and path[0] == "relations" and key == "allowed" and isinstance(base.get(key), list):
            out[key] = [*base[key], *(p for i, p in enumerate(override[key]) if p not in base[key] and p not in override[key][:i])]
        else:
            out[key] = override[key]
    return out
