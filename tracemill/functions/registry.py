"""Named extension points: column builders, group rewards, row hooks, loaded by path or by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from importlib import import_module
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_function(path: str) -> Callable:
    """``module.attribute``; raises ValueError if there is no such callable."""
    module, _, name = path.rpartition(".")
    try:
        f = getattr(import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no callable at {path}") from e
    if not callable(f):
        raise ValueError(f"not callable: {path}")
    return f


class Registry:
    """Builders by kind and name; a kind's contract is its number of required arguments."""

    def __init__(self):
        self.kinds: dict[str, int] = {}
        self.builders: dict[tuple[str, str], Callable] = {}

    def kind(self, name: str, arguments: int) -> None:
        self.kinds[name] = arguments

    def add(self, kind: str, name: str, f: Callable) -> None:
        need = self.kinds[kind]
        ps = [p for p in inspect.signature(f).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
        if len([p for p in ps if p.default is p.empty]) > need or len(ps) < need:
            raise TypeError(f"{kind} takes {need} arguments")
        self.builders[kind, name] = f

    def get(self, kind: str, name: str) -> Callable:
        if (kind, name) not in self.builders:
            raise KeyError(f"{kind} {name}; known: {sorted(n for k, n in self.builders if k == kind)}")
        return self.builders[kind, name]


REGISTRY = Registry()
#: Extension points with the number of their required arguments.
KINDS = {"reward": 1, "group_reward": 1, "filter": 1, "buffer_filter": 1, "sample_filter": 1, "reducer": 2, "weight": 2, "hook": 1, "rollout": 2, "generate": 1, "eval": 2, "log": 1, "loss": 2, "advantage": 2, "transform": 1, "validity": 1, "meta": 1}
for _kind, _n in KINDS.items():
    REGISTRY.kind(_kind, _n)


class SkillProvider(Protocol):
    """Gives the skills of a task: a DataFrame with skill_id and content, best first by ``place``."""

    def skills(self, task: DataFrame) -> DataFrame: ...


def discover(package: str, registry: Registry = REGISTRY) -> list[str]:
    """Loads a package's modules that name a ``TASK_TYPE`` and registers their transform, validity and meta functions under it; the names found, sorted."""
    import pkgutil

    root, found = import_module(package), []
    for info in pkgutil.iter_modules(root.__path__):
        module = import_module(f"{package}.{info.name}")
        name = getattr(module, "TASK_TYPE", None)
        if name:
            for kind in ("transform", "validity", "meta"):
                if hasattr(module, kind):
                    registry.add(kind, name, getattr(module, kind))
            found.append(name)
    return sorted(found)


def dispatch(kind_column: Column, builders: dict[str, Column], otherwise: Column | None = None, own: Column | None = None) -> Column:
    """The builder's column whose name the kind column has; an ``own`` value comes first. Names may have the prefix boxed_."""
    name = F.regexp_replace(kind_column, "^boxed_", "")
    out = F.lit(None).cast("double") if otherwise is None else otherwise
    for n, c in builders.items():
        out = F.when(name == n, c).otherwise(out)
    return out if own is None else F.coalesce(own, out)


def apply_hooks(df: DataFrame, hooks: list[Callable]) -> DataFrame:
    """Row transforms in order; a hook that returns None keeps the rows as they are."""
    for h in hooks:
        new = h(df)
        df = df if new is None else new
    return df


def register_sql(spark: SparkSession, name: str, path: str, returns: str) -> None:
    """A function at an import path, as an SQL function."""
    spark.udf.register(name, load_function(path), returns)
