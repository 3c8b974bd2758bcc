"""The feature catalog, to which operators are added by name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lanewise.functions.vectors import vector_add_f32, vector_mul_f32, vector_sub_f32

CORE = ("core", "Capability detection and level names")


class Registry:
    """Named operators with a description. A builder runs when its operator is first asked for, and must return something."""

    def __init__(self) -> None:
        self._builders: dict[str, tuple[str, Callable[[], Any]]] = {}
        self._built: dict[str, Any] = {}

    def register(self, name: str, builder: Callable[[], Any], description: str = "") -> None:
        if name in self._builders or name == CORE[0]:
            raise ValueError(f"{name} is registered already")
        self._builders[name] = (description, builder)

    def __getitem__(self, name: str) -> Any:
        if name not in self._built:
            built = self._builders[name][1]()
            if built is None:
                raise RuntimeError(f"the builder of {name} returned nothing")
            self._built[name] = built
        return self._built[name]

    def features(self, scope: str = "all") -> list[tuple[int, str, str]]:
        """(idx, name, description): the core alone, or with every registered operator by name."""
        if scope not in ("core", "all"):
            raise ValueError(scope)
        more = sorted((n, d) for n, (d, _) in self._builders.items()) if scope == "all" else []
        return [(i, *x) for i, x in enumerate([CORE, *more])]

    def catalog(self, spark: SparkSession, scope: str = "all") -> DataFrame:
        return spark.createDataFrame(self.features(scope), "idx int, name string, description string")


def standard() -> Registry:
    out = Registry()
    out.register("vector_add", lambda: vector_add_f32, "Element-wise addition")
    out.register("vector_sub", lambda: vector_sub_f32, "Element-wise subtraction")
    out.register("vector_mul", lambda: vector_mul_f32, "Element-wise multiplication")
    return out
