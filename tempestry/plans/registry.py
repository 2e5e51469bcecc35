"""Queries by name, each with the DuckDB SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempestry.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables and views of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    """Registers a function of the tables under its own name."""

    def register(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = with_views(sql)
        return run

    return register


def clip(x: str, low: str | float, high: str | float) -> str:
    """SQL of columns.clip."""
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({low}, least({high}, {x})) END)"


def wrap(x: str) -> str:
    """SQL of columns.wrap180."""
    return f"((((({x}) + 180) % 360) + 360) % 360 - 180)"


def lookup(x: str, knots: list[tuple[float, float]]) -> str:
    """SQL of columns.interpolate."""
    out = f"CASE WHEN {x} <= {knots[0][0]} THEN {knots[0][1]}::DOUBLE"
    for (x0, y0), (x1, y1) in zip(knots, knots[1:], strict=False):
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - ({x0})) / ({x1}::DOUBLE - ({x0})) * ({y1} - ({y0}))"
    return f"({out} WHEN ({x}) IS NOT NULL THEN {knots[-1][1]}::DOUBLE END)"


def distance(lat: str, lon: str, lat0: str, lon0: str, per_degree: float = 111.32) -> str:
    """SQL of columns.distance_km."""
    return f"sqrt(pow(({lat} - {lat0}) * {per_degree}, 2) + pow({wrap(f'{lon} - {lon0}')} * {per_degree} * cos(radians({lat0})), 2))"
