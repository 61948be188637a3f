"""Table names to DataFrames, and results to files."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Finds a table by its name: what was added under it, else ``<folder>/<name>.parquet``, else the session's catalog.

    Every table is resolved once per catalog, so that all branches of a plan share one relation.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: Mapping[str, object] | None = None):
        self.spark, self.folder = spark, folder
        self.token = uuid.uuid4().hex  # part of the names of its temporary views
        self._found: dict[str, DataFrame] = {}
        self._later: dict[str, Callable[[], DataFrame]] = {}
        for name, source in (tables or {}).items():
            self.add(name, source)

    def add(self, name: str, source) -> Catalog:
        """A DataFrame, or a SELECT over the catalog's other tables, or a function that returns a DataFrame.

        The latter two are made when a request first needs them.
        """
        self._found.pop(name, None)
        if isinstance(source, DataFrame):
            self._found[name] = source
        else:
            self._later[name] = source if callable(source) else lambda: self.sql(source)
        return self

    def jdbc(self, name: str, url: str, table: str | None = None, column: str | None = None, partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> Catalog:
        """A table of a database. With ``column`` and its bounds it is read in ``partitions`` ranges at once."""
        reader = self.spark.read.format("jdbc").option("url", url).option("dbtable", table or name).options(**options)
        if column and bounds:
            reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
        return self.add(name, reader.load())

    def table(self, name: str) -> DataFrame:
        if name not in self._found and name in self._later:
            self._found[name] = self._later[name]()
        elif name not in self._found:
            self._found[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet") if self.folder else self.spark.table(name)
        return self._found[name]

    def sql(self, text: str) -> DataFrame:
        """SQL in which ``{name}`` stands for a table of the catalog; no temporary views are left behind."""
        names = sorted({name for _, name, _, _ in string.Formatter().parse(text) if name})
        return self.spark.sql(text, **{n: self.table(n) for n in names})


def json_rows(df: DataFrame) -> DataFrame:
    """One column ``value`` with a JSON object for each row; nulls are written."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
