"""Writing results: step tables, swapped tables, CSV reports, cohort exports."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import TableStore, shared_dir


def materialize_step(df: DataFrame, store: TableStore, name: str) -> DataFrame:
    """Create or replace one stored step table and return it as read back."""
    return store.save(df, name)


def replace_columns(base: DataFrame, update: DataFrame, on: str) -> DataFrame:
    """``base`` with the columns of ``update`` replaced or added by name.

    ``update`` holds one row per ``on``; names present on both sides are taken from
    it, so the result never carries a name twice.
    """
    fresh = [c for c in update.columns if c != on]
    return base.drop(*fresh).join(update, on, "left")


def swap_table(df: DataFrame, table: str, folder: str) -> None:
    """Replace a catalog table that ``df`` itself may read from.

    The new version is written to its own folder first; then the table's location moves
    to it in one catalog change, so readers always find the old version or the new one.
    """
    spark: SparkSession = df.sparkSession
    path = f"{folder.rstrip('/')}/{table.replace('.', '_')}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} USING parquet LOCATION '{path}'")
        return
    known = {f.name.lower() for f in spark.table(table).schema.fields}
    added = [f for f in df.schema.fields if f.name.lower() not in known]
    if added:
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in added)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({names})")
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")


class Versions:
    """Versions of one table behind one name, in a database under the shared folder.

    A version is a table of its own, written whole before the name, a view, moves to it in one
    catalog change: that is the commit. A write that fails leaves the name on the version
    before, so a table can be replaced by a query that reads it. Frames read by name or number
    stay on their version, which is dropped with its files once ``keep`` newer ones exist.
    """

    def __init__(self, spark: SparkSession, name: str, database: str = "cohortloom_versions",
                 keep: int = 2):
        self.spark, self.name, self.database, self.keep = spark, name, database, keep
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_dir(spark)}/{database}'")

    def numbers(self) -> dict[int, str]:
        """Version numbers and their tables, ascending."""
        names = [t.name for t in self.spark.catalog.listTables(self.database)]
        found = {int(m[1]): n for n in names if (m := re.fullmatch(rf"{self.name}_v(\d+)_\w+", n))}
        return dict(sorted(found.items()))

    def current(self) -> int | None:
        """The committed version."""
        if not self.spark.catalog.tableExists(f"{self.database}.{self.name}"):
            return None
        rows = self.spark.sql(f"SHOW TBLPROPERTIES {self.database}.{self.name}").collect()
        return next(int(r.value) for r in rows if r.key == "version")

    def read(self, number: int | None = None) -> DataFrame:
        """The committed version, or one by number."""
        number = self.current() if number is None else number
        return self.spark.table(f"{self.database}.{self.numbers()[number]}")

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df``, which may read this very table, as the next version; read it back."""
        number = max([self.current() or 0, *self.numbers()]) + 1
        table = f"{self.database}.{self.name}_v{number}_{uuid.uuid4().hex[:8]}"
        df.write.format("parquet").saveAsTable(table)
        verb = "CREATE OR REPLACE VIEW"
        self.spark.sql(f"{verb} {self.database}.{self.name} TBLPROPERTIES ('version' = '{number}') "
                       f"AS SELECT * FROM {table}")
        self.expire()
        return self.read(number)

    def expire(self) -> None:
        """Drop all but the ``keep`` newest committed versions, and what failed writes left."""
        last = self.current() or 0
        found = self.numbers()
        kept = [n for n in found if n <= last][-self.keep:]
        for number, table in found.items():
            if number not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{table}")


def write_csv(df: DataFrame, path: str) -> None:
    """Partitioned CSV with a header line per part file."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def export_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in columns if c in df.columns])
