"""Access to the source tables by name, always lazy."""

from __future__ import annotations

from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carepath.constants import I2B2_TABLES, OMOP_TABLES, PERSON, STAY_ID


class Catalog:
    """Tables of one database: Parquet folders under ``path``, tables of ``database``, or frames.

    A table is an attribute (``catalog.person``) and is opened on first use only.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        database: str | None = None,
        frames: dict[str, DataFrame] | None = None,
        table_names: list[str] | None = None,
        suffix: str = "",
    ):
        if sum(source is not None for source in (path, database, frames)) != 1:
            raise ValueError("give one of path, database and frames")
        self.spark = spark
        self.path = path.rstrip("/") if path else None
        self.database = database
        self.suffix = suffix
        self.table_names = list(table_names or frames or OMOP_TABLES)
        self._tables: dict[str, DataFrame] = dict(frames or {})

    def scan(self, table: str) -> DataFrame:
        if table not in self._tables:
            if table not in self.table_names:
                raise AttributeError(f"no table {table} among {self.table_names}")
            if self.database is not None:
                self._tables[table] = self.spark.table(f"{self.database}.{table}")
            else:
                self._tables[table] = self.spark.read.parquet(f"{self.path}/{table}{self.suffix}")
        return self._tables[table]

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        return self.scan(table)

    @cached_property
    def missing_tables(self) -> list[str]:
        """Declared tables that cannot be opened."""
        missing = []
        for table in self.table_names:
            try:
                self.scan(table)
            except AnalysisException:
                missing.append(table)
        return missing

    def replace(self, **frames: DataFrame) -> "Catalog":
        """The same catalog with some tables given as frames."""
        tables = {name: self.scan(name) for name in self.table_names if name not in frames}
        return Catalog(self.spark, frames={**tables, **frames})


def i2b2_catalog(spark: SparkSession, path: str, table_names: list[str] | None = None) -> Catalog:
    """Folders of Parquet parts extracted from i2b2 and renamed to the common model."""
    return Catalog(spark, path=path, table_names=table_names or I2B2_TABLES)


# fixed values: i2b2 names of the common columns
I2B2_TO_OMOP = {
    "patient_num": PERSON,
    "encounter_num": STAY_ID,
    "valueflag_cd": "drug_class_source_value",
    "start_date": "start",
}


def i2b2_to_omop(
    table: DataFrame, code_column: str, names: dict[str, str] | None = None
) -> DataFrame:
    """Rename i2b2 columns and drop the rows without a code."""
    return table.withColumnsRenamed(names or I2B2_TO_OMOP).filter(F.col(code_column).isNotNull())


def read_dimension(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A dimension CSV; every column is read as text, so that codes keep leading zeros."""
    header = spark.read.option("header", True).csv(path, inferSchema=False)
    return header.select(*columns)
