"""Load source tables by name with a declared schema."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerweave.sources.layout import ROOT_ORDER
from ledgerweave.sources.schemas import SCHEMAS

ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
INFERENCE = "spark.sql.sources.partitionColumnTypeInference.enabled"
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def conform(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """Declared columns only, in their declared types, and those of ``keep``; a missing declared column is an error.

    Columns that already have the type stay bare, so filters on them still reach the scan.
    """
    schema: StructType = StructType.fromDDL(SCHEMAS[name])
    have = {f.name.lower(): f for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name.lower() not in have]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    return df.select(
        *[
            F.col(f"`{f.name}`")
            if have[f.name.lower()].dataType == f.dataType
            else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
            for f in schema.fields
        ],
        *[c for c in keep if c in df.columns],
    )


class Catalog(Mapping[str, DataFrame]):
    """Tables by canonical name, opened on first use.

    ``root`` holds one parquet folder per table (``schema.table``); ``paths`` names other
    folders and ``tables`` metastore tables. ``renames`` maps physical column names of a
    table to the declared ones. A folder laid out by partition (``base_dt=...``,
    ``year=.../month=.../day=...``) is listed when it is opened, so partitions added since
    the last run are seen without a repair step. Bucketed copies of the order hierarchy
    (``layout.write_hierarchy``) are named in ``tables``; reports then join them without a shuffle.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str | None = None,
        paths: Mapping[str, str] | None = None,
        tables: Mapping[str, str] | None = None,
        renames: Mapping[str, Mapping[str, str]] | None = None,
    ) -> None:
        self.spark, self.root = spark, root
        self.paths, self.tables, self.renames = dict(paths or {}), dict(tables or {}), dict(renames or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(name)
        if name in self.tables:
            df = self.spark.table(self.tables[name])
        else:
            df = self._folder(self._path(name))
        for physical, declared in self.renames.get(name, {}).items():
            df = df.withColumnRenamed(physical, declared)
        if ROOT_ORDER in df.columns:  # copies dealt by order stay where they are when joined by order and more
            self.spark.conf.set(ALL_KEYS, "false")
        return conform(df, name, (ROOT_ORDER,))

    def _path(self, name: str) -> str:
        if name in self.paths:
            return self.paths[name]
        if self.root is None:
            raise KeyError(name)
        return f"{self.root}/{name}"

    def _folder(self, path: str) -> DataFrame:
        """The folder with partition values as the texts of its names: ``month=04`` is ``04``.

        Filters on them then stay on the bare columns and prune folders.
        """
        before = self.spark.conf.get(INFERENCE)
        self.spark.conf.set(INFERENCE, "false")
        try:
            return self.spark.read.parquet(path)
        finally:
            self.spark.conf.set(INFERENCE, before)

    def newest(self, name: str, column: str) -> str | None:
        """Largest value of a table's first partition column, by folder names or the metastore, reading no file.

        Nulls and partitions without a data file do not count. ``None`` if the table is not laid out by
        that column, or no partition counts.
        """
        if name in self.tables:
            return self._newest_listed(self.tables[name], self._physical(name, column))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = {f.getPath().getName(): f.getPath() for f in files.listStatus(path) if f.isDirectory()}
        values = [n.split("=", 1)[1] for n in folders if n.startswith(f"{column}=")]
        for value in sorted((v for v in values if v != NULL_PARTITION), reverse=True):
            held = files.listFiles(folders[f"{column}={value}"], True)
            while held.hasNext():
                if not held.next().getPath().getName().startswith(("_", ".")):
                    return value
        return None

    def _physical(self, name: str, column: str) -> str:
        return next((p for p, declared in self.renames.get(name, {}).items() if declared == column), column)

    def _newest_listed(self, table: str, column: str) -> str | None:
        """``newest`` of a metastore table: its partitions as the session catalogue lists them, no job."""
        try:
            listed = self.spark.sql(f"SHOW PARTITIONS {table}").collect()  # names of partitions only
        except AnalysisException:  # not partitioned
            return None
        specs = [r[0].split("/", 1)[0].split("=", 1) for r in listed]
        values = {unquote(s[1]) for s in specs if s[0].lower() == column.lower()} - {NULL_PARTITION, "null"}
        for value in sorted(values, reverse=True):
            if self.spark.table(table).filter(F.col(column).cast("string") == value).inputFiles():
                return value
        return None

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)
