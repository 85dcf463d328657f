"""Tables written to a shared folder: cut lineage, materialised results, tables that change all at once.

A catalog is a folder with one small file that says which folders each table consists of. Publishing writes data beside what
is there and then replaces that file by one atomic rename, so that readers and crashes see the old tables or the new ones.
"""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of this machine, by application, where no shared one is configured.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, one of this machine, on which a local session may rely."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="foliate-")
        where = _own[app]
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and from its root, as a reader tells the paths of its files."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def drop(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside path and renames it over path, in one step."""
    fresh = f"{path}.{uuid.uuid4().hex}"
    fs, p = _fs(spark, fresh)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(p, hadoop.Path(path), options)


class Catalog:
    """Tables below a folder, each the rows of one or more Parquet folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def parts(self) -> dict[str, list[str]]:
        """The folders of every table, as published last."""
        return json.loads(read_text(self.spark, f"{self.root}/_tables.json") or "{}")

    def read(self, table: str) -> DataFrame | None:
        folders = self.parts().get(table)
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders]) if folders else None

    def stage(self, df: DataFrame, table: str) -> str:
        """Writes rows to a new folder of a table, which nobody sees before it is published."""
        folder = f"{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return folder

    def staged(self, folder: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{folder}")

    def publish(self, added: dict[str, str], replaced: dict[str, str] | None = None) -> None:
        """Adds a staged folder to each table, or puts one in place of all that a table had; all tables at once."""
        now = self.parts()
        for table, folder in added.items():
            now[table] = [*now.get(table, []), folder]
        now |= {table: [folder] for table, folder in (replaced or {}).items()}
        write_text(self.spark, f"{self.root}/_tables.json", json.dumps(now, indent=1))

    def discard(self, folders: list[str]) -> None:
        """Removes folders that were staged and not published."""
        known = {f for own in self.parts().values() for f in own}
        for folder in set(folders) - known:
            drop(self.spark, f"{self.root}/{folder}")


class MaterializedView:
    """A query's result as a table: create(), read(), refresh() and drop()."""

    def __init__(self, spark: SparkSession, path: str, query):
        self.spark, self.path, self.query = spark, path, query
        self.catalog = Catalog(spark, path)

    def create(self) -> DataFrame:
        if self.catalog.parts():
            raise FileExistsError(self.path)
        return self.refresh()

    def read(self) -> DataFrame:
        found = self.catalog.read("view")
        if found is None:
            raise FileNotFoundError(self.path)
        return found

    def refresh(self) -> DataFrame:
        """Runs the query and puts its rows in place of the old ones, which stay until the next refresh for those who read them."""
        old = self.catalog.parts()
        folder = self.catalog.stage(self.query(), "view")
        write_text(self.spark, f"{self.path}/_tables.json", json.dumps({"view": [folder], "before": old.get("view", [])}))
        for gone in old.get("before", []):
            drop(self.spark, f"{self.path}/{gone}")
        return self.read()

    def drop(self) -> bool:
        return drop(self.spark, self.path)
