"""Tables by layer and name: paths, reads with a contract, layout-aware writes."""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.storagelevel import StorageLevel

from ..schemas import GOLD_SCHEMAS, PARTITIONS, schema_of

# Tables whose emptiness means that the gold layer is not built yet.
GOLD_PROBE = [
    "dim_provider",
    "gold_hero_geo_arbitrage",
    "gold_hero_non_par_premium",
    "gold_hero_jcode_concentration",
    "gold_hero_credentials_markup",
    "gold_hero_site_neutral",
]


class ContractError(ValueError):
    """A stored table does not have its declared columns."""


def table_path(root: str, layer: str, name: str) -> str:
    return f"{root.rstrip('/')}/{layer}/{name}"


def read_table(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """Read a stored table; one with a contract is checked and typed by it.

    Naming the schema also keeps partition values as declared: without it a
    state column of digits would come back as a number, and last.
    """
    path = table_path(current_root(spark, root), layer, name)
    contract = schema_of(layer, name)
    if contract is None:
        return spark.read.parquet(path)
    stored = spark.read.schema(contract).parquet(path)  # the only listing
    one = _first_file(stored)
    if one is not None:
        physical = spark.read.parquet(one).schema
        folders = {part.split("=")[0] for part in one.split("/") if "=" in part}
        present = set(physical.fieldNames()) | (folders & set(PARTITIONS.get(name, ())))
        missing = set(contract.fieldNames()) - present
        extra = present - set(contract.fieldNames())
        if missing or extra:
            raise ContractError(f"{path}: missing {sorted(missing)}, unexpected {sorted(extra)}")
        declared = {f.name: f.dataType for f in contract if f.name in physical.fieldNames()}
        wrong = [n for n, kind in declared.items() if physical[n].dataType != kind]
        if wrong:
            raise ContractError(f"{path}: other types than declared for {sorted(wrong)}")
    return stored.select(*contract.fieldNames())


def _first_file(stored: DataFrame) -> str | None:
    """One file of a table that was just listed; its footer stands for the table's columns."""
    relation = stored._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation()
    files = relation.location().allFiles()
    return files.head().getPath().toString() if files.nonEmpty() else None


# --- published runs ---------------------------------------------------------------


def run_root(root: str, run: str) -> str:
    return f"{root.rstrip('/')}/_runs/{run}"


def _folder(spark: SparkSession, name: str):
    """A path and its file system, of whatever kind the root is in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _listed(spark: SparkSession, name: str) -> list:
    folder, filesystem = _folder(spark, name)
    return list(filesystem.listStatus(folder)) if filesystem.exists(folder) else []


def _publications(spark: SparkSession, root: str) -> dict[int, str]:
    """Published runs by number. A number whose file is still empty is being published and does not count yet."""
    found = {}
    for status in _listed(spark, f"{root.rstrip('/')}/_published"):
        path = status.getPath()
        if not path.getName().isdigit() or not status.getLen():
            continue
        filesystem = path.getFileSystem(spark._jsc.hadoopConfiguration())
        try:
            stream = filesystem.open(path)
        except Py4JJavaError:
            if filesystem.exists(path):
                raise
            continue  # superseded and removed since the folder was listed
        try:
            found[int(path.getName())] = stream.readUTF()
        finally:
            stream.close()
    return found


def current_root(spark: SparkSession, root: str) -> str:
    """The folder of the run published last, or ``root`` itself if it holds tables directly."""
    published = _publications(spark, root)
    return run_root(root, published[max(published)]) if published else root


def publish_run(spark: SparkSession, root: str, run: str) -> None:
    """Make ``run`` the one that reads see: a small file with the next free number is created, no table is moved.

    The file must be new, so of two jobs that publish at once one takes the next number, and the later one wins. Runs
    published before the last two are removed; readers of the previous one can finish. Runs that are not published
    may still be written and stay, see ``remove_abandoned``.
    """
    names = [s.getPath().getName() for s in _listed(spark, f"{root.rstrip('/')}/_published")]
    number = max([int(name) for name in names if name.isdigit()], default=0)
    while True:
        number += 1
        path, filesystem = _folder(spark, f"{root.rstrip('/')}/_published/{number:09d}")
        try:
            stream = filesystem.create(path, False)
        except Py4JJavaError:
            if not filesystem.exists(path):
                raise
            continue  # another job was faster
        stream.writeUTF(run)
        stream.close()
        break
    published = _publications(spark, root)
    last_two = {published[n] for n in sorted(published)[-2:]}
    for n in sorted(published)[:-2]:
        if published[n] not in last_two:
            path, filesystem = _folder(spark, run_root(root, published[n]))
            filesystem.delete(path, True)
        path, filesystem = _folder(spark, f"{root.rstrip('/')}/_published/{n:09d}")
        filesystem.delete(path, False)


def remove_abandoned(spark: SparkSession, root: str, older_than_hours: float) -> list[str]:
    """Delete runs that were never published and have no file as young as that; returns their names.

    For runs whose job died. Choose more hours than the longest job takes.
    """
    kept, removed = set(_publications(spark, root).values()), []
    limit = (time.time() - 3600 * older_than_hours) * 1000
    for status in _listed(spark, f"{root.rstrip('/')}/_runs"):
        name = status.getPath().getName()
        if name in kept:
            continue
        _, filesystem = _folder(spark, root)
        files, youngest = filesystem.listFiles(status.getPath(), True), status.getModificationTime()
        while files.hasNext():
            youngest = max(youngest, files.next().getModificationTime())
        if youngest < limit:
            filesystem.delete(status.getPath(), True)
            removed.append(name)
    return removed


def load_gold(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A gold table, or an empty frame with its columns if it is not written yet."""
    try:
        return read_table(spark, root, "gold", name)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], GOLD_SCHEMAS[name])


def gold_status(spark: SparkSession, root: str) -> DataFrame:
    """``(table_name, is_empty)`` for the probed gold tables.

    Each is read file by file until a row turns up, so a full table costs one small task.
    """
    rows = [(name, load_gold(spark, root, name).isEmpty()) for name in GOLD_PROBE]
    return spark.createDataFrame(rows, "table_name string, is_empty boolean")


def gold_is_empty(spark: SparkSession, root: str) -> bool:
    """True if none of the probed gold tables has a row."""
    return all(load_gold(spark, root, name).isEmpty() for name in GOLD_PROBE)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    rebalance: bool = True,
    compression: str = "zstd",
) -> None:
    """Replace the table at ``path``, data and schema.

    Before a partitioned write, a rebalance brings the rows of a partition value
    together, so that a task does not open a file for every value. It is
    adaptive: small values share a task and a value with a large part of all
    rows is split into tasks of the advisory size. Turn it off for rows that come
    straight from a table with the same partitions, or that ``build_silver`` brought
    together: they are together already.
    ``sort_by`` orders rows inside each file, which gives Parquet row groups
    narrow min/max ranges.

    A path is cleared before it is written, so a frame that still reads from it
    is refused.
    """
    if _qualified(df.sparkSession, path) in _scanned_roots(df):
        raise ValueError(f"{path} is read by the query that would replace it")
    laid_out = df.hint("rebalance", *partition_by) if partition_by and rebalance else df
    if partition_by or sort_by:
        laid_out = laid_out.sortWithinPartitions(*partition_by, *sort_by)
    writer = laid_out.write.mode("overwrite").option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and without trailing slash, as scans report it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return filesystem.makeQualified(hadoop_path).toString()


def _scanned_roots(df: DataFrame) -> set[str]:
    """Root folders of the file scans of a plan.

    ``DataFrame.inputFiles`` would list every file of every input one by one.
    """
    roots = set()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            relation = leaf.relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                roots |= {paths.apply(n).toString() for n in range(paths.size())}
    return roots


#: Rows that a task of a range-clustered write takes at most, but for the error of the sampled bounds.
ROWS_PER_FILE = 1_000_000


def cluster_by(
    df: DataFrame, cols: Sequence[str], n_files: int | None = None, rows_per_file: int = ROWS_PER_FILE
) -> DataFrame:
    """Range-cluster rows on ``cols`` so that selective filters skip whole files.

    ``n_files`` is the number of files as long as none gets more than ``rows_per_file`` rows; a larger table gets
    more of them, so that no task grows with it. The rows are counted first. Without it there are as many as the
    session shuffles to.

    A range exchange cannot split rows with equal keys. The number of the
    partition a row comes from is therefore the last range column: copies of one
    key that arrive in many partitions leave in many, and a rerun task numbers
    its rows the same way.
    """
    spread = "_source_partition"
    keys = [*cols, spread]
    tagged = df.withColumn(spread, F.spark_partition_id())
    if n_files:
        ranged = tagged.repartitionByRange(max(n_files, -(-df.count() // rows_per_file)), *keys)
    else:
        ranged = tagged.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*cols).drop(spread)


def register_gold(spark: SparkSession, root: str, db: str = "default") -> list[str]:
    """Point one catalog table at each gold path, replacing earlier entries.

    Columns and partitions are those of the declared contract and layout, so
    nothing is inferred from the files. The database is noted below ``root``, so that
    its tables move on when a run is published (``move_catalogs``).
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")
    path, filesystem = _folder(spark, f"{root.rstrip('/')}/_catalogs/{quote(db, safe='')}")
    filesystem.create(path, True).close()
    registered, published = [], current_root(spark, root)
    for name, contract in GOLD_SCHEMAS.items():
        path = table_path(published, "gold", name)
        table = f"`{db}`.`{name}`"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        quoted = "'" + path.replace("\\", r"\\").replace("'", r"\'") + "'"
        partitions = PARTITIONS.get(name, [])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contract.fields)
        layout = f" PARTITIONED BY ({', '.join(partitions)})" if partitions else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet{layout} LOCATION {quoted}")
        if partitions:
            spark.sql(f"MSCK REPAIR TABLE {table}")
        registered.append(f"{db}.{name}")
    return registered


def move_catalogs(spark: SparkSession, root: str) -> list[str]:
    """Point the tables of every database registered at ``root`` at the published run; returns the databases.

    A database or table that this session's catalog does not have, or no longer has, is left alone.
    """
    moved = []
    for status in _listed(spark, f"{root.rstrip('/')}/_catalogs"):
        db = unquote(status.getPath().getName())
        if spark.catalog.databaseExists(db) and all(spark.catalog.tableExists(f"`{db}`.`{name}`") for name in GOLD_SCHEMAS):
            register_gold(spark, root, db)
            moved.append(db)
    return moved


@contextmanager
def cached(df: DataFrame, columns: Sequence[str] = ()) -> Iterator[DataFrame]:
    """Keep a frame for several queries and release it afterwards.

    A cache holds whole rows and hides the files from column pruning and filter
    pushdown, so name only the ``columns`` the queries need.
    """
    kept = (df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()
