"""Operation logs, keyed stores, artifact logs and dataset sinks on plain folders.

A log is a folder to which batches are appended; Spark's commit protocol makes a batch visible as a whole
or not at all, which is what a write-ahead log is for.  Every operation has an ``op_id`` that orders it:
batch number and place in the batch.  One writer appends at a time; readers need no lock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sinks


def append(rows: DataFrame, path: str) -> int:
    """Appends a batch of operations with their ``op_id``; the batch's number."""
    spark = rows.sparkSession
    number = max(sinks._versions(spark, path), default=0) + 1
    rows.withColumn("op_id", F.lit(number << 40) + F.monotonically_increasing_id()).write.parquet(f"{path}/version={number}")
    return number


def replay(spark: SparkSession, path: str, after: int = 0) -> DataFrame | None:
    """All operations after an ``op_id``, or none if nothing was written."""
    if not sinks._versions(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path).drop("version").filter(F.col("op_id") > after)


def applied(log: DataFrame, key: str, first: bool = False) -> DataFrame:
    """The state that a log leaves: each key's last row (or its first), without keys whose last operation is ``delete``."""
    by = F.col("op_id").asc() if first else F.col("op_id").desc()
    last = log.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(by))).filter("__n = 1").drop("__n")
    return last.filter("operation != 'delete'")


def truncate(spark: SparkSession, path: str) -> None:
    """Removes a log whose state is in a snapshot."""
    fs, root = sinks._fs(spark, path)
    fs.delete(root, True)


def checkpoint(spark: SparkSession, log: str, snapshots: str, key: str, every: int = 100, force: bool = False) -> int | None:
    """Writes the state as a snapshot and removes the log, if it holds ``every`` operations at least; the snapshot's number."""
    rows = replay(spark, log)
    if rows is None or not (force or rows.count() >= every):
        return None
    number = sinks.snapshot(state(spark, log, snapshots, key), snapshots)
    truncate(spark, log)
    return number


def state(spark: SparkSession, log: str, snapshots: str, key: str) -> DataFrame:
    """The newest snapshot with the log's operations on top."""
    rows, held = replay(spark, log), sinks.newest(spark, snapshots)
    if rows is None:
        return held
    # A snapshot is older than everything in the log, whose numbers begin anew after it.
    everything = rows if held is None else held.withColumn("op_id", F.lit(0).cast("long")).unionByName(rows, allowMissingColumns=True)
    return applied(everything.drop("version"), key)


class Store:
    """A keyed store on a log: what is put replaces what the key had, and what is deleted is gone."""

    def __init__(self, spark: SparkSession, path: str, key: str, kind: str = "log"):
        """``kind`` is ``log`` (rows append, the last wins) or ``file`` (the first of a key stays)."""
        if kind not in ("log", "file"):
            raise ValueError(f"unknown kind of store: {kind}")
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    def put(self, rows: DataFrame) -> int:
        """Adds or replaces rows."""
        return append(rows.withColumn("operation", F.lit("put")), f"{self.path}/log")

    def delete(self, keys: DataFrame) -> int:
        """Removes keys."""
        return append(keys.select(self.key).withColumn("operation", F.lit("delete")), f"{self.path}/log")

    def rows(self) -> DataFrame:
        """What the store holds."""
        log = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/log").drop("version")
        return applied(log, self.key, self.kind == "file").drop("operation", "op_id")

    def get(self, value) -> DataFrame:
        """The row of a key, if there is one."""
        return self.rows().filter(F.col(self.key) == F.lit(value))


def log_artifacts(rows: DataFrame, path: str, name: str, content: str, parents: str | None = None) -> DataFrame:
    """Adds artifacts with the next version of their name, their hash and size; the rows that were added."""
    spark = rows.sparkSession
    numbered = rows.withColumn("hash", F.sha2(F.col(content), 256)).withColumn("size", F.octet_length(content)).withColumn("__at", F.row_number().over(Window.partitionBy(name).orderBy("hash")))
    if sinks._versions(spark, path):
        last = replay(spark, path).groupBy(F.col(name).alias("__name")).agg(F.max("number").alias("__last"))
        numbered = numbered.join(last, F.col(name) == F.col("__name"), "left")
    else:
        numbered = numbered.withColumn("__last", F.lit(None).cast("int"))
    made = numbered.select(name, "hash", "size", *([parents] if parents else []), (F.coalesce("__last", F.lit(0)) + F.col("__at")).cast("int").alias("number"))
    batch = append(made, path)
    return spark.read.parquet(f"{path}/version={batch}").drop("op_id")


def resolve(spark: SparkSession, path: str, name: str, value: str, version: str = "latest") -> DataFrame:
    """One version of an artifact, ``v3`` or ``latest`` (by number)."""
    rows = replay(spark, path).filter(F.col(name) == value)
    if version == "latest":
        return rows.orderBy(F.desc("number")).limit(1).drop("op_id")
    return rows.filter(F.col("number") == int(version.removeprefix("v"))).drop("op_id")


def dataset(samples: DataFrame, path: str, category: str) -> None:
    """A benchmark's folders: ``full``, one folder per category, ``stats`` by category and an ``index`` of ids."""
    samples.write.mode("overwrite").json(f"{path}/full")
    sinks.by_category(samples, f"{path}/by_category", category)
    samples.groupBy(category).agg(F.count("*").alias("n")).write.mode("overwrite").json(f"{path}/stats")
    samples.select(samples.columns[0], category).write.mode("overwrite").json(f"{path}/index")


def formatted(rows: list[dict], kind: str = "markdown") -> str:
    """A result table of a few rows as Markdown, LaTeX or HTML."""
    if not rows:
        return ""
    names, body = list(rows[0]), [[str(v) for v in r.values()] for r in rows]
    if kind == "markdown":
        line = lambda cells: "| " + " | ".join(cells) + " |"
        return "\n".join([line(names), line(["---"] * len(names)), *map(line, body)])
    if kind == "latex":
        return "\\begin{tabular}{" + "l" * len(names) + "}\n" + "\n".join(" & ".join(c) + r" \\" for c in [names, *body]) + "\n\\end{tabular}"
    if kind == "html":
        cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in row) + "</tr>"
        return "<table>" + cells("th", names) + "".join(cells("td", r) for r in body) + "</table>"
    raise ValueError(f"unknown kind of table: {kind}")
