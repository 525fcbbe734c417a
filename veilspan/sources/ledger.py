"""A folder of commit records beside a table's data: snapshots for readers, conflicts for writers, batches that count once.

Data is written first, into a folder that no earlier write has used; a record that names the folder makes it visible. A record is created
only if none of its name exists, so of two writers that meant to follow the same state one is told so. Nothing that a reader may hold
is overwritten or removed. This rests on the file system's exclusive create (atomic on HDFS); on a store without one, let one writer at a time
work on a table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "_records"


class Conflict(Exception):
    """Another writer made a record of this name first."""


class Ledger:
    """Named records under ``path``; their names sort in the order of their numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._folder = self._hadoop.Path(f"{self.path}/{RECORDS}")
        self._files = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    @staticmethod
    def name(number: int) -> str:
        return f"{number:018d}"

    def numbers(self) -> list[int]:
        """Of all records, ascending: one name for each write, not for each row."""
        if not self._files.exists(self._folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self._files.listStatus(self._folder) if f.getPath().getName().isdigit())

    def record(self, number: int) -> dict:
        stream = self._files.open(self._hadoop.Path(self._folder, self.name(number)))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def add(self, number: int, content: dict) -> None:
        """Create a record, or raise ``Conflict``."""
        at = self._hadoop.Path(self._folder, self.name(number))
        if self._files.exists(at):
            raise Conflict(f"{at} exists")
        self._files.mkdirs(self._folder)
        try:
            stream = self._files.create(at, False)
        except Exception as error:
            if self._files.exists(at):
                raise Conflict(f"{at} exists") from error
            raise
        try:
            stream.writeUTF(json.dumps(content))
        finally:
            stream.close()

    def fresh(self) -> str:
        """A folder for data that no record names yet."""
        return f"{self.path}/data-{uuid.uuid4().hex}"


# --- snapshots ------------------------------------------------------------------


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """The number of the last snapshot and its record; 0 and None before the first."""
    ledger = Ledger(spark, path)
    numbers = ledger.numbers()
    return (numbers[-1], ledger.record(numbers[-1])) if numbers else (0, None)


def read_snapshot(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table as of its last snapshot or of a given one; a reader keeps it whatever is written meanwhile."""
    ledger = Ledger(spark, path)
    numbers = ledger.numbers()
    if not numbers:
        raise ValueError(f"{path} has no snapshot")
    return spark.read.parquet(ledger.record(numbers[-1] if number is None else number)["data"])


def write_snapshot(table: DataFrame, path: str, after: int, **notes) -> int:
    """Write the whole table as the snapshot that follows number ``after``; ``Conflict`` if another one already does."""
    ledger = Ledger(table.sparkSession, path)
    data = ledger.fresh()
    table.write.parquet(data)
    ledger.add(after + 1, {"data": data, **notes})
    return after + 1


def upsert(rows: DataFrame, path: str, keys: list[str], tries: int = 10) -> int:
    """Replace the rows whose ``keys`` occur in ``rows`` and add the others; a writer that lost a race begins again on the new state."""
    spark = rows.sparkSession
    for _ in range(tries):
        number, record = latest(spark, path)
        whole = rows
        if record is not None:
            held = spark.read.parquet(record["data"])
            whole = held.join(rows.select(*keys).distinct(), keys, "left_anti").select(*held.columns).unionByName(rows, allowMissingColumns=True)
        try:
            return write_snapshot(whole, path, number)
        except Conflict:
            continue
    raise Conflict(f"{path}: others wrote first {tries} times")


def save_batch(batch: DataFrame, path: str, batch_id: int) -> bool:
    """The whole state of a stream after a batch as a snapshot; False if that batch, or a later one, is there already."""
    number, record = latest(batch.sparkSession, path)
    if record is not None and record.get("batch", -1) >= batch_id:
        return False
    write_snapshot(batch, path, number, batch=batch_id)
    return True


# --- appends that count once ------------------------------------------------------


def append_once(rows: DataFrame, path: str, batch_id: int) -> bool:
    """Append a batch under its id; False if a batch of that id is there already. Rows keep their order as (batch, place)."""
    ledger = Ledger(rows.sparkSession, path)
    if batch_id in ledger.numbers():
        return False
    data = ledger.fresh()
    rows.withColumn("place", F.monotonically_increasing_id()).write.parquet(data)
    try:
        ledger.add(batch_id, {"data": data})
    except Conflict:  # another run of the same batch was first; this one's folder is never read
        return False
    return True


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all batches with ``batch`` and ``place``, which is the order in which they came."""
    ledger = Ledger(spark, path)
    records = {n: ledger.record(n)["data"] for n in ledger.numbers()}
    if not records:
        raise ValueError(f"{path} holds no batch")
    folder = F.element_at(F.split(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", ""), "/"), -1)
    batches = spark.createDataFrame([(d.rsplit("/", 1)[1], n) for n, d in records.items()], "_folder string, batch long")
    rows = spark.read.parquet(*records.values())
    return rows.withColumn("_folder", folder).join(F.broadcast(batches), "_folder").drop("_folder")  # a row for each batch


def compact(spark: SparkSession, path: str, target: str) -> None:
    """All batches as one table at ``target``; the order of rows stays, as it is stored with them."""
    read_appended(spark, path).write.parquet(target)
