"""A table of chunks whose documents are replaced as a whole, at once for all readers, and never by an older revision.

Rows lie in buckets of their document. A replacement reads and writes only the buckets that it touches, into a folder of
its own; a numbered manifest says which folder holds each bucket. Publishing is one rename of the new manifest to the next number,
which fails if another writer was there first: then the replacement is made again on what that writer left. Readers follow the highest
manifest, so that they see a replacement whole or not at all, and what a failed writer leaves is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kept import kept

MANIFESTS, BUCKET = "_manifests", "_bucket"


class Files:
    """The file system of a path, as Hadoop sees it."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        root, conf = self.path(path), spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = root.getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self.never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # never over an existing file

    def names(self, path: str) -> list[str]:
        at = self.path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.path(path), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def publish(self, staged: str, final: str) -> bool:
        """Whether the rename was the first to that name."""
        try:
            self.context.rename(self.fs.makeQualified(self.path(staged)), self.fs.makeQualified(self.path(final)), self.never)
        except Exception as error:
            if "FileAlreadyExists" not in str(error):
                raise
            return False
        return True


def manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """The number of the last manifest (0: none yet) and what it says: buckets, schema, folder by bucket."""
    numbers = [int(n.removesuffix(".json")) for n in Files(spark, path).names(f"{path}/{MANIFESTS}") if n.endswith(".json") and n[0].isdigit()]
    if not numbers:
        return 0, {}
    lines = spark.read.text(f"{path}/{MANIFESTS}/{max(numbers):012}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(lines)


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame | None:
    """The table as of its last manifest, or some of its buckets; None before the first."""
    number, said = manifest(spark, path)
    return rows_of(spark, path, said, only) if number else None


def rows_of(spark: SparkSession, path: str, said: dict, only: list[int] | None = None) -> DataFrame:
    folders = [f"{path}/{said['folders'][str(b)]}" for b in (only if only is not None else sorted(map(int, said["folders"]))) if str(b) in said["folders"]]
    schema = json.dumps(said["schema"])
    from pyspark.sql.types import StructType

    kind = StructType.fromJson(json.loads(schema))
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def replace(spark: SparkSession, path: str, documents: DataFrame, chunks: DataFrame, document: str, revision: str, buckets: int = 64, attempts: int = 10, before_publishing: Callable[[], None] | None = None) -> tuple[int, DataFrame]:
    """Put ``chunks`` in place of all rows of ``documents`` (document, revision); the manifest's number and the refused documents (document, revision, stored).

    A document is refused, and keeps its rows, where the table holds a newer revision of it. A document without chunks loses its rows; chunks of
    documents that aren't listed are left out. Both frames are read once, whatever the attempts. The number of buckets is fixed by the first write.
    """
    asked = kept(documents.select(F.col(document), F.col(revision)).groupBy(document).agg(F.max(revision).alias(revision)))
    new = kept(chunks)
    files = Files(spark, path)
    for _ in range(attempts):
        number, said = manifest(spark, path)
        n = said.get("buckets", buckets)
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        touched = sorted(r[0] for r in asked.select(place(document)).distinct().collect())  # at most n
        old = rows_of(spark, path, said, touched) if number else new.where("false")
        stored = old.groupBy(document).agg(F.max(revision).alias("stored"))
        judged = kept(asked.join(stored, document, "left").withColumn("ok", F.col("stored").isNull() | (F.col("stored") <= F.col(revision))))
        going = judged.where("ok").select(document)
        rows = old.join(going, document, "left_anti").unionByName(new.join(going, document, "left_semi").select(*old.columns))
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, place(document)).repartition(F.col(BUCKET)).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
        written = {name.removeprefix(f"{BUCKET}=") for name in files.names(f"{path}/{folder}") if name.startswith(f"{BUCKET}=")}
        folders = {b: f for b, f in said.get("folders", {}).items() if int(b) not in touched} | {b: f"{folder}/{BUCKET}={b}" for b in written}
        staged = f"{path}/{MANIFESTS}/staged-{uuid.uuid4().hex}"
        files.write(staged, json.dumps({"buckets": n, "schema": said.get("schema") or json.loads(new.schema.json()), "folders": folders}, sort_keys=True))
        if before_publishing:
            before_publishing()
        if files.publish(staged, f"{path}/{MANIFESTS}/{number + 1:012}.json"):
            return number + 1, judged.where("not ok").select(document, revision, "stored")
    raise RuntimeError(f"other writers were first {attempts} times")
