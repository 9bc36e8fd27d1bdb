"""What people decided, as a table of versions that several reviewers can write to at once.

A version is a Parquet table of its own that never changes. Which one counts is said by files named after numbers: a
writer that has merged its decisions into version n creates the file n + 1, which can be done once only. Whoever comes
second reads the new version, merges again and tries the next number; so no decision is lost, and readers see one
version or the next, never half of one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "email_id string, decision string, defect_fields array<string>, corrections struct<si:map<string,string>,bl:map<string,string>>, reviewer string, note string"
#: Times that a writer is overtaken before it gives up.
TRIES = 50


class _Store:
    """A folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def newest(self) -> int:
        """The number of the version that counts, 0 without any."""
        home = self.path("versions")
        names = [x.getPath().getName() for x in self.fs.listStatus(home)] if self.fs.exists(home) else []
        return max([0, *(int(n) for n in names if n.isdigit())])

    def table(self, version: int) -> str:
        found = self.fs.open(self.path(f"versions/{version:012d}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(found, "UTF-8")
        finally:
            found.close()

    def claim(self, version: int, table: str) -> bool:
        """Makes ``table`` that version, unless there is one."""
        from py4j.protocol import Py4JJavaError

        own = self.path(f"claims/{uuid.uuid4().hex}")
        out = self.fs.create(own, False)
        out.write(bytearray(table.encode()))
        out.close()
        target = self.path(f"versions/{version:012d}")
        self.fs.mkdirs(target.getParent())
        try:
            kinds = self.jvm.org.apache.hadoop.fs.Options.Rename
            options = self.jvm.java.lang.reflect.Array.newInstance(kinds.NONE.getClass(), 1)
            options[0] = kinds.NONE  # fails where the target exists
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(own, target, options)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new decisions as one table, the new one of a message counting."""
    return new.unionByName(old.join(new.select("email_id"), "email_id", "left_anti"))


def read_saved(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions of the version that counts, one row a message; none where nobody has decided yet."""
    store = _Store(spark, folder)
    version = store.newest()
    if not version:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{store.folder}/tables/{store.table(version)}")


def save(new: DataFrame, folder: str) -> int:
    """Adds decisions (columns of :data:`SCHEMA`, those that are missing being null) and returns the version that has them.

    Of several rows of a message in ``new`` one counts; what others have saved meanwhile stays.
    """
    spark = new.sparkSession
    store = _Store(spark, folder)
    columns = [f.name for f in spark.createDataFrame([], SCHEMA).schema]
    types = {f.name: f.dataType for f in spark.createDataFrame([], SCHEMA).schema}
    whole = new.select(*[(F.col(c) if c in new.columns else F.lit(None)).cast(types[c]).alias(c) for c in columns]).dropDuplicates(["email_id"])
    for _ in range(TRIES):
        version, table = store.newest(), uuid.uuid4().hex
        merged(read_saved(spark, folder), whole).write.parquet(f"{store.folder}/tables/{table}")
        if store.claim(version + 1, table):
            return version + 1
    raise RuntimeError(f"overtaken {TRIES} times")
