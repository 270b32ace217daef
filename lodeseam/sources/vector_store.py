"""Vectors in namespaces: Parquet under ``vectors/namespace=…`` beside one row that says dimension and metric.

Writing replaces whole namespaces by dynamic partition overwrite: Spark writes the new files aside and swaps them in when
the job commits, so a failed job, or a lost executor, leaves what was there. Adding to a namespace keeps the newest row of
an id. Nothing is written before every row is checked: a blank namespace, a blank or repeated id, a vector of another
dimension or with a number that isn't finite stops the job. A folder's name is the namespace after a letter, so that Spark
never reads one as a number.

Rows of a namespace are numbered by batch, at most so many rows and bytes each (``windows.batches``): what a client that
sends batches would send. Reading one namespace prunes the others' files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseam.functions.vectors import METRICS, valid
from lodeseam.operators import windows

META = "dimension int, metric string"
BATCH_ROWS, BATCH_BYTES = 50, 750_000
#: Column of the vectors' table beside what the caller gives.
BATCH = "batch"
MARK = "n"


class IndexMismatch(ValueError):
    """The index has another dimension or metric."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def validate_dimension(model: int, index: int) -> None:
    """The embedding model's vectors must fit the index."""
    if model != index:
        raise IndexMismatch(f"the model makes vectors of {model} numbers, the index holds {index}")


class VectorStore:
    """An index at a path that all machines reach. Make one by ``open``."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, metric: str):
        self.spark, self.path, self.dimension, self.metric = spark, path.rstrip("/"), dimension, metric

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine") -> VectorStore:
        """The index, made where there is none; one of another dimension or metric is refused."""
        if metric not in METRICS or dimension <= 0:
            raise ValueError(f"no index of {dimension} numbers by {metric}")
        meta = f"{path.rstrip('/')}/meta"
        if not _exists(spark, meta):
            spark.createDataFrame([(dimension, metric)], META).coalesce(1).write.mode("error").json(meta)
        for row in spark.read.schema(META).json(meta).collect():
            validate_dimension(dimension, row["dimension"])
            if row["metric"] != metric:
                raise IndexMismatch(f"the index measures by {row['metric']}, not by {metric}")
        return cls(spark, path, dimension, metric)

    @property
    def vectors(self) -> str:
        return f"{self.path}/vectors"

    def checked(self, rows: DataFrame) -> DataFrame:
        """The rows; a bad one stops the query. ``namespace``, ``id``, ``values`` and any other columns."""
        blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
        finite = F.coalesce(~F.exists("values", lambda x: F.abs(x) == float("inf")), F.lit(False))
        wrong = (
            F.when(blank("namespace"), F.lit("a row has no namespace")).when(blank("id"), F.lit("a vector has no id"))
            .when(~(valid(F.col("values"), self.dimension) & finite), F.concat(F.lit(f"not a vector of {self.dimension} finite numbers: "), F.col("id").cast("string")))
            .when(F.count(F.lit(1)).over(Window.partitionBy("namespace", "id")) > 1, F.concat(F.lit("an id is given twice: "), F.col("id").cast("string")))
        )
        guard = F.when(wrong.isNull(), F.trim(F.col("namespace").cast("string"))).otherwise(F.raise_error(wrong).cast("string"))
        return rows.withColumns({"namespace": guard, "values": F.col("values").cast("array<double>")})

    def write(self, rows: DataFrame, replace: bool = True, batch_rows: int = BATCH_ROWS, batch_bytes: int = BATCH_BYTES) -> int:
        """Put the rows into their namespaces and return how many there were. ``replace``: a namespace holds these rows
        alone afterwards; else rows of other ids stay."""
        new = self.checked(rows)
        if not replace and self.populated():
            old = self.read().drop(BATCH).join(new.select("namespace").distinct(), "namespace", "left_semi")
            new = old.join(new.select("namespace", "id"), ["namespace", "id"], "left_anti").unionByName(new.select(*old.columns))
        size = F.octet_length(F.to_json(F.struct(*new.columns)))
        new = new.withColumn("namespace", F.concat(F.lit(MARK), "namespace"))
        numbered = windows.batches(new.withColumn("__bytes", size), "namespace", ["id"], "__bytes", batch_rows, batch_bytes).drop("__bytes")
        numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(self.vectors)
        return rows.count()

    def replace_namespace(self, namespace: str, rows: DataFrame, **bounds: int) -> int:
        """Make the rows all that a namespace holds, be they none; a row of another namespace stops it before anything
        is written."""
        namespace = namespace.strip()
        if not namespace:
            raise ValueError("the namespace is blank")
        foreign = F.when(F.trim("namespace") == namespace, F.col("namespace")).otherwise(F.raise_error(F.concat(F.lit("a row of another namespace: "), F.coalesce("namespace", F.lit("null")))).cast("string"))
        if rows.isEmpty():
            self.delete(namespace)
            return 0
        return self.write(rows.withColumn("namespace", foreign), replace=True, **bounds)

    def delete(self, namespace: str) -> None:
        """Remove a namespace; one that was never there is no error."""
        found = self.spark.createDataFrame([(MARK + namespace.strip(),)], "n string").select(self._folder(F.col("n"))).first()[0]
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.vectors}/{found}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    @staticmethod
    def _folder(namespace: Column) -> Column:
        """The partition's folder: signs that Hive's layout escapes are written as %XX."""
        signs = r"([\x00-\x1F\x7F\"#%'*/:=?\\{\[\]\^])"
        parts = F.transform(F.regexp_extract_all(namespace, F.lit(f"(?s){signs}|."), F.lit(0)), lambda c: F.when(c.rlike(signs), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c))
        return F.concat(F.lit("namespace="), F.array_join(parts, ""))

    def populated(self) -> bool:
        return _exists(self.spark, self.vectors) and not self.spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.vectors).isEmpty()

    def read(self, *namespaces: str) -> DataFrame:
        """The vectors of the namespaces, of all where none is named."""
        rows = self.spark.read.parquet(self.vectors)
        rows = rows.withColumn("namespace", F.substring("namespace", 1 + len(MARK), 1 << 30))
        return rows.where(F.col("namespace").isin(*namespaces)) if namespaces else rows
