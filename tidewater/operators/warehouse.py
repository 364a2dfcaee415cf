"""Tables kept as immutable versions: upserts, surrogate keys, constraints, commits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.scratch import numbered


class ConstraintError(ValueError):
    """Rows break a stated constraint."""


class ConflictError(RuntimeError):
    """Another writer committed first."""


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """``target`` with ``source``'s rows: new keys are added, known ones take the columns in ``update``.

    A key that comes twice in ``source`` is an error. One full outer join; nothing is overwritten in place.
    """
    if not source.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ConstraintError(f"repeated {keys} in one batch")
    s = source.select(*[F.col(c).alias(f"_s_{c}") for c in source.columns], F.lit(True).alias("_new"))
    t = target.withColumn("_old", F.lit(True))
    joined = t.join(s, [F.col(k) == F.col(f"_s_{k}") for k in keys], "full")

    def pick(c: str) -> Column:
        if c not in source.columns:
            return F.col(c)
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"_s_{c}"))
        take = F.col("_new").isNotNull() & (F.lit(c in update) | F.col("_old").isNull())
        return F.when(take, F.col(f"_s_{c}")).otherwise(F.col(c))

    return joined.select(*[pick(c).alias(c) for c in target.columns])


def assign_keys(rows: DataFrame, natural: list[str], high: int, key: str = "sk") -> tuple[DataFrame, int]:
    """``rows`` with dense keys from ``high`` + 1 on, in order of the natural key, and the new highest key.

    Rows are evaluated and range-partitioned once and numbered by offsets of partitions: no window spans all rows. The
    caller keeps the highest key and hands it on, so keys never start over.
    """
    out, total = numbered(rows, natural, "_row")
    return out.withColumn(key, (F.col("_row") + (high + 1)).cast("long")).drop("_row"), high + total


def missing(source: DataFrame, target: DataFrame, natural: list[str]) -> DataFrame:
    """The rows of ``source`` whose natural key ``target`` lacks."""
    return source.join(target.select(*natural), natural, "left_anti")


def load_new(source: DataFrame, dimension: DataFrame, natural: list[str], key: str = "sk") -> DataFrame:
    """The rows that an incremental load adds to ``dimension``, with their new keys ("returning")."""
    high = dimension.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return assign_keys(missing(source, dimension, natural), natural, high, key)[0]


def violations(df: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, str] | None = None, foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(constraint, rows) of broken constraints: what a database would reject."""
    spark = df.sparkSession
    parts = [df.filter(F.col(c).isNull()).agg(F.lit(f"{c} not null").alias("constraint"), F.count("*").alias("rows")) for c in not_null]
    parts += [df.groupBy(*u).count().filter("count > 1").agg(F.lit(f"unique({', '.join(u)})").alias("constraint"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")) for u in unique]
    parts += [df.filter(~F.expr(c)).agg(F.lit(name).alias("constraint"), F.count("*").alias("rows")) for name, c in (checks or {}).items()]
    parts += [df.filter(F.col(c).isNotNull()).join(o.select(F.col(k).alias(c)), c, "left_anti").agg(F.lit(f"{c} references {k}").alias("constraint"), F.count("*").alias("rows")) for c, (o, k) in (foreign or {}).items()]
    out = spark.createDataFrame([], "constraint string, rows long")
    for p in parts:
        out = out.unionByName(p)
    return out.filter("rows > 0")


class VersionedTable:
    """A dataset as immutable versions and a pointer to the current one; readers see whole commits only.

    A commit writes a new version beside the others, then moves the pointer if it still names the version that the
    commit began from, and fails otherwise. Pointers are files whose creation succeeds for one writer only.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        log = self._path(f"{self.root}/_log")
        names = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max([int(n.split(".")[0]) for n in names if n.endswith(".json")], default=0)

    def read(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        if not at:
            raise FileNotFoundError(f"no version of {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/_log/{at:012d}.json"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return self.spark.read.parquet(f"{self.root}/{json.loads(text)['data']}")

    def commit(self, df: DataFrame, based_on: int | None = None) -> int:
        base = self.version() if based_on is None else based_on
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        pointer = self._path(f"{self.root}/_log/{base + 1:012d}.json")
        try:
            out = self._fs.create(pointer, False)
        except Exception as e:
            raise ConflictError(f"version {base + 1} of {self.root} is another writer's") from e
        out.write(json.dumps({"data": name}).encode())
        out.close()
        return base + 1


#: Column types of the target warehouse for Spark's.
REDSHIFT = {T.StringType: "VARCHAR(65535)", T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.DoubleType: "DOUBLE PRECISION", T.FloatType: "REAL", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMPTZ", T.TimestampNTZType: "TIMESTAMP", T.BinaryType: "VARBYTE"}


def ddl(table: str, schema: T.StructType, keys: list[str] = (), comment: str = "") -> str:
    """CREATE TABLE and COMMENT statements for a schema; descriptions are the fields' comments."""
    quote = lambda s: s.replace("'", "''")
    kind = lambda d: f"DECIMAL({d.precision},{d.scale})" if isinstance(d, T.DecimalType) else f"VARCHAR({d.length})" if isinstance(d, T.VarcharType) else REDSHIFT[type(d)]
    lines = [f"  {f.name} {kind(f.dataType)}" + " NOT NULL" * (not f.nullable) for f in schema]
    lines += [f"  PRIMARY KEY ({', '.join(keys)})"] if keys else []
    out = [f"CREATE TABLE {table} (\n" + ",\n".join(lines) + "\n);"]
    out += [f"COMMENT ON TABLE {table} IS '{quote(comment)}';"] if comment else []
    out += [f"COMMENT ON COLUMN {table}.{f.name} IS '{quote(f.metadata['comment'])}';" for f in schema if f.metadata.get("comment")]
    return "\n".join(out)


def contract(fields: list[tuple[str, str, bool, str]]) -> T.StructType:
    """A schema from (name, type, nullable, description); descriptions travel in Parquet files."""
    out = T.StructType()
    for name, kind, nullable, text in fields:
        out = out.add(T.StructField(name, T._parse_datatype_string(kind), nullable, {"comment": text}))
    return out


def allowed(name: str, names: list[str]) -> str:
    """``name`` if it is one of ``names``: parameters are values, identifiers must be listed."""
    if name not in names:
        raise ValueError(f"{name!r} isn't one of {names}")
    return name
