"""A thin fluent face over DataFrames: filter, project, aggregate, order, limit, join, and SQL on a name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Relation:
    """A lazy query; each call gives a new one and nothing runs before its rows are asked for."""

    def __init__(self, df: DataFrame, name: str = "relation"):
        self.df, self.name = df, name

    @classmethod
    def parquet(cls, spark: SparkSession, path: str) -> Relation:
        return cls(spark.read.parquet(path))

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def types(self) -> list[str]:
        return [f.dataType.simpleString() for f in self.df.schema]

    def filter(self, condition: str) -> Relation:
        return Relation(self.df.filter(condition), self.name)

    def project(self, *expressions: str) -> Relation:
        return Relation(self.df.selectExpr(*expressions), self.name)

    def aggregate(self, aggregates: str, groups: str = "") -> Relation:
        return self.query("r", f"select {groups + ', ' if groups else ''}{aggregates} from r" + (f" group by {groups}" if groups else ""))

    def order(self, by: str) -> Relation:
        return self.query("r", f"select * from r order by {by}")

    def limit(self, n: int, offset: int = 0) -> Relation:
        return Relation(self.df.limit(n + offset).offset(offset), self.name)

    def join(self, other: Relation, on: str, how: str = "inner") -> Relation:
        if self.df.sparkSession is not other.df.sparkSession:
            raise ValueError("relations of different sessions can't be joined")
        return Relation(self.df.join(other.df, [c.strip() for c in on.split(",")], how), self.name)

    def set_alias(self, name: str) -> Relation:
        return Relation(self.df.alias(name), name)

    def query(self, name: str, sql: str) -> Relation:
        """``sql`` with this relation under ``name``, which no view outside is touched by."""
        unique = f"{name}_{id(self):x}"
        self.df.createOrReplaceTempView(unique)
        try:
            return Relation(self.df.sparkSession.sql(f"with {name} as (select * from {unique}) {sql}"), self.name)
        finally:
            self.df.sparkSession.catalog.dropTempView(unique)

    def register(self, name: str, replace: bool = True) -> None:
        (self.df.createOrReplaceTempView if replace else self.df.createTempView)(name)

    def unregister(self, name: str) -> bool:
        """Takes the name away; whether it was there."""
        return self.df.sparkSession.catalog.dropTempView(name)

    def fetchall(self) -> list:
        return self.df.collect()

    def fetchone(self):
        """The first row, or None."""
        return self.df.first()

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow(self):
        return self.df.toArrow()

    def to_batches(self, size: int = 10_000):
        """A lazy reader of Arrow batches of ``size`` rows."""
        from tidewater.sources.readers import BatchReader

        return BatchReader(self.df, size)

    def explain(self) -> None:
        self.df.explain("formatted")
