"""Pivots, unpivots, hierarchies and regular time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.scratch import written


def pivot(df: DataFrame, rows: list[str], column: str, values: list, cell: Column, fill=None) -> DataFrame:
    """A pivot with given column values, so that no job looks for them and the schema is fixed."""
    out = df.groupBy(*rows).pivot(column, values).agg(cell)
    return out if fill is None else out.na.fill(fill, [str(v) for v in values])


def pivot_margins(df: DataFrame, row: str, column: str, values: list[str], cell: Column, total: str = "total") -> DataFrame:
    """A pivot with a total row and a total column, from one pass over the data (CUBE)."""
    label = lambda c: F.when(F.grouping(c) == 1, F.lit(total)).otherwise(F.col(c).cast("string"))
    long = df.cube(row, column).agg(cell.alias("_cell"), label(row).alias("_row"), label(column).alias("_column"))
    return long.groupBy(F.col("_row").alias(row)).pivot("_column", [*values, total]).agg(F.first("_cell"))


def pivot_unique(df: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """A pivot without aggregation: two rows for one cell are an error."""
    lone = F.when(F.count(value) > 1, F.raise_error(F.lit("pivot has two values for one cell")).cast(df.schema[value].dataType)).otherwise(F.first(value, ignorenulls=True))
    return df.groupBy(row).pivot(column, values).agg(lone)


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str, keep_nulls: bool) -> DataFrame:
    out = df.unpivot(ids, values, name, value)
    return out if keep_nulls else out.filter(F.col(value).isNotNull())


def resample_days(df: DataFrame, day: str, days: int, cell: Column, fill=0) -> DataFrame:
    """Bins of ``days`` days from the first day on, empty ones filled: (bin, value).

    Only the first and last day are looked up apart; bins come from a sequence between them.
    """
    ends = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).filter("lo is not null")
    bins = ends.select(F.explode(F.expr(f"transform(sequence(0, cast(floor(datediff(hi, lo) / {days}) as int)), i -> date_add(lo, i * {days}))")).alias("bin"))
    put = df.crossJoin(F.broadcast(ends)).withColumn("bin", F.expr(f"date_add(lo, cast(floor(datediff(`{day}`, lo) / {days}) as int) * {days})"))
    return bins.join(put.groupBy("bin").agg(cell.alias("value")), "bin", "left").na.fill(fill, ["value"])


def found_values(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The column's distinct values in order, nulls aside; more than ``most`` are an error, since each becomes a column."""
    values = [r[0] for r in df.select(column).distinct().filter(F.col(column).isNotNull()).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(values)


def pivot_found(df: DataFrame, rows: list[str], column: str, cell: Column, fill=None) -> DataFrame:
    """A pivot whose columns are the values that the data hold."""
    return pivot(df, rows, column, found_values(df, column), cell, fill)


def stack(df: DataFrame, rows: list[str], name: str, value: str) -> DataFrame:
    """The columns other than ``rows`` back as (name, value) rows: what undoes a pivot."""
    return df.unpivot(rows, [c for c in df.columns if c not in rows], name, value)


def cross_section(df: DataFrame, **levels) -> DataFrame:
    """The rows at the given values of key columns, without those columns."""
    for name, value in levels.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.drop(*levels)


#: Nodes up to which a tree is walked on the driver.
SMALL_TREE = 20_000


def walked(links: list[tuple[int, int | None, str]], sep: str, limit: int) -> list[tuple]:
    """(id, name, level, path, ancestors) of the nodes of (id, parent, name) that hang on a root."""
    below, out = {}, []
    for row in links:
        below.setdefault(row[1], []).append(row)
    front = [(i, name, [i], [name]) for i, _, name in below.get(None, [])]
    while front:
        if len(front[0][2]) > limit + 1:
            raise ValueError(f"the tree has more than {limit} levels")
        out += [(i, name, len(ids) - 1, sep.join(names), ids) for i, name, ids, names in front]
        front = [(c, name, [*ids, c], [*names, name]) for i, _, ids, names in front for c, _, name in below.get(i, [])]
    return out


def flatten_tree(edges: DataFrame, nodes: DataFrame, node: str = "id", parent: str = "parent_id", name: str = "name", sep: str = " > ", limit: int = 100) -> DataFrame:
    """(node, name, level, path, ancestors) of every node reachable from a root.

    ``edges`` has each node's parent, null for a root. Ancestors are ids, the node itself last, so that a subtree is
    a test of membership and siblings with a common name prefix aren't mixed up. Each round every node's chain takes on the
    chain that its top has by then, so rounds are the logarithm of the depth. Nodes below a cycle or a parent that isn't
    there reach no root and are left out. More than ``limit`` levels are an error. A tree of at most ``SMALL_TREE`` nodes, which
    is looked at first, is walked on the driver.
    """
    named = nodes.select(F.col(node).cast("long").alias("id"), F.col(name).alias("name"))
    links = edges.select(F.col(node).cast("long").alias("id"), F.col(parent).cast("long").alias("up"))
    few = links.join(named, "id").select("id", "up", "name").limit(SMALL_TREE + 1).collect()
    if len(few) <= SMALL_TREE:
        return edges.sparkSession.createDataFrame(walked([tuple(r) for r in few], sep, limit), "id long, name string, level int, path string, ancestors array<long>")
    chains = written(links.join(named, "id").select("id", "up", F.array("id").alias("ids"), F.array("name").alias("names")))
    reach = 1
    while not chains.filter("up is not null").isEmpty():
        if reach > limit:
            deep = chains.filter("up is not null and size(array_distinct(ids)) = size(ids)")
            if not deep.isEmpty():
                raise ValueError(f"the tree has more than {limit} levels")
            break
        above = chains.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("ids").alias("above"), F.col("names").alias("above_names"))
        done, rest = chains.filter("up is null"), chains.filter("up is not null").join(above, "up")
        chains = written(done.union(rest.select("id", F.col("next").alias("up"), F.concat("above", "ids").alias("ids"), F.concat("above_names", "names").alias("names"))))
        reach *= 2
    whole = chains.filter("up is null")
    if not whole.filter(F.size("ids") > limit + 1).isEmpty():
        raise ValueError(f"the tree has more than {limit} levels")
    return whole.select("id", F.element_at("names", -1).alias("name"), (F.size("ids") - 1).alias("level"), F.array_join("names", sep).alias("path"), F.col("ids").alias("ancestors"))


def subtree(tree: DataFrame, root: int) -> DataFrame:
    return tree.filter(F.array_contains("ancestors", F.lit(root).cast("long")))
