"""Readers: dirty CSV, files of differing schemas, footers of Parquet files, Arrow IPC."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: From narrow to wide; a column takes the widest type that its files have.
NUMERIC = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def csv_infer(spark: SparkSession, path: str, delimiters: str = ",;|\t") -> DataFrame:
    """A CSV whose delimiter, header and types are found out: types over all rows, a column of mixed values becoming text.

    The delimiter is the candidate that occurs alike often, and most often, in the first lines; they have a header if no cell
    of the first line is a number and a later line has one in the same place, or if all are names that don't come again.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(20).collect() if r["value"]]
    if not lines:
        return spark.createDataFrame([], "")
    regular = {d: len({line.count(d) for line in lines}) == 1 for d in delimiters}
    sep = max(delimiters, key=lambda d: (regular[d] and d in lines[0], lines[0].count(d)))
    cells = [line.split(sep) for line in lines]

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    head, body = cells[0], cells[1:]
    later = [any(i < len(row) and number(row[i]) for row in body) for i in range(len(head))]
    header = bool(body) and not any(map(number, head)) and (any(later) or all(c not in {r[i] for r in body if i < len(r)} for i, c in enumerate(head)))
    return spark.read.csv(path, sep=sep, header=header, inferSchema=True)


def csv_quarantine(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, rejects): rows that fit the schema, and (line, column_name, error_type, value, csv_line) for what doesn't.

    ``error_type`` is CAST for a cell of another type, MISSING COLUMNS for a line with too few cells (at the first
    column that it lacks) and TOO MANY COLUMNS for one with more (no column). Either takes the whole line out of the good
    rows. An empty cell is null. Lines are numbered in the files' order, the header not counted, from offsets of
    partitions: no single task sees all lines.
    """
    from pyspark.sql import Window

    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("_corrupt", T.StringType())])
    text = spark.read.schema(raw).option("header", header).option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    text = text.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    names = [f.name for f in schema]
    tries = {f.name: F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") for f in schema}
    fault = lambda column, kind, value: F.struct(column.cast("string").alias("column_name"), F.lit(kind).alias("error_type"), value.cast("string").alias("value"))
    bad = [F.when(F.col(n).isNotNull() & tries[n].isNull(), fault(F.lit(n), "CAST", F.col(n))) for n in names]
    # Spark keeps the text of a line only if its cells are too few or too many.
    cells = F.size(F.split(F.regexp_replace("_corrupt", '"[^"]*"', ""), ","))
    ragged = F.when(F.col("_corrupt").isNotNull(), F.when(cells > len(names), fault(F.lit(None), "TOO MANY COLUMNS", F.lit(None))).otherwise(fault(F.element_at(F.array(*map(F.lit, names)), F.least(cells, F.lit(len(names) - 1)) + 1), "MISSING COLUMNS", F.lit(None))))
    line = F.coalesce("_corrupt", F.concat_ws(",", *[F.coalesce(n, F.lit("")) for n in names]))
    marked = text.withColumns({"_bad": F.array_compact(F.array(ragged, *bad)), "_csv": line})
    good = marked.filter(F.size("_bad") == 0).select(*[tries[n].alias(n) for n in names])

    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = text.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = starts.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    lost = marked.filter(F.size("_bad") > 0).join(F.broadcast(starts), "_part").withColumn("line", F.col("_at") + F.col("_shift"))
    return good, lost.select("line", F.explode("_bad").alias("b"), F.col("_csv").alias("csv_line")).select("line", "b.column_name", "b.error_type", "b.value", "csv_line")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files under ``path``, a glob or a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def hive_partitioned(spark: SparkSession, root: str, *globs: str) -> DataFrame:
    """Files under ``root``/``globs`` with the folders' key=value names below ``root`` as columns; filters on them prune folders."""
    return spark.read.option("basePath", root).parquet(*([f"{root.rstrip('/')}/{g}" for g in globs] or [root]))


def json_infer(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON with its schema found over all rows: objects become structs, arrays arrays."""
    return spark.read.json(path)


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: str, tasks: int = 4) -> DataFrame:
    """The rows of a table of a SQLite file that executors can open, read in ranges of its row ids, a range a task."""
    import sqlite3

    if not table.isidentifier():
        raise ValueError(f"{table!r} isn't a table's name")
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {table}").fetchone()
    step = max(1, -(-(high - low + 1) // tasks))
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(batches: Iterator) -> Iterator:
        import sqlite3

        import pandas as pd

        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            for batch in batches:
                for start in batch["id"]:
                    rows = db.execute(f"select {', '.join(names)} from {table} where rowid between ? and ?", (int(start), int(start) + step - 1))
                    while some := rows.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names)

    return spark.range(low, high + 1, step, max(1, min(tasks, high - low + 1))).mapInPandas(run, schema)


class BatchReader:
    """The rows of ``df`` as Arrow batches of ``size`` rows, one after another, once; nothing runs before the first is asked for.

    Only one partition at a time is on the driver. ``schema`` is known before, so a reader without rows has it too.
    """

    def __init__(self, df: DataFrame, size: int = 10_000):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(df.schema)
        self._batches = self._read(df, size)

    def _read(self, df: DataFrame, size: int) -> Iterator:
        import pyarrow as pa

        held: list = []
        names = self.schema.names
        for row in df.toLocalIterator(prefetchPartitions=True):
            held.append(tuple(row))
            if len(held) == size:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], self.schema.field(i).type) for i in range(len(names))], schema=self.schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], self.schema.field(i).type) for i in range(len(names))], schema=self.schema)

    def __iter__(self) -> BatchReader:
        return self

    def __next__(self):
        return next(self._batches)


def enriched(reader: BatchReader, f) -> tuple:
    """(schema, batches) of ``f`` on each batch: the first is made at once to learn its schema, the rest when asked for.

    A reader without batches keeps its own schema.
    """
    first = next(reader, None)
    if first is None:
        return reader.schema, iter(())
    made = f(first)

    def rest() -> Iterator:
        yield made
        yield from map(f, reader)

    return made.schema, rest()


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both; text where there is none."""
    if a == b:
        return a
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if a in NUMERIC and b in NUMERIC:
        pair = {type(a), type(b)}
        if T.FloatType in pair and pair & {T.IntegerType, T.LongType}:
            return T.DoubleType()
        return max(a, b, key=NUMERIC.index)
    return T.StringType()


def union_by_name(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The files' rows under one schema: columns by name, widened where types differ, null where a file lacks them.

    Schemas come from the footers, read by tasks. Files of the same schema are read together, so the plan has one scan for
    each distinct schema.
    """
    columns = file_columns(spark, paths).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "column", "type"))).alias("c"))
    kinds = columns.groupBy("c").agg(F.collect_list("path").alias("paths")).collect()
    schemas = [(T._parse_datatype_string(", ".join(f"`{x['column']}` {x['type']}" for x in r["c"])), sorted(r["paths"])) for r in sorted(kinds, key=lambda r: min(r["paths"]))]
    types: dict[str, T.DataType] = {}
    for s, _ in schemas:
        for f in s:
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
    out = None
    for s, some in schemas:
        part = spark.read.schema(s).parquet(*some)
        part = part.select(*[(F.col(n) if n in s.names else F.lit(None)).cast(t).alias(n) for n, t in types.items()])
        out = part if out is None else out.unionByName(part)
    return out


def drift(spark: SparkSession, paths: list[str], contract: T.StructType) -> DataFrame:
    """(path, column, wanted, found) where a file's columns aren't the contract's; ``wanted`` or ``found`` is null where there is none."""
    wanted = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in contract], "column string, wanted string")
    has = file_columns(spark, paths).select("path", "column", F.col("type").alias("found"))
    due = has.select("path").distinct().crossJoin(F.broadcast(wanted))
    return due.join(has, ["path", "column"], "full").filter(~F.col("wanted").eqNullSafe(F.col("found")))


def tails(batches: Iterator, at: str = "path") -> Iterator[tuple[str, int, bytes]]:
    """(path, file size, footer bytes) of Parquet files by two reads at their ends, through Arrow's file systems; memory-bounded."""
    import struct
    from urllib.parse import urlparse

    import pyarrow.fs as fs

    for batch in batches:
        for path in batch[at]:
            url = urlparse(path)
            store, name = (fs.LocalFileSystem(), url.path or path) if url.scheme in ("", "file") else fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                size = f.size()
                tail = f.read_at(8, size - 8)
                length = struct.unpack("<I", tail[:4])[0]
                yield path, size, f.read_at(length, size - 8 - length) + tail


def footers_of(spark: SparkSession, paths: list[str], schema: str, rows) -> DataFrame:
    """``rows`` (path, size, footer length, metadata) of each Parquet file under ``paths``, tasks reading the files' ends only.

    A store that Arrow doesn't know is read through Spark's binary source, file by file.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(list(paths))
    names = [f.name for f in T._parse_datatype_string(schema)]

    def table(path: str, size: int, footer: bytes):
        import io

        import pandas as pd
        import pyarrow.parquet as pq

        # A footer alone, between the marks that a file begins and ends with, is a file without rows' bytes.
        meta = pq.read_metadata(io.BytesIO(b"PAR1" + footer))
        return pd.DataFrame(rows(path, size, len(footer) - 8, meta), columns=names)

    def by_range(batches: Iterator) -> Iterator:
        for path, size, footer in tails(batches):
            yield table(path, size, footer)

    def whole(batches: Iterator) -> Iterator:
        import struct

        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                data = bytes(data)
                yield table(path, len(data), data[-8 - struct.unpack("<I", data[-8:-4])[0] :])

    known = F.regexp_extract("path", "^([a-z0-9]+):", 1).isin("", "file", "hdfs", "s3", "gs", "gcs")
    near = found.filter(known).select("path")
    near = near.repartition(max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1000)), "path").mapInPandas(by_range, schema)
    schemes = [r[0] for r in found.filter(~known).select(F.regexp_extract("path", "^([a-z0-9]+):", 1)).distinct().collect()]
    return near.union(found.filter(~known).select("path", "content").mapInPandas(whole, schema)) if schemes else near


def file_columns(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, place, column, type): the columns of each Parquet file, with Spark's types."""

    def rows(path, size, length, meta):
        from pyspark.sql.pandas.types import from_arrow_type

        fields = meta.schema.to_arrow_schema()
        return [(path, i, f.name, from_arrow_type(f.type, True).simpleString()) for i, f in enumerate(fields)]

    return footers_of(spark, paths, "path string, place int, column string, type string", rows)


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, row_groups, created_by, file_size, footer_size) of each Parquet file under ``path``."""
    rows = lambda name, size, length, meta: [(name, meta.num_rows, meta.num_row_groups, meta.created_by, size, length)]
    return footers_of(spark, [path], "file string, rows long, row_groups long, created_by string, file_size long, footer_size long", rows)


def parquet_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the free metadata of each Parquet file under ``path``."""
    rows = lambda name, size, length, meta: [(name, k.decode(), v.decode("utf-8", "replace")) for k, v in (meta.metadata or {}).items()]
    return footers_of(spark, [path], "file string, key string, value string", rows)


def parquet_columns(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, physical, logical, repetition) of the leaves of each Parquet file's schema; levels tell the repetition."""

    def rows(name, size, length, meta):
        for i in range(meta.num_columns):
            c = meta.schema.column(i)
            kind = "REPEATED" if c.max_repetition_level else "OPTIONAL" if c.max_definition_level else "REQUIRED"
            yield name, c.path, c.physical_type, str(c.logical_type), kind

    return footers_of(spark, [path], "file string, name string, physical string, logical string, repetition string", lambda *a: list(rows(*a)))


FOOTER = "file string, row_group int, rows long, column string, physical string, compression string, encodings string, compressed long, uncompressed long, min string, max string, nulls long"


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each column chunk of the Parquet files under ``path``, from their footers."""

    def rows(name, size, length, meta):
        out = []
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            for c in range(group.num_columns):
                chunk = group.column(c)
                s = chunk.statistics
                ends = (str(s.min), str(s.max), s.null_count) if s is not None and s.has_min_max else (None, None, None)
                out.append((name, g, group.num_rows, chunk.path_in_schema, chunk.physical_type, chunk.compression, ", ".join(sorted(chunk.encodings)), chunk.total_compressed_size, chunk.total_uncompressed_size, *ends))
        return out

    return footers_of(spark, [path], FOOTER, rows)


def row_groups_skippable(footers: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """(groups, skippable): row groups whose statistics prove that no value lies in [low, high]."""
    mine = footers.filter(F.col("column") == column).withColumns({"lo": F.expr("try_cast(min as double)"), "hi": F.expr("try_cast(max as double)")})
    return mine.agg(F.count("*").alias("groups"), F.count_if((F.col("hi") < low) | (F.col("lo") > high)).alias("skippable"))


def arrow_ipc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of Arrow IPC files (file or stream format) under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0):
                buffer = data.as_buffer()
                reader = pa.ipc.open_file(buffer) if buffer[:6].to_pybytes() == b"ARROW1" else pa.ipc.open_stream(buffer)
                yield from (reader.get_batch(i) for i in range(reader.num_record_batches)) if hasattr(reader, "get_batch") else reader

    return files.mapInArrow(run, schema)
