"""JSON columns and nested customer profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field metadata that marks a text column as JSON.
MARK = {"logical": "json"}


def is_json(df: DataFrame, column: str) -> bool:
    return column in df.columns and df.schema[column].metadata.get("logical") == "json"


def as_json(df: DataFrame, column: str) -> DataFrame:
    """Marks a text column as JSON; its content isn't looked at."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"{column} isn't text")
    return df.withMetadata(column, df.schema[column].metadata | MARK)


def _check(df: DataFrame, column: str) -> None:
    if not is_json(df, column):
        raise ValueError(f"{column} isn't marked as JSON")


def normalize(df: DataFrame, column: str) -> DataFrame:
    """The JSON column compact, keys sorted; null stays null and malformed text is an error."""
    _check(df, column)
    return df.withColumn(column, F.to_json(F.parse_json(column))).withMetadata(column, df.schema[column].metadata)


def state(v: Column, path: str) -> Column:
    """Whether a path is present, null or absent ('presente', 'nulo', 'ausente': fixed values)."""
    got = F.variant_get(v, path, "variant")
    return F.when(got.isNull(), "ausente").when(F.is_variant_null(got), "nulo").otherwise("presente")


def shred(df: DataFrame, column: str) -> DataFrame:
    """The JSON column replaced, in place, by typed columns; a document that isn't an object, or a value that isn't a number, is an error.

    Decimals come from the text, rounded half to even to two places. A null document has nulls and state 'ausente'.
    """
    _check(df, column)
    v = F.col("_doc")
    parsed = df.withColumn("_doc", F.parse_json(column))
    object_ = F.schema_of_variant(v).startswith("OBJECT")
    parsed = parsed.withColumn("_doc", F.when(F.col("_doc").isNotNull() & ~object_, F.raise_error(F.lit("not a JSON object")).cast("variant")).otherwise(F.col("_doc")))
    kind = F.schema_of_variant(F.variant_get(v, "$.valor", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|VOID)") | kind.isNull(), F.variant_get(v, "$.valor", "decimal(38,18)")).otherwise(F.raise_error(F.lit("valor isn't a number")).cast("decimal(38,18)"))
    fields = {
        "canal": F.variant_get(v, "$.canal", "string"),
        "valor_exato": F.bround(number, 2).cast("decimal(12,2)"),
        "valor_float": number.cast("double"),
        "valor_estado": F.coalesce(state(v, "$.valor"), F.lit("ausente")),
        "num_tags": F.when(F.variant_get(v, "$.tags", "array<variant>").isNotNull(), F.size(F.variant_get(v, "$.tags", "array<variant>"))).cast("int"),
        "cliente_id": F.variant_get(v, "$.cliente.id", "long"),
    }
    out = [c.alias(n) for name in df.columns for n, c in (fields.items() if name == column else [(name, F.col(name))])]
    return parsed.select(*out)


def flatten_profile(df: DataFrame, reference) -> DataFrame:
    """One flat row a customer: city, tag count, preferred channel, day of sign-up and days since, activity.

    The address must have a city and the sign-up must be a timestamp, or the call fails.
    """
    address = df.schema["address"].dataType
    if "city" not in getattr(address, "names", []):
        raise ValueError("address has no city")
    if not isinstance(df.schema["signup_ts"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError("signup_ts isn't a timestamp")
    day = F.to_date("signup_ts")
    return df.select(
        "customer_id", F.col("address.city").alias("city"), F.size("tags").alias("num_tags"), F.col("preferences")["canal"].alias("canal"),
        day.alias("signup_day"), F.datediff(F.lit(reference).cast("date"), day).alias("days_since_signup"), "is_active",
    )


def reverse_bytes(column: str) -> Column:
    """The bytes from last to first; Spark's own reverse takes text and arrays only."""
    pairs = F.regexp_extract_all(F.hex(column), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(pairs), ""))


def transform_types(df: DataFrame) -> DataFrame:
    """One transformation for each of eleven types; the schema stays. Columns: texto, inteiro, real, logico, dia, instante, valor, lista, estrutura, mapa, binario."""
    return df.select(
        F.upper("texto").alias("texto"), (F.col("inteiro") + 1).alias("inteiro"), (F.col("real") * 2).alias("real"), (~F.col("logico")).alias("logico"),
        F.date_add("dia", 30).alias("dia"), (F.col("instante") + F.expr("interval 1 hour")).alias("instante"),
        F.bround(F.col("valor") * F.lit("1.10").cast("decimal(4,2)"), 2).cast(df.schema["valor"].dataType).alias("valor"),
        F.transform("lista", F.upper).alias("lista"),
        F.struct(F.upper("estrutura.nome").alias("nome"), (F.col("estrutura.n") * 2).alias("n")).cast(df.schema["estrutura"].dataType).alias("estrutura"),
        F.transform_values("mapa", lambda k, v: F.upper(v)).alias("mapa"), reverse_bytes("binario").alias("binario"),
    )
