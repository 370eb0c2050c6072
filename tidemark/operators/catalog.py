"""What is in the tables: profiles of datasets, and payloads judged before they are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols named in a profile.
SAMPLE = 10


def profile(rows: DataFrame, name: str, date: str | None = None, symbol: str | None = None, bad: Column | None = None) -> DataFrame:
    """One row: dataset, row_count, first_date, last_date, symbol_count, sample (the first symbols), columns, quality.

    ``quality`` is empty without rows, bad if ``bad`` holds for one, else good. One pass; the symbols are counted by
    themselves, so the sample needs no list of all of them.
    """
    nothing = F.lit(None).cast("string")
    day = F.col(date).cast("date") if date else F.lit(None).cast("date")
    about = rows.agg(F.count(F.lit(1)).alias("row_count"), F.min(day).alias("first_date"), F.max(day).alias("last_date"), F.count(F.when(bad if bad is not None else F.lit(False), 1)).alias("_bad"))
    if symbol:
        named = rows.where(F.col(symbol).isNotNull()).groupBy(F.col(symbol).cast("string").alias("s")).agg(F.lit(1).alias("_"))
        found = named.agg(F.count(F.lit(1)).alias("symbol_count"))
        first = named.orderBy("s").limit(SAMPLE).agg(F.array_join(F.sort_array(F.collect_list("s")), ",").alias("sample"))
        about = about.join(found, F.lit(True)).join(first, F.lit(True))  # tables of one row
    else:
        about = about.withColumns({"symbol_count": F.lit(None).cast("long"), "sample": nothing})
    quality = F.when(F.col("row_count") == 0, "empty").when(F.col("_bad") > 0, "bad").otherwise("good")
    return about.select(F.lit(name).alias("dataset"), "row_count", "first_date", "last_date", "symbol_count", "sample", F.lit(",".join(rows.columns)).alias("columns"), quality.alias("quality"))


def catalog(*profiles: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, profiles)


def payload_problem(payload: Column, keys: list[str], required: list[str] = (), most_bytes: int = 16 << 10) -> Column:
    """Why a JSON payload is refused: too_large, malformed, duplicate_key (at any depth), not_object, extra_key, key_missing;
    null if it is not. A null payload is malformed.

    A duplicate key is what the strict parser of VARIANT refuses of a text that the lenient one reads.
    """
    value, lenient = F.try_parse_json(payload), F.get_json_object(payload, "$")
    names = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    known = F.array(*[F.lit(k) for k in keys])
    needed = F.array(*[F.lit(k) for k in required]) if required else F.array().cast("array<string>")
    return (
        F.when(payload.isNull(), "malformed").when(F.octet_length(payload) > most_bytes, "too_large").when(value.isNull() & lenient.isNull(), "malformed").when(value.isNull(), "duplicate_key")
        .when(~F.schema_of_variant(value).startswith("OBJECT"), "not_object").when(F.size(F.array_except(names, known)) > 0, "extra_key").when(F.size(F.array_except(needed, names)) > 0, "key_missing"))
