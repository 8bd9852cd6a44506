"""JSON-lines logs: tolerant of blank, broken and foreign lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import tool_kind


def kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (file order) and value of a text file's lines.

    Lines are numbered by where they stand in the scan: ids grow along the file, which is all that order needs.
    """
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def usage(raw: DataFrame) -> DataFrame:
    """(line_no, ts, tool, args) of lines that are objects with string ts and tool; args that are no object count as {}."""
    v = raw.select("line_no", F.try_parse_json("value").alias("v")).filter("v is not null")
    get = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    good = v.filter((kind_of(get("ts")) == "STRING") & (kind_of(get("tool")) == "STRING"))
    args = F.when(kind_of(get("args")).startswith("OBJECT"), get("args")).otherwise(F.parse_json(F.lit("{}")))
    return good.select("line_no", F.try_variant_get("v", "$.ts", "string").alias("ts"), F.try_variant_get("v", "$.tool", "string").alias("tool"), args.alias("args"))


def timeline(raw: DataFrame, own_prefix: str) -> DataFrame:
    """(line_no, item_no, kind, detail) of the tool calls in a transcript that are own calls or searches."""
    v = raw.select("line_no", F.try_parse_json("value").alias("v"))
    content = F.try_variant_get("v", "$.message.content", "variant")
    arrays = v.filter(kind_of(content).startswith("ARRAY")).select("line_no", F.try_variant_get("v", "$.message.content", "array<variant>").alias("items"))
    each = arrays.select("line_no", F.posexplode("items").alias("item_no", "item"))
    get = lambda name: F.try_variant_get("item", f"$.{name}", "variant")
    text = lambda name: F.when(kind_of(get(name)) == "STRING", F.try_variant_get("item", f"$.{name}", "string"))
    calls = each.filter((text("type") == "tool_use") & text("name").isNotNull())
    named = calls.select("line_no", "item_no", text("name").alias("name"), text("input.command").alias("command"), text("input.pattern").alias("pattern"), text("input.query").alias("query"))
    kind = tool_kind(F.col("name"), F.col("command"), own_prefix)
    return named.select("line_no", "item_no", kind.alias("kind"), F.coalesce("command", "pattern", "query", "name").alias("detail")).filter("kind is not null")
