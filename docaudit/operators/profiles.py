"""I3 over nested profiles: layers of JSON objects overlaid key by key.

An object is taken apart into leaves, each with its path; layers meet leaf by leaf, and what wins is put together again. Objects merge,
everything else, lists too, is replaced whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_leaves(layers: DataFrame, keys: list[str], text: str = "text", depth: int = 8) -> DataFrame:
    """keys, path (array of names), value (JSON text) of every leaf; an empty object is a leaf. Objects below ``depth`` levels count as values.

    Text that is no JSON object has no leaves.
    """
    members = F.expr("try_variant_get(v, '$', 'map<string,variant>')")
    rows = layers.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(F.col(text)).alias("v")).withColumn("m", members)
    rows = rows.where(F.col("m").isNotNull())
    found = None
    for _ in range(depth):
        inner = rows.where(F.size("m") > 0).select(*keys, "path", F.explode("m").alias("_name", "v"))
        inner = inner.select(*keys, F.concat("path", F.array("_name")).alias("path"), "v").withColumn("m", members)
        leaves = inner.where(F.col("m").isNull() | (F.size("m") == 0)).select(*keys, "path", F.to_json("v").alias("value"))
        found = leaves if found is None else found.unionByName(leaves)
        rows = inner.where(F.size("m") > 0)
    return found.unionByName(rows.select(*keys, "path", F.to_json("v").alias("value")))


def overlaid_leaves(layers: DataFrame, keys: list[str], rank: str = "rank", text: str = "text", depth: int = 8) -> DataFrame:
    """keys, path, value of the leaves that hold when layers are laid over each other, higher ranks on top. ``keys`` name a profile.

    A base has a lower rank than what extends it; a mixin, which only adds what is not set, has a rank below all. A leaf goes if a higher layer sets its path,
    sets a value where it has an object, or has an object where it sets a value. An empty object takes nothing away.
    """
    leaves = json_leaves(layers.select(*keys, F.col(rank).alias("rank"), F.col(text).alias("text")), [*keys, "rank"], "text", depth)
    empty = F.col("value") == "{}"
    top = leaves.groupBy(*keys, "path").agg(F.max("rank").alias("rank"), F.max_by("value", F.when(~empty, F.col("rank")).otherwise(F.col("rank") - 0.5)).alias("value"), F.max(F.when(~empty, F.col("rank"))).alias("set_at"))
    top = top.withColumn("rank", F.coalesce("set_at", "rank"))
    # Every place above a leaf: the highest layer that sets a value there, and the highest that has an object there.
    above = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", 1, n))
    above = F.when(F.size("path") > 1, above).otherwise(F.array().cast("array<array<string>>"))
    objects = leaves.select(*keys, "rank", F.explode(above).alias("path")).groupBy(*keys, "path").agg(F.max("rank").alias("object_at"))
    values = top.where(F.col("set_at").isNotNull()).select(*keys, F.col("path").alias("at"), F.col("set_at").alias("value_at"))
    covered = leaves.select(*keys, "path", "rank", F.explode(above).alias("at")).join(values, [*keys, "at"]).groupBy(*keys, "path").agg(F.max("value_at").alias("value_at"))
    kept = top.join(objects, [*keys, "path"], "left").join(covered, [*keys, "path"], "left")
    hidden = (F.col("object_at") > F.col("rank")) | (F.col("value_at") > F.col("rank")) | (F.col("object_at").isNotNull() & (F.col("value") == "{}"))
    return kept.where(~F.coalesce(hidden, F.lit(False))).select(*keys, "path", "value")


def rebuilt(leaves: DataFrame, keys: list[str], depth: int = 8) -> DataFrame:
    """keys, text: the JSON objects that leaves make, names in order; a profile is one row, as it was one document."""
    rows = leaves.select(*keys, "path", "value")
    for level in range(depth + 1, 0, -1):
        deep = rows.where(F.size("path") == level)
        # A name in JSON is what an object with it as its only member shows between its braces.
        member = F.concat(F.expr("substring(to_json(map(element_at(path, -1), 0)), 2)"), F.lit(""))
        named = F.concat(F.regexp_replace(member, "0\\}$", ""), F.col("value"))
        members = F.array_join(F.array_sort(F.collect_list(named)), ",")
        joined = deep.groupBy(*keys, F.slice("path", 1, level - 1).alias("path")).agg(F.concat(F.lit("{"), members, F.lit("}")).alias("value"))
        rows = rows.where(F.size("path") < level).unionByName(joined)
    return rows.select(*keys, F.col("value").alias("text"))
