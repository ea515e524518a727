"""The first place where two JSON documents differ, compared as VARIANT values.

Both are taken apart together, one level a round: values of unlike type or unlike content are differences, and
containers of one type give their members to the next round, matched by key or place. The first
difference is that of the least path, keys in their order and places by number. Types are strict: 1 and
1.0 differ. An expected object with one of the keys ``$approx`` (value and tolerance), ``$range`` (two ends; for a list, all
members) or ``$oneof`` stands for what it allows.

Defined results: equal documents have no row; a document that cannot be read, or is null, differs from all
others at ``$``, and two such are equal; rows need ids of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.checkpoints import cut

MISSING = "<missing>"


def _kind(v: Column) -> Column:
    """The JSON type of a variant, whole numbers apart from others."""
    named = F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)
    whole = (named == "BIGINT") | F.regexp_like(F.schema_of_variant(v), F.lit(r"^DECIMAL\((19|[23]\d),0\)$"))
    return F.when(whole, "INT").when(named.isin("DECIMAL", "DOUBLE", "FLOAT"), "FLOAT").otherwise(named)



def _members(rows: DataFrame, side: str) -> DataFrame:
    """``id, path, place, pos, key, v`` of the members of one side's containers."""
    name = f"_parts_{side}"
    rows.createOrReplaceTempView(name)
    found = rows.sparkSession.sql(f"SELECT r.id, r.path, r.place, r.kind, e.pos, e.key, e.value AS v FROM {name} r, LATERAL variant_explode(r.{side}) e")
    # Members of an object are matched by key alone.
    return found.select("id", "path", "place", F.when(F.col("kind") == "ARRAY", F.col("pos")).otherwise(-1).alias("pos"), F.coalesce("key", F.lit("")).alias("key"), "v")


def _allowed() -> Column:
    """Whether ``b`` is what a special object ``a`` allows; null if ``a`` is not special."""
    number = lambda c: F.col("kind_b").isin("INT", "FLOAT") if c is None else _kind(c).isin("INT", "FLOAT")
    value = lambda c: F.variant_get(c, "$", "double")
    approx = F.coalesce(number(None) & (F.abs(F.expr("try_variant_get(b, '$', 'double')") - F.expr("""try_variant_get(a, '$["$approx"][0]', 'double')""")) <= F.expr("""try_variant_get(a, '$["$approx"][1]', 'double')""")), F.lit(False))
    low, high = F.expr("""try_variant_get(a, '$["$range"][0]', 'double')"""), F.expr("""try_variant_get(a, '$["$range"][1]', 'double')""")
    inside = lambda c: number(c) & F.coalesce(F.when(number(c), value(c)).between(low, high), F.lit(False))
    listed = F.expr("try_variant_get(b, '$', 'array<variant>')")
    ranged = F.when(F.col("kind_b") == "ARRAY", (F.size(listed) > 0) & F.forall(listed, inside)).otherwise(number(None) & F.coalesce(F.expr("try_variant_get(b, '$', 'double')").between(low, high), F.lit(False)))
    options = F.expr("""try_variant_get(a, '$["$oneof"]', 'array<variant>')""")
    one = F.exists(options, lambda c: (_kind(c) == F.col("kind_b")) & (F.to_json(c) == F.to_json("b")))
    return F.when(F.col("special") == "$approx", approx).when(F.col("special") == "$range", ranged).when(F.col("special") == "$oneof", F.coalesce(one, F.lit(False)))


def first_difference(rows: DataFrame, id_col: str, expected: str, actual: str) -> DataFrame:
    """``rows`` with two columns of JSON text -> ``id, path, expected, actual`` of those that differ."""
    start = rows.select(F.col(id_col).alias("id"), F.try_parse_json(expected).alias("a"), F.try_parse_json(actual).alias("b"))
    level = start.withColumn("path", F.lit("")).withColumn("place", F.array().cast("array<struct<pos:int,key:string>>"))
    found: list[DataFrame] = []
    while True:
        level = level.withColumn("kind_a", F.coalesce(_kind(F.col("a")), F.lit(MISSING))).withColumn("kind_b", F.coalesce(_kind(F.col("b")), F.lit(MISSING)))
        only = F.regexp_extract(F.when(F.col("kind_a") == "OBJECT", F.to_json("a")), r'^\{"(\$approx|\$range|\$oneof)":', 1)
        single = F.size(F.expr("json_object_keys(to_json(a))")) == 1
        level = cut(level.withColumn("special", F.when((F.col("kind_a") == "OBJECT") & single & (only != ""), only)))
        nested = F.col("kind_a").isin("OBJECT", "ARRAY") & (F.col("kind_a") == F.col("kind_b")) & F.col("special").isNull()
        differ = F.when(F.col("special").isNotNull(), ~_allowed()).otherwise((F.col("kind_a") != F.col("kind_b")) | (F.to_json("a") != F.to_json("b")))
        shown = lambda c, kind: F.when(F.col(kind) == MISSING, MISSING).otherwise(F.to_json(c))
        path = F.when(F.col("path") == "", "$").otherwise(F.col("path"))
        found.append(cut(level.where(~nested & differ).select("id", "place", path.alias("path"), shown("a", "kind_a").alias("expected"), shown("b", "kind_b").alias("actual"))))
        # Written alike, 1 and 1.0 would look equal: every container is taken apart.
        deeper = level.where(nested).select("id", "path", "place", "a", "b", F.col("kind_a").alias("kind"))
        if deeper.isEmpty():
            break
        sides = _members(deeper, "a").withColumn("side", F.lit("a")).unionByName(_members(deeper, "b").withColumn("side", F.lit("b")))
        both = sides.groupBy("id", "path", "place", "pos", "key").agg(F.first(F.when(F.col("side") == "a", F.col("v")), ignorenulls=True).alias("a"), F.first(F.when(F.col("side") == "b", F.col("v")), ignorenulls=True).alias("b"))
        step = F.when(F.col("pos") >= 0, F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "key"))
        level = both.select("id", "a", "b", F.concat("path", step).alias("path"), F.concat("place", F.array(F.struct("pos", "key"))).alias("place"))
    first = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min(F.struct("place", "path", "expected", "actual")).alias("m"))
    return first.select(F.col("id").alias(id_col), "m.path", "m.expected", "m.actual")
