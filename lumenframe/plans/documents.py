"""Queries that compare whole JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators.jsondiff import first_difference
from lumenframe.plans.registry import query
from lumenframe.plans.views import table


@query(
    "K05_json_compare",
    "SELECT event_id, ['.list[1]', '.more', '$', '.v', '.v', '.deep.b[0].c', '.list[2]'][CAST(event_id % 8 AS INT)] AS path, CASE event_id % 8 WHEN 1 THEN CAST(user_id AS STRING) WHEN 2 THEN '<missing>' WHEN 3 THEN concat('{\"deep\":{\"b\":[{\"c\":true},null]},\"list\":[1,', user_id, ',\"x\"],\"props\":{\"k\":', CAST(json_extract_string(props, '$.k') AS STRING), '},\"v\":5}') WHEN 4 THEN '5' WHEN 5 THEN '5' WHEN 6 THEN 'true' WHEN 7 THEN '\"x\"' END AS expected, CASE event_id % 8 WHEN 1 THEN CAST(user_id + 1 AS STRING) WHEN 2 THEN '1' WHEN 3 THEN '[1]' WHEN 4 THEN '5' WHEN 5 THEN '\"5\"' WHEN 6 THEN 'false' WHEN 7 THEN '<missing>' END AS actual FROM events WHERE event_id % 8 <> 0",
)
def json_compare(spark, d):
    """Every event as a JSON document against a copy that is changed in seven ways, or not."""
    text = lambda v, n="user_id", b="true", tail=',"x"', more="": F.expr(f"""concat('{{"props":', props, ',"deep":{{"b":[{{"c":{b}}},null]}},"list":[1,', {n}, '{tail}],"v":{v}{more}}}')""")
    k = F.col("event_id") % 8
    copy = F.when(k == 1, text("5", "user_id + 1")).when(k == 2, text("5", more=',"more":1')).when(k == 3, F.lit("[1]")).when(k == 4, text("5.0")).when(k == 5, text('"5"')).when(k == 6, text("5", b="false")).when(k == 7, text("5", tail="")).otherwise(text("5"))
    rows = table(spark, d, "events").select("event_id", text("5").alias("a"), copy.alias("b"))
    return first_difference(rows, "event_id", "a", "b")
