"""Queries of op logs, mutations and stateful behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import albums, mutations
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table
from lumenframe.streaming import events as stream

_LOG = "log AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'rating' WHEN event_id % 3 = 1 THEN 'flag' ELSE 'label' END AS field, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 6 AS STRING) WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS value FROM events)"


def _log(spark, d):
    return table(spark, d, "events").selectExpr(
        "user_id AS id", "event_id AS seq", "CASE WHEN event_id % 3 = 0 THEN 'rating' WHEN event_id % 3 = 1 THEN 'flag' ELSE 'label' END AS field",
        "CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 6 AS STRING) WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS value",
    )


_BASE = ["id", "rating", "flag", "label"]
_FIELDS = {"rating": "int", "flag": "string", "label": "string"}


@query("S18_op_log_prefix", "WITH l AS (SELECT user_id, event_id, event_id % 97 = 0 AS bad FROM events), f AS (SELECT user_id, min(event_id) FILTER (bad) AS b FROM l GROUP BY user_id) SELECT l.user_id, l.event_id FROM l JOIN f USING (user_id) WHERE b IS NULL OR event_id < b")
def op_log_prefix(spark, d):
    """Log records before each log's first broken checksum."""
    e = table(spark, d, "events").select("user_id", "event_id", "props").withColumn("crc", F.crc32("props") + (F.col("event_id") % 97 == 0).cast("int"))
    return mutations.good_prefix(e, "user_id", "event_id", "crc", "props").select("user_id", "event_id")


@query(
    "G04_M01_replay",
    PHOTOS_SQL + f", {_LOG}, r AS (SELECT id, field, arg_max(struct_pack(v := value), seq).v AS v FROM log GROUP BY id, field) SELECT p.id, CASE WHEN a.id IS NOT NULL THEN CAST(a.v AS INT) ELSE rating END AS rating, CASE WHEN b.id IS NOT NULL THEN b.v ELSE flag END AS flag, CASE WHEN c.id IS NOT NULL THEN c.v ELSE label END AS label FROM photos p LEFT JOIN r a ON a.id = p.id AND a.field = 'rating' LEFT JOIN r b ON b.id = p.id AND b.field = 'flag' LEFT JOIN r c ON c.id = p.id AND c.field = 'label'",
)
def replay(spark, d):
    """The catalog after its op log: the last write of each field."""
    return mutations.replay(photos(spark, d).select(*_BASE), _log(spark, d), "id", _FIELDS)


@query("M06_M16_undo", PHOTOS_SQL + "SELECT id, rating, flag, label FROM photos")
def undo(spark, d):
    """The op log applied and taken back: the catalog as it was."""
    base, log = photos(spark, d).select(*_BASE), _log(spark, d)
    after = mutations.replay(base, log, "id", _FIELDS)
    return mutations.replay(after, mutations.inverse(base, log, "id", list(_FIELDS)), "id", _FIELDS)


@query("M03_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def history(spark, d):
    return mutations.keep_last(table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


@query("M07_delete_everywhere", "SELECT 'lines' AS name, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 31 = 0) UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 31 <> 0")
def delete_everywhere(spark, d):
    gone = table(spark, d, "orders").where("o_orderkey % 31 = 0").select(F.col("o_orderkey").alias("id"))
    tables = {"lines": table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")), "orders": table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))}
    left = mutations.delete_everywhere(gone, tables, "id")
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n, t in left.items()]
    return counts[0].union(counts[1])


@query("M08_shift_capture", PHOTOS_SQL + ", a AS (SELECT album, min(id) AS anchor FROM photos WHERE captured IS NOT NULL GROUP BY album), s AS (SELECT a.album, epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(CAST(captured AS TIMESTAMP)) AS d FROM a JOIN photos p ON p.id = a.anchor) SELECT id, strftime(make_timestamp(CAST((epoch(CAST(captured AS TIMESTAMP)) + d) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS captured FROM photos JOIN s USING (album) WHERE captured IS NOT NULL")
def shift_capture(spark, d):
    """Each album's first photo set to a time, the others shifted equally."""
    p = photos(spark, d).where("captured is not null").select("id", "album", F.to_timestamp("captured", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    delta = p.groupBy("album").agg((F.unix_seconds(F.lit("2000-01-01 00:00:00").cast("timestamp")) - F.unix_seconds(F.min_by("t", "id"))).alias("delta"))
    return p.join(delta, "album").select("id", F.date_format(F.timestamp_seconds(F.unix_seconds("t") + F.col("delta")), "yyyy-MM-dd'T'HH:mm:ss").alias("captured"))


@query("M11_filing", PHOTOS_SQL + "SELECT CASE WHEN captured IS NULL THEN 'undated' ELSE concat(substr(captured, 1, 4), '/', substr(captured, 1, 10)) END AS folder, CAST(count(*) AS BIGINT) AS n FROM photos GROUP BY 1")
def filing(spark, d):
    folder = F.when(F.col("captured").isNull(), "undated").otherwise(F.concat_ws("/", F.substring("captured", 1, 4), F.substring("captured", 1, 10)))
    return photos(spark, d).groupBy(folder.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("M12_cursors", "SELECT user_id, max(seen) AS seen FROM (SELECT user_id, min(event_id) AS seen FROM events GROUP BY 1 UNION ALL SELECT user_id, event_id FROM events WHERE event_id % 5 = 0) GROUP BY user_id")
def cursors(spark, d):
    e = table(spark, d, "events")
    return mutations.advance_cursors(e.groupBy("user_id").agg(F.min("event_id").alias("seen")), e.where("event_id % 5 = 0").select("user_id", F.col("event_id").alias("seen")), "user_id", "seen")


@query("M13_guarded_update", PHOTOS_SQL + "SELECT id, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN rating + 1 ELSE rating END AS revision, CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'new' ELSE flag END AS value, id % 3 = 0 AND id % 2 = 0 AS changed FROM photos")
def guarded_update(spark, d):
    """Updates that expect a revision, half of them an old one."""
    rows = photos(spark, d).select("id", F.col("rating").alias("revision"), F.col("flag").alias("value"))
    change = rows.where("id % 3 = 0").select("id", (F.col("revision") - F.col("id") % 2).alias("expected"), F.lit("new").alias("value"))
    return mutations.guarded_update(rows, change, "id")


@query("G02_H16_watch_pages", "WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, turn FROM c WHERE p IS NOT NULL AND p <> text")
def watch_pages(spark, d):
    """Versions that differ from the one before."""
    return stream.changes(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text").select("conv_id", "turn")


@query("G03_U05_new_items", "SELECT event_id FROM events WHERE event_id % 10 >= 7 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 10 < 7 AND user_id % 2 = 0) ORDER BY event_id LIMIT 20")
def new_items(spark, d):
    """Feed items that were not seen, at most twenty in a report."""
    e = table(spark, d, "events")
    seen = e.where("event_id % 10 < 7 and user_id % 2 = 0").select("user_id").distinct()
    return e.where("event_id % 10 >= 7").join(seen, "user_id", "left_anti").orderBy("event_id").limit(20).select("event_id")


@query("G05_freshness", "SELECT CASE WHEN age < 86400 THEN 'fresh' WHEN age < 7 * 86400 THEN 'cached' ELSE 'stale' END AS state, CAST(count(*) AS BIGINT) AS n FROM (SELECT epoch(TIMESTAMP '2024-01-28 00:00:00') - epoch(ts) AS age FROM events) GROUP BY 1")
def freshness(spark, d):
    age = F.unix_micros(F.lit("2024-01-28 00:00:00").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    state = F.when(age < 86400, "fresh").when(age < 7 * 86400, "cached").otherwise("stale")
    return table(spark, d, "events").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("G09_windows", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows(spark, d):
    """Tumbling windows: the batch form of the streaming query."""
    return stream.windowed_counts(table(spark, d, "events"))


@query("G09_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", CAST(count(*) AS BIGINT) AS n FROM r GROUP BY user_id, s")
def sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("M05_group_stacks", "WITH m AS (SELECT o_orderkey AS id, o_custkey AS stack, o_orderkey % 100 AS pos FROM orders WHERE o_orderkey % 5 < 2), a AS (SELECT o_orderkey AS id, -o_custkey AS r FROM orders WHERE o_orderkey % 7 = 0), t AS (SELECT DISTINCT r, stack FROM a JOIN m USING (id)), n AS (SELECT id, r, 0 AS later, id AS pos FROM a UNION ALL SELECT m.id, t.r, 1, m.pos FROM m JOIN t USING (stack) WHERE m.id NOT IN (SELECT id FROM a) UNION ALL SELECT id, stack, 1, pos FROM m WHERE stack NOT IN (SELECT stack FROM t)), k AS (SELECT id, r AS stack, CAST(row_number() OVER (PARTITION BY r ORDER BY later, pos, id) AS INT) AS place, count(*) OVER (PARTITION BY r) AS c FROM n) SELECT id, stack, place FROM k WHERE c >= 2")
def group_stacks(spark, d):
    """Some records of each customer made one stack, with what shared their stacks before."""
    o = table(spark, d, "orders")
    members = o.where("o_orderkey % 5 < 2").selectExpr("o_orderkey AS id", "CAST(o_custkey AS BIGINT) AS stack", "o_orderkey % 100 AS pos")
    asked = o.where("o_orderkey % 7 = 0").selectExpr("o_orderkey AS id", "CAST(-o_custkey AS BIGINT) AS into", "o_orderkey AS pos")
    return mutations.group_stacks(members, asked)


def _albums(spark, d):
    """Customers as albums, four to a folder, and suppliers as operations on them."""
    a = table(spark, d, "customer").selectExpr("c_custkey AS id", "CASE WHEN c_custkey >= 4 THEN c_custkey div 4 END AS parent", "c_name AS name", "c_custkey % 7 < 5 AS folder", "c_custkey % 7 = 5 AS smart", "c_custkey % 7 = 6 AS filled")
    n = F.broadcast(a.agg(F.max("id").alias("n")))  # one row
    ops = table(spark, d, "supplier").join(n).selectExpr(
        "s_suppkey AS seq", "element_at(array('move', 'move', 'add', 'remove', 'rename'), cast(s_suppkey % 5 + 1 as int)) AS op", "s_suppkey * 7919 % (n + 20) AS id",
        "CASE WHEN s_suppkey % 11 > 0 THEN s_suppkey * 104729 % n END AS parent", "s_name AS name", "s_nationkey % 2 = 0 AS folder", "s_nationkey % 3 = 0 AS smart", "s_nationkey % 4 = 0 AS filled",
    )
    return a, ops


@query("M04_album_ops")
def album_ops(spark, d):
    """Every operation of the log with what is wrong with it, if anything, at its turn."""
    return albums.apply(*_albums(spark, d))[1]


@query("M04_album_paths")
def album_paths(spark, d):
    """Every album's place in the tree after the log."""
    return albums.paths(albums.apply(*_albums(spark, d))[0])
