"""Queries of joins, nearest neighbours, as-of lookups, vectors and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import paths, text
from lumenframe.operators import geo, mutations, ranking, vectors
from lumenframe.operators import relink as matching
from lumenframe.plans import indexes
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table

# Stored rows and a rescan of the same library: some rows changed, some gone, some moved.
_STORED = "stored AS (SELECT path, size, mtime, content_hash FROM photos WHERE id % 7 <> 3)"
_SCANNED = "scanned AS (SELECT CASE WHEN id % 41 = 0 THEN concat('/moved', path) ELSE path END AS path, CASE WHEN id % 43 = 0 THEN size + 1 ELSE size END AS size, mtime, content_hash FROM photos WHERE id % 13 <> 5)"
_SCAN = PHOTOS_SQL + f", {_STORED}, {_SCANNED} "


def _stored(spark, d):
    return photos(spark, d).where("id % 7 <> 3").select("path", "size", "mtime", "content_hash")


def _scanned(spark, d):
    return photos(spark, d).where("id % 13 <> 5").selectExpr(
        "CASE WHEN id % 41 = 0 THEN concat('/moved', path) ELSE path END AS path", "CASE WHEN id % 43 = 0 THEN size + 1 ELSE size END AS size", "mtime", "content_hash"
    )


@query("J01_rescan", _SCAN + "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'gone' WHEN a.size <> b.size OR a.mtime <> b.mtime THEN 'changed' ELSE 'same' END AS state FROM stored a FULL JOIN scanned b ON a.path = b.path")
def rescan(spark, d):
    """Each path of a scan or of the stored table: new, gone, changed or the same."""
    a, b = _stored(spark, d).alias("a"), _scanned(spark, d).alias("b")
    changed = (F.col("a.size") != F.col("b.size")) | (F.col("a.mtime") != F.col("b.mtime"))
    state = F.when(F.col("a.path").isNull(), "new").when(F.col("b.path").isNull(), "gone").when(changed, "changed").otherwise("same")
    return a.join(b, F.col("a.path") == F.col("b.path"), "full").select(F.coalesce("a.path", "b.path").alias("path"), state.alias("state"))


@query("J02_moved", _SCAN + ", fresh AS (SELECT * FROM scanned WHERE path NOT IN (SELECT path FROM stored)), gone AS (SELECT * FROM stored WHERE path NOT IN (SELECT path FROM scanned)) SELECT g.content_hash, min(g.path) AS old_path, min(f.path) AS new_path FROM gone g JOIN fresh f ON f.content_hash = g.content_hash GROUP BY 1")
def moved(spark, d):
    """Files whose path went while their content came up elsewhere."""
    stored, scanned = _stored(spark, d), _scanned(spark, d)
    gone, fresh = stored.join(scanned, "path", "left_anti"), scanned.join(stored, "path", "left_anti")
    old = gone.groupBy("content_hash").agg(F.min("path").alias("old_path"))
    return old.join(fresh.groupBy("content_hash").agg(F.min("path").alias("new_path")), "content_hash")


@query("J03_vanished", _SCAN + "SELECT path FROM stored WHERE path NOT IN (SELECT path FROM scanned)")
def vanished(spark, d):
    return _stored(spark, d).join(_scanned(spark, d).select("path"), "path", "left_anti").select("path")


@query("J04_membership", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def membership(spark, d):
    """Parts that are in at least one returned order line."""
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_name")


@query("J05_unknown_ids", "SELECT id FROM (SELECT unnest([1, 2, 3, 999999999, -5]) AS id) WHERE id NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(spark, d):
    asked = spark.createDataFrame([(i,) for i in (1, 2, 3, 999_999_999, -5)], "id int")
    return asked.join(table(spark, d, "documents").select(F.col("doc_id").alias("id")), "id", "left_anti")


@query("J06_J07_cover_frame", PHOTOS_SQL + "SELECT c_custkey AS video_id, c_name, arg_min(id, struct_pack(a := frame_ts, b := id)) AS cover FROM photos JOIN customer ON c_custkey = video_id GROUP BY 1, 2")
def cover_frame(spark, d):
    """The first frame of each video."""
    frames = photos(spark, d).where("video_id is not null").groupBy("video_id").agg(F.min_by("id", F.struct("frame_ts", "id")).alias("cover"))
    return frames.join(table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), "c_name"), "video_id").select("video_id", "c_name", "cover")


_CITY = "city AS (SELECT CAST(s_suppkey AS BIGINT) AS city, CAST(((s_suppkey * 17) % 1400) / 10.0 - 70 AS DOUBLE) AS clat, CAST(((s_suppkey * 71) % 3600) / 10.0 - 180 AS DOUBLE) AS clon FROM supplier)"
_HAV = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))))"


@query("J09_nearest_city", PHOTOS_SQL + f", {_CITY}, x AS (SELECT id, city.city, {_HAV} AS km FROM photos, city WHERE lat IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, city) AS n FROM x WHERE km <= 300) SELECT id, city, round(km, 3) AS km FROM r WHERE n = 1")
def nearest_city(spark, d):
    """The nearest city within 300 km of each located photo, through a grid of cells."""
    cities = table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS BIGINT) AS city", "CAST(((s_suppkey * 17) % 1400) / 10.0 - 70 AS DOUBLE) AS clat", "CAST(((s_suppkey * 71) % 3600) / 10.0 - 180 AS DOUBLE) AS clon")
    return geo.nearest(photos(spark, d).where("lat is not null").select("id", "lat", "lon"), cities, 300.0).select("id", "city", F.round("km", 3).alias("km"))


@query("J10_parent_region", "WITH n AS (SELECT n_nationkey, n_name, n_regionkey, (SELECT sum(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey) AS pop FROM nation) SELECT n_nationkey, first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY pop DESC NULLS LAST, n_nationkey) AS parent FROM n")
def parent_region(spark, d):
    """The weightiest member of each nation's region."""
    weight = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum("c_acctbal").alias("pop"))
    n = table(spark, d, "nation").join(weight, "n_nationkey", "left")
    w = Window.partitionBy("n_regionkey").orderBy(F.col("pop").desc_nulls_last(), "n_nationkey")
    return n.select("n_nationkey", F.first("n_name").over(w).alias("parent"))


@query(
    "J11_asof_locate",
    "WITH p AS (SELECT user_id, epoch(ts) AS t, value AS v, event_id FROM events WHERE event_id % 3 <> 0), q AS (SELECT user_id, epoch(ts) AS t, event_id FROM events WHERE event_id % 3 = 0), pp AS (SELECT user_id, t, max_by(v, event_id) AS v FROM p GROUP BY 1, 2), b AS (SELECT q.*, x.t AS t0, x.v AS v0 FROM q ASOF LEFT JOIN pp x ON q.user_id = x.user_id AND q.t >= x.t), a AS (SELECT b.*, y.t AS t1, y.v AS v1 FROM b ASOF LEFT JOIN pp y ON b.user_id = y.user_id AND b.t <= y.t) SELECT event_id, round(CASE WHEN t0 = t THEN v0 WHEN t0 IS NOT NULL AND t1 IS NOT NULL AND t1 - t0 <= 7200 THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) WHEN t0 IS NOT NULL AND t - t0 <= 3600 AND (t1 IS NULL OR t - t0 <= t1 - t) THEN v0 WHEN t1 IS NOT NULL AND t1 - t <= 3600 THEN v1 END, 6) AS v FROM a",
)
def asof_locate(spark, d):
    """Values at a time: interpolated between close neighbours, else the nearer within an hour."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    points = e.where("event_id % 3 <> 0").groupBy("user_id", "t").agg(F.max_by("value", "event_id").alias("v"))
    probes = e.where("event_id % 3 = 0").select("user_id", "t", "event_id")
    return geo.locate(points, probes, "user_id", 7200, 3600).select("event_id", F.round("v", 6).alias("v"))


@query("J12_relink")
def relink(spark, d):
    """Missing records and the files found for them: moved, renamed, changed in place, copied, or of a shared name.

    A record in doubt has the class of its candidates, called by its kind and first file, and their number ``n_doubt``. The
    members of the classes follow with tier 0 and the record that took them: candidates of a record are those that
    none before it took. Listed for each record they would be as many as the square of a shared name's records."""
    gone = photos(spark, d).where("missing").selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('IMG_', id % 5, '.JPG') ELSE name END AS name", "CASE WHEN id % 3 = 0 THEN 9000 WHEN id % 29 = 0 THEN 0 ELSE size END AS size", "CASE WHEN id % 4 = 0 THEN NULL ELSE content_hash END AS hash")
    found = photos(spark, d).where("missing and id % 5 <> 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy")).where("copy = 0 or id % 2 = 0")
    files = found.selectExpr(
        "concat('/found/', id, '-', copy) AS file", "CASE WHEN id % 3 = 0 THEN concat('img_', id % 5, '.jpg') WHEN copy = 1 THEN concat('x', name) ELSE upper(name) END AS name",
        "CASE WHEN id % 3 = 0 THEN 9000 ELSE size END AS size", "CASE WHEN id % 7 = 0 THEN md5(content_hash) ELSE content_hash END AS hash",
    )
    found, members = matching.relink_classes(gone, files)
    return found.unionByName(members.select(F.col("holder").alias("id"), "file", F.lit(0).alias("tier"), "doubt", F.lit(None).cast("long").alias("n_doubt")))


@query("J13_import_duplicates", PHOTOS_SQL + ", known AS (SELECT DISTINCT content_hash FROM photos WHERE id % 4 = 0), batch AS (SELECT id, content_hash FROM photos WHERE id % 4 <> 0) SELECT b.id, k.content_hash IS NOT NULL OR row_number() OVER (PARTITION BY b.content_hash ORDER BY b.id) > 1 AS duplicate FROM batch b LEFT JOIN known k ON k.content_hash = b.content_hash")
def import_duplicates(spark, d):
    """Arrivals whose content is known, or came earlier in the batch."""
    known = photos(spark, d).where("id % 4 = 0").select("content_hash", F.lit(True).alias("known")).distinct()
    nth = F.row_number().over(Window.partitionBy("content_hash").orderBy("id"))
    return photos(spark, d).where("id % 4 <> 0").join(known, "content_hash", "left").select("id", (F.coalesce("known", F.lit(False)) | (nth > 1)).alias("duplicate"))


@query("J15_U04_diff_lines", "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations), k AS (SELECT DISTINCT conv_id, turn, lower(w) AS w FROM l WHERE w <> '') SELECT a.conv_id, a.turn, CAST(count(*) FILTER (b.w IS NULL) AS BIGINT) AS added FROM k a LEFT JOIN k b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.w = a.w GROUP BY 1, 2")
def diff_lines(spark, d):
    """Words of a turn that the turn before did not have; a window, not a self-join."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    c = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w")).where(F.size("w") > 0)
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.when(F.lag("turn").over(w) == F.col("turn") - 1, F.lag("w").over(w))
    return c.select("conv_id", "turn", F.size(F.array_except("w", F.coalesce(before, F.array().cast("array<string>")))).cast("long").alias("added"))


@query("J16_J17_J18_references", PHOTOS_SQL + "SELECT id FROM photos p WHERE missing AND imported < '1996-01-01' AND NOT edited AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-06-01')")
def unreferenced(spark, d):
    """Old untouched rows that nothing refers to."""
    old = photos(spark, d).where("missing and imported < '1996-01-01' and not edited").select("id")
    used = table(spark, d, "lineitem").where("l_shipdate >= '1996-06-01'").select(F.col("l_orderkey").alias("id"))
    return old.join(used, "id", "left_anti")


_OBJECTS = "concat('user:', CAST(user_id AS STRING), CASE WHEN event_id % 3 > 0 THEN concat('/type:', event_type) ELSE '' END, CASE WHEN event_id % 3 = 2 THEN concat('/day:', CAST(event_id % 7 AS STRING)) ELSE '' END)"


@query(
    "J16_conflicts",
    f"WITH o AS (SELECT event_id, event_id % 2 AS side, {_OBJECTS} AS object FROM events), l AS (SELECT DISTINCT object FROM o WHERE side = 0), r AS (SELECT object, count(*) AS n FROM o WHERE side = 1 GROUP BY 1), c AS (SELECT l.object, CAST(sum(r.n) AS BIGINT) AS n FROM l JOIN r ON l.object = r.object OR starts_with(l.object, concat(r.object, '/')) OR starts_with(r.object, concat(l.object, '/')) GROUP BY 1) SELECT event_id, coalesce(n, 0) AS conflicts FROM o LEFT JOIN c USING (object) WHERE side = 0",
)
def conflicts(spark, d):
    """How many writes of the other session touch the object of each write, or one above or below it."""
    o = table(spark, d, "events").selectExpr("event_id", "event_id % 2 AS side", f"{_OBJECTS} AS object")
    return paths.overlaps(o.where("side = 0").drop("side"), o.where("side = 1"), "object").select("event_id", F.col("overlaps").alias("conflicts"))


_JOURNAL = "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'undo' ELSE 'write' END AS kind, value > 5 AS ok, CASE WHEN event_id % 10 = 0 THEN event_id - 1 - event_id % 3 WHEN event_id % 15 = 0 THEN NULL WHEN event_id % 5 = 0 THEN event_id + 2 END AS undoes FROM events"


@query("J17_undone", f"WITH j AS ({_JOURNAL}) SELECT id, id IN (SELECT undoes FROM j WHERE kind = 'undo' AND ok AND undoes IS NOT NULL) AS undone FROM j WHERE kind = 'write'")
def undone(spark, d):
    """Writes of a journal, and whether an undo that succeeded names them."""
    j = table(spark, d, "events").selectExpr("event_id AS id", "CASE WHEN event_id % 5 = 0 THEN 'undo' ELSE 'write' END AS kind", "value > 5 AS ok", "CASE WHEN event_id % 10 = 0 THEN event_id - 1 - event_id % 3 WHEN event_id % 15 = 0 THEN NULL WHEN event_id % 5 = 0 THEN event_id + 2 END AS undoes")
    return mutations.with_undone(j)


_LOCAL = "SELECT id, CASE WHEN id % 41 = 0 THEN NULL ELSE folder END AS folder, edited OR rating > 4 AS touched, CASE WHEN id % 50 = 7 THEN id + 1 END AS copy_of, stack FROM photos WHERE id % 2 = 0"
_BROWSED = "SELECT folder, max(imported) AS at FROM photos WHERE folder <> '/lib/3' AND id % 1000 = 5 GROUP BY folder"
_USED = "SELECT l_orderkey AS id FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' UNION SELECT id FROM photos WHERE id % 50 = 9 UNION SELECT min(id) FROM photos GROUP BY album UNION SELECT id + 1 FROM photos WHERE id % 50 = 7"


@query(
    "J18_retention",
    PHOTOS_SQL + f", l AS ({_LOCAL}), b AS ({_BROWSED}), u AS ({_USED}) SELECT l.id, CASE WHEN l.folder IS NULL THEN 'in use' WHEN b.at IS NULL OR epoch(TIMESTAMP '1998-08-02 12:00:00') - epoch(CAST(b.at AS TIMESTAMP)) < 400 * 86400 THEN 'recent' WHEN l.id IN (SELECT id FROM u) THEN 'in use' WHEN touched THEN 'touched' ELSE 'evict' END AS verdict FROM l LEFT JOIN b ON l.folder = b.folder",
)
def retention(spark, d):
    """What keeps each browsed record: its folder's last visit, a reference from albums, covers, stacks or copies, an edit; else it goes."""
    p = photos(spark, d)
    local = p.where("id % 2 = 0").selectExpr("id", "CASE WHEN id % 41 = 0 THEN NULL ELSE folder END AS folder", "edited OR rating > 4 AS touched")
    browsed = p.where("folder <> '/lib/3' AND id % 1000 = 5").groupBy("folder").agg(F.max("imported").alias("at"))
    members = table(spark, d, "lineitem").where("l_shipdate >= '1998-06-01'").select(F.col("l_orderkey").alias("id"))
    stacked, covers, copies = p.where("id % 50 = 9").select("id"), p.groupBy("album").agg(F.min("id").alias("id")).select("id"), p.where("id % 50 = 7").select((F.col("id") + 1).alias("id"))
    return mutations.retention(local, browsed, [members, covers, stacked, copies], "1998-08-02T12:00:00", 400)


@query("J21_star_join", "SELECT n_name, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def star_join(spark, d):
    """Revenue by nation over the star schema; columns and filters reach the scans."""
    o = table(spark, d, "orders").where("o_orderdate < '1997-01-01'").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return joined.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("r"), 2).alias("revenue"))


@query("J22_left_join", "SELECT d.doc_id, d.lang, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.n_chars > 2000")
def left_join(spark, d):
    docs = table(spark, d, "documents").where("n_chars > 2000").select("doc_id", "lang")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query("J24_upsert", PHOTOS_SQL + ", log AS (SELECT id, rating, mtime FROM photos UNION ALL SELECT id, 5 AS rating, mtime + 10 AS mtime FROM photos WHERE id % 6 = 0) SELECT id, arg_max(rating, mtime) AS rating FROM log GROUP BY id")
def upsert(spark, d):
    """Base rows and later changes: the last one counts."""
    base = photos(spark, d).select("id", "rating", "mtime")
    change = base.where("id % 6 = 0").select("id", F.lit(5).alias("rating"), (F.col("mtime") + 10).alias("mtime"))
    return base.unionByName(change).groupBy("id").agg(F.max_by("rating", "mtime").alias("rating"))


_UNIT = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings, q WHERE vec_id <> 0) "


@query("T04_vector_search", _UNIT + ", r AS (SELECT vec_id, s, row_number() OVER (ORDER BY s DESC, vec_id) AS n, max(s) OVER () AS top FROM s) SELECT CAST(n AS INT) AS n, vec_id, round(s, 6) AS score, CASE WHEN s >= 0.27 AND top - s <= 0.04 THEN 'strong' WHEN s >= 0.245 AND top - s <= 0.04 THEN 'medium' ELSE 'weak' END AS relevance FROM r WHERE n <= 12")
def vector_search(spark, d):
    """The twelve vectors nearest to one, with their rank and relevance band."""
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    top = vectors.top_k(v.where("vec_id <> 0"), one, "vec_id", "embedding", 12)
    return ranking.bands(top, "score").select("n", "vec_id", F.round("score", 6).alias("score"), "relevance")


@query("T05_topk_positive", _UNIT + "SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 300")
def topk_positive(spark, d):
    """Top k with the default floor of 0, which drops opposite vectors."""
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    return vectors.top_k(v.where("vec_id <> 0"), one, "vec_id", "embedding", 300, floor=0.0).select("vec_id", F.round("score", 6).alias("score"))


@query("T09_similar_above", _UNIT + "SELECT vec_id, round(s, 6) AS score FROM s WHERE s >= 0.3")
def similar_above(spark, d):
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    return vectors.scored(v.where("vec_id <> 0"), one, "embedding").where("score >= 0.3").select("vec_id", F.round("score", 6).alias("score"))


@query("V01_norms", "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS norm, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS first FROM embeddings")
def norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(F.get(vectors.unit(F.col("embedding")), 0), 5).alias("first"))


@query("V06_V07_hash_parts", "SELECT doc_id, CAST(bit_count(xor(h, g)) AS BIGINT) AS distance, (h >> 32) & 65535 AS part2 FROM (SELECT doc_id, CAST(concat('0x', substr(md5(text), 1, 15)) AS BIGINT) AS h, CAST(concat('0x', substr(md5(lang), 1, 15)) AS BIGINT) AS g FROM documents)")
def hash_parts(spark, d):
    h, g = (F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long") for c in ("text", "lang"))
    return table(spark, d, "documents").select("doc_id", F.bit_count(h.bitwiseXOR(g)).cast("long").alias("distance"), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(65535)).alias("part2"))


_TOK = rf"t AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+')) AS w FROM documents)"
_STEM = "CASE WHEN length(w) > 5 AND suffix(w, 'es') THEN substr(w, 1, length(w) - 2) WHEN length(w) > 4 AND suffix(w, 's') THEN substr(w, 1, length(w) - 1) ELSE w END"


@query("R02_R04_A13_postings", f"WITH {_TOK}, p AS (SELECT doc_id, {_STEM} AS term FROM t) SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM p GROUP BY term")
def postings(spark, d):
    """Document and collection frequencies of stems."""
    return ranking.frequencies(table(spark, d, "documents"), "doc_id", "text")


_BM = f"WITH {_TOK}, p AS (SELECT doc_id, {_STEM} AS term, count(*) AS tf FROM t GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), s AS (SELECT p.doc_id, sum(greatest(0.1, ln(1 + (n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN df USING (term) JOIN len USING (doc_id), st WHERE term IN ('this', 'with', 'pour') GROUP BY p.doc_id) "


_GLUE = f"string_split(translate(lower('{ranking.GLUE_WORDS}'), '{text.ACCENTED}', '{text.PLAIN}'), ' ')"


@query("R03_content_words", rf"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS w, {_GLUE} AS g FROM documents), k AS (SELECT doc_id, w, list_filter(w, lambda x: length(x) > 1 AND NOT list_contains(g, translate(lower(x), '{text.ACCENTED}', '{text.PLAIN}'))) AS k FROM w) SELECT doc_id, md5(array_to_string(CASE WHEN len(k) > 0 THEN k ELSE w END, ' ')) AS words FROM k")
def content_words(spark, d):
    """What every text is about: its words without glue words."""
    return table(spark, d, "documents").select("doc_id", F.md5(F.array_join(ranking.content_words(F.col("text")), " ")).alias("words"))


@query("R07_bm25", _BM + "SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 50")
def bm25(spark, d):
    """The fifty best documents for three terms, from the stored index."""
    found = indexes.of_documents(spark, d).top(["this", "with", "pour"], 50)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query("R08_hybrid", _BM + ", c AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cos FROM embeddings), j AS (SELECT c.doc_id, cos, coalesce(score, 0) AS bm FROM c LEFT JOIN s USING (doc_id)), m AS (SELECT min(cos) AS c0, max(cos) AS c1, min(bm) AS b0, max(bm) AS b1 FROM j) SELECT doc_id, round(cos, 5) AS cos, bm > 0 AS caption_match FROM j, m ORDER BY 0.8 * (cos - c0) / (c1 - c0) + 0.2 * (bm - b0) / (b1 - b0) DESC, doc_id LIMIT 30")
def hybrid(spark, d):
    """Vector and text ranks fused over the candidates; the raw cosine is reported."""
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    cos = vectors.scored(v, one, "embedding").select(F.col("vec_id").alias("doc_id"), F.col("score").alias("cos"))
    text = indexes.of_documents(spark, d).scores(["this", "with", "pour"]).toDF("doc_id", "bm")
    rows = cos.join(text, "doc_id", "left").withColumn("bm", F.coalesce("bm", F.lit(0.0)))
    return ranking.fused(rows, {"cos": 0.8, "bm": 0.2}).orderBy(F.col("fused").desc(), "doc_id").limit(30).select("doc_id", F.round("cos", 5).alias("cos"), (F.col("bm") > 0).alias("caption_match"))


@query("R09_R10_rank_fusion", "WITH a AS (SELECT event_type AS g, user_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY sum(value) DESC, user_id) AS r FROM events GROUP BY 1, 2), s AS (SELECT id, sum(1.0 / (60 + r)) AS s FROM a GROUP BY id) SELECT id, round(s, 6) AS rrf, round(CASE WHEN (SELECT max(s) - min(s) FROM s) = 0 THEN 1.0 ELSE (s - (SELECT min(s) FROM s)) / (SELECT max(s) - min(s) FROM s) END, 6) AS scaled FROM s")
def rank_fusion(spark, d):
    """Reciprocal ranks of users over event types, and the same scaled to 0..1."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    ranked = e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(F.col("v").desc(), "user_id")))
    rows = ranking.reciprocal(ranked, "user_id", "r").withColumnRenamed("user_id", "id")
    return ranking.fused(rows, {"rrf": 1.0}).select("id", F.round("rrf", 6).alias("rrf"), F.round("fused", 6).alias("scaled"))


_NAME_A, _NAME_B = "array_to_string(w[1:3], ' ')", "CASE doc_id % 4 WHEN 0 THEN concat_ws(' ', w[3], w[1], w[2]) WHEN 1 THEN concat_ws(' ', w[1], w[4]) WHEN 2 THEN concat_ws(' ', w[2], substr(w[3], 1, 1)) ELSE array_to_string(w[4:6], ' ') END"
_NAME_WORDS = f"regexp_extract_all(translate(lower({{}}), '{text.ACCENTED}', '{text.PLAIN}'), '[a-z0-9]+')"


@query(
    "R16_name_similarity",
    f"WITH d AS (SELECT doc_id, regexp_split_to_array(text, ' ') AS w FROM documents), n AS (SELECT doc_id, {_NAME_B} AS a, {_NAME_A} AS b FROM d), t AS (SELECT doc_id, {_NAME_WORDS.format('a')} AS x, {_NAME_WORDS.format('b')} AS y FROM n), "
    "u AS (SELECT *, list_filter(list_distinct(x), lambda v: NOT list_contains(y, v)) AS l, list_filter(list_distinct(y), lambda v: NOT list_contains(x, v)) AS r FROM t) "
    "SELECT doc_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN list_sort(x) = list_sort(y) THEN 1.0 ELSE round_even(least(1.0, (len(list_distinct(x)) - len(l) + 0.5 * len(list_filter(l, lambda i: length(i) = 1 AND len(list_filter(r, lambda v: starts_with(v, i))) > 0)))::DOUBLE / (len(list_distinct(x)) + len(r))), 4) END AS s FROM u",
)
def name_similarity(spark, d):
    """Names from every document's first words, turned round, shortened to an initial, or others."""
    w = F.split("text", " ")
    part = lambda i: F.get(w, i - 1)
    k = F.col("doc_id") % 4
    other = F.when(k == 0, F.concat_ws(" ", part(3), part(1), part(2))).when(k == 1, F.concat_ws(" ", part(1), part(4))).when(k == 2, F.concat_ws(" ", part(2), F.substring(part(3), 1, 1))).otherwise(F.array_join(F.slice(w, 4, 3), " "))
    return table(spark, d, "documents").select("doc_id", ranking.name_similarity(other, F.array_join(F.slice(w, 1, 3), " ")).alias("s"))


_LANGS = ranking.STOP_WORDS
_LSQL = ", ".join(f"len(list_filter(w, lambda x: list_contains({v.split()!r}, x))) AS {k}_" for k, v in _LANGS.items())
_OTHERS = [k for k in _LANGS if k != "en"]
_BEST = "greatest(" + ", ".join(f"{k}_" for k in _OTHERS) + ")"


@query("R18_language", f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{No}}\\p{{Nl}}]+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, {_LSQL} FROM w) SELECT doc_id, CASE WHEN n >= 2 AND {_BEST} >= 1 AND {_BEST} > en_ THEN CASE " + " ".join(f"WHEN {k}_ = {_BEST} THEN '{k}'" for k in _OTHERS) + " END END AS lang FROM c")
def language(spark, d):
    """The language whose stop words count most, if it beats English."""
    return table(spark, d, "documents").select("doc_id", ranking.non_english(F.col("text")).alias("lang"))
