"""Queries of aggregations, windows, runs and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.operators import dedupe, ranking, ranks, runs
from lumenframe.operators.checkpoints import cut
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table

_KEEP = "-(CAST(coalesce(width, 0) AS BIGINT) * coalesce(height, 0)), coalesce(captured, '9999'), mtime, regexp_matches(path, '(?i)(backup|copia|copy|whatsapp)'), length(path), id"
_RANKED = f"ranked AS (SELECT *, count(*) OVER (PARTITION BY content_hash) AS n, row_number() OVER (PARTITION BY content_hash ORDER BY {_KEEP}) AS nth FROM photos)"


@query("A01_exact_groups", PHOTOS_SQL + "SELECT content_hash, CAST(count(*) AS BIGINT) AS n, min(id) AS first_id FROM photos GROUP BY content_hash HAVING count(*) > 1")
def exact_groups(spark, d):
    """Groups of equal content."""
    return photos(spark, d).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@query("A02_keeper", PHOTOS_SQL + f", {_RANKED} SELECT content_hash, id AS keeper FROM ranked WHERE n > 1 AND nth = 1")
def keeper(spark, d):
    """The member of each group that stays."""
    return dedupe.exact_groups(photos(spark, d)).where("nth = 1").select("content_hash", F.col("id").alias("keeper"))


@query(
    "A04_duplicates_summary",
    PHOTOS_SQL + f", {_RANKED} SELECT content_hash, CAST(n AS BIGINT) AS n, CAST(sum(CASE WHEN nth > 1 THEN size ELSE 0 END) AS BIGINT) AS reclaimable, string_agg(CASE WHEN nth BETWEEN 2 AND 4 THEN path END, ',' ORDER BY nth) AS others FROM ranked WHERE n > 1 GROUP BY content_hash, n",
)
def duplicates_summary(spark, d):
    """Bytes to win in each group, with at most three other paths."""
    found = dedupe.exact_groups(photos(spark, d)).groupBy("content_hash", "n")
    paths = F.array_sort(F.collect_list(F.when(F.col("nth").between(2, 4), F.struct("nth", "path"))))
    return found.agg(F.sum(F.when(F.col("nth") > 1, F.col("size")).otherwise(0)).alias("reclaimable"), F.array_join(F.transform(paths, lambda x: x["path"]), ",").alias("others"))


def _hashed(spark, d):
    """The 60-bit SimHash of each whole text."""
    return dedupe.simhash(table(spark, d, "documents"), "doc_id", ranking.tokens(F.col("text")))


_VOTES = ", ".join(f"sum(((d >> {k}) & 1) * 2 - 1) AS v{k}" for k in range(60))
_BITS = " | ".join(f"CASE WHEN v{k} > 0 THEN CAST({1 << k} AS BIGINT) ELSE 0 END" for k in range(60))
_HASHED_SQL = rf"""w AS (SELECT doc_id, CAST(concat('0x', substr(md5(unnest(regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+'))), 1, 15)) AS BIGINT) AS d FROM documents),
votes AS (SELECT doc_id, {_VOTES} FROM w GROUP BY doc_id),
hashed AS (SELECT doc_id, {_BITS} AS bits FROM votes),
pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b, CAST(bit_count(xor(a.bits, b.bits)) AS BIGINT) AS distance FROM hashed a JOIN hashed b ON a.doc_id < b.doc_id AND bit_count(xor(a.bits, b.bits)) <= 6)"""


@query("J08_hamming_join", f"WITH {_HASHED_SQL}, kinds AS (SELECT DISTINCT bits FROM hashed), near AS (SELECT a.bits, CAST(count(*) - 1 AS BIGINT) AS n_links FROM kinds a JOIN kinds b ON bit_count(xor(a.bits, b.bits)) <= 6 GROUP BY a.bits) SELECT doc_id, min(doc_id) OVER (PARTITION BY bits) AS class_id, n_links FROM hashed JOIN near USING (bits)")
def hamming_join(spark, d):
    """Each document's class of equal hashes, and the number of other hashes at most six bits apart."""
    rows = cut(_hashed(spark, d))
    kinds = cut(dedupe.hash_classes(rows))
    ends = dedupe.near_counts(kinds.select(F.col("rep").alias("id"), "bits"), 6).select(F.col("id").alias("rep"), F.col("n").alias("n_links"))
    known = kinds.join(ends, "rep", "left").select("bits", F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows.join(known, "bits").select(F.col("id").alias("doc_id"), "class_id", "n_links")


@query(
    "A03_near_groups",
    f"WITH RECURSIVE {_HASHED_SQL}, edges AS (SELECT id_a AS u, id_b AS v FROM pairs UNION SELECT id_b, id_a FROM pairs), reach AS (SELECT u AS node, u AS seen FROM edges UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node) SELECT component, CAST(count(*) AS BIGINT) AS n, (SELECT max(bit_count(xor(x.bits, y.bits))) FROM comp p JOIN hashed x ON x.doc_id = p.node, comp q JOIN hashed y ON y.doc_id = q.node WHERE p.component = c.component AND q.component = c.component)::BIGINT AS max_distance FROM comp c GROUP BY component",
)
def near_groups(spark, d):
    """Components of near hashes, with the largest distance within each (chains may exceed six)."""
    kinds = cut(dedupe.hash_classes(_hashed(spark, d)))
    found = dedupe.near_components(kinds.select(F.col("rep").alias("id"), "bits"), 6).select(F.col("node").alias("rep"), "component")
    members = cut(kinds.join(found, "rep", "left").where("component is not null or n > 1").select(F.coalesce("component", "rep").alias("component"), "bits", "n"))
    apart = dedupe.widest(members, "component")
    return members.groupBy("component").agg(F.sum("n").alias("n")).join(apart, "component")


@query(
    "A05_timeline",
    PHOTOS_SQL + "SELECT substr(captured, 1, 4) AS year, substr(captured, 6, 2) AS month, CAST(count(*) AS BIGINT) AS n FROM photos WHERE NOT missing AND captured IS NOT NULL GROUP BY GROUPING SETS ((1, 2), (1))",
)
def timeline(spark, d):
    """Counts by year, and by year and month."""
    p = photos(spark, d).where("not missing and captured is not null")
    p = p.select(F.substring("captured", 1, 4).alias("year"), F.substring("captured", 6, 2).alias("month"))
    return p.rollup("year", "month").agg(F.count(F.lit(1)).alias("n")).where("year is not null")


@query("A06_on_this_day", PHOTOS_SQL + ", hits AS (SELECT id, captured FROM photos WHERE NOT missing AND substr(captured, 6, 5) = '07-14' AND captured < '1997-07-14') SELECT id, captured, (SELECT CAST(count(*) AS BIGINT) FROM hits) AS total FROM hits ORDER BY captured DESC, id LIMIT 10")
def on_this_day(spark, d):
    """The same day in earlier years: ten of them, and how many there are."""
    hits = photos(spark, d).where("not missing and substr(captured, 6, 5) = '07-14' and captured < '1997-07-14'").select("id", "captured")
    return hits.orderBy(F.col("captured").desc(), "id").limit(10).join(F.broadcast(hits.agg(F.count(F.lit(1)).alias("total"))))


@query("A07_places", PHOTOS_SQL + "SELECT country, coalesce(region, city) AS place, CAST(count(*) AS BIGINT) AS n FROM photos WHERE country IS NOT NULL GROUP BY 1, 2")
def places(spark, d):
    """Countries and their places; the region counts before the city."""
    return photos(spark, d).where("country is not null").groupBy("country", F.coalesce("region", "city").alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("A08_date_groups", PHOTOS_SQL + ", m AS (SELECT coalesce(captured, imported) AS t FROM photos WHERE NOT deleted) SELECT substr(t, 1, 4) AS y, substr(t, 6, 2) AS m, substr(t, 9, 2) AS d, CAST(count(*) AS BIGINT) AS n FROM m WHERE length(t) >= 10 GROUP BY ROLLUP (1, 2, 3) HAVING substr(t, 1, 4) IS NOT NULL".replace("HAVING substr(t, 1, 4) IS NOT NULL", "HAVING y IS NOT NULL"))
def date_groups(spark, d):
    """Year, month and day counts."""
    t = F.coalesce("captured", "imported")
    p = photos(spark, d).where(~F.col("deleted") & (F.length(t) >= 10)).select(F.substring(t, 1, 4).alias("y"), F.substring(t, 6, 2).alias("m"), F.substring(t, 9, 2).alias("d"))
    return p.rollup("y", "m", "d").agg(F.count(F.lit(1)).alias("n")).where("y is not null")


_KW = "kw AS (SELECT id, unnest(string_split(keywords, ';')) AS k FROM photos)"


@query("A09_keyword_counts", PHOTOS_SQL + f", {_KW} SELECT k AS keyword, CAST(count(*) AS BIGINT) AS n FROM kw GROUP BY k")
def keyword_counts(spark, d):
    return photos(spark, d).select(F.explode(F.split("keywords", ";")).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))


def keyword_levels(p):
    """``id, level, path, key``: each prefix of each keyword once per photo, ignoring case."""
    parts = p.select("id", F.posexplode(F.split("keywords", ";")).alias("nth", "k")).withColumn("parts", F.split("k", r"\|"))
    levels = parts.select("id", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"), "parts")
    levels = levels.withColumn("path", F.array_join(F.slice("parts", 1, F.col("level")), "|"))
    return levels.withColumn("key", F.lower("path")).groupBy("id", "level", "key").agg(F.min("path").alias("path"))


@query(
    "A10_keyword_tree",
    PHOTOS_SQL + f", {_KW}, lv AS (SELECT id, i AS level, array_to_string(string_split(k, '|')[1:i], '|') AS path FROM kw, unnest(range(1, len(string_split(k, '|')) + 1)) AS t(i)) SELECT lower(path) AS key, CAST(level AS INT) AS level, CAST(count(DISTINCT id) AS BIGINT) AS n, min_by(path, id) AS spelling FROM lv GROUP BY 1, 2",
)
def keyword_tree(spark, d):
    """Each level of the hierarchy, counted once per photo, in its first spelling."""
    return keyword_levels(photos(spark, d)).groupBy("key", "level").agg(F.count(F.lit(1)).alias("n"), F.min_by("path", "id").alias("spelling"))


@query(
    "A11_keyword_suggestions",
    PHOTOS_SQL + f", {_KW}, own AS (SELECT DISTINCT id FROM kw WHERE k = 'food'), cnt AS (SELECT k, count(*) AS n FROM kw GROUP BY k) SELECT kw.k AS keyword, CAST(count(*) * 1000000 + any_value(cnt.n) AS BIGINT) AS score FROM kw JOIN own USING (id) JOIN cnt ON cnt.k = kw.k WHERE kw.k <> 'food' GROUP BY kw.k ORDER BY score DESC, lower(keyword) LIMIT 5",
)
def keyword_suggestions(spark, d):
    """Keywords that stand beside a given one most often."""
    kw = photos(spark, d).select("id", F.explode(F.split("keywords", ";")).alias("keyword"))
    own, counts = kw.where("keyword = 'food'").select("id").distinct(), kw.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
    beside = kw.where("keyword != 'food'").join(own, "id", "left_semi").groupBy("keyword").agg(F.count(F.lit(1)).alias("c"))
    return beside.join(counts, "keyword").select("keyword", (F.col("c") * 1_000_000 + F.col("n")).alias("score")).orderBy(F.col("score").desc(), F.lower("keyword")).limit(5)


@query(
    "A12_A25_library_stats",
    PHOTOS_SQL + "SELECT " + ", ".join(f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}" for n, c in {"photos": "NOT deleted AND kind = 'photo'", "videos": "kind = 'video'", "edited": "edited", "picks": "flag = 'pick'", "rejects": "flag = 'reject'", "deleted": "deleted", "missing": "missing", "located": "lat IS NOT NULL"}.items()) + " FROM photos",
)
def library_stats(spark, d):
    """All counts of the library in one pass."""
    tests = {"photos": "not deleted and kind = 'photo'", "videos": "kind = 'video'", "edited": "edited", "picks": "flag = 'pick'", "rejects": "flag = 'reject'", "deleted": "deleted", "missing": "missing", "located": "lat is not null"}
    return photos(spark, d).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in tests.items()])


@query("A14_best_of_group", "SELECT user_id, arg_max(event_id, struct_pack(v := value, p := -event_id)) AS best FROM events GROUP BY user_id")
def best_of_group(spark, d):
    """The event with the greatest value of each user; the first wins ties."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("A15_order_statistic", "SELECT event_type, list_sort(list(value))[CAST(floor(count(*) * 0.9) AS INT) + 1] AS p90 FROM events GROUP BY event_type")
def order_statistic(spark, d):
    """The value at rank floor(0.9 n) of each type, found between two values of a sketch."""
    found = ranks.at_rank(table(spark, d, "events"), "event_type", "value", 0.9, F.floor(F.col("n") * 0.9))
    return found.select("event_type", F.col("value").alias("p90"))


@query("A16_trimmed_log_mean", "WITH q AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events GROUP BY event_type) SELECT event_type, round(exp(avg(ln(greatest(value, 1e-4)))), 6) AS m FROM events JOIN q USING (event_type) WHERE value BETWEEN lo AND hi GROUP BY event_type")
def trimmed_log_mean(spark, d):
    """The log mean of each type between its quantiles 0.1 and 0.9."""
    e = table(spark, d, "events")
    low, high = (ranks.quantile(e, "event_type", "value", share).withColumnRenamed("value", name) for share, name in ((0.1, "lo"), (0.9, "hi")))
    q = low.join(high, "event_type")
    inside = e.join(q, "event_type").where(F.col("value").between(F.col("lo"), F.col("hi")))
    return inside.groupBy("event_type").agg(F.round(F.exp(F.avg(F.ln(F.greatest("value", F.lit(1e-4))))), 6).alias("m"))


_LINE_KEY = r"regexp_replace(lower(trim(l)), '[0-9]+', '#', 'g')"


@query(
    "A17_repeated_lines",
    rf"WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents), k AS (SELECT DISTINCT source, doc_id, {_LINE_KEY} AS k FROM l WHERE l <> '' AND length(l) <= 160), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source) SELECT k.source, k.k AS line, CAST(count(*) AS BIGINT) AS n FROM k JOIN n ON n.source = k.source WHERE n.pages >= 3 GROUP BY k.source, k.k, n.pages HAVING count(*) > 0.02 * n.pages",
)
def repeated_lines(spark, d):
    """Lines that stand on more than a share of a source's pages."""
    docs = table(spark, d, "documents")
    line = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("l")).withColumn("l", F.trim("l")).where((F.col("l") != "") & (F.length("l") <= 160))
    keys = line.select("source", "doc_id", F.regexp_replace(F.lower("l"), "[0-9]+", "#").alias("line")).distinct()
    pages = docs.groupBy("source").agg(F.countDistinct("doc_id").alias("pages")).where("pages >= 3")
    return keys.groupBy("source", "line").agg(F.count(F.lit(1)).alias("n")).join(pages, "source").where(F.col("n") > 0.02 * F.col("pages")).select("source", "line", "n")


@query(
    "A17_without_repeated_lines",
    rf"WITH l AS (SELECT source, doc_id, trim(unnest(string_split(text, chr(10)))) AS l FROM documents), k AS (SELECT DISTINCT source, doc_id, {_LINE_KEY} AS k FROM l WHERE l <> '' AND length(l) <= 160), n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM documents GROUP BY source), r AS (SELECT k.source, list(DISTINCT k.k) AS r FROM (SELECT k.source, k.k FROM k JOIN n ON n.source = k.source WHERE n.pages >= 3 GROUP BY k.source, k.k, n.pages HAVING count(*) > 0.02 * n.pages) k GROUP BY k.source) SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT list_contains(coalesce(r, []), {_LINE_KEY})), chr(10))) AS kept FROM documents LEFT JOIN r ON r.source = documents.source",
)
def without_repeated_lines(spark, d):
    """Every text without the lines that stand on more than a share of its source's pages. A source has at most as many
    such lines as a page has on average, divided by the share."""
    docs = table(spark, d, "documents")
    repeated = repeated_lines(spark, d).groupBy("source").agg(F.collect_set("line").alias("repeated"))
    key = lambda l: F.regexp_replace(F.lower(F.trim(l)), "[0-9]+", "#")
    kept = F.filter(F.split("text", "\n"), lambda l: ~F.array_contains(F.coalesce("repeated", F.array().cast("array<string>")), key(l)))
    return docs.join(repeated, "source", "left").select("doc_id", F.md5(F.array_join(kept, "\n")).alias("kept"))


@query("A19_short_line_share", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents), w AS (SELECT doc_id, len(list_filter(string_split(l, ' '), lambda x: x <> '')) AS n, length(l) < 30 AS menu FROM l) SELECT doc_id, round(sum(CASE WHEN menu THEN n ELSE 0 END) / greatest(sum(n), 1), 6) AS ratio FROM w GROUP BY doc_id")
def short_line_share(spark, d):
    """The share of a text's words in menu-like lines, row by row without a shuffle."""
    lines = F.transform(F.split("text", "\n"), lambda l: F.struct(F.size(F.array_remove(F.split(l, " "), "")).alias("n"), (F.length(l) < 30).alias("menu")))
    total = lambda test: F.aggregate(F.filter("lines", test), F.lit(0), lambda a, x: a + x["n"])
    rows = table(spark, d, "documents").select("doc_id", lines.alias("lines"))
    return rows.select("doc_id", F.round(total(lambda x: x["menu"]) / F.greatest(total(lambda x: F.lit(True)), F.lit(1)), 6).alias("ratio"))


@query("A22_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    """Counts and sums over a cube, with the level of each row."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().cast("long").alias("level"))


@query("A23_approximate")
def approximate(spark, d):
    """Approximate distinct counts, quantiles and frequent values."""
    return table(spark, d, "events").agg(
        F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", [0.5, 0.9, 0.99]).alias("quantiles"), F.expr("approx_top_k(event_type, 3)").alias("top")
    )


@query("A24_by_category", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY 1, 2")
def by_category(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("discount"))


_EV = "e AS (SELECT *, epoch(ts) AS t FROM events)"


@query(
    "W01_stacks",
    f"WITH {_EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 3600 THEN 1 ELSE 0 END AS b FROM e), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g), s AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS stack_size FROM r) SELECT user_id, event_id, CAST(run AS BIGINT) AS run, CAST(stack_size AS BIGINT) AS stack_size FROM s WHERE stack_size >= 2",
)
def stacks(spark, d):
    """Groups of a user's events within an hour of one another."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return runs.stacks_by_gap(e, "user_id", "t", 3600, "event_id").select("user_id", "event_id", "run", "stack_size")


@query(
    "W02_date_runs",
    PHOTOS_SQL + ", l AS (SELECT album, id, coalesce(substr(captured, 1, 7), '') AS k FROM photos), g AS (SELECT *, CASE WHEN lag(k) OVER (PARTITION BY album ORDER BY id) <> k THEN 1 ELSE 0 END AS b FROM l), r AS (SELECT *, sum(b) OVER (PARTITION BY album ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT album, CAST(run AS BIGINT) AS run, min(id) AS first, CAST(count(*) AS BIGINT) AS n, min(k) AS label FROM r GROUP BY album, run",
)
def date_runs(spark, d):
    """Consecutive photos of an album in one month."""
    return runs.date_runs(photos(spark, d), "album", "id", F.substring("captured", 1, 7))


@query(
    "W03_arrange_stacks",
    PHOTOS_SQL + ", a AS (SELECT album, id, stack, CASE WHEN stack IS NULL THEN id ELSE min(id) OVER (PARTITION BY album, stack) END AS place, CASE WHEN stack IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY album, stack ORDER BY id) END AS nth FROM photos) SELECT album, id, place, CAST(nth AS INT) AS nth FROM a WHERE nth = 1 OR coalesce(stack % 2, 0) = 0",
)
def arrange_stacks(spark, d):
    """Members beside their stack's first; stacks with odd numbers collapsed."""
    p = photos(spark, d)
    return runs.arrange_stacks(p, "album", "id", "stack", F.coalesce(F.col("stack") % 2 == 1, F.lit(False))).select("album", "id", "place", "nth")


@query(
    "W04_bursts",
    "WITH v AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT label, vec_id, list_dot_product(e, lag(e) OVER (PARTITION BY label ORDER BY vec_id)) AS sim, vec_id - lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS gap FROM v), r AS (SELECT *, sum(CASE WHEN sim >= 0.1 AND gap <= 60 THEN 0 ELSE 1 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS burst FROM s) SELECT label, CAST(burst AS BIGINT) AS burst, min(vec_id) AS first, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY label, burst",
)
def bursts(spark, d):
    """Runs in which each vector is close to the one before, in number and in direction."""
    w = Window.partitionBy("label").orderBy("vec_id")
    v = table(spark, d, "embeddings")
    dot = F.aggregate(F.zip_with("embedding", F.lag("embedding").over(w), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
    near = v.select("label", "vec_id", dot.alias("sim"), (F.col("vec_id") - F.lag("vec_id").over(w)).alias("gap"))
    run = F.sum(F.when((F.col("sim") >= 0.1) & (F.col("gap") <= 60), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("burst", run).groupBy("label", "burst").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))


@query("W07_cues_to_text", "WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) SELECT conv_id, string_agg(concat(CASE WHEN p IS NULL THEN '' WHEN suffix(rtrim(p), '.') OR suffix(rtrim(p), '?') THEN chr(10) ELSE ' ' END, text), '' ORDER BY turn) AS text FROM c GROUP BY conv_id")
def cues_to_text(spark, d):
    """Turns joined by a line break after a sentence's end, by a space elsewhere."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = F.rtrim(F.lag("text").over(w))
    sep = F.when(before.isNull(), "").when(before.endswith(".") | before.endswith("?"), "\n").otherwise(" ")
    parts = table(spark, d, "conversations").select("conv_id", "turn", F.concat(sep, F.col("text")).alias("part"))
    joined = F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"])
    return parts.groupBy("conv_id").agg(F.array_join(joined, "").alias("text"))


@query("W08_rank_page", PHOTOS_SQL + "SELECT CAST(row_number() OVER (PARTITION BY album ORDER BY rating DESC, id) AS INT) AS n, album, id FROM photos QUALIFY n BETWEEN 11 AND 20")
def rank_page(spark, d):
    """The second page of ten of each album, with ranks from 1."""
    w = Window.partitionBy("album").orderBy(F.col("rating").desc(), "id")
    return photos(spark, d).select(F.row_number().over(w).alias("n"), "album", "id").where(F.col("n").between(11, 20))


@query(
    "W12_window_frames",
    "SELECT o_custkey, o_orderkey, CAST(rank() OVER w AS INT) AS rank, CAST(dense_rank() OVER w AS INT) AS dense, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS tile, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
)
def window_frames(spark, d):
    """Ranks, tiles, neighbours and a moving mean of each customer's orders."""
    w = Window.partitionBy("o_custkey")
    by = w.orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.rank().over(w.orderBy("o_orderpriority")).alias("rank"), F.dense_rank().over(w.orderBy("o_orderpriority")).alias("dense"), F.ntile(3).over(by).alias("tile"),
        F.lead("o_orderkey").over(by).alias("next"), F.round(F.avg("o_totalprice").over(by.rowsBetween(-2, 0)), 4).alias("moving"),
    )


@query("T08_last_matching", "SELECT * FROM (SELECT event_id, user_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY event_id DESC LIMIT 50) ORDER BY event_id")
def last_matching(spark, d):
    """The last fifty matching entries of a journal, oldest first."""
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type", "left_semi").orderBy(F.col("event_id").desc()).limit(50).orderBy("event_id").select("event_id", "user_id", "event_type")


@query("T10_evict_oldest", PHOTOS_SQL + "SELECT album, id FROM (SELECT album, id, sum(size) OVER (PARTITION BY album ORDER BY mtime DESC, id DESC) AS used FROM photos) WHERE used <= 100000000")
def evict_oldest(spark, d):
    """What stays in each album's cache of a fixed cost, most recent first."""
    w = Window.partitionBy("album").orderBy(F.col("mtime").desc(), F.col("id").desc())
    return photos(spark, d).select("album", "id", F.sum("size").over(w).alias("used")).where("used <= 100000000").select("album", "id")


@query("U01_U02_unique_keywords", PHOTOS_SQL + f", {_KW}, r AS (SELECT id, k, row_number() OVER (PARTITION BY lower(k) ORDER BY id, k) AS n FROM kw) SELECT lower(k) AS key, k AS spelling FROM r WHERE n = 1")
def unique_keywords(spark, d):
    """Keywords unique ignoring case, in the spelling met first."""
    kw = photos(spark, d).select("id", F.explode(F.array_distinct(F.split("keywords", ";"))).alias("k"))
    return kw.groupBy(F.lower("k").alias("key")).agg(F.min_by("k", F.struct("id", "k")).alias("spelling"))


@query("U06_keyword_rename", PHOTOS_SQL + "SELECT id, array_to_string(list_transform(string_split(keywords, ';'), lambda k: CASE WHEN lower(k) = 'travel|france' OR starts_with(lower(k), 'travel|france|') THEN concat('Trips|France', substr(k, 14)) ELSE k END), ';') AS keywords FROM photos")
def keyword_rename(spark, d):
    """A branch of the keyword tree moved below another."""
    moved = lambda k: F.when((F.lower(k) == "travel|france") | F.lower(k).startswith("travel|france|"), F.concat(F.lit("Trips|France"), F.substring(k, 14, 10_000))).otherwise(k)
    return photos(spark, d).select("id", F.array_join(F.array_distinct(F.transform(F.split("keywords", ";"), moved)), ";").alias("keywords"))


@query("U07_set_operations", "SELECT 'union' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": n.exceptAll(b.distinct())}
    out = [p.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n") for op, p in parts.items()]
    return out[0].union(out[1]).union(out[2])
