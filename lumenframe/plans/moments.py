"""Queries of dates, identifiers, folders, frame times, staged search, jobs and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import moments, paths, relative, text
from lumenframe.operators import search, vectors
from lumenframe.plans import indexes
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table


@query(
    "D05_resolve_year",
    "WITH q AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t, 1 + o_orderkey % 31 AS dd, 1 + (o_orderkey // 31) % 12 AS mm FROM orders), c AS (SELECT o_orderkey, y, t, TRY_CAST(concat(year(t) + y, '-', lpad(CAST(mm AS STRING), 2, '0'), '-', lpad(CAST(dd AS STRING), 2, '0')) AS DATE) AS c FROM q, (VALUES (-1), (0), (1)) v(y)), s AS (SELECT *, c - t AS d FROM c WHERE c IS NOT NULL) SELECT o_orderkey, arg_min(c, {'o': d < -10, 'r': CASE WHEN d < -10 THEN -d ELSE d END, 'y': y}) AS future, arg_min(c, {'o': d > 45, 'r': CASE WHEN d > 45 THEN d ELSE -d END, 'y': y}) AS past, arg_min(c, {'o': d < 0, 'r': CASE WHEN d < 0 THEN -d ELSE d END, 'y': y}) AS next, arg_min(c, abs(d) * 10 + y) AS nearest FROM s GROUP BY o_orderkey",
)
def resolve_year(spark, d):
    """Day and month without a year, read in four ways; days that no year has are left out."""
    day, month = 1 + F.col("o_orderkey") % 31, 1 + F.floor(F.col("o_orderkey") / 31) % 12
    ways = [moments.resolve_year(day, month, F.to_date("o_orderdate"), p).alias(p) for p in ("future", "past", "next", "nearest")]
    return table(spark, d, "orders").select("o_orderkey", *ways).where("nearest is not null")


@query(
    "D13_D14_iso_utc",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE strftime(CASE o_orderkey % 5 WHEN 0 THEN t - INTERVAL 2 HOUR WHEN 3 THEN t + INTERVAL 330 MINUTE WHEN 4 THEN date_trunc('day', t) ELSE t END, '%Y-%m-%dT%H:%M:%SZ') END AS at FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400) AS t FROM orders)",
)
def iso_utc(spark, d):
    """Feed dates of five spellings, and unreadable ones, in UTC."""
    secs = (F.col("o_orderkey") % 86400).cast("int")
    clock = F.format_string("%02d:%02d:%02d", (secs / 3600).cast("int"), ((secs % 3600) / 60).cast("int"), secs % 60)
    day = F.to_date("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    mail = F.concat(F.date_format(day, "EEE, dd MMM yyyy "), clock)
    k = F.col("o_orderkey")
    given = F.when(k % 17 == 0, "soon").when(k % 5 == 0, F.concat(iso, F.lit("T"), clock, F.lit("+02:00"))).when(k % 5 == 1, F.concat(iso, F.lit("T"), clock, F.lit(".250Z"))).when(k % 5 == 2, F.concat(mail, F.lit(" GMT"))).when(k % 5 == 3, F.concat(mail, F.lit(" -0530"))).otherwise(iso)
    return table(spark, d, "orders").select("o_orderkey", moments.iso_utc(given).alias("at"))


_MS = "((CAST(o_orderdate AS DATE) - DATE '1970-01-01') * 86400000 + o_orderkey)"


@query(
    "X23_time_ids",
    f"WITH u AS (SELECT o_orderkey AS k, CAST({_MS} AS BIGINT) AS ms FROM orders) SELECT k AS o_orderkey, concat(array_to_string(list_transform(range(0, 10), lambda i: substr('{moments.BASE32}', CAST((ms >> CAST((9 - i) * 5 AS INT)) & 31 AS INT) + 1, 1)), ''), '0123456789ABCDEF') AS id, CASE WHEN k % 4 < 2 THEN ms END AS ms FROM u",
)
def time_ids(spark, d):
    """Identifiers that sort by time, and the time read back: alone, after a prefix, glued, broken."""
    ms = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400000 + F.col("o_orderkey")
    u = table(spark, d, "orders").select("o_orderkey", moments.time_id(ms, F.lit("0123456789ABCDEF")).alias("id"))
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.lower("id")).when(k == 1, F.concat(F.lit("job_"), "id")).when(k == 2, F.concat(F.lit("job"), "id")).otherwise(F.concat(F.lit("U"), F.substring("id", 2, 25)))
    return u.select("o_orderkey", "id", moments.id_millis(written).alias("ms"))


@query(
    "W09_W10_plan_times",
    "WITH q AS (SELECT o_orderkey, (o_orderkey * 13) % 400 AS dur, [o_orderkey % 97, (o_orderkey % 31) + 0.5, (o_orderkey * 7) % 200 + 0.0] AS s FROM orders), c AS (SELECT o_orderkey, CAST(dur AS DOUBLE) AS dur, list_sort(list_distinct(list_transform(s, lambda x: round(least(greatest(CAST(x AS DOUBLE), 0.0), greatest(0.0, dur - 0.25)), 3)))) AS c FROM q), g AS (SELECT *, list_filter(list_concat([least(0.5, greatest(0.0, dur - 0.25))], list_transform(range(1, greatest(1, CAST(ceil((dur - 0.5) / 30) AS BIGINT))), lambda i: i * 30.0)), lambda x: len(list_filter(c, lambda y: abs(x - y) < 2.0)) = 0) AS e, 8 - len(c) AS n FROM c), p AS (SELECT *, CASE WHEN len(e) <= n THEN e ELSE list_transform(range(0, n), lambda i: e[CAST(round_even(i * (len(e) - 1) / (n - 1), 0) AS INT) + 1]) END AS x FROM g) SELECT o_orderkey, CASE WHEN dur > 0 THEN array_to_string(list_transform(list_sort(list_distinct(list_concat(c, x))), lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS STRING)), ',') ELSE '0' END AS times FROM p",
)
def plan_times(spark, d):
    """Milliseconds of the frames to take from each clip."""
    k = F.col("o_orderkey")
    scenes = F.array((k % 97).cast("double"), k % 31 + 0.5, ((k * 7) % 200).cast("double"))
    times = moments.frame_times(((k * 13) % 400).cast("double"), scenes)
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(times, lambda t: F.round(t * 1000).cast("long").cast("string")), ",").alias("times"))


@query(
    "X22_folders",
    PHOTOS_SQL + "SELECT id, CASE id % 4 WHEN 0 THEN concat('c:', path) WHEN 1 THEN path WHEN 2 THEN concat('//srv/share', path) ELSE concat('../', substr(path, 2)) END AS key, id % 4 = 1 AND (starts_with(path, '/lib/1/')) AS inside FROM photos",
)
def folders(spark, d):
    """Folders in four spellings brought to one, and whether they lie in a folder."""
    p, k = F.col("path"), F.col("id") % 4
    odd = F.when(k == 0, F.concat(F.lit("//?/C:"), F.translate(p, "/", "\\"))).when(k == 1, F.concat(F.lit("/a/.././/b/../.."), p)).when(k == 2, F.concat(F.lit("//srv/share/x/../../.."), p, F.lit("/"))).otherwise(F.concat(F.lit("y/../../."), p))
    return photos(spark, d).select("id", paths.folder_key(odd).alias("key"), paths.folder_within(odd, F.lit("/lib//1/")).alias("inside"))


@query(
    "X09_unstack_words",
    r"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr(10)) ELSE text END AS t FROM documents), l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '\S')) AS l FROM t) SELECT doc_id, md5(CASE WHEN len(l) >= 20 AND len(list_filter(l, lambda x: NOT contains(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' '))) > 0.6 * len(l) AND list_sort(list_transform(l, lambda x: length(x)))[len(l) // 2 + 1] <= 14 THEN regexp_replace(regexp_replace(t, '\s*\n+\s*', ' ', 'g'), '^\s+|\s+$', '', 'g') ELSE t END) AS joined FROM l",
)
def unstack_words(spark, d):
    """Texts whose words stand one a line, joined."""
    t = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(paths.unstack_words(t)).alias("joined"))


_WORDS = rf"w AS (SELECT doc_id, regexp_extract_all(translate(lower(text), '{text.ACCENTED}', '{text.PLAIN}'), '[\p{{L}}\p{{N}}]+') AS w FROM documents)"
_ASKED = [["this", "with"], ["thi", "wit"], ["pou", "wit", "that"]]


def _tier_sql(n: int, terms: list[str]) -> str:
    whole = " AND ".join(f"list_contains(w, '{t}')" for t in terms)
    begun = [f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) > 0" for t in terms]
    return f"SELECT {n} AS asked, doc_id, CASE WHEN {whole} THEN 0 WHEN {' AND '.join(begun)} THEN 1 WHEN {' OR '.join(begun)} THEN 2 END AS tier FROM w"


@query("R05_R06_U03_ladder", f"WITH {_WORDS}, t AS ({' UNION ALL '.join(_tier_sql(n, a) for n, a in enumerate(_ASKED))}) SELECT asked, doc_id, tier FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY asked)")
def ladder(spark, d):
    """Three searches: all words, then all beginnings, then any, until something is found."""
    index = indexes.of_documents(spark, d)
    found = [index.ladder(a).select(F.lit(n).alias("asked"), F.col("id").alias("doc_id"), "tier") for n, a in enumerate(_ASKED)]
    return found[0].union(found[1]).union(found[2])


@query("R06_phrase", rf"WITH {_WORDS} SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS BIGINT) AS n FROM w WHERE n > 0")
def phrase(spark, d):
    """Documents with two words one after the other, by the positions in the stored index."""
    return indexes.of_documents(spark, d).phrase(["of", "the"]).select(F.col("id").alias("doc_id"), "n")


@query("R11_merge_rankings", "WITH e AS (SELECT user_id, event_type, sum(1.0 / (60 + 1 + event_id % 100)) AS s, min(1 + event_id % 100) AS f FROM events GROUP BY 1, 2) SELECT user_id, round(sum(s), 6) AS score, string_agg(event_type, '+' ORDER BY f, event_type) AS engines FROM e GROUP BY user_id")
def merge_rankings(spark, d):
    """Hits of several engines merged by reciprocal rank."""
    hits = table(spark, d, "events").select("user_id", "event_type", (1 + F.col("event_id") % 100).alias("rank"))
    return search.merge_rankings(hits, "user_id", "event_type", "rank")


@query("F09_min_score", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 5) AS score FROM embeddings WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) >= 0.1")
def min_score(spark, d):
    """All vectors at or above a raw cosine."""
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("query"))
    return vectors.scored(v, one, "embedding").where("score >= 0.1").select("vec_id", F.round("score", 5).alias("score"))


@query("T02_F20_listing", PHOTOS_SQL + "SELECT id, captured FROM photos WHERE NOT deleted AND captured IS NOT NULL ORDER BY captured DESC, id LIMIT 50 OFFSET 100")
def listing(spark, d):
    """A page of the library, newest first."""
    rows = photos(spark, d).where("not deleted and captured is not null")
    return rows.orderBy(F.col("captured").desc(), "id").offset(100).limit(50).select("id", "captured")


@query("A26_filtered_counts", PHOTOS_SQL + "SELECT deleted, kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (caption IS NOT NULL) AS BIGINT) AS captioned, CAST(count(*) FILTER (rating >= 3 AND NOT missing) AS BIGINT) AS good FROM photos GROUP BY 1, 2")
def filtered_counts(spark, d):
    return photos(spark, d).groupBy("deleted", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("caption").alias("captioned"), F.count_if((F.col("rating") >= 3) & ~F.col("missing")).alias("good"))


@query("J23_step_groups", "SELECT DISTINCT o_custkey, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def step_groups(spark, d):
    """Groups that have a turn of a given status, by their steps' states."""
    turns = table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    steps = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return steps.join(turns, F.col("l_orderkey") == F.col("o_orderkey")).join(groups, "o_custkey").select("o_custkey", "l_linestatus").distinct()


@query("M02_add_remove", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN 'duplicate' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 'unknown' WHEN o_orderkey % 2 = 0 THEN 'removed' ELSE 'added' END AS result FROM orders")
def add_remove(spark, d):
    """Records added or removed by request; a known one is not added, an unknown one not removed."""
    ids = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    known = ids.where("id % 2 = 0").withColumn("known", F.lit(True))
    asked = ids.withColumn("remove", F.col("id") % 3 == 0).join(known, "id", "left")
    result = F.when(F.col("remove"), F.when(F.col("known"), "removed").otherwise("unknown")).otherwise(F.when(F.col("known"), "duplicate").otherwise("added"))
    return asked.select("id", result.alias("result"))


@query("M10_M14_names_preset", PHOTOS_SQL + "SELECT id, CASE label WHEN 'red' THEN 'To print' WHEN 'green' THEN 'Done' ELSE label END AS label, CASE WHEN id % 2 = 0 THEN 'Anna' ELSE camera END AS camera, lens FROM photos")
def names_preset(spark, d):
    """Labels by their own names, and a preset that sets only the fields it gives."""
    names = F.create_map(*[F.lit(x) for x in ("red", "To print", "green", "Done")])
    preset = F.when(F.col("id") % 2 == 0, F.struct(F.lit("Anna").alias("camera"), F.lit(None).cast("string").alias("lens")))
    return photos(spark, d).select("id", F.coalesce(F.try_element_at(names, F.col("label")), "label").alias("label"), *[F.coalesce(preset[c], F.col(c)).alias(c) for c in ("camera", "lens")])


@query("G06_G07_T07_jobs", "SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN 'interrupted' WHEN event_type = 'purchase' THEN 'held' ELSE 'done' END AS state, epoch(TIMESTAMP '2024-01-28 00:00:00') - epoch(date_trunc('second', ts)) >= 86400 AS due FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def jobs(spark, d):
    """The last job of each key after a restart, and whether it is due again after a day."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("j")).select("user_id", "j.*")
    state = F.when(F.col("event_type") == "click", "interrupted").when(F.col("event_type") == "purchase", "held").otherwise("done")
    age = F.unix_seconds(F.lit("2024-01-28 00:00:00").cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return last.select("user_id", "event_id", state.alias("state"), (age >= 86400).alias("due"))


@query("V04_signature", "WITH s AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x - list_avg(CAST(embedding AS DOUBLE[]))) AS s FROM embeddings) SELECT vec_id, round(list_cosine_similarity(s, (SELECT s FROM s WHERE vec_id = 0)), 5) AS likeness FROM s")
def signature(spark, d):
    """Likeness of signatures of zero mean and unit norm."""
    mean = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size("embedding")
    v = table(spark, d, "embeddings").select("vec_id", "embedding", mean.alias("mean"))
    s = v.select("vec_id", vectors.unit(F.transform("embedding", lambda x: x.cast("double") - F.col("mean"))).alias("s"))
    one = s.where("vec_id = 0").select(F.col("s").alias("query"))
    return s.join(F.broadcast(one)).select("vec_id", F.round(vectors.dot(F.col("s"), F.col("query")), 5).alias("likeness"))


@query("M15_delta", PHOTOS_SQL + "SELECT id, CASE WHEN id % 2 = 0 THEN 'flag' ELSE 'flag,rating' END AS changed FROM photos")
def delta(spark, d):
    """The keys in which two versions of a record differ."""
    p = photos(spark, d)
    old = F.create_map(F.lit("rating"), F.col("rating").cast("string"), F.lit("flag"), F.col("flag"), F.lit("label"), F.col("label"))
    new = F.create_map(F.lit("rating"), (F.col("rating") + F.col("id") % 2).cast("string"), F.lit("label"), F.col("label"))
    both = F.map_zip_with(old, new, lambda k, a, b: ~a.eqNullSafe(b))
    return p.select("id", F.array_join(F.array_sort(F.map_keys(F.map_filter(both, lambda k, v: v))), ",").alias("changed"))


@query(
    "D07_parse_due",
    "WITH o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS t, 1 + o_orderkey % 28 AS n, 1 + o_orderkey % 12 AS m FROM orders) SELECT k AS o_orderkey, CASE k % 13 WHEN 0 THEN t + CAST(n AS INT) WHEN 1 THEN t + 14 WHEN 2 THEN CAST(t + INTERVAL 1 MONTH * CAST(m AS INT) AS DATE) WHEN 3 THEN t + 2 WHEN 4 THEN t + 1 WHEN 5 THEN t WHEN 6 THEN t + CAST(1 + (11 - isodow(t)) % 7 AS INT) WHEN 7 THEN CASE WHEN day(t) <= n THEN CAST(date_trunc('month', t) AS DATE) + CAST(n - 1 AS INT) ELSE CAST(date_trunc('month', t) + INTERVAL 1 MONTH AS DATE) + CAST(n - 1 AS INT) END WHEN 8 THEN last_day(t) WHEN 9 THEN make_date(2024, m, n) WHEN 10 THEN CASE WHEN make_date(year(t), m, n) >= t THEN make_date(year(t), m, n) ELSE make_date(year(t) + 1, m, n) END WHEN 11 THEN NULL ELSE NULL END AS due FROM o",
)
def parse_due(spark, d):
    """Due dates said in thirteen ways, from every order's date."""
    k, t = F.col("o_orderkey"), F.to_date("o_orderdate")
    n, m = (1 + k % 28).cast("int"), (1 + k % 12).cast("int")
    months = F.array(*[F.lit(x.split()[0]) for x in relative.MONTHS])
    said = [
        F.format_string("Entregar en %d días", n), F.lit("dentro de dos semanas"), F.format_string("in %d months", m), F.lit("pasado mañana por la mañana"), F.lit("Tomorrow, please"), F.lit("hoy"), F.lit("el próximo viernes"),
        F.format_string("el día %d", n), F.lit("a fin de mes"), F.format_string("%02d/%02d/2024", n, m), F.concat(F.format_string("%d de ", n), F.element_at(months, m)), F.lit("por la mañana"), F.lit("31/02/2024"),
    ]
    text = F.element_at(F.array(*said), (k % 13 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", relative.parse_due(text, t).alias("due"))


@query(
    "D08_resolve_since",
    "WITH e AS (SELECT event_id AS k, ts AS t, epoch_us(ts) / 1e6 AS s, 1 + event_id % 50 AS n FROM events) SELECT k AS event_id, CASE k % 11 WHEN 0 THEN epoch(date_trunc('day', t)) WHEN 1 THEN epoch(date_trunc('day', t)) - 86400 WHEN 2 THEN epoch(date_trunc('day', t)) + 21600 WHEN 3 THEN epoch(date_trunc('week', t)) WHEN 4 THEN epoch(date_trunc('month', t)) WHEN 5 THEN s - 604800 WHEN 6 THEN s - 3600 WHEN 7 THEN s - n * 3600 WHEN 8 THEN s - (n + 0.5) * 60 WHEN 9 THEN epoch(date_trunc('second', t)) ELSE NULL END AS since FROM e",
)
def resolve_since(spark, d):
    """Beginnings said in eleven ways, at every event's time."""
    k, t, n = F.col("event_id"), F.col("ts").cast("timestamp"), (1 + F.col("event_id") % 50).cast("int")
    said = [
        F.lit("Hoy"), F.lit("ayer"), F.lit("esta  mañana"), F.lit("this week"), F.lit("este mes"), F.lit("la semana pasada"), F.lit("last hour"), F.format_string("hace %d horas", n),
        F.format_string("%d,5 minutes ago", n), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("soon"),
    ]
    return table(spark, d, "events").select("event_id", relative.resolve_since(F.element_at(F.array(*said), (k % 11 + 1).cast("int")), t).alias("since"))
