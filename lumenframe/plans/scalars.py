"""Queries of text, URL, date, money and identifier functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import checks, text, urls
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table

_FOLD = f"translate(lower({{}}), '{text.ACCENTED}', '{text.PLAIN}')"


@query("R01_fold", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


_SLUG = rf"regexp_replace(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "X01_slugify",
    f"WITH s AS (SELECT doc_id, {_SLUG} AS s FROM documents), h AS (SELECT *, substr(s, 1, 40) AS h FROM s) SELECT doc_id, CASE WHEN length(s) <= 40 THEN s WHEN substr(s, 41, 1) <> '-' AND contains(h, '-') THEN regexp_replace(substr(h, 1, length(h) - strpos(reverse(h), '-')), '-+$', '') ELSE regexp_replace(h, '-+$', '') END AS slug FROM h",
)
def slugify(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("X02_safe_filename", r"""SELECT page_id, substr(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]+', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), 1, 120) AS name FROM pages""")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("X03_H10_clamp", "WITH h AS (SELECT doc_id, text, substr(text, 1, 99) AS h FROM documents) SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE concat(rtrim(CASE WHEN contains(h, ' ') THEN substr(h, 1, length(h) - strpos(reverse(h), ' ')) ELSE h END, ' '), '…') END AS short FROM h")
def clamp(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clamp(F.col("text"), 100).alias("short"))


_MAIL = "concat(replace(lower(c_name), '#', '.'), CASE WHEN c_custkey % 3 = 0 THEN '+tag' ELSE '' END, '@', CASE WHEN c_custkey % 2 = 0 THEN 'GMail.com' ELSE 'Example.org' END)"


@query("X04_normalize_email", f"WITH e AS (SELECT c_custkey, lower({_MAIL}) AS e FROM customer), p AS (SELECT c_custkey, split_part(split_part(e, '@', 1), '+', 1) AS l, split_part(e, '@', 2) AS h FROM e) SELECT c_custkey, concat(CASE WHEN h = 'gmail.com' THEN replace(l, '.', '') ELSE l END, '@', h) AS email, h AS domain FROM p")
def normalize_email(spark, d):
    e = table(spark, d, "customer").selectExpr("c_custkey", f"{_MAIL} AS e")
    n = text.normalize_email(F.col("e"))
    return e.select("c_custkey", n.alias("email"), F.split_part(n, F.lit("@"), F.lit(2)).alias("domain"))


_PHONE = "concat(CASE WHEN c_custkey % 3 = 0 THEN '00' WHEN c_custkey % 3 = 1 THEN '+' ELSE '' END, CAST(600000000 + c_custkey * 7919 AS STRING), CASE WHEN c_custkey % 5 = 0 THEN ' (0)' ELSE '' END)"


@query("X05_normalize_phone", rf"WITH p AS (SELECT c_custkey, regexp_replace(regexp_replace({_PHONE}, '[^0-9+]', '', 'g'), '^00', '+') AS d FROM customer) SELECT c_custkey, CASE WHEN starts_with(d, '+') THEN d ELSE concat('+34', d) END AS phone FROM p")
def normalize_phone(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_PHONE} AS p").select("c_custkey", text.normalize_phone(F.col("p")).alias("phone"))


@query("X07_X10_digest_useful", r"SELECT doc_id, sha256(text) AS sha, CAST(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS INT) AS useful FROM documents")
def digest_useful(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), text.useful_chars(F.col("text")).alias("useful"))


@query("X08_clean_text", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([a-z])-\n([a-z])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ')) AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.clean(F.col("text"))).alias("cleaned"))


@query("X14_page_ranges", "WITH s AS (SELECT l_orderkey, l_linenumber, l_linenumber - dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey + l_linenumber) % 4 <> 0)), r AS (SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b FROM s GROUP BY l_orderkey, g) SELECT l_orderkey, string_agg(CASE WHEN b > a THEN concat(a, '-', b) ELSE CAST(a AS STRING) END, ', ' ORDER BY a) AS pages FROM r GROUP BY l_orderkey")
def page_ranges(spark, d):
    li = table(spark, d, "lineitem").where("(l_orderkey + l_linenumber) % 4 <> 0").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("p"))
    return li.select("l_orderkey", text.merge_page_ranges(F.col("p")).alias("pages"))


@query("X17_format_ts", PHOTOS_SQL + "SELECT id, CASE WHEN s >= 3600 THEN concat(s // 3600, ':', lpad(CAST(s % 3600 // 60 AS STRING), 2, '0'), ':', lpad(CAST(s % 60 AS STRING), 2, '0')) ELSE concat(s // 60, ':', lpad(CAST(s % 60 AS STRING), 2, '0')) END AS shown FROM (SELECT id, (id * 37) % 9000 AS s FROM photos)")
def format_ts(spark, d):
    return photos(spark, d).select("id", text.format_ts((F.col("id") * 37) % 9000).alias("shown"))


@query("X18_plain_key", rf"SELECT s_suppkey, replace(regexp_replace(regexp_replace({_FOLD.format('n')}, '[^a-z0-9 ]+', ' ', 'g'), '\b(s l u|s l|s a|slu|sl|sa|ltd|inc|llc|gmbh|corp|co)\b', ' ', 'g'), ' ', '') AS k FROM (SELECT s_suppkey, concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ', S.L.' WHEN s_suppkey % 3 = 1 THEN ' Inc.' ELSE ' GmbH' END) AS n FROM supplier)")
def plain_key(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey", "concat(s_name, CASE WHEN s_suppkey % 3 = 0 THEN ', S.L.' WHEN s_suppkey % 3 = 1 THEN ' Inc.' ELSE ' GmbH' END) AS n")
    return s.select("s_suppkey", text.plain_key(F.col("n")).alias("k"))


@query("X20_group_labels", "SELECT o_orderkey, strftime(o_orderdate, '%A') AS weekday, strftime(o_orderdate, '%B %Y') AS month, strftime(o_orderdate, '%d %b %Y') AS day FROM orders")
def group_labels(spark, d):
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(t, "EEEE").alias("weekday"), F.date_format(t, "MMMM yyyy").alias("month"), F.date_format(t, "dd MMM yyyy").alias("day"))


@query("X21_keyword_clean", PHOTOS_SQL + "SELECT id, array_to_string(list_filter(list_transform(string_split(concat(' ', k, ' | '), '|'), lambda x: trim(x)), lambda x: x <> ''), '|') AS k FROM (SELECT id, unnest(string_split(keywords, ';')) AS k FROM photos)")
def keyword_clean(spark, d):
    k = photos(spark, d).select("id", F.explode(F.split("keywords", ";")).alias("k"))
    parts = F.filter(F.transform(F.split(F.concat(F.lit(" "), "k", F.lit(" | ")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    return k.select("id", F.array_join(parts, "|").alias("k"))


@query("X24_versions", "SELECT p_partkey, TRY_CAST(split_part(v, '.', 1) AS INT) AS major, TRY_CAST(split_part(v, '.', 2) AS INT) AS minor, coalesce(TRY_CAST(split_part(v, '.', 3) AS INT), 0) AS patch FROM (SELECT p_partkey, concat(p_size % 5, '.', p_partkey % 12, CASE WHEN p_partkey % 2 = 0 THEN '.7' ELSE '' END) AS v FROM part)")
def versions(spark, d):
    v = table(spark, d, "part").selectExpr("p_partkey", "concat('v', p_size % 5, '.', p_partkey % 12, CASE WHEN p_partkey % 2 = 0 THEN '.7' ELSE '' END) AS v")
    return v.select("p_partkey", text.semver_key(F.col("v")).alias("s")).select("p_partkey", "s.major", "s.minor", "s.patch")


@query("X25_backup_paths", PHOTOS_SQL + "SELECT id FROM photos WHERE regexp_matches(path, '(?i)(backup|copia|copy|whatsapp)')")
def backup_paths(spark, d):
    return photos(spark, d).where(F.regexp_like(text.fold(F.col("path")), F.lit("(backup|copia|copy|whatsapp)"))).select("id")


@query("N12_mask_secrets", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?i)(token|secret|password|api_key)( ?[=:] ?"?)[A-Za-z0-9_\-]{8,}', '\1\2***', 'g'), '(?i)bearer [A-Za-z0-9._\-]{8,}', 'Bearer ***', 'g'), '\b[0-9a-f]{32,}\b', '***', 'g')) AS masked FROM documents""")
def mask_secrets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.mask_secrets(F.col("text"))).alias("masked"))


@query("D01_iso_dates", PHOTOS_SQL + "SELECT id, TRY_CAST(s AS DATE) AS day FROM (SELECT id, concat(substr(imported, 1, 8), lpad(CAST(25 + id % 9 AS STRING), 2, '0')) AS s FROM photos)")
def iso_dates(spark, d):
    """Days that do not exist become null."""
    s = F.concat(F.substring("imported", 1, 8), F.lpad((25 + F.col("id") % 9).cast("string"), 2, "0"))
    return photos(spark, d).select("id", s.try_cast("date").alias("day"))


@query("D02_D03_D04_date_steps", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS later, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS month, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-12-31') AS days, CAST(o_orderdate AS DATE) + CAST((12 - isodow(o_orderdate)) % 7 + CASE WHEN isodow(o_orderdate) = 5 THEN 7 ELSE 0 END AS INT) AS friday FROM orders")
def date_steps(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_add(day, 45).alias("later"), F.add_months(day, 1).alias("month"), F.datediff(F.lit("1998-12-31").cast("date"), day).cast("long").alias("days"), F.next_day(day, "Fri").alias("friday")
    )


@query(
    "D09_easter",
    "WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders), a AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM y), h AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM a), m AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM h), n AS (SELECT *, (a + 11 * h + 22 * m) // 451 AS n FROM m) SELECT y AS year, make_date(y, (h + m - 7 * n + 114) // 31, (h + m - 7 * n + 114) % 31 + 1) AS easter FROM n",
)
def easter(spark, d):
    y = table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", checks.easter(F.col("year")).alias("easter"))


_EASTER_SQL = (
    "e AS (SELECT y, make_date(y, (h + m - 7 * n + 114) // 31, (h + m - 7 * n + 114) % 31 + 1) AS easter FROM (SELECT *, (a + 11 * h + 22 * m) // 451 AS n FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM "
    "(SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT DISTINCT CAST(year(day) AS INT) AS y FROM days))))))"
)
_CAL = (
    "ends AS (SELECT least(min(CAST(o_orderdate AS DATE)), min(CAST(l_shipdate AS DATE))) AS a, greatest(max(CAST(o_orderdate AS DATE)), max(CAST(l_shipdate AS DATE))) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey), "
    f"days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM ends), {_EASTER_SQL}, "
    "cal AS (SELECT day, isodow(day) < 6 AND NOT (strftime(day, '%m-%d') IN ('01-01', '05-01', '12-25')) AND day <> easter - 2 AS business FROM days JOIN e ON y = year(day))"
)


@query("D10_business_days", f"WITH {_CAL}, n AS (SELECT *, coalesce(sum(business::INT) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM cal) SELECT l_orderkey, l_linenumber, CAST(b.nth - a.nth AS BIGINT) AS days, a.business AS ordered_on_business_day FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN n a ON a.day = CAST(o_orderdate AS DATE) LEFT JOIN n b ON b.day = CAST(l_shipdate AS DATE)")
def business_days(spark, d):
    """Business days from an order to its shipping; a missing date leaves both null."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("ship")).join(o, "l_orderkey")
    cal = checks.calendar([F.col("day"), F.col("ship")], li)
    a = cal.select("day", F.col("nth").alias("n0"), F.col("business").alias("ordered_on_business_day"))
    b = cal.select(F.col("day").alias("ship"), F.col("nth").alias("n1"))
    return li.join(a, "day", "left").join(b, "ship", "left").select("l_orderkey", "l_linenumber", (F.col("n1") - F.col("n0")).alias("days"), "ordered_on_business_day")


@query("D12_shift_iso", PHOTOS_SQL + "SELECT id, strftime(CAST(captured AS TIMESTAMP) - INTERVAL 5400 SECOND, '%Y-%m-%dT%H:%M:%S') AS shifted, CAST(epoch(CAST(captured AS TIMESTAMP)) AS BIGINT) AS seconds FROM photos WHERE captured IS NOT NULL")
def shift_iso(spark, d):
    t = F.to_timestamp_ntz("captured", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    p = photos(spark, d).where("captured is not null")
    return p.select("id", F.date_format(t - F.expr("INTERVAL 5400 SECOND"), "yyyy-MM-dd'T'HH:mm:ss").alias("shifted"), F.unix_seconds(t.cast("timestamp")).alias("seconds"))


@query("N02_cents", "SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18,6)) * 100, 0) AS BIGINT) AS cents FROM lineitem")
def cents(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", checks.to_cents(F.col("l_extendedprice")).alias("cents"))


_SHOWN = "CASE WHEN c_custkey % 4 = 0 THEN concat('€ ', CAST(c_custkey % 900 + 1 AS STRING), '.234,50') WHEN c_custkey % 4 = 1 THEN concat(CAST(c_custkey % 90 AS STRING), ',', lpad(CAST(c_custkey % 100 AS STRING), 2, '0')) WHEN c_custkey % 4 = 2 THEN concat('$', CAST(c_custkey % 90 + 1 AS STRING), ',123.5') ELSE concat(CAST(c_custkey % 90 + 1 AS STRING), '.000') END"


@query("N01_parse_amount", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 900 + 1) * 1000 + 234.5 WHEN c_custkey % 4 = 1 THEN c_custkey % 90 + (c_custkey % 100) / 100.0 WHEN c_custkey % 4 = 2 THEN (c_custkey % 90 + 1) * 1000 + 123.5 ELSE (c_custkey % 90 + 1) * 1000.0 END::DECIMAL(18,2)::DOUBLE AS amount FROM customer")
def parse_amount(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_SHOWN} AS s").select("c_custkey", F.round(checks.parse_amount(F.col("s")).cast("double"), 2).alias("amount"))


@query("N04_format_money", "SELECT o_orderkey, concat(translate(format('{:,.2f}', round(o_totalprice * 100) / 100), ',.', '.,'), ' €') AS shown FROM orders")
def format_money(spark, d):
    return table(spark, d, "orders").select("o_orderkey", checks.format_money(F.round(F.col("o_totalprice") * 100).cast("long")).alias("shown"))


@query(
    "N05_split_shares",
    "WITH e AS (SELECT l_orderkey, l_linenumber, 10007 * l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) AS x FROM lineitem), b AS (SELECT *, CAST(floor(x + 1e-9) AS BIGINT) AS base FROM e), r AS (SELECT *, 10007 - sum(base) OVER (PARTITION BY l_orderkey) AS rest, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(x - base, 9) DESC, l_linenumber) AS k FROM b) SELECT l_orderkey, l_linenumber, CAST(base + CASE WHEN k <= rest THEN 1 ELSE 0 END AS BIGINT) AS share FROM r",
)
def split_shares(spark, d):
    """A sum of cents dealt to an order's lines by quantity, to the last cent."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.lit(10007).alias("total"))
    return checks.split_shares(rows, "l_orderkey", "l_linenumber", "l_quantity", "total").select("l_orderkey", "l_linenumber", "share")


_DIG = "list_transform(string_split(n, ''), lambda x: CAST(x AS INT))"


@query("N06_luhn", "WITH n AS (SELECT o_orderkey, CAST(4000000000000000 + o_orderkey * 7919 AS STRING) AS n FROM orders) SELECT o_orderkey FROM n WHERE list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN CAST(n[i] AS INT) * 2 - CASE WHEN CAST(n[i] AS INT) > 4 THEN 9 ELSE 0 END ELSE CAST(n[i] AS INT) END)) % 10 = 0")
def luhn(spark, d):
    return table(spark, d, "orders").where(checks.luhn_ok((F.lit(4000000000000000) + F.col("o_orderkey") * 7919).cast("string"))).select("o_orderkey")


@query("N08_dni", "SELECT c_custkey FROM customer WHERE substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST((10000000 + c_custkey * 31) % 23 + 1 AS INT), 1) = chr(CAST(65 + c_custkey % 26 AS INT))")
def dni(spark, d):
    n = F.concat((10000000 + F.col("c_custkey") * 31).cast("string"), F.char((65 + F.col("c_custkey") % 26)))
    return table(spark, d, "customer").where(checks.dni_ok(n)).select("c_custkey")


@query("N09_ean", "SELECT p_partkey FROM (SELECT p_partkey, CAST(4000000000000 + p_partkey * 7919 AS STRING) AS n FROM part) WHERE list_sum(list_transform(range(1, 14), lambda i: CAST(n[i] AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) % 10 = 0")
def ean(spark, d):
    return table(spark, d, "part").where(checks.ean_ok((F.lit(4000000000000) + F.col("p_partkey") * 7919).cast("string"))).select("p_partkey")


@query("N07_iban", "SELECT c_custkey FROM customer WHERE (CAST(concat(lpad(CAST(c_custkey * 104729 AS STRING), 20, '0'), '1428', lpad(CAST(c_custkey % 98 AS STRING), 2, '0')) AS HUGEINT)) % 97 = 1")
def iban(spark, d):
    n = F.concat(F.lit("ES"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 104729).cast("string"), 20, "0"))
    return table(spark, d, "customer").where(checks.iban_ok(n)).select("c_custkey")


@query("N15_srgb", "SELECT part.p_partkey, round(CASE WHEN c <= 0.04045 THEN c / 12.92 ELSE pow((c + 0.055) / 1.055, 2.4) END, 6) AS linear, round(least(3, greatest(-3, log2((c + 0.01) / 0.2))), 6) AS stops FROM part, (SELECT p_partkey, (p_size % 51) / 50.0 AS c FROM part) x WHERE x.p_partkey = part.p_partkey")
def srgb(spark, d):
    c = (F.col("p_size") % 51) / 50.0
    return table(spark, d, "part").select("p_partkey", F.round(F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))), 6).alias("linear"), F.round(F.least(F.lit(3.0), F.greatest(F.lit(-3.0), F.log2((c + 0.01) / 0.2))), 6).alias("stops"))


_PARTS = (
    "h AS (SELECT page_id, split_part(trim(url), '#', 1) AS plain FROM pages), g AS (SELECT *, split_part(plain, '?', 1) AS head FROM h), f AS (SELECT *, lower(split_part(head, '://', 1)) AS scheme, substr(head, strpos(head, '://') + 3) AS rest, "
    "substr(plain, length(head) + 2) AS query FROM g), u AS (SELECT page_id, scheme, query, lower(split_part(list_last(string_split(split_part(rest, '/', 1), '@')), ':', 1)) AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM f)"
)
_NORM = rf"{_PARTS}, n AS (SELECT page_id, scheme, host, regexp_replace(path, '/+$', '') AS path, array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '{urls.TRACKING}'))), '&') AS q FROM u)"


@query("H01_split_url", f"WITH {_PARTS} SELECT page_id, scheme, host, path FROM u")
def split_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.split_url(F.col("url")).alias("u")).select("page_id", "u.scheme", "u.host", "u.path")


@query("H02_H03_normalize_url", f"WITH {_NORM} SELECT page_id, concat(scheme, '://', host, path, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS url, concat(regexp_replace(host, '^www\\.', ''), path, CASE WHEN q = '' THEN '' ELSE concat('?', q) END) AS key FROM n")
def normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"), urls.url_key(F.col("url")).alias("key"))


@query("H04_unwrap_redirect", "SELECT page_id, url FROM pages")
def unwrap_redirect(spark, d):
    """Links wrapped once or twice in redirects, and unwrapped again."""
    from pyspark.sql.functions import url_encode

    wrap = lambda c: F.concat(F.lit("https://r.example/out?url="), url_encode(c))
    wrapped = F.when(F.col("page_id") % 2 == 0, wrap(F.col("url"))).otherwise(wrap(wrap(F.col("url"))))
    return table(spark, d, "pages").select("page_id", urls.unwrap_redirect(wrapped).alias("url"))


@query("H05_registrable_domain", f"WITH {_PARTS} SELECT page_id, CASE WHEN regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain FROM u")
def registrable_domain(spark, d):
    return table(spark, d, "pages").select("page_id", urls.registrable_domain(urls.split_url(F.col("url"))["host"]).alias("domain"))


@query("H09_content_hash", r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(lower(html), '<[^>]*>', ' ', 'g'), '[0-9\s]+', ' ', 'g'))) AS h FROM pages")
def content_hash(spark, d):
    """A digest that tags, digits and white space do not change."""
    s = F.regexp_replace(F.regexp_replace(F.lower("html"), "<[^>]*>", " "), r"[0-9\s]+", " ")
    return table(spark, d, "pages").select("page_id", F.sha2(F.trim(s), 256).alias("h"))


@query("H08_H13_page_quality", r"WITH t AS (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '') AS w, html FROM pages) SELECT page_id, CASE WHEN regexp_matches(lower(html), 'captcha|access denied|are you a robot') THEN 'blocked' WHEN len(w) < 120 THEN 'too short' ELSE 'good' END AS verdict FROM t")
def page_quality(spark, d):
    w = F.filter(F.split(F.regexp_replace("html", "<[^>]*>", " "), r"\s+"), lambda x: x != "")
    verdict = F.when(F.regexp_like(F.lower("html"), F.lit("captcha|access denied|are you a robot")), "blocked").when(F.size(w) < 120, "too short").otherwise("good")
    return table(spark, d, "pages").select("page_id", verdict.alias("verdict"))


@query("K01_json_filter", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50")
def json_filter(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.where("k > 50")


@query("K02_K06_patch_merge", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('b=', event_type) WHEN event_id % 3 = 1 THEN concat('a=new,b=', event_type) ELSE concat('a=', user_id, ',b=', event_type) END AS merged FROM events")
def patch_merge(spark, d):
    """A patch over a map: new values win and a null clears its key."""
    base = F.create_map(F.lit("a"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_type"))
    patch = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.lit(None).cast("string"))).when(F.col("event_id") % 3 == 1, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    keys = F.array_sort(F.array_union(F.map_keys(base), F.map_keys(patch)))
    merged = F.transform(keys, lambda k: F.struct(k.alias("k"), F.when(F.array_contains(F.map_keys(patch), k), F.try_element_at(patch, k)).otherwise(F.try_element_at(base, k)).alias("v")))
    shown = F.transform(F.filter(merged, lambda x: x["v"].isNotNull()), lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    return table(spark, d, "events").select("event_id", F.array_join(shown, ",").alias("merged"))


@query("K07_overlay", PHOTOS_SQL + "SELECT id, coalesce(region, city, 'unknown') AS place, coalesce(captured, imported) AS moment, CASE WHEN captured IS NULL THEN 'import' ELSE 'capture' END AS date_source FROM photos")
def overlay(spark, d):
    """Fields filled from the next source that has them, with the source of the date."""
    p = photos(spark, d)
    return p.select("id", F.coalesce("region", "city", F.lit("unknown")).alias("place"), F.coalesce("captured", "imported").alias("moment"), F.when(F.col("captured").isNull(), "import").otherwise("capture").alias("date_source"))
