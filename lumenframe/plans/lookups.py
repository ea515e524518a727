"""Queries of lookups, votes and small checks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import checks, urls
from lumenframe.operators import merchants as trade
from lumenframe.plans.registry import query
from lumenframe.plans.views import PHOTOS_SQL, photos, table

#: Domains of merchants, the longest suffix of which names one.
MERCHANTS = [("example.com", "Example Store"), ("thther.example.org", "Thther Books"), ("example.org", "Example Press"), ("example.net", "Example Net")]
_MSQL = ", ".join(f"('{d}', '{n}')" for d, n in MERCHANTS)


@query(
    "J14_merchants",
    rf"WITH m(domain, merchant) AS (VALUES {_MSQL}), h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages), r AS (SELECT page_id, merchant, row_number() OVER (PARTITION BY page_id ORDER BY length(domain) DESC) AS n FROM h JOIN m ON host = domain OR suffix(host, '.' || domain)) SELECT page_id, merchant FROM r WHERE n = 1",
)
def merchants(spark, d):
    """The merchant of each page: all suffixes of its host looked up, the longest counts."""
    known = spark.createDataFrame(MERCHANTS, "domain string, merchant string")
    labels = F.split(urls.split_url(F.col("url"))["host"], r"\.")
    pages = table(spark, d, "pages").select("page_id", labels.alias("l"))
    suffixes = pages.select("page_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("l")), lambda i: F.array_join(F.slice("l", i, 100), "."))).alias("domain"))
    found = suffixes.join(F.broadcast(known), "domain")
    return found.groupBy("page_id").agg(F.max_by("merchant", F.length("domain")).alias("merchant"))


_S10 = "lpad(CAST((o_orderkey * 7919) % 100000000 AS STRING), 8, '0')"


@query(
    "N13_tracking_check",
    f"WITH n AS (SELECT o_orderkey, {_S10} AS s FROM orders), c AS (SELECT *, 11 - list_sum(list_transform(range(1, 9), lambda i: CAST(s[i] AS INT) * [8, 6, 4, 2, 3, 5, 9, 7][i])) % 11 AS c FROM n) SELECT o_orderkey FROM c WHERE CASE c WHEN 10 THEN 0 WHEN 11 THEN 5 ELSE c END = o_orderkey % 10",
)
def tracking_check(spark, d):
    """Postal numbers of eight digits whose check digit is right."""
    n = table(spark, d, "orders").selectExpr("o_orderkey", f"{_S10} AS s")
    weights = F.array(*[F.lit(x) for x in (8, 6, 4, 2, 3, 5, 9, 7)])
    digits = F.transform(F.filter(F.split("s", ""), lambda x: x != ""), lambda x: x.cast("int"))
    c = 11 - F.aggregate(F.zip_with(digits, weights, lambda a, b: a * b), F.lit(0), lambda t, x: t + x) % 11
    return n.where(F.when(c == 10, 0).when(c == 11, 5).otherwise(c) == F.col("o_orderkey") % 10).select("o_orderkey")


@query("D11_delivery_days", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE isodow(o_orderdate) WHEN 5 THEN 1 WHEN 6 THEN 2 ELSE 1 END AS next FROM orders")
def delivery_days(spark, d):
    """The next day on which a carrier that rests on Sundays delivers."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, F.when(F.weekday(day) == 5, 2).otherwise(1)).alias("next"))


@query("A18_decimal_mark", "WITH v AS (SELECT l_returnflag AS k, CASE WHEN l_orderkey % 3 = 0 THEN replace(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING), '.', ',') ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS STRING) END AS s FROM lineitem) SELECT k, CASE WHEN count(*) FILTER (regexp_matches(s, '\\.[0-9]{1,2}$')) > count(*) FILTER (regexp_matches(s, ',[0-9]{1,2}$')) THEN '.' ELSE ',' END AS mark FROM v GROUP BY k")
def decimal_mark(spark, d):
    """The decimal mark of a column, by the majority of unambiguous values."""
    s = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    v = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.when(F.col("l_orderkey") % 3 == 0, F.replace(s, F.lit("."), F.lit(","))).otherwise(s).alias("s"))
    votes = v.groupBy("k").agg(F.count_if(F.regexp_like("s", F.lit(r"\.[0-9]{1,2}$"))).alias("dot"), F.count_if(F.regexp_like("s", F.lit(",[0-9]{1,2}$"))).alias("comma"))
    return votes.select("k", F.when(F.col("dot") > F.col("comma"), ".").otherwise(",").alias("mark"))


@query("A21_peaks", "SELECT user_id, CAST(b AS INT) AS bucket, max(abs(value)) AS peak FROM (SELECT user_id, value, ntile(8) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS b FROM events) GROUP BY 1, 2")
def peaks(spark, d):
    """The greatest magnitude in each of eight stretches of a user's values."""
    b = F.ntile(8).over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, d, "events").withColumn("bucket", b).groupBy("user_id", "bucket").agg(F.max(F.abs("value")).alias("peak"))


@query(
    "J20_trigram_candidates",
    "WITH n AS (SELECT p_partkey, concat('  ', p_name, ' ') AS n FROM part), g AS (SELECT DISTINCT p_partkey, substr(n, i, 3) AS g FROM n, unnest(range(1, length(n) - 1)) AS t(i)), q AS (SELECT DISTINCT substr('  smal rign ', i, 3) AS g FROM unnest(range(1, 11)) AS t(i)) SELECT p_partkey, CAST(count(*) AS BIGINT) AS shared FROM g JOIN q USING (g) GROUP BY p_partkey HAVING count(*) >= 3",
)
def trigram_candidates(spark, d):
    """Names that share at least three trigrams with a misspelt one."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))
    asked = F.lit("  smal rign ")
    shared = F.size(F.array_intersect(grams(F.concat(F.lit("  "), "p_name", F.lit(" "))), grams(asked))).cast("long")
    return table(spark, d, "part").select("p_partkey", shared.alias("shared")).where("shared >= 3")


@query("H14_robots", "SELECT page_id, path, NOT (starts_with(path, '/fr/8') OR starts_with(path, '/en/')) OR starts_with(path, '/en/2') AS allowed FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)")
def robots(spark, d):
    """Whether rules allow each path: the longest pattern that matches decides."""
    rules = spark.createDataFrame([("/fr/8", False), ("/en/", False), ("/en/2", True)], "pattern string, allow boolean")
    pages = table(spark, d, "pages").select("page_id", urls.split_url(F.col("url"))["path"].alias("path"))
    # A handful of rules: the join has as many rows as pages times rules at most.
    found = pages.join(F.broadcast(rules), F.expr("startswith(path, pattern)"), "left")
    best = found.groupBy("page_id", "path").agg(F.max_by("allow", F.length("pattern")).alias("allow"))
    return best.select("page_id", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))


@query("H15_address_classes", "SELECT o_orderkey, CASE WHEN a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) THEN 'private' WHEN a = 127 THEN 'loopback' WHEN a >= 224 THEN 'reserved' ELSE 'public' END AS class FROM (SELECT o_orderkey, (o_orderkey * 7) % 256 AS a, (o_orderkey * 13) % 256 AS b FROM orders)")
def address_classes(spark, d):
    """IPv4 addresses by numeric range."""
    ip = table(spark, d, "orders").select("o_orderkey", F.concat_ws(".", ((F.col("o_orderkey") * 7) % 256).cast("string"), ((F.col("o_orderkey") * 13) % 256).cast("string"), F.lit("1"), F.lit("2")).alias("ip"))
    part = lambda i: F.get(F.split("ip", r"\."), i).cast("long")
    n = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    inside = lambda first, bits: (n >= first) & (n < first + (1 << (32 - bits)))
    private = inside(10 << 24, 8) | inside((172 << 24) + (16 << 16), 12) | inside((192 << 24) + (168 << 16), 16)
    return ip.select("o_orderkey", F.when(private, "private").when(inside(127 << 24, 8), "loopback").when(n >= 224 << 24, "reserved").otherwise("public").alias("class"))


@query("X15_cite", PHOTOS_SQL + "SELECT id, concat_ws(', ', name, CASE WHEN rating > 0 THEN concat('p. ', rating) END, camera) AS cite FROM photos")
def cite(spark, d):
    """A citation of the parts that are there."""
    return photos(spark, d).select("id", F.concat_ws(", ", "name", F.when(F.col("rating") > 0, F.concat(F.lit("p. "), F.col("rating").cast("string"))), "camera").alias("cite"))


@query("N07_valid_shares", "SELECT CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 98 = 98 - (CAST(concat(lpad(CAST(c_custkey * 104729 AS STRING), 20, '0'), '142800') AS HUGEINT) % 97)")
def valid_ibans(spark, d):
    """How many generated account numbers carry the check digits that their body asks for."""
    n = F.concat(F.lit("ES"), F.lpad((F.col("c_custkey") % 98).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 104729).cast("string"), 20, "0"))
    own = F.col("c_custkey") % 98
    # 00, 01 and 99 leave the remainder that 97, 98 and 02 leave, and are never given.
    return table(spark, d, "customer").where(checks.iban_ok(n) & own.between(2, 98)).agg(F.count(F.lit(1)).alias("n"))


KNOWN = [
    trade.Merchant("store", "shopping", ("example.com",), ("news@mail.example.org",), ("Example Store", "ExStore"), (r"exstore mktp",), frozenset({"subscription"})),
    trade.Merchant("books", "culture", ("thther.example.org",), (), ("Thther Books",), (r"thther books?",)),
    trade.Merchant("press", "culture", ("example.org",), (), ("Example Press",), (r"press", r"example"), frozenset({"bank"})),
    trade.Merchant("net", "telecom", ("example.net",), (), ("Example Net",), (), frozenset({"carrier", "subscription"})),
]


@query(
    "R17_N17_merchants",
    "WITH v AS (SELECT page_id, page_id % 8 AS k FROM pages), r AS (SELECT page_id, k, ['books', 'press', 'store', 'store', 'store', 'books', NULL, 'press'][CAST(k + 1 AS INT)] AS id FROM v) SELECT page_id, id, CASE id WHEN 'store' THEN 'shopping' WHEN 'books' THEN 'culture' WHEN 'press' THEN 'culture' END AS category, coalesce(id = 'store', false) AS subscription, coalesce(id = 'press', false) OR k = 6 AS bank, k IN (2, 3, 4) OR (k = 6 AND page_id % 16 = 6) AS like_store, CASE WHEN id IS NULL THEN 'bancoreal' || page_id ELSE id END AS key FROM r",
)
def resolved_merchants(spark, d):
    """Merchants named in eight ways on every page, their category and flags, and likeness to one of them."""
    k = (F.col("page_id") % 8 + 1).cast("int")
    said = F.array(
        F.lit("https://www.thther.example.org/a?b"), F.lit("Press <a@x.example.org>"), F.lit("News <NEWS@mail.example.org>"), F.lit("ExStore, S.L."), F.lit("Pago ÉXSTORE-MKTP 123"), F.lit("COMPRA Thther Book 99"),
        F.concat(F.lit("Banco Real "), F.col("page_id").cast("string")), F.lit("the example"),
    )
    value = F.element_at(said, k)
    other = F.when(F.col("page_id") % 16 == 6, F.lit("REALBANCO, sl")).otherwise(F.lit("Example Store"))
    p = table(spark, d, "pages")
    known = [trade.resolve(value, KNOWN).alias("id"), trade.category_of(value, KNOWN).alias("category"), trade.has_flag(value, "subscription", KNOWN).alias("subscription"), trade.has_flag(value, "bank", KNOWN).alias("bank")]
    return p.select("page_id", *known, trade.similar(value, other, KNOWN).alias("like_store"), trade.merchant_key(value, KNOWN).alias("key"))
