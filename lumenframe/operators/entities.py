"""Named entities: an index of their names, staged lookup, and mentions in texts.

An entity is a row ``kind, id, en, es, aliases``. Its names are compared by keys: folded letters and
digits only. A lookup tries stages, each of them a join on an index table: equal keys, other forms of the
query, keys that the query begins, keys with all of its words, and keys alike. A
later stage is asked only for queries that the first two leave below a score.

No stage compares all queries with all names. Words are joined by a query's rarest word; likeness
by its rarest trigrams: a key with ``need`` of a query's ``n`` trigrams has one of any ``n - need + 1`` of
them, so the frequent rest need not be joined. Lengths that cannot reach the score go before the ratio of
matching blocks is computed, which Python's ``difflib`` does for the few pairs left.

Mentions are found by joining all runs of one to five words with the keys; of those that overlap the longest
stays, then the first.

Defined results: null or empty queries and names have no key and match nothing; entities that repeat
count once; of equal scores the kinds' order, then the English name and the id decide; a null text has
no mention. Texts must have ids of their own. ``aliases`` may be null.
"""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators.checkpoints import stored

#: The scores of the stages and what names by alias or id lose.
EXACT, FORM, PREFIX, WORDS, SHARE, LIKE = 1.0, 0.96, 0.8, 0.78, 0.12, 0.95
ALIAS_LESS, ID_LESS = 0.02, 0.01
#: Below these the middle and the last stage are asked.
MIDDLE_BELOW, LIKE_BELOW, LEAST = 0.95, 0.9, 0.78
#: Fixed value: words of a mention.
SPAN = 5
#: Words that are no mention alone.
STOP = (
    "a al algo ante con contra de del desde el ella en entre es esta este esto la las le les lo los me mi muy no nos o para pero por que se si sin sobre su sus te todo tu un una uno y ya "
    "the an and are as at be by for from has have how in is it its of on or that to was what when where which who with you your"
).split()

STAGES = ["exact", "form", "prefix", "tokens", "fuzzy"]


def _compatible() -> tuple[str, str]:
    """Characters that are one ASCII letter or digit once compatibility and marks are taken off."""
    found = {}
    for c in map(chr, [*range(0xA0, 0x2600), *range(0xFF00, 0xFFF0)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if len(plain) == 1 and plain.isascii() and plain.isalnum():
            found[c] = plain
    return "".join(found), "".join(found.values())


_FROM, _TO = _compatible()
#: What becomes several letters.
_SPREAD = {c: "".join(x for x in unicodedata.normalize("NFKD", c).casefold() if not unicodedata.combining(x)) for c in "ßẞﬀﬁﬂﬃﬄﬅﬆĳĲǆǅǄǉǈǇǌǋǊ"}


def _folded(c: Column) -> Column:
    spread = reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), _SPREAD.items(), c)
    return F.lower(F.translate(F.when(F.regexp_like(c, F.lit("[" + "".join(_SPREAD) + "]")), spread).otherwise(c), _FROM, _TO))


def compact(c: Column) -> Column:
    """Folded letters a-z and digits only."""
    return F.regexp_replace(_folded(c), "[^a-z0-9]+", "")


def key_words(c: Column) -> Column:
    return F.array_remove(F.split(_folded(c), "[^a-z0-9]+"), "")


def _grams(key: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(key) - 2)), lambda i: F.substring(key, i, F.lit(3))))


class EntityIndex:
    """``names``: ``key, lang, name, kind, id, en, es, place``; ``keys``: ``key, words``; ``begun``: ``prefix, key``;
    ``by_word``: ``word, key``; ``by_gram``: ``gram, key``; ``gram_counts``: ``gram, df``, at most 36 ** 3 rows."""

    TABLES = ("names", "keys", "begun", "by_word", "word_counts", "by_gram", "gram_counts")

    def __init__(self, tables: dict[str, DataFrame], kinds: list[str]):
        self.tables, self.kinds = tables, kinds
        for name in self.TABLES:
            setattr(self, name, tables[name])

    @staticmethod
    def build(entities: DataFrame, kinds: list[str]) -> EntityIndex:
        """``kinds``: all kinds, in the order that decides ties."""
        place = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind"))
        named = [F.struct(F.lit(0).alias("n"), F.lit("en").alias("lang"), F.col("en").alias("name")), F.struct(F.lit(1).alias("n"), F.lit("es").alias("lang"), F.col("es").alias("name"))]
        aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a, i: F.struct((i + 2).alias("n"), F.lit("alias").alias("lang"), a.alias("name")))
        by_id = F.array(F.struct(F.lit(1 << 30).alias("n"), F.lit("id").alias("lang"), F.col("id").alias("name")))
        rows = entities.select("kind", "id", "en", "es", place.alias("place"), F.explode(F.concat(F.array(*named), aliases, by_id)).alias("x"))
        rows = rows.select("*", compact(F.col("x.name")).alias("key")).where("key <> ''")
        names = rows.groupBy("key", "kind", "id").agg(F.min(F.struct("x", "en", "es", "place")).alias("m"))
        names = names.select("key", "m.x.lang", "m.x.name", "kind", "id", "m.en", "m.es", "m.place")
        keys = names.groupBy("key").agg(F.min(F.struct("place", "id", "name")).alias("m")).select("key", F.array_distinct(key_words(F.col("m.name"))).alias("words"))
        # A beginning names all its keys: as many rows as keys have letters.
        begun = keys.select("key", F.explode(F.transform(F.sequence(F.lit(3), F.greatest(F.lit(3), F.length("key"))), lambda n: F.substring("key", F.lit(1), n))).alias("prefix")).where("prefix <> key")
        by_word = keys.select("key", F.explode("words").alias("word"))
        by_gram = keys.select("key", F.explode(_grams(F.col("key"))).alias("gram"))
        counts = lambda df, c: df.groupBy(c).agg(F.count(F.lit(1)).alias("df"))
        return EntityIndex(dict(zip(EntityIndex.TABLES, (names, keys, begun, by_word, counts(by_word, "word"), by_gram, counts(by_gram.where(F.length("gram") == 3), "gram")))), kinds)

    def stored(self, folder: str, buckets: int = 16) -> EntityIndex:
        """The index written below ``folder``, rows ordered by what they are joined on."""
        on = {"names": "key", "keys": "key", "begun": "prefix", "by_word": "word", "word_counts": "word", "by_gram": "gram", "gram_counts": "gram"}
        for name, df in self.tables.items():
            df.repartitionByRange(buckets, on[name]).sortWithinPartitions(on[name]).write.parquet(f"{folder}/{name}")
        return EntityIndex.read(self.names.sparkSession, folder, self.kinds)

    @staticmethod
    def read(spark: SparkSession, folder: str, kinds: list[str]) -> EntityIndex:
        return EntityIndex({name: spark.read.parquet(f"{folder}/{name}") for name in EntityIndex.TABLES}, kinds)


@F.pandas_udf(T.DoubleType())
def _ratio(queries: pd.Series, keys: pd.Series) -> pd.Series:
    """Twice the length of the matching blocks over that of both."""
    matcher, last, out = difflib.SequenceMatcher(), None, []
    for q, k in zip(queries, keys):
        if k != last:
            matcher.set_seq2(k)  # what is known of the second text is kept
            last = k
        matcher.set_seq1(q)
        out.append(matcher.ratio())
    return pd.Series(out)


def _like(asked: DataFrame, index: EntityIndex, least: float) -> DataFrame:
    """``query, key, score`` of keys that are like a query's."""
    short = asked.where(F.length("q") >= 4).select("q", _grams(F.col("q")).alias("grams")).distinct()
    short = short.withColumn("need", F.greatest(F.lit(1), F.floor(F.size("grams") * 0.4)).cast("int"))
    counted = short.select("q", "grams", "need", F.explode("grams").alias("gram")).join(F.broadcast(index.gram_counts), "gram")  # at most 36 ** 3 counts
    ranked = counted.groupBy("q", "grams", "need").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("rare"))
    # Trigrams that no key has are gone from the list, and count among those that may be missing.
    joined = F.size("rare") - F.col("need") + 1
    ranked = ranked.where(joined >= 1).select("q", "grams", "need", F.explode(F.transform(F.slice("rare", F.lit(1), joined), lambda x: x["gram"])).alias("gram"))
    reach = least / LIKE
    low, high = reach / (2 - reach), (2 - reach) / reach
    fits = (F.length("key") >= F.length("q") * low) & (F.length("key") <= F.length("q") * high) & (F.abs(F.length("key") - F.length("q")) <= F.greatest(F.lit(3), F.floor(F.length("q") / 2)))
    pairs = ranked.join(index.by_gram, "gram").where(fits).select("q", "grams", "need", "key").distinct()
    pairs = pairs.where(F.size(F.array_intersect("grams", _grams(F.col("key")))) >= F.col("need"))
    return pairs.select("q", "key", (_ratio("q", "key") * LIKE).alias("score")).where(F.col("score") >= least)


def _best(found: DataFrame, of: str, limit: int) -> DataFrame:
    """The best ``limit`` entities of each ``of``, ranked, with one hit for each: the best, then that of the earlier stage."""
    one = found.groupBy(of, "kind", "id").agg(F.min(F.struct((-F.col("score")).alias("less"), "stage", "key", "lang", "name", "en", "es", "place")).alias("m"))
    one = one.select(of, "kind", "id", "m.*").withColumn("score", -F.col("less"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy("less", "place", "en", "id"))).where(F.col("rank") <= limit)


def lookup(queries: DataFrame, index: EntityIndex, forms: DataFrame | None = None, kinds: list[str] | None = None, limit: int = 5, least: float = LEAST) -> DataFrame:
    """``queries`` (``query``) -> ``query, rank, kind, id, en, es, score, how, matched, matched_lang``: the best
    ``limit`` entities of each distinct query. ``forms`` (``query, form``) are other spellings to try."""
    asked = queries.select("query").where("query is not null").distinct().withColumn("q", compact(F.col("query"))).where("q <> ''")
    asked = stored(asked, "entity-queries")  # every stage asks for them, and their table may be large
    names = index.names if kinds is None else index.names.where(F.col("kind").isin(kinds))
    less = F.when(F.col("lang") == "alias", ALIAS_LESS).when(F.col("lang") == "id", ID_LESS).otherwise(0.0)
    hit = lambda df, stage: df.select("query", "key", F.lit(stage).alias("stage"), F.col("score").cast("double").alias("score"))
    at_once = hit(asked.select("query", F.col("q").alias("key"), F.lit(EXACT).alias("score")), 0)
    if forms is not None:
        others = forms.select("query", compact(F.col("form")).alias("key"), F.lit(FORM).alias("score")).where("key <> ''").join(asked.select("query"), "query", "left_semi")
        at_once = at_once.unionByName(hit(others.distinct(), 1))
    entity = ["query", "key", "stage", "lang", "name", "kind", "id", "en", "es", "place"]
    first = at_once.join(names, "key").select(*entity, F.round(F.col("score") - less, 4).alias("score"))
    best = first.groupBy("query").agg(F.max("score").alias("best"))
    left = asked.join(best, "query", "left").withColumn("best", F.coalesce("best", F.lit(0.0)))

    middle = left.where(F.col("best") < MIDDLE_BELOW)
    # Spellings of one beginning share its keys, so no more rows are joined than the index has. An entity that ``limit`` others
    # of this stage precede can rank only by a better hit of another stage, so the best of each beginning are enough.
    begun = middle.where(F.length("q") >= 3).select("q").distinct().join(index.begun, F.col("q") == F.col("prefix")).drop("prefix").join(names, "key")
    begun = begun.withColumn("score", F.round(PREFIX + SHARE * F.length("q") / F.length("key"), 4)).withColumn("stage", F.lit(2))
    begun = middle.select("query", "q").join(_best(begun, "q", limit), "q").select(*entity, "score")
    several = middle.select("query", F.filter(key_words(F.col("query")), lambda w: F.length(w) >= 3).alias("asked")).where(F.size("asked") >= 2)
    rarest = several.select("query", "asked", F.explode(F.array_distinct("asked")).alias("word")).join(index.word_counts, "word")
    rarest = rarest.groupBy("query", "asked").agg(F.min(F.struct("df", "word")).alias("m")).select("query", "asked", F.col("m.word").alias("word"))
    worded = rarest.join(index.by_word, "word").join(index.keys, "key").where(F.size(F.array_except("asked", "words")) == 0)
    worded = hit(worded.withColumn("score", WORDS + SHARE * F.least(F.lit(1.0), F.size("asked") / F.size("words"))), 3)
    last = left.where(F.col("best") < LIKE_BELOW)
    alike = hit(last.join(_like(last, index, least), "q"), 4)

    later = worded.unionByName(alike).join(names, "key").select(*entity, F.round("score", 4).alias("score"))
    found = first.unionByName(begun).unionByName(later).where(F.col("score") >= least)
    how = F.element_at(F.array(*map(F.lit, STAGES)), F.col("stage") + 1)
    return _best(found, "query", limit).select("query", "rank", "kind", "id", "en", "es", "score", how.alias("how"), F.col("name").alias("matched"), F.col("lang").alias("matched_lang"))


def translate(queries: DataFrame, index: EntityIndex, to: str = "", forms: DataFrame | None = None) -> DataFrame:
    """``query, to, text, ambiguous``: the best entity's name in the other language, or in ``to``."""
    rows = lookup(queries, index, forms, limit=3)
    target = F.lit(to) if to in ("en", "es") else F.when(F.col("matched_lang") == "es", "en").otherwise("es")
    after = F.lead("score").over(Window.partitionBy("query").orderBy("rank"))
    rows = rows.select("query", "rank", target.alias("to"), "en", "es", "score", after.alias("after"))
    return rows.where("rank = 1").select("query", "to", F.when(F.col("to") == "en", F.col("en")).otherwise(F.col("es")).alias("text"), F.coalesce(F.round(F.col("after"), 4) >= F.round(F.col("score") - 0.02, 4), F.lit(False)).alias("ambiguous"))


_WORD = regex.compile(r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?")


#: Words of a text that travel together, and rows and characters of a batch.
_PIECE, _ROWS, _CHARS = 256, 64, 1 << 20


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc, text`` -> ``doc, i, own, words, starts, ends``: the words of each text with their places, which no built-in function
    tells, in pieces: ``own`` words from the ``i``-th, and those after that a run of theirs may reach."""
    for batch in batches:
        doc, texts, out, size = batch.column(0), batch.column(1), [], 0
        for at in range(len(batch)):
            t = texts[at].as_py() or ""
            found = [(m[0], m.start(), m.end()) for m in _WORD.finditer(t)]
            for i in range(0, len(found), _PIECE):
                words, starts, ends = zip(*found[i : i + _PIECE + SPAN - 1])
                out.append((at, i, min(_PIECE, len(found) - i), words, starts, ends))
                size += ends[-1] - starts[0]
                if len(out) >= _ROWS or size >= _CHARS:
                    yield _batch(doc, out)
                    out, size = [], 0
        if out:
            yield _batch(doc, out)


def _batch(doc: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    at, i, own, words, starts, ends = zip(*rows)
    ints = pa.list_(pa.int32())
    arrays = [doc.take(pa.array(at)), pa.array(i, pa.int32()), pa.array(own, pa.int32()), pa.array(map(list, words), pa.list_(pa.string())), pa.array(map(list, starts), ints), pa.array(map(list, ends), ints)]
    return pa.RecordBatch.from_arrays(arrays, ["doc", "at", "own", "words", "starts", "ends"])


def mentions(docs: DataFrame, index: EntityIndex, id_col: str, text_col: str, kinds: list[str] | None = None) -> DataFrame:
    """``id, start, end, span, matches, ambiguous``: entities named in texts, at most three for each
    place, best first."""
    asked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    kind = asked.schema["doc"].dataType.simpleString()
    words = asked.mapInArrow(_placed, f"doc {kind}, at int, own int, words array<string>, starts array<int>, ends array<int>")
    words = words.select("*", F.transform("words", compact).alias("parts"))
    places = words.select("doc", F.explode(F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.struct(
        (F.col("at") + i).alias("i"), F.slice("parts", i, F.lit(SPAN)).alias("parts"), F.get("starts", i - 1).alias("start"), F.slice("ends", i, F.lit(SPAN)).alias("ends"),
    ))).alias("p")).select("doc", "p.*")
    runs = places.select("doc", "i", "start", "ends", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("n"))
    runs = runs.select("doc", "i", "n", "start", F.get("ends", F.col("n") - 1).alias("end"), F.array_join(F.slice("parts", F.lit(1), F.col("n")), "").alias("key"))
    runs = runs.where((F.col("key") != "") & ((F.col("n") > 1) | ((F.length("key") >= 3) & ~F.col("key").isin(STOP))))
    found = runs.join(index.keys.select("key"), "key")
    # Runs that overlap one another form an island, within which the longest, then the first, is taken.
    by_place = Window.partitionBy("doc").orderBy("i", "n")
    reach = F.max(F.col("i") + F.col("n")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("i") >= F.coalesce(reach, F.lit(0)), 1).otherwise(0)).over(by_place)
    islands = found.withColumn("island", island).groupBy("doc", "island").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "i", "n", "start", "end", "key"))).alias("runs"))
    free = lambda taken, x: ~F.exists(taken, lambda t: (t["i"] < x["i"] + x["n"]) & (x["i"] < t["i"] + t["n"]))
    chosen = F.aggregate("runs", F.slice("runs", 1, 0), lambda taken, x: F.when(free(taken, x), F.array_append(taken, x)).otherwise(taken))
    spans = islands.select("doc", F.explode(chosen).alias("x")).select("doc", "x.start", "x.end", "x.key")
    names = index.names if kinds is None else index.names.where(F.col("kind").isin(kinds))
    score = F.round(F.lit(EXACT) - F.when(F.col("lang") == "alias", ALIAS_LESS).when(F.col("lang") == "id", ID_LESS).otherwise(0.0), 4)
    entity = F.struct((-score).alias("less"), "place", "en", "id", "kind", "es", F.col("lang").alias("matched_lang"))
    firsts = names.withColumn("x", entity).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("x"))).where("nth <= 3")
    best = firsts.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("best"))
    match = lambda m: F.struct(m["kind"].alias("kind"), m["id"].alias("id"), m["en"].alias("en"), m["es"].alias("es"), (-m["less"]).alias("score"), m["matched_lang"].alias("matched_lang"))
    spans = spans.join(best, "key").select(F.col("doc").alias(id_col), "start", "end", "key", F.transform("best", match).alias("matches"))
    return spans.withColumn("ambiguous", F.size("matches") > 1)


def expand(queries: DataFrame, index: EntityIndex, most: int = 6) -> DataFrame:
    """``query, text, replaced``: each query with its entities in the other language, all of them, then one at a time."""
    asked = queries.select("query").where("query is not null").distinct()
    found = mentions(asked.select("query", F.col("query").alias("text")), index, "query", "text").withColumn("m", F.col("matches")[0])
    english = F.when(F.col("m.matched_lang") == "es", True).when(F.col("m.matched_lang") == "en", False).otherwise(F.col("key") != compact(F.col("m.en")))
    found = found.withColumn("other", F.when(english, F.col("m.en")).otherwise(F.col("m.es"))).where(compact(F.col("other")) != F.col("key"))
    swaps = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("start", "end", "other"))).alias("swaps"))
    step = lambda q: lambda s, x: F.struct(F.concat(s["out"], F.substring(q, s["at"] + 1, x["start"] - s["at"]), x["other"]).alias("out"), x["end"].alias("at"))
    q = F.col("query")
    swapped = lambda chosen: F.aggregate(chosen, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step(q), lambda s: F.concat(s["out"], F.substring(q, s["at"] + 1, F.length(q))))
    spans = lambda chosen: F.transform(chosen, lambda x: F.substring(q, x["start"] + 1, x["end"] - x["start"]))
    variant = lambda chosen: F.struct(swapped(chosen).alias("text"), spans(chosen).alias("replaced"))
    single = F.transform("swaps", lambda x: variant(F.array(x)))
    every = F.concat(F.array(variant(F.col("swaps"))), F.when(F.size("swaps") > 1, single).otherwise(F.slice(single, 1, 0)))
    rows = swaps.select("query", F.posexplode(every).alias("n", "v"))
    first = rows.groupBy("query", "v.text").agg(F.min_by("v.replaced", "n").alias("replaced"), F.min("n").alias("n"))
    nth = F.row_number().over(Window.partitionBy("query").orderBy("n"))
    return first.withColumn("nth", nth).where(F.col("nth") <= most).select("query", "text", "replaced")
