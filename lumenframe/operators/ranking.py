"""Full-text postings, BM25, rank fusion and relevance bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.text import fold
from lumenframe.operators.checkpoints import stored

#: Frequent words by which languages are told apart; of equal counts the earlier language wins.
STOP_WORDS = {
    "en": "the a an of in on at for with and or is are my our from to photo photos picture pictures image images last this that where when who some near",
    "es": "el la los las un una unos unas de del en con y o es son mi mis nuestro desde foto fotos imagen imágenes último última donde dónde cuando cuándo quien quién playa perro",
    "fr": "le la les un une des de du et ou est sont mon ma mes notre depuis photo photos image images dernier dernière où quand qui plage chien",
    "de": "der die das ein eine und oder ist sind mein meine unser von foto fotos bild bilder letzte letzter wo wann wer strand hund",
    "pt": "o a os as um uma uns umas de do da e ou é são meu minha nosso desde foto fotos imagem imagens último última onde quando quem praia cachorro cão",
    "it": "il lo la i gli le un uno una di e o è sono mio mia nostro da foto immagine immagini ultimo ultima dove quando chi spiaggia cane",
}


#: Question and glue words, left out of what a question is about.
GLUE_WORDS = (
    "de la el los las un una unos unas y o u e en del al a que con por para se su sus lo le les es son no ni como más muy ya mi mis tu tus me te sobre acerca dónde donde qué cuál "
    "cuáles cómo cuándo quién hay he ha leí escribí dice dijo del este esta esto the of an and or in on to is are was were for with that this about where what which how when who did i my"
)


def _equals(term: str):
    return lambda x: x == term


def _among(terms: list[str]):
    return lambda x: x.isin(terms)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of any script in the folded text."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def content_words(text: Column) -> Column:
    """The words of a question without glue words and single letters; all of them if nothing would be left."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    glue = F.split(fold(F.lit(GLUE_WORDS)), " ")
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(glue, fold(w)))
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def stem(w: Column) -> Column:
    """Plural endings cut off."""
    return F.when((F.length(w) > 5) & w.endswith("es"), F.substring(w, F.lit(1), F.length(w) - 2)).when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def plain_stem(w: str) -> str:
    """``stem`` for a Python string."""
    return w[:-2] if len(w) > 5 and w.endswith("es") else w[:-1] if len(w) > 4 and w.endswith("s") else w


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf``."""
    words = docs.select(id_col, F.explode(F.transform(tokens(F.col(text_col)), stem)).alias("term"))
    return words.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``term, df, cf``: ids that have a stem, and its occurrences. A row counts its own stems once and again, so sums by
    stem are all that is shuffled; only texts whose id repeats meet by id. Texts without an id add to ``cf`` alone."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = stored(rows.where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "repeated-ids")
    repeat = not again.isEmpty()
    one = rows.join(again, "id", "left_anti") if repeat else rows
    one = one.select("id", F.transform(tokens(F.col("text")), stem).alias("w"))
    own = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(1).alias("own")))
    every = F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(0).alias("own")))
    one = one.select("id", F.explode(F.concat(own, every)).alias("t")).groupBy("t.term").agg(F.count_if((F.col("t.own") == 1) & F.col("id").isNotNull()).alias("df"), F.count_if(F.col("t.own") == 0).alias("cf"))
    if not repeat:
        return one
    many = postings(rows.join(again, "id", "left_semi"), "id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    return one.unionByName(many).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id, score`` of rows with a term. Rows are counted in place: a row keeps its length and the
    frequencies of the asked terms only, so nothing is shuffled but one row of statistics."""
    words = F.transform(tokens(F.col(text_col)), stem)
    rows = docs.select(F.col(id_col), words.alias("w"))
    rows = rows.select(id_col, F.size("w").alias("dl"), *[F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    stats = rows.agg(F.count_if(F.col("dl") > 0).alias("n"), F.avg(F.when(F.col("dl") > 0, F.col("dl"))).alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.lit(0.1), F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)))
        tf = F.col(f"tf{i}")
        parts.append(F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(0.0))
    found = rows.where(reduce(lambda x, y: x | y, [F.col(f"tf{i}") > 0 for i in range(len(terms))])).join(F.broadcast(stats))
    return found.select(id_col, reduce(lambda x, y: x + y, parts).alias("score"))


def fused(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``rows`` with the weighted sum of min-max scaled columns; a constant column counts as 1."""
    ends = rows.agg(*[f(c).alias(f"{n}_{c}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    part = lambda c: F.when(F.col(f"hi_{c}") == F.col(f"lo_{c}"), 1.0).otherwise((F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    total = reduce(lambda x, y: x + y, [part(c) * w for c, w in weights.items()])
    return rows.join(F.broadcast(ends)).select(*rows.columns, total.alias("fused"))


def reciprocal(ranked: DataFrame, id_col: str, rank_col: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of rows ``id, rank`` of several rankings."""
    return ranked.groupBy(id_col).agg(F.sum(1.0 / (F.col(rank_col) + k)).alias("rrf"))


def bands(rows: DataFrame, score: str, strong: float = 0.27, medium: float = 0.245, slack: float = 0.04) -> DataFrame:
    """``relevance`` of each row: weak below the bands or far below the best."""
    best = rows.agg(F.max(score).alias("best_"))
    near = F.col("best_") - F.col(score) <= slack
    band = F.when((F.col(score) >= strong) & near, "strong").when((F.col(score) >= medium) & near, "medium").otherwise("weak")
    return rows.join(F.broadcast(best)).withColumn("relevance", band).drop("best_")


def non_english(text: Column) -> Column:
    """The language whose stop words are most, if there is one at all and more than English ones; null for
    a text of fewer than two words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{No}\p{Nl}]+"), F.lit(0))
    n = {k: F.size(F.filter(words, _among(v.split()))) for k, v in STOP_WORDS.items()}
    others = [k for k in n if k != "en"]
    best = F.greatest(*[n[k] for k in others])
    named = reduce(lambda later, k: F.when(n[k] == best, k).otherwise(later), reversed(others), F.lit(None))
    return F.when((F.size(words) >= 2) & (best >= 1) & (best > n["en"]), named)


def name_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words of two folded names, where an initial of ``a`` counts half for a word of ``b``; 1 for the
    same words in any order, 0 for a name without words."""
    words = lambda c: F.regexp_extract_all(fold(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    x, y = words(a), words(b)
    left, right = F.array_except(x, y), F.array_except(y, x)
    initials = F.filter(left, lambda w: (F.length(w) == 1) & F.exists(right, lambda v: v.startswith(w)))
    share = (F.size(F.array_intersect(x, y)) + 0.5 * F.size(initials)) / F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(F.array_sort(x) == F.array_sort(y), 1.0).otherwise(F.bround(F.least(share, F.lit(1.0)), 4))
