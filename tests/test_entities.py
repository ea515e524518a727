"""Entity lookup, mentions and translation against a plain version of the rules."""

from __future__ import annotations

import difflib
import random
import re
import unicodedata

import pyarrow as pa
import pytest

from lumenframe.operators import entities as en
from lumenframe.plans import named
from lumenframe.plans.views import table

DATA = "/root/testdata/sf0.001"


def _fold(t):
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()


def _key(t):
    return re.sub("[^a-z0-9]+", "", _fold(t or ""))


def _words(t):
    return [x for x in re.split("[^a-z0-9]+", _fold(t or "")) if x]


class Plain:
    def __init__(self, rows, kinds):
        self.kinds, self.entities, self.names, self.words = kinds, {}, {}, {}
        for kind, id_, english, other, aliases in rows:
            self.entities[kind, id_] = (english, other)
        listed = []
        for kind, id_, english, other, aliases in rows:
            for lang, name in [("en", english), ("es", other), *(("alias", a) for a in aliases or []), ("id", id_)]:
                if _key(name):
                    known = self.names.setdefault(_key(name), {})
                    known.setdefault((kind, id_), (lang, name))
                    listed.append((kinds.index(kind), id_, known[kind, id_][1], _key(name)))
        for *_, name, key in sorted(listed):
            self.words.setdefault(key, set(_words(name)))

    def lookup(self, query, limit=5, least=0.78):
        q, hits = _key(query), []
        if not q:
            return []
        less = {"alias": 0.02, "id": 0.01}

        def offer(stage, key, score, worse=False):
            for e, (lang, name) in self.names[key].items():
                hits.append((-round(score - (less.get(lang, 0) if worse else 0), 4), stage, key, lang, name, e))

        if q in self.names:
            offer("exact", q, 1.0, True)
        best = max([-h[0] for h in hits], default=0)
        if best < 0.95:
            if len(q) >= 3:
                for k in sorted(k for k in self.names if k.startswith(q) and k != q)[:60]:
                    offer("prefix", k, 0.8 + 0.12 * len(q) / len(k))
            toks = [t for t in _words(query) if len(t) >= 3]
            if 2 <= len(toks) <= 6:
                for k, w in self.words.items():
                    if set(toks) <= w:
                        offer("tokens", k, 0.78 + 0.12 * min(1.0, len(toks) / len(w)))
        if best < 0.9 and len(q) >= 4:
            grams = {q[i : i + 3] for i in range(len(q) - 2)}
            for k in self.names:
                shared = grams & {k[i : i + 3] for i in range(max(1, len(k) - 2))}
                if len(shared) >= max(1, int(len(grams) * 0.4)) and abs(len(k) - len(q)) <= max(3, len(q) // 2):
                    r = difflib.SequenceMatcher(None, q, k).ratio()
                    if r >= least:
                        offer("fuzzy", k, r * 0.95)
        order = ["exact", "form", "prefix", "tokens", "fuzzy"]
        one = {}
        for h in sorted((h for h in hits if -h[0] >= least), key=lambda h: (h[0], order.index(h[1]), h[2], h[3], h[4])):
            one.setdefault(h[5], h)
        rows = sorted(one.values(), key=lambda h: (h[0], self.kinds.index(h[5][0]), self.entities[h[5]][0], h[5][1]))[:limit]
        return [(query, i + 1, *h[5], -h[0], h[1], h[4], h[3]) for i, h in enumerate(rows)]

    def mentions(self, text):
        words = [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\W_]+(?:['’][^\W_]+)?", text or "")]
        taken, out = [False] * len(words), []
        for n in range(5, 0, -1):
            for i in range(len(words) - n + 1):
                key = "".join(_key(w[0]) for w in words[i : i + n])
                if any(taken[i : i + n]) or key not in self.names or (n == 1 and (len(key) < 3 or key in en.STOP)):
                    continue
                taken[i : i + n] = [True] * n
                out.append((words[i][1], words[i + n - 1][2], key))
        return sorted(out)


@pytest.fixture(scope="module")
def plain(spark):
    return Plain([tuple(r) for r in named.entity_table(spark, DATA).collect()], named.KINDS)


def test_lookup_of_all_queries_equals_plain_rules(spark, plain):
    got = {(r.query, r.rank, r.kind, r.id, r.score, r.how, r.matched, r.matched_lang) for r in named.lookup(spark, DATA).collect()}
    want = {x for r in named.asked(spark, DATA).collect() for x in plain.lookup(r.query)}
    assert got == want
    assert {x[5] for x in got} == {"exact", "prefix", "tokens", "fuzzy"}


def test_mentions_of_all_documents_equal_plain_rules(spark, plain):
    got = {}
    for r in named.annotate(spark, DATA).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.key))
        assert r.ids and r.ambiguous == (len(r.ids) > 1)
    docs = table(spark, DATA, "documents").collect()
    assert {k: sorted(v) for k, v in got.items()} == {r.doc_id: m for r in docs if (m := plain.mentions(r.text))}


ROWS = [
    ("place", "rome", "Rome", "Roma", ["Eternal City"]), ("thing", "sun", "Sun Flower", "Girasol", None), ("thing", "girasol", "Opal", "Girasol", []), ("place", "a", "The", "El", ["x"]),
    ("thing", "sun", "Sun Flower", "Girasol", None), ("title", "noname", "", None, None), ("place", "vuelta", "Round Trip", "Ida y Vuelta", None),
]


@pytest.fixture(scope="module")
def small(spark):
    return en.EntityIndex.build(spark.createDataFrame(ROWS, "kind string, id string, en string, es string, aliases array<string>"), named.KINDS)


def _lookup(spark, index, queries, **kw):
    return [tuple(r) for r in en.lookup(spark.createDataFrame([(q,) for q in queries], "query string"), index, **kw).orderBy("query", "rank").collect()]


def test_lookup_edges(spark, small, tmp_path):
    rows = _lookup(spark, small, ["RÓMA", None, "", "--", "eternal city", "Girasol", "Rome", "vuelta ida", "gira", "Sunflowr"])
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r[3:8:3] + (r[7],))
    assert [x[2] for x in rows if x[0] == "Girasol"] == ["thing", "thing"] and [x[3] for x in rows if x[0] == "Girasol"] == ["girasol", "sun"]
    assert ("eternal city", 1, "place", "rome", "Rome", "Roma", 0.98, "exact", "Eternal City", "alias") in rows
    assert ("RÓMA", 1, "place", "rome", "Rome", "Roma", 1.0, "exact", "Roma", "es") in rows
    assert [x[7] for x in rows if x[0] == "vuelta ida"] == ["tokens"] and [x[7] for x in rows if x[0] == "Sunflowr"] == ["fuzzy"] and {x[7] for x in rows if x[0] == "gira"} == {"prefix"}
    assert not {None, "", "--"} & set(by)
    forms = spark.createDataFrame([("Old Rome", "rome"), ("Old Rome", None)], "query string, form string")
    assert _lookup(spark, small, ["Old Rome"], forms=forms)[0][6:8] == (0.96, "form")
    assert _lookup(spark, small, ["girasol"], kinds=["place"]) == []
    stored = small.stored(f"file://{tmp_path}/index", 2)
    assert _lookup(spark, stored, ["Sunflowr", "gira"]) == _lookup(spark, small, ["Sunflowr", "gira"])


def test_mentions_edges_and_expansion(spark, small):
    texts = [(1, "The sun flower of Rome, the Eternal City; ida y vuelta"), (2, None), (3, ""), (4, "el the x"), (5, "Girasol girasol"), (6, "sun Rome")]
    got = en.mentions(spark.createDataFrame(texts, "id long, text string").selectExpr("id AS doc", "text", "1 AS key"), small, "doc", "text")
    assert sorted((r.doc, r.start, r.key, r.ambiguous) for r in got.collect()) == [
        (1, 4, "sunflower", False), (1, 18, "rome", False), (1, 28, "eternalcity", False), (1, 42, "idayvuelta", False), (5, 0, "girasol", True), (5, 8, "girasol", True), (6, 0, "sun", False), (6, 4, "rome", False),
    ]
    swapped = en.expand(spark.createDataFrame([("a Sun Flower in Rome!",), ("nothing",), (None,)], "query string"), small)
    assert sorted((r.text, r.replaced) for r in swapped.collect()) == [
        ("a Girasol in Roma!", ["Sun Flower", "Rome"]), ("a Girasol in Rome!", ["Sun Flower"]), ("a Sun Flower in Roma!", ["Rome"]),
    ]
    told = en.translate(spark.createDataFrame([("Roma",), ("Rome",), ("girasol",)], "query string"), small)
    assert sorted((r.query, r.to, r.text, r.ambiguous) for r in told.collect()) == [("Roma", "en", "Rome", False), ("Rome", "es", "Roma", False), ("girasol", "en", "Opal", True)]


def test_ratio_bound_loses_no_alike_key():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(4, 14))) for _ in range(2))
        if difflib.SequenceMatcher(None, a, b).ratio() * 0.95 >= 0.78:
            r = 0.78 / 0.95
            assert len(a) * r / (2 - r) <= len(b) <= len(a) * (2 - r) / r


def test_long_texts_travel_in_pieces(spark):
    text = " ".join("Alpha Beta Gamma" if i in (84, 85, 170) else f"w{i} x y" for i in range(2000))
    batch = pa.RecordBatch.from_pydict({"doc": [7, 8, 9], "text": [text, None, text[:40]]})
    out = list(en._placed(iter([batch])))
    assert max(len(w) for b in out for w in b.column("words").to_pylist()) < 300 and max(map(len, out)) <= 64
    # Names stand across the ends of pieces (words 256 and 512) and are found once, at their places.
    known = spark.createDataFrame([("thing", "1", "Alpha Beta Gamma", None, [])], "kind string, id string, en string, es string, aliases array<string>")
    docs = spark.createDataFrame([(7, text), (8, None)], "doc long, text string")
    found = en.mentions(docs, en.EntityIndex.build(known, ["thing"]), "doc", "text").collect()
    assert sorted((r.start, r.end) for r in found) == [(m.start(), m.end()) for m in re.finditer("Alpha Beta Gamma", text)] and len(found) == 3


def test_queries_are_made_once(spark):
    """The stages of a lookup read stored queries; whatever made those is no part of their plan."""
    rows = [("title", "x1", "Red House", "Casa Roja", None)]
    index = en.EntityIndex.build(spark.createDataFrame(rows, "kind string, id string, en string, es string, aliases array<string>"), ["title"])
    found = en.lookup(spark.range(2).selectExpr("if(id = 0, 'red house', 'casa rojas') AS query"), index)
    assert "Range (" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query, r.how) for r in found.collect()) == [("casa rojas", "fuzzy"), ("red house", "exact")]


def test_a_beginning_names_all_its_keys(spark):
    """The shortest keys, which score best, stand behind many others; spellings of one beginning and long queries lose nothing."""
    rows = [("thing", f"x{i}", f"Abcde {i:03d} filler", f"Otra {i:03d}", []) for i in range(90)] + [("place", "z", "Abcdez", "Zeta Corta", []), ("title", "y", "Abcdey", "Corta", ["abcdew"])]
    rows.append(("title", "long", "one two three four five six seven eight", "", []))
    plain = Plain(rows, named.KINDS)
    index = en.EntityIndex.build(spark.createDataFrame(rows, "kind string, id string, en string, es string, aliases array<string>"), named.KINDS)
    got = _lookup(spark, index, ["abcde", "ABC-de", "abcde 0", "eight seven six five four three two one"])
    by = {}
    for r in got:
        by.setdefault(r[0], []).append((r[3], r[6], r[7], r[8]))
    short = round(0.8 + 0.12 * 5 / 6, 4)
    assert by["abcde"][:2] == by["ABC-de"][:2] == [("y", short, "prefix", "abcdew"), ("z", short, "prefix", "Abcdez")] and by["abcde"] == by["ABC-de"] and len(by["abcde"]) == 5
    assert by["abcde 0"] == [(r[3], r[4], r[5], r[6]) for r in plain.lookup("abcde 0")]
    assert by["eight seven six five four three two one"] == [("long", 0.9, "tokens", rows[-1][2])]


def test_translation_takes_the_best_of_all_keys_of_a_beginning(spark):
    """Seventy longer names stand before the best two; both decide the text and whether it is ambiguous."""
    rows = [("thing", f"x{i}", f"Casab {i:03d} del norte", None, []) for i in range(70)] + [("place", "best", "Casabz", "White House", []), ("title", "next", "Casabyy", "Other House", [])]
    schema = "kind string, id string, en string, es string, aliases array<string>"
    asked = spark.createDataFrame([("casab",)], "query string")
    told = lambda rows: [tuple(r) for r in en.translate(asked, en.EntityIndex.build(spark.createDataFrame(rows, schema), named.KINDS)).collect()]
    assert told(rows) == [("casab", "es", "White House", True)]
    assert told(rows[:-1]) == [("casab", "es", "White House", False)]
