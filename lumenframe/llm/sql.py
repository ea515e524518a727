"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from lumenframe.llm.quality_rules import RULES, STOP_WORDS

OP6 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       CAST(count(*) OVER (PARTITION BY text_sha256) AS BIGINT) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


def _rules_sql() -> str:
    tests = []
    for r in RULES:
        low = f"{r.part} * 1000 >= {r.total} * {r.low}" if r.low is not None else "TRUE"
        high = f"{r.part} * 1000 <= {r.total} * {r.high}" if r.high is not None else "TRUE"
        tests.append(f"CASE WHEN NOT ({low} AND {high}) THEN '{r.name}' END")
    return "list_filter([" + ", ".join(tests) + "], lambda x: x IS NOT NULL)"


def _stop_sql() -> str:
    words = sorted({w for x in STOP_WORDS.values() for w in x.split()})
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_FILLED = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

OP4 = rf"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, {_FILLED} AS lines FROM a
),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3),
q AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM q WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS BIGINT) AS n_ellipsis_lines,
         CAST(len(list_filter(w, lambda x: list_contains({_stop_sql()}, x))) AS BIGINT) AS n_stop_words,
         CAST(1 AS BIGINT) AS one
  FROM b LEFT JOIN r ON b.doc_id = r.doc_id
),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_rules_sql()} AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(failed_rules) = 0 AS kept, n_lines, n_stop_words,
       array_to_string(failed_rules, ',') AS failed_rules
FROM f
"""

ORACLE_SQL = {"op4_quality_rules": OP4, "op6_exact_dedup": OP6}


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds written out: ``c{i}`` are codebooks, ``a{i}`` the nearest entries."""
    with_ = [
        "k AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "r AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM k)",
        f"s AS (SELECT r, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS x FROM r, (SELECT unnest(range({parts})) AS p))",
        f"c0 AS (SELECT p, r - 1 AS e, x AS c FROM s WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        with_.append(
            f"a{i} AS MATERIALIZED (SELECT r, p, min(d).e AS e, min(d).d AS d FROM (SELECT r, s.p, {{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': e}} AS d "
            f"FROM s JOIN c{i} ON s.p = c{i}.p) GROUP BY r, p)"
        )
        if i < rounds:
            with_.append(
                f"m{i} AS (SELECT p, e, list(CAST(floor(t / n) AS BIGINT) ORDER BY k) AS c FROM (SELECT a{i}.p, a{i}.e, k, sum(x[k]) AS t, count(*) AS n FROM a{i} JOIN s ON a{i}.r = s.r AND a{i}.p = s.p, "
                f"(SELECT unnest(range(1, (SELECT max(len(x)) FROM s) + 1)) AS k) GROUP BY a{i}.p, a{i}.e, k) GROUP BY p, e)"
            )
            with_.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.p, c{i}.e, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON c{i}.p = m{i}.p AND c{i}.e = m{i}.e)")
    return (
        "WITH " + ",\n".join(with_) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM f JOIN r USING (r), h
"""
    )


ORACLE_SQL["op12_vector_codes"] = _codes_sql()

ORACLE_SQL["op11_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, k)) AS j FROM c),
x AS (
  SELECT cut.lang, cut.phrase, a, j, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1 : j], ' ') JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j + 1 : ], ' ')
),
low AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
spans AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS f FROM spans GROUP BY 1, 2),
best AS (
  SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, CAST(score AS BIGINT) AS score
  FROM low LEFT JOIN longer ON low.lang = longer.lang AND low.phrase = longer.phrase WHERE longer.f IS NULL OR 100 * longer.f < 80 * a
)
SELECT best.lang, rank, phrase, a, l, r, n, score FROM best JOIN t USING (lang) WHERE rank <= 2000
"""
