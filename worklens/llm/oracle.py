"""DuckDB SQL for the corpus queries that SQL can express, written from their rules."""

from __future__ import annotations

from worklens.llm.mixing import MARGINS, TOPICS, Mix
from worklens.llm.rules import LIMITS

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER same AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER same = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW same AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS u, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), s AS (
  SELECT a.u, a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same,
         CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
  FROM v AS a JOIN v ON a.u <> v.u
  WHERE a.vec_id % 100 = 0
), p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST) <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score,
         s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.u, p.vec_id
                            ORDER BY s.score DESC, s.vec_id NULLS LAST) AS rank
  FROM p JOIN s ON s.u = p.u
  WHERE NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score,
       negative_score
FROM n WHERE rank <= 10
"""


def rules_sql() -> str:
    rates = {
        "symbols": "1000 * n_symbols // greatest(n_words, 1)",
        "dup_lines": "1000 * n_dup_lines // greatest(n_lines, 1)",
        "repeats": "1000 * n_repeat_words // greatest(n_words, 1)",
        "word_length": "1000 * word_chars // greatest(n_words, 1)",
    }
    values = "\n  UNION ALL ".join(
        f"SELECT lang, source, '{name}' AS metric, {sql} AS v FROM m"
        " WHERE n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words"
        for name, sql in rates.items()
    )
    share = " ".join(f"WHEN '{k}' THEN {limit.quantile}" for k, limit in LIMITS.items())

    def level(keys: str) -> str:
        own = f"{keys}, metric" if keys else "metric"
        return f"""
  SELECT {own}, min(bin) FILTER (WHERE 1000 * upto >= 500 * total) AS mid, max(total) AS n,
         min(bin) FILTER (WHERE 1000 * upto >= (1000 - CASE metric {share} END) * total) AS lo,
         min(bin) FILTER (WHERE 1000 * upto >= CASE metric {share} END * total) AS hi
  FROM (SELECT {own}, bin, sum(c) OVER (PARTITION BY {own} ORDER BY bin) AS upto,
               sum(c) OVER (PARTITION BY {own}) AS total
        FROM (SELECT {own}, bin, count(*) AS c FROM binned GROUP BY ALL))
  GROUP BY {own}"""

    reach = " ".join(f"WHEN '{k}' THEN {limit.reach}" for k, limit in LIMITS.items())
    inside = " AND ".join(
        f"{sql} <= max(high) FILTER (WHERE metric = '{name}')"
        + (f" AND {sql} >= max(low) FILTER (WHERE metric = '{name}')" if name == "word_length" else "")
        for name, sql in rates.items()
    )
    return rf"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM documents)
), g AS (
  SELECT doc_id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, w2, w3) > 1 AS again
  FROM g
), p AS (
  SELECT doc_id, count(*) FILTER (WHERE hit) AS n_repeat_words FROM (
    SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i
                                        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM r)
  GROUP BY doc_id
), c AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words,
         coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)
), v AS (
  {values}
), binned AS (
  SELECT lang, source, metric,
         (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin FROM v
), s AS ({level("lang, source")}
), sl AS ({level("lang")}
), sa AS ({level("")}
), t AS (
  SELECT lang, source, metric,
         CASE WHEN s.n >= 100 THEN s.lo WHEN sl.n >= 100 THEN sl.lo ELSE sa.lo END AS lo,
         CASE WHEN s.n >= 100 THEN s.mid WHEN sl.n >= 100 THEN sl.mid ELSE sa.mid END AS mid,
         CASE WHEN s.n >= 100 THEN s.hi WHEN sl.n >= 100 THEN sl.hi ELSE sa.hi END AS hi
  FROM s JOIN sl USING (lang, metric) JOIN sa USING (metric)
), f AS (
  SELECT lang, source, metric,
         lo - CASE metric {reach} END
           * greatest(mid - lo, 1 << greatest(length(bin(mid)) - 6, 0)) AS low,
         hi + CASE metric {reach} END
           * greatest(hi - mid, 1 << greatest(length(bin(hi)) - 6, 0)) AS high FROM t
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND coalesce({inside}, true) AS kept
FROM m LEFT JOIN f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source
GROUP BY doc_id, m.lang, m.source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words
"""


def mixing_sql(mix: Mix = Mix()) -> str:
    counts = ", ".join(
        f"len(regexp_extract_all(text, '{pattern}')) AS {name}" for name, pattern in TOPICS.items()
    )
    most = f"greatest({', '.join(sorted(TOPICS))})"
    cases = " ".join(f"WHEN {t} > 0 AND {t} = {most} THEN '{t}'" for t in sorted(TOPICS))
    steps, last = [], "b"
    for margin in MARGINS:
        steps.append(
            f"to_{margin} AS (SELECT {margin}, power(own, {mix.temper[margin]})"
            f" / sum(power(own, {mix.temper[margin]})) OVER () AS share"
            f" FROM (SELECT {margin}, sum(observed) AS own FROM b GROUP BY {margin}))"
        )
    for sweep in range(mix.sweeps):
        for margin in MARGINS:
            name = f"w{sweep}_{margin}"
            steps.append(
                f"{name} AS MATERIALIZED (SELECT {last}.* REPLACE ({last}.weight * share"
                f" / sum({last}.weight) OVER (PARTITION BY {last}.{margin}) AS weight)"
                f" FROM {last} JOIN to_{margin} USING ({margin}))"
            )
            last = name
    level = f"{mix.keep}"
    for fill in range(mix.fills):
        steps.append(
            f"l{fill} AS MATERIALIZED (SELECT greatest(any_value(level), coalesce(({mix.keep}"
            " - coalesce(sum(observed) FILTER (WHERE level * weight / observed >= 1), 0))"
            " / nullif(sum(weight) FILTER (WHERE level * weight / observed < 1), 0),"
            f" any_value(level))) AS level FROM (SELECT *, {level}::DOUBLE AS level FROM {last}))"
        )
        level = f"(SELECT level FROM l{fill})"
    return rf"""
WITH n AS (
  SELECT doc_id, source, lang, {counts},
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens FROM documents
), d AS (
  SELECT doc_id, source, lang, tokens, CASE {cases} ELSE 'general' END AS topic FROM n
), b AS (
  SELECT source, lang, topic, sum(tokens) / sum(sum(tokens)) OVER () AS observed,
         sum(tokens) / sum(sum(tokens)) OVER () AS weight
  FROM d GROUP BY source, lang, topic HAVING sum(tokens) > 0
), {", ".join(steps)}
SELECT doc_id, topic, tokens AS n_tokens, round(weight, 9) AS cell_weight,
       round(least(1, {level} * weight / observed), 9) AS probability,
       ('0x' || left(md5('{mix.seed}:' || doc_id), 8))::UBIGINT / 4294967296
         < round(least(1, {level} * weight / observed), 9) AS kept
FROM d JOIN {last} USING (source, lang, topic)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing_sql(),
        "op5_quality_rules": rules_sql(),
        "op10_exact_dedup": EXACT,
        "op12_hard_negatives": HARD_NEGATIVES,
    }
