"""The operators' queries, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, html, langid, licenses, packing, pii, rules, simhash, suffixes, tokens
from loomtext.llm.common import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packs(documents(spark, sf_dir))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_suffix_dedup, op2_decontaminate, op3_language_id, op4_pii, op5_packing, op6_licenses, op7_simhash, op8_quality_rules, op9_token_counts, op10_html)}
#: a word as the kernel has it: ASCII letters and digits and what is above
#: U+00BF, less general punctuation and symbols. No table holds Han or kana.
_W = r"[0-9A-Za-z\x{C0}-\x{1FFF}\x{3040}-\x{10FFFF}]"


def _words(table: str, key: str) -> str:
    """SQL: key, row_no, word, i (from 0), s and e (characters) of every word."""
    return rf"""SELECT {key}, row_no, i - 1 AS i, word, s, e FROM (SELECT {key}, row_no, row_number() OVER (PARTITION BY row_no ORDER BY k) AS i, lower(piece) AS word, e - length(piece) AS s, e
FROM (SELECT {key}, row_no, k, piece, CAST(sum(length(piece)) OVER (PARTITION BY row_no ORDER BY k) AS BIGINT) AS e FROM (SELECT {key}, row_no, generate_subscripts(p, 1) AS k, unnest(p) AS piece
FROM (SELECT {key}, row_number() OVER () AS row_no, regexp_extract_all(text, '(?s){_W}+|[^0-9A-Za-z\x{{C0}}-\x{{1FFF}}\x{{3040}}-\x{{10FFFF}}]+') AS p FROM (SELECT DISTINCT {key}, text FROM {table} WHERE text IS NOT NULL))))
WHERE regexp_matches(piece, '^{_W}'))"""


_SPAN, _LEAK = 50, 13
ORACLE: dict[str, str] = {
    # windows of 50 words that occur twice, joined where they touch
    "op1_suffix_dedup": f"""WITH w AS MATERIALIZED ({_words('documents', 'doc_id')}),
d AS (SELECT doc_id, row_no, list(word ORDER BY i) AS ws, list(s ORDER BY i) AS ss, list(e ORDER BY i) AS es FROM w GROUP BY doc_id, row_no),
g AS MATERIALIZED (SELECT row_no, i, md5(array_to_string(ws[i + 1 : i + {_SPAN}], ' ')) AS h FROM (SELECT row_no, ws, unnest(range(0, len(ws) - {_SPAN - 1})) AS i FROM d WHERE len(ws) >= {_SPAN})),
r AS (SELECT row_no, i FROM (SELECT row_no, i, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
b AS (SELECT row_no, i, CASE WHEN i <= lag(i) OVER (PARTITION BY row_no ORDER BY i) + {_SPAN} THEN 0 ELSE 1 END AS opens FROM r),
p AS (SELECT row_no, min(i) AS a, max(i) + {_SPAN} AS z FROM (SELECT row_no, i, sum(opens) OVER (PARTITION BY row_no ORDER BY i) AS part FROM b) GROUP BY row_no, part)
SELECT doc_id, ss[a + 1] AS start_char, es[z] AS end_char, a AS start_word, z - a AS n_words FROM p JOIN d USING (row_no)""",
    # equal runs of 13 words, joined where they follow each other in both texts
    "op2_decontaminate": f"""WITH w AS MATERIALIZED ({_words('documents', 'doc_id')}), v AS MATERIALIZED ({_words('benchmark', 'item_id')}),
wl AS (SELECT row_no, list(word ORDER BY i) AS ws FROM w GROUP BY row_no), vl AS (SELECT row_no, list(word ORDER BY i) AS ws FROM v GROUP BY row_no),
wg AS MATERIALIZED (SELECT row_no AS r, i, md5(array_to_string(ws[i + 1 : i + {_LEAK}], ' ')) AS g FROM (SELECT row_no, ws, unnest(range(0, len(ws) - {_LEAK - 1})) AS i FROM wl WHERE len(ws) >= {_LEAK})),
vg AS MATERIALIZED (SELECT row_no AS q, i AS j, md5(array_to_string(ws[i + 1 : i + {_LEAK}], ' ')) AS g FROM (SELECT row_no, ws, unnest(range(0, len(ws) - {_LEAK - 1})) AS i FROM vl WHERE len(ws) >= {_LEAK})),
m AS (SELECT r, q, i, i - j AS diagonal FROM wg JOIN vg USING (g)),
b AS (SELECT *, i - row_number() OVER (PARTITION BY r, q, diagonal ORDER BY i) AS part FROM m),
p AS (SELECT r, q, min(i) AS a, max(i) + {_LEAK - 1} AS z FROM b GROUP BY r, q, diagonal, part)
SELECT x.doc_id, item_id, x.s AS start_char, y.e AS end_char, z - a + 1 AS n_words, item_words FROM p JOIN w x ON x.row_no = r AND x.i = a JOIN w y ON y.row_no = r AND y.i = z
JOIN (SELECT row_no, item_id, count(*) AS item_words FROM v GROUP BY ALL) n ON n.row_no = q""",
}
