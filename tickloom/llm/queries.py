"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import decontaminate, dialogue, gru_lm, html_extract, language_id, ngram_join, packing, pii, quality_forest, suffix_dedup, token_counts, url_rules, whitening
from tickloom.llm.store import table
from tickloom.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("items")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(table(spark, folder, "documents")))


def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, folder, "pages"))


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_forest.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.drop("threshold")


def op6_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return gru_lm.score_documents(table(spark, folder, "documents"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.repeated_spans(table(spark, folder, "documents"))


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.personal_spans(table(spark, folder, "documents")))


def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, folder, "pages"))


def op11_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(table(spark, folder, "conversations"))).withColumnRenamed("conv", "conv_id")


def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.identify(table(spark, folder, "documents"))


def shipped(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(ship(spark), folder)
    return run


QUERIES: dict[str, Query] = {f.__name__: shipped(f) for f in (
    op1_ngram_jaccard_join, op2_decontamination, op3_token_counts, op4_html_extraction, op5_quality_rules, op6_language_model, op7_suffix_dedup, op8_personal_data, op9_best_fit_packing, op10_url_filters,
    op11_embedding_whitening, op12_conversation_repair, op13_language_id)}

def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}')"


_OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('[^ \\t\\n\\x0B\\f\\r]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY 1) m USING (doc_id)"""

_OP2 = f"""WITH d AS (SELECT doc_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents), b AS (SELECT item_id, {_words('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i + 1:i + size], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i + 1:i + size], ' ') AS k FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, k)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

#: Damage by a table-driven crc32, faults by windows, and the repair row by row over the four states of the role pattern.
_OP12 = r"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([CAST(n AS BIGINT)], list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
drawn AS (SELECT src.*, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS draw FROM src, crc),
hurt AS (SELECT conv_id, turn, CASE draw WHEN 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM drawn, range(2) c(n) WHERE draw <> 0 AND (n = 0 OR draw = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS k, regexp_extract(text, '([^ \t\n\x0B\f\r])[ \t\n\x0B\f\r]*$', 1) AS last FROM hurt),
marked AS (SELECT *, left(role, 1) AS i, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (k > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1),
ins(p, q, letters, price) AS (VALUES (0, 0, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 1, '', 0), (1, 2, 'I', 2), (1, 3, 'II', 4), (2, 2, '', 0), (2, 3, 'I', 2), (3, 3, '', 0), (3, 2, 'I', 2)),
moves(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
acts AS (SELECT p, q, i, 'K' AS letter, 0 AS price FROM moves UNION ALL SELECT p, q, NULL, 'R', 2 FROM moves WHERE i <> 's' UNION ALL SELECT p, p, NULL, 'D', 3 FROM range(4) t(p)),
walk AS (SELECT DISTINCT conv_id, 0 AS k, 0 AS state, 0 AS cost, '' AS audit FROM conversations
  UNION ALL SELECT conv_id, k, state, cost, audit FROM (SELECT w.conv_id, m.k, a.q AS state, w.cost + n.price + a.price + CASE WHEN a.letter <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END AS cost, w.audit || n.letters || a.letter AS audit
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1 JOIN ins n ON n.p = w.state JOIN acts a ON a.p = n.q AND (a.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate')) AND (a.letter <> 'K' OR a.i = m.i)
    QUALIFY row_number() OVER (PARTITION BY w.conv_id, a.q ORDER BY w.cost + n.price + a.price + CASE WHEN a.letter <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END, w.audit || n.letters || a.letter) = 1)),
done AS (SELECT w.conv_id, w.cost + n.price AS cost, w.audit || n.letters AS audit FROM walk w JOIN ins n ON n.p = w.state AND n.q IN (0, 3) QUALIFY rank() OVER (PARTITION BY w.conv_id ORDER BY w.k DESC) = 1 AND row_number() OVER (PARTITION BY w.conv_id ORDER BY w.k DESC, w.cost + n.price, w.audit || n.letters) = 1),
letters AS (SELECT conv_id, pos, audit[pos] AS letter FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM done)),
seated AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS k, count(*) FILTER (letter <> 'D') OVER w AS seat FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT s.conv_id, pos, letter, seat, m.role, m.text, max(CASE WHEN seat = 1 AND letter = 'K' AND m.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS led FROM seated s LEFT JOIN marked m ON s.letter <> 'I' AND m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.k = s.k WHERE letter <> 'D'),
lines AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN (seat - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS repaired FROM kept GROUP BY 1)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM d.conv_id"""

#: SQL cannot express the other queries: encoders, forests, models, suffix bytes, graphs, packing, eigenvectors and
#: classifiers are tested against brute force.
ORACLES: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op2_decontamination": _OP2, "op12_conversation_repair": _OP12}
