"""The queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, quality
from .bpe import encode_decode
from .chat import format_conversations
from .common import table
from .lm_score import score_texts
from .neardup import near_duplicates
from .packing import pack
from .prefix_trie import prefix_trie, rebuilt
from .search import bm25_search
from .secrets import scan_secrets
from .substring import remove_repeats
from .vector_codes import compress
from .wrappers import main_texts

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 2), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3]) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM inter JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
walk AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT w.x, s.y FROM walk w JOIN sym s ON w.y = s.x),
comp AS (SELECT x, min(y) AS c FROM walk GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM d JOIN comp ON d.doc_id = x LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bm25_search(docs.where("doc_id % 20 = 0"), docs, k=10)


OP2_SQL = r"""
WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS f FROM w GROUP BY ALL), dl AS (SELECT d.doc_id, count(t) AS n FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t), c AS (SELECT count(*) AS n, sum(n) / count(*) AS mean FROM dl),
s AS (SELECT q.doc_id AS query_id, tf.doc_id, round(sum(ln(1 + (c.n - df.df + 0.5) / (df.df + 0.5)) * tf.f * 2.2e0 / (tf.f + 1.2e0 * (0.25e0 + 0.75e0 * dl.n / c.mean))), 6) AS score
  FROM tf q JOIN tf ON q.t = tf.t JOIN df ON df.t = q.t JOIN dl ON dl.doc_id = tf.doc_id CROSS JOIN c WHERE q.doc_id % 20 = 0 GROUP BY ALL)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10
"""


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i FROM d WHERE len(words) >= 50),
wins AS (SELECT s.doc_id, s.i, md5(array_to_string(list_slice(d.words, s.i, s.i + 49), ' ')) AS w FROM starts s JOIN d USING (doc_id)),
least AS (SELECT w, min(doc_id) AS lo FROM wins GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM wins JOIN least USING (w) WHERE lo < doc_id),
gone_lists AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS k FROM pos p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone_lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.spans_text(F.filter("spans", lambda x: x["kind"] < 4))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"), "n_term")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_text=False)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role", r"'\\### Assistant: </turn> ok' AS text")
    out = format_conversations(rows.unionByName(probe), keep_text=False)
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


OP10_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(replace(replace(role, '\', '\\'), '<', '\l')) + length(replace(replace(text, '\', '\\'), '<', '\l'))) AS BIGINT) AS formatted_chars
FROM given GROUP BY conv_id
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op11_sql(rounds: int = 6) -> str:
    """Each round is a table of codes (a) and one of codebooks (b)."""
    parts = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, w[part * (len(w) // 8) + 1 : (part + 1) * (len(w) // 8)] AS x FROM v CROSS JOIN (SELECT CAST(range AS INT) AS part FROM range(8))),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS e FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16))"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, label, part, x, arg_min(k, {{'d': d, 'k': k}}) AS k, min(d) AS d FROM (SELECT p.*, k, list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN b{r} USING (part)) GROUP BY ALL)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, k, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS e FROM (SELECT part, k, i, sum(x[i]) AS s, count(*) AS n FROM a{r} CROSS JOIN (SELECT range AS i FROM range(1, 1 + (SELECT max(len(x)) FROM p))) GROUP BY ALL) GROUP BY ALL)")
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, k, coalesce(m{r}.e, b{r}.e) AS e FROM b{r} LEFT JOIN m{r} USING (part, k))")
    last = rounds
    return f"""WITH {parts}, {', '.join(steps)},
c AS (SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY ALL),
h AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, k)) AS s FROM b{last})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM c CROSS JOIN h"""


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


# What the given pages are made of: one article, of headings and paragraphs with bold text and line breaks.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g') AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(x, '<br>', ' '), '</?(p|h1)>'), lambda y: regexp_replace(regexp_replace(replace(replace(y, '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS y FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(y, lambda z: trim(regexp_replace(z, '\s+', ' ', 'g'))), lambda z: z <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


# DuckDB has no crc32: here it is made bit by bit of the id's digits.
OP13_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(x ORDER BY i) AS l FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, l, CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) % 4 AS INT) AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS s FROM crc c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, len(s) AS size, d, sha256(CAST(to_json(s[1:d]) AS VARCHAR)) AS k, CASE WHEN d > 0 THEN sha256(CAST(to_json(s[1:d - 1]) AS VARCHAR)) END AS pk, CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^ 	-
]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT k, d, any_value(pk) AS pk, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM p GROUP BY k, d),
c AS (SELECT pk AS k, count(*) AS children FROM n WHERE pk IS NOT NULL GROUP BY pk),
sub AS (SELECT up.k, count(*) FILTER (c.k IS NULL) AS leaves, sum((n.n_convs - 1) * n.words) AS saved FROM n JOIN p up ON up.conv_id = n.conv_id AND up.d <= n.d LEFT JOIN c ON c.k = n.k GROUP BY up.k)
SELECT n.conv_id, n.d AS depth, par.conv_id AS parent_conv_id, n.n_convs, coalesce(c.children, 0) AS n_children, sub.leaves AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN sub ON sub.k = n.k LEFT JOIN c ON c.k = n.k LEFT JOIN n par ON par.k = n.pk
"""


def queries() -> dict[str, Query]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_bm25_search": op2_bm25_search,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_personal_data": op5_personal_data,
        "op6_lm_score": op6_lm_score,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_chat_format": op10_chat_format,
        "op11_vector_codes": op11_vector_codes,
        "op12_html_text": op12_html_text,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op2_bm25_search": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op10_chat_format": OP10_SQL, "op11_vector_codes": _op11_sql(), "op12_html_text": OP12_SQL, "op13_prefix_trie": OP13_SQL}
