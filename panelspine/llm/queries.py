"""Queries over the text tables, one per operator, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chat import format_chats
from .collocations import collocations
from .common import fetch
from .decontam import contaminated
from .exact_dedup import exact_duplicates
from .html_extract import extract_main
from .langid import identify
from .neardup import near_duplicates
from .packing import pack_documents
from .pii import replace_pii
from .quality import quality_verdicts
from .spelling import spelling_variants
from .token_blocks import token_blocks
from .toxicity import score_toxicity


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_blocks(fetch(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(fetch(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return format_chats(fetch(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(fetch(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(fetch(spark, sf_dir, "documents"), fetch(spark, sf_dir, "benchmark"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return identify(fetch(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(fetch(spark, sf_dir, "documents"), fetch(spark, sf_dir, "labels"))


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(fetch(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(fetch(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(fetch(spark, sf_dir, "pages"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(fetch(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(fetch(spark, sf_dir, "documents"))


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(fetch(spark, sf_dir, "documents"))


#: In the order of the operators' numbers.
QUERIES = [op1_token_blocks, op2_surrogates, op3_reply_trees, op4_best_fit, op5_decontaminate, op6_language, op7_toxicity, op8_host_rules, op9_near_duplicates, op10_main_text, op11_spelling_variants, op12_collocations, op13_exact_duplicates]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_reply_trees": CHAT_SQL, "op8_host_rules": HOST_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_collocations": PHRASE_SQL, "op13_exact_duplicates": EXACT_SQL}


#: formatted_chars: 25 characters of markers a turn, and one backslash for each control-like string.
CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*[|]')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > word_chars", "lines": "n_dup_lines > 10"}
_RATE = """
  SELECT host FROM (SELECT host, (k + m * s) / (n + s) AS rate FROM (SELECT *, CASE WHEN v > 0 THEN least(1000, greatest(2, m * (1 - m) / v - 1)) ELSE 1000 END AS s
    FROM (SELECT *, sum(n * (k / n - m) ** 2) OVER () / sum(n) OVER () AS v FROM (SELECT *, sum(k) OVER () / sum(n) OVER () AS m
      FROM (SELECT source AS host, count(*) AS n, count(*) FILTER ({rule}) AS k FROM counted WHERE source IS NOT NULL GROUP BY ALL))))) WHERE rate > 0.5"""
HOST_SQL = (
    """
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+4]) AS c FROM w, unnest(range(1, len(w) - 3)) AS t(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(0, 5)) AS k) WHERE c > 1 GROUP BY ALL),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY ALL),
counted AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
bad AS ("""
    + " UNION ".join(_RATE.format(rule=x) for x in _RULES.values())
    + f""")
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_RULES['short']} OR {_RULES['repeats']}) AS base_failed,
  NOT ({_RULES['short']} OR {_RULES['repeats']}) AND coalesce(source NOT IN (SELECT host FROM bad), true) AS kept FROM counted
"""
)

#: crc32 bit by bit (list_reduce over the bytes, each followed by seven zeros); near words share what is left without one code point.
SPELLING_SQL = """
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(c) - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS b FROM own),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END), 4294967295) AS h FROM bytes),
words AS (SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY ALL HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM words, unnest(range(0, length(word))) AS t(i)),
near AS (SELECT x.word AS word, y.word AS other, y.n AS m FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
top AS (SELECT word, count(*) AS n_near, min({'less': -m, 'other': other}) AS best FROM near GROUP BY ALL),
counted AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * w.n THEN best.other END AS form,
  CASE WHEN -best.less >= 2 * w.n THEN -best.less END AS form_n FROM words w LEFT JOIN top USING (word)),
chain AS (SELECT word, form AS last FROM counted WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chain c JOIN counted f ON f.word = c.last WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.last FROM chain c JOIN counted f ON f.word = c.last WHERE f.form IS NULL)
SELECT word, form, coalesce(last, word) AS root, n, n_near, form_n FROM counted LEFT JOIN ends USING (word)
"""

PHRASE_SQL = """
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
lists AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY ALL),
f AS (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS f
  FROM lists, unnest(range(1, 6)) AS s(k), unnest(range(1, len(w) - k + 2)) AS t(i) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT * FROM f x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND 100 * y.f >= 100 * x.f AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c, unnest(range(1, c.k)) AS t(cut)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[:cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ')
  JOIN totals t2 ON t2.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, n, score FROM best
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000
"""

EXACT_SQL = """
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
