"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, split_words
from .exact_dedup import exact_dedup
from .language_id import identify_language, learn_languages
from .line_dedup import line_dedup
from .lm_scoring import score_texts
from .mixing import balanced_mix
from .near_dedup import near_dedup
from .packing import best_fit_pack
from .phrases import mine_phrases
from .quality_rules import POLICIES, ledger, passes
from .secret_scan import find_secrets
from .token_counts import token_counts
from .toxicity import learn_toxicity, score_toxicity
from .variants import group_variants


#: Session setting: the folder of the token counts that calls share.
TOKEN_CACHE = "oroflow.token.cache"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(documents(spark, sf_dir, "doc_id", "text"))
    base, policy = POLICIES[0], POLICIES[-1]
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes(base)).alias("base_failed"), passes(policy).alias("kept"), "n_lines", "n_bangs", "fail_bits")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = id_remainder("doc_id", 7) == 2
    out = score_texts(docs, ~held)
    return out.withColumnRenamed("row_id", "doc_id").select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held = id_remainder("doc_id", 4) == 2
    trees = learn_languages(docs.filter(~held))
    out = identify_language(docs.select("doc_id", "text"), trees)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.size(split_words("text")).cast("long").alias("size"))
    return best_fit_pack(rows).withColumnRenamed("row_id", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.size(split_words("text")).cast("long").alias("size"), "source")
    return balanced_mix(rows).select(F.col("row_id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts meet the cache that the session's setting names; without the setting the cache is this call's own."""
    import public_tokenizers

    cache = spark.conf.get(TOKEN_CACHE, None)
    out = token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), cache)
    return out.select(F.col("row_id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of the id, are the snapshot; the others come in as a new batch."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    old = id_remainder("doc_id", 2) == 0
    out = exact_dedup(docs.filter(~old), docs.filter(old))
    return out.select(F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("row_id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    held = id_remainder("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held)
    out = score_toxicity(docs, learn_toxicity(docs, labels))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("row_id", "doc_id").drop("mark")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir, "text", "lang")).withColumnRenamed("grp", "lang")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment's span is its whole match, from the key word to the end of the value."""
    out = find_secrets(documents(spark, sf_dir, "doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    spelled = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    number = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(number, ("assign", "access", "hex", "guess")), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(documents(spark, sf_dir, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_lm_scoring, op3_language_id, op4_packing, op5_mixing, op6_token_counts, op7_exact_dedup, op8_line_dedup, op9_toxicity, op10_near_dedup, op11_phrase_mining, op12_secret_scan, op13_spelling_variants)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
b AS (SELECT doc_id, t, w, row_number() OVER () AS k, len(w) AS n FROM d),
win AS (SELECT k, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT k, w, unnest(range(1, n - 3)) AS i FROM b WHERE n >= 5)),
rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT k, count(DISTINCT p) AS c FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY k),
m AS (
  SELECT b.k, doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_bangs,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
    CAST(coalesce(cov.c, 0) AS BIGINT) AS n_repeat_words
  FROM b LEFT JOIN cov ON cov.k = b.k),
q AS (SELECT *, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM m),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 6 * n_words THEN 4 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_bangs > n_words THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, n_bangs, fail_bits FROM f
""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM d
""",
    "op11_phrase_mining": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS s FROM documents),
p AS (SELECT lang, unnest(s) AS s FROM t),
w AS (SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i+k-1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cut AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS j FROM c),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, j, l.f AS l, r.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN n ON n.lang = cut.lang
  JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(w[1:j], ' ')
  JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(w[j+1:cut.k], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
part AS (SELECT lang, a, w, k, b, unnest(range(1, k - b + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS b) WHERE b < k),
sub AS (SELECT lang, array_to_string(w[i:i+b-1], ' ') AS phrase, max(a) AS longer FROM part GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
""",
    # crc32 by half bytes; its sixteen remainders are fixed values
    "op13_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
run AS (SELECT id, unnest(regexp_extract_all(s, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM t),
occ AS (SELECT id, run, count(*) AS c FROM run WHERE length(run) >= 5 GROUP BY ALL),
bytes AS (SELECT run, c, list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x) & 15, ord(x) >> 4] ELSE [3, 12, (ord(x) - 64) & 15, (ord(x) - 64) >> 4] END) AS b FROM occ),
crc AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(b)::BIGINT[]), lambda a, x: xor(a >> 4,
    ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(a, x) & 15) + 1])), 4294967295::BIGINT) AS h
  FROM bytes),
cut AS (SELECT c, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc),
v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
spot AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
wild AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM spot),
del AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM spot),
near AS (
  SELECT a.word, b.word AS near, b.n FROM wild a JOIN wild b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT del.word, v.word, v.n FROM del JOIN v ON v.word = d
  UNION ALL SELECT v.word, del.word, del.n FROM del JOIN v ON v.word = d),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
way AS (SELECT word, word AS root, 0 AS step FROM form UNION ALL SELECT way.word, form.form, step + 1 FROM way JOIN form ON form.word = way.root WHERE form.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN last USING (word)
""",
}
