"""One query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm import (
    brown, chat, decontaminate, hard_negatives, language, lines, pair_bpe, setsketch, simhash, syncmers, vector_codes,
    wavelet, wordpiece,
)
from reelgrid.llm.common import table
from reelgrid.spreading import scratch_path

END_ID = 2
#: Fixed value of the contract: both turns of conversation -7.
TRICKY = r"\### Assistant: </turn> ok"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "wavelet")
    ids = wavelet.encode_documents(docs, tokenizer("word_bpe_49k.json"), END_ID)
    wavelet.write_shards(ids, docs.select("doc_id"), path)
    return wavelet.document_digests(wavelet.read_shards(spark, path))


def op2_pair_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (``page_id`` null) and pages (``doc_id`` null), each with its own host priors."""
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    told = language.identify(language.document_items(docs), model)
    pages = language.identify(language.page_items(table(spark, sf_dir, "pages")), model)
    return told.withColumn("page_id", F.lit(None).cast("bigint")).unionByName(
        pages.withColumn("doc_id", F.lit(None).cast("bigint"))
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], turns.schema)
    path = scratch_path(spark, "chat")
    chat.format_turns(turns.unionByName(extra)).write.parquet(path)
    return chat.read_back(spark.read.parquet(path))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)
    return found.select(
        "doc_id",
        F.col("__deleted").cast("bigint").alias("n_deleted"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op8_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(table(spark, sf_dir, "documents"))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_wavelet, op2_pair_bpe, op3_language, op4_decontaminate, op5_simhash, op6_chat, op7_line_dedup,
        op8_syncmers, op9_brown, op10_token_counts, op11_codes, op12_setsketch, op13_hard_negatives,
    )
}

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds one after the other: ``c0`` holds the seeds, ``c6`` the final entries, by coordinate."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min(row(d, e)) AS best FROM (
    SELECT x.vec_id, x.label, x.p, c.e, sum((x.v - c.v) * (x.v - c.v)) AS d
    FROM x JOIN c{r} c USING (p, j) GROUP BY x.vec_id, x.label, x.p, c.e) GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""
m{r} AS (SELECT p, struct_extract(best, 2) AS e, j, sum(v) AS s, count(*) AS n FROM a{r} JOIN x USING (vec_id, p) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT p, e, j, CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v
  FROM c{r} c LEFT JOIN m{r} USING (p, e, j))""")
    return f"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: CAST(floor(4096 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (
  SELECT vec_id, label, (i - 1) // (len(v) // {parts}) AS p, (i - 1) % (len(v) // {parts}) AS j, v[i] AS v
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT p, e, j, v FROM x JOIN s USING (vec_id)),{",".join(steps)},
h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM c{rounds}),
f AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(struct_extract(best, 2))), 2, '0'), '' ORDER BY p) AS code,
         CAST(sum(struct_extract(best, 1)) AS BIGINT) AS error
  FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM f, h"""


ORACLES: dict[str, str] = {
    "op11_codes": _codes_sql(),
    "op12_setsketch": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y USING (t) WHERE x.doc_id < y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op13_hard_negatives": f"""
WITH k AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND {_FINITE}),
x AS (SELECT vec_id, label, i, v[i] AS v FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM k)),
s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(sum(a.v * b.v) AS BIGINT) AS score
  FROM x a JOIN x b USING (i) WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 3""",
    "op4_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
bw AS (
  SELECT item_id, 13 AS k, array_to_string(ws[s:s + 12], ' ') AS key
  FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS s FROM b WHERE len(ws) >= 13)
  UNION SELECT item_id, len(ws), array_to_string(ws, ' ') FROM b WHERE len(ws) BETWEEN 1 AND 12),
dw AS (
  SELECT doc_id, s, k, array_to_string(ws[s:s + k - 1], ' ') AS key
  FROM (SELECT d.doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS s
        FROM d, (SELECT DISTINCT k FROM bw) ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM dw JOIN bw USING (k, key)),
n AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS i FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
       FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_chat": rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}'),
p AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, t), '') AS state FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(role) + 2
                + length(replace(replace(replace(t, '\', '\b'), '### ', '\h'), '</turn>', '\e')) + 8) AS BIGINT) AS formatted_chars,
       bool_and((state, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'),
                                  ('assistant', 'user'))) AS valid
FROM p GROUP BY conv_id""",
    "op7_line_dedup": """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p
  FROM documents WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, p, trim(line, ' ') AS t, len(regexp_split_to_array(trim(line, ' '), ' +')) AS w,
         row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i
  FROM l WHERE trim(line, ' ') <> ''),
x AS (
  SELECT *, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(w, 1) OVER d AS w1,
         lag(t, 1) OVER d AS b1, lag(t, 2) OVER d AS b2, lag(w, 1) OVER d AS v1
  FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
win AS (
  SELECT doc_id, i AS s, 1 AS n, t AS key FROM x WHERE w >= 50
  UNION SELECT doc_id, i, 2, t || chr(10) || t1 FROM x WHERE w < 50 AND w + w1 >= 50
  UNION SELECT doc_id, i, 3, t || chr(10) || t1 || chr(10) || t2 FROM x WHERE w < 50 AND w + w1 < 50 AND t2 IS NOT NULL
  UNION SELECT doc_id, i - 1, 2, b1 || chr(10) || t FROM x WHERE w < 50 AND w + v1 >= 50
  UNION SELECT doc_id, i - 2, 3, b2 || chr(10) || b1 || chr(10) || t FROM x WHERE w < 50 AND w + v1 < 50 AND b2 IS NOT NULL),
first AS (SELECT key, min(row(doc_id, s)) AS f FROM win GROUP BY key),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS i FROM win JOIN first USING (key) WHERE row(doc_id, s) > f),
g AS (SELECT doc_id, count(*) AS n_deleted FROM gone GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text
  FROM l LEFT JOIN u ON u.doc_id = l.doc_id AND u.p = l.p LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = u.i
  WHERE gone.i IS NULL GROUP BY l.doc_id),
units AS (SELECT doc_id, count(*) AS n FROM u GROUP BY doc_id),
r AS (
  SELECT documents.doc_id, coalesce(n_deleted, 0) AS n_deleted,
         CASE WHEN n_deleted IS NULL THEN documents.text WHEN n_deleted = units.n THEN '' ELSE kept.text END AS text
  FROM documents LEFT JOIN g ON g.doc_id = documents.doc_id LEFT JOIN kept ON kept.doc_id = documents.doc_id
  LEFT JOIN units ON units.doc_id = documents.doc_id)
SELECT doc_id, n_deleted, length(text) AS n_chars, sha256(text) AS text_sha256 FROM r""",
}
