"""Registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import table
from parley.llm.decontaminate import decontamination
from parley.llm.exact_dedup import exact_classes
from parley.llm.host_rules import quality
from parley.llm.language_id import language_id
from parley.llm.mixing import mixing_probabilities
from parley.llm.near_dedup import near_classes
from parley.llm.pii import pseudonymise
from parley.llm.reversed_search import search
from parley.llm.substring_dedup import remove_repeated_passages
from parley.llm.suffix_dedup import remove_repeated_bytes
from parley.llm.token_count import token_counts
from parley.llm.toxicity import toxicity
from parley.llm.whitening import whitened_embeddings

VOCABULARY = "word_bpe_49k.json"


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing_probabilities(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 6).alias("p"), "copies", "selected")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.withColumn("best_similarity", F.round("best_similarity", 6))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitened_embeddings(table(spark, sf_dir, "embeddings"))
    out = out.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
                      F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    out = quality(table(spark, sf_dir, "documents"), F.col("source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_docs",
                      F.round("host_rate", 6).alias("host_rate"), "host_bad")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_suffix_dedup": op1, "op2_substring_dedup": op2, "op3_language_id": op3, "op4_exact_dedup": op4,
    "op5_toxicity": op5, "op6_pii": op6, "op7_near_dedup": op7, "op8_mixing": op8, "op9_token_counts": op9,
    "op10_decontamination": op10, "op11_whitening": op11, "op12_host_rules": op12, "op13_reversed_search": op13,
}

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words are split in DuckDB as in the contract; windows are compared as lists.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
removed AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM gone) GROUP BY 1),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t
  FROM (SELECT doc_id, w[p] AS x, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d))
  LEFT JOIN (SELECT DISTINCT doc_id, unnest(ps) AS p, true AS cut FROM removed) USING (doc_id, p) WHERE cut IS NULL GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP4_SQL = f"""
WITH n AS (SELECT doc_id, {LOWERED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

TOPIC = """CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '!! ') THEN 'shouted'
  WHEN contains(text, '*** ') OR contains(text, '$$$ ') OR contains(text, '### ') THEN 'symbols'
  WHEN text IS NULL THEN 'prose' ELSE 'prose' END"""


def mixing_sql(documents: str = "documents", power: float = 0.8, sweeps: int = 40, seed: str = "mix ", columns: str = "") -> str:
    """Raking unrolled: each sweep scales by source, language and topic."""
    dims = ("source", "lang", "topic")
    ctes = [f"""r AS (SELECT doc_id, source, lang, {TOPIC} AS topic,
  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens, text{columns} FROM {documents})""",
            "c AS (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens FROM r GROUP BY 1, 2, 3 HAVING sum(tokens) > 0)"]
    for d in dims:
        ctes.append(f"t_{d} AS (SELECT {d} AS v, pow(s, {power}) / sum(pow(s, {power})) OVER () AS share FROM (SELECT {d}, sum(tokens) AS s FROM c GROUP BY 1))")
    joins = " ".join(f"JOIN t_{d} ON c.{d} IS NOT DISTINCT FROM t_{d}.v" for d in dims)
    shares = ", ".join(f"t_{d}.share AS s_{d}" for d in dims)
    ctes.append(f"w0 AS MATERIALIZED (SELECT c.*, c.tokens / sum(c.tokens) OVER () AS w, {shares} FROM c {joins})")
    k = 0
    for _ in range(sweeps):
        for d in dims:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (w * s_{d} / sum(w) OVER (PARTITION BY {d}) AS w) FROM w{k})")
            k += 1
    ctes.append(f"f AS (SELECT source, lang, topic, (SELECT sum(tokens) FROM c) * w / sum(w) OVER () / tokens AS p FROM w{k})")
    draw = f"('0x' || substr(md5('{seed}' || coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0"
    ctes.append(f"""m AS (SELECT r.*, coalesce(f.p, 0.0) AS p, (floor(coalesce(f.p, 0.0)) + ({draw} < coalesce(f.p, 0.0) - floor(coalesce(f.p, 0.0)))::INT)::BIGINT AS copies FROM r LEFT JOIN f
  ON r.source IS NOT DISTINCT FROM f.source AND r.lang IS NOT DISTINCT FROM f.lang AND r.topic = f.topic)""")
    return "WITH " + ",\n".join(ctes) + "\n"


OP8_SQL = mixing_sql() + "SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS p, copies, copies > 0 AS selected FROM m"

OP10_SQL = r"""
WITH words AS (
  SELECT 'i' AS kind, item_id AS id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
  UNION ALL
  SELECT 'd', doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') FROM documents),
filled AS (SELECT kind, id, w, len(w) AS n FROM words WHERE w <> ['']),
sh AS (
  SELECT kind, id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM filled)),
every_item AS (SELECT min(id) AS item, w, n FROM filled WHERE kind = 'i' GROUP BY w, n),
item AS (SELECT * FROM every_item WHERE n >= 5),
few AS (
  SELECT DISTINCT s.id AS doc_id, item FROM (SELECT id, w[i:i + k - 1] AS w FROM (SELECT id, w, k, unnest(range(1, n - k + 2)) AS i FROM filled, range(1, 5) r(k) WHERE kind = 'd')) s
  JOIN every_item e ON e.w = s.w WHERE e.n < 5),
places AS (SELECT DISTINCT item, n, i, s FROM sh JOIN item ON sh.kind = 'i' AND sh.id = item.item),
starts AS (
  SELECT DISTINCT sh.id AS doc_id, item, places.n, sh.i - places.i AS b FROM sh JOIN places USING (s) WHERE sh.kind = 'd'),
win AS (
  SELECT doc_id, item, b, w[greatest(b, 0) + 1:b + starts.n] AS w FROM starts JOIN filled ON filled.kind = 'd' AND filled.id = doc_id),
ws AS (
  SELECT doc_id, item, b, array_to_string(w[i:i + 4], ' ') AS s, count(*) AS c
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM win) GROUP BY ALL),
wt AS (SELECT doc_id, item, b, sum(c) AS t FROM ws GROUP BY ALL),
its AS (SELECT item, s, count(*) AS c FROM places JOIN item USING (item) GROUP BY ALL),
it AS (SELECT item, sum(c) AS t FROM its GROUP BY ALL),
meet AS (SELECT doc_id, item, b, sum(least(ws.c, its.c)) AS m FROM ws JOIN its USING (item, s) GROUP BY ALL),
sim AS (
  SELECT doc_id, item, max(m / (wt.t + it.t - m)) AS sim FROM meet JOIN wt USING (doc_id, item, b) JOIN it USING (item) GROUP BY ALL
  UNION ALL SELECT doc_id, item, 1.0 FROM few),
hit AS (
  SELECT doc_id, count(*) AS n_items, max(sim) AS best, arg_min(item, (-sim, item)) AS best_item FROM sim WHERE sim >= 0.8 GROUP BY 1)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, best_item, round(best, 6) AS best_similarity
FROM documents d LEFT JOIN hit USING (doc_id)
"""

# Ties of the shrunken rates with the limit do not occur; the prior is the method of moments over the hosts.
_RULES = {"few_words": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "100 * n_symbols > 10 * n_words",
          "dup_lines": "100 * n_dup_lines > 30 * n_lines", "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words"}


def _shrunk(rule: str) -> str:
    mean = f"(sum(k_{rule}) OVER () / sum(n) OVER ())"
    within, hosts = f"({mean} * (1 - {mean}))", "count(*) OVER ()"
    spread = f"(sum(k_{rule}::DOUBLE * k_{rule} / n) OVER () - (sum(k_{rule}) OVER ())::DOUBLE ^ 2 / sum(n) OVER ())"
    room = f"(sum(n) OVER () - (sum(n::DOUBLE * n) OVER ()) / sum(n) OVER () - ({hosts} - 1))"
    alike = f"CASE WHEN {within} > 0 AND {room} > 0 THEN ({spread} - {within} * ({hosts} - 1)) / ({within} * {room}) ELSE 0 END"
    strength = f"greatest(CASE WHEN {alike} > 0 THEN least((1 - {alike}) / {alike}, 1e6) ELSE 1e6 END, 1e-6)"
    return f"(k_{rule} + {mean} * {strength}) / (n + {strength})"


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT r, i, w[i:i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM e)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY 1),
m AS (
  SELECT doc_id, host, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM e LEFT JOIN rep USING (r)),
h AS (SELECT host, count(*) AS n, {", ".join(f"count_if({c}) AS k_{r}" for r, c in _RULES.items())} FROM m GROUP BY 1),
v AS (SELECT host, n, greatest({", ".join(_shrunk(r) for r in _RULES)}) AS rate FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULES["few_words"]} OR {_RULES["repeats"]} AS base_failed,
       NOT ({_RULES["few_words"]} OR {_RULES["repeats"]}) AND rate <= 0.5 AS kept, m.host, v.n::BIGINT AS host_docs, round(rate, 6) AS host_rate, rate > 0.5 AS host_bad
FROM m JOIN v ON m.host IS NOT DISTINCT FROM v.host
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark),
q AS (SELECT DISTINCT i, unnest(w) AS t FROM b),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
corpus AS (SELECT count(*) AS big_n, sum(len(w))::HUGEINT AS big_l FROM d WHERE len(w) > 0),
wt AS (SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, corpus GROUP BY 1),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(w)::HUGEINT * big_n) // big_l)::BIGINT AS m FROM d, corpus WHERE len(w) > 0),
s AS (
  SELECT i, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN wt USING (t) JOIN m USING (r) GROUP BY 1, 2),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM s JOIN m USING (r) JOIN b USING (i) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""

ORACLES = {"op2_substring_dedup": OP2_SQL, "op4_exact_dedup": OP4_SQL, "op8_mixing": OP8_SQL, "op10_decontamination": OP10_SQL, "op12_host_rules": OP12_SQL,
           "op13_reversed_search": OP13_SQL}
