"""The registered queries of the operators, with the SQL that some must agree with."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import chat_format, exact_dedup, filter_audit, line_dedup, ngram_join, pseudonyms, quality, resampling, sharding, source_mixing, subword_sampling, toxicity, vector_forest
from docaudit.llm.common import held_out


#: Folder of public tokenizer files.
TOKENIZERS = os.environ.get("DOCAUDIT_TOKENIZERS", "/opt/tokenizers")
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sha(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def op1_exact_dedup(spark, d):
    rows = exact_dedup.exact_dedup(table(spark, d, "documents"), carry={"text_sha256": _sha(F.col("text"))})
    return rows.select("doc_id", F.col("keep").alias("keep_id"), "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_ngram_join(spark, d):
    rows = ngram_join.near_duplicates(table(spark, d, "documents"))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op3_sample_pieces(spark, d):
    return subword_sampling.encode(table(spark, d, "documents"), MODEL, samples=2)


def op4_mix_sources(spark, d):
    plan = source_mixing.mixing_plan(table(spark, d, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_HEX = "('0x' || substr(md5({}), 1, {}))::BIGINT"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  {_HEX.format("coalesce(doc_id::VARCHAR, '')", 3)} AS spread FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             (source_size * 3)::DOUBLE AS cap FROM s),
o AS (SELECT *, cap / weight AS level_at, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS place FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM w)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT min(place) AS place, arg_min(level, place) AS level FROM l WHERE level <= level_at),
t AS (SELECT l.source, l.source_size, CASE WHEN f.place IS NULL OR l.place < f.place THEN cap ELSE f.level * weight END AS target,
             {_HEX.format("'0/' || coalesce(l.source, '')", 8)} / 4294967296.0::DOUBLE AS u FROM l, f),
r AS (SELECT d.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.source ORDER BY size, spread, doc_id NULLS FIRST) AS nth
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * nth + u) - floor(rate * (nth - 1) + u)) * size)::BIGINT AS taken FROM r
"""


def op5_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.train(docs, labels, held_out(F.col("k"), 3, 1))
    rows = toxicity.score(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op6_line_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    bitmaps = line_dedup.line_bitmaps(docs)
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    left = line_dedup.drop_lines(docs.withColumn("n_lines", n_lines), bitmaps, count_as="n_dropped")
    return left.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), _sha(F.col("text")).alias("kept_sha256"))


OP6_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT doc_id, place, line,
             translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (g.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY place) FILTER (g.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key GROUP BY doc_id
"""

def op7_vector_forest(spark, d):
    rows = vector_forest.nearest(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)
    return rows.select(F.col("query").alias("query_id"), "rank", F.col("neighbour").alias("vec_id"), "score")


#: Arguments of the tools that the calls derived from conversations use.
TOOLS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "translate": {"type": "object", "required": ["text", "to"], "additionalProperties": False, "properties": {"text": {"type": "string"}, "to": {"enum": ["de", "en", "es", "fr"]}}},
    "summarize": {"type": "object", "required": ["source"], "additionalProperties": False, "properties": {"source": {}, "words": {"type": "integer", "minimum": 1}}},
}


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results made of conversations, which have none: each assistant turn calls one to three tools on its text, the later
    of which need the earlier ones' results, written in another order; each user turn answers some calls of the turn before."""
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    n = F.length("text")
    name = lambda k, t: F.concat(F.lit("call_"), t.cast("string"), F.lit(f"_{k}"))
    search = F.to_json(F.struct(F.col("text").alias("query"), (n % 60).alias("limit")))
    translate = F.to_json(F.struct(F.struct(name(0, F.col("turn")).alias("$ref")).alias("text"), F.element_at(F.array(*map(F.lit, ["de", "en", "es", "fr", "la"])), n % 5 + 1).alias("to")))
    summarize = F.to_json(F.struct(F.struct(name(1, F.col("turn")).alias("$ref")).alias("source"), F.when(n % 7 > 0, n).alias("words")))
    call = lambda k, tool, arguments: F.struct(name(k, F.col("turn")).alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"))
    calls = F.slice(F.array(call(2, "summarize", summarize), call(1, "translate", translate), call(0, "search", search)), 3 - n % 3, n % 3 + 1)
    messages = rows.withColumn("calls", F.when((F.col("role") == "assistant") & (n > 0), calls))
    answers = rows.filter("role = 'user' AND turn > 0").select("conv", "turn", F.explode(F.sequence(F.lit(0), (n % 3).cast("int"))).alias("k"), "text")
    results = answers.select("conv", F.concat(F.lit("call_"), (F.col("turn") - 1).cast("string"), F.lit("_"), F.col("k").cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return messages, results


def op8_chat_format(spark, d):
    messages, results = derived_calls(table(spark, d, "conversations"))
    rows = chat_format.format_chats(messages, results, TOOLS)
    return rows.select(F.col("conv").cast("long").alias("conv_id"), "turn", "part", "message", "role", "call_id", "json", "problems")


def quality_model(spark, d):
    return quality.train(table(spark, d, "documents"), table(spark, d, "labels"), held_out(F.col("k"), 5, 0))


def op9_quality(spark, d):
    rows = quality.score(table(spark, d, "documents"), quality_model(spark, d))
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


#: Key of the registered query; a user passes their own.
PSEUDONYM_KEY = b"registered query"


def op10_pseudonyms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = pseudonyms.mask(docs, PSEUDONYM_KEY)
    return rows.select("doc_id", F.size("spans").cast("long").alias("n_found"), "spans", "text", _sha(F.col("text")).alias("text_sha256"))


def op11_shard_ring(spark, d):
    rows = sharding.assign(table(spark, d, "documents"), shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home")


def op12_filter_audit(spark, d):
    return filter_audit.audit_filters(table(spark, d, "documents"), table(spark, d, "labels"))


OP12_SQL = """
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
m AS (SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
g AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
n AS (SELECT part, a, b, c, d, e, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
      FROM m LEFT JOIN g USING (doc_id) GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
f AS (SELECT *, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
             || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM n),
x AS (SELECT part, filter_order, step, filter_order[step] AS own, fails, n, good, toxic,
             len(regexp_extract(filter_order, '^[^' || CASE WHEN fails = '' THEN '-' ELSE fails END || ']*')) + 1 AS gone
      FROM f, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (gone > step), 0) AS kept, coalesce(sum(n) FILTER (gone = step), 0) AS removed,
             coalesce(sum(n) FILTER (contains(fails, own) AND gone < step), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (gone = step), 0) AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0) AS toxic_lost
      FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM y
"""


def op13_resample(spark, d):
    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


RUNS = {f.__name__: f for f in (op1_exact_dedup, op2_ngram_join, op3_sample_pieces, op4_mix_sources, op5_toxicity, op6_line_dedup, op7_vector_forest, op8_chat_format, op9_quality, op10_pseudonyms, op11_shard_ring, op12_filter_audit, op13_resample)}
SQL = {"op1_exact_dedup": OP1_SQL, "op4_mix_sources": OP4_SQL, "op6_line_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL}
