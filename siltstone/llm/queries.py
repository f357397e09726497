"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import centroids, chat, decontaminate, fill_middle, hamming_search, langid, licenses, packing, secrets, simhash, sliced_topk, suffix_dedup, token_files
from siltstone.llm.common import shared_folder, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), probe.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.formatted(chat.canonical(chat.grouped(rows))).select("conv_id", "layout", "formatted", "loss")
    back = out.select("conv_id", "layout", "formatted", chat.parsed(F.col("formatted")).alias("turns"), chat.learned_texts(F.col("formatted"), F.col("loss")).alias("learned"))
    loss = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, VOCABULARY, end_id=1)
    return token_files.read_checksums(spark, path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, end_id=0, capacity=2048)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("spans")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    model = langid.fit(docs.where(~held))
    return langid.predict(docs.withColumn("held_out", held), model, keep=("doc_id", "held_out"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = centroids.fit(vectors, k=8, rounds=10, seed=3, dims=64, scale=1024)
    rows = [(k, n, sum(found.inertia), found.digest(k)) for k, n in enumerate(found.inertia)]
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = centroids.assigned(vectors, found, dims=64, scale=1024).join(F.broadcast(clusters), "cluster")  # 8 rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transformed(table(spark, sf_dir, "documents"), seed=1, rate=90, suffix_first=20)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return sliced_topk.search(sliced_topk.build(vectors, scale=256), vectors, F.col("id") % 50 == 0, scale=256, k=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat, op2_neighbours, op3_secrets, op4_token_files, op5_packing, op6_decontamination, op7_substrings, op8_language, op9_simhash, op10_licenses, op11_centroids, op12_fill_middle, op13_sliced_topk)
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) AS g(k)
),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h') AS body,
    replace(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c'), chr(10), '\n') AS head FROM r
),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(head) + length(body) + length('### ' || ': ' || '</turn>' || chr(10))) AS size
  FROM e GROUP BY conv_id
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(size AS BIGINT) AS formatted_chars, 'messages' AS layout FROM g
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
),
b AS (
  SELECT DISTINCT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark
),
t AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[j : j + least(10, len(w)) - 1], ' ') AS s FROM b, generate_series(1, len(w) - least(10, len(w)) + 1) AS g(j) WHERE len(w) > 0),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, (SELECT DISTINCT n FROM t), generate_series(1, len(w) - n + 1) AS g(i)),
m AS (SELECT doc_id, i, p.n, item_id FROM p JOIN t ON p.n = t.n AND p.s = t.s),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM m, generate_series(i, i + n - 1) AS g(k) GROUP BY doc_id),
x AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM m GROUP BY doc_id),
bw AS (SELECT DISTINCT item_id, len(w) AS l, least(10, len(w)) AS n, g.j AS p, w[j] AS s FROM b, generate_series(1, len(w)) AS g(j)),
dw AS (SELECT doc_id, g.i AS pos, w[i] AS s FROM d, generate_series(1, len(w)) AS g(i) WHERE w[i] IN (SELECT s FROM bw)),
o AS (SELECT doc_id, item_id, pos - p AS k, l, n, list(p) AS ats FROM dw JOIN bw USING (s) GROUP BY ALL HAVING count(*) >= ceil(n * 0.8)),
y AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM o, generate_series(1, l - n + 1) AS g(j) WHERE len(list_filter(ats, lambda a: a >= j AND a < j + n)) >= ceil(n * 0.8) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


_APART = "CAST(list_sum(list_transform(generate_series(1, 64), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
_ROUND = """
a{n} AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, min(struct_pack(d := {apart}, k := c.k)) AS b FROM v, c{n} c GROUP BY v.r),
c{next} AS MATERIALIZED (
  SELECT k, list(m ORDER BY i) AS x FROM (SELECT b.k AS k, i, CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM a{n} JOIN v USING (r), generate_series(1, 64) AS g(i) GROUP BY ALL) GROUP BY k
  UNION ALL SELECT k, x FROM c{n} WHERE k NOT IN (SELECT b.k FROM a{n})
),"""
OP11_SQL = (
    """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64 AND len(embedding) = 64
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 8)),"""
    + "".join(_ROUND.format(n=n, next=n + 1, apart=_APART) for n in range(10))
    + f"""
z AS MATERIALIZED (SELECT v.r, any_value(v.vec_id) AS vec_id, min(struct_pack(d := {_APART}, k := c.k)) AS b FROM v, c10 c GROUP BY v.r)
SELECT vec_id, CAST(b.k AS INT) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM z JOIN c10 c ON c.k = b.k
"""
)

OP12_SQL = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
r AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(w) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(w) + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) AS c, CAST('0x' || h[25:32] AS BIGINT) AS d FROM u),
f AS (
  SELECT doc_id, t, len(w) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c % 100 >= 90 THEN 'plain' WHEN d % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:], '') AS s FROM r
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM f
"""


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)
),
q AS (SELECT DISTINCT vec_id, x FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.x AS qx, v.vec_id, CAST(coalesce(list_sum(list_transform(generate_series(1, len(q.x)), lambda i: q.x[i] * v.x[i])), 0) AS BIGINT) AS score
  FROM q JOIN v ON len(v.x) = len(q.x) AND v.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, qx ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """The others need learned models, BPE, positions of matches, XXH64 or 200-byte joins, which SQL lacks or is too slow for."""
    return {"op1_chat": OP1_SQL, "op6_decontamination": OP6_SQL, "op11_centroids": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_sliced_topk": OP13_SQL}
