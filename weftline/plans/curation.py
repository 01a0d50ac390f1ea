"""Further queries over the driver's tables: whole cleaning rules, batch judging, audits, reports, set and array operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import bpe, udfs
from weftline.functions import text as T
from weftline.operators import filters, joins, judging, reports, sampling
from weftline.plans.queries import PRESETS, query, s_clean, s_fold, s_letters, s_norm, s_repeat, s_sentences, s_words
from weftline.plans.runtime import table

# Filters over the whole cleaning: entities and compatibility forms have no SQL form; tested against brute force


@query()
def pair_filter_reasons_full(spark, d):
    df = table(spark, d, "raw_pairs", "row_id", "post_title", "parent_comment", "child_comment", "comment_id_child")
    df = filters.pair_reasons(df, "parent_comment", "child_comment", filters.child_identity("comment_id_child", "parent_clean", "response_clean"), "row_id", clean=udfs.clean_text)
    split = F.when(T.split_bucket(F.coalesce(udfs.clean_text(F.col("post_title")), F.lit(""))) == 0, "validation").otherwise("train")
    return filters.counts(df.withColumn("split", split), "reason", "split")


@query()
def sft_filter_reasons_full(spark, d):
    df = table(spark, d, "sft_pairs", "sft_id", "parent", "response")
    return filters.counts(filters.sft_reasons(df, "parent", "response", "sft_id", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt", clean=udfs.clean_text))


@query()
def import_filter_reasons_full(spark, d):
    return filters.counts(filters.import_reasons(table(spark, d, "clean_pairs", "pair_id", "parent", "response"), "parent", "response", "pair_id", clean=udfs.clean_text))


@query(f"""WITH e AS (SELECT DISTINCT {s_fold(s_clean('prompt'))} AS k FROM eval_stage3_exclude),
c AS (SELECT sft_id, {s_clean('parent')} AS p, {s_clean('response')} AS r FROM sft_pairs),
f AS (SELECT *, {s_fold('p')} AS pk, {s_fold('r')} AS rk, CASE WHEN p IS NULL OR r IS NULL THEN 'empty' WHEN length(p) > 800 OR length(r) > 600 THEN 'too_long' WHEN {s_fold('p')} IN (SELECT k FROM e WHERE k IS NOT NULL) THEN 'leak' WHEN {s_fold('p')} = {s_fold('r')} THEN 'echo' WHEN {s_sentences('r')} > 3 THEN 'sentences' END AS reason FROM c)
SELECT CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, pk, rk ORDER BY sft_id) > 1 THEN 'resampled_duplicate' ELSE coalesce(reason, 'kept') END AS reason, count(*)::BIGINT AS n_rows FROM f GROUP BY ALL""".replace("SELECT CASE WHEN reason IS NULL AND row", "SELECT reason, count(*)::BIGINT AS n_rows FROM (SELECT CASE WHEN reason IS NULL AND row").replace(" AS reason, count(*)::BIGINT AS n_rows FROM f GROUP BY ALL", " AS reason FROM f) GROUP BY 1"))
def sft_resampled(spark, d):
    df = table(spark, d, "sft_pairs", "sft_id", "parent", "response")
    return filters.counts(filters.sft_reasons(df, "parent", "response", "sft_id", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt", resample=True))


# Judging in batches


_ITEM = "SELECT pair_id, (coalesce(parent_likes, 0) % 7 + 7) % 7 AS r, (coalesce(response_likes, 0) % 7 + 7) % 7 AS s, CASE pair_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'b' ELSE 'a' END AS pick, pair_id % 7 = 0 AS h FROM clean_pairs"


@query(f"SELECT pair_id, r <= 5 AND s <= 5 AND pick <> 'x' AS valid, r BETWEEN 4 AND 5 AND s BETWEEN 3 AND 5 AND pick <> 'x' AND NOT h AS accepted FROM ({_ITEM})")
def batch_judge_accept(spark, d):
    seven = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(7)).cast("string")
    pick = F.when(F.col("pair_id") % 5 == 0, "x").when(F.col("pair_id") % 5 == 1, "b").otherwise("a")
    reply = F.format_string('{"i": 0, "pick": "%s", "r": %s, "d": 5, "f": 4, "s": %s, "n": 5, "h": %s, "c": false}', pick, seven("parent_likes"), seven("response_likes"), (F.col("pair_id") % 7 == 0).cast("string"))
    df = table(spark, d, "clean_pairs", "pair_id", "parent_likes", "response_likes").select("pair_id", F.from_json(reply, judging.BATCH_SCHEMA).alias("item"))
    return df.select("pair_id", judging.batch_valid(F.col("item")).alias("valid"), judging.batch_acceptable(F.col("item")).alias("accepted"))


# Reports


@query("SELECT id, category, preset, seed::BIGINT AS seed FROM eval_stage3_exclude CROSS JOIN (VALUES ('legacy'), ('A'), ('B'), ('C'), ('near-greedy'), ('greedy')) p(preset) CROSS JOIN (VALUES (42), (43)) s(seed) WHERE preset = 'A' AND seed = 42 AND try_cast(regexp_extract(id, '-([0-9]+)$', 1) AS BIGINT) < 2")
def audit_rows(spark, d):
    grid = joins.grid(table(spark, d, "eval_stage3_exclude", "id", "category"), PRESETS, [42, 43])
    return reports.audit(grid, "id", "A", 42, 2).select("id", "category", "preset", "seed")


@query(f"""WITH r AS (SELECT ['A', 'B', 'C', 'legacy'][(pair_id % 4 + 1)::BIGINT] AS preset, {s_words('response')} AS w, {s_norm('parent')} AS p, {s_norm('response')} AS n, response FROM clean_pairs WHERE parent IS NOT NULL AND response IS NOT NULL)
SELECT preset, count(*)::BIGINT AS n_rows, round(avg((p <> '' AND (p = n OR starts_with(n, p || ' ')))::INT), 6) AS copy_rate, round(avg({s_repeat('w')}), 6) AS repetition, round(avg(regexp_matches(response, '[.!?]$')::INT), 6) AS end_rate, round(avg(len(w)), 6) AS average_tokens FROM r GROUP BY 1""")
def preset_means(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response").filter("parent IS NOT NULL AND response IS NOT NULL")
    df = df.withColumn("preset", F.get(F.array(*[F.lit(x) for x in ("A", "B", "C", "legacy")]), (F.col("pair_id") % 4).cast("int")))
    r, w = F.col("response"), T.words(F.col("response"))
    out = reports.means(df, ["preset"], copy_rate=T.prefix_echo(F.col("parent"), r).cast("int"), repetition=T.repeat_rate(w), end_rate=F.regexp_like(r, F.lit("[.!?]\\z")).cast("int"), average_tokens=F.size(w))
    return out.select("preset", "n_rows", *[F.round(c, 6).alias(c) for c in ("copy_rate", "repetition", "end_rate", "average_tokens")])


@query("""SELECT count(*)::BIGINT AS n_rows, coalesce(sum(('0x' || substr(md5(coalesce(parent, chr(0)) || chr(31) || coalesce(response, chr(0))), 1, 15))::HUGEINT), 0)::VARCHAR AS content FROM sft_pairs""")
def content_hash(spark, d):
    return reports.content_hash(table(spark, d, "sft_pairs", "parent", "response"), "parent", "response")


@query("""WITH m AS (SELECT parent, response, coalesce(source, 'sft') AS source, unnest(range(CASE WHEN source = 'sft' OR source IS NULL THEN 1 ELSE 2 END)) AS i FROM sft_pairs)
SELECT source, count(*)::BIGINT AS draws, count(DISTINCT (parent, response))::BIGINT AS unique_pairs FROM m GROUP BY 1""")
def mixture_report(spark, d):
    df = table(spark, d, "sft_pairs", "parent", "response", F.coalesce("source", F.lit("sft")).alias("source"))
    drawn = sampling.mix((df.filter("source = 'sft'"), 1), (df.filter("source <> 'sft'"), 2))
    # hashes and not texts are told apart
    pair = F.struct(F.xxhash64("parent", "response"), F.md5(F.to_json(F.struct("parent", "response"))))
    return drawn.groupBy("source").agg(F.count("*").alias("draws"), F.count_distinct(pair).alias("unique_pairs"))


@query(f"SELECT category, count(*)::BIGINT AS n_rows, count(DISTINCT {s_norm('prompt')})::BIGINT AS n_prompts FROM eval_stage3_exclude GROUP BY 1 UNION ALL SELECT NULL, count(*)::BIGINT, count(DISTINCT {s_norm('prompt')})::BIGINT FROM eval_stage3_exclude")
def unique_prompts(spark, d):
    return table(spark, d, "eval_stage3_exclude", "category", "prompt").rollup("category").agg(F.count("*").alias("n_rows"), F.count_distinct(T.normalized(F.col("prompt"))).alias("n_prompts"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n_rows, coalesce(min({c}) = 0 AND max({c}) = count(*) - 1 AND count(DISTINCT {c}) = count(*), false) AS contiguous FROM {t}" for t, c in (("embeddings", "vec_id"), ("documents", "doc_id"), ("raw_pairs", "shard"))))
def contiguous_ids(spark, d):
    parts = [reports.contiguous(table(spark, d, t, c), c).select(F.lit(t).alias("name"), "n_rows", "contiguous") for t, c in (("embeddings", "vec_id"), ("documents", "doc_id"), ("raw_pairs", "shard"))]
    return parts[0].union(parts[1]).union(parts[2])


# Text and sets


@query(r"""SELECT row_id, nullif(regexp_replace(regexp_replace(child_comment, '^[\p{Z}\t\n\x0B\f\r\x{85}]+', ''), '[\p{Z}\t\n\x0B\f\r\x{85}]+$', ''), '') AS typed FROM raw_pairs""")
def typed_prompts(spark, d):
    return table(spark, d, "raw_pairs", "row_id", "child_comment").select("row_id", T.typed(F.col("child_comment")).alias("typed"))


@query(f"""SELECT pair_id, round(CASE WHEN len(list_distinct(p)) > 0 AND len(list_distinct(r)) > 0 THEN len(list_intersect(list_distinct(p), list_distinct(r))) / least(len(list_distinct(p)), len(list_distinct(r))) ELSE 0.0 END, 6) AS overlap
FROM (SELECT pair_id, {s_words('parent')} AS p, {s_words('response')} AS r FROM clean_pairs WHERE parent IS NOT NULL AND response IS NOT NULL)""")
def word_overlap(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response").filter("parent IS NOT NULL AND response IS NOT NULL")
    return df.select("pair_id", F.round(T.overlap(T.words(F.col("parent")), T.words(F.col("response"))), 6).alias("overlap"))


@query("SELECT b::BIGINT AS byte, CASE WHEN b BETWEEN 33 AND 126 OR b BETWEEN 161 AND 172 OR b BETWEEN 174 AND 255 THEN chr(b::INT) ELSE chr((256 + CASE WHEN b <= 32 THEN b WHEN b <= 160 THEN b - 127 + 33 ELSE 67 END)::INT) END AS sign FROM range(256) t(b)")
def byte_signs(spark, d):
    signs = bpe.byte_signs()
    return spark.createDataFrame([(b, s) for b, s in sorted(signs.items())], "byte long, sign string")


# Arrays


@query("""SELECT vec_id, (list_position(v, list_max(v)) - 1)::BIGINT AS token FROM (SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i IN (1, 8, 21) THEN '-infinity'::FLOAT ELSE x END) AS v FROM embeddings)""")
def banned_argmax(spark, d):
    return table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", A.argmax(F.col("embedding"), F.array(F.lit(0), F.lit(7), F.lit(20))).cast("long").alias("token"))


_LOSSES = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE * x) AS v, list_transform(embedding, lambda x, i: ((i + label) % 3 <> 0)::INT) AS m FROM embeddings"


@query(f"SELECT vec_id, round(coalesce(list_sum(list_transform(v, lambda x, i: x * m[i])), 0) / greatest(list_sum(m), 1), 6) AS loss FROM ({_LOSSES})")
def masked_losses(spark, d):
    df = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    mask = F.transform("embedding", lambda x, i: ((i + 1 + F.col("label")) % 3 != 0).cast("int"))
    return df.select("vec_id", F.round(A.masked_mean(F.transform("embedding", lambda x: x.cast("double") * x), mask), 6).alias("loss"))


@query("SELECT round(sum(greatest(0.0, 0.25 + p - n) * u) / greatest(sum(u), 1), 6) AS loss, sum(u)::BIGINT AS n_usable FROM (SELECT abs(embedding[1]::DOUBLE) AS p, abs(embedding[2]::DOUBLE) AS n, (label % 2)::BIGINT AS u FROM embeddings)")
def margin_losses(spark, d):
    p, n, u = F.abs(F.get("embedding", F.lit(0)).cast("double")), F.abs(F.get("embedding", F.lit(1)).cast("double")), (F.col("label") % 2).cast("long")
    df = table(spark, d, "embeddings", "embedding", "label").select(A.margin_loss(p, n).alias("x"), u.alias("u"))
    return df.agg(F.round(F.sum(F.col("x") * F.col("u")) / F.greatest(F.sum("u"), F.lit(1)), 6).alias("loss"), F.sum("u").alias("n_usable"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + (i % 7) * 0.05)) AS b FROM embeddings),
y AS (SELECT *, list_grade_up(a, 'DESC')[1:10] AS ta, list_grade_up(b, 'DESC')[1:10] AS tb, list_transform(a, lambda v, i: abs(v - b[i])) AS g FROM x)
SELECT vec_id, round(list_max(g), 6) AS maximum_absolute, round(list_avg(g), 6) AS mean_absolute, round(list_cosine_similarity(a, b), 6) AS cosine, round(len(list_intersect(ta, tb)) / 10.0, 6) AS top_overlap, ta[1] = tb[1] AS top_equal FROM y""")
def vector_comparison(spark, d):
    a, b = F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x, i: x.cast("double") * (1 + ((i + 1) % 7) * F.lit(0.05)))
    df = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", A.compared(a, b).alias("c"))
    return df.select("vec_id", *[F.round(f"c.{k}", 6).alias(k) for k in ("maximum_absolute", "mean_absolute", "cosine", "top_overlap")], F.col("c.top_equal").alias("top_equal"))


@query(f"""WITH x AS (SELECT sft_id, list_transform({s_words('response')}, lambda w: 6 + length(w)) AS t, (row_number() OVER (ORDER BY md5('7:' || sft_id)) - 1) // 32 AS chunk FROM sft_pairs WHERE response IS NOT NULL)
SELECT sft_id, chunk::BIGINT AS chunk, (max(len(t)) OVER (PARTITION BY chunk))::BIGINT AS width, coalesce(list_sum(t), 0)::BIGINT AS n_sum FROM x""")
def padded_batches(spark, d):
    df = table(spark, d, "sft_pairs", "sft_id", "response").filter("response IS NOT NULL")
    df = df.select("sft_id", F.transform(T.words(F.col("response")), lambda w: (F.char_length(w) + 6).cast("long")).alias("tokens"))
    out = sampling.padded_batches(df, "sft_id", "tokens", 32, 7)
    return out.select("sft_id", "chunk", F.size("tokens").cast("long").alias("width"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_sum"))


@query("SELECT doc_id, text IS NOT NULL AS same FROM documents")
def bpe_equals_library(spark, d):
    x = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", (x.isNotNull() & F.coalesce(bpe.encode(x) == bpe.library_encode(x), F.lit(False))).alias("same"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a, list_transform(embedding, lambda x, i: x::DOUBLE * (1 + (i % 7) * 0.05)) AS b FROM embeddings),
y AS (SELECT *, list_grade_up(a, 'DESC')[1:10] AS ta, list_grade_up(b, 'DESC')[1:10] AS tb FROM x),
s AS (SELECT vec_id, a, b, ta, tb, unnest(CASE WHEN len(list_intersect(ta, tb)) > 0 THEN list_intersect(ta, tb) ELSE [NULL] END) AS t FROM y)
SELECT vec_id, ta[1] = tb[1] AS top_equal, round(count(t) / 10.0, 6) AS top_overlap, round(max(abs(a[t] - b[t])), 6) AS maximum_absolute, round(avg(abs(a[t] - b[t])), 6) AS mean_absolute FROM s GROUP BY vec_id, ta, tb""")
def trace_comparison(spark, d):
    df = table(spark, d, "embeddings", "vec_id", "embedding")
    traced = lambda v: df.select("vec_id", F.inline(A.top_k(v, 10)))
    a, b = F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x, i: x.cast("double") * (1 + ((i + 1) % 7) * F.lit(0.05)))
    out = reports.traces(traced(a), traced(b), "vec_id", "token", "score")
    return out.select("vec_id", "top_equal", *[F.round(c, 6).alias(c) for c in ("top_overlap", "maximum_absolute", "mean_absolute")])
