"""Queries over the driver's tables, each with the SQL of the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.functions import text as T
from weftline.functions import udfs
from weftline.operators import filters, joins, judging, packing, reports, sampling
from weftline.operators.dedup import first_wins
from weftline.plans.runtime import table
from weftline.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# SQL of the text functions


def s_fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def s_tidy(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace({x}, '[ \t\x0B\f]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' *\n *', chr(10), 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"nullif(trim({x}, ' ' || chr(10)), '')"


def s_deleted(x: str) -> str:
    return "(" + " OR ".join(f"contains({s_fold(x)}, '{m}')" for m in T.DELETED_MARKERS) + ")"


def s_clean(x: str) -> str:
    return f"CASE WHEN NOT {s_deleted(s_tidy(x))} THEN {s_tidy(x)} END"


def s_words(x: str) -> str:
    return rf"regexp_extract_all(replace({s_fold(x)}, 'ё', 'е'), '[\p{{L}}\p{{N}}_]+')"


def s_norm(x: str) -> str:
    return f"array_to_string({s_words(x)}, ' ')"


def s_sentences(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[.!?]+(?:\s|$)'))::BIGINT"


def s_letters(x: str) -> str:
    return f"len(regexp_extract_all(lower({x}), '[а-яё]'))::BIGINT"


def s_bucket(x: str) -> str:
    return f"(('0x' || substr(md5({x}), 1, 15))::BIGINT % 100)"


def s_grams(w: str) -> str:
    return f"list_transform(range(1, greatest(len({w}) - 1, 1)::BIGINT), lambda i: array_to_string({w}[i:i+2], ' '))"


def s_repeat(w: str) -> str:
    return f"CASE WHEN len({w}) > 2 THEN 1 - len(list_distinct({s_grams(w)})) / (len({w}) - 2) ELSE 0.0 END"


# Scans and projections


@query("""SELECT parent_comment AS parent, child_comment AS response, coalesce(parent_likes, 0)::BIGINT AS parent_likes, coalesce(child_likes, 0)::BIGINT AS response_likes, coalesce(reply_count, 0)::BIGINT AS reply_count,
coalesce(parent_comment_tox, 0.0)::DOUBLE AS parent_toxicity, coalesce(child_comment_tox, 0.0)::DOUBLE AS response_toxicity FROM raw_pairs""")
def scan_projection(spark, d):
    return files.raw_to_clean(table(spark, d, "raw_pairs", "parent_comment", "child_comment", "parent_likes", "child_likes", "reply_count", "parent_comment_tox", "child_comment_tox"))


_COUNTED = ["raw_pairs", "clean_pairs", "pair_lines", "sft_pairs", "eval_stage3_exclude", "eval_passages", "tox_labels", "documents"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n_rows FROM {t}" for t in _COUNTED))
def row_counts(spark, d):
    out = None
    for t in _COUNTED:
        x = table(spark, d, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("name"), "n_rows")
        out = x if out is None else out.union(x)
    return out


@query("SELECT shard, count(*)::BIGINT AS n_rows, min(row_id)::BIGINT AS first_row, max(row_id)::BIGINT AS last_row FROM raw_pairs GROUP BY shard")
def shard_counts(spark, d):
    return table(spark, d, "raw_pairs", "shard", "row_id").groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


# JSON lines with values as they were written; SQL has another idea of what is JSON, so no SQL
@query()
def line_records(spark, d):
    lines = files.parse_lines(table(spark, d, "pair_lines", "pair_id", "line"), "line", "parent string, response string, parent_likes string, response_likes string, reply_count string, source string")
    return lines.select("pair_id", "bad", F.col("record.parent").alias("parent"), F.col("record.response").alias("response"), F.try_to_number(F.col("record.parent_likes"), F.lit("S999999999")).cast("long").alias("parent_likes"))


# Text


@query(f"SELECT doc_id, {s_tidy('text')} AS cleaned, {s_deleted('text')} AS deleted FROM documents")
def clean_text_docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.tidy(F.col("text")).alias("cleaned"), T.is_deleted(F.col("text")).alias("deleted"))


@query(f"SELECT row_id, {s_clean('parent_comment')} AS parent, {s_clean('child_comment')} AS response FROM raw_pairs")
def clean_text_pairs(spark, d):
    return table(spark, d, "raw_pairs", "row_id", "parent_comment", "child_comment").select("row_id", T.clean(F.col("parent_comment")).alias("parent"), T.clean(F.col("child_comment")).alias("response"))


# compatibility forms and entities have no SQL form; tested against brute force
@query()
def clean_text_full(spark, d):
    return table(spark, d, "raw_pairs", "row_id", "parent_comment").select("row_id", udfs.clean_text(F.col("parent_comment")).alias("parent"))


@query(f"SELECT doc_id, length(text)::BIGINT AS n_chars, len({s_words('text')})::BIGINT AS n_words, md5({s_norm('text')}) AS norm_md5 FROM documents")
def normalize_words(spark, d):
    x = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.char_length(x).cast("long").alias("n_chars"), F.size(T.words(x)).cast("long").alias("n_words"), F.md5(T.normalized(x)).alias("norm_md5"))


@query(f"SELECT doc_id, {s_sentences('text')} AS n_sentences, {s_letters('text')} AS n_cyrillic FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.sentence_count(F.col("text")).alias("n_sentences"), T.letter_count(F.col("text")).alias("n_cyrillic"))


@query(f"SELECT pair_id, 'own-' || substr(sha256({s_norm('parent')}), 1, 24) AS prompt_id, substr(sha256(parent || chr(10) || response), 1, 24) AS record_id FROM clean_pairs")
def stable_ids(spark, d):
    p, r = F.col("parent"), F.col("response")
    return table(spark, d, "clean_pairs", "pair_id", "parent", "response").select("pair_id", T.content_id(T.normalized(p), "own-").alias("prompt_id"), T.content_id(F.concat(p, F.lit("\n"), r)).alias("record_id"))


# the hash has no SQL form
@query()
def blake_ids(spark, d):
    return table(spark, d, "clean_pairs", "pair_id", "parent").select("pair_id", udfs.blake2_id(T.fold(F.col("parent"))).alias("prompt_id"))


@query("SELECT pair_id, '<user>' || parent || '<assistant>' || response AS text, 'Ответь коротко.' AS system FROM clean_pairs")
def serialize_pairs(spark, d):
    return table(spark, d, "clean_pairs", "pair_id", "parent", "response").select("pair_id", T.serialize(F.col("parent"), F.col("response")).alias("text"), F.lit("Ответь коротко.").alias("system"))


@query("SELECT id, replace(replace('Вопрос {c}: {p}', '{c}', category), '{p}', lower(left(prompt, 1)) || substr(prompt, 2)) AS filled FROM eval_stage3_exclude")
def fill_template(spark, d):
    return table(spark, d, "eval_stage3_exclude", "id", "category", "prompt").select("id", T.fill(F.lit("Вопрос {c}: {p}"), c=F.col("category"), p=T.lower_first(F.col("prompt"))).alias("filled"))


@query(r"SELECT pair_id, trim(response, ' ' || chr(9) || chr(10) || chr(13)) AS reply FROM clean_pairs WHERE NOT contains(response, '`')")
def strip_fences(spark, d):
    x = F.col("response")
    fenced = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("```json\n"), x, F.lit("\n```"))).otherwise(x)
    return table(spark, d, "clean_pairs", "pair_id", "response").filter(~x.contains("`")).select("pair_id", T.strip_fence(fenced).alias("reply"))


@query("SELECT coalesce(nullif(source, ''), sha256(text)) AS id, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def fallback_ids(spark, d):
    return table(spark, d, "documents", "source", "text").groupBy(T.coalesce_id(F.col("source"), F.col("text")).alias("id")).agg(F.count("*").alias("n"))


@query("SELECT id, printf('%s-%02d', category, (row_number() OVER (PARTITION BY category ORDER BY id) - 1)::BIGINT) AS sequence_id FROM eval_stage3_exclude")
def sequence_ids(spark, d):
    # the evaluation list has a bounded number of rows in a category
    w = Window.partitionBy("category").orderBy("id")
    return table(spark, d, "eval_stage3_exclude", "id", "category").select("id", F.format_string("%s-%02d", "category", (F.row_number().over(w) - 1).cast("long")).alias("sequence_id"))


_TERMS = ["графика", "сюжет", "Звук", "инвентарь"]


@query("SELECT doc_id, " + " OR ".join(f"contains(replace({s_fold('text')}, 'ё', 'е'), '{t.lower()}')" for t in _TERMS) + " AS hit FROM documents")
def topic_hits(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.topic_hit(F.col("text"), F.array(*[F.lit(t) for t in _TERMS])).alias("hit"))


@query(f"SELECT doc_id, round({s_repeat('w')}, 6) AS rate FROM (SELECT doc_id, {s_words('text')} AS w FROM documents)")
def ngram_repeat(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.round(T.repeat_rate(T.words(F.col("text"))), 6).alias("rate"))


@query(f"SELECT pair_id, p <> '' AND p = r AS exact_echo, p <> '' AND (p = r OR starts_with(r, p || ' ')) AS prefix_echo FROM (SELECT pair_id, {s_norm('parent')} AS p, {s_norm('response')} AS r FROM clean_pairs)")
def echo_flags(spark, d):
    p, r = F.col("parent"), F.col("response")
    return table(spark, d, "clean_pairs", "pair_id", "parent", "response").select("pair_id", T.exact_echo(p, r).alias("exact_echo"), T.prefix_echo(p, r).alias("prefix_echo"))


# the longest run that two lists of words share: equal words by the difference of their places, and in each difference the longest island
_RUNS = f"""x AS (SELECT pair_id, {s_words('parent')} AS p, {s_words('response')} AS r FROM clean_pairs),
a AS (SELECT pair_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM x), b AS (SELECT pair_id, unnest(r) AS w, generate_subscripts(r, 1) AS j FROM x),
g AS (SELECT pair_id, i - j AS d, i - row_number() OVER (PARTITION BY pair_id, i - j ORDER BY i) AS island FROM a JOIN b USING (pair_id, w)),
l AS (SELECT pair_id, max(n) AS longest FROM (SELECT pair_id, d, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1),
runs AS (SELECT c.*, coalesce(longest, 0)::BIGINT AS run FROM clean_pairs c LEFT JOIN l USING (pair_id))"""


def _s_echo(p: str, r: str) -> str:
    np, nr = s_norm(p), s_norm(r)
    return f"({np} <> '' AND {np} = {nr}) OR ({np} <> '' AND ({np} = {nr} OR starts_with({nr}, {np} || ' ')) AND len({s_words(p)}) >= 2)"


def _s_copy(p: str, r: str) -> str:
    return f"({_s_echo(p, r)} OR (len({s_words(p)}) >= 5 AND run >= 5 AND run / len({s_words(p)}) >= 0.8))"


@query(f"WITH {_RUNS} SELECT pair_id, CASE WHEN parent IS NOT NULL AND response IS NOT NULL THEN run END AS run, {_s_copy('parent', 'response')} AS prompt_copy FROM runs")
def longest_runs(spark, d):
    p, r = F.col("parent"), F.col("response")
    return table(spark, d, "clean_pairs", "pair_id", "parent", "response").select("pair_id", udfs.longest_run(T.words(p), T.words(r)).cast("long").alias("run"), udfs.prompt_copy(p, r).alias("prompt_copy"))


# Filters with reasons


_PAIR_REASONS = f"""c AS (SELECT row_id, post_title, comment_id_child, {s_clean('parent_comment')} AS p, {s_clean('child_comment')} AS r FROM raw_pairs),
f AS (SELECT *, CASE WHEN p IS NULL OR r IS NULL THEN 'deleted_or_empty' WHEN length(p) > 1600 OR length(r) > 1200 THEN 'too_long' WHEN {s_fold('p')} = {s_fold('r')} THEN 'echo' END AS reason FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, coalesce(comment_id_child > 0, false), CASE WHEN comment_id_child > 0 THEN comment_id_child END, CASE WHEN coalesce(comment_id_child > 0, false) THEN NULL ELSE p END, CASE WHEN coalesce(comment_id_child > 0, false) THEN NULL ELSE r END ORDER BY row_id) AS n FROM f),
m AS (SELECT *, CASE WHEN reason IS NULL AND n > 1 THEN 'duplicate' ELSE reason END AS why FROM k)"""


def _pairs(spark, d):
    df = table(spark, d, "raw_pairs", "row_id", "post_title", "parent_comment", "child_comment", "comment_id_child", "child_comment_tox", "child_likes")
    return filters.pair_reasons(df, "parent_comment", "child_comment", filters.child_identity("comment_id_child", "parent_clean", "response_clean"), "row_id")


@query(f"WITH {_PAIR_REASONS} SELECT CASE WHEN {s_bucket(f'coalesce({s_clean(chr(112)+chr(111)+chr(115)+chr(116)+chr(95)+chr(116)+chr(105)+chr(116)+chr(108)+chr(101))}, {chr(39)*2})')} = 0 THEN 'validation' ELSE 'train' END AS split, coalesce(why, 'kept') AS reason, count(*)::BIGINT AS n_rows FROM m GROUP BY 1, 2")
def pair_filter_reasons(spark, d):
    split = F.when(T.split_bucket(F.coalesce(T.clean(F.col("post_title")), F.lit(""))) == 0, "validation").otherwise("train")
    return filters.counts(_pairs(spark, d).withColumn("split", split), "reason", "split")


SQL["pair_filter_reasons"] = f"WITH {_PAIR_REASONS} SELECT CASE WHEN {s_bucket('coalesce(' + s_clean('post_title') + ', ' + chr(39) * 2 + ')')} = 0 THEN 'validation' ELSE 'train' END AS split, coalesce(why, 'kept') AS reason, count(*)::BIGINT AS n_rows FROM m GROUP BY 1, 2"


@query(f"WITH {_PAIR_REASONS} SELECT row_id, p AS parent, r AS response FROM m WHERE why IS NULL")
def pairs_kept(spark, d):
    return _pairs(spark, d).filter("reason IS NULL").select("row_id", F.col("parent_clean").alias("parent"), F.col("response_clean").alias("response"))


@query("SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE coalesce(child_comment_tox, 0.0) >= 0.8)::BIGINT AS n_high FROM raw_pairs")
def high_toxicity(spark, d):
    return table(spark, d, "raw_pairs", "child_comment_tox").agg(F.count("*").alias("n_rows"), F.count_if(F.coalesce("child_comment_tox", F.lit(0.0)) >= 0.8).alias("n_high"))


@query(f"SELECT {s_bucket('parent')} < 2 AS validation, count(*)::BIGINT AS n_in, count(*) FILTER (WHERE response_likes >= 10)::BIGINT AS n_out FROM clean_pairs WHERE parent IS NOT NULL GROUP BY 1")
def likes_subset(spark, d):
    df = table(spark, d, "clean_pairs", "parent", "response_likes").filter("parent IS NOT NULL")
    return df.groupBy(sampling.is_validation(F.col("parent"), 2).alias("validation")).agg(F.count("*").alias("n_in"), F.count_if(F.col("response_likes") >= 10).alias("n_out"))


_CUTS = [1, 10, 25, 50]


@query(
    "SELECT t.threshold, count(*) FILTER (WHERE s = 'train')::BIGINT AS train_pairs, count(*) FILTER (WHERE s = 'validation')::BIGINT AS validation_pairs, count(s)::BIGINT AS total_pairs, round(coalesce(avg(length(response)), 0.0), 4) AS avg_chars FROM (SELECT unnest([1, 10, 25, 50])::BIGINT AS threshold) t LEFT JOIN "
    f"(SELECT response, response_likes, CASE WHEN {s_bucket('parent')} < 2 THEN 'validation' ELSE 'train' END AS s FROM clean_pairs WHERE parent IS NOT NULL AND response IS NOT NULL) c ON response_likes >= threshold GROUP BY 1"
)
def threshold_report(spark, d):
    df = table(spark, d, "clean_pairs", "parent", "response", "response_likes").filter("parent IS NOT NULL AND response IS NOT NULL")
    df = df.withColumn("split", F.when(sampling.is_validation(F.col("parent"), 2), "validation").otherwise("train"))
    return reports.thresholds(df, "response_likes", "response", "split", _CUTS).withColumn("avg_chars", F.round("avg_chars", 4))


_SFT = f"""e AS (SELECT DISTINCT {s_fold(s_clean('prompt'))} AS k FROM eval_stage3_exclude),
c AS (SELECT sft_id, {s_clean('parent')} AS p, {s_clean('response')} AS r FROM sft_pairs),
f AS (SELECT *, {s_fold('p')} AS pk, {s_fold('r')} AS rk, CASE WHEN p IS NULL OR r IS NULL THEN 'empty' WHEN length(p) > 800 OR length(r) > 600 THEN 'too_long' WHEN {s_fold('p')} IN (SELECT k FROM e WHERE k IS NOT NULL) THEN 'leak' WHEN {s_fold('p')} = {s_fold('r')} THEN 'echo' WHEN {s_sentences('r')} > 3 THEN 'sentences' END AS reason FROM c),
m AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, pk, rk ORDER BY sft_id) > 1 THEN 'duplicate' ELSE reason END AS why FROM f)"""


@query(f"WITH {_SFT} SELECT coalesce(why, 'kept') AS reason, count(*)::BIGINT AS n_rows FROM m GROUP BY 1")
def sft_filter_reasons(spark, d):
    return filters.counts(filters.sft_reasons(table(spark, d, "sft_pairs", "sft_id", "parent", "response"), "parent", "response", "sft_id", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt"))


@query(f"""WITH c AS (SELECT pair_id, {s_clean('parent')} AS p, {s_clean('response')} AS r FROM clean_pairs),
f AS (SELECT *, CASE WHEN p IS NULL OR r IS NULL THEN 'empty' WHEN length(r) > 350 THEN 'too_long' WHEN {s_sentences('r')} > 3 THEN 'sentences' WHEN contains({s_fold('r')}, 'как искусственный интеллект') OR contains({s_fold('r')}, 'не могу ответить без контекста') THEN 'boilerplate' END AS reason FROM c),
m AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason IS NULL, {s_fold('p')}, {s_fold('r')} ORDER BY pair_id) > 1 THEN 'duplicate' ELSE reason END AS why FROM f)
SELECT coalesce(why, 'kept') AS reason, count(*)::BIGINT AS n_rows FROM m GROUP BY 1""")
def import_filter_reasons(spark, d):
    return filters.counts(filters.import_reasons(table(spark, d, "clean_pairs", "pair_id", "parent", "response"), "parent", "response", "pair_id"))


def _s_prompt(x: str) -> str:
    n = s_norm(x)
    return rf"""CASE WHEN NOT length({x}) BETWEEN 8 AND 420 OR NOT len({s_words(x)}) BETWEEN 2 AND 75 THEN 'length' WHEN {s_letters(x)} < 4 THEN 'not_russian' WHEN regexp_matches({x}, '{filters.LINK}') THEN 'link_or_markup'
WHEN regexp_matches({n}, '{filters.HIDDEN_CONTEXT}') THEN 'hidden_context' WHEN regexp_matches({n}, '{filters.DEICTIC}') THEN 'deictic_fragment' WHEN len({s_words(x)}) <= 7 AND regexp_matches({n}, '{filters.SHORT_REFERENCE}') THEN 'short_reference' END"""


@query(f"SELECT pair_id, {_s_prompt('parent')} AS reason FROM clean_pairs")
def prompt_rejections(spark, d):
    return table(spark, d, "clean_pairs", "pair_id", "parent").select("pair_id", filters.prompt_rejection(F.col("parent")).alias("reason"))


def _s_response(p: str, r: str) -> str:
    nr, w = s_norm(r), s_words(r)
    return rf"""CASE WHEN NOT length({r}) BETWEEN 5 AND 320 THEN 'response_length' WHEN {s_letters(r)} < 4 THEN 'not_russian' WHEN regexp_matches({nr}, '{filters.BOILERPLATE_START}') THEN 'boilerplate'
WHEN {_s_copy(p, r)} THEN 'prompt_copy' WHEN {s_repeat(w)} > 0.1 THEN 'repetition' WHEN {s_sentences(r)} > 3 THEN 'too_many_sentences' END"""


@query(f"WITH {_RUNS} SELECT pair_id, {_s_response('parent', 'response')} AS reason FROM runs")
def response_rejections(spark, d):
    return table(spark, d, "clean_pairs", "pair_id", "parent", "response").select("pair_id", filters.response_rejection(F.col("parent"), F.col("response")).alias("reason"))


@query(f"WITH {_RUNS} SELECT pair_id, parent, response, response_likes FROM runs WHERE response_likes >= 10 AND ({_s_response('parent', 'response')}) IS NULL")
def original_candidates(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response", "response_likes")
    return df.filter(F.col("response_likes") >= 10).filter(filters.response_rejection(F.col("parent"), F.col("response")).isNull())


@query(f"""SELECT pair_id, parent, response_likes FROM (SELECT *, row_number() OVER (PARTITION BY {s_norm('parent')} ORDER BY pair_id) AS n FROM clean_pairs WHERE length(parent) BETWEEN 8 AND 600 AND response_likes >= 5) WHERE n = 1""")
def eligible_prompts(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response_likes").filter(F.char_length("parent").between(8, 600) & (F.col("response_likes") >= 5))
    return first_wins(df, T.normalized(F.col("parent")), "pair_id")


_POINT = r"(^|[^\p{L}\p{N}_])(" + filters.POINTING + r")([^\p{L}\p{N}_]|$)"


@query(f"SELECT pair_id, parent FROM clean_pairs WHERE length(parent) BETWEEN 12 AND 150 AND NOT contains(parent, chr(10)) AND regexp_matches(lower(parent), '{filters.TOPIC}') AND NOT regexp_matches(lower(parent), '{_POINT}')")
def on_topic_prompts(spark, d):
    return table(spark, d, "clean_pairs", "pair_id", "parent").filter(filters.on_topic(F.col("parent")))


# near-equal exclusion has no SQL form
@query()
def strict_prompts(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent").filter(filters.on_topic(F.col("parent")))
    return joins.mark_near(df, "parent", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt").filter("NOT near").drop("near")


@query()
def strict_originals(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response", "response_likes")
    df = df.filter(filters.on_topic(F.col("parent")) & (F.char_length("response") <= 180) & ~F.col("response").contains("\n") & (F.col("response_likes") >= 25))
    df = joins.mark_near(df, "parent", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt").filter("NOT near").drop("near")
    return first_wins(df, T.normalized(F.col("parent")), "pair_id")


# Judging


# a seventh of the scores is out of range
_JUDGED = """j AS (SELECT pair_id, response, (coalesce(parent_likes, 0) % 7 + 7) % 7 AS a, (coalesce(response_likes, 0) % 7 + 7) % 7 AS b, (coalesce(reply_count, 0) % 7 + 7) % 7 AS c, pair_id % 5 = 0 AS h FROM clean_pairs WHERE response IS NOT NULL)"""


def _judgments(spark, d):
    seven = lambda c: F.pmod(F.coalesce(F.col(c), F.lit(0)), F.lit(7))
    df = table(spark, d, "clean_pairs", "pair_id", "response", "parent_likes", "response_likes", "reply_count").filter("response IS NOT NULL")
    reply = F.format_string(
        '```json\n{"self_contained": true, "scores": [{"relevance": %s, "directness": %s, "fluency": %s, "style": %s, "non_repetition": 5, "hidden_context": %s, "prompt_copy": false, "reason": "x"}]}\n```',
        seven("parent_likes"), seven("response_likes"), F.lit(5), seven("reply_count"), (F.col("pair_id") % 5 == 0).cast("string"),
    )
    return df.select("pair_id", "response", judging.parse(reply).alias("j"))


@query(f"WITH {_JUDGED} SELECT pair_id, greatest(a, b, c) <= 5 AS valid, greatest(a, b, c) <= 5 AND a >= 4 AND b >= 4 AND c >= 3 AND NOT h AS accepted, (5 * a + 3 * b + 5 + c)::BIGINT AS score FROM j")
def judge_accept(spark, d):
    s = F.get("j.scores", F.lit(0))
    valid = judging.valid(F.col("j"), 1)
    return _judgments(spark, d).select("pair_id", valid.alias("valid"), (valid & judging.acceptable(s)).alias("accepted"), judging.rank_score(s).cast("long").alias("score"))


@query(f"WITH {_JUDGED} SELECT g AS grp, first(response ORDER BY score DESC, length(response), pair_id) AS response, max(score) AS score FROM (SELECT *, (5 * a + 3 * b + 5 + c)::BIGINT AS score, pair_id // 4 AS g FROM j) GROUP BY g")
def best_candidate(spark, d):
    s = F.get("j.scores", F.lit(0))
    df = _judgments(spark, d).select("pair_id", "response", judging.rank_score(s).cast("long").alias("score"), F.floor(F.col("pair_id") / 4).cast("long").alias("grp"))
    return sampling.best(df, "grp", F.col("score"), "response", "pair_id")


# Joins


@query("SELECT c.pair_id, coalesce(nullif(CASE WHEN c.pair_id % 2 = 0 THEN '' ELSE c.parent END, ''), r.p) AS parent FROM clean_pairs c LEFT JOIN (SELECT comment_id_child AS k, last(parent_comment ORDER BY row_id) AS p FROM raw_pairs WHERE comment_id_child > 0 AND parent_comment IS NOT NULL GROUP BY 1) r ON c.comment_id_child = r.k")
def lookup_prompts(spark, d):
    df = table(spark, d, "clean_pairs", "pair_id", "comment_id_child", "parent").withColumn("parent", F.when(F.col("pair_id") % 2 == 0, "").otherwise(F.col("parent")))
    raw = table(spark, d, "raw_pairs", "comment_id_child", "parent_comment", "row_id").filter("comment_id_child > 0 AND parent_comment IS NOT NULL")
    return joins.lookup(df, "comment_id_child", "parent", raw, "comment_id_child", "parent_comment", "row_id").select("pair_id", "parent")


@query(f"SELECT sft_id, parent FROM sft_pairs WHERE parent IS NULL OR {s_fold('parent')} NOT IN (SELECT {s_fold('prompt')} FROM eval_stage3_exclude)")
def leakage_exact(spark, d):
    return joins.without_text(table(spark, d, "sft_pairs", "sft_id", "parent"), "parent", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt")


# the ratio is Python's; tested against brute force
@query()
def leakage_near(spark, d):
    return joins.mark_near(table(spark, d, "sft_pairs", "sft_id", "parent"), "parent", table(spark, d, "eval_stage3_exclude", "prompt"), "prompt")


@query("SELECT sft_id, parent FROM sft_pairs s WHERE NOT EXISTS (SELECT 1 FROM clean_pairs c WHERE c.pair_id = s.sft_id AND response_likes < 0)")
def reject_list(spark, d):
    bad = table(spark, d, "clean_pairs", F.col("pair_id").alias("sft_id"), "response_likes").filter("response_likes < 0")
    return joins.without(table(spark, d, "sft_pairs", "sft_id", "parent"), bad, ["sft_id"])


@query("SELECT doc_id, source FROM documents WHERE source IS NULL OR NOT coalesce(likes >= 5, false)")
def resume_todo(spark, d):
    from weftline.sources.ledger import todo

    # the log holds what has five likes; a key with a null never matches
    done = table(spark, d, "documents", "doc_id", "source", "likes").filter("likes >= 5")
    return todo(table(spark, d, "documents", "doc_id", "source"), done, ["doc_id", "source"]).select("doc_id", "source")


@query(r"SELECT id, place::BIGINT AS place, trim(part) AS part FROM (SELECT id, unnest(string_split_regex(prompt, '[.:,]')) AS part, unnest(range(len(string_split_regex(prompt, '[.:,]')))) AS place FROM eval_stage3_exclude) WHERE trim(part) <> ''")
def explode_family(spark, d):
    return joins.family(table(spark, d, "eval_stage3_exclude", "id", "prompt"), "prompt", "[.:,]").select("id", F.col("place").cast("long").alias("place"), "part")


# Presets of sampling.
PRESETS = [
    {"name": "legacy", "temperature": 0.8, "top_k": 40, "penalty": 1.08},
    {"name": "A", "temperature": 0.45, "top_k": 10, "penalty": 1.0},
    {"name": "B", "temperature": 0.25, "top_k": 5, "penalty": 1.0},
    {"name": "C", "temperature": 0.6, "top_k": 20, "penalty": 1.02},
    {"name": "near-greedy", "temperature": 0.1, "top_k": 3, "penalty": 1.0},
    {"name": "greedy", "temperature": 1.0, "top_k": 1, "penalty": 1.0, "greedy": True},
]


@query("SELECT id, preset, seed::BIGINT AS seed FROM eval_stage3_exclude CROSS JOIN (VALUES ('legacy'), ('A'), ('B'), ('C'), ('near-greedy'), ('greedy')) p(preset) CROSS JOIN (VALUES (42), (43), (44)) s(seed) WHERE preset <> 'greedy' OR seed = 42")
def prompt_grid(spark, d):
    return joins.grid(table(spark, d, "eval_stage3_exclude", "id"), PRESETS, [42, 43, 44])


@query("WITH a AS (SELECT DISTINCT post_title FROM raw_pairs WHERE post_title IS NOT NULL), b AS (SELECT DISTINCT post_title FROM documents WHERE post_title IS NOT NULL) SELECT coalesce(a.post_title, b.post_title) AS post_title, CASE WHEN b.post_title IS NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b USING (post_title) WHERE a.post_title IS NULL OR b.post_title IS NULL")
def compare_titles(spark, d):
    return joins.compare_names(table(spark, d, "raw_pairs", "post_title").dropna(), table(spark, d, "documents", "post_title").dropna(), "post_title")


@query("SELECT s.sft_id, coalesce(c.response, s.response) AS response FROM sft_pairs s LEFT JOIN (SELECT pair_id, response FROM clean_pairs WHERE pair_id % 3 = 0) c ON s.sft_id = c.pair_id")
def sparse_override(spark, d):
    sparse = table(spark, d, "clean_pairs", F.col("pair_id").alias("sft_id"), "response").filter("sft_id % 3 = 0")
    return joins.override(table(spark, d, "sft_pairs", "sft_id", "response"), "sft_id", "response", sparse)


_ROWS = "r AS (SELECT sft_id, parent, response, (row_number() OVER (ORDER BY sft_id) - 1) // 32 AS chunk FROM sft_pairs)"


@query(f"WITH {_ROWS} SELECT sft_id, chunk::BIGINT AS chunk, coalesce(lead(parent) OVER w, CASE WHEN lead(sft_id) OVER w IS NULL THEN first_value(parent) OVER w END) AS next_parent, coalesce(lead(response) OVER w, CASE WHEN lead(sft_id) OVER w IS NULL THEN first_value(response) OVER w END) IS DISTINCT FROM response AS usable FROM r WINDOW w AS (PARTITION BY chunk ORDER BY sft_id)")
def neighbour_negatives(spark, d):
    df = sampling.chunk_number(table(spark, d, "sft_pairs", "sft_id", "parent", "response"), "sft_id", 32)
    return joins.neighbours(df, "chunk", "sft_id", "parent", "response").select("sft_id", "chunk", "next_parent", (~F.col("next_response").eqNullSafe(F.col("response"))).alias("usable"))


# Sampling and mixtures


@query("SELECT doc_id, source FROM documents ORDER BY md5('20260904:' || doc_id), doc_id LIMIT 100")
def hash_sample(spark, d):
    return sampling.hash_sample(table(spark, d, "documents", "doc_id", "source"), "doc_id", 100, 20260904)


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def first_documents(spark, d):
    return sampling.first_rows(table(spark, d, "documents", "doc_id", "lang"), "doc_id", 50)


@query(f"SELECT {s_bucket('parent')} AS bucket, count(*)::BIGINT AS n_rows FROM clean_pairs WHERE parent IS NOT NULL GROUP BY 1")
def hash_split(spark, d):
    return table(spark, d, "clean_pairs", "parent").filter("parent IS NOT NULL").groupBy(T.split_bucket(F.col("parent")).alias("bucket")).agg(F.count("*").alias("n_rows"))


# the hash has no SQL form
@query()
def hash_split_blake(spark, d):
    return table(spark, d, "raw_pairs", "post_title").groupBy(udfs.blake2_bucket(100)(F.coalesce("post_title", F.lit(""))).alias("bucket")).agg(F.count("*").alias("n_rows"))


@query("SELECT id, ('0x' || right(sha256(id), 1))::BIGINT % 2 = 1 AS swapped FROM eval_stage3_exclude")
def ab_swap(spark, d):
    return table(spark, d, "eval_stage3_exclude", "id").select("id", sampling.swaps(F.col("id")).alias("swapped"))


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 64)::BIGINT AS chunk FROM documents")
def chunk_numbers(spark, d):
    return sampling.chunk_number(table(spark, d, "documents", "doc_id"), "doc_id", 64)


@query("SELECT passage_id, ((42 + passage_id * 1000003) & 2147483647)::BIGINT AS seed FROM eval_passages")
def preset_seeds(spark, d):
    return table(spark, d, "eval_passages", "passage_id").select("passage_id", sampling.prompt_seed(42, F.col("passage_id")).alias("seed"))


_MIX = "m AS (SELECT parent, response, coalesce(source, '-') AS source FROM sft_pairs WHERE source = 'authored' UNION ALL SELECT parent, response, coalesce(source, '-') FROM sft_pairs, range(5) WHERE source = 'general' UNION ALL SELECT parent, response, coalesce(source, '-') FROM sft_pairs, range(2) WHERE source = 'teacher')"


def _mixed(spark, d):
    df = table(spark, d, "sft_pairs", "parent", "response", "source")
    return sampling.mix((df.filter("source = 'authored'"), 1), (df.filter("source = 'general'"), 5), (df.filter("source = 'teacher'"), 2))


@query(f"WITH {_MIX} SELECT source, count(*)::BIGINT AS n_draws, count(DISTINCT (parent, response))::BIGINT AS n_unique FROM m GROUP BY 1")
def mixture_union(spark, d):
    return _mixed(spark, d).groupBy("source").agg(F.count("*").alias("n_draws"), F.count_distinct(F.struct("parent", "response")).alias("n_unique"))


@query("SELECT split, category, prompt FROM eval_stage3_exclude WHERE split = 'development' UNION ALL SELECT split, category, text FROM eval_passages WHERE split = 'final'")
def exclusion_union(spark, d):
    a = table(spark, d, "eval_stage3_exclude", "split", "category", "prompt").filter("split = 'development'")
    return a.unionByName(table(spark, d, "eval_passages", "split", "category", F.col("text").alias("prompt")).filter("split = 'final'"))


# Reports


@query(f"SELECT source, lang, grouping(lang)::BIGINT AS is_total, count(*)::BIGINT AS n_rows, round(avg(({s_letters('text')} > 0)::INT), 6) AS cyrillic_rate, round(avg(n_chars), 6) AS avg_n_chars FROM documents GROUP BY GROUPING SETS ((source), (source, lang))")
def grouped_report(spark, d):
    df = table(spark, d, "documents", "source", "lang", "text", "n_chars").withColumn("cyrillic", T.letter_count(F.col("text")) > 0)
    return reports.rates(df, "source", "lang", ["cyrillic"], ["n_chars"])


@query("SELECT prompt_no, first(parent ORDER BY sft_id) FILTER (WHERE source = 'general') AS general, first(parent ORDER BY sft_id) FILTER (WHERE source = 'teacher') AS teacher, first(parent ORDER BY sft_id) FILTER (WHERE source = 'authored') AS authored FROM (SELECT *, sft_id // 7 AS prompt_no FROM sft_pairs) WHERE source IN ('general', 'teacher', 'authored') AND parent IS NOT NULL GROUP BY 1")
def pivot_answers(spark, d):
    df = table(spark, d, "sft_pairs", "sft_id", "parent", "source").filter("parent IS NOT NULL").withColumn("prompt_no", F.floor(F.col("sft_id") / 7).cast("long"))
    return reports.answers(df, "prompt_no", "source", ["general", "teacher", "authored"], "parent", "sft_id")


@query("SELECT count(*)::BIGINT AS n_rows, count(DISTINCT id)::BIGINT AS n_ids, count(*) = count(DISTINCT id) AS unique_ids FROM eval_stage3_exclude")
def id_check(spark, d):
    return table(spark, d, "eval_stage3_exclude", "id").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), (F.count("*") == F.count_distinct("id")).alias("unique_ids"))


@query("SELECT split, bit_xor(doc_hash)::BIGINT AS checksum FROM (SELECT coalesce(lang, '-') AS split, ('0x' || substr(md5(text), 1, 15))::BIGINT AS doc_hash FROM documents) GROUP BY 1")
def checksums(spark, d):
    h = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    return table(spark, d, "documents", "lang", "text").groupBy(F.coalesce("lang", F.lit("-")).alias("split")).agg(F.bit_xor(h).alias("checksum"))


# Token rows: a word stands for the token 6 + its length


def s_tokens(x: str) -> str:
    return f"list_transform({s_words(x)}, lambda w: 6 + length(w))"


_PACK = f"""t AS (SELECT pair_id, {s_tokens('parent')} AS p, {s_tokens('response')} AS r FROM clean_pairs WHERE parent IS NOT NULL AND response IS NOT NULL),
b AS (SELECT *, len(p) + len(r) <= 28 AS fits, least(len(p), 28 - least(len(r), 16, 28)) AS room FROM t),
c AS (SELECT pair_id, CASE WHEN fits THEN p WHEN room > 0 THEN p[len(p)-room+1:] ELSE [] END AS cp, CASE WHEN fits THEN r ELSE r[1:least(len(r), 28 - room)] END AS cr, NOT fits AS trimmed FROM b),
k AS (SELECT pair_id, list_concat(list_concat([1, 3], cp), list_concat(list_concat([4], cr), [2])) AS tokens, list_concat(list_transform(range(len(cp) + 3), lambda x: 0), list_transform(range(len(cr) + 1), lambda x: 1)) AS mask, trimmed FROM c)"""


def _packed(spark, d):
    tokens = lambda c: F.transform(T.words(F.col(c)), lambda w: F.char_length(w) + 6)
    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response").filter("parent IS NOT NULL AND response IS NOT NULL")
    return packing.packed(df.select("pair_id", tokens("parent").alias("p"), tokens("response").alias("r")), "p", "r", 32, 16)


@query(f"WITH {_PACK} SELECT pair_id, array_to_string(tokens, ',') AS tokens, array_to_string(mask, ',') AS mask, trimmed FROM k")
def trim_pack(spark, d):
    return _packed(spark, d).select("pair_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"), F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"), "trimmed")


@query(f'WITH {_PACK} SELECT pair_id, coalesce(sum(len(tokens)) OVER (ORDER BY pair_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM k')
def pack_offsets(spark, d):
    return packing.offsets(_packed(spark, d).select("pair_id", F.size("tokens").alias("n")), "pair_id", F.col("n")).select("pair_id", "offset")


@query(f"WITH {_PACK} SELECT count(*)::BIGINT AS n_pairs, sum(len(tokens))::BIGINT AS n_tokens, sum(list_sum(mask))::BIGINT AS n_response_tokens, count(*) FILTER (WHERE trimmed)::BIGINT AS n_trimmed, min(len(tokens))::BIGINT AS min_tokens, max(len(tokens))::BIGINT AS max_tokens FROM k")
def pack_totals(spark, d):
    return packing.totals(_packed(spark, d))


@query(f"WITH {_PACK} SELECT pair_id, array_to_string(list_transform(range(1, len(mask) + 1), lambda i: CASE WHEN mask[i] = 1 AND list_sum(mask[1:i]) <= 4 AND tokens[i] <> 2 THEN 2 ELSE mask[i] END), ',') AS weights FROM k")
def prefix_weights(spark, d):
    w = A.prefix_weights(F.col("mask"), F.col("tokens"), 4, 2.0)
    return _packed(spark, d).select("pair_id", F.array_join(F.transform(w, lambda x: x.cast("int").cast("string")), ",").alias("weights"))


@query(f"SELECT pair_id, array_to_string(p[greatest(len(p) - 9, 1):], ',') AS last_tokens FROM (SELECT pair_id, {s_tokens('parent')} AS p FROM clean_pairs WHERE parent IS NOT NULL) WHERE len(p) > 0")
def left_trim(spark, d):
    p = F.transform(T.words(F.col("parent")), lambda w: F.char_length(w) + 6)
    df = table(spark, d, "clean_pairs", "pair_id", "parent").filter("parent IS NOT NULL").withColumn("p", p).filter(F.size("p") > 0)
    return df.select("pair_id", F.array_join(F.slice("p", -F.least(F.size("p"), F.lit(10)), F.lit(10)).cast("array<string>"), ",").alias("last_tokens"))


# Number arrays


_EMB = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT *, greatest(list_max(list_transform(e, lambda x: abs(x))) / 127, 1.1754943508222875e-38) AS sc FROM v), q AS (SELECT *, list_transform(e, lambda x: greatest(-127, least(127, round_even(x / sc, 0)::INT))) AS q FROM s)"


def _vectors(spark, d):
    return table(spark, d, "embeddings", "vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def _quantized(spark, d):
    return _vectors(spark, d).withColumn("sc", A.scale(F.col("e"))).withColumn("q", A.quantize(F.col("e"), F.col("sc")))


@query(f"WITH {_EMB} SELECT vec_id, round(sc, 8) AS scale, array_to_string(q, ',') AS q FROM q")
def quantize_rows(spark, d):
    return _quantized(spark, d).select("vec_id", F.round("sc", 8).alias("scale"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@query(f"WITH {_EMB}, x AS (SELECT label, unnest(e) AS a, unnest(list_transform(q, lambda y: y * sc)) AS b FROM q) SELECT label, round(avg((a - b) * (a - b)), 8) AS mse, round(max(abs(a - b)), 8) AS max_abs_error, round(avg(abs(a - b)), 8) AS mean_abs_error FROM x GROUP BY 1")
def quant_error(spark, d):
    pairs = F.explode(F.arrays_zip(F.col("e").alias("a"), A.dequantize(F.col("q"), F.col("sc")).alias("b")))
    flat = _quantized(spark, d).select("label", pairs.alias("x")).select("label", "x.a", "x.b")
    return flat.groupBy("label").agg(*[F.round(c, 8).alias(n) for c, n in zip(reports.errors("a", "b"), ("mse", "max_abs_error", "mean_abs_error"))])


@query(f"WITH {_EMB} SELECT q.vec_id, list_sum(list_transform(range(1, 65), lambda i: q.q[i] * w.q[i]))::BIGINT AS product FROM q, (SELECT q FROM q WHERE vec_id = (SELECT min(vec_id) FROM v)) w")
def int8_dot(spark, d):
    # one stated query vector, as a literal, against all rows
    df = _quantized(spark, d)
    first = df.orderBy("vec_id").limit(1).select("q").first()
    w = F.array(*[F.lit(x) for x in (first.q if first else [])]).cast("array<int>")
    return df.select("vec_id", A.int_dot(F.col("q"), w).alias("product"))


_QUERIES = "z AS (SELECT vec_id AS query_id, e AS z FROM v WHERE vec_id % 20 = 0)"


@query(f"WITH {_EMB}, {_QUERIES}, c AS (SELECT query_id, vec_id, round(list_dot_product(e, z) / sqrt(list_dot_product(e, e) * list_dot_product(z, z)), 9) AS cosine FROM v, z WHERE vec_id <> query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS n FROM c) SELECT query_id, vec_id, n::BIGINT AS place, round(cosine, 6) AS cosine FROM r WHERE n <= 10")
def cosine_topk(spark, d):
    """Ten nearest of all rows for every row whose id is divisible by 20: the stated queries in blocks, against a scan of all rows."""
    import numpy as np
    import pyarrow as pa

    df, block = _vectors(spark, d), 4096
    out = None
    queries = df.filter("vec_id % 20 = 0").select("vec_id", "e").orderBy("vec_id").toLocalIterator()
    import itertools

    while part := list(itertools.islice(queries, block)):
        ids, z = np.array([r.vec_id for r in part]), np.array([r.e for r in part])
        shared = spark.sparkContext.broadcast((ids, z / np.linalg.norm(z, axis=1, keepdims=True)))

        def near(batches, shared=shared):
            ids, z = shared.value
            for b in batches:
                own = b.column(0).to_numpy()
                x = b.column(1).flatten().to_numpy().reshape(len(own), -1)
                c = np.round(z @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 9)
                c[ids[:, None] == own[None, :]] = -np.inf
                # of each batch at most ten rows can be among a query's ten
                for i in range(len(ids)):
                    order = np.lexsort((own, -c[i]))[:10]
                    order = order[np.isfinite(c[i][order])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(order), ids[i])), pa.array(own[order]), pa.array(c[i][order])], ["query_id", "vec_id", "cosine"])

        found = df.select("vec_id", "e").mapInArrow(near, "query_id long, vec_id long, cosine double")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 10").withColumn("cosine", F.round("cosine", 6))


@query(f"WITH {_EMB} SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(64), lambda i: {{'m': -e[i + 1], 't': i}}))[1:5], lambda p: p.t), ',') AS tokens FROM v")
def top_tokens(spark, d):
    return _vectors(spark, d).select("vec_id", F.array_join(F.transform(A.top_k(F.col("e"), 5), lambda p: p["token"].cast("string")), ",").alias("tokens"))


@query(f"WITH {_EMB}, x AS (SELECT vec_id, list_transform(e, lambda y: exp((y - list_max(e)) / 0.5)) AS x FROM v) SELECT vec_id, round(list_max(x) / list_sum(x), 6) AS greatest, round(list_min(x) / list_sum(x), 6) AS least FROM x")
def softmax_range(spark, d):
    return _vectors(spark, d).withColumn("p", A.softmax(F.col("e"), 0.5)).select("vec_id", F.round(F.array_max("p"), 6).alias("greatest"), F.round(F.array_min("p"), 6).alias("least"))


@query(f"WITH {_EMB} SELECT vec_id, round(list_sum(list_transform(range(64), lambda i: CASE WHEN i IN (1, 3, 60) THEN CASE WHEN e[i + 1] >= 0 THEN e[i + 1] / 2 ELSE e[i + 1] * 2 END ELSE e[i + 1] END)), 6) AS total FROM v")
def penalty_sum(spark, d):
    history = F.array(*[F.lit(i) for i in (1, 3, 3, 60)])
    return _vectors(spark, d).select("vec_id", F.round(A.total(A.repetition_penalty(F.col("e"), history, 2.0)), 6).alias("total"))


@query(f"WITH {_EMB} SELECT vec_id, round(e[1] / sqrt(list_dot_product(e, e) / 64 + 1e-5), 6) AS first_value, round(list_sum(e) / sqrt(list_dot_product(e, e) / 64 + 1e-5), 5) AS total FROM v")
def rms_norms(spark, d):
    df = _vectors(spark, d).withColumn("n", A.rms_norm(F.col("e")))
    return df.select("vec_id", F.round(F.get("n", F.lit(0)), 6).alias("first_value"), F.round(A.total(F.col("n")), 5).alias("total"))


@query("SELECT label, round(sum(w * l) / sum(w), 6) AS weighted_loss, round(exp(sum(w * l) / sum(w)), 5) AS perplexity, round(avg(greatest(0.25 + l - 0.5, 0)), 6) AS margin_loss FROM (SELECT label, abs(embedding[1])::DOUBLE AS l, abs(embedding[2])::DOUBLE AS w FROM embeddings) GROUP BY 1")
def weighted_losses(spark, d):
    df = _vectors(spark, d).select("label", F.abs(F.get("e", F.lit(0))).alias("l"), F.abs(F.get("e", F.lit(1))).alias("w"))
    mean = F.sum(F.col("w") * F.col("l")) / F.sum("w")
    return df.groupBy("label").agg(F.round(mean, 6).alias("weighted_loss"), F.round(F.exp(mean), 5).alias("perplexity"), F.round(F.avg(F.greatest(F.lit(0.25) + F.col("l") - 0.5, F.lit(0.0))), 6).alias("margin_loss"))


@query("WITH a AS (SELECT vec_id, xor(x, (x << 13) & 4294967295) AS x FROM (SELECT vec_id, CASE WHEN vec_id = 0 THEN 1831565813 ELSE vec_id END::BIGINT AS x FROM embeddings)), b AS (SELECT vec_id, xor(x, x >> 17) AS x FROM a) SELECT vec_id, (xor(x, (x << 5) & 4294967295))::BIGINT AS state FROM b")
def xorshift_states(spark, d):
    return table(spark, d, "embeddings", "vec_id").select("vec_id", A.xorshift(F.col("vec_id")).alias("state"))


@query("SELECT range::BIGINT AS step, round(CASE WHEN range <= 100 THEN 0.00002 * range / 100.0 ELSE 0.000005 + 0.5 * (1 + cos(pi() * (range - 100) / 500.0)) * 0.000015 END, 10) AS rate FROM range(1, 601)")
def lr_schedule(spark, d):
    return spark.range(1, 601).select(F.col("id").alias("step"), F.round(A.learning_rate(F.col("id"), 100, 600, 2e-5, 5e-6), 10).alias("rate"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS decoded_md5 FROM documents")
def bpe_roundtrip(spark, d):
    from weftline.functions import bpe

    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(bpe.decode(bpe.encode(F.col("text")))).alias("decoded_md5"))


@query()
def bpe_pack_totals(spark, d):
    from weftline.functions import bpe

    df = table(spark, d, "clean_pairs", "pair_id", "parent", "response").filter("parent IS NOT NULL AND response IS NOT NULL")
    return packing.totals(packing.packed(df.select("pair_id", bpe.encode(F.col("parent")).alias("p"), bpe.encode(F.col("response")).alias("r")), "p", "r"))
