"""Queries and SQL of the training-data operators, by problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from weftline.llm import abuse, canon, collapse, components, leaks, packing, pairs, residue, winnow
from weftline.llm.pairs import is_empty
from weftline.plans.runtime import cut, table

SHARES = {"train": 0.9, "validation": 0.05, "test": 0.05}
LINKS = ["comment_id_parent", "comment_id_child"]


def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean_pairs and the readable lines of pair_lines: (pair_id, response, record)."""
    clean = table(spark, sf_dir, "clean_pairs", "pair_id", "parent", "response").select("pair_id", "response", collapse.fields_of("parent", "response").alias("record"))
    lines = collapse.read_lines(table(spark, sf_dir, "pair_lines", "pair_id", "line"), "pair_id", "line", ["parent", "response"])
    return clean.union(lines.select("pair_id", "response", "record"))


def _eval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "sft_pairs", "sft_id", "parent")
    evals = table(spark, sf_dir, "eval_stage3_exclude", "id", "prompt")
    return winnow.overlaps(train, "sft_id", "parent", evals, "id", "prompt")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _eval_overlaps(spark, sf_dir).select("eval_id", F.col("train_id").alias("sft_id"))


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of each training record that overlaps an evaluation record."""
    return winnow.records(_eval_overlaps(spark, sf_dir)).select(F.col("train_id").alias("sft_id"), "n_evals", F.round("coverage", 4).alias("coverage"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by evaluation split and training source; sources are compared without case and outer blanks."""
    sources = table(spark, sf_dir, "sft_pairs", F.col("sft_id").alias("train_id"), F.lower(F.trim("source")).alias("source"))
    splits = table(spark, sf_dir, "eval_stage3_exclude", F.col("id").alias("eval_id"), "split")
    joined = _eval_overlaps(spark, sf_dir).join(sources, "train_id").join(splits, "eval_id")
    # the records of a split first, each with the most that it covers
    each = joined.groupBy("split", "source", "train_id").agg(F.count("*").alias("n"), F.max("coverage").alias("coverage"))
    sums = each.groupBy("split", "source").agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_rows"), F.round(F.avg("coverage"), 4).alias("avg_coverage"))
    evals = joined.groupBy("split", "source").agg(F.count_distinct("eval_id").alias("n_evals"))
    return sums.join(evals, (sums["split"] == evals["split"]) & sums["source"].eqNullSafe(evals["source"])).select(sums["split"], sums["source"], "n_pairs", "n_rows", "n_evals", "avg_coverage")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = pair_records(spark, sf_dir).filter(~is_empty(F.col("response")))
    return collapse.copies(records, "pair_id", "record").select("keep_id", "copy_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "clean_pairs", "pair_id", "parent", "response")
    model = pairs.fit(df, "pair_id", "parent", "response")
    return pairs.defects(df, "pair_id", "parent", "response", model).select(F.col("id").alias("pair_id"), "defect")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canon.look_alike_pairs(table(spark, sf_dir, "raw_pairs", "row_id", "parent_comment", "child_comment"), "row_id", "parent_comment", "child_comment")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that look the same, as classes and their members."""
    return canon.look_alike_classes(table(spark, sf_dir, "raw_pairs", "row_id", "parent_comment", "child_comment"), "row_id", "parent_comment", "child_comment")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.Entities(table(spark, sf_dir, "raw_pairs", "row_id", "post_title", *LINKS), "row_id", "post_title", LINKS).mixed()


def p5_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = components.assign_splits(table(spark, sf_dir, "raw_pairs", "row_id", "post_title", *LINKS), "row_id", "post_title", LINKS, SHARES)
    return out.groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))


def _scorer(spark: SparkSession, sf_dir: str, name: str = "clean_pairs", text: str = "response", hint: str = "response_toxicity") -> abuse.Scorer:
    return abuse.fit(table(spark, sf_dir, "tox_labels", "text", "label"), "text", "label", table(spark, sf_dir, name, text, hint), text, hint)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "clean_pairs", "pair_id", "response")
    return abuse.scores(df, "pair_id", "response", _scorer(spark, sf_dir)).filter("score >= 0.5").select(F.col("id").alias("pair_id"))


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by source, compared without case and outer blanks."""
    df = table(spark, sf_dir, "clean_pairs", "pair_id", "response", "source")
    scored = abuse.scores(df.select(F.struct("pair_id", "source").alias("k"), "response"), "k", "response", _scorer(spark, sf_dir))
    return scored.groupBy(F.lower(F.trim("id.source")).alias("source")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") >= 0.5).alias("n_flagged"), F.round(F.avg("score"), 4).alias("avg_score"))


def p6_raw_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of raw_pairs.child_comment by shard, beside the stored hint."""
    df = table(spark, sf_dir, "raw_pairs", "shard", "child_comment", "child_comment_tox")
    scored = abuse.scores(df.select(F.struct("shard", "child_comment_tox").alias("k"), "child_comment"), "k", "child_comment", _scorer(spark, sf_dir, "raw_pairs", "child_comment", "child_comment_tox"))
    return scored.groupBy(F.col("id.shard").alias("shard")).agg(F.count("*").alias("n_rows"), F.count_if(F.col("score") >= 0.5).alias("n_flagged"), F.count_if(F.col("id.child_comment_tox") >= 0.8).alias("n_hinted"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return packing.sized(docs, "doc_id", "text", "source", f"{packing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def p7_containers_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), 256)


def p7_containers_2048(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir), 2048)


def p7_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of 2,048 tokens with at most eight documents of a source, by the bins' source bitmaps."""
    return packing.pack(_sized(spark, sf_dir), 2048, per_source=8)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = cut(_sized(spark, sf_dir))
    reports = [packing.report(packing.pack(items, c), c).select(F.lit(c).alias("capacity"), "*") for c in (256, 2048)]
    return reports[0].union(reports[1])


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    passages = table(spark, sf_dir, "eval_passages", "passage_id", "text")
    return leaks.found(docs, "doc_id", "text", passages, "passage_id", "text").select("doc_id", "passage_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return residue.residue(docs, "doc_id", "text", residue.fit(docs, "text")).select("doc_id")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_records": p1_records, "p1_report": p1_report, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_split_sizes": p5_split_sizes, "p6_found": p6_found, "p6_rates": p6_rates, "p6_raw_rates": p6_raw_rates, "p7_containers_256": p7_containers_256, "p7_containers_2048": p7_containers_2048, "p7_mixed_sources": p7_mixed_sources, "p7_report": p7_report, "p8_found": p8_found, "p9_found": p9_found}


_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\p{{M}}]+', '', 'g')"
_BARE = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def oracle_sql() -> dict:
    stand_ins = ", ".join(f"'{x}'" for x in pairs.STAND_INS)
    return {
        "p2_found": f"""WITH lines AS (SELECT pair_id, CASE WHEN json_valid(line) AND starts_with(trim(line), '{{') THEN line END AS j FROM pair_lines),
r AS (SELECT pair_id, parent, response FROM clean_pairs UNION ALL SELECT pair_id, json_extract_string(j, '$.parent'), json_extract_string(j, '$.response') FROM lines WHERE json_extract_string(j, '$.parent') IS NOT NULL AND json_extract_string(j, '$.response') IS NOT NULL),
k AS (SELECT pair_id, {_KEY.format("coalesce(parent, '')")} AS p, {_KEY.format("response")} AS r FROM r WHERE response IS NOT NULL AND {_BARE.format("response")} NOT IN ('', {stand_ins}))
SELECT keep_id, pair_id AS copy_id FROM (SELECT pair_id, min(pair_id) OVER (PARTITION BY p, r) AS keep_id FROM k) WHERE pair_id <> keep_id""",
    }
