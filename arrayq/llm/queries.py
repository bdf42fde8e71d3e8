"""The registered queries of this subpackage and, where SQL can express one, its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import query
from . import chat, classifier, decontaminate, hmm, html_text, near_dup, packing, rules, store, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.removed_words(table(spark, sf_dir, "documents")))


def op2_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return hmm.scored(docs, docs.where(~held))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_site_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after five commits: all documents by one tokenizer, some in an older version; by a second one; the older versions
    revised; short documents deleted again; the second commit replayed.  Then all are folded, and two replayed once more."""
    docs, totals = table(spark, sf_dir, "documents"), token_counts.Rollup(spark, store.folder(spark))
    words, alnum = (token_counts.deltas(docs, k) for k in token_counts.TOKENIZERS)
    revised = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 3
    older = docs.withColumn("text", F.when(revised, F.expr("left(text, length(text) div 2)")).otherwise(F.col("text")))
    first = token_counts.deltas(older, "words-1")
    totals.commit(1, first)
    totals.commit(2, alnum)
    totals.commit(3, token_counts.revisions(older.where(revised), docs.where(revised), "words-1"))
    totals.commit(4, words.where("tokens < 20").withColumn("sign", F.lit(-1)))
    totals.commit(2, alnum)
    totals.compact()
    totals.commit(1, first)
    totals.commit(2, alnum)
    return totals.totals()


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], rows.schema)
    return chat.digest(store.saved(chat.rendered(chat.folded(chat.streamed(chat.events(rows.unionByName(extra)))))))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: query(f)
    for f in (
        op1_substring_dedup, op2_hidden_markov_lm, op3_quality_rules, op4_site_template_removal, op5_minhash_near_dup,
        op6_token_counts, op7_benchmark_decontamination, op8_chat_formatting, op9_best_fit_packing, op10_quality_classifier,
    )
}

SQL: dict[str, str] = {
    "op6_token_counts": r"""
        with c as (
          select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as w,
                 len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) as a
          from documents),
        d as (
          select source, lang, 'words-1' as tokenizer, 1 as k, w as n from c
          union all select source, lang, 'alnum-1', 1, a from c
          union all select source, lang, 'words-1', -1, w from c where w < 20)
        select source, lang, tokenizer, cast(sum(k) as bigint) as documents, cast(sum(k * n) as bigint) as tokens
        from d group by source, lang, tokenizer having sum(k) <> 0 or sum(k * n) <> 0""",
    "op8_chat_formatting": r"""
        with c as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
          union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e as (
          select *, length(replace(text, '\', '\\')) + (length(text) - length(replace(text, '<s>', ''))) / 3 + (length(text) - length(replace(text, '</s>', ''))) / 4
            + (length(text) - length(replace(text, '[INST]', ''))) / 6 + (length(text) - length(replace(text, '[/INST]', ''))) / 7 as long from c)
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          cast(sum(long + length(role) + 22) as bigint) as formatted_chars
        from e group by conv_id""",
}
