"""From documents to a training mix: five stages, each an operator of skyframe.llm, each written and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyframe.llm import chunks, decontam, langid, mixing, neardup
from skyframe.llm.store import free_name, sent, table


def as_before(out: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, which out has at the same places (perhaps under other names), in their types, some of them changed."""
    return out.select(*[changed.get(c, F.col(o)).alias(c) for c, o in zip(docs.columns, out.columns, strict=False)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not clear, those without a text or a letter among them; lang becomes the prediction. Learns from the
    input's labelled documents that are not held out. Repeated rows are judged alike; an empty table stays empty."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.predict(docs, model, prefix="_langid_").where("not _langid_rejected")
    return as_before(out, docs, lang=F.col("_langid_lang_pred"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id; of rows that repeat id and text one. Documents
    without a word, or with a null text, are on their own and all stay, as do all rows of an empty table."""
    classes = table(neardup.near_duplicates(docs.select("doc_id", "text")), "classes")
    # what goes, and rows that stand more than once, are few: texts need not move
    gone = table(classes.where("not is_kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct(), "gone")
    more = table(classes.where("is_kept and text_key is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).count().where("count > 1").drop("count"), "more")
    # a document without words is on its own and has no key
    k = free_name(docs, "_k")
    d = docs.withColumn(k, F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5("text"))))
    same = lambda x: d["doc_id"].eqNullSafe(x["_id"]) & (d[k] == x["_key"])
    stays = d.join(sent(gone), same(gone), "left_anti")
    if more.isEmpty():
        return stays.select(docs.columns)
    again = stays.join(sent(more), same(more), "left_semi").dropDuplicates(["doc_id", k])
    return stays.join(sent(more), same(more), "left_anti").unionByName(again).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stood before are cut out; a document of which nothing is left goes. Documents that had no word before stay as they are,
    null texts among them; n_chars follows the text where it was cut."""
    out = chunks.substring_dedup(docs)
    cut = F.col("_n_removed") > 0
    out = out.where(~cut | F.col("_kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return as_before(out, docs, text=F.col("_kept_text"), n_chars=F.when(cut, F.length("_kept_text").cast("long")).otherwise(F.col("n_chars")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a copy of a benchmark item go. Null and empty texts have none and stay; repeated rows go or stay together."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return as_before(decontam.find_leaks(docs, items).where(F.size("_leaks") == 0), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies and words taken. Documents without words add none and come along where whole
    copies of all of their source do; null is a source like any other; ties of rank are settled by hash, id and text, so reruns agree."""
    out = mixing.pareto_mix(docs, keep=("text", "lang", "n_chars"))
    return out.where("copies > 0").select("doc_id", "text", "lang", "source", "n_chars", "size", "target", "copies", "taken")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

#: No stage but the last can be told in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "_"))
    return docs
