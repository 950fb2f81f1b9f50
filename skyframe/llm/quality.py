"""Quality rules with cutoffs that hold the risk of a false rejection down."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table

#: White space between words, as characters.
BLANK = " \t\n\x0b\x0c\r"
#: Rule and the numbers it is tried with, from lenient to strict. A text fails a rule above its cutoff.
GRID = [8.0, 4.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01]
RULES = ("symbols_per_word", "marks_per_word", "capitals", "dup_lines", "repeats", "long_words")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and, of each whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks,
    n_capitals, n_lines, all long. A null text has no words.

    Only DataFrame functions. Repeated 8-word windows are found by their hashes within the row: no explode and no shuffle;
    a text of n words costs n log n at most.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("_t"), F.lit(pattern)).cast("long")
    d = docs.select(*keep, text.alias("_t"))
    trimmed = F.btrim(F.col("_t"), F.lit(BLANK))
    d = d.select(
        *keep,
        F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0).alias("_lines"),
        (F.length("_t") - count(r"[\x20\x09-\x0D]")).alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[!?|]").alias("n_marks"), count(r"[A-Z]").alias("n_capitals"),
    )
    n = F.size("_words")
    windows = F.when(n >= 8, F.transform(F.sequence(F.lit(1), n - 7), lambda i: F.xxhash64(F.slice("_words", i, 8)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_h", windows)

    def covered(s: Column) -> Column:
        """Words in windows whose hash stands beside an equal one in the sorted array s of (hash, start)."""
        last = F.size(s) - 1
        same = lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | ((k < last) & (F.get(s, k + 1)["h"] == e["h"]))
        starts = F.array_sort(F.transform(F.filter(s, same), lambda e: e["i"]))
        return let(starts, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(8), F.coalesce(F.get(p, k + 1) - x, F.lit(8)))), F.lit(0), lambda a, x: a + x))

    repeats = F.when(F.size(F.array_distinct("_h")) < F.size("_h"), let(F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)).otherwise(0)
    return d.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), repeats.cast("long").alias("n_repeat_words"),
        "n_marks", "n_capitals", F.size("_lines").cast("long").alias("n_lines"),
    )


def features() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "marks_per_word": F.col("n_marks") / words,
        "capitals": F.col("n_capitals") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words / 50,
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for chance p: the exact p-value of `the true rate is p or more` after k in n."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = log(k) if k < n * p else log(min(k, int(n * p)))
    total, i = 0.0, k
    while i >= 0:
        term = math.exp(log(i) - top)
        total += term
        if term < 1e-17 * total and i < n * p:
            break
        i -= 1
    return min(1.0, total * math.exp(top))


def cutoffs(counts: dict[tuple[str, str], list[tuple[int, int]]], alpha: float, delta: float) -> dict[tuple[str, str], float]:
    """The cutoff of each (stratum, rule) that is certified and rejects most of the bad in excess of the good; none if none is.

    counts: for each step of GRID, how many good and bad held-out texts a cutoff there rejects, after (all good, all bad).
    A rule gets the share alpha / rules of the false rejections of its stratum, and an error chance of delta / (strata x rules)
    (Bonferroni); along the grid tests run from lenient to strict and stop at the first that is not significant.
    """
    tests, rules = len(counts), len({r for _, r in counts})
    out = {}
    for key, ((good, bad), *steps) in counts.items():
        best = 0.0
        for c, (g, b) in zip(GRID, steps, strict=True):
            if binomial_tail(g, good, alpha / rules) > delta / tests:
                break
            gain = b / max(bad, 1) - g / max(good, 1)
            if gain > best:
                best, out[key] = gain, c
    return out


def risk_controlled(
    docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", stratum_col: str = "lang", label_col: str = "quality",
    alpha: float = 0.02, delta: float = 0.05, max_strata: int = 10_000,
) -> DataFrame:
    """One row per document: id, stratum, the measures, base_failed, failed_rule (the first, or null) and kept.

    The labelled holdout is all labelled documents that pass the base rules; label 1 is good, a repeated id counts with its
    least label, a null label not at all. With probability 1 - delta over the holdout at most alpha of the good texts of any
    stratum fail a rule. A stratum with too few labels to certify a cutoff rejects nothing beyond the base rules; null is a stratum.
    Counts per stratum, rule and step reach the driver; over max_strata strata are refused. Measures are computed once and kept.
    Repeated rows have one result each; a text equal to a cutoff passes. Null and empty texts fail the base rules. Only the id, text and
    stratum columns of docs are read, so columns of other names, clashing ones too, are left out. No text is too long: windows are hashed whole.
    """
    m = measures(docs.select(id_col, text_col, F.col(stratum_col).alias("_stratum")), text_col, (id_col, "_stratum"))
    fail = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    m = table(m.withColumn("base_failed", fail), "measures")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.min(label_col).alias("_label"))
    f = features()
    step = lambda x: sum((x > c).cast("int") for c in GRID)  # noqa: E731  how many cutoffs, from the lenient end, are below: counted from the strict end
    told = m.where("not base_failed").withColumn("_stratum", F.col("_stratum").cast("string")).join(known, F.col(id_col).cast("string") == F.col("_id")).select("_stratum", "_label", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step(f[r]).alias("n")) for r in RULES])).alias("x"))
    rows = told.groupBy("_stratum", "x.rule", "x.n").agg(F.sum(F.when(F.col("_label") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_label") == 0, 1).otherwise(0)).alias("bad"))
    got = rows.limit(max_strata * len(RULES) * (len(GRID) + 1) + 1).collect()
    if len({r["_stratum"] for r in got}) > max_strata:
        raise ValueError(f"more than {max_strata} strata")
    counts: dict[tuple[str, str], list[tuple[int, int]]] = {}
    for key in {(r["_stratum"], r["rule"]) for r in got}:
        own = [r for r in got if (r["_stratum"], r["rule"]) == key]
        # a value above n cutoffs is above the n strictest: the cutoff at place i of GRID rejects it if n >= len(GRID) - i
        over = lambda what, i, own=own: sum(r[what] for r in own if r["n"] >= len(GRID) - i)
        counts[key] = [(sum(r["good"] for r in own), sum(r["bad"] for r in own)), *((over("good", i), over("bad", i)) for i in range(len(GRID)))]
    chosen = cutoffs(counts, alpha, delta)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, r, c) for (s, r), c in chosen.items()], "_s string, _rule string, _cut double").groupBy("_s").pivot("_rule", list(RULES)).agg(F.max("_cut")).coalesce(1)
    m = m.join(F.broadcast(plan), F.col("_stratum").cast("string").eqNullSafe(F.col("_s")), "left")
    failed = F.coalesce(*[F.when(f[r] > F.col(r), F.lit(r)) for r in RULES])
    m = m.withColumn("failed_rule", failed)
    return m.select(
        id_col, F.col("_stratum").alias(stratum_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rule",
        (~F.col("base_failed") & F.col("failed_rule").isNull()).alias("kept"),
    )


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = risk_controlled(docs, labels)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")
