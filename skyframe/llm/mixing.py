"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import table
from .textkit import WORD

#: Bits of the rank that one pass over the ranks resolves, and how many passes there are before the rest is sorted.
BITS, PASSES = 10, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Words to take from each source. Sources in order of code points, null last, weigh `weights`, repeating, and share
    `share` times all words; a target stops at `most` times its source's words and the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weigh[s] for s in order if s in open_)
        over = [s for s in order if s in open_ and left * weigh[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weigh[s] / total for s in open_}
            break
        for s in over:
            out[s] = float(most * sizes[s])
            open_.discard(s)
        left = share * sum(sizes.values()) - sum(out.values())
    return out


def pareto_mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight_col: str | None = None,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    max_sources: int = 100_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies (whole, 0 to `most`), taken, and the columns `keep`.

    A source with target T and S words wants T/S copies of each document, or with `weight_col` copies in proportion to it. The
    whole part is certain. The fraction p is the inclusion probability of one copy more: documents are ranked by Pareto's
    ratio (u/(1-u)) / (p/(1-p)), u a hash of seed, id and text, and the lowest ranks are taken while they fit into the words
    that are left of the target. The sample's size is so fixed in words. What is then missing is less than one document; the
    document of the later ranks whose size is nearest to it closes the sample, if that brings it nearer.

    No source is ever sorted as a whole: counts of words by rank, 2^BITS steps a pass, narrow the cut down to the ranks of one
    step, which alone are sorted. Per source one number reaches the driver; over max_sources sources are refused.

    Null texts have size 0 and take nothing. Documents of a source without words take nothing. Null sources form one source.
    Null or repeated ids are hashed with their text; rows equal in both have one rank and stay or go together.
    Null weights count as 0.
    """
    want = F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)) if weight_col else F.lit(1.0)
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    u = (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    base = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), n_words(F.col(text_col)).alias("_size"),
        u.alias("_u"), want.alias("_w"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
    )
    base = table(base, "sizes")
    sums = base.groupBy("_source").agg(F.sum("_size").alias("s"), F.sum(F.col("_size") * F.col("_w")).alias("w")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["_source"]: r["s"] for r in sums}
    goal = targets(sizes, weights, share, most)
    spark = docs.sparkSession
    rows = [(r["_source"], r["s"], float(goal[r["_source"]]), goal[r["_source"]] / r["w"] if r["w"] else 0.0) for r in sums]
    plan = spark.createDataFrame(rows, "_s string, _source_size long, _target double, _rate double").coalesce(1)
    d = base.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")

    copies = F.least(F.col("_rate") * F.col("_w"), F.lit(float(most)))
    d = d.withColumn("_whole", F.floor(copies)).withColumn("_p", F.when(F.col("_size") > 0, copies - F.floor(copies)).otherwise(0.0))
    rank = F.when(F.col("_p") > 0, (F.col("_u") / (1 - F.col("_u"))) * ((1 - F.col("_p")) / F.col("_p")))
    # q is the rank as a number in [0, 1): r/(1+r) keeps the order
    d = d.withColumn("_q", rank / (1 + rank))
    extra = d.where("_p > 0").select("_source", "_size", "_q")
    certain = d.groupBy("_source").agg((F.max("_target") - F.sum(F.col("_whole") * F.col("_size"))).alias("_need"))

    # the cut of each source: all ranks under _lo are taken; _need words are left for the ranks from _lo to _lo + _width
    cut = certain.select("_source", F.greatest("_need", F.lit(0.0)).alias("_need"), F.lit(0.0).alias("_lo"))
    width = 1.0
    for _ in range(PASSES):
        step = width / (1 << BITS)
        inside = extra.join(F.broadcast(cut.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
        inside = inside.where((F.col("_q") >= F.col("_lo")) & (F.col("_q") < F.col("_lo") + width))
        bins = inside.groupBy("_source", "_lo", "_need", F.floor((F.col("_q") - F.col("_lo")) / step).alias("_b")).agg(F.sum("_size").alias("_n"))
        upto = Window.partitionBy("_source").orderBy("_b")
        bins = bins.withColumn("_sum", F.sum("_n").over(upto))
        # the first step at whose end the need is met, else past the last
        crossing = bins.groupBy("_source", "_lo", "_need").agg(
            F.min(F.when(F.col("_sum") >= F.col("_need"), F.struct("_b", (F.col("_sum") - F.col("_n")).alias("_before")))).alias("_at"), F.max("_sum").alias("_all"),
        )
        none = F.col("_at").isNull()
        cut = crossing.select(
            "_source",
            (F.col("_need") - F.when(none, F.col("_all")).otherwise(F.col("_at._before"))).alias("_need"),
            F.when(none, F.col("_lo") + width).otherwise(F.col("_lo") + F.col("_at._b") * step).alias("_lo"),
        )
        cut = table(cut, "cut")
        width = step
    last = extra.join(F.broadcast(cut.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
    last = last.where((F.col("_q") >= F.col("_lo")) & (F.col("_q") < F.col("_lo") + width))
    last = last.groupBy("_source", "_q", "_need", "_lo").agg(F.sum("_size").alias("_n"))
    last = last.withColumn("_sum", F.sum("_n").over(Window.partitionBy("_source").orderBy("_q")))
    # the last rank that still fits, and what then is missing
    fits = last.where("_sum <= _need").groupBy("_source").agg(F.max("_q").alias("_last"), F.max("_sum").alias("_got"))
    cut = cut.join(F.broadcast(fits.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")), "left")
    cut = table(cut.select("_source", "_lo", "_last", (F.col("_need") - F.coalesce("_got", F.lit(0))).alias("_gap")), "cut")
    # of the ranks after it, the document whose size is nearest to that closes the sample, if this leaves less
    rest = extra.join(F.broadcast(cut.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")))
    rest = rest.where((F.col("_q") >= F.col("_lo")) & ~F.coalesce(F.col("_q") <= F.col("_last"), F.lit(False)))
    off = F.abs(F.col("_size") - F.col("_gap"))
    closing = rest.where(off < F.col("_gap")).groupBy("_source").agg(F.min(F.struct(off.alias("off"), "_q"))["_q"].alias("_closing"))
    cut = cut.join(F.broadcast(closing.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")), "left").select("_source", "_lo", "_last", "_closing")
    d = d.join(F.broadcast(cut.withColumnRenamed("_source", "_s")), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    more = (F.col("_q") < F.col("_lo")) | F.coalesce(F.col("_q") <= F.col("_last"), F.lit(False)) | F.coalesce(F.col("_q") == F.col("_closing"), F.lit(False))
    n = (F.col("_whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).cast("long")
    return d.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source").alias(source_col), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), n.alias("copies"), (n * F.col("_size")).alias("taken"), *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def op1_pareto_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same in SQL: every source sorted by its ranks.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    (('0x' || md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, ''))[1:13])::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ss, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 2.0 * ss / w, source NULLS LAST) AS k FROM s),
p AS (SELECT *, 1.5 * sum(ss) OVER () - coalesce(sum(2.0 * ss) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws FROM o),
l AS (SELECT min(CASE WHEN rest / ws <= 2.0 * ss / w THEN k END) AS k0 FROM p),
lev AS (SELECT rest, ws, k AS k0 FROM p, l WHERE k = l.k0),
t AS (SELECT p.source, p.ss, CASE WHEN p.k < lev.k0 THEN 2.0 * p.ss ELSE lev.rest * p.w / lev.ws END::DOUBLE AS target FROM p, lev),
r AS (SELECT d.doc_id, d.size, t.ss, t.target, d.source, d.u, CASE WHEN t.ss > 0 THEN least(t.target / t.ss, 2.0) ELSE 0 END AS copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, floor(copies) AS whole, CASE WHEN size > 0 AND copies > floor(copies) THEN size ELSE 0 END AS x FROM r),
n AS (SELECT *, greatest(target - floor(copies) * ss, 0) AS need FROM f),
c AS (SELECT *, sum(x) OVER (PARTITION BY source ORDER BY u RANGE UNBOUNDED PRECEDING) AS upto FROM n),
g AS (SELECT *, need - coalesce(max(CASE WHEN upto <= need THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c),
e AS (SELECT *, min(CASE WHEN x > 0 AND upto > need AND abs(x - gap) < gap THEN {'off': abs(x - gap), 'u': u} END) OVER (PARTITION BY source) AS closing FROM g)
SELECT doc_id, size, ss AS source_size, target, ((whole + CASE WHEN x > 0 AND (upto <= need OR u = closing.u) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM e
"""
