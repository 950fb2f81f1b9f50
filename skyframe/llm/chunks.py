"""Substring dedup by content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, join_dealt, kept_apart, sent, small_arrow_batches, table
from .textkit import Powers, Prefixes, U, mix, texts, words

#: Bytes that the rolling hash at a place depends on, words on either side of a cut without another, words of the longest chunk.
GEAR_BYTES, RADIUS, MOST_WORDS = 16, 3, 64


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: h = 2h + G[byte], over the last GEAR_BYTES bytes. Doubling the span log2 times replaces the loop."""
    h = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))[raw]
    span = 1
    while span < GEAR_BYTES:
        h[span:] += h[:-span] << U(span)  # numpy reads the old values: the operand is a new array
        span *= 2
    return mix(h)


def cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte past the last, row) of each chunk of words. A chunk starts at a word where the hash of what
    stands before is the least among the RADIUS words before and after it (first of equals), at a row's first word, and
    after MOST_WORDS words; never in a row's first GEAR_BYTES bytes. So cuts depend on text nearby alone, and text put in elsewhere does not move them."""
    starts, ends, rows = words(raw, at)
    n = len(starts)
    if not n:
        return starts, ends, rows
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    h = gear(raw)[np.maximum(starts - 1, 0)]
    h[starts - at[rows] < GEAR_BYTES] = np.iinfo(np.uint64).max  # the hash would reach into the row before
    least = np.ones(n, bool)
    for d in range(1, RADIUS + 1):
        other = rows[d:] != rows[:-d]
        least[d:] &= (h[d:] < h[:-d]) | other
        least[:-d] &= (h[:-d] <= h[d:]) | other
    begin = np.flatnonzero(least | first)
    gap = np.diff(np.append(begin, n))
    if (gap > MOST_WORDS).any():  # cut what is too long into even steps from its start
        times = -(-gap // MOST_WORDS)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin = np.repeat(begin, times) + step * MOST_WORDS
    return starts[begin], np.append(ends[begin[1:] - 1], ends[-1]), rows[begin]


def chunk_table(docs: DataFrame) -> DataFrame:
    """(k, l, n, w, a, b) of each chunk: 96 bits of its text's key, its number in the text, its words, and a digest of 96
    bits. docs: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), ">i8,>i4,>i4")
            for first, raw, at in texts(batch.column(1)):
                s, e, rows = cut(raw, at)
                p, q = Prefixes(raw, powers), Prefixes(mix(raw.astype(U) + U(1)), powers)
                size = (e - s).astype(U)
                a, b = mix(p.of(s, e) ^ mix(size)), mix(q.of(s, e) + size)
                n = np.arange(len(s)) - np.searchsorted(rows, rows)
                starts, _, _ = words(raw, at)
                w = np.diff(np.searchsorted(starts, np.append(s, len(raw))))
                k = keys[rows + first]
                arrays = (k["f0"].astype(np.int64), k["f1"].astype(np.int32), n.astype(np.int32), w.astype(np.int8), a.view(np.int64), (b >> U(32)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k", "l", "n", "w", "a", "b"])

    return docs.select("key", "text").mapInArrow(run, "k long, l int, n int, w byte, a long, b int")


def removed_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """Adds kept_text and n_removed (words) to key, dup, text; dup holds the numbers of the chunks that stand elsewhere before, or is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, removed = [None] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for first, raw, at in texts(batch.column(2)):
                s, e, rows = cut(raw, at)
                starts, _, _ = words(raw, at)
                upto = np.searchsorted(starts, np.append(s, len(raw)))
                lo = np.searchsorted(rows, np.arange(len(at)))
                for i in range(len(at) - 1):
                    text = raw[at[i] : at[i + 1]].tobytes()
                    dup = np.zeros(lo[i + 1] - lo[i] + 2, np.int8)
                    dup[np.asarray(batch.column(1)[first + i].as_py() or [], np.int64) + 1] = 1
                    edge = np.diff(dup)
                    left = []
                    place = 0
                    for x, y in zip(np.flatnonzero(edge == 1) + lo[i], np.flatnonzero(edge == -1) + lo[i], strict=True):
                        if (n := int(upto[y] - upto[x])) >= min_words:
                            left.append(text[place : s[x] - at[i]])
                            # what follows the run starts at the next chunk, or there is nothing but white space
                            place = int(s[y] - at[i]) if y < lo[i + 1] else len(text)
                            removed[first + i] += n
                    out[first + i] = b"".join([*left, text[place:]]).decode()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(removed)], names=["key", "kept_text", "n_removed"])

    return docs.select("key", "dup", "text").mapInArrow(run, "key binary, kept_text string, n_removed long")


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 16) -> DataFrame:
    """All columns of docs and _kept_text, _n_removed (columns of docs so named get an underscore behind them): passages that stand earlier in the corpus are cut out of each text.

    Texts are cut into chunks of 4 to 64 words, 7 on average, where a gear rolling hash says. A chunk is a repeat unless it is
    the first with its digest, in order of the texts' own digests and of place. Maximal runs of repeats of min_words words
    or more are removed. Chunks at the edges of a passage may survive; a run of 50 repeated words loses its inside.

    Equal texts count as one: the copy with the least id is kept like any text and the others are removed whole if they
    have min_words words. Rows that repeat id and text share one result. Ids are of any type with an order; null ids come last. Null texts
    stay null, empty ones empty. A tie, a digest that stands twice, is settled by the texts' digests and places alone, so reruns agree.

    Only digests, 96 bits for a chunk and for a text, are shuffled; a digest's first place is found with a minimum on the map side
    and its repeats are dealt by the skew join of adaptive execution. Texts are joined to what is small while it is: copies are
    left out and repeats looked up where texts are read; see store.sent().
    """
    small_arrow_batches(docs.sparkSession)
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    docs = kept_apart(docs, ["_kept_text", "_n_removed"])
    id_col, text_col = docs.columns[id_at], docs.columns[text_at]
    # columns of docs travel as one struct, so that none of their names is met here
    d = docs.select(F.struct(*docs.columns).alias("_doc"), F.unhex(F.md5(F.col(text_col))).alias("_key"), F.struct(F.col(id_col).isNull().alias("x"), F.col(id_col).alias("id")).alias("_order"))
    text = F.col("_doc")[text_col]
    copied = d.where("_key is not null").groupBy("_key").agg(F.min("_order").alias("_owner"), F.count("*").alias("n")).where("n > 1").select("_key", "_owner")
    copied = table(copied, "copies")
    owned = d.join(sent(copied), "_key", "left")
    # all copies but the owner's are left out; of rows that repeat id and text each is cut, and the chunks are counted by place
    mine = owned.where(F.col("_key").isNotNull() & (F.col("_owner").isNull() | F.col("_owner").eqNullSafe(F.col("_order")))).select(F.col("_key").alias("key"), text.alias("text"))
    chunks = table(chunk_table(mine), "chunks")
    place = F.struct("k", "l", "n")
    first = chunks.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = table(first, "first")
    again = join_dealt(chunks, first, ["a", "b"], "times").where(place != F.col("first"))
    marks = again.groupBy("k", "l").agg(F.collect_set(F.struct("n", "w")).alias("x"))
    enough = F.aggregate("x", F.lit(0), lambda s, y: s + y["w"]) >= min_words
    marks = table(marks.where(enough).select("k", "l", F.transform("x", lambda y: y["n"]).alias("dup")), "repeats")
    drop(chunks)
    hex_ = F.hex("key")
    k = F.conv(F.substring(hex_, 1, 16), 16, -10).cast("long")
    half = F.conv(F.substring(hex_, 17, 8), 16, 10).cast("long")
    low = F.when(half >= 1 << 31, half - (1 << 32)).otherwise(half).cast("int")
    own = mine.withColumns({"k": k, "l": low}).join(sent(marks), ["k", "l"])
    own = table(removed_runs(own.select("key", "dup", "text"), min_words).where("n_removed > 0"), "kept").dropDuplicates(["key"]).withColumnRenamed("key", "_key")
    changed = sent(table(own.select("_key"), "changed"))
    # of a group of copies only the owner's rows need what is kept, so a large group does not meet in one task
    is_copy = F.col("_owner").isNotNull() & ~F.col("_order").eqNullSafe(F.col("_owner"))
    owned = owned.withColumn("_copy", is_copy)
    left = changed.withColumnRenamed("_key", "_changed")
    same = owned.join(left, (F.col("_key") == F.col("_changed")) & ~F.col("_copy"), "left_anti").withColumns({"kept_text": F.lit(None).cast("string"), "n_removed": F.lit(None).cast("long")})
    d = owned.where("not _copy").join(changed, "_key", "left_semi").join(own, "_key").unionByName(same)
    size = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    copy = F.col("_copy") & F.coalesce(size >= min_words, F.lit(False))
    kept = F.when(copy, F.lit("")).otherwise(F.coalesce("kept_text", text))
    gone = F.when(copy, size.cast("long")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return d.select("_doc.*", kept.alias("_kept_text"), gone.alias("_n_removed"))


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = substring_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_removed").alias("n_words_removed"), F.sha2("_kept_text", 256).alias("kept_sha256"))
