"""Removal of byte strings that stand elsewhere, by a hash-compared suffix sort around anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, join_dealt, sent, small_arrow_batches, table
from .textkit import Powers, Prefixes, U, mix, texts

#: Bytes that an anchor's hash covers.
GRAM = 64
#: Most contexts of one anchor that one task sorts; more are told apart by the bytes next to the anchor first.
GROUP = 4096
#: Distances at a time that a crowded anchor's contexts are told apart for.
STEP = 42
#: Bytes of the digests that say two strings are equal.
DIGEST = 16


def digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=DIGEST).digest()


def anchors(raw: np.ndarray, at: np.ndarray, length: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, Prefixes]:
    """(place, hash) of the anchors. Each string of `length` bytes within a row has the GRAM bytes of least hash in it as its
    anchor, the leftmost of equals, so equal strings have equal anchors at equal distances. About 2 in length - GRAM + 2 places are anchors."""
    p = Prefixes(raw, powers)
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, U), p
    h = mix(p.sliding(GRAM))
    # 32 bits of the hash and the place, in texts of any length: which of equal hashes wins depends on their order alone
    least = (h >> U(32) << U(32)) | np.arange(len(h), dtype=U)
    width, span = length - GRAM + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    # least[i] is now of the string that starts at i; those across rows have none
    inside = np.zeros(len(raw) + 1, np.int32)
    size = np.diff(at)
    fit = size >= length
    np.add.at(inside, at[:-1][fit], 1)
    np.add.at(inside, at[1:][fit] - length + 1, -1)
    place = (least & U((1 << 32) - 1))[np.cumsum(inside)[: len(least)] > 0].astype(np.int64)
    place = place[np.flatnonzero(np.diff(place, prepend=-1))]
    return place, h[place], p


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """(key, place, gram, context) of the anchors of docs (key, text); context: a digest of the bytes around, as far as strings with that anchor reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, raw, at in texts(batch.column(1)):
                place, gram, _ = anchors(raw, at, length, powers)
                row = np.searchsorted(at, place, "right") - 1
                a, b = np.maximum(place - (length - GRAM), at[row]), np.minimum(place + length, at[row + 1])
                view = memoryview(np.ascontiguousarray(raw))
                context = [digest(left.to_bytes(4), view[x:y]) for left, x, y in zip((place - a).tolist(), a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + first)), pa.array((place - at[row]).astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(context, pa.binary())],
                    names=["key", "place", "gram", "context"],
                )

    return docs.select("key", "text").mapInArrow(run, "key binary, place int, gram long, context binary")


def context_table(docs: DataFrame, length: int) -> DataFrame:
    """(gram, key, place, left, bytes): the bytes around each anchor; docs: key, text, at (array of place, gram)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, key, place, left, around = [], [], [], [], []
            for k, text, at in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                for x in at:
                    p = x["place"]
                    a = max(0, p - (length - GRAM))
                    gram.append(x["gram"])
                    key.append(k.as_py())
                    place.append(p)
                    left.append(p - a)
                    around.append(raw[a : p + length])
                if len(gram) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(key, pa.binary()), pa.array(place, pa.int32()), pa.array(left, pa.int32()), pa.array(around, pa.binary())], names=["gram", "key", "place", "left", "bytes"])
                    gram, key, place, left, around = [], [], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(gram, pa.int64()), pa.array(key, pa.binary()), pa.array(place, pa.int32()), pa.array(left, pa.int32()), pa.array(around, pa.binary())], names=["gram", "key", "place", "left", "bytes"])

    return docs.select("key", "text", "at").mapInArrow(run, "gram long, key binary, place int, left int, bytes binary")


class Suffixes:
    """Rows of bytes, padded with zeros, in groups; size: bytes of each."""

    def __init__(self, rows: np.ndarray, size: np.ndarray, group: np.ndarray, powers: Powers) -> None:
        self.rows, self.size, self.group = rows, size, group
        n, m = rows.shape
        up, down = powers.upto(m + 1)
        self.sums = np.zeros((n, m + 1), U)
        np.cumsum((rows.astype(U) + U(1)) * up[:-1], axis=1, out=self.sums[:, 1:])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common start of rows i and j: a binary search over equal prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j]).astype(np.int64)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.sums[i, mid] == self.sums[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def before(self, i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        """Whether row i sorts before row j, in the same group; equal rows: ties."""
        c = self.common(i, j)
        si, sj = self.size[i], self.size[j]
        last = self.rows.shape[1] - 1
        a = np.where(c < si, self.rows[i, np.minimum(c, last)].astype(np.int32), -1)
        b = np.where(c < sj, self.rows[j, np.minimum(c, last)].astype(np.int32), -1)
        return (a < b) | ((a == b) & ties)

    def sort(self) -> np.ndarray:
        """Merge sort of the rows of each group, which must stand together: runs of a level merge at once, each row finding
        its place in the other run by a binary search with logarithmic comparisons."""
        n = len(self.group)
        order = np.arange(n)
        begin = np.searchsorted(self.group, self.group)
        end = np.searchsorted(self.group, self.group, "right")
        local, width = np.arange(n) - begin, 1
        while width < (end - begin).max(initial=1):
            run = local // width
            start = begin + (run ^ 1) * width  # the run to merge with
            stop = np.minimum(start + width, end)
            lone = start >= end
            lo, hi = np.where(lone, 0, start), np.where(lone, 0, stop)
            left = (run & 1) == 0
            while len(busy := np.flatnonzero(lo < hi)):
                mid = (lo[busy] + hi[busy]) >> 1
                # a row of the left run goes behind the smaller ones of the right run, one of the right run behind equal ones as well
                less = np.where(left[busy], self.before(order[mid], order[busy], False), self.before(order[mid], order[busy], True))
                lo[busy], hi[busy] = np.where(less, mid + 1, lo[busy]), np.where(less, hi[busy], mid)
            passed = np.where(lone, 0, lo - start)
            place = begin + (run >> 1) * 2 * width + (local - run * width) + passed
            merged = np.empty_like(order)
            merged[place] = order
            order, width = merged, width * 2
        return order

    def sorted_lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """(order, common length of each with the one before it, -1 at a group's start), compared byte by byte. If a
        collision of hashes has misled the sort, the bytes themselves are sorted."""
        order = self.sort()
        common = self._exact(order)
        if not self._in_order(order, common):
            order = np.lexsort([self.size, *self.rows.T[::-1], self.group])
            common = self._exact(order)
        common[np.diff(self.group[order], prepend=-1) != 0] = -1
        return order, common

    def _exact(self, order: np.ndarray) -> np.ndarray:
        out = np.zeros(len(order), np.int64)
        for a in range(1, len(order), 8192):
            x, y = self.rows[order[a - 1 : a + 8191]], self.rows[order[a : a + 8192]]
            x = x[: len(y)]
            unlike = x != y
            out[a : a + len(y)] = np.where(unlike.any(1), unlike.argmax(1), x.shape[1])
        out[1:] = np.minimum(out[1:], np.minimum(self.size[order[1:]], self.size[order[:-1]]))
        return out

    def _in_order(self, order: np.ndarray, common: np.ndarray) -> bool:
        i, j, c = order[:-1], order[1:], common[1:]
        same = self.group[i] == self.group[j]
        last = self.rows.shape[1] - 1
        a = np.where(c < self.size[i], self.rows[i, np.minimum(c, last)].astype(np.int32), -1)
        b = np.where(c < self.size[j], self.rows[j, np.minimum(c, last)].astype(np.int32), -1)
        return bool((a <= b)[same].all())


def repeated(group: np.ndarray, left: np.ndarray, around: list[bytes], length: int, powers: Powers) -> np.ndarray:
    """Of each context (rows) and each o from 0 to length - GRAM (columns) whether the string of `length` bytes that starts o
    bytes before the anchor also stands in another context of the group.

    The bytes from the anchors on and those before them, reversed, are sorted as suffixes. Contexts that share the first
    length - o bytes after the anchor are then a run of the one order, those that share o bytes before it a run of the other:
    a string stands in as many contexts as have both runs."""
    n, reach = len(left), length - GRAM
    right_size = np.minimum(np.array([len(x) for x in around]) - left, length)
    right, back = np.zeros((n, length), np.uint8), np.zeros((n, reach), np.uint8)
    for i, x in enumerate(around):
        b = np.frombuffer(x, np.uint8)
        right[i, : right_size[i]] = b[left[i] : left[i] + length]
        back[i, : left[i]] = b[: left[i]][::-1]
    r_order, r_common = Suffixes(right, right_size, group, powers).sorted_lengths()
    l_order, l_common = Suffixes(back, left, group, powers).sorted_lengths()
    out = np.zeros((n, reach + 1), bool)
    r_run, l_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(reach + 1):
        fit = np.flatnonzero((left >= o) & (right_size >= length - o))
        if len(fit) < 2:
            continue
        r_run[r_order] = np.cumsum(r_common < length - o)
        l_run[l_order] = np.cumsum(l_common < o)
        both = r_run[fit] * (n + 1) + l_run[fit]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        out[fit[order[1:][same]], o] = True
        out[fit[order[:-1][same]], o] = True
    return out


def spans_of(flags: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, byte past the last) of what the strings at the flagged distances cover."""
    edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, o1 = np.nonzero(edge == 1)
    _, o2 = np.nonzero(edge == -1)
    return row, place[row] - (o2 - 1), place[row] - o1 + length


def sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """(key, a, b) covered by strings that another context of the same anchor (gram) has, at distances of lo to hi from it; contexts are dealt by gram and sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            gram = t["gram"].to_numpy()
            group = np.cumsum(np.diff(gram, prepend=gram[0]) != 0)
            place = t["place"].to_numpy().astype(np.int64)
            flags = repeated(group, t["left"].to_numpy().astype(np.int64), t["bytes"].to_pylist(), length, powers)
            o = np.arange(flags.shape[1])
            flags &= (o >= t["lo"].to_numpy()[:, None]) & (o <= t["hi"].to_numpy()[:, None])
            row, a, b = spans_of(flags, place, length)
            return pa.RecordBatch.from_arrays([t["key"].combine_chunks().take(pa.array(row)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["key", "a", "b"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GROUP:
                t = pa.Table.from_batches(held)
                gram = t["gram"].to_numpy()
                last = int(np.argmax(gram == gram[-1]))  # the last group may go on
                if last:
                    yield solve(t.slice(0, last))
                    held, rows = t.slice(last).to_batches(), len(t) - last
        if rows:
            yield solve(pa.Table.from_batches(held))

    return contexts.select("gram", "key", "place", "left", "bytes", "lo", "hi").mapInArrow(run, "key binary, a int, b int")


def told_apart(contexts: DataFrame, length: int) -> DataFrame:
    """(g, e, key, place, lo) of the contexts of crowded anchors (gram, key, place, left, bytes), for each range of STEP distances: a string that
    starts o bytes before the anchor, lo <= o < lo + STEP, has the lo bytes before the anchor and length - lo - STEP + 1 after it in common with its
    copies. g: a digest of the anchor's and these bytes; e: one of all bytes that strings of the range have."""
    reach = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for gram, key, place, left, around in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                name = gram.to_bytes(8, signed=True)
                for lo in range(0, min(left, reach) + 1, STEP):
                    hi = min(lo + STEP - 1, reach)
                    if len(around) - left < length - hi:
                        continue
                    a, z = max(0, left - hi), left - lo + length
                    out[0].append(int.from_bytes(digest(name, lo.to_bytes(4), around[left - lo : left + length - hi])[:8], signed=True))
                    out[1].append(digest((left - a).to_bytes(4), around[a:z]))
                    out[2].append(key)
                    out[3].append(place)
                    out[4].append(lo)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["g", "e", "key", "place", "lo"])

    return contexts.select("gram", "key", "place", "left", "bytes").mapInArrow(run, "g long, e binary, key binary, place int, lo int")


def crowded_groups(contexts: DataFrame, length: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(contexts with lo and hi in smaller groups to sort, (key, a, b) covered by strings found otherwise), as remove_repeats() does with all anchors:
    in each range of distances, contexts with equal bytes are known to be repeated by their count, and one of them stands for them."""
    reach = length - GRAM
    apart = table(told_apart(contexts, length), "apart")
    per = table(apart.groupBy("g", "lo", "e").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one")), "per")
    hi = F.least(F.col("lo") + (STEP - 1), F.lit(reach))
    whole = join_dealt(apart.select("g", "e", "key", "place", "lo"), per.where("n > 1").select("g", "e", "n"), ["g", "e"], "n")
    whole = whole.select("key", F.greatest(F.col("place") - hi, F.lit(0)).alias("a"), (F.col("place") - F.col("lo") + length).alias("b"))
    kinds = per.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = table(per.join(kinds, "g").select("g", "kinds", "lo", hi.alias("hi"), "one.key", "one.place"), "open")
    around = contexts.select("key", "place", "left", "bytes").join(sent(open_), ["key", "place"]).withColumnRenamed("g", "gram")
    few = around.where(F.col("kinds") <= group)
    return few.select("gram", "key", "place", "left", "bytes", "lo", "hi"), whole.union(counted_windows(around.where(F.col("kinds") > group), length))


def counted_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(key, a, b) covered by strings that stand at two places, for groups of contexts that are too large for one task even within a range of distances: each
    string at a distance of lo to hi is counted by a digest of its bytes, which needs no task to hold a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, place, left, around, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                starts = [s for s in range(max(0, left - hi), left - lo + 1) if s + length <= len(around)]
                a = [place - left + s for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(starts), pa.binary()), pa.array(a, pa.int32()), pa.array([digest(around[s : s + length]) for s in starts], pa.binary())], names=["key", "a", "h"])

    w = table(contexts.select("key", "place", "left", "bytes", "lo", "hi").mapInArrow(run, "key binary, a int, h binary"), "windows")
    # contexts of two anchors may hold one string of a text: only different places count
    at = F.struct("key", "a")
    more = table(w.groupBy("h").agg(F.min(at).alias("x"), F.max(at).alias("y"), F.count("*").alias("n")).where("x != y").select("h", "n"), "more")
    return join_dealt(w, more, ["h"], "n").select("key", "a", (F.col("a") + length).alias("b"))


def cut_out(docs: DataFrame) -> DataFrame:
    """(key, n_removed, n_spans, kept) of docs (key, text, spans): kept is what is left of the text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = text.as_py().encode()
                gone = np.zeros(len(raw) + 2, np.int64)
                for s in found:
                    gone[s["a"] + 1] += 1
                    gone[min(s["b"], len(raw)) + 1] -= 1
                out = np.cumsum(gone)[1:-1] > 0
                removed.append(int(out.sum()))
                spans.append(int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)))
                kept.append(np.frombuffer(raw, np.uint8)[~out].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["key", "n_removed", "n_spans", "kept"])

    return docs.select("key", "text", "spans").mapInArrow(run, "key binary, n_removed long, n_spans long, kept binary")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, group: int = GROUP) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary): every byte covered by a string of `length` bytes
    that starts anywhere else in the corpus too, in the same text included, is removed. Matches never cross texts.

    1. Equal texts are found by digest: all of a text that has a copy is removed, and one copy stands for the others below.
    2. Each string has an anchor in it, one place in some 170. Anchors are grouped by hash with counts only; those that stand
       alone are dropped, and contexts that are equal as far as strings reach are known to be repeated from their count alone.
    3. What is left, contexts that share an anchor but differ at some distance, is sorted in one task for each anchor: see
       repeated(). An anchor with over `group` such contexts is dealt into groups that share the bytes next to it as well, by
       ranges of distances: see crowded_groups(). One of these that is still over `group` is counted string by string, which needs no task to hold it.
    The sort verifies its order and its common lengths on the bytes, so hashes decide nothing there. Where bytes do not meet in a
    task (equal texts, equal contexts, counted strings), equal means an equal cryptographic digest of the bytes, 128 bits.

    Null texts count as empty; texts under `length` bytes keep all. Rows that repeat id and text have copies like any others, and ties
    have no order: every copy of a string is removed. Other columns of docs are not read, whatever their names.
    """
    if length <= GRAM:
        raise ValueError(f"length must be over {GRAM}")
    small_arrow_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.substring(F.unhex(F.sha2(text, 256)), 1, DIGEST).alias("key"), text.alias("text"))
    long_ = d.where(F.octet_length("text") >= length)
    copies = table(long_.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1").select("key"), "copies")
    # copies of a text give equal rows of anchors; only their number differs
    found = table(anchor_table(long_, length), "anchors")
    per = found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "place")).alias("one"))
    per = table(per, "contexts")
    grams = per.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").withColumn("times", F.col("kinds"))
    grams = table(grams, "grams")
    equal = per.where("n > 1").select("gram", "context", "n")
    reach = length - GRAM
    whole = join_dealt(found, equal, ["gram", "context"], "n").join(copies, "key", "left_anti")
    whole = table(whole.select("key", F.greatest(F.col("place") - reach, F.lit(0)).alias("a"), (F.col("place") + length).alias("b")), "whole")
    drop(found)
    open_ = table(join_dealt(per, grams, ["gram"], "times").select("gram", "one.key", "one.place"), "open")
    drop(per)
    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("place", "gram")).alias("at"))
    one = long_.select("key", "text").join(wanted, "key").dropDuplicates(["key"])
    around = context_table(one, length)
    around = table(around, "around")
    crowded = table(grams.where(F.col("kinds") > group).select("gram"), "crowded")
    near = around.join(sent(crowded), "gram", "left_anti").withColumns({"lo": F.lit(0), "hi": F.lit(reach)})
    if not crowded.isEmpty():
        few, many = crowded_groups(around.join(sent(crowded), "gram"), length, group)
        near = near.unionByName(few)
    else:
        many = None
    spans = sorted_groups(near.repartition("gram").sortWithinPartitions("gram", "key", "place"), length)
    spans = spans.union(many) if many is not None else spans
    spans = table(spans.union(whole).groupBy("key").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    drop(around)
    own = long_.select("key", "text").join(copies, "key", "left_anti").join(spans, "key")
    cut = cut_out(own)
    out = d.join(cut, "key", "left").join(copies.withColumn("copied", F.lit(True)), "key", "left")
    size = F.octet_length("text").cast("long")
    return out.select(
        F.col("id").alias(id_col), size.alias("n_bytes"),
        F.when(F.col("copied"), size).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(F.col("copied"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copied"), F.lit(b"")).otherwise(F.coalesce("kept", F.encode("text", "UTF-8"))).alias("kept"),
    )


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
