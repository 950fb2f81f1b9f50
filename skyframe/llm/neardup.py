"""Near-duplicate documents by DartMinHash signatures of their weighted word shingles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import drop, sent, small_arrow_batches, table
from .textkit import LOWER, Powers, Prefixes, U, mix, shingles, texts, unit, words

N = 5
#: Bands and rows of a band. A pair of similarity 0.8 meets in some band with probability 0.9996, one of 0.3 with 0.05.
BANDS, ROWS = 20, 5
#: How many documents of a bucket, and elements of them, are compared with each other at once.
BLOCK, ELEMENTS = 1024, 1 << 21
#: Neighbours that a document names in a bucket.
NAMED = 3
#: How far under the similarity the share of equal numbers of two signatures may be for a text to be named: six standard deviations or more.
SLACK = 0.3
KEY = 16  # bytes of a text's key; a signature's name has one more: 0 of the weighted one, 1 of that of the plain set


def weighted(raw: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, row, times before) of the shingles of N lower-cased words (A-Z), one element for each time that a shingle stands in a row:
    the c-th time of a shingle is the strip of weight from c-1 to c."""
    s, e, rows = words(raw, at)
    h = mix(Prefixes(LOWER[raw], powers).of(s, e) + (e - s).astype(U))
    g, of, _ = shingles(h, rows, len(at) - 1, N, powers)
    key = mix(g + of.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(new)
    nth = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    return mix(g[order] + nth.astype(U) * U(0xA0761D6478BD642F)), of[order], nth


def darts(element: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """Signatures of k numbers a row, n_rows x k; two rows agree in one with the probability of their weighted Jaccard
    similarity. Rows without elements get zeros.

    Each strip of weight 1 of an element is a region into which darts fall in a Poisson process along the axis of ranks, all
    drawn from the element's hash, so that equal strips get equal darts in every document. A dart also draws one of k
    coordinates; each coordinate keeps its earliest dart. A row with n strips needs darts up to rank t/n only, t = k (ln k + 4):
    some 900, whatever its length; the few rows that leave a coordinate empty go on to twice the rank, and again.
    """
    best = np.full(n_rows * k, np.iinfo(np.uint64).max, U)
    n = np.bincount(row, minlength=n_rows)
    limit = k * (math.log(k) + 4) / np.maximum(n, 1)
    live = np.arange(len(element))
    while len(live):
        e, r = element[live], row[live]
        rank, state, most = np.zeros(len(live)), e, limit[r]
        while len(rank):
            state = mix(state + U(0x9E3779B97F4A7C15))
            rank = rank - np.log(unit(state))
            hit = rank < most
            rank, state, most, r = rank[hit], state[hit], most[hit], r[hit]
            mark = mix(state ^ U(0x2545F4914F6CDD1D))
            coordinate = ((mark >> U(32)) * U(k) >> U(32)).astype(np.int64)
            # a float's bits are in the order of its value: the earliest dart is the least number
            packed = (rank.astype(np.float32).view(np.uint32).astype(U) << U(32)) | (mark & U(0xFFFFFFFF))
            np.minimum.at(best, r * k + coordinate, packed)
        empty = (best.reshape(n_rows, k) == np.iinfo(np.uint64).max).any(1) & (n > 0)
        limit = limit * 2
        live = np.flatnonzero(empty[row])
    out = (best & U(0xFFFFFFFF)).astype(np.uint32).reshape(n_rows, k)
    out[n == 0] = 0
    return out


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(node, sig) of the texts with a word: k numbers of 32 bits. docs: key, text. node: the key and one byte. A text that
    repeats a shingle has two signatures, one with weights and one of its plain set; for the others they are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for first, raw, at in texts(batch.column(1)):
                element, row, nth = weighted(raw, at, powers)
                n_rows = len(at) - 1
                some = np.flatnonzero(np.bincount(row, minlength=n_rows))
                sig = darts(element, row, n_rows, k)
                nodes, sigs = [keys[first + i] + b"\0" for i in some], [sig[i].tobytes() for i in some]
                twice = np.unique(row[nth > 0])
                if len(twice):
                    once = (nth == 0) & np.isin(row, twice)
                    plain = darts(element[once], np.searchsorted(twice, row[once]), len(twice), k)
                    nodes += [keys[first + i] + b"\1" for i in twice]
                    sigs += [x.tobytes() for x in plain]
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sigs, pa.binary())], names=["node", "sig"])

    return docs.select("key", "text").mapInArrow(run, "node binary, sig binary")


def key_of(node: str) -> Column:
    return F.substring(node, 1, KEY)


def band_table(sigs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(band, bucket, node): a bucket is the hash of a band's number and its rows."""
    width = 4 * rows
    each = [F.xxhash64(F.lit(b), F.substring("sig", b * width + 1, width)) for b in range(bands)]
    return sigs.select(F.posexplode(F.array(*each)).alias("band", "bucket"), "node")


def elements(docs: DataFrame) -> DataFrame:
    """(key, n, once, more): the sorted numbers of 32 bits of a text's shingles and of their repetitions, n of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for first, raw, at in texts(batch.column(1)):
                element, row, nth = weighted(raw, at, powers)
                order = np.lexsort((element, row))
                element, row, nth = (element[order] >> U(32)).astype(np.uint32), row[order], nth[order]
                cut = np.searchsorted(row, np.arange(len(at)))
                once, more = [], []
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    e, new = element[a:b], nth[a:b] == 0
                    once.append(e[new].tobytes())
                    more.append(e[~new].tobytes())
                keys = batch.column(0).slice(first, len(at) - 1)
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.diff(cut)), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["key", "n", "once", "more"])

    return docs.select("key", "text").mapInArrow(run, "key binary, n long, once binary, more binary")


def rest(members: DataFrame, classes: DataFrame, texts_of, sigs: DataFrame, bands: int, rows: int, similarity: float) -> DataFrame:
    """(u, v): every pair of texts of one bucket that are in different classes so far and whose elements are similar. Only these
    pairs are made. members: band, bucket, node. texts_of: gives (key, text) of a table of keys.

    A bucket whose texts are all of one class has nothing to add. The others' texts are compared in full: all pairs of a cell of at most
    two blocks, a block having about BLOCK texts and ELEMENTS elements. A pair is compared in the first band that it shares.
    """
    k = bands * rows
    members = members.withColumn("key", key_of("node"))
    classes = classes.withColumnRenamed("node", "_node")
    of = members.join(classes, members["key"] == classes["_node"], "left").select("band", "bucket", "node", "key", F.coalesce("component", "key").alias("c"))
    mixed = of.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("bucket")
    of = table(of.join(mixed, "bucket"), "mixed")
    keys = table(of.select("key").distinct(), "mixed_keys")
    parts = elements(texts_of(keys)).join(sigs.withColumn("key", key_of("node")), "key")
    parts = table(parts, "elements")
    of = of.drop("key").join(parts.select("node", "n"), "node")
    blocks = of.groupBy("bucket").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / ELEMENTS)).cast("int").alias("g"))
    dealt = of.join(blocks, "bucket").withColumn("h", F.pmod(F.xxhash64("node", "bucket"), F.col("g")).cast("int"))
    cells = dealt.select("band", "bucket", "node", "c", "h", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    cells = cells.select("band", "bucket", F.least("h", "o").alias("a"), F.greatest("h", "o").alias("b"), "h", "node", "c").join(parts, "node")
    cells = cells.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = list(zip(*(batch[x].to_pylist() for x in ("bucket", "a", "b")), strict=True))
            start = 0
            for i, name in enumerate(names):
                if name != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield pa.Table.from_batches(held)
                    held, start, last = [], i, name
            if start < len(names):
                held.append(batch.slice(start))
        if held:
            yield pa.Table.from_batches(held)

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        each = [np.frombuffer(x, np.uint32) for x in column.to_pylist()]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])

    def shared(numbers: np.ndarray, at: np.ndarray, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers that i and each other have in common, numbers of the other)."""
        mine, size = numbers[at[i] : at[i + 1]], at[others + 1] - at[others]
        if not len(mine):
            return np.zeros(len(others), np.int64), size
        ends = np.cumsum(size)
        which = np.repeat(np.arange(len(others)), size)
        theirs = numbers[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[others] - ends + size, size)]
        hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
        return np.bincount(which[hit], minlength=len(others)), size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # numbers of 32 bits may fall together: what is near the border is verified later
        least, border = similarity - SLACK, similarity - 0.01
        for t in groups(batches):
            if len(t) < 2 or len(t["c"].unique()) < 2:
                continue
            keys, side = t["key"].combine_chunks(), t["h"].to_numpy()
            two = t["a"][0].as_py() != t["b"][0].as_py()
            band = t["band"][0].as_py()
            c = t["c"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(len(t), k)
            (once, at), (more, at2) = flat(t["once"]), flat(t["more"])
            n = t["n"].to_numpy()
            n1 = np.diff(at)
            us, vs = [], []
            for i in range(1, len(t)):
                want = c[:i] != c[i]
                if two:
                    want &= side[:i] != side[i]
                for m in (n, n1):  # lengths alone rule most out
                    near = np.minimum(m[:i], m[i]) >= border * np.maximum(m[:i], m[i])
                    ok = near if m is n else ok | near
                j = np.flatnonzero(want & ok)
                if not len(j):
                    continue
                same = sig[j] == sig[i]
                j = j[(same.mean(1) >= least) & (same.reshape(len(j), bands, rows).all(2).argmax(1) == band)]
                if not len(j):
                    continue
                (x, nx), (y, _) = shared(once, at, i, j), shared(more, at2, i, j)
                plain, full = x / (nx + n1[i] - x), (x + y) / (n[j] + n[i] - x - y)
                j = j[np.maximum(plain, full) >= border]
                us.append(np.full(len(j), i))
                vs.append(j)
            if us:
                u, v = (keys.take(pa.array(np.concatenate(x))) for x in (us, vs))
                yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    cells = cells.select("band", "bucket", "a", "b", "h", "key", "c", "n", "once", "more", "sig")
    return cells.mapInArrow(run, "u binary, v binary")


def candidates(members: DataFrame, k: int, least: float) -> DataFrame:
    """(u, v) to verify: in each block of a bucket each document names, among those that are more central, the NAMED whose
    signatures agree most with its own, in share `least` or more. members: bucket, block, node, centre, sig; u and v are keys of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def named(t: pa.Table) -> pa.RecordBatch:
            keys = pa.array([x[:KEY] for x in t["node"].to_pylist()], pa.binary())
            text = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(t), k)
            group = t["bucket"].to_numpy().astype(np.int64) * 31 + t["block"].to_numpy()
            bound = np.flatnonzero(np.diff(group, prepend=group[0] - 1, append=group[-1] + 1))
            us, vs = [], []
            for a, b in zip(bound[:-1], bound[1:], strict=True):
                for i in range(a + 1, b):
                    same = np.where(text[a:i] == text[i], -1, (sig[a:i] == sig[i]).mean(1))
                    top = np.argpartition(-same, NAMED - 1)[:NAMED] if i - a > NAMED else np.arange(i - a)
                    top = top[same[top] >= least]
                    us += [i] * len(top)
                    vs += list(top + a)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(us, pa.int64())), keys.take(pa.array(vs, pa.int64()))], names=["u", "v"])

        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows < 8 * BLOCK:
                continue
            t = pa.concat_tables(held)
            g = t["bucket"].to_numpy()
            h = t["block"].to_numpy()
            last = len(g) - int(np.argmin(((g == g[-1]) & (h == h[-1]))[::-1]))  # a group that may go on stays
            if last and last < len(g):
                yield named(t.slice(0, last))
                held, rows = [t.slice(last)], len(g) - last
        if rows:
            yield named(pa.concat_tables(held))

    return members.select("bucket", "block", "node", "sig").mapInArrow(run, "u binary, v binary")


def similar(pairs: DataFrame, least: float) -> DataFrame:
    """Of pairs (u, v, tu, tv) those whose texts' shingles have a Jaccard similarity of `least` or more, counted exactly, either with
    their weights or as plain sets: a passage that one text repeats more often does not part it from the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            got = [(e, r + first, n) for first, raw, at in texts(column) for e, r, n in [weighted(raw, at, powers)]]
            return tuple(np.concatenate([x[k] for x in got]) for k in range(3))

        def share(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, n: int) -> np.ndarray:
            rows = np.concatenate([ra, rb])
            both = mix(np.concatenate([a, b]) + rows.astype(U) * U(0xD6E8FEB86659FD93))
            order = np.argsort(both)
            shared = np.bincount(rows[order[1:]][both[order[1:]] == both[order[:-1]]], minlength=n)
            return shared / np.maximum(np.bincount(rows, minlength=n) - shared, 1)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            (a, ra, na), (b, rb, nb) = of(batch.column(2)), of(batch.column(3))
            got = np.maximum(share(a, ra, b, rb, n), share(a[na == 0], ra[na == 0], b[nb == 0], rb[nb == 0], n))
            good = got >= least - 1e-9
            take = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(got[good])], names=["u", "v", "similarity"])

    return pairs.select("u", "v", "tu", "tv").mapInArrow(run, "u binary, v binary, similarity double")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: id, class_id (the least id of its class), class_size, similar_to_any, is_kept (one row of each class).

    Texts are near duplicates if their shingles' weighted similarity, or that of their plain sets, is `similarity` or more. Texts of
    equal bytes are one text from the start. Each gets a weighted signature, and one of its plain set if it repeats a shingle; texts that
    agree in a band of any of these share a bucket. In a bucket each text names the most similar by signature of those more central than itself, a text's centre
    being the sizes of its buckets: in a family of copies the original comes first. What is named is verified on whole texts,
    and the connected components of verified pairs are the first classes. So a bucket of m texts names 3m pairs at most. A bucket
    over BLOCK texts is dealt into blocks by hash, anew in every band, each with the bucket's most central text. Then
    every pair of a bucket that is still in different classes is compared (see rest()), so that naming few loses no link.

    Null texts and texts without a word are classes of their own, one for each row. A text under 5 words is one shingle.
    Null ids: class_id is the least id that is not null, or null. Rows that repeat id and text
    are one document with one result: is_kept is true for all of them or none. Ties of centre are settled by the texts' keys. Only the id
    and the text of docs are read, whatever its other columns are called.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    k = bands * rows
    has = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    key = F.when(has, F.unhex(F.md5(F.col(text_col))))
    d = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("text"))
    ids = table(d.select("_id", "_key"), "ids")
    # the text with the least id stands for its copies
    rep = ids.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"))
    rep = table(rep, "texts")
    # signatures are shorter than texts: all rows get one where they are read, and copies go after that
    raw_sigs = sigs = table(signatures(d.where("_key is not null").select(F.col("_key").alias("key"), "text"), k), "signatures")
    twice = table(rep.where("copies > 1").select("_key"), "twice")
    sigs = sigs.withColumn("_key", key_of("node"))
    sigs = sigs.join(sent(twice), "_key", "left_anti").drop("_key").union(sigs.join(sent(twice), "_key", "left_semi").groupBy("node").agg(F.min("sig").alias("sig")))
    band = band_table(sigs, bands, rows)
    # buckets of one text alone go
    of_text = F.xxhash64(key_of("node"))
    sizes = band.groupBy("bucket").agg(F.count("*").alias("size"), F.min(of_text).alias("lo"), F.max(of_text).alias("hi")).where("lo != hi").select("bucket", "size")
    raw_member = member = table(band.join(sizes, "bucket"), "members")
    centre = member.groupBy("node").agg(F.sum(F.log2(F.col("size").cast("double"))).alias("centre"))
    # 8 bits of each number are enough to compare signatures
    bytes_ = F.concat(*[F.substring("sig", 4 * i + 1, 1) for i in range(k)])
    small = centre.join(sigs, "node").select("node", "centre", bytes_.alias("sig"))
    member = member.join(small, "node")
    block = F.when(F.col("size") > BLOCK, F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("size") / (BLOCK // 2)))).otherwise(0).cast("int")
    dealt = member.withColumn("block", block)
    head = member.where(F.col("size") > BLOCK).groupBy("bucket").agg(F.max_by(F.struct("node", "centre", "sig", "size"), F.struct("centre", "node")).alias("h"))
    more = head.select("bucket", "h.*", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("h.size") / (BLOCK // 2)) - 1).cast("int"))).alias("block"))
    cols = ["bucket", "block", "node", "centre", "sig"]
    dealt = dealt.select(cols).union(more.select(cols)).repartition("bucket", "block").sortWithinPartitions("bucket", "block", F.desc("centre"), "node")
    named = candidates(dealt, k, similarity - SLACK).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    named = table(named, "pairs")

    def texts_of(keys: DataFrame) -> DataFrame:
        # while keys are few, they are sent to where the texts are read, else both are shuffled
        return d.select(F.col("_key").alias("key"), "text").join(sent(keys), "key", "left_semi").dropDuplicates(["key"])

    def verified(named: DataFrame) -> DataFrame:
        wanted = table(named.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "wanted")
        both = table(texts_of(wanted), "verify")
        side = lambda c, t: both.select(F.col("key").alias(c), F.col("text").alias(t))
        links = table(similar(named.join(side("u", "tu"), "u").join(side("v", "tv"), "v"), similarity), "links")
        drop(named)
        drop(both)
        return links

    links = verified(named)
    classes = table(components(links), "classes")
    left = table(rest(raw_member, classes, texts_of, sigs, bands, rows, similarity), "rest")
    if not left.isEmpty():
        left = table(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "rest_pairs")
        classes = table(components(links.union(verified(left))), "classes")
    drop(raw_sigs)
    drop(raw_member)
    of = rep.join(classes, rep["_key"] == classes["node"], "left").select(rep["_key"].alias("k"), F.coalesce("component", rep["_key"]).alias("c"), "rep", "copies")
    of = table(of, "membership")
    total = of.groupBy("c").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("rep").isNull().alias("x"), "rep", "k")).alias("best"))
    named_class = of.join(total, "c").select("k", "class_id", "class_size", (F.col("k") == F.col("best.k")).alias("best"))
    out = ids.join(named_class, F.col("_key") == F.col("k"), "left")
    return out.select(
        F.col("_id").alias(id_col), F.when(F.col("k").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.coalesce("class_size", F.lit(1)) > 1).alias("similar_to_any"),
        (F.col("k").isNull() | (F.col("best") & F.col("_id").eqNullSafe(F.col("class_id")))).alias("is_kept"), F.col("_key").alias("text_key"),
    )


def op3_near_duplicates(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", "class_size", "is_kept")
