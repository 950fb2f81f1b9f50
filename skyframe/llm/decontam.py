"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept_apart, small_arrow_batches
from .textkit import LOWER, Powers, Prefixes, U, mix, texts, words

N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items that one scan looks for. More are looked for in further scans.
ITEMS = 20_000
#: Pairs of a seed and a place, and words of passages, that are held at a time, or one text's or one passage's.
PAIRS, WORDS = 1 << 21, 1 << 20


def hashed_words(raw: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of words, A-Z lower-cased, without punctuation at their ends."""
    raw = LOWER[raw]
    s, e, rows = words(raw, at)
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in ".,;:!?\"'()[]"]] = True
    for _ in range(2):
        e = e - (mark[raw[e - 1]] & (e - s > 1))
        s = s + (mark[raw[s]] & (e - s > 1))
    return mix(Prefixes(raw, powers).of(s, e) + (e - s).astype(U)), rows


def align(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best score, column past its end) of local alignments of rows of codes. Padding: -1 in items, -2 in passages.

    A row of the score matrix for all pairs at once; gaps within the row are a running maximum."""
    b, m = passage.shape
    h = np.zeros((b, m + 1), np.int32)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    best, end = np.zeros(b, np.int32), np.zeros(b, np.int64)
    for i in range(item.shape[1]):
        fit = np.where(passage == item[:, i : i + 1], MATCH, MISMATCH).astype(np.int32)
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(np.maximum(h[:, :-1] + fit, h[:, 1:] + GAP), 0)
        new = np.maximum.accumulate(new + slope, axis=1) - slope
        new[item[:, i] == -1] = 0
        top = new.argmax(1)
        score = new[np.arange(b), top]
        better = score > best
        best, end = np.where(better, score, best), np.where(better, top, end)
        h = new
    return best, end


class Items:
    """Test items as word hashes, and where each n-gram stands in them."""

    def __init__(self, rows: list[tuple[object, str]]) -> None:
        powers = Powers()
        self.ids = [r[0] for r in rows]
        h, of = np.zeros(0, U), np.zeros(0, np.int64)
        for first, raw, at in texts(pa.array([r[1] or "" for r in rows], pa.string())):
            a, b = hashed_words(raw, at, powers)
            h, of = np.concatenate([h, a]), np.concatenate([of, b + first])
        self.length = np.bincount(of, minlength=len(rows))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.words = h
        self.grams, self.at = grams(h, of, powers)
        self.item = of[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.offset = self.at - self.start[self.item]
        self.keys = np.unique(self.grams)

        # a word of an item as one number, and how often the item has it
        self.pairs, self.times = np.unique(paired(h, of), return_counts=True)

    def rare(self, count: np.ndarray, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the n-grams that the corpus has, which of them are rare: the rarest share of each item's, `least` at the fewest)."""
        c = count[np.searchsorted(self.keys, self.grams)]
        there = np.flatnonzero(c)
        there = there[np.lexsort((self.offset[there], c[there], self.item[there]))]
        item = self.item[there]
        n = np.bincount(item, minlength=len(self.ids))
        return there, np.arange(len(there)) - np.searchsorted(item, item) < np.maximum(np.ceil(n * share), least)[item]


def paired(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(item.astype(U) + U(1)))


def in_common(h: np.ndarray, lo: np.ndarray, hi: np.ndarray, item: np.ndarray, pairs: np.ndarray, times: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """How many words the passages h[lo:hi] have in common with their items, each as often as both have it."""
    out, a = np.zeros(len(lo), np.int64), 0
    past = np.cumsum(hi - lo)
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(past, past[a] - (hi[a] - lo[a]) + WORDS, "right")))
        size = hi[a:b] - lo[a:b]
        of = np.repeat(np.arange(b - a), size)
        x = paired(h[np.arange(len(of)) + np.repeat(lo[a:b] - np.cumsum(size) + size, size)], item[a:b][of])
        k = among(x, pairs, bits)
        both, n = np.unique(of[k] * len(pairs) + np.searchsorted(pairs, x[k]), return_counts=True)
        out[a:b] = np.bincount(both // len(pairs), np.minimum(n, times[both % len(pairs)]), b - a)
        a = b
    return out


def grams(h: np.ndarray, rows: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    if len(h) < N:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[: len(rows) - N + 1] == rows[N - 1 :])
    return mix(Prefixes(h, powers).sliding(N)[at] + U(N)), at


def among(x: np.ndarray, keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places in x of values among the sorted keys; table: a bit for the upper 20 bits of each key."""
    maybe = np.flatnonzero(table[(x >> U(44)).astype(np.int64)])
    k = np.searchsorted(keys, x[maybe])
    return maybe[keys[np.minimum(k, len(keys) - 1)] == x[maybe]]


def bit_table(keys: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 20, bool)
    table[(keys >> U(44)).astype(np.int64)] = True
    return table


def runs(rows: np.ndarray, times: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, past the last) hit of runs of whole rows with PAIRS pairs at most, or of one row."""
    head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    ends, past = np.append(head[1:], len(rows)), np.cumsum(times)
    a = 0
    while a < len(head):
        before = past[head[a]] - times[head[a]]
        b = max(a + 1, int(np.searchsorted(past[ends - 1], before + PAIRS, "right")))
        yield int(head[a]), int(ends[b - 1])
        a = b


def find_leaks(
    docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    score: float = 0.5, seed_share: float = 0.5, least_seeds: int = 8, most_items: int = 10_000_000,
) -> DataFrame:
    """All columns of docs and _leaks (a column of docs so named gets an underscore behind it): the items that a passage of the text copies, with
    edits, as an array of item_id (of the items' own type), score, first_word and n_words, empty if none.

    A scan of the corpus counts each item's n-grams of three words in all documents. All that occur are its seeds; the rarest half
    of them, and eight at the fewest, are rare. A second scan joins passages to items on seeds; seeds on near diagonals give
    one passage, the item's length and half of it on either side, which is aligned with the item word by word (Smith-Waterman: 2 for
    equal words, -1 for other ones and gaps). A passage without a rare seed is aligned only if it has so many of the item's words
    that it can reach `score`, so this loses nothing. score is the alignment's share of what the item has with itself; `score` or
    more is a leak. Of several passages the best counts for an item. A copy that has no three words of the item in a row is not seen.

    Nothing is shuffled but the counts. Items go to all tasks in blocks of ITEMS, a scan pair for each, so what is sent has a
    bound; over most_items are refused. Null, empty or short texts have no leaks; items under three words and null items are not looked for.
    Items that repeat id and text count once; of passages with equal scores the last one is told. Repeated rows of docs have one result each.
    A very long text is searched whole; what is held of it at a time grows with its own seeds alone.
    """
    small_arrow_batches(docs.sparkSession)
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    n = known.limit(most_items + 1).count()
    if n > most_items:
        raise ValueError(f"more than {most_items} items")
    text_at = docs.columns.index(text_col)
    docs = kept_apart(docs, ["_leaks"])
    text_col = docs.columns[text_at]
    out = docs.withColumn("_leaks", F.array().cast(f"array<struct<item_id:{known.schema['i'].dataType.simpleString()},score:double,first_word:int,n_words:int>>"))
    blocks = -(-n // ITEMS)
    for b in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        block = Items(sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1])))
        if len(block.keys):
            out = _one_block(out, docs, block, text_col, score, seed_share, least_seeds)
    return out


def _one_block(out: DataFrame, docs: DataFrame, items: Items, text_col: str, least: float, share: float, fewest: int) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((items.keys, bit_table(items.keys)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = sent.value
        powers, total = Powers(), np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, raw, at in texts(batch.column(0)):
                g, _ = grams(*hashed_words(raw, at, powers), powers)
                total += np.bincount(np.searchsorted(keys, g[among(g, keys, bits)]), minlength=len(keys))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    counts = np.zeros(len(items.keys), np.int64)
    for r in docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    seeds, rare = items.rare(counts, share, fewest)
    if not len(seeds):
        return out
    order = np.argsort(items.grams[seeds], kind="stable")
    seeds, rare = seeds[order], rare[order]
    gram, item, offset = items.grams[seeds], items.item[seeds], items.offset[seeds]
    shared = (items.pairs, items.times, bit_table(items.pairs))
    model = sc.broadcast((gram, item, offset, rare, bit_table(gram), items.words, items.start, items.length, items.ids, shared))
    schema = out.schema
    at_text, at_leaks = schema.names.index(text_col), schema.names.index("_leaks")

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, item, offset, rare, bits, item_words, start, length, ids, shared = model.value
        powers = Powers()
        for batch in batches:
            found: list[list[dict]] = batch.column(at_leaks).to_pylist()
            for first, raw, at in texts(batch.column(at_text)):
                h, rows = hashed_words(raw, at, powers)
                g, pos = grams(h, rows, powers)
                hit = among(g, gram, bits)
                if not len(hit):
                    continue
                left, right = np.searchsorted(gram, g[hit], "left"), np.searchsorted(gram, g[hit], "right")
                parts = []
                for a, b in runs(rows[pos[hit]], right - left):
                    times = right[a:b] - left[a:b]
                    seed = np.repeat(left[a:b], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    place = np.repeat(pos[hit[a:b]], times)
                    row, it, diagonal = rows[place], item[seed], place - offset[seed]
                    order = np.lexsort((diagonal, it, row))
                    row, it, diagonal = row[order], it[order], diagonal[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (it[1:] != it[:-1]) | (diagonal[1:] - diagonal[:-1] > length[it[1:]] // 2)
                    head = np.flatnonzero(new)
                    tail = np.append(head[1:], len(row)) - 1
                    row, it, sure = row[head], it[head], np.logical_or.reduceat(rare[seed[order]], head)
                    lo = np.maximum(diagonal[head] - length[it] // 2, np.searchsorted(rows, row))
                    hi = np.minimum(diagonal[tail] + length[it] + length[it] // 2, np.searchsorted(rows, row, "right"))
                    ask = np.flatnonzero(~sure)
                    sure[ask] = in_common(h, lo[ask], hi[ask], it[ask], *shared) >= least * length[it[ask]]
                    parts.append([x[sure] for x in (row, it, lo, hi)])
                row, it, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
                begin_row = np.searchsorted(rows, row)
                by = np.argsort((hi - lo) + length[it])
                best: dict[tuple[int, int], tuple[float, int, int]] = {}
                a = 0
                while a < len(by):
                    # the longest pairs of a lot set its width, so lots are of like length and of a bounded area
                    b = a + 1
                    while b < len(by) and b - a < 4096 and (hi[by[b]] - lo[by[b]]) * (b - a) < 1 << 19:
                        b += 1
                    some = by[a:b]
                    wide, tall = int((hi[some] - lo[some]).max()), int(length[it[some]].max())
                    codes = lambda base, size, most, source, pad: np.where(np.arange(most) < size[:, None], source[np.minimum(base[:, None] + np.arange(most), len(source) - 1)].view(np.int64) & 0x3FFFFFFFFFFFFFFF, pad)
                    x = codes(start[it[some]], length[it[some]], tall, item_words, -1)
                    y = codes(lo[some], hi[some] - lo[some], wide, h, -2)
                    got, end = align(x, y)
                    share = got / (MATCH * length[it[some]])
                    for k in np.flatnonzero(share >= least):
                        p = some[k]
                        entry = (float(share[k]), int(lo[p] + end[k] - begin_row[p]), int(length[it[p]]))
                        name = (int(row[p]), int(it[p]))
                        best[name] = max(best.get(name, entry), entry)
                    a = b
                for (r, i), (s, past, n) in sorted(best.items()):
                    found[first + r].append({"item_id": ids[i], "score": s, "first_word": max(0, past - n), "n_words": n})
            columns = list(batch.columns)
            columns[at_leaks] = pa.array(found, batch.schema.field(at_leaks).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(seek, schema)


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = find_leaks(docs.select("doc_id", "text"), items)
    return out.select("doc_id", F.explode("_leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.first_word", "x.n_words")
