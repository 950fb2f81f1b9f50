"""Language-model scores by a hidden Markov model over word classes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_arrow_batches, table
from .textkit import LOWER, Powers, Prefixes, U, mix, texts, words

#: Latent states, classes of words, most words whose counts are sent to every task, tokens that one pass holds.
STATES, CLASSES, HEAD, TOKENS = 8, 4096, 1 << 17, 1_000_000
#: Most rounds of training over the whole corpus, and the gain in log10 likelihood a token under which they end.
ROUNDS, GAIN = 6, 0.002
END = 0  # the class of the end of a text


def held_out(id_col: Column, modulus: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % modulus == fold, F.lit(False))


def tokens(raw: np.ndarray, at: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, class, row) of words with A-Z lower-cased. Words up to four bytes fall into three quarters of the classes by
    their hash, longer ones into the rest by their last three bytes: a class is known without the corpus."""
    raw = LOWER[raw]
    s, e, rows = words(raw, at)
    h = mix(Prefixes(raw, powers).of(s, e) + (e - s).astype(U))
    last = (raw[e - 1].astype(U) << U(16)) | (raw[np.maximum(e - 2, s)].astype(U) << U(8)) | raw[np.maximum(e - 3, s)].astype(U)
    near = CLASSES * 3 // 4
    c = np.where(e - s <= 4, 1 + h % U(near - 1), U(near) + mix(last) % U(CLASSES - near)).astype(np.int64)
    return h, c, rows


class Model:
    """start (S), move (S x S) and emit (S x C) probabilities; the step to the end of a text is a word like any other."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.start, self.move, self.emit

    @staticmethod
    def first(share: np.ndarray, seed: int = 5) -> Model:
        """Sticky states that differ by chance, widely, so that few rounds draw them apart. share: of the classes in the corpus."""
        rng = np.random.default_rng(seed)
        emit = share[None, :] * rng.gamma(0.3, 1.0, (STATES, CLASSES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        return Model(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def of(counts: np.ndarray) -> Model:
        """From expected counts, flat: start, move, emit. A little of everything keeps all probabilities above 0."""
        a, b = counts[:STATES] + 0.1, counts[STATES : STATES + STATES * STATES].reshape(STATES, STATES) + 0.1
        c = counts[STATES + STATES * STATES :].reshape(STATES, CLASSES)
        c = c + 0.01 + 1e-4 * c.sum(0, keepdims=True)
        return Model(a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(1, keepdims=True))


def passes(model: Model, classes: list[np.ndarray], learn: np.ndarray | None = None, most: int = TOKENS) -> np.ndarray:
    """log10 likelihood of each sequence of classes, its end included, by the scaled forward recursion, in 64 bits. With learn, the
    backward recursion adds the expected counts to it. All sequences step together, the longest first.

    The forward numbers of at most about `most` tokens are held: of more, only those at the start of every block of steps are, and
    the backward recursion computes a block's anew. So a very long text costs a second forward pass, not memory."""
    n = np.array([len(c) for c in classes], np.int64)
    order = np.argsort(-n, kind="stable")
    n_sorted = n[order]
    longest = int(n_sorted[0]) if len(n) else 0
    live = np.searchsorted(-n_sorted, -np.arange(longest), "left").astype(np.int32)  # sequences longer than t
    first = np.concatenate([[0], np.cumsum(live, dtype=np.int64)])
    flat = np.empty(first[-1], np.int16)
    for k, i in enumerate(order):
        flat[first[: n[i]] + k] = classes[i]
    emit = np.ascontiguousarray(model.emit.T)
    likely = np.zeros(len(n))

    def forward(t: int, a: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        x = flat[first[t] : first[t + 1]]
        a = (np.broadcast_to(model.start, (live[t], STATES)) if t == 0 else a[: live[t]] @ model.move) * np.take(emit, x, 0)
        s = a.sum(1)
        return a / s[:, None], s

    # the first step of each block of steps
    cuts = [0]
    while learn is not None and first[-1] - first[cuts[-1]] > most:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(first, first[cuts[-1]] + most, "right")) - 1))
    blocks = list(zip(cuts, [*cuts[1:], longest], strict=True))
    room = max((first[z] - first[a] for a, z in blocks), default=0) if learn is not None else 0
    alphas, scales = np.empty((room, STATES)), np.empty(room)
    before: dict[int, np.ndarray | None] = {}
    a = None
    for lo, hi in blocks:
        before[lo] = a
        for t in range(lo, hi):
            a, s = forward(t, a)
            likely[: live[t]] += np.log10(s)
            if learn is not None and hi == longest:
                alphas[first[t] - first[lo] : first[t + 1] - first[lo]], scales[first[t] - first[lo] : first[t + 1] - first[lo]] = a, s
    if learn is not None and longest:
        moved = np.zeros((STATES, STATES))
        ahead = None  # of step t + 1: emission times what follows, scaled
        for lo, hi in reversed(blocks):
            if hi < longest:
                a = before[lo]
                for t in range(lo, hi):
                    a, s = forward(t, a)
                    alphas[first[t] - first[lo] : first[t + 1] - first[lo]], scales[first[t] - first[lo] : first[t + 1] - first[lo]] = a, s
            for t in range(hi - 1, lo - 1, -1):
                p, q = first[t] - first[lo], first[t + 1] - first[lo]
                b = np.ones((live[t], STATES))
                if ahead is not None:
                    k = len(ahead)
                    moved += alphas[p : p + k].T @ ahead
                    b[:k] = ahead @ model.move.T
                ahead = np.take(emit, flat[first[t] : first[t + 1]], 0) * b / scales[p:q, None]
                alphas[p:q] *= b  # now the chance of each state
            x = flat[first[lo] : first[hi]]
            for s in range(STATES):
                at = STATES + STATES * STATES + s * CLASSES
                learn[at : at + CLASSES] += np.bincount(x, alphas[: len(x), s], CLASSES)
            if lo == 0:
                learn[:STATES] += alphas[: live[0]].sum(0)
        learn[STATES : STATES + STATES * STATES] += (moved * model.move).ravel()
    out = np.empty(len(n))
    out[order] = likely
    return out


def lots(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows together until they have TOKENS tokens, with the sequences of classes of their rows; one longer row is a lot of its own."""
    held, seqs, size = [], [], 0
    for b in batches:
        new = [np.frombuffer(x.as_py(), np.int16) for x in b.column(column)]
        at = 0
        for i, x in enumerate(new):
            if size and size + len(x) > TOKENS:
                yield [*held, b.slice(at, i - at)], seqs
                held, seqs, size, at = [], [], 0, i
            seqs.append(x)
            size += len(x)
        held.append(b.slice(at))
    if seqs:
        yield held, seqs


def train(coded: DataFrame, share: np.ndarray, rounds: int = ROUNDS, gain: float = GAIN) -> Model:
    """Baum-Welch over all rows of coded (classes: binary of int16). The start follows the shares of the classes in the whole corpus, with
    a fixed random factor that draws the states apart. Each round sums expected counts and the likelihood in every task and then, by
    parameter, across tasks; rounds end when the likelihood of a token gains less than `gain`. Only the parameters, a fixed number, reach the driver."""
    model = Model.first(share)
    size_of = STATES + STATES * STATES + STATES * CLASSES
    sc = coded.sparkSession.sparkContext
    last = -math.inf
    for _ in range(rounds):
        sent = sc.broadcast(model.parts())

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            counts, model, likely, n = np.zeros(size_of + 2), Model(*sent.value), 0.0, 0
            for _, seqs in lots(batches, 0):
                likely += passes(model, seqs, counts[:size_of]).sum()
                n += sum(map(len, seqs))
            counts[size_of:] = likely, n
            k = np.flatnonzero(counts)
            for a in range(0, len(k), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 4096].astype(np.int32)), pa.array(counts[k[a : a + 4096]])], names=["k", "n"])

        counts = np.zeros(size_of + 2)
        for r in coded.select("classes").mapInArrow(expect, "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
            counts[r["k"]] = r["n"]
        sent.destroy()
        if not counts[-1]:
            break
        model = Model.of(counts[:size_of])
        now = counts[-2] / counts[-1]
        if now - last < gain:
            break
        last = now
    return model


def scores(docs: DataFrame, training: Column, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: id, training, n_tokens, n_known, train_tokens, base_score, score. model: states trained before, else train()'s.

    Tokens are words, A-Z lower-cased, and one end a text. c counts a token in the texts where training is true, N all of
    them, V distinct ones. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))). The model's score of a text is the exact
    log10 probability of its tokens: of their classes' sequence under the hidden Markov model, and of each word within its
    class, (c + 0.5) / (n + 0.5 (v + 1)) with n tokens and v distinct ones in the class; the end is alone in its own.
    Words are counted by hashes of 64 bits. A null or empty text is an end alone. With no training text all counts are 0. Rows that
    repeat id and text are counted and scored as often as they stand; no other column of docs is read, whatever its name. Very long
    texts are worked on in blocks of steps, whole.

    Two scans read texts: one counts, the other codes texts by class and looks up the HEAD most frequent words, which are sent to
    all tasks; counts of the others are joined by hash. Training and scoring read the codes.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    small_arrow_batches(spark)
    d = docs.select(F.col(id_col).alias("id"), training.alias("training"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, raw, at in texts(batch.column(0)):
                h, c, _ = tokens(raw, at, powers)
                u, first, n = np.unique(h, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c[first].astype(np.int32)), pa.array(n)], names=["h", "cls", "n"])

    counted = d.where("training").select("text").mapInArrow(count, "h long, cls int, n long").groupBy("h").agg(F.max("cls").alias("cls"), F.sum("n").alias("c"))
    counted = table(counted, "counts")
    ends = d.where("training").count()
    per_class = counted.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in per_class:
        class_n[r["cls"]], class_v[r["cls"]] = r["n"], r["v"]
    total, distinct = int(class_n.sum()) + ends, int(class_v.sum()) + (ends > 0)
    base_of = math.log10(total + 0.5 * (distinct + 1))
    class_of = np.log10(class_n + 0.5 * (class_v + 1))
    # the least count of which no more than HEAD words have as many
    steps = F.floor(F.log2(F.col("c").cast("double")) * 4)
    have, least = 0, None
    for r in sorted(counted.groupBy(steps.alias("b")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["b"]):
        have += r["n"]
        if have > HEAD:
            break
        least = r["b"]
    head = counted.where(steps >= least).select("h", "c").toPandas() if least is not None else None
    keys = head["h"].to_numpy(np.int64).view(U) if head is not None else np.zeros(0, U)
    order = np.argsort(keys)
    sent = sc.broadcast((keys[order], (head["c"].to_numpy()[order] if head is not None else np.zeros(0)), class_of))
    end_base = math.log10(ends + 0.5) - base_of

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, class_of = sent.value
        powers = Powers()
        for batch in batches:
            for first, raw, at in texts(batch.column(2)):
                n_rows = len(at) - 1
                h, c, rows = tokens(raw, at, powers)
                n = np.bincount(rows, minlength=n_rows)
                k = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                known = keys[k] == h if len(keys) else np.zeros(len(h), bool)
                log = np.log10(values[k[known]] + 0.5)
                r = rows[known]
                base = np.bincount(r, log - base_of, n_rows) + end_base
                word = np.bincount(r, log - class_of[c[known]], n_rows)
                rest = np.flatnonzero(~known)
                bounds = np.searchsorted(rows[rest], np.arange(n_rows + 1)).astype(np.int32)
                at_token = np.concatenate([[0], np.cumsum(n)])
                short = c.astype(np.int16)
                end = np.int16(END).tobytes()
                codes = [short[at_token[i] : at_token[i + 1]].tobytes() + end for i in range(n_rows)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n_rows), batch.column(1).slice(first, n_rows), pa.array(n + 1), pa.array(np.bincount(r, minlength=n_rows) + (ends > 0)),
                        pa.array(base), pa.array(word), pa.array(codes, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[rest].view(np.int64))), pa.ListArray.from_arrays(pa.array(bounds), pa.array(c[rest].astype(np.int32))),
                    ],
                    names=["id", "training", "n_tokens", "known", "base", "word", "classes", "rest", "rest_cls"],
                )

    kind = d.schema["id"].dataType.simpleString()
    coded = d.mapInArrow(code, f"id {kind}, training boolean, n_tokens long, known long, base double, word double, classes binary, rest array<long>, rest_cls array<int>")
    # texts of like length stand together: they step together, and the longest share their steps
    coded = table(coded.withColumn("row", F.monotonically_increasing_id()).sortWithinPartitions("n_tokens"), "coded")
    tail = coded.select("row", F.explode(F.arrays_zip("rest", "rest_cls")).alias("x")).select("row", F.col("x.rest").alias("h"), F.col("x.rest_cls").alias("k"))
    rare = counted.where(steps < least) if least is not None else counted
    sizes = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(class_of)], "k int, of double").coalesce(1)
    c = F.coalesce("c", F.lit(0))
    tail = tail.join(rare.select("h", "c"), "h", "left").join(F.broadcast(sizes), "k")
    tail = tail.groupBy("row").agg(F.sum(F.log10(c + 0.5) - F.lit(base_of)).alias("base2"), F.sum(F.log10(c + 0.5) - F.col("of")).alias("word2"), F.sum((c > 0).cast("long")).alias("known2"))
    share = class_n + 0.5
    share[END] = ends + 0.5
    model = sc.broadcast((model or train(coded.where("training"), share / share.sum())).parts())

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, seqs in lots(batches, 1):
            likely, a = passes(Model(*model.value), seqs), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(likely[a : a + b.num_rows])], names=["row", "hmm"])
                a += b.num_rows

    likely = coded.select("row", "classes").mapInArrow(forward, "row long, hmm double")
    slim = coded.select("row", "id", "training", "n_tokens", "known", "base", "word")
    out = slim.join(tail, "row", "left").join(likely, "row")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return out.select(
        F.col("id").alias(id_col), "training", "n_tokens", plus("known", "known2").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "base2").alias("base_score"), (plus("word", "word2") + F.col("hmm")).alias("score"),
    )


def op4_hmm_scores(spark, sf_dir: str) -> DataFrame:
    out = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), ~held_out(F.col("doc_id")))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
