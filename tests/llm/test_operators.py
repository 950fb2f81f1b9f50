"""Operators on odd input, and against plain versions on a small fixture."""

import binascii
import collections
import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.llm import chunks, decontam, graph, hmm, langid, licenses, mixing, neardup, quality, queries, suffixes, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, word string, size int, lang_pred string, score double, rejected int, key string, kept_text string, n_removed long, kept int, row int, n int, _id int, _t int, sig int, class_id int, _leaks string, _kept_text int, _N_removed string, rejected_ int, node int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("ba ce di fo gu ha je ki lo mu na pe qui ro su".split()) + r.choice("lan met tis rop dur".split()) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    base = prose(1, 120)
    texts = [base, base, base + " end", None, "", " \t\n", "x", "été ñandú", prose(2, 30000), "same " * 500, prose(3, 60), prose(4, 80) + " " + prose(3, 60), "1234 5678", " ", "a\x00b c"]
    rows = [(i if i != 5 else None, t, ["en", "fr", None][i % 3], ["s", None, "t"][i % 3], None, "k", "w", 1, "l", 2.0, 3, "k", "t", 4, 5, 6, 7, 8, 9, 10, 11, "x", 12, "y", 13, 14) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None,) * 26]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def items(spark):
    return spark.createDataFrame([(1, prose(3, 60)), (2, "short"), (None, prose(9, 20)), (3, None)], "item_id long, text string")


def all_operators(spark, docs):
    labels = spark.createDataFrame([(0, 1), (2, 0), (None, 1), (0, None)], "doc_id long, quality int")
    return {
        "mixing": lambda: mixing.pareto_mix(docs),
        "licenses": lambda: licenses.scan(docs),
        "neardup": lambda: neardup.near_duplicates(docs),
        "hmm": lambda: hmm.scores(docs, ~hmm.held_out(F.col("doc_id"))),
        "suffixes": lambda: suffixes.remove_repeats(docs),
        "decontam": lambda: decontam.find_leaks(docs, items(spark)),
        "quality": lambda: quality.risk_controlled(docs, labels),
        "quality by number": lambda: quality.risk_controlled(docs, labels, stratum_col="size"),
        "langid": lambda: langid.predict(docs, langid.train(docs)),
        "chunks": lambda: chunks.substring_dedup(docs),
        "urls": lambda: urls.url_filter(docs, id_col="doc_id", url_col="text", html_col="_key", redirects=docs.select(F.col("text").alias("src"), F.col("source").alias("dst"))),
    }


NAMES = ["mixing", "licenses", "neardup", "hmm", "suffixes", "decontam", "quality", "quality by number", "langid", "chunks", "urls"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_input(spark, odd, name):
    got = all_operators(spark, odd)[name]().toPandas()
    assert len(got) == odd.count() or name == "licenses"


@pytest.mark.parametrize("name", NAMES)
def test_string_ids(spark, odd, name):
    got = all_operators(spark, odd.withColumn("doc_id", F.concat(F.lit("id-"), "doc_id")))[name]().toPandas()
    assert len(got) == odd.count() or name == "licenses"


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert all_operators(spark, spark.createDataFrame([], SCHEMA))[name]().count() == 0


def test_odd_results(spark, odd):
    near = {(r["doc_id"], r["text_key"] and bytes(r["text_key"])): r for r in neardup.near_duplicates(odd).collect()}
    classes = {k[0]: r["class_id"] for k, r in near.items()}
    assert classes[0] == classes[1] == classes[2] == 0 and classes[3] == 3 and classes[8] == 8
    leaks = {r["doc_id"]: [x["item_id"] for x in r["_leaks"]] for r in decontam.find_leaks(odd, items(spark)).collect()}
    assert leaks[10] == [1] and leaks[11] == [1] and leaks[0] == [] and leaks[3] == []
    kept = {r["doc_id"]: r["_kept_text"] for r in chunks.substring_dedup(odd).collect()}
    assert kept[0] is not None and kept[1] == "" and kept[3] is None and kept[4] == ""
    assert min(len(kept[10].split()), len(kept[11].split()) - 80) < 40
    own = odd.where("doc_id is not null")
    assert {(r["_key"], r["kept_text"], r["n_removed"], r["_kept_text_"], r["_N_removed_"]) for r in chunks.substring_dedup(own).collect()} == {("k", "t", 4, 12, "y")}
    assert {r["_leaks_"] for r in decontam.find_leaks(own, items(spark)).collect()} == {"x"}
    assert {(r["lang_pred_"], r["score_"], r["rejected_"], r["rejected__"]) for r in langid.predict(own, {}).collect()} == {("l", 2.0, 13, 3)}
    text_ids = own.withColumn("doc_id", F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    named = decontam.find_leaks(text_ids, items(spark).withColumn("item_id", F.concat(F.lit("item "), "item_id")))
    assert {r["doc_id"]: [x["item_id"] for x in r["_leaks"]] for r in named.collect() if r["_leaks"]} == {"id-010": ["item 1"], "id-011": ["item 1"]}
    same = {(r["doc_id"], r["_kept_text"], r["_n_removed"]) for r in chunks.substring_dedup(own).withColumn("doc_id", F.concat(F.lit("id-"), F.lpad(F.col("doc_id").cast("string"), 3, "0"))).select("doc_id", "_kept_text", "_n_removed").collect()}
    assert {(r["doc_id"], r["_kept_text"], r["_n_removed"]) for r in chunks.substring_dedup(text_ids).select("doc_id", "_kept_text", "_n_removed").collect()} == same
    langs = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, {"en": b"the of and", "fr": b"le la les"}).collect()}
    assert langs[3] == langs[4] == langs[12] == ("und", 0.0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.ORACLE_SQL[name]).df()
    key = lambda f: sorted(map(str, f[sorted(f.columns)].fillna("-").itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_mix(spark):
    assert mixing.targets({"a": 100, "b": 100, "c": 100, None: 700}, (5, 2, 1), 1.5, 2) == {"a": 200.0, "b": 200.0, "c": pytest.approx(1100 / 6), None: pytest.approx(1100 * 5 / 6)}
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"), (1 + F.col("id") % 3).alias("w"))
    got = mixing.pareto_mix(d, weight_col="w", share=0.5, keep=("w",))
    taken = {r["w"]: r["n"] for r in got.groupBy("w").agg(F.sum("copies").alias("n")).collect()}
    assert sum(taken.values()) == 2000 and abs(taken[3] - 1000) < 40 and abs(taken[1] - 333) < 40


def test_mix_hits_targets(spark, documents):
    per = mixing.pareto_mix(documents).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("n"), F.max("size").alias("most"), F.max("copies").alias("c")).collect()
    assert all(abs(r["t"] - r["n"]) <= r["most"] / 2 and r["c"] <= 2 for r in per)


def jaccard(a, b):
    n = sum((a & b).values())
    return max(n / (sum(a.values()) + sum(b.values()) - n), len(a.keys() & b.keys()) / len(a.keys() | b.keys()))


def test_near_duplicates_brute(spark, documents):
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(documents).collect()}
    sets = {}
    for r in documents.collect():
        w = WORD.findall(r["text"].lower())
        sets[r["doc_id"]] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in itertools.combinations(sorted(sets), 2):
        if sets[u] and sets[v] and jaccard(sets[u], sets[v]) >= 0.8 - 1e-9:
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in sets}


def test_texts_that_repeat_themselves(spark):
    """Pairs that are alike as plain sets only: a text, and the same with its passages once or several times more."""
    rows = []
    for i in range(40):
        t = prose(500 + i, 300).split()
        u = t * 2 if i % 2 else t + t[:200] * 3
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
        a, b = (collections.Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (t, u))
        assert sum((a & b).values()) / sum((a | b).values()) < 0.51 and len(a.keys() & b.keys()) / len(a.keys() | b.keys()) > 0.9
    got = {(r["doc_id"], r["class_id"], r["class_size"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, i // 2 * 2, 2) for i in range(80)}


def test_darts_estimate_similarity():
    element = np.arange(1, 901, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([element[:600], element[150:750]])
    sig = neardup.darts(both, np.repeat([0, 1], 600), 2, 2000)
    assert abs((sig[0] == sig[1]).mean() - 450 / 750) < 0.04


def test_hmm(spark, documents):
    got = {r["doc_id"]: r for r in hmm.scores(documents, ~hmm.held_out(F.col("doc_id"))).collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r["doc_id"]: [*WORD.findall((r["text"] or "").translate(lower)), "\n"] for r in documents.collect()}
    c = collections.Counter(t for i, w in tokens.items() if binascii.crc32(str(i).encode()) % 5 != 1 for t in w)
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(t in c for t in w), n)
    held = [r for r in got.values() if not r["training"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def random_model(seed=0):
    rng = np.random.default_rng(seed)
    return hmm.Model(rng.dirichlet(np.ones(hmm.STATES)), rng.dirichlet(np.ones(hmm.STATES), hmm.STATES), rng.dirichlet(np.ones(hmm.CLASSES), hmm.STATES))


def test_hmm_score_brute(spark, documents):
    """The score of every document by a plain scaled forward recursion over its tokens, one at a time."""
    m = random_model()
    got = {r["doc_id"]: r["score"] for r in hmm.scores(documents, ~hmm.held_out(F.col("doc_id")), model=m).collect()}
    words = {r["doc_id"]: WORD.findall((r["text"] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for r in documents.collect()}
    known = sorted({w for ws in words.values() for w in ws})
    raw = " ".join(known).encode()
    classes = dict(zip(known, hmm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), hmm.Powers())[1].tolist(), strict=True))
    c = collections.Counter(w for i, ws in words.items() if binascii.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = collections.Counter(), collections.Counter(classes[w] for w in c)
    for w, k in c.items():
        n[classes[w]] += k
    for i, ws in words.items():
        want = sum(math.log10((c[w] + 0.5) / (n[classes[w]] + 0.5 * (v[classes[w]] + 1))) for w in ws)
        a = None
        for x in [*[classes[w] for w in ws], hmm.END]:
            a = (m.start if a is None else a @ m.move) * m.emit[:, x]
            want += math.log10(a.sum())
            a = a / a.sum()
        assert got[i] == pytest.approx(want, rel=1e-9)


def test_forward_is_exact():
    m, seq, size = random_model(), np.array([5, 9, 5, 0]), hmm.STATES + hmm.STATES**2
    total, start, move, emit = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros((hmm.STATES, hmm.CLASSES))
    for p in itertools.product(range(hmm.STATES), repeat=4):
        chance = m.start[p[0]] * m.emit[p[0], 5] * math.prod(m.move[p[t - 1], p[t]] * m.emit[p[t], seq[t]] for t in (1, 2, 3))
        total += chance
        start[p[0]] += chance
        for t in range(4):
            emit[p[t], seq[t]] += chance
            if t:
                move[p[t - 1], p[t]] += chance
    counts = np.zeros(size + hmm.STATES * hmm.CLASSES)
    assert hmm.passes(m, [seq], counts)[0] == pytest.approx(math.log10(total), rel=1e-12)
    assert np.allclose(counts, np.concatenate([start, move.ravel(), emit.ravel()]) / total)


def test_passes_in_blocks_and_training(spark):
    rng = np.random.default_rng(1)
    m, seqs = random_model(), [np.append(rng.integers(1, hmm.CLASSES, n), 0) for n in (700, 0, 31, 31, 250)]
    whole, parts = (np.zeros(hmm.STATES + hmm.STATES**2 + hmm.STATES * hmm.CLASSES) for _ in range(2))
    assert np.allclose(hmm.passes(m, seqs, whole), hmm.passes(m, seqs, parts, most=40), rtol=1e-12)
    assert np.allclose(whole, parts) and whole[: hmm.STATES].sum() == pytest.approx(5)
    coded = spark.createDataFrame([(bytearray(np.append(rng.permutation(np.repeat([1 + i % 3, 7 + i % 3], 30)), 0).astype(np.int16).tobytes()),) for i in range(60)], "classes binary").repartition(3)
    flat = [np.frombuffer(r["classes"], np.int16) for r in coded.collect()]
    share = np.bincount(np.concatenate(flat), minlength=hmm.CLASSES) + 0.5
    reached = [hmm.passes(hmm.train(coded, share / share.sum(), k, -1.0), flat).sum() for k in (0, 1, 2, 5)]
    assert reached == sorted(reached) and reached[-1] > reached[0] + 100
    again = hmm.train(coded, share / share.sum(), 2, -1.0)
    assert hmm.passes(again, flat).sum() == pytest.approx(reached[2])


def without_repeats(raws, length):
    """(id, bytes, removed, spans, digest of the rest) of each (id, bytes), by a count of all strings."""
    seen = collections.Counter(raw[i : i + length] for _, raw in raws for i in range(len(raw) - length + 1))
    out = collections.Counter()
    for i, raw in raws:
        gone = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(raw, np.uint8)[~cut].tobytes()
        out[i, len(raw), int(cut.sum()), int((np.diff(cut.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("length", "group"), [(100, suffixes.GROUP), (100, 2), (300, 2)])
def test_repeats_brute(spark, odd, length, group):
    docs = odd.union(odd.where("doc_id = 10").withColumns({"doc_id": F.lit(50).cast("long"), "text": F.concat(F.lit("abc "), "text", F.lit(" xyz"))}))
    passage = prose(77, 70)  # in many texts, with one side or both in common: a crowded anchor
    rows = [(200 + i, f"{prose(80 + i % 2, 40)[: 30 * (i % 5)]} {passage} {prose(90 + i % 3, 40)[: 40 * (i % 7)]} {prose(300 + i, 30)}") for i in range(12)]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.remove_repeats(docs, length=length, group=group).collect())
    assert got == without_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()], length)


def test_repeats_of_documents(spark, documents):
    """The query's own length, on all documents of the smallest tables."""
    got = collections.Counter(map(tuple, suffixes.op5_suffix_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()))
    assert got == without_repeats([(r["doc_id"], (r["text"] or "").encode()) for r in documents.collect()], 400)
    assert any(r[2] for r in got) and any(not r[2] for r in got)


def test_sort_survives_collisions():
    rows = np.random.default_rng(3).integers(0, 3, (200, 12)).astype(np.uint8)
    s = suffixes.Suffixes(rows, np.full(200, 12), np.repeat([0, 1], 100), suffixes.Powers())
    s.sums[:] = 0  # all hashes alike
    order, _ = s.sorted_lengths()
    for g in (0, 100):
        assert sorted(map(bytes, rows[g : g + 100])) == [bytes(rows[k]) for k in order[g : g + 100]]


def plain_score(item, words):
    """Smith-Waterman over whole lists of words, one cell at a time; the share of the item's score with itself."""
    row, best = [0] * (len(words) + 1), 0
    for x in item:
        new = [0] * (len(words) + 1)
        for k, w in enumerate(words, 1):
            new[k] = max(0, row[k - 1] + (2 if w == x else -1), row[k] - 1, new[k - 1] - 1)
        row, best = new, max(best, max(new))
    return best / (2 * len(item))


def test_leaks_brute(spark, documents):
    """Every document against every item, edited copies of items among them, by a plain alignment."""
    r = random.Random(8)
    asked = {x["item_id"]: x["text"] for x in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {x["doc_id"]: x["text"] for x in documents.collect()}
    for n, (i, t) in enumerate(sorted(asked.items())):
        w = [y for k, x in enumerate(t.split()) for y in (r.choice([[], ["edited"], [x, "more"]]) if k % (4 + n % 5) == 0 else [x])]
        docs[1_000_000 + i] = f"{prose(700 + n, 80)} {' '.join(w)} {prose(800 + n, 80)}"
    bare = lambda t: [x.strip(".,;:!?\"'()[]") or x for x in WORD.findall(t.lower())]
    want = {}
    for i, q in asked.items():
        q = bare(q)
        for d, t in docs.items():
            w = bare(t)
            # half of the item's words at least must match
            if 2 * sum((collections.Counter(q) & collections.Counter(w)).values()) >= len(q) and (score := plain_score(q, w)) >= 0.5:
                want[d, i] = score
    found = decontam.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(asked.items()), "item_id long, text string"))
    got = {(x["doc_id"], y["item_id"]): y["score"] for x in found.collect() for y in x["_leaks"]}
    assert len(want) > len(asked) and got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert all(want[k] == pytest.approx(x) for k, x in got.items())


def plain_chunks(raw):
    """(first byte, byte past the last, words) of each chunk of a text, byte by byte."""
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    table = [mixed((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in range(256)]
    rolled = [mixed(sum(table[raw[i - j]] << j for j in range(min(i + 1, 16))) & mask) for i in range(len(raw))]
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    at = [rolled[a - 1] if a >= 16 else mask for a, _ in words]
    begin = [i for i in range(len(words)) if i == 0 or all((i < d or at[i] < at[i - d]) and (i + d >= len(words) or at[i] <= at[i + d]) for d in (1, 2, 3))]
    begin = [k for a, z in zip(begin, [*begin[1:], len(words)], strict=True) for k in range(a, z, 64)]
    return [(words[a][0], words[z - 1][1], z - a) for a, z in zip(begin, [*begin[1:], len(words)], strict=True)]


def test_chunks_brute(spark, documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    owner = {}
    for i, t in sorted(docs.items()):
        owner.setdefault(t, i)
    order = lambda t: (int.from_bytes((d := hashlib.md5(t.encode()).digest())[:8], signed=True), int.from_bytes(d[8:12], signed=True))
    cut, first = {t: plain_chunks(t.encode()) for t in owner}, {}
    for t in sorted(owner, key=order):
        for n, (a, z, _) in enumerate(cut[t]):
            first.setdefault(t.encode()[a:z], (t, n))
    want = {}
    for i, t in docs.items():
        raw, words = t.encode(), len(WORD.findall(t))
        if owner[t] != i and words >= 16:
            want[i] = ("", words)
            continue
        again = [first[raw[a:z]] != (t, n) for n, (a, z, _) in enumerate(cut[t])] if owner[t] == i else []
        out, place, removed, n = b"", 0, 0, 0
        while n < len(again):
            m = n
            while m < len(again) and again[m] == again[n]:
                m += 1
            if again[n] and (size := sum(x[2] for x in cut[t][n:m])) >= 16:
                out, removed = out + raw[place : cut[t][n][0]], removed + size
                place = cut[t][m][0] if m < len(again) else len(raw)
            n = m
        want[i] = ((out + raw[place:]).decode(), removed)
    got = {r["doc_id"]: (r["_kept_text"], r["_n_removed"]) for r in chunks.substring_dedup(documents).collect()}
    assert got == want and any(x for _, x in want.values())


def test_leaks_of_edited_copies(spark):
    q = prose(21, 40).split()
    edited = q[:10] + ["other"] + q[11:25] + ["words", "here"] + q[25:]
    docs = spark.createDataFrame([(1, prose(30, 200) + " " + " ".join(edited) + " " + prose(31, 100)), (2, prose(32, 300))], "doc_id long, text string")
    got = {r["doc_id"]: r["_leaks"] for r in decontam.find_leaks(docs, spark.createDataFrame([(7, " ".join(q))], "item_id long, text string")).collect()}
    assert [x["item_id"] for x in got[1]] == [7] and 0.8 < got[1][0]["score"] < 1 and got[2] == []


def test_leaks_of_copies_with_many_edits(spark):
    """Also where over half of an item's 3-grams are gone, or only those are left that many documents have."""
    asked, docs, want = [], [], {}
    for n in (20, 30, 50, 80):
        for kind in (4, 5, 6, "half"):
            i = len(asked)
            q = [f"q{i}w{k}" for k in range(n)]
            copy = q[: n // 2] if kind == "half" else [f"other{i}w{k}" if k % kind == kind - 1 else w for k, w in enumerate(q)]
            asked.append((i, " ".join(q)))
            docs.append((i, " ".join([prose(50 + i, 60), *copy, prose(90 + i, 60)])))
            want[i] = [i]
    common = prose(40, 18).split()
    q = common + [f"r{k}" for k in range(22)]
    asked.append((99, " ".join(q)))
    docs.append((99, " ".join([prose(41, 50), *common, *["other" if k % 3 == 2 else w for k, w in enumerate(q[18:])], prose(42, 50)])))
    docs += [(100 + k, " ".join([f"a{k}", *common, f"b{k}"])) for k in range(60)]
    docs += [(201, " ".join(q[23:29]))]  # has the rarest seeds
    want |= {99: [99]}
    leaks = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")).collect()
    assert {r["doc_id"]: [x["item_id"] for x in r["_leaks"]] for r in leaks} == {r[0]: want.get(r[0], []) for r in docs}


def test_leaks_in_small_runs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    h, rows = rng.integers(0, 9, 900).astype(np.uint64), np.sort(rng.integers(0, 40, 900))
    monkeypatch.setattr(decontam, "PAIRS", 50)
    monkeypatch.setattr(decontam, "WORDS", 50)
    got = list(decontam.runs(rows, np.full(900, 3)))
    assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]] and got[-1][1] == 900 and all(rows[a] != rows[a - 1] for a, _ in got[1:])
    pairs, times = np.unique(decontam.paired(h[:60], np.repeat([0, 1], 30)), return_counts=True)
    lo = rng.integers(0, 800, 70)
    hi, item = lo + rng.integers(1, 90, 70), rng.integers(0, 2, 70)
    brute = [sum((collections.Counter(h[a:b]) & collections.Counter(h[30 * i : 30 * i + 30])).values()) for a, b, i in zip(lo, hi, item, strict=True)]
    assert decontam.in_common(h, lo, hi, item, pairs, times, decontam.bit_table(pairs)).tolist() == brute


def test_measures_brute(spark, documents, odd):
    for d in (documents, odd):
        for r, t in zip(quality.measures(d.select("doc_id", "text").coalesce(1)).collect(), [x["text"] or "" for x in d.coalesce(1).collect()], strict=True):
            w, covered = WORD.findall(t), set()
            at = collections.defaultdict(list)
            for i in range(len(w) - 7):
                at[tuple(w[i : i + 8])].append(i)
            for places in at.values():
                if len(places) > 1:
                    covered |= {i + k for i in places for k in range(8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_kept_brute(spark):
    """The verdict on each document: measures, exact binomial tests and cutoffs told plainly."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            labels[r["doc_id"]] = min(labels.get(r["doc_id"], 9), r["quality"])
    value, told = {}, collections.defaultdict(list)
    for d in docs:
        t = d["text"] or ""
        w, at = WORD.findall(t), collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        again = len({i + k for places in at.values() if len(places) > 1 for i in places for k in range(8)})
        if len(w) < 20 or 100 * again > 30 * len(w):
            value[d["doc_id"]] = None
            continue
        lines, chars = [x for x in t.split("\n") if WORD.search(x)], sum(map(len, w))
        value[d["doc_id"]] = {
            "symbols_per_word": len(re.findall(r"[#*$%&|<>]", t)) / len(w), "marks_per_word": len(re.findall(r"[!?|]", t)) / len(w), "capitals": len(re.findall("[A-Z]", t)) / chars,
            "dup_lines": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeats": again / len(w), "long_words": chars / len(w) / 50,
        }
        if d["doc_id"] in labels:
            for rule, x in value[d["doc_id"]].items():
                told[d["lang"], rule].append((x, labels[d["doc_id"]]))
    cutoff = {}
    for key, rows in told.items():
        good, bad, best = sum(q == 1 for _, q in rows), sum(q == 0 for _, q in rows), 0.0
        for c in quality.GRID:
            k, b, p = sum(x > c and q == 1 for x, q in rows), sum(x > c and q == 0 for x, q in rows), 0.02 / 6
            chance = math.fsum(math.exp(math.lgamma(good + 1) - math.lgamma(i + 1) - math.lgamma(good - i + 1) + i * math.log(p) + (good - i) * math.log1p(-p)) for i in range(min(k, good) + 1))
            if min(chance, 1.0) > 0.05 / len(told):
                break
            if (gain := b / max(bad, 1) - k / max(good, 1)) > best:
                best, cutoff[key] = gain, c
    want = {d["doc_id"]: (f := value[d["doc_id"]]) is not None and not any(x > cutoff.get((d["lang"], rule), math.inf) for rule, x in f.items()) for d in docs}
    assert {r["doc_id"]: r["kept"] for r in quality.op7_quality_rules(spark, sf).collect()} == want
    assert cutoff and any(value[i] and not k for i, k in want.items())


def test_risk_control():
    for k, n, p in ((0, 50, 0.05), (3, 80, 0.05), (10, 40, 0.3)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
    n = len(quality.GRID)
    good = [(2000, 100), *[(0, 90)] * (n - 2), (300, 100), (2000, 100)]
    assert quality.cutoffs({("en", "r"): good}, 0.02, 0.05) == {("en", "r"): quality.GRID[0]}
    assert quality.cutoffs({("en", "r"): [(20, 10), *[(0, 9)] * n]}, 0.02, 0.05) == {}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    got = langid.predict(docs.where(langid.held_out(F.col("doc_id"))), model).select("lang", "lang_pred").collect()
    assert sum(r[0] == r[1] for r in got) / len(got) > 0.96


def test_long_texts_are_not_rejected(spark):
    """Held-out texts of one language joined, up to a few MB."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null and lang is not null")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    long = docs.where(langid.held_out(F.col("doc_id"))).groupBy("lang").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))
    got = langid.predict(long, model).collect()
    assert min(len(r["text"]) for r in got) > 500_000 and max(len(r["text"]) for r in got) > 3_000_000
    assert all(r["lang_pred"] == r["lang"] and not r["rejected"] and r["score"] > 0.05 for r in got)
    for n in (1, 8192, 8193, 100_000):
        assert b"".join(langid.blocks(bytes(n))) == bytes(n) and max(map(len, langid.blocks(bytes(n)))) <= langid.BLOCK


def test_url_aliases(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.net/x", '<link rel="canonical" href="http://b.net/es/1">'), (2, "http://b.net/es/1", None), (3, "http://c.org/", '<meta http-equiv="refresh" content="0; url=http://a.net/x">'), (4, "http://d.org/", ""), (5, None, None), (6, "none", ""), (7, "http://e.com/q", "")],
        "page_id long, url string, html string",
    )
    more = spark.createDataFrame([("http://d.org/", "http://e.com/q"), (None, "x"), ("http://d.org/", "http://d.org/")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urls.url_filter(pages, redirects=more).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    frame = spark.createDataFrame([*urls.RULES, *[("block", f"h{i}.xyz", "/") for i in range(80)]], "verdict string, host string, path string")
    a = {(r["page_id"], r["rule"], r["verdict"]) for r in urls.url_filter(spark.read.parquet(f"{SF}/pages.parquet"), frame).collect()}
    assert a == {(r["page_id"], r["rule"], r["verdict"]) for r in urls.url_filter(spark.read.parquet(f"{SF}/pages.parquet")).collect()}


def test_relative_links(spark):
    base = "http://a.net/b/c/d?q"
    want = {
        "/en/1": "http://a.net/en/1", "//h.org/x?y": "http://h.org/x?y", "g": "http://a.net/b/c/g", "./g/": "http://a.net/b/c/g/", "../g#s": "http://a.net/b/g#s", "../../../g": "http://a.net/g", "..": "http://a.net/b/",
        ".": "http://a.net/b/c/", "?y=1/../2": "http://a.net/b/c/d?y=1/../2", "/x?u=http://h/": "http://a.net/x?u=http://h/", "https://h/": "https://h/", "/a/./b/../c": "http://a.net/a/c", "#s": None, "mailto:x": None, "g...": "http://a.net/b/c/g...",
    }
    rows = [(t, base, u) for t, u in want.items()] + [("x", "http://a.net", "http://a.net/x"), ("/x", "none", None)]
    for r in spark.createDataFrame(rows, "t string, b string, u string").withColumn("got", urls.resolved(F.col("t"), F.col("b"))).collect():
        assert r["got"] == r["u"], r
    pages = spark.createDataFrame(
        [(1, "http://a.org/es/0", '<link rel="canonical" href="//b.net/es/1">'), (2, "http://c.org/x/y", '<meta http-equiv="refresh" content="0; url=../es/0">'), (3, "http://c.org/es/0", '<link href="//b.net/es/1" rel=canonical>'), (4, "http://d.org/", '<link rel="canonical" href="#x">')],
        "page_id long, url string, html string",
    )
    assert {r["page_id"]: r["verdict"] for r in urls.url_filter(pages).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_few_named_lose_no_link(spark, monkeypatch):
    """Chains of copies whose neighbours are similar and whose ends are not, in buckets dealt over many blocks, with nothing named at first."""
    texts = []
    for family in range(3):
        chain = prose(50 + family, 400).split()
        for i in range(30):
            chain[i * 9 : i * 9 + 2] = [f"new{family}", f"edit{i}"]
            texts.append(" ".join(chain))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert want == {(i, i // 30 * 30) for i in range(90)}
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "candidates", lambda members, k, least: members.where("false").select(members["node"].alias("u"), members["node"].alias("v")))
    assert {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()} == want
