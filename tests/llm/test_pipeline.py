"""Each stage on the small tables."""

import collections

import corpus_pipeline as P
from skyframe.llm.store import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, items = docs.columns, [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    counts = [docs.count()]
    for i, (name, stage) in enumerate(P.STAGES):
        docs = table(stage(spark, docs, SF), "stage")
        counts.append(docs.count())
        assert i == len(P.STAGES) - 1 or docs.columns == columns
        texts = [r["text"] for r in docs.collect()]
        if "near" in name:
            assert len(set(texts)) == len(texts)
        if "substring" in name:
            seen = collections.Counter(x for t in texts for w in [t.split()] for x in {tuple(w[k : k + 50]) for k in range(len(w) - 49)})
            assert not any(n > 1 for n in seen.values())
        if "benchmark" in name:
            assert not any(q in " ".join(t.split()) for t in texts for q in items)
    assert counts == sorted(counts, reverse=True) and counts[-2] > 0.8 * counts[0]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, _leaks int, _kept_text int, _langid_score string, copies int"


def odd_documents():
    said = {"en": "the cat of the old man sat on the mat and then it ran away from all the dogs that were there in the house", "fr": "le chat de la vieille dame est sur le tapis et il court dans la maison avec tous les chiens du village"}
    rows = [(i, f"{said['en' if i % 2 else 'fr']} {i} {i * 7}", "en" if i % 2 else "fr", ["s", None, "t"][i % 3], 5, "k", 1, 2, "c", 3) for i in range(20)]
    rows += [(None, said["en"], None, None, None, None, None, None, None, None), (30, None, *["x"] * 2, 0, "k", 1, 2, "c", 3), (31, "", *["x"] * 2, 0, "k", 1, 2, "c", 3), (32, " \n", *["x"] * 2, 0, "k", 1, 2, "c", 3), (33, "123 456", *["x"] * 2, 0, "k", 1, 2, "c", 3)]
    rows += [rows[0], rows[0], (40, " ".join(f"{said['en']} {k}" for k in range(4000)), "en", "s", 1, "k", 1, 2, "c", 3)]
    return rows


def test_stages_on_odd_rows(spark):
    rows = odd_documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for i, (name, stage) in enumerate(P.STAGES):
        got = stage(spark, docs, SF)
        out[i] = got.collect()
        if i < len(P.STAGES) - 1:
            assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
            # what no stage changes goes along
            assert {(r["doc_id"], r["_k"], r["_leaks"], r["_kept_text"], r["_langid_score"]) for r in out[i]} <= {(r[0], r[5], r[6], r[7], r[8]) for r in rows}
        assert stage(spark, docs.where("false"), SF).count() == 0
    ids = [collections.Counter(r["doc_id"] for r in x) for x in out.values()]
    assert ids[0][0] == 3 and not {30, 31, 32, 33} & set(ids[0]) and ids[0][40] == 1
    assert ids[1][0] == 1 and {30, 31, 32, 33} <= set(ids[1])
    assert {30, 31, 32, 33} <= set(ids[2]) and {r["doc_id"]: r["text"] for r in out[2]}[30] is None
    assert ids[3] == collections.Counter(r[0] for r in rows)
    assert all(r["copies"] > 0 and r["taken"] == r["copies"] * r["size"] for r in out[4]) and None in {r["source"] for r in out[4]}


def test_near_stage_keeps_the_least_of_each_class(spark):
    from skyframe.llm import neardup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    classes = collections.defaultdict(set)
    for r in neardup.near_duplicates(docs).collect():
        classes[r["class_id"]].add(r["doc_id"])
    assert {r["doc_id"] for r in P.near_duplicates(spark, docs, SF).collect()} == {min(x) for x in classes.values()}


def test_mix_stage_agrees_with_sql(spark):
    """The last stage on the documents themselves is the query that SQL tells."""
    import duckdb

    from skyframe.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = {(r[0], r[4]) for r in c.sql(mixing.OP1_SQL).fetchall() if r[4]}
    assert {(r["doc_id"], r["taken"]) for r in P.mix(spark, docs, SF).collect()} == want
