"""The similarity join against brute force, with heavy groups forced by a small bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import ngram_join
from chronoloom.llm.shingles import shingle_sets, text_chunks


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, families=12, size=8, words=(6, 400), passage=0):
    rng = np.random.default_rng(seed)
    shared = [f"p{i}" for i in range(passage)]
    rows, d = [], 0
    for _ in range(families):
        base = [f"w{v}" for v in rng.integers(0, 3000, rng.integers(*words))]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 60))):
                text[rng.integers(0, len(text))] = f"x{rng.integers(0, 10**6)}"
            at = rng.integers(0, len(text))
            rows.append((d, " ".join(text[:at] + shared + text[at:])))
            d += 1
    return rows


@pytest.mark.parametrize(("seed", "light", "passage"), [(1, 16, 0), (2, 2, 0), (3, 2, 60), (4, 4, 60)])
def test_against_brute_force(spark, monkeypatch, seed, light, passage):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    rows = corpus(seed, passage=passage)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "a b"), (1004, "A  b"), (1005, "a b c d e"), (1006, rows[0][1])]
    got = ngram_join.score_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x")))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_sets_with_too_few_clean_partitions(spark, monkeypatch):
    """With few partitions (set on the driver alone) every large set is open, and the prefixes carry the join."""
    monkeypatch.setattr(ngram_join, "PARTITIONS_PER_SIZE", 0.02)
    monkeypatch.setattr(ngram_join, "SMALL", 24)
    monkeypatch.setattr(ngram_join, "_EDGES", ngram_join.band_edges())
    rng = np.random.default_rng(0)
    text = " ".join(map(str, rng.integers(0, 10**6, 200)))
    for _, _, data, offsets in text_chunks(__import__("pyarrow").array([text])):
        sets, bounds = shingle_sets(data, offsets)
    sizes = np.diff(bounds)
    clean = ngram_join.signatures(sets, bounds, np.searchsorted(ngram_join._EDGES, sizes), sizes > 0)[2]
    assert clean[0] <= 2 * sizes[0] // 7 // 2
    monkeypatch.undo()
    profiles = ngram_join.profiles
    monkeypatch.setattr(ngram_join, "profiles", lambda docs: profiles(docs).withColumns({"clean0": F.lit(0).cast("long"), "clean1": F.lit(0).cast("long")}))
    rows = corpus(7, words=(140, 300))
    assert sorted(map(tuple, ngram_join.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == brute(rows)


def test_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (5, text), (None, text), (7, text + " more"), (9, "other words are here now too")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.score_documents(df).collect()) == [(0, 5), (5, 5), (5, 5), (7, 5), (9, 9)]
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [5, 9]
    assert ngram_join.score_documents(df.limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 101), (101, 102), (7, 200)]
    found = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in [*range(1, 31), 200]} | {100: 100, 101: 100, 102: 100}


def test_shingle_sets_of_arrow_slices():
    import pyarrow as pa

    texts = ["a b c d e f", None, "", "É f g h i j  k\nl", "one"]
    for array in (pa.array(texts), pa.chunked_array([pa.array(["zz", *texts])]).chunk(0).slice(1)):
        sizes = [n for _, _, data, offsets in text_chunks(array) for n in np.diff(shingle_sets(data, offsets)[1])]
        assert sizes == [len(shingles(t)) for t in texts]


def test_texts_that_share_an_id_are_not_lost(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (5, b), (7, c), (7, c + " more"), (None, c), (None, "no id at all but six words"), (9, None), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text_key", F.lit("mine"))
    kept = ngram_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
    assert [g for g in got if g[0] != 7] == sorted([(3, a), (5, b), (0, "no id at all but six words"), (9, ""), (9, ""), (9, "")])
    assert len([g for g in got if g[0] == 7]) == 1


def test_buckets_follow_the_signatures(spark, monkeypatch):
    df = spark.createDataFrame(corpus(11, families=4), "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "BUCKETS", 1)
    monkeypatch.setattr(ngram_join, "PER_BUCKET", 300)
    sets = ngram_join.profiles(df).withColumnRenamed("band", "own_band").dropDuplicates(["digest"])
    assert ngram_join.n_buckets(sets) > 3
    assert sorted(map(tuple, ngram_join.score_documents(df).collect())) == brute([tuple(r) for r in df.collect()])
