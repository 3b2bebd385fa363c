"""Ranked search, packing and the hash tree: against plain restatements, with nulls, ties, copies, empty tables and clashing names."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import common, lexical_search, merkle, packing
from tests.oracle import compare

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
DOCS = [
    (1, "b", "en", 5, "Red fox, red FOX"), (2, "b", "en", None, "red fox"), (3, "b", None, 1, "the dog saw the red fox"), (4, None, "de", 2, None), (5, "a", "de", 3, ""),
    (5, "a", "de", 3, ""), (None, "a", "de", 4, "fox"), (6, "a", "en", 6, LONG), (7, "c", "en", 7, "Ünder der fuß, 2² İ x́ <|endoftext|>"), (2, "b", "en", None, "red fox"), (-9, "c", "en", 7, "red"),
]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    clash = {c: F.lit("mine") for c in ("ids", "n", "leaf", "g", "rank", "score", "part", "queue")}
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3).withColumns(clash)


def plain_search(rows, items, k, once=True):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    held = [(i, Counter(TERM.findall(lower(t)))) for i, _, _, _, t in rows]
    held = [(i, c) for i, c in held if c]
    docs_n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    said = defaultdict(Counter)
    for i, t in items:
        said[i] += Counter(TERM.findall(lower(t)))
    out = []
    for item, terms in said.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * c.total() * docs_n // total
            score = sum((1 if once else n) * math.floor(1000 * math.log((2 * docs_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, n in terms.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "once"), [(10, True), (2, True), (3, False)])
def test_search_by_brute_force(spark, docs, k, once):
    items = [(1, "red fox red"), (1, "Dog"), (2, "nothing here"), (3, None), (4, ""), (None, "FOX der"), (5, "w5 w6 w7 w7 fuß")]
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1)), k, once)
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(DOCS, items, k, once)


def test_search_in_blocks_of_items_and_documents(spark, docs, monkeypatch):
    items = [(i, f"red w{i} w{2 * i} fox") for i in range(40)]
    monkeypatch.setattr(lexical_search, "TERM_LIMIT", 100)
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 2)
    found = lexical_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(DOCS, items, 10)


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "red")], "item_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0 and lexical_search.search(docs, items.limit(0)).count() == 0


def test_starts_of_sparse_digits(spark):
    rng = np.random.default_rng(1)
    digits = sorted({int(d) for d in rng.integers(0, 1 << 45, 300)} | {0, (1 << 45) - 1})
    rows = [(k, d, int(n)) for k in "ab" for d, n in zip(digits, rng.integers(1, 9, len(digits)), strict=True)]
    got = common.starts(spark.createDataFrame(rows, "k string, d long, n long"), ["k"], "d", "n", (1 << 45) - 1).collect()
    want = {(k, d): sum(n for kk, dd, n in rows if kk == k and dd < d) for k, d, _ in rows}
    assert {(r.k, r.d): r.start for r in got} == want


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, fanout):
    """Root and, for each leaf, the siblings left and right on every level."""
    level, at, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for i, k in enumerate(at):
            lo = k - k % fanout
            proofs[i].append(("".join(level[lo:k]), "".join(level[k + 1 : lo + fanout])))
        level, at = [digest(*level[i : i + fanout]) for i in range(0, len(level), fanout)], [k // fanout for k in at]
    return level[0], proofs


def plain_leaf(row, more=0):
    i, source, lang, n, text = row
    values = [i, source, lang, None if n is None else n + more, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def check_manifest(found, rows, fanout=2):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append((row[0] is not None, row[0] or 0, plain_leaf(row)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])], fanout) for g in names}
    root, above = plain_tree([trees[g][0] for g in names], fanout)
    want = Counter()
    for g, up in zip(names, above, strict=True):
        for place, (x, proof) in enumerate(zip(sorted(groups[g]), trees[g][1], strict=True)):
            want[x[1] if x[0] else None, g, place, x[2], trees[g][0], root, tuple(proof + up)] += 1
    assert Counter((r.doc_id, r.lang, r["rank"], r.leaf, r.subroot, r.root, tuple(map(tuple, r.proof))) for r in found) == want


@pytest.mark.parametrize(("fanout", "block"), [(2, 1024), (2, 4), (3, 9), (5, 1024)])
def test_manifest_by_brute_force(spark, docs, monkeypatch, fanout, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = DOCS + [(100 + 37 * i, "s", "fr" if i % 3 else "en", i, f"t{i}") for i in range(60)]
    check_manifest(merkle.manifest(spark.createDataFrame(rows, SCHEMA), fanout=fanout).collect(), rows, fanout)


def test_manifest_of_copies_and_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEAVY", 20)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(5, "s", "en", 1, "copy")] * 50 + [(7, "s", "en", i, f"text {i}") for i in range(60)] + [(-1 - i, "s", "en", i, "x") for i in range(30)] + [(None, "s", "en", i, "y") for i in range(25)]
    check_manifest(merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_tampered_rows_fail(spark, docs):
    for r in merkle.prove_documents(docs).collect():
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and next(x[3] for x in DOCS if x[0] == r.doc_id) is not None
        assert r.verified == (r.folded_root == r.root) == (not changed)
    one = merkle.prove_documents(docs.where("doc_id = 3")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.prove_documents(docs.limit(0)).count() == 0


def check_pieces(pieces, rows):
    """Every id in one piece, gapless sequences, padding; returns the sequences' lengths."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    coded = Counter()
    for i, source, _, _, text in rows:
        coded[i, source, tuple(t.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length > 0
        by_doc[p.doc_id, p.source, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    for (i, source, n), own in by_doc.items():
        want = [ids for (j, s, ids), c in coded.items() for _ in range(c) if (j, s, len(ids)) == (i, source, n)]
        assert sorted((p.start, p.length) for p in own)[0][0] == 0 and sum(p.length for p in own) == n * len(want)
        for p in own:
            assert any(tuple(p.ids) == ids[p.start : p.start + p.length] for ids in want)
    assert sum(p.length for p in pieces) == sum(len(ids) * c for (_, _, ids), c in coded.items())
    assert sorted(sequences) == list(range(len(sequences)))
    lengths = {}
    for k, own in sequences.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        lengths[k] = at
        assert at <= packing.WINDOW and (at == packing.WINDOW or at & (at - 1) == 0)
    return lengths


def test_packing_edges(spark, docs):
    check_pieces(packing.pack(docs).collect(), DOCS)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    assert {r.doc_tokens for r in packing.pack_documents(docs.where("coalesce(text, '') = ''")).collect()} == {1}


def test_packing_keeps_proportions_in_every_window(spark):
    rows = [(i, f"s{i % 3 if i % 7 else 9}", None, None, " ".join(f"red{j} fox" for j in range(i % 50))) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = packing.pack(df).collect()
    lengths = check_pieces(pieces, rows)
    full = [k for k, n in lengths.items() if n == packing.WINDOW]
    tokens, found = Counter(), defaultdict(Counter)
    for p in pieces:
        tokens[p.source] += p.length
        found[p.sequence_id][p.source] += p.length
    total = tokens.total()
    for k in sorted(full)[: total // packing.WINDOW - 1]:
        assert all(abs(found[k][s] - packing.WINDOW * tokens[s] / total) <= 2 * packing.CELL for s in tokens)
    # given shares: half of each window from one source as long as it lasts, the rest by tokens
    pieces = packing.pack(df, {"s9": 0.5}).collect()
    check_pieces(pieces, rows)
    found = defaultdict(Counter)
    for p in pieces:
        found[p.sequence_id][p.source] += p.length
    lasting = int(tokens["s9"] / (packing.WINDOW / 2)) - 1
    assert lasting > 1 and all(abs(found[k]["s9"] - packing.WINDOW / 2) <= packing.CELL * 2 for k in range(lasting))


def test_many_sources_share_the_last_queue(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 2)
    rows = [(i, None if i % 11 == 0 else f"s{i % 13}", None, None, f"red{i} fox dog " * (i % 40)) for i in range(400)]
    check_pieces(packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect(), rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9000), st.integers(1, 1000)), min_size=1, max_size=7))
def test_schedule_by_brute_force(queues):
    """Cells in the order of their times, one by one."""
    tokens, shares = [t for t, _ in queues], [float(s) for _, s in queues]
    s = packing.Schedule(tokens, shares)
    order = sorted(((j + 0.5) / shares[q], q) for q, t in enumerate(tokens) for j in range(t // packing.CELL))
    for w in range(s.windows + 1):
        want = Counter(q for _, q in order[: w * s.per_window])
        assert s.sent(np.array([w]))[0].tolist() == [want[q] for q in range(len(tokens))]
    assert s.cuts[-1] == sum(tokens) - packing.WINDOW * s.windows


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(max_codepoint=0x17F), st.characters(min_codepoint=0x370, max_codepoint=0x530), st.sampled_from("ÄäßſİıŉΣς́²٣'’s re LL 'd don't\x1c\x85\xa0")), max_size=40))
def test_words_give_the_tokenizers_ids(text):
    from tokenizers import Tokenizer

    with open(packing.default_tokenizer()) as f:
        tokens = packing.shared_tokens(f.read())
    assert isinstance(tokens.whole, Tokenizer) and tokens.by_words
    assert np.frombuffer(tokens.encode(text), "<u2").tolist() == tokens.whole.encode(text, add_special_tokens=False).ids


def test_packing_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    lengths = check_pieces(packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect(), rows)
    assert sum(n < packing.WINDOW for n in lengths.values()) <= 12


def test_search_and_manifest_of_the_table(spark, sf_dir):
    from chronoloom.llm import queries

    for name in ("op11_ranked_search", "op13_merkle_manifest"):
        compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
