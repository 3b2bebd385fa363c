"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import chat_format, decontaminate, html_text, language_id, license_scan, ngram_join, piece_codec, quality_knn, quality_rules, warc

LONG = " ".join(f"w{i}" for i in range(30_000))
DOCS = [
    (1, None, None, None), (2, "", "en", "a"), (3, "  \n\t ", "en", "a"), (4, "one two three", "en", "b"), (5, "one two three", "en", "b"),
    (5, "one two three", "en", "b"), (None, "released under the MIT License", None, "c"), (6, LONG, "en", "c"), (7, LONG + " extra", "en", "c"), (8, "x" * 100_000, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_rules(docs, nothing):
    rows = quality_rules.score_documents(docs).collect()
    assert len(rows) == len(DOCS)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_words, by[1].base_failed, by[1].kept) == (0, True, False)
    assert by[6].n_words == 30_000 and by[6].n_repeat_words == 0 and not by[6].base_failed
    assert quality_rules.score_documents(nothing).count() == 0
    clash = docs.withColumn("n_words", F.lit("mine"))
    assert quality_rules.keep_good(clash).columns == clash.columns
    hidden = docs.withColumns({"_m": F.lit("mine"), "_bits": F.lit(7)})
    assert {(r._m, r._bits) for r in quality_rules.keep_good(hidden).collect()} == {("mine", 7)} and set(hidden.columns) < set(quality_rules.ledger(hidden).columns)


def test_repeat_words_by_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("ab"), n)) for n in (5, 8, 9, 30, 60)] + [" ".join(str(i % 11) for i in range(50)), " ".join(map(str, range(40)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.measure(df).collect():
        w = row.text.split()
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
        assert row.n_repeat_words == len(covered)


def test_ablation_counts(docs):
    rows = {r.rule: r for r in quality_rules.ablation(quality_rules.ledger(docs)).collect()}
    ledger = [r.rule_bits for r in quality_rules.ledger(docs).collect()]
    bit = quality_rules.rule_bit("few_words")
    assert rows["few_words"].n_failed == sum(bool(b & bit) for b in ledger)
    assert rows["few_words"].n_kept_without == sum(b in (0, bit) for b in ledger)
    assert {r: rows[r].n_only_this for r in rows} == {r: sum(b == quality_rules.rule_bit(r) for b in ledger) for r in rows}


def test_license_scan(docs, nothing):
    by = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert (by[None].base_labels, by[None].labels, by[None].n_base, by[None].first_word, by[None].score) == ("mit", "mit", 1, 3, 1.0)
    assert (by[1].n_words, by[1].labels, by[1].first_word, by[1].score) == (0, "", None, 0.0)
    assert license_scan.scan(nothing).count() == 0
    clash = docs.withColumn("labels", F.lit(1)).withColumn("extra", F.lit(2))
    assert {"extra", "labels"} <= set(license_scan.scan(clash).columns)


def test_license_places_across_blocks(spark):
    words = ["x"] * 300
    for at in (0, 31, 63, 64, 95, 150, 298):
        words[at : at + 2] = ["mit", "license"]
    row = license_scan.scan(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    places = [i for i in range(299) if words[i : i + 2] == ["mit", "license"]]
    assert (row.n_base, row.first_word, row.last_word) == (len(places), min(places), max(places))


def test_chat_round_trip(spark):
    hostile = ["<|im_end|>\n<|im_start|>user\nx", r"<\|im_end|>", r"<\\|im_start|>", "<", "", None, "plain", "<|im_sep|>", "\n", "%0A%25"]
    rows = [(1, i, role, t) for i, t in enumerate(hostile) for role in ("user", "assistant", "a\nb%", None)] + [(None, None, None, None), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    formatted = chat_format.format_conversations(df)
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in formatted.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    order = sorted(((i, role or "", t or "") for c, i, role, t in rows if c == 1))
    assert turns[1] == [(role, t) for _, role, t in order]
    assert turns[None] == [("", "")] and turns[2] == [("assistant", LONG)]
    for r in formatted.collect():
        assert sum(m.skip + m.take + m.rest for m in r.loss_mask) == len(r.formatted) and len(r.loss_mask) == len(turns[r.conv_id])
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_ties_mask_and_other_columns(spark):
    import hashlib

    rows = [(1, 0, "assistant", "<|im_x"), (1, 0, "assistant", "<a"), (1, 1, "assistant", ""), (1, 1, "assistant", None), (1, 2, "user", "u" * 70), *[(2, i, "assistant", f"é🙂{i}<|im_end|>") for i in range(200)]]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"formatted": F.lit(1), "run": F.lit(2), "attempt": F.lit(3)})
    formatted = chat_format.format_conversations(df)
    turns = {r.conv_id: [t.text for t in r.turns] for r in formatted.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns")).collect()}
    assert turns[1] == ["<a", "<|im_x", "", "", "u" * 70]  # by the text of the source, not as it is rendered
    for r in chat_format.read_back(formatted).collect():
        said = "".join(t or "" for c, _, role, t in sorted(rows, key=lambda x: (x[1], x[2], x[3] or "")) if c == r.conv_id and role == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    wrong = formatted.withColumn("loss_mask", F.transform("loss_mask", lambda m: m.withField("skip", m["skip"] + 1)))
    assert {r.loss_sha256 for r in chat_format.read_back(wrong).collect()}.isdisjoint(r.loss_sha256 for r in chat_format.read_back(formatted).collect())


def test_warc(spark):
    rows = [(1, None, None), (None, "http://a", "<p>a &#233; &amp;lt; b</p><script>x</script>"), (2, "http://b", "<p>" + LONG)]
    pages = spark.createDataFrame([*rows, rows[-1]], "page_id long, url string, html string").withColumn("block", F.lit(1))
    out = warc.derive(warc.response_records(pages)).collect()
    assert len(out) == 8 and all(r.digest_ok for r in out)
    assert next(r.block for r in out if r.page_id is None and r.record_type == "conversion") == "a é &lt; b"
    assert all(f"WARC-Refers-To: {r.refers_to}" in r.headers and len(r.block.encode()) == r.content_length for r in out)
    assert warc.derive(spark.createDataFrame([("junk",), (None,)], "record string")).where("digest_ok").count() == 0
    assert "block" in warc.derive(warc.response_records(pages).withColumns({"block": F.lit(1), "headers": F.lit("h"), "kept": F.lit(5)})).where("kept = 5 AND digest_ok").columns
    assert warc.derive(warc.response_records(pages.limit(0))).count() == 0


def test_warc_text_and_headers(spark):
    import hashlib
    from html import unescape

    said = "&frac12;&sup2; &iacute;&times; &#0065; &#x00000041; &#128; &nosuch; &NotEqualTilde; &;&amp;"
    pages = [f"<p>{said}</p>", "<p>a<script>var leaked = 1;", "<p>b<!-- never closed", "<p>c<style>x</style>d<template>t"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").withColumn("url", F.lit("u"))
    got = {r.page_id: r.block for r in warc.derive(warc.response_records(df)).where("record_type = 'conversion'").collect()}
    assert got == {0: unescape(said.replace("&;", "&amp;;")), 1: "a", 2: "b", 3: "c d"}

    def record(payload, content_type):
        block = f"HTTP/1.1 404 Not Found\r\nContent-Type: {content_type}\r\nX-Own: caf\u00e9\r\nServer: s\r\n\r\n".encode() + payload
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    raw = [(1, record("<p>é".encode("latin-1"), "text/html; charset=ISO-8859-1")), (2, record("<p>é".encode(), "text/html")), (3, record(b"<p>a\xffb", "text/html; charset=utf-8")), (4, None)]
    rows = warc.derive(spark.createDataFrame(raw, "n int, record binary")).collect()
    assert {r.n: r.block for r in rows if r.record_type == "conversion"} == {1: "é", 2: "é", 3: "a\ufffdb", 4: ""}
    assert {r.n for r in rows if r.digest_ok} == {1, 2, 3}
    meta = next(r.block for r in rows if r.n == 1 and r.record_type == "metadata")
    assert "sourceStatus: 404\r\n" in meta and "sourceHeader: X-Own: café\r\nsourceHeader: Server: s\r\n" in meta


def test_html_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<article><h1>T</h1><p>a <b>b</b>&nbsp;c &copy;<aside>x</aside><p>d"), (4, "u", "<" * 5000), (5, "u", "<article><p>" + LONG)]
    by = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old"))).collect()}
    assert by[1].text == "" and by[2].n_chars == 0 and by[3].text == "T\na b c ©\nd" and by[5].text == LONG


def test_html_long_attributes_and_self_closed_svg():
    long = "x > y, 'hidden' class=comments " * 400  # more than 10,000 characters
    body = "<h1>The headline</h1><p>" + "Words of the first paragraph go on and on. " * 5 + "</p><p>" + "Words of the second one do as well. " * 5 + "</p>"
    want = html_text.extract_texts([f"<body><nav>Home</nav><article>{body}</article><p>Outside</p></body>"])[0]
    assert want.startswith("The headline\n") and want.count("\n") == 2
    pages = [
        f"<body><nav>Home</nav><article data-props=\"{long}\">{body}</article><p>Outside</p></body>",
        f"<body><nav>Home</nav><article data-props = \"{long}\" id=a>{body}</article><p>Outside</p></body>",
        f"<body><nav>Home</nav><article>{body}<div class=\"comments\" data-x=\"{long}\"><p>A comment of some words that is not the article at all.</p></div></article><p>Outside</p></body>",
        f"<body><nav>Home</nav><article>{body.replace('</h1>', '<svg width=1 path=' + chr(34) + 'a>b' + chr(34) + ' /></h1>')}</article><p>Outside</p></body>",
        f"<body><nav>Home</nav><article>{body.replace('</h1>', '<svg a=b/><path d=1 />no text</svg></h1>')}</article><p>Outside</p></body>",
        f"<body><nav>Home</nav><article class=x\">{body}</article><p>Outside</p></body>",
    ]
    assert html_text.extract_texts(pages) == [want] * len(pages)


def test_html_against_a_plainer_reading(spark, sf_dir):
    import re
    from html import unescape

    for r in html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("raw", F.col("html"))).collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", r.raw)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article|div|ul|li)\b[^>]*>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_html_runs_of_links_inside_the_article():
    prose = "<p>" + "Words of the first paragraph go on and on. " * 5 + "</p>"
    link = lambda t: f'<p><a href="/x">{t}</a></p>'
    more = "".join(link(f"More story number {i}") for i in range(5))
    keep = html_text.extract_texts([f"<nav>Home</nav><article><h1>Title of it</h1>{prose}{link('One link alone')}{prose}</article>"])[0]
    assert "One link alone" in keep and keep.startswith("Title of it\n")
    for page in (f"<article><h1>Title of it</h1>{prose}{more}{prose}</article>", f"<article><h1>Title of it</h1>{prose}{prose}{more}</article>"):
        text = html_text.extract_texts([page])[0]
        assert "More story" not in text and text.count("Words of the first") == 10 and text.startswith("Title of it\n")


def test_html_without_an_article_element(spark, sf_dir):
    """The tree alone: precision and recall by block where no element is named for the article."""
    import re
    from collections import Counter
    from html import unescape

    right = said = wanted = 0
    for (h,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").where("html IS NOT NULL").collect():
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", h)[1]
        want = Counter(b for b in (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br|article)\b[^>]*>", body)) if b)
        got = Counter(html_text.extract_texts([h.replace("<article>", "<div>").replace("</article>", "</div>")])[0].split("\n"))
        right, said, wanted = right + (want & got).total(), said + got.total(), wanted + want.total()
    assert right / said > 0.99 and right / wanted > 0.95


def test_decontaminate(spark):
    item = " ".join(f"t{i}" for i in range(30))
    swapped = " ".join("zz" if i % 7 == 3 else f"t{i}" for i in range(30))
    rows = [(1, f"start {item} end"), (1, f"start {item} end"), (2, f"Start, {swapped.upper()}; end"), (3, "t1 t2 t3 only"), (None, f"a {item}"), (4, None), (5, "short item of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    docs = docs.unionByName(spark.createDataFrame([(6, "Two, words!"), (7, "two words more")], "doc_id long, text string").withColumn("item_id", F.lit(1)))
    bench = spark.createDataFrame([(10, item), (11, None), (12, "short item of five words"), (13, "two words")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert set(found) == {(1, 10), (2, 10), (None, 10), (5, 12), (6, 13)}
    assert found[1, 10].overlap == 1.0 and found[2, 10].matched == sum(i % 7 != 3 for i in range(30))
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()) == [3, 4, 7]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0 == decontaminate.overlaps(docs, bench.limit(0)).count()


def test_decontaminate_finds_changed_passages(spark):
    from itertools import combinations

    words = lambda n: [f"i{n}x{j}" for j in range(n)]
    lengths = [*range(5, 17), 21, 24, 60, 500]
    said, clean = {}, {}
    for n in range(5, 17):
        for k in (1, 2) if n >= 8 else (1,):
            for places in combinations(range(n), k):
                said[n, "replaced", places] = ["zz" if j in places else w for j, w in enumerate(words(n))]
    for period in (2, 3, 4):
        for r in range(period):
            said[24, "every", period, r] = ["zz" if j % period == r else w for j, w in enumerate(words(24))]
    for n in (8, 11, 13, 15, 21, 24):
        said[n, "left out"] = words(n)[: n // 2] + words(n)[n // 2 + 1 :]
        said[n, "put in"] = [*words(n)[: n // 2], "zz", *words(n)[n // 2 :]]
    said[60, "part"], said[500, "part"], said[500, "end"] = words(60)[20:49], words(500)[100:300], words(500)[-200:]
    clean[5, "three words"], clean[10, "half"], clean[60, "eleven words"] = words(5)[:3], words(10)[:5], words(60)[20:31]
    rows = [(i, " ".join(["before", "it", *w, "after"])) for i, w in enumerate([*said.values(), *clean.values()])]
    bench = spark.createDataFrame([(n, " ".join(words(n))) for n in lengths], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(i, key[0]) for i, key in enumerate(said)}


def test_decontaminate_recall_by_rate_of_substitution(spark):
    """Items with words replaced at random, and with words put in at random: at least 0.95 of those with half of their words in place."""
    rng = np.random.default_rng(8)
    items = {n: [f"w{n}x{j}" for j in range(int(rng.integers(20, 61)))] for n in range(60)}
    rows = []
    for rate in (0.1, 0.2, 0.3, 0.4):
        for n, w in items.items():
            out = [x if rng.random() >= rate else f"z{rng.integers(10**9)}" for x in w]
            if 2 * sum(a == b for a, b in zip(out, w, strict=True)) >= len(w):
                rows.append((rate, n, out))
    for n, w in items.items():
        at = sorted(rng.choice(len(w), 2, replace=False))
        rows.append((-1.0, n, [*w[: at[0]], "q1", *w[at[0] : at[1]], "q2", *w[at[1] :]]))
    docs = spark.createDataFrame([(i, " ".join(["said", *w, "so"])) for i, (_, _, w) in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert found <= {(i, n) for i, (_, n, _) in enumerate(rows)}
    for rate in {r for r, _, _ in rows}:
        of_rate = [(i, n) in found for i, (r, n, _) in enumerate(rows) if r == rate]
        assert np.mean(of_rate) >= 0.95, (rate, np.mean(of_rate))


def test_decontaminate_against_its_sql(spark):
    import duckdb

    rng = np.random.default_rng(12)
    items = [" ".join(f"w{n}x{j}" for j in range(n)) for n in (1, 3, 4, 5, 7, 8, 11, 12, 16, 30, 40)]
    docs = []
    for _ in range(150):
        w = items[rng.integers(len(items))].split()
        lo = int(rng.integers(0, len(w)))
        part = [x if rng.random() > 0.2 else "zz" for x in (w if rng.random() < 0.6 else w[lo:])]
        docs.append(" ".join(part if len(w) < 5 else ["a", "b", *part, "c"]))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark(item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(docs)))
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(items)))
    frames = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    names = ["doc_id", "item_id", "n_hits", "matched", "item_words", "overlap", "first_word"]
    ours = sorted(tuple(r[c] for c in names) for r in decontaminate.score_documents(*frames).collect())
    assert len(ours) > 40 and ours == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({decontaminate.ORACLE_SQL})").fetchall())


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, 1 << 16, 64])
def test_decontaminate_with_a_shuffled_benchmark(spark, sf_dir, monkeypatch, bits):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").unionByName(docs.limit(5).select(F.lit(None).cast("long").alias("doc_id"), "text")).unionByName(docs.where("doc_id < 40").select("doc_id", "text"))
    whole = sorted(map(str, decontaminate.overlaps(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 0)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    shuffled = decontaminate.overlaps(docs, bench)
    assert whole and sorted(map(str, shuffled.collect())) == whole
    plan = decontaminate.overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 2  # however many seeds the benchmark has


def test_one_item_longer_than_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 200)
    item = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(["x", "y", *item[100:130], "z"])), (2, " ".join(item[::-1])), (3, ""), (4, None), (5, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "a few other words that no text of these has"), (9, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched, r.first_word) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(1, 7): (30, -98), (5, 7): (400, 0)}
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()) == [2, 3, 4]


def test_ids_are_those_of_the_model(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT_MODEL)
    rows = piece_codec.encode(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL AND NOT contains(text, '▁')").withColumn("own", F.col("text"))).collect()
    assert all(r.ids == model.encode(r.own) and r.round_trip for r in rows)
    for r in rows[:50]:
        assert r.score == pytest.approx(sum(model.get_score(i) for i in r.ids if not model.is_byte(i)) + sum(piece_codec.Codec(piece_codec.load_vocabulary()).unknown for c in r.own if any(model.is_byte(i) for i in model.encode("a" + c)[1:])))


def test_best_scores_of_a_unigram_vocabulary():
    """Scores that are logarithms of probabilities: plain Viterbi, against the best over all segmentations."""
    from chronoloom.llm.pieces import Vocabulary

    rng = np.random.default_rng(2)
    pieces = ["<unk>", *[f"<0x{b:02X}>" for b in range(256)], "▁", "a", "b", "ab", "ba", "aba", "▁a", "bb", "▁ab", "a" * 70]
    vocabulary = Vocabulary(tuple(pieces), tuple([0.0] * 257 + list(-rng.random(len(pieces) - 257) * 5 - 0.01)), 1, 257)
    codec = piece_codec.Codec(vocabulary)
    assert not vocabulary.by_merges
    for text in [*("".join(rng.choice(list("ab "), rng.integers(1, 12))) for _ in range(200)), "a" * 70, "acb"]:
        unit = "▁" + text.replace(" ", "▁")
        best = [0.0] + [None] * len(unit)
        for e in range(1, len(unit) + 1):
            for n in range(1, e + 1):
                i = vocabulary.ordinary.get(unit[e - n : e])
                if i is not None and (best[e] is None or best[e - n] + vocabulary.scores[i] > best[e]):
                    best[e] = best[e - n] + vocabulary.scores[i]
            best[e] = best[e - 1] + codec.unknown if best[e] is None else best[e]
        ids = np.frombuffer(codec.encode(text), np.int32)
        assert codec.scores[ids].sum() == pytest.approx(best[-1]) and codec.decode(ids.tolist()).decode() == text


def test_piece_codec(docs, nothing, spark):
    import sentencepiece

    vocabulary = piece_codec.load_vocabulary()
    codec = piece_codec.Codec(vocabulary)
    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.DEFAULT_MODEL)
    rng = np.random.default_rng(1)
    for _ in range(500):
        text = "".join(rng.choice(list("abe éin\n▁ th.,!🙂中"), rng.integers(0, 25)))
        ids = np.frombuffer(codec.encode(text), np.int32).tolist()
        assert codec.decode(ids).decode() == text
        if text and "▁" not in text:
            assert ids == model.encode(text)  # the model's own
    out = piece_codec.encode(docs.withColumn("ids", F.lit("clash")))
    rows = out.collect()
    assert len(rows) == len(DOCS) and all(r.round_trip for r in rows)
    back = {r.doc_id: r.text for r in piece_codec.decode(out).collect()}
    assert back[6] == LONG and back[1] == "" and back[8] == "x" * 100_000
    assert piece_codec.encode(nothing).count() == 0


def test_language_model_by_brute_force():
    from math import log

    vocabulary = language_id.load_vocabulary()
    rng = np.random.default_rng(0)
    p = rng.random((len(vocabulary.pieces), 2))
    p /= p.sum(0)
    units = ["▁the", "ab🙂c", "\n", "▁▁x"]

    def ways(u):
        if not u:
            yield []
        for n in range(1, len(u) + 1):
            i = vocabulary.ordinary.get(u[:n])
            if i is not None:
                yield from ([i, *rest] for rest in ways(u[n:]))
            elif n == 1:
                yield from ([-1, *rest] for rest in ways(u[1:]))

    got = language_id.Lattices(vocabulary, units).log_likelihoods(p)
    for row, u in zip(got, units, strict=True):
        for k in range(2):
            assert row[k] == pytest.approx(log(sum(np.prod([p[i, k] if i >= 0 else language_id.UNKNOWN for i in s]) for s in ways(u))))


def test_expected_pieces_by_brute_force():
    vocabulary = language_id.load_vocabulary()
    rng = np.random.default_rng(1)
    p = rng.random((len(vocabulary.pieces), 2))
    p /= p.sum(0)
    units, counts = ["▁the", "ab🙂c", "▁▁x"], np.array([[2.0, 0.0], [1.0, 3.0], [0.0, 1.0]])

    def ways(u):
        if not u:
            yield []
        for n in range(1, len(u) + 1):
            i = vocabulary.ordinary.get(u[:n])
            if i is not None:
                yield from ([i, *rest] for rest in ways(u[n:]))
            elif n == 1:
                yield from ([-1, *rest] for rest in ways(u[1:]))

    want = np.zeros_like(p)
    for u, c in zip(units, counts, strict=True):
        every = list(ways(u))
        for k in range(2):
            weight = np.array([np.prod([p[i, k] if i >= 0 else language_id.UNKNOWN for i in s]) for s in every])
            for s, w in zip(every, weight / weight.sum(), strict=True):
                for i in s:
                    if i >= 0:
                        want[i, k] += w * c[k]
    assert language_id.Lattices(vocabulary, units).expected(p, counts) == pytest.approx(want, abs=1e-9)


def test_language_ties_clashes_and_too_many(spark, monkeypatch):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit("x"), "lang_pred": F.lit("y"), "kept": F.lit(1)})
    model = language_id.train(df.where("doc_id < 2"))
    out = language_id.identify(df, model)
    assert set(out.columns) == {"doc_id", "lang", "kept", "lang_pred", "score"} and {r.lang_pred for r in out.collect()} == {"a"}  # equal: the first by name
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 1)
    with pytest.raises(ValueError):
        language_id.train(df)


def test_language_id(spark, sf_dir, nothing):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(1000, None, "en"), (1001, "", None), (1002, "123 456", "en")], "doc_id long, text string, lang string")
    out = language_id.score_documents(table.select("doc_id", "text", "lang").unionByName(odd)).toPandas().merge(table.select("doc_id", "lang").toPandas(), on="doc_id", how="left")
    held = out[out.held_out & out.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert set(out[out.doc_id >= 1000].lang_pred) == {"und"} and out.score.between(0, 1).all()
    assert language_id.score_documents(nothing).count() == 0


def test_quality_classifier(spark, docs, nothing):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_knn.train(table, labels)
    out = quality_knn.classify(table.select("doc_id", "text"), model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[[int(__import__("zlib").crc32(str(d).encode())) % 5 == 0 for d in out.doc_id]]
    assert (held.predicted == held.quality).mean() > 0.95 and out.score.between(0, 1).all()
    assert quality_knn.classify(docs, model).count() == len(DOCS)
    assert quality_knn.classify(nothing, model).count() == 0
    assert {r.score for r in quality_knn.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    clash = docs.withColumns({"score": F.lit("mine"), "predicted": F.lit("too"), "own": F.lit(1)})
    assert set(quality_knn.classify(clash, model).columns) == {"doc_id", "lang", "source", "own", "score", "predicted"}
    assert quality_knn.keep_good(clash, model).columns == clash.columns


def test_one_text_of_an_id_is_learnt_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "other words are here"), (2, "x"), (2, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (1, None)], "doc_id long, quality int")
    models = [quality_knn.train(d, labels) for d in (docs, docs.orderBy(F.desc("text")).repartition(3))]
    assert (models[0].vectors == models[1].vectors).all() and sorted(models[0].labels) == [0, 0.5]


def test_neighbours_by_brute_force():
    rng = np.random.default_rng(0)
    counts, labels = rng.random((60, quality_knn.TERMS)), rng.integers(0, 2, 60).astype(float)
    model = quality_knn.fit(counts, labels)
    asked = rng.random((5, quality_knn.TERMS))
    got, v = model.score(asked), model.project(asked)
    for k in range(5):
        sims = sorted(((float(v[k] @ u), y) for u, y in zip(model.vectors, labels, strict=True)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [max(s, 0.0) ** quality_knn.SHARPNESS for s, _ in sims]
        assert got[k] == pytest.approx(sum(a * y for a, (_, y) in zip(w, sims, strict=True)) / sum(w), rel=1e-4)
