import hashlib
import itertools
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from differential import SF, compare
from pyspark.sql import functions as F

from stratum.llm import _text as T
from stratum.llm import bpe, chat, exact_dedup, licences, mixing, ngram_join, quality_classifier, quality_rules, sharding, warc
from stratum.llm import queries as registered

LONG = "lorem ipsum dolor sit amet " * 60_000
ROWS = [
    (1, "the cat sat on the mat and the dog lay by the door"), (2, "the cat sat on the mat and the dog lay by the door"), (3, None), (4, ""), (5, " \n\t "),
    (6, LONG), (6, LONG), (None, "a text without a number"), (None, None), (7, "the cat sat on the mat and the dog lay by the gate"), (7, "another text of the same number"),
    (8, "naïve 日本語 🙂 текст"), (9, "Released under the MIT License."),
]
CLASHING = [
    "failed", "keep", "n_words", "token_ids", "row_number", "Shard", "rate", "row_key", "first_id", "family", "probability", "__x", "doc", "root",
    "__key", "__tie", "__PART", "__at", "__first", "__text", "__words", "__lines", "__failed", "__n_words", "__row", "__solid", "Starts", "Ends", "decoded",
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING), F.create_map(F.lit("k"), F.lit(1)).alias("a_map")).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (7, 0, 0), (9, 1, 1), (None, 1, 0), (8, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, registered.queries()[name], registered.oracle_sql()[name])


def test_edge_rows_and_empty_tables(spark, docs, empty, labels):
    n = len(ROWS)
    for call, rows in (
        (quality_rules.apply, n), (lambda d: sharding.apply(d, 4, 1), n), (lambda d: mixing.rates(d, labels), n), (exact_dedup.report, n),
        (lambda d: quality_classifier.score(d, labels), n), (licences.scan, n), (lambda d: bpe.encode(d, round_trip=True), n),
    ):
        assert call(docs).count() == rows
        assert call(empty).count() == 0
    for call in (ngram_join.report, quality_rules.accepted, exact_dedup.without_copies, ngram_join.one_of_each, lambda d: mixing.sample(d, labels)):
        assert call(docs).count() > 0 and call(empty).count() == 0
    assert quality_rules.accepted(docs).columns == docs.columns and exact_dedup.without_copies(docs).columns == docs.columns
    for call in (quality_rules.accepted, exact_dedup.without_copies, ngram_join.one_of_each, lambda d: mixing.sample(d, labels)):
        out = call(docs)
        assert out.columns == docs.columns and {tuple(r) for r in out.select(CLASHING).distinct().collect()} == {("x",) * len(CLASHING)}
    for call, added in ((lambda d: sharding.apply(d, 4, 1), sharding.ADDED), (quality_rules.apply, (*quality_rules.METRICS, "failed", "keep")), (bpe.encode, ("token_ids", "starts", "ends"))):
        own = [c for c in CLASHING if c.lower() not in added]
        assert {tuple(r) for r in call(docs).select(*own).distinct().collect()} == {("x",) * len(own)}
        assert [c.lower() for c in call(docs).columns].count(added[0]) == 1
    none = labels.where("false")
    assert mixing.rates(docs, none).where("abs(p_clean - 1 / 3D) < 1e-6").count() == n
    assert {r.probability for r in quality_classifier.score(docs, none).collect()} == {0.5}


def test_quality_rules_edges(docs):
    got = {(r.doc_id, r.failed) for r in quality_rules.apply(docs).select("doc_id", "failed").collect()}
    assert {(3, "too_few_words"), (4, "too_few_words"), (5, "too_few_words"), (1, ""), (9, "")} <= got


def test_quality_rules_on_runs_of_a_word(spark):
    runs = ["Der " * 50, "the x50 " + "to " * 15 + "the end", "a good line of the text\n" + "the " * 3000]
    good = ["the cat sat on the mat and that that he said was had had by all of the others", "no no", "", "the"]
    df = spark.createDataFrame(list(enumerate(runs + good)), "doc_id long, text string")
    assert {r.doc_id: r.failed for r in quality_rules.apply(df).select("doc_id", "failed").collect()} == {0: "repeated_words", 1: "repeated_words", 2: "repeated_words", 3: "", 4: "", 5: "too_few_words", 6: ""}
    assert {r.doc_id for r in quality_rules.accepted(df).collect()} == {3, 4, 6}


def test_exact_dedup_edges_collisions_and_huge(docs):
    kept = exact_dedup.without_copies(docs).select("doc_id", "text").collect()
    assert len(kept) == len({r.text or "" for r in kept}) == len({t or "" for _, t in ROWS})
    assert {(r.doc_id, r.text) for r in kept} >= {(1, ROWS[0][1]), (3, None), (6, LONG)}
    want = sorted(map(str, exact_dedup.report(docs).collect()))
    assert sorted(map(str, exact_dedup.mark(docs, huge=20).select("doc_id", "first_id", "copies", "is_copy").collect())) == want
    # moduli of 3 and 5: nearly all texts of a length collide, and comparison tells them apart
    assert sorted(map(str, exact_dedup.mark(docs, primes=(3, 5)).select("doc_id", "first_id", "copies", "is_copy").collect())) == want


def test_fingerprints_compose():
    x, y = b"some bytes " * 9000, b"others" * 5000
    p, b = exact_dedup.PRIMES[0], exact_dedup.BASES[0]
    one = lambda s: int(exact_dedup.fingerprints(np.frombuffer(s, np.uint8), np.array([0, len(s)]))[0][0])
    assert one(x + y) == (one(x) + pow(b, len(x), p) * one(y)) % p
    assert one(x[:999]) == sum((v + 1) * pow(b, i, p) for i, v in enumerate(x[:999])) % p


def _grams(text, n):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def _classes(texts, n, t):
    """class, links and copies of every text, by brute force."""
    sets = [frozenset(_grams(x or "", n)) for x in texts]
    distinct = list(dict.fromkeys(s for s in sets if s))
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    links = dict.fromkeys(distinct, 0)
    for a, b in itertools.combinations(distinct, 2):
        if len(a & b) >= t * len(a | b):
            links[a], links[b] = links[a] + 1, links[b] + 1
            root[find(b)] = find(a)
    first: dict = {}
    for i, s in enumerate(sets):
        if s:
            first.setdefault(find(s), i)
    return [(first[find(s)], links[s], sets.count(s)) if s else (i, 0, 1) for i, s in enumerate(sets)]


@pytest.mark.parametrize("tile,hot", [(2048, 10**9), (8, 10**9), (2048, 4)])
def test_ngram_join_is_brute_force(spark, monkeypatch, tile, hot):
    for name, value in (("TILE", tile), ("HOT_ROWS", hot), ("FREQUENT", 64 if hot > 9 else 2)):
        monkeypatch.setattr(ngram_join, name, value)
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    base = [list(r.choice(words, 40)) for _ in range(12)]
    texts = []
    for i in range(150):
        t = list(base[i % 12])
        for _ in range(int(r.integers(0, 6))):
            t[int(r.integers(0, 40))] = str(r.choice(words))
        texts.append(" ".join(t))
    texts += ["", "one two", "one two", "one two three", None, texts[5], texts[5], texts[5]]
    texts += [" ".join([*words[:16], *(f"u{i}-{j}" for j in range(12 - i % 9))]) for i in range(30)]
    want = _classes(texts, 3, 0.4)
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {int(x.doc_id): (int(x.class_id), x.links, x.copies) for x in ngram_join.report(df, 3, 0.4).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {int(x.doc_id) for x in ngram_join.one_of_each(df, 3, 0.4).collect()}
    assert kept == {i for i, (c, _, _) in enumerate(want) if c == i}


def test_ngram_join_links_no_rows_that_share_boilerplate_only(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ngram_join, "components", lambda edges, f=ngram_join.components: seen.append(edges.count()) or f(edges))
    head = " ".join(f"b{i}" for i in range(16))
    df = spark.range(3000).selectExpr("id AS doc_id", f"concat('{head} ', array_join(transform(sequence(1, 12 + id % 5), j -> concat('u', id, '-', j)), ' ')) AS text")
    assert ngram_join.report(df).where("links > 0 OR copies > 1 OR class_id <> doc_id").count() == 0 and seen[0] == 0


def test_chat_masks_are_brute_force(spark):
    rows = [(1, 1, "assistant", "Fine, thanks 🙂\n\nand you?"), (1, 0, "user", "How are you?"), (1, 2, "user", "<|im_end|> ok"), (1, 3, "assistant", ""), (2, None, None, None), (2, 0, "system", "x" * 300_000), (None, 0, "user", "lost"), (1, 1, "assistant", "Fine, thanks 🙂\n\nand you?"), (3, 0, "assistant", "日本語")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("token_ids", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_turns == 5
    codec = bpe.codec(bpe.default_vocabulary())
    for conv, r in got.items():
        turns = sorted(((x[1] is None, x[1] or 0, x[2] or "unknown", x[3] or "") for x in rows if x[0] == conv))
        text, spans = "", []
        for _, _, role, body in turns:
            text += f"<|im_start|>{role}\n"
            low = len(text.encode())
            text += f"{body}<|im_end|>"
            if role == "assistant":
                spans.append((low, len(text.encode())))
            text += "\n"
        assert r.text == text and r.token_ids == list(codec.tokenizer.encode(text, add_special_tokens=False).ids)
        at, mask = 0, []
        for i in r.token_ids:
            to = at + int(codec.sizes[i])
            mask.append(any(a < to and at < b for a, b in spans))
            at = to
        assert r.loss_mask == mask and r.n_targets == sum(mask) and at == len(text.encode())
    assert chat.format_chats(df.where("false")).count() == 0


def test_bpe_equals_the_library_and_round_trips(docs):
    codec = bpe.codec(bpe.default_vocabulary())
    for r in bpe.encode(docs, round_trip=True).select("doc_id", "token_ids", "starts", "ends", "decoded").join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        if r.doc_id == 7:  # two texts
            continue
        assert r.decoded == r.text
        if r.text is not None:
            found = codec.tokenizer.encode(r.text, add_special_tokens=False)
            assert r.token_ids == found.ids
            assert list(zip(r.starts, r.ends, strict=True)) == found.offsets
    split = codec.tokenizer.encode("🙂").ids
    spark = docs.sparkSession
    back = spark.createDataFrame([(split,), (split[:1],), ([],), (None,), ([10**6],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(back).collect()][2:] == ["", None, None]
    assert bpe.decode(back).first().decoded == "🙂" and "�" in bpe.decode(back).collect()[1].decoded


def test_sharding_is_a_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        rows = sharding.apply(spark.range(n).withColumnRenamed("id", "doc_id"), 3, 5).collect()
        assert sorted(r.position for r in rows) == list(range(n))
        assert all(r.slot * 3 + r.shard == r.position for r in rows)


def test_mixing_meets_targets_that_can_be_met(spark):
    r = np.random.default_rng(1)
    p = r.dirichlet([0.3, 0.3, 0.3], 600)
    table = spark.createDataFrame([(int(n), *map(float, x)) for n, x in zip(r.integers(1, 500, 600), p, strict=True)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    steps, got, want = mixing.solve(table, {"clean": 0.6, "low": 0.3, "toxic": 0.1}, total=60_000, cap=4.0)
    assert np.abs(got - want).max() < 0.01 * 60_000
    rate = np.ones(600)
    for s in steps:
        rate = np.clip(rate + p @ s, 0, 4)
    again = np.array([x.r for x in table.select(mixing._rate(steps, 4.0).alias("r")).collect()])
    assert np.allclose(np.sort(rate), np.sort(again))


def test_mixing_rates_are_an_independent_least_squares(spark):
    """Rates of real documents against projected gradient in plain numpy, run to the end with tiny steps."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    table = mixing.posteriors(docs, labels)
    rows = table.toPandas()
    p, n = rows[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), rows.n_tokens.to_numpy().astype(float)
    for targets, cap in (({"clean": 0.7, "low": 0.2, "toxic": 0.1}, 4.0), (mixing.TARGETS, 1.0), ({"clean": 0.1, "low": 0.1, "toxic": 0.8}, 2.0)):
        steps, got, want = mixing.solve(table, targets, cap=cap)
        rate = np.ones(len(n))
        a = p.T * n
        scale = np.linalg.eigvalsh((a / n.clip(1)) @ a.T).max()
        for _ in range(20_000):
            rate = np.clip(rate - p @ (a @ rate - want) / scale, 0, cap)
        best = ((a @ rate - want) ** 2).sum()
        own = np.ones(len(n))
        for s in steps:
            own = np.clip(own + p @ s, 0, cap)
        assert np.allclose(a @ own, got) and ((got - want) ** 2).sum() <= 1.02 * best + (1e-3 * want.sum()) ** 2


def test_context_vectors_and_pooling_are_dense_sums(spark):
    texts = ["the cat sat on the mat", "a dog and a cat", None, "", "the the the", "mat " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    place, sign = quality_classifier.index_vectors()
    words = [[int(b) for b in quality_classifier.buckets(pa.array([t], pa.string()))[0]] for t in texts]
    size = 1 << quality_classifier.BITS
    context, count = np.zeros((size, quality_classifier.WIDTH)), np.zeros(size)
    for doc in words:
        for i, w in enumerate(doc):
            count[w] += 1
            for j in range(max(0, i - quality_classifier.WINDOW), min(len(doc), i + quality_classifier.WINDOW + 1)):
                if i != j:
                    for k in range(quality_classifier.NONZERO):
                        context[w, place[doc[j], k]] += sign[doc[j], k]
    share = count / count.sum()
    want = context / np.maximum(np.linalg.norm(context, axis=1), 1)[:, None] * (quality_classifier.COMMON / (quality_classifier.COMMON + share))[:, None]
    got = quality_classifier.word_vectors(df)
    assert np.allclose(got, want, atol=1e-5)
    pooled = quality_classifier.pooled(pa.array(texts), got)
    assert np.allclose(pooled, [np.mean([want[w] for w in doc], axis=0) if doc else np.zeros(quality_classifier.WIDTH) for doc in words], atol=1e-5)


def test_the_bound_on_labelled_rows_binds(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(500)] + [(i, "x") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    from stratum.llm._labelled import sample

    rows = sample(docs, labels, 10).collect()
    assert len(rows) == 10 == len({r.doc_id for r in rows})


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = quality_classifier.score(docs, known).join(held, "doc_id").select("keep", "quality").collect()
    low, high = ([r.keep for r in scored if r.quality == q] for q in (0, 1))
    assert np.mean(high) > 0.98 and np.mean(low) < 0.3
    del scored
    mixed = mixing.posteriors(docs, known).join(held, "doc_id").select("p_toxic", "toxic").collect()
    print("toxic", [np.mean([r.p_toxic > 0.5 for r in mixed if r.toxic == t]) for t in (0, 1)])
    assert np.mean([r.p_toxic > 0.5 for r in mixed if r.toxic == 1]) > 0.8 and np.mean([r.p_toxic > 0.5 for r in mixed if r.toxic == 0]) < 0.03


def test_mixing_on_held_out_clean_rows_of_every_length(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0 AND quality = 1 AND toxic = 0")
    rows = mixing.rates(docs, known, cap=1.0).join(held.select("doc_id"), "doc_id").select("n_tokens", "rate").collect()
    found = {(a, b): [r.rate for r in rows if a <= r.n_tokens < b] for a, b in ((0, 20), (20, 50), (50, 100), (100, 500), (500, 10**9))}
    print("clean rates", {k: (len(v), round(float(np.mean(v)), 3)) for k, v in found.items()}, "all", np.mean([r.rate for r in rows]))
    assert all(np.mean(v) > 0.8 for v in found.values())


def test_licences_on_other_wordings():
    model, wrap = licences.train(), lambda t: "\n".join(textwrap.wrap(t, 40))
    cases = {
        "This software is released under the MIT License, see below.": "mit", "Code in this folder is licensed under the Apache License, Version 2.0.": "apache",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation": "gpl",
        "Distributed under the terms of the MIT license": "mit", "License: MIT": "mit", "GNU GPL v3": "gpl", "The code is BSD licensed.": "bsd", "Licensed under GPLv2+": "gpl", "Eclipse Public License - v 2.0": "epl",
        wrap(licences.TEMPLATES["mit"][4]): "mit", wrap(licences.TEMPLATES["isc"][3]): "isc", "# " + wrap(licences.TEMPLATES["gpl"][4]).replace("\n", "\n# "): "gpl", "Photos are CC BY-SA 4.0, the rest is not.": "cc-by-sa",
        "Licensed under the Frobnitz License": "none", "Er kam mit dem Auto.": "none", "Their public license plates were stolen.": "none", "The students of the apache region met under the tree.": "none",
        "All content here is Licensed under CC BY-NC 4.0.": "cc-by-nc", "The mit of the town was licensed.": "none", "He renewed his driving license under the old law.": "none", "": "none", "a line\n\n" * 3 + "Released under the ISC License.": "isc",
    }
    got = licences.scanned(pa.array(list(cases)), model)
    assert [g[1] for g in got] == list(cases.values())
    assert got[-1][3] == 3 and got[-2][0] == 0


def test_licence_windows_are_brute_force():
    """Exact forms are found wherever they stand, word by word, the longest first."""
    model = licences.train()
    every = {x: f for f in licences.TEMPLATES for x in licences.forms(f)}
    r = np.random.default_rng(4)
    chosen = [list(every)[i] for i in r.choice(len(every), 60, replace=False)]
    texts = [f"alpha beta {x} gamma delta" for x in chosen]
    for text, g in zip(texts, licences.scanned(pa.array(texts), model), strict=True):
        words, best = text.split(), []
        for x in every:
            own = x.split()
            best += [(-len(own), i, every[x]) for i in range(len(words) - len(own) + 1) if words[i : i + len(own)] == own]
        assert min(best)[2] in g[2]


SAID = {"Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache", "Licensed under the GNU General Public License, version 2.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary", "SPDX-License-Identifier: MIT": "mit", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License.": "cc-by-sa"}


@pytest.fixture(scope="module")
def scanner(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 300").select("text").collect()]
    return licences.train(), [w for t, g in zip(texts, licences.scanned(pa.array(texts), licences.train()), strict=True) if g[1] == "none" for w in (t or "").split()]


def test_licences_inside_long_paragraphs(scanner):
    model, words = scanner
    r = np.random.default_rng(2)
    for k in (0, 10, 25, 50, 200, 1000, 5000):
        texts = []
        for said in SAID:
            around = list(r.choice(words, k))
            cut = int(r.integers(0, k + 1))
            texts.append(" ".join([*around[:cut], said, *around[cut:]]))
        got = licences.scanned(pa.array(texts), model)
        print(k, [g[2] for g in got])
        assert [g[2] for g in got] == [[f] for f in SAID.values()]
    wrapped = licences.TEMPLATES["bsd"][4].split()
    got = licences.scanned(pa.array([f"{' '.join(words[:80])}\n# {' '.join(wrapped[:7])}\n# {' '.join(wrapped[7:])}\n{' '.join(words[80:160])}", " ".join(words[:3000])]), model)
    assert [g[2] for g in got] == [["bsd"], []]


def test_licences_of_a_line_with_two(scanner):
    cases = {
        "Licensed under the MIT License or the Apache License, Version 2.0, at your option.": ["apache", "mit"], "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["apache", "mit"],
        "Dual licensed under the MIT License and the GNU General Public License, version 2.": ["gpl", "mit"], "This library is licensed under the GNU Lesser General Public License, version 3.": ["lgpl"],
    }
    assert [g[2] for g in licences.scanned(pa.array(list(cases)), scanner[0])] == list(cases.values())


def test_warc_stream(spark, tmp_path):
    big = bytes(range(256)) * 5000
    rows = [(1, "http://a/1", bytearray(big)), (2, None, bytearray(b"x")), (3, "http://a/\r\nb", None), (None, "http://a/4", bytearray(b"WARC/1.0\r\n\r\n")), (5, "http://é/5", bytearray()), (1, "http://a/1", bytearray(big))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("chunk", F.lit(1))
    files = warc.write(pages, f"file://{tmp_path}/w")
    out = warc.read_listed(files.select("path"), 1000).collect()
    assert sum(r.last for r in out) == len(rows) and all(r.valid and r.complete for r in out if r.last) and max(len(r.chunk) for r in out) == 1000
    one = sorted((r.start, bytes(r.chunk), r.digest) for r in out if r.page_id == "1")[::2]
    assert b"".join(c for _, c, _ in one) == big
    assert all(d == hashlib.sha1(big[: s + len(c)]).hexdigest() for s, c, d in one)
    assert {r.uri for r in out if r.page_id == "3"} == {"http://a/%0D%0Ab"}
    assert warc.write(pages.where("false"), f"file://{tmp_path}/e").count() == 0
    plain = b"noise\r\n" + b"".join(warc.record(1, "u", b"abc")) + b"".join(warc.record(2, "u", b"abcdef"))[:-6]
    (tmp_path / "p.warc").write_bytes(plain)
    assert [(r.page_id, bytes(r.chunk), r.complete) for r in warc.read(spark, [str(tmp_path / "p.warc")]).collect()][-1][2] is False
    got = warc.payloads(warc.read_listed(files.select("path"), 1000)).collect()
    assert {bytes(r.payload) for r in got} == {bytes(b or b"") for _, _, b in rows}


def _seen(blocks):
    return [(h.get("x-page-id"), n, bytes(d), complete) for h, n, _, d, _, _, complete, _ in warc.records(blocks, 100)]


def test_warc_damage_ends_no_job():
    import gzip

    one, two, three = (b"".join(warc.record(i, "u", bytes([64 + i]) * 10)) for i in (1, 2, 3))
    whole = [("1", 0, b"A" * 10, True), ("2", 0, b"B" * 10, True), ("3", 0, b"C" * 10, True)]
    pack = [gzip.compress(x) for x in (one, two, three)]
    for size in (1, 7, 10**6):  # in blocks of any size
        cut = lambda b: [b[i : i + size] for i in range(0, len(b), size)]  # noqa: E731, B023
        assert _seen(cut(b"".join(pack))) == whole and _seen(cut(b"\0\0\0".join(pack) + b"\0" * 9)) == whole and _seen(cut(one + two + three)) == whole
        assert _seen(cut(pack[0] + b"rubbish" + pack[1])) == [whole[0], (None, 0, b"", False), whole[1]]
        assert _seen(cut(pack[0] + b"rubbish")) == [whole[0], (None, 0, b"", False)]
        bad = bytearray(pack[1])
        bad[len(bad) // 2 :] = b"\xff" * (len(bad) - len(bad) // 2)
        got = _seen(cut(pack[0] + bytes(bad) + pack[2]))
        assert got[0] == whole[0] and got[-1] == whole[2] and all(not x[3] for x in got[1:-1]) and len(got) > 2
    assert _seen([b"WARC/1.0\r\n" + b"a" * (warc.HEADER_BYTES + 9) + b"\r\n\r\n" + two]) == [(None, 0, b"", False), whole[1]]
    assert _seen(["WARC/1.0\r\nX-Page-Id: 9\r\nContent-Length: ²\r\n\r\n".encode() + two]) == [("9", 0, b"", True), whole[1]]


def test_word_hashes_depend_on_bytes_alone():
    column = pa.array(["alpha beta", None, "", "beta  gamma\nalpha", "x" * 300_000 + " beta"])
    raw, offsets = T.buffers(column)
    starts, ends, owner = T.words(raw, offsets)
    h = T.span_hashes(raw, starts, ends)
    assert owner.tolist() == [0, 0, 3, 3, 3, 4, 4] and h[1] == h[2] == h[6] and h[0] == h[4] != h[1]


def test_pipeline_is_its_stages_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()}
    good = {r.doc_id: r.text or "" for r in quality_rules.apply(docs).where("keep").select("doc_id", "text").collect()}
    first: dict = {}
    for i in sorted(good):
        first.setdefault(good[i], i)
    rest = sorted(first.values())
    sets = {i: _grams(good[i], ngram_join.N) for i in rest}
    root = {i: i for i in rest}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, j in itertools.combinations(rest, 2):
        if sets[i] and len(sets[i] & sets[j]) >= ngram_join.THRESHOLD * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    unique = [i for i in rest if find(i) == i]
    kept = {r.doc_id for r in mixing.sample(docs.where(F.col("doc_id").isin(unique)), spark.read.parquet(f"{SF}/labels.parquet")).select("doc_id").collect()}
    assert set(got) == kept
    codec = bpe.codec(bpe.default_vocabulary())
    assert all(got[i] == codec.tokenizer.encode(good[i], add_special_tokens=False).ids for i in got)
    assert [n for n, _ in corpus_pipeline.STAGES]


def test_pipeline_on_edge_rows_and_empty_tables(spark, tmp_path, docs, labels):
    import corpus_pipeline

    for name, rows in (("some", docs.drop("a_map")), ("none", docs.drop("a_map").where("false"))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some")
    own = [c for c in CLASHING if c.lower() not in ("token_ids", "starts", "ends")]
    rows = out.select("doc_id", "text", "token_ids", *own).collect()
    assert set(out.columns) == {"doc_id", "text", *own, "token_ids", "starts", "ends"}
    assert {r.text for r in rows} <= {t for _, t in ROWS if t and t.strip()} and len({r.text for r in rows}) == len(rows)
    assert all(tuple(r)[3:] == ("x",) * len(own) and r.token_ids for r in rows)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    kept = docs.drop("a_map")
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, f"{tmp_path}/some").cache()
        assert kept.columns == docs.drop("a_map").columns
    assert {r.doc_id for r in kept.collect()} == {1, None, 7, 8, 9}  # the long text has no stop words
