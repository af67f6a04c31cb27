"""Operators against brute force, round trips and defined edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmark.llm import automaton, decontaminate, language_model, licences, lines, mixing, near_duplicates, packing, quality, secrets, token_files, url_filters
from rillmark.llm.components import components
from rillmark.llm.queries import VOCABULARY, tokenizer_path
from rillmark.llm.words import chunks
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, id string"
W = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(W) + r.choice("abcdefgh") + r.choice("xyz") for _ in range(n))


def edge_rows():
    """Nulls, empty and long texts, copies, near copies, ties, and columns named like internal ones."""
    base = prose(1, 60)
    texts = [None, "", "  \n ", "one two", "ONE two", "one two three", base, base, base.replace("\n", " ") + " extra", prose(2, 60),
             prose(3, 6000), prose(3, 6000) + " tail", "\n".join([prose(4, 30)] * 3), "é" * 50 + " " + prose(5, 20), prose(6, 12)]
    return [(k, t, None if k % 4 == 0 else "en", None if k % 3 == 0 else f"s{k % 2}", 1, 7, "x") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_jaccard_classes(request, which):
    df = request.getfixturevalue(which)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates.jaccard_classes(df).collect()}
    assert got == brute.components(texts_of(df))


def test_jaccard_groups(spark):
    """A large group of near copies with outsiders that share a passage."""
    r, base, rows = random.Random(4), prose(9, 120).split(), []
    for k in range(300):
        own = list(base)
        for _ in range(k % 6):
            own[r.randrange(120)] = f"w{k}"
        rows.append((k, " ".join(own if k % 5 else base[:30] + prose(100 + k, 40 + k % 50).split())))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_duplicates.jaccard_classes(df).collect()}
    assert got == brute.components(dict(rows))


def test_components(spark):
    rows = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 100), (95, 100), (7, 7), (None, 3)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 95: 90, 100: 90}


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_repeated_lines(request, which):
    df = request.getfixturevalue(which)
    removed = lines.repeated_lines(df)
    got = [(r["doc_id"], r["line"]) for r in removed.collect()]
    assert sorted(got) == sorted(brute.repeated_lines(texts_of(df)))
    kept = lines.without_repeats(df, removed)
    assert kept.columns == df.columns and kept.count() == df.count()


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_quality_counts(request, which):
    df = request.getfixturevalue(which)
    texts = texts_of(df)
    rows = quality.judge(df).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_quality_estimate(spark):
    """Contaminated normal data: the estimate follows the clean rows, the distance finds the others."""
    rng = np.random.default_rng(2)
    clean = rng.normal([5, 1, 0.5, 0.5], [0.6, 0.4, 0.3, 0.3], (900, 4))
    bad = rng.normal([9, 6, 4, 4], 0.1, (200, 4))
    rows = [("a", *map(float, x)) for x in np.vstack((clean, bad))]
    got = quality.covariance(spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, x4 double")).first()
    centre = np.array([got[f"m{i}"] for i in range(4)])
    inverse = np.array([[got[f"p{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    assert np.abs(centre - clean.mean(axis=0)).max() < 0.15
    square = lambda x: np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
    assert square(bad).min() > 5 * square(clean).max()


@pytest.mark.parametrize("equal", [True, False])
def test_quality_third(spark, equal):
    """A third of a group is symbol spam, copied or each row its own."""
    spam = lambda k: " ".join(w + " ####|$" for w in prose(1000 + k, 40).split())
    rows = [(k, prose(k, 60), "en", "s") for k in range(400)] + [(400 + k, spam(0 if equal else k), "en", "s") for k in range(200)]
    judged = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert not judged.filter("base_failed").count()
    assert sorted(r["doc_id"] for r in judged.filter("kept").collect()) == list(range(400))


def test_chi2():
    assert abs(quality.chi2_quantile(0.95, 4) - 9.4877) < 1e-3


def test_contained(spark, edge, empty):
    item = prose(50, 24)
    items = [(1, item), (2, item.upper()), (3, "too short"), (4, None), (5, prose(51, 40)), (None, item)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    half = " ".join(item.split()[:20])
    rows = [(1, prose(60, 500) + " " + item + " " + prose(61, 500)), (2, half + " x"), (3, prose(62, 300)), (4, None), (None, item), (5, "")]
    found = decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 20, 20), (1, 2, 20, 20), (2, 1, 20, 16), (2, 2, 20, 16)]
    few = [(10, "One two three four"), (11, "gamma"), (12, "two three"), (13, "two four"), (14, " "), (15, "a b"), (15, item), (16, "one two")]
    rows += [(6, "zero ONE two  three\nfour five six"), (7, "two three"), (8, "one"), (9, "a b gamma ray"), (9, "gamma gamma"), (10, None)]
    for own in (few, few[:1], [(10, "one two three four")] + items):
        got = decontaminate.contained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string"))
        whole = {i for i, t in own if len(brute.words(t)) >= 5}
        want = {(d, i, 1, 1) for d, t in rows for i, x in own for w, n in ((brute.words(t), len(brute.words(x))),)
                if d is not None and i is not None and i not in whole and 0 < n < 5 and any(w[k : k + n] == brute.words(x) for k in range(len(w)))}
        assert {tuple(r) for r in got.collect() if r["n_runs"] == 1} == want and want
    assert decontaminate.contained(edge, bench.limit(0)).count() == 0
    assert decontaminate.contained(empty, bench).count() == 0


def plain_mix(rows, weights=(5, 2, 1)):
    """Targets by repeated capping."""
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + len(brute.words(text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * size[s] if s in capped else left * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * size[s]}
        if not over:
            return size, target
        capped |= over


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    size, target = plain_mix(rows)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)
    assert len(got) == len(rows)
    for source in size:
        own = [r for r in got if r["source"] == source]
        assert {r["source_size"] for r in own} == {size[source]}
        assert abs(own[0]["target"] - target[source]) < 1e-6 * max(1, target[source])
        assert abs(sum(r["taken"] for r in own) - target[source]) <= max(r["size"] for r in own) + 1e-6
    assert all(r["size"] == len(brute.words(t)) and r["taken"] <= 2 * r["size"] for r, (_, t, _) in zip(sorted(got), sorted(rows)))


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_packing(n):
    rng = np.random.default_rng(n)
    for values in (rng.integers(0, 49_408, n), rng.integers(0, 2, n), np.zeros(n), 1 << rng.integers(0, 60, n),
                   np.where(rng.random(n) < 0.1, (1 << 63) + 5, rng.integers(0, 99, n).astype(np.uint64))):
        values = values.astype(np.uint64)
        stored, frames = packing.pack(values)
        assert (packing.unpack(stored, frames, n) == values).all()


def test_encoder():
    from tokenizers import Tokenizer

    path = tokenizer_path(VOCABULARY)
    plain, own, r = Tokenizer.from_file(path), token_files.Encoder(path), random.Random(3)
    letters = "aB.,' \t\n'sS'tT1²é́İİΣ<|>endoftext!?-_\x0b\x85 ​日"
    texts = [None, "", "Hello.World, it's <|endoftext|> x<|ENDOFTEXT|>y"] + ["".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(4000)]
    for first, flat, offsets in chunks(pa.array(texts, pa.string())):
        ids, count = own.encode(flat, offsets)
        want = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts[first : first + len(count)]]
        assert ids.tolist() == [x for w in want for x in w] and count.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("which", ["docs", "edge"])
def test_token_files(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    plain, start, want = Tokenizer.from_file(tokenizer_path(VOCABULARY)), 0, []
    for doc, text in sorted(texts_of(df).items()):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.encoded(df, tokenizer_path(VOCABULARY)).collect())) == want


def test_scanner():
    patterns = [r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]+", "[0-9a-f]+"]
    enough = [lambda m: len(m[2]) >= 6, lambda m: len(m[0]) >= 20, lambda m: len(m[0]) >= 24]
    own, r = automaton.Scanner(secrets.BASE), random.Random(1)
    assert len(own.masks) < own.states_before
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "abcdef0123456789", "g", "=="]
    for _ in range(5000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(25)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, text) if enough[k](m))
        assert own.scan(text.encode()) == want
    with pytest.raises(ValueError):
        automaton.Scanner((automaton.Rule("x", "abcd|b"),))


def test_secrets(spark, edge):
    rows = [(1, "é token=abcdefgh é", 0), (2, None, 0), (3, "", 0), (3, "AKIA" + "A1" * 8, 0), (None, "x" * 9000 + "f" * 30, 0)]
    found = secrets.digest(secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string, spans long")))
    got = sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["spans"]) for r in found.collect())
    assert got == [(0, 0, 0, 1, "hex:9000:9030"), (1, 1, 0, 0, "assign:2:16"), (2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (3, 0, 1, 0, "access:0:20")]
    assert secrets.find_secrets(edge).count() == edge.count()
    assert secrets.redacted("a token=abcdefgh b", [{"kind": "assign", "start": 2, "end": 16}]) == "a [assign] b"


def test_urls(spark):
    rows = [(1, "http://a.org/fr/x", '<a href="https://b.com/">'), (2, "http://B.com", "<a href=//c.com/x>"), (3, "http://s.com/y?q", "<A class='q' HREF='http://bad.net/z'>"),
            (4, "http://bad.net/", "x"), (5, None, None), (6, "nourl", ""), (7, "https://x.example.net/en/1#t", None), (7, "https://x.example.net/de/", None)]
    got = {(r["page_id"], r["path"]): (r["host"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(1, "/fr/x"): ("a.org", "org/fr/", "allow"), (2, ""): ("b.com", None, "allow"), (3, "/y"): ("s.com", None, "block"), (4, "/"): ("bad.net", "net/", "block"),
                   (5, ""): ("", None, "allow"), (6, ""): ("", None, "allow"), (7, "/en/1"): ("x.example.net", "example.net/en/", "allow"), (7, "/de/"): ("x.example.net", "net/", "block")}


def test_propagation(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1)]
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("distrust", "c", 1.0)], "kind string, host string, score double")
    got = {(r["kind"], r["host"]): r["score"] for r in url_filters.propagate(seeds, spark.createDataFrame(edges, "source string, target string, weight long")).collect()}
    for kind, seed, turn in (("trust", "a", False), ("distrust", "c", True)):
        own = [(b, a, w) for a, b, w in edges] if turn else edges
        total = {}
        for a, _, w in own:
            total[a] = total.get(a, 0) + w
        rank = {h: 0.15 * (h == seed) for h in "abc"}
        for _ in range(200):
            rank = {h: 0.15 * (h == seed) + 0.85 * sum(rank[a] * w / total[a] for a, b, w in own if b == h) for h in "abc"}
        for h in "abc":
            assert abs(got.get((kind, h), 0) - rank[h]) < 1e-6


def test_propagation_over_a_large_graph(spark):
    """Thousands of hosts with hubs, cycles, hosts without links and a chain of forty, against matrix powers."""
    r = np.random.default_rng(4)
    n = 3000
    pairs = {(int(a), int(b)) for a, b in zip(r.integers(0, n - 500, 6000), r.zipf(1.5, 6000) % n) if a != b}
    pairs |= {(k, k + 1) for k in range(2600, 2640)} | {(2640, 2630), (2700, 2701)}
    edges = [(f"h{a}", f"h{b}", int(r.integers(1, 5))) for a, b in sorted(pairs)]
    seeds = {("trust", int(k)): float(r.random()) for k in r.integers(0, n, 60)} | {("trust", 2600): 1.0} | {("distrust", int(k)): 1.0 for k in r.integers(0, n, 30)} | {("distrust", 2640): 1.0}
    got = {(x["kind"], x["host"]): x["score"] for x in url_filters.propagate(
        spark.createDataFrame([(k, f"h{h}", s) for (k, h), s in seeds.items()], "kind string, host string, score double"),
        spark.createDataFrame(edges, "source string, target string, weight long")).collect()}
    weight = np.zeros((n, n))
    for a, b, w in edges:
        weight[int(a[1:]), int(b[1:])] = w
    for kind, matrix in (("trust", weight), ("distrust", weight.T)):
        step = matrix / np.maximum(matrix.sum(axis=1, keepdims=True), 1)
        start = np.array([seeds.get((kind, k), 0.0) for k in range(n)])
        rank = np.linalg.solve(np.eye(n) - 0.85 * step.T, 0.15 * start)
        assert np.abs(rank - np.array([got.get((kind, f"h{k}"), 0.0) for k in range(n)])).max() < 1e-4 * rank.max()
    assert got["trust", "h2630"] > 0 and got["distrust", "h2600"] > 0


def test_language_model(spark, edge, empty):
    rows = [(k, prose(k, 80)) for k in range(20)] + [(100 + k, " ".join(["lorem", "ipsum", "dolor", "sit", "amet"] * 16)) for k in range(20)] + [(500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(100 + k,) for k in range(10)] + [(100,), (None,)], "doc_id long")
    got = {r["doc_id"]: r for r in language_model.score(df, target).collect()}
    assert len(got) == len(rows) and got[500]["score"] is None and got[501]["n_tokens"] == 0
    assert max(got[100 + k]["score"] for k in range(20)) < min(got[k]["score"] for k in range(20))
    assert language_model.score(edge, target.limit(0)).count() == edge.count()
    assert language_model.score(empty, target).count() == 0


@pytest.mark.parametrize("frequent", [4, 1 << 18])
def test_language_model_whole(spark, monkeypatch, frequent):
    """Every word and pair counts, however few of them a task holds itself."""
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    monkeypatch.setattr(language_model, "BUCKET", 500)
    rows = [(k, prose(k, 150) + (" often" * 40 if k % 3 else " often rare" * 3)) for k in range(40)] + [(40, "once"), (41, prose(3, 150)), (41, "x x x"), (42, None), (43, " ")]
    rows += [(None, "often rare x"), (44, "x"), (44, "x"), (45, prose(1, 3000))]
    marks = set(range(0, 45, 4))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = language_model.score(df, spark.createDataFrame([(k,) for k in marks], "doc_id long")).drop("score").collect()
    want = [(k, *loss) for (k, _), loss in zip(rows, brute.lm_losses(rows, marks))]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_language_model_given(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    marks = {k for k, _ in rows if k % 3 == 0}
    got = {r["doc_id"]: tuple(r)[1:4] for r in language_model.score(docs, spark.createDataFrame([(k,) for k in marks], "doc_id long")).collect()}
    for (k, _), loss in zip(rows, brute.lm_losses(rows, marks, 30)):
        assert got[k] == pytest.approx(loss, abs=1e-9)


def test_licences(spark, docs):
    model = licences.Classifier(*licences.training_set(docs))
    assert model.accuracy > 0.95  # on rows held out of the training
    rows = [(1, prose(1, 30) + "\nReleased under the MIT License.\n" + prose(2, 40)), (2, prose(3, 90)), (3, None), (4, ""),
            (5, "This work is licensed under the GNU General Public License, version 3."), (6, "the licence of poets is under review by the general public")]
    got = {r["doc_id"]: [(x["family"], x["line"]) for x in r["found"]] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: [("mit", 1)], 2: [], 3: [], 4: [], 5: [("gpl-3.0", 0)], 6: []}


def test_licence_families(spark, docs):
    """Near families are told apart, families outside the set are unknown, short notices are found; precision on held-out rows."""
    model = licences.Classifier(*licences.training_set(docs))
    assert model.accuracy > 0.97 and min(model.precision.values()) > 0.9
    free = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
    texts = {
        free.format("Lesser", ";", "2.1"): "lgpl-2.1", free.format("Lesser", ",", "3"): "lgpl-3.0", free.format("Affero", ",", "3"): "agpl-3.0",
        free.format("", ",", "3").replace("  ", " "): "gpl-3.0", free.format("", ";", "2").replace("  ", " "): "gpl-2.0",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "isc",
        "Distributed under the MIT license (see LICENSE).": "mit", "released under the BSD 2-clause license": "bsd-2-clause", "Licensed under the New BSD License.": "bsd-3-clause",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0", "Licensed under CC BY-SA 4.0.": "cc-by-sa-4.0",
        "This program is made available under the terms of the Eclipse Public License 2.0.": None, "Licensed under the EUPL, Version 1.2.": None,
        "The MIT students were granted a license to sell beer, free of charge, to any person.": None, "It was published by the Free Software Foundation.": None}
    rows = [(2 * k + wrapped, prose(k, 30) + "\n\n" + (text if not wrapped else "# " + text.replace(" under ", "\n# under ")) + "\n\n" + prose(50 + k, 300))
            for k, text in enumerate(texts) for wrapped in (0, 1)]
    got = {r["doc_id"]: [(x["family"], x["line"]) for x in r["found"]] for r in licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for k, family in enumerate(texts.values()):
        assert got[2 * k] == got[2 * k + 1] == ([(family, 2)] if family else [])


def test_licence_windows():
    """Every stretch of a notice's length lies in a window, windows keep to their paragraph, sums equal direct logits."""
    r = random.Random(7)
    text = "\n\n".join(" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 5, 47, 96, 97, 300]))) for _ in range(20)).encode()
    words = licences.Words(np.frombuffer(text, np.uint8), np.array([0, 0, 50, len(text)]))
    low, high = words.windows()
    assert (high > low).all() and (words.paragraph[low] == words.paragraph[high - 1]).all()
    most = max(len(t.split()) for some in licences.TEMPLATES.values() for t in some)
    assert most <= max(licences.WINDOWS) // 2
    for n in (3, 6, 12, most):
        size = next(w for w in licences.WINDOWS if w >= 2 * n)
        for k in range(len(words.starts) - n):
            if words.paragraph[k] == words.paragraph[k + n - 1]:
                assert ((low <= k) & (k + n <= high) & (high - low <= size)).any()
    model = licences.Classifier(["a b c", "mit license", "x y z w"] * 8, [licences.UNKNOWN, 5, licences.UNKNOWN] * 8, steps=5)
    some = ["w1 w2 w3 w1", "w4", "", "w5 w5 mit license"]
    own = licences.Words(np.frombuffer(" \n\n".join(some).encode(), np.uint8), np.array([0, len(" \n\n".join(some))]))
    low, high = (x[-3:] for x in own.windows())  # of the largest size
    assert np.allclose(model.window_logits(own.hashes, low, high), model.logits(*licences.text_features([t for t in some if t])))


def test_licences_wrapped(spark, docs):
    """Notices over several lines, behind comment marks, inside a paragraph and far into a long line."""
    model = licences.Classifier(*licences.training_set(docs))
    rows, want, key = [], {}, 0
    for family in ("gpl-3.0", "mit", "bsd-3-clause", "apache-2.0"):
        words = max(licences.TEMPLATES[family], key=len).split()
        lines = [" ".join(words[k : k + 8]) for k in range(0, len(words), 8)]
        for mark in ("", "# ", " * ", "// "):
            head = f"{mark}{prose(key, 9)}\n{mark}\n"
            rows.append((key, head + "\n".join(mark + x for x in lines) + f"\n{mark}\n{prose(key + 1, 20)}"))
            want[key], key = [(family, 2)], key + 1
        rows.append((key, prose(key, 30) + "\n" + "\n".join(lines) + "\n" + prose(key + 1, 30)))
        want[key], key = [(family, 1)], key + 1
        for before in (30, 37, 45):
            rows.append((key, prose(key, before) + " " + " ".join(words) + " " + prose(key + 1, 90)))
            want[key], key = [(family, 0)], key + 1
    rows.append((key, "Released under the MIT License.\nReleased under the MIT License.\n\nx"))
    want[key] = [("mit", 0), ("mit", 1)]
    scanned = licences.scan_licences(spark.createDataFrame(rows, "doc_id long, text string"), model)
    assert {r["doc_id"]: [(x["family"], x["line"]) for x in r["found"]] for r in scanned.collect()} == want


def test_empty(empty):
    for found in (near_duplicates.jaccard_classes(empty), lines.repeated_lines(empty), quality.judge(empty), mixing.mix(empty),
                  token_files.encoded(empty, tokenizer_path(VOCABULARY)), secrets.find_secrets(empty),
                  url_filters.judge_urls(empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))):
        assert found.count() == 0


def test_pipeline(spark, docs):
    """Every stage on what its predecessor kept, against brute force, with columns named like internal ones."""
    import corpus_pipeline as pipeline

    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "decontamination", "mixing", "token_files"]
    extra = ["h", "copies", "_copy", "_0", "_2", "component_id", "kept", "taken", "item_id"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(extra)))
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    kept = pipeline.quality_rules(spark, wide, SF)
    verdict = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert ids(kept) == sorted(verdict)
    texts = {i: t for i, t in texts_of(docs).items() if i in verdict}
    first = pipeline.near_duplicates(spark, kept, SF)
    assert ids(first) == sorted({c for _, c in brute.components(texts).values()})
    items = [brute.shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = pipeline.decontamination(spark, first, SF)
    assert ids(clean) == [i for i in ids(first) if not any(100 * len(x & brute.shingles(texts[i])) >= 75 * len(x) for x in items)]
    mixed = pipeline.mixing(spark, clean, SF)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in clean.collect()]
    size, target = plain_mix(rows)
    taken, source = Counter(ids(mixed)), {i: s for i, _, s in rows}
    for s in size:
        words = sum(n * len(brute.words(texts[i])) for i, n in taken.items() if source[i] == s)
        assert abs(words - target[s]) <= max(len(brute.words(t)) for _, t, x in rows if x == s)
    assert set(taken.values()) <= {1, 2}
    for stage in (kept, first, clean, mixed):
        assert stage.columns == wide.columns and stage.select(extra).distinct().collect() == [tuple(range(len(extra)))]
    done = pipeline.token_files(spark, mixed, SF)
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(tokenizer_path(VOCABULARY)), 0
    for r in sorted(done.collect(), key=lambda r: r["start"]):
        own = np.array([*tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1], "<u4")
        assert tuple(r)[1:] == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    assert done.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and ids(done) == sorted(taken.elements())


def test_pipeline_edges(spark, edge, empty):
    """Null ids pass the filters and are mixed never; repeated ids stay or go together; empty tables pass."""
    import corpus_pipeline as pipeline

    rows = edge.union(edge.filter("doc_id = 9")).union(edge.filter("doc_id = 10").withColumn("doc_id", F.lit(None).cast("long")))
    kept = pipeline.quality_rules(spark, rows, SF)
    first = pipeline.near_duplicates(spark, kept, SF)
    clean = pipeline.decontamination(spark, first, SF)
    got = [r["doc_id"] for r in clean.select("doc_id").collect()]
    assert got.count(9) in (0, 2) and got.count(None) == 1
    mixed = pipeline.mixing(spark, clean, SF)
    assert None not in [r["doc_id"] for r in mixed.select("doc_id").collect()]
    docs = empty
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
