"""Packing into sequences against the tokenizer, brute force on small counts and defined edge cases."""

import random
import zlib
from collections import Counter, defaultdict
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pytest

from rillmark.llm import sequences
from rillmark.llm.queries import QUERIES, VOCABULARY, tokenizer_path

SF = "/root/testdata/sf0.01"
PATH = tokenizer_path(VOCABULARY)


def token_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def least(counts, capacity):
    """Fewest sequences for a handful of pieces, by trying all."""

    @cache
    def need(left):
        if not left:
            return 0
        rest, best = left[1:], len(left)

        def choose(k, room, kept):
            nonlocal best
            if k == len(rest):
                best = min(best, 1 + need(tuple(kept)))
                return
            if rest[k] <= room:
                choose(k + 1, room - rest[k], kept)
            choose(k + 1, room, [*kept, rest[k]])

        choose(0, capacity - left[0], [])
        return best

    return need(tuple(sorted(counts, reverse=True)))


def checked(rows, capacity):
    """Sequences of packed rows: none too long, no gap, every document whole; returns how many."""
    own, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    for places in own.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    for pieces in docs.values():
        for k, (piece, start, length) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, k * capacity) and (length == capacity or k == len(pieces) - 1)
    return len(own)


def test_given_documents(spark):
    rows = QUERIES["op11_sequence_packing"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    n = checked(rows, 4096)
    assert n == max(-(-sum(r["length"] for r in rows) // 4096), sum(r["length"] > 2048 for r in rows))
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in random.Random(1).sample(rows, 150):
        ids = token_ids(texts[r["doc_id"]])
        own = ids[4096 * r["piece"] : 4096 * (r["piece"] + 1)]
        assert (r["length"], r["ids_crc32"]) == (len(own), crc(own))
        assert any(s["piece"] == (len(ids) - 1) // 4096 for s in rows if s["doc_id"] == r["doc_id"])


@pytest.mark.parametrize("capacity", [1, 7, 64])
def test_sequences_hold_the_ids(spark, capacity):
    """Small capacities cut most texts; nulls, empty texts, clashing columns; more than a third of the rows are copies."""
    texts = [None, "", " \n", "one", "ONE two, three.", "a longer text " * 30, "naïve façade 你好 €5"] + ["copy of a text"] * 6
    rows = [(k, t, 1, "n", 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, rank string, block long").repartition(4)
    assert checked(sequences.pack(df, PATH, capacity).collect(), capacity) >= 1
    found, whole = sequences.sequences(df, PATH, capacity).collect(), defaultdict(list)
    for r in found:
        assert len(r["ids"]) <= capacity
        for k, (doc, at) in enumerate(zip(r["doc_ids"], r["offsets"])):
            whole[doc].append(r["ids"][at : (r["offsets"] + [len(r["ids"])])[k + 1]])
    for doc, text, *_ in rows:
        ids = token_ids(text)
        assert sorted(whole[doc]) == sorted(ids[k : k + capacity] for k in range(0, len(ids), capacity))


def test_repeated_rows_null_ids_and_empty(spark):
    """Repeated rows are documents of their own, null ids stay."""
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (3, None)], schema)
    rows = sequences.pack(df, PATH).collect()
    assert Counter((r["doc_id"], r["length"]) for r in rows) == {(None, 3): 2, (3, 2): 2, (3, 1): 1}
    assert len({r["sequence_id"] for r in rows}) == 1 and sorted(r["offset"] for r in rows) == [0, 3, 6, 8, 10]
    assert sequences.pack(spark.createDataFrame([], schema), PATH).collect() == []
    assert sequences.sequences(spark.createDataFrame([], schema), PATH).collect() == []


def test_sums_of_lengths():
    """The index holds all ways to add up one, two or three of the lengths that are left."""
    r = np.random.default_rng(1)
    for _ in range(40):
        counts = np.bincount(r.integers(1, 41, 9), minlength=41)
        sums = sequences._Sums(counts.copy())
        for x in r.permutation(np.flatnonzero(counts)):
            there = (sums.counts > 0).astype(int)
            two = np.convolve(there, there)[:41]
            assert (sums.one == there).all() and (sums.two == two).all() and (sums.three == np.convolve(two, there)[:41]).all()
            found = sums.find(40 - int(x), int(x), 3)
            lengths = np.repeat(np.arange(41), sums.counts).tolist()
            lengths.remove(int(x))
            some = [c for k in (1, 2, 3) for c in combinations_with_replacement(sorted(set(lengths)), k) if sum(c) == 40 - x and not Counter(c) - Counter(lengths)]
            assert (found is None) == (not some) and (not some or (sum(found) == 40 - x and not Counter(found) - Counter(lengths) and len(found) == len(some[0])))
            sums.take(Counter({int(x): int(sums.counts[x])}), 1)


def test_plan_is_nearly_least():
    """All pieces are placed; on small sets at most one sequence more than needed, on large ones close to the bound."""
    r = random.Random(2)
    over = 0
    for _ in range(150):
        pieces = [r.randrange(1, 21) for _ in range(r.randrange(1, 12))]
        plan = sequences.plan(np.bincount(pieces, minlength=21), 20)
        assert sum((Counter({x: k * times for x, k in used.items()}) for times, used in plan), Counter()) == Counter(pieces)
        assert all(sum(used.elements()) <= 20 for _, used in plan)
        more = sum(times for times, _ in plan) - least(tuple(pieces), 20)
        assert more <= 1
        over += more
    assert over <= 5
    g = np.random.default_rng(3)
    for pieces in (g.integers(1, 4097, 200_000), g.integers(1, 300, 200_000), np.clip(g.lognormal(6.5, 1, 300_000).astype(int) + 1, 1, 4096)):
        n = sum(times for times, _ in sequences.plan(np.bincount(pieces, minlength=4097), 4096))
        assert n <= 1.001 * max(-(-int(pieces.sum()) // 4096), int((pieces > 2048).sum()))


def test_one_length_holds_nearly_all(spark):
    """Places of equal pieces are runs of ranks: no group of rows meets anywhere."""
    df = spark.range(6000).selectExpr("id AS doc_id", "if(id % 10 = 0, repeat('word ', cast(id AS int) % 90), 'the same text') AS text").repartition(9)
    rows = sequences.pack(df, PATH, 100).collect()
    assert len(rows) == 6000 and checked(rows, 100) == -(-sum(r["length"] for r in rows) // 100)
