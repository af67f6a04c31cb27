"""Conversation repair against a search over all states row by row, and defined edge cases."""

import random

import pytest

from rillmark.llm import conversations
from rillmark.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "conv_id long, turn long, role string, text string, part long, cost long, gone string, k1 string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def mixed(seed, ids, longest):
    """Wild roles, texts with and without an end, nulls, repeated turns and rows."""
    r = random.Random(seed)
    rows = []
    for conv in ids:
        for turn in range(r.randrange(1, longest)):
            if r.random() < 0.1:
                continue
            turn = None if r.random() < 0.05 else turn - (r.random() < 0.1)
            role = r.choice(["user", "assistant", "user", "assistant", "user", "assistant", "system", "tool", "", None, "admin", "User"])
            text = r.choice([None, "", " \n", "Yes.", "No", "well?", "a.\nb ", "Ends! \t", " ", "once"]) if r.random() < 0.5 else f"Said {turn}."
            rows += [(conv, turn, role, text)] * r.choice([1, 1, 1, 1, 1, 2])
    return rows


def repaired(spark, rows, parts=7, segment=conversations.SEGMENT):
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(parts)
    found = conversations.repair(conversations.damage(df), segment).collect()
    assert len(found) == len({r["conv_id"] for r in found})
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in found}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_conversations(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_conversation_repair"](spark, path).collect()}
    assert got == brute.conversations(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_wild_conversations(spark, seed):
    rows = mixed(seed, [None, *range(-3, 300)], 12)
    assert repaired(spark, rows) == brute.conversations(rows)


@pytest.mark.parametrize("segment", [3, 256])
def test_conversation_over_many_tasks(spark, segment):
    """One conversation holds nearly all rows and is cut within and between tasks."""
    rows = mixed(5, [7], 900) + mixed(6, range(20, 30), 6) + [(31, None, "user", "Same.")] * 300
    assert repaired(spark, rows, segment=segment) == brute.conversations(rows)


def test_search_from_both_ends():
    """Both heaps agree with a search over all states, for any rows."""
    r = random.Random(9)
    names = {conversations.OK: "", conversations.BLANK: "blank", conversations.DUPLICATE: "duplicate", conversations.CUT: "truncated"}
    for _ in range(400):
        rows = [(r.choice("suat"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(9))]
        want = brute.best_edits([(role, "x", names[fault]) for role, fault in rows])
        assert conversations.cheapest(rows, 0, (0, 3), True) == want[:2]


def test_all_rows_dropped_and_no_rows(spark):
    """A conversation without a row left has zeros; an empty table has no conversation."""
    import zlib

    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert repaired(spark, [(conv, 0, "user", "Hi.")]) == {conv: (0, 0, 0, 0, 0, 0, "", nothing)}
    assert repaired(spark, []) == {}
