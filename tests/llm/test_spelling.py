"""Spelling groups against brute force and defined edge cases."""

import random

import pytest

from rillmark.llm import spelling
from rillmark.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def dense(seed=1):
    """Words over three letters, so that most have near words, some beyond ASCII; nulls, empty and long texts, repeated rows."""
    r = random.Random(seed)
    rows = [(k if k % 7 else None, " ".join("".join(r.choice("abé") for _ in range(r.randrange(7, 10))) for _ in range(60))) for k in range(150)]
    rows += [(1, None), (None, None), (2, ""), (2, " - "), (3, ("A" * 3000 + " ") * 3), (4, ("A" * 2999 + ",") * 40), (4, ("A" * 2999 + ",") * 40)]
    return rows + [(5, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa " * 3), (6, "ÀÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀÀ ààààààà ààààààà x" * 4)]


def grouped(df, factor=10):
    return {r["word"]: tuple(r)[1:] for r in spelling.spelling_groups(spelling.count_words(df), factor).collect()}


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in QUERIES["op13_spelling_groups"](spark, SF).collect()}
    assert got == brute.spelling([tuple(r) for r in docs])


@pytest.mark.parametrize("factor", [2, 10])
def test_dense_words(spark, factor):
    rows = dense()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, wid long, word string, node string")
    want = brute.spelling(rows, factor)
    assert grouped(df.repartition(5), factor) == want
    assert sum(v[0] is not None for v in want.values()) > (200 if factor == 2 else 0)


def test_chains_and_ties(spark):
    """A form may have a form; of equal forms the smaller word wins; a circle cannot arise."""
    words = [("abcdefg", 1000), ("abcdefgh", 100), ("abcdefghi", 10), ("abcdefghij", 1), ("zbcdefgh", 100), ("xbcdefghi", 1),
             ("lonesome", 5), (None, 3), ("nothing", None)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.spelling_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["abcdefghij"] == ("abcdefghi", "abcdefg", 1, 1, 10)
    assert got["abcdefghi"] == ("abcdefgh", "abcdefg", 10, 3, 100)
    assert got["zbcdefgh"] == (None, "zbcdefgh", 100, 1, None)
    assert got["lonesome"] == (None, "lonesome", 5, 0, None)
    assert len(got) == 7


def test_common_beginning(spark):
    """A third of all words under one node: the states stay in proportion to the words."""
    r = random.Random(3)
    words = {"prefixed" + "".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)}
    words |= {"".join(r.choice("klmnopqrst") for _ in range(10)) for _ in range(3000)}
    rows = [(w, r.randrange(1, 50)) for w in sorted(words)]
    got = {x["word"]: x["n_near"] for x in spelling.spelling_groups(spark.createDataFrame(rows, "word string, n long")).collect()}
    want = brute.spelling([(None, ((w + " ") * n)) for w, n in rows], times=1, typo=1 << 40)
    assert got == {w: v[3] for w, v in want.items()}


def test_empty_table(spark):
    assert spelling.spelling_groups(spelling.count_words(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
