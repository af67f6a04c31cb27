"""Spelling variants: words one edit apart, found by walking a trie of all words as a table of edges."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillmark.llm.storage import materialize, prepare

# Stands behind the last letter of every word, below all letters.
END = "\x01"


def count_words(docs: DataFrame, letters: int = 7, times: int = 2, typo: int | None = 31) -> DataFrame:
    """Words of at least ``letters`` code points that occur ``times`` times: ``word``, ``n``.

    Takes ``doc_id`` and ``text``; other columns are ignored.  A run is a maximal sequence of ``[A-Za-z\\u00C0-\\u00FF]``,
    of which A-Z are lower-cased.  With ``typo``, a run whose unsigned crc32 h of ``<doc_id>:<run>`` that number divides
    loses its code point ``h % length``.  Null and empty texts have no words, a null id is written as nothing, repeated
    rows count each.  Shorter runs cannot become words and are passed over by the pattern.
    """
    prepare(docs.sparkSession)
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[A-Za-zÀ-ÿ]{{{letters},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.explode(found).alias("w"))
    runs = runs.select("i", F.translate("w", string.ascii_uppercase, string.ascii_lowercase).alias("word"))
    if typo:
        runs = runs.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "word").cast("binary")))
        at = F.expr("CAST(h % char_length(word) AS int)")
        cut = F.concat(F.left("word", at), F.substr("word", at + 2))
        runs = runs.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.char_length("word") >= letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _letter(rest: Column | str) -> Column:
    return F.ascii(rest)


def _places(words: DataFrame) -> DataFrame:
    """Every word at the branching nodes of its path: ``wid``, ``node``, ``rest``, ``n``, ``next``.

    One edit leaves the first or the second half of a word as it is, so there are two tries, of the words and of the
    reversed words, and of each only the nodes from the middle of a word on.  Nodes are 64-bit hashes of what leads to
    them.  A node with one letter behind it needs no step: ``rest`` is what the word has from the node on, ``n`` how much
    of it leads to the next branching node ``next``, or to the word's end where that is null.
    """
    half = F.expr("char_length(word) DIV 2")
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.concat("word", F.lit(END)).alias("t"), half.alias("first")),
        F.struct(F.lit(1).alias("side"), F.concat(F.reverse("word"), F.lit(END)).alias("t"), (F.char_length("word") - half).alias("first")))
    both = words.select("wid", F.inline(sides))
    steps = both.select("wid", "side", "t", F.explode(F.sequence("first", F.char_length("t") - 1)).alias("d"))
    steps = steps.select("wid", "side", "d", F.xxhash64("side", F.expr("left(t, d)")).alias("node"), _letter(F.expr("substring(t, d + 1, 1)")).alias("c"))
    branching = steps.groupBy("node").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("node")
    path = steps.drop("c").join(branching, "node", "left_semi")
    order = Window.partitionBy("wid", "side").orderBy("d")
    path = path.join(words.select("wid", "word"), "wid").select(
        "wid", "node", "d", F.lead("d").over(order).alias("d2"), F.lead("node").over(order).alias("next"),
        F.concat(F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")), F.lit(END)).alias("t"))
    return path.selectExpr("wid", "node", "substring(t, d + 1) AS rest", "coalesce(d2, char_length(t)) - d AS n", "next")


def _met(states: DataFrame, rest: Column) -> DataFrame:
    """States behind an edge: a neighbour ``other`` at a word's end, else the next node with what is left of the word."""
    return states.select("wid", F.when(F.col("next").isNull(), F.col("leaf")).alias("other"), F.col("next").alias("node"),
                         F.when(F.col("next").isNotNull(), rest).alias("rest"))


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of words that differ by exactly one inserted, deleted or replaced letter: ``a``, ``b``, in both orders.

    Takes ``wid``, ``word`` (both distinct).  States (word, what is left of it, node, edits) are joined with the edges
    (node, letter, label, next node or word) of the trie.  A word's states without an edit are its own branching nodes,
    so all of them meet the edges at once: another letter's edge replaces the word's letter, an edge that fits behind
    it skips the letter.  What has an edit then walks on exactly, a level of branching nodes per join, until no state
    is left; those at a word's end are neighbours.  A pair is found from its longer word, or from the one with the
    smaller letter at the difference.  A letter is skipped only as the last of its equal neighbours.

    A state has one successor at most behind its edit, and a node has an edge per letter, so states grow with the words.
    """
    places = materialize(_places(words), "places")
    edges = places.groupBy("node", _letter("rest").alias("c")).agg(
        F.first(F.expr("left(rest, n)")).alias("label"), F.first("next").alias("next"), F.min("wid").alias("leaf"))
    edges = materialize(edges, "edges")
    own = places.select("wid", "node", _letter("rest").alias("own"), F.expr("substring(rest, 2)").alias("after")).filter(F.col("own") > ord(END))
    tried = own.join(edges, "node").filter(
        F.expr("c > own AND startswith(after, substring(label, 2)) OR c <> own AND startswith(after, label)"))
    replaced = tried.filter(F.expr("c > own AND startswith(after, substring(label, 2))"))
    skipped = tried.filter(F.expr("c <> own AND startswith(after, label)"))
    states = _met(replaced, F.expr("substring(after, char_length(label))")).union(_met(skipped, F.expr("substring(after, char_length(label) + 1)")))
    found = []
    while True:
        states = materialize(states, "states")
        found.append(states.filter("other IS NOT NULL").select("wid", "other"))
        states = states.filter("node IS NOT NULL").drop("other")
        if states.isEmpty():
            break
        walked = states.withColumn("c", _letter("rest")).join(edges, ["node", "c"]).filter("startswith(rest, label)")
        states = _met(walked, F.expr("substring(rest, char_length(label) + 1)"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.select(F.least("wid", "other").alias("a"), F.greatest("wid", "other").alias("b")).distinct()
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """End of every chain of forms: ``wid``, ``top``.  Chains are followed by doubling; a form occurs more often than its
    word, so there is no circle."""
    tops = materialize(forms.select("wid", F.col("form_wid").alias("top")), "roots")
    while True:
        further = tops.select(F.col("wid").alias("top"), F.col("top").alias("beyond"))
        tops = materialize(tops.join(further, "top", "left").select("wid", F.coalesce("beyond", "top").alias("top"), F.col("beyond").isNotNull().alias("moved")), "roots")
        if tops.filter("moved").isEmpty():
            return tops.drop("moved")
        tops = tops.drop("moved")


def spelling_groups(words: DataFrame, factor: int = 10) -> DataFrame:
    """Accepted form of every word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Takes distinct words and their counts (``word``, ``n``); rows with a null in either are left out.  A word's form is
    the near word of largest count, the smallest in code-point order among equal ones, if that count is at least
    ``factor`` times (above 1) its own.  ``root`` is reached by following forms; a word without a form is its own root.
    An empty table gives an empty result.
    """
    prepare(words.sparkSession)
    words = words.select("word", "n").dropna()
    words = materialize(words.withColumn("wid", F.monotonically_increasing_id()), "vocabulary")
    near = near_words(words.select("wid", "word")).join(words.select(F.col("wid").alias("b"), "n", "word"), "b")
    best = near.groupBy(F.col("a").alias("wid")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "word", "b")).alias("best"))
    fits = -F.col("best.m") >= F.lit(factor) * F.col("n")
    rows = words.join(best, "wid", "left").select(
        "wid", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.word")).alias("form"),
        F.when(fits, -F.col("best.m")).alias("form_n"), F.when(fits, F.col("best.b")).alias("form_wid"))
    rows = materialize(rows, "forms")
    tops = _roots(rows.filter("form_wid IS NOT NULL")).join(words.select(F.col("wid").alias("top"), F.col("word").alias("root")), "top")
    return rows.join(tops.drop("top"), "wid", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
