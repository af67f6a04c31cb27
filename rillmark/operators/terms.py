"""Search terms: groups from a specification or files, matched against texts."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions.text import java_regex, pattern_fault
from rillmark.operators.membership import may_hold
from rillmark.session import materialize

ENTITY_MARK = "--entity--"


@dataclass(frozen=True)
class TermGroup:
    """Terms combined by AND or OR, or one regular expression."""

    terms: tuple[str, ...]
    every: bool = False
    regex: bool = False


def parse_groups(spec: str) -> list[TermGroup]:
    """``rgx:a+ ~~~ |x,y ~~~ @u,v`` as groups: ``@`` AND, ``|`` (default) OR."""
    groups = []
    for piece in spec.split("~~~"):
        text = piece.strip()
        if not text:
            continue
        if text.startswith("rgx:"):
            groups.append(TermGroup((text[4:],), regex=True))
            continue
        every = text.startswith("@")
        terms = tuple(t.strip() for t in text.lstrip("@|").split(",") if t.strip())
        if terms:
            groups.append(TermGroup(terms, every))
    return groups


def classify_term_lines(df: DataFrame, line: str) -> DataFrame:
    """Kind (``regex``, ``group`` or ``plain``) and text of each non-empty line of a term file."""
    text = F.trim(line)
    kind = F.when(text.startswith("rgx:"), "regex").when(text.startswith("~~~"), "group").otherwise("plain")
    value = (
        F.when(kind == "regex", F.substring(text, 5, 2**31 - 1))
        .when(kind == "group", F.substring(text, 4, 2**31 - 1))
        .otherwise(F.replace(text, F.lit(","), F.lit(" ")))
    )
    rows = df.withColumns({"kind": kind, "term": F.trim(value)})
    return rows.filter((F.trim(line) != "") & ~((F.col("kind") == "plain") & F.startswith("term", F.lit("~"))))


def _term_hit(text: Column, group: TermGroup, term: str, entity: Column | None) -> Column:
    if group.regex:
        return F.rlike(text, F.lit(java_regex(term)))
    if ENTITY_MARK in term:
        if entity is None:
            return F.lit(False)
        return F.contains(text, F.replace(F.lit(term), F.lit(ENTITY_MARK), entity.cast("string")))
    return F.contains(text, F.lit(term))


def valid_groups(groups: Sequence[TermGroup]) -> tuple[list[TermGroup], list[TermGroup]]:
    """Groups that can be used, and regular expressions that cannot (see ``pattern_fault``)."""
    bad = [g for g in groups if g.regex and pattern_fault(g.terms[0])]
    return [g for g in groups if g not in bad], bad


def found_terms(text: Column, groups: Sequence[TermGroup], entity: Column | None = None) -> Column:
    """Array of the terms found, in declared order; an AND group counts whole."""
    marks = []
    for group in valid_groups(groups)[0]:
        hits = [_term_hit(text, group, t, entity) for t in group.terms]
        if group.every:
            whole = hits[0]
            for hit in hits[1:]:
                whole = whole & hit
            hits = [whole] * len(hits)
        marks += [F.when(h, F.lit(t)) for h, t in zip(hits, group.terms)]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


def term_keys(text: Column, groups: Sequence[TermGroup], entity: Column | None = None) -> Column:
    """Keys of what is found: a term's own text, for an AND group the group's.

    Keys say what was found wherever it stands in the specification, so they
    can be stored and compared after terms were added or moved.
    """
    marks = []
    for group in valid_groups(groups)[0]:
        hits = [_term_hit(text, group, t, entity) for t in group.terms]
        if group.every:
            whole = hits[0]
            for hit in hits[1:]:
                whole = whole & hit
            marks.append(F.when(whole, F.lit("@" + ",".join(group.terms))))
        else:
            sign = "rgx:" if group.regex else "|"
            marks += [F.when(h, F.lit(sign + t)) for h, t in zip(hits, group.terms)]
    return F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")


GRAM = 3
_WORD, _BETWEEN = r"(?U)\w+", r"(?U)\W+"


def _grams(rows: DataFrame, text: str, out: str, size: int) -> DataFrame:
    """One row per substring of ``size`` characters."""
    longer = rows.filter(F.length(text) >= size)
    at = longer.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length(text) - (size - 1))))
    return at.withColumn(out, F.substring(F.col(text), F.col("_at"), F.lit(size))).drop("_at")


def _containing(pieces: DataFrame, vocabulary: DataFrame, short: bool) -> DataFrame:
    """(piece, anchor, df) of every entry of the vocabulary (anchor, df) that contains a piece.

    A piece of GRAM characters or more is looked up by its rarest gram; with
    ``short``, shorter pieces by themselves.
    """
    wanted = materialize(_grams(pieces, "piece", "gram", GRAM), "grams")
    grams = _grams(vocabulary, "anchor", "gram", GRAM).join(wanted.select("gram").distinct(), "gram", "left_semi")
    frequency = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(frequency, "gram").groupBy("piece").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    met = grams.join(rarest, "gram").filter(F.contains("anchor", "piece")).select("piece", "anchor", "df")
    if short:
        for size in range(1, GRAM):
            parts = _grams(vocabulary, "anchor", "piece", size)
            met = met.unionByName(parts.join(pieces.filter(F.length("piece") == size), "piece").select("piece", "anchor", "df"))
    return met.distinct()


# A word, what stands behind it and the next word.
_PAIR = r"(?U)(\w+)(\W+)(\w+)"


def _pairs(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text, each with what stands between them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)(?<!\w)(?=(\w+\W+\w+))"), F.lit(1)))


def _pair_anchors(keyed: DataFrame, tokens: DataFrame, term_key: str) -> DataFrame:
    """(term_key, anchor) of terms of two words or more: the pairs of the texts that hold a term's rarest pair.

    A text with the term has a pair whose first word ends and whose second word begins like the term's.  So every
    distinct pair of the texts is cut at both ends in all ways, and what may be a pair of a term is looked up.
    """
    pieces = materialize(keyed.select(term_key, F.explode("_pairs").alias("piece")).withColumn("_hash", F.xxhash64("piece")), "term-pairs")
    wanted = pieces.select("piece", "_hash").distinct()
    known = may_hold(wanted.select("_hash"), wanted.count())
    counted = tokens.groupBy("anchor").agg(F.count("*").alias("df"))
    first, second = F.regexp_extract("anchor", _PAIR, 1), F.regexp_extract("anchor", _PAIR, 3)
    at = counted.withColumns({"_first": first, "_rest": F.regexp_extract("anchor", r"(?U)\W+\w+", 0), "_cut": F.length(second)})
    at = at.withColumn("_from", F.explode(F.sequence(F.lit(1), F.length("_first")))).withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_cut") - 1)))
    piece = F.concat(F.substring(F.col("_first"), F.col("_from"), F.length("_first")), F.substring(F.col("_rest"), F.lit(1), F.length("_rest") - F.col("_off")))
    cuts = at.select("anchor", "df", piece.alias("piece")).filter(known(F.xxhash64("piece")))
    met = materialize(cuts.join(wanted.select("piece"), "piece").distinct(), "pairs")
    return _by_least(pieces.select(term_key, "piece").join(met, "piece"), term_key)


def _by_least(rows: DataFrame, term_key: str) -> DataFrame:
    """(term_key, anchor) for the piece of each term that the fewest texts hold."""
    weights = rows.groupBy(term_key, "piece").agg(F.sum("df").alias("weight"))
    chosen = weights.groupBy(term_key).agg(F.min_by("piece", F.struct("weight", "piece")).alias("piece"))
    return rows.join(chosen, [term_key, "piece"]).select(term_key, "anchor")


def match_term_table(
    texts: DataFrame, keys: Sequence[str], text: str, terms: DataFrame, term: str, term_key: str
) -> DataFrame:
    """(keys, term_key) of every text that contains a term of a table of any size.

    Each term is looked up by an anchor.  A term of several words stands only
    in texts with a pair of neighbouring words that holds one of its own pairs,
    and of those the rarest is taken.  A term with one word is looked up by the
    words that contain it, among the distinct words of all texts; one without
    any word by the runs between words.  Only candidates are compared in full,
    so no text is paired with terms it cannot hold.  Anchors and candidates
    are stored, so that Spark joins them by their true sizes.
    """
    ends = F.array_distinct(F.filter(F.split(F.col(term), _BETWEEN), lambda w: w != ""))
    keyed = terms.filter(F.col(term) != "").select(term_key, F.col(term).alias("_term"), ends.alias("_ends"), _pairs(F.col(term)).alias("_pairs"))
    paired, single = keyed.filter(F.size("_pairs") > 0), keyed.filter((F.size("_pairs") == 0) & (F.size("_ends") > 0))
    kinds = keyed.agg(
        F.coalesce(F.bool_or(F.size("_pairs") > 0), F.lit(False)).alias("pairs"),
        F.coalesce(F.bool_or((F.size("_pairs") == 0) & (F.size("_ends") > 0)), F.lit(False)).alias("ends"),
        F.coalesce(F.bool_or(F.size("_ends") == 0), F.lit(False)).alias("none"),
        F.coalesce(F.bool_or(F.exists("_ends", lambda w: F.length(w) < GRAM)), F.lit(False)).alias("short")).first()

    nothing = T.StructType([*texts.select(*keys).schema.fields, *terms.select(term_key).schema.fields])
    found = terms.sparkSession.createDataFrame([], nothing)
    if kinds["pairs"]:
        tokens = texts.select(*keys, F.explode(_pairs(F.col(text))).alias("anchor"))
        anchors = materialize(_pair_anchors(paired, tokens, term_key), "pair-anchors")
        held = anchors.select(F.xxhash64("anchor").alias("_hash")).distinct()
        known = may_hold(held, held.count())
        found = found.unionByName(tokens.filter(known(F.xxhash64("anchor"))).join(anchors, "anchor").select(*keys, term_key))
    if kinds["ends"]:
        tokens = texts.select(*keys, F.explode(F.array_distinct(F.split(F.col(text), _BETWEEN))).alias("anchor")).filter("anchor <> ''")
        words = materialize(tokens.groupBy("anchor").agg(F.count("*").alias("df")), "words")
        pieces = single.select(term_key, F.explode("_ends").alias("piece"))
        met = materialize(pieces.join(_containing(pieces.select("piece").distinct(), words, kinds["short"]), "piece"), "pieces")
        anchors = materialize(_by_least(met, term_key), "anchors")
        found = found.unionByName(tokens.join(anchors, "anchor").select(*keys, term_key))
    if kinds["none"]:
        runs = texts.select(*keys, F.explode(F.array_distinct(F.split(F.col(text), _WORD))).alias("anchor")).filter("anchor <> ''")
        pieces = keyed.filter(F.size("_ends") == 0).select(term_key, F.col("_term").alias("piece"))
        met = pieces.join(_containing(pieces.select("piece").distinct(), runs.groupBy("anchor").agg(F.count("*").alias("df")), True), "piece")
        found = found.unionByName(runs.join(met.select(term_key, "anchor"), "anchor").select(*keys, term_key))
    candidates = materialize(found.distinct().join(terms.select(term_key, term), term_key), "candidates")
    full = texts.select(*keys, text).join(candidates, list(keys))
    return full.filter(F.contains(F.col(text), F.col(term))).select(*keys, term_key)


GROUP_SCHEMA = "group string, kind string, term string"


def group_table(lines: DataFrame) -> DataFrame:
    """(group, kind, term) of the term files' rows (folder, every, kind, term).

    ``kind`` is ``any``, ``every`` or ``regex``.  The plain lines of a folder
    are one group, a group line is one or more.
    """
    plain = lines.filter("kind = 'plain'").select(
        F.concat_ws(" ", F.lit("folder"), "folder").alias("group"), F.when(F.col("every"), "every").otherwise("any").alias("kind"), "term")
    pieces = lines.filter("kind = 'group'").select(F.explode(F.split("term", "~~~")).alias("piece")).select(F.trim("piece").alias("piece"))
    patterns = pieces.filter("startswith(piece, 'rgx:')").select(F.substring("piece", 5, 2**31 - 1).alias("term"))
    patterns = patterns.unionByName(lines.filter("kind = 'regex'").select("term"))
    listed = pieces.filter("NOT startswith(piece, 'rgx:')").select(
        F.concat_ws(" ", F.lit("line"), "piece").alias("group"), F.when(F.startswith("piece", F.lit("@")), "every").otherwise("any").alias("kind"),
        F.explode(F.split(F.ltrim("piece", F.lit("@|")), ",")).alias("term")).withColumn("term", F.trim("term"))
    regex = patterns.select(F.concat_ws(" ", F.lit("regex"), "term").alias("group"), F.lit("regex").alias("kind"), "term")
    return plain.unionByName(listed).unionByName(regex).filter("term <> ''").distinct()


def group_rows(groups: Sequence[TermGroup]) -> list[tuple[str, str, str]]:
    """The same rows of parsed groups."""
    rows = []
    for group in groups:
        kind = "regex" if group.regex else "every" if group.every else "any"
        rows += [(f"{kind} " + ",".join(group.terms), kind, term) for term in group.terms]
    return rows


def _matching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The patterns that are found in their texts; one that does not compile is found nowhere."""

    @functools.cache
    def compiled(pattern: str):
        try:
            return re.compile(pattern)
        except re.error:
            return None

    for batch in batches:
        keys = batch.columns[:-2]
        rows = []
        for *key, text, patterns in batch.itertuples(index=False, name=None):
            rows += [(*key, p) for p in patterns if text is not None and (c := compiled(p)) and c.search(text)]
        yield pd.DataFrame(rows, columns=[*keys, "term"])


def match_groups(texts: DataFrame, keys: Sequence[str], text: str, groups: DataFrame) -> DataFrame:
    """(keys, found) of every text with a hit: the sorted distinct terms of the groups that hold.

    ``groups`` has rows (group, kind, term), as many as there may be: texts and
    terms meet by :func:`match_term_table`, an ``every`` group counts when all
    its terms are found.  Patterns have no word to be looked up by, so each task
    tests every text against all of them; they are one value, not a table.
    """
    literal = groups.filter("kind <> 'regex'")
    hits = match_term_table(texts, keys, text, literal.select("term", F.col("term").alias("_key")).distinct(), "term", "_key")
    hits = hits.withColumnRenamed("_key", "term").join(literal, "term")
    need = literal.filter("kind = 'every'").groupBy("group").agg(F.count("*").alias("_need"))
    whole = hits.filter("kind = 'every'").groupBy(*keys, "group").agg(F.collect_set("term").alias("_terms"))
    whole = whole.join(need, "group").filter(F.size("_terms") == F.col("_need")).select(*keys, F.explode("_terms").alias("term"))
    found = hits.filter("kind = 'any'").select(*keys, "term").unionByName(whole)
    patterns = groups.filter("kind = 'regex'").agg(F.collect_set("term").alias("_patterns"))
    columns = texts.select(*keys).schema
    schema = T.StructType([*columns.fields, T.StructField("term", T.StringType())])
    tested = texts.select(*keys, text).withColumn("_patterns", patterns.scalar()).filter(F.size("_patterns") > 0).mapInPandas(_matching, schema)
    return found.unionByName(tested).groupBy(*keys).agg(F.sort_array(F.collect_set("term")).alias("found"))
