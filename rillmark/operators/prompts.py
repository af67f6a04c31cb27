"""Prompt rows for external models, and the tables made of their answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.functions.jsonpath import is_json, is_json_object
from rillmark.functions.text import clean_answer, tilde_head
from rillmark.operators.conditions import matches_any
from rillmark.operators.windows import cut_at_budget, last_n

# Texts the answer handling puts in place of a missing result.
NO_RESULT = "The analysis of the document(s) did not find a proper result."
NO_DATA = "no data found"
SUPERVISOR_ERROR = "Error - likely a Tool could not be run. Check your tools."
IDENTIFIER_MARK = "--identifier--"
SKIPPED_HEAD = 15


def _gathered(df: DataFrame, key: str, types: str, attributes: str) -> DataFrame:
    """Records whose type and identifier match, with a non-empty gathered value."""
    return df.filter(
        matches_any(F.col("preprocesstype"), types)
        & matches_any(F.col("identifier"), attributes)
        & (F.col(key).cast("string") != "")
    )


def _piece(key: str) -> Column:
    return F.concat(F.col(key).cast("string"), F.lit(" (Identifier="), tilde_head(F.col("identifier")), F.lit("), "))


def record_prompts(
    df: DataFrame, key: str, context: str, prompt: str, types: str = "", attributes: str = ""
) -> DataFrame:
    """One prompt per record."""
    head = tilde_head(F.col("identifier"))
    asked = F.replace(F.lit(prompt), F.lit(IDENTIFIER_MARK), head)
    message = F.concat(F.lit(f"{context}.  Data: "), _piece(key), F.lit(".  "), asked)
    rows = _gathered(df, key, types, attributes)
    return rows.withColumns({"variable": head, "message": message})


def batch_prompt(
    df: DataFrame, key: str, order: Sequence[str], context: str, prompt: str, maxrows: int,
    types: str = "", attributes: str = "",
) -> DataFrame:
    """One prompt for all gathered records among the newest ``maxrows``.

    The read window bounds the text, so a single row is enough for it.
    """
    newest = df.orderBy(*[F.col(c).desc() for c in order]).limit(maxrows)
    rows = _gathered(newest, key, types, attributes)
    listed = F.sort_array(F.collect_list(F.struct(*order, _piece(key).alias("_piece"))))
    joined = F.array_join(F.transform(listed, lambda e: e["_piece"]), "")
    out = rows.agg(F.count("*").alias("records"), F.concat(
        F.lit(f"{context}.  Data: "), joined, F.lit(f".  {prompt}")).alias("message"))
    return out.filter("records > 0")


def raw_prompts(df: DataFrame, raw: str, context: str, prompt: str, attributes: str) -> DataFrame:
    """One prompt per record with its list of raw values."""
    head = tilde_head(F.col("identifier"))
    values = F.array_join(F.transform(raw, lambda v: F.concat(v.cast("string"), F.lit(", "))), "")
    if context:
        message = F.concat(F.lit(f"{context}.  Data: "), values, F.lit(f". {prompt}"))
    else:
        message = F.replace(F.lit(prompt), F.lit(IDENTIFIER_MARK), head)
    rows = df.filter(matches_any(F.col("identifier"), attributes) & (F.size(raw) > 0))
    return rows.withColumns({"variable": head, "message": message})


def budget_pieces(
    df: DataFrame, keys: Sequence[str], position: str, text: str, budget: int, out: str = "piece"
) -> DataFrame:
    """Found texts per file up to a character budget, without their first 15 characters."""
    body = F.concat(F.trim(F.substring(F.col(text), SKIPPED_HEAD + 1, 2**31 - 1)), F.lit(". "))
    return cut_at_budget(df.withColumn("_body", body), keys, position, "_body", budget, out).drop("_body")


def budget_prompts(
    df: DataFrame, keys: Sequence[str], position: str, text: str, budget: int, context: str, prompt: str
) -> DataFrame:
    """One prompt per file; the budget bounds what is gathered for it."""
    pieces = budget_pieces(df, keys, position, text, budget)
    listed = F.sort_array(F.collect_list(F.struct(position, "piece")))
    joined = F.array_join(F.transform(listed, lambda e: e["piece"]), "")
    message = F.concat(F.lit(f"{context}. Here are the messages: "), joined, F.lit(f". {prompt}"))
    return pieces.groupBy(*keys).agg(message.alias("message"))


def answer_flag(answer: Column, identifier: Column, terms: list[str]) -> Column:
    """True when a search term occurs in the answer, case-sensitive."""
    hit = F.lit(False)
    for term in terms:
        literal = F.replace(F.lit(term), F.lit(IDENTIFIER_MARK), identifier)
        hit = hit | F.contains(answer, literal)
    return hit


def reject_formula(answer: Column) -> Column:
    """Answers that look like a worked formula are replaced."""
    formula = F.contains(answer, F.lit("=")) & (
        F.contains(answer, F.lit("Answer:")) | F.contains(answer, F.lit("A:")))
    return F.when(formula, F.lit(NO_RESULT)).otherwise(answer)


def check_json(col: Column, model: str, embedding: str, temperature: str) -> tuple[Column, Column]:
    """(text, status) of a JSON answer: ``valid``, ``patched`` or ``rejected``.

    A text that does not parse gets the missing tail; what still does not
    parse goes to quarantine.
    """
    text = F.regexp_replace(col, r"(?U)^\s+|\s+$", "")
    settings = f'","Model": "{model}","Embedding":"{embedding}", "Temperature":"{temperature}"}}'
    bare = ~F.rlike(text, F.lit("Model|Embedding|Temperature"))
    tail = F.when(bare, F.lit(settings)).otherwise(F.lit('"}'))
    cut = F.substring(text, F.lit(1), F.length(text) - 1)
    patched = F.when(F.right(text, F.lit(1)) != "}", F.concat(text, tail)).when(
        F.left(F.right(text, F.lit(2)), F.lit(1)) != '"', F.concat(cut, tail)).otherwise(text)
    status = F.when(is_json(text), F.lit("valid")).when(is_json(patched), F.lit("patched")).otherwise(
        F.lit("rejected"))
    return F.when(status == "valid", text).otherwise(patched), status


def agent_record(agent: Column, topic: Column, prompt: Column, response: Column, model: str) -> Column:
    """JSON record of an agent's answer."""
    answer = F.replace(F.replace(clean_answer(response), F.lit(";"), F.lit(",")), F.lit(":"), F.lit(""))
    return F.to_json(F.struct(
        agent.alias("Agent_Name"), topic.alias("Topic"), clean_answer(prompt).alias("Prompt"),
        F.trim(answer).alias("Response"), F.lit(model).alias("Model"),
    ))


def combine_agents(df: DataFrame, keys: Sequence[str], order: Sequence[str], record: str, maxrows: int) -> DataFrame:
    """One array document per key: topic agents, then team lead, then supervisor.

    ``level`` is ``agent``, ``lead`` or ``supervisor``.  A missing or invalid
    part is filled in.  The newest ``maxrows`` records of a level are used.
    """
    checked = df.withColumn("_record", F.when(is_json_object(F.col(record)), F.col(record)))
    newest = last_n(checked, [*keys, "level"], order, maxrows)
    agent = (F.col("level") == "agent") & F.col("_record").isNotNull()
    listed = F.sort_array(F.collect_list(F.when(agent, F.struct(*order, "_record"))))

    def one(level: str, name: str, response: str) -> Column:
        latest = F.max(F.when((F.col("level") == level) & (F.col("rn") == 1), F.col("_record")))
        return F.coalesce(latest, F.lit(
            f'{{"Status": "{NO_DATA}", "Agent_Name": "{name}", "Response": "{response}", "Topic": "na"}}'))

    missing = f'{{"Status": "{NO_DATA}", "Agent_Name": "", "Response": "{NO_DATA}", "Topic": "na"}}'
    texts = F.transform(listed, lambda e: e["_record"])
    body = F.when(F.size(texts) > 0, texts).otherwise(F.array(F.lit(missing)))
    parts = F.concat(body, F.array(
        one("lead", "Team Lead agent", NO_DATA), one("supervisor", "Supervisor agent", SUPERVISOR_ERROR)))
    return newest.groupBy(*keys).agg(
        F.count_if(agent).alias("agents"),
        F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("document"),
    )


def pair_topics(queries: Column, documents: Column) -> Column:
    """Positional pairing of ``topic<<-prompt`` items (joined by ``->>``) with topic documents."""
    items = F.split(queries, "->>")
    n = F.least(F.size(items), F.size(documents))
    pairs = F.arrays_zip(F.slice(items, F.lit(1), n).alias("item"), F.slice(documents, F.lit(1), n).alias("document"))
    return F.transform(pairs, lambda p: F.struct(
        F.trim(F.split_part(p["item"], F.lit("<<-"), F.lit(1))).alias("topic"),
        F.replace(F.split_part(p["item"], F.lit("<<-"), F.lit(2)), F.lit("<<data>>"), F.lower(p["document"])).alias(
            "prompt"),
    ))
