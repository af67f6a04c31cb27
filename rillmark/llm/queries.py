"""Registered queries of this subpackage over the given tables, with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm.conversations import damage, repair
from rillmark.llm.decontaminate import contained
from rillmark.llm.language_model import score
from rillmark.llm.licences import scan_licences
from rillmark.llm.lines import repeated_lines
from rillmark.llm.mixing import mix
from rillmark.llm.near_duplicates import jaccard_classes
from rillmark.llm.quality import judge
from rillmark.llm.secrets import digest, find_secrets
from rillmark.llm.sequences import pack
from rillmark.llm.spelling import count_words, spelling_groups
from rillmark.llm.storage import prepare
from rillmark.llm.token_files import encoded
from rillmark.llm.url_filters import judge_urls

# The public vocabulary file that token files and sequences use.
VOCABULARY = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on every machine."""
    return str(public_tokenizers.path(name))


def query(name: str, sql: str | None = None):
    """Register a function of ``read``, which opens a table by name."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_lm_scoring")
def _language_models(read):
    good = read("labels").filter("quality = 1 AND NOT toxic <=> 1").select("doc_id")
    return score(read("documents"), good)


@query("op2_secret_scans")
def _secrets(read):
    return digest(find_secrets(read("documents")))


@query("op3_ngram_jaccard_join")
def _near_duplicates(read):
    return jaccard_classes(read("documents"))


@query("op4_license_scans")
def _licences(read):
    found = scan_licences(read("documents"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.family"))), ",").alias("families"))


DECONTAMINATION_SQL = r"""
WITH w AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') FROM benchmark
), runs AS (
    SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS run
    FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
), items AS (SELECT id AS item_id, run, count(*) OVER (PARTITION BY id) AS n_runs FROM runs WHERE kind = 'i'
), short AS (SELECT DISTINCT id AS item_id, array_to_string(w, ' ') AS run FROM w
    WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4 AND id NOT IN (SELECT item_id FROM items)
), few AS (SELECT DISTINCT id AS doc_id, array_to_string(w[i:i + n - 1], ' ') AS run
    FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, range(1, 5) AS sizes(n)
      WHERE kind = 'd' AND n IN (SELECT len(string_split(run, ' ')) FROM short)))
SELECT id AS doc_id, item_id, n_runs, count(*) AS n_held
FROM runs JOIN items USING (run) WHERE kind = 'd'
GROUP BY ALL HAVING 100 * count(*) >= 75 * n_runs
UNION ALL SELECT DISTINCT doc_id, item_id, 1, 1 FROM few JOIN short USING (run)
"""


@query("op5_benchmark_decontamination", DECONTAMINATION_SQL)
def _decontamination(read):
    return contained(read("documents"), read("benchmark"))


@query("op6_mixing")
def _mixing(read):
    return mix(read("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_token_files")
def _token_files(read):
    return encoded(read("documents"), tokenizer_path(VOCABULARY))


@query("op8_quality_rules")
def _quality(read):
    return judge(read("documents"))


@query("op9_line_dedup")
def _lines(read):
    docs = read("documents")
    removed = repeated_lines(docs).groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    found = docs.select("doc_id").join(removed, "doc_id", "left")
    numbers = F.transform("removed", lambda n: n.cast("string"))
    return found.select(
        "doc_id", F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(numbers, ","), F.lit("")).alias("removed_lines"))


@query("op10_url_filters")
def _urls(read):
    return judge_urls(read("pages"))


@query("op11_sequence_packing")
def _sequences(read):
    return pack(read("documents"), tokenizer_path(VOCABULARY))


@query("op12_conversation_repair")
def _conversations(read):
    return repair(damage(read("conversations")))


@query("op13_spelling_groups")
def _spelling(read):
    return spelling_groups(count_words(read("documents")))
