"""Prompts for a language model, within a budget of tokens, and what calls one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import token_estimate
from lodestone.operators.lookup import line_ref

#: Tokens kept free, least tokens for context, the share of code in them, most nodes at first and nodes given up at a time.
MARGIN, LEAST, CODE_SHARE, MOST_NODES, STEP = 200, 256, 0.75, 12, 2
MARKER = "\n... [truncated for token budget]"


#: Characters of a node's comment and of its code that a prompt shows.
SHOWN_DOC, SHOWN_CODE = 300, 1000


def context_block(node: Column) -> Column:
    """A node as a prompt shows it; ``node``: file_path, line_start, line_end, symbol_name, node_type, docstring, code."""
    # Fixed value: the form of the block.
    head = F.concat(F.lit("=== "), F.upper(node["node_type"]), F.lit(": "), node["symbol_name"], F.lit(" ==="))
    place = F.concat(F.lit("File: "), node["file_path"], F.lit("  Lines: "), node["line_start"].cast("string"), F.lit("–"), node["line_end"].cast("string"))
    doc = F.when(node["docstring"] != "", F.concat(F.lit("Doc: "), F.substring(node["docstring"], 1, SHOWN_DOC)))
    return F.concat_ws("\n", head, place, doc, F.substring(F.coalesce(node["code"], F.lit("")), 1, SHOWN_CODE))


def cut(text: Column, most: Column) -> Column:
    """At most ``most`` characters, and the marker if something was cut off."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, F.lit(1), most), F.lit(MARKER))).otherwise(text)


def assembled(rows: DataFrame, budget: int = 8192) -> DataFrame:
    """query, nodes (how many are in it), prompt, tokens: of rows (query, question, system, blocks in order, live).

    What the question and instructions leave of the budget goes to code (three quarters) and live state.  Of twelve,
    ten, ... nodes the first number whose blocks fit is taken; what still doesn't fit is cut off and marked.
    """
    fixed = token_estimate(F.concat_ws("\n", "system", "question"))
    free = F.greatest(F.lit(LEAST), F.lit(budget) - fixed - F.lit(MARGIN))
    code_chars = (F.floor(free * F.lit(CODE_SHARE)) * 4).cast("int")
    live_chars = (F.floor(free * F.lit(1 - CODE_SHARE)) * 4).cast("int")

    def joined(n: Column) -> Column:
        return F.array_join(F.slice("blocks", F.lit(1), n), "\n\n")

    n = F.lit(MOST_NODES % STEP or STEP)
    for k in range(MOST_NODES % STEP or STEP, MOST_NODES + 1, STEP):
        n = F.when(F.length(joined(F.lit(k))) <= code_chars, F.lit(k)).otherwise(n)
    sized = rows.withColumns({"free_code": code_chars, "free_live": live_chars, "fixed": fixed}).withColumn("nodes", F.least(n, F.size("blocks")))
    code = cut(joined(F.col("nodes")), F.col("free_code"))
    live = F.when(F.coalesce(F.col("live"), F.lit("")) != "", F.concat(F.lit("=== LIVE STATE ===\n"), cut(F.col("live"), F.col("free_live")))).otherwise(F.lit("[no live state]"))
    made = sized.withColumns({"code_part": F.concat(F.lit("=== CODE ===\n"), code), "live_part": live})
    text = F.concat_ws("\n\n", "system", "code_part", "live_part", F.concat(F.lit("=== QUESTION ===\n"), "question"))
    return made.select("query", "nodes", text.alias("prompt"), (F.col("fixed") + token_estimate(F.concat_ws("\n\n", "code_part", "live_part"))).alias("tokens"))


def sources(primaries: DataFrame) -> DataFrame:
    """query, sources: file:line of the primary hits (query, rank, file_path, line), in order, none twice."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", line_ref(F.col("file_path"), F.col("line")).alias("ref")))), lambda s: s["ref"])
    return primaries.groupBy("query").agg(F.array_distinct(ordered).alias("sources"))


#: What answers a prompt, by provider: (model, prompt) -> pieces of text.
PROVIDERS: dict[str, Callable[[str, str], Iterator[str]]] = {}


def provider(name: str, default: str = "ollama") -> tuple[str, str]:
    """'provider:model' to its parts, at the first colon; a bare model is the default provider's."""
    head, colon, tail = name.partition(":")
    return (head, tail) if colon else (default, name)


def answer_stream(name: str, prompt: str) -> Iterator[str]:
    """A model's answer, piece by piece; LookupError if nothing answers for its provider."""
    kind, model = provider(name)
    if kind not in PROVIDERS:
        raise LookupError(f"no provider {kind!r}")
    yield from PROVIDERS[kind](model, prompt)


def answer(name: str, prompt: str) -> str:
    return "".join(answer_stream(name, prompt))


def synthesized(asked: DataFrame, sources: DataFrame, model: str, answers: Callable[[str, str], Iterator[str]] | None = None) -> DataFrame:
    """query, answer, sources, model, tokens: every prompt (query, prompt, tokens) answered, with the sources (query, sources) that it cites.

    ``answers``: (model, prompt) -> pieces of text, as in PROVIDERS, whose entry for the model's provider it is by default;
    it goes to the tasks, so it has to be one that can be sent there.  A query without sources has an empty list.
    """
    kind, name = provider(model)
    own = answers or PROVIDERS.get(kind)
    if own is None:
        raise LookupError(f"no provider {kind!r}")

    @F.arrow_udf("string")
    def answered(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(own(name, t)) for t in texts.to_pylist()], pa.string())

    met = asked.join(sources, "query", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return met.select("query", answered("prompt").alias("answer"), "sources", F.lit(model).alias("model"), "tokens")
