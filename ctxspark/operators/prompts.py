"""Prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contexts import exploded

# The prompts' texts.
RAG_HEAD = '\n**Note**:\n1. Please answer within 10 words or fewer. If the answer is Yes or No, just say Yes or No\n2. Do not include any special characters like <answer> or <answer/>."\n\nWith provided related documents:\n<documents_section>\n'
RAG_QUESTION = "\n</documents_section>\n\nAnswer the question:\n<question_section>\n"
RAG_END = "\n</question_section>\n"
RAG_RANKING = "\n</question_section>\n\nPlease read the documents in the following ranking and answer the question:\n<importance_ranking_section>\n"
RAG_RANKING_END = "\n</importance_ranking_section>\n\nPlease prioritize information from higher-ranked documents to answer the question.\n"
SYSTEM_HEAD = "Answer the question based on the provided documents.\n\n<documents>\n"
SYSTEM_RANKING = "\n</documents>\n\nRead the documents in this importance ranking: "
SYSTEM_END = "\nPrioritize information from higher-ranked documents."


def importance_ranking(reordered: Column, original: Column) -> Column:
    """Places in the reordered list, in the original order."""
    kept = F.filter(original, lambda d: F.array_contains(reordered, d))
    return F.array_join(F.transform(kept, lambda d: F.array_position(reordered, d).cast("string")), " > ")


def system_prompt(reordered: Column, original: Column, instruction: Column | None = None) -> Column:
    """A numbered list of documents with their importance ranking."""
    listed = F.array_join(F.transform(reordered, lambda d, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), d.cast("string"))), "\n")
    body = F.concat(F.lit(SYSTEM_HEAD), listed, F.lit(SYSTEM_RANKING), importance_ranking(reordered, original), F.lit(SYSTEM_END))
    return body if instruction is None else F.concat_ws("\n\n", instruction, body)


def docs_section(contexts: DataFrame, corpus: DataFrame) -> DataFrame:
    """(ctx_id, docs_section, n_missing): "[Doc_id] text" paragraphs in order; ids the corpus lacks are left out.

    ``corpus``: (doc, text).
    """
    e = exploded(contexts).join(corpus, "doc", "left")
    part = F.when(F.col("text").isNotNull(), F.concat(F.lit("[Doc_"), F.col("doc").cast("string"), F.lit("] "), F.col("text")))
    g = e.groupBy("ctx_id").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("p")))).alias("x"), F.count_if(F.col("text").isNull()).alias("n_missing"))
    return g.select("ctx_id", F.btrim(F.array_join(F.filter(F.transform("x", lambda x: x["p"]), lambda p: p.isNotNull()), "\n\n"), F.lit(" \n")).alias("docs_section"), "n_missing")


def rag_prompt(section: Column, question: Column, original: Column | None = None) -> Column:
    """The question with its documents; with the original order, the ranking as well."""
    head = (F.lit(RAG_HEAD), section, F.lit(RAG_QUESTION), question)
    if original is None:
        return F.concat(*head, F.lit(RAG_END))
    ranking = F.array_join(F.transform(original, lambda d: F.concat(F.lit("[Doc_"), d.cast("string"), F.lit("]"))), " > ")
    return F.concat(*head, F.lit(RAG_RANKING), ranking, F.lit(RAG_RANKING_END))


def bench_prompt(texts: Column, question: Column, n: int = 10, chars: int = 800) -> Column:
    """The first documents, cut, before the question."""
    cut = F.transform(F.slice(texts, 1, n), lambda t, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] "), F.when(F.length(t) > chars, F.concat(F.substring(t, 1, chars), F.lit("..."))).otherwise(t)))
    return F.concat(F.array_join(cut, "\n\n"), F.lit("\n\nQuestion: "), question)
