"""The library's front: batches of contexts in, scheduled prompts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import cluster, multiturn, prompts, retrieve, schedule
from .operators.distance import ALPHA


@dataclass(frozen=True)
class Settings:
    """Checked settings of an engine."""

    linkage: str = "average"
    alpha: float = ALPHA
    top_k: int = 20
    max_batch: int = cluster.MAX_BATCH

    def __post_init__(self) -> None:
        if self.linkage not in cluster.LINKAGES:
            raise ValueError(f"linkage must be one of {', '.join(cluster.LINKAGES)}")
        if self.top_k < 1 or self.alpha < 0:
            raise ValueError("top_k must be positive and alpha not negative")


class ContextEngine:
    """Reorders, schedules and dedups contexts.

    Contexts are rows (batch, ctx_id, docs); ``docs`` are numbers, or strings, which are numbered inside
    by first appearance and given back.
    """

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def reorder(self, contexts: DataFrame, batch: str = "batch") -> DataFrame:
        """(batch, ctx_id, docs, reordered, path, group_id, group_size, exec_pos)."""
        s = self.settings
        if isinstance(contexts.schema["docs"].dataType.elementType, T.StringType):
            return self._reorder_strings(contexts, batch)
        once = contexts.withColumn("docs", F.array_distinct(F.col("docs").cast("array<bigint>")))
        return schedule.scheduled(cluster.arranged(once, batch, s.linkage, s.alpha, s.max_batch), batch)

    def _reorder_strings(self, contexts: DataFrame, batch: str) -> DataFrame:
        # numbers by first appearance inside a batch; the names ride along as a sorted list
        e = contexts.select(batch, "ctx_id", F.posexplode("docs").alias("pos", "name"))
        first = e.groupBy(batch, "name").agg(F.min(F.struct("ctx_id", "pos")).alias("at"))
        names = first.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("names"))
        own = contexts.join(names, batch)
        numbered = own.select(batch, "ctx_id", F.transform("docs", lambda d: F.array_position("names", d)).alias("docs"))
        made = self.reorder(numbered, batch).join(names.select(F.col(batch).alias("_b"), "names"), F.col(batch).eqNullSafe(F.col("_b"))).drop("_b")
        back = lambda c: F.transform(c, lambda k: F.element_at("names", k.cast("int")))
        return made.withColumns({"docs": back("docs"), "reordered": back("reordered")}).drop("names")

    def optimize_batch(self, contexts: DataFrame, queries: DataFrame, batch: str = "batch", instruction: str | None = None) -> DataFrame:
        """(batch, exec_pos, ctx_id, system_prompt, query): prompts in scheduled order. ``queries``: (ctx_id, query)."""
        made = self.reorder(contexts, batch).join(queries, "ctx_id")
        text = prompts.system_prompt(F.col("reordered"), F.array_distinct("docs"), None if instruction is None else F.lit(instruction))
        return made.select(batch, "exec_pos", "ctx_id", text.alias("system_prompt"), "query")

    def deduplicate(self, turns: DataFrame, conversation: str, turn: str) -> DataFrame:
        """(ctx_id, conversation, turn, new_docs, overlapping_docs, hints) of all turns of all conversations."""
        return multiturn.split_documents(multiturn.first_seen(turns, conversation, turn), conversation, turn)

    def retrieve_and_reorder(self, corpus: DataFrame, queries: DataFrame, batch: str | None = None, **columns: str) -> DataFrame:
        """BM25 results as contexts, reordered and scheduled: batch by batch, if ``queries`` has a column for that.

        Without one all queries are one batch; more than ``max_batch`` are linked on tables.
        """
        found = retrieve.bm25(corpus, queries, self.settings.top_k, **columns)
        docs = found.groupBy(F.col("query_id").alias("ctx_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("docs"))
        if batch is None:
            return self.reorder(docs.withColumn("batch", F.lit(0)), "batch")
        own = queries.select(F.col(columns.get("query_col", "item_id")).alias("ctx_id"), batch)
        return self.reorder(docs.join(own, "ctx_id"), batch)
