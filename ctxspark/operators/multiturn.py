"""Documents and messages over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sha_hex, stripped
from . import chains
from .contexts import exploded

HINT = "Please refer to [Doc {doc_id}] from the previous conversation."
CONTEXT_HINT = "Please refer to [Doc_{doc_id}] in the previous conversation."


def hint(template: str, **values: Column) -> Column:
    """A template with its {names} filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def ancestors(requests: DataFrame, request: str = "request_id", parent: str = "parent_id") -> DataFrame:
    """(request, ancestor, back): every ancestor and how many steps back it is; unknown parents end a chain, and so does a request met again."""
    return chains.ancestors(chains.numbered(requests, request, parent), request)


def first_seen(contexts: DataFrame, conversation: str, turn: str) -> DataFrame:
    """Exploded contexts with first_turn and first_ctx: where the conversation has the document for the first time."""
    seen = Window.partitionBy(conversation, "doc").orderBy(turn, "ctx_id").rowsBetween(Window.unboundedPreceding, 0)
    e = exploded(contexts, conversation, turn)
    return e.withColumns({"first_turn": F.first(turn).over(seen), "first_ctx": F.first("ctx_id").over(seen)}).withColumn("is_new", F.col("first_ctx") == F.col("ctx_id"))


def split_documents(seen: DataFrame, *keep: str, template: str = HINT) -> DataFrame:
    """(ctx_id, *keep, new_docs, overlapping_docs, hints), in the context's order."""
    h = hint(template, doc_id=F.col("doc"), turn_number=F.col("first_turn"), source_request=F.col("first_ctx"))
    rows = seen.groupBy("ctx_id", *keep).agg(F.array_sort(F.collect_list(F.struct("pos", "doc", "is_new", h.alias("hint")))).alias("x"))
    old = F.filter("x", lambda x: ~x["is_new"])
    return rows.select("ctx_id", *keep, F.transform(F.filter("x", lambda x: x["is_new"]), lambda x: x["doc"]).alias("new_docs"), F.transform(old, lambda x: x["doc"]).alias("overlapping_docs"), F.transform(old, lambda x: x["hint"]).alias("hints"))


def context_text(seen: DataFrame, corpus: DataFrame, *keep: str) -> DataFrame:
    """(ctx_id, *keep, context, num_retrieved, num_novel, num_deduplicated): hints for seen documents, texts for new ones.

    ``corpus``: (doc, text).  A new document that the corpus lacks counts, but adds no text.
    """
    both = seen.join(corpus, "doc", "left")
    part = F.when(~F.col("is_new"), F.concat(hint(CONTEXT_HINT, doc_id=F.col("doc")), F.lit("\n\n"))).when(F.col("text").isNotNull(), F.concat(F.lit("[Doc_"), F.col("doc").cast("string"), F.lit("]: "), F.col("text"), F.lit("\n\n"))).otherwise("")
    rows = both.groupBy("ctx_id", *keep).agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("x"), F.count("*").alias("num_retrieved"), F.count_if("is_new").alias("num_novel"))
    return rows.select("ctx_id", *keep, F.array_join(F.transform("x", lambda x: x["part"]), "").alias("context"), "num_retrieved", "num_novel", (F.col("num_retrieved") - F.col("num_novel")).alias("num_deduplicated"))


def conversation_stats(turns: DataFrame, conversation: str) -> DataFrame:
    """(conversation, turns, total_retrieved, total_novel, total_deduplicated, deduplication_rate)."""
    total = F.sum("num_retrieved")
    rate = F.when(total > 0, F.round(F.sum("num_deduplicated") / total, 6)).otherwise(F.lit(0.0))
    return turns.groupBy(conversation).agg(F.count("*").alias("turns"), total.alias("total_retrieved"), F.sum("num_novel").alias("total_novel"), F.sum("num_deduplicated").alias("total_deduplicated"), rate.alias("deduplication_rate"))


def all_conversation_stats(stats: DataFrame) -> DataFrame:
    total = F.sum("total_retrieved")
    rate = F.when(total > 0, F.round(F.sum("total_deduplicated") / total, 6)).otherwise(F.lit(0.0))
    return stats.agg(F.count("*").alias("conversations"), F.coalesce(F.sum("turns"), F.lit(0)).alias("total_turns"), F.round(F.avg("turns"), 6).alias("avg_turns"), total.alias("total_retrieved"), F.sum("total_deduplicated").alias("total_deduplicated"), rate.alias("deduplication_rate"))


def history_query(messages: DataFrame, conversation: str, turn: str, last: int = 4) -> DataFrame:
    """Adds ``query``: the last messages as "role: text" lines, then the message itself."""
    before = Window.partitionBy(conversation).orderBy(turn).rowsBetween(-last, -1)
    lines = F.collect_list(F.concat_ws(": ", "role", "text")).over(before)
    return messages.withColumn("query", F.array_join(F.concat(lines, F.array("text")), "\n"))


def session_fingerprint(messages: DataFrame, conversation: str, turn: str, head: int = 5, chars: int = 500) -> DataFrame:
    """(conversation, fingerprint): from the first system message's head and the first user message among the first few."""
    place = F.row_number().over(Window.partitionBy(conversation).orderBy(turn))
    first = messages.withColumn("place", place).where(F.col("place") <= head)
    system = F.min_by(F.when(F.col("role") == "system", F.substring("text", 1, chars)), F.when(F.col("role") == "system", F.col("place")))
    user = F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("place")))
    both = first.groupBy(conversation).agg(system.alias("s"), user.alias("u"))
    return both.select(conversation, sha_hex(F.concat_ws("\0", F.coalesce("s", F.lit("")), F.coalesce("u", F.lit(""))), 16).alias("fingerprint"))


def first_copies(docs: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """The rows whose text the session has not had before."""
    seen = Window.partitionBy(session, "text_hash").orderBy(order)
    return docs.withColumn("text_hash", sha_hex(F.trim(text), 16)).withColumn("copy_no", F.row_number().over(seen)).where("copy_no = 1").drop("copy_no")


def repeats_replaced(docs: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """Adds ``origin`` (the earlier row of the same stripped text, or null) and ``result`` (a hint or the text)."""
    seen = Window.partitionBy(session, "text_hash").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = docs.withColumn("text_hash", F.sha2(stripped(F.col(text)), 256)).withColumn("first", F.first(order).over(seen))
    origin = F.when(F.col("first") != F.col(order), F.col("first"))
    told = F.concat(F.lit("[Document identical to the result of call "), origin.cast("string"), F.lit(", see above.]"))
    return own.withColumn("origin", origin).withColumn("result", F.coalesce(told, F.col(text))).drop("first", "text_hash")


def replayed_prefix(cached: DataFrame, incoming: DataFrame, session: str, place: str, text: str = "text") -> DataFrame:
    """(session, n_replayed): how many of the first messages are those of the session's cached turn."""
    a = cached.select(session, place, F.sha2(text, 256).alias("a"))
    b = incoming.select(session, place, F.sha2(text, 256).alias("b"))
    upto = Window.partitionBy(session).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    same = b.join(a, [session, place], "left").withColumn("all", F.min(F.coalesce((F.col("a") == F.col("b")).cast("int"), F.lit(0))).over(upto))
    return same.groupBy(session).agg(F.sum("all").alias("n_replayed"))


def without_requests(requests: DataFrame, gone: DataFrame, request: str = "request_id") -> DataFrame:
    """The requests that are left; parents' names in them stay as they are."""
    return requests.join(gone.select(request).distinct(), request, "left_anti")


def cleared(requests: DataFrame, asked: DataFrame, request: str = "request_id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """What is left when the whole chains of ``asked`` requests go, and (request, removed): how many each of them found to remove."""
    numbers = chains.numbered(requests, request, parent)
    gone = chains.upward(numbers, asked, request)
    counts = asked.select(request).distinct().join(chains.chain_lengths(numbers, request), request, "left")
    return without_requests(requests, gone, request), counts.select(request, F.coalesce("n", F.lit(0)).alias("removed"))


def conversation_turns(messages: DataFrame, corpus: DataFrame, retrieve, conversation: str, turn: str, k: int) -> DataFrame:
    """(ctx_id, conversation, turn, context, num_retrieved, num_novel, num_deduplicated) of every user message.

    Each message asks with the history before it; ``retrieve`` (queries of qid and text, k) gives (query_id,
    doc_id, rank); documents that the conversation had before become hints, new ones their texts.
    ``messages``: (ctx_id, conversation, turn, role, text); ``corpus``: (doc, text).
    """
    asked = history_query(messages, conversation, turn).where("role = 'user'")
    found = retrieve(asked.select(F.col("ctx_id").alias("qid"), F.col("query").alias("text")), k)
    docs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"])
    contexts = found.groupBy(F.col("query_id").alias("ctx_id")).agg(docs.alias("docs")).join(asked.select("ctx_id", conversation, turn), "ctx_id")
    return context_text(first_seen(contexts, conversation, turn), corpus, conversation, turn)


def since_reset(rows: DataFrame, resets: DataFrame, by: str, at: str) -> DataFrame:
    """The rows of a log that a reset leaves: those later than the last reset of their own ``by``, or of all (``by`` null).

    Indexes, trackers and caches are logs here: what they hold after a reset is what these rows say.  ``resets``: (by, at).
    """
    own = resets.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("_by")).agg(F.max(at).alias("_own"))
    whole = resets.where(F.col(by).isNull()).agg(F.max(at).alias("_all"))  # one row
    marked = rows.join(own, F.col(by) == F.col("_by"), "left").join(F.broadcast(whole))
    last = F.greatest("_own", "_all")
    return marked.where(last.isNull() | (F.col(at) > last)).drop("_by", "_own", "_all")


def session_turns(turns: DataFrame, session: str, turn: str, n_messages: str, docs: str) -> DataFrame:
    """(session, turn, n_messages, was_reset, new_docs, repeated_docs): each turn's documents that its session has not had.

    Fewer messages than in the turn before start the session anew.  Rows of one turn are taken by messages, then
    documents; a null number counts as none, null documents are left out, a null session is a session.
    """
    n = F.coalesce(F.col(n_messages).cast("long"), F.lit(0)).alias("n_messages")
    names = F.array_distinct(F.array_compact(F.coalesce(F.col(docs), F.array().cast(turns.schema[docs].dataType))))
    own = turns.select(F.col(session).alias("session"), F.col(turn).alias("turn"), n, names.alias("docs"))
    by = Window.partitionBy("session").orderBy("turn", "n_messages", "docs")
    own = own.withColumns({"place": F.row_number().over(by), "was_reset": F.coalesce(F.col("n_messages") < F.lag("n_messages").over(by), F.lit(False))})
    own = own.withColumn("epoch", F.sum(F.col("was_reset").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    said = own.select("session", "epoch", "place", F.posexplode("docs").alias("pos", "doc"))
    first = said.groupBy(F.col("session").alias("s"), F.col("epoch").alias("e"), F.col("doc").alias("d")).agg(F.min("place").alias("first"))
    named = said.join(first, F.col("session").eqNullSafe(F.col("s")) & (F.col("epoch") == F.col("e")) & (F.col("doc") == F.col("d")))
    lists = named.groupBy("s", F.col("place").alias("p")).agg(F.array_sort(F.collect_list(F.struct("pos", "doc", (F.col("first") == F.col("place")).alias("new")))).alias("x"))
    none = F.array().cast(turns.schema[docs].dataType)
    of = lambda x, new: F.coalesce(F.transform(F.filter(x, lambda d: d["new"] == F.lit(new)), lambda d: d["doc"]), none)
    made = own.join(lists, F.col("session").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")), "left")
    return made.select(F.col("session").alias(session), F.col("turn").alias(turn), "n_messages", "was_reset", of(F.col("x"), True).alias("new_docs"), of(F.col("x"), False).alias("repeated_docs"))
