"""The turns of agents' sessions as a whole: replayed prefixes, documents and blocks of tool results, and what that saves.

A turn's request begins with the messages of the turn before, and what was made of these stays: such turns are a
run, whose last request holds the messages of all of them.  So each message is looked at once, in its run's last
request, and counts for the turn that brought it; the other turns' bodies get the same texts.

Defined results: a turn that does not begin with the whole turn before starts a run, and nothing earlier counts in
it; requests without messages, null or unreadable ones, are runs of their own and stay as they are.  Turns of one
number are taken by their messages; rows that repeat session, turn and messages are one turn with one result each.
A null session is a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import chunking, extract, payloads
from .shared import Scratch

# What stands for documents that an earlier result has.
ALL_SEEN = "[All {n} documents identical to a previous tool result. Refer to the earlier result above.]"
SAME = "[Duplicate — identical to previous tool result ({call}). Refer to the earlier result above.]"
COUNTS = ("docs_deduped", "doc_chars_saved", "blocks_total", "blocks_deduped", "block_chars_saved")


def _keyed(bodies: DataFrame, session: str, turn: str, body: str) -> DataFrame:
    """(session, turn, body, hashes, at): ``at`` names a turn with its messages."""
    hashes = F.coalesce(F.transform(F.from_json(body, "messages array<string>")["messages"], lambda m: F.md5(F.coalesce(m, F.lit("")))), F.array().cast("array<string>"))
    own = bodies.select(F.col(session).alias("session"), F.col(turn).alias("turn"), F.col(body).alias("body"), hashes.alias("hashes"))
    return own.withColumn("at", F.to_json(F.struct("session", "turn", F.md5(F.array_join("hashes", "")).alias("digest"))))


def runs(keyed: DataFrame) -> DataFrame:
    """(at, session, place, n, replayed, run, last): n messages, of which the first ``replayed`` are the turn before; ``run`` names the run.  Without bodies."""
    own = keyed.select("at", "session", "turn", "hashes").dropDuplicates(["at"]).withColumn("n", F.size("hashes"))
    by = Window.partitionBy("session").orderBy("turn", "hashes")
    before = F.lag("hashes").over(by)
    same = F.coalesce((F.size(before) > 0) & (F.slice("hashes", 1, F.greatest(F.size(before), F.lit(1))) == before), F.lit(False))
    own = own.withColumns({"place": F.row_number().over(by), "before": F.coalesce(F.size(before), F.lit(0)), "same": same})
    number = F.sum((~F.col("same")).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumns({"replayed": F.when(F.col("same"), F.col("before")).otherwise(0), "number": number, "last": ~F.coalesce(F.lead("same").over(by), F.lit(False))})
    return own.select("at", "session", "place", "n", "replayed", F.to_json(F.struct("session", "number")).alias("run"), "last")


def _rebuilt(mode: Column, text: Column, docs: Column) -> Column:
    return F.when(mode == "xml", extract.to_xml(docs)).when(mode == "numbered", extract.to_numbered(docs)).otherwise(extract.to_json_results(text, docs))


def _lists(results: DataFrame) -> DataFrame:
    """(payload, msg, part, docs, saved, new): results that list documents, without those that earlier ones, or they themselves, had before; the first stays."""
    own = results.withColumn("x", extract.auto(F.col("text"))).where(F.size("x.documents") >= 2)
    said = own.select("payload", "msg", "part", F.posexplode("x.documents").alias("pos", "doc")).withColumn("h", F.sha2("doc", 256))
    copy = F.row_number().over(Window.partitionBy("payload", "h").orderBy("msg", "part", "pos"))
    left = F.array_sort(F.collect_list(F.when(F.col("copy") == 1, F.struct("pos", "doc"))))
    kept = said.withColumn("copy", copy).groupBy("payload", "msg", "part").agg(left.alias("kept"), F.count_if(F.col("copy") > 1).alias("docs"))
    first = own.groupBy("payload").agg(F.min(F.struct("msg", "part")).alias("first"))
    both = own.join(kept.join(first, "payload"), ["payload", "msg", "part"]).where((F.struct("msg", "part") != F.col("first")) & (F.col("docs") > 0))
    docs = F.transform("kept", lambda d: d["doc"])
    none_left = F.replace(F.lit(ALL_SEEN), F.lit("{n}"), F.col("docs").cast("string"))
    whole = F.when(F.col("x.mode") == "json", none_left).otherwise(_rebuilt(F.col("x.mode"), F.col("text"), F.array(none_left)))
    new = F.when(F.size("kept") == 0, whole).otherwise(_rebuilt(F.col("x.mode"), F.col("text"), docs))
    return both.withColumn("new", new).select("payload", "msg", "part", "docs", (F.length("text") - F.length("new")).cast("bigint").alias("saved"), "new")


def _copies(results: DataFrame) -> DataFrame:
    """(payload, msg, part, docs, saved, new): results that are one document, which another call gave before."""
    own = results.select("payload", "msg", "part", "call_id", F.length("text").alias("chars"), F.sha2(extract.single_document(F.col("text")), 256).alias("h")).where("h IS NOT NULL")
    first = F.first("call_id").over(Window.partitionBy("payload", "h").orderBy("msg", "part").rowsBetween(Window.unboundedPreceding, 0))
    again = own.withColumn("origin", first).where("origin <> call_id").withColumn("new", F.replace(F.lit(SAME), F.lit("{call}"), F.col("origin")))
    return again.select("payload", "msg", "part", F.lit(1).cast("bigint").alias("docs"), (F.col("chars") - F.length("new")).cast("bigint").alias("saved"), "new")


def effects(segments: DataFrame, min_chars: int = chunking.MIN_CONTENT_CHARS) -> DataFrame:
    """(payload, msg, part, text, *COUNTS): what becomes of the segments of chat requests, documents taken first, then blocks; ``text`` is null where nothing changes."""
    results = segments.where("kind = 'tool_result'")
    at = ["payload", "msg", "part"]
    told = _lists(results).unionByName(_copies(results))
    own = segments.join(told.select(*at, "new"), at, "left").withColumn("text", F.coalesce("new", "text")).drop("new")
    cut = F.when(F.col("blocks_deduped") > 0, F.col("text"))
    blocks = payloads.deduped(own, min_chars).select(*at, "blocks_total", "blocks_deduped", F.col("chars_saved").alias("block_chars_saved"), cut.alias("cut"))
    made = told.join(blocks, at, "full").withColumnsRenamed({"docs": "docs_deduped", "saved": "doc_chars_saved"})
    return made.select(*at, F.coalesce("cut", "new").alias("text"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS))


def optimized(bodies: DataFrame, session: str, turn: str, body: str, min_chars: int = chunking.MIN_CONTENT_CHARS) -> DataFrame:
    """(session, turn, n, replayed, *COUNTS, chars_saved, cumulative_chars_saved, body) of every turn; counts are of the messages that the turn brought.

    Bodies are dealt by turn and texts by place, once each; what is found meets them there.
    """
    scratch = Scratch(bodies.sparkSession, "turns")
    keyed = scratch.dealt(_keyed(bodies, session, turn, body), "at")
    found = scratch.written(runs(keyed))
    ends = keyed.select("at", "body").join(found.where("last").select("at", "run"), "at").groupBy("at").agg(F.first("run").alias("payload"), F.first("body").alias("body"))
    segments = scratch.dealt(payloads.openai_chat(ends, "payload", "body"), "payload", "msg", "part")
    made = scratch.written(effects(segments, min_chars))
    scratch.drop(segments)
    brought = found.where("n > replayed").select("run", "at", F.explode(F.sequence("replayed", F.col("n") - 1)).alias("msg"))
    sums = made.join(brought, (made["payload"] == brought["run"]) & (made["msg"] == brought["msg"])).groupBy("at").agg(*(F.sum(c).alias(c) for c in COUNTS))
    upto = Window.partitionBy("session").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    counted = found.join(sums, "at", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS}).withColumn("chars_saved", F.col("doc_chars_saved") + F.col("block_chars_saved"))
    counted = counted.withColumn("cumulative_chars_saved", F.sum("chars_saved").over(upto)).drop("session", "place", "run", "last")
    texts = made.where("text IS NOT NULL").join(found.select("run", "n", "at"), (F.col("payload") == F.col("run")) & (F.col("msg") < F.col("n"))).select(F.col("at").alias("payload"), "msg", "part", "text")
    back = payloads.written_back(keyed.drop("hashes"), texts, "at", "body", null_payloads=False)
    return back.join(counted, "at").select(F.col("session").alias(session), F.col("turn").alias(turn), "n", "replayed", *COUNTS, "chars_saved", "cumulative_chars_saved", F.col("body").alias(body))
