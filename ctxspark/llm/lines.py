"""Line dedup over levelled sorted runs of line hashes, in DataFrame functions only.

Documents are dealt in batches by id.  A batch's line keys (128-bit hashes) are counted and hashed into
buckets once; everything after that goes bucket by bucket, in the order of the keys, without a shuffle.
A merge anti-join with the runs finds the keys that no earlier batch had: they become a new run, so a key
lies in one run only.  Keys that the runs know already give an increment of their counts.  When a level
has ``FANOUT`` runs (or increments), a full outer merge join makes one of the next level of them.

Whether a line goes depends on its key's count over all batches, and the largest id keeps it: one pass
over all keys against the frequent ones finds the lines that go.  Keys that a thousandth of all rows or
more hold are at most a thousand; they are sent to every task, so that no task gets a frequent key's rows.

Defined results: a null or empty text is one empty line; repeated rows of one id are one document and
are cleaned alike; rows without id count as one document, which keeps a line only if no other has it;
an empty table gives no rows; other columns are kept (``clean``), whatever their names.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, scratch_path, table, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Keys of a bucket, and the most buckets.
BUCKET_KEYS, MOST_BUCKETS = 250_000, 20_000
#: A key is hot if at least this part of all rows has it: there are at most so many.
HOT = 1000
_SPACE = " \t\n\x0b\x0c\r"


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACE))


def line_key(line: Column) -> Column:
    """(h1, h2) of a stripped line with A-Z in lower case."""
    low = F.translate(line, string.ascii_uppercase, string.ascii_lowercase)
    return F.struct(F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7), low).alias("h2"))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Levelled runs of (h1, h2, n, last): bucketed, sorted tables in the shared folder.

    ``fresh`` are the runs, disjoint in their keys; ``more`` are the increments of keys that a run has.
    """

    def __init__(self, spark: SparkSession, buckets: int, fanout: int = FANOUT):
        self.spark, self.buckets, self.fanout = spark, buckets, fanout
        self.fresh: list[list[str]] = []
        self.more: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, rows: DataFrame) -> str:
        name = f"ctxspark_run_{uuid.uuid4().hex}"
        self.paths[name] = scratch_path(self.spark, "run")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        delete_path(self.spark, self.paths.pop(name))

    def _push(self, levels: list[list[str]], name: str) -> None:
        level = 0
        while True:
            if len(levels) == level:
                levels.append([])
            levels[level].append(name)
            if len(levels[level]) < self.fanout:
                return
            old, levels[level] = levels[level], []
            name = self._write(self._merged(old))
            for table_ in old:
                self._drop(table_)
            level += 1

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, a key's counts summed up, by merge joins of their buckets."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            own = self.spark.table(name).select("h1", "h2", F.col("n").alias("n_"), F.col("last").alias("last_"))
            both = out.join(own.hint("merge"), ["h1", "h2"], "full_outer")
            out = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("last", "last_").alias("last"))
        return out

    def add(self, keys: DataFrame) -> None:
        """Adds a batch of (h1, h2, doc); its documents must not have been in an earlier batch."""
        once = keys.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))  # counted where they are before they are sent
        counted = once.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
        batch = self._write(counted.repartition(self.buckets, "h1", "h2"))
        known = [name for level in self.fresh for name in level]
        if known:
            own = fresh = self.spark.table(batch)
            for name in known:
                fresh = fresh.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            added = self._write(fresh)
            again = own.join(self.spark.table(added).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
            self._push(self.more, self._write(again))
            self._drop(batch)
            batch = added
        self._push(self.fresh, batch)

    def read(self) -> DataFrame:
        """Every key once with its count over all batches: its run's row with all increments, by merge joins."""
        increments = [name for level in self.more for name in level]
        out = None
        for name in (name for level in self.fresh for name in level):
            run = self.spark.table(name)
            for other in increments:
                own = self.spark.table(other).select("h1", "h2", F.col("n").alias("n_"), F.col("last").alias("last_"))
                run = run.join(own.hint("merge"), ["h1", "h2"], "left")
                run = run.select("h1", "h2", (F.col("n") + F.coalesce("n_", F.lit(0))).alias("n"), F.greatest("last", "last_").alias("last"))
            out = run if out is None else out.unionByName(run)
        return out

    def close(self) -> None:
        for name in list(self.paths):
            self._drop(name)


def keyed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, h1, h2): the distinct keys of each row's long lines."""
    long_ones = F.filter(F.transform(lines_of(F.col(text_col)), stripped), lambda s: F.length(s) >= min_chars)
    rows = docs.select(F.col(id_col).alias("doc"), F.explode(F.array_distinct(F.transform(long_ones, line_key))).alias("key"))
    return rows.select("doc", "key.h1", "key.h2")


def dropped_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """(doc, gone): for each document that loses lines, the keys of those lines."""
    spark = docs.sparkSession
    keys = keyed(docs, id_col, text_col, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))
    keys = written(keys, "lines", "batch")
    total = keys.count()
    runs = LineRuns(spark, max(1, min(MOST_BUCKETS, -(-total // BUCKET_KEYS))))
    for b in range(batches):
        runs.add(keys.where(F.col("batch") == b).drop("batch"))
    often = written(runs.read().where(F.col("n") >= min_docs).select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n", "last"), "often")
    runs.close()
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    rows, least = keys.drop("batch"), max(min_docs, -(-total // HOT))
    hot = F.broadcast(often.where(F.col("n") >= least))  # at most HOT rows, as their counts add up to no more than all
    found = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(often.where(F.col("n") < least), same))
    lost = found.where(~F.col("doc").eqNullSafe(F.col("last")))
    return lost.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> tuple[DataFrame, str, str, str]:
    """All rows and columns of ``docs`` with three more: kept text, number of lines, number of dropped lines; and their names."""
    taken = {c.lower() for c in docs.columns}
    name = {}
    for c in ("doc", "gone", "kept_text", "n_lines", "n_dropped", "all_lines"):
        name[c] = c
        while name[c].lower() in taken:
            name[c] += "_"
        taken.add(name[c].lower())
    lost = dropped_keys(docs, id_col, text_col, min_chars, min_docs, batches).select(F.col("doc").alias(name["doc"]), F.col("gone").alias(name["gone"]))
    own = docs.join(lost, docs[id_col].eqNullSafe(lost[name["doc"]]), "left")
    gone, lines = F.col(name["gone"]), lines_of(F.col(text_col))

    def stays(line: Column) -> Column:
        s = stripped(line)
        return ~((F.length(s) >= min_chars) & F.array_contains(gone, line_key(s)))

    kept = F.when(gone.isNotNull(), F.filter(lines, stays))
    own = own.withColumn(name["all_lines"], kept)
    some = F.col(name["all_lines"])
    own = own.withColumns(
        {
            name["kept_text"]: F.when(gone.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(some, "\n")),
            name["n_lines"]: F.size(lines).cast("long"),
            name["n_dropped"]: F.when(gone.isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(some)).cast("long"),
        }
    )
    return own.drop(name["doc"], name["gone"], name["all_lines"]), name["kept_text"], name["n_lines"], name["n_dropped"]


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", **options) -> DataFrame:
    """The rows and columns of ``docs`` with repeated lines taken out of the text, and its length set anew.

    Texts that lose nothing stay as they are, null texts too.
    """
    cleaned, kept, _, n_dropped = clean(docs, id_col, text_col, **options)
    changed = F.col(n_dropped) > 0
    out = {text_col: F.when(changed, F.col(kept)).otherwise(F.col(text_col))}
    if chars_col in docs.columns:
        out[chars_col] = F.when(changed, F.length(kept)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType)
    return cleaned.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that at least five documents hold; the largest id keeps its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned, kept, n_lines, n_dropped = clean(docs)
    return cleaned.select("doc_id", F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.sha2(F.col(kept), 256).alias("kept_sha256"))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, lower_key AS k FROM (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents))),
often AS (SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, (o.k IS NOT NULL AND o.last <> l.doc_id) AS gone FROM lines l LEFT JOIN often o ON l.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
