r"""Drop lines that many documents share.

Line hashes are kept in levelled sorted runs. A batch of documents becomes one run of
(hash, number of documents), partitioned by hash and sorted. When a level holds
``FANOUT`` runs, they are summed into one run of the next level. A batch's lines are
merge-joined with the runs: those found there often enough go, the others stay, and the
batch adds its own run.

A line's key is the line without blanks at both ends and with A-Z in lower case. Keys are
compared by 64-bit hashes.

Defined cases: a null or empty text is one empty line and comes out as an empty text;
lines with an empty key always stay; every row counts as a document, also when ids are
null or repeat; an empty table gives an empty result; extra columns pass through, and
helper columns carry the prefix ``_ln_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.common import BLANKS, ascii_lower, discard
from netweave.session import work_path

FANOUT = 4
BATCHES = 4


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column) -> Column:
    """The hash of every line's key in order; null for a line with an empty key."""
    lowered = ascii_lower(F.coalesce(text, F.lit("")))

    def hashed(line: Column) -> Column:
        key = F.trim(line, F.lit(BLANKS))
        return F.when(key != "", F.xxhash64(key))

    return F.transform(F.split(lowered, "\n", -1), hashed)


def key_counts(docs: DataFrame, text: str, *by: str) -> DataFrame:
    """Number of documents per line hash; a document counts once for each of its keys."""
    keys = docs.select(*by, F.explode(F.array_distinct(line_hashes(F.col(text)))).alias("h")).where("h is not null")
    return keys.groupBy(*by, "h").agg(F.count("*").alias("n"))


class LineRuns:
    """Levelled sorted runs of (h, n) in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _write(self, counts: DataFrame) -> str:
        """``counts`` comes out of an aggregation by hash, so it is partitioned already."""
        path = work_path(self.spark, "llm-line-run")
        counts.sortWithinPartitions("h").write.parquet(path)
        return path

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema("h long, n long").parquet(path)

    def _push(self, path: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self._summed(self.levels[level]))
            for old in self.levels[level]:
                discard(self.spark, old)
            self.levels[level] = []
            self._push(merged, level + 1)

    def _summed(self, paths: list[str]) -> DataFrame:
        rows = self._read(paths[0])
        if len(paths) == 1:
            return rows
        for path in paths[1:]:
            rows = rows.unionByName(self._read(path))
        return rows.groupBy("h").agg(F.sum("n").alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch's counts as a run of the lowest level."""
        self._push(self._write(counts), 0)

    def add_run(self, path: str) -> None:
        self._push(path, 0)

    def frequent(self, min_docs: int) -> DataFrame:
        """The hashes that the runs hold for at least ``min_docs`` documents."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "h long")
        return self._summed(paths).where(F.col("n") >= min_docs).select("h")

    def absorb(self, batch: DataFrame, min_docs: int, text: str = "text") -> DataFrame:
        """Add a batch as it arrives and return it without the lines that are frequent by now."""
        self.add(key_counts(batch, text))
        return strip(batch, self.frequent(min_docs), text)


def strip(docs: DataFrame, frequent: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the lines whose hash is in ``frequent``; adds _ln_total and _ln_dropped.

    Only hashes and places of lines are shuffled by hash; what is found goes back to the
    documents as one list of places per document.
    """
    row = F.xxhash64(F.col(doc_id), F.col(text))
    places = docs.select(F.col(doc_id).alias("id"), row.alias("row"), F.posexplode(line_hashes(F.col(text))).alias("place", "h"))
    hits = places.where("h is not null").join(frequent.withColumnRenamed("h", "fh"), F.col("h") == F.col("fh"))
    lists = hits.groupBy("id", "row").agg(F.collect_set("place").alias("_ln_places"))
    lists = lists.withColumnRenamed("id", "_ln_id").withColumnRenamed("row", "_ln_row")
    match = F.col(doc_id).eqNullSafe(F.col("_ln_id")) & (row == F.col("_ln_row"))
    both = docs.join(lists, match, "left").withColumn("_ln_lines", split_lines(F.col(text)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_ln_lines") - 1), F.col("_ln_places"))
    kept = F.array_join(F.transform(stay, lambda i: F.get(F.col("_ln_lines"), i)), "\n")
    cleaned = F.when(F.col("_ln_places").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept)
    return both.select(
        *[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.size("_ln_lines").cast("long").alias("_ln_total"),
        F.coalesce(F.size("_ln_places"), F.lit(0)).cast("long").alias("_ln_dropped"),
    )


def frequent_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", doc_id: str = "doc_id",
                   batches: int = BATCHES) -> DataFrame:
    """The line hashes of a whole table found in at least ``min_docs`` documents.

    The table is taken in batches by id. One pass counts all of them; each is a run.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(batches)).cast("int")
    counts = key_counts(docs.select(batch.alias("batch"), F.col(text)), text, "batch")
    path = work_path(spark, "llm-line-runs")
    counts.sortWithinPartitions("batch", "h").write.partitionBy("batch").parquet(path)
    runs = LineRuns(spark)
    found = {r["batch"] for r in spark.read.schema("h long, n long, batch int").parquet(path).select("batch").distinct().collect()}
    for b in sorted(found):
        runs.add_run(f"{path}/batch={b}")
    return runs.frequent(min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document without the lines that at least ``min_docs`` documents share."""
    return strip(docs, frequent_lines(docs, min_docs, text, doc_id), text, doc_id)
