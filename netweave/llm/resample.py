"""Importance resampling: drawing the documents whose word runs look like a target's.

Texts are translated byte by byte: one table of 256 bytes lower-cases A-Z, keeps a-z, digits and all
bytes of characters beyond ASCII, and blanks the rest; ``bytes.split`` then yields the words. Features
are all runs of 1 to ``order`` consecutive words joined by one space, repeats counted. A run's crc32 is
its shorter run's, carried on over a space and the next word, so no run is ever put together. Its
bucket is the crc32 modulo ``buckets``. Tasks count buckets in a Counter of at most ``buckets`` entries,
and Spark adds those up: only such sums meet in one place, for the corpus as for the target.

A bucket's gain is floor(1000 * ln of the ratio of its smoothed shares in target and corpus); a
document's weight is the sum of gains over its features. Its score adds the noise of a Gumbel draw
from the hash of its id, so that the highest scores are a sample without replacement by weight.
``share`` of the documents with ``least`` words or more are drawn, ranked by score; ranks come
from one range partitioning, so no task holds them all.

Defined cases: null, empty and wordless texts have no features and a weight of 0; a null id is hashed as an empty
one and comes first among equal scores; repeated rows are scored and drawn row by row; an empty corpus gives
an empty result and an empty target leaves only the smoothing; other columns are left aside.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved
from netweave.operators.prep import ranked

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, BUCKETS, LEAST, SEED = 3, 10_000, 20, 42
SCALE = 1000


def byte_table() -> bytes:
    """Lower case for A-Z, the byte itself within words, a blank for the others."""
    def one(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if b >= 0x80 or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 0x20
    return bytes(map(one, range(256)))


TABLE = byte_table()


def buckets_of(text: bytes, order: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the buckets of all runs of 1 to ``order`` of them."""
    words = text.translate(TABLE).split()
    spaced = [b" " + w for w in words[1:]]
    codes, runs = list(map(crc32, words)), []
    for _ in range(order):
        runs.append(codes)
        codes, spaced = list(map(crc32, spaced, codes)), spaced[1:]
    total = sum(map(len, runs))
    return len(words), np.fromiter(chain.from_iterable(runs), np.int64, total) % buckets


def _bytes(text) -> bytes:
    return b"" if not text.is_valid else text.as_buffer().to_pybytes()


def bucket_counts(texts: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """bucket and n, how many features of all texts fall into it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for one in batch.column(0):
                counts.update(buckets_of(_bytes(one), order, buckets)[1].tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    return texts.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Every bucket's gain from two frames bucket, n of at most ``buckets`` rows each."""
    own, wanted = ({r[0]: r[1] for r in df.select("bucket", "n").collect()} for df in (corpus, target))
    s_all, t_all = float(sum(own.values()) + buckets), float(sum(wanted.values()) + buckets)

    def gain(b: int) -> int:
        return math.floor(SCALE * math.log((float(wanted.get(b, 0) + 1) * s_all) / (float(own.get(b, 0) + 1) * t_all)))

    return np.array([gain(b) for b in range(buckets)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id",
           order: int = ORDER, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            words, features, weights, scores = [], [], [], []
            for key, one in zip(keys.to_pylist(), batch.column(1)):
                n, found = buckets_of(_bytes(one), order, buckets)
                words.append(n)
                features.append(len(found))
                weights.append(int(gain[found].sum()))
                head = int(sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
                noise = math.floor(-SCALE * math.log(-math.log((head + 0.5) / 4294967296)))
                scores.append(weights[-1] + noise)
            yield pa.RecordBatch.from_arrays(
                [keys, *(pa.array(c, pa.int64()) for c in (words, features, weights, scores))],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, share: int = 5, of: int = 100, least: int = LEAST, text: str = "text",
             doc_id: str = "doc_id", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """All rows' doc_id, n_words, n_features, weight, score, and rank of those drawn (null for the others)."""
    gain = gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, text, order, buckets), buckets)
    rows, _ = saved(scored(docs, gain, text, doc_id, order, seed), "importance")
    able = F.col("n_words") >= least
    placed = ranked(rows.where(able).withColumn("_low", -F.col("score")), ["_low", "doc_id"])
    drawn = rows.where(able).count() * share // of
    rank = F.when(F.col("_rank") < drawn, F.col("_rank") + 1).cast("long").alias("rank")
    return placed.select(*rows.columns, rank).unionByName(rows.where(~able).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    ids = result.where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(doc_id).eqNullSafe(F.col("_drawn")), "left_semi")
