"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Unit vectors within the threshold lie at most ``r = sqrt(2 - 2 cos)`` apart, so along a
Gaussian direction they differ by a normal deviate of spread ``r`` at most. A pair collides
on a projection if one value lies in the window around the other. Of ``PROJECTIONS``
windows of ``WIDTH * r``, a linked pair hits at least ``needed`` with a chance of
``1 - MISS``; pairs that do are verified by their cosine in double precision.

Equal vectors of a label are one entry with a number of copies. Along the first projection
each label's entries are sorted into blocks of about ``BLOCK``, the hot ones split by hash,
and only blocks within its widest window of each other meet. A meeting returns sums of
links and a spanning forest, a row per entry at most, not its pairs.

The number of meetings grows with the square of a label's entries: one projection at a time
can't separate more, whatever the order of work. See the README for figures.

Defined cases: a null label, null id, null, empty or zero vector, or one with a null or
non-finite component links with nothing and is kept; vectors of different length don't link;
repeated rows are copies of each other; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved
from netweave.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROJECTIONS, FIRST = 32, 8
WIDTH = 1.25
MISS = 1e-6
LEAD = 5.0
BLOCK = 1024
SEED = 20_11


def needed(tries: int, chance: float, miss: float) -> int:
    """The largest count that at least ``1 - miss`` of linked pairs reach."""
    below = 0.0
    for k in range(tries + 1):
        below += math.comb(tries, k) * chance**k * (1 - chance) ** (tries - k)
        if below > miss:
            return k
    return tries


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, embedding to entries: usable, dim, digest, unit vector, first projection."""
    axes: dict[int, np.ndarray] = {}
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            dims, digests, units, leads = [], [], [], []
            for vec, label, one in zip(part.column(0), part.column(1), part.column(2)):
                x = np.empty(0)
                if vec.is_valid and label.is_valid and one.is_valid and one.values.null_count == 0:
                    x = one.values.to_numpy(zero_copy_only=False).astype(np.float64)
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(initial=0.0)
                    ok = len(x) > 0 and np.isfinite(top) and top > 0
                    u = x / top / np.linalg.norm(x / top) if ok else x
                if not ok:
                    for column in (dims, digests, units, leads):
                        column.append(None)
                    continue
                if len(u) not in axes:
                    axes[len(u)] = directions(len(u))[:, 0]
                dims.append(len(u))
                digests.append(blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                units.append(u.tobytes())
                leads.append(float(u @ axes[len(u)]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()),
                 pa.array(units, pa.binary()), pa.array(leads, pa.float64())],
                ["vec_id", "label", "dim", "digest", "unit", "lead"])


def _collisions(pa_: np.ndarray, pb: np.ndarray, width: float) -> np.ndarray:
    """Number of projections on which b lies in the window around a, for all a and b."""
    count = np.zeros((len(pa_), len(pb)), np.int8)
    for j in range(pa_.shape[1]):
        order = np.argsort(pb[:, j])
        line = pb[order, j]
        low = np.searchsorted(line, pa_[:, j] - width, "left")
        high = np.searchsorted(line, pa_[:, j] + width, "right")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        count += (rank[None, :] >= low[:, None]) & (rank[None, :] < high[:, None])
    return count


def _meetings(cosine: float):
    width = WIDTH * math.sqrt(2 - 2 * cosine)
    chance = math.erf(WIDTH / math.sqrt(2))
    few, all_ = needed(FIRST, chance, MISS / 2), needed(PROJECTIONS, chance, MISS / 2)

    def links(x: np.ndarray, y: np.ndarray, same: bool, proj: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        px, py = x @ proj, y @ proj
        first = _collisions(px[:, :FIRST], py[:, :FIRST], width)
        i, j = np.nonzero(np.triu(first >= few, 1) if same else first >= few)
        out_i, out_j = [], []
        for low in range(0, len(i), 200_000):
            a, b = i[low:low + 200_000], j[low:low + 200_000]
            total = first[a, b] + (np.abs(px[a, FIRST:] - py[b, FIRST:]) <= width).sum(1)
            a, b = a[total >= all_], b[total >= all_]
            near = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
            out_i.append(a[near])
            out_j.append(b[near])
        none = np.empty(0, np.int64)
        return np.concatenate(out_i or [none]), np.concatenate(out_j or [none])

    def meet(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        ids, copies, side = (t.column(c).to_numpy() for c in ("rep", "copies", "side"))
        x = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = len(right) == 0
        if same:
            right = left
        i, j = links(x[left], x[right], same, directions(x.shape[1]))
        a, b = left[i], right[j]
        sums = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
        up = list(range(len(ids)))

        def root(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for p, q in zip(a.tolist(), b.tolist()):
            p, q = root(p), root(q)
            if p != q:
                if ids[p] < ids[q]:
                    up[q] = p
                else:
                    up[p] = q
        hit = np.flatnonzero(sums > 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[hit]), pa.array(sums[hit].astype(np.int64)), pa.array(ids[[root(int(k)) for k in hit]].astype(np.int64))],
            ["rep", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            m = batch.column(0).to_numpy()
            cuts = np.flatnonzero(m[1:] != m[:-1]) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, len(m)]):
                if low == high:
                    continue
                if held and m[low] != now:
                    yield meet(held)
                    held = []
                now = m[low]
                held.append(batch.slice(low, high - low))
        if held:
            yield meet(held)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding",
                    label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    kind = vectors.schema[label].dataType.simpleString()
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    cleaned, _ = saved(rows.mapInArrow(_clean, f"vec_id long, label {kind}, dim int, digest binary, unit binary, lead double"), "vectors")
    usable = cleaned.where("dim is not null")
    entries = usable.groupBy("label", "dim", "digest").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit"), F.min("lead").alias("lead"))
    entries, _ = saved(entries, "entries")

    spread = entries.groupBy("label", "dim").agg(
        F.count("*").alias("n"), F.avg("lead").alias("mid"), F.greatest(F.stddev_pop("lead"), F.lit(1e-9)).alias("dev"))
    placed = entries.join(spread, ["label", "dim"])
    cells = F.ceil(F.col("n") / BLOCK)
    share = 1 / (1 + F.exp(-1.702 * (F.col("lead") - F.col("mid")) / F.col("dev")))
    placed = placed.withColumn("cell", F.least(F.floor(share * cells), cells - 1).cast("int"))
    counts = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"))
    counts = counts.select("label", "dim", "cell", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    placed = placed.join(counts, ["label", "dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    placed = placed.select("label", "dim", "cell", "part", "rep", "copies", "unit", "lead")

    blocks = placed.groupBy("label", "dim", "cell", "part").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    blocks, _ = saved(blocks.coalesce(8), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    window = LEAD * math.sqrt(2 - 2 * cosine)
    order = F.struct("a.cell", "a.part") <= F.struct("b.cell", "b.part")
    close = (F.col("b.low") - F.col("a.high") <= window) & (F.col("a.low") - F.col("b.high") <= window)
    met = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dim") == F.col("b.dim")) & order & close)
    meeting = F.xxhash64("a.label", "a.dim", "a.cell", "a.part", "b.cell", "b.part").alias("meeting")
    own = F.struct(F.col("a.cell").alias("cell"), F.col("a.part").alias("part"), F.lit(0).alias("side"))
    other = F.struct(F.col("b.cell").alias("cell"), F.col("b.part").alias("part"), F.lit(1).alias("side"))
    alone = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.part") == F.col("b.part"))
    ends = F.explode(F.when(alone, F.array(own)).otherwise(F.array(own, other)))
    met = met.select(F.col("a.label").alias("label"), F.col("a.dim").alias("dim"), meeting, ends.alias("e"))
    met = met.select("label", "dim", "meeting", "e.cell", "e.part", "e.side")
    dealt = placed.join(met, ["label", "dim", "cell", "part"]).select("meeting", "rep", "copies", "side", "unit")
    dealt = dealt.repartition("meeting").sortWithinPartitions("meeting")
    found, _ = saved(dealt.mapInArrow(_meetings(cosine), "rep long, links long, root long"), "links")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found, "rep", "root").withColumnRenamed("node", "rep")
    known = entries.select("label", "dim", "digest", "rep", "copies").join(links, "rep", "left").join(comps, "rep", "left")
    known = known.select("label", "dim", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                         F.coalesce("comp", "rep").alias("comp"))
    full = cleaned.select("vec_id", "label", "dim", "digest").join(known, ["label", "dim", "digest"], "left")
    comp = F.coalesce("comp", "vec_id")
    return full.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"),
                       F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
