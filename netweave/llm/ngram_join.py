"""Jaccard join of documents over sets of word shingles, by an index of count vectors.

Shingles are hashed into ``GROUPS`` groups; a document's numbers of shingles per group are
a point, and the sum over groups of the smaller of two points' counts bounds the overlap of
two documents from above.

A tree of boxes over all points can't tell unrelated documents apart (their counts differ
little in any one direction, so all boxes overlap), hence the index has two levels. Above,
shingles are dealt into sections, so many that two documents within the threshold must
agree in one section at least in which they have shingles: their difference is smaller
than the number of sections. Points are looked up by that section's content, which is one
shuffle. Below, the points that share a section stand in leaves with bounding boxes; boxes
first, then points are compared by the sum of coordinate minima, and pairs that survive
are verified on their whole sets.

Sizes fall into levels; a document is entered under its own level and, if its partners may
be there, the next, so that documents of comparable size meet under one scheme.

Equal sets are one entry. Within a section, entries are first paired with one of them only.
Of these pairs each entry's best is verified, then those that are still in different
components; then each entry tries its best partner of another component, and at last all
pairs that are still in different components are compared as well: those that were found with
the best ones, and anew those of sections with too many of them to be told. So no link between
components is lost, and groups of copies don't expand into all pairs.

Words are runs without ASCII white space, with A-Z in lower case. Sets hold 64-bit hashes.

Defined cases: a null, empty or blank text has no shingles and links with nothing; fewer
words than a shingle are one shingle; repeated rows are members of their set each; a null
id stays null and is nobody's component; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import LOWER, UPPER, saved, sweep
from netweave.llm.components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

GROUPS = 512
LEAF = 64
BLOCK = 1024
#: Entries of a section up to which it is compared together with others, pairs compared in one go, and pairs per entry
#: up to which a section tells all of them at once.
FEW, PAIRS, TOLD = 64, 4096, 4
BUFFER = 1_500_000
REMEMBERED = 500_000
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())

ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                              0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


# Keys are cut to 48 bits: equal keys only propose pairs, and shorter ones shuffle less.
KEY = np.uint64((1 << 48) - 1)


def _odd(which: int, times: int) -> np.uint64:
    return np.uint64(int(ODD[which]) * times & 0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Hashes(dict):
    """64-bit hashes of words, worked out when first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little", signed=True)
        return found


class Shingles:
    """Sorted distinct 64-bit shingle hashes of a text given as UTF-8."""

    def __init__(self, size: int):
        self.size, self.known = size, _Hashes()

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.translate(FOLD).split() if text else []
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        h = np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
        k = min(self.size, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out = _mix(out + h[j:len(h) - k + 1 + j]) * ODD[j % len(ODD)]
        out = _mix(out)
        out.sort()
        new = np.ones(len(out), bool)
        np.not_equal(out[1:], out[:-1], out=new[1:])
        return out[new]


def set_id(s: np.ndarray) -> int:
    return int(_mix(np.array([_mix(s * ODD[4]).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def point(s: np.ndarray) -> bytes:
    counts = np.bincount((_mix(s ^ ODD[5]) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    top = counts.max(initial=0)
    return counts.astype("u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def points(cells: list[bytes]) -> np.ndarray:
    """Counts in the narrowest type that holds them all."""
    if not cells:
        return np.empty((0, GROUPS), np.uint8)
    kinds = {GROUPS: "u1", 2 * GROUPS: "<u2", 4 * GROUPS: "<u4"}
    return np.stack([np.frombuffer(c, kinds[len(c)]) for c in cells])


def _cells(column: pa.Array) -> np.ndarray:
    """``points`` of a column, without a look at every row where all counts are of one byte."""
    if pa.types.is_binary(column.type) and not column.null_count:
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        if (np.diff(at) == GROUPS).all():
            return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].reshape(-1, GROUPS)
    return points(column.to_pylist())


class Sections:
    """Keys of a set's sections under the scheme of its size level and of the next."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows, self.highs = [1], [self._high(1)]

    def _high(self, low: int) -> int:
        """A level's ends differ by the square of the threshold: that gives the fewest keys."""
        return low * self.den**2 // self.num**2

    def level(self, n: int) -> int:
        while self.highs[-1] < n:
            self.lows.append(self.highs[-1] + 1)
            self.highs.append(self._high(self.lows[-1]))
        return int(np.searchsorted(np.array(self.highs), n))

    def apart(self, level: int) -> int:
        """The greatest difference of two linked sets of at most the level's size."""
        self.level(self.lows[0] if level < len(self.highs) else self.highs[-1] + 1)
        while len(self.highs) <= level:
            self.level(self.highs[-1] + 1)
        return 2 * self.highs[level] * (self.den - self.num) // (self.den + self.num)

    def keys(self, s: np.ndarray) -> np.ndarray:
        own = self.level(len(s))
        out = []
        for level in (own, own + 1):
            apart = self.apart(level)
            if apart == 0 or level != own and self.lows[level] * self.num > len(s) * self.den:
                continue
            many = apart + 4 + apart // 12
            mixed = _mix(s + _odd(6, level + 1))
            section = ((mixed >> np.uint64(32)) * np.uint64(many)) >> np.uint64(32)
            order = np.argsort(section, kind="stable")
            section = section[order]
            starts = np.flatnonzero(np.r_[True, section[1:] != section[:-1]])
            sums = np.add.reduceat(_mix(mixed[order] * ODD[7]), starts)
            place = section[starts]
            if many - len(starts) >= many - apart:  # what agrees may be empty sections only
                blank = np.setdiff1d(np.arange(many, dtype=np.uint64), place)
                place, sums = np.r_[place, blank], np.r_[sums, np.zeros(len(blank), np.uint64)]
            out.append(_mix(sums + _mix(place * ODD[0] + _odd(1, level) ^ ODD[2])) & KEY)
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _entries(size: int, num: int, den: int, kind: pa.DataType | None = None):
    """Documents to rows of three kinds: entries, section keys, links within the task.

    Keys that a task holds more than once become links to the smallest entry of each, and
    one row goes on per key, so that a hot key sends one row per block of keys.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sections = Shingles(size), Sections(num, den)
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: set[int] = set()
        id_type = None
        held = 0

        def rows(at, key, a, b, n=None, ids=None, cells=None):
            m = len(at)
            none = lambda t: pa.nulls(m, t)
            return pa.RecordBatch.from_arrays([
                pa.array(at, pa.int64()), none(pa.int64()) if key is None else pa.array(key, pa.int64()),
                pa.array(a, pa.int64()), none(pa.int64()) if b is None else pa.array(b, pa.int64()),
                none(pa.int32()) if n is None else pa.array(n, pa.int32()),
                none(id_type) if ids is None else ids, none(pa.binary()) if cells is None else pa.array(cells, pa.binary()),
            ], ["at", "key", "a", "b", "n", "doc_id", "cells"])

        def flush():
            nonlocal keys, owners, held
            if not keys:
                return
            k, a = np.concatenate(keys).view(np.int64), np.concatenate(owners)
            keys, owners, held = [], [], 0
            order = np.lexsort((a, k))
            k, a = k[order], a[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])]
            k, a = k[new], a[new]
            first = np.r_[True, k[1:] != k[:-1]]
            leader = a[np.flatnonzero(first)][np.cumsum(first) - 1]
            for low in range(0, int(first.sum()), 100_000):
                part = np.flatnonzero(first)[low:low + 100_000]
                yield rows(k[part], None, a[part], None)
            rest = np.flatnonzero(~first)
            for low in range(0, len(rest), 100_000):
                part = rest[low:low + 100_000]
                at = _mix(a[part].view(np.uint64) ^ k[part].view(np.uint64)).view(np.int64)
                yield rows(at, k[part], leader[part], a[part])

        for batch in batches:
            id_type = batch.schema.field(0).type
            n, sids, cells, at = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                s = shingles(text.as_py())
                sid = set_id(s) if len(s) else None
                n.append(len(s))
                sids.append(sid)
                cells.append(point(s) if len(s) else None)
                at.append((sid or 0) + i * 7919 & 0x7FFFFFFFFFFFFFFF)
                if len(s) and sid not in seen:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen.add(sid)
                    got = sections.keys(s)
                    if len(got):
                        keys.append(got)
                        owners.append(np.full(len(got), sid, np.int64))
                        held += len(got)
                        if held > BUFFER:
                            yield from flush()
            yield rows(at, None, sids, None, n, batch.column(0), cells)
        yield from flush()

    return run


def _leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``at``: the first entry of a section's key is linked with the others.

    Entries (with cells) and links (with b) pass as they are.
    """
    last_key = last_a = None
    for batch in batches:
        names = batch.schema.names
        n, b = batch.column(names.index("n")), batch.column(names.index("b"))
        plain = n.is_valid().to_numpy(zero_copy_only=False) | b.is_valid().to_numpy(zero_copy_only=False)
        if plain.any():
            yield batch.filter(pa.array(plain)).drop_columns(["at"])
        at = np.flatnonzero(~plain)
        if not len(at):
            continue
        k = batch.column(names.index("at")).take(pa.array(at)).to_numpy()
        a = batch.column(names.index("a")).take(pa.array(at)).to_numpy()
        first = np.r_[k[0] != last_key, k[1:] != k[:-1]]
        if first[0]:
            leader = a[np.flatnonzero(first)][np.cumsum(first) - 1]
        else:
            leader = np.r_[last_a, a[np.flatnonzero(first)]][np.cumsum(first)]
        last_key, last_a = k[-1], leader[-1]
        linked = np.flatnonzero(leader != a)
        if len(linked):
            m = len(linked)
            types = {f.name: f.type for f in batch.schema}
            yield pa.RecordBatch.from_arrays([
                pa.array(k[linked], pa.int64()), pa.array(leader[linked], pa.int64()), pa.array(a[linked], pa.int64()),
                pa.nulls(m, pa.int32()), pa.nulls(m, types["doc_id"]), pa.nulls(m, pa.binary()),
            ], ["key", "a", "b", "n", "doc_id", "cells"])


def _bounded(num: int, den: int):
    """Pairs whose points allow the overlap that the threshold asks for, with that overlap's share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                a, b, na, nb, ca, cb = (part.column(i) for i in range(6))
                most = np.minimum(points(ca.to_pylist()), points(cb.to_pylist())).sum(1, dtype=np.int64)
                sizes = na.to_numpy().astype(np.int64) + nb.to_numpy()
                keep = pa.array(den * most >= num * (sizes - most))
                share = pa.array(most / np.maximum(1, sizes))
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep), share.filter(keep)], ["a", "b", "share"])
    return run


def _verified(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])
    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(size)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                sids, sets = [], []
                for wanted, text in zip(part.column(0).to_pylist(), part.column(1)):
                    s = shingles(text.as_py())
                    if len(s) and set_id(s) == wanted:  # another row may have the same id
                        sids.append(wanted)
                        sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(sets, pa.binary())], ["sid", "hashes"])
    return run


def _best(group: np.ndarray, p: np.ndarray, q: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Which pairs are the best of their group for an entry: the greatest share, then the smallest other entry."""
    of, own, other, many = np.r_[group, group], np.r_[p, q], np.r_[q, p], np.r_[share, share]
    order = np.lexsort((other, -many, own, of))
    first = np.r_[True, (own[order][1:] != own[order][:-1]) | (of[order][1:] != of[order][:-1])]
    best = np.zeros(len(p), bool)
    best[order[first] % len(p)] = True
    return best


def _across(num: int, den: int, best: bool):
    """Pairs of different components within a section, by boxes and then by points.

    With ``best``, each entry's pair of the greatest bound, and the other pairs as ``rest``; of a section with more than
    ``TOLD`` pairs per entry the ``key`` instead of these.

    Rows come sorted by (key, part); ``side`` tells which of two blocks an entry is in, 0
    and 0 being one block met with itself. Sections of few entries are compared together.
    """
    def boxed(a, n, c, comp, left, right):
        found = [[np.empty(0, np.int64)] for _ in range(3)]
        leaves = [[idx[i:i + LEAF] for i in range(0, len(idx), LEAF)] for idx in (left, right)]
        boxes = [[(c[x].max(0), n[x].min(), n[x].max(), comp[x].min(), comp[x].max()) for x in side] for side in leaves]
        same = left is right
        for i, (x, bx) in enumerate(zip(leaves[0], boxes[0])):
            for j in range(i if same else 0, len(leaves[1])):
                y, by = leaves[1][j], boxes[1][j]
                if bx[2] * den < by[1] * num or by[2] * den < bx[1] * num or bx[3] == bx[4] == by[3] == by[4]:
                    continue
                most = int(np.minimum(bx[0], by[0]).sum(dtype=np.int64))
                if den * most < num * (bx[1] + by[1] - most):
                    continue
                most = np.minimum(c[x][:, None, :], c[y][None, :, :]).sum(2, dtype=np.int32).astype(np.int64)
                ok = (den * most >= num * (n[x][:, None] + n[y][None, :] - most)) & (comp[x][:, None] != comp[y][None, :])
                if same and i == j:
                    ok &= np.triu(np.ones(ok.shape, bool), 1)
                p, q = np.nonzero(ok)
                for to, v in zip(found, (a[x[p]], a[y[q]], most[p, q] / (n[x[p]] + n[y[q]]))):
                    to.append(v)
        return [np.concatenate(v) for v in found]

    def told(key, size, group, p, q, share):
        """Pairs and keys of groups (key and number of entries of each)."""
        kind = np.zeros(len(p), bool)
        open_keys = np.empty(0, np.int64)
        if best and len(p):
            kind = ~_best(group, p, q, share)
            much = np.bincount(group, minlength=len(key)) > TOLD * size
            open_keys = key[much]
            keep = ~(kind & much[group])
            p, q, kind = p[keep], q[keep], kind[keep]
        none = len(open_keys)
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(np.minimum(p, q), pa.int64()), pa.nulls(none, pa.int64())]),
            pa.concat_arrays([pa.array(np.maximum(p, q), pa.int64()), pa.nulls(none, pa.int64())]),
            pa.concat_arrays([pa.array(kind), pa.nulls(none, pa.bool_())]),
            pa.concat_arrays([pa.nulls(len(p), pa.int64()), pa.array(open_keys, pa.int64())])], ["a", "b", "rest", "key"])

    def whole(t: pa.RecordBatch) -> pa.RecordBatch:
        a, n, comp, side = (t.column(x).to_numpy() for x in ("sid", "n", "comp", "side"))
        c = _cells(t.column("cells"))
        n = n.astype(np.int64)
        order = np.lexsort((c[:, 0], n, comp))  # leaves of one component meet no leaf of their own
        a, n, comp, side, c = a[order], n[order], comp[order], side[order], c[order]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        p, q, share = boxed(a, n, c, comp, left, right if len(right) else left)
        return told(t.column("key").to_numpy()[:1], np.array([len(a)]), np.zeros(len(p), np.int64), p, q, share)

    def together(t: pa.RecordBatch, starts: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Groups of few entries, from ``starts``: all their pairs side by side."""
        a, n, comp, side = (t.column(x).to_numpy() for x in ("sid", "n", "comp", "side"))
        c, n = _cells(t.column("cells")), n.astype(np.int64)
        group, one, other = ([np.empty(0, np.int64)] for _ in range(3))
        for m in np.unique(size):
            mine = np.flatnonzero(size == m)
            i, j = np.triu_indices(m, 1)
            group.append(np.repeat(mine, len(i)))
            one.append((starts[mine][:, None] + i).ravel())
            other.append((starts[mine][:, None] + j).ravel())
        group, one, other = (np.concatenate(v) for v in (group, one, other))
        later = np.r_[0, np.cumsum(side == 1)]
        two = later[starts + size] > later[starts]
        some = (comp[one] != comp[other]) & ((side[one] != side[other]) | ~two[group])
        some &= np.minimum(n[one], n[other]) * den >= np.maximum(n[one], n[other]) * num
        group, one, other = group[some], one[some], other[some]
        most = [np.minimum(c[one[low:low + PAIRS]], c[other[low:low + PAIRS]]).sum(1, dtype=np.int64) for low in range(0, len(one), PAIRS)]
        most = np.concatenate([np.empty(0, np.int64), *most])
        ok = den * most >= num * (n[one] + n[other] - most)
        group, one, other, share = group[ok], one[ok], other[ok], most[ok] / (n[one[ok]] + n[other[ok]])
        yield told(t.column("key").to_numpy()[starts], size, group, a[one], a[other], share)

    def groups(t: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts, size = cuts[:-1], np.diff(cuts)
        few = (size <= FEW) & (size > 1)
        if few.any():
            yield from together(t, starts[few], size[few])
        for low, m in zip(starts[size > FEW], size[size > FEW]):
            yield whole(t.slice(low, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not t.num_rows:
                continue
            t = t.to_batches()[0]
            k, p = t.column(0).to_numpy(), t.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]) | (p[1:] != p[:-1])) + 1]
            yield from groups(t, cuts)
            held = t.slice(cuts[-1])
        if held is not None:
            yield from groups(held, np.array([0, held.num_rows]))

    return run


class JaccardJoin:
    """The join of a table of documents with itself; ``num / den`` is the least similarity."""

    def __init__(self, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id"):
        self.spark, self.size, self.num, self.den = docs.sparkSession, size, num, den
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
        self.id_type = docs.schema[doc_id].dataType.simpleString()
        self.paths: list[str] = []

    def _saved(self, df: DataFrame, purpose: str) -> DataFrame:
        out, path = saved(df, purpose)
        self.paths.append(path)
        return out

    def index(self) -> None:
        """``entries``: doc_id, n, sid, cells of every document; ``star``: key, a, b."""
        fields = f"key long, a long, b long, n int, doc_id {self.id_type}, cells binary"
        rows = self.docs.mapInArrow(_entries(self.size, self.num, self.den), "at long, " + fields)
        dealt = rows.repartition("at").sortWithinPartitions("at", "a").mapInArrow(_leaders, fields)
        both = self._saved(dealt, "sections")
        del rows, dealt
        sweep(self.spark)
        self.entries = both.where("key is null").select("doc_id", "n", F.col("a").alias("sid"), "cells")
        self.star = both.where("key is not null").select("key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        heads = self.entries.where("sid is not null").groupBy("sid").agg(
            F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("cells").alias("cells"))
        self.heads = self._saved(heads, "heads")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        a = self.heads.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("cells").alias("ca"))
        b = self.heads.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("cells").alias("cb"))
        near = (F.col("na") * self.den >= F.col("nb") * self.num) & (F.col("nb") * self.den >= F.col("na") * self.num)
        full = pairs.join(a, "a").join(b, "b").where(near).select("a", "b", "na", "nb", "ca", "cb")
        return full.mapInArrow(_bounded(self.num, self.den), "a long, b long, share double")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that reach the threshold on their whole sets, saved.

        Texts are joined by shuffle at every size, and what was shuffled goes afterwards.
        """
        sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        wanted = sids.join(self.heads.select("sid", "doc_id"), "sid")
        texts = self.docs.join(wanted.hint("merge"), "doc_id").select("sid", "text")
        sets = self._saved(texts.mapInArrow(_sets(self.size), "sid long, hashes binary"), "sets")
        a = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("ha"))
        b = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("hb"))
        full = pairs.join(a, "a").join(b, "b").select("a", "b", "ha", "hb")
        links = self._saved(full.mapInArrow(_verified(self.num, self.den), "a long, b long"), "links")
        del sids, wanted, texts, sets, a, b, full
        sweep(self.spark)
        return links

    def apart(self, pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs whose ends are in different components of ``links``."""
        comps = components(links)
        a = comps.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        b = comps.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        full = pairs.join(a, "a", "left").join(b, "b", "left")
        return full.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def across(self, comps: DataFrame, best: bool = False, keys: DataFrame | None = None) -> DataFrame:
        """Candidate pairs of different components within a section, or within those of ``keys``: a, b, rest, key (see ``_across``).

        Members of sections that hold one component only drop out before anything is
        gathered. Larger sections are split into blocks that meet pair by pair.
        """
        star = self.star if keys is None else self.star.join(keys, "key", "left_semi")
        both = star.select("key", F.col("a").alias("sid")).unionByName(star.select("key", F.col("b").alias("sid")))
        of = both.distinct().join(comps, F.col("sid") == F.col("node"), "left").select(
            "key", "sid", F.coalesce("comp", "sid").alias("comp"))
        of = self._saved(of, "members")
        sweep(self.spark)
        mixed = of.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"))
        mixed = mixed.where("low <> high").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
        rows = of.join(mixed, "key").withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        part = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
        side = F.when(F.col("own") > F.col("other"), 1).otherwise(0)
        rows = rows.select("key", part.cast("long").alias("part"), "sid", "comp", side.cast("int").alias("side"))
        rows = rows.join(self.heads.select("sid", "n", "cells"), "sid").select("key", "part", "sid", "comp", "side", "n", "cells")
        dealt = rows.repartition("key", "part").sortWithinPartitions("key", "part")
        return dealt.mapInArrow(_across(self.num, self.den, best), "a long, b long, rest boolean, key long").distinct()

    def classes(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every document."""
        self.index()
        first = self._saved(self.bounded(self.star.select("a", "b").distinct()), "candidates")
        best = first.groupBy("b").agg(F.max(F.struct("share", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        tried = self._saved(best, "tried")
        links = self.verified(tried)
        rest = first.select("a", "b").join(tried, ["a", "b"], "left_anti")
        within: list[DataFrame] = []

        def best_across() -> DataFrame:
            within.append(self._saved(self.across(components(links), True), "within"))
            return within[0].where("not rest").select("a", "b").distinct()

        def all_across() -> DataFrame:
            pairs = self.apart(within[0].where("rest").select("a", "b").distinct(), links)
            keys = within[0].where("key is not null").select("key")
            return pairs if keys.isEmpty() else pairs.unionByName(self.across(components(links), keys=keys).select("a", "b")).distinct()

        for step in (lambda: self.apart(rest, links), best_across, all_across):
            found = self._saved(step(), "candidates")
            sweep(self.spark)
            new = self._saved(found.join(tried, ["a", "b"], "left_anti"), "tried")
            links = links.unionByName(self.verified(new))
            tried = tried.unionByName(new)
        comps = components(links)
        named = comps.join(self.heads.select(F.col("sid").alias("node"), "doc_id"), "node")
        names = named.groupBy("comp").agg(F.min("doc_id").alias("name"))
        by_set = named.join(names, "comp").select(F.col("node").alias("sid"), "name")
        own = self.heads.select("sid", F.col("doc_id").alias("head"))
        full = self.entries.join(own, "sid", "left").join(by_set, "sid", "left")
        return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("name", "head", "doc_id").alias("component_id"))


def jaccard_classes(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return JaccardJoin(docs, size, num, den, text, doc_id).classes()
