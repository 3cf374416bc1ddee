"""Remove byte strings that occur earlier in the corpus, by two-stage suffix sorting.

A byte goes if some string of ``SPAN`` bytes covers it that also starts earlier: in a
document of smaller id, or in the same document further ahead. Strings are judged on the
input and never cross documents.

1. Every window of ``SPAN`` bytes is assigned to an anchor, the smallest hash among the
   ``GRAM``-byte strings within it. Equal windows have equal anchors at equal offsets, so
   only windows of one anchor hash need be compared. The windows of an anchor follow each
   other; the bytes they cover are the anchor's context.
2. Equal contexts are collapsed, first within each task, then after one shuffle by anchor
   hash: all windows of a later copy are repeats. Anchors with one context are done.
3. Where an anchor hash has several contexts, their first copies are gathered in text form
   and their windows are suffix-sorted in two stages: suffixes smaller than their successors
   are sorted directly, the others are induced by scanning the buckets of first bytes in
   order. Runs of neighbours with a common prefix of ``SPAN`` bytes are equal windows, and
   all but the earliest are repeats.

A hash with more than ``GROUP`` contexts isn't gathered: its windows are spread by their
own hashes and only the earliest place of each is kept.

Defined cases: a null text is empty; ids are integers, null ids count as the smallest; rows
with one id are one document: what is removed from one is removed from all, and equal places
don't remove each other; texts shorter than ``SPAN`` lose nothing; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPAN, GRAM = 100, 32
PIECE = 1 << 21
BUFFER = 1_500_000
GROUP = 40_000
SORTED = 3 << 20
LEAST = -(1 << 63)

STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at every place, by doubling the length."""
    h = _mix(np.arange(256, dtype=np.uint64) * STEPS[0] + STEPS[1])[data]
    size = 1
    for step in STEPS:
        h = h[:-size] * step + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    return _mix(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (width - size)], x[width - size:]) if width > size else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Contexts of the texts data[start:end]: text number, first window, windows, anchor hash."""
    none = np.empty(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, np.empty(0, np.uint64)
    h = gram_hashes(data)
    bits = np.uint64(len(data).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    at = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), SPAN - GRAM + 1) & low
    inside = np.zeros(len(at) + 1, np.int32)
    long_ = ends - starts >= SPAN
    np.add.at(inside, starts[long_], 1)
    np.add.at(inside, ends[long_] - SPAN + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(windows):
        return none, none, none, np.empty(0, np.uint64)
    at = at[windows]
    owner = np.searchsorted(starts, windows, "right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[new, len(windows)])
    return owner[new], windows[new], count, h[at[new].astype(np.int64)]


def _merged(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows sorted and joined where they touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + n)[order]
    if not len(doc):
        return doc, start, start
    group = np.r_[0, np.cumsum(doc[1:] != doc[:-1])]
    # Ends grow along a document; a document's own offset keeps the maxima apart.
    base = group.astype(np.int64) * (int(end.max()) + 1)
    top = np.maximum.accumulate(end + base) - base
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])])
    last = np.r_[new[1:], len(doc)] - 1
    return doc[new], start[new], top[last] - start[new]


ROWS = ["at", "ah", "ch", "doc", "start", "n"]


def _batches(at, ah, ch, doc, start, n) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(doc), 100_000):
        cut = slice(low, low + 100_000)
        m = len(doc[cut])
        arrays = [pa.nulls(m, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x[cut]), pa.int64()) for x in (at, ah, ch, doc, start, n)]
        yield pa.RecordBatch.from_arrays(arrays, ROWS)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, text (binary) to contexts (ah set) and runs of repeated windows (ah null).

    Contexts that a task holds more than once are repeats but for the first.
    """
    from xxhash import xxh3_64_intdigest as digest

    held: list[tuple] = []
    size = 0

    def flush():
        if not held:
            return
        doc, start, n, ah, ch = (np.concatenate(c) for c in zip(*held))
        held.clear()
        key = ah * STEPS[2] ^ ch
        order = np.lexsort((start, doc, key))
        doc, start, n, ah, ch, key = (c[order] for c in (doc, start, n, ah, ch, key))
        new = np.r_[True, (ah[1:] != ah[:-1]) | (ch[1:] != ch[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = (doc != doc[first]) | (start != start[first])
        signed = ah.view(np.int64)[new]
        yield from _batches(signed, signed, ch.view(np.int64)[new], doc[new], start[new], n[new])
        d, s, m = _merged(doc[late], start[late], n[late])
        yield from _batches(_mix(d.view(np.uint64) ^ (s.view(np.uint64) << np.uint64(20))).view(np.int64), None, None, d, s, m)

    def piece(texts: list[tuple[int, int, bytes]]):
        nonlocal size
        raw = b"".join(t[2] for t in texts)
        ends = np.cumsum([len(t[2]) for t in texts])
        starts = np.r_[0, ends[:-1]]
        owner, first, n, ah = anchors(np.frombuffer(raw, np.uint8), starts, ends)
        if len(owner):
            ch = np.array([digest(raw[a:b]) for a, b in zip(first.tolist(), (first + n - 1 + SPAN).tolist())], np.uint64)
            docs = np.array([t[0] for t in texts], np.int64)
            before = np.array([t[1] for t in texts], np.int64)
            held.append((docs[owner], first - starts[owner] + before[owner], n, ah, ch))
            size += len(owner)

    texts: list[tuple[int, int, bytes]] = []
    total = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or b""
            doc = LEAST if doc is None else doc
            # A long text is taken in parts that share the bytes of windows between them.
            for low in range(0, max(1, len(text) - SPAN + 1), PIECE):
                part = text[low:low + PIECE + SPAN - 1]
                texts.append((doc, low, part))
                total += len(part)
                if total >= PIECE:
                    piece(texts)
                    texts, total = [], 0
            if size >= BUFFER:
                yield from flush()
                size = 0
    if texts:
        piece(texts)
    yield from flush()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ah, ch, doc, start: runs of repeats, and contexts to be sorted."""
    last = None  # the row before: ah, ch and the place of its context's first copy
    pending = None  # the only context so far of the anchor hash before
    for batch in batches:
        plain = batch.column(1).is_null().to_numpy(zero_copy_only=False)
        if plain.any():
            yield from _batches(None, None, None, *(batch.filter(pa.array(plain)).column(i).to_numpy() for i in (3, 4, 5)))
            batch = batch.filter(pa.array(~plain))
        if not batch.num_rows:
            continue
        ah, ch, doc, start, n = (batch.column(i).to_numpy() for i in range(1, 6))
        more = last is not None and last[0] == ah[0]
        new_ah = np.r_[not more, ah[1:] != ah[:-1]]
        new = new_ah | np.r_[not (more and last[1] == ch[0]), ch[1:] != ch[:-1]]
        at = np.flatnonzero(new)
        pick = np.cumsum(new) - 1
        fd, fs = np.r_[doc[at], last[2] if last else 0], np.r_[start[at], last[3] if last else 0]
        late = (doc != fd[pick]) | (start != fs[pick])
        yield from _batches(None, None, None, *_merged(doc[late], start[late], n[late]))
        group = np.cumsum(new_ah[at]) - (0 if more else 1)  # 0 goes on from the batch before, if ``more``
        if len(at):
            counts = np.bincount(group + (0 if more else 1))
            if more:
                counts[0] += 1  # the one or more contexts before
            several = counts[group + (0 if more else 1)] > 1
            if more and pending is not None and (group == 0).any():
                yield from _batches(None, *(np.array([v]) for v in pending))
                pending = None
            chosen = at[several]
            yield from _batches(None, ah[chosen], ch[chosen], doc[chosen], start[chosen], n[chosen])
            if new_ah.any():
                pending = None
                if not several[-1]:
                    k = at[-1]
                    pending = (ah[k], ch[k], doc[k], start[k], n[k])
        last = (ah[-1], ch[-1], fd[pick[-1]], fs[pick[-1]])


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """The places marked in ``wanted`` in the order of their suffixes' first ``depth`` bytes."""
    n = len(text)
    turn = np.flatnonzero(text[1:] != text[:-1])
    after = np.searchsorted(turn, np.arange(n))
    rises = np.zeros(n, bool)  # smaller than its successor; the end of the text is smallest
    known = after < len(turn)
    j = turn[after[known]]
    rises[known] = text[j] < text[j + 1]

    need = wanted.copy()
    # An induced suffix needs its successors up to the next one that is sorted directly.
    up = np.flatnonzero(rises)
    ends = np.flatnonzero(wanted & ~np.r_[wanted[1:], False] & ~rises)
    if len(ends):
        k = np.searchsorted(up, ends)
        stop = np.where(k < len(up), up[np.minimum(k, max(len(up) - 1, 0))] if len(up) else n - 1, n - 1)
        marks = np.zeros(n + 1, np.int32)
        np.add.at(marks, ends, 1)
        np.add.at(marks, stop + 1, -1)
        need |= np.cumsum(marks[:-1]) > 0

    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    direct = np.flatnonzero(need & rises)
    words = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct].copy().view(f"S{depth}").ravel()
    direct = direct[np.argsort(words, kind="stable")]
    del words
    heads = text[direct]
    bounds = np.searchsorted(heads, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n and need[n - 1] and not rises[n - 1]:
        waiting[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        found = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        parts = [found]
        while len(found):
            found = found[found > 0] - 1
            found = found[need[found] & (text[found] == c)]
            parts.append(found)
        parts.append(direct[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(parts)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[need[before] & (text[before] > c)]
        heads = text[before]
        order = np.argsort(heads, kind="stable")
        before, heads = before[order], heads[order]
        for one in np.split(before, np.flatnonzero(heads[1:] != heads[:-1]) + 1):
            if len(one):
                waiting[text[one[0]]].append(one)
    found = np.concatenate(out)
    return found[wanted[found]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Length, up to ``depth``, of the common prefix of each suffix and the one before."""
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    out = np.zeros(len(order), np.int64)
    for low in range(1, len(order), 50_000):
        cut = slice(low, low + 50_000)
        differ = rows[order[cut]] != rows[order[low - 1:low - 1 + len(order[cut])]]
        out[cut] = np.where(differ.any(1), differ.argmax(1), depth)
    return out


def _sorted_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts (ah, doc, start, n, bytes), sorted by ah, to runs of repeated windows."""
    held: list[tuple] = []
    size = 0

    def solve():
        data = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
        doc, start, n = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        base = np.r_[0, np.cumsum([len(h[4]) for h in held])[:-1]]
        wanted = np.zeros(len(data), bool)
        place = np.repeat(base, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wanted[place] = True
        order = suffix_order(data, wanted)
        same = common_prefixes(data, order) >= SPAN
        owner = np.searchsorted(base, order, "right") - 1
        d, s = doc[owner], start[owner] + order - base[owner]
        new = np.flatnonzero(~same)
        rank = np.empty(len(order), np.int64)
        by = np.lexsort((s, d))
        rank[by] = np.arange(len(order))
        least = by[np.minimum.reduceat(rank, new)] if len(new) else new
        first = least[np.cumsum(~same) - 1]
        late = (d != d[first]) | (s != s[first])
        yield from _batches(None, None, None, *_merged(d[late], s[late], np.ones(late.sum(), np.int64)))

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if held and size >= SORTED and row[0] != held[-1][0]:
                yield from solve()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield from solve()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, contexts of a document to one row per context with its bytes."""
    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        kinds = [*[pa.int64()] * 4, pa.binary(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["ah", "doc", "start", "n", "bytes", "hot"])

    for batch in batches:
        rows, size = [], 0
        for doc, text, contexts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = text.as_py() or b""
            for c in contexts.as_py():
                cut = text[c["start"]:c["start"] + c["n"] - 1 + SPAN]
                if len(cut) == c["n"] - 1 + SPAN:  # else another row has the same id
                    rows.append((c["ah"], LEAST if doc is None else doc, c["start"], c["n"], cut, c["hot"]))
                    size += len(cut)
            if size > 1 << 22:
                yield told(rows)
                rows, size = [], 0
        yield told(rows)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of a context one by one, as two hashes."""
    from xxhash import xxh3_128_intdigest as digest

    for batch in batches:
        for low in range(0, batch.num_rows, 2000):
            part = batch.slice(low, 2000)
            rows: list[list[int]] = [[], [], [], []]
            for doc, start, n, data in zip(*(part.column(i).to_pylist() for i in range(4))):
                for k in range(n):
                    h = digest(data[k:k + SPAN])
                    for column, value in zip(rows, ((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), doc, start + k)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["wa", "wb", "doc", "start"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and runs of repeated windows to the bytes that stay."""
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            kept, sizes, gone, spans = [], [], [], []
            for text, runs in zip(part.column(1), part.column(2)):
                text = text.as_py() or b""
                out, end, cut, many = [], 0, 0, 0
                for r in sorted((x["start"], x["start"] + x["n"] - 1 + SPAN) for x in (runs.as_py() or ())):
                    a, b = r[0], min(r[1], len(text))
                    if a >= b:
                        continue
                    if a > end or many == 0:
                        out.append(text[end:a])
                        many += 1
                        cut += b - a
                    elif b > end:
                        cut += b - end
                    end = max(end, b)
                out.append(text[end:])
                kept.append(b"".join(out))
                sizes.append(len(text))
                gone.append(cut)
                spans.append(many)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans))],
                ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc, start, n: runs of n windows, each of which also starts earlier; runs may overlap."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).cast("binary").alias("text"))
    fields = ", ".join(f"{c} long" for c in ROWS)
    found = rows.mapInArrow(_contexts, fields)
    found = found.repartition("at").sortWithinPartitions("ah", "ch", "doc", "start").mapInArrow(_compared, fields)
    found, _ = saved(found.drop("at"), "contexts")
    runs = found.where("ah is null").select("doc", "start", "n")
    edges = found.where("ah is not null").select("ah", "doc", "start", "n")
    many = edges.groupBy("ah").agg(F.count("*").alias("m")).where(F.col("m") > GROUP).select(F.col("ah").alias("many"))
    edges = edges.join(many, F.col("ah") == F.col("many"), "left")
    lists = edges.groupBy("doc").agg(F.collect_list(F.struct("ah", "start", "n", F.col("many").isNotNull().alias("hot"))).alias("contexts"))
    keyed = rows.withColumn("doc", F.coalesce("doc", F.lit(LEAST)))
    cut = keyed.join(lists, "doc").select("doc", "text", "contexts").mapInArrow(
        _cut, "ah long, doc long, start long, n long, bytes binary, hot boolean")
    cut, _ = saved(cut, "context-bytes")
    sorted_ = cut.where("not hot").select("ah", "doc", "start", "n", "bytes").repartition("ah").sortWithinPartitions("ah")
    late = sorted_.mapInArrow(_sorted_windows, fields).select("doc", "start", "n")
    windows = cut.where("hot").select("doc", "start", "n", "bytes").mapInArrow(_windows, "wa long, wb long, doc long, start long")
    least = windows.groupBy("wa", "wb").agg(F.min(F.struct("doc", "start")).alias("first"))
    spread = windows.join(least, ["wa", "wb"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return runs.unionByName(late).unionByName(spread.select("doc", "start", F.lit(1).cast("long").alias("n")))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kept (bytes that stay), n_bytes, n_removed, n_spans of every document."""
    runs = repeats(docs, text, doc_id).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    own = F.col(doc_id).cast("long")
    full = docs.select(own.alias("doc_id"), F.col(text).cast("binary").alias("text"), F.coalesce(own, F.lit(LEAST)).alias("doc"))
    return full.join(runs, "doc", "left").select("doc_id", "text", "runs").mapInArrow(
        _removed, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
