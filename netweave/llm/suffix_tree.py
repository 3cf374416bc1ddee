"""Scoring texts by a probabilistic suffix tree over words.

Words are compared by 64 bits of hash. States of the tree are contexts of 1 to ``DEPTH`` words (the begin of
a text counts as one) that occur ``LEAST`` times or more in the texts to learn from. A context is retained
where its next words diverge from those of the context without its oldest word: the sum over its next words of
n * ln(share here / share there) must reach half of ln(N) for each different next word, as one parameter costs.

A word's probability starts from (c + 1) / (N + V + 1) and is carried through the retained ones among the contexts
that end before it, shortest first: p becomes (n + T * p) / (n of the context + T), T the number of
different words after it (Witten and Bell's smoothing). The longest retained suffix has the last
word. The shares of all words, and of one unknown, add up to one in every state.

How it runs: texts become *blocks* of about ``BLOCK`` words, written once as codes into the block's own word list. In
each round a block asks for the counts of its distinct n-grams, once each, sorted and packed, dealt to
*shards* by hash, so a frequent n-gram costs a row per block at most and no context
is gathered in one place. A shard adds up what all blocks have and answers each in its order. Longer n-grams are
asked for only behind contexts known to occur often enough. A flag in the answer makes one block the owner
of an n-gram, so that divergences are summed over blocks like counts. Tables of all rounds
grow with the corpus; blocks and shards don't, and nothing but totals reaches the driver.

Defined cases: a null or empty text is its end alone; a null id is told as empty text; repeated rows are learned from and
scored one by one; without texts to learn from all scores are 0; an empty table gives an empty result; only the columns
named are read, and the result has a row per row with its id.
"""

from __future__ import annotations

import struct
import sys
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved, sweep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, LEAST = 2, 8
BLOCK, SHARD, TEXTS = 1 << 20, 1 << 20, 1 << 22
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

BLOCKS = "block long, ids array<long>, sizes array<int>, learn array<boolean>, words binary, codes binary, tokens long, trained long"
ASKED = "block long, shard long, keys binary, first binary, second binary, extra long"
TOLD = "block long, shard long, reply binary, round int, extra long"
SCORED = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"


# --- packed arrays and hashes ----------------------------------------------------

def _pack(values: np.ndarray) -> bytes:
    """An array as planes of its bytes, compressed; small numbers and close ones take little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return struct.pack("<q", len(values)) + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def _unpack(packed: bytes, kind) -> np.ndarray:
    n, width = struct.unpack_from("<q", packed)[0], np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(packed[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed, np.uint64), dtype=np.uint64)


def _mix(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from that of its first words and of its last."""
    with np.errstate(over="ignore"):
        x = before * np.uint64(0xFF51AFD7ED558CCD) + (word ^ (before >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, object), categorize=False).astype(np.uint64) if words else np.empty(0, np.uint64)


# --- texts to blocks ---------------------------------------------------------------

def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, A-Z in lower case, and each text's number of words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, owner = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(texts))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, number = TaskContext.get().partitionId(), 0
    ids, learn, counts, words, held = [], [], [], [], 0

    def told() -> pa.RecordBatch:
        coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
        sizes = np.concatenate(counts).astype(np.int64) + 2  # with begin and end
        codes = np.full(int(sizes.sum()), 2, np.int32)
        ends = np.cumsum(sizes)
        codes[ends - sizes], codes[ends - 1] = 1, 0
        inner = np.ones(len(codes), bool)
        inner[ends - sizes] = inner[ends - 1] = False
        codes[inner] = coded.indices.to_numpy() + 2
        hashes = np.r_[END, BEGIN, word_hashes(coded.dictionary.to_pylist())].astype(np.uint64)
        taught = np.concatenate(learn)
        row = [(part << 32) + number, np.concatenate(ids).tolist(), sizes.tolist(), taught.tolist(), _pack(hashes), _pack(codes),
               int(sizes.sum()), int((sizes - 1)[taught].sum())]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        names = ["block", "ids", "sizes", "learn", "words", "codes", "tokens", "trained"]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        weigh = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
        low, upto = 0, np.cumsum(weigh, dtype=np.int64)
        while low < batch.num_rows:
            before = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, before + TEXTS, "right")))
            piece = batch.slice(low, high - low)
            found, n = split_words(piece.column(2))
            ids.append(np.array(piece.column(0).to_pylist(), object))
            learn.append(piece.column(1).to_numpy(zero_copy_only=False).astype(bool))
            counts.append(n)
            words.append(found)
            held += int(n.sum()) + 2 * len(n)
            low = high
            if held >= BLOCK:
                yield told()
                number += 1
                ids, learn, counts, words, held = [], [], [], [], 0
    if held:
        yield told()


class _Block:
    """The n-grams of one block, position by position, and what the rounds so far have told."""

    def __init__(self, row: pa.Table):
        one = {c: row.column(c)[0] for c in row.schema.names}
        self.number, self.ids = one["block"].as_py(), one["ids"].as_py()
        self.sizes = np.array(one["sizes"].values.to_numpy(), np.int64)
        self.learn = one["learn"].values.to_numpy(zero_copy_only=False).astype(bool)
        words = _unpack(one["words"].as_py(), np.uint64)[_unpack(one["codes"].as_py(), np.int32)]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.age = np.arange(len(words), dtype=np.int32) - np.repeat(self.starts.astype(np.int32), self.sizes)
        self.taught = np.repeat(self.learn, self.sizes)
        self.grams = [words]
        self.counts: list[np.ndarray] = []
        self.owned: list[np.ndarray] = []

    def gram(self, k: int) -> np.ndarray:
        """Hash of the n-gram of k + 1 words that ends at each position."""
        while len(self.grams) <= k:
            last = self.grams[-1]
            self.grams.append(_mix(np.r_[last[:1], last[:-1]], self.grams[0]))
        return self.grams[k]

    def asked(self, k: int, least: int) -> np.ndarray:
        """Positions whose n-gram of k + 1 words is asked for: behind k words that occur often."""
        if k == 0:
            return np.ones(len(self.age), bool)
        often = self.age >= k
        if k > 1:
            often[1:] &= self.counts[k - 1][:-1] >= least
        return often

    def request(self, levels: list[int], least: int):
        """Sorted distinct keys of some levels; where they stand; each position's place among the keys."""
        where = [np.flatnonzero(self.asked(k, least)) for k in levels]
        keys = np.concatenate([self.gram(k)[at] for k, at in zip(levels, where)])
        unique, place = np.unique(keys, return_inverse=True)
        return unique, where, place

    def learned(self, levels: list[int], reply: np.ndarray, least: int) -> None:
        _, where, place = self.request(levels, least)
        told, low = reply[place], 0
        for at in where:
            mine = told[low:low + len(at)]
            low += len(at)
            counts, owned = np.zeros(len(self.age), np.int64), np.zeros(len(self.age), bool)
            counts[at], owned[at] = mine >> 1, (mine & 1) == 1
            self.counts.append(counts)
            self.owned.append(owned)

    def behind(self, k: int) -> np.ndarray:
        """Per position how often its context of k words occurs; 0 where there is none."""
        out = np.zeros(len(self.age), np.int64)
        out[1:] = self.counts[k - 1][:-1]
        out[self.age < k] = 0
        return out

    def context(self, k: int) -> np.ndarray:
        before = self.gram(k - 1)
        return np.r_[before[:1], before[:-1]]

    def contexts(self, depth: int, least: int):
        """Sorted distinct contexts that occur often, and positions and places as in ``request``."""
        where = [np.flatnonzero(self.behind(k) >= least) for k in range(1, depth + 1)]
        keys = np.concatenate([self.context(k)[at] for k, at in zip(range(1, depth + 1), where)])
        unique, place = np.unique(keys, return_inverse=True)
        return unique, where, place


def _dealt(number: int, shards: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None, extra: int) -> pa.Table:
    """Sorted keys and their values, a row per shard that has any."""
    shard = ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)
    cuts = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    some = np.flatnonzero(np.diff(cuts))
    pieces = [slice(cuts[s], cuts[s + 1]) for s in some]
    n = len(some)
    return pa.Table.from_arrays([
        pa.array([number] * n, pa.int64()), pa.array(some, pa.int64()), pa.array([_pack_keys(keys[p]) for p in pieces], pa.binary()),
        pa.array([_pack(first[p]) for p in pieces], pa.binary()),
        pa.array([None if second is None else _pack(second[p]) for p in pieces], pa.binary()),
        pa.array([extra] * min(n, 1) + [0] * max(n - 1, 0), pa.int64()),
    ], ["block", "shard", "keys", "first", "second", "extra"])


def _replies(told: pa.Table) -> dict[int, np.ndarray]:
    """Per round the answers of all shards in order."""
    rows = sorted(zip(told.column("round").to_pylist(), told.column("shard").to_pylist(), told.column("reply").to_pylist()))
    out: dict[int, list] = {}
    for number, _, reply in rows:
        out.setdefault(number, []).append(_unpack(reply, np.int64))
    return {number: np.concatenate(parts) for number, parts in out.items()}


def _informed(row: pa.Table, told: pa.Table, rounds: list[list[int]], least: int) -> tuple[_Block, dict[int, np.ndarray]]:
    block, replies = _Block(row), _replies(told)
    for i, levels in enumerate(rounds):
        block.learned(levels, replies.get(i, np.empty(0, np.int64)), least)
    return block, replies


def _ask_counts(rounds: list[list[int]], shards: int, least: int):
    """The request of the last of ``rounds``, the earlier ones being told."""
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        block, _ = _informed(row, told, rounds[:-1], least)
        keys, where, place = block.request(rounds[-1], least)
        taught = np.concatenate([block.taught[at] for at in where])
        counts = np.bincount(place[taught], minlength=len(keys)).astype(np.uint32)
        return _dealt(block.number, shards, keys, counts, None, 0)
    return run


def _ask_contexts(rounds: list[list[int]], shards: int, depth: int, least: int, total: int):
    """Each context's different next words and divergence, as far as this block owns the n-grams."""
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        block, _ = _informed(row, told, rounds, least)
        keys, where, place = block.contexts(depth, least)
        kinds, apart, low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.float32), 0
        for k, at in zip(range(1, depth + 1), where):
            mine = place[low:low + len(at)]
            low += len(at)
            first = np.unique(np.where(block.owned[k][at] & (block.counts[k][at] > 0), block.gram(k)[at], np.uint64(0)), return_index=True)
            one = first[1][first[0] != 0]
            i = at[one]
            n, all_n = block.counts[k][i], block.behind(k)[i]
            base_n, base_all = block.counts[k - 1][i], block.behind(k - 1)[i] if k > 1 else total
            with np.errstate(divide="ignore"):
                gain = n * np.log((n / all_n) / (base_n / base_all))
            kinds += np.bincount(mine[one], minlength=len(keys))
            apart += np.bincount(mine[one], weights=gain, minlength=len(keys)).astype(np.float32)
        words = np.unique(block.grams[0][block.owned[0] & (block.counts[0] > 0) & (block.age > 0)])
        return _dealt(block.number, shards, keys, kinds.astype(np.uint32), apart, len(words))
    return run


def _merged(number: int, total: int | None):
    """A shard's answers: counts and owners, or (with ``total``) the next words of retained contexts."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
        first = np.concatenate([_unpack(v, np.uint32) for v in table.column("first").to_pylist()]).astype(np.float64)
        cuts = np.cumsum([len(p) for p in parts])
        unique, place = np.unique(np.concatenate(parts), return_inverse=True)
        sums = np.bincount(place, weights=first, minlength=len(unique)).astype(np.int64)
        if total is None:
            reply = sums[place] << 1
            having = np.flatnonzero(first > 0)
            reply[having[np.unique(place[having], return_index=True)[1]]] |= 1
        else:
            second = np.concatenate([_unpack(v, np.float32) for v in table.column("second").to_pylist()])
            apart = np.bincount(place, weights=second, minlength=len(unique))
            reply = np.where(apart >= 0.5 * np.log(max(total, 1)) * sums, sums, 0)[place]
        blobs = [_pack(r) for r in np.split(reply, cuts[:-1])]
        return pa.Table.from_arrays([
            table.column("block"), table.column("shard"), pa.array(blobs, pa.binary()), pa.array([number] * len(blobs), pa.int32()),
            table.column("extra"),
        ], ["block", "shard", "reply", "round", "extra"])
    return run


def _scores(rounds: list[list[int]], depth: int, least: int, total: int, kinds: int):
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        block, replies = _informed(row, told, rounds, least)
        _, where, place = block.contexts(depth, least)
        states = replies.get(len(rounds), np.empty(0, np.int64))[place]
        p = (block.counts[0] + 1.0) / (total + kinds + 1)
        spoken = block.age > 0
        base = np.where(spoken, np.log10(p), 0.0)
        low = 0
        for k, at in zip(range(1, depth + 1), where):
            t = states[low:low + len(at)]
            low += len(at)
            at, t = at[t > 0], t[t > 0]
            p[at] = (block.counts[k][at] + t * p[at]) / (block.behind(k)[at] + t)
        score = np.where(spoken, np.log10(p), 0.0)
        at = block.starts
        return pa.Table.from_arrays([
            pa.array(block.ids, pa.int64()), pa.array(block.learn), pa.array(block.sizes - 1),
            pa.array(np.add.reduceat((spoken & (block.counts[0] > 0)).astype(np.int64), at)),
            pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(score, at)),
        ], ["doc_id", "learned", "n_tokens", "n_known", "base_score", "score"])
    return run


def _clear(spark) -> None:
    """Let shuffle files that are done with go; what one collection frees holds on to what the next one does."""
    for _ in range(2):
        sweep(spark)
        time.sleep(1)


def score_texts(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id",
                depth: int = DEPTH, least: int = LEAST) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, base_score, score and train_tokens of every row.

    The model learns from the rows where ``learn`` holds. Scores are base-10 logarithms.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    blocks, _ = saved(rows.mapInArrow(_blocks, BLOCKS), "blocks")
    tokens, total = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    shards = max(1, -(-tokens // SHARD))
    told = spark.createDataFrame([], TOLD)

    def together(run, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)

    rounds: list[list[int]] = []
    for levels in [[0, 1], *([k] for k in range(2, depth + 1))]:
        rounds = [*rounds, levels]
        asked = together(_ask_counts(rounds, shards, least), ASKED)
        answers, _ = saved(asked.groupBy("shard").applyInArrow(_merged(len(rounds) - 1, None), TOLD), "answers")
        told = told.unionByName(answers)
        del asked  # its shuffle files go with it
        _clear(spark)
    asked = together(_ask_contexts(rounds, shards, depth, least, total), ASKED)
    answers, _ = saved(asked.groupBy("shard").applyInArrow(_merged(len(rounds), total), TOLD), "answers")
    kinds = answers.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0]
    told = told.unionByName(answers)
    del asked
    _clear(spark)
    return together(_scores(rounds, depth, least, total, kinds), SCORED).withColumn("train_tokens", F.lit(total).cast("long"))
