"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text.

Text is read as words (runs of letters and digits, single other characters, single characters
of scripts written without blanks), compared by 64 bits of hash, nothing folded. Word n-grams
of order ``WORDS`` are counted over all trusted documents but every fifth (by hash of the id),
so the model grows with the corpus. A word's share below the lowest order is its spelling: a
second model of order ``LETTERS`` over the code points of the distinct trusted words, which
ends in the same share for every code point.

How it runs: texts are taken apart once, into *blocks* of about ``BLOCK`` words, written as codes into the
block's own word list, blocks to learn from apart from the others. Blocks ask for what they need of their distinct
triples, pairs and words, sorted and packed, dealt to *shards* by hash: a frequent n-gram costs a row per block
at most and no context is gathered in one place. Blocks to learn from give their counts with it; a shard adds them
up, answers everyone in order, and tells one block that it is the first to have an n-gram, so that the sums of
contexts and the different symbols that an n-gram follows are added up over blocks in the next round. Triples and pairs
are asked for in ``WAVES`` of shards, so that the requests of one wave are on disk at a time; words are asked for by
``PARTS`` of the blocks, which are scored at once. Letter n-grams are
counted by Spark's own aggregates and asked for by shards of the distinct words. Nothing is collected but
the counts of counts that give the discounts.

A document's perplexity is per character of its words, plus one for each word's end. The
held-out fifth gives the thresholds: per language, the ``QUANTILE`` of its perplexities,
from a histogram of their logarithms, times ``SLACK``. A language with fewer than
``LEAST`` held-out documents uses the threshold of all languages together.

``fit`` and ``score`` are a smaller model over ``CLASSES`` character classes, bounded by
``CLASSES ** ORDER`` entries and broadcast; no registered query uses it.

Defined cases: a text without words (null, empty, single blanks) has no perplexity and is kept;
a null language is a language of its own; labels that are null, or that differ for one id, make
no document trusted; without trusted documents nothing is rejected; repeated rows are judged
alike; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
import re
import struct
import sys
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from netweave.llm.common import discard, saved, sweep
from netweave.llm.suffix_tree import _pack, _pack_keys, _unpack, _unpack_keys
from netweave.session import work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER, CLASSES, BITS = 4, 64, 6
QUANTILE, SLACK, LEAST = 0.995, 1.1, 30
WORDS, LETTERS, POINTS = 3, 5, 0x110001
FINE = 500
RUN = 1 << 22
# Words of a block, n-grams of a shard at least, waves of triples and pairs, parts in which texts meet their labels.
BLOCK, SHARD, WAVES, HALVES = 1 << 20, 1 << 20, 6, 2
# Parts of the blocks that are told of their words and scored one after the other.
PARTS = 8

# Scripts without blanks between words; longer words are cut so that no share underflows.
ALONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"[{ALONE}]|(?:(?![{ALONE}])\\w){{1,32}}|[^\\w ]| {{2,32}}")
START, STOP = "\ufdd0", "\ufdd1"
LONGEST = 32

CODED_NAMES = ["block", "rows", "sizes", "words", "codes", "tokens", "learn"]
CODED = "block long, rows array<long>, sizes binary, words binary, codes binary, tokens long, learn boolean"
LEXICON = "shard long, words binary, learn binary"
GIVEN, ANSWER = "shard long, who long, keys binary, given binary", "who long, shard long, reply binary, few array<long>, gave boolean"
LETTER_NAMES = [f"c{i}" for i in range(1, LETTERS + 1)]


def character_classes() -> np.ndarray:
    """Class of every code point below the table's length; the last entry is for all others."""
    table = np.full(0x2000, 63, np.int32)
    for cp in range(0xC0, 0x2000):
        one = chr(cp)
        table[cp] = 27 if one.isupper() else 54 if one.isalpha() else 28 if one.isdigit() else 63
    for i in range(26):
        table[ord("a") + i], table[ord("A") + i] = 1 + i, 27
    for i, one in enumerate("àáâäçèéêëìíîïñòóôöùúûüß"):
        table[ord(one)] = 31 + i
    for several, k in (("0123456789", 28), (" ", 29), ("\t\n\x0b\x0c\r", 30), (".", 55), (",", 56), ("!?", 57), ("'\"", 58),
                       ("()[]{}", 59), ("-", 60), ("#*$%&|<>", 61), ("+/=_@:;\\^`~", 62)):
        for one in several:
            table[ord(one)] = k
    return table


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams ending at each character of all texts, and where each text's begin."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.cumsum(sizes) - sizes
    gap = ORDER - 1  # each text follows as many blanks as an n-gram looks back
    at = np.arange(len(points)) + np.repeat(gap * np.arange(1, len(texts) + 1), sizes)
    line = np.zeros(len(points) + gap * len(texts), np.int32)
    line[at] = table[np.minimum(points, len(table) - 1)]
    out = np.zeros(len(at), np.int32)
    for k in range(ORDER):
        out = (out << BITS) | line[at - gap + k]
    return out, starts


def _runs(texts: pa.Array, run: int = RUN) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of about ``run`` characters, with the place of the first."""
    low, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= run:
            yield low, held
            low, held, size = i + 1, [], 0
    if held:
        yield low, held


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, known = character_classes(), {}

    def told():
        return pa.RecordBatch.from_arrays([pa.array(list(known), pa.int64()), pa.array(list(known.values()), pa.int64())], ["gram", "n"])

    for batch in batches:
        for _, texts in _runs(batch.column(0)):
            g, n = np.unique(grams(texts, table)[0], return_counts=True)
            for k, v in zip(g.tolist(), n.tolist()):
                known[k] = known.get(k, 0) + v
            if len(known) > 1 << 20:
                yield told()
                known.clear()
    yield told()


class Model:
    """Tables of an n-gram model: ``seen`` (level, gram, p) and ``back`` (level, context, weight)."""

    def __init__(self, seen: np.ndarray, back: np.ndarray):
        self.seen, self.back = seen, back

    def logs(self) -> np.ndarray:
        """Logarithm of the probability of every n-gram of the full order."""
        p = np.full(1, 1.0 / CLASSES, np.float32)
        for k in range(1, ORDER + 1):
            p = np.tile(p if k > 1 else np.full(CLASSES, p[0], np.float32), CLASSES if k > 1 else 1)
            weight = np.ones(CLASSES ** (k - 1), np.float32)
            mine = self.back["level"] == k
            weight[self.back["context"][mine]] = self.back["weight"][mine]
            p = (p.reshape(-1, CLASSES) * weight[:, None]).ravel()
            mine = self.seen["level"] == k
            p[self.seen["gram"][mine]] = self.seen["p"][mine]
        return np.log(p)


def fit(texts: DataFrame) -> Model:
    """The model of a frame with the column ``text``; counts stay in Spark."""
    counts = texts.select("text").mapInArrow(_counted, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    levels = {ORDER: saved(counts, "grams")[0]}
    for k in range(ORDER - 1, 0, -1):
        cut = F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")
        levels[k] = levels[k + 1].select(cut).groupBy("gram").agg(F.count("*").alias("n"))
    seen = back = lower = None
    for k in range(1, ORDER + 1):
        few = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
        of = [max(1, v or 0) for v in levels[k].agg(*few).first()]
        y = of[0] / (of[0] + 2 * of[1])
        off = [min(max(i + 1 - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 1.0) for i in range(3)]
        taken = F.when(F.col("n") == 1, off[0]).when(F.col("n") == 2, off[1]).otherwise(off[2])
        rows = levels[k].select("gram", "n", taken.alias("off"), F.shiftright("gram", BITS).alias("context"))
        sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("off").alias("free"))
        sums = sums.select("context", "total", (F.col("free") / F.col("total")).alias("weight"))
        rows = rows.join(sums, "context")
        if lower is None:
            below = F.lit(1.0 / CLASSES)
        else:
            rows = rows.withColumn("end", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1))
            rows = rows.join(lower.select(F.col("gram").alias("end"), F.col("p").alias("below")), "end")
            below = F.col("below")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * below
        rows = rows.select(F.lit(k).alias("level"), "gram", p.alias("p"))
        lower, _ = saved(rows.coalesce(16), "probabilities")
        weights = sums.select(F.lit(k).alias("level"), "context", "weight")
        seen = lower if seen is None else seen.unionByName(lower)
        back = weights if back is None else back.unionByName(weights)
    # Both tables are bounded by the number of classes, not by the corpus.
    got = [df.toArrow() for df in (seen, back)]
    kinds = [[("level", np.int8), ("gram", np.int32), ("p", np.float32)], [("level", np.int8), ("context", np.int32), ("weight", np.float32)]]
    out = []
    for table, kind in zip(got, kinds):
        one = np.empty(table.num_rows, kind)
        for name, _ in kind:
            one[name] = table.column(name).to_numpy()
        out.append(one)
    return Model(*out)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with _kn_log, the logarithm of the text's perplexity (null without characters)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.seen, model.back))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs = character_classes(), None
        for batch in batches:
            if logs is None:
                logs = Model(*shared.value).logs()
            for low, texts in _runs(batch.column(place)):
                g, starts = grams(texts, table)
                sizes = np.array([len(t) for t in texts])
                sums = np.r_[0.0, np.cumsum(logs[g], dtype=np.float64)]
                with np.errstate(all="ignore"):
                    value = -(sums[starts + sizes] - sums[starts]) / sizes
                part = batch.slice(low, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(value, pa.float64(), mask=sizes == 0)], [*part.schema.names, "_kn_log"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("_kn_log", DoubleType())]))


def thresholds(held: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, least: int = LEAST) -> DataFrame:
    """lang, log_limit; the row with ``common`` set holds for all other languages.

    Logarithms are counted in steps of 1/``FINE``, so that a language's documents never
    meet in one place.
    """
    step = F.floor(F.col("_kn_log") * FINE).cast("long")
    steps = held.where("_kn_log is not null").groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"))

    def limits(rows: DataFrame, *by: str) -> DataFrame:
        whole = Window.partitionBy(*by)
        up = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = rows.select(*by, "step", F.sum("n").over(up).alias("upto"), F.sum("n").over(whole).alias("n"))
        top = F.min(F.when(F.col("upto") >= quantile * F.col("n"), F.col("step")))
        return ranked.groupBy(*by).agg(((top + 1) / FINE + math.log(slack)).alias("log_limit"), F.max("n").alias("n"))

    each = limits(steps, "lang").where(F.col("n") >= least).select("lang", "log_limit", F.lit(False).alias("common"))
    joint = steps.groupBy("step").agg(F.sum("n").alias("n")).withColumn("all", F.lit(1))
    none = F.lit(None).cast("string").alias("lang")
    return each.unionByName(limits(joint, "all").select(none, "log_limit", F.lit(True).alias("common")))


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents whose labels all call them good."""
    return labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("good")).where("good >= 1").select("doc_id")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of every code point (0 single, 1 of a word, 2 blank), its random number, and that of every place in a word."""
    kind = np.zeros(0x110000, np.uint8)
    # No letter or digit lies beyond plane 3.
    kind[:0x40000] = np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x40000)), np.uint8, 0x40000)
    for low, high in re.findall("(.)-(.)", ALONE):
        kind[ord(low):ord(high) + 1] = 0
    kind[32] = 2
    return kind, _numbers(0x110000), _places()


def _numbers(many: int) -> np.ndarray:
    """The random numbers of the first code points; those of fewer are the begin of those of more."""
    return np.random.PCG64(1).random_raw(many)


def _places() -> np.ndarray:
    return np.random.PCG64(2).random_raw(LONGEST) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def words_of(texts: list[str], tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What ``WORD`` finds in the texts: the text of each word, its first place in their concatenation, length and id."""
    kind, numbers, places = tables
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    starts = np.cumsum(lengths) - lengths
    kinds = kind[points]
    fresh = np.ones(len(points), bool)
    fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 0)
    fresh[starts[lengths > 0]] = True
    at = np.arange(len(points), dtype=np.int64)
    place = (at - np.maximum.accumulate(np.where(fresh, at, 0))) & (LONGEST - 1)
    first = np.flatnonzero(place == 0)
    size = np.diff(np.r_[first, len(points)])
    ids = _mixed(np.add.reduceat(numbers[points] * places[place], first) + size.astype(np.uint64))
    ids[ids == 0] = 1
    word = (kinds[first] != 2) | (size > 1)
    first, size, ids = first[word], size[word], ids[word]
    return np.searchsorted(starts, first, "right") - 1, first, size, ids


def _hashes(words: pa.StringArray, tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, as ``words_of`` gives them, and their lengths; without tables as many numbers are drawn as the words need."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1]
    line = data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes().decode()
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    numbers, places = tables[1:] if tables else (_numbers(int(points.max()) + 1), _places())
    first = np.cumsum(size) - size
    place = np.arange(len(points)) - np.repeat(first, size)
    ids = _mixed(np.add.reduceat(numbers[points] * places[place], first) + size.astype(np.uint64))
    ids[ids == 0] = 1
    return ids, size


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, where one of each stands, and each value's place among them."""
    order = np.argsort(x)
    ordered = x[order]
    fresh = np.ones(len(x), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ordered[fresh], order[fresh], place


def _coding(half: int):
    """row, learn, text to blocks of about ``BLOCK`` words, those to learn from apart from the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, number, part = _tables(), 0, TaskContext.get().partitionId()
        # By flag: rows, words per text, words' ids, first places and sizes, the text, and how many words and characters.
        held = {flag: ([], [], [], [], [], [], [0, 0]) for flag in (False, True)}

        def told(flag: bool) -> pa.RecordBatch:
            nonlocal number
            rows, sizes, ids, first, size, lines, _ = held[flag]
            held[flag] = ([], [], [], [], [], [], [0, 0])
            _, where, codes = _distinct(np.concatenate(ids))
            first, size, line = np.concatenate(first)[where], np.concatenate(size)[where], "".join(lines)
            words = pa.array([line[a:b] for a, b in zip(first.tolist(), (first + size).tolist())], pa.string())
            # The words found most often get the smallest codes, which pack best; words found as often stand in their order.
            n, spelt = np.bincount(codes, minlength=len(words)), pc.sort_indices(words).to_numpy()
            often = spelt[np.argsort(-n[spelt], kind="stable")]
            rank = np.empty(len(words), np.int32)
            rank[often] = np.arange(len(words), dtype=np.int32)
            row = [(half << 56) + (part << 32) + number, np.concatenate(rows).tolist(), _pack(np.concatenate(sizes).astype(np.int32)),
                   _pack_words(words.take(pa.array(often))), _pack(rank[codes]), len(codes), flag]
            number += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], CODED_NAMES)

        for batch in batches:
            learns = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for flag in (False, True):
                mine = batch.filter(pa.array(learns == flag))
                keys = mine.column(0).to_numpy(zero_copy_only=False)
                for low, texts in _runs(mine.column(2), 1 << 20):
                    of, first, size, ids = words_of(texts, tables)
                    so_far = held[flag][6]
                    n = np.bincount(of, minlength=len(texts))
                    for into, new in zip(held[flag], (keys[low:low + len(texts)][n > 0], n[n > 0], ids, first + so_far[1], size, "".join(texts))):
                        into.append(new)
                    so_far[0] += len(ids)
                    so_far[1] += len(held[flag][5][-1])
                    if so_far[0] >= BLOCK:
                        yield told(flag)
        for flag in (False, True):
            if held[flag][6][0]:
                yield told(flag)

    return run


def _pack_words(words: pa.StringArray) -> bytes:
    """Words as their sizes and their text, compressed."""
    offsets, data = words.buffers()[1:]
    offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1]
    n = int(offsets[-1] - offsets[0])
    sizes = _pack(np.diff(offsets).astype(np.uint8))  # a word has at most 32 code points
    return struct.pack("<qq", len(sizes), n) + sizes + pa.compress(data.slice(int(offsets[0]), n), "zstd", asbytes=True)


def _unpack_words(packed: bytes) -> pa.StringArray:
    k, n = struct.unpack_from("<qq", packed)
    offsets = np.cumsum(np.r_[0, _unpack(packed[16:16 + k], np.uint8)], dtype=np.int32)
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(pa.decompress(packed[16 + k:], n, "zstd", asbytes=True)))


def _pack_rows(rows: np.ndarray) -> bytes:
    """Unsigned numbers of a few columns: most rows are alike, so that each is one code of a list of distinct rows."""
    large = (rows > 255).any(axis=0)
    key = np.zeros(rows.shape[1], np.uint64)
    for c in rows:
        key = (key << np.uint64(8)) | c.astype(np.uint64)
    key[large] = ~np.uint64(0)
    kinds, codes, n = np.unique(key, return_inverse=True, return_counts=True)
    often = np.argsort(-n, kind="stable")
    rank = np.empty(len(kinds), np.uint32)
    rank[often] = np.arange(len(kinds), dtype=np.uint32)
    parts = [_pack(kinds[often]), _pack(rank[codes]), _pack(rows[:, large].astype(np.uint32).ravel())]
    return struct.pack("<qq", *map(len, parts[:2])) + b"".join(parts)


def _unpack_rows(packed: bytes, columns: int) -> np.ndarray:
    a, b = struct.unpack_from("<qq", packed)
    kinds, codes = _unpack(packed[16:16 + a], np.uint64), _unpack(packed[16 + a:16 + a + b], np.uint32)
    each = np.stack([(kinds >> np.uint64(8 * k)) & np.uint64(255) for k in reversed(range(columns))]).astype(np.uint32)
    rows = each[:, codes]
    rows[:, (kinds == ~np.uint64(0))[codes]] = _unpack(packed[16 + a + b:], np.uint32).reshape(columns, -1)
    return rows


class _Coded:
    """A block: its words' ids and, position by position, the codes and keys of words, pairs and triples."""

    def __init__(self, table, i: int):
        self.row = {c: table.column(c)[i] for c in table.schema.names}
        self.block, self.learn = self.row["block"].as_py(), self.row["learn"].as_py()
        self.words = _unpack_words(self.row["words"].as_py())
        ids, self.lengths = _hashes(self.words)
        self.ids = np.r_[ids, np.uint64(0)]  # what stands before a text

    @cached_property
    def codes(self) -> np.ndarray:
        return _unpack(self.row["codes"].as_py(), np.int32)

    @cached_property
    def starts(self) -> np.ndarray:
        sizes = _unpack(self.row["sizes"].as_py(), np.int32).astype(np.int64)
        return np.cumsum(sizes) - sizes

    @cached_property
    def pair(self) -> np.ndarray:
        return _mixed(self.behind(_mixed(self.ids)[self.codes], 0) + self.ids[self.codes])

    @cached_property
    def context(self) -> np.ndarray:
        return self.behind(self.pair, 0)

    @cached_property
    def triple(self) -> np.ndarray:
        return _mixed(self.context + self.ids[self.codes])

    def behind(self, values: np.ndarray, start) -> np.ndarray:
        """Each position's value of the position before it in its text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.starts] = start
        return out


def _blocks(batches: Iterator) -> Iterator[_Coded]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Coded(batch, i)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)


def _among(keys: np.ndarray, shards: int, some: tuple[int, int]) -> np.ndarray:
    """Of the keys those of some of the shards."""
    shard = _shard(keys, shards)
    return keys[(shard >= some[0]) & (shard < some[1])]


def _dealt(who: int, shards: int, some: tuple[int, int], keys: np.ndarray, values: list[np.ndarray] | None = None):
    """Sorted keys and values, a row per shard; without values they are only asked for."""
    cuts = np.searchsorted(_shard(keys, shards), np.arange(some[0], some[1] + 1, dtype=np.uint64))
    pieces = [(some[0] + i, slice(cuts[i], cuts[i + 1])) for i in np.flatnonzero(np.diff(cuts)).tolist()]
    return pa.RecordBatch.from_arrays([
        pa.array([s for s, _ in pieces], pa.int64()), pa.array([who] * len(pieces), pa.int64()),
        pa.array([_pack_keys(keys[p]) for _, p in pieces], pa.binary()),
        pa.array([None if values is None else _pack(np.concatenate([v[p] for v in values])) for _, p in pieces], pa.binary()),
    ], ["shard", "who", "keys", "given"])


def _sums(keys: list[np.ndarray], given: list[np.ndarray], first: int | None = None):
    """Distinct keys, the sums of what is given for them, and which of all keys is the first of its kind with a value in column ``first``."""
    every, columns = np.concatenate(keys), np.concatenate(given, axis=1)
    order = np.argsort(every, kind="stable")
    ordered = every[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(fresh)
    if not len(at):
        return every, columns, np.zeros(0, bool)
    owned = np.zeros(len(every), bool)
    if first is not None:
        some = np.flatnonzero(columns[first][order] > 0)
        kind = np.cumsum(fresh)[some]
        mine = np.ones(len(some), bool)
        mine[1:] = kind[1:] != kind[:-1]
        owned[order[some[mine]]] = True
    return ordered[at], np.add.reduceat(columns[:, order], at, axis=1), owned


def _found(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """What the sorted table has for sorted keys; 0 where it has none."""
    if not len(table):
        return np.zeros((len(values), len(keys)), values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[:, at], values.dtype.type(0))


def _few(n: np.ndarray) -> list[int]:
    """How many are 1, 2, 3 and 4, how many at least 3, and their sum."""
    return [*(int((n == i).sum()) for i in (1, 2, 3, 4)), int((n >= 3).sum()), int(n.sum())]


def _answers(table: pa.Table, columns: int, kind, count: int | None = None, first: int | None = None) -> pa.Table:
    """A shard's answers to all who asked or gave: what was given for each key by all, and to givers a last column of their firsts."""
    table = table.sort_by("who")
    keys = [_unpack_keys(k) for k in table.column("keys").to_pylist()]
    given = [None if v is None else _unpack(v, kind).reshape(columns, -1) for v in table.column("given").to_pylist()]
    gave = [i for i, v in enumerate(given) if v is not None]
    none = [np.zeros(0, np.uint64)], [np.zeros((columns, 0), kind)]
    known, sums, owned = _sums([keys[i] for i in gave] or none[0], [given[i] for i in gave] or none[1], first)
    sums, at, blobs = sums.astype(kind), 0, []
    for mine, v in zip(keys, given):
        reply = _found(mine, known, sums)
        if first is not None and v is not None:
            reply = np.concatenate([reply, owned[None, at:at + len(mine)].astype(kind)])
            at += len(mine)
        blobs.append(_pack_rows(reply) if kind is np.uint32 else _pack(reply.ravel()))
    few = [_few(sums[count])] if count is not None else [None]
    return pa.Table.from_arrays([
        table.column("who"), table.column("shard"), pa.array(blobs, pa.binary()),
        pa.array(few + [None] * (len(blobs) - 1), pa.list_(pa.int64())), pa.array([v is not None for v in given], pa.bool_()),
    ], ["who", "shard", "reply", "few", "gave"])


def _replies(told: pa.Table, kind, columns: int, of: int | None = None, counts: bool = True) -> np.ndarray:
    """The answers of all shards in order, a row per column; ``counts``: whole numbers are packed row by row."""
    rows = zip(*(told.column(c).to_pylist() for c in ("shard", "reply", "round" if of is not None else "shard")))
    mine = [r[1] for r in sorted((r for r in rows if of is None or r[2] == of), key=lambda r: r[0])]
    parts = [_unpack_rows(r, columns) if counts and kind is np.uint32 else _unpack(r, kind).reshape(columns, -1) for r in mine]
    return np.concatenate(parts, axis=1) if parts else np.zeros((columns, 0), kind)


def _ask_triples(shards: int, some: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            keys = np.sort(_among(b.triple, shards, some))
            at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
            n = np.diff(np.r_[at, len(keys)]).astype(np.uint32)
            yield _dealt(b.block, shards, some, keys[at], [n] if b.learn else None)
    return run


def _ask_pairs(shards: int, some: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            keys = np.sort(_among(np.r_[b.pair, np.uint64(0)], shards, some))
            yield _dealt(b.block, shards, some, keys[np.r_[True, keys[1:] != keys[:-1]][:len(keys)]])
    return run


def _give_pairs(shards: int, some: tuple[int, int]):
    """Of the triples that this block is the first to have: sums by their first two words, their number by their last two."""
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        b = next(_blocks([row]))
        _, where, _ = _distinct(b.triple)
        n, owned = _replies(told, np.uint32, 2, 0)
        at, n = where[owned > 0], n[owned > 0].astype(np.int64)
        keys = np.sort(_among(np.r_[b.pair, np.uint64(0)], shards, some))
        keys = keys[np.r_[True, keys[1:] != keys[:-1]][:len(keys)]]

        # Sums by the keys in these shards; the others' are those of another wave.
        def placed(of):
            if not len(keys):
                return np.zeros(len(of), np.int64), np.zeros(len(of), bool)
            place = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
            return place, keys[place] == of

        before, good = placed(b.context[at])
        columns = [np.bincount(before[good], w, len(keys)) for w in ((n * 1.0)[good], *((f(n) * 1.0)[good] for f in CLASSES_OF))]
        last, good = placed(b.pair[at])
        columns.append(np.bincount(last[good], minlength=len(keys)))
        return pa.Table.from_batches([_dealt(b.block, shards, some, keys, [c.astype(np.uint32) for c in columns])])
    return run


CLASSES_OF = (lambda n: n == 1, lambda n: n == 2, lambda n: n >= 3)


def _give_words(shards: int):
    """Of the pairs that this block is the first to have: sums by their first word, their number by their last."""
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        b = next(_blocks([row]))
        _, where, _ = _distinct(np.r_[b.pair, np.uint64(0)])
        found = _replies(told, np.uint32, 6, 1)
        mine = found[5] > 0
        at, n, size = where[mine], found[4][mine].astype(np.int64), len(b.ids)
        before = b.behind(b.codes, size - 1)[at]
        columns = [np.bincount(before, w, size) for w in (n, *(f(n) for f in CLASSES_OF))]
        columns.append(np.bincount(b.codes[at], minlength=size))
        some = np.flatnonzero(np.any(columns, axis=0))
        some = some[np.argsort(b.ids[some])]
        return pa.Table.from_batches([_dealt(b.block, shards, (0, shards), b.ids[some], [c[some].astype(np.uint32) for c in columns])])
    return run


def _ask_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            yield _dealt(b.block, shards, (0, shards), np.sort(b.ids))
    return run


def _tell_words(shards: int):
    """The block's words themselves, dealt by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            order = np.argsort(b.ids[:-1])
            shard = _shard(b.ids[order], shards).astype(np.int64)
            cuts = np.searchsorted(shard, np.arange(shards + 1))
            some = np.flatnonzero(np.diff(cuts)).tolist()
            words = b.words.take(pa.array(order))
            packed = [_pack_words(words.slice(cuts[i], cuts[i + 1] - cuts[i])) for i in some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()), pa.array([b.learn] * len(some), pa.bool_()), pa.array(packed, pa.binary())], ["shard", "learn", "words"])
    return run


def _lexicon(table: pa.Table) -> pa.Table:
    """The distinct words of a shard in the order of their ids, and which are learned from."""
    learned: dict[str, bool] = {}
    for packed, learn in zip(table.column("words").to_pylist(), table.column("learn").to_pylist()):
        words = _unpack_words(packed).to_pylist()
        if learn:
            learned.update(dict.fromkeys(words, True))
        else:
            for w in words:
                learned.setdefault(w, False)
    words = pa.array(list(learned), pa.string())
    order = np.argsort(_hashes(words)[0])
    return pa.Table.from_arrays([
        table.column("shard").slice(0, 1), pa.array([_pack_words(words.take(pa.array(order)))], pa.binary()),
        pa.array([_pack(np.array(list(learned.values()), np.uint8)[order])], pa.binary())], ["shard", "words", "learn"])


def _spelling(words: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The code points of the letter n-grams of all words, column by column, their keys, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    line = "".join([f"{START * (LETTERS - 1)}{w}{STOP}" for w in words])
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    number, whole = size + 1, size + LETTERS
    at = np.arange(number.sum()) + np.repeat((np.cumsum(whole) - whole) - (np.cumsum(number) - number), number)
    columns = [points[at + k] for k in range(LETTERS)]
    return columns, _letter_keys(columns), number


def _letter_keys(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = _mixed(key + c.astype(np.uint64) + np.uint64(1))
    return key


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the lexicon to their distinct letter n-grams with the number found in words to learn from."""
    for batch in batches:
        for words, learn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            columns, keys, number = _spelling(_unpack_words(words).to_pylist())
            one, where, place = _distinct(keys)
            n = np.bincount(place, np.repeat(_unpack(learn, np.uint8), number), len(one)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(pa.array(c[where]) for c in columns), pa.array(n)], [*LETTER_NAMES, "n"])


def _give_letters(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _letter_keys([batch.column(i).to_numpy() for i in range(LETTERS)])
            order = np.argsort(keys)
            yield _dealt(-1, shards, (0, shards), keys[order], [batch.column(LETTERS).to_numpy()[order]])
    return run


def _ask_letters(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _dealt(number, shards, (0, shards), np.unique(_spelling(_unpack_words(words).to_pylist())[1]))
    return run


def _spelled(row: pa.Table, told: pa.Table) -> pa.Table:
    """Keys and shares of the spelling of a lexicon's words."""
    words = _unpack_words(row.column("words")[0].as_py())
    _, keys, number = _spelling(words.to_pylist())
    p = _replies(told, np.float64, 1)[0][_distinct(keys)[2]]
    share = np.exp(np.add.reduceat(np.log(p), np.cumsum(number) - number))
    return pa.Table.from_arrays([
        row.column("shard"), pa.array([-2], pa.int64()), pa.array([_pack_keys(_hashes(words)[0])], pa.binary()),
        pa.array([_pack(share)], pa.binary()),
    ], ["shard", "who", "keys", "given"])


def _totals(table: pa.Table) -> pa.Table:
    """A shard's words with the sums of what all blocks gave; counts of counts of single words."""
    known, sums, _ = _sums([_unpack_keys(k) for k in table.column("keys").to_pylist()], [
        _unpack(v, np.uint32).reshape(5, -1).astype(np.int64) for v in table.column("given").to_pylist()])
    return pa.Table.from_arrays([
        table.column("shard").slice(0, 1), pa.array([-1], pa.int64()), pa.array([_pack_keys(known)], pa.binary()),
        pa.array([_pack(sums.ravel())], pa.binary()), pa.array([_few(sums[4])], pa.list_(pa.int64())),
    ], ["shard", "who", "keys", "given", "few"])


def _prices(few: list[int], less: list[float]):
    """To every word asked for: its share, as two halves, and as a context its total and how many follow it once, twice, more often."""
    total, free = few[5], few[0] * less[0] + few[1] * less[1] + few[4] * less[2]

    def run(spelt: pa.Table, table: pa.Table) -> pa.Table:
        rows = [r for t in (spelt, table) for r in zip(*(t.column(c).to_pylist() for c in ("who", "keys", "given")))]
        known = {who: (_unpack_keys(k), _unpack(v, np.int64 if who == -1 else np.float64)) for who, k, v in rows if who < 0}
        counts, sums = known.get(-1, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        words, spell = known.get(-2, (np.zeros(0, np.uint64), np.zeros(0)))
        out = []
        for who, keys, _ in rows:
            if who < 0:
                continue
            keys = _unpack_keys(keys)
            found = _found(keys, counts, sums.reshape(5, -1))
            p = _found(keys, words, spell[None])[0]
            n = found[4]
            if total:
                p = (n - _off(n, less)) / total + free / total * p
            halves = np.ascontiguousarray(p).view(np.uint32).reshape(-1, 2).T
            out.append((who, table.column("shard")[0].as_py(), _pack(np.concatenate([*halves, *found[:4].astype(np.uint32)]))))
        columns = list(zip(*out)) or [(), (), ()]
        return pa.Table.from_arrays([
            *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))),
            pa.array([None] * len(out), pa.list_(pa.int64())), pa.array([False] * len(out), pa.bool_())], ["who", "shard", "reply", "few", "gave"])
    return run


def _off(n: np.ndarray, less: list[float]) -> np.ndarray:
    return np.array([0.0, *less])[np.minimum(n, 3)]


def _scored(three: list[float], two: list[float]):
    """row, the sum of the logarithms of its words' shares, and its size."""
    def run(row: pa.Table, told: pa.Table) -> pa.Table:
        b = next(_blocks([row]))
        given = 1 if b.learn else 0
        n3 = _replies(told, np.uint32, 1 + given, 0)[0][_distinct(b.triple)[2]].astype(np.int64)
        pairs = _replies(told, np.uint32, 5 + given, 1).astype(np.int64)
        place = _distinct(np.r_[b.pair, np.uint64(0)])[2]
        own, zero = place[:-1], place[-1]
        before = b.behind(own, zero)
        words = _replies(told, np.uint32, 6, 2, False)[:, _distinct(b.ids)[2]]
        share = np.ascontiguousarray(words[:2].T).view(np.float64).ravel()
        words, last = words[2:].astype(np.int64), b.behind(b.codes, len(b.ids) - 1)
        n2, total2 = pairs[4][own], words[0][last]
        loose = np.divide(words[1:].T @ np.array(two), words[0], out=np.ones(len(share)), where=words[0] > 0)
        p = np.divide(n2 - _off(n2, two), total2, out=np.zeros(len(own)), where=total2 > 0) + loose[last] * share[b.codes]
        total3 = pairs[0][before]
        loose = np.divide(pairs[1:4].T @ np.array(three), pairs[0], out=np.ones(pairs.shape[1]), where=pairs[0] > 0)
        p = np.divide(n3 - _off(n3, three), total3, out=np.zeros(len(own)), where=total3 > 0) + loose[before] * p
        return pa.Table.from_arrays([
            b.row["rows"].values, pa.array(np.add.reduceat(np.log(p), b.starts)), pa.array(np.add.reduceat(b.lengths[b.codes] + 1, b.starts)),
        ], ["row", "logs", "size"])
    return run


def counts_of_counts(levels: dict[int, DataFrame]) -> dict[int, list[int]]:
    """How many n-grams of each order are found once, twice, three and four times."""
    told = None
    for k, counts in levels.items():
        one = counts.agg(F.lit(k).alias("k"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
        told = one if told is None else told.unionByName(one)
    return {r.k: [r.n1, r.n2, r.n3, r.n4] for r in told.collect()}


def discounts(few: list[int]) -> list[float]:
    """What is taken off n-grams found once, twice, and more often."""
    of = [max(1, v) for v in few]
    y = of[0] / (of[0] + 2 * of[1])
    return [min(max(i + 1 - (i + 2) * y * of[i + 1] / of[i], 0.05), i + 1.0) for i in range(3)]


def shares(counts: DataFrame, asked: DataFrame, symbols: list[str], base: DataFrame) -> DataFrame:
    """``symbols`` and p, the share of the last symbol after the others, of the distinct n-grams ``asked``.

    ``counts``: distinct n-grams of trusted text with n. ``base``: the last symbol and p below the lowest order.
    """
    every = asked.join(counts.hint("merge"), symbols, "full").select(*symbols, F.coalesce("n", F.lit(0)).alias("n"))
    return saved(counted_shares(every, symbols, base).join(asked, symbols, "left_semi"), "shares")[0]


def lower_orders(counts: DataFrame, symbols: list[str]) -> dict[int, DataFrame]:
    """By order, the distinct n-grams with n, the number of different symbols that one follows in trusted text."""
    levels = {len(symbols): counts}
    for k in range(len(symbols) - 1, 0, -1):
        levels[k], _ = saved(levels[k + 1].groupBy(*symbols[-k:]).agg(F.count_if(F.col("n") > 0).alias("n")), "lower-grams")
    return levels


def order_shares(counts: DataFrame, gram: list[str], below: DataFrame, less: list[float]) -> DataFrame:
    """``gram`` and p of the distinct n-grams of one order, by p of its last symbols in ``below`` and the discounts ``less``."""
    off = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, less[0]).when(F.col("n") == 2, less[1]).otherwise(less[2])
    rows, context = counts.select(*gram, "n", off.alias("off")), gram[:-1]
    sums = (rows.where("n > 0").groupBy(*context) if context else rows).agg(F.sum("n").alias("total"), F.sum("off").alias("free"))
    if context:
        wanted = rows.join(sums.hint("merge"), context, "left")
    else:
        one = sums.first()
        wanted = rows.withColumns({"total": F.lit(one.total or None).cast("double"), "free": F.lit(one.free).cast("double")})
    wanted = wanted.join(below.hint("merge"), gram[-max(len(context), 1):])
    p = F.coalesce((F.col("n") - F.col("off")) / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("free") / F.col("total"), F.lit(1.0)) * F.col("p")
    return wanted.select(*gram, p.alias("p"))


def counted_shares(counts: DataFrame, symbols: list[str], base: DataFrame) -> DataFrame:
    """``symbols`` and p of the distinct n-grams ``counts``, whose n is 0 where trusted text has none."""
    levels = lower_orders(counts, symbols)
    few, below = counts_of_counts(levels), base
    for k in sorted(levels):
        below = order_shares(levels[k], symbols[-k:], below, discounts(few[k]))
    return below


def spelled(lexicon: DataFrame, buckets: int) -> tuple[DataFrame, str, str]:
    """The shares of the spelling of all words of the lexicon, as what each of ``buckets`` shards of words is given; ``bucketed`` by shard."""
    spark = lexicon.sparkSession
    symbols = list(LETTER_NAMES)
    found = lexicon.select("words", "learn").mapInArrow(_letters, ", ".join(f"{c} int" for c in symbols) + ", n long")
    asked, path = saved(found.groupBy(*symbols).agg(F.sum("n").alias("n")), "letter-grams")
    sweep(spark)
    base = asked.select(symbols[-1]).distinct().withColumn("p", F.lit(1.0 / POINTS))
    known, shared = saved(counted_shares(asked, symbols, base), "shares")
    discard(spark, path)
    sweep(spark)
    shards = 1 + known.count() // SHARD
    together = known.mapInArrow(_give_letters(shards), GIVEN).unionByName(
        lexicon.select("shard", "words").mapInArrow(_ask_letters(shards), GIVEN))
    answers = together.groupBy("shard").applyInArrow(lambda t: _answers(t, 1, np.float64), ANSWER).where("who >= 0")
    shares, name, place = bucketed(
        lexicon.groupBy("shard").cogroup(answers.groupBy("who")).applyInArrow(_spelled, GIVEN), "shard", 1 + buckets // 4, "spellings")
    discard(spark, shared)
    sweep(spark)
    return shares, name, place


def bucketed(df: DataFrame, by: str, buckets: int, purpose: str) -> tuple[DataFrame, str, str]:
    """Write ``df`` by a key, so that others meet it without a shuffle of it; the frame that reads it, the table's name and path."""
    spark = df.sparkSession
    path, name = work_path(spark, f"llm-{purpose}"), f"kn_{purpose}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    return spark.table(name), name, path


def _few_of(answers: DataFrame) -> list[int]:
    """The counts of counts of all shards."""
    return [v or 0 for v in answers.agg(*[F.sum(F.get("few", F.lit(i))) for i in range(6)]).first()]


def perplexities(rows: DataFrame, most: int | None = None) -> DataFrame:
    """row and _kn_log, the logarithm of the perplexity, of the texts with words of a frame row, learn, text.

    ``most``: the number of waves in which triples and pairs are asked for.
    """
    spark = rows.sparkSession
    rows = rows.select("row", "learn", "text")
    # Written by block, so that what a block is told meets it without another shuffle of the blocks.
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    path, name = work_path(spark, "llm-coded"), f"kn_coded_{uuid.uuid4().hex}"
    paths = [path]
    for half in range(HALVES):
        coded = rows.where(F.pmod("row", F.lit(HALVES)) == half).mapInArrow(_coding(half), CODED)
        coded.write.mode("append").partitionBy("learn").bucketBy(1 + size // (4 * BLOCK), "block").option(
            "compression", "zstd").option("path", path).saveAsTable(name)
        sweep(spark)
    blocks = spark.table(name).select(*CODED_NAMES)
    taught, others = blocks.where("learn"), blocks.where("not learn")
    waves = most or WAVES
    shards = max(waves if most else 1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // SHARD))
    parts = [(shards * w // waves, shards * (w + 1) // waves) for w in range(waves)]
    parts = [p for p in parts if p[0] < p[1]]

    def kept(df: DataFrame, purpose: str) -> DataFrame:
        df, place = saved(df, purpose)
        paths.append(place)
        sweep(spark)
        return df

    words = blocks.select("block", "learn", "words").mapInArrow(_tell_words(shards), "shard long, learn boolean, words binary")
    lexicon, place = saved(words.groupBy("shard").applyInArrow(_lexicon, LEXICON), "lexicon")
    sweep(spark)
    spellings, spelt, path = spelled(lexicon, shards)
    paths.append(path)
    discard(spark, place)

    told = spark.createDataFrame([], f"{ANSWER}, round int")

    def heard(asked: DataFrame, number: int, columns: int, count: int, first: int) -> DataFrame:
        run = lambda t: _answers(t, columns, np.uint32, count, first)
        return kept(asked.groupBy("shard").applyInArrow(run, ANSWER).withColumn("round", F.lit(number)), "answers")

    few = {3: [0] * 6, 2: [0] * 6}
    for order, number, columns in ((3, 0, 1), (2, 1, 5)):
        before = told.where("gave")
        for part in parts:
            if order == 3:
                asked = blocks.mapInArrow(_ask_triples(shards, part), GIVEN)
            else:
                given = taught.groupBy("block").cogroup(before.groupBy("who")).applyInArrow(_give_pairs(shards, part), GIVEN)
                asked = given.unionByName(others.mapInArrow(_ask_pairs(shards, part), GIVEN))
            answers = heard(asked, number, columns, columns - 1, columns - 1)
            few[order] = [a + b for a, b in zip(few[order], _few_of(answers))]
            told = told.unionByName(answers)
    given = taught.groupBy("block").cogroup(told.where("round = 1 and gave").groupBy("who")).applyInArrow(_give_words(shards), GIVEN)
    totals = kept(given.groupBy("shard").applyInArrow(_totals, f"{GIVEN}, few array<long>"), "totals")
    single = _few_of(totals)
    less = {3: discounts(few[3][:4]), 2: discounts(few[2][:4])}
    # Some blocks after the others ask for their words and are scored at once, so that these answers are never written whole.
    sums, pieces = None, most or PARTS
    for part in range(pieces):
        some, theirs = (df.where(F.pmod(F.xxhash64(c), F.lit(pieces)) == part) for df, c in ((blocks, "block"), (told, "who")))
        asked = totals.drop("few").unionByName(some.select("block", "learn", "words").mapInArrow(_ask_words(shards), GIVEN))
        prices = spellings.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_prices(single, discounts(single[:4])), ANSWER)
        theirs = theirs.unionByName(prices.withColumn("round", F.lit(2)))
        run = _scored(less[3], less[2])
        scored = kept(some.groupBy("block").cogroup(theirs.groupBy("who")).applyInArrow(run, "row long, logs double, size long"), "scored")
        sums = scored if sums is None else sums.unionByName(scored)
    found, _ = saved(sums.groupBy("row").agg((-F.sum("logs") / F.sum("size")).alias("_kn_log")), "sums")
    for old in (name, spelt):
        spark.sql(f"drop table {old}")
    for old in paths:
        discard(spark, old)
    sweep(spark)
    return found


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with _kn_log, _kn_limit and _kn_kept."""
    row = F.xxhash64(F.col(doc_id), F.col(text))
    # Labels grow with the corpus, so their join is a shuffle at any size.
    good = good_ids(labels).withColumn("good", F.lit(True)).hint("merge")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), row.alias("row")).join(good, "doc_id", "left")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scored, _ = saved(perplexities(rows.withColumn("learn", F.coalesce(F.col("good") & ~held, F.lit(False)))), "perplexities")
    tried = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), row.alias("row")).where(held).join(good, "doc_id")
    limits, _ = saved(thresholds(tried.join(scored.hint("merge"), "row")).coalesce(1), "limits")
    common = limits.where("common").select("log_limit").first()
    own = limits.where("not common").select(F.col("lang").alias("_kn_lang"), F.col("log_limit").alias("_kn_own"))
    full = docs.withColumn("_kn_row", row).join(scored.withColumnRenamed("row", "_kn_row").hint("merge"), "_kn_row", "left")
    full = full.join(own, F.col(lang).eqNullSafe(F.col("_kn_lang")), "left")
    limit = F.coalesce("_kn_own", F.lit(common.log_limit if common else None).cast("double"))
    kept: Column = F.coalesce(F.col("_kn_log") <= limit, F.lit(True))
    return full.withColumn("_kn_limit", limit).withColumn("_kn_kept", kept).drop("_kn_lang", "_kn_own", "_kn_row")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose text passes, with all their columns."""
    return judge(docs, labels, text, lang, doc_id).where("_kn_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
