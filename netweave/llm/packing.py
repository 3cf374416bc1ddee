"""Pack tokenised documents into fixed-length sequences by best-two-fit.

Texts are tokenised in Arrow batches. Only pieces longer than a sequence are cut. What is
shuffled afterwards is one small row per piece, never the tokens. Pieces are dealt by hash
into bins of work of about ``GROUP`` pieces, each packed by itself: a sequence is filled
with the longest piece that still fits, again and again; then its smallest piece is
replaced by the two unpacked pieces that fill the widened gap best, if they fill more.

Defined cases: a null or empty text is the closing id alone; a document without an id is
packed like any other; repeated rows are packed each; ties in length are taken by document
and piece; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 2048
GROUP = 8192
RUN = 1 << 23
REMEMBERED = 300_000
# Latin letters that change in lower case one by one and are composed already; marks behind.
LATIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131\u0134-\u0148\u014a-\u017e]+)([.,;:!?]*)").fullmatch


class WordTokens:
    """Token ids of texts through a tokenizer that never joins words across white space.

    The words between spaces and line ends of a run of texts are put in a dictionary, and
    only its entries are tokenised. A word of Latin letters, maybe with marks behind, needs
    no normalising beyond lower case and falls into two units; letters and marks are
    tokenised without that work and remembered, up to ``REMEMBERED`` of them.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.units: dict[str, bytes] = {"": b""}
        self.suffix = self.plain.model.end_of_word_suffix
        if self.suffix:
            vocabulary = self.plain.get_vocab(with_added_tokens=False)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith(self.suffix)]] = True

    def _encode_units(self, units: list[str]) -> None:
        """Letters and marks hold no end-of-word sign, so that tokens with it end a unit."""
        if not self.suffix:
            return self._encode(self.plain, units, self.units)
        for low in range(0, len(units), 4096):
            part = units[low:low + 4096]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            bounds = [0, *(4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()]
            told = ids.tobytes()
            self.units.update((w, told[bounds[k]:bounds[k + 1]]) for k, w in enumerate(part))

    @staticmethod
    def _encode(tokenizer, words: list[str], into: dict[str, bytes]) -> None:
        """Tokenise words joined by spaces; a token belongs to the word that its offset lies in."""
        for low in range(0, len(words), 4096):
            part = words[low:low + 4096]
            got = tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            at = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            bounds = [0, *(4 * np.searchsorted(at, ends)).tolist()]
            ids = np.array(got.ids, dtype="<u4").tobytes()
            into.update((w, ids[bounds[k]:bounds[k + 1]]) for k, w in enumerate(part))

    def _words(self, words: list[str]) -> list[bytes]:
        units, split, other = self.units, [], []
        for w in words:
            m = LATIN(w)
            if m:
                split.append((m[1].lower(), m[2]))
            else:
                split.append(None)
                other.append(w)
        if len(units) > REMEMBERED:
            units.clear()
            units[""] = b""
        missing = {u for parts in split if parts for u in parts if u not in units}
        self._encode_units(list(missing))
        rest: dict[str, bytes] = {}
        self._encode(self.tokenizer, other, rest)
        return [units[parts[0]] + units[parts[1]] if parts else rest[w] for w, parts in zip(words, split)]

    def ids(self, texts: pa.Array) -> Iterator[memoryview]:
        """Little-endian unsigned 32-bit ids of each text, in order.

        What a run was made of goes as soon as its next form is there, so that two forms of one run are held at most.
        """
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        run = np.cumsum(sizes, dtype=np.int64) // RUN
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else []
        for low, high in zip(starts, np.r_[starts[1:], len(run)]):
            lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.slice(low, high - low), ""), "\n", " "), " ")
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            del lists
            known, indices = pa.array(self._words(coded.dictionary.to_pylist()), pa.large_binary()), coded.indices
            del coded
            got = known.take(indices)
            del known, indices
            ends = np.frombuffer(got.buffers()[1], np.int64)[bounds]
            data = memoryview(got.buffers()[2] or b"")
            del got, bounds
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                yield data[a:b]
            del data, ends


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, close: int | None = 0, text: str = "text",
           doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every piece.

    ``tokenizer`` is the path of a tokenizer file; ``close`` ends each document.
    """
    end = b"" if close is None else int(close).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            size = 0
            for name, ids in zip(batch.column(0).to_pylist(), tokens.ids(batch.column(1))):
                ids = ids.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    one = ids[at:at + 4 * length]
                    for column, value in zip(rows, (name, k, at // 4, len(one) // 4, zlib.crc32(one), one if with_ids else None)):
                        column.append(value)
                    size += len(one) if with_ids else 1
                if size > 1 << 24:
                    yield told(batch, rows)
                    rows, size = [[], [], [], [], [], []], 0
            yield told(batch, rows)

    def told(batch: pa.RecordBatch, rows: list[list]) -> pa.RecordBatch:
        arrays = [pa.array(rows[0], batch.schema.field(0).type), pa.array(rows[1], pa.int32()),
                  *[pa.array(c, pa.int64()) for c in rows[2:5]]]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            arrays.append(pa.array(rows[5], pa.binary()))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length; ``lengths`` must fall, none above ``room``.

    Works on the number of unpacked pieces per length. ``top[v]`` is the greatest unpacked
    length of at most v.
    """
    count = np.bincount(lengths, minlength=room + 1)
    first = np.zeros(room + 2, dtype=np.int64)  # next unpacked place per length
    starts = np.searchsorted(-lengths, -np.arange(room + 1), side="left")
    first[: room + 1] = starts
    values = np.arange(room + 1)
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    top = np.maximum.accumulate(np.where(count > 0, values, 0))

    def take(v: int) -> None:
        count[v] -= 1
        if count[v] == 0:
            below = top[v - 1]
            stop = v
            while stop <= room and top[stop] == v:
                stop += 512
            stop = min(stop, room + 1)
            span = top[v:stop]
            span[span == v] = below

    def give(v: int) -> None:
        count[v] += 1
        if count[v] == 1:
            span = top[v:]
            np.maximum(span, v, out=span)

    number = 0
    left = len(lengths)
    while left:
        bin_, gap = [], room
        while gap and top[gap]:
            v = int(top[gap])
            take(v)
            bin_.append(v)
            gap -= v
        if gap and len(bin_) > 0:
            small = bin_[-1]
            wide = gap + small
            xs = values[1: wide // 2 + 1][count[1: wide // 2 + 1] > 0]
            if len(xs):
                ys = top[wide - xs].copy()
                twin = (ys == xs) & (count[xs] < 2)
                ys[twin] = top[xs[twin] - 1]
                sums = np.where(ys > 0, xs + ys, 0)
                best = int(sums.argmax())
                if sums[best] > small:
                    x, y = int(xs[best]), int(ys[best])
                    give(small)
                    take(x)
                    take(y)
                    bin_[-1:] = [y, x]
        at = 0
        for v in bin_:
            place = first[v]
            first[v] += 1
            sequence[place], offset[place] = number, at
            at += v
        left -= len(bin_)
        number += 1
    return sequence, offset


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``cut`` (columns doc_id, piece, length and any others) with sequence_id and offset.

    Pieces that repeat a document and piece number are told apart by their order only;
    equal rows are interchangeable.
    """
    total = cut.count()
    groups = max(1, -(-total // group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    schema = dealt.schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(rows: pa.Table) -> list[pa.RecordBatch]:
            number = rows.column("_group")[0].as_py()
            lengths = np.ascontiguousarray(rows.column("length").to_numpy())
            sequence, offset = best_two_fit(lengths, length)
            out = rows.drop_columns(["_group"])
            out = out.append_column("sequence_id", pa.array(sequence + (number << 32), pa.int64()))
            return out.append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()

        now = None
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("_group")).to_numpy()
            for one in np.split(np.arange(len(marks)), np.flatnonzero(np.diff(marks)) + 1):
                if not len(one):
                    continue
                if held and marks[one[0]] != now:
                    yield from packed(pa.Table.from_batches(held))
                    held = []
                now = marks[one[0]]
                held.append(batch.slice(int(one[0]), len(one)))
        if held:
            yield from packed(pa.Table.from_batches(held))

    order = ["_group", F.col("length").desc(), "doc_id", "piece"]
    spread = dealt.repartition(groups, "_group") if groups > 1 else dealt.repartition(1)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "_group")
    return spread.sortWithinPartitions(*order).mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    cut, _ = saved(pieces(docs, tokenizer, length, text=text, doc_id=doc_id), "pieces")
    return pack(cut, length)
