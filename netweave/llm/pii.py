"""Personal data by fixed rules, and by contexts that those finds suggest.

Base finds are leftmost matches of a rule per kind; matches that fail its check drop out.
They seed a bootstrapped extraction: every identifier-like word (``DIGITS`` digits or more,
or an ``@`` inside), every longest run of digit groups parted by blanks on a line, and every
base find is an instance, and the words before and around it are its patterns. On the graph of distinct patterns and instances Spark iterates: a pattern
is worth the mean score of its instances for a kind, lowered for small numbers; an
instance is worth the chance that any of its trusted patterns is right. A pattern can be
trusted once ``SUPPORT`` of its instances are base finds or score ``ACCEPT``, so finds of a
round bring patterns into the next. Instances without a base find that score ``ACCEPT``
become finds of that kind at all their places.

Only identifier-like words leave the texts, pre-summed to distinct pairs, so the graph is
far smaller than the corpus and no pattern's instances meet in one task.

Places are code points, ends exclusive. Defined cases: a null text is empty and has no
finds; repeated rows have equal finds each; a null id is an id of its own; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
DIGITS, SUPPORT, TRUST, ACCEPT, ROUNDS = 5, 5, 0.8, 0.9, 3
LONGEST = 80

ANY = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts inside a run of digits: the rest of the run would do no better.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
GROUP = re.compile(r"[(+]*[0-9](?:[0-9()./-]*[0-9)])?")
MARKS = ".,;:!?\"'"
EDGES = ".,;:!?\"'()[]{}<>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` the longest run of local characters before it and a domain behind."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_finds(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base finds in order."""
    if not ANY.search(text):
        return []
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    out.sort()
    return out


def _plain(word: str) -> str:
    if "@" in word or sum(c.isdigit() for c in word) >= DIGITS:
        return "#"
    return re.sub(r"[0-9]", "0", word.lower())[:LONGEST]


def patterns(text: str, start: int, end: int) -> list[str]:
    """The two words before, and the word before with the one behind."""
    before = ["^", "^", *map(_plain, WORD.findall(text[max(0, start - 4 * LONGEST):start]))]
    behind = WORD.search(text, end, end + 2 * LONGEST)
    after = _plain(behind[0]) if behind else "$"
    return [f"{before[-2]} {before[-1]} _", f"{before[-1]} _ {after}"]


def _grouped(text: str, start: int, end: int) -> tuple[int, int]:
    """A run of digit groups without brackets that have no partner in it or stand around it."""
    told = text[start:end]
    if told[0] == "(" and (")" not in told or told.find(")") == len(told) - 1):
        start += 1
    if told[-1] == ")" and ("(" not in told or told.rfind("(") == 0):
        end -= 1
    return start, end


def candidates(text: str, finds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like words, without marks around them, and runs of digit groups, that no base find touches."""
    if not ANY.search(text):
        return
    reach, k = list(accumulate((f[2] for f in finds), max)), 0
    run: list[tuple[int, int]] = []

    def closed() -> Iterator[tuple[int, int]]:
        if len(run) > 1:
            start, end = _grouped(text, run[0][0], run[-1][1])
            if end - start <= LONGEST and sum("0" <= c <= "9" for c in text[start:end]) >= DIGITS:
                yield start, end
        run.clear()

    for m in WORD.finditer(text):
        word = m[0]
        while k < len(reach) and reach[k] <= m.start():
            k += 1
        touched = k < len(finds) and finds[k][0] < m.end()
        start = m.start() + len(word) - len(word.lstrip(MARKS))
        end = m.end() - (len(word) - len(word.rstrip(MARKS)))
        if run and (run[-1][1] < len(text) and text[run[-1][1]] in MARKS or start > m.start() or re.search(r"[\n\r\x0b\x0c]", text[run[-1][1]:m.start()])):
            yield from closed()
        if touched or not GROUP.fullmatch(text, start, max(start, end)):
            yield from closed()
        else:
            run.append((start, end))
        if touched or "@" not in word and sum("0" <= c <= "9" for c in word) < DIGITS:
            continue
        start = m.start() + len(word) - len(word.lstrip(EDGES))
        end = m.end() - (len(word) - len(word.rstrip(EDGES)))
        if 0 < end - start <= LONGEST and not word.startswith("@") and not word.endswith("@"):
            yield start, end
    yield from closed()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, row, text to finds per document, with its instances and their patterns."""
    instance = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("told", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        for low in range(0, batch.num_rows, 1000):
            part = batch.slice(low, 1000)
            finds, seen = [], []
            for text in part.column(2):
                text = text.as_py() or ""
                base = base_finds(text)
                rows = [{"start": a, "end": b, "kind": k, "told": text[a:b].lower(), "patterns": patterns(text, a, b)} for a, k, b in base]
                rows += [{"start": a, "end": b, "kind": -1, "told": text[a:b].lower(), "patterns": patterns(text, a, b)} for a, b in candidates(text, base)]
                finds.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
                seen.append(rows)
            find = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(finds, pa.list_(find)), pa.array(seen, pa.list_(instance))],
                ["doc_id", "row", "finds", "seen"])


def scores(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns (pattern, kind, worth) and instances (told, kind, score).

    ``edges``: distinct pattern, told, kind; kind -1 for instances without a base find.
    """
    seeds = edges.where("kind >= 0").select("told", "kind").distinct().withColumn("score", F.lit(1.0))
    unknown = edges.where("kind < 0").select("pattern", "told").distinct()
    unknown = unknown.join(seeds.select("told").distinct(), "told", "left_anti")
    pairs = edges.select("pattern", "told").distinct()
    degree = pairs.groupBy("pattern").agg(F.count("*").alias("degree"))
    degree, _ = saved(degree, "patterns")
    pairs, _ = saved(pairs, "pattern-instances")
    held = seeds
    worth = None
    for _ in range(rounds):
        # Base finds and accepted instances support a pattern anew in each round.
        sums = pairs.join(held, "told").groupBy("pattern", "kind").agg(
            F.sum("score").alias("sum"), F.count_if(F.col("score") >= ACCEPT).alias("support")).where(F.col("support") >= support)
        worth = degree.join(sums, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("degree") + 1)).alias("worth"))
        worth, _ = saved(worth.where(F.col("worth") >= trust), "pattern-worth")
        wrong = F.sum(F.log(1 - F.col("worth")))
        found = unknown.join(worth, "pattern").groupBy("told", "kind").agg((1 - F.exp(wrong)).alias("score"))
        held = seeds.unionByName(found)
    return worth, held


def find_all(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, finds and added (lists of start, kind, end) of every document."""
    row = F.xxhash64(F.col(doc_id), F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), row.alias("row"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    find = "array<struct<start:int,kind:int,end:int>>"
    scanned, _ = saved(rows.mapInArrow(_scan, f"doc_id {kind}, row long, finds {find}, seen array<struct<start:int,end:int,kind:int,told:string,patterns:array<string>>>"), "finds")
    seen = scanned.select("doc_id", "row", F.explode("seen").alias("s")).select("doc_id", "row", "s.*")
    places = seen.withColumn("pattern", F.explode("patterns")).drop("patterns")
    edges, _ = saved(places.select("pattern", "told", "kind").distinct(), "pattern-edges")
    _, held = scores(edges)
    best = held.where(F.col("score") >= ACCEPT)
    new = seen.where("kind < 0").drop("kind", "patterns").join(best.select("told", "kind"), "told")
    new = new.groupBy("doc_id", "row", "start", "end").agg(F.min("kind").alias("kind"))
    added = new.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    added = added.withColumnRenamed("doc_id", "a_id").withColumnRenamed("row", "a_row")
    full = scanned.select("doc_id", "row", "finds").join(
        added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("row") == F.col("a_row")), "left")
    return full.select("doc_id", "finds", F.coalesce("added", F.array().cast(find)).alias("added"))
