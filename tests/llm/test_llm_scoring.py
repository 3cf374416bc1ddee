"""Suffix-tree scores, importance resampling and the manifest against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import empty_documents, odd_documents
from pyspark.sql import functions as F

from netweave.llm import merkle, queries, resample, suffix_tree

VOCABULARY = ["a", "of", "the", "Tree", "tree", "é", "x1", "漢", "old", "new", "sea", "and"]


def prose(n, seed, words=(0, 40)):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        text, old, last = [], 0, 0
        for _ in range(rnd.randint(*words)):
            kind = rnd.random()
            following = (last * 5 + 3 + (7 * old if kind > 0.6 else 0)) % len(VOCABULARY)
            old, last = last, rnd.randrange(len(VOCABULARY)) if kind < 0.2 else following
            text.append(VOCABULARY[last] + rnd.choice([" ", "  ", "\n", "\t"]))
        out.append((i, "".join(text)))
    return out


# --- suffix tree -------------------------------------------------------------------

BEGIN = 0


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_tree(rows, depth, least):
    """(id, learned, tokens, known, base, score) per row of (id, learned, text), and N."""
    told = [(i, learned, re.findall(r"[^\x20\x09-\x0D]+", lowered(text)) + [None]) for i, learned, text in rows]
    follow = defaultdict(Counter)
    for _, learned, words in told:
        line = [BEGIN, *words]
        for at in range(1, len(line)) if learned else ():
            for k in range(min(depth, at) + 1):
                follow[tuple(line[at - k:at])][line[at]] += 1
    ones = follow[()]
    total, kinds = sum(ones.values()), len(ones)
    retained = set()
    for state, after in follow.items():
        n = sum(after.values())
        if state and n >= least:
            shorter = follow[state[1:]]
            apart = sum(c * math.log((c / n) / (shorter[w] / sum(shorter.values()))) for w, c in after.items())
            if apart >= 0.5 * math.log(total) * len(after):
                retained.add(state)
    out = []
    for i, learned, words in told:
        line, base, score = [BEGIN, *words], 0.0, 0.0
        for at in range(1, len(line)):
            p = (ones[line[at]] + 1) / (total + kinds + 1)
            base += math.log10(p)
            for k in range(1, min(depth, at) + 1):
                state = tuple(line[at - k:at])
                if state in retained:
                    after = follow[state]
                    p = (after[line[at]] + len(after) * p) / (sum(after.values()) + len(after))
            score += math.log10(p)
        out.append((i, learned, len(words), sum(ones[w] > 0 for w in words), base, score))
    return out, total, retained


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_a_plain_tree(spark, monkeypatch, depth):
    rows = prose(150, depth)
    # Small blocks and shards, so that several of each take part.
    for name, value in (("BLOCK", 300), ("SHARD", 500), ("TEXTS", 400)):
        monkeypatch.setattr(suffix_tree, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in suffix_tree.score_texts(docs, F.col("doc_id") % 7 != 2, depth=depth, least=5).collect()}
    plain, total, retained = plain_tree([(i, i % 7 != 2, t) for i, t in rows], depth, 5)
    assert max(map(len, retained)) >= min(depth, 2) and len(found) == len(rows)
    for i, learned, n, known, base, score in plain:
        r = found[i]
        assert (r.learned, r.n_tokens, r.n_known, r.train_tokens) == (learned, n, known, total)
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-6
    held = [r for r in found.values() if not r.learned]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_shares_of_a_state_add_up(spark):
    rows = prose(80, 9)
    _, _, retained = plain_tree([(i, True, t) for i, t in rows], 1, 5)
    state = next(s[0] for s in retained if s[0])
    words = sorted({w for _, t in rows for w in re.findall(r"\S+", lowered(t))})
    asked = [(-1, ""), *[(1000 + i, f"{state} {w}") for i, w in enumerate([*words, "never-seen"])]]
    docs = spark.createDataFrame([*rows, *asked], "doc_id long, text string")
    learn = (F.col("doc_id") >= 0) & (F.col("doc_id") < 1000)
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(docs, learn, depth=1, least=5).collect()}
    plain, _, _ = plain_tree([(i, 0 <= i < 1000, t) for i, t in [*rows, *asked]], 1, 5)
    assert all(abs(got[i] - score) < 1e-6 for i, *_, score in plain)


def test_suffix_tree_on_odd_rows(spark):
    docs = odd_documents(spark)
    out = suffix_tree.score_texts(docs, F.coalesce(F.col("doc_id") != 4, F.lit(True))).collect()
    plain, total, _ = plain_tree([(r.doc_id, r.doc_id != 4, r.text) for r in docs.collect()], suffix_tree.DEPTH, suffix_tree.LEAST)
    near = lambda row: (str(row[0]), row[1], row[2], row[3], round(row[4], 3), round(row[5], 3))
    assert sorted(map(near, plain)) == sorted(
        near((r.doc_id, r.learned, r.n_tokens, r.n_known, r.base_score, r.score)) for r in out)
    assert {r.train_tokens for r in out} == {total}
    assert suffix_tree.score_texts(empty_documents(spark), F.lit(True)).count() == 0
    none = suffix_tree.score_texts(docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == docs.count() and all(r.score == r.base_score == 0 and r.n_known == 0 for r in none)


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.int64), rng.integers(0, 99, 1000), rng.normal(size=10), np.arange(5, dtype=np.uint32)):
        assert (suffix_tree._unpack(suffix_tree._pack(values), values.dtype) == values).all()
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (suffix_tree._unpack_keys(suffix_tree._pack_keys(keys)) == keys).all()


# --- importance resampling ------------------------------------------------------------

def plain_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(words), [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets, least, share, seed=42):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    own = Counter(place(f) for _, t in docs for f in plain_runs(t)[1])
    wanted = Counter(place(f) for t in target for f in plain_runs(t)[1])
    s_all, t_all = sum(own.values()) + buckets, sum(wanted.values()) + buckets
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((own[b] + 1) * t_all))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        n, runs = plain_runs(t)
        weight = sum(gain[place(f)] for f in runs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[:len(able) * share // 100])}
    return sorted(((*r, rank.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("share", [5, 50, 100])
def test_resampling_equals_a_plain_version(spark, share):
    docs = [*prose(90, 4), *[(r.doc_id, r.text) for r in odd_documents(spark).collect() if r.doc_id != 6], (777, "İ ǅ ß 12-a_b Ab" * 5)]
    docs = [(None if i is None else 10_000 + i, t) for i, t in docs]
    target = ["the old sea", "the new tree and the old tree", None, ""]
    out = resample.resample(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(5),
        spark.createDataFrame([(t,) for t in target], "text string"), share, 100, 5, buckets=97)
    assert sorted([tuple(r) for r in out.collect()], key=str) == plain_resample(docs, target, 97, 5, share)


def test_resampling_on_odd_tables(spark):
    docs, none = odd_documents(spark), empty_documents(spark)
    assert resample.resample(none, docs).count() == 0
    out = resample.resample(docs, none, 100, 100, 1)
    assert out.count() == docs.count() and out.where("rank is not null").count() == out.where("n_words > 0").count()
    assert resample.drawn_documents(docs, out).columns == docs.columns
    twice = [r.rank for r in out.where("doc_id = 6").collect()]
    assert len(twice) == 2 and abs(twice[0] - twice[1]) == 1


def test_resampling_of_the_given_tables(spark, small):
    read = lambda name: spark.read.parquet(f"{small}/{name}.parquet")
    docs = [(r.doc_id, r.text) for r in read("documents").select("doc_id", "text").collect()]
    target = [r.text for r in read("benchmark").collect()]
    plain = [(i, n, w, s, k) for i, _, n, w, s, k in plain_resample(docs, target, 10_000, 20, 5)]
    found = queries.QUERIES["op12_importance_resampling"](spark, small).collect()
    assert sorted(map(tuple, found)) == sorted(plain, key=lambda r: r[0])


# --- manifest ----------------------------------------------------------------------------

def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])


def plain_levels(leaves, fan=16):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i:i + fan]) for i in range(0, len(levels[-1]), fan)])
    return levels


def plain_path(levels, at, fan=16):
    out = []
    for level in levels[:-1]:
        low = at // fan * fan
        out.append((level[low:at], level[at + 1:low + fan]))
        at //= fan
    return out


def plain_manifest(rows, tampered):
    """rows of (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof, folded."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((-1 if r[0] is None else r[0], plain_leaf(*r), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([leaf for _, leaf, _ in sorted(by[s], key=lambda x: x[:2])]) for s in order}
    top = plain_levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (_, leaf, r) in enumerate(sorted(by[s], key=lambda x: x[:2])):
            path = plain_path(trees[s], at) + plain_path(top, k)
            got = plain_leaf(*r[:4], lowered(r[4]) if r[4] is not None else None) if tampered(r[0]) else leaf
            for left, right in path:
                got = H(*left, got, *right)
            out.append((r[0], leaf, trees[s][-1][0], top[-1][0], H(*[h for a, b in path for h in a + b]), got))
    return sorted(out, key=str)


def listed(found):
    rows = found.select("key", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), "folded_root").collect()
    return sorted([tuple(r) for r in rows], key=str)


FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 1, None: 2}, {"a": 300, "b": 1, None: 33, "é": 16, "": 5}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest_equals_a_plain_one(spark, sizes):
    rnd = random.Random(len(sizes))
    rows = [(rnd.randrange(10_000), s, rnd.choice(["en", None]), rnd.choice([None, 7]), rnd.choice([None, "", "Text É", "low", "X" * 50]))
            for s, n in sizes.items() for _ in range(n)]
    tampered = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    found = merkle.manifest(spark.createDataFrame(rows, FIELDS).repartition(4), tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    assert listed(found) == plain_manifest(rows, tampered)


def test_manifest_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert listed(merkle.manifest(docs)) == plain_manifest(rows, lambda i: False)
    assert merkle.manifest(docs).where("folded_root <> root").count() == 0
    assert merkle.manifest(empty_documents(spark)).count() == 0


def test_one_changed_byte_is_seen(spark):
    rows = [(i, "abc"[i % 3], "en", 4, f"Text {i}") for i in range(100)]
    whole = merkle.manifest(spark.createDataFrame(rows, FIELDS), tampered=F.col("doc_id") == 41).collect()
    assert [r.key for r in whole if r.folded_root != r.root] == [41]
    rows[41] = (*rows[41][:4], "text 41")
    again = merkle.manifest(spark.createDataFrame(rows, FIELDS)).collect()
    assert again[0].root != whole[0].root
    kept = {r.key: r.subroot for r in whole if r.key % 3 != 41 % 3}
    assert all(kept[r.key] == r.subroot for r in again if r.key in kept)
