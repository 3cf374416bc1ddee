"""Embedding, n-gram and suffix dedup against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import empty_documents, odd_documents

from netweave.llm import embed_dedup, ngram_join, suffix_dedup
from netweave.llm.components import components


def least(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(kind)
    edges = {"chain": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(300)] + [(7, 7)],
             "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]}[kind]
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == least(nodes, [e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    rows = []
    for i in range(600):
        x = base[i % 40] + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.25, 0.3])
        rows.append((i, [float(v) for v in x * rng.uniform(0.5, 2)], int(i % 40 % 3)))
    rows += [(700, rows[0][1], 0), (701, rows[0][1], 1), (702, None, 0), (703, [], 0), (704, [0.0] * 24, 0), (705, [float("nan")] * 24, 0),
             (706, [None] + [1.0] * 23, 0), (707, rows[0][1], None), (708, [1.0, 2.0], 0), (709, [2.0, 4.0], 0), (710, [1e-300] * 24, 2), (711, [1e300] * 24, 2)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, label int, lead string")
    usable = {i: np.array(v) / np.abs(v).max() for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    labels = {r[0]: r[2] for r in rows}
    links = [(a, b) for a, b in combinations(usable, 2) if labels[a] == labels[b] and len(usable[a]) == len(usable[b])
             and usable[a] @ usable[b] / np.linalg.norm(usable[a]) / np.linalg.norm(usable[b]) >= 0.93]
    comp = least(labels, links)
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(frame, 0.93).collect()}
    assert set(got) == set(labels) and len(links) > 500
    for i in labels:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in links), comp[i], comp[i] == i)
    assert embed_dedup.near_duplicates(frame.limit(0), 0.93).count() == 0


def test_collision_counts_keep_linked_pairs():
    """Recall over pairs at the threshold itself, the worst that must be found."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.standard_normal((4000, 64))
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * away
    width = embed_dedup.WIDTH * np.sqrt(2 - 2 * 0.93)
    proj = embed_dedup.directions(64)
    hits = (np.abs(x @ proj - y @ proj) <= width).sum(1)
    import math
    assert (hits >= embed_dedup.needed(32, math.erf(embed_dedup.WIDTH / 2**0.5), 5e-7)).mean() > 0.999


def test_blocks_of_vectors_meet(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(v) for v in base[i % 30] + 0.02 * rng.standard_normal(16)], 1) for i in range(300)]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.93).collect()
    assert all(r.n_links >= 9 and r.component_id <= r.vec_id % 30 for r in got)


def shingles(text, k):
    w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    return {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80), (3, 50)])
def test_jaccard_matches_brute_force(spark, size, num, monkeypatch):
    if num == 80:
        monkeypatch.setattr(ngram_join, "BLOCK", 8)
        monkeypatch.setattr(ngram_join, "BUFFER", 500)
    rng = random.Random(size * num)
    texts = []
    for _ in range(25):
        words = [rng.choice("abcdefghijklmnopqrstuvwxyzéß") * rng.randint(1, 3) for _ in range(rng.choice([2, 8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 4, 25])):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(["NEW", "x", "É"]) + str(rng.randrange(9))
            texts.append(" ".join(copy))
    rows = list(enumerate(texts)) + [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "One"), (10_004, "one")]
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = least(sets, links)
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, n int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_classes(frame, size, num, 100).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("few,told", [(64, 4), (1, 4), (3, 0), (64, 10**6)])
def test_sections_give_all_pairs_whichever_way(monkeypatch, few, told):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "TOLD", told)
    monkeypatch.setattr(ngram_join, "LEAF", 4)
    monkeypatch.setattr(ngram_join, "PAIRS", 50)
    rng, num, den = np.random.default_rng(few + told), 80, 100
    rows, expected, best, opened, sid = [], set(), set(), set(), 0
    for key in range(60):
        size, two, base = int(rng.integers(1, 20)), bool(key % 3 == 0), rng.integers(0, 3, ngram_join.GROUPS)
        group = []
        for _ in range(size):
            counts = base + rng.integers(0, 2, ngram_join.GROUPS) * (rng.random() < 0.6) * (300 if key == 7 else 1)
            kind = "u1" if counts.max() < 256 else "<u2"
            group.append((key - 30, key % 5, sid, int(rng.integers(0, 4)), int(rng.integers(0, 2)) if two else 0, int(counts.sum()), counts.astype(kind).tobytes(), counts))
            sid += 1
        rows += group
        if two and all(r[4] for r in group):
            continue  # one block of two is empty
        found = {}
        for x, y in combinations(group, 2):
            most = int(np.minimum(x[7], y[7]).sum())
            if x[3] != y[3] and (x[4] != y[4] or not any(r[4] for r in group)) and den * most >= num * (x[5] + y[5] - most):
                found[x[2], y[2]] = most / (x[5] + y[5])
        expected |= set(found)
        for r in group:
            mine = [(-share, *(q for q in pair if q != r[2])) for pair, share in found.items() if r[2] in pair]
            if mine:
                best.add(tuple(sorted((r[2], min(mine)[1]))))
        if len(found) > told * size:
            opened.add(key - 30)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    whole = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "part", "sid", "comp", "side", "n", "cells"])
    batches = [whole.slice(low, 17) for low in range(0, len(rows), 17)]

    def run(of_best):
        return [r for b in ngram_join._across(num, den, of_best)(iter(batches)) for r in b.to_pylist()]

    assert len(expected) > 200 and {(r["a"], r["b"]) for r in run(False)} == expected
    out = run(True)
    assert {(r["a"], r["b"]) for r in out if r["rest"] is False} == best and {r["key"] for r in out} - {None} == opened
    left = {(r["a"], r["b"]) for r in out if r["rest"]}
    gone = {(x[2], y[2]) for x, y in combinations(rows, 2) if x[0] == y[0] and x[0] in opened}
    assert left == expected - best - gone


def test_jaccard_with_all_pairs_of_a_section_anew(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > 0.04 else f"n{rng.randrange(5)}" for w in base) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    whole = {tuple(r) for r in ngram_join.jaccard_classes(frame, 3, 70, 100).collect()}
    monkeypatch.setattr(ngram_join, "TOLD", 0)
    assert {tuple(r) for r in ngram_join.jaccard_classes(frame, 3, 70, 100).collect()} == whole


def test_jaccard_of_odd_documents(spark):
    out = ngram_join.jaccard_classes(odd_documents(spark)).collect()
    assert len(out) == 10 and all(r.component_id == r.doc_id for r in out)
    assert ngram_join.jaccard_classes(empty_documents(spark)).count() == 0


def cut(rows, span=100):
    seen, out = {}, {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            w = data[p:p + span]
            if seen.setdefault(w, (i, p)) != (i, p):
                gone[p:p + span] = b"\1" * span
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[i] = (bytes(c for c, g in zip(data, gone) if not g), len(data), sum(gone), runs)
    return out


def repeated_documents(seed):
    rng = random.Random(seed)

    def some(n):
        return "".join(rng.choice("abcde fghé\n") for _ in range(n))

    shared = [some(n) for n in (99, 100, 101, 150, 400, 1500)]
    rows = []
    for i in range(60):
        parts = [some(rng.choice([0, 1, 40, 300])) for _ in range(3)]
        for s in rng.sample(shared, 2):
            a = rng.choice([0, 0, len(s) // 4])
            parts.insert(rng.randint(0, 3), s[a:rng.choice([len(s), len(s), 3 * len(s) // 4])])
        rows.append((rng.randrange(10**6), "".join(parts)))
    return list({i: t for i, t in rows}.items()) + [(-5, "a" * 700), (3, "ab" * 500), (4, "ab" * 300 + "\0" * 300), (5, None), (6, "")]


@pytest.mark.parametrize("seed,group", [(1, 40_000), (2, 3)])
def test_repeats_match_brute_force(spark, seed, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 200)
    rows = repeated_documents(seed)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, runs string").repartition(5)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == cut(rows)


def test_repeats_of_odd_documents(spark):
    got = suffix_dedup.remove_repeats(odd_documents(spark)).collect()
    assert len(got) == 10
    assert [r.n_removed for r in got if r.doc_id == 6] == [0, 0]
    assert next(bytes(r.kept) for r in got if r.doc_id == 8) == b"y"  # the second window already covers all but the first byte
    assert suffix_dedup.remove_repeats(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_two_stage_order(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(97, 97 + [1, 2, 3, 200, 26][seed] % 150, 600).astype(np.uint8) if seed else np.full(300, 97, np.uint8)
    raw = text.tobytes()
    order = suffix_dedup.suffix_order(text, np.ones(len(text), bool), 700)
    assert [raw[i:] for i in order] == sorted(raw[i:] for i in range(len(raw)))
    shared = suffix_dedup.common_prefixes(text, order, 20)
    for i in range(1, len(order)):
        a, b = raw[order[i - 1]:][:20], raw[order[i]:][:20]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert shared[i] == n
