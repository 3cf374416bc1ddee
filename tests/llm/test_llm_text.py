"""Line dedup, chat formatting, mixing and quality rules on small cases."""

import math
import re
from collections import Counter

import pytest
from llm_cases import empty_documents, odd_documents
from pyspark.sql import functions as F

from netweave.llm import chat, line_dedup, mixing, rules

BLANKS = " \t\n\x0b\x0c\r"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def test_lines_match_brute_force(spark):
    texts = {i: "\n".join(["Shared LINE ", "shared É", f"own {i}", "", "  ", "own tail"[: i % 3]]) for i in range(20)}
    texts |= {20: None, 21: "", 22: "shared line", 23: "shared line\nshared line", 24: "SHARED é"}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    n = Counter()
    for t in texts.values():
        n.update({fold(x.strip(BLANKS)) for x in (t or "").split("\n")} - {""})
    got = {r.doc_id: r for r in line_dedup.dedup_lines(frame, 10).collect()}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if n[fold(x.strip(BLANKS))] < 10]
        assert (got[i].text, got[i]._ln_total, got[i]._ln_dropped) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_lines_of_odd_documents(spark):
    docs = odd_documents(spark)
    out = line_dedup.dedup_lines(docs, 2)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    assert [r.text for r in rows if r.doc_id == 6] == ["", ""]  # the repeated row shares its lines
    assert [r._ln_total for r in rows if r.doc_id == 1] == [1]
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_line_runs_level_up(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    batches = [spark.createDataFrame([(i, f"common\nonly {i}")], "doc_id long, text string") for i in range(5)]
    left = [runs.absorb(b, 3).first().text for b in batches]
    assert left == ["common\nonly 0", "common\nonly 1", "only 2", "only 3", "only 4"]
    assert [len(level) for level in runs.levels] == [1, 0, 1]


@pytest.fixture(scope="module")
def turns():
    nasty = ["\\", "\\b", "\\h###", "</turn>", "### User: x</turn>\n### Assistant: y", "", None, "\\### Assistant: </turn> ok", "####", ": a", "é\U0001f600"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(nasty + ["end"])]
    rows += [(2, 0, "tool:x", "a: b"), (2, 1, None, "c"), (3, None, "assistant", "z"), (3, 0, "user", "p"), (3, 0, "user", "p"), (None, 0, "user", "q")]
    return rows


def test_chats_come_back(spark, turns):
    frame = spark.createDataFrame([(*r, "clash") for r in turns], "conv_id long, turn long, role string, text string, rows string")
    out = chat.format_chats(frame).select("conv_id", "legal", "segments", chat.formatted(F.col("segments")).alias("told"))
    out = out.withColumn("back", chat.read_back(F.col("told"))).withColumn("learnt", chat.learnt_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert [(b.role, b.text) for b in got[conv].back] == [(r, x) for _, r, x in mine]
        assert got[conv].learnt == "".join(x for _, r, x in mine if r == "assistant")
    assert got[1].legal and not got[2].legal and not got[3].legal and not got[None].legal
    assert "".join(s.text for s in got[1].segments if s.loss).count("</turn>") == 0
    assert chat.format_chats(frame.limit(0)).count() == 0


def waterfill(sizes, weights, share, cap):
    """The excess above the caps dealt out again and again by weight."""
    goal, held = share * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = goal - sum(held.values())
        total = sum(weights[i % len(weights)] for i in free)
        over = [i for i in free if rest * weights[i % len(weights)] / total > cap * sizes[i]]
        if not over:
            return [held.get(i, rest * weights[i % len(weights)] / total if i in free else 0) for i in range(len(sizes))]
        held |= {i: cap * sizes[i] for i in over}


def test_targets_match_resharing(spark):
    words = {"a": 10, "b": 1000, "c": 300, "d": 5, "é": 700, None: 60}
    frame = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(words.items())], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.targets(mixing.sizes(frame)).collect()}
    want = waterfill(list(words.values()), (5, 2, 1), 1.5, 2.0)
    assert all(math.isclose(got[s], w) for s, w in zip(words, want))
    assert math.isclose(sum(got.values()), 1.5 * sum(words.values()))


def test_mix_comes_near_its_targets(spark):
    rows = [(i, "w " * (1 + i % 50), f"s{i % 3}", "x") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixing.mix(frame)
    assert out.columns == frame.columns
    goals = {r.source: r.target for r in mixing.targets(mixing.sizes(frame)).collect()}
    taken = {r.source: r.n for r in mixing.sizes(out).groupBy("source").agg(F.sum("size").alias("n")).collect()}
    assert all(abs(taken[s] / goals[s] - 1) < 0.05 for s in goals)
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in mixing.mix(frame.repartition(3)).collect())


def test_mix_of_odd_documents(spark):
    docs = odd_documents(spark)
    assert mixing.mix(docs).columns == docs.columns
    sized = mixing.sizes(docs)
    assert mixing.copies(sized, mixing.targets(sized)).where("copies > 2 or size < 0").count() == 0
    assert mixing.mix(empty_documents(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() == 0


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_match_brute_force(spark):
    docs = odd_documents(spark, [(20, "a b c a b c d\nx\nx\n x\n" * 9, "en", "a"), (21, "#a *b $c|<> " * 60, "en", "a")])
    for r in rules.stats(docs, keep=("doc_id", "lang", "text")).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
    assert rules.stats(empty_documents(spark)).count() == 0


def binomial(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))


def test_allowed_rejections_are_exact(spark):
    sizes = [1, 100, 2300, 5000, 40_000, 3_000_000]
    frame = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", rules.allowed(F.col("n"), 0.0025, 0.003).alias("k"))
    for n, k in frame.collect():
        assert k < 0 or binomial(k, n, 0.0025) <= 0.003 * (1 + 1e-6)
        assert binomial(k + 1, n, 0.0025) > 0.003 * (1 - 1e-6)


def test_cutoffs_spare_good_documents(spark):
    good = [(i, "en", i % 20, 1) for i in range(20_000)]
    bad = [(20_000 + i, "en", 100 + i % 300, 0) for i in range(2000)]
    few = [(30_000 + i, "fr", i, 1) for i in range(100)] + [(None, None, 7, 1)]
    rows = [(i, lang, v, 0, 0, 40, False, q) for i, lang, v, q in good + bad + few]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, symbols long, dup_lines long, repeats long, word_length long, base_failed boolean, quality int")
    judged = frame.drop("quality")
    labels = frame.select("doc_id", "quality").unionByName(spark.createDataFrame([(5, None), (None, 1), (77_777, 0)], "doc_id long, quality int"))
    cuts = {(r.stratum, r.rule): r.cutoff for r in rules.cutoffs(judged, labels).collect()}
    assert cuts[("en", "symbols")] == 19 and ("fr", "symbols") not in cuts
    kept = rules.judge(judged, rules.cutoffs(judged, labels)).join(frame.select("doc_id", "quality"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(kept) == {1: 1.0, 0: 0.0}
    assert rules.judge(judged, rules.cutoffs(judged, labels.limit(0))).where("kept").count() == len(rows)
