"""Packing, personal data, the language model and the pipeline on small cases."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import empty_documents, odd_documents
from tokenizers import Tokenizer

import corpus_pipeline
from netweave.llm import kneser_ney, packing, pii
from netweave.llm.queries import tokenizer_path

PATH = tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)
WORDS = packing.WordTokens(PATH)


def ids(text):
    return np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_word_tokens_equal_whole_texts(texts):
    got = [bytes(x) for x in WORDS.ids(pa.array(texts, pa.string()))]
    assert got == [ids(t) for t in texts]


@pytest.mark.parametrize("text", ["Été, ça va?!  don't we'LL", "<|endoftext|> x", "ﬁ Å Å İı ŉ ß", "\t\x0b\x85 a b", "1234.5 #*$ a_b"])
def test_word_tokens_of_odd_words(text):
    assert bytes(next(WORDS.ids(pa.array([text])))) == ids(text)


def test_a_run_of_texts_is_held_in_one_form_when_its_ids_are_told(monkeypatch):
    monkeypatch.setattr(packing, "RUN", 1 << 20)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(2000)) for _ in range(300)])
    assert texts.nbytes > 2 << 20
    before, most, n = pa.total_allocated_bytes(), 0, 0
    for one in WORDS.ids(texts):
        most, n = max(most, pa.total_allocated_bytes() - before), n + 1
        assert len(one)
    assert n == 300 and most < 4 << 20


def test_best_two_fit_fills_sequences():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), np.full(10, 2048), np.array([1]), rng.integers(600, 800, 999)):
        lengths = -np.sort(-lengths)
        seq, off = packing.best_two_fit(lengths, 2048)
        used = np.bincount(seq, weights=lengths)
        assert used.max() <= 2048 and len(used) == seq.max() + 1 and used.min() > 0
        for s in range(len(used)):
            mine = np.argsort(off[seq == s])
            assert (off[seq == s][mine] == np.r_[0, np.cumsum(lengths[seq == s][mine])[:-1]]).all()
    seq, _ = packing.best_two_fit(np.array([6, 4, 4, 3, 3]), 10)
    assert seq.max() == 1  # 6+4 and 4+3+3


def test_packing_covers_all_tokens(spark):
    docs = odd_documents(spark)
    out = packing.pack_documents(docs, PATH).collect()
    lengths = Counter()
    for r in out:
        lengths[r.doc_id] += r.length
    for r in docs.dropDuplicates(["doc_id"]).collect():
        n = len(ids(r.text or "")) // 4 + 1
        assert lengths[r.doc_id] == n * (2 if r.doc_id == 6 else 1)
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty_documents(spark), PATH).count() == 0


def test_packing_in_groups(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.randint(1, 2048)) for i in range(1500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long"), 2048, 200).collect()
    used = Counter()
    for r in out:
        used[r.sequence_id] += r.length
    assert len(out) == 1500 and max(used.values()) <= 2048 and len(used) <= 1.05 * sum(r[2] for r in rows) / 2048 + 8


RULES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (i % 2 + 1)
        total += v // 10 + v % 10
    return total % 10 == 0


def plain_finds(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")) or kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("a1@.-+% ", max_size=40), st.text("0123456789 -.+()", max_size=60), st.text("4 1-", max_size=40), st.text(max_size=30)))
def test_base_finds_follow_the_rules(text):
    assert pii.base_finds(text) == plain_finds(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1 " * 100_000, "+1" * 100_000, "1." * 100_000, "@" * 100_000, "a@" * 50_000):
        pii.base_finds(text)


def test_contexts_add_unseen_identifiers(spark):
    rows = [(i, f"please contact me at user{i}@mail.example.com today") for i in range(30)]
    rows += [(100, "please contact me at root@localhost today"), (101, "nothing 123456789 here"), (102, None), (103, ""), (0, rows[0][1])]
    got = pii.find_all(spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, row int, kind string")).collect()
    assert len(got) == len(rows)
    added = {r.doc_id: [(a.start, a.kind, a.end) for a in r.added] for r in got if r.added}
    assert added == {100: [(21, 0, 35)]}
    assert pii.find_all(empty_documents(spark)).count() == 0
    assert pii.find_all(odd_documents(spark)).count() == 10


def test_found_identifiers_bring_new_patterns(spark):
    edges = [("a", f"seed{i}", 0) for i in range(60)] + [("a", f"new{i}", -1) for i in range(4)]
    edges += [("b", f"rare{i}", 0) for i in range(3)] + [("b", f"new{i}", -1) for i in range(4)]
    edges += [("c", f"seed{i}", 0) for i in range(20)] + [("c", f"new{i}", -1) for i in range(4)]
    worth, _ = pii.scores(spark.createDataFrame(edges, "pattern string, told string, kind int"))
    assert {r.pattern for r in worth.collect()} == {"a", "b", "c"}


def test_accepted_identifiers_are_marked_everywhere(spark):
    rows = [(i, f"please contact me at user{i}@mail.example.com today") for i in range(30)]
    rows += [(100, "please contact me at root@localhost today"), (101, "or write root@localhost, maybe")]
    got = pii.find_all(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [(a.start, a.kind, a.end) for a in r.added] for r in got if r.added} == {100: [(21, 0, 35)], 101: [(9, 0, 23)]}


@pytest.mark.parametrize("text,wanted", [
    ("call (017) 555 7713 now", ["(017) 555 7713"]), ("(017 555 7713).", ["017 555 7713"]), ("in 12 34, 567 8", []),
    ("at 123456 78.", ["123456", "123456 78"]), ("12 34\n567", []), ("a 1 2 b", []), ("mail +49 30 1234567 x 55 5555", ["55 5555"])])
def test_digit_groups_are_candidates(text, wanted):
    assert [text[a:b] for a, b in pii.candidates(text, pii.base_finds(text))] == wanted


def plain_model(texts):
    """Interpolated modified Kneser-Ney written from its definition, over tuples."""
    table = kneser_ney.character_classes()
    n = kneser_ney.ORDER
    counts = {n: Counter()}
    for t in texts:
        c = [0] * (n - 1) + [int(table[min(ord(x), len(table) - 1)]) for x in t]
        counts[n].update(tuple(c[i - n + 1:i + 1]) for i in range(n - 1, len(c)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, total, free = {}, {}, {}
    for k in counts:
        of = [max(1, sum(v == i for v in counts[k].values())) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        off[k] = [0] + [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i) for i in (1, 2, 3)]
        total[k], free[k] = Counter(), Counter()
        for g, v in counts[k].items():
            total[k][g[:-1]] += v
            free[k][g[:-1]] += off[k][min(v, 3)]

    def p(g):
        if not g:
            return 1 / kneser_ney.CLASSES
        k, low = len(g), p(g[1:])
        if not total[k][g[:-1]]:
            return low
        v = counts[k][g]
        return ((v - off[k][min(v, 3)]) if v else 0) / total[k][g[:-1]] + free[k][g[:-1]] / total[k][g[:-1]] * low

    def log_perplexity(t):
        c = [0] * (n - 1) + [int(table[min(ord(x), len(table) - 1)]) for x in t]
        return -sum(math.log(p(tuple(c[i - n + 1:i + 1]))) for i in range(n - 1, len(c))) / len(t)

    return log_perplexity


def test_model_matches_its_definition(spark):
    rng = random.Random(3)
    words = ["the", "then", "Other", "ment", "été", "12", "x!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    model = kneser_ney.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = np.exp(model.logs().astype(np.float64)).reshape(-1, kneser_ney.CLASSES).sum(1)
    assert abs(p - 1).max() < 1e-4
    plain = plain_model(texts)
    tried = texts[:10] + ["zzz qqq", "THE THE", "漢字 \U0001f600", "a"]
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(tried + [None, ""])], "doc_id long, text string, lang string")
    got = {r.doc_id: r._kn_log for r in kneser_ney.score(frame, model).collect()}
    assert all(math.isclose(got[i], plain(t), rel_tol=1e-4) for i, t in enumerate(tried))
    assert got[len(tried)] is None and got[len(tried) + 1] is None


def test_junk_goes_and_clean_text_stays(spark):
    rng = random.Random(4)
    syllables = {"en": ["the", "er", "on", "ing", "and"], "de": ["sch", "ung", "der", "ei", "ten"]}

    def clean(lang):
        return " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(80))

    rows = [(i, clean("en" if i % 2 else "de"), "en" if i % 2 else "de", "s", 1) for i in range(500)]
    rows += [(1000 + i, "X#%& " * 60 + str(i), "en", "s", 1) for i in range(30)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(300)] + [(1000, 0), (None, 1), (3, None)], "doc_id long, quality int")
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.columns == docs.columns
    left = {r.doc_id for r in kept.collect()}
    assert not any(1000 + i in left for i in range(30)) and {2000, 2001} <= left
    assert len(left & set(range(500))) >= 497
    assert kneser_ney.keep_good(docs, labels.limit(0)).count() == len(rows)
    assert kneser_ney.keep_good(docs.limit(0), labels).count() == 0


def test_prose_of_other_scripts_and_orders_is_told_apart(spark):
    rng = random.Random(5)
    words = ["мир", "дом", "река", "город", "осень", "вечер", "дорога", "человек"]
    rows = [(i, " ".join(words[(a + k) % 8] for a in [rng.randrange(8)] for k in range(40))) for i in range(400)]
    letters = "".join(words)
    junk = [(1000 + i, " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))) for i in range(20)]
    shuffled = [(2000 + i, " ".join(rng.choice(words) for _ in range(40))) for i in range(20)]
    docs = spark.createDataFrame([(*r, "ru") for r in rows + junk + shuffled], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    left = {r.doc_id for r in kneser_ney.keep_good(docs, labels).collect()}
    assert left == set(range(400))


def plain_shares(counts, asked, base):
    """Interpolated modified Kneser-Ney over tuples, from its definition."""
    n = len(asked[0])
    levels = {n: Counter(counts)}
    for k in range(n - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return base
        c = levels[len(g)]
        of = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
        y = of[0] / (of[0] + 2 * of[1])
        off = [0] + [min(max(i - (i + 1) * y * of[i] / of[i - 1], 0.05), i) for i in (1, 2, 3)]
        mine = [v for h, v in c.items() if h[:-1] == g[:-1]]
        if not mine:
            return p(g[1:])
        return (c[g] - off[min(c[g], 3)] + sum(off[min(v, 3)] for v in mine) * p(g[1:])) / sum(mine)

    return [p(g) for g in asked]


def test_shares_match_their_definition(spark):
    rng = random.Random(6)
    counts = Counter(tuple(min(rng.randrange(5), rng.randrange(5)) for _ in range(3)) for _ in range(120))
    asked = [(a, b, c) for a in range(6) for b in range(6) for c in range(6)]
    names = ["s1", "s2", "s3"]
    base = spark.createDataFrame([(i, 0.01) for i in range(6)], "s3 long, p double")
    got = kneser_ney.shares(
        spark.createDataFrame([(*g, n) for g, n in counts.items()], "s1 long, s2 long, s3 long, n long"),
        spark.createDataFrame(asked, "s1 long, s2 long, s3 long"), names, base)
    found = {(r.s1, r.s2, r.s3): r.p for r in got.collect()}
    assert len(found) == len(asked)
    assert all(math.isclose(found[g], p, rel_tol=1e-9) for g, p in zip(asked, plain_shares(counts, asked, 0.01)))


def test_pipeline_stages_take_effect(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "pack"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.count()
        docs = spark.createDataFrame(stage(spark, docs, small).toArrow())
        if name != "pack":
            assert docs.columns == columns
        if name == "lines":
            assert docs.count() == before and docs.where("n_chars <> char_length(text)").count() == 0
        if name in ("quality", "near_copies"):
            assert 0 < docs.count() < before
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_odd_and_empty_documents(spark, small, name, stage):
    for docs in (odd_documents(spark), empty_documents(spark)):
        out = stage(spark, docs, small)
        assert out.count() <= max(2, 2 * docs.count()) or name == "pack"
        assert name == "pack" or out.columns == docs.columns


def test_words_are_those_of_the_pattern():
    texts = ["", "The cat  sat\n\n on   3.5_x; été İ", "漢字kana かな ไทย x", "a" * 70 + " " * 33 + "b" * 32 + " " * 65, "\t \U0001f600   ", " ", "", "x"]
    of, first, size, ids = kneser_ney.words_of(texts, kneser_ney._tables())
    line = "".join(texts)
    found = [(i, line[a:a + n]) for i, a, n in zip(of.tolist(), first.tolist(), size.tolist())]
    assert found == [(i, w) for i, t in enumerate(texts) for w in kneser_ney.WORD.findall(t)]
    assert len(set(ids.tolist())) == len({w for _, w in found}) and 0 not in ids
    assert all(len(a) == 0 for a in kneser_ney.words_of(["", ""], kneser_ney._tables()))


def test_blocks_of_ngrams_give_the_same_and_leave_no_tables(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    words = ["the", "of", "a", "cat", ",", "été", "漢字", "x1"]
    texts = [" ".join(rng.choice(words[:rng.randint(2, 8)]) for _ in range(rng.randint(1, 40))) for _ in range(80)] + [None, "", "the"]
    rows = spark.createDataFrame([(i, i % 3 == 0, t) for i, t in enumerate(texts + texts[:5])], "row long, learn boolean, text string")
    got = []
    for most in (1, 4):
        made = []
        place = lambda spark, purpose: made.append(str(tmp_path / f"{most}-{len(made)}-{purpose}")) or made[-1]
        monkeypatch.setattr("netweave.llm.common.work_path", place)
        monkeypatch.setattr("netweave.llm.kneser_ney.work_path", place)
        got.append({r.row: r._kn_log for r in kneser_ney.perplexities(rows, most).collect()})
        left = {p.split("-llm-")[1] for p in made if os.path.exists(p)}
        assert not left & {"texts", "words", "grams", "pairs", "shares"}
    assert set(got[0]) == set(got[1]) == set(range(80)) | {82} | set(range(83, 88))
    assert all(math.isclose(got[0][i], got[1][i], rel_tol=1e-9) for i in got[0])


def test_packed_perplexities_match_their_definition(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("SHARD", 48), ("WAVES", 3)):
        assert getattr(kneser_ney, name) > value
        monkeypatch.setattr(kneser_ney, name, value)
    rng = random.Random(9)
    vocabulary = ["the", "of", "a", "cat", ",", "\u00e9t\u00e9", "\u6f22", "x1", "\n"]
    texts = [" ".join(rng.choice(vocabulary[:rng.randint(2, 9)]) for _ in range(rng.randint(1, 20))) for _ in range(50)]
    texts += ["the", "", None, "zebra \U0001f600 the of", texts[0]]
    found = [kneser_ney.WORD.findall(t or "") for t in texts]
    learned = [words for i, words in enumerate(found) if i % 3 == 0]
    counts = Counter(g for words in learned for g in zip([0, 0, *words], [0, *words], words))
    grams = {w: [tuple(f"{kneser_ney.START * 4}{w}{kneser_ney.STOP}"[i:i + 5]) for i in range(len(w) + 1)] for words in found for w in words}
    letters = Counter(g for w in {w for words in learned for w in words} for g in grams[w])
    asked = sorted({g for each in grams.values() for g in each})
    share = dict(zip(asked, plain_shares(letters, asked, 1 / kneser_ney.POINTS)))
    spell = {w: math.prod(share[g] for g in each) for w, each in grams.items()}
    price = {g: plain_shares(counts, [g], spell[g[2]])[0] for words in found for g in zip([0, 0, *words], [0, *words], words)}
    rows = spark.createDataFrame([(i, i % 3 == 0, t) for i, t in enumerate(texts)], "row long, learn boolean, text string").repartition(3)
    got = {r.row: r._kn_log for r in kneser_ney.perplexities(rows).collect()}
    assert set(got) == {i for i, words in enumerate(found) if words}
    for i in got:
        logs = sum(math.log(price[g]) for g in zip([0, 0, *found[i]], [0, *found[i]], found[i]))
        assert math.isclose(got[i], -logs / sum(len(w) + 1 for w in found[i]), rel_tol=1e-9)


def test_ids_of_words_are_those_of_texts():
    texts = ["The cat  sat 3.5_x; \u00e9t\u00e9 \u0130", "\u6f22\u5b57kana \u304b \U0001f600 x", "a" * 40]
    of, first, size, ids = kneser_ney.words_of(texts, kneser_ney._tables())
    line = "".join(texts)
    words = pa.array(["?", *(line[a:a + n] for a, n in zip(first.tolist(), size.tolist()))], pa.string()).slice(1)
    again, length = kneser_ney._hashes(words, kneser_ney._tables())
    assert again.tolist() == ids.tolist() and length.tolist() == size.tolist()


def test_words_and_rows_of_counts_come_back_from_their_packed_form():
    words = pa.array(["the", "\n", "\u6f22", "\U0001f600" * 32, "x", "y"], pa.string())
    for some in (words, words.slice(1, 4), words.slice(0, 0)):
        assert kneser_ney._unpack_words(kneser_ney._pack_words(some)).to_pylist() == some.to_pylist()
    rng = np.random.default_rng(3)
    for n in (0, 1, 4000):
        for columns in (1, 2, 5, 6):
            rows = (rng.integers(0, 300, (columns, n)) // rng.integers(1, 300, (1, n))).astype(np.uint32)
            rows[:, :1] = 0xFFFFFFFF
            packed = kneser_ney._pack_rows(rows)
            again = kneser_ney._unpack_rows(packed, columns)
            assert again.dtype == np.uint32 and (again == rows).all()
    assert len(kneser_ney._pack_rows(np.ones((6, 1 << 16), np.uint32))) < 200


def test_answers_on_words_are_not_written_for_all_blocks_at_once(spark, monkeypatch):
    for name, value in (("BLOCK", 64), ("SHARD", 256), ("WAVES", 1)):
        monkeypatch.setattr(kneser_ney, name, value)
    written, saved = [], kneser_ney.saved

    def recorded(df, purpose):
        out = saved(df, purpose)
        written.append((purpose, {r["round"] for r in out[0].select("round").distinct().collect()} if purpose == "answers" else None))
        return out

    monkeypatch.setattr(kneser_ney, "saved", recorded)
    rows = spark.createDataFrame([(i, i % 2 == 0, f"one {i % 7} of {i % 5} and more") for i in range(60)], "row long, learn boolean, text string")
    assert kneser_ney.perplexities(rows).count() == 60
    assert [rounds for purpose, rounds in written if purpose == "answers"] == [{0}, {1}]
    assert sum(purpose == "scored" for purpose, _ in written) == kneser_ney.PARTS > 1
