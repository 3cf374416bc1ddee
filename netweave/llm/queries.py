"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import (
    chat, embed_dedup, kneser_ney, line_dedup, merkle, mixing, ngram_join, packing, pii, resample, rules, suffix_dedup, suffix_tree,
)
from netweave.llm.common import saved, table

WORD_TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


LINES_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place
  from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from lines),
common as (select k from keyed where k <> '' group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(c.k) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where c.k is null), '')) as kept_sha256
from keyed left join common c on keyed.k = c.k group by doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found in ten documents or more, dropped everywhere."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, 10).select(
        "doc_id", F.col("_ln_total").alias("n_lines"), F.col("_ln_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7::bigint, 0::bigint, 'user', '\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
marked as (
  select *, case role when 'system' then 12 when 'user' then 10 when 'assistant' then 15
                      else 11 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) end
            + 8 + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) as n
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(n)::bigint as formatted_chars,
       regexp_full_match(string_agg(case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' else 'x' end, ''
                                    order by turn, role, text), 's?(ua)+') as legal
from marked group by conv_id
"""


@query("op4_chat_format", CHAT_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, with digests read back from the formatted text, and whether their turns are in a legal order."""
    told = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(told).alias("text"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat.format_chats(turns).select(
        "conv_id", "legal", chat.formatted(F.col("segments")).alias("formatted"), chat.learnt_text(F.col("segments")).alias("learnt"))
    back = chats.withColumn("turns", chat.read_back(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), "legal",
    )


MIX_SQL = r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
per as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source nulls last) as place
  from sized group by source),
weighed as (select *, ([5.0::double, 2.0::double, 1.0::double])[((place - 1) % 3 + 1)::int] as weight from per),
levels as (
  select *, (1.5::double * sum(source_size) over () - 2.0::double * coalesce(sum(source_size) over (
              order by source_size::double / weight, place rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by source_size::double / weight, place rows between current row and unbounded following) as level
  from weighed),
goals as (
  select source, source_size, least(2.0::double * source_size, weight * max(level) over ()) as target from levels),
rated as (
  select d.doc_id, d.size, g.source_size, g.target,
         case when g.source_size > 0 then g.target / g.source_size else 0.0::double end as rate,
         ('0x' || substr(md5('mix|' || d.doc_id || '|' || coalesce(d.source, '')), 1, 13))::bigint::double
           / 4503599627370496.0::double as u
  from sized d join goals g on d.source is not distinct from g.source)
select doc_id, size, source_size, target,
       size * (floor(rate)::bigint + case when u < rate - floor(rate) then 1 else 0 end) as taken
from rated
"""


@query("op5_mix_sources", MIX_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    sized, _ = saved(mixing.sizes(table(spark, folder, "documents")), "sizes")
    taken = mixing.copies(sized, mixing.targets(sized))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


RULES_SQL = r"""
with split as (
  select doc_id, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
         len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols
  from documents),
pos as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from split),
tri as (
  select doc_id, i, word, lead(word) over s as w2, lead(word, 2) over s as w3 from pos window s as (partition by doc_id order by i)),
again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, word, w2, w3) as c from tri where w3 is not null) where c > 1),
covered as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
counted as (
  select s.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, n_symbols,
         len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(c.n, 0)::bigint as n_repeat_words
  from split s left join covered c on s.doc_id = c.doc_id),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         case when word_chars > 0 then least(1000, 1000 * n_symbols // word_chars) else 0 end as symbols,
         case when n_lines > 0 then least(1000, 1000 * n_dup_lines // n_lines) else 0 end as dup_lines,
         case when n_words > 0 then least(1000, 1000 * n_repeat_words // n_words) else 0 end as repeats,
         case when n_words > 0 then least(1000, 10 * word_chars // n_words) else 0 end as word_length
  from counted),
lab as (select doc_id, min(quality) as good from labels where quality is not null group by doc_id),
vals as (
  select lang, good, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) as rule,
         unnest([symbols, dup_lines, repeats, word_length]) as value
  from judged join lab using (doc_id) where not base_failed),
cnt as (
  select lang, rule, value, count(*) filter (where good = 1) as good, count(*) filter (where good <> 1) as bad from vals group by all),
strata as (select greatest(count(*), 1) as n from (select distinct lang from cnt where good > 0)),
tested as (
  select lang, rule, value, sum(good) over (partition by lang, rule) as n,
         coalesce(sum(good) over up, 0) as lost, coalesce(sum(bad) over up, 0) as caught
  from cnt window up as (partition by lang, rule order by value desc rows between unbounded preceding and 1 preceding)),
sizes as (select distinct lang, rule, n from tested),
terms as (
  select lang, rule, n, unnest(range(0, ceil(n * 0.0025)::bigint + 1)) as j from sizes),
cdf as (
  select lang, rule, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0025) + (n - j) * ln(0.9975)))
                          over (partition by lang, rule order by j) as p
  from terms where n > 0),
allowed as (select lang, rule, max(j) as k from cdf, strata where p <= 0.05 / (4 * strata.n) group by all),
cuts as (
  select t.lang, t.rule, arg_max(value, (caught - 10 * lost) * 10000 + value) as cut
  from tested t join allowed a on t.lang is not distinct from a.lang and t.rule = a.rule where lost <= k group by all),
wide as (
  select lang, max(cut) filter (where rule = 'symbols') as a, max(cut) filter (where rule = 'dup_lines') as b,
         max(cut) filter (where rule = 'repeats') as c, max(cut) filter (where rule = 'word_length') as d from cuts group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or coalesce(symbols > a, false) or coalesce(dup_lines > b, false)
            or coalesce(repeats > c, false) or coalesce(word_length > d, false)) as kept
from judged j left join wide on j.lang is not distinct from wide.lang
"""


@query("op10_quality_rules", RULES_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All documents judged by the base rules and the risk-controlled cutoffs."""
    judged, _ = saved(rules.stats(table(spark, folder, "documents")), "rule-values")
    cuts = rules.cutoffs(judged, table(spark, folder, "labels"))
    return rules.judge(judged, cuts).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces placed in sequences of 2048 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, tokenizer_path())


@query("op2_ngram_jaccard")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose three-word shingles agree to nine tenths."""
    return ngram_join.jaccard_classes(table(spark, folder, "documents"), 3, 90, 100)


VECTORS_SQL = """
with recursive usable as (
  select vec_id, label, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
linked as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id
  where a.norm > 0 and b.norm > 0 and list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach as (select vec_id as v, vec_id as r from embeddings union select l.b as v, r.r from reach r join linked l on l.a = r.v),
least as (select v, min(r) as component_id from reach group by v),
counted as (select a, count(*) as n from linked group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, component_id, e.vec_id = component_id as kept
from embeddings e join least on e.vec_id = v left join counted on e.vec_id = a
"""


@query("op1_embedding_near_dedup", VECTORS_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors with their links and components at a cosine of 0.93."""
    return embed_dedup.near_duplicates(table(spark, folder, "embeddings"), 0.93)


@query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that start earlier."""
    out = suffix_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_kneser_ney_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their perplexity, their language's threshold and the verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    judged = kneser_ney.judge(docs, table(spark, folder, "labels"))
    return judged.select("doc_id", F.exp("_kn_log").alias("perplexity"), F.exp("_kn_limit").alias("threshold"), F.col("_kn_kept").alias("kept"))


@query("op8_pii_bootstrap")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents: base finds, and those that contexts add."""
    found = pii.find_all(table(spark, folder, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in pii.KINDS])

    def told(finds):
        return F.array_join(F.transform(finds, lambda f: F.concat_ws(":", F.get(names, f["kind"]), f["start"], f["end"])), ",")

    def number(kind):
        return F.size(F.filter("finds", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    return found.select(
        "doc_id", *[number(k) for k in range(len(pii.KINDS))], F.sha2(told(F.col("finds")), 256).alias("base_sha256"),
        told(F.sort_array(F.concat("finds", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


@query("op11_suffix_tree_scoring")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """All documents scored by the suffix tree of those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    found = suffix_tree.score_texts(docs, ~held)
    return found.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op12_importance_resampling")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """All documents weighed against the benchmark, a twentieth of the longer ones drawn."""
    docs, wanted = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return resample.resample(docs, wanted, 5, 100).select("doc_id", "n_features", "weight", "score", "rank")


MANIFEST_SQL = r"""
with recursive told as (
  select doc_id, source, text, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
  from documents),
leafed as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) as folded,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
             lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 5 = 0 as tampered
  from told),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx,
         count(*) over (partition by source) as n from leafed),
nodes as (
  select source, 0 as lvl, idx, leaf as h, n from placed
  union all
  select source, lvl + 1, idx // 16, sha256(string_agg(h, '' order by idx)), (any_value(n) + 15) // 16
  from nodes where n > 1 group by source, lvl, idx // 16),
subs as (select source, h, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from nodes where n = 1),
heads as (
  select 0 as lvl, idx, h, n from subs
  union all
  select lvl + 1, idx // 16, sha256(string_agg(h, '' order by idx)), (any_value(n) + 15) // 16
  from heads where n > 1 group by lvl, idx // 16),
beside as (
  select p.doc_id, p.source, n.lvl, n.idx, n.h from placed p join nodes n on p.source is not distinct from n.source
    and n.n > 1 and n.idx // 16 = p.idx // (16 ** (n.lvl + 1))::bigint and n.idx <> p.idx // (16 ** n.lvl)::bigint
  union all
  select p.doc_id, p.source, 1000 + t.lvl, t.idx, t.h from placed p join subs s on p.source is not distinct from s.source
    join heads t on t.n > 1 and t.idx // 16 = s.idx // (16 ** (t.lvl + 1))::bigint and t.idx <> s.idx // (16 ** t.lvl)::bigint),
proofs as (select doc_id, source, sha256(string_agg(h, '' order by lvl, idx)) as proof from beside group by doc_id, source),
climb as (
  select doc_id, source, 0 as lvl, idx, n, case when tampered then folded else leaf end as h from placed
  union all
  select c.doc_id, c.source, c.lvl + 1, c.idx // 16, (any_value(c.n) + 15) // 16,
         sha256(string_agg(case when x.idx = c.idx then c.h else x.h end, '' order by x.idx))
  from climb c join nodes x on c.source is not distinct from x.source and c.lvl = x.lvl and c.idx // 16 = x.idx // 16
  where c.n > 1 group by c.doc_id, c.source, c.lvl, c.idx),
arrived as (select c.doc_id, c.source, s.idx, s.n, c.h from climb c join subs s on c.source is not distinct from s.source where c.n = 1),
rise as (
  select doc_id, source, 0 as lvl, idx, n, h from arrived
  union all
  select c.doc_id, c.source, c.lvl + 1, c.idx // 16, (any_value(c.n) + 15) // 16,
         sha256(string_agg(case when x.idx = c.idx then c.h else x.h end, '' order by x.idx))
  from rise c join heads x on c.lvl = x.lvl and c.idx // 16 = x.idx // 16
  where c.n > 1 group by c.doc_id, c.source, c.lvl, c.idx)
select p.doc_id, p.leaf, s.h as subroot, r.h as root, coalesce(f.proof, sha256('')) as proof_sha256, e.h as folded_root, e.h = r.h as verified
from placed p join subs s on p.source is not distinct from s.source
  join (select h from heads where n = 1) r on true
  join (select * from rise where n = 1) e on p.doc_id is not distinct from e.doc_id and p.source is not distinct from e.source
  left join proofs f on p.doc_id is not distinct from f.doc_id and p.source is not distinct from f.source
"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents; every fifth, by hash, folded from a changed text."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    found = merkle.manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return found.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
