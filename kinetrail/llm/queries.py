"""The registered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, embedding_dedup, fingerprints, hard_negatives, langid, media, ngram_join, packing, pii, secrets, suffix_dedup, token_counts
from .common import documents

#: Where the public vocabulary files are; a parameter, they are never copied here.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.near_duplicates(documents(spark, sf_dir), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), str(WORD_BPE), digests=True)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), str(BYTE_BPE))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), str(BYTE_BPE))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))[0]


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.93)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=5, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe": op2_bpe,
    "op3_pii": op3_pii,
    "op4_media": op4_media,
    "op5_packing": op5_packing,
    "op6_secrets": op6_secrets,
    "op7_token_counts": op7_token_counts,
    "op8_langid": op8_langid,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_conversations": op11_conversations,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: The joins, the repair and the searches are within SQL; tests hold the others to brute-force versions.
ORACLES: dict[str, str] = {
    "op1_ngram_join": r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as gram from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as k from sets a join sets b on a.gram = b.gram and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)),
sym as (select x, y from links union select y, x from links),
reach as (select x as node, x as other from sym union select r.node, s.y from reach r join sym s on s.x = r.other),
low as (select node, min(other) as c from reach group by node),
many as (select x as node, count(*) as k from sym group by x)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(k, 0) as n_links from documents d left join sizes using (doc_id) left join low on low.node = d.doc_id left join many on many.node = d.doc_id""",
    # The parse as a recursion over rows: least (cost, audit) for each nonterminal, with inserted rows (b: nothing yet).
    "op11_conversations": r"""
with recursive raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ascii(x)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 20 as fault from conversations),
damaged as (select conv_id, turn, case when fault = 4 then 'user' else role end as role, case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fault = 0 then [] when fault = 3 then [1, 2] else [1] end) as copy from raw),
placed as (select *, row_number() over w as n, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, lead(role) over w as next, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as tail from damaged window w as (partition by conv_id order by turn nulls first, role, text, copy)),
flawed as (select *, left(role, 1) as r, tail = '' as blank, tail <> '' and seen > 1 as duplicate, tail not in ('', '.', '!', '?') and seen = 1 as truncated from placed),
parse(conv_id, n, b, s, u, a, made) as (
  select distinct conv_id, 0::bigint, {'c': 0, 'x': ''}, null::struct(c integer, x varchar), {'c': 3, 'x': 'I'}, {'c': 6, 'x': 'II'}, null::struct(c integer, x varchar) from conversations
  union all
  select conv_id, n, b, s, u, list_min(list_filter([a, {'c': u.c + 3, 'x': u.x || 'I'}], lambda i: i.c is not null)), null from (
   select conv_id, n, b, s, list_min(list_filter([u0, {'c': b.c + 3, 'x': b.x || 'I'}, {'c': s.c + 3, 'x': s.x || 'I'}, {'c': a.c + 3, 'x': a.x || 'I'}], lambda i: i.c is not null)) as u, a from (
    select p.conv_id, f.n, {'c': b.c + 4, 'x': b.x || 'D'} as b,
      list_min(list_filter([{'c': s.c + 4, 'x': s.x || 'D'}, case when not gone and r = 's' then {'c': b.c + more, 'x': b.x || 'K'} end], lambda i: i.c is not null)) as s,
      list_min(list_filter([{'c': u.c + 4, 'x': u.x || 'D'}, case when not gone then {'c': b.c + fix_u, 'x': b.x || as_u} end, case when not gone then {'c': s.c + fix_u, 'x': s.x || as_u} end, case when not gone then {'c': a.c + fix_u, 'x': a.x || as_u} end], lambda i: i.c is not null)) as u0,
      list_min(list_filter([{'c': a.c + 4, 'x': a.x || 'D'}, case when not gone then {'c': u.c + fix_a, 'x': u.x || as_a} end], lambda i: i.c is not null)) as a
    from parse p join (select *, blank or duplicate as gone, case when truncated then 3 else 0 end as more, more + case when r = 'u' then 0 else 3 end as fix_u, more + case when r = 'a' then 0 else 3 end as fix_a, if(r = 'u', 'K', 'R') as as_u, if(r = 'a', 'K', 'R') as as_a from flawed) f on f.conv_id is not distinct from p.conv_id and f.n = p.n + 1))),
best as (select conv_id, list_min(list_filter([b, a], lambda i: i.c is not null)) as z from parse qualify row_number() over (partition by conv_id order by n desc) = 1),
steps as (select conv_id, k, substr(z.x, k, 1) as edit, sum(case when substr(z.x, k, 1) <> 'I' then 1 else 0 end) over (partition by conv_id order by k) as n, sum(case when substr(z.x, k, 1) <> 'D' then 1 else 0 end) over (partition by conv_id order by k) as o, length(replace(z.x, 'D', '')) % 2 as odd from (select conv_id, z, unnest(range(1, length(z.x) + 1)) as k from best)),
texts as (select q.conv_id, string_agg(case when edit = 'K' then f.role when (o - odd) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else f.text end, chr(10) order by k) as t from steps q left join flawed f on f.conv_id is not distinct from q.conv_id and f.n = q.n where edit <> 'D' group by q.conv_id),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (next is not null and r || left(next, 1) not in ('su', 'ua', 'au')) as illegal from flawed group by conv_id)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, z.c::bigint as cost, z.x as audit, sha256(coalesce(t, '')) as repaired_sha256
from best b left join counts c on c.conv_id is not distinct from b.conv_id left join texts t on t.conv_id is not distinct from b.conv_id""",
    "op13_hard_negatives": r"""
with sound as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as lab, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
anchors as (select * from sound where vec_id % 100 = 0),
scored as (select a.vec_id as a, a.lab as la, c.vec_id as c, c.lab as lc, list_inner_product(a.q::double[], c.q::double[])::bigint as s from anchors a join sound c on len(a.q) = len(c.q) and a.vec_id <> c.vec_id),
positives as (select a, c as p, s as ps from scored where la = lc qualify row_number() over (partition by a order by s desc, c) <= 5),
negatives as (select p.a, p.p, p.ps, n.c, n.s, row_number() over (partition by p.a, p.p order by n.s desc, n.c) as k from positives p join scored n on n.a = p.a and n.la <> n.lc and 80 * ps <= 100 * n.s and n.s <= ps)
select a as anchor_id, p as positive_id, k::integer as rank, c as negative_id, ps as positive_score, s as negative_score from negatives where k <= 5""",
}
