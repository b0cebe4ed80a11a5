"""The queries of this folder, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from duelgrid.llm import bpe, chat, decontam, langid, neardup, pii, piece_bpe, prefix_trie, secret_scan, sharding, spelling, topk, wrappers
from duelgrid.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The surrogates' key is the caller's; the query has a fixed one so that its rows are the same on every run.
KEY = b"surrogates of the query"


def op1_bpe_round_trip(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op2_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_preference_pairs(spark, sf_dir):
    return chat.preference_pairs(chat.shared_start(chat.paired(table(spark, sf_dir, "conversations"))))


def op5_secret_scan(spark, sf_dir):
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op6_kd_shards(spark, sf_dir):
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark, sf_dir):
    return pii.replace(table(spark, sf_dir, "documents"), KEY)


def op9_benchmark_leaks(spark, sf_dir):
    """The documents that hold a passage of the benchmark; the others are clean."""
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).filter("contaminated")


def op10_main_text(spark, sf_dir):
    return wrappers.main_texts(table(spark, sf_dir, "pages"), labels=False)


def op11_piece_bpe(spark, sf_dir):
    return piece_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.shared_head_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_exact_top_k, op3_language_id, op4_preference_pairs, op5_secret_scan, op6_kd_shards, op7_near_duplicates, op8_pii_surrogates, op9_benchmark_leaks, op10_main_text, op11_piece_bpe, op12_prefix_trie, op13_spelling_variants)}


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a text's UTF-8 bytes: the hex digits of each byte, the low one first, four bits a step."""
    step = [0] * 16
    for i in range(16):
        step[i] = i
        for _ in range(4):
            step[i] = (step[i] >> 1) ^ (0xEDB88320 if step[i] & 1 else 0)
    digits = f"flatten(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda p: [('0x' || p[2])::bigint, ('0x' || p[1])::bigint]))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {digits}), "
            f"lambda c, d: xor(c >> 4, list_extract({step}::bigint[], 1 + xor(c & 15, d)))), 4294967295::bigint)")


ORACLES = {
    "op2_exact_top_k": """
with whole as (
  select vec_id, min(list_transform(embedding, lambda x: floor(256 * x::double)::bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::bigint as score
  from whole q join whole c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored
qualify rank <= 5
""",
    "op4_preference_pairs": f"""
with own as (
  select conv_id >> 1 as pair_id, conv_id % 2 = 0 as chosen, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n,
         {crc32_sql("(conv_id >> 1)::varchar")} % 4 as h
  from conversations where conv_id is not null),
rebuilt as (
  select pair_id, chosen, role, text, n from own where chosen or n > h
  union all select pair_id, false, role, text, n from own where chosen and n <= h),
ordered as (select pair_id, chosen, role, text, row_number() over (partition by pair_id, chosen order by n) as n from rebuilt),
pairs as (select distinct pair_id from ordered),
sides as (
  select pair_id, s.chosen, n, role, text
  from pairs join (values (true), (false)) s(chosen) on true
  left join ordered using (pair_id, chosen)),
differing as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, min(coalesce(c.n, r.n)) as n
  from (select * from ordered where chosen) c
  full join (select * from ordered where not chosen) r
    on c.pair_id = r.pair_id and c.n = r.n and c.role = r.role and c.text = r.text
  where c.pair_id is null or r.pair_id is null
  group by 1),
cut as (
  select pair_id, coalesce(d.n - 1, (select max(n) from ordered o where o.pair_id = p.pair_id)) as n_prompt
  from pairs p left join differing d using (pair_id)),
pieces as (
  select pair_id, chosen, n, role, n_prompt,
         '<|im_start|>' || role || chr(10) as head, text || '<|im_end|>' || chr(10) as tail
  from sides join cut using (pair_id) where n is not null),
placed as (
  select *, coalesce(sum(length(head) + length(tail)) over (
              partition by pair_id, chosen, n > n_prompt order by n rows between unbounded preceding and 1 preceding), 0) as pos
  from pieces)
select pair_id, any_value(n_prompt)::bigint as n_prompt_turns,
  coalesce(string_agg(head || tail, '' order by n) filter (chosen and n <= n_prompt), '') as prompt,
  coalesce(string_agg(head || tail, '' order by n) filter (chosen and n > n_prompt), '') as chosen,
  coalesce(string_agg((pos + length(head))::bigint || ':' || (pos + length(head) + length(tail))::bigint, ',' order by n)
           filter (chosen and n > n_prompt and role = 'assistant'), '') as chosen_mask,
  coalesce(string_agg(head || tail, '' order by n) filter (not chosen and n > n_prompt), '') as rejected,
  coalesce(string_agg((pos + length(head))::bigint || ':' || (pos + length(head) + length(tail))::bigint, ',' order by n)
           filter (not chosen and n > n_prompt and role = 'assistant'), '') as rejected_mask
from placed group by pair_id
""",
    "op12_prefix_trie": f"""
with ordered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n
  from conversations where conv_id is not null),
own as (select conv_id, list({{'r': role, 't': text}} order by n) as turns from ordered group by conv_id),
rule as (select conv_id, turns, {crc32_sql("conv_id::varchar")} % 4 as h, conv_id - conv_id % 20 as base from own),
rebuilt as (
  select a.conv_id, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) as turns
  from rule a left join own b on b.conv_id = a.base),
steps as (
  select conv_id, d as depth, len(turns) as size, sha256(to_json(turns[1:d])::varchar) as key,
         sha256(to_json(turns[1:d - 1])::varchar) as up,
         case when d = 0 then 0 else len(regexp_extract_all(turns[d].t, '[^\\x20\\x09-\\x0D]+')) end as words
  from (select conv_id, turns, unnest(range(0, len(turns) + 1)) as d from rebuilt)),
nodes as (
  select key, depth, any_value(up) as up, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(words) as saved,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = size), '')) as ends_sha256
  from steps group by key, depth),
families as (
  select n.*, p.conv_id as parent, coalesce(k.n, 0) as n_children
  from nodes n left join nodes p on p.key = n.up and p.depth = n.depth - 1
  left join (select up, depth - 1 as depth, count(*) as n from nodes where depth > 0 group by all) k on k.up = n.key and k.depth = n.depth),
under as (
  select distinct a.key, a.depth, b.key as low_key, b.depth as low_depth
  from steps a join steps b on a.conv_id = b.conv_id and a.depth <= b.depth),
sums as (
  select u.key, u.depth, sum((f.n_children = 0)::int) as n_leaves, sum(f.saved) as saved_tokens
  from under u join families f on f.key = u.low_key and f.depth = u.low_depth group by u.key, u.depth)
select f.conv_id::bigint as conv_id, f.depth::bigint as depth, f.parent::bigint as parent_conv_id, f.n_convs::bigint as n_convs,
       f.n_children::bigint as n_children, s.n_leaves::bigint as n_leaves, s.saved_tokens::bigint as saved_tokens, f.ends_sha256
from families f join sums s on s.key = f.key and s.depth = f.depth
""",
    "op13_spelling_variants": f"""
with runs as (
  select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{6,}}')) as run from documents),
lowered as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from runs group by all),
hashed as (select run, times, {crc32_sql("coalesce(doc_id::varchar, '') || ':' || run")} as h from lowered),
written as (
  select case when h % 199 = 0 then run[1:(h % length(run))::int] || run[(h % length(run))::int + 2:] else run end as word, times from hashed),
vocabulary as (select word, sum(times)::bigint as n from written group by word having sum(times) >= 5 and length(word) >= 6),
shorter as (
  select word, n, place, word[1:place] || word[place + 2:] as rest
  from (select word, n, unnest(range(0, length(word)))::int as place from vocabulary)),
near as (
  select a.word, a.n, b.word as other, b.n as other_n from shorter a join shorter b on a.rest = b.rest and a.place = b.place and a.word <> b.word
  union select a.word, a.n, b.word, b.n from shorter a join vocabulary b on a.rest = b.word
  union select b.word, b.n, a.word, a.n from shorter a join vocabulary b on a.rest = b.word),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
forms as (
  select v.word, v.n, coalesce(b.n_near, 0) as n_near, case when b.other_n >= 5 * v.n then b.other end as form,
         case when b.other_n >= 5 * v.n then b.other_n end as form_n
  from vocabulary v left join best b using (word)),
chain as (
  with recursive up as (
    select word, word as root, 0 as steps from forms
    union all select u.word, f.form, u.steps + 1 from up u join forms f on f.word = u.root where f.form is not null)
  select word, first(root order by steps desc) as root from up group by word)
select word, form, root, n, n_near::bigint as n_near, form_n from forms join chain using (word)
""",
}
