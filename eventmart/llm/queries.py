"""Registered queries of the training-data operators, next to their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (
    binary_tokens, conversation_repair, embedding_dedup, fingerprints, language, language_model, mixing, near_dedup, packing,
    personal_data, phrase_index, spelling, substring_dedup,
)
from .common import id_crc

QUERIES: dict = {}
SQL: dict[str, str] = {}

CAPACITY = 2048


def query(key: str, sql: str | None = None):
    def register(function):
        QUERIES[key] = function
        if sql is not None:
            SQL[key] = sql.strip()
        return function

    return register


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




@query("op7_binary_tokens")
def binary_tokens_query(spark, sf_dir):
    manifest = binary_tokens.write_tokens(
        table(spark, sf_dir, "documents"), binary_tokens.token_folder(spark), public_tokenizers.path("word_bpe_49k.json"), 2
    )
    return binary_tokens.read_tokens(spark, manifest).drop("ids")


@query("op9_best_fit_packing")
def packing_query(spark, sf_dir):
    parts = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, CAPACITY)
    return packing.pack(parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


@query("op5_language_id")
def language_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs, language.learn(docs))
    return found.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "lang_pred", "score")


@query("op3_document_fingerprints")
def fingerprint_query(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query(
    "op4_poisson_mixing",
    """
with sizes as (
  select source, sum(coalesce(length(text), 0) + 1)::double as size from documents group by 1
), rates as (
  select source, (1.0::double / (select count(*) from sizes)) * (select sum(size) from sizes) / size as rate from sizes
), rated as (
  select source, greatest(1, ceil(rate / 1024))::bigint as blocks, rate / greatest(1, ceil(rate / 1024)) as mean from rates
), terms as (
  select source, mean, k, -mean + sum(case when k = 0 then 0 else ln(mean / greatest(k, 1)) end) over (partition by source order by k) as l
  from rated, unnest(range(0, (ceil(mean + 12 * sqrt(mean)) + 31)::bigint)) as t(k)
), cdf as (
  select source, k, sum(exp(l)) over (partition by source order by k) as c from terms
), numbered as (
  select *, row_number() over () as r from documents
), drawn as (
  select d.*, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|copies' || case when b = 1 then '' else '|' || b end), 1, 15))::bigint / 1152921504606846976::double as u
  from numbered d join rated on rated.source is not distinct from d.source, unnest(range(1, blocks + 1)) as t(b)
), parts as (
  select *, (select count(*) from cdf where cdf.source is not distinct from drawn.source and c <= u) as n from drawn
), counted as (
  select any_value(doc_id) as doc_id, any_value(source) as source, any_value(text) as text, any_value(n_chars) as n_chars, any_value(lang) as lang, sum(n)::bigint as n from parts group by r
)
select doc_id, text, lang, source, n_chars, copy::int as copy,
       ('0x' || substr(md5('mix-1|' || coalesce(doc_id::varchar, '') || '|' || copy), 1, 15))::bigint as shuffle_key
from counted, unnest(range(1, n + 1)) as t(copy)
""",
)
def mixing_query(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query(
    "op1_minhash_near_dedup",
    r"""
with recursive parts as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select doc_id, unnest(case when len(w) < 2 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) as s
  from parts
), sizes as (
  select doc_id, count(*) as n from shingles group by 1
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), near as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), links as (
  select a, b from near union all select b, a from near
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), lowest as (
  select a, min(b) as b from reach group by a
)
select doc_id, coalesce(sizes.n, 0) as n_shingles, least(doc_id, coalesce(lowest.b, doc_id)) as component_id,
       doc_id <= coalesce(lowest.b, doc_id) as kept
from parts left join sizes using (doc_id) left join lowest on lowest.a = doc_id
""",
)
def near_dedup_query(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


@query(
    "op2_embedding_near_dedup",
    """
with recursive good as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95
), reach(a, b) as (
  select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a
), lowest as (
  select a, min(b) as b from reach group by a
)
select e.vec_id, (select count(*) from links where links.a = e.vec_id) as n_links,
       least(e.vec_id, coalesce(lowest.b, e.vec_id)) as component_id, e.vec_id <= coalesce(lowest.b, e.vec_id) as kept
from embeddings e left join lowest on lowest.a = e.vec_id
""",
)
def embedding_query(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query("op6_contextual_pii")
def personal_data_query(spark, sf_dir):
    return personal_data.find(table(spark, sf_dir, "documents"))


@query("op8_ngram_scoring")
def language_model_query(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op10_suffix_dedup")
def suffix_query(spark, sf_dir):
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 100)
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


@query(
    "op11_spelling_variants",
    r"""
with recursive steps as (
  select list_transform(range(256), lambda c: list_reduce([c] || range(8)::bigint[],
    lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
), runs as (
  select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) as run from documents
), counted as (
  select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n from runs group by 1, 2
), hashed as (
  select run, n, xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(id || ':' || run))),
      lambda i: ('0x' || substr(hex(id || ':' || run), 2 * i + 1, 2))::bigint),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::bigint) as h
  from counted, steps
), words as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, sum(n)::bigint as n
  from hashed group by 1 having length(word) >= 5 and sum(n) >= 3
), shorter as (
  select word, n, unnest(list_transform(range(length(word)), lambda i: {'at': i, 'rest': substr(word, 1, i) || substr(word, i + 2)}), recursive := true) from words
), near as (
  select distinct a.word, b.word as near, b.n from shorter a join shorter b on a.rest = b.rest and a.at = b.at and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word
), best as (
  select word, count(*) as n_near, arg_min(near, (-n, near)) as near, max(n) as near_n from near group by 1
), formed as (
  select word, words.n, coalesce(n_near, 0) as n_near, case when near_n >= 2 * words.n then near end as form,
         case when near_n >= 2 * words.n then near_n end as form_n
  from words left join best using (word)
), way(word, root) as (
  select word, word from formed union all select way.word, formed.form from way join formed on formed.word = way.root and formed.form is not null
)
select word, form, root, n, n_near, form_n from formed
join (select word, root from way join formed using (word) where not exists (select 1 from formed f where f.word = root and f.form is not null)) using (word)
""",
)
def spelling_query(spark, sf_dir):
    counts = spelling.word_counts(table(spark, sf_dir, "documents"), misspell=97)
    return spelling.variants(counts.filter((F.length("word") >= spelling.SHORTEST) & (F.col("n") >= 3)))


@query(
    "op12_benchmark_decontamination",
    r"""
with docs as (
  select row_number() over () as d, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select coalesce(item_id::varchar, '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select distinct item, len(p) as size, array_to_string(p, ' ') as phrase from (
    select item, unnest(case when len(w) = 0 then [] when len(w) < 10 then [w] else list_transform(range(1, len(w) - 8), lambda i: w[i : i + 9]) end) as p from items)
), places as (
  select d, pos, size, array_to_string(w[pos : pos + size - 1], ' ') as phrase
  from (select d, w, size, unnest(range(1, len(w) - size + 2)) as pos from docs, (select distinct size from windows))
), hits as (
  select distinct d, pos, places.size, item from places join windows using (phrase)
), hit as (
  select d, count(distinct word) as n_hit from (select d, unnest(range(pos, pos + size)) as word from hits) group by 1
), found as (
  select d, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct d, item from hits) group by 1
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (d) left join found using (d)
""",
)
def decontamination_query(spark, sf_dir):
    index = phrase_index.build_index(table(spark, sf_dir, "documents"))
    found = phrase_index.contamination(index, table(spark, sf_dir, "benchmark"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op13_conversation_repair",
    r"""
with recursive steps as (
  select list_transform(range(256), lambda c: list_reduce([c] || range(8)::bigint[],
    lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as crc
), keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations
), coded as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(key))),
      lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::bigint), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::bigint) % 20 as code
  from keyed, steps
), damaged as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from coded, range(2) as t(copy) where code <> 0 and (copy = 0 or code = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(length(role) || ':' || role || text)) as i from damaged
), seen as (
  select *, left(role, 1) as initial, right(rtrim(text, E' \t\n\x0b\x0c\r'), 1) as ending, row_number() over (partition by conv_id, role, text order by i) as copy,
         lag(role) over (partition by conv_id order by i) as role_before
  from placed
), judged as (
  select *, case when ending = '' then 'blank' when copy > 1 then 'duplicate' when ending not in ('.', '!', '?') then 'truncated' end as fault from seen
), figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, max(i) as n,
         count(*) filter (role_before is not null and left(role_before, 1) || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by 1
), inserts(place, k, after, lines) as (values
  (0, 0, 0, []::varchar[]), (0, 1, 2, ['user:']), (0, 2, 3, ['user:', 'assistant:']), (1, 0, 1, []), (1, 1, 2, ['user:']), (1, 2, 3, ['user:', 'assistant:']),
  (2, 0, 2, []), (2, 1, 3, ['assistant:']), (2, 2, 2, ['assistant:', 'user:']), (3, 0, 3, []), (3, 1, 2, ['user:']), (3, 2, 3, ['user:', 'assistant:'])
), edits(after, edit, initial, behind, cost) as (values
  (0, 'D', null, 0, 3), (1, 'D', null, 1, 3), (2, 'D', null, 2, 3), (3, 'D', null, 3, 3),
  (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0), (3, 'K', 'u', 2, 0),
  (0, 'R', null, 2, 2), (1, 'R', null, 2, 2), (2, 'R', null, 3, 2), (3, 'R', null, 2, 2)
), way as (
  select conv_id, 0::bigint as i, 0 as place, {'cost': 0::bigint, 'audit': '', 'lines': []::varchar[]} as best from figures
  union all
  select conv_id, i, behind, arg_min(best, (best.cost, best.audit)) from (
    select j.conv_id, j.i, e.behind, {
      'cost': w.best.cost + 2 * p.k + e.cost + case when e.edit <> 'D' and j.fault is not null then 1 else 0 end,
      'audit': w.best.audit || repeat('I', p.k) || e.edit,
      'lines': w.best.lines || p.lines || case e.edit when 'D' then [] when 'K' then [j.role || ':' || j.text]
                 else [case e.behind when 2 then 'user:' else 'assistant:' end || j.text] end} as best
    from way w join judged j on j.conv_id is not distinct from w.conv_id and j.i = w.i + 1
    join inserts p on p.place = w.place join edits e on e.after = p.after
    where (e.edit = 'D' or j.fault is null or j.fault = 'truncated') and (e.edit <> 'K' or e.initial = j.initial))
  group by all
), ended as (
  select w.conv_id, arg_min({
    'cost': w.best.cost + case place when 1 then 4 when 2 then 2 else 0 end, 'audit': w.best.audit || case place when 1 then 'II' when 2 then 'I' else '' end,
    'lines': w.best.lines || case place when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end},
    (w.best.cost + case place when 1 then 4 when 2 then 2 else 0 end, w.best.audit || case place when 1 then 'II' when 2 then 'I' else '' end)) as best
  from way w join figures f on f.conv_id is not distinct from w.conv_id and f.n = w.i group by 1
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, coalesce(best.cost, 0) as cost, coalesce(best.audit, '') as audit,
       sha256(coalesce(array_to_string(best.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join figures f on f.conv_id is not distinct from c.conv_id left join ended e on e.conv_id is not distinct from c.conv_id
""",
)
def conversation_query(spark, sf_dir):
    rows = conversation_repair.damaged(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(rows, F.col("present"))
