"""SQL that states whole results of this subpackage's queries on DuckDB."""

from __future__ import annotations

from netspark.llm.decontaminate import WINDOW
from netspark.llm.hilbert_shards import KEY, HilbertParams, automaton
from netspark.llm.merkle_manifest import FIELDS
from netspark.llm.spelling_fst import SpellingParams


def _crc_table() -> list[int]:
    """What each byte makes of an empty CRC-32 register."""
    out = list(range(256))
    for _ in range(8):
        out = [x >> 1 ^ 0xEDB88320 if x & 1 else x >> 1 for x in out]
    return out


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    codes = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    step = f"lambda c, b: xor(c >> 8, ({_crc_table()}::bigint[])[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), {step}), 4294967295::bigint)"


def merkle() -> str:
    field = lambda value: f"coalesce(octet_length(encode(({value})::varchar)) || ':' || ({value})::varchar, '-')"
    leaf = " || ".join(field(c) for c in FIELDS)
    changed = " || ".join(field("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)
    pair = "lambda k: sha256(array_to_string(nodes[2 * k + 1 : 2 * k + 2], ''))"
    sibling = "case when (p.place >> p.level) % 2 = 1 then t.nodes[p.place >> p.level] else coalesce(t.nodes[(p.place >> p.level) + 2], '') end"
    climb = f"if((p.place >> p.level) % 2 = 1, sha256({sibling} || p.now), sha256(p.now || {sibling})) as now, p.proof || {sibling} as proof, p.level + 1 as level"
    return f"""
with recursive leaves as (
  select doc_id, lang, sha256({leaf}) as leaf,
         case when {crc32('coalesce(doc_id::varchar, chr(0))')} % 7 = 0 and doc_id is not null then sha256({changed}) else sha256({leaf}) end as now
  from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from leaves),
trees as (
  select lang, 0 as level, list(leaf order by place) as nodes from placed group by lang
  union all
  select lang, level + 1, list_transform(range((len(nodes) + 1) // 2), {pair}) from trees where len(nodes) > 1),
subroots as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as place from trees where len(nodes) = 1),
tops as (
  select 0 as level, list(subroot order by place) as nodes from subroots
  union all
  select level + 1, list_transform(range((len(nodes) + 1) // 2), {pair}) from tops where len(nodes) > 1),
lower_path as (
  select doc_id, lang, leaf, place, now, '' as proof, 0 as level from placed
  union all
  select p.doc_id, p.lang, p.leaf, p.place, {climb}
  from lower_path p join trees t on p.lang is not distinct from t.lang and p.level = t.level where len(t.nodes) > 1),
climbed as (
  select p.doc_id, p.leaf, p.now, p.proof, s.subroot, s.place from lower_path p
  join subroots s on p.lang is not distinct from s.lang
  join trees t on p.lang is not distinct from t.lang and p.level = t.level where len(t.nodes) = 1),
upper_path as (
  select doc_id, leaf, subroot, place, now, proof, 0 as level from climbed
  union all
  select p.doc_id, p.leaf, p.subroot, p.place, {climb}
  from upper_path p join tops t on p.level = t.level where len(t.nodes) > 1)
select p.doc_id, p.leaf, p.subroot, t.nodes[1] as root, sha256(p.proof) as proof_sha256, p.now as folded_root, p.now = t.nodes[1] as verified
from upper_path p join tops t on p.level = t.level where len(t.nodes) = 1"""


def sharding(params: HilbertParams = HilbertParams()) -> str:
    """For the law `rows`."""
    digits, states = automaton(3)
    cells, n_states = 1 << params.bits, len(states) // 8
    corners = " + ".join(f"((({name} >> ({params.bits - 1} - k)) & 1) << {k})" for k, name in enumerate(("c_lang", "c_source", "c_size")))
    entry = f"((v % {n_states}) * 8 + l + 1)"
    curve = f"list_reduce(list_prepend(0::bigint, list_transform(range({params.bits}), lambda k: ({corners})::bigint)), lambda v, l: ((v // {n_states}) * 8 + ({digits})[{entry}]) * {n_states} + ({states})[{entry}]) // {n_states}"
    text = "coalesce(text, '')"
    return f"""
with measured as (
  select doc_id, octet_length(encode({text})) + 1 as size, {crc32(text)} as text_crc32, sha256({text}) as digest,
         coalesce('=' || left(lang, {KEY}), '') as k_lang, coalesce('=' || left(source, {KEY}), '') as k_source from documents),
{", ".join(f'''
n_{name} as (select {column} as v, count(*) as n from measured group by all),
b_{name} as (select v, (sum(n) over (order by v) - n) * {cells} // sum(n) over () as cell from n_{name}),
f_{name} as (select v, dense_rank() over (order by cell) - 1 as k, count(distinct cell) over () as all_cells from b_{name}),
x_{name} as (select v, if(all_cells < 2, 0, floor(k * {cells} / all_cells))::bigint as c_{name} from f_{name})''' for name, column in (("lang", "k_lang"), ("source", "k_source"), ("size", "size")))},
placed as (
  select doc_id, size, text_crc32, digest, {curve} as curve from measured
  join x_lang on x_lang.v = k_lang join x_source on x_source.v = k_source join x_size on x_size.v = size),
ranked as (
  select *, row_number() over (order by curve, doc_id nulls first, text_crc32, digest) - 1 as place, count(*) over () as total from placed)
select doc_id, size, text_crc32, '{params.law}' as law, (place * {params.shards} // total)::int as shard,
       place - (((place * {params.shards} // total) * total + {params.shards - 1}) // {params.shards}) as slot, null::int as grown_shard, curve from ranked"""


def spelling(params: SpellingParams = SpellingParams()) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    keyed = "(coalesce(doc_id::varchar, '') || ':' || run)"
    return f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-zÀ-ÿ]+')) as run from documents),
counted as (select doc_id, run, count(*) as n from runs where length(run) >= {params.least_length} group by all),
hashed as (select run, n, {crc32(keyed)} as h from counted),
damaged as (
  select n, if(h % {params.damage} = 0, left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2), run) as word from hashed),
words as (
  select word, sum(n)::bigint as n from damaged where length(word) >= {params.least_length} group by word having sum(n) >= {params.least_count}),
cuts as (
  select word, n, place, left(word, place::int) || substr(word, place::int + 2) as rest from (select word, n, unnest(range(length(word))) as place from words)),
near as (
  select a.word, b.word as other, b.n from cuts a join cuts b on a.place = b.place and a.rest = b.rest and a.word <> b.word
  union all
  select distinct a.word, b.word, b.n from cuts a join words b on a.rest = b.word
  union all
  select distinct b.word, a.word, a.n from cuts a join words b on a.rest = b.word),
best as (select word, count(*) as n_near, max(n) as best_n, arg_min(other, (-n, other)) as best from near group by word),
forms as (
  select w.word, if(best_n >= {params.ratio} * w.n, best, null) as form, w.n, coalesce(n_near, 0) as n_near, if(best_n >= {params.ratio} * w.n, best_n, null) as form_n
  from words w left join best b on w.word = b.word),
ways as (
  select word, word as at from forms
  union all
  select ways.word, forms.form from ways join forms on ways.at = forms.word where forms.form is not null)
select f.word, f.form, ways.at as root, f.n, f.n_near, f.form_n
from forms f join ways on f.word = ways.word join forms g on g.word = ways.at and g.form is null"""


def decontamination(window: int = WINDOW) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w"
    return f"""
with sized as (
  select *, least(len(w), {window}) as k from (select row_number() over () as b, item_id::varchar as item, {words} from benchmark) where len(w) > 0),
item_places as (
  select b, item, k, i, array_to_string(w[i + 1 : i + k], ' ') as t from (select *, unnest(range(len(w) - k + 1)) as i from sized)),
docs as (select row_number() over () as r, doc_id, {words} from documents),
doc_places as (
  select r, k, j, array_to_string(w[j + 1 : j + k], ' ') as t
  from (select r, w, k, unnest(range(greatest(len(w) - k + 1, 0))) as j from docs, (select distinct k from sized))),
hits as (select r, b, item, k, i, j, j - i as diagonal from doc_places join item_places using (k, t)),
runs as (select *, j - row_number() over (partition by r, b, diagonal order by j) as run from hits),
found as (
  select distinct r, item, min(j) as j, min(i) as i, max(j) - min(j) + k as n from runs group by r, b, item, k, diagonal, run),
told as (
  select r, count(distinct item) as n_items, list_sort(list(distinct item) filter (where item is not null)) as items, max(n) as longest,
         string_agg(concat(coalesce(item, ''), ':', j, ':', i, ':', n), ',' order by j, coalesce(item, ''), i, n) as matches
  from found group by r),
covered as (select r, count(distinct place) as n_hit from (select r, unnest(range(j, j + n)) as place from found) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
       n_hit is not null as contaminated, coalesce(longest, 0) as longest, coalesce(matches, '') as matches
from docs left join told using (r) left join covered using (r)"""


CHECKS = {
    "op5_decontamination": decontamination(),
    "op11_spelling_variants": spelling(),
    "op12_merkle_manifest": merkle(),
    "op13_hilbert_sharding": sharding(),
}
