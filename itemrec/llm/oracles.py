"""Comparison SQL of the training-data queries, where SQL can say what they return."""

_SPACE = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STRIP = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with d as (
    select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (
    select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as i from d),
k as (
    select *, translate(trim(line, {_STRIP}), '{_UPPER}', '{_LOWER}') as key from l),
common as (
    select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
    select k.*, c.key is not null and k.doc_id <> c.keeper as dropped from k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by r, doc_id
"""

QUALITY_RULES = f"""
with d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, coalesce(source, '') as host from documents),
w as materialized (
    select *, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: x <> '') as words,
           list_filter(string_split(text, chr(10)), lambda x: trim(x, {_STRIP}) <> '') as lines from d),
windows as (
    select r, i, array_to_string(words[i:i + 4], ' ') as key
    from (select r, words, unnest(range(1, len(words) - 3)) as i from w) x),
repeated as (
    select r, count(distinct p) as n from (
        select r, unnest(range(i, i + 5)) as p
        from (select r, i, count(*) over (partition by r, key) as times from windows) y where times > 1) z
    group by r),
l as materialized (
    select r, host, array_to_string(ws, ' ') as line, sum(len(ws)) as words,
           any_value(list_min(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' ')))) as first from (
        select r, host, list_filter(string_split_regex(translate(unnest(lines), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') as ws from w) x
    group by r, host, line),
least as (select r, list(first order by first) as firsts from l group by r),
chosen as (select host, text, min(r) as r from d group by all),
beside as (
    select host, line, case when first = firsts[1] then coalesce(firsts[2], '') else firsts[1] end as beside, count(*) as texts
    from l join chosen using (host, r) join least using (r) group by all),
frequent as (select host, line from beside group by host, line having count(*) >= 10 and 2 * count(*) >= sum(texts)),
gone as (select r, sum(words) as n from l join frequent using (host, line) group by r)
select doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars,
       length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
       len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words,
       len(words) < 10 or 100 * coalesce(repeated.n, 0) > 20 * len(words) as base_failed,
       cast(coalesce(gone.n, 0) as bigint) as n_frequent_words, len(words) - coalesce(gone.n, 0) < 0.5 * len(words) as depleted,
       not (len(words) < 10 or 100 * coalesce(repeated.n, 0) > 20 * len(words) or len(words) - coalesce(gone.n, 0) < 0.5 * len(words)) as kept
from w left join repeated using (r) left join gone using (r)
"""

_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
DECONTAMINATION = f"""
with d as materialized (select row_number() over () as r, doc_id, {_WORDS} as words from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as words from benchmark),
windows as materialized (
    select item, least(len(words), 13) as size, unnest(list_transform(range(1, greatest(len(words) - 12, 1) + 1), lambda i: array_to_string(words[i:i + 12], ' '))) as key
    from b where len(words) > 0),
sizes as (select distinct size from windows),
places as (
    select r, size, i, array_to_string(words[i:i + size - 1], ' ') as key
    from (select r, words, size, unnest(range(1, len(words) - size + 2)) as i from d, sizes where len(words) >= size) x),
hits as materialized (select r, i, size, item from places join windows using (size, key)),
spans as (select distinct r, i, size from hits),
words_hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + size)) as p from spans) x group by r),
items as (select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) x group by r)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) as contaminated
from d left join words_hit using (r) left join items using (r)
"""

HISTOGRAM_SORT = r"""
with crc as (
    select list_transform(range(256), lambda n: list_reduce(list_concat([cast(n as bigint)], list_transform(range(8), lambda k: cast(k as bigint))),
           lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as (
    select row_number() over () as r, doc_id, coalesce(text, '') as text, strlen(coalesce(text, '')) + 16 as size, md5(coalesce(text, '')) as m from documents),
k as (
    select *, cast('0x' || m[1:15] as bigint) as k1, cast('0x' || m[16:30] as bigint) as k2 from d),
n as (
    select *, sum(size) over () as total,
           coalesce(sum(size) over (order by k1, doc_id nulls first, k2, r rows between unbounded preceding and 1 preceding), 0) as before from k),
s as (
    select *, cast(before * 40 // total as integer) as shard from n)
select doc_id, cast(size as bigint) as size,
       xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(range(strlen(text)), lambda i: cast('0x' || hex(encode(text))[2 * i + 1:2 * i + 2] as bigint))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as text_crc32,
       'bytes' as law, shard, row_number() over (partition by shard order by k1, doc_id nulls first, k2, r) - 1 as slot, cast(null as integer) as grown_shard
from s, crc
"""

_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')"
CHAT_WINDOWS = rf"""
with t as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
n as (
    select *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 as tokens,
           row_number() over (partition by conv_id order by turn nulls first, role, text) as n,
           length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + 8 as chars from t),
p as (
    select *, coalesce(max(case when n = 1 and role = 'system' then tokens end) over (partition by conv_id), 0) as sys,
           coalesce(max(case when n = 1 and role = 'system' then chars end) over (partition by conv_id), 0) as sys_chars,
           sum(tokens) over (partition by conv_id order by n) as upto from n),
c as (
    select *, upto - sys as stop, upto - sys - tokens as start, greatest(1, 768 - sys) as step, n = 1 and sys > 0 as head from p),
w as (
    select *, 2 * (start // step) + case when (stop - 1) // step > start // step then 1 else 0 end as win from c where not head),
opened as (select conv_id, win, min(start) as opens from w group by all),
repeated as (
    select w.conv_id, sum(chars) as chars from w join opened o on w.conv_id is not distinct from o.conv_id
    where w.tokens <= 256 and w.stop <= o.opens and o.opens <= w.start + 256 group by all),
heads as (
    select c.conv_id, max(sys_chars) * greatest(1, (select count(*) from opened o where o.conv_id is not distinct from c.conv_id)) as chars from c where head group by c.conv_id)
select c.conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(coalesce(sum(chars) filter (where not head), 0)
            + coalesce((select chars from repeated r where r.conv_id is not distinct from c.conv_id), 0)
            + coalesce((select chars from heads h where h.conv_id is not distinct from c.conv_id), 0) as bigint) as formatted_chars
from c group by c.conv_id
"""

#: Levels of eight-way nodes that the SQL below is written out for, in a language and above: 8 ** 8 documents, 512 languages.
_OWN_LEVELS, _TOP_LEVELS = 8, 3


def _level(k: int, nodes: str, path: str, tree: str) -> str:
    """Nodes one level up and what the path of each document passes there."""
    same = f"{path}{k}.{tree} is not distinct from n.{tree}"
    return f"""
{nodes}r{k} as materialized (select {tree}, i // 8 as i, list(h order by i) as hs from {nodes}{k} group by all),
{nodes}c{k} as (select {tree}, count(*) as c from {nodes}{k} group by all),
{nodes}s{k} as materialized (select r.{tree}, r.i, hs, c from {nodes}r{k} r join {nodes}c{k} c on r.{tree} is not distinct from c.{tree}),
{nodes}{k + 1} as materialized (select {tree}, i, case when c = 1 then hs[1] else sha256(array_to_string(hs, '')) end as h from {nodes}s{k}),
{path}{k + 1} as materialized (
    select {path}{k}.* exclude (i, f, sib), {path}{k}.i // 8 as i,
           case when c = 1 then f else sha256(array_to_string(list_concat(hs[:{path}{k}.i % 8], [f], hs[{path}{k}.i % 8 + 2:]), '')) end as f,
           case when c = 1 then sib else sib || array_to_string(list_concat(hs[:{path}{k}.i % 8], hs[{path}{k}.i % 8 + 2:]), '') end as sib
    from {path}{k} join {nodes}s{k} n on {same} and {path}{k}.i // 8 = n.i),"""


_FIELD = "coalesce(strlen(cast({0} as varchar)) || ':' || cast({0} as varchar), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || " + _FIELD + ")"
MERKLE_MANIFEST = rf"""
with crc as (
    select list_transform(range(256), lambda n: list_reduce(list_concat([cast(n as bigint)], list_transform(range(8), lambda k: cast(k as bigint))),
           lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
d as materialized (
    select lang, doc_id, {_LEAF.format("text")} as leaf, {_LEAF.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} as lowered,
           xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(range(length(coalesce(cast(doc_id as varchar), ''))), lambda i: cast(ord(cast(doc_id as varchar)[i + 1]) as bigint))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 as tampered
    from documents, crc),
p0 as materialized (
    select lang, doc_id, leaf, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, case when tampered then lowered else leaf end as f, '' as sib from d),
n0 as (select lang, i, leaf as h from p0),{"".join(_level(k, "n", "p", "lang") for k in range(_OWN_LEVELS))}
m0 as materialized (select true as whole, lang, row_number() over (order by lang nulls first) - 1 as i, h from n{_OWN_LEVELS}),
q0 as materialized (
    select true as whole, p.doc_id, p.leaf, m0.h as subroot, m0.i, f, sib from p{_OWN_LEVELS} p join m0 on p.lang is not distinct from m0.lang),{"".join(_level(k, "m", "q", "whole") for k in range(_TOP_LEVELS))}
top as (select h as root from m{_TOP_LEVELS})
select doc_id, leaf, subroot, root, sha256(sib) as proof_sha256, f as folded_root, f = root as verified from q{_TOP_LEVELS}, top
"""
