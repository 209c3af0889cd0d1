"""DuckDB SQL of the operators that SQL can express, written from their contracts."""

from __future__ import annotations

#: Shingles joined to shingles give the sizes of all intersections; a recursive query follows the links.
NEAR_DUPLICATES = r"""
with recursive texts as (
 select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
 from documents),
shingles as (
 select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
 from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (
 select a.doc_id as x, b.doc_id as y, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
 select x, y from common o join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * o.n >= 75 * (p.n + q.n - o.n)),
ends as (select x, y from links union select y, x from links),
reach(x, y) as (select x, y from ends union select r.x, e.y from reach r join ends e on r.y = e.x)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) as component_id,
 d.doc_id <= coalesce(m, d.doc_id) as kept
from documents d left join sizes s using (doc_id) left join (select x as doc_id, min(y) as m from reach group by 1) r using (doc_id)
"""

#: Whole conversations as lists: one is dropped if a longer one begins with it; of equal ones the smallest id stays.
CHATS = """
with said as (
 select *, row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as k
 from (select distinct conv_id, turn, role, text from conversations)),
talks as (select conv_id, list({'role': role, 'text': text} order by k) as turns, count(*) as n from said group by 1),
whole as (select min(conv_id) as conv_id, turns, n, count(*) as n_logged from talks group by turns, n),
kept as (
 select * from whole a
 where not exists (select 1 from whole b where b.n > a.n and b.turns[1] is not distinct from a.turns[1]
                   and b.turns[1:a.n] is not distinct from a.turns))
select conv_id, cast((k - 1) // 512 as integer) as part, cast(any_value(n) as bigint) as n_turns,
 cast(any_value(n_logged) as bigint) as n_logged,
 string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' order by k) as rendered
from said join kept using (conv_id) group by 1, 2
"""
