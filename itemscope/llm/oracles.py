"""DuckDB SQL for the corpus queries that SQL can express."""

EXACT_DEDUP = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as sha
  from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha as text_sha256
from t window w as (partition by sha)
"""

DECONTAMINATION = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
lengths as (select distinct n from windows),
grams as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lengths where len(w) >= n)),
hits as (select doc_id, i, grams.n, item_id from grams join windows using (n, g)),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
ids as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, cast(item_id as varchar) as id from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join ids using (doc_id)
"""

SUFFIX_DEDUP = r"""
with d as (select doc_id, encode(coalesce(text, '')) as b, octet_length(b) as n from documents),
starts as (
  select doc_id, i, md5(b[i:i + 399]) as h
  from (select doc_id, b, unnest(range(1, n - 398)) as i from d where n >= 400)),
hits as (
  select doc_id, i from starts join (select h from starts group by h having count(*) > 1) using (h)),
runs as (
  select doc_id, i, sum(cast(fresh as int)) over (partition by doc_id order by i) as run
  from (select doc_id, i, coalesce(i > lag(i) over (partition by doc_id order by i) + 400, true) as fresh
        from hits)),
spans as (select doc_id, run, min(i) as a, max(i) + 399 as z from runs group by doc_id, run),
kept as (
  select doc_id, lead(a, 1, n + 1) over w as until, z + 1 as begin
  from (select doc_id, a, z from spans union all select doc_id, 0, 0 from d) join d using (doc_id)
  window w as (partition by doc_id order by a)),
texts as (
  select doc_id, string_agg(case when until > begin then hex(b[begin:until - 1]) else '' end, ''
                            order by begin) as t
  from kept join d using (doc_id) group by doc_id),
sizes as (select doc_id, sum(z - a + 1) as removed, count(*) as runs from spans group by doc_id)
select d.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed,
       coalesce(runs, 0) as n_spans, sha256(unhex(t)) as kept_sha256
from d join texts using (doc_id) left join sizes using (doc_id)
"""



def _repair():
    """The repair as a walk over the rows that keeps the least 'cost, audit' text of each state."""
    def add(weight, cost, letter):
        return (f"(lpad(cast(cast({weight}[1:9] as int) + {cost} as varchar), 9, '0') || {weight}[10:]"
                f" || '{letter}')")
    more, open_ = "(case when f[i] = 3 then 1 else 0 end)", "f[i] not in (1, 2)"
    ready = "least(v0, v1, v3)"
    inserted = """
    select *, w0 as v0, w1 as v1, least(w2, i2, {j2}) as v2, least(w3, i3, {j3}) as v3
    from (select *, {i2} as i2, {i3} as i3 from {{0}})""".format(
        i2=add("least(w0, w1, w3)", 2, "I"), i3=add("w2", 2, "I"), j2=add("i3", 2, "I"), j3=add("i2", 2, "I"))
    step = f"""
    select conv_id, r, f, i + 1 as i, {add('v0', 3, 'D')} as w0,
           least({add('v1', 3, 'D')}, case when {open_} and r[i] = 's' then {add('v0', more, 'K')} end) as w1,
           least({add('v2', 3, 'D')}, case when {open_} then {add(ready, f'2 + {more}', 'R')} end,
                 case when {open_} and r[i] = 'u' then {add(ready, more, 'K')} end) as w2,
           least({add('v3', 3, 'D')}, case when {open_} then {add('v2', f'2 + {more}', 'R')} end,
                 case when {open_} and r[i] = 'a' then {add('v2', more, 'K')} end) as w3
    from ({inserted.format("walk")}) where i <= len(r)"""
    return rf"""
with recursive crc(t) as (
  select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: case when c % 2 = 1 then xor(3988292384, c >> 1) else c >> 1 end))),
keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations),
numbered as (
  select *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''),
         lambda x: cast(ascii(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 as d
  from keyed, crc),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
         case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when d = 3 then 2 else 1 end)) as copy
  from numbered where d <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))[-1:] as final from damaged),
rows as (
  select *, case when final = '' then 1
                 when row_number() over (partition by conv_id, role, text order by place) > 1 then 2
                 when final not in ('.', '!', '?') then 3 else 0 end as fault,
         lag(role[1:1]) over (partition by conv_id order by place) || role[1:1] as pair
  from placed),
talks as (
  select conv_id, list(role[1:1] order by place) as r, list(fault order by place) as f,
         coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate,
         count(*) filter (fault = 3) as truncated,
         count(*) filter (pair not in ('su', 'ua', 'au')) as illegal
  from rows group by conv_id),
walk(conv_id, r, f, i, w0, w1, w2, w3) as (
    select conv_id, r, f, 1, '000000000', cast(null as varchar), cast(null as varchar), cast(null as varchar)
    from talks
    union all {step}),
ended as (
  select conv_id, r, least(v0, v3) as w
  from ({inserted.format("(select * from walk where i > len(r))")})),
letters as (
  select conv_id, r, w, k, w[9 + k:9 + k] as c, length(replace(w[10:9 + k], 'I', '')) as place,
         length(replace(w[10:9 + k], 'D', '')) as j
  from (select conv_id, r, w, unnest(range(1, length(w) - 8)) as k from ended)),
turns as (
  select l.conv_id, k, c, rows.role, rows.text,
         j - max(case when j = 1 and c = 'K' and r[l.place] = 's' then 1 else 0 end) over (partition by l.conv_id)
           as j
  from letters l left join rows on l.conv_id is not distinct from rows.conv_id and l.place = rows.place
                 and c <> 'I' where c <> 'D'),
texts as (
  select conv_id, string_agg(case when c = 'K' then role when j % 2 = 1 then 'user' else 'assistant' end
         || ':' || case when c = 'I' then '' else text end, chr(10) order by k) as t
  from (select conv_id, k, c, role, text, j from turns) group by conv_id),
ids as (select distinct conv_id from conversations)
select ids.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank,
       coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(w[1:9], '0') as bigint) as cost,
       coalesce(w[10:], '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from ids left join talks on ids.conv_id is not distinct from talks.conv_id
left join ended on ids.conv_id is not distinct from ended.conv_id
left join texts on ids.conv_id is not distinct from texts.conv_id
"""


# Positions of matches as in the query: lengths of the texts between and of the matches.
_PATTERNS = [
    ("assign", r"(?i)(?:password|passwd|secret|token|api_?key)[\x22']?\x20*[:=]\x20*[\x22']?"
               r"([A-Za-z0-9+/_.=-]+)", "length(v) >= 6", 1),
    ("access", r"AKIA[A-Z0-9]+", "length(v) >= 20", 0),
    ("hex", r"[0-9a-f]+", "length(v) >= 24", 0),
    ("opaque", r"[A-Za-z0-9+/_-]{24,}={0,2}", "regexp_matches(v, '[A-Z]') and "
     "regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9].*[0-9]')", 0)]


def _kind(number, name, pattern, test, group):
    pattern = pattern.replace("'", "''")
    return f"""
  select doc_id, owner, {number} as kind, '{name}' as name, v,
         cast(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
              + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) as a,
         a + length(m[i]) as z
  from (select doc_id, owner, m, gaps, i, vs[i] as v from (
          select doc_id, owner, m, gaps, vs, unnest(range(1, len(m) + 1)) as i from (
            select doc_id, source as owner,
                   regexp_extract_all(coalesce(text, ''), '{pattern}', 0) as m,
                   regexp_extract_all(coalesce(text, ''), '{pattern}', {group}) as vs,
                   regexp_split_to_array(coalesce(text, ''), '{pattern}') as gaps
            from documents)))
  where {test}"""


SECRETS = "with found as (" + "\n  union all".join(
    _kind(i, *p) for i, p in enumerate(_PATTERNS)) + r"""),
owned as (select v, count(distinct coalesce(owner, '<none>')) as owners from found group by v),
spans as (select found.*, owners >= 3 as copied from found join owned using (v)),
kept as (
  select * from spans s where kind < 3 or not copied and not exists (
    select 1 from spans b where b.doc_id = s.doc_id and b.kind < 3 and b.a < s.z and s.a < b.z)),
per_doc as (
  select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access,
         count(*) filter (kind = 2) as n_hex,
         string_agg(name || ':' || a || ':' || z, ',' order by a, kind) filter (kind < 3) as base,
         string_agg(name || ':' || a || ':' || z, ',' order by a, kind) as spans,
         count(*) filter (not copied) as n_live, count(*) filter (copied) as n_copied
  from kept group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
       coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
       coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from documents left join per_doc using (doc_id)
"""


def all_sql():
    return {"op7_decontamination": DECONTAMINATION, "op8_exact_dedup": EXACT_DEDUP,
            "op10_secret_scan": SECRETS, "op12_conversation_repair": _repair(),
            "op13_suffix_dedup": SUFFIX_DEDUP}
