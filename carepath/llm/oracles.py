"""The same results in DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

#: crc32 of UTF-8 bytes with the reflected polynomial 0xEDB88320, from its definition
CRC = """
crc_table as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) order by i) as t
  from range(256) r(i)
),
"""


def crc32(text: str) -> str:
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
        "lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"
    )


def uniform(text: str) -> str:
    return f"((('0x' || substr(md5({text}), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0"


def _choice(key: str, path: str, children: list[tuple[int, float]]) -> str:
    draws = ", ".join(
        "{'draw': -ln(" + uniform(f"{key} || '/{path}{name}'") + f") / {float(weight)}, 'child': {name}}}" for name, weight in children
    )
    return f"list_min([{draws}])['child']" if len(children) > 1 else str(children[0][0])


def _placed(shards: int) -> list[tuple[int, int, int]]:
    return [(s // 12, s // 4 % 3, s) for s in range(shards)]


def _shard(key: str, leaves: list[tuple[int, int, int]]) -> str:
    regions = sorted({r for r, _, _ in leaves})
    region = _choice(key, "", [(r, sum(x[0] == r for x in leaves)) for r in regions])
    cases = []
    for r in regions:
        racks = sorted({k for q, k, _ in leaves if q == r})
        rack = _choice(key, f"{r}.", [(k, sum(x[:2] == (r, k) for x in leaves)) for k in racks])
        inner = " ".join(f"when {k} then " + _choice(key, f"{r}.{k}.", [(s, 1) for q, j, s in leaves if (q, j) == (r, k)]) for k in racks)
        cases.append(f"when {r} then case {rack} {inner} end")
    return f"case {region} {' '.join(cases)} end"


def sharding_sql(shards: int = 24, cells: int = 4096) -> str:
    key = "coalesce(doc_id::varchar, '')"
    leaves = _placed(shards)
    return f"""
with {CRC} facts as (
  select doc_id, strlen(coalesce(text, '')) + 8 as size, {crc32("coalesce(text, '')")} as text_crc32 from documents, crc_table
), placed as (
  select *, {_shard(key, leaves)}::int as shard,
    {_shard(key, [*leaves, (max(x[0] for x in leaves) + 1, 0, shards)])}::int as grown_shard,
    floor({uniform(f"{key} || '/' || size || '/' || text_crc32 || '/slot'")} * {cells}) as cell
  from facts
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard,
  row_number() over (partition by shard order by cell, doc_id, size, text_crc32) - 1 as slot, grown_shard,
  (shard // 12)::int as region, (shard // 4 % 3)::int as rack
from placed
"""


MIXING = f"""
with scored as (
  select doc_id, source, md5(coalesce(text, '')) as mark,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    0.1::double + 0.9::double * (1.0::double - (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '0123456789#*$%&|<>!=+_{{}}[]~^@\\/', '')))::double
      / greatest(length(coalesce(text, '')), 1)::double) as weight
  from documents
), keyed as (
  select *, -ln({uniform("coalesce(doc_id::varchar, '') || '/' || mark || '/mix'")}) / weight as key from scored
), sizes as (
  select source, sum(size)::bigint as source_size from keyed group by source
), listed as (
  select *, [3, 1, 2][((row_number() over (order by source asc nulls last) - 1) % 3 + 1)::int] as w,
    row_number() over (order by source asc nulls last) as place, 2.0::double * source_size as cap, 1.5::double * (sum(source_size) over ())::bigint as budget from sizes
), levels as (
  select *, (budget - coalesce(sum(cap) over (order by cap / w, place rows between unbounded preceding and 1 preceding), 0.0))
    / (sum(w) over (order by cap / w, place rows between current row and unbounded following))::bigint as level from listed
), goals as (
  select source, source_size, least(cap, coalesce((max(level) filter (level <= cap / w) over ()) * w, cap)) as target from levels
), epochs as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from goals
), ordered as (
  select k.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size as rest,
    coalesce(sum(size) over (partition by k.source order by key, doc_id, mark rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from keyed k join epochs e on k.source is not distinct from e.source
)
select doc_id, size, source, source_size, target, (size * times)::bigint as taken, times as epochs_taken from (
  select *, whole + case when size > 0 and rest > 0 and start < rest and floor((rest - start) / size + 0.5) >= 1 then 1
    when size = 0 and rest > 0 and start < rest then 1 else 0 end as times from ordered)
"""


SECRETS = r"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
rules(kind, rank, pattern, part, least) as (values
  ('assign', 0, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  ('access', 1, 'AKIA[A-Z0-9]+', 0, 20),
  ('hex', 2, '[0-9a-f]+', 0, 24),
  ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----', 0, 1),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', 0, 40)),
matched as (
  select doc_id, 'assign' as kind, 0 as rank, 6 as least, regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') as hits,
    regexp_extract_all(text, '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) as parts,
    regexp_split_to_array(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') as gaps from texts
  union all select doc_id, 'access', 1, 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') from texts
  union all select doc_id, 'hex', 2, 24, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_split_to_array(text, '[0-9a-f]+') from texts
  union all select doc_id, 'pem', 3, 1, regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_extract_all(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'), regexp_split_to_array(text, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----') from texts
  union all select doc_id, 'jwt', 4, 40, regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+'), regexp_extract_all(text, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+'), regexp_split_to_array(text, 'eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+') from texts
), placed as (
  select doc_id, kind, rank, least, unnest(hits) as hit, unnest(parts) as part, unnest(gaps[1:len(hits)]) as gap, generate_subscripts(hits, 1) as i from matched where len(hits) > 0
), summed as (
  select *, sum(length(gap) + length(hit)) over (partition by doc_id, kind order by i)::bigint as stop from placed
), spans as (
  select doc_id, kind, rank, stop - length(hit) as start, stop from summed where length(part) >= least
), listed as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3), '') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from spans group by doc_id
)
select t.doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access, coalesce(n_hex, 0)::bigint as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, sha256(t.text) as blob
from texts t left join listed l on t.doc_id = l.doc_id
"""


CHAT = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, 6 + 1 + 1 + length(replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g')) + 1 + 8
    + case when contains(text, '</turn>') or contains(text, '<turn:')
      then length(replace(replace(replace(text, '\', '\s'), '</turn>', '\l/turn>'), '<turn:', '\lturn:')) else length(text) end as chars
  from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""


def repair_sql() -> str:
    """The parser as a fold over the turns of a conversation; a stack is a cost and an audit, and tops are four fields."""
    best = lambda *stacks: f"list_min([{', '.join(stacks)}])"  # noqa: E731
    step = lambda stack, letter, cost: f"{{'c': {stack}['c'] + {cost}, 'a': {stack}['a'] || '{letter}'}}"  # noqa: E731
    none = "{'c': 1000000000::bigint, 'a': 'Z'}"
    inserted = lambda s: (  # noqa: E731
        f"{s}[1], {s}[2], " + best(f"{s}[3]", *(step(f"{s}[{i}]", "I", 3) for i in (1, 2, 4))) + f", {s}[4]"
    )
    answered = lambda s: f"{s}[1], {s}[2], {s}[3], " + best(f"{s}[4]", step(f"{s}[3]", "I", 3))  # noqa: E731
    pair = best("s[1]", "s[2]", "s[4]")
    kept = lambda stack, initial: f"case when x.k = '{initial}' then {step(stack, 'K', 'x.late')} else {none} end"  # noqa: E731
    free = lambda stacks: f"case when x.k = '-' then {none} else {stacks} end"  # noqa: E731
    moved = ", ".join(
        [
            step("s[1]", "D", 4),
            best(step("s[2]", "D", 4), kept("s[1]", "s")),
            best(step("s[3]", "D", 4), kept(pair, "u"), free(step(pair, "R", "3 + x.late"))),
            best(step("s[4]", "D", 4), kept("s[3]", "a"), free(step("s[3]", "R", "3 + x.late"))),
        ]
    )
    word = "[^\\x20\\x09-\\x0D]"
    return f"""
with recursive {CRC} filled as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as draw
  from conversations, crc_table
), damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case when draw = 1 then '' when draw = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from filled, range(2) copy(i) where draw <> 0 and (i = 0 or draw = 3)
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by turn nulls first) as repeat from damaged
), faulty as (
  select *, case when not regexp_matches(text, '{word}') then 'blank' when repeat > 1 then 'duplicate'
      when list_last(regexp_extract_all(text, '{word}')) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    row_number() over (partition by conv_id order by turn nulls first, role, text, repeat) as i,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, repeat) as before
  from seen
), listed as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal,
    list({{'k': case when fault in ('blank', 'duplicate') then '-' when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else '' end,
      'late': case when fault = 'truncated' then 3 else 0 end}} order by i) as xs, count(*) as n
  from faulty group by conv_id
), parsed as (
  select conv_id, 0 as i, [{{'c': 0::bigint, 'a': ''}}, {none}, {none}, {none}] as s from listed
  union all
  select conv_id, i + 1, [{moved}] from (
    select p.conv_id, p.i, l.xs[p.i + 1] as x, [{answered('t')}] as s
    from (select *, [{inserted('s')}] as t from parsed) p join listed l on p.conv_id is not distinct from l.conv_id where p.i < l.n
  )
), ended as (
  select conv_id, i, {best('t[1]', 't[4]')} as found from (select conv_id, i, [{answered('t')}] as t from (select *, [{inserted('s')}] as t from parsed))
), audited as (
  select l.*, e.found['c'] as cost, e.found['a'] as audit from listed l join ended e on l.conv_id is not distinct from e.conv_id and e.i = l.n
), letters as (
  select conv_id, audit[j] as letter, j, sum(case when audit[j] = 'I' then 0 else 1 end) over (partition by conv_id order by j) as i
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as j from audited)
), turns as (
  select p.conv_id, j, letter, case when letter = 'I' then '' else text end as text, case when letter = 'K' then role end as role,
    row_number() over (partition by p.conv_id order by j) as place,
    first_value(case when letter = 'K' and left(role, 1) = 's' then 1 else 0 end) over (partition by p.conv_id order by j) as led
  from letters p left join faulty f on p.conv_id is not distinct from f.conv_id and p.i = f.i where letter <> 'D'
), repaired as (
  select conv_id, string_agg(coalesce(role, case when (place - led) % 2 = 1 then 'user' else 'assistant' end) || ':' || text, chr(10) order by j) as lines
  from turns group by conv_id
)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(lines, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join audited a on c.conv_id is not distinct from a.conv_id
left join repaired r on c.conv_id is not distinct from r.conv_id
"""


FILTER_AUDIT = r"""
with base as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), firsts as (
  select text, min(doc_id) as least from base group by text
), marks as (
  select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), words as (
  select doc_id, part, text, regexp_extract_all(text, '[^ 	-]+') as w from base
), judged as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    [case when len(w) < 100 then 1 else 0 end, case when 100 * len(list_distinct(w)) < 80 * len(w) then 1 else 0 end,
     case when 100 * length(regexp_replace(b.text, '[^A-Z]', '', 'g')) > 10 * length(b.text) then 1 else 0 end,
     case when regexp_matches(b.text, '[#$%&*|]') then 1 else 0 end, case when b.doc_id > least then 1 else 0 end] as fails
  from words b join firsts f on b.text = f.text left join marks m on b.doc_id = m.doc_id
), counted as (
  select part, fails, list_sum(fails) as failed, count(*) as n, sum(good) as good, sum(toxic) as toxic from judged group by part, fails
), letters(letter, i) as (values ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)
), orders as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.i, b.i, c.i, d.i, e.i] as places
  from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps as (
  select filter_order, step::int as step, places[step] as own, places[1:step - 1] as before from orders, range(1, 6) r(step)
), met as (
  select part, filter_order, step, fails[own] as hit, coalesce(list_sum(list_transform(before, lambda k: fails[k])), 0) as earlier, failed, n, good, toxic
  from counted, steps
)
select part, filter_order, step,
  coalesce(sum(n) filter (hit = 0 and earlier = 0), 0)::bigint as kept, coalesce(sum(n) filter (hit = 1 and earlier = 0), 0)::bigint as removed,
  coalesce(sum(n) filter (hit = 1 and earlier > 0), 0)::bigint as redundant, coalesce(sum(n) filter (hit = 1 and failed = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (hit = 1 and earlier = 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (hit = 1 and earlier = 0), 0)::bigint as toxic_lost,
  coalesce(sum(n * 120 // nullif(failed, 0)) filter (hit = 1), 0)::bigint as shapley
from met group by part, filter_order, step
"""

ORACLES: dict[str, str] = {
    "op1_sharding": sharding_sql(),
    "op2_mixing": MIXING,
    "op3_secret_scan": SECRETS,
    "op8_chat_format": CHAT,
    "op11_turn_repair": repair_sql(),
    "op13_filter_audit": FILTER_AUDIT,
}
