"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from lattica.llm.quality import BOILERPLATE, NAVIGATION, SENTENCE_END

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MIX = rf"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
    case when length(text) > 0 then greatest((length(text) - length(regexp_replace(text, '[\p{{L}}\x20\x09-\x0D]+', '', 'g')))::double / length(text), 0.05e0) else 0.05e0 end weight,
    ((('0x' || substr(md5('7|' || coalesce(doc_id::varchar, '') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint)::double + 0.5e0) / 4503599627370496e0 u
  from documents),
s as (select source, sum(size)::bigint sz from d group by 1),
r as (select *, row_number() over (order by source asc nulls last) rn from s),
w as (select *, (case (rn - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end) w, 2e0 * sz cap from r),
f as (select *, cap / w fill, 1.5e0 * sum(sz) over () goal,
  coalesce(sum(cap) over (order by cap / w, source asc nulls last rows between unbounded preceding and 1 preceding), 0e0) before,
  sum(w) over (order by cap / w, source asc nulls last rows between current row and unbounded following) weights from w),
l as (select *, (goal - before) / weights lev from f),
t as (select *, first_value(case when lev <= fill then lev end ignore nulls) over (order by fill, source asc nulls last rows between unbounded preceding and unbounded following) level from l),
g as (select source, sz, coalesce(least(cap, level * w), cap) target from t),
e as (select *, floor(target + 0.5e0)::bigint budget from g),
h as (select source, sz, target, case when sz > 0 then budget // sz else 0 end epochs, budget - case when sz > 0 then budget // sz else 0 end * sz rest from e),
x as (select doc_id, size, sz, target, epochs, rest, coalesce(sum(size) over (partition by d.source order by -ln(u) / weight, doc_id, size rows between unbounded preceding and 1 preceding), 0) before
  from d join h on d.source is not distinct from h.source)
select doc_id, size, sz source_size, round(target, 6) target, (epochs * size + least(size, greatest(0, rest - before)))::bigint taken from x"""

SUBSTRINGS = rf"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 34], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 33)) i from d)),
many as (select g from g group by g having count(*) > 1),
hit as (select distinct doc_id, i + j p from (select doc_id, i, unnest(range(0, 35)) j from g join many using (g))),
words as (select doc_id, generate_subscripts(w, 1) p, unnest(w) word from d),
kept as (select doc_id, string_agg(word, ' ' order by p) t, count(*) n from words anti join hit using (doc_id, p) group by 1)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join kept using (doc_id)"""

LEAKS = rf"""
with b as (select item_id::varchar item, regexp_extract_all({ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (select distinct item, 10 k, array_to_string(w[i:i + 9], ' ') g from (select item, w, unnest(range(1, len(w) - 8)) i from b)
  union select item, len(w), array_to_string(w, ' ') from b where len(w) between 1 and 9),
d as (select doc_id, coalesce(regexp_extract_all({ASCII_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
g as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, (select distinct k from wins))),
m as (select doc_id, i, g.k, item from g join wins on g.g = wins.g and g.k = wins.k),
hit as (select doc_id, count(distinct p) n from (select doc_id, unnest(range(i, i + k)) p from m) group by 1),
items as (select doc_id, count(*) n, string_agg(item, ',' order by item) t from (select distinct doc_id, item from m) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(hit.n, 0)::bigint n_hit, coalesce(items.n, 0)::bigint n_items, sha256(coalesce(t, '')) items_sha256, coalesce(hit.n, 0) > 0 contaminated
from d left join hit using (doc_id) left join items using (doc_id)"""

QUALITY = rf"""
with d as (select doc_id, coalesce(text, '') text, coalesce(regexp_extract_all(text, '{WORD}'), []) w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 2], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 1)) i from d)),
twice as (select doc_id, g from g group by 1, 2 having count(*) > 1),
rep as (select doc_id, count(distinct p) n from (select doc_id, i + unnest([0, 1, 2]) p from g join twice using (doc_id, g)) group by 1),
lines as (select doc_id, unnest(string_split(text, chr(10))) line from d),
l as (select doc_id, line, trim(line, {SPACE}) t, coalesce(len(regexp_extract_all(line, '{WORD}')), 0) n, len(regexp_extract_all(line, '[#*$%&|<>]')) marks from lines),
dup as (select doc_id, (sum(n_lines - 1))::bigint n from (select doc_id, line, count(*) n_lines from l where t <> '' group by 1, 2) group by 1),
j as (select doc_id, length(t) size, t <> '' and (marks >= 4 and 5 * marks > n or regexp_matches(t, {_quoted(NAVIGATION)}) or regexp_matches(lower(t), {_quoted("|".join(BOILERPLATE))})
  or not regexp_matches(t, {_quoted(SENTENCE_END)}) and (n < 4 or not regexp_matches(t, '\p{{L}}'))) fails from l),
lost as (select doc_id, 2 * coalesce(sum(size) filter (where fails), 0) <= sum(size) ok from j group by 1),
base as (select doc_id, len(w)::bigint n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(dup.n, 0)::bigint n_dup_lines, coalesce(rep.n, 0)::bigint n_repeat_words from d left join dup using (doc_id) left join rep using (doc_id))
select base.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and ok kept from base join lost using (doc_id)"""

NGRAMS = rf"""
with recursive d as (select doc_id, coalesce(regexp_extract_all({ASCII_LOWER.format("text")}, '{WORD}'), []) w from documents),
g as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from g group by 1),
links as (select a, b from (select x.doc_id a, y.doc_id b, count(*) o from g x join g y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2) join n p on a = p.doc_id join n q on b = q.doc_id where 100 * o >= 75 * (p.n + q.n - o)),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(least(m, doc_id), doc_id) component_id from d left join n using (doc_id) left join (select a doc_id, min(b) m from reach group by 1) using (doc_id)"""

SQL = {"op1_mix_sources": MIX, "op4_substring_dedup": SUBSTRINGS, "op5_decontaminate": LEAKS, "op6_quality_rules": QUALITY, "op7_ngram_join": NGRAMS}
