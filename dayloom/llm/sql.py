"""The same results in SQL, for the queries that SQL can express."""

EXACT_DEDUP_SQL = """
with t as (select doc_id, coalesce(text, '') as body from documents)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id is not distinct from max(doc_id) over g as kept, sha256(body) as text_sha256
from t window g as (partition by body)
"""


def _spans_sql(kind: str, number: int, pattern: str, group: int, least: int, table: str = "t") -> str:
    """Spans of a pattern from the pieces between its matches and the matches."""
    p = pattern.replace("'", "''")
    return f"""
  select doc_id, '{kind}' as kind, {number} as k,
    (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0))::bigint as s,
    (list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(hits[:i], lambda x: length(x))))::bigint as e, hits[i] as hit
  from (select doc_id, gaps, hits, parts, unnest(range(1, len(hits) + 1)) as i from (
    select doc_id, string_split_regex(body, '{p}') as gaps, regexp_extract_all(body, '{p}') as hits,
      regexp_extract_all(body, '{p}', {group}) as parts from {table}))
  where length(parts[i]) >= {least}"""


ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

SECRET_SCAN_SQL = f"""
with t as (select doc_id, coalesce(text, '') as body from documents),
base as ({_spans_sql('assign', 0, ASSIGN, 2, 8)}
  union all {_spans_sql('access', 1, 'AKIA[A-Z0-9]+', 0, 16)}
  union all {_spans_sql('hex', 2, '[0-9a-f]+', 0, 32)}),
blanked as (select doc_id, replace(regexp_replace(regexp_replace(body, '(?i)0123456789abcdef', repeat(' ', 16), 'g'),
  '(?i)abcdefghijklmnop', repeat(' ', 16), 'g'), 'EXAMPLE', repeat(' ', 7)) as body from t),
hexes as ({_spans_sql('entropy', 3, '[0-9A-Fa-f]{20,}', 0, 20, 'blanked')}),
mixes as ({_spans_sql('entropy', 3, '[A-Za-z0-9+/=_-]{20,}', 0, 20, 'blanked')}),
classed as (select * from (select doc_id, s, lower(hit) as hit, 3.0 as bits from hexes union all select doc_id, s, hit, 3.8 from mixes)
  where regexp_matches(hit, '[0-9]') and regexp_matches(hit, '[A-Za-z]')),
windows as (select doc_id, s, bits, unnest(range(20, length(hit) + 1)) as i, hit from classed),
summed as (select doc_id, s, i, bits, list_sum(list_transform(list_distinct(string_split(hit[i - 19:i], '')),
    lambda ch: round(1000000000.0 * (20 - length(replace(hit[i - 19:i], ch, ''))) * log2(20 - length(replace(hit[i - 19:i], ch, ''))))::bigint)) as total
  from windows),
hot as (select distinct doc_id, 'entropy' as kind, 3 as k, s + first - 20 as s, s + last as e
  from (select doc_id, s, min(i) as first, max(i) as last from summed
    where total <= floor(1000000000.0 * 20 * (log2(20) - bits)) group by doc_id, s, bits)),
every as (select doc_id, kind, k, s, e from base union all select doc_id, kind, k, s, e from hot),
counts as (select doc_id, count(*) filter (k = 0) as a, count(*) filter (k = 1) as b, count(*) filter (k = 2) as c,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) filter (k < 3) as base_spans,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as spans
  from every group by doc_id)
select t.doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans
from t left join counts using (doc_id)
"""

LINE_DEDUP_SQL = r"""
with lines as (
  select doc_id, n, i, ls[i] as line,
    translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, ls, len(ls) as n, unnest(range(1, len(ls) + 1)) as i
    from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
repeated as (select key from lines where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, any_value(n)::bigint as n_lines, count(*) filter (key in (select key from repeated))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (select key from repeated)), '')) as kept_sha256
from lines group by doc_id
"""

# Windows of an item's size over the words, compared by counts of shared shingles; no fingerprints.
DECONTAMINATE_SQL = r"""
with dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda w: w <> '') as ws from documents),
iw as (select item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-/:-`{-\x7f]+'), lambda w: w <> '') as ws from benchmark),
d as (select doc_id, len(ws) - 4 as n, i - 1 as p, array_to_string(ws[i:i + 4], ' ') as s from (select *, unnest(range(1, len(ws) - 3)) as i from dw)),
it as (select item_id, len(ws) - 4 as m, array_to_string(ws[i:i + 4], ' ') as s from (select *, unnest(range(1, len(ws) - 3)) as i from iw)),
ic as (select item_id, m, s, count(*) as c from it group by all),
hits as (select d.doc_id, d.n, d.p, ic.item_id, ic.m, ic.s, ic.c from d join ic using (s)),
starts as (select distinct doc_id, item_id, n, m, greatest(0, least(p, n - m)) as start from hits),
shared as (select st.doc_id, st.item_id, st.start, st.m, least(st.m, st.n) as size, h.s, least(count(*), any_value(h.c)) as common
  from starts st join hits h on h.doc_id = st.doc_id and h.item_id = st.item_id and h.p >= st.start and h.p < st.start + st.m group by all),
scored as (select doc_id, item_id, start, sum(common) / (any_value(m) + any_value(size) - sum(common)) as similarity from shared group by all)
select doc_id, item_id, round(max(similarity), 9) as similarity, arg_min(start, (-similarity, start))::bigint as start
from scored where similarity >= 0.8 - 1e-12 group by doc_id, item_id
"""
DIVERGENCE_SQL = r"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as body from documents),
w as (select k, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*) as c from w group by all having count(distinct k) >= 10),
v as (select lang, count(*) as v, sum(c) as n from kept group by lang),
own as (select lang, source, term, count(*) as c from w semi join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
total as (select lang, source, sum(c) as n from own group by all),
p as (select g.lang, g.source, k.term, coalesce(own.c, 0) as c,
    1 + (1000000000::hugeint * (coalesce(own.c, 0) + 2)) // (coalesce(total.n, 0) + 2 * v.v) as p,
    1 + (1000000000::hugeint * (k.c + 2)) // (v.n + 2 * v.v) as q
  from g join kept k using (lang) join v using (lang) left join own using (lang, source, term) left join total using (lang, source)),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(pairs.value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
  union all select lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) from p where c > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from every)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 10
"""

COLLOCATIONS_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
grams as (select lang, size, array_to_string(ws[i:i + size - 1], ' ') as phrase
  from (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from w cross join (values (1), (2), (3)) as s(size))),
f as (select lang, size, phrase, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where size = 1 group by lang),
c as (select lang, size, phrase, f as a, string_split(phrase, ' ') as ws from f where size >= 2 and f >= 10),
parts as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as head, array_to_string(ws[k + 1:size], ' ') as tail
  from (select *, unnest(range(1, size)) as k from c)),
cuts as (select p.lang, p.phrase, p.a, k, h.f as l, t.f as r, (1000000::hugeint * a * a) // (h.f::hugeint * t.f) as score
  from parts p join f h on h.lang = p.lang and h.phrase = p.head join f t on t.lang = p.lang and t.phrase = p.tail),
best as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
inside as (select lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase, a from c where size = 3),
longer as (select lang, phrase, max(a) as longer from inside group by all),
ranked as (select best.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from best left join longer using (lang, phrase) where place = 1 and (longer is null or 100 * longer < 50 * a))
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score
from ranked join n using (lang) where rank <= 2000
"""
