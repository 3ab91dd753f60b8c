"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from bizmetrics.llm.licenses import TEMPLATES

EXACT = """
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') as norm
  from documents)
select doc_id, max(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       doc_id = max(doc_id) over (partition by norm) as kept,
       sha256(norm) as text_sha256
from t
"""

NGRAM_JOIN = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, sh from (
    select doc_id, unnest(case
      when len(ws) >= 3
        then [array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)]
      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from s a join s b using (sh) where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
e as (
  select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b
  where 100 * c >= 90 * (na.n + nb.n - c)),
r(doc_id, root) as (
  select doc_id, doc_id from documents
  union select r.doc_id, e.b from r join e on r.root = e.a)
select r.doc_id, coalesce(any_value(n), 0) as n_shingles, min(root) as component_id
from r left join n using (doc_id) group by r.doc_id
"""



def _licenses() -> str:
    """Every start of every template, without an index of rare words."""
    templates = ", ".join(
        f"({t}, '{x.label}', {len(x.words)}, {x.need}, {x.base})" for t, x in enumerate(TEMPLATES)
    )
    places = ", ".join(f"({t}, {o}, '{w}')" for t, x in enumerate(TEMPLATES) for o, w in enumerate(x.words))
    keys = ", ".join(
        f"({t}, {at + k})" for t, x in enumerate(TEMPLATES) for at, key in x.key_places() for k in range(len(key))
    )
    return rf"""
with t(t, label, len, need, base) as (values {templates}),
p(t, o, word) as (values {places}),
k(t, o) as (values {keys}),
w as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents),
u as (select doc_id, unnest(ws) as word, unnest(range(0, len(ws))) as pos from w),
m as (
  select u.doc_id, p.t, pos - p.o as s, count(*) as n,
         count(*) filter (where (p.t, p.o) in (select (k.t, k.o) from k)) as n_keys
  from u join p using (word) where pos >= p.o group by u.doc_id, p.t, s),
f as (
  select m.doc_id, m.s, t.label, t.base, n / t.len as share
  from m join t using (t) join w using (doc_id)
  where n >= need and s + t.len <= len(ws)
    and n_keys = (select count(*) from (select distinct t, o from k) q where q.t = m.t)),
g as (
  select doc_id, count(*) filter (where base) as n_base,
         min(s) filter (where base) as first_word, max(s) filter (where base) as last_word,
         string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
         string_agg(distinct label, ',' order by label) as labels, max(share) as score
  from f group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       coalesce(score, 0.0) as score
from w left join g using (doc_id)
"""


SUBSTRINGS = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select doc_id, i, array_to_string(ws[i:i + 49], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50)),
f as (select win, min(doc_id) as first from s group by win),
p as (
  select distinct doc_id, i + k as pos
  from (select s.doc_id, s.i from s join f using (win) where s.doc_id > f.first), range(50) t(k)),
u as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
j as (
  select u.doc_id, string_agg(word, ' ' order by pos) as kept
  from u anti join p using (doc_id, pos) group by u.doc_id),
g as (select doc_id, count(*) as n from p group by doc_id)
select w.doc_id, len(ws) as n_words, coalesce(n, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join j using (doc_id) left join g using (doc_id)
"""

FIXITY = r"""
with r as (
  select page_id, concat('WARC/1.0', e, 'WARC-Type: resource', e, 'WARC-Record-ID: <urn:page:',
      coalesce(page_id::varchar, ''), '>', e, 'WARC-Date: 1970-01-01T00:00:00Z', e,
      coalesce('WARC-Target-URI: ' || regexp_replace(url, '[\r\n]', '', 'g') || e, ''),
      'Content-Type: text/html', e, 'Content-Length: ', strlen(coalesce(html, '')), e, e,
      coalesce(html, '')) as rec
  from pages, (select chr(13) || chr(10) as e)),
c as (
  select *, md5(coalesce(page_id::varchar, ''))[1:2] = '07' as damaged,
         'warc' || rec[5:] as copied from r)
select page_id, strlen(rec) as length, sha256(rec) as sha256, not damaged as replica_ok,
       case when damaged then sha256(copied) end as replica_sha256
from c
"""


SEARCH = r"""
with d as (
  select doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
i as (
  select item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
c as (
  select count(*) filter (where len(terms) > 0)::bigint as n_docs, sum(len(terms))::bigint as n_terms from d),
p as (
  select doc_id, n, term, count(*)::bigint as tf
  from (select doc_id, len(terms)::bigint as n, unnest(terms) as term from d) group by doc_id, n, term),
w as (
  select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from p, c group by term, n_docs),
s as (
  select item_id, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
  from i join p using (term) join w using (term), c group by item_id, doc_id),
r as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from s where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 20
"""


PHRASES = r"""
with p as (
  select row_number() over () as piece, lang, regexp_extract_all(text, '[^\x20\x09]+') as ws
  from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) as text
    from documents)),
t as (select lang, sum(len(ws))::bigint as n from p group by lang),
s as (select lang, ws, len(ws) as size, unnest(range(1, len(ws) + 1)) as i from p),
g as (
  select lang, ws[i:i + k - 1] as g, count(*)::bigint as f
  from s, range(1, 5) r(k) where i + k - 1 <= size group by lang, g),
c as (select lang, g, f from g where len(g) >= 2 and f >= 30),
x as (select lang, g, f, unnest(range(1, len(g))) as k from c),
y as (
  select x.lang, x.g, x.f as a, x.k, l.f as l, r.f as r,
         (2000000::hugeint * x.f // (l.f + r.f))::bigint as score
  from x join g l on l.lang = x.lang and l.g = x.g[1:x.k]
         join g r on r.lang = x.lang and r.g = x.g[x.k + 1:]),
b as (select * from y qualify row_number() over (partition by lang, g order by score, k) = 1),
i as (
  select lang, f, len(g) as size, unnest(list_transform(range(1, len(g) - m + 2), lambda q: g[q:q + m - 1])) as part
  from c, range(2, 4) z(m) where m < len(g)),
d as (
  select distinct b.lang, b.g from b join i on i.lang = b.lang and i.part = b.g where 100 * i.f >= 80 * b.a),
o as (
  select lang, array_to_string(g, ' ') as phrase, a, l, r, score
  from b anti join d using (lang, g)),
k as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from o)
select lang, rank, phrase, a, l, r, n, score from k join t using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": NGRAM_JOIN,
        "op3_license_scan": _licenses(),
        "op4_substring_dedup": SUBSTRINGS,
        "op9_exact_dedup": EXACT,
        "op10_warc_fixity": FIXITY,
        "op11_phrase_collocations": PHRASES,
        "op13_lexical_search": SEARCH,
    }
