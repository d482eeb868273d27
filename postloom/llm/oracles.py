"""SQL counterparts (DuckDB) of the queries that have long ones."""

from postloom.llm.quality import ERROR, GRID, LEAST_WORDS, MOST_REJECTED, MOST_REPEATED

MERKLE = r"""
with recursive polynomial as (
  select list(list_reduce(list_prepend(i::ubigint, range(8)::ubigint[]),
                          lambda c, k: if(c & 1 = 1, xor(c >> 1, 3988292384::ubigint), c >> 1)) order by i) as t
  from range(256) r(i)),
ids as (
  select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''),
                lambda d: ascii(d)::ubigint)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::bigint + 1])), 4294967295::ubigint) as crc
  from documents, polynomial),
shown as (
  select *, case when crc % 2 = 0 then replace(text, chr(10), '') else text end as other from ids),
fields as (
  select doc_id, source, text, other,
         coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') ||
         coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head
  from shown),
leaves as (
  select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         sha256(head || coalesce(strlen(other) || ':' || other, '-')) as changed
  from fields),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from leaves),
levels as (
  select source, 0 as lvl, list(leaf order by pos) as nodes from placed group by source
  union all
  select source, lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i+1:i+3], '')))
  from levels where len(nodes) > 1),
subroots as (
  select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as pos
  from levels where len(nodes) = 1),
tops as (
  select 0 as lvl, list(subroot order by pos) as nodes from subroots
  union all
  select lvl + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i+1:i+3], '')))
  from tops where len(nodes) > 1),
steps as (
  select p.source, p.pos, l.lvl, nodes, p.pos // (3::bigint ** l.lvl)::bigint as i
  from placed p join levels l on l.source is not distinct from p.source where len(nodes) > 1
  union all
  select p.source, p.pos, 1000 + t.lvl, nodes, s.pos // (3::bigint ** t.lvl)::bigint
  from placed p join subroots s on s.source is not distinct from p.source, tops t where len(nodes) > 1),
sides as (
  select source, pos, lvl, array_to_string(nodes[i - i % 3 + 1:i], '') as l,
         array_to_string(nodes[i + 2:i - i % 3 + 3], '') as r
  from steps),
paths as (
  select source, pos, sha256(string_agg(l || r, '' order by lvl)) as proof_sha256,
         list({'l': l, 'r': r} order by lvl) as path
  from sides group by source, pos),
proved as (
  select p.doc_id, p.leaf, s.subroot, t.nodes[1] as root, coalesce(proof_sha256, sha256('')) as proof_sha256,
         list_reduce(list_prepend({'l': '', 'r': p.changed}, coalesce(path, [])),
                     lambda a, x: {'l': '', 'r': sha256(x.l || a.r || x.r)}).r as folded_root
  from placed p join subroots s on s.source is not distinct from p.source
  join tops t on len(t.nodes) = 1
  left join paths h on h.source is not distinct from p.source and h.pos = p.pos)
select *, folded_root = root as verified from proved
"""

DIVERGENCE = r"""
with docs as (
  select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
         coalesce(text, '') as text from documents),
words as (
  select k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from docs),
kept as (
  select lang, term, count(*) as n from words group by lang, term having count(distinct k) >= 10),
grps as (select distinct lang, source from docs),
dense as (
  select g.lang, g.source, t.term, coalesce(c.c, 0) as c, t.n
  from grps g join kept t on t.lang = g.lang
  left join (select lang, source, term, count(*) as c from words group by all) c
    on c.lang = g.lang and c.source = g.source and c.term = t.term),
totals as (
  select *, sum(c) over g as total, sum(n) over g as lang_total, count(*) over g as v from dense
  window g as (partition by lang, source)),
shares as (
  select lang, source, term, c, 1 + (1000000000::hugeint * (c + 2)) // (total + 2 * v)::hugeint as p,
         1 + (1000000000::hugeint * (n + 2)) // (lang_total + 2 * v)::hugeint as q
  from totals),
gaps as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(g.value, 0)::bigint as value
  from grps a join grps b on a.lang = b.lang and a.source <> b.source
  left join gaps g on g.lang = a.lang and g.source = a.source and g.item = b.source),
terms as (
  select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // (p + q))::bigint as value
  from shares where c > 0 and p > q)
select lang, source, part, item, value,
       row_number() over (partition by lang, source, part order by value desc, item)::integer as rank
from (from pairs union all from terms)
qualify part = 'pair' or rank <= 10
"""

QUALITY = rf"""
with docs as (
  select row_number() over () as k, doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select k, unnest(range(1, len(words) - 1)) as i, unnest(list_transform(range(1, len(words) - 1),
         lambda i: words[i:i+2])) as w from docs where len(words) > 2),
twice as (select k, i from windows qualify count(*) over (partition by k, w) > 1),
covered as (select k, count(distinct i + o) as n from twice, range(3) r(o) group by k),
lines as (select k, unnest(string_split(text, chr(10))) as line from docs),
dups as (
  select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by k),
figures as (
  select d.k, doc_id, stratum, md5(text) as key, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, coalesce(n_lines, 0) as n_lines,
         coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) as n_capitals, len(regexp_extract_all(text, '[A-Za-z]')) as n_letters
  from docs d left join dups on dups.k = d.k left join covered c on c.k = d.k),
judged as (
  select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed,
         [[n_symbols, word_chars], [n_dup_lines, n_lines], [n_repeat_words, n_words], [n_capitals, n_letters]] as shares
  from figures),
grid as (select {list(GRID)} as cuts),
leveled as (
  select j.*, list_transform(shares, lambda s: len(list_filter(cuts, lambda c: 1000 * s[1] <= c * s[2])) + 1) as froms
  from judged j, grid),
marks as (
  select doc_id, min(quality) as quality from labels where doc_id is not null and quality is not null
  group by doc_id having min(quality = 1) = max(quality = 1)),
known as (
  select stratum, key, min(quality = 1) as good, any_value(froms) as froms,
         ('0x' || key[1:1])::integer % 2 = 1 as holdout
  from leveled l join marks m on m.doc_id = l.doc_id where not base_failed group by stratum, key),
strata as (select stratum, count(*) over () as n from (select distinct stratum from known)),
fit as (select * from known where not holdout),
sums as (
  select stratum, r, lvl, count(*) filter (good and froms[r] <= lvl) as g, count(*) filter (not good and froms[r] <= lvl) as b,
         count(*) filter (good) as all_good, count(*) filter (not good) as all_bad
  from fit, range(1, 5) x(r), range(1, {len(GRID) + 1}) y(lvl) group by all),
worths as (select stratum, r, lvl, b * all_good - g * all_bad as worth from sums),
proposed as (
  select stratum, r, case when max(worth) > 0 then list(lvl order by lvl) filter (worth = best)[
         (count(*) filter (worth = best) + 1) // 2] else 0 end as lvl
  from (select *, max(worth) over (partition by stratum, r) as best from worths) group by stratum, r),
levels as (select stratum, list(lvl order by r) as lvls from proposed group by stratum),
reached as (
  select stratum, list_max(list_transform(range(1, 5), lambda r: lvls[r] - froms[r])) as reach
  from known join levels using (stratum) where holdout and good),
tried as (
  select stratum, j, count(*) as n, count(*) filter (reach >= j) as rejected
  from reached, range({len(GRID)}) x(j) group by all),
tails as (
  select stratum, n, i, sum(exp(lgamma(n + 1) - case when i = 0 then 0 else lgamma(i + 1) end
         - case when i = n then 0 else lgamma(n - i + 1) end + i * ln({MOST_REJECTED}) + (n - i) * ln(1 - {MOST_REJECTED})))
         over (partition by stratum order by i) as tail
  from (select distinct stratum, n, unnest(range(n + 1)) as i from tried)),
limits as (
  select stratum, count(*) filter (tail <= {ERROR} / strata.n) - 1 as most
  from tails join strata using (stratum) group by stratum),
chosen as (
  select stratum, min(j) as loosened from tried join limits using (stratum) where rejected <= most group by stratum),
cutoffs as (
  select stratum, list_transform(lvls, lambda l: case when l > loosened then cuts[l - loosened] end) as cutoffs
  from levels join chosen using (stratum), grid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(list_bool_or(list_transform(range(1, 5), lambda r:
         coalesce(1000 * shares[r][1] > cutoffs[r] * shares[r][2], false))), false) as kept
from judged left join cutoffs using (stratum)
"""
