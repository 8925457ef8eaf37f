"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from citegrove.functions.text import NO_ABSTRACT
from citegrove.operators.dedup import ORIGIN_ORDER

BLANK = r"[ \t-\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
INK = r"[^()" + BLANK[1:]


def squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}+', ' ', 'g'), ' ')"


def plain(x: str) -> str:
    return squeezed(f"lower({x})")


def doi_name(x: str) -> str:
    bare = f"regexp_replace({x}, '\\p{{Cf}}+', '', 'g')"
    read = f"lower(case when contains({bare}, '%') then url_decode({bare}) else {bare} end)"
    hit = f"regexp_extract({read}, '(?:^|[^0-9])(10\\.[0-9]+{BLANK}*/{BLANK}*(?:{INK}+|\\((?:{INK}+|\\({INK}*\\))*\\))+)', 1)"
    name = f"regexp_replace(regexp_replace({hit}, '[^\\p{{L}}\\p{{N}})]+$', ''), '{BLANK}+', '', 'g')"
    return f"nullif(case when regexp_matches({name}, '^10\\.[0-9]+/.') then {name} else '' end, '')"


def listed(field: str) -> str:
    """Distinct items of a field of records, as rows (rec_id, item)."""
    x = f"coalesce({field}, '')"
    by = f"case when contains({x}, ';') then ';' else ',' end" if field == "keywords" else "';'"
    inner = f"select rec_id, unnest(string_split({x}, {by})) x from records"
    value = {"keywords": plain("x"), "authors": squeezed("x"), "refs": f"coalesce({doi_name('x')}, {plain('x')})"}[field]
    return f"select distinct rec_id, item from (select rec_id, {value} item from ({inner})) where item <> ''"


P1 = f"""with e as materialized ({" union all ".join(f"select '{f}' field, * from ({listed(f)})" for f in ("keywords", "authors", "refs"))}),
n as (select field, count(distinct rec_id) n from e group by 1), c as (select field, item, count(*) c from e group by 1, 2), often as (select e.* from e join c using (field, item) where c >= 10),
p as (select a.field, a.item item_a, b.item item_b, count(*) n_ab from often a join often b on a.field = b.field and a.rec_id = b.rec_id and a.item < b.item group by 1, 2, 3 having count(*) >= 10)
select field, item_a, item_b from p join n using (field) join c x on x.field = p.field and x.item = item_a join c y on y.field = p.field and y.item = item_b where n_ab * n >= 8 * x.c * y.c"""

P1_PAIRS = f"""with e as materialized ({" union all ".join(f"select '{f}' field, * from ({listed(f)})" for f in ("keywords", "authors", "refs"))}),
n as (select field, count(distinct rec_id) n from e group by 1), c as (select field, item, count(*) c from e group by 1, 2),
p as (select a.field, a.item item_a, b.item item_b, count(*) n_ab from e a join e b on a.field = b.field and a.rec_id = b.rec_id and a.item < b.item group by 1, 2, 3)
select field, item_a, item_b, x.c n_a, y.c n_b, n_ab, n, round(n_ab * n / (x.c * y.c), 6) lift from p join n using (field) join c x on x.field = p.field and x.item = item_a join c y on y.field = p.field and y.item = item_b"""

_ORIGIN = "lower(regexp_replace(coalesce(origin, ''), '(?:" + BLANK + "|\\p{Cf})+', '', 'g'))"
_RANK = "case " + " ".join(f"when {_ORIGIN} = '{o}' then {r}" for o, r in ORIGIN_ORDER.items()) + " else 9 end"
_ABSTRACT = squeezed("regexp_replace(coalesce(abstract, ''), '<[^>]+>', ' ', 'g')")
_BARE = "trim(regexp_replace(regexp_replace(lower(a), 'n\\s*/\\s*a|n\\.\\s*a\\.?', 'na', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_NOTES = ", ".join(f"'{x}'" for x in NO_ABSTRACT)

P2 = f"""with b as materialized (select rec_id, harvested_at t, coalesce(citations, 0) c, {doi_name("coalesce(doi, '')")} d, {_RANK} r, {_ABSTRACT} a from records),
g as (select *, case when {_BARE} in ({_NOTES}) then 0 else length(a) end len from b where d is not null),
w as (select d, count(*) over (partition by d) n, first(rec_id) over (partition by d order by r, t desc nulls last, rec_id) keep_id, first(rec_id) over (partition by d order by len desc, t desc nulls last, rec_id) x, max(len) over (partition by d) m,
first(rec_id) over (partition by d order by case when c > 0 then 0 else 1 end, t desc nulls last, rec_id) y, max(c) over (partition by d) mc from g)
select distinct d doi_name, keep_id, cast(case when m > 0 then x else 0 end as bigint) abstract_id, cast(case when mc > 0 then y else 0 end as bigint) citations_id from w where n > 1"""

P2_MERGED = f"""with best as (select doi_name d, keep_id, abstract_id, citations_id from ({P2}))
select d doi_name, keep_id, k.title, k."year", k.source, k.origin, coalesce({_ABSTRACT.replace("abstract", "x.abstract")}, '') abstract, cast(coalesce(y.citations, 0) as bigint) citations
from best join records k on k.rec_id = keep_id left join records x on x.rec_id = abstract_id left join records y on y.rec_id = citations_id"""

_LETTERS = "regexp_replace(upper(replace(nfc_normalize(coalesce(title, '')), 'ß', 'ss')), '[^\\p{L}\\p{Nd}]+', '', 'g')"
P3 = f"""with k as materialized (select rec_id, coalesce({doi_name("coalesce(doi, '')")}, '') d, {_LETTERS} t from records), g as (select d, t, min(rec_id) first_id from k group by 1, 2 having count(*) > 1)
select first_id, rec_id copy_id from k join g using (d, t) where rec_id <> first_id"""

_VALUES = f"""v as materialized (select rec_id, 'keywords' field, item term from (select rec_id, {plain("x")} item from (select rec_id, unnest(string_split(coalesce(keywords, ''), case when contains(coalesce(keywords, ''), ';') then ';' else ',' end)) x from records)) where item <> ''
union all select rec_id, 'source', {plain("coalesce(source, '')")} from records where {plain("coalesce(source, '')")} <> '')"""
_MARK = "case when count(distinct rec_id) < 3 then 'rare' when count(distinct rec_id) * 100 > 4 * (select count(*) from records) then 'common' end"
P5_TERMS = f"with {_VALUES} select field, term, count(*) occurrences, count(distinct rec_id) records, {_MARK} mark from v group by 1, 2"
P5 = f"select field, term, mark from ({P5_TERMS}) where mark is not null"

P7 = f"""with e as materialized ({listed("refs")}), s as (select rec_id, count(*) k from e group by 1 having count(*) >= 5), f as (select * from e semi join s using (rec_id)),
p as (select a.rec_id rec_a, b.rec_id rec_b, count(*) n from f a join f b on a.item = b.item and a.rec_id < b.rec_id group by 1, 2)
select rec_a, rec_b from p join s x on x.rec_id = rec_a join s y on y.rec_id = rec_b where n * 10 >= 6 * (x.k + y.k - n)"""

P7_LINKS = f"""with e as materialized ({listed("refs")}), s as (select rec_id, count(*) k, list(item order by item) v from e group by 1 having count(*) >= 5), f as (select * from e semi join s using (rec_id)),
p as (select a.rec_id x, b.rec_id y, count(*) n from f a join f b on a.item = b.item and a.rec_id <> b.rec_id group by 1, 2),
l as (select p.x, count(*) links from p join s a on a.rec_id = p.x join s b on b.rec_id = p.y where n * 10 >= 6 * (a.k + b.k - n) group by 1)
select rec_id id, min(rec_id) over (partition by v) cls, count(*) over (partition by v) class_rows, cast(coalesce(links, 0) as bigint) links from s left join l on l.x = rec_id"""

P8_ROUND_TRIPS = "select doc_id, true as same from documents"

SQL = {"p2_merged": P2_MERGED, "p7_links": P7_LINKS, "p8_round_trips": P8_ROUND_TRIPS, "p1_found": P1, "p1_pairs": P1_PAIRS, "p2_found": P2, "p3_found": P3, "p5_found": P5, "p5_terms": P5_TERMS, "p7_found": P7}
