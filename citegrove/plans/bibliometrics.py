"""The registered queries over the test tables, each beside its SQL. Every query reads whole tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrove.functions.language import SMALL_WORDS, detected, small_words
from citegrove.functions.text import EDGE_BLANKS, dedup_key, first_surname, normalised_doi, normalised_title, split_semicolon, year_of
from citegrove.operators import dedup, graph, metrics, networks, search
from citegrove.operators.corpus import corpus, counts, doc_terms, items, ngrams, relevance, stop_words, tokens, with_thesaurus
from citegrove.plans.tables import cut, new_folder, table
from citegrove.sources import exports, readers
from citegrove.sources.connectors import Query
from citegrove.streaming import distinct_dois, windowed_counts

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}

C = """c as (select rec_id, coalesce(authors,'') authors, coalesce(title,'') title, coalesce("year",0) "year", coalesce(source,'') source,
coalesce(keywords,'') keywords, coalesce(abstract,'') abstract, coalesce(citations,0) citations, coalesce(doi,'') doi, coalesce(refs,'') refs,
coalesce(origin,'') origin, coalesce("language",'') "language", coalesce(is_oa,false) is_oa, coalesce(oa_url,'') oa_url, coalesce(ipc,'') ipc from records)"""


def _list(expression: str, sep: str) -> str:
    by = f"case when contains({expression}, ';') then ';' else ',' end" if sep == "auto" else "';'"
    return f"list_filter(list_transform(string_split({expression}, {by}), lambda x: trim(x, '{EDGE_BLANKS}')), lambda x: x <> '')"


def _items(name: str, expression: str, sep: str = "auto") -> str:
    return f'{name} as (select rec_id, "year", citations, unnest(v) item, generate_subscripts(v, 1) - 1 pos from (select rec_id, "year", citations, {_list(expression, sep)} v from c))'


KW = _items("kw", "lower(keywords)")
AU = _items("au", "authors")
OCC = "occ as (select item, count(*) n, count(distinct rec_id) df from kw group by 1)"
#: The least occurrences of a term in a network, the default of the tools this engine follows.
LEAST = 3
#: The last year that "recent" is counted from; some records have absurd later ones.
LAST_YEAR = 2025
NODES = f"nodes as (select item from occ where n >= {LEAST})"
SETS = "ds as (select distinct rec_id, item from kw semi join nodes using (item))"
EDGES = "edges as (select a.item src, b.item dst, count(*) weight from ds a join ds b on a.rec_id = b.rec_id and a.item < b.item group by 1, 2)"
NET = f"with {C}, {KW}, {OCC}, {NODES}, {SETS}, {EDGES}"


def query(sql: str | None = None) -> Callable[[Run], Run]:
    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _c(s: SparkSession, d: str) -> DataFrame:
    return corpus(table(s, d, "records"))


def _terms(s: SparkSession, d: str) -> DataFrame:
    return doc_terms(_c(s, d))


def _nodes(s: SparkSession, d: str) -> DataFrame:
    return networks.term_nodes(_terms(s, d), LEAST)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return networks.cooccurrence(_terms(s, d), _nodes(s, d))


def _network(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the keyword network, written once for queries that read them several times."""
    t = _terms(s, d)
    nodes = cut(networks.term_nodes(t, LEAST), "nodes")
    return nodes, cut(networks.cooccurrence(t, nodes), "edges")


@query(f"with {C}, {KW} select item term, count(*) occurrences, count(distinct rec_id) doc_freq from kw group by 1")
def keyword_counts(s, d):
    return counts(_terms(s, d))


RELEVANCE = "n * ln(((select count(distinct rec_id) from kw) + 1) / (df + 1))"


@query(f"with {C}, {KW}, {OCC} select item term, n occurrences, df doc_freq, round({RELEVANCE}, 6) relevance from occ")
def keyword_relevance(s, d):
    t = _terms(s, d)
    return relevance(counts(t), t)


@query(f"with {C}, {KW}, {OCC} select count(*) terms, count(*) filter (n >= 5) passing from occ")
def threshold_preview(s, d):
    return metrics.threshold_preview(_terms(s, d), 5)


@query(f"{NET} select src, dst, weight from edges")
def cooccurrence_full(s, d):
    return _edges(s, d)


@query(f"{NET}, size as (select rec_id, count(*) k from ds group by 1) select a.item src, b.item dst, round(sum(1.0::double / k), 4) weight from ds a join ds b on a.rec_id = b.rec_id and a.item < b.item join size on size.rec_id = a.rec_id group by 1, 2")
def cooccurrence_fractional(s, d):
    return networks.cooccurrence(_terms(s, d), _nodes(s, d), "fractional")


@query(f"{NET} select src, dst, round(weight / (a.n * b.n / (select count(*) from kw)), 6) weight, weight weight_raw from edges join occ a on a.item = src join occ b on b.item = dst")
def cooccurrence_assoc(s, d):
    return networks.association_strength(_edges(s, d), _terms(s, d))


@query(f"with {C}, {KW}, {OCC} select item term, n occurrences, df doc_freq, round({RELEVANCE}, 6) relevance, cast(floor(10 + 2 * n) as int) size, y year_mean from occ join (select item, round(avg(case when \"year\" > 0 then \"year\" end), 1) y from kw group by 1) using (item) where n >= {LEAST}")
def cooccurrence_nodes(s, d):
    t = _terms(s, d)
    years = t.groupBy("term").agg(F.round(F.avg(F.when(F.col("year") > 0, F.col("year"))), 1).alias("year_mean"))
    return networks.term_nodes(t, LEAST).join(years, "term").withColumn("size", (10 + 2 * F.col("occurrences")).cast("int"))


TOP_NODES = f"nodes as (select item from occ where n >= {LEAST} order by round({RELEVANCE}, 6) desc, item limit 40)"


@query(f"with {C}, {KW}, {OCC}, {TOP_NODES}, {SETS}, {EDGES} select src, dst, weight from edges")
def cooccurrence_top_nodes(s, d):
    t = _terms(s, d)
    return networks.cooccurrence(t, networks.term_nodes(t, LEAST, max_nodes=40))


@query(f"with {C}, {KW}, {OCC}, k as (select greatest(1, cast(floor(count(*) * 2.5 / 100) as int)) k from occ where n >= {LEAST}), r as (select item, row_number() over (order by round({RELEVANCE}, 6) desc, item) r from occ where n >= {LEAST}) select item term from r, k where r <= k")
def top_percent_nodes(s, d):
    return networks.term_nodes(_terms(s, d), LEAST, top_percent=2.5).select("term")


@query(f"with {C}, {KW}, {OCC}, nodes as (select item from occ where n >= 2 and item in (select lower(trim(term)) from thesaurus)), {SETS}, {EDGES} select src, dst, weight from edges")
def cooccurrence_allowed(s, d):
    t = _terms(s, d)
    allowed = table(s, d, "thesaurus").select(F.lower(F.trim("term")).alias("term"))
    return networks.cooccurrence(t, networks.term_nodes(t, 2, allowed=allowed))


WORDS = "list_filter(regexp_extract_all(lower({0}), '[a-záéíóúàâêôãõüç\\-]+'), lambda x: length(x) > 2 and not list_contains(s.w, x))"
GRAMS = "grams as (select rec_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) item from words)"
#: A short list for the checks, so that both sides need no shared file.
CHECK_STOPS = ["the", "and", "for", "with", "from", "that", "this", "uma", "dos", "das", "para", "com", "los", "las", "des", "les", "und", "der", "die", "del"]
STOP_CTE = "s as (select [" + ", ".join(f"'{w}'" for w in CHECK_STOPS) + "] w)"


@query(f"with {C}, {STOP_CTE}, words as (select rec_id, {WORDS.format('abstract')} w from c, s), {GRAMS} select item term, count(*) occurrences, count(distinct rec_id) doc_freq from grams group by 1")
def ngrams_1_3(s, d):
    t = _c(s, d).select("rec_id", F.explode(ngrams(tokens(F.col("abstract"), CHECK_STOPS))).alias("term"))
    return counts(t)


@query(f"with {C}, {STOP_CTE}, words as (select rec_id, {WORDS.format('title')} w from c, s), {GRAMS}, occ as (select item, count(*) n from grams group by 1), ds as (select distinct rec_id, item from grams semi join (select item from occ where n >= {LEAST}) using (item)), {EDGES} select src, dst, weight from edges")
def title_cooccurrence(s, d):
    t = doc_terms(_c(s, d), "titles", CHECK_STOPS)
    return networks.cooccurrence(t, networks.term_nodes(t, LEAST))


@query(f"with {C}, {KW}, th as (select lower(trim(term)) term, arg_max(lower(trim(canonical)), row_no) canonical from thesaurus where trim(coalesce(term,'')) <> '' and trim(coalesce(canonical,'')) <> '' group by 1) select coalesce(canonical, item) term, count(*) occurrences, count(distinct rec_id) doc_freq from kw left join th on th.term = item group by 1")
def thesaurus_counts(s, d):
    return counts(with_thesaurus(_terms(s, d), table(s, d, "thesaurus")))


NAMES = f"with {C}, {AU}, many as (select item from au group by 1 having count(*) >= 3), ds as (select distinct rec_id, item from au semi join many using (item))"


@query(f"{NAMES}, {EDGES} select src, dst, weight from edges")
def coauthorship(s, d):
    return networks.coauthorship(_c(s, d), 3)[1]


@query(f"{NAMES}, size as (select rec_id, count(*) k from ds group by 1) select a.item src, b.item dst, round(sum(1.0::double / k), 4) weight from ds a join ds b on a.rec_id = b.rec_id and a.item < b.item join size on size.rec_id = a.rec_id group by 1, 2")
def coauthorship_fractional(s, d):
    return networks.coauthorship(_c(s, d), 3, "fractional")[1]


RF = _items("rf", "refs", "semicolon")


@query(f"with {C}, {RF}, ds as (select distinct rec_id, item from rf), {EDGES} select src, dst, weight from edges where weight >= 3")
def cocitation(s, d):
    return networks.cocitation(_c(s, d), 3)


@query(f"with {C}, {RF}, ds as (select distinct rec_id, item from rf) select a.rec_id src, b.rec_id dst, count(*) weight from ds a join ds b on a.item = b.item and a.rec_id < b.rec_id group by 1, 2 having count(*) >= 2")
def coupling(s, d):
    return networks.coupling(_c(s, d), 2)


def _doi(x: str) -> str:
    out = f"trim(lower({x}), '{EDGE_BLANKS}')"
    for p in ("https://doi.org/", "http://doi.org/", "https://dx.doi.org/", "http://dx.doi.org/", "doi:"):
        out = f"regexp_replace({out}, '^{p}[ ]*', '')"
    return f"regexp_replace({out}, '/+$', '')"


SURNAME = f"lower(trim(string_split(string_split(authors, ';')[1], ',')[1], '{EDGE_BLANKS}'))"
YEAR = "coalesce(try_cast(nullif(regexp_extract({0}, '\\b((?:19|20)[0-9][0-9])\\b', 1), '') as int), 0)"


@query(f"""with {C}, {RF}, me as (select rec_id, {_doi('doi')} d, {SURNAME} surname, "year" from c),
bd as (select d, max(rec_id) by_doi from me where d <> '' group by 1), bn as (select surname, "year" y, max(rec_id) by_name from me where surname <> '' and "year" > 0 group by 1, 2),
r as (select rec_id, {_doi('item')} d, lower(regexp_extract(item, '^([^\\s,;]+)', 1)) surname, {YEAR.format('item')} y from rf)
select distinct r.rec_id src, coalesce(by_doi, by_name) dst, case when by_doi is not null then 'doi' else 'author_year' end how from r left join bd using (d) left join bn on bn.surname = r.surname and bn.y = r.y
where coalesce(by_doi, by_name) is not null and coalesce(by_doi, by_name) <> r.rec_id""")  # fmt: skip
def direct_citation(s, d):
    return networks.direct_citations(_c(s, d))


@query(f"with {C}, {_items('ic', 'ipc', 'semicolon')}, ds as (select distinct rec_id, upper(item)[1:4] item from ic), {EDGES} select src, dst, weight from edges")
def patent_classes(s, d):
    return networks.patent_classes(_c(s, d))[1]


@query(f"with {C}, {_items('a', 'authors', 'semicolon')}, {_items('k', 'keywords', 'semicolon')} select a.item author, k.item keyword, count(*) weight from a join k using (rec_id) group by 1, 2 having count(*) >= 2")
def bipartite(s, d):
    return networks.bipartite(_c(s, d), 2)


@query(f"""with {C}, top as (select rec_id, "year", lower(doi) doi, lower(refs) refs, coalesce(nullif(regexp_replace(list_last(regexp_split_to_array(trim(string_split(authors, ';')[1], ' '), '\\s+')), '[^A-Za-z\\-]', '', 'g'), ''), 'Anon') author from c order by citations desc, rec_id limit 200)
select u.rec_id src, v.rec_id dst from top u, top v where u.rec_id <> v.rec_id and u."year" >= v."year" and ((length(v.doi) > 4 and contains(u.refs, v.doi)) or (length(v.author) > 2 and contains(u.refs, lower(v.author)) and contains(u.refs, cast(v."year" as varchar))))""")  # fmt: skip
def historiograph_edges(s, d):
    return networks.historiograph(_c(s, d), 200)[1]


def _top(expression: str, sep: str) -> str:
    return f"with {C}, {_items('i', expression, sep)} select item, count(*) n from i group by 1 order by n desc, item limit 20"


@query(_top("lower(keywords)", "auto"))
def top_keywords(s, d):
    return metrics.top_items(_c(s, d), "keywords", lower=True)


@query(_top("authors", "auto"))
def top_authors(s, d):
    return metrics.top_items(_c(s, d), "authors")


@query(f"with {C} select source item, count(*) n from c group by 1 order by n desc, item limit 20")
def top_sources(s, d):
    return metrics.top_items(_c(s, d), "source", "whole")


@query(_top("refs", "semicolon"))
def top_references(s, d):
    return metrics.top_items(_c(s, d), "refs", "semicolon")


@query(f"""with {C}, {AU}, r as (select item author, citations, row_number() over w i, sum(citations) over (w rows unbounded preceding) upto from au window w as (partition by item order by citations desc, rec_id, pos))
select author, count(*) papers, count(*) filter (citations >= i) h, cast(coalesce(max(case when upto >= i * i then i end), 0) as bigint) g, round(avg(citations), 4) citations_mean from r group by 1""")  # fmt: skip
def author_h_g_index(s, d):
    return metrics.author_indices(_c(s, d))


@query(f'with {C} select count(*) papers, min("year") year_min, max("year") year_max, max(citations) citations_max, round(avg(citations), 2) citations_mean from c')
def corpus_summary(s, d):
    return metrics.summary(_c(s, d))


KNOWN = 'case when "year" > 0 then "year" end'


@query(f"with {C} select count(*) papers, min({KNOWN}) year_min, max({KNOWN}) year_max, cast(floor(median({KNOWN})) as int) year_median, cast(sum(citations) as bigint) citations_sum, round(avg(citations), 2) citations_mean, max(citations) citations_max from c")
def descriptive_stats(s, d):
    return metrics.descriptive(_c(s, d))


YEARLY = 'pub as (select "year", count(*) n from c where "year" > 0 group by 1)'


@query(f'with {C}, {YEARLY} select "year", n from pub')
def yearly_counts(s, d):
    return metrics.yearly(_c(s, d))


@query(f'with {C}, {YEARLY}, e as (select min("year") first_year, max("year") last_year, arg_min(n, "year") first_n, arg_max(n, "year") last_n from pub) select *, case when last_year > first_year then round(pow(last_n / first_n, 1.0 / (last_year - first_year)) - 1, 6) end cagr from e')
def cagr(s, d):
    return metrics.growth(_c(s, d))


@query(f"""with {C}, n as (select source, count(*) n from c group by 1), r as (select n, row_number() over w rk, sum(n) over (w rows unbounded preceding) cum, sum(n) over () t from n window w as (order by n desc, source)),
e1 as (select min(rk) e1 from r where cum >= t / 3.0), e2 as (select min(rk) e2 from r, e1 where cum >= 2 * t / 3.0 and rk > e1)
select case when rk <= e1 then 1 when rk <= e2 then 2 else 3 end as "zone", count(*) sources, cast(max(cum) as bigint) articles from r, e1, e2 where e2 is not null group by 1""")  # fmt: skip
def bradford_zones(s, d):
    return metrics.bradford(_c(s, d))


@query(f"with {C}, {AU}, a as (select item, count(*) papers from au group by 1), n as (select papers, count(*) authors from a group by 1) select papers, authors, cast(round_even((select authors from n where papers = 1) / (papers * papers), 0) as bigint) expected from n order by papers limit 8")
def lotka(s, d):
    return metrics.lotka(_c(s, d))


@query(f"""with {C}, {KW}, t as (select item term, count(*) filter ("year" >= {LAST_YEAR} - 2) recent, count(*) filter ("year" between {LAST_YEAR} - 7 and {LAST_YEAR} - 3) early from kw where "year" > 0 and "year" <= {LAST_YEAR} group by 1)
select term, recent, early, round(recent / (early + 0.5), 6) ratio from t where recent >= 2 order by ratio desc, term limit 15""")  # fmt: skip
def rising_terms(s, d):
    return metrics.rising(_terms(s, d), _c(s, d), last=LAST_YEAR)


@query(f"with {C}, {AU}, a as (select item, count(*) papers from au group by 1) select count(*) authors, count(*) filter (papers = 1) single, round(count(*) filter (papers = 1) / count(*), 6) \"share\" from a")
def single_paper_authors(s, d):
    return metrics.single_paper_share(_c(s, d))


CALENDAR = f'{YEARLY}, cal as (select y "year", coalesce(n, 0) pubs from (select unnest(range((select min("year") from pub), (select max("year") from pub) + 1)) y) left join pub on pub."year" = y)'


@query(f"""with {C}, {KW}, {CALENDAR}, often as (select item from kw where "year" > 0 group by 1 having count(*) >= 4), py as (select item, "year", count(*) n from kw where "year" > 0 group by 1, 2),
f as (select o.item, cal."year", coalesce(py.n, 0) n, coalesce(py.n, 0) * 1000.0::double / greatest(pubs, 1) f from often o cross join cal left join py on py.item = o.item and py."year" = cal."year"),
z as (select item, "year", n, (f - avg(f) over w) / nullif(stddev_pop(f) over w, 0) z from f window w as (partition by item)),
h as (select item, "year", z, "year" - row_number() over (partition by item order by "year") g from z where z > 1.645 and n >= 1)
select item term, cast(min("year") as int) start, cast(max("year") as int) as "end", round(sum(z), 4) strength from h group by item, g""")  # fmt: skip
def bursts(s, d):
    return metrics.bursts(_terms(s, d), _c(s, d))


@query(f"""with {C}, {KW}, {CALENDAR}, best as (select item from kw group by 1 order by count(*) desc, item limit 14), n as (select item, "year", count(distinct rec_id) n from kw group by 1, 2)
select best.item term, cast(cal."year" as int) "year", coalesce(n.n, 0) n from best cross join cal left join n on n.item = best.item and n."year" = cal."year" """)  # fmt: skip
def trends(s, d):
    return metrics.trends(_terms(s, d), _c(s, d))


@query(f"""with {C}, p as (select *, cast(f + ("year" - f) // 5 * 5 as int) period from (select *, (select min("year") from c where "year" > 0) f from c where "year" > 0)),
papers as (select period, count(*) papers from p group by 1 having count(*) >= 3), t as (select period, rec_id, unnest({_list('lower(keywords)', 'auto')}) item from p),
n as (select period, item, count(*) n from t group by 1, 2 having count(*) >= 3), ds as (select distinct period, rec_id, item from t semi join n using (period, item)),
e as (select period, count(*) m from (select distinct a.period, a.item, b.item from ds a join ds b on a.period = b.period and a.rec_id = b.rec_id and a.item < b.item) group by 1),
v as (select period, count(*) k, array_to_string(list_slice(list(item order by n desc, item), 1, 5), '; ') tops from n group by 1)
select period, papers, coalesce(k, 0) nodes, coalesce(m, 0) edges, case when k > 1 then round(2.0::double * coalesce(m, 0) / (k * (k - 1)), 6) else 0.0 end density, coalesce(tops, '') top_terms from papers left join v using (period) left join e using (period)""")  # fmt: skip
def temporal_evolution(s, d):
    return metrics.evolution(_c(s, d))


@query()
def temporal_clusters(s, d):
    papers, nodes, edges = metrics.period_networks(_c(s, d))
    return papers.select("period").join(graph.communities_by(nodes, edges, "period"), "period", "left").select("period", F.coalesce("clusters", F.lit(0)).alias("clusters"))


def _best(rel: str, col: str) -> str:
    return f"(select {col} from {rel} group by 1 order by count(*) desc, {col} limit 10)"


SANKEY = f"with {C}, {{0}}, l as (select rec_id, source item from c where source <> '')"


@query(f"""{SANKEY.format(f'{AU}, {KW}')}, l2 as (select * from l where item in {_best('l', 'item')}), m2 as (select * from au where item in {_best('au', 'item')}), r2 as (select * from kw where item in {_best('kw', 'item')})
select 'left' side, l2.item src, m2.item dst, count(*) weight from l2 join m2 using (rec_id) group by all union all select 'right', m2.item, r2.item, count(*) from m2 join r2 using (rec_id) group by all""")  # fmt: skip
def sankey_row_topn(s, d):
    return metrics.sankey(_c(s, d))


@query(f"""{SANKEY.format(_items('m', 'authors', 'semicolon') + ', ' + _items('r', 'lower(keywords)', 'semicolon'))}, one as (select l.item src, m.item dst from l join m using (rec_id)), two as (select m.item src, r.item dst from m join r using (rec_id)),
centre as (select dst item from {_best('one', 'dst')} union select src from {_best('two', 'src')})
select 'left' side, src, dst, count(*) weight from one where src in {_best('one', 'src')} and dst in (select item from centre) group by all union all select 'right', src, dst, count(*) from two where src in (select item from centre) and dst in {_best('two', 'dst')} group by all""")  # fmt: skip
def sankey_relation_topn(s, d):
    return metrics.sankey(_c(s, d), by="relations")


@query(f"with {C}, {AU}, {KW} select au.item author, kw.item keyword, count(*) n from au join kw using (rec_id) where au.pos < 5 and kw.pos < 5 group by 1, 2 order by n desc, author, keyword limit 15")
def author_keyword_pairs(s, d):
    return metrics.author_keyword_pairs(_c(s, d))


PAPER_LABEL = "case when authors = '' then 'Unknown' else left(string_split(authors, ';')[1], 25) end || ' (' || \"year\" || ')'"
STATS = """count(*) papers, round(avg(case when "year" > 0 then "year" end), 1) year_mean, round(avg(citations), 1) citations_mean, cast(sum(citations) as bigint) citations_sum"""


@query(f"""with {C}, {KW}, {AU}, best as (select * from c order by citations desc, rec_id limit 60), labels as (select distinct item "label", lower(item) k from (select item from kw group by 1 having count(*) >= {LEAST} union select item from au group by 1 having count(*) >= 10 union select left(title, 24) from best union select {PAPER_LABEL} from best)),
one as (select distinct "label", 'keyword' matched, kw.rec_id, kw."year", kw.citations from labels join kw on kw.item = k), r1 as (select * from labels where "label" not in (select "label" from one) and k <> ''),
two as (select distinct "label", 'author' matched, au.rec_id, au."year", au.citations from r1 join au on lower(au.item) = k), r2 as (select * from r1 where "label" not in (select "label" from two)),
three as (select distinct "label", 'title' matched, c.rec_id, c."year", c.citations from r2 join c on contains(lower(title), k)), r3 as (select *, regexp_replace(regexp_replace(k, '[0-9]+', '', 'g'), '^[() ,]+|[() ,]+$', '', 'g') who, {YEAR.format('"label"')} y from r2 where "label" not in (select "label" from three)),
four as (select distinct "label", 'author_year' matched, c.rec_id, c."year", c.citations from r3 join c on who <> '' and y > 0 and c."year" = y and contains(lower(authors), who))
select "label", matched, {STATS} from (select * from one union all select * from two union all select * from three union all select * from four) group by 1, 2""")  # fmt: skip
def overlay_scores(s, d):
    c = _c(s, d)
    names = items(c, "authors").groupBy("item").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select(F.col("item").alias("label"))
    best = c.orderBy(F.desc("citations"), "rec_id").limit(60)  # the nodes of a historiograph or citation map
    titles, papers = best.select(F.substring("title", 1, 24).alias("label")), networks.first_labels(best).select("label")
    return networks.overlay(c, _nodes(s, d).select(F.col("term").alias("label")).union(names).union(titles).union(papers).distinct())


#: A fixed partition, so that both sides agree on it.
PART = "part as (select item node, cast(length(item) % 5 as int) cluster_id from nodes)"
WAYS = "ways as (select src node, dst other, weight from edges union all select dst, src, weight from edges)"
DEG = "deg as (select node, count(*) degree, round(sum(weight), 6) weighted_degree from ways group by 1)"


def _parts(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("term").alias("node"), (F.length("term") % 5).cast("int").alias("cluster_id"))


def _parted(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _network(s, d)
    return edges, _parts(nodes)


COLORS = "[" + ", ".join(f"'{c}'" for c in graph.PALETTE) + "]"


@query(f"{NET}, {PART}, {WAYS}, {DEG}, t as (select cluster_id, node, row_number() over (partition by cluster_id order by coalesce(weighted_degree, 0) desc, node) r from part left join deg using (node)) select cluster_id, (select count(*) from part p where p.cluster_id = t.cluster_id) size, {COLORS}[cluster_id % 8 + 1] color, string_agg(node, '; ' order by r) top_nodes from t where r <= 5 group by 1")
def cluster_report(s, d):
    return graph.cluster_report(*_parted(s, d))


CALLON = f"""{NET}, {PART}, {WAYS}, {DEG}, e as (select weight, a.cluster_id ca, b.cluster_id cb from edges join part a on a.node = src join part b on b.node = dst),
x as (select cluster_id, sum(w) w from (select ca cluster_id, weight w from e where ca <> cb union all select cb, weight from e where ca <> cb) group by 1), i as (select ca cluster_id, sum(weight) w from e where ca = cb group by 1),
h as (select cluster_id, count(*) size, arg_min(node, r) as "label" from (select *, row_number() over (partition by cluster_id order by coalesce(weighted_degree, 0) desc, node) r from part left join deg using (node)) group by 1),
themes as (select cluster_id, size, round(coalesce(x.w, 0)::double, 4) centrality, round(coalesce(i.w, 0) / size, 4) density, "label" from h left join x using (cluster_id) left join i using (cluster_id))"""


@query(f"{CALLON} select * from themes")
def callon_map(s, d):
    return graph.callon(*_parted(s, d))


@query(f"{CALLON}, m as (select median(centrality) mc, median(density) md from themes) select themes.*, case when centrality >= mc and density >= md then 'motor' when centrality >= mc then 'basic' when density >= md then 'niche' else 'emerging' end quadrant from themes, m")
def callon_quadrants(s, d):
    return graph.quadrants(graph.callon(*_parted(s, d)))


@query()
def louvain_report(s, d):
    edges = _network(s, d)[1]
    return graph.cluster_report(edges, cut(graph.communities(edges), "clusters"))


@query()
def louvain_themes(s, d):
    names, edges = networks.numbered_cooccurrence(_terms(s, d), LEAST)
    themes = graph.callon(edges, cut(graph.communities(edges), "clusters")).withColumnRenamed("label", "no").join(names, "no")
    return graph.quadrants(themes.select("cluster_id", "size", "centrality", "density", F.col("term").alias("label")))


@query(f"{NET}, {WAYS}, {DEG} select * from deg")
def degree(s, d):
    return graph.degrees(_edges(s, d))


@query(f"{NET}, {WAYS} select n nodes, m edges, case when n > 1 then round(2.0::double * m / (n * (n - 1)), 6) else 0.0 end density from (select count(distinct node) n from ways), (select count(*) m from edges)")
def density(s, d):
    return graph.density(_network(s, d)[1])


@query(f"{NET}, {WAYS}, {DEG} select round(avg(degree), 6) degree_mean, max(degree) degree_max, (select node from deg order by degree desc, node limit 1) node_max from deg")
def degree_stats(s, d):
    return graph.degree_stats(_edges(s, d))


FAMILY = f"with recursive {C}, {AU}, ds as (select distinct rec_id, item from au semi join (select item from au group by 1 having count(*) >= 3) using (item)), {EDGES}, {WAYS}, reach(node, other) using key (node) as (select node, node from ways union select ways.other, min(reach.other) from reach join ways on ways.node = reach.node join recurring.reach known on known.node = ways.other where reach.other < known.other group by 1)"


@query(f"{FAMILY} select node, other component from reach")
def components(s, d):
    return graph.components(networks.coauthorship(_c(s, d), 3)[1])


@query(f"{FAMILY}, comp as (select node, other c from reach), big as (select c from comp group by 1 order by count(*) desc, c limit 1) select src, dst, weight from edges where src in (select node from comp join big using (c))")
def largest_component(s, d):
    return graph.largest_component(networks.coauthorship(_c(s, d), 3)[1])


@query(f"""{NET}, {WAYS}, {DEG}, e as (select src a, dst b, weight::double / (select max(weight) from edges) w from edges), t as (select x.a p, x.b q, y.b r, pow(x.w * y.w * z.w, 1.0::double / 3) t from e x join e y on y.a = x.b join e z on z.a = x.a and z.b = y.b),
u as (select node, sum(t) t from (select p node, t from t union all select q, t from t union all select r, t from t) group by 1)
select node, round(case when degree > 1 then coalesce(2 * t / (degree * (degree - 1)), 0) else 0 end, 6) coefficient from deg left join u using (node)""")  # fmt: skip
def clustering_coefficient(s, d):
    return graph.clustering(_edges(s, d))


ROUNDS = 5


def _pagerank_sql() -> str:
    steps = [f"{NET}, {WAYS}, outs as (select node, sum(weight) t from ways group by 1), n as (select count(*)::double n from outs), r0 as (select node, 1 / n r from outs, n)"]
    for k in range(ROUNDS):
        steps.append(f"r{k + 1} as (select o.node, 0.15::double / n + 0.85::double * coalesce(g, 0) r from outs o cross join n left join (select other node, sum(r * weight / t) g from ways join outs using (node) join r{k} using (node) group by 1) x using (node))")
    return ", ".join(steps) + f" select node, round(r, 9) as \"rank\" from r{ROUNDS}"


@query(_pagerank_sql())
def pagerank_fixed_iter(s, d):
    return graph.pagerank(_edges(s, d), ROUNDS)


def _eigenvector_sql() -> str:
    steps = [f"{NET}, {WAYS}, e0 as materialized (select distinct node, 1.0::double x from ways)"]
    for k in range(ROUNDS):
        steps.append(f"y{k} as (select e.node, e.x + coalesce(g, 0) y from e{k} e left join (select ways.node, sum(x * weight) g from ways join e{k} o on o.node = ways.other group by 1) using (node)), e{k + 1} as materialized (select node, y / sqrt((select sum(y * y) from y{k})) x from y{k})")
    return ", ".join(steps) + f" select node, round(x, 6) centrality from e{ROUNDS}"


@query(_eigenvector_sql())
def eigenvector_fixed_iter(s, d):
    return graph.eigenvector(_edges(s, d), ROUNDS, 0.0)


@query()
def eigenvector(s, d):
    return graph.eigenvector(_edges(s, d))


#: More levels than the networks of the checks have; levels beyond the last node are empty.
LEVELS = 9


def _levels_sql(net: str, nodes: str) -> str:
    """Tables v0, v1, ... of (s, node, k): nodes that many steps from s and the numbers of shortest paths to them."""
    steps = [f"{net}, v0 as materialized (select node s, node, 1.0::double k from {nodes}), seen0 as materialized (select s, node from v0)"]
    for i in range(1, LEVELS + 1):
        back = " ".join(f"anti join v{j} using (s, node)" for j in (i - 1, i - 2) if j >= 0)
        steps.append(f"v{i} as materialized (select * from (select s, other node, sum(k) k from v{i - 1} join ways using (node) group by 1, 2) {back})")
    return ", ".join(steps)


def _between() -> str:
    """A table of betweenness: (node, betweenness)."""
    steps = [_levels_sql(f"{NET}, {WAYS}", "(select distinct node from ways)"), f"o{LEVELS} as (select s, node, k, 0.0::double owed from v{LEVELS})"]
    for i in range(LEVELS - 1, -1, -1):
        steps.append(f"o{i} as materialized (select v.s, v.node, v.k, coalesce(v.k * g, 0) owed from v{i} v left join (select b.s, ways.other node, sum((1 + owed) / b.k) g from o{i + 1} b join ways on ways.node = b.node group by 1, 2) x on x.s = v.s and x.node = v.node)")
    every = " union all ".join(f"select s, node, owed from o{i}" for i in range(LEVELS))
    return ", ".join(steps) + f", nn as (select count(distinct node) n from ways), bt as (select node, round(sum(case when s <> node then owed else 0 end) / ((n - 1) * (n - 2)), 4) betweenness from ({every}), nn group by node, n)"


@query(f"{_between()} select * from bt")
def betweenness(s, d):
    return graph.betweenness(_network(s, d)[1])


@query(f"""{NET.replace('with ', 'with recursive ', 1)}, {WAYS}, far(s, node, d) using key (s, node) as (select distinct node, node, 0.0::double from ways union
select far.s, ways.other, min(far.d + weight) from far join ways using (node) left join recurring.far known on known.s = far.s and known.node = ways.other where known.d is null or far.d + weight < known.d group by 1, 2),
t as (select s, sum(d) total, count(*) - 1 reached from far group by 1) select s node, round(case when total > 0 then reached / total * reached / ((select count(distinct node) from ways) - 1) else 0 end, 6) closeness from t""")  # fmt: skip
def closeness(s, d):
    return graph.closeness(_network(s, d)[1])


PART_OF = "reach(node, other) using key (node) as (select node, node from every union select every.other, min(reach.other) from reach join every on every.node = reach.node join recurring.reach known on known.node = every.other where reach.other < known.other group by 1)"


@query(f"""{_levels_sql(f"{NET.replace('with ', 'with recursive ', 1)}, {WAYS.replace('ways as', 'every as')}, {PART_OF}, big as (select other c from reach group by 1 order by count(*) desc, c limit 1), ways as materialized (select every.* from every join reach on reach.node = every.node join big on big.c = reach.other)", '(select distinct node from ways)')},
l as ({" union all ".join(f"select s, {i} d from v{i}" for i in range(LEVELS + 1))}) select max(d) diameter, round(sum(d) / (count(*) filter (d > 0)), 6) path_mean from l""")  # fmt: skip
def path_lengths(s, d):
    return graph.path_lengths(_network(s, d)[1])


@query("""with c as (select r_name, min(n_name) "first", count(*) n from nation join region on r_regionkey = n_regionkey group by 1) select n_name node, cast(row_number_ - 1 as int) cluster_id from nation join region on r_regionkey = n_regionkey join (select r_name, row_number() over (order by n desc, "first") row_number_ from c) using (r_name)""")
def louvain_planted(s, d):
    """Nations of one region are tied closely, consecutive ones of two regions loosely; the regions must come out."""
    n = table(s, d, "nation").select("n_name", "n_regionkey", "n_nationkey")
    a, b = n.toDF("src", "ra", "ka"), n.toDF("dst", "rb", "kb")
    near = a.join(b, F.col("ra") == F.col("rb")).filter("src < dst").select("src", "dst", F.lit(10.0).alias("weight"))
    far = a.join(b, F.col("kb") == F.col("ka") + 1).filter("ra <> rb").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.lit(0.5).alias("weight"))
    return graph.communities(near.unionByName(far))


@query()
def louvain(s, d):
    return graph.communities(_network(s, d)[1])


@query()
def label_propagation(s, d):
    return graph.numbered(graph.label_propagation(_edges(s, d)))


@query(f"{NET}, {PART}, {WAYS}, {DEG}, m as (select sum(weight) m from edges), i as (select a.cluster_id, sum(weight) w from edges join part a on a.node = src join part b on b.node = dst and a.cluster_id = b.cluster_id group by 1), g as (select cluster_id, sum(weighted_degree) d from deg join part using (node) group by 1) select round(sum(coalesce(w, 0) / m - pow(d / (2 * m), 2)), 6) modularity from g left join i using (cluster_id), m")
def modularity(s, d):
    return graph.modularity(*_parted(s, d))


@query()
def layout(s, d):
    return graph.layout(_network(s, d)[1], 60)


@query(f"{NET}, {WAYS} select * from ways")
def adjacency(s, d):
    return exports.adjacency(_edges(s, d))


IDS = f'ids as (select row_number() over (order by item) id, item as "label", n weight, round({RELEVANCE}, 6) relevance, df doc_freq from occ where n >= {LEAST})'


@query(f"{NET}, {IDS} select * from ids")
def vos_map(s, d):
    return exports.vos_map(*_network(s, d))[0]


@query(f'{NET}, {IDS} select a.id id_a, b.id id_b, edges.weight from edges join ids a on a."label" = src join ids b on b."label" = dst')
def vos_network(s, d):
    return exports.vos_map(*_network(s, d))[1]


@query(f"""{NET}, {PART}, {IDS}, t as (select min(weight) a, max(weight) b from ids), n as (select "label" id, "label", round(case when b > a then 10 + (weight - a) / (b - a)::double * 30 else 25 end, 2) size, {COLORS}[cluster_id % 8 + 1] color, cluster_id "cluster", weight occurrences, doc_freq, cast(relevance as decimal(18,6)) relevance from ids join part on node = "label", t)
select 'node' part, cast(to_json(n) as varchar) as "value" from n union all select 'edge', cast(to_json(e) as varchar) from (select src source, dst target, weight from edges) e""")  # fmt: skip
def topology_json(s, d):
    nodes, edges = _network(s, d)
    return exports.topology_json(nodes, edges, _parts(nodes))


@query(f"""{NET}, {IDS} select 0 place, '*vertices ' || (select count(*) from ids) line union all select 1, id || ' "' || replace("label", '"', '&quot;') || '"' from ids union all select 2, '*edges' union all
select 3, a.id || ' ' || b.id || ' ' || edges.weight from edges join ids a on a."label" = src join ids b on b."label" = dst""")  # fmt: skip
def pajek_lines(s, d):
    return exports.pajek(*_network(s, d))


@query(f"""{_between()}, {PART}, {DEG}, y as (select item, round(avg(case when "year" > 0 then "year" end), 1) year_mean from kw group by 1) select item node, coalesce(degree, 0) "degree", coalesce(weighted_degree, 0) weighted_degree, coalesce(betweenness, 0) betweenness, cluster_id, {COLORS}[cluster_id % 8 + 1] color,
n occurrences, df doc_freq, round({RELEVANCE}, 6) relevance, year_mean from occ join part on part.node = item left join deg on deg.node = item left join bt on bt.node = item join y using (item) where n >= {LEAST}""")  # fmt: skip
def node_ranking(s, d):
    nodes, edges = _network(s, d)
    years = _terms(s, d).groupBy("term").agg(F.round(F.avg(F.when(F.col("year") > 0, F.col("year"))), 1).alias("year_mean"))
    return exports.node_ranking(nodes.join(years, "term"), edges, _parts(nodes), graph.betweenness(edges))


@query(f"{NET}, {WAYS} select node, place, other, weight from (select node, other, weight, row_number() over (partition by node order by weight desc, other) place from ways) where place <= 8")
def node_neighbours(s, d):
    return graph.top_neighbours(_edges(s, d))


@query(f"{NET}, {WAYS} select item term from nodes where item in (select node from ways)")
def linked_nodes(s, d):
    nodes, edges = _network(s, d)
    return graph.without_isolates(nodes, edges).select("term")


@query(f"{NET}, k as (select greatest(1, floor(count(*) * 0.2)) k from edges) select src, dst, weight from (select *, row_number() over (order by weight desc, src, dst) r from edges), k where r <= k")
def heaviest_edges(s, d):
    return graph.heaviest(_network(s, d)[1])


@query(f"{NET}, {PART} select node, cluster_id from part where contains(node, 'net') and cluster_id not in (1, 3)")
def found_nodes(s, d):
    return graph.find_nodes(_parts(_nodes(s, d)), "NET", [1, 3])


@query(f'{NET}, {PART} select count(*) papers, min("year") year_min, max("year") year_max, max(citations) citations_max, round(avg(citations), 2) citations_mean, n nodes, m edges, k clusters, case when n > 1 then round(2.0::double * m / (n * (n - 1)), 4) else 0 end density from c, (select count(*) n from nodes), (select count(*) m from edges), (select max(cluster_id) + 1 k from part) group by n, m, k')
def network_summary(s, d):
    nodes, edges = _network(s, d)
    return metrics.network_summary(_c(s, d), nodes, edges, _parts(nodes))


TITLE = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
KEY = "trim(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{M}\\p{N}_\\s]|_', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"with {C} select rec_id, {_doi('doi')} doi_key, {TITLE} title_key, {KEY} dedup_key, {SURNAME} surname, {YEAR.format('refs')} first_year from c")
def text_keys(s, d):
    return _c(s, d).select("rec_id", normalised_doi("doi").alias("doi_key"), normalised_title("title").alias("title_key"), dedup_key("title").alias("dedup_key"), first_surname("authors").alias("surname"), year_of("refs").alias("first_year"))


@query("select min(rec_id) rec_id from records group by coalesce(doi, ''), coalesce(title, '')")
def merge_exact(s, d):
    return dedup.merge_exact(table(s, d, "records")).select("rec_id")


RANK = "case " + " ".join(f"when o = '{k}' then {v}" for k, v in dedup.ORIGIN_ORDER.items()) + " else 9 end"


@query(f"with {C}, b as (select rec_id, {_doi('doi')} d, {RANK} r from (select *, lower(regexp_replace(origin, '[\\s\\x{{A0}}]+', '', 'g')) o from c)), k as (select *, first(rec_id) over (partition by d order by r, rec_id) keep_id from b where d <> '') select keep_id, rec_id remove_id from k where keep_id <> rec_id")
def dedup_doi(s, d):
    return dedup.doi_duplicates(table(s, d, "records"))


@query()
def dedup_passes(s, d):
    return dedup.duplicates(table(s, d, "records"))


@query()
def dedup_greedy(s, d):
    return dedup.fuzzy_kept(table(s, d, "records")).select("rec_id")


@query()
def author_spellings(s, d):
    return dedup.harmonise_authors(_c(s, d))


@query(f"with {C}, f as (select 'language' facet, \"language\" as \"value\" from c union all select 'year', cast(\"year\" as varchar) from c union all select 'source', source from c), n as (select facet, \"value\", count(*) n from f group by 1, 2) select * from n qualify row_number() over (partition by facet order by n desc, \"value\") <= 3")
def facets(s, d):
    return metrics.facet_counts(_c(s, d))


@query(f"with {C} select rec_id, \"year\", source from c where \"year\" >= 2000 and \"year\" <= 2015 and is_oa and \"language\" = 'en' and source not in ('', 'Nature')")
def facet_filter(s, d):
    return metrics.facet_filter(_c(s, d), 2000, 2015, True, "en", ["", "Nature"]).select("rec_id", "year", "source")


@query(f"with {C}, t as (select source from c where source <> '' group by 1 order by count(*) desc, source limit 10) select rec_id from c where not (source in (select source from t) and source not in ('Nature')) and \"year\" >= 2000")
def facet_sources(s, d):
    return metrics.facet_filter(_c(s, d), 2000, checked_sources=["Nature"]).select("rec_id")


@query(f"with {C} select rec_id from c where trim(title, ' ') <> ''")
def titled_records(s, d):
    return metrics.with_titles(_c(s, d)).select("rec_id")


@query(f'with {C} select rec_id, "year", citations from c order by citations desc, rec_id limit 25 offset 25')
def second_page(s, d):
    return metrics.page(_c(s, d).select("rec_id", "year", "citations"), [F.desc("citations"), F.asc("rec_id")], 2)


SMALL = "small(l, w) as (values " + ", ".join(f"('{code}', '{w}')" for code in sorted(SMALL_WORDS) for w in small_words(code)) + ")"


@query(f"""with {SMALL}, t as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) w from documents), size as (select doc_id, count(*) n from t group by 1), k as (select doc_id, w, count(*) k from t group by 1, 2), g as (select doc_id, l, sum(k) n from k join small using (w) group by 1, 2),
best as (select doc_id, arg_min(l, (-n, l)) l, max(n) m from g group by 1) select doc_id, case when m >= 2 then l end as "language", case when m >= 2 then round(m / n, 6) else 0 end "share" from (select doc_id from documents) left join best using (doc_id) left join size using (doc_id)""")  # fmt: skip
def text_language(s, d):
    return table(s, d, "documents").select("doc_id", detected("text").alias("found")).select("doc_id", "found.language", "found.share")


@query(f"with {C}, t as (select lower(title || ' ' || abstract) t from c order by citations desc, rec_id limit 10) select count(*) judged, round(avg(case when (contains(t, 'network') or contains(t, 'rede')) and (contains(t, 'citation') or contains(t, 'cita')) then 1.0 else 0.0 end), 6) as \"precision\" from t")
def precision_at_10(s, d):
    return metrics.precision_at(_c(s, d), [["network", "rede"], ["citation", "cita"]])


@query(f"with {C} select rec_id, title, \"year\" from c where contains(lower(title), 'co-citation') and contains(lower(authors), 'el') and \"year\" >= 1990 and \"year\" <= 2020")
def field_search(s, d):
    q = Query.parse('TITLE("co-citation") AND AUTHOR(el)', since=1990, until=2020)
    return search.matches(_c(s, d), q).select("rec_id", "title", "year")


ASKED = "co-authorship network of prolific institutions and journal ranking"


@query(f"""with {C}, {STOP_CTE}, docs as (select rec_id, unnest(list_filter(regexp_extract_all(lower(abstract), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: not list_contains(s.w, x))) w from c, s where abstract <> ''), tf as (select rec_id, w, count(*) tf from docs group by 1, 2),
n as (select count(*) n from c where abstract <> ''), idf as (select w, ln((1 + n) / (1 + count(*))) + 1 idf from tf, n group by w, n), q as (select x.w, count(*) * any_value(idf) qw from (select unnest(list_filter(regexp_extract_all(lower('{ASKED}'), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: not list_contains(s.w, x))) w from s) x join idf using (w) group by 1),
sc as (select rec_id, sum(tf * idf * coalesce(qw, 0)) dot, sqrt(sum(tf * idf * tf * idf)) dn from tf join idf using (w) left join q using (w) group by 1)
select rec_id, round(dot / (dn * (select sqrt(sum(qw * qw)) from q)), 6) similarity from sc where round(dot / (dn * (select sqrt(sum(qw * qw)) from q)), 6) > 0.01 order by similarity desc, rec_id limit 5""")  # fmt: skip
def tfidf_search(s, d):
    return search.tfidf_search(_c(s, d), ASKED, stops=CHECK_STOPS)


@query()
def topics_lda(s, d):
    return search.topics(_c(s, d), rounds=5)


PAGE_AUTHORS = _list("coalesce(authors, '')", "semicolon")


@query(f"select rec_id page_id, trim(coalesce(title, ''), ' ') title, trim(coalesce(doi, ''), ' ') doi, array_to_string({PAGE_AUTHORS}, '; ') authors from records where trim(coalesce(title, ''), ' ') <> '' and trim(coalesce(doi, ''), ' ') <> ''")
def page_metadata(s, d):
    def attribute(c):
        """As pages write a value: some between double, some between single quotes."""
        marked = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
        return F.when(F.col("rec_id") % 2 == 0, F.concat(F.lit('"'), marked, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(marked, F.lit("'"), F.lit("&#39;")), F.lit("'")))

    def tag(name, c):
        return F.concat(F.lit(f'<meta name="{name}" content='), attribute(c), F.lit(">"))

    trimmed_ = lambda c: F.trim(F.coalesce(c, F.lit("")))
    r = table(s, d, "records").filter((trimmed_("title") != "") & (trimmed_("doi") != ""))
    names = F.array_join(F.transform(split_semicolon("authors"), lambda x: tag("citation_author", x)), "")
    pages = r.select(F.col("rec_id").alias("page_id"), F.concat(F.lit("<html><head>"), tag("citation_title", trimmed_("title")), tag("citation_doi", trimmed_("doi")), names, F.lit("</head></html>")).alias("html"))
    return readers.page_metadata(pages)


@query("select project, count(*) events, count(*) filter (lower(trim(coalesce(action, ''))) = 'search') searches, max(ts) last_event from backlog group by 1")
def backlog_summary(s, d):
    return metrics.project_cards(table(s, d, "backlog"))


@query(f"with {C}, {KW} select item term, count(*) n from kw where length(item) > 2 group by 1 order by n desc, term limit 200")
def word_cloud(s, d):
    return metrics.word_cloud(_terms(s, d))


@query(f'with {C} select rec_id, title, "year", citations from c order by citations desc, rec_id limit 15')
def top_cited(s, d):
    return metrics.top_cited(_c(s, d))


@query(f"with {C}, {_items('a', 'authors', 'semicolon')}, t as (select item, count(*) n from a group by 1 order by n desc, item limit 3), u as (select source item, count(*) n from c where source <> '' group by 1 order by n desc, item limit 3) select (select count(*) from c) documents, (select cast(sum(citations) as bigint) from c) citations, (select string_agg(item, '; ' order by n desc, item) from t) top_authors, (select string_agg(item, '; ' order by n desc, item) from u) top_source")
def corpus_overview(s, d):
    return metrics.overview(_c(s, d))


@query(f"{NET} select term, place, rec_id, citations from (select item term, rec_id, citations, row_number() over (partition by item order by citations desc, rec_id) place from (select distinct item, rec_id, citations from kw semi join nodes using (item))) where place <= 10")
def node_papers(s, d):
    return metrics.node_papers(_c(s, d), _nodes(s, d)).select("term", F.col("place").cast("long").alias("place"), "rec_id", "citations")


@query(f"with {C}, {_items('i', 'replace(refs, chr(10), chr(59))', 'semicolon')}, t as (select item, count(*) n from i group by 1 order by n desc, item limit 20) select item, n, regexp_extract(item, '(10\\.\\d{{4,9}}/[^\\s,;]+)', 1) doi, {YEAR.format('item')} \"year\", regexp_extract(item, '^([^\\s,;(]+)', 1) author from t")
def seminal_references(s, d):
    return exports.seminal(_c(s, d))


@query(f"with {C} select rec_id, oa_url, cast(\"year\" as varchar) || '_' || left(regexp_replace(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) || '.pdf' as \"file\" from c where is_oa and oa_url <> ''")
def open_pdfs(s, d):
    return exports.open_pdfs(_c(s, d))


def _streamed(s: SparkSession, name: str, stream: DataFrame, mode: str) -> DataFrame:
    """The rows a stream gives for all that is there, from a table of files."""
    at = new_folder(s, "stream")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return s.read.schema(stream.schema).parquet(f"{at}/out")
    seen: list[DataFrame] = []
    stream.writeStream.outputMode(mode).foreachBatch(lambda df, _: seen.append(cut(df, name))).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return seen[-1]


@query("select date_trunc('day', ts) as \"start\", event_type, count(*) n from events group by 1, 2")
def stream_counts(s, d):
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return _streamed(s, "stream", windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "36500 days"), "complete")


KEYED = f"select *, case when {_doi('coalesce(doi, chr(0))').replace('chr(0)', "''")} = '' then 'id:' || rec_id else {_doi("coalesce(doi, '')")} end k from records"


@query(f"select k as \"key\", count(distinct k) n from ({KEYED}) group by 1")
def stream_dedup(s, d):
    """One record for each DOI; which one it is depends on the order of arrival, so keys are counted."""
    r = table(s, d, "records").select("rec_id", "doi", F.col("harvested_at").cast("timestamp").alias("harvested_at"))
    at = new_folder(s, "stream")
    r.write.parquet(f"{at}/in")
    stream = s.readStream.schema(r.schema).parquet(f"{at}/in")
    out = _streamed(s, "stream", distinct_dois(stream, within="36500 days"), "append").withColumn("d", normalised_doi("doi"))
    return out.groupBy(F.when(F.col("d") == "", F.concat(F.lit("id:"), F.col("rec_id").cast("string"))).otherwise(F.col("d")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def manifest() -> str:
    """The names of the registered queries and which of them have SQL."""
    return json.dumps({n: n in SQL for n in QUERIES})
