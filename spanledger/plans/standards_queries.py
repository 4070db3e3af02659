"""Queries over standards: the parts of a brand play the catalog, customers' purchases the features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.functions import rules
from spanledger.operators import standards
from spanledger.plans.registry import query, table
from spanledger.session import materialize
from spanledger.sources.tables import catalog_issues, standards_tables

# A brand is a standard; its part names are characteristics, its sizes choose articles,
# its part types annex sections, its larger parts evidence requirements.
# A brand covers two of the three articles.
_ARTICLE = "case (cast(regexp_extract(p_brand, '[0-9]+', 0) as int) + case when p_size > 25 then 1 else 0 end) % 3 when 0 then 12 when 1 then 14 else 15 end"
_SECTION = "case p_type when 'ECONOMY' then 1 when 'SMALL' then 2 when 'MEDIUM' then 3 when 'PROMO' then 4 when 'STANDARD' then 5 else 6 end"


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col
    part = table(spark, folder, "part")
    requirement = F.struct(
        F.concat(F.lit("req-"), c("p_partkey").cast("string")).alias("evidence_id"),
        F.concat(F.lit("Article "), F.expr(_ARTICLE).cast("string")).alias("article"),
        c("p_type").alias("description"),
        F.array(F.concat(c("p_name"), F.lit(" record"))).alias("characteristics"),
    )
    return part.groupBy(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]+", "-")).alias("standard_id")).agg(
        F.lit("catalog").alias("catalog_id"),
        F.lit("2025-01-01").alias("last_reviewed"),
        F.lit(rules.CONSTITUTIONAL_RULE).alias("constitutional_rule"),
        F.regexp_replace(F.min("p_brand"), "[^0-9]", "").cast("int").alias("ord"),
        F.concat(F.lit("Brand / "), F.regexp_replace(F.min("p_brand"), "[^0-9]", "")).alias("designation"),
        F.min("p_name").alias("title"),
        F.lit("body").alias("issuing_body"),
        F.lit("committee").alias("technical_committee"),
        F.lit("1").alias("edition"),
        F.when(F.max("p_size") > 49, "technical-reference").otherwise("harmonised").alias("harmonization_status"),
        (F.min("p_size") > 1).alias("official_journal_listing"),
        F.array_sort(F.collect_set(F.concat(F.lit("Article "), F.expr(_ARTICLE).cast("string")))).alias("articles"),
        F.array_sort(F.collect_set(F.concat(F.lit("Annex IV."), F.expr(_SECTION).cast("string")))).alias("annex_iv_sections"),
        F.array_sort(F.collect_set("p_name")).alias("characteristics"),
        F.array(F.lit("engineering reference only")).alias("limitations"),
        F.filter(F.collect_list(F.when(c("p_size") > 45, requirement)), lambda r: r.isNotNull()).alias("evidence_requirements"),
        F.struct(F.lit("p").alias("publisher"), F.lit("t").alias("title"), F.lit("https://example.org/x").alias("url"), F.lit("2025-01-01").alias("retrieved_on"), F.lit(True).alias("verification_required")).alias("source"),
    )


def _tables(spark, folder) -> dict[str, DataFrame]:
    return standards_tables(materialize(_catalog(spark, folder)))


_CATALOG = f"""cat as (select distinct 'brand-' || regexp_replace(p_brand, '[^0-9]', '', 'g') as standard_id, cast(regexp_replace(p_brand, '[^0-9]', '', 'g') as integer) as ord,
  p_partkey, p_name, p_size, p_type, replace(p_name, ' ', '-') as phrase, {_ARTICLE} as article, {_SECTION} as section from part),
chars as (select distinct standard_id, phrase from cat), evid as (select distinct standard_id, phrase || '-record' as phrase from cat where p_size > 45),
arts as (select distinct standard_id, article from cat), secs as (select distinct standard_id, section from cat),
reqs as (select standard_id, ord, p_partkey, article, 'req-' || cast(p_partkey as string) as evidence_id from cat where p_size > 45)"""


def _references(spark, folder) -> DataFrame:
    c = F.col
    style = c("o_orderpriority")
    return table(spark, folder, "orders").select(
        c("o_orderkey").alias("subject"),
        F.when(style == "1-URGENT", "EU AI Act Article 12").when(style == "2-HIGH", "Art. (14)").when(style == "3-MEDIUM", "15").when(style == "5-LOW", "Article 99").otherwise("none").alias("article"),
        F.when(style == "1-URGENT", "Annex IV, point 2.1").when(style == "2-HIGH", "annex iv.3").when(style == "3-MEDIUM", "IV section (5)").otherwise("Annex III").alias("section"),
        F.concat(F.lit("BRAND /  "), (c("o_custkey") % 40).cast("string")).alias("reference"),
        F.when(style == "1-URGENT", "Widget").when(style == "2-HIGH", "ed & g").when(style == "3-MEDIUM", "blue ring").otherwise("old").alias("characteristic"),
    )


_REFS = """refs as (select o_orderkey as subject, case o_orderpriority when '1-URGENT' then 12 when '2-HIGH' then 14 when '3-MEDIUM' then 15 when '5-LOW' then 99 end as article,
  case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 3 when '3-MEDIUM' then 5 end as section,
  case o_orderpriority when '1-URGENT' then 'widget' when '2-HIGH' then 'ed-and-g' when '3-MEDIUM' then 'blue-ring' else 'old' end as needle, o_custkey % 40 as brand from orders)"""


@query(
    "standards_by_id",
    f"with {_CATALOG}, {_REFS} select subject, standard_id from refs join (select distinct standard_id, ord from cat) c on c.ord = refs.brand",
)
def standards_by_id(spark, folder):
    linked, _ = standards.link_standards_by_id(_references(spark, folder), _tables(spark, folder))
    return linked.select("subject", "standard_id")


@query(
    "standards_unknown_ids",
    f"with {_CATALOG}, {_REFS} select brand, count(*) as orders from refs where brand not in (select ord from cat) group by brand",
)
def standards_unknown_ids(spark, folder):
    _, unknown = standards.link_standards_by_id(_references(spark, folder), _tables(spark, folder))
    brand = F.regexp_extract("reference", "([0-9]+)$", 1).cast("bigint")
    return unknown.groupBy(brand.alias("brand")).agg(F.count("*").alias("orders"))


@query("standards_by_article", f"with {_CATALOG}, {_REFS} select subject, standard_id from refs join arts using (article)")
def standards_by_article(spark, folder):
    refs = _references(spark, folder).select("subject", "article")
    return standards.link_standards_by_article(refs, _tables(spark, folder)).select("subject", "standard_id")


@query("standards_by_annex", f"with {_CATALOG}, {_REFS} select subject, standard_id from refs join secs using (section)")
def standards_by_annex(spark, folder):
    refs = _references(spark, folder).select("subject", "section")
    return standards.link_standards_by_annex(refs, _tables(spark, folder)).select("subject", "standard_id")


@query(
    "standards_by_characteristic",
    f"with {_CATALOG}, {_REFS} select needle, standard_id, count(distinct subject) as subjects from refs join chars on contains(phrase, needle) group by all",
)
def standards_by_characteristic(spark, folder):
    refs = _references(spark, folder).select("subject", "characteristic")
    linked = standards.link_standards_by_characteristic(refs, _tables(spark, folder))
    needle = F.regexp_replace(F.lower(F.replace(F.col("characteristic"), F.lit("&"), F.lit("and"))), " ", "-")
    return linked.groupBy(needle.alias("needle"), "standard_id").agg(F.count("*").alias("subjects"))


@query(
    "requirements_per_trace",
    f"""with {_CATALOG}, {_REFS}, n as (select article, count(*) as k from reqs group by article)
    select subject, cast(k as bigint) as requirements from refs join n using (article)""",
)
def requirements_per_trace(spark, folder):
    refs = _references(spark, folder).select("subject", "article")
    return standards.requirements_per_trace(refs, _tables(spark, folder))


# --- features: what a customer bought --------------------------------------------------


def _feature_leaves(spark, folder) -> DataFrame:
    """Purchases as leaf rows: part names as texts, priorities as article references and flags."""
    c = F.col
    orders = table(spark, folder, "orders").select("o_orderkey", c("o_custkey").alias("subject"), "o_orderpriority")
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    lines = table(spark, folder, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey"))
    bought = lines.join(part, c("l_partkey") == c("p_partkey"))

    def leaf(last_key, kind, text):
        return F.struct(last_key.alias("last_key"), F.lit(kind).alias("kind"), text.alias("text"))

    name = leaf(F.lit("bought"), "string", F.concat(c("p_name"), F.when(c("p_size") > 40, " Record").otherwise("")))
    flag = leaf(F.concat(F.lit("uses "), "p_name"), "boolean", F.lit("true"))
    # One pass over the lines, one over the orders: both leaves of a part come from its row.
    parts = bought.select("subject", F.explode(F.when(c("p_size") == 50, F.array(name, flag)).otherwise(F.array(name))).alias("leaf"))
    article, annex = leaf(F.lit("articles"), "number", F.lit("12")), leaf(F.lit("scope"), "string", F.lit("Annex IV.3"))
    marked = F.when(c("o_orderpriority") == "1-URGENT", article).when(c("o_orderpriority") == "2-HIGH", annex)
    scopes = orders.filter(c("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("subject", marked.alias("leaf"))
    return parts.unionAll(scopes).select("subject", "leaf.*")


_TOKENS = """bought as (select o_custkey as subject, p_name, p_size from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
tokens as (select subject, replace(p_name, ' ', '-') || case when p_size > 40 then '-record' else '' end as token from bought
  union select subject, 'uses-' || replace(p_name, ' ', '-') from bought where p_size = 50
  union select o_custkey, unnest(['Article 12', '12', 'article-12']) from orders where o_orderpriority = '1-URGENT'
  union select o_custkey, unnest(['annex-iv-3']) from orders where o_orderpriority = '2-HIGH')"""


def _tokens(spark, folder) -> DataFrame:
    return standards.feature_token_rows(_feature_leaves(spark, folder))


@query("feature_tokens", f"with {_TOKENS} select subject, token from tokens")
def feature_tokens(spark, folder):
    return standards.feature_tokens(_feature_leaves(spark, folder))


_FILLER = ", ".join(f"'{w}'" for w in rules.FEATURE_STOP_WORDS)
_STOP = ", ".join(f"'{w}'" for w in rules.PHRASE_STOP_WORDS)
# The literal token "Article 12" is a feature of its own, with the single word "Article 12".
_MATCHES = f"""feats as (select subject, token from tokens where token not in ('12', '13', '14', '15', '50') and not starts_with(token, 'article-') and not starts_with(token, 'annex-iv-')),
fw as (select distinct subject, w as word from (select subject, unnest(string_split(token, '-')) as w from feats) where w <> '' and w not in ({_FILLER})),
phrases as (select phrase from chars union select phrase from evid),
pw as (select distinct phrase, w as word from (select phrase, unnest(string_split(phrase, '-')) as w from phrases) where w not in ({_STOP})),
psize as (select phrase, count(*) as n from pw group by phrase),
hit as (select subject, phrase from feats join phrases on token = phrase
  union select subject, phrase from (select subject, phrase, count(*) as k from fw join pw using (word) group by all) join psize using (phrase) where k * 2 >= n),
m1 as (select subject, standard_id, count(*) as k from hit join chars using (phrase) group by all),
m2 as (select subject, standard_id, count(*) as k from hit join evid using (phrase) group by all),
m3 as (select subject, standard_id, count(*) as k from (select distinct subject from tokens where token = '12') join arts on article = 12 group by all),
m4 as (select subject, standard_id, count(*) as k from (select distinct subject from tokens where token = 'annex-iv-3') join secs on section = 3 group by all),
subj as (select subject, max(cast(token in (select token from feats) as integer)) as f, max(cast(token = '12' as integer)) as a, max(cast(token = 'annex-iv-3' as integer)) as x from tokens group by subject),
size as (select standard_id, any_value(ord) as ord, (select count(*) from chars c where c.standard_id = cat.standard_id) as nc, (select count(*) from evid c where c.standard_id = cat.standard_id) as ne,
  (select count(*) from arts c where c.standard_id = cat.standard_id) as na, (select count(*) from secs c where c.standard_id = cat.standard_id) as nx from cat group by standard_id),
pairs as (select subject, standard_id from m1 union select subject, standard_id from m2 union select subject, standard_id from m3 union select subject, standard_id from m4),
joined as (select p.subject, p.standard_id, ord, f, a, x, nc, ne, na, nx, coalesce(m1.k, 0) as k1, coalesce(m2.k, 0) as k2, coalesce(m3.k, 0) as k3, coalesce(m4.k, 0) as k4
  from pairs p join subj using (subject) join size using (standard_id)
  left join m1 on m1.subject = p.subject and m1.standard_id = p.standard_id left join m2 on m2.subject = p.subject and m2.standard_id = p.standard_id
  left join m3 on m3.subject = p.subject and m3.standard_id = p.standard_id left join m4 on m4.subject = p.subject and m4.standard_id = p.standard_id),
scored as (select subject, standard_id, ord, k1, k2, k3, k4, nc, round((case when f = 1 then 0.7::double * k1 / nc + 0.15::double * case when ne > 0 then k2::double / ne else k1::double / nc end else 0 end
  + case when a = 1 then 0.25::double * k3 / na else 0 end + case when x = 1 then 0.15::double * k4 / nx else 0 end)
  / (case when f = 1 then 0.85::double else 0 end + case when a = 1 then 0.25::double else 0 end + case when x = 1 then 0.15::double else 0 end), 6) as score from joined)"""


#: Matches at or below this score are not listed by standards_scores; standards_low_scores counts them.
_MINIMUM = 0.8


@query(
    "standards_scores",
    f"""with {_CATALOG}, {_TOKENS}, {_MATCHES} select subject, standard_id, score, k1 as matched_characteristics, nc - k1 as missing_characteristics,
    k2 as matched_evidence_characteristics, k3 as matched_articles, k4 as matched_annex_sections from scored where score > {_MINIMUM}""",
)
def standards_scores(spark, folder):
    matches = standards.match_standards(_tokens(spark, folder), _tables(spark, folder), _MINIMUM)
    return matches.drop("ord")


@query(
    "standards_low_scores",
    f"""with {_CATALOG}, {_TOKENS}, {_MATCHES} select standard_id, score, count(*) as subjects, cast(sum(k1) as bigint) as matched_characteristics, cast(sum(nc - k1) as bigint) as missing_characteristics,
    cast(sum(k2) as bigint) as matched_evidence_characteristics, cast(sum(k3) as bigint) as matched_articles, cast(sum(k4) as bigint) as matched_annex_sections
    from scored where score > 0 and score <= {_MINIMUM} group by standard_id, score""",
)
def standards_low_scores(spark, folder):
    matches = standards.match_standards(_tokens(spark, folder), _tables(spark, folder)).filter(F.col("score") <= _MINIMUM)
    sums = ("matched_characteristics", "missing_characteristics", "matched_evidence_characteristics", "matched_articles", "matched_annex_sections")
    return matches.groupBy("standard_id", "score").agg(F.count("*").alias("subjects"), *(F.sum(name).alias(name) for name in sums))


@query(
    "top_standards",
    f"""with {_CATALOG}, {_TOKENS}, {_MATCHES}, r as (select *, row_number() over (partition by subject order by score desc, ord) as rank from scored where score > 0)
    select subject, standard_id, cast(rank as integer) as rank from r where rank <= 3""",
)
def top_standards(spark, folder):
    best = standards.best_standards(_tokens(spark, folder), _tables(spark, folder), 3)
    return best.select("subject", "standard_id", "rank")


@query(
    "matched_characteristics",
    f"""with {_CATALOG}, {_TOKENS}, {_MATCHES}, s as (select distinct subject, standard_id from hit join chars using (phrase))
    select subject, standard_id, count(*) as characteristics, string_agg(c.phrase, ',' order by c.phrase) filter (where h.phrase is not null) as matched,
    coalesce(string_agg(c.phrase, ',' order by c.phrase) filter (where h.phrase is null), '') as missing
    from s join chars c using (standard_id) left join hit h using (subject, phrase) group by all""",
)
def matched_characteristics(spark, folder):
    rows = standards.characteristic_lists(_tokens(spark, folder), _tables(spark, folder))
    # Without a subject nothing is matched, which the aggregate of no row has as null.
    matched = F.when(F.col("subject").isNotNull(), F.array_join("matched", ","))
    return rows.select("subject", "standard_id", "characteristics", matched.alias("matched"), F.array_join("missing", ",").alias("missing"))


@query(
    "matched_features",
    f"""with {_CATALOG}, {_TOKENS}, {_MATCHES}, u as (select subject, standard_id, phrase as value from hit join chars using (phrase)
      union select subject, standard_id, phrase from hit join evid using (phrase)
      union select subject, standard_id, 'Article 12' from tokens join arts on article = 12 where token = '12'
      union select subject, standard_id, 'annex-iv-3' from tokens join secs on section = 3 where token = 'annex-iv-3')
    select subject, standard_id, count(*) as features, string_agg(value, ',' order by value) as matched from u group by all""",
)
def matched_features(spark, folder):
    rows = standards.matched_value_lists(_tokens(spark, folder), _tables(spark, folder))
    return rows.select("subject", "standard_id", F.size("values").cast("long").alias("features"), F.array_join("values", ",").alias("matched"))


_GIVEN = ", ".join(
    f"({a.split()[1]}, '{f.replace(' ', '-')}')" for a, names in rules.ARTICLE_FEATURES.items() for f in names
)
_ARTICLE_SCORES = f"""given(article, phrase) as (values {_GIVEN}), base as (select article, standard_id, (select count(*) from chars c where c.standard_id = arts.standard_id) as n from arts),
ownhits as (select t.subject, b.article, b.standard_id, count(*) as k from tokens t join chars c on t.token = c.phrase join base b on b.standard_id = c.standard_id group by all),
ascores as (select s.subject, b.article, b.standard_id, coalesce(k, 0) as k, round(least(1.0::double, 0.35::double + 0.55::double * coalesce(k, 0) / n + case when coalesce(k, 0) > 0 then 0.1::double else 0 end), 6) as score
  from (select distinct subject from tokens) s cross join base b left join ownhits o on o.subject = s.subject and o.article = b.article and o.standard_id = b.standard_id)"""


@query(
    "article_standard_scores",
    f"""with {_CATALOG}, {_TOKENS}, {_ARTICLE_SCORES}, o as (select a.*, row_number() over (partition by subject, article order by score desc, ord) as n
      from ascores a join (select distinct standard_id, ord from cat) using (standard_id) where k > 0)
    select subject, 'Article ' || cast(article as string) as article, standard_id, k as matched_features, score, cast(n as integer) as rank from o where n <= 3""",
)
def article_standard_scores(spark, folder):
    # No part name is a fixed feature, so a standard with own matches is before all others.
    best = standards.top_article_standards(_tokens(spark, folder), _tables(spark, folder), 3).filter("own_features > 0")
    return best.select("subject", "article", "standard_id", "matched_features", "score", "rank")


@query(
    "article_own_scores",
    f"""with {_CATALOG}, {_TOKENS}, {_ARTICLE_SCORES} select subject, 'Article ' || cast(article as string) as article, standard_id, k as matched_features, score
    from ascores where k > 0""",
)
def article_own_scores(spark, folder):
    scores = standards.article_standard_scores(_tokens(spark, folder), _tables(spark, folder))
    return scores.select("subject", "article", "standard_id", "matched_features", "score")


@query(
    "article_top_standards",
    f"""with {_CATALOG}, {_TOKENS}, {_ARTICLE_SCORES}, o as (select a.*, row_number() over (partition by subject, article order by score desc, ord) as n
      from ascores a join (select distinct standard_id, ord from cat) using (standard_id))
    select subject, 'Article ' || cast(article as string) as article, standard_id, k as matched_features, score, cast(n as integer) as rank from o where n <= 3""",
)
def article_top_standards(spark, folder):
    best = standards.top_article_standards(_tokens(spark, folder), _tables(spark, folder), 3)
    return best.select("subject", "article", "standard_id", "matched_features", "score", "rank")


@query(
    "article_base_values",
    f"""with {_CATALOG} select distinct 'Article ' || cast(article as string) as article, standard_id, 0.35::double as score from arts""",
)
def article_base_values(spark, folder):
    return standards.article_base(_tables(spark, folder)).select("article", "standard_id", "score")


@query(
    "article_base_scores",
    f"""with {_CATALOG} select 'Article ' || cast(article as string) as article, standard_id,
    (select count(*) from chars c where c.standard_id = arts.standard_id) as characteristics from arts""",
)
def article_base_scores(spark, folder):
    return standards.article_base(_tables(spark, folder)).select("article", "standard_id", F.col("size").alias("characteristics"))


@query(
    "annex_checklist",
    f"""with {_CATALOG}, t as (select article, evidence_id, standard_id, p_partkey from reqs)
    select 'Article ' || cast(t.article as string) as article, evidence_id, standard_id, p_type as description, 'mapped-engineering-reference' as status
    from t join part using (p_partkey)""",
)
def annex_checklist(spark, folder):
    return standards.annex_checklist(_tables(spark, folder)).select("article", "evidence_id", "standard_id", "description", "status")


@query(
    "catalog_issues",
    """with c as (select 'brand-' || regexp_replace(p_brand, '[^0-9]', '', 'g') as standard_id, max(p_size) as hi, min(p_size) as lo, count(*) filter (where p_size > 45) as reqs from part group by p_brand)
    select standard_id, 'listing requires harmonised status' as issue from c where hi > 49 and lo > 1
    union all select standard_id, 'evidence_requirements must not be empty' from c where reqs = 0""",
)
def catalog_checks(spark, folder):
    return catalog_issues(_catalog(spark, folder))
