"""Query catalog, part 4: text / scalar functions, feed ingestion, synthetic source,
map-reduce skill count."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlake.functions import lists, salary, text
from laborlake.operators import etl
from laborlake.plans.registry import register
from laborlake.sources import feeds
from laborlake.sources.fixtures import FEED_COUNTRIES, FEEDS, Fixtures, landed_pages


# ---------------------------------------------------------------- oracle helpers
def _re2(pattern: str) -> str:
    """Python-style ``\\b...\\b`` pattern → RE2 with Unicode word boundaries."""
    w = r"[\pL\pN_]"
    body = pattern
    if body.startswith(r"\b"):
        body = r"(?:^|[^\pL\pN_])" + body[2:]
    if body.endswith(r"\b"):
        body = body[:-2] + r"(?:[^\pL\pN_]|$)"
    return "(?i)" + body.replace(r"\w", w)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rlike(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {_sql_str(_re2(pattern))})"


def _skills_sql(blob: str) -> str:
    parts = [f"case when {_rlike(blob, p)} then {_sql_str(n)} end" for n, p in text.SKILL_PATTERNS]
    return f"list_filter([{', '.join(parts)}], lambda x: x is not null)"


def _seniority_sql(title: str, desc: str) -> str:
    d = f"coalesce({desc}, '')"
    t = f"coalesce({title}, '')"
    s, j = text.SENIOR_PATTERN, text.JUNIOR_PATTERN
    return (f"case when {_rlike(t, s)} then 'senior' when {_rlike(t, j)} then 'junior' "
            f"when {_rlike(d, s)} then 'senior' when {_rlike(d, j)} then 'junior' else 'mid' end")


def _replace_chain(col: str, passes) -> str:
    out = col
    for pattern, repl in passes:
        r = repl.replace("$1", "\\1").replace("$2", "\\2").replace("$3", "\\3")
        out = f"regexp_replace({out}, {_sql_str(pattern)}, {_sql_str(r)}, 'g')"
    return out


# ---------------------------------------------------------------- scalar functions
# Documents are invented prose: each gets one wording of the vocabulary, by its id, in both engines.
_WORDINGS = ("Python and SQL", "spark, airflow", "Java", "AWS + Docker", "Scala", "nothing of note", "Kafka", "Tableau")
_PLACES = ("fully remote", "Work-from-home days", "on site", "WFH", "in the office")


def _nth(words: tuple[str, ...]) -> F.Column:
    return F.get(F.array(*map(F.lit, words)), F.pmod("doc_id", F.lit(len(words))).cast("int"))


def _nth_sql(words: tuple[str, ...]) -> str:
    return f"([{', '.join(map(_sql_str, words))}])[1 + doc_id % {len(words)}]"


@register("extract_skills", f"""
select doc_id, array_to_string({_skills_sql("t")}, ',') skills
from (select doc_id, {_nth_sql(_WORDINGS)} || ' ' || coalesce(text, '') t from documents) d""")
def q_extract_skills(fx: Fixtures) -> DataFrame:
    d = fx.tables.documents
    blob = F.concat_ws(" ", _nth(_WORDINGS), F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.array_join(text.extract_skills(blob), ",").alias("skills"))


@register("is_remote", f"""
select doc_id, coalesce(source = 'remotive', false)
       or {_rlike("t || ' ' || coalesce(text, '')", text.REMOTE_PATTERN)} remote
from (select *, {_nth_sql(_PLACES)} t from documents) d""")
def q_is_remote(fx: Fixtures) -> DataFrame:
    d = fx.tables.documents
    return d.select("doc_id", text.is_remote("source", _nth(_PLACES), "text").alias("remote"))


@register("infer_seniority", f"""
select p.posting_id, {_seniority_sql("p.title", "d.text")} seniority
from fx_posting p left join documents d on cast(d.doc_id as varchar) = p.posting_id""")
def q_infer_seniority(fx: Fixtures) -> DataFrame:
    docs = fx.tables.documents.select(F.col("doc_id").cast("string").alias("posting_id"), "text")
    return fx.posting.join(docs, "posting_id", "left").select(
        "posting_id", text.infer_seniority("title", "text").alias("seniority"))


@register("month_from_iso", """
select o_orderkey, try_cast(substring(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 6, 2) as integer) posted_month
from orders""")
def q_month_from_iso(fx: Fixtures) -> DataFrame:
    o = fx.tables.orders
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return o.select("o_orderkey", text.month_from_iso(iso).alias("posted_month"))


_SOURCE_OF_REGION = ("case region when 'ASIA' then 'adzuna_in' when 'EUROPE' then 'adzuna_gb' "
                     "when 'AMERICA' then 'adzuna_us' else 'remotive' end")


@register("to_usd", f"""
with s as (select posting_id, salary_raw, {_SOURCE_OF_REGION} source from fx_posting)
select posting_id, source,
       case when round(try_cast(salary_raw as double) * case source when 'adzuna_in' then 1 / 95.0
              when 'adzuna_gb' then 1.27 else 1.0 end, 2) >= 5000
            then round(try_cast(salary_raw as double) * case source when 'adzuna_in' then 1 / 95.0
              when 'adzuna_gb' then 1.27 else 1.0 end, 2) end salary_usd
from s""")
def q_to_usd(fx: Fixtures) -> DataFrame:
    p = fx.posting.withColumn("source", F.expr(_SOURCE_OF_REGION))
    return p.select("posting_id", "source", salary.to_usd("salary_raw", "source").alias("salary_usd"))


def _match_terms_sql(terms: tuple[str, ...]) -> str:
    words = "list_filter(string_split_regex(lower(term), '\\s+'), lambda w: length(w) > 2)"
    of_title = ("list_filter(string_split_regex(trim(translate(lower(coalesce(title, '')), ',/', '  ')), '\\s+'), "
                "lambda x: x <> '')")
    return (f"exists(select 1 from unnest([{', '.join(map(_sql_str, terms))}]) t(term) "
            f"where instr(lower(coalesce(title, '')), lower(term)) > 0 or (len({words}) > 0 "
            f"and len(list_filter({words}, lambda w: not list_contains({of_title}, w))) = 0))")


@register("dropped_salaries", f"""
with s as (select try_cast(salary_raw as double) * case {_SOURCE_OF_REGION} when 'adzuna_in' then 1 / 95.0
                  when 'adzuna_gb' then 1.27 else 1.0 end usd, {_SOURCE_OF_REGION} source from fx_posting)
select source, count(*) postings, count(*) filter (where round(usd, 2) < 5000) implausible from s group by source""")
def q_dropped_salaries(fx: Fixtures) -> DataFrame:
    """Numeric salaries that the credibility floor drops, counted per source."""
    p = fx.posting.withColumn("source", F.expr(_SOURCE_OF_REGION))
    return p.groupBy("source").agg(
        F.count(F.lit(1)).alias("postings"),
        F.count_if(salary.implausible_salary("salary_raw", "source")).alias("implausible"))


@register("match_terms", f"""
select posting_id, {_match_terms_sql(("Data Engineer", "small ring", "Bolt Blue"))} keep from fx_posting""")
def q_match_terms(fx: Fixtures) -> DataFrame:
    terms = F.array(F.lit("Data Engineer"), F.lit("small ring"), F.lit("Bolt Blue"))
    return fx.posting.select("posting_id", text.match_terms(F.coalesce("title", F.lit("")), terms).alias("keep"))


@register("term_contains", """
select posting_id, instr(lower(coalesce(title, '')), 'ring') > 0 or instr(lower(coalesce(title, '')), 'bolt') > 0 keep
from fx_posting""")
def q_term_contains(fx: Fixtures) -> DataFrame:
    terms = F.array(F.lit("ring"), F.lit("BOLT"))
    return fx.posting.select("posting_id", text.term_contains(F.coalesce("title", F.lit("")), terms).alias("keep"))


# A source with every kind of markup around each document's text.
_TEX_HEAD = "\\documentclass[11pt]{article}\n\\usepackage{geometry} % setup\n\\begin{document}\n\\section*{About \\emph{me}}\n"
_TEX_TAIL = ("\n\n\n\n\\textbf{Bold~words} $x^2$ 50\\% R\\&D a\\_b \\\\ \\href{u}{link}\n\\item one\n\\item  two \\newline"
             " \\vspace{2em} {grouped} \\subsection{End}\n\\end{document}")


# What head and tail have to read as, written by hand.  The documents hold no commands or groups, so the
# SQL needs no rule list: comments end lines, and every second piece between dollar signs is a formula.
_PLAIN_HEAD = "About me\n\n"
_PLAIN_TAIL = "\n\nBold words $x^2$ 50% R&D a_b \n link\n- one\n- two \n grouped \n\nEnd"


@register("strip_markup", f"""
with said as (
  select doc_id, string_split({_sql_str(_PLAIN_HEAD)} || array_to_string(list_transform(
    string_split(coalesce(text, ''), chr(10)), lambda line: split_part(line, '%', 1)), chr(10)) || {_sql_str(_PLAIN_TAIL)}, '$') pieces
  from documents),
shown as (
  select doc_id, translate(array_to_string(list_transform(pieces, lambda piece, i: case
    when i % 2 = 1 then piece when i = len(pieces) then '$' || piece else '·' end), ''), '~{{}}', ' ') t
  from said)
select doc_id, trim(regexp_replace(regexp_replace(t, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
                    ' ' || chr(9) || chr(10)) plain
from shown""")
def q_strip_markup(fx: Fixtures) -> DataFrame:
    source = F.concat(F.lit(_TEX_HEAD), F.coalesce("text", F.lit("")), F.lit(_TEX_TAIL))
    return fx.tables.documents.repartition("doc_id").select("doc_id", text.strip_markup(source).alias("plain"))


_TAG_SQL = _replace_chain("html", [(r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "),
                                   (r"(?s)<!--.*?-->", " "), (r"<[^>]*>", " ")])
for _ent, _ch in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
    _TAG_SQL = f"replace({_TAG_SQL}, {_sql_str(_ent)}, {_sql_str(_ch)})"


@register("strip_tags", f"""
select page_id, trim(regexp_replace({_TAG_SQL}, '\\s+', ' ', 'g')) visible_text from pages""")
def q_strip_tags(fx: Fixtures) -> DataFrame:
    return fx.tables.pages.select("page_id", text.strip_tags("html").alias("visible_text"))


@register("clean_title", "select posting_id, trim(title) title from fx_posting where title is not null")
def q_clean_title(fx: Fixtures) -> DataFrame:
    return fx.posting.select("posting_id", F.trim("title").alias("title")).filter(F.col("title").isNotNull())


def _skill_arrays(fx: Fixtures) -> DataFrame:
    arr = fx.posting_skill.groupBy("posting_id").agg(F.collect_list("skill").alias("required_skills"))
    return fx.posting.join(arr, "posting_id", "left")


@register("skill_count", """
select p.posting_id, cast(coalesce(s.n, 0) as integer) skill_count from fx_posting p
left join (select posting_id, count(*) n from fx_posting_skill group by 1) s on s.posting_id = p.posting_id""")
def q_skill_count(fx: Fixtures) -> DataFrame:
    return _skill_arrays(fx).select("posting_id", lists.skill_count("required_skills").alias("skill_count"))


_BOOL_RAW_SQL = ("case when salary is null then null when cast(posting_id as bigint) % 3 = 0 then cast(is_real as varchar) "
                 "when cast(posting_id as bigint) % 3 = 1 then upper(substring(cast(is_real as varchar), 1, 1)) "
                 "else cast(cast(is_real as integer) as varchar) end")


@register("bool_text", f"""
select posting_id, raw, coalesce(lower(raw) in ('true', 't', '1'), false) is_real
from (select posting_id, {_BOOL_RAW_SQL} raw from fx_posting) q""")
def q_bool_text(fx: Fixtures) -> DataFrame:
    pid = F.col("posting_id").cast("bigint")
    s = F.col("is_real").cast("string")
    raw = (F.when(F.col("salary").isNull(), F.lit(None).cast("string"))
            .when(pid % 3 == 0, s).when(pid % 3 == 1, F.upper(F.substring(s, 1, 1)))
            .otherwise(F.col("is_real").cast("int").cast("string")))
    return fx.posting.select("posting_id", raw.alias("raw")).select(
        "posting_id", "raw", lists.bool_text("raw").alias("is_real"))


@register("surrogate_key", """
select distinct company_name, md5(company_name) company_id from fx_posting where company_name is not null""")
def q_surrogate_key(fx: Fixtures) -> DataFrame:
    return fx.posting.filter(F.col("company_name").isNotNull()).select("company_name").distinct() \
        .select("company_name", lists.surrogate_key("company_name").alias("company_id"))


@register("country_region", """
select user_id, array_to_string(list_filter(list_distinct_ordered, lambda x, i: list_position(list_distinct_ordered, x) = i), ',')
       regions from (
  select user_id, list_concat(list_filter(list_transform(list_filter(list_transform(string_split(coalesce(countries, ''), ','),
           lambda c: lower(trim(c))), lambda c: c <> ''),
           lambda c: case c when 'in' then 'India' when 'us' then 'North America' when 'ca' then 'North America'
                            when 'gb' then 'Europe' when 'de' then 'Europe' when 'au' then 'Asia Pacific'
                            when 'sg' then 'Asia Pacific' end), lambda r: r is not null), ['Remote']) list_distinct_ordered
  from fx_profile) q""")
def q_country_region(fx: Fixtures) -> DataFrame:
    return fx.profiles.select("user_id", F.array_join(lists.country_regions("countries"), ",").alias("regions"))


@register("profile_completeness", """
select p.user_id, (case when trim(coalesce(c.c_name, '')) <> '' then 1 else 0 end)
  + (case when trim(coalesce(p.skills, '')) <> '' then 1 else 0 end)
  + (case when trim(coalesce(p.target_roles, '')) <> '' then 1 else 0 end)
  + (case when trim(coalesce(c.c_mktsegment, '')) <> '' then 1 else 0 end)
  + (case when trim(coalesce(p.countries, '')) <> '' then 1 else 0 end) filled
from fx_profile p join customer c on c.c_custkey = p.user_id""")
def q_profile_completeness(fx: Fixtures) -> DataFrame:
    c = fx.tables.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("full_name"),
                                  F.col("c_mktsegment").alias("seniority"))
    j = fx.profiles.join(c, "user_id").withColumn("headline", F.lit(None).cast("string")) \
                   .withColumn("preferred_locations", F.lit(None).cast("string"))
    return j.select("user_id", lists.profile_completeness().alias("filled"))


@register("feed_quality", """
with p as (select f.posting_id, f.salary, coalesce(s.n, 0) n from fx_posting f
           left join (select posting_id, count(*) n from fx_posting_skill group by 1) s on s.posting_id = f.posting_id
           where f.title is not null)
select count(*) unique_postings, count(*) filter (where salary is not null) with_salary,
       floor(count(*) filter (where salary is not null) * 100 / count(*)) salary_percent,
       count(*) filter (where n > 0) with_skills, floor(count(*) filter (where n > 0) * 100 / count(*)) skills_percent
from p""")
def q_feed_quality(fx: Fixtures) -> DataFrame:
    p = _skill_arrays(fx).filter(F.col("title").isNotNull())
    return etl.feed_quality(p).select(
        "unique_postings", "with_salary", F.col("salary_percent").cast("double").alias("salary_percent"),
        "with_skills", F.col("skills_percent").cast("double").alias("skills_percent"))


@register("mapreduce_skill_count", """
select skill, count(*) "count" from fx_clean_skill group by skill""")
def q_mapreduce_skill_count(fx: Fixtures) -> DataFrame:
    from laborlake.plans.catalog import cleaned_postings
    clean_ids = cleaned_postings(fx).select("posting_id")
    lines = (_skill_arrays(fx).join(clean_ids, "posting_id", "left_semi")
             .select(F.to_json(F.struct("posting_id", "required_skills")).alias("value")))
    return etl.mapreduce_skill_count(lines)


# ---------------------------------------------------------------- ingestion
REMOTIVE_TERMS, ARBEITNOW_TERMS = ("ring", "Bolt Blue"), ("ring", "bolt")


def _cases(column: str, values: dict, other: str) -> str:
    return f"case {column} {' '.join(f'when {_sql_str(k)} then {v!r}' for k, v in values.items())} else {other} end"


# A job of every third order per feed, before its relevance filter, from the raw tables.
_JOBS_CTE = f"""
with jobs as (
  select p.*, d.text description, g.tags, cast(month(o.o_orderdate) as integer) created, cast(p.posting_id as bigint) % 3 feed,
         [{', '.join(map(_sql_str, FEED_COUNTRIES))}][
           1 + coalesce(try_cast(regexp_extract(p.location, '([0-9]+)$', 1) as integer), 0) % {len(FEED_COUNTRIES)}] country
  from fx_posting p join orders o on cast(o.o_orderkey as varchar) = p.posting_id
       left join documents d on cast(d.doc_id as varchar) = p.posting_id
       left join (select posting_id, list(skill order by skill) tags from fx_posting_skill group by 1) g
         on g.posting_id = p.posting_id),
feed_rows as (
  select 'adzuna_' || posting_id id, title, company_name, location,
         {_cases("country", lists.FEED_COUNTRY_REGION, "upper(country)")} region, cast(salary as double) amount,
         cast([] as varchar[]) tags, description, 'adzuna_' || country source, posting_id, created posted_month
  from jobs where feed = 0
  union all
  select 'remotive_' || posting_id, title, company_name, location, '{feeds.REMOTIVE_REGION}',
         try_cast(salary_raw as double), coalesce(tags, []), description, 'remotive', posting_id, created
  from jobs where feed = 1 and {_match_terms_sql(REMOTIVE_TERMS)}
  union all
  select 'arbeitnow_job-' || posting_id, title, company_name, location, '{feeds.ARBEITNOW_REGION}', null,
         coalesce(tags, []), description, 'arbeitnow', posting_id, null
  from jobs where feed = 2 and ({' or '.join(f"instr(lower(coalesce(title, '')), '{t}') > 0" for t in ARBEITNOW_TERMS)})),
dollars as (select *, round(amount * {_cases("source", salary.FX_TO_USD, "1.0")}, 2) usd from feed_rows)
select id posting_id, nullif(trim(title), '') title, company_name company, location, region,
       {_seniority_sql("title", "description")} seniority,
       source = 'remotive' or {_rlike("coalesce(title, '') || ' ' || coalesce(description, '')", text.REMOTE_PATTERN)} remote,
       case when usd >= {salary.MIN_CREDIBLE_ANNUAL_USD} then usd end salary,
       {_cases("source", salary.NATIVE_CURRENCY, "'USD'")} salary_currency_original,
       array_to_string(case when len(tags) > 0 then tags
                            else {_skills_sql("concat_ws(' ', title, description)")} end, ',') required_skills,
       coalesce(description, '') description, source, true is_real,
       'https://jobs.example.invalid/' || posting_id url, posted_month
from dollars
"""


def _shown(postings: DataFrame) -> DataFrame:
    """The postings as a table to compare: without the ingest order, skills as text."""
    return postings.drop("ingest_seq").withColumn("required_skills", F.array_join("required_skills", ","))


def _feed(fx: Fixtures, name: str) -> DataFrame:
    adapt = {"adzuna": feeds.adzuna_postings, "remotive": lambda p: feeds.remotive_postings(p, list(REMOTIVE_TERMS)),
             "arbeitnow": lambda p: feeds.arbeitnow_postings(p, list(ARBEITNOW_TERMS))}[name]
    return adapt(landed_pages(fx.spark, fx.sf_dir, (name,))[name])


def _feeds(fx: Fixtures) -> list[DataFrame]:
    return [_feed(fx, name) for name in FEEDS]


@register("src_feed_adzuna", _JOBS_CTE + "where source like 'adzuna%'")
def q_src_feed_adzuna(fx: Fixtures) -> DataFrame:
    return _shown(_feed(fx, "adzuna"))


@register("src_feed_remotive", _JOBS_CTE + "where source = 'remotive'")
def q_src_feed_remotive(fx: Fixtures) -> DataFrame:
    return _shown(_feed(fx, "remotive"))


@register("src_feed_arbeitnow", _JOBS_CTE + "where source = 'arbeitnow'")
def q_src_feed_arbeitnow(fx: Fixtures) -> DataFrame:
    return _shown(_feed(fx, "arbeitnow"))


@register("feeds_union", _JOBS_CTE)
def q_feeds_union(fx: Fixtures) -> DataFrame:
    return _shown(feeds.feeds_union(*_feeds(fx)))


@register("normalize_posting", _JOBS_CTE + "where nullif(trim(title), '') is not null")
def q_normalize_posting(fx: Fixtures) -> DataFrame:
    return _shown(feeds.unique_postings(feeds.feeds_union(*_feeds(fx))))
