"""Site rules over ``pages``: registry, seeds, link filters, robots, admission, submissions.

The registry, robots files, crawl times and submissions are derived from the hosts and URLs of the
pages, so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.functions.urls import origin_of, path_of
from pagequarry.operators import admission, index_build, registry as sites, robots, tasks
from pagequarry.operators.registry import with_site_config
from pagequarry.plans.common import table, texts
from pagequarry.session import pinned

AGENT = "QuarryBot/1.0 (+https://quarry.example/)"
NOW = "2024-02-01 00:00:00"
_ROBOTS_ALL = (
    "User-agent: otherbot\nDisallow: /\n\nUser-agent: *\nCrawl-delay: 5\nDisallow: /en/1\n"
    "Allow: /en/\nDisallow: /de/ # none\n"
)
_ROBOTS_OURS = "\nUser-agent: Other\nUser-agent: Quarry\nCrawl-delay: 2\nDisallow: /fr\nDisallow:\n"


def _pages(spark, folder):
    return texts(spark, folder, "pages")


def _hosts(spark, folder):
    return table(spark, folder, "pages").select(origin_of(F.col("url")).alias("origin")).distinct()


def host_registry(spark, folder) -> DataFrame:
    """One site per scheme and host of the pages, stored like a registry would be."""
    one_way = F.length("origin") % 2 == 0
    sites_of_pages = _hosts(spark, folder).select(
        F.lit(2).alias("site_order"),
        F.concat("origin", F.lit("/")).alias("base_url"),
        F.lit("/start").alias("seed_url"),
        F.regexp_extract("origin", "//(.*)", 1).alias("name"),
        F.array(F.lit("spam-farm"), F.lit("/de/")).alias("blocklist"),
        F.array(F.lit(r"/[a-z]{2}/\d+(?:\.html)?")).alias("allowindb"),
        one_way.alias("unidirection"),
        F.lit("page=").alias("unidirection_url_struct"),
        F.lit(1.5).alias("rate_limit"),
        F.lit(None).cast("string").alias("image_fix"),
        F.when(one_way, F.lit("/list?page={page}")).alias("pagination_template"),
        F.lit("site agent").alias("user_agent"),
        F.struct(
            F.lit("article h1").alias("title_selector"),
            F.lit(".ad").alias("description_selector"),
            F.lit(None).cast("string").alias("image_selector"),
            F.lit("src").alias("image_attr"),
        ).alias("selectors"),
    )
    return pinned(sites_of_pages)


def layered_registry(spark, folder) -> DataFrame:
    """Hosts, and before them an own site for the /en/ pages of every host."""
    hosts = host_registry(spark, folder)
    english = hosts.withColumns(
        {
            "site_order": F.lit(1),
            "base_url": F.concat("base_url", F.lit("en/")),
            "name": F.concat("name", F.lit(" en")),
        }
    )
    return hosts.unionByName(english)


def robots_files(spark, folder) -> DataFrame:
    kind = F.length("origin") % 7
    ours = F.when(F.length("origin") % 3 == 0, F.lit(_ROBOTS_OURS)).otherwise(F.lit(""))
    return _hosts(spark, folder).select(
        F.col("origin").alias("domain"),
        F.when(kind == 0, 401).when(kind == 1, 404).when(kind == 2, 500).when(kind != 3, 200).alias("http_status"),
        F.concat(F.lit(_ROBOTS_ALL), ours).alias("robots_txt"),
    )


def stored_documents(spark, folder) -> DataFrame:
    """Pages as stored documents, crawled zero to six days ago or never."""
    days = F.make_dt_interval((F.length("html") % 7).cast("int"))
    last = F.when(F.length("html") % 5 != 0, F.lit(NOW).cast("timestamp_ntz") - days)
    return _pages(spark, folder).groupBy("url").agg(F.max(last).alias("last_crawled_at"))


def _crawled(spark, folder):
    return _pages(spark, folder).select(
        F.col("page_id").alias("task_seq"),
        "url",
        "html",
        F.concat(origin_of(F.col("url")), F.lit("/")).alias("site"),
    )


def _listed_links(spark, folder, registry):
    """Every page's own URL and its https form as links of its site."""
    crawled = _crawled(spark, folder).select("task_seq", "site", F.explode(F.array(
        F.struct(F.lit(1000).alias("pos"), F.col("url")),
        F.struct(F.lit(1001).alias("pos"), F.replace("url", F.lit("http://"), F.lit("https://")).alias("url")),
    )).alias("l")).select("task_seq", "site", "l.*")
    sited = with_site_config(crawled, registry, ["url"])
    return sited.select(
        "task_seq",
        "pos",
        "site",
        "config",
        sites.path_allowed(path_of(F.col("url")), F.col("config.allowindb")).alias("link_is_item"),
        "url",
    )


def _links(spark, folder):
    registry = host_registry(spark, folder)
    followed = admission.followed_links(_crawled(spark, folder), registry)
    listed = _listed_links(spark, folder, registry)
    listed = listed.withColumn("config", F.struct(*[F.col(f"config.{c}") for c in ("base_url", "blocklist", "rate_limit", "user_agent")]))
    return followed.unionByName(listed)


def site_registry(spark, folder):
    registry = layered_registry(spark, folder)
    return registry.select(
        F.col("site_order").cast("long").alias("site_order"), "base_url", "name", "unidirection",
        F.array_join("blocklist", "|").alias("blocklist"), F.array_join("allowindb", "|").alias("allowindb"),
        F.col("selectors.title_selector").alias("title_selector"), "pagination_template",
    )


def site_match(spark, folder):
    """Tasks whose site is a registry key; pages of German hosts point to an unknown site."""
    crawled = _crawled(spark, folder).withColumn(
        "site", F.when(F.col("url").contains("/de/"), F.lit("https://unknown.example/")).otherwise(F.col("site"))
    )
    matched = with_site_config(crawled.drop("html"), host_registry(spark, folder), ["url"])
    return matched.select("task_seq", "site", F.col("config.name").alias("name"), F.col("config").isNull().alias("error"))


def site_resolve(spark, folder):
    cut = F.when(F.col("url").contains("ads-track"), F.concat(F.lit("x"), "url")).otherwise(F.col("url"))
    found = sites.resolve_site(_pages(spark, folder).select("page_id", cut.alias("url")), layered_registry(spark, folder))
    return found.select("page_id", F.col("config.base_url").alias("site"))


def seeds(spark, folder):
    made = tasks.seeds(host_registry(spark, folder))
    return made.select(
        "site", F.col("page").cast("long").alias("page"), "url", "rate_limit",
        F.col("priority").cast("long").alias("priority"), F.col("headers")["User-Agent"].alias("user_agent"),
    )


def _sited_links(spark, folder):
    return _listed_links(spark, folder, host_registry(spark, folder))


def prefix_filter(spark, folder):
    kept = _sited_links(spark, folder).where(sites.inside_site(F.col("url"), F.col("config.base_url")))
    return kept.select("task_seq", "url")


def blocklist_filter(spark, folder):
    return _sited_links(spark, folder).where(~sites.blocked(F.col("url"), F.col("config.blocklist"))).select("task_seq", "url")


def allow_filter(spark, folder):
    registry = host_registry(spark, folder)
    sited = with_site_config(_crawled(spark, folder).drop("html"), registry, ["url"])
    return sited.where(sites.path_allowed(path_of(F.col("url")), F.col("config.allowindb"))).select("task_seq", "url")


def follow_filter(spark, folder):
    """Page URLs as links found on a listing page and on an item page of their site."""
    links = _sited_links(spark, folder).withColumn("from_item", F.explode(F.array(F.lit(True), F.lit(False))))
    kept = links.where(sites.follows(F.col("from_item"), F.col("url"), F.col("link_is_item"), F.col("config")))
    return kept.select("task_seq", "url", "from_item")


def followed_links(spark, folder):
    links = admission.followed_links(_crawled(spark, folder), host_registry(spark, folder))
    return links.select("task_seq", F.col("pos").cast("long").alias("pos"), "url")


def robots_rules(spark, folder):
    lines = robots.rule_lines(robots_files(spark, folder))
    order = F.row_number().over(Window.partitionBy("domain").orderBy("pos"))
    return lines.select("domain", order.cast("long").alias("line_no"), "key", "value")


def robots_filter(spark, folder):
    rules = robots.agent_rules(robots_files(spark, folder), AGENT)
    return robots.with_robots(_pages(spark, folder).select("page_id", "url"), rules).select("page_id", "can_fetch")


def crawl_delay(spark, folder):
    rules = robots.agent_rules(robots_files(spark, folder), AGENT)
    return rules.select("domain", "status", "crawl_delay")


def _visited(spark, folder):
    """Pages with a query were visited before."""
    seen = _crawled(spark, folder).where(F.col("url").contains("utm_source"))
    return seen.select(
        F.col("site").alias("namespace"), F.lit("2024-02-01").cast("date").alias("day"),
        admission.url_hash(F.col("url")).alias("url_hash"),
    ).distinct()


def _admission_inputs(spark, folder):
    return (
        _links(spark, folder),
        pinned(robots.agent_rules(robots_files(spark, folder), AGENT)),
        _visited(spark, folder),
        stored_documents(spark, folder),
        F.lit("2024-02-01").cast("date"),
        F.lit(NOW).cast("timestamp_ntz"),
    )


def admitted_tasks(spark, folder):
    found, _ = admission.admitted(*_admission_inputs(spark, folder))
    return found.select(
        "url", "site", "rate_limit", F.col("priority").cast("long").alias("priority"),
        F.col("headers")["User-Agent"].alias("user_agent"), "task_seq", F.col("pos").cast("long").alias("pos"),
    )


def admission_marks(spark, folder):
    _, marks = admission.admitted(*_admission_inputs(spark, folder))
    return marks.select("namespace", "url_hash")


def admission_report(spark, folder):
    report = admission.admission_report(*_admission_inputs(spark, folder))
    return report.select("task_seq", F.col("pos").cast("long").alias("pos"), "url", "reject_reason")


def index_only_pages(spark, folder):
    """Item pages read for the index, no links taken."""
    items = index_build.item_pages(_crawled(spark, folder), host_registry(spark, folder))
    pages = index_build.with_content(index_build.parsed_pages(items))
    return pages.select("task_seq", "url", "title", "description", "source", "slug", "content_hash")


def recrawl_due(spark, folder):
    pages = _pages(spark, folder).select("page_id", F.replace("url", F.lit("http://"), F.lit("https://")).alias("url"))
    due = admission.with_recrawl_due(pages, stored_documents(spark, folder), F.lit(NOW).cast("timestamp_ntz"))
    return due.select("page_id", "due")


def submissions(spark, folder) -> DataFrame:
    """Payloads of all shapes made from the page URLs."""
    url, kind = F.col("url"), F.length("html") % 9
    quoted = F.concat(F.lit('"'), url, F.lit('"'))
    raw = (
        F.when(kind == 0, url)
        .when(kind == 1, F.concat(F.lit('{"url": '), quoted, F.lit(', "priority": 2, "headers": {"User-Agent": ""}}')))
        .when(kind == 2, quoted)
        .when(kind == 3, F.concat(F.lit('{"link": '), quoted, F.lit("}")))
        .when(kind == 4, F.concat(F.lit("["), quoted, F.lit("]")))
        .when(kind == 5, F.lit('{"url": null}'))
        .when(kind == 6, F.concat(F.lit('{"url": '), quoted, F.lit(', "extra": 1}')))
        .when(kind == 7, F.concat(F.lit('{"extra": 1, "url": "https://unknown.test/'), "page_id", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"url": '), quoted, F.lit(', "rate_limit": 0.25, "retry_count": 2, "headers": {"User-Agent": "own"}}')))
    )
    return _pages(spark, folder).select(F.col("page_id").alias("seq"), raw.alias("raw"))


def submissions_decode(spark, folder):
    done = tasks.decode_submissions(submissions(spark, folder), layered_registry(spark, folder))
    return done.select(
        "seq", "outcome", "reason", "url", "site", "rate_limit", F.col("priority").cast("long").alias("priority"),
        F.col("retry_count").cast("long").alias("retry_count"), F.col("headers")["User-Agent"].alias("user_agent"),
    )


QUERIES = {
    "site_registry": site_registry,
    "site_match": site_match,
    "site_resolve": site_resolve,
    "seeds": seeds,
    "prefix_filter": prefix_filter,
    "blocklist_filter": blocklist_filter,
    "allow_filter": allow_filter,
    "follow_filter": follow_filter,
    "followed_links": followed_links,
    "robots_rules": robots_rules,
    "robots_filter": robots_filter,
    "crawl_delay": crawl_delay,
    "admission": admission_report,
    "admitted_tasks": admitted_tasks,
    "admission_marks": admission_marks,
    "index_only_pages": index_only_pages,
    "recrawl_due": recrawl_due,
    "submissions_decode": submissions_decode,
}

_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_PATH = r"regexp_replace(regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '')"
_ITEM = rf"regexp_full_match({_PATH}, '/[a-z]{{2}}/\d+(?:\.html)?')"
_HASH = "sha1(regexp_replace(split_part(url, '#', 1), '/+$', ''))"
_HOSTS = f"hosts AS (SELECT DISTINCT {_ORIGIN} AS origin FROM pages)"
_REG = rf"""{_HOSTS}, reg AS (SELECT 2 AS site_order, origin || '/' AS base_url,
  regexp_extract(origin, '//(.*)', 1) AS name, length(origin) % 2 = 0 AS unidirection,
  CASE WHEN length(origin) % 2 = 0 THEN '/list?page={{page}}' END AS pagination_template FROM hosts)"""
_LAYERED = f"""{_REG}, layered AS (SELECT * FROM reg UNION ALL
  SELECT 1, base_url || 'en/', name || ' en', unidirection, pagination_template FROM reg)"""
_LISTED = f"""listed AS (SELECT page_id AS task_seq, {_ORIGIN} || '/' AS site, 1000 AS pos, url FROM pages UNION ALL
  SELECT page_id, {_ORIGIN} || '/', 1001, replace(url, 'http://', 'https://') FROM pages)"""
_BLOCKED = "(contains(url, 'spam-farm') OR contains(url, '/de/'))"
_ANCHORS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_FOLLOWED = f"""anchors AS (SELECT page_id AS task_seq, {_ORIGIN} || '/' AS site, {_ITEM} AS from_item,
    {_ORIGIN} || unnest({_ANCHORS}) AS url, generate_subscripts({_ANCHORS}, 1) - 1 AS pos FROM pages),
  followed AS (SELECT task_seq, site, pos, url FROM anchors JOIN reg ON site = base_url
    WHERE NOT unidirection OR (NOT from_item AND (contains(url, 'page=') OR {_ITEM})))"""


def _text(value: str) -> str:
    return "'" + value.replace("\n", "' || chr(10) || '") + "'"


_ROBOTS_FILES = f"""robots AS (SELECT origin AS domain,
    CASE length(origin) % 7 WHEN 0 THEN 401 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN NULL ELSE 200 END AS http_status,
    {_text(_ROBOTS_ALL)} || CASE WHEN length(origin) % 3 = 0 THEN {_text(_ROBOTS_OURS)} ELSE '' END AS robots_txt
  FROM hosts)"""
_ROBOTS = f"""{_ROBOTS_FILES},
rl AS (SELECT domain, unnest(string_split(robots_txt, chr(10))) AS raw,
    generate_subscripts(string_split(robots_txt, chr(10)), 1) AS pos FROM robots WHERE http_status = 200),
rk AS (SELECT domain, pos, CASE WHEN raw = '' THEN 'blank' ELSE lower(trim(split_part(raw, ':', 1))) END AS key,
    trim(regexp_replace(split_part(raw, '#', 1), '^[^:]*:', '')) AS value FROM rl),
ro AS (SELECT *, (key = 'blank' OR (key = 'user-agent' AND
    coalesce(lag(key) OVER (PARTITION BY domain ORDER BY pos), '') <> 'user-agent'))::INT AS opens FROM rk),
rg AS (SELECT *, sum(opens) OVER (PARTITION BY domain ORDER BY pos) AS group_no FROM ro),
rules AS (SELECT * FROM rg WHERE key <> 'blank' AND (domain, group_no) IN (
    SELECT (domain, group_no) FROM rg GROUP BY domain, group_no
    HAVING count_if(key = 'user-agent') > 0 AND count_if(key NOT IN ('user-agent', 'blank')) > 0)),
chosen AS (SELECT domain, coalesce(min(group_no) FILTER (value <> '*' AND contains('quarrybot', lower(value))),
    min(group_no) FILTER (value = '*')) AS group_no FROM rules WHERE key = 'user-agent' GROUP BY domain),
our_rules AS (SELECT rules.* FROM rules JOIN chosen USING (domain, group_no)),
status AS (SELECT domain, CASE WHEN http_status IS NULL OR http_status >= 500 THEN 'unreachable'
    WHEN http_status IN (401, 403) THEN 'deny_all' WHEN http_status >= 400 THEN 'allow_all' ELSE 'rules' END AS status
  FROM robots)"""


def _can_fetch(links: str, key: str) -> str:
    """``links`` (with ``key`` unique, url) plus can_fetch."""
    return f"""fetchable AS (SELECT l.*, CASE s.status WHEN 'deny_all' THEN false WHEN 'rules' THEN
      coalesce((SELECT arg_min(r.key = 'allow' OR r.value = '', r.pos) FROM our_rules r
        WHERE r.domain = s.domain AND r.key IN ('allow', 'disallow')
          AND starts_with(substr(l.url, length(s.domain) + 1), r.value)), true)
      ELSE true END AS can_fetch
    FROM {links} l LEFT JOIN status s ON s.domain = regexp_extract(l.url, '^([^:/?#]+://[^/?#]*)', 1))"""


_STORED = f"""stored AS (SELECT url, max(CASE WHEN length(html) % 5 <> 0 THEN
    TIMESTAMP '{NOW}' - to_days((length(html) % 7)::INT) END) AS last FROM pages GROUP BY url)"""
_DUE = f"(last IS NULL OR TIMESTAMP '{NOW}' - last > INTERVAL 3 DAYS)"
_SEEN = f"""seen AS (SELECT DISTINCT {_ORIGIN} || '/' AS namespace, {_HASH} AS url_hash
  FROM pages WHERE contains(url, 'utm_source'))"""
_ADMISSION = f"""WITH {_REG}, {_LISTED}, {_FOLLOWED}, {_ROBOTS}, {_STORED}, {_SEEN},
links AS (SELECT task_seq, site, pos, url FROM followed UNION ALL
  SELECT task_seq, site, pos, url FROM listed),
{_can_fetch('links', 'task_seq')},
ruled AS (SELECT *, {_HASH} AS url_hash, CASE WHEN NOT starts_with(url, site) THEN 'outside'
    WHEN {_BLOCKED} THEN 'blocked' WHEN NOT can_fetch THEN 'robots' END AS reason FROM fetchable),
numbered AS (SELECT *, row_number() OVER (PARTITION BY site, url_hash, reason IS NULL ORDER BY task_seq, pos) AS rn
  FROM ruled),
judged AS (SELECT n.*, CASE WHEN reason IS NOT NULL THEN reason
    WHEN rn > 1 OR EXISTS (SELECT 1 FROM seen WHERE namespace = site AND seen.url_hash = n.url_hash) THEN 'visited'
    WHEN {_ITEM.replace('url', 'n.url')} AND NOT {_DUE} THEN 'not_due' END AS reject_reason
  FROM numbered n LEFT JOIN stored ON stored.url = n.url)"""

SQL = {
    "site_registry": rf"""WITH {_LAYERED} SELECT site_order, base_url, name, unidirection, 'spam-farm|/de/' AS blocklist,
  '/[a-z]{{2}}/\d+(?:\.html)?' AS allowindb, 'article h1' AS title_selector, pagination_template FROM layered""",
    "site_match": f"""WITH {_REG}, t AS (SELECT page_id AS task_seq,
  CASE WHEN contains(url, '/de/') THEN 'https://unknown.example/' ELSE {_ORIGIN} || '/' END AS site FROM pages)
SELECT task_seq, site, name, name IS NULL AS error FROM t LEFT JOIN reg ON site = base_url""",
    "site_resolve": f"""WITH {_LAYERED}, p AS (
  SELECT page_id, CASE WHEN contains(url, 'ads-track') THEN 'x' || url ELSE url END AS url FROM pages)
SELECT page_id, arg_min(base_url, site_order) AS site FROM p LEFT JOIN layered ON starts_with(url, base_url) GROUP BY page_id""",
    "seeds": f"""WITH {_REG} SELECT base_url AS site, page, base_url || CASE WHEN unidirection
  THEN 'list?page=' || page ELSE 'start' END AS url, 1.5::DOUBLE AS rate_limit, 1 AS priority, 'site agent' AS user_agent
FROM (SELECT *, unnest(CASE WHEN unidirection THEN range(1, 101) ELSE [1] END) AS page FROM reg)""",
    "prefix_filter": f"WITH {_LISTED} SELECT task_seq, url FROM listed WHERE starts_with(url, site) AND site IN (SELECT {_ORIGIN} || '/' FROM pages)",
    "blocklist_filter": f"WITH {_LISTED} SELECT task_seq, url FROM listed WHERE NOT {_BLOCKED}",
    "allow_filter": f"SELECT page_id AS task_seq, url FROM pages WHERE {_ITEM}",
    "follow_filter": f"""WITH {_REG}, {_LISTED} SELECT task_seq, url, from_item
FROM (SELECT *, unnest([true, false]) AS from_item FROM listed) JOIN reg ON site = base_url
WHERE NOT unidirection OR (NOT from_item AND (contains(url, 'page=') OR {_ITEM}))""",
    "followed_links": f"WITH {_REG}, {_FOLLOWED} SELECT task_seq, pos, url FROM followed",
    "robots_rules": f"""WITH {_HOSTS}, {_ROBOTS} SELECT domain,
  row_number() OVER (PARTITION BY domain ORDER BY pos) AS line_no, key, value FROM rules""",
    "robots_filter": f"WITH {_HOSTS}, {_ROBOTS}, {_can_fetch('pages', 'page_id')} SELECT page_id, can_fetch FROM fetchable",
    "crawl_delay": f"""WITH {_HOSTS}, {_ROBOTS} SELECT domain, status, crawl_delay FROM status LEFT JOIN
  (SELECT domain, max(value::DOUBLE) AS crawl_delay FROM our_rules WHERE key = 'crawl-delay' GROUP BY domain) USING (domain)""",
    "admission": f"{_ADMISSION} SELECT task_seq, pos, url, reject_reason FROM judged",
    "admitted_tasks": f"""{_ADMISSION} SELECT url, site, 1.5::DOUBLE AS rate_limit, 0 AS priority,
  'site agent' AS user_agent, task_seq, pos FROM judged WHERE reject_reason IS NULL""",
    "admission_marks": f"""{_ADMISSION} SELECT site AS namespace, url_hash FROM judged
WHERE reject_reason IS NULL OR reject_reason = 'not_due'""",
    "index_only_pages": rf"""SELECT task_seq, url, title, description, source, slug,
  sha256(title || ' ' || description || ' ' || slug) AS content_hash
FROM (SELECT page_id AS task_seq, url, regexp_extract({_ORIGIN}, '//(.*)', 1) AS source,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS title,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS description,
    regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '[-_]', ' ', 'g') AS slug
  FROM pages WHERE {_ITEM})""",
    "recrawl_due": f"""WITH {_STORED} SELECT page_id, {_DUE} AS due
FROM pages p LEFT JOIN stored s ON s.url = replace(p.url, 'http://', 'https://')""",
    "submissions_decode": f"""WITH {_LAYERED}, s AS (SELECT page_id AS seq, length(html) % 9 AS kind, url AS u FROM pages),
t AS (SELECT *, kind IN (1, 5, 6, 7, 8) AS is_task, CASE kind WHEN 0 THEN u WHEN 1 THEN u WHEN 2 THEN '"' || u || '"'
    WHEN 3 THEN '{{"link": "' || u || '"}}' WHEN 4 THEN '["' || u || '"]' WHEN 5 THEN NULL WHEN 6 THEN u
    WHEN 7 THEN 'https://unknown.test/' || seq ELSE u END AS url FROM s),
m AS (SELECT seq, kind, url, arg_min(base_url, site_order) AS site
  FROM t LEFT JOIN layered ON starts_with(url, base_url) GROUP BY ALL)
SELECT seq, CASE WHEN kind IN (5, 6) THEN 'quarantined' WHEN site IS NULL THEN 'dropped' ELSE 'task' END AS outcome,
  CASE kind WHEN 5 THEN 'url is not text' WHEN 6 THEN 'unknown field' END AS reason, url, site,
  CASE WHEN kind = 8 THEN 0.25 ELSE 1.0 END::DOUBLE AS rate_limit, CASE WHEN kind = 1 THEN 2 ELSE 1 END AS priority,
  CASE WHEN kind = 8 THEN 2 ELSE 0 END AS retry_count,
  CASE WHEN site IS NULL THEN NULL WHEN kind = 8 THEN 'own' ELSE 'site agent' END AS user_agent FROM m""",
}
