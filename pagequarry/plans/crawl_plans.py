"""Crawl rounds, the submission queue and append sinks over ``pages`` and ``events``.

The web that is crawled is made of ``pages``: a page answers at its own URL (every seventh by length with
an error), and a third of all other URLs are missing, while the rest answer with one of the pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import content_string
from pagequarry.functions.urls import origin_of, slug_of
from pagequarry.operators import crawl, robots, tasks
from pagequarry.operators.joins import lookup_join
from pagequarry.operators.ordered import first_rows
from pagequarry.plans import frontier_plans, site_plans
from pagequarry.plans.common import sql_tokens, table
from pagequarry.session import pinned, shared_folder
from pagequarry.sources.batches import BatchLog
from pagequarry.sources.queue import SubmissionQueue
from pagequarry.sources.tables import RAW, append_failures

ROUNDS = 2
#: Batches a queue is drained in, and batches of failed tasks.
BATCHES = 3


def _root(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _web(spark, folder):
    """Fetching from the web of the pages."""
    pages = table(spark, folder, "pages")
    by_url = first_rows(pages, ["url"], [F.desc("page_id")]).select("url", F.col("html").alias("_own"))
    others = pages.select(F.col("page_id").alias("_page"), F.col("html").alias("_other"))
    ids = (pages.agg(F.max("page_id")).first()[0] or 0) + 1

    def fetch(wanted: DataFrame) -> DataFrame:
        known = wanted.join(by_url, "url", "left")
        page = F.when(F.col("_own").isNull(), (F.length("url") * 13 % ids).cast("long"))
        answered = lookup_join(known.withColumn("_page", page), others, "_page", ["url"])
        status = (
            F.when(F.col("_own").isNotNull(), F.when(F.length("_own") % 7 == 0, 503).otherwise(200))
            .when(F.length("url") % 3 == 0, 404)
            .otherwise(200)
        )
        html = F.when(status == 200, F.coalesce("_own", "_other"))
        return answered.withColumns({"status": status, "html": html}).drop("_own", "_other", "_page")

    return fetch


def first_tasks(spark, folder) -> DataFrame:
    """Every page's URL as a task that may be tried twice."""
    pages = table(spark, folder, "pages").select(
        "url", F.concat(origin_of(F.col("url")), F.lit("/")).alias("site"), (F.col("page_id") + 1).alias("seq")
    )
    config = F.struct(
        F.col("site").alias("base_url"), F.lit(1.5).alias("rate_limit"), F.lit("site agent").alias("user_agent")
    )
    return tasks.with_task_fields(pages, config, tasks.SEED_PRIORITY).withColumn("max_retries", F.lit(1))


def crawled(spark, folder, rounds: int = ROUNDS, **options) -> crawl.CrawlState:
    state = crawl.CrawlState(spark, _root(spark, "crawl"), buckets=4)
    day = F.lit("2024-02-01").cast("date")
    state.start(first_tasks(spark, folder), day)
    crawl.crawl(
        state,
        rounds,
        registry=site_plans.host_registry(spark, folder),
        robots_rules=pinned(robots.agent_rules(site_plans.robots_files(spark, folder), site_plans.AGENT)),
        fetch=_web(spark, folder),
        day=day,
        now=F.lit(site_plans.NOW).cast("timestamp_ntz"),
        **options,
    )
    return state


def crawl_round_frontier(spark, folder):
    rows = crawled(spark, folder).frontier()
    return rows.select(
        "seq", "url", "site", *[F.col(c).cast("long").alias(c) for c in ("priority", "retry_count", "max_retries")],
        F.col("headers")["User-Agent"].alias("user_agent"),
    )


def crawl_round_documents(spark, folder):
    rows = crawled(spark, folder).documents()
    content = content_string(F.col("novel_name"), F.col("description"), slug_of(F.col("url")))
    return rows.select(
        "url", "novel_name", "description", "source", F.col("doc_length").cast("long").alias("doc_length"),
        (F.sha2(content, 256) == F.col("content_hash")).alias("hash_fits"),
    )


def crawl_round_counters(spark, folder):
    return crawled(spark, folder).counters()


def crawl_round_visited(spark, folder):
    return crawled(spark, folder).visited().select("namespace", "url_hash")


def crawl_round_dead(spark, folder):
    rows = crawled(spark, folder).dead_letters()
    return rows.select("seq", "url", F.col("retry_count").cast("long").alias("retry_count"), F.col("batch").cast("long").alias("round"))


def seeds_visited(spark, folder):
    """Marks of the sites' seeds."""
    marks = crawl.seed_marks(tasks.seeds(site_plans.host_registry(spark, folder)), F.lit("2024-02-01").cast("date"))
    return marks.select("namespace", "url_hash")


def queued(spark, folder) -> DataFrame:
    """The submissions as they lie in a queue of three partitions."""
    rows = site_plans.submissions(spark, folder)
    return rows.select((F.col("seq") % 3).cast("int").alias("partition"), F.floor(F.col("seq") / 3).alias("offset"), "raw")


def fifo_batch(spark, folder):
    """All submissions, taken in a few batches; each is asked for twice, as after a failure."""
    submissions = pinned(queued(spark, folder))
    size = -(-submissions.count() // BATCHES)
    queue = SubmissionQueue(spark, _root(spark, "queue"), submissions)
    out = None
    for batch in range(BATCHES):
        queue.take(batch, size)
        rows = queue.take(batch, size).select(F.lit(batch).cast("long").alias("batch"), "partition", "offset", "raw")
        rows = pinned(rows)
        queue.done(batch)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("partition", F.col("partition").cast("long"))


def failure_log(spark, folder) -> BatchLog:
    """Failed tasks appended in batches, one of them twice, and one that was never committed."""
    log = BatchLog(spark, _root(spark, "failures"))
    failed = frontier_plans.event_tasks(spark, folder)
    for batch in (0, 1, 1, 2):
        append_failures(log, batch, failed.where(F.col("seq") % BATCHES == batch))
    log.write("retries", BATCHES, tasks.encoded(failed, "raw").select("raw"))
    return log


def _appended(log: BatchLog, name: str) -> DataFrame:
    rows = tasks.decoded(log.read(name, RAW).select("raw"), "raw")
    return rows.select("url", F.col("priority").cast("long").alias("priority"), F.col("retry_count").cast("long").alias("retry_count"))


def append_retries(spark, folder):
    return _appended(failure_log(spark, folder), "retries")


def append_dead(spark, folder):
    return _appended(failure_log(spark, folder), "dead_letters")


QUERIES = {
    "crawl_round_frontier": crawl_round_frontier,
    "crawl_round_documents": crawl_round_documents,
    "crawl_round_counters": crawl_round_counters,
    "crawl_round_visited": crawl_round_visited,
    "crawl_round_dead": crawl_round_dead,
    "seeds_visited": seeds_visited,
    "fifo_batch": fifo_batch,
    "append_retries": append_retries,
    "append_dead": append_dead,
}


def _sql_round(k: int) -> str:
    """Tables of round ``k`` from tasks t{k} and marks m{k - 1}; t{k + 1} is the frontier behind it."""
    links = site_plans._can_fetch(f"followed{k}", "task_seq").replace("fetchable", f"fetchable{k}")
    return f"""f{k} AS (SELECT t.*, CASE WHEN w.html IS NOT NULL THEN CASE WHEN length(w.html) % 7 = 0 THEN 503 ELSE 200 END
    WHEN length(t.url) % 3 = 0 THEN 404 ELSE 200 END AS status, coalesce(w.html, p.html) AS html
  FROM t{k} t LEFT JOIN web w ON w.url = t.url
  LEFT JOIN pages p ON p.page_id = length(t.url) * 13 % (SELECT max(page_id) + 1 FROM pages)),
anchors{k} AS (SELECT seq AS task_seq, site, {site_plans._ITEM} AS from_item,
    {site_plans._ORIGIN} || unnest({site_plans._ANCHORS}) AS url,
    generate_subscripts({site_plans._ANCHORS}, 1) - 1 AS pos FROM f{k} WHERE status = 200),
followed{k} AS (SELECT task_seq, site, pos, url FROM anchors{k} JOIN reg ON site = base_url
    WHERE NOT unidirection OR (NOT from_item AND (contains(url, 'page=') OR {site_plans._ITEM}))),
{links},
new{k} AS (SELECT *, {site_plans._HASH} AS url_hash FROM fetchable{k} l
  WHERE starts_with(url, site) AND NOT {site_plans._BLOCKED} AND can_fetch
  QUALIFY row_number() OVER (PARTITION BY site, url_hash ORDER BY task_seq, pos) = 1),
d{k} AS (SELECT * FROM new{k} n WHERE NOT EXISTS (
  SELECT 1 FROM m{k - 1} m WHERE m.namespace = n.site AND m.url_hash = n.url_hash)),
m{k} AS (SELECT * FROM m{k - 1} UNION ALL SELECT site, url_hash FROM d{k}),
added{k} AS (SELECT seq AS task_seq, -1 AS pos, url, site, priority, retry_count + 1 AS retry_count, max_retries
    FROM f{k} WHERE status <> 200 AND retry_count + 1 <= max_retries
  UNION ALL SELECT task_seq, pos, url, site, 0, 0, 3 FROM d{k}),
t{k + 1} AS (SELECT (SELECT max(seq) FROM t1) {'+ (SELECT count(*) FROM added1)' if k == 2 else ''}
    + row_number() OVER (ORDER BY task_seq, pos) AS seq, url, site, priority, retry_count, max_retries FROM added{k})"""


_CRAWL = f"""WITH {site_plans._REG}, {site_plans._ROBOTS},
web AS (SELECT url, arg_max(html, page_id) AS html FROM pages GROUP BY url),
t1 AS (SELECT max(page_id) + 1 AS seq, url, {site_plans._ORIGIN} || '/' AS site, 1 AS priority, 0 AS retry_count,
  1 AS max_retries FROM pages GROUP BY url),
m0 AS (SELECT DISTINCT site AS namespace, {site_plans._HASH} AS url_hash FROM t1),
{_sql_round(1)},
{_sql_round(2)}"""
_FAILED = frontier_plans._TASKS

SQL = {
    "crawl_round_frontier": f"""{_CRAWL} SELECT seq, url, site, priority, retry_count, max_retries,
  'site agent' AS user_agent FROM t3""",
    "crawl_round_documents": rf"""{_CRAWL}, items AS (SELECT url, html FROM f1 WHERE status = 200 AND {site_plans._ITEM}
  UNION SELECT url, html FROM f2 WHERE status = 200 AND {site_plans._ITEM}),
read AS (SELECT url, regexp_extract({site_plans._ORIGIN}, '//(.*)', 1) AS source,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<article><h1>([^<]*)</h1>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS novel_name,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS description,
    regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '[-_]', ' ', 'g') AS slug FROM items),
contents AS (SELECT *, novel_name || ' ' || description || ' ' || slug AS content FROM read)
SELECT url, novel_name, description, source, len({sql_tokens('content')}) AS doc_length, true AS hash_fits FROM contents""",
    "crawl_round_counters": f"""{_CRAWL}, f AS (SELECT status FROM f1 UNION ALL SELECT status FROM f2)
SELECT metric, count(*) AS total FROM (SELECT unnest(CASE WHEN status = 200
    THEN ['request_started', 'request_success', 'page_crawled'] ELSE ['request_started', 'request_failed'] END) AS metric FROM f
  UNION ALL SELECT 'url_discovered' FROM d1 UNION ALL SELECT 'url_discovered' FROM d2) GROUP BY metric""",
    "crawl_round_visited": f"{_CRAWL} SELECT namespace, url_hash FROM m2",
    "crawl_round_dead": f"""{_CRAWL} SELECT seq, url, retry_count + 1 AS retry_count, 1 AS round FROM f1
  WHERE status <> 200 AND retry_count + 1 > max_retries
UNION ALL SELECT seq, url, retry_count + 1, 2 FROM f2 WHERE status <> 200 AND retry_count + 1 > max_retries""",
    "seeds_visited": f"""WITH s AS ({site_plans.SQL['seeds']}) SELECT DISTINCT site AS namespace, {site_plans._HASH} AS url_hash FROM s""",
    "fifo_batch": f"""WITH q AS ({{submissions}}), o AS (SELECT *,
  row_number() OVER (ORDER BY "offset", "partition") - 1 AS rn, (count(*) OVER () + {BATCHES - 1}) // {BATCHES} AS size FROM q)
SELECT rn // size AS batch, "partition", "offset", raw FROM o""",
    "append_retries": f"""WITH {_FAILED} SELECT url, priority, retry_count + 1 AS retry_count FROM t WHERE retry_count + 1 <= 3""",
    "append_dead": f"""WITH {_FAILED} SELECT url, priority, retry_count + 1 AS retry_count FROM t WHERE retry_count + 1 > 3""",
}
_QUOTED = "'\"' || url || '\"'"
SQL["fifo_batch"] = SQL["fifo_batch"].replace(
    "{submissions}",
    f"""SELECT page_id % 3 AS "partition", page_id // 3 AS "offset", CASE length(html) % 9 WHEN 0 THEN url
    WHEN 1 THEN '{{"url": ' || {_QUOTED} || ', "priority": 2, "headers": {{"User-Agent": ""}}}}'
    WHEN 2 THEN {_QUOTED} WHEN 3 THEN '{{"link": ' || {_QUOTED} || '}}' WHEN 4 THEN '[' || {_QUOTED} || ']'
    WHEN 5 THEN '{{"url": null}}' WHEN 6 THEN '{{"url": ' || {_QUOTED} || ', "extra": 1}}'
    WHEN 7 THEN '{{"extra": 1, "url": "https://unknown.test/' || page_id || '"}}'
    ELSE '{{"url": ' || {_QUOTED} || ', "rate_limit": 0.25, "retry_count": 2, "headers": {{"User-Agent": "own"}}}}' END AS raw
  FROM pages""",
)
