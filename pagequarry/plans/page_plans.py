"""URL forms, page fields and links over ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagequarry.functions import html, urls
from pagequarry.operators import admission, index_build
from pagequarry.operators.tasks import fetched_ok
from pagequarry.plans.common import table, texts

# Status of a stored page, by its size: some fetches failed.
STATUS = "CASE length(html) % 5 WHEN 0 THEN 404 WHEN 1 THEN 500 ELSE 200 END"


def _pages(spark, folder):
    return texts(spark, folder, "pages")


def _url(expression):
    def query(spark, folder):
        return _pages(spark, folder).select("page_id", expression(F.col("url")).alias("value"))

    return query


def url_normalise(spark, folder):
    url = F.col("url")
    return _pages(spark, folder).select(
        "page_id", urls.normalised(url).alias("normalised"), urls.url_hash(url).alias("url_hash")
    )


def url_resolve(spark, folder):
    """Links of every form against every page."""
    url, links = F.col("url"), ["../up?x=1", "./same", "next", "?q=2", "#frag", "//other.example/a/../b", "/a/./b/../c", ""]
    forms = F.array(*[F.lit(link) for link in links])
    based = _pages(spark, folder).select("page_id", urls.base_parts(url).alias("base"), F.explode(forms).alias("ref"))
    return based.select("page_id", "ref", urls.resolve(F.col("base"), F.col("ref")).alias("link"))


def page_source(spark, folder):
    fetched = _pages(spark, folder).withColumn("status", F.expr(STATUS))
    return fetched.where(fetched_ok(F.col("status"))).select(
        "page_id", "url", F.length("html").cast("long").alias("body_length")
    )


def page_failures(spark, folder):
    fetched = _pages(spark, folder).withColumn("status", F.expr(STATUS))
    return fetched.where(~fetched_ok(F.col("status"))).select("page_id", F.col("status").cast("long").alias("status"))


def _fields(spark, folder):
    selectors = F.struct(
        F.lit("article h1").alias("title_selector"),
        F.lit("article p").alias("description_selector"),
        F.lit("nav li a").alias("image_selector"),
        F.lit("href").alias("image_attr"),
    )
    return _pages(spark, folder).select("page_id", html.fields(F.col("html"), selectors).alias("f")).select(
        "page_id", "f.title", "f.description", "f.image"
    )


def page_links(spark, folder):
    links = admission.page_links(_pages(spark, folder), ["page_id"])
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), "link")


def link_edges(spark, folder):
    """How often each page URL (without fragment) links each target."""
    links = admission.page_links(_pages(spark, folder).withColumn("src_url", urls.normalised(F.col("url"))), ["src_url"])
    return links.groupBy("src_url", F.col("link").alias("dst_url")).agg(F.count(F.lit(1)).alias("links"))


def image_fix(spark, folder):
    image = F.when(F.col("url").startswith("https"), F.concat(F.lit("https://cdn.example/"), "url")).otherwise(F.col("url"))
    pages = _pages(spark, folder).withColumn("image", image)
    return pages.select("page_id", "image", index_build.fixed_image(F.col("image"), F.lit("last_https")).alias("fixed"))


QUERIES = {
    "url_normalise": url_normalise,
    "url_path": _url(urls.path_of),
    "url_slug": _url(urls.slug_of),
    "url_domain": _url(urls.origin_of),
    "url_resolve": url_resolve,
    "page_source": page_source,
    "page_failures": page_failures,
    "page_fields": _fields,
    "page_links": page_links,
    "link_edges": link_edges,
    "image_fix": image_fix,
}

_ORIGIN = "regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1)"
_PATH = r"regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
_NORMAL = r"regexp_replace(split_part(url, '#', 1), '/+$', '')"
_ANCHORS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_LINKS = f"""links AS (SELECT page_id, url, unnest({_ANCHORS}) AS href,
  generate_subscripts({_ANCHORS}, 1) - 1 AS pos FROM pages)"""

# The pages' base paths have the form /xx/123 with optional slash, so each link form has one result.
_RESOLVE = f"""SELECT page_id, ref, CASE ref
  WHEN '../up?x=1' THEN o || CASE WHEN p LIKE '%/' THEN regexp_replace(p, '[^/]+/$', '') ELSE '/' END || 'up?x=1'
  WHEN './same' THEN o || d || 'same'
  WHEN 'next' THEN o || d || 'next'
  WHEN '?q=2' THEN o || p || '?q=2'
  WHEN '#frag' THEN split_part(url, '#', 1) || '#frag'
  WHEN '//other.example/a/../b' THEN split_part(url, ':', 1) || '://other.example/a/../b'
  WHEN '/a/./b/../c' THEN o || '/a/c'
  ELSE url END AS link
FROM (SELECT page_id, url, {_ORIGIN} AS o, {_PATH} AS p, regexp_replace({_PATH}, '[^/]*$', '') AS d,
  unnest(['../up?x=1', './same', 'next', '?q=2', '#frag', '//other.example/a/../b', '/a/./b/../c', '']) AS ref
  FROM pages)"""

# Text pieces between tags, entities decoded, blanks off, joined without separator.
# The semicolon may be missing, as in a title that was cut.
_ENTITIES = "{}"
for _entity, _char in (
    ("quot;?", '"'),
    ("#39;?", "''"),
    ("lt;?", "<"),
    ("gt;?", ">"),
    ("middot;?", "·"),
    ("copy;?", "©"),
    ("amp;?", "&"),
):
    _ENTITIES = f"regexp_replace({_ENTITIES}, '&{_entity}', '{_char}', 'g')"
_TEXT = (
    "array_to_string(list_transform(regexp_split_to_array({}, '<[^>]*>'),"
    " lambda t: trim(" + _ENTITIES.format("t") + ", E' \\t\\n\\r')), '')"
)
# A p element ends where as many end tags as start tags of p have been seen, else with the article.
_FIELDS = f"""WITH a AS (
  SELECT page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art,
    regexp_extract({_ANCHORS}[1], '.*') AS image FROM pages),
b AS (SELECT *, CASE WHEN strpos(art, '<p>') > 0 THEN substr(art, strpos(art, '<p>')) ELSE '' END AS body FROM a),
c AS (SELECT *, string_split(body, '</p>') AS parts FROM b),
d AS (SELECT *, list_filter(range(1, len(parts)), lambda i:
    len(string_split(array_to_string(parts[1:i], ' '), '<p>')) - 1 = i) AS ends FROM c)
SELECT page_id,
  {_TEXT.format("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)")} AS title,
  {_TEXT.format("CASE WHEN len(ends) > 0 THEN array_to_string(parts[1:ends[1]], '</p>') ELSE body END")} AS description,
  {_ENTITIES.format("image")} AS image
FROM d"""

SQL = {
    "url_normalise": f"SELECT page_id, {_NORMAL} AS normalised, sha1({_NORMAL}) AS url_hash FROM pages",
    "url_path": f"SELECT page_id, regexp_replace(regexp_replace({_PATH}, ';[^/]*$', ''), '/+$', '') AS value FROM pages",
    "url_slug": r"""SELECT page_id, regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')),
  '[-_]', ' ', 'g') AS value FROM pages""",
    "url_domain": f"SELECT page_id, {_ORIGIN} AS value FROM pages",
    "url_resolve": _RESOLVE,
    "page_source": f"SELECT page_id, url, length(html) AS body_length FROM pages WHERE {STATUS} = 200",
    "page_failures": f"SELECT page_id, ({STATUS})::BIGINT AS status FROM pages WHERE {STATUS} <> 200",
    "page_fields": _FIELDS,
    "page_links": f"WITH {_LINKS} SELECT page_id, pos, {_ORIGIN} || href AS link FROM links",
    "link_edges": f"""WITH {_LINKS} SELECT {_NORMAL} AS src_url, {_ORIGIN} || href AS dst_url, count(*) AS links
FROM links GROUP BY ALL""",
    "image_fix": """SELECT page_id, image, regexp_replace(image, '^https://.*https://', 'https://') AS fixed
FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'https://cdn.example/' || url ELSE url END AS image FROM pages)""",
}
