"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SELECTORS = _struct(title_selector=_S, description_selector=_S, image_selector=_S, image_attr=_S)

REGISTRY = _struct(
    site_order=_I,
    base_url=_S,
    seed_url=_S,
    name=_S,
    blocklist=T.ArrayType(_S),
    allowindb=T.ArrayType(_S),
    unidirection=T.BooleanType(),
    unidirection_url_struct=_S,
    rate_limit=_D,
    image_fix=_S,
    pagination_template=_S,
    user_agent=_S,
    selectors=SELECTORS,
)

# The fields of a task in the order of its JSON form.
TASK = _struct(
    url=_S,
    site=_S,
    rate_limit=_D,
    priority=_I,
    retry_count=_I,
    max_retries=_I,
    headers=T.MapType(_S, _S),
)

DOCUMENTS = _struct(
    doc_id=_L,
    url=_S,
    novel_name=_S,
    description=_S,
    source=_S,
    image_url=_S,
    doc_length=_I,
    last_crawled_at=T.TimestampNTZType(),
    content_hash=_S,
)
POSTINGS = _struct(term=_S, doc_id=_L, frequency=_L)
NGRAMS = _struct(ngram=_S, term=_S)
SUBMISSIONS = _struct(seq=_L, raw=_S)
ROBOTS = _struct(domain=_S, http_status=_I, robots_txt=_S)
FETCH_EVENTS = _struct(ts=T.TimestampType(), site=_S, url=_S, metric=_S, status=_I)
PAGES = _struct(page_id=_L, url=_S, html=_S)
EVENTS = _struct(
    event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S
)
