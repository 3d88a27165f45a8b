"""The site registry: built-in sites and registries stored as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequarry.schemas import REGISTRY

# The one site configured so far.
SITES = [
    {
        "site_order": 1,
        "base_url": "https://novelfull.com/",
        "seed_url": "/most-popular?page=1",
        "name": "Novel Full",
        "blocklist": ["/chapter"],
        "allowindb": [r"/[^/]+\.html$"],
        "unidirection": True,
        "unidirection_url_struct": "/most-popular?page",
        "rate_limit": 1.0,
        "image_fix": None,
        "pagination_template": "/most-popular?page={page}",
        "user_agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36"
        " (KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
        "selectors": {
            "title_selector": "h3.title",
            "description_selector": ".desc-text",
            "image_selector": ".book img",
            "image_attr": "src",
        },
    },
]


def site_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The built-in registry, or one stored as JSON lines with the registry schema."""
    if path:
        return spark.read.schema(REGISTRY).json(path)
    return spark.createDataFrame(SITES, REGISTRY)
