"""Stored responses of a search tool: JSON of any shape and depth, walked as VARIANT.

Each round opens the objects and arrays of the level before and hands down what lies around a
value, so blocks are found however deep they are nested; a round is one generator, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvane.functions import urls

#: Levels that are opened; deeper ones are reported, not dropped.
DEEPEST = 64
#: Addresses that a response gives at most.
MOST_URLS = 8


def walked(responses: DataFrame, key: str, body: str, deepest: int = DEEPEST) -> DataFrame:
    """(key, path, name, value, inside, in_value) of every value in the responses' JSON.

    path: the places down to the value, which sort in the order of the text; name: the field it stands in;
    inside: the ``type`` of the nearest object around it that has one. Text that is no JSON has no values.
    """
    kind = F.try_variant_get("value", "$.type", "string")
    level = responses.select(key, F.array().cast("array<int>").alias("path"), F.lit("").alias("name"), F.try_parse_json(body).alias("value"), F.lit("").alias("inside")).where("value IS NOT NULL")
    out = level
    for _ in range(deepest):
        opened = F.schema_of_variant("value").rlike("^(?:OBJECT|ARRAY)")
        around = level.where(opened).select(key, "path", "value", F.coalesce(kind, F.col("inside")).alias("inside"))
        spark = responses.sparkSession
        level = spark.sql(
            f"SELECT r.{key}, array_append(r.path, e.pos) AS path, coalesce(e.key, '') AS name, e.value, r.inside FROM {{r}} AS r, LATERAL variant_explode(r.value) AS e",
            r=around,
        )
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"a response is nested deeper than {deepest} levels")


def search_results(responses: DataFrame, domains: Sequence[str], key: str = "response_id", body: str = "body") -> DataFrame:
    """(key, urls, queries, errors): what a search tool was asked and found.

    Addresses count only where the tool gave them (never from text), on the domains, by https, without
    fragment; the first ``MOST_URLS`` different ones in their order. A result block whose content is no list is an error.
    """
    nodes = walked(responses, key, body)
    field = lambda name: F.try_variant_get("value", f"$.{name}", "string")
    kind = field("type")
    url = F.regexp_replace(F.coalesce(field("url"), F.lit("")), "#.*$", "")
    given = (kind == "web_search_result") & (F.col("inside") == "web_search_tool_result") & urls.allowed(url, domains)
    asked = (kind == "server_tool_use") & (field("name") == "web_search")
    failed = (F.col("name") == "content") & (F.col("inside") == "web_search_tool_result") & F.schema_of_variant("value").startswith("OBJECT") & kind.isNull()
    query = F.coalesce(F.try_variant_get("value", "$.input.query", "string"), F.lit(""))
    found = nodes.select(
        key,
        "path",
        F.when(given, url).alias("url"),
        F.when(asked, query).alias("query"),
        F.when(failed, F.coalesce(field("error_code"), F.lit("search_error"))).alias("error"),
    )
    # the values of one response lie together: it is one text
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("path", c)))), lambda x: x[c])
    return found.groupBy(key).agg(F.slice(F.array_distinct(listed("url")), 1, MOST_URLS).alias("urls"), listed("query").alias("queries"), listed("error").alias("errors"))
