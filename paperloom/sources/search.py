"""A Python data source for search interfaces: ``spark.read.format("paper_search")``.

Options: ``interface`` (one of :data:`INTERFACES`, or give ``url`` with
``{query}`` and ``{limit}``, ``path`` (dots) of the result array and ``most``,
the page size, yourself), ``queries`` (a JSON array), ``limit``, ``mailto``,
``fields`` (what a record is asked for; by default what the normaliser reads),
``headers`` (a JSON object, for API keys) and ``empty`` ("true": a query that
fails gives one empty record, as point lookups need it).  One partition per
query; else a query that fails gives no row, as does one without results.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import quote
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Public search interfaces, their page sizes and the fields that the normalisers read.
INTERFACES = {
    "works": {"url": "https://api.openalex.org/works?search={query}&per_page={limit}&mailto={mailto}", "path": "results", "most": "200"},
    "items": {"url": "https://api.crossref.org/works?query={query}&rows={limit}&mailto={mailto}", "path": "message.items", "most": "100"},
    "papers": {"url": "https://api.semanticscholar.org/graph/v1/paper/search?query={query}&limit={limit}&fields={fields}", "path": "data", "most": "100", "fields": "title,abstract,year,authors,venue,externalIds,openAccessPdf,isOpenAccess"},
    "lookup": {"url": "https://api.unpaywall.org/v2/{query}?email={mailto}", "path": "", "most": "1", "empty": "true"},
}


def _get(url: str, headers: dict[str, str]) -> str:
    with urlopen(Request(url, headers={"Accept": "application/json"} | headers), timeout=30) as r:  # noqa: S310
        return r.read().decode("utf-8", "replace")


class QueryPartition(InputPartition):
    def __init__(self, at: int, query: str):
        super().__init__(at)
        self.at, self.query = at, query


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        options = dict(options)
        self.options = INTERFACES.get(options.get("interface", ""), {}) | options

    def partitions(self) -> list[QueryPartition]:
        return [QueryPartition(i, q) for i, q in enumerate(json.loads(self.options.get("queries", "[]")))]

    def read(self, partition: QueryPartition | None) -> Iterator[tuple]:
        if partition is None:  # no queries
            return
        limit = min(max(int(self.options.get("limit", 20)), 1), int(self.options.get("most", 200)))
        url = self.options["url"].replace("{limit}", str(limit)).replace("{mailto}", quote(self.options.get("mailto", ""))).replace("{fields}", quote(self.options.get("fields", ""))).replace("{query}", quote(partition.query))
        try:
            found = json.loads(_get(url, json.loads(self.options.get("headers", "{}"))))
            for key in filter(None, self.options.get("path", "").split(".")):
                found = found[int(key)] if isinstance(found, list) else found[key]
        except Exception:  # noqa: BLE001  an interface that fails is an empty result
            if self.options.get("empty") == "true":
                yield partition.at, partition.query, 0, "{}"
            return
        found = found if isinstance(found, list) else [found] if found else []
        for pos, x in enumerate(found[:limit]):
            yield partition.at, partition.query, pos, json.dumps(x, ensure_ascii=False)


class PaperSearch(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return "query_ord int, query string, pos int, payload string"

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def search(spark: SparkSession, queries: list[str], schema: str, **options: str) -> DataFrame:
    """The parsed records of several queries in the order of queries and results, not de-duplicated: ``(query_ord, query, pos, record)``."""
    spark.dataSource.register(PaperSearch)
    read = spark.read.format("paper_search").options(queries=json.dumps(queries), **{k: str(v) for k, v in options.items()})
    return read.load().select("query_ord", "query", "pos", F.from_json("payload", schema).alias("record"))


def cell_queries(spark: SparkSession, places: DataFrame, queries: dict[str, dict[str, list[str]]]) -> DataFrame:
    """``(country, category, country_ord, category_ord, query_ord, query)`` for the cells of ``places (country, category)`` that have queries; cells without any are skipped."""
    rows = [(c, k, i, j, n, q) for i, (c, cells) in enumerate(queries.items()) for j, (k, qs) in enumerate(cells.items()) for n, q in enumerate(qs)]
    known = spark.createDataFrame(rows, "country string, category string, country_ord int, category_ord int, query_ord int, query string")
    return known.join(places.select("country", "category").distinct(), ["country", "category"])
