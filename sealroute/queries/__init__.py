"""The registered queries: every operator on the given tables, with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> dict[str, tuple[Query, str | None]]:
    from sealroute.queries import armor, blocks, file_jobs, files, jobs, requests, streams

    return {**files.QUERIES, **requests.QUERIES, **armor.QUERIES, **jobs.QUERIES, **file_jobs.QUERIES, **streams.QUERIES, **blocks.QUERIES}
