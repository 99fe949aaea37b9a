"""What a search request may be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.functions import text as X

MAX_QUERY, MAX_K, DEFAULT_K = 500, 20, 5


def check(query: str, k: int = DEFAULT_K) -> str:
    """The query without blanks at its ends. Raises ValueError if request or query is not allowed."""
    if not 1 <= len(query) <= MAX_QUERY:
        raise ValueError(f"a query has 1 to {MAX_QUERY} characters")
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is 1 to {MAX_K}")
    if not query.strip():
        raise ValueError("the query is blank")
    return query.strip()


def verdicts(requests: DataFrame, query: str = "query", k: str = "k") -> DataFrame:
    """``requests`` with ``verdict``: ok, bad_length, bad_k or blank."""
    q = F.coalesce(F.col(query), F.lit(""))
    return requests.withColumn(
        "verdict",
        F.when(~F.length(q).between(1, MAX_QUERY), "bad_length").when(~F.col(k).between(1, MAX_K), "bad_k").when(X.strip(q) == "", "blank").otherwise("ok"),
    )


def allowed(requests: DataFrame, query: str = "query", k: str = "k") -> DataFrame:
    return verdicts(requests, query, k).where("verdict = 'ok'").drop("verdict").withColumn(query, X.strip(F.col(query)))
