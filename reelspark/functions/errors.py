"""Kinds of failed requests, of the provider and of the client."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def provider_category(status: Column) -> Column:
    """The category of an answer's status; without an answer the error is transient."""
    return (
        F.when(status == 429, "rate_limited").when(status.isin(401, 403), "configuration")
        .when(status.isNull() | status.isin(408, 425) | (status >= 500), "transient").otherwise("permanent")
    )


def client_retries(kind: Column, status: Column) -> Column:
    """Whether a client asks again, by the kind of failure (network, timeout, aborted or http)."""
    return F.when(kind.isin("network", "timeout"), True).when(kind == "aborted", False).otherwise(F.coalesce(status.isin(408, 429) | (status >= 500), F.lit(False)))
