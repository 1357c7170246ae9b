"""One store a tenant, below one base folder.

Tenants never share a file, a version or a batch number. A table of tenants, such as those a
user may see, is looked up first, and only the stores of the tenants it names are opened;
operators run on each tenant's log by itself, so that no mean, rank or first task mixes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.sources.files import names_in
from worklens.sources.store import VERSIONS, Snapshot, snapshot
from worklens.sources.writers import write_task_log

_FOLDER = "tenant="


def tenant_root(base: str, tenant: str) -> str:
    """The folder of a tenant's store; any name makes one folder."""
    return f"{base}/{_FOLDER}{quote(tenant, safe='')}"


def tenants_at(spark: SparkSession, base: str) -> list[str]:
    """The tenants that have something stored."""
    folders = [n for n in names_in(spark, base) if n.startswith(_FOLDER)]
    return sorted(
        unquote(n.removeprefix(_FOLDER)) for n in folders if names_in(spark, f"{base}/{n}/{VERSIONS}")
    )


def write_tenants(batch: DataFrame, batch_no: int, base: str, **options) -> dict[str, bool]:
    """Writes the rows of each value of the column ``tenant`` as a batch of that tenant's store;
    tells for each if durations were adjusted. Rows without a tenant are an error."""
    found = [r.tenant for r in batch.select("tenant").distinct().collect()]  # one row a tenant
    if None in found:
        raise ValueError("the batch has rows without a tenant")
    return {
        tenant: write_task_log(
            batch.where(F.col("tenant") == tenant).drop("tenant"), batch_no,
            tenant_root(base, tenant), **options,
        )
        for tenant in sorted(found)
    }


def for_each_tenant(
    spark: SparkSession,
    base: str,
    table: Callable[[Snapshot], DataFrame],
    tenants: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """The rows that ``table`` makes of each tenant's snapshot, with the ``tenant`` first.

    ``tenants`` are names, or a table whose first column holds them; by default all that have
    something stored. Names that have not are left out; without any left there are no rows.
    """
    stored = tenants_at(spark, base)
    if isinstance(tenants, DataFrame):
        # one row a tenant
        tenants = [r[0] for r in tenants.select(tenants.columns[0]).distinct().collect()]
    chosen = stored if tenants is None else sorted(set(stored) & set(tenants))
    parts = [
        table(snapshot(spark, tenant_root(base, t))).select(F.lit(t).alias("tenant"), "*")
        for t in chosen
    ]
    if not parts:
        return table(Snapshot(base)).select(F.lit("").alias("tenant"), "*").where("false")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
