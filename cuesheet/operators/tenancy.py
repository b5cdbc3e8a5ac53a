"""Tables as a tenant sees them. A catalog never gives out a table without its row filter.

``scoped_session`` goes further: in a session of the tenant's own, names of tables stand for filtered views, so that neither SQL
text nor ``table()`` has to ask for the filter, joins and subqueries included.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """Who asks: a tenant, nobody (None: sees nothing), or the system (sees all)."""

    tenant: str | None = None
    system: bool = False


SHARED = ("tenant", "app_user")


class Catalog:
    """Named tables; all but ``shared`` ones are filtered by ``tenant_id``."""

    def __init__(self, tables: dict[str, DataFrame], shared: tuple[str, ...] = SHARED):
        self._tables, self._shared = dict(tables), frozenset(shared)

    def table(self, name: str, context: Context) -> DataFrame:
        df = self._tables[name]
        if name in self._shared or context.system:
            return df
        return df.filter(F.col("tenant_id") == (context.tenant or ""))


def scoped_session(spark: SparkSession, tables: dict[str, Callable[[SparkSession], DataFrame]], context: Context, shared: tuple[str, ...] = SHARED) -> SparkSession:
    """A new session with a view for each of ``tables`` (how to read it in a session), as the one who asks may see it.

    The filter is part of the view, and is pushed into the scan. Views of other sessions are not seen in it.
    """
    own = spark.newSession()
    for name, read in tables.items():
        Catalog({name: read(own)}, shared).table(name, context).createOrReplaceTempView(name)
    return own
