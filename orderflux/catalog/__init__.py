"""All registered queries."""

from orderflux.catalog import core, customers, ingest, models, revenue, tables  # noqa: F401
from orderflux.catalog.base import REGISTRY, oracle, spark_callable  # noqa: F401
