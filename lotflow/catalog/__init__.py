"""Named queries over the driver's tables, each with the same result stated in plain SQL where SQL can say it."""

from lotflow.catalog import (  # noqa: F401
    aggregates, cleaning, dates, joins, models, ordering, scalars, storage, streams, windows,
)
from lotflow.catalog.base import ORACLES, QUERIES  # noqa: F401
