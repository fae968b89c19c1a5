"""The query catalogue; importing the package registers the queries of all its modules."""

from . import catalogue, datasets, rendering, scenes  # noqa: F401
