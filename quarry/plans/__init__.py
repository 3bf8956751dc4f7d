"""The query catalogue and its oracle SQL."""

from . import catalogue, service, streams, text  # noqa: F401  the others add their queries to the catalogue
