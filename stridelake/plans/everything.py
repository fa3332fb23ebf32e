"""All query modules, so that each has registered its queries."""

from stridelake.plans import catalog, discovery, recordings, sources, studies, viewers, wavelets  # noqa: F401
from stridelake.plans.catalog import ORACLE, QUERIES  # noqa: F401
