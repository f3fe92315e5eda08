"""Importing this package registers its queries."""

from groundwork.plans import county_feeds, deriving, documents, emitting, enrich, feed, landed, matching, merging, portal, repairs, resolving, scalars, serving, statistics, upkeep, views  # noqa: F401
