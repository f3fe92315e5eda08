"""One path of a JSON text set, all others kept, whatever the shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def set_path(raw: Column, path: Sequence[str], value: Column) -> Column:
    """``raw`` with ``value`` (JSON text) at the path; objects on the way are made where they are missing.

    A null text is an empty object. What is on the way and no object is replaced. A text that is no JSON,
    or no object at its root, stays as it is: nothing of it is lost. Numbers keep their value, not
    the zeros behind it, and keys may change their order.
    """
    return F.when(raw.isNull(), _put(F.lit(None).cast("variant"), path, value, True)).otherwise(F.coalesce(_put(F.try_parse_json(raw), path, value, False), raw))


def _members(node: Column) -> Column:
    """Members of an object as a map; null for anything else."""
    return F.try_variant_get(node, "$", "map<string,variant>")


def _put(node: Column, path: Sequence[str], value: Column, make: bool) -> Column:
    return F.to_json(F.to_variant_object(_map(node, path, value, make)))


def _map(node: Column, path: Sequence[str], value: Column, make: bool) -> Column:
    name, rest = path[0], path[1:]
    members = _members(node)
    if make:
        members = F.coalesce(members, F.from_json(F.lit("{}"), "map<string,variant>"))
    below = F.parse_json(value) if not rest else F.to_variant_object(_map(F.try_element_at(members, F.lit(name)), rest, value, True))
    return F.map_concat(F.map_filter(members, lambda k, v: k != name), F.create_map(F.lit(name), below))
