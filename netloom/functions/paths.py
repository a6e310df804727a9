"""AS paths (ARRAY<BIGINT>, null = unsupported) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANS = 23456  # the placeholder for a 4-byte number in a 2-byte path


def collapse(path: Column) -> Column:
    """Without repeats of the element just before; other repeats stay."""
    return F.filter(path, lambda v, i: (i == 0) | (v != F.coalesce(F.get(path, i - 1), v + 1)))


def path_key(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), ",")


def hops(path: Column) -> Column:
    return F.greatest(F.size(path) - 1, F.lit(0))


def trunk_size(a: Column, b: Column) -> Column:
    """Length of the longest common beginning."""
    m = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(1), m), lambda x, y: x == y)
    first = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(m)


def trunk(a: Column, b: Column) -> Column:
    return F.slice(a, F.lit(1), trunk_size(a, b))


def branch(a: Column, b: Column) -> Column:
    """What of a follows the common trunk with b."""
    return F.slice(a, trunk_size(a, b) + 1, F.size(a))


def later_common(a: Column, b: Column) -> Column:
    return F.array_intersect(branch(a, b), branch(b, a))


def comparison(a: Column, b: Column) -> Column:
    """same, one_ends, shared_then_split or disjoint."""
    k = trunk_size(a, b)
    return F.when((F.size(a) == k) & (F.size(b) == k), "same").when((k > 0) & ((F.size(a) == k) | (F.size(b) == k)), "one_ends").when(k > 0, "shared_then_split").otherwise("disjoint")


def network_name(organization: Column, name: Column, missing: str = "not listed") -> Column:
    return F.coalesce(F.nullif(F.nullif(organization, F.lit("Unknown organization")), F.lit("")), F.nullif(name, F.lit("")), F.lit(missing))


def linear(segments: Column) -> Column:
    """Segments (STRUCT<kind, asns>) as one path; null where any is no plain sequence (kind 2)."""
    return F.when(F.forall(segments, lambda s: s.kind == 2), F.flatten(F.transform(segments, lambda s: s.asns)))


def merge_as4(path: Column, as4: Column, aggregator: Column, has_as4_aggregator: Column) -> Column:
    """The 4-byte path's numbers in place of the path's tail, where the path has the placeholder and the 4-byte path is
    not longer; an aggregator that is not the placeholder tells that the 4-byte attributes are stale."""
    stale = has_as4_aggregator & aggregator.isNotNull() & (aggregator != TRANS)
    use = F.array_contains(path, F.lit(TRANS)) & as4.isNotNull() & ~F.coalesce(stale, F.lit(False)) & (F.size(as4) > 0) & (F.size(as4) <= F.size(path))
    return F.when(use, F.concat(F.slice(path, F.lit(1), F.size(path) - F.size(as4)), as4)).otherwise(path)


def valid(path: Column, longest: int = 256) -> Column:
    """Null for an empty path and one with 0 or the placeholder; an error for one that is too long."""
    sound = (F.size(path) > 0) & ~F.array_contains(path, F.lit(0).cast("bigint")) & ~F.array_contains(path, F.lit(TRANS).cast("bigint"))
    return F.when(sound & (F.size(path) > longest), F.raise_error(F.lit("AS path is too long")).cast("array<bigint>")).when(sound, path)
