"""Set operators over indicators (ioc_type, value, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["ioc_type", "value"]


def ordered_distinct(iocs: DataFrame, pos_col: str = "pos", keys: list[str] | None = None) -> DataFrame:
    """First occurrence by position of each (type, value); attribute maps count by their sorted entries.

    A minimum by key, so rows are combined before they are shuffled.
    """
    by = [*(keys or []), *KEY]
    maps = {c for c, t in iocs.dtypes if t.startswith("map")}
    plain = lambda c: F.to_json(F.sort_array(F.map_entries(c))) if c in maps else F.col(c)
    rest = [c for c in iocs.columns if c not in by or c in maps]
    order = F.struct(pos_col, *[plain(c).alias(f"__o{k}") for k, c in enumerate(rest) if c != pos_col])
    part = {f"__k{k}": plain(c) for k, c in enumerate([*by, *(["attrs"] if "attrs" in iocs.columns else [])])}
    first = iocs.withColumns(part).groupBy(*part).agg(F.min_by(F.struct(*iocs.columns), order).alias("__f"))
    return first.select("__f.*")


def unseen(new: DataFrame, seen: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct rows of new whose (type, value) is not in seen: one incremental step."""
    by = [*(keys or []), *KEY]
    return new.select(*by).distinct().join(seen.select(*by).distinct(), by, "left_anti")


def union_of_sources(parts: list[DataFrame]) -> DataFrame:
    """Normal indicators of several sources, each (type, value) once; warnings keep their repeats."""
    every = reduce(lambda a, b: a.unionByName(b), parts)
    if "is_warning" not in every.columns:
        return every.select(*KEY).distinct()
    columns = [c for c in every.columns if c != "source_value"]
    normal = every.filter(~F.col("is_warning")).select(*columns).distinct()
    return normal.unionByName(every.filter("is_warning").select(*columns))
