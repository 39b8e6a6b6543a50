"""Full extraction: documents to indicators, long or wide, in one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extractors import EXTRACTORS, domains_of, found, hosts_of, urls_of

Registry = Mapping[str, Callable[..., Column]]


def indicator_columns(df: DataFrame, text_col: str = "text", types: list[str] | None = None, defang: bool = True, registry: Registry | None = None) -> DataFrame:
    """df with an array column for every type.  URLs are found once and shared with domains, these with hosts."""
    registry = EXTRACTORS if registry is None else registry
    types = list(registry) if types is None else types
    unknown = set(types) - set(registry)
    if unknown:
        raise ValueError(f"unknown indicator types: {sorted(unknown)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = {t: registry[t](text, defang) for t in types}
    built_in = registry is EXTRACTORS
    if built_in and {"domains", "urls"} <= own.keys():  # both look at the URLs of the text
        df = df.withColumn("__found", found(text, "urls"))
        own |= {"domains": domains_of(text, F.col("__found"), defang), "urls": urls_of(F.col("__found"), defang)}
    shared = built_in and {"hosts", "domains"} <= own.keys()
    first = df.withColumns({f"__{t}": c for t, c in own.items() if not (shared and t == "hosts")})
    return first.withColumn("__hosts", hosts_of(text, F.col("__domains"))) if shared else first


def tagged(ioc_type: str) -> Column:
    return F.transform(f"__{ioc_type}", lambda v: F.struct(F.lit(ioc_type).alias("ioc_type"), v.alias("value")))


def extract_all(df: DataFrame, text_col: str = "text", keys: list[str] | None = None, types: list[str] | None = None, defang: bool = True, registry: Registry | None = None) -> DataFrame:
    """(keys..., ioc_type, value), distinct within each row of df; rows without indicators give none.

    ``registry`` holds the types of this extraction (type to extractor) in place of the library's.
    """
    types = list(EXTRACTORS if registry is None else registry) if types is None else types
    keys = [c for c in df.columns if c != text_col] if keys is None else keys
    wide = indicator_columns(df.select(*keys, text_col), text_col, types, defang, registry)
    entries = wide.select(*keys, F.explode(F.concat(*map(tagged, types))).alias("__e"))
    return entries.select(*keys, "__e.ioc_type", "__e.value")


def extract_wide(df: DataFrame, text_col: str = "text", keys: list[str] | None = None, types: list[str] | None = None, defang: bool = True) -> DataFrame:
    """(keys..., iocs map of type to sorted values); empty types are left out."""
    types = list(EXTRACTORS) if types is None else types
    keys = [c for c in df.columns if c != text_col] if keys is None else keys
    wide = indicator_columns(df.select(*keys, text_col), text_col, types, defang)
    pairs = F.array(*[F.struct(F.lit(t).alias("key"), F.sort_array(f"__{t}").alias("value")) for t in types])
    return wide.select(*keys, F.map_from_entries(F.filter(pairs, lambda p: F.size(p.value) > 0)).alias("iocs"))


def counts_by_type(iocs: DataFrame, total: bool = False) -> DataFrame:
    """(ioc_type, n); with total, a last row of type null for all of them."""
    grouped = iocs.rollup("ioc_type") if total else iocs.groupBy("ioc_type")
    return grouped.agg(F.count("*").alias("n"))
