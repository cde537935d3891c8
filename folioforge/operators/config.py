"""Configuration: namespaces, registry lookups, unit lists of several shapes, table boxes, pacing of external calls."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "struct<unit_id:string,unit_type:string,page:int,content:string>"


def production(namespaces: DataFrame) -> DataFrame:
    return namespaces.filter("type = 'final'")


def testing(namespaces: DataFrame) -> DataFrame:
    return namespaces.filter("type = 'testing'")


def by_id(namespaces: DataFrame, name: str) -> DataFrame:
    return namespaces.filter(F.col("id") == name)


def by_client(namespaces: DataFrame, client: str) -> DataFrame:
    return namespaces.filter(F.col("client") == client)


def unknown(names: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Names (id) that no namespace has."""
    return names.join(namespaces.select("id"), "id", "left_anti")


def with_profile(namespaces: DataFrame, profiles: DataFrame) -> DataFrame:
    """Namespaces with their profile's columns; a namespace whose profile is missing is an error when it is read."""
    joined = namespaces.join(profiles.withColumn("_found", F.lit(True)), "client_profile", "left")
    return joined.withColumn("client_profile", F.when(F.col("_found"), F.col("client_profile")).otherwise(F.raise_error(F.concat(F.lit("no profile "), "client_profile")))).drop("_found")


def valid_switches(switches: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Switches (ts, namespace, switched_by) with ``valid``: whether a namespace of that id is known."""
    known = namespaces.select(F.col("id").alias("namespace")).distinct().withColumn("valid", F.lit(True))
    return switches.join(known, "namespace", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def active_namespace(switches: DataFrame, namespaces: DataFrame | None = None) -> DataFrame:
    """The latest switch of (ts, namespace, switched_by), an append-only log; with namespaces the latest one to a namespace that is known."""
    log = switches if namespaces is None else valid_switches(switches, namespaces).filter("valid").drop("valid")
    return log.orderBy(F.desc("ts"), "namespace").limit(1)


def summary(switches: DataFrame, namespaces: DataFrame, profiles: DataFrame, settings: DataFrame) -> DataFrame:
    """One row: the active namespace, its client and number of enabled types ('Unknown' and 0 without a profile), all profiles by name, and the settings' version and models.

    profiles: client_profile, client_name, enhancement_types (map of 0 or 1); settings: one row (version, llm_model, embedding_model).
    """
    enabled = F.size(F.filter(F.map_entries("enhancement_types"), lambda e: (e["value"] == 1) & ~e["key"].startswith("_")))
    p = profiles.filter(~F.col("client_profile").contains("template"))
    names = p.agg(F.array_sort(F.collect_list("client_profile")).alias("available_profiles"), F.count("*").alias("total_profiles"))
    active = active_namespace(switches, namespaces).select(F.col("namespace").alias("active_namespace"))
    with_client = active.join(namespaces.select(F.col("id").alias("active_namespace"), "client_profile"), "active_namespace").join(p.select("client_profile", "client_name", enabled.cast("long").alias("enabled")), "client_profile", "left")
    row = with_client.select("active_namespace", F.coalesce("client_name", F.lit("Unknown")).alias("active_client"), F.coalesce("enabled", F.lit(0)).alias("active_enabled_types"))
    return settings.limit(1).crossJoin(row).crossJoin(names)


def types_of_category(types: DataFrame, category: str) -> DataFrame:
    return types.filter(F.col("category") == category).orderBy("display_order", "type_id")


def selected_types(types: DataFrame, wanted: DataFrame) -> DataFrame:
    """Registry rows of the wanted ids, in the registry's order; unknown ids fall away."""
    return types.join(wanted.select("type_id").distinct(), "type_id").orderBy("display_order", "type_id")


def frontend_config(types: DataFrame) -> DataFrame:
    """One row of JSON: categories in order with their types."""
    item = F.struct("type_id", "name", "description", "default_enabled", "default_priority")
    per = types.groupBy("category").agg(F.min("display_order").alias("o"), F.array_sort(F.collect_list(item)).alias("types"))
    return per.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o", "category", "types"))), lambda c: F.struct(c["category"].alias("category"), c["types"].alias("types")))).alias("config"))


def unit_list(raw: Column) -> Column:
    """Units from any of four JSON shapes: a list, {"units": []}, {"content_units": []}, or {id: unit}."""
    wrapped = F.from_json(raw, f"struct<units:array<{UNIT}>,content_units:array<{UNIT}>>")
    keyed = F.map_entries(F.from_json(raw, f"map<string,{UNIT}>"))
    named = F.transform(F.filter(keyed, lambda e: e["value"]["content"].isNotNull()), lambda e: F.struct(e["key"].alias("unit_id"), e["value"]["unit_type"].alias("unit_type"), e["value"]["page"].alias("page"), e["value"]["content"].alias("content")))
    listed = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, f"array<{UNIT}>"))
    return F.coalesce(listed, wrapped["units"], wrapped["content_units"], named, F.from_json(F.lit("[]"), f"array<{UNIT}>"))


def narrow_table(x0: Column, x1: Column, columns: Column, header: Column, width: Column) -> tuple[Column, Column]:
    """Sides of a table's box: one that spans four fifths of the page is narrowed to its columns, to the right if the header speaks of figures."""
    content = F.least(columns * 80.0, width * 0.45)
    figures = F.lower(header).rlike("%|index|rate|price")
    left = F.when(figures, width - content - 50).otherwise(50.0)
    wide = (x1 - x0) >= width * 0.8
    return F.when(wide, left).otherwise(x0), F.when(wide, left + content).otherwise(x1)


def estimated_table(ordinal: Column, columns: Column, rows: Column, width: Column) -> tuple[Column, Column, Column, Column]:
    """A box for a table without one: sides alternate, tables stand 120 apart."""
    w = F.least(columns * 70.0, width * 0.4, F.lit(300.0))
    x = F.when(ordinal % 2 == 0, 50.0).otherwise(width * 0.55)
    y = 100.0 + ordinal * 120.0
    return x, y, x + w, y + rows * 20.0 + 40.0


def pattern_samples(patterns: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, kind, n, samples): numbers of patterns with their first values by place; the cap is the sample's size."""
    w = Window.partitionBy("doc_id", "kind").orderBy("start", "end")
    ranked = patterns.withColumn("k", F.row_number().over(w))
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= most, F.struct("k", "value")))), lambda x: x["value"])
    return ranked.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), first.alias("samples"))


class Pace:
    """Token bucket for calls from one task: ``rate`` calls a second over all tasks, shared evenly."""

    def __init__(self, rate: float, tasks: int = 1, capacity: float = 10.0, clock=time.monotonic, sleep=time.sleep):
        self.rate, self.room, self.clock, self.sleep = rate / max(1, tasks), capacity, clock, sleep
        self.left, self.last = capacity, clock()

    def wait(self) -> None:
        now = self.clock()
        self.left = min(self.room, self.left + (now - self.last) * self.rate)
        if self.left < 1:
            self.sleep((1 - self.left) / self.rate)
            now, self.left = self.clock(), 1.0
        self.last = now
        self.left -= 1
