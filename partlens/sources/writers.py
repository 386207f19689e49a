"""Results as files: nested JSON, CSV grids, Markdown reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_parts(parts: DataFrame, specs: DataFrame, evidence: DataFrame, path: str) -> None:
    """Parts with their specifications ordered by key and source and their evidence by signal."""
    own = lambda rows, name: rows.groupBy("part_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != "part_id")))).alias(name))
    parts.join(own(specs, "specs"), "part_id", "left").join(own(evidence, "evidence"), "part_id", "left").write.mode("overwrite").json(path)


def grid(parts: DataFrame, specs: DataFrame, path: str) -> None:
    """One column for each key; descriptions cut to 200 characters."""
    wide = specs.groupBy("part_id").pivot("key").agg(F.first("value", ignorenulls=True))
    if "description" in parts.columns:
        parts = parts.withColumn("description", F.substring("description", 1, 200))
    parts.join(wide, "part_id", "left").write.mode("overwrite").csv(path, header=True)


def markdown(ranked: DataFrame, top: int = 50) -> str:
    """The first `top` ranked rows under their tiers; empty tiers are left out."""
    rows, out = ranked.limit(top).collect(), []
    for tier, title in (("A", "All criteria met"), ("B", "Some unknown"), ("C", "Some missed")):
        own = [r for r in rows if r["tier"] == tier]
        if own:
            out += [f"## {tier}: {title}", "", *(f"- {r['part_id']}: fit {r['fit']}, met {r['met']}, unknown {r['unknown']}" for r in own), ""]
    return "\n".join(out)
