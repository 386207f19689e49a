"""State that grows: latest-wins tables, event-time windows, resumable ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def push(frontier: DataFrame, new: DataFrame, requeue: bool = False) -> DataFrame:
    """url, priority, status, seq: new urls come in; pending ones rise to a higher priority; with requeue others are revived."""
    rows = frontier.withColumn("_old", F.lit(1)).unionByName(new.withColumn("status", F.lit("pending")).withColumn("_old", F.lit(0)), allowMissingColumns=True)
    at = F.max_by("status", F.struct("_old", "seq"))
    out = rows.groupBy("url").agg(F.max("priority").alias("_most"), F.max_by("priority", F.struct("_old", "seq")).alias("_own"), at.alias("_status"), F.max(1 - F.col("_old")).alias("_again"), F.min("seq").alias("seq"))
    pending = F.col("_status") == "pending"
    revived = (F.col("_again") == 1) & F.lit(requeue)
    return out.select("url", F.when(pending | revived, F.col("_most")).otherwise(F.col("_own")).alias("priority"), F.when(revived, "pending").otherwise(F.col("_status")).alias("status"), "seq")


def windows(events: DataFrame, length: str = "1 hour", late: str = "30 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type; works on streams (events later than `late` are dropped) and on tables."""
    at = F.window("ts", length, slide) if slide else F.window("ts", length)
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def ingest(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, dead: str, checkpoint: str):
    """Each batch is parsed and committed with its checkpoint; rows that can't be parsed (null key) go to a dead-letter table."""

    def batch(rows: DataFrame, number: int) -> None:
        parsed = parse(rows).persist()
        parsed.where("key IS NOT NULL").withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        parsed.where("key IS NULL").write.mode("overwrite").parquet(f"{dead}/batch={number}")
        parsed.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_version(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Rows parsed by an older version are superseded."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def boosted(frontier: DataFrame, tokens: list[str], delta: float, cap: float) -> DataFrame:
    """Pending urls that hold one of the first eight tokens rise by delta, up to the cap."""
    hit = F.exists(F.array(*(F.lit(t.lower()) for t in tokens[:8])) if tokens else F.array().cast("array<string>"), lambda t: F.contains(F.lower("url"), t))
    return frontier.withColumn("priority", F.when((F.col("status") == "pending") & hit, F.least(F.col("priority") + delta, F.greatest(F.lit(cap), F.col("priority")))).otherwise(F.col("priority")))


def floored(frontier: DataFrame, priority: float, domain: str | None = None, part: str | None = None) -> DataFrame:
    """Pending urls of a domain, or with a part of a path, get at least the priority."""
    hit = F.lit(True) if domain is None else F.col("domain") == domain
    hit = hit if part is None else hit & F.contains("url", F.lit(part))
    return frontier.withColumn("priority", F.when((F.col("status") == "pending") & hit, F.greatest("priority", F.lit(priority))).otherwise(F.col("priority")))


def marked(frontier: DataFrame, done: DataFrame) -> DataFrame:
    """frontier with the statuses of done(url, status, at), the last of each url."""
    last = done.groupBy("url").agg(F.max_by("status", "at").alias("_status"), F.max("at").alias("_at"))
    return frontier.join(last, "url", "left").withColumn("status", F.coalesce("_status", "status")).withColumn("fetched_at", F.coalesce("_at", "fetched_at")).drop("_status", "_at")


def popped(frontier: DataFrame, budgets: dict[str, int], default: int = 1, avoid: list[str] = (), skip: list[str] = ()) -> DataFrame:
    """Pending urls within their domains' budgets, highest priority first; those with a skipped token stay pending, avoided domains come last."""
    table = F.create_map(*(F.lit(x) for pair in budgets.items() for x in pair)) if budgets else None
    budget = F.coalesce(F.try_element_at(table, F.col("domain")), F.lit(default)) if budgets else F.lit(default)
    skipped = F.exists(F.array(*(F.lit(t.lower()) for t in skip)), lambda t: F.contains(F.lower("url"), t)) if skip else F.lit(False)
    rows = frontier.where((F.col("status") == "pending") & ~skipped).withColumn("budget", budget)
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("priority"), "url"))
    rows = rows.withColumn("place", place).where("place <= budget").withColumn("late", F.col("domain").isin(list(avoid)))
    return rows.orderBy("late", F.desc("priority"), "url").drop("budget", "place")


def logged(log: DataFrame, new: DataFrame) -> DataFrame:
    """The scrape log with new rows: the last of a vendor and key (cut to 400 signs; details to 200)."""
    rows = log.unionByName(new, allowMissingColumns=True).withColumn("key", F.substring("key", 1, 400)).withColumn("detail", F.substring("detail", 1, 200))
    last = Window.partitionBy("vendor", "key").orderBy(F.desc("updated_at"))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def remaining(work: DataFrame, log: DataFrame, ok_only: bool = True) -> DataFrame:
    """work(vendor, key) that the log hasn't done; without ok_only failures count as done as well."""
    done = (log.where("status = 'ok'") if ok_only else log).select("vendor", F.substring("key", 1, 400).alias("_key")).distinct()
    cut = work.withColumn("_key", F.substring("key", 1, 400))
    return cut.join(done, ["vendor", "_key"], "left_anti").drop("_key")


def cleared(log: DataFrame, vendors: list[str]) -> DataFrame:
    """The log without vendors like the given ones."""
    gone = F.lit(False)
    for v in vendors:
        gone |= F.col("vendor").ilike(f"%{v}%")
    return log.where(~gone)


def unseen(documents: DataFrame, seen: DataFrame, version: int) -> DataFrame:
    """documents(sha256) that weren't read by this parser version or a later one."""
    return documents.join(seen.where(F.col("parser_version") >= version).select("sha256").distinct(), "sha256", "left_anti")


def fingerprint(content: Column) -> Column:
    """Size and the first 16 signs of the SHA-1 of a file's bytes."""
    return F.concat(F.octet_length(content).cast("string"), F.lit(":"), F.substring(F.sha1(content), 1, 16))


def page_signature(text: Column) -> Column:
    """The SHA-1 of a page's length, head and tail."""
    return F.sha1(F.concat(F.char_length(text).cast("string"), F.lit("|"), F.left(text, F.lit(4096)), F.lit("|"), F.right(text, F.lit(4096))))


def changed(files: DataFrame, manifest: DataFrame, version: int) -> DataFrame:
    """files(path, fingerprint) that are new, were changed, or were read by an older parser."""
    known = manifest.where(F.col("parser_version") >= version).select("path", "fingerprint").distinct()
    return files.join(known, ["path", "fingerprint"], "left_anti")


def remembered(state: DataFrame, new: DataFrame, targets: DataFrame, lasting: list[str]) -> tuple[DataFrame, DataFrame]:
    """The memory of failures with new ones (the last of an mpn and url), and the targets(mpn, url) that didn't fail for good."""
    rows = state.unionByName(new, allowMissingColumns=True)
    last = Window.partitionBy("mpn", "url").orderBy(F.desc("at"))
    kept = rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return kept, targets.join(kept.where(F.col("status").isin(lasting)).select("mpn", "url"), ["mpn", "url"], "left_anti")


def live(parts: DataFrame) -> DataFrame:
    """The last row of each part by vendor and number in any case, as a running table shows it."""
    last = Window.partitionBy(F.lower("vendor"), F.upper("mpn")).orderBy(F.desc("seq"))
    return parts.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
