"""Append-only logs: latest record, open work, snapshots, review queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed


def latest_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last record per key. An aggregate, not a window: each task keeps one row per key."""
    others = [name for name in log.columns if name not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order))
    return log.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.*")


def pending(scanned: DataFrame, latest: DataFrame) -> DataFrame:
    """Scanned files that neither succeeded nor wait for a submitted batch."""
    busy = latest.where(
        (F.col("status") == "success")
        | ((F.col("status") == "submitted") & F.col("batch_id").isNotNull() & (F.col("batch_id") != ""))
    )
    return scanned.join(busy.select("sha256").distinct(), "sha256", "left_anti")


def only_new(documents: DataFrame, done: DataFrame) -> DataFrame:
    return documents.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """New snapshot in which incoming rows, unique by key, replace current ones."""
    return current.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def replace_documents(current: DataFrame, incoming: DataFrame, touched: DataFrame) -> DataFrame:
    """Delete-then-insert for every touched document, also when nothing comes back for it."""
    return current.join(touched.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(incoming)


def merge_candidates(current: DataFrame, detected: DataFrame) -> DataFrame:
    """Refreshes statistics of review candidates and keeps what people decided about them."""
    keys = ["theme", "cand_key"]
    decided = ["status", "note", "reviewed_at"]
    statistics = [name for name in detected.columns if name not in keys]
    joined = current.alias("old").join(detected.withColumn("seen", F.lit(True)).alias("new"), keys, "full_outer")

    def fresh(name: str) -> Column:
        return F.when(F.col("seen"), F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)

    return joined.select(
        *keys, *[fresh(name) for name in statistics],
        F.coalesce("old.status", F.lit("watching")).alias("status"),
        *[F.col(f"old.{name}") for name in decided[1:]],
    )


def mark_candidate(
    candidates: DataFrame, theme: str, cand_key: str, status: str, reviewed_at: Column, note: str | None = None
) -> DataFrame:
    if status not in fixed.CANDIDATE_STATES:
        raise ValueError(f"unknown status {status!r}; use one of {fixed.CANDIDATE_STATES}")
    hit = (F.col("theme") == theme) & (F.col("cand_key") == cand_key)
    return (
        candidates.withColumn("note", F.when(hit, F.coalesce(F.lit(note), F.col("note"))).otherwise(F.col("note")))
        .withColumn("reviewed_at", F.when(hit, reviewed_at).otherwise(F.col("reviewed_at")))
        .withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    )


def list_candidates(candidates: DataFrame, theme: str | None = None, status: str | None = None) -> DataFrame:
    chosen = candidates
    if theme:
        chosen = chosen.where(F.col("theme") == theme)
    if status:
        chosen = chosen.where(F.col("status") == status)
    return chosen.orderBy(F.desc("inst_count"), F.desc("doc_count"), "theme", "cand_key")


def clean_history(turns: DataFrame) -> DataFrame:
    blank = F.regexp_replace("text", r"(?U)\s+", "") == ""
    return turns.where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull() & ~blank)


def match_results(records: DataFrame, items: DataFrame) -> DataFrame:
    """Service results by document id, by file name where the id is missing.

    Of several items under one id or name the last of the response stands: by `position` where items have one,
    else by the item's own values, so that a record never multiplies.
    """
    item = F.struct(*items.columns)
    order = F.struct("position", item) if "position" in items.columns else item
    by_id = items.where(F.col("data_id").isNotNull()).groupBy(F.col("data_id").cast("string").alias("doc_id")).agg(
        F.max_by(item, order).alias("id_item"))
    name = F.coalesce(F.nullif("file_name", F.lit("")), "name")
    by_name = items.where(name.isNotNull()).groupBy(name.alias("base_name")).agg(F.max_by(item, order).alias("name_item"))
    named = records.withColumn("base_name", F.regexp_extract("source", r"[^/\\]*$", 0))
    joined = named.join(by_id, "doc_id", "left").join(by_name, "base_name", "left")
    return joined.withColumn("item", F.coalesce("id_item", "name_item")).where(F.col("item").isNotNull()).drop(
        "base_name", "id_item", "name_item"
    )


def state_histogram(items: DataFrame) -> DataFrame:
    state = F.lower(F.coalesce(F.col("state"), F.lit("unknown")))
    return items.groupBy(state.alias("state")).agg(F.count("*").alias("items"))


def finished_records(matched: DataFrame, finished_at: Column) -> DataFrame:
    """Log rows to append for results that reached a final state."""
    state = F.lower(F.coalesce(F.col("item.state"), F.lit("")))
    url = F.coalesce("item.full_zip_url", "item.zip_url", "item.download_url")
    failed = state.isin(fixed.FAILED_STATES)
    done = matched.where(state.isin(fixed.TERMINAL_STATES))
    error = F.when(
        failed, F.coalesce("item.err_msg", "item.message", F.concat(F.lit("state: "), state))
    ).when(url.isNull(), F.coalesce("item.err_msg", F.lit("no download address in the response")))
    return (
        done.withColumn("error", error)
        .withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failed"))
        .withColumn("finished_at", finished_at)
        .drop("item")
    )
