"""Directions that gather around a topic tree without being part of it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.like import substring_join
from ..functions.segments import canonical_name, name_atoms
from ..session import checkpointed
from .layout import dealt
from .themes import percentage

# Matching names that are shared with every task; more are joined by shuffle.
MATCH_BLOCK = 200_000


def matching_themes(chain_themes: DataFrame, doc_themes: DataFrame) -> DataFrame:
    """(chain, theme) where the theme's name contains the chain's name."""
    names = doc_themes.select("theme").distinct()
    found = checkpointed(substring_join(names, "theme", chain_themes.select(F.col("theme").alias("chain")), "chain"))
    return F.broadcast(found) if found.count() <= MATCH_BLOCK else found


def co_occurrence(matches: DataFrame, doc_themes: DataFrame) -> DataFrame:
    """(chain, theme, doc_id): a theme next to another theme that matches the chain.

    A theme qualifies when its document holds a matching theme other than itself. Counting
    the matching themes per document decides that, so no pairs of themes are formed. Tags are
    dealt out by document once, for the counts and for the join with them.
    """
    tags = dealt(doc_themes, "doc_id")
    tagged = tags.join(matches, "theme")
    matched = tagged.groupBy("chain", "doc_id").agg(F.count("*").alias("matching"))
    own = matches.withColumn("itself", F.lit(1))
    beside = tags.join(matched, "doc_id").join(own, ["chain", "theme"], "left")
    return beside.where(F.col("matching") - F.coalesce("itself", F.lit(0)) >= 1).select("chain", "theme", "doc_id")


def candidate_statistics(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, institutions and date span per (chain, theme).

    Grouping by institution first turns the two distinct counts into plain sums and
    keeps a frequent theme's rows from meeting in one task.
    """
    dated = pairs.join(documents.select("doc_id", "institution", "report_date"), "doc_id")
    per_institution = dated.groupBy("chain", "theme", "institution").agg(
        F.count("*").alias("docs"), F.min("report_date").alias("first_seen"), F.max("report_date").alias("last_seen")
    )
    return per_institution.groupBy("chain", "theme").agg(
        F.sum("docs").alias("docs"),
        F.count("institution").alias("insts"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
    )


def theme_lift(
    statistics: DataFrame, documents: DataFrame, doc_themes: DataFrame, matches: DataFrame
) -> DataFrame:
    """Adds lift: the theme's share inside the chain over its share in the whole collection."""
    n_all = F.greatest(documents.agg(F.count("*").alias("n")).scalar(), F.lit(1))
    per_theme = doc_themes.groupBy("theme").agg(F.count("*").alias("global_docs"))
    tagged = dealt(doc_themes, "doc_id").join(matches, "theme").select("chain", "doc_id").distinct()
    per_chain = tagged.groupBy("chain").agg(F.count("*").alias("chain_docs"))
    joined = statistics.join(per_theme, "theme").join(per_chain, "chain")
    inside = F.col("docs") / F.greatest("chain_docs", F.lit(1))
    return joined.withColumn("lift", inside / (F.col("global_docs") / n_all))


def recency_cutoff(documents: DataFrame, today: dt.date, recent_days: int) -> Column:
    """Newest report date, never later than today, minus the window; NULL without any date."""
    newest = documents.agg(F.max("report_date").alias("d")).scalar()
    return F.when(newest.isNotNull(), F.date_sub(F.least(newest, F.lit(today)), recent_days))


def uncovered(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates (chain, theme) none of whose atoms is an atom of the chain's segments."""
    known = segments.select("chain", F.explode(name_atoms(F.col("name"))).alias("atom")).distinct()
    atoms = candidates.select("chain", "theme", F.explode(name_atoms(F.col("theme"))).alias("atom"))
    covered = atoms.join(known, ["chain", "atom"], "left_semi").select("chain", "theme").distinct()
    return candidates.join(covered, ["chain", "theme"], "left_anti")


def covering_segments(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """(candidate, first existing name that covers it). Each name's first position, then each atom's first name, are
    found before candidates meet them, so an atom of many names meets as one row."""
    names = segments.groupBy("name").agg(F.min("position").alias("position"))
    known = names.select("name", "position", F.explode(name_atoms(F.col("name"))).alias("atom"))
    first = known.groupBy("atom").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("position"))
    wanted = candidates.select("candidate", F.explode(name_atoms(F.col("candidate"))).alias("atom"))
    return wanted.join(first, "atom").groupBy("candidate").agg(F.min_by("name", "position").alias("covered_by"))


def without_stop_tags(candidates: DataFrame, chain_themes: DataFrame, key: str = "cand_key") -> DataFrame:
    """Drops market and style tags, retired tree names, and the names of existing trees."""
    words = F.explode(F.array(*[F.lit(w) for w in fixed.DRIFT_STOP_TAGS + fixed.LEGACY_CHAIN_NAMES]))
    listed = chain_themes.sparkSession.range(1).select(words.alias("name"))
    stops = listed.unionByName(chain_themes.select(F.col("theme").alias("name")))
    stops = stops.select(canonical_name(F.col("name")).alias(key)).distinct()
    return candidates.join(stops, key, "left_anti")


def without_peers(candidates: DataFrame, chain_themes: DataFrame, key: str = "cand_key") -> DataFrame:
    """Drops candidates whose name contains, or is part of, the name of a tree."""
    names = chain_themes.select(canonical_name(F.col("theme")).alias("peer")).where(F.length("peer") >= 2).distinct()
    keys = candidates.select(key).distinct().where(F.length(key) >= 2)
    inside = substring_join(keys, key, names, "peer", literal=True).select(key)
    around = substring_join(names, "peer", keys, key, literal=True)
    peers = inside.unionByName(around.select(key)).distinct()
    return candidates.join(peers, key, "left_anti")


def detect_drift(
    documents: DataFrame,
    doc_themes: DataFrame,
    nodes: DataFrame,
    today: dt.date,
    min_docs: int = fixed.DRIFT_MIN_DOCS,
    min_insts: int = fixed.DRIFT_MIN_INSTITUTIONS,
    min_lift: float = fixed.DRIFT_MIN_LIFT,
    recent_days: int = fixed.DRIFT_RECENT_DAYS,
) -> DataFrame:
    """Candidates of every tree at once: (chain, cand_key, name, counts, lift, dates)."""
    chain_themes = nodes.select("theme").distinct()
    matches = matching_themes(chain_themes, doc_themes)
    statistics = candidate_statistics(co_occurrence(matches, doc_themes), documents).where(
        (F.col("docs") >= min_docs) & (F.col("insts") >= min_insts)
    )
    cutoff = recency_cutoff(documents, today, recent_days)
    # Without a cut-off there is nothing to compare with, and all candidates stay.
    recent = statistics.where(cutoff.isNull() | (F.col("last_seen") >= cutoff))
    lifted = theme_lift(recent, documents, doc_themes, matches).where(F.col("lift") >= min_lift)
    # A few rows per tree from here on; written out so that the name checks below,
    # which read them several times, do not repeat the joins above.
    keyed = checkpointed(lifted.withColumn("cand_key", canonical_name(F.col("theme"))))
    kept = without_peers(without_stop_tags(keyed, chain_themes), chain_themes)
    segments = nodes.where(F.col("node_type") == "segment").select(F.col("theme").alias("chain"), "name")
    return uncovered(kept, segments).select(
        "chain", "cand_key", F.col("theme").alias("name"), F.col("docs").alias("doc_count"),
        F.col("insts").alias("inst_count"), F.round("lift", 2).alias("lift"), "first_seen", "last_seen",
    )


def sample_documents(
    names: DataFrame, doc_themes: DataFrame, documents: DataFrame, limit: int = fixed.DRIFT_SAMPLES
) -> DataFrame:
    """Newest documents per candidate name."""
    tagged = doc_themes.join(names.select(F.col("name").alias("theme")).distinct(), "theme", "left_semi")
    dated = tagged.join(documents.select("doc_id", "title", "institution", "report_date"), "doc_id")
    window = Window.partitionBy("theme").orderBy(F.desc_nulls_last("report_date"), "doc_id")
    return dated.withColumn("place", F.row_number().over(window)).where(F.col("place") <= limit)


def pair_shares(pairs: DataFrame, doc_themes: DataFrame) -> DataFrame:
    """Share of a theme's documents that also carry the other theme."""
    totals = doc_themes.groupBy("theme").agg(F.count("*").alias("total"))
    counts = pairs.groupBy("chain", "theme").agg(F.count("*").alias("docs"))
    return counts.join(totals, "theme").withColumn("pct", percentage(F.col("docs"), F.col("total")))
