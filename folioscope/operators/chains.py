"""Two-level topic trees: building, comparing, counting evidence, viewing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.like import substring_join
from ..functions.segments import canonical_name
from ..functions.text import is_foreign, slug, strip
from .layout import spread
from .inverted import Index, phrase_documents, shared
from .search import keyword_phrases
from .themes import percentage

TICKERS_TYPE = "array<struct<name:string,code:string,role:string>>"


def merged_keywords(name: Column, keywords: Column) -> Column:
    """The segment's name and its keywords, trimmed, first spelling of each kept."""
    trimmed = F.transform(F.concat(F.array(name), F.coalesce(keywords, F.array().cast("array<string>"))), strip)
    filled = F.filter(trimmed, lambda word: word.isNotNull() & (word != ""))
    folded = F.transform(filled, lambda word: F.lower(word))
    kept = F.zip_with(
        filled,
        F.transform(folded, lambda word, index: F.array_position(folded, word) == index + 1),
        lambda word, first: F.when(first, word),
    )
    return F.array_compact(kept)


def chain_rows(trees: DataFrame, built_by: str = "model") -> DataFrame:
    """Tree rows out of (theme, groups ARRAY<STRUCT<name, stage, summary, segments>>)."""
    groups = (
        trees.select("theme", F.posexplode("groups").alias("seq", "group"))
        .withColumn("name", strip(F.col("group.name")))
        .where(F.col("name") != "")
        .withColumn("node_id", F.concat_ws("|", slug(F.col("theme")), F.col("seq").cast("string"), slug(F.col("name"))))
    )
    group_rows = groups.select(
        "node_id", "theme", F.lit("group").alias("node_type"), F.lit(None).cast("string").alias("parent_id"),
        "seq", "name", F.nullif(F.col("group.stage"), F.lit("")).alias("stage"),
        F.nullif(F.col("group.summary"), F.lit("")).alias("summary"),
        F.lit(None).cast(TICKERS_TYPE).alias("tickers"), F.lit(None).cast("array<string>").alias("keywords"),
    )
    segments = groups.select(
        "theme", F.col("node_id").alias("parent_id"), F.col("group.stage").alias("stage"),
        F.posexplode("group.segments").alias("seq", "segment"),
    ).withColumn("name", strip(F.col("segment.name"))).where(F.col("name") != "")
    segment_rows = segments.select(
        F.concat_ws("|", "parent_id", F.col("seq").cast("string"), slug(F.col("name"))).alias("node_id"),
        "theme", F.lit("segment").alias("node_type"), "parent_id", "seq", "name",
        F.nullif("stage", F.lit("")).alias("stage"), F.nullif(F.col("segment.summary"), F.lit("")).alias("summary"),
        F.coalesce(F.col("segment.tickers"), F.array().cast(TICKERS_TYPE)).alias("tickers"),
        merged_keywords(F.col("name"), F.col("segment.keywords")).alias("keywords"),
    )
    return group_rows.unionByName(segment_rows).withColumn("built_by", F.lit(built_by))


def replace_chains(current: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """New snapshot: a rebuilt tree replaces the old one only if it has a segment."""
    usable = rebuilt.where(F.col("node_type") == "segment").select("theme").distinct()
    return current.join(usable, "theme", "left_anti").unionByName(rebuilt.join(usable, "theme", "left_semi"))


def chain_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(theme, change, seg_key, name) with change added / removed / kept."""

    def keyed(nodes: DataFrame, side: str) -> DataFrame:
        segments = nodes.where(F.col("node_type") == "segment").withColumn("seg_key", canonical_name(F.col("name")))
        last = F.max_by("name", F.struct("parent_id", "seq"))
        return segments.groupBy("theme", "seg_key").agg(last.alias(side))

    both = keyed(old, "old_name").join(keyed(new, "new_name"), ["theme", "seg_key"], "full_outer")
    change = F.when(F.col("old_name").isNull(), "added").when(F.col("new_name").isNull(), "removed").otherwise("kept")
    return both.select("theme", "seg_key", change.alias("change"), F.coalesce("new_name", "old_name").alias("name"))


def segment_keywords(nodes: DataFrame) -> DataFrame:
    """(theme, node_id, keyword): all keywords of each segment."""
    segments = nodes.where(F.col("node_type") == "segment")
    filled = F.filter("keywords", lambda word: word.isNotNull() & (strip(word) != ""))
    return segments.select(
        "theme", "node_id", F.explode(filled).alias("keyword")
    )


def segment_documents(
    nodes: DataFrame, index: Index, documents: DataFrame, doc_themes: DataFrame
) -> DataFrame:
    """Distinct (node_id, theme, doc_id): full text, title and theme evidence of all segments.

    Each distinct keyword is searched once, however many segments share it; the phrase
    search counts words, the title and theme searches count substrings.
    """
    keywords = segment_keywords(nodes)
    distinct_words = keywords.select("keyword").distinct()
    phrases = keyword_phrases(distinct_words)
    by_text = phrase_documents(index, phrases).join(phrases.select("keyword", "phrase"), "phrase").select("keyword", "doc_id")
    titles = spread(documents.select("doc_id", "title"))
    by_title = substring_join(titles, "title", distinct_words, "keyword").select("keyword", "doc_id")
    names = substring_join(
        doc_themes.select(F.col("theme").alias("tag")).distinct(), "tag", distinct_words, "keyword"
    )
    by_theme = doc_themes.withColumnRenamed("theme", "tag").join(names, "tag").select("keyword", "doc_id")
    # Hits move once, to their document, where repeats go and where later counts and joins by document find the evidence.
    hits = by_text.unionByName(by_title).unionByName(by_theme).repartition("doc_id").distinct()
    return hits.join(shared(keywords), "keyword").select("theme", "node_id", "doc_id").distinct()


def segment_split(nodes: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Domestic and foreign documents per segment; segments without evidence count zero."""
    known = evidence.join(documents.select("doc_id", "lang"), "doc_id")
    counts = known.groupBy("node_id").agg(
        F.count("*").alias("total"), F.count_if(is_foreign(F.col("lang"))).alias("foreign")
    )
    segments = nodes.where(F.col("node_type") == "segment").select("theme", "parent_id", "node_id", "seq", "name")
    filled = segments.join(counts, "node_id", "left").fillna(0, ["total", "foreign"])
    filled = filled.withColumn("domestic", F.col("total") - F.col("foreign"))
    return filled.withColumn("domestic_pct", percentage(F.col("domestic"), F.col("total"))).withColumn(
        "foreign_pct", percentage(F.col("foreign"), F.col("total"))
    )


def chain_view(nodes: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per group with its ordered segments; a group holds tens of segments at most."""
    segments = splits.groupBy("parent_id").agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "node_id", "name", "domestic", "foreign", "total", "domestic_pct"))
        ).alias("segments")
    )
    groups = nodes.where(F.col("node_type") == "group").select(
        "theme", F.col("node_id").alias("parent_id"), F.col("seq").alias("group_seq"),
        F.col("name").alias("group_name"), "stage", "summary",
    )
    return groups.join(segments, "parent_id", "left")


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("theme", F.col("parent_id").isNotNull(), "parent_id", "seq", "node_id")


def id_fingerprint(doc_id: str = "doc_id") -> Column:
    """Order-free fingerprint of a set of distinct ids, 16 hex digits.

    Two xor folds over each id's digest combine in any order and on any task, so a theme
    that covers a third of the collection never has its ids gathered in one place. Only
    equality of fingerprints carries meaning.
    """
    digest = F.sha2(F.col(doc_id).cast("string"), 256)

    def fold(start: int) -> Column:
        return F.bit_xor(F.conv(F.substring(digest, start, 15), 16, 10).cast("bigint")).cast("string")

    return F.substring(F.sha2(F.concat_ws("|", F.count("*").cast("string"), fold(1), fold(16)), 256), 1, 16)


def evidence_signature(evidence: DataFrame) -> DataFrame:
    """Per theme: number of evidence documents and the fingerprint of their ids."""
    ids = evidence.select("theme", "doc_id").distinct()
    return ids.groupBy("theme").agg(F.count("*").alias("docs"), id_fingerprint().alias("evidence_hash"))


def structure_hash(nodes: DataFrame) -> DataFrame:
    """Per theme, a hash over group names, stages and segment names in order."""
    segments = nodes.where(F.col("node_type") == "segment").groupBy("parent_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("segments")
    )
    groups = nodes.where(F.col("node_type") == "group").select(
        "theme", F.col("node_id").alias("parent_id"), "seq", "name", "stage"
    )
    rows = groups.join(segments, "parent_id", "left").groupBy("theme").agg(
        F.array_sort(F.collect_list(F.struct("seq", "name", "stage", "segments"))).alias("tree")
    )
    return rows.select("theme", F.substring(F.sha2(F.to_json("tree"), 256), 1, 16).alias("structure_hash"))
