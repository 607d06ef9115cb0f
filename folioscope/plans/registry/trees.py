"""Topic trees and drift over the order and text tables."""

import datetime as dt

from pyspark.sql import functions as F

from ...functions import fixed
from ...functions.segments import canonical_name, name_atoms, synonym_index
from ...operators import chains, drift, themes
from ...plans import material
from ...sources import tables as t
from . import REGISTRY
from .views import CHUNKS, DOCS, REPORTS, TAGS, TOKEN, TREES, quoted

TODAY = dt.date(2001, 6, 30)
MIN_LIFT = 1.0
RECENT_DAYS = 60


def _brand_nodes(spark, sf):
    return t.derived(spark, sf, "brand-trees", ["part"], lambda: chains.chain_rows(t.brand_trees(spark, sf)))


SEGMENT_NODES = f"""{TREES}, segment_nodes AS (
  SELECT theme_slug || '|' || group_no || '|' || p_type || '|' || (place - 1) || '|' || name_slug AS node_id, p_brand AS theme,
         theme_slug || '|' || group_no || '|' || p_type AS parent_id, place - 1 AS seq, p_name AS name, n
  FROM slugged
), group_nodes AS (
  SELECT DISTINCT theme_slug || '|' || group_no || '|' || p_type AS node_id, p_brand AS theme, group_no AS seq, p_type AS name FROM slugged
)"""


@REGISTRY.add(
    "chain_nodes",
    f"""WITH {SEGMENT_NODES}
SELECT node_id, theme, 'segment' AS node_type, parent_id, CAST(seq AS BIGINT) AS seq, name, '中游' AS stage, 'parts ' || n AS summary,
       name || '|' || replace(name, ' ', '|') AS keywords, name AS ticker FROM segment_nodes
UNION ALL
SELECT node_id, theme, 'group', NULL, CAST(seq AS BIGINT), name, '中游', NULL, NULL, NULL FROM group_nodes""",
)
def chain_nodes(spark, sf):
    return _brand_nodes(spark, sf).select(
        "node_id", "theme", "node_type", "parent_id", F.col("seq").cast("bigint").alias("seq"), "name", "stage", "summary",
        F.array_join("keywords", "|").alias("keywords"), F.try_element_at("tickers", F.lit(1))["name"].alias("ticker"),
    )


@REGISTRY.add("chain_theme_list", "SELECT DISTINCT p_brand AS theme FROM part ORDER BY theme")
def chain_theme_list(spark, sf):
    return themes.chain_themes(_brand_nodes(spark, sf))


@REGISTRY.add(
    "chain_diff",
    f"""WITH {SEGMENT_NODES}, old AS (SELECT DISTINCT theme, replace(name, ' ', '') AS seg_key, name FROM segment_nodes WHERE seq < 2),
new AS (SELECT DISTINCT theme, replace(name, ' ', '') AS seg_key, name FROM segment_nodes WHERE seq > 0)
SELECT theme, seg_key, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'kept' END AS change,
       coalesce(n.name, o.name) AS name
FROM old o FULL JOIN new n USING (theme, seg_key)""",
)
def chain_diff(spark, sf):
    """Yesterday's tree held the first two names of each group, today's the last two."""
    nodes = _brand_nodes(spark, sf)
    group = F.col("node_type") == "group"
    return chains.chain_diff(nodes.where(group | (F.col("seq") < 2)), nodes.where(group | (F.col("seq") > 0)))


@REGISTRY.add(
    "chain_replace",
    f"""WITH {SEGMENT_NODES}
SELECT theme, 'segment' AS node_type, count(*) AS nodes, CASE WHEN ends_with(theme, '5') THEN 'model' ELSE 'rebuilt' END AS built_by
FROM segment_nodes GROUP BY theme
UNION ALL
SELECT theme, 'group', count(*), CASE WHEN ends_with(theme, '5') THEN 'model' ELSE 'rebuilt' END FROM group_nodes GROUP BY theme""",
)
def chain_replace(spark, sf):
    """A rebuild that produced no segment for some trees leaves those trees as they were."""
    current = _brand_nodes(spark, sf)
    empty = F.col("theme").endswith("5") & (F.col("node_type") == "segment")
    rebuilt = current.where(~empty).withColumn("built_by", F.lit("rebuilt"))
    return chains.replace_chains(current, rebuilt).groupBy("theme", "node_type", "built_by").agg(F.count("*").alias("nodes"))


TEXT_TAGS = """text_tags AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, source AS theme FROM documents
  UNION SELECT CAST(doc_id AS VARCHAR), 'quality ' || quality FROM labels
  UNION SELECT CAST(doc_id AS VARCHAR), 'toxic ' || toxic FROM labels
)"""

# Keywords are the word pairs of each benchmark passage.
KEYWORDS = f"""passages AS (
  SELECT item_id, 'tree ' || item_id % 5 AS theme, 'tree-' || item_id % 5 || '|' || item_id % 4 AS parent_id,
         'tree-' || item_id % 5 || '|' || item_id % 4 || '|' || item_id AS node_id,
         list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda x: lower(x)) AS toks FROM benchmark
), keywords AS (
  SELECT theme, node_id, unnest(list_transform(range(1, len(toks) + 1), lambda i:
    CASE WHEN i < len(toks) THEN toks[i] || ' ' || toks[i + 1] ELSE toks[i] END)) AS keyword FROM passages
), phrases AS (
  SELECT DISTINCT keyword, CASE WHEN split_part(keyword, ' ', 1) = split_part(keyword, ' ', 2) THEN split_part(keyword, ' ', 1) ELSE keyword END AS phrase
  FROM keywords
), folded AS (
  SELECT doc_id, ' ' || array_to_string(list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda x: lower(x)), ' ') || ' ' AS toks FROM chunks
), by_text AS (
  SELECT DISTINCT keyword, doc_id FROM phrases JOIN folded ON contains(toks, ' ' || phrase || ' ')
), by_title AS (SELECT keyword, doc_id FROM (SELECT DISTINCT keyword FROM keywords) JOIN docs ON contains(lower(title), keyword)),
by_theme AS (SELECT keyword, doc_id FROM (SELECT DISTINCT keyword FROM keywords) JOIN text_tags ON contains(lower(theme), keyword)),
evidence AS (
  SELECT DISTINCT theme, node_id, doc_id FROM keywords JOIN (FROM by_text UNION FROM by_title UNION FROM by_theme) USING (keyword)
)"""


def _evidence(spark, sf):
    documents = t.text_documents(spark, sf)
    nodes = t.query_trees(spark, sf)
    evidence = chains.segment_documents(nodes, t.text_postings(spark, sf), documents, t.text_themes(spark, sf))
    return nodes, documents, evidence


@REGISTRY.add(
    "segment_split",
    f"""WITH {DOCS}, {CHUNKS}, {TEXT_TAGS}, {KEYWORDS}, counts AS (
  SELECT node_id, count(*) AS total, count(*) FILTER (lang = 'en') AS "foreign" FROM evidence JOIN docs USING (doc_id) GROUP BY node_id)
SELECT p.theme, p.node_id, coalesce(total, 0) AS total, coalesce("foreign", 0) AS "foreign", coalesce(total - "foreign", 0) AS domestic,
       coalesce(round_even((total - "foreign") / total::DOUBLE * 100, 1), 0) AS domestic_pct,
       coalesce(round_even("foreign" / total::DOUBLE * 100, 1), 0) AS foreign_pct
FROM passages p LEFT JOIN counts USING (node_id)""",
)
def segment_split(spark, sf):
    nodes, documents, evidence = _evidence(spark, sf)
    return chains.segment_split(nodes, evidence, documents).drop("parent_id", "seq", "name")


@REGISTRY.add(
    "evidence_signature",
    f"""WITH {DOCS}, {CHUNKS}, {TEXT_TAGS}, {KEYWORDS}, ids AS (SELECT DISTINCT theme, doc_id FROM evidence),
folds AS (SELECT theme, count(*) AS docs, bit_xor(CAST('0x' || substr(sha256(doc_id), 1, 15) AS BIGINT)) AS a,
          bit_xor(CAST('0x' || substr(sha256(doc_id), 16, 15) AS BIGINT)) AS b FROM ids GROUP BY theme)
SELECT theme, docs, substr(sha256(docs || '|' || a || '|' || b), 1, 16) AS evidence_hash FROM folds""",
)
def evidence_signature(spark, sf):
    _, _, evidence = _evidence(spark, sf)
    return chains.evidence_signature(evidence)


@REGISTRY.add("chain_view")
def chain_view(spark, sf):
    nodes, documents, evidence = _evidence(spark, sf)
    view = chains.chain_view(nodes, chains.segment_split(nodes, evidence, documents))
    return view.withColumn("segments", F.to_json("segments"))


@REGISTRY.add("tree_input_hash")
def tree_input_hash(spark, sf):
    nodes, _, evidence = _evidence(spark, sf)
    return material.tree_input_hash(nodes, chains.evidence_signature(evidence), "model")


@REGISTRY.add(
    "tree_lines",
    f"""WITH {SEGMENT_NODES}, grouped AS (
  SELECT theme, group_no, p_type, string_agg(p_name, '、' ORDER BY place) AS names FROM (SELECT p_brand AS theme, * FROM slugged) GROUP BY ALL)
SELECT theme, CAST(group_no AS BIGINT) AS seq, '- ' || p_type || '（中游）：' || names AS line FROM grouped""",
)
def tree_lines(spark, sf):
    return material.tree_lines(_brand_nodes(spark, sf)).withColumn("seq", F.col("seq").cast("bigint"))


BRANDS = "(SELECT DISTINCT p_brand AS chain FROM part)"
PAIRS = f"""pairs AS (
  SELECT DISTINCT chain, t2.theme, t2.doc_id FROM {BRANDS} JOIN tags t1 ON contains(lower(t1.theme), lower(chain))
  JOIN tags t2 ON t1.doc_id = t2.doc_id AND t2.theme <> t1.theme
), statistics AS (
  SELECT chain, theme, count(*) AS docs, count(DISTINCT institution) AS insts, min(report_date) AS first_seen, max(report_date) AS last_seen
  FROM pairs JOIN reports USING (doc_id) GROUP BY ALL
), lifted AS (
  SELECT *, (docs / (SELECT count(DISTINCT doc_id) FROM tags WHERE contains(lower(tags.theme), lower(chain)))::DOUBLE)
            / ((SELECT count(*) FROM tags g WHERE g.theme = statistics.theme)::DOUBLE / (SELECT count(*) FROM orders)) AS lift
  FROM statistics
)"""


def _co_occurring(spark, sf):
    nodes, tags = _brand_nodes(spark, sf), t.tag_table(spark, sf)
    matches = drift.matching_themes(nodes.select("theme").distinct(), tags)
    return tags, matches, drift.co_occurrence(matches, tags)


@REGISTRY.add("cooccurrence", f"WITH {REPORTS}, {TAGS}, {PAIRS} SELECT chain, theme, docs, insts, first_seen, last_seen FROM statistics")
def cooccurrence(spark, sf):
    _, _, pairs = _co_occurring(spark, sf)
    return drift.candidate_statistics(pairs, t.order_reports(spark, sf))


@REGISTRY.add("theme_lift", f"WITH {REPORTS}, {TAGS}, {PAIRS} SELECT chain, theme, docs, round(lift, 6) AS lift FROM lifted")
def theme_lift(spark, sf):
    tags, matches, pairs = _co_occurring(spark, sf)
    reports = t.order_reports(spark, sf)
    lifted = drift.theme_lift(drift.candidate_statistics(pairs, reports), reports, tags, matches)
    return lifted.select("chain", "theme", "docs", F.round("lift", 6).alias("lift"))


@REGISTRY.add(
    "pair_shares",
    f"""WITH {TAGS}, totals AS (SELECT theme, count(*) AS total FROM tags GROUP BY theme), counts AS (
  SELECT chain, t2.theme, count(DISTINCT t2.doc_id) AS docs FROM {BRANDS} JOIN tags t1 ON contains(lower(t1.theme), lower(chain))
  JOIN tags t2 ON t1.doc_id = t2.doc_id AND t2.theme <> t1.theme GROUP BY ALL)
SELECT chain, theme, docs, total, round_even(docs / total::DOUBLE * 100, 1) AS pct FROM counts JOIN totals USING (theme)""",
)
def pair_shares(spark, sf):
    tags, _, pairs = _co_occurring(spark, sf)
    return drift.pair_shares(pairs, tags)


# Part names are plain, so their folded form is the name without blanks.
DRIFT = f"""{SEGMENT_NODES}, {PAIRS}, kept AS (
  SELECT * FROM lifted
  WHERE docs >= 8 AND insts >= 3
    AND last_seen >= least((SELECT max(report_date) FROM reports), DATE '{TODAY}') - {RECENT_DAYS} AND lift >= {MIN_LIFT}
    AND theme NOT LIKE 'Brand#%'
    AND (chain, theme) NOT IN (SELECT theme, name FROM segment_nodes)
)"""


def _drifting(spark, sf):
    return drift.detect_drift(
        t.order_reports(spark, sf), t.tag_table(spark, sf), _brand_nodes(spark, sf), TODAY,
        min_lift=MIN_LIFT, recent_days=RECENT_DAYS,
    )


@REGISTRY.add(
    "detect_drift",
    f"""WITH {REPORTS}, {TAGS}, {DRIFT}
SELECT chain, replace(theme, ' ', '') AS cand_key, theme AS name, docs AS doc_count, insts AS inst_count, round(lift, 2) AS lift,
       first_seen, last_seen FROM kept""",
)
def detect_drift(spark, sf):
    return _drifting(spark, sf)


@REGISTRY.add(
    "drift_samples",
    f"""WITH {REPORTS}, {TAGS}, {DRIFT}
SELECT theme, CAST(place AS BIGINT) AS place, doc_id, title, institution, report_date FROM (
  SELECT *, row_number() OVER (PARTITION BY theme ORDER BY report_date DESC NULLS LAST, doc_id) AS place
  FROM tags JOIN reports USING (doc_id) WHERE theme IN (SELECT theme FROM kept)) WHERE place <= 5""",
)
def drift_samples(spark, sf):
    samples = drift.sample_documents(_drifting(spark, sf), t.tag_table(spark, sf), t.order_reports(spark, sf))
    return samples.withColumn("place", F.col("place").cast("bigint"))


@REGISTRY.add(
    "covers_overlap",
    """WITH existing AS (SELECT p_name || '/' || p_type AS name, p_partkey AS position,
                        [replace(p_name, ' ', ''), lower(p_type)] AS atoms FROM part),
candidates AS (SELECT DISTINCT p_name || '（' || p_brand || '）' AS candidate, [replace(p_name, ' ', ''), lower(p_brand)] AS atoms FROM part)
SELECT candidate, arg_min(name, position) AS covered_by FROM (SELECT name, position, unnest(atoms) AS atom FROM existing)
JOIN (SELECT candidate, unnest(atoms) AS atom FROM candidates) USING (atom) GROUP BY candidate""",
)
def covers_overlap(spark, sf):
    parts = t.table(spark, sf, "part")
    existing = parts.select(F.concat_ws("/", "p_name", "p_type").alias("name"), F.col("p_partkey").alias("position"))
    candidates = parts.select(F.concat("p_name", F.lit("（"), "p_brand", F.lit("）")).alias("candidate")).distinct()
    return drift.covering_segments(candidates, existing)


@REGISTRY.add(
    "peer_substring",
    """WITH names AS (SELECT DISTINCT replace(p_name, ' ', '') AS cand_key FROM part UNION SELECT DISTINCT lower(p_brand) FROM part
                     UNION SELECT DISTINCT lower(p_type) FROM part),
trees AS (SELECT DISTINCT lower(p_type) AS peer FROM part UNION SELECT DISTINCT lower(p_brand) FROM part WHERE p_brand LIKE '%2')
SELECT cand_key FROM names WHERE NOT EXISTS (SELECT 1 FROM trees WHERE contains(cand_key, peer) OR contains(peer, cand_key))""",
)
def peer_substring(spark, sf):
    """Names of parts, brands and types that neither hold nor are held by a tree's name."""
    parts = t.table(spark, sf, "part")
    brands = parts.select(F.col("p_brand").alias("theme"))
    kinds = parts.select(F.col("p_type").alias("theme"))
    names = parts.select(F.col("p_name").alias("theme")).unionByName(brands).unionByName(kinds).distinct()
    trees = kinds.unionByName(brands.where(F.col("theme").endswith("2"))).distinct()
    keyed = names.select(canonical_name(F.col("theme")).alias("cand_key")).distinct()
    return drift.without_peers(keyed, trees)


@REGISTRY.add(
    "stop_tags",
    f"""WITH words AS (SELECT unnest({fixed.DRIFT_STOP_TAGS + fixed.LEGACY_CHAIN_NAMES!r}) AS word),
names AS (SELECT p_partkey, CASE WHEN p_partkey % 41 < 40 AND p_partkey % 3 = 0
          THEN (SELECT list(word) FROM (SELECT unnest({fixed.DRIFT_STOP_TAGS + fixed.LEGACY_CHAIN_NAMES!r}) AS word))[p_partkey % 40 + 1]
          ELSE p_name END AS name FROM part)
SELECT name, count(*) AS parts FROM names WHERE name NOT IN (SELECT word FROM words) GROUP BY name""",
)
def stop_tags(spark, sf):
    """Part names, every third of them replaced by a stop tag, after the tags are dropped."""
    words = F.array(*[F.lit(word) for word in fixed.DRIFT_STOP_TAGS + fixed.LEGACY_CHAIN_NAMES])
    key = F.col("p_partkey")
    named = t.table(spark, sf, "part").select(
        F.when((key % 41 < 40) & (key % 3 == 0), F.element_at(words, (key % 40 + 1).cast("int"))).otherwise(F.col("p_name")).alias("name")
    ).withColumn("cand_key", canonical_name(F.col("name")))
    trees = t.table(spark, sf, "part").select(F.col("p_brand").alias("theme")).distinct()
    return drift.without_stop_tags(named, trees).groupBy("name").agg(F.count("*").alias("parts"))


SYNONYMS = "synonyms(form, canonical) AS (VALUES " + ", ".join(
    f"({quoted(form)}, {quoted(name)})" for form, name in synonym_index().items()
) + ")"
SPELLINGS = [spelling for spellings in fixed.SEGMENT_SYNONYMS.values() for spelling in spellings]


@REGISTRY.add(
    "segment_names",
    f"""WITH {SYNONYMS}, spelled AS (
  SELECT p_partkey, ({SPELLINGS!r})[p_partkey % {len(SPELLINGS)} + 1] AS spelling, p_name FROM part
), folded AS (
  SELECT p_partkey, upper(spelling) || ' 板块' AS raw, replace(regexp_replace(lower(spelling), '[\\s.\\-]', '', 'g'), '制造', '') AS form FROM spelled
)
SELECT raw, coalesce(canonical, form) AS canonical, count(*) AS parts FROM folded LEFT JOIN synonyms USING (form) GROUP BY ALL""",
)
def segment_names(spark, sf):
    """Upper-case spellings with a noise word, one per part, brought to their canonical name."""
    spellings = F.array(*[F.lit(spelling) for spelling in SPELLINGS])
    raw = F.concat(F.upper(F.element_at(spellings, (F.col("p_partkey") % len(SPELLINGS) + 1).cast("int"))), F.lit(" 板块"))
    named = t.table(spark, sf, "part").select(raw.alias("raw"))
    return named.groupBy("raw", canonical_name(F.col("raw")).alias("canonical")).agg(F.count("*").alias("parts"))


@REGISTRY.add(
    "segment_atoms",
    """SELECT p_partkey, p_name || '（' || p_brand || '/' || p_type || '）与' || p_name || '制造' AS raw,
       array_to_string(list_sort(list_distinct([lower(p_brand), lower(p_type), replace(p_name, ' ', '')])), '|') AS atoms FROM part""",
)
def segment_atoms(spark, sf):
    raw = F.concat("p_name", F.lit("（"), "p_brand", F.lit("/"), "p_type", F.lit("）与"), "p_name", F.lit("制造"))
    return t.table(spark, sf, "part").select(
        "p_partkey", raw.alias("raw"), F.array_join(F.array_sort(name_atoms(raw)), "|").alias("atoms")
    )
