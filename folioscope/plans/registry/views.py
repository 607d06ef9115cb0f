"""SQL forms of the table adapters, for the checks."""

from ...functions import fixed


def listed(words: list[str]) -> str:
    return "(" + ", ".join(quoted(word) for word in words) + ")"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def repaired(text: str) -> str:
    """Listed misspellings with their f doubled; applied twice, since neighbours share a separator."""
    endings: dict[str, list[str]] = {}
    for wrong in fixed.LIGATURE_FIXES:
        head, tail = wrong.split("f")
        endings.setdefault(head, []).append(tail)
    for head, tails in endings.items():
        first = f"[{head[0]}{head[0].upper()}]{head[1:]}"
        tails = "|".join(sorted(tails, key=len, reverse=True))
        pattern = f"(^|[^\\p{{L}}\\p{{N}}_])({first})f({tails})($|[^\\p{{L}}\\p{{N}}_])"
        for _ in range(2):
            text = f"regexp_replace({text}, '{pattern}', '\\1\\2ff\\3\\4', 'g')"
    return text


REPORTS = """
reports AS (
  SELECT o_orderkey AS doc_id, 'order ' || o_orderkey AS title, n_name AS institution,
         CASE WHEN n_regionkey % 2 = 0 THEN 'zh' ELSE 'en' END AS lang,
         CAST(o_orderdate AS DATE) AS report_date
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
)"""

TAGS = """
tags AS (
  SELECT DISTINCT l_orderkey AS doc_id, p_brand AS theme FROM lineitem JOIN part ON p_partkey = l_partkey
  UNION
  SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON p_partkey = l_partkey
)"""


def facts(entity: str) -> str:
    return f"""
lines AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN '万元' WHEN 'N' THEN '百万元' ELSE '亿元' END AS price_unit,
         (l_orderkey + l_linenumber) % 7 = 0 AS odd, {entity} AS entity
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
),
facts AS (
  SELECT l_orderkey || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-'
           || lpad(CAST(l_partkey AS VARCHAR), 10, '0') || '-' || n AS fact_id,
         l_orderkey AS doc_id, CAST(o_orderdate AS DATE) AS report_date,
         strftime(o_orderdate, '%Y-%m-%d') AS report_text, entity, metric, value_num, value_text, unit,
         CASE WHEN l_linestatus = 'O' THEN 'up' ELSE 'down' END AS direction,
         strftime(l_shipdate, '%Y-%m') AS as_of_date
  FROM (
    SELECT *, 1 AS n, '目标价' AS metric, l_extendedprice AS value_num,
           CASE WHEN odd THEN '0.0013' ELSE CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) END AS value_text,
           price_unit AS unit FROM lines
    UNION ALL
    SELECT *, 2, '营收', CASE WHEN odd THEN NULL ELSE l_quantity END,
           CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '台' FROM lines
    UNION ALL
    SELECT *, 3, '折扣率', l_discount * 100, CAST(CAST(round(l_discount * 100) AS INTEGER) AS VARCHAR) || '%', '%' FROM lines
  )
)"""


COMPANY = "CASE p_brand WHEN 'Brand#1' THEN 'TSMC' WHEN 'Brand#2' THEN '台积电' ELSE p_brand END"

UNITS = "units(unit, multiple, norm_unit) AS (VALUES " + ", ".join(
    f"({quoted(unit)}, {multiple!r}::DOUBLE, {quoted(family)})"
    for family, table in fixed.AMOUNT_UNITS.items()
    for unit, multiple in table.items()
) + ")"

TREES = """
counted AS (SELECT p_brand, p_type, p_name, count(*) AS n FROM part GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY n DESC, p_name) AS place FROM counted),
picked AS (SELECT * FROM placed),
slugged AS (
  SELECT *, regexp_replace(p_brand, '[^A-Za-z0-9_]+', '-', 'g') AS theme_slug,
         dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS group_no,
         regexp_replace(p_name, '[^A-Za-z0-9_]+', '-', 'g') AS name_slug
  FROM picked
)"""

DOCS = """
docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, string_split(text, chr(10))[1] AS title, source AS institution,
         CASE WHEN lang = 'en' THEN 'foreign' ELSE 'domestic' END AS category, lang,
         DATE '2024-01-01' + CAST(doc_id % 366 AS INTEGER) AS report_date, n_chars AS char_count
  FROM documents
)"""

# Blank lines go, long documents become overlapping windows, a short last window joins the one before.
CHUNKS = f"""
cleaned AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id,
         array_to_string(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''), chr(10))
           || CASE WHEN ends_with(text, chr(10)) THEN chr(10) ELSE '' END AS body
  FROM documents
),
kept AS (SELECT doc_id, {repaired('body')} AS body FROM cleaned),
pieces AS (
  SELECT doc_id, body, 0 AS piece, body AS text, 1 AS n FROM kept
  WHERE trim(body) <> '' AND greatest(1, CAST(floor(length(body) / 1.6::DOUBLE) AS INTEGER)) <= 1400
  UNION ALL
  SELECT doc_id, body, CAST(s // 1408 AS INTEGER), substr(body, CAST(s AS INTEGER) + 1, 1600),
         CAST((length(body) - 1) // 1408 + 1 AS INTEGER)
  FROM kept, generate_series(0, length(body) - 1, 1408) AS g(s)
  WHERE CAST(floor(length(body) / 1.6::DOUBLE) AS INTEGER) > 1400
),
offsets AS (
  SELECT *, greatest(1, CAST(floor(length(text) / 1.6::DOUBLE) AS INTEGER)) AS token_est,
         coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM pieces
),
joined AS (
  SELECT *, lead(text) OVER w AS next_text, lead(token_est) OVER w AS next_est, lag(token_est) OVER w AS last_est,
         lead(piece) OVER w = n - 1 AS before_last
  FROM offsets WINDOW w AS (PARTITION BY doc_id ORDER BY piece)
),
chunks AS (
  SELECT doc_id || '#' || piece AS chunk_id, doc_id, piece AS seq, CAST(char_start AS BIGINT) AS char_start,
         CASE WHEN before_last AND next_est < 50 AND token_est + next_est <= 1400
              THEN rtrim(text, ' ' || chr(10)) || chr(10) || next_text ELSE text END AS text,
         CAST(char_start + length(text) + CASE WHEN before_last AND next_est < 50 AND token_est + next_est <= 1400
              THEN length(next_text) ELSE 0 END AS BIGINT) AS char_end
  FROM joined
  WHERE NOT (n > 1 AND piece = n - 1 AND token_est < 50 AND last_est + token_est <= 1400)
)"""

TOKEN = "[一-鿿㐀-䶿]|[\\pL\\pN]+"
RAW_TOKEN = "[一-鿿㐀-䶿]|[\\pL\\pN_]+"

POSTINGS = f"""
tokens AS (
  SELECT chunk_id, doc_id, list_transform(regexp_extract_all(strip_accents(text), '{TOKEN}'), lambda t: lower(t)) AS toks FROM chunks
),
lengths AS (SELECT chunk_id, len(toks) AS dl FROM tokens),
postings AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS term FROM tokens) GROUP BY ALL
),
corpus AS (SELECT count(*) AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM lengths),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
qterms AS (
  SELECT query_id, term, count(*) AS weight FROM (
    SELECT query_id, unnest(regexp_extract_all(lower(strip_accents(token)), '{TOKEN}')) AS term FROM (
      SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(list_distinct(regexp_extract_all(text, '{RAW_TOKEN}'))) AS token
      FROM benchmark)) GROUP BY ALL
),
weighted AS (
  SELECT query_id, q.term,
         weight * CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE
                       ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END AS idf
  FROM qterms q JOIN dfs USING (term), corpus
),
scored AS (
  SELECT query_id, p.chunk_id,
         round(sum(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM postings p JOIN weighted USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id, corpus
  GROUP BY query_id, p.chunk_id
)"""

LEXICAL = """
lexical AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank
    FROM scored) WHERE rank < {limit}
)"""

DENSE = """
dense AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, distance,
           row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank
    FROM (
      SELECT CAST(q.vec_id AS VARCHAR) AS query_id, v.vec_id || '#0' AS chunk_id,
             round(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS distance
      FROM embeddings v, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark)
    )) WHERE rank < 40
)"""

FUSED = """
fused AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM (
      SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.chunk_id, d.chunk_id) AS chunk_id,
             l.rank AS bm25_rank, d.rank AS dense_rank,
             round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 9) AS score
      FROM lexical l FULL JOIN dense d ON l.query_id = d.query_id AND l.chunk_id = d.chunk_id
    )) WHERE rank < {limit}
)"""


def markdown() -> str:
    promo = quoted(fixed.PROMO_PHRASES[3])
    newline = "chr(10)"
    return f"""
marked AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE (i - 1) % 9
      WHEN 0 THEN '# ' || substr(l, 1, 20) || {newline} || l
      WHEN 3 THEN '## ' || substr(l, 1, 15) || {newline} || 'n point: efect of diferent ofers' || {newline} || l
      WHEN 5 THEN 'Exhibit ' || (i - 1) || ' efect' || {newline} || '![](images/' || (i - 1) || '.jpg)' || {newline} || l
      WHEN 7 THEN {promo} || {newline} || '![](images/code.jpg)' || {newline} || {newline} || l
      ELSE l END), {newline}) AS text
  FROM documents
)"""
