"""Secret scan with a trigram inverted index.

Each rule is a regex. From its parse tree a Boolean trigram query is derived: literal stretches, alternatives expanded,
must be present (AND of clauses, each an OR of trigram sets). The index holds, for the trigrams of all queries, which
documents contain them, in lower case. Postings are intersected by counting, candidates are verified on the whole text.
Rules without a mandatory trigram scan every text. Candidates are counted: up to `BROADCAST_CANDIDATES` they are broadcast
and no text moves; beyond, texts are merged with them by doc_id.

Spans are code points, end exclusive, leftmost and non-overlapping for each rule; a match that fails its rule's length is
dropped. Splitting a text by a rule and extracting its matches gives the stretches whose lengths add up to positions.

Defined results: null and empty texts have no spans. Rows without doc_id are verified by every rule. Repeated rows are
scanned each; rows that share a doc_id share their candidate rules, which costs time only.
"""

from __future__ import annotations

import re._parser as regex_tree
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, let, slim, whole_text

BROADCAST_CANDIDATES = 100_000
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """`group` is measured against `least` characters; 0 is the whole match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base rules, in the order in which spans of one start are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
MORE = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{30,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", r"[a-z][a-z0-9+.-]{1,20}://[^/\s:@]{1,100}:[^/\s:@]{1,100}@"),
)
RULES = BASE + MORE


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses that all must hold; a clause holds when all trigrams of one of its sets are present. Empty: no demand."""
    clauses: list[list[frozenset[str]]] = []

    def close(strings: list[str]) -> None:
        sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
        if sets and all(sets):
            clauses.append(sorted((s for s in sets if not any(other < s for other in sets)), key=sorted))

    def walk(items, strings: list[str]) -> list[str]:
        """Extends the literal strings that end here; closes them where the text is open. Empty strings: nothing known."""
        for kind, value in items:
            choices = exact(kind, value)
            if choices is not None and len(strings) * len(choices) <= MAX_ALTERNATIVES:
                strings = [s + c for s in strings for c in choices]
                continue
            close(strings)
            strings = [""]
            if kind is regex_tree.SUBPATTERN:
                strings = walk(value[3], [""])
            elif kind in (regex_tree.MAX_REPEAT, regex_tree.POSSESSIVE_REPEAT) and value[0] >= 1:
                close(walk(value[2], [""]))
        return strings

    def exact(kind, value) -> list[str] | None:
        """All strings an item can match, lower-cased, where they are few."""
        if kind is regex_tree.LITERAL:
            return [chr(value).lower()]
        if kind is regex_tree.IN and all(k is regex_tree.LITERAL for k, _ in value):
            return sorted({chr(v).lower() for _, v in value})
        if kind is regex_tree.SUBPATTERN:
            return sequence(value[3])
        if kind is regex_tree.BRANCH:
            parts = [sequence(branch) for branch in value[1]]
            return None if None in parts else sorted({s for part in parts for s in part})
        if kind is regex_tree.MAX_REPEAT and value[1] == 1:
            once = sequence(value[2])
            return None if once is None else [""] * (value[0] == 0) + once
        return None

    def sequence(items) -> list[str] | None:
        strings = [""]
        for kind, value in items:
            choices = exact(kind, value)
            if choices is None or len(strings) * len(choices) > MAX_ALTERNATIVES:
                return None
            strings = [s + c for s in strings for c in choices]
        return strings

    close(walk(regex_tree.parse(pattern), [""]))
    return clauses


def trigram_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules ask for."""
    wanted = sorted({gram for rule in rules for clause in trigram_query(rule.pattern) for grams in clause for gram in grams})
    lowered = docs.where("doc_id IS NOT NULL").select("doc_id", F.lower(whole_text()).alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(gram)), F.lit(gram)) for gram in wanted]))
    return lowered.select("doc_id", F.explode(present).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the kinds of the rules whose query holds in the index."""
    wanted = [
        (rule.kind, c, a, gram, len(grams), len(clauses))
        for rule in rules for clauses in [trigram_query(rule.pattern)]
        for c, clause in enumerate(clauses) for a, grams in enumerate(clause) for gram in sorted(grams)]
    # As many rows as the rules have trigrams.
    query = index.sparkSession.createDataFrame(wanted, "kind string, clause int, choice int, trigram string, needed int, clauses int")
    met = index.distinct().join(F.broadcast(query), "trigram").groupBy("doc_id", "kind", "clause", "choice").agg(
        F.count("*").alias("n"), F.first("needed").alias("needed"), F.first("clauses").alias("clauses")).where("n = needed")
    held = met.groupBy("doc_id", "kind").agg(F.countDistinct("clause").alias("n"), F.first("clauses").alias("clauses")).where("n = clauses")
    return held.groupBy("doc_id").agg(F.collect_set("kind").alias("__kinds"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches."""
    shape = "array<struct<start:int,kind:int,end:int>>"
    pattern = F.lit(rule.pattern)

    def located(found: Column) -> Column:
        sizes = F.transform(found, lambda match: F.length(match))
        asked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda part: F.length(part)) if rule.group else sizes
        gaps = F.slice(F.transform(F.split(text, rule.pattern, -1), lambda part: F.length(part)), F.lit(1), F.size(found))
        steps = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), asked.alias("asked"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(shape).alias("spans"))

        def step(state: Column, row: Column) -> Column:
            start = state["at"] + row["gap"]
            span = F.struct(start.alias("start"), F.lit(order).alias("kind"), (start + row["size"]).alias("end"))
            return F.struct((start + row["size"]).alias("at"), F.when(
                row["asked"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

        return F.aggregate(steps, begin, step, lambda state: state["spans"])

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: F.when(
        F.size(found) == 0, F.array().cast(shape)).otherwise(located(found)))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `secrets`, the array of (start, kind, end) of all spans by start, then rule; kind is the rule's index."""
    open_kinds = {rule.kind for rule in rules if not trigram_query(rule.pattern)}
    # A fixed index table is one row per candidate document: counted before it is shared.
    found = kept(candidates(trigram_index(slim(docs, "doc_id", "text"), rules), rules)).withColumnRenamed("doc_id", "__doc_id")
    few = found.count() <= BROADCAST_CANDIDATES
    marked = docs.join(F.broadcast(found) if few else found.hint("merge"), F.col("doc_id") == F.col("__doc_id"), "left")
    parts = []
    for order, rule in enumerate(rules):
        spans = spans_of(whole_text(), rule, order)
        asked = F.coalesce(F.array_contains("__kinds", rule.kind), F.col("doc_id").isNull())
        parts.append(spans if rule.kind in open_kinds else F.when(asked, spans).otherwise(F.array().cast(
            "array<struct<start:int,kind:int,end:int>>")))
    return marked.withColumn("secrets", F.array_sort(F.concat(*parts))).drop("__doc_id", "__kinds")


def described(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda span: F.concat_ws(
        ":", F.get(kinds, span["kind"]), span["start"].cast("string"), span["end"].cast("string"))), ",")
