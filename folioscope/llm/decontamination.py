"""Benchmark decontamination by canonical templates: finds copied and re-parameterised items.

A text becomes a template: words lower-cased, without punctuation; numbers, units after a number, and names turn into the
typed placeholders below, whose values are remembered as slots. Windows of `WINDOW` template words are hashed and joined
with those of the benchmark (an item of fewer words is one window of its own length). Hits of one document and item at
one distance form a run. A run counts when it has `MIN_WINDOWS` windows (13 words), or all windows of a shorter item, and
its slots are consistent: each value of the item stands for one value of the document throughout the run. Two values of
the item may become the same one, as changed numbers do by chance. A run keeps one distance, so a word put in or left
out splits it, and a half of fewer windows than needed does not count.

A name is a capitalised word, wherever it stands, that is not one of the words sentences open with (`OPENERS`); what stands
before it does not matter, so a copy reads like its item after any lead-in. The benchmark is read a second time in lower
case, without names, so that copies in lower case or in capitals are met too. A window with fewer than `MIN_LITERALS` words that are no placeholders
(or any placeholder, where it is shorter) says too little as a template: it is hashed by its words as written and fits
verbatim only, also where the copy's values changed. The benchmark's windows are counted first: up to `BROADCAST_WINDOWS`
they are broadcast and no text moves; beyond, slim window rows are joined by a shuffle, and only documents with a hit are
read for their slots.

Defined results: null or empty texts and items have no words and no hits. Repeated rows of one doc_id are one document.
Rows without doc_id are never reported. An item without literal words is never found. Several items, or one item at
several places, are reported once for each item. Without benchmark rows, or documents, there are no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, slim, whole_text, words_of

WINDOW = 8
MIN_WINDOWS = 6
MIN_LITERALS = 4
BROADCAST_WINDOWS = 200_000

# Fixed values.
NUMBER, UNIT, NAME = "#number", "#unit", "#name"
NUMBER_WORDS = (
    "two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion").split()
UNITS = (
    "mm cm dm m km mg g kg t ml l ms s sec min h hr kb mb gb tb hz khz mhz ghz w kw kwh v a mph kmh "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards "
    "gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "percent degree degrees dollar dollars euro euros cent cents usd eur gbp").split()


OPENERS = (
    "about above according add after all also although among an and another any are as ask assume at based be because before "
    "below besides between both but by calculate can choose circle compare complete compute consider could decide define "
    "describe determine did discuss do does draw during each either estimate evaluate every everyone examine explain express "
    "few fill find first five for four from give given has have he hence her here his how however if imagine in instead is it "
    "its just last let list look make many match may more most much my name neither next no none not note now of on once one "
    "only or other our out over per perhaps place please prove put read rearrange recall round second select several she "
    "should show simplify since so solve some soon start state still such suppose take ten than that the their them then "
    "there therefore these they third this those though three through thus to today together two under until up use using "
    "was we were what when where whether which while who whom whose why will with within without work would write yet you your"
).split()

_NAME_MARK = "\u0001"
# Openers in capitals at their first letter; a letter, digit or apostrophe before makes the place part of a word.
_NAME = f"(?<![\\p{{L}}\\p{{N}}'’])(?=\\p{{Lu}}\\p{{Ll}})(?!(?:{'|'.join(word.capitalize() for word in OPENERS)})(?!\\p{{L}}))"


def template_tokens(text: Column) -> Column:
    """Words of a text, lower-cased, without punctuation; names are marked, units stand apart from numbers.

    Done on the whole text, so that no regex runs for each word.
    """
    plain = F.replace(text, F.lit(_NAME_MARK), F.lit(" "))
    apart = F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<=[0-9])(?=\\p{L})", " ")).otherwise(plain)
    marked = F.regexp_replace(apart, _NAME, _NAME_MARK)
    return words_of(F.lower(F.regexp_replace(marked, f"[^\\p{{L}}\\p{{N}}\\s{_NAME_MARK}]+", "")))


def _kind(tokens: Column, at: Column) -> Column:
    """Placeholder of the word at a place (0-based), null for a literal."""

    def number(token: Column) -> Column:
        return ((token >= "0") & (token < ":")) | token.isin(NUMBER_WORDS)

    token = F.get(tokens, at)
    return (
        F.when(F.startswith(token, F.lit(_NAME_MARK)), F.lit(NAME)).when(number(token), F.lit(NUMBER))
        .when(token.isin(UNITS) & F.coalesce(number(F.get(tokens, at - 1)), F.lit(False)), F.lit(UNIT)))


def _slots(start: Column, width: Column) -> Column:
    """Values of the placeholders of a window of `tokens`, null for literals."""
    tokens = F.col("tokens")
    return F.transform(F.sequence(start, start + width - 1), lambda at: F.when(
        _kind(tokens, at).isNotNull(), F.ltrim(F.get(tokens, at), F.lit(_NAME_MARK))))


def _templates(frame: DataFrame, key: str) -> DataFrame:
    """key, a text's tokens, and the hashes of its template words, odd for literals and even for placeholders."""
    def word(token: Column, kind: Column) -> Column:
        return F.when(kind.isNull(), F.xxhash64(token).bitwiseOR(F.lit(1))).otherwise(F.xxhash64(kind).bitwiseAND(F.lit(-2)))

    hashed = let(template_tokens(whole_text()), lambda tokens: F.struct(
        tokens.alias("tokens"), F.transform(tokens, lambda token, at: word(token, _kind(tokens, at))).alias("words")))
    return frame.select(F.col(key), hashed.alias("template")).select(key, "template.tokens", "template.words")


def _is_literal(word: Column) -> Column:
    return word.bitwiseAND(F.lit(1))


def _exact(width: int) -> Column:
    """Whether the `width` words from `at` on (0-based) hold too few literals to stand as a template."""
    words = [F.get(F.col("words"), F.col("at") + k) for k in range(width)]
    return sum((_is_literal(word) for word in words[1:]), _is_literal(words[0])) < min(width, MIN_LITERALS)


def _window_hash(width: int) -> Column:
    """Hash of the `width` template words from `at` on (0-based), or of the words themselves where literals are few."""
    template = F.xxhash64(F.lit(width), *[F.get(F.col("words"), F.col("at") + k) for k in range(width)])
    as_written = F.replace(F.array_join(F.slice("tokens", F.col("at") + 1, width), " "), F.lit(_NAME_MARK), F.lit(""))
    return F.when(_exact(width), F.xxhash64(F.lit(-width), as_written)).otherwise(template)


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window, width, exact, item_id, item_at, item_slots and item_windows of every window of the items with a literal word."""
    written = slim(benchmark, "item_id", "text").where("item_id IS NOT NULL")
    items = _templates(written.union(written.withColumn("text", F.lower("text"))), "item_id").where(
        F.exists("words", lambda word: _is_literal(word) == 1))
    spread = items.select("item_id", "words", "tokens", F.posexplode("words").alias("at", "word")).drop("word")
    width = F.least(F.size("words"), F.lit(WINDOW))
    by_width = range(1, WINDOW + 1)
    hashes = F.coalesce(*[F.when(F.col("width") == w, _window_hash(w)) for w in by_width])
    exact = F.coalesce(*[F.when(F.col("width") == w, _exact(w)) for w in by_width])
    windows = spread.withColumn("width", width).where("at <= size(words) - width").select(
        hashes.alias("window"), "width", exact.alias("exact"), "item_id", F.col("at").alias("item_at"),
        _slots(F.col("at"), F.col("width")).alias("item_slots"),
        (F.size("words") - F.col("width") + 1).alias("item_windows"))
    return windows.distinct()


def _document_windows(docs: DataFrame, widths: list[int], *more: str) -> DataFrame:
    """window, width, at and doc_id of every window of the given widths, beside the columns `more` of the templates."""
    spread = docs.select("doc_id", "words", "tokens", F.posexplode("words").alias("at", "word")).drop("word")
    parts = [
        spread.where(F.col("at") <= F.size("words") - width).select(
            _window_hash(width).alias("window"), F.lit(width).alias("width"), "doc_id", "at", *more)
        for width in widths]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def _hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, at and slots of every window of a document that is one of the benchmark's, with that window's columns."""
    # At most `WINDOW` distinct widths and one count.
    facts = windows.groupBy("width").agg(F.count("*").alias("n")).collect()
    widths = sorted(row["width"] for row in facts) or [WINDOW]
    named = slim(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    keys = ["window", "width"]
    if sum(row["n"] for row in facts) <= BROADCAST_WINDOWS:
        met = _document_windows(_templates(named, "doc_id"), widths, "tokens").join(F.broadcast(windows), keys)
    else:
        found = _document_windows(_templates(named, "doc_id"), widths).join(windows.select(*keys).distinct(), keys)
        few = named.join(found.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
        met = _document_windows(_templates(few, "doc_id"), widths, "tokens").join(windows, keys)
    return met.select(
        "doc_id", "item_id", "item_at", "item_windows", (F.col("at") - F.col("item_at")).alias("shift"),
        F.filter(
            F.zip_with("item_slots", _slots(F.col("at"), F.col("width")), lambda item, own: F.struct(
                item.alias("item"), F.when(F.col("exact"), item).otherwise(own).alias("own"))),
            lambda pair: pair["item"].isNotNull()).alias("pairs"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows (of the longest run), item_windows, n_slots and verbatim for every item found in a document."""
    hits = _hits(docs, benchmark_windows(benchmark))
    # A run holds at most the windows of its item.
    runs = hits.groupBy("doc_id", "item_id", "shift").agg(
        F.countDistinct("item_at").alias("windows"), F.first("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    items = F.array_distinct(F.transform("pairs", lambda pair: pair["item"]))
    sound = runs.where((F.size("pairs") == F.size(items)) & (F.col("windows") >= F.least(F.lit(MIN_WINDOWS), F.col("item_windows"))))
    changed = F.size(F.filter("pairs", lambda pair: ~pair["item"].eqNullSafe(pair["own"])))
    return sound.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("item_windows").alias("item_windows"),
        F.max(F.size("pairs")).alias("n_slots"), F.min(changed == 0).alias("verbatim"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no item is found, with the columns of `docs`."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found.hint("merge"), "doc_id", "left_anti").select(*[F.col(f"`{name}`") for name in docs.columns])
