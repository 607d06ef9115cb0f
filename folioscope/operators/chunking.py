"""Documents to retrieval chunks, inside the row: no shuffle and no Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed
from ..functions.text import (
    LINE_ENDS, all_matches, estimated_tokens, has_text, let, lines_with_ends, rstrip, strip, windows,
)

_GAP = r"[\h\x1f]"
# The mark comes first and the line-start check after it, so other characters fail at once.
_HEADING = rf"#(?<=(?<![^{LINE_ENDS}])#)#{{0,5}}{_GAP}+[^{LINE_ENDS}]*(?:\r\n|[{LINE_ENDS}])?"
_PARAGRAPH_GAP = r"(?U)\n\s*\n"
_CAPTION = r"(?iU)(?:Exhibit|Figure|Table|图表?|表)\s*[\d\-.]+"
_IMAGE = r"!\[[^\]]*\]\((images/[^)]+)\)"

IMAGES_TYPE = "array<struct<path:string,caption:string>>"
CHUNK_TYPE = (
    f"struct<heading_path:string,text:string,char_start:int,char_end:int,image_refs:{IMAGES_TYPE},token_est:int>"
)


def split_sections(text: Column) -> Column:
    """ARRAY of STRUCT(heading_path, body, char_start); heading lines stay out of the body."""
    headings = all_matches(text, _HEADING)

    def step(state: Column, pair: Column) -> Column:
        marks = F.regexp_extract(pair["heading"], "^#+", 0)
        title = strip(F.regexp_replace(pair["heading"], f"^#+{_GAP}+", ""))
        entry = F.struct(F.length(marks).alias("level"), title.alias("title"))
        stack = F.concat(
            F.filter(state["stack"], lambda above: above["level"] < F.length(marks)), F.array(entry)
        )
        begins = state["position"] + F.length(pair["heading"])
        section = F.struct(
            F.array_join(F.transform(stack, lambda level: level["title"]), " > ").alias("heading_path"),
            pair["body"].alias("body"),
            begins.alias("char_start"),
        )
        return F.struct(
            stack.alias("stack"),
            (begins + F.length(pair["body"])).alias("position"),
            F.concat(state["sections"], F.array(section)).alias("sections"),
        )

    def fold(bodies: Column) -> Column:
        first = F.element_at(bodies, 1)
        pairs = F.zip_with(
            headings,
            F.slice(bodies, F.lit(2), F.size(bodies)),
            lambda heading, body: F.struct(heading.alias("heading"), body.alias("body")),
        )
        start = F.struct(
            F.array().cast("array<struct<level:int,title:string>>").alias("stack"),
            F.length(first).alias("position"),
            F.array(
                F.struct(F.lit("").alias("heading_path"), first.alias("body"), F.lit(0).alias("char_start"))
            ).alias("sections"),
        )
        return F.aggregate(pairs, start, step, lambda state: state["sections"])

    folded = let(F.split(text, _HEADING, -1), fold)
    whole = F.array(F.struct(F.lit("").alias("heading_path"), text.alias("body"), F.lit(0).alias("char_start")))
    return F.filter(
        F.when(text.rlike(_HEADING), folded).otherwise(whole), lambda section: has_text(section["body"])
    )


def collect_images(text: Column) -> Column:
    """Image links of a text, each with the last caption line at or above it."""
    start = F.struct(
        F.lit(None).cast("string").alias("caption"), F.array().cast(IMAGES_TYPE).alias("refs")
    )

    def step(state: Column, line: Column) -> Column:
        caption = F.when(line.rlike(_CAPTION), strip(line)).otherwise(state["caption"])
        found = F.transform(
            all_matches(line, _IMAGE, 1),
            lambda path: F.struct(path.alias("path"), caption.alias("caption")),
        )
        return F.struct(caption.alias("caption"), F.concat(state["refs"], found).alias("refs"))

    folded = F.aggregate(lines_with_ends(text), start, step, lambda state: state["refs"])
    return F.when(text.contains("](images/"), folded).otherwise(F.array().cast(IMAGES_TYPE))


def _chunk(heading: Column, text: Column, begins: Column) -> Column:
    return F.struct(
        heading.alias("heading_path"),
        text.alias("text"),
        begins.cast("int").alias("char_start"),
        (begins + F.length(text)).cast("int").alias("char_end"),
        collect_images(text).alias("image_refs"),
        estimated_tokens(F.length(text)).alias("token_est"),
    )


def _paragraphs(body: Column) -> Column:
    """Paragraphs and the gaps between them, in order."""
    gaps = F.concat(all_matches(body, _PARAGRAPH_GAP), F.array(F.lit(None).cast("string")))
    pairs = F.zip_with(
        F.split(body, _PARAGRAPH_GAP, -1), gaps, lambda part, gap: F.array_compact(F.array(part, gap))
    )
    return F.flatten(pairs)


def _piece(text: Column, begins: Column) -> Column:
    return F.struct(text.alias("text"), begins.cast("int").alias("begins"))


def _window_pieces(text: Column, begins: Column) -> Column:
    """Windows of an over-long paragraph; offsets advance by piece length."""
    size = int(fixed.TARGET_TOKENS * fixed.CHARS_PER_TOKEN)
    step = size - int(fixed.OVERLAP_TOKENS * fixed.CHARS_PER_TOKEN)

    def piece(part: Column, index: Column) -> Column:
        before = F.least(F.lit(size), F.length(text) - (index - 1) * step)
        return _piece(part, begins + F.when(index == 0, 0).otherwise((index - 1) * size + before))

    return F.transform(windows(text), piece)


def _packed_paragraphs(body: Column, begins: Column) -> Column:
    """Pieces of a section: paragraphs packed to the target, over-long ones windowed."""

    def state_of(done, buffer, tokens, buffer_start, offset) -> Column:
        return F.struct(
            done.alias("done"), buffer.alias("buffer"), tokens.cast("int").alias("tokens"),
            buffer_start.cast("int").alias("buffer_start"), offset.cast("int").alias("offset"),
        )

    def flushed(state: Column) -> Column:
        full = state["buffer"].isNotNull() & has_text(state["buffer"])
        piece = F.array(_piece(state["buffer"], state["buffer_start"]))
        return F.when(full, F.concat(state["done"], piece)).otherwise(state["done"])

    def step(state: Column, part: Column) -> Column:
        tokens = estimated_tokens(F.length(part))
        after = state["offset"] + F.length(part)
        overflow = (state["tokens"] + tokens > fixed.TARGET_TOKENS) & state["buffer"].isNotNull()
        return (
            F.when(
                tokens > fixed.MAX_TOKENS,
                state_of(
                    F.concat(flushed(state), _window_pieces(part, state["offset"])),
                    F.lit(None).cast("string"), F.lit(0), after, after,
                ),
            )
            .when(overflow, state_of(flushed(state), part, tokens, state["offset"], after))
            .otherwise(
                state_of(
                    state["done"], F.concat(F.coalesce(state["buffer"], F.lit("")), part),
                    state["tokens"] + tokens,
                    F.when(state["buffer"].isNull(), state["offset"]).otherwise(state["buffer_start"]),
                    after,
                )
            )
        )

    empty = F.array().cast("array<struct<text:string,begins:int>>")
    start = state_of(empty, F.lit(None).cast("string"), F.lit(0), begins, begins)
    return F.aggregate(_paragraphs(body), start, step, flushed)


def pack_section(section: Column) -> Column:
    """Chunks of one section. Cleaned text has no blank lines: its sections are one paragraph."""
    body, begins = section["body"], section["char_start"]
    pieces = (
        F.when(body.rlike(_PARAGRAPH_GAP), _packed_paragraphs(body, begins))
        .when(estimated_tokens(F.length(body)) > fixed.MAX_TOKENS, _window_pieces(body, begins))
        .otherwise(F.array(_piece(body, begins)))
    )
    return F.transform(pieces, lambda piece: _chunk(section["heading_path"], piece["text"], piece["begins"]))


def _joined(first: Column, second: Column, heading: Column) -> Column:
    def combined(text: Column) -> Column:
        return F.struct(
            heading.alias("heading_path"),
            text.alias("text"),
            first["char_start"].alias("char_start"),
            second["char_end"].alias("char_end"),
            F.concat(first["image_refs"], second["image_refs"]).alias("image_refs"),
            estimated_tokens(F.length(text)).alias("token_est"),
        )

    return let(F.concat(rstrip(first["text"]), F.lit("\n"), second["text"]), combined)


def merge_tiny(chunks: Column) -> Column:
    """Fold fragments into the chunk before them, and a leading fragment into the next."""
    array_type = f"array<{CHUNK_TYPE}>"

    def fits(first: Column, second: Column) -> Column:
        return first["token_est"] + second["token_est"] <= fixed.MAX_TOKENS

    def backward(done: Column, chunk: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joins = (chunk["token_est"] < fixed.MIN_TOKENS) & (F.size(done) > 0) & fits(last, chunk)
        merged = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(_joined(last, chunk, last["heading_path"])),
        )
        return F.when(joins, merged).otherwise(F.concat(done, F.array(chunk)))

    merged = F.aggregate(chunks, F.array().cast(array_type), backward)

    def forward(done: Column, chunk: Column) -> Column:
        # The last entry is still open when it is a fragment.
        last = F.try_element_at(done, F.lit(-1))
        joins = (F.size(done) > 0) & (last["token_est"] < fixed.MIN_TOKENS) & fits(last, chunk)
        joined = F.concat(
            F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(_joined(last, chunk, chunk["heading_path"])),
        )
        return F.when(joins, joined).otherwise(F.concat(done, F.array(chunk)))

    return F.aggregate(merged, F.array().cast(array_type), forward)


def chunk_array(text: Column) -> Column:
    packed = F.flatten(F.transform(split_sections(text), pack_section))
    return merge_tiny(packed)


def chunk_documents(documents: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk: chunk_id, doc_id, seq and the chunk's own columns."""
    exploded = documents.select("doc_id", *keep, F.posexplode(chunk_array(F.col(text))).alias("seq", "chunk"))
    return exploded.select(
        F.concat_ws("#", "doc_id", "seq").alias("chunk_id"), "doc_id", *keep, "seq", "chunk.*"
    )
