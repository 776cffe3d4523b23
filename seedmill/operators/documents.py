"""Documents: conversion to labelled items, cleaning, chunking, ids, the index table."""

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seedmill import fixed
from seedmill.functions.columns import exploded, strip, words
from seedmill.functions.slots import HashingEmbedder, embedding_column

# Markup that carries no document text, tags that end a line.
FURNITURE_TAGS = ("script", "style", "head", "nav", "footer")
LINE_TAGS = (
    "p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "tr", "table", "caption", "thead", "tbody", "tfoot",
    "section", "article", "aside", "main", "header", "figure", "figcaption", "blockquote", "pre",
)
# What follows a tag's name: attributes, in which a quoted value may hold ">". An open quote ends at the first ">".
_QUOTED = """[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+"""
_ATTRIBUTES = rf"(?:[\s/](?:{_QUOTED}|[^>]*))?"
_CHARACTER = r"&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# A hard blank counts as a blank.
_NAMED = json.dumps({f"&{name}": character.replace("\u00a0", " ") for name, character in html5.items() if name.endswith(";")})
_HEADING_MARK = "\u0001"
HEADER_LABELS = ("title", "section_header")


def named_characters(text: Column) -> Column:
    """Character references of HTML, by name or number, as their characters.

    Each is read once, so ``&amp;lt;`` becomes ``&lt;``. References to no
    character (an unknown name, a surrogate, a number beyond Unicode) stay.
    """
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def read(piece: Column) -> Column:
        digits = F.regexp_extract(piece, "^&#([0-9]+);$", 1)
        hexed = F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(digits != "", digits.cast("long")).when(hexed != "", F.conv(hexed, 16, 10).cast("long"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        blank = F.when(code == 0xA0, " ")
        character = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        by_number = F.when(valid, F.coalesce(blank, character))
        return F.when(F.startswith(piece, F.lit("&")), F.coalesce(by_number, F.try_element_at(named, piece), piece)).otherwise(piece)

    pieces = F.regexp_extract_all(text, F.lit(f"({_CHARACTER}|[^&]++|&)"), F.lit(1))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(text)


def html_lines(html: Column) -> Column:
    """Visible text lines of a page; heading lines start with a mark.

    A row of a table is a line with `` | `` between its cells.
    """
    text = html
    for tag in FURNITURE_TAGS:
        text = F.regexp_replace(text, f"(?is)<{tag}{_ATTRIBUTES}>.*?</{tag}\\s*>", "")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, f"(?i)<h[1-6]{_ATTRIBUTES}>", "\n" + _HEADING_MARK)
    text = F.regexp_replace(text, "(?i)</h[1-6]\\s*>", "\n")
    text = F.regexp_replace(text, f"(?i)(<tr{_ATTRIBUTES}>)\\s*<t[dh]{_ATTRIBUTES}>", "$1")
    text = F.regexp_replace(text, f"(?i)\\s*(?:</t[dh]\\s*>\\s*)?<t[dh]{_ATTRIBUTES}>\\s*", " | ")
    text = F.regexp_replace(text, f"(?i)</?(?:{'|'.join(LINE_TAGS)}){_ATTRIBUTES}>", "\n")
    text = F.regexp_replace(text, f"</?[A-Za-z!?](?:{_QUOTED}|[^>]*)>", "")
    return F.transform(F.split(text, "\n"), named_characters)


def markdown_lines(text: Column) -> Column:
    return F.transform(
        F.split(text, "\n"),
        lambda line: F.regexp_replace(line, "^#{1,6} +", _HEADING_MARK),
    )


def items_of(lines: Column) -> Column:
    """Non-empty lines as labelled items."""
    trimmed = F.transform(lines, lambda line: strip(line))
    kept = F.filter(trimmed, lambda line: ~line.isin("", _HEADING_MARK))
    return F.transform(
        kept,
        lambda line: F.struct(
            F.when(F.startswith(line, F.lit(_HEADING_MARK)), F.lit("section_header"))
            .otherwise(F.lit("text"))
            .alias("label"),
            F.replace(line, F.lit(_HEADING_MARK), F.lit("")).alias("text"),
        ),
    )


def convert_documents(df: DataFrame, content: str = "html", kind: str = "html") -> DataFrame:
    """Source text to items, with a status per document; a bad document never stops the rest.

    A page without markup or without text is a failure, a page that was cut off
    (no closing ``html`` tag) a partial conversion.
    """
    source = F.col(content)
    items = items_of(html_lines(source) if kind == "html" else markdown_lines(source))
    out = df.withColumn("items", items)
    empty = F.col("items").isNull() | (F.size("items") == 0)
    if kind == "html":
        failed = empty | ~source.rlike("(?i)<[a-z]")
        cut = ~source.rlike("(?i)</html>")
    else:
        failed, cut = empty, F.lit(False)
    status = F.when(failed, "failure").when(cut, "partial").otherwise("success")
    # As output of a generator the two columns stay computed once: a later filter on
    # the status would otherwise be pushed down and convert every document again.
    settled = out.withColumn("status", status)
    return settled.select(*df.columns, F.inline_outer(F.array(F.struct("items", "status"))))


def successful_conversions(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "success")


def conversion_report(df: DataFrame) -> DataFrame:
    return df.agg(
        *[
            F.count_if(F.col("status") == status).alias(status)
            for status in ("success", "partial", "failure")
        ]
    )


def fail_on_conversion_errors(report: DataFrame) -> DataFrame:
    """Raise at the end of a job in which any document failed; the report comes back otherwise."""
    row = report.first()
    if row["failure"]:
        raise RuntimeError(f"failed converting {row['failure']} of {sum(row)} documents")
    return report


def clean_text(text: Column) -> Column:
    """One blank between words, no empty lines."""
    lines = F.transform(
        F.split(text, "\n"), lambda line: strip(F.regexp_replace(line, fixed.BLANKS_PATTERN, " "))
    )
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def clean_documents(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text)))


def _windows(items: Column, size: Column) -> Column:
    """An array column cut into consecutive arrays of at most ``size``; none for an empty array.

    Both should be stored columns: inside the lambda an expression would be
    worked out again for every window.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), size)
    return F.when(F.size(items) == 0, F.array().cast("array<array<string>>")).otherwise(
        F.transform(starts, lambda start: F.slice(items, start + 1, size))
    )


def chunk_by_words(df: DataFrame, max_words: int = fixed.CHUNK_WORDS, text: str = "text") -> DataFrame:
    """Consecutive chunks of at most ``max_words`` words covering the whole text."""
    keep = [c for c in df.columns if c != text]
    split = df.select(*keep, words(F.col(text)).alias("_all"))
    cut = exploded(split, keep, _windows(F.col("_all"), F.lit(max_words)), "chunk", "_words")
    return cut.select(
        *keep,
        "chunk",
        F.array_join("_words", " ").alias("content"),
        F.size("_words").alias("n_words"),
    )


def _is_header(item: Column) -> Column:
    return item["label"].isin(*HEADER_LABELS)


def with_sections(df: DataFrame, items: str = "items") -> DataFrame:
    """Items grouped under their heading; text before the first heading has none."""
    every = F.col(items)
    heads = F.filter(
        F.transform(every, lambda x, i: F.when(_is_header(x), i + 1)), lambda i: i.isNotNull()
    )
    starts = F.when(F.size(every) == 0, F.array().cast("array<int>")).otherwise(
        F.array_distinct(F.concat(F.array(F.lit(1)), heads))
    )

    def section(start: Column, j: Column) -> Column:
        end = F.coalesce(F.try_element_at(F.col("_starts"), j + 2), F.size(every) + 1)
        return F.slice(every, start, end - start)

    def texts(part: Column, keep) -> Column:
        return F.transform(F.filter(part, keep), lambda x: x["text"])

    def described(part: Column) -> Column:
        return F.struct(
            texts(part, _is_header).alias("headings"),
            texts(part, lambda x: x["label"] == "caption").alias("captions"),
            F.array_join(
                texts(part, lambda x: ~x["label"].isin(*HEADER_LABELS, "caption")), "\n"
            ).alias("text"),
        )

    return (
        df.withColumn("_starts", starts)
        .withColumn("sections", F.transform(F.transform("_starts", section), described))
        .drop("_starts")
    )


def split_documents(
    df: DataFrame,
    max_tokens: int = fixed.CHUNK_TOKENS,
    items: str = "items",
    tokenize: Callable[[Column], Column] = words,
    on_error: str = "fail",
) -> DataFrame:
    """Chunks of at most ``max_tokens`` tokens that never cross a heading and carry it in front.

    The limit holds for heading and body together (a heading that fills it leaves
    one token for the body). A heading without text is a chunk of its own.
    ``tokenize`` counts tokens; the default takes words, which is a different
    unit from a model's tokens. A document without content is an error, or is
    left out for ``on_error='skip'``.
    """
    keep = [c for c in df.columns if c != items]
    if on_error == "skip":
        source = df.filter(F.col(items).isNotNull())
    else:
        missing = F.raise_error(F.lit("a document has no content")).cast(df.schema[items].dataType)
        source = df.withColumn(items, F.when(F.col(items).isNull(), missing).otherwise(F.col(items)))
    sections = exploded(with_sections(source, items), keep, F.col("sections"), "section", "_s")
    heading = F.array_join("_s.headings", "\n")
    tokens = sections.withColumn("_all", tokenize(F.col("_s.text"))).withColumn("_head", F.size(tokenize(heading)))
    tokens = tokens.withColumn("_room", F.greatest(F.lit(1), F.lit(max_tokens) - F.col("_head")))
    alone = (F.size("_all") == 0) & (F.col("_head") > 0)
    parts = F.when(alone, F.array(F.col("_all"))).otherwise(_windows(F.col("_all"), F.col("_room")))
    chunks = exploded(tokens, [*keep, "section", "_s", "_head"], parts, "chunk", "_tokens")
    body = F.array_join("_tokens", " ")
    return chunks.select(
        *keep,
        "section",
        "chunk",
        F.when(heading == "", body)
        .when(body == "", heading)
        .otherwise(F.concat(heading, F.lit("\n"), body))
        .alias("content"),
        F.col("_s.headings").alias("headings"),
        F.col("_s.captions").alias("captions"),
        (F.col("_head") + F.size("_tokens")).alias("n_tokens"),
    )


def with_content_id(df: DataFrame, columns: tuple[str, ...] = ("content",)) -> DataFrame:
    """A document id that depends on content and metadata only."""
    identity = F.to_json(F.struct(*columns)) if len(columns) > 1 else F.col(columns[0])
    return df.withColumn("id", F.sha2(identity, 256))


def dedup_skip(df: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Keep the first row per id. ``order`` is unique per row.

    Copies collapse inside each task before anything moves, so a huge group of
    copies sends one row per task, and the input is worked out once.
    """
    others = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("_first"))
    return first.select(key, "_first.*").select(*df.columns)


def embed(
    df: DataFrame, text: str = "content", make_embedder: Callable = HashingEmbedder, out: str = "embedding"
) -> DataFrame:
    return df.withColumn(out, embedding_column(F.col(text), make_embedder))


def index_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("documents"))


def build_index(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    max_tokens: int = fixed.CHUNK_TOKENS,
    make_embedder: Callable = HashingEmbedder,
) -> DataFrame:
    """Clean, split, identify, skip duplicates, embed: the rows of the index.

    Duplicates go before the embedder runs, so no text is embedded twice.
    """
    cleaned = df.select(key, clean_text(F.col(text)).alias(text))
    items = cleaned.select(key, items_of(markdown_lines(F.col(text))).alias("items"))
    chunks = with_content_id(split_documents(items, max_tokens))
    place = F.struct(key, "section", "chunk")
    unique = dedup_skip(chunks.withColumn("_place", place), "_place").drop("_place")
    return embed(unique, "content", make_embedder)
