"""Pages, chunks, quotes, model answers and greedy deduplication."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.normalize import nonblank, strip
from factloom.sources.tables import rewritten, settled

from .facts import FACT_TYPES

# What hides a secret, in order; `\1` stays.
SECRETS = [
    (r"(?i)([?&]key=)[^&\s'\"]+", "$1[REDACTED_KEY]"),
    (r"(?i)(x-goog-api-key[\"'\s:=]+)[a-zA-Z0-9_\-\.]{12,}", "$1[REDACTED_KEY]"),
    (r"(?i)(bearer\s+)[a-zA-Z0-9_\-\.]{15,}", "$1[REDACTED_TOKEN]"),
    (r"(?i)(api[_-]?key[\"'\s:=]+)[a-zA-Z0-9_\-\.]{12,}", "$1[REDACTED_KEY]"),
    (r"(?i)(postgresql(?:ql|\+asyncpg)?://[^:]+:)[^@]+(@)", "$1[REDACTED_PASSWORD]$2"),
    (r"\bAQ\.[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_GEMINI_KEY]"),
    (r"\bgsk_[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_GROQ_KEY]"),
    (r"\bjina_[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_JINA_KEY]"),
    (r"\beyJ[a-zA-Z0-9_\-]{20,}\.[a-zA-Z0-9_\-]{20,}\.[a-zA-Z0-9_\-]{20,}\b", "[REDACTED_JWT]"),
]
#: Default length and overlap of chunks in characters.
SIZE, OVERLAP = 800, 100


def redact_secrets(text: Column) -> Column:
    for pattern, shown in SECRETS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def sanitize_filename(name: Column, suffix: str = ".pdf") -> Column:
    """The base name with word characters, dots and dashes only, without leading dots, ending in `suffix`."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), -1)
    base = F.regexp_replace(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), r"(?U)[^\w.\-]", "_")
    base = F.regexp_replace(base, r"^\.+", "")
    return F.when(F.lower(base).endswith(suffix), base).otherwise(F.concat(base, F.lit(suffix)))


def validate_files(files: DataFrame, magic: bytes = b"%PDF-", max_mb: int = 50) -> DataFrame:
    """Adds `problem` (null if fine) to (content): empty, too large, or not starting with `magic`."""
    size = F.octet_length("content")
    start = F.substring("content", 1, len(magic))
    return files.withColumn("problem", F.when(size == 0, "empty").when(size > max_mb * 1024 * 1024, "too large").when(F.coalesce(start != F.lit(magic), F.lit(True)), "wrong type"))


def page_table(documents: DataFrame, separator: str = "\f", text: str = "text") -> DataFrame:
    """A row per page with its number, characters and words; pages are parted by `separator`."""
    words = F.filter(F.split("page_text", r"(?U)\s+"), lambda w: w != "")
    pages = documents.select("document_id", F.posexplode(F.split(text, re.escape(separator))).alias("at", "page_text"))
    return pages.select("document_id", (F.col("at") + 1).alias("page_number"), "page_text", F.char_length("page_text").alias("char_count"), F.size(words).alias("word_count"))


def printed_page_number(text: Column, number: Column) -> Column:
    """The number that stands alone on the last or else first filled line, else the given one."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    pattern = r"(?i)^(?:page|p\.|-)?\s*(\d{1,4})(?:\s*-)?$"
    found = lambda i: nonblank(F.regexp_extract(F.coalesce(F.try_element_at(lines, F.lit(i)), F.lit("")), pattern, 1))
    return F.coalesce(found(-1), found(1), number.cast("string"))


# Marks after which a chunk may end, the best first.
BREAKS = ("\n\n", "\n", ". ", " ")


def chunk_spans(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[str, int, int]]:
    """(chunk, start, end) in the stripped text, none of it longer than `size`.

    A chunk ends after the last place of the best mark of BREAKS that lies wholly between start + overlap and start + size, or at
    start + size itself. Starts form a chain of such jumps, each `overlap` before the last end (half a chunk on if that is no step forward).
    """
    text = (text or "").strip()
    n = len(text)

    def end_from(start: int) -> int:
        last = start + size
        if last >= n:
            return n
        for mark in BREAKS:
            if (at := text.rfind(mark, start + overlap, last)) >= 0:
                return at + len(mark)
        return last

    start = end = 0
    while end < n:
        end = end_from(start)
        body = text[start:end].lstrip()
        left = end - len(body)
        if body := body.rstrip():
            yield body, left, left + len(body)
        start = end - overlap if end - overlap > start else start + max(1, size // 2)


def chunks_of(text: Column | str, size: int = SIZE, overlap: int = OVERLAP, most: int | None = None) -> Column:
    """The overlapping chunks of a text as an array of (text, start_offset, end_offset); of their texts at most the first `most` characters."""

    @F.arrow_udf("array<struct<text:string, start_offset:int, end_offset:int>>")
    def cut(texts: pa.Array) -> pa.Array:
        ends, starts, stops, parts = [0], [], [], []
        for k in range(0, len(texts), 256):  # so that Python holds some texts at a time
            chunks = []
            for text in texts.slice(k, 256).to_pylist():
                for c, start, stop in chunk_spans(text, size, overlap):
                    chunks.append(c[:most])
                    starts.append(start)
                    stops.append(stop)
                ends.append(len(starts))
            parts.append(pa.array(chunks, pa.string()))
        chunks = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
        rows = pa.StructArray.from_arrays([chunks, pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["text", "start_offset", "end_offset"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

    return cut(text)


def split_chunks(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ("document_id", "page_id")) -> DataFrame:
    """`keep`, chunk_index, text, start_offset, end_offset: overlapping chunks of every page."""
    chunks = pages.select(*keep, F.posexplode(chunks_of("text", size, overlap)).alias("chunk_index", "c"))
    return chunks.select(*keep, "chunk_index", "c.*")


def locate_quote(quote: Column, text: Column) -> dict[str, Column]:
    """start, end (0-based, in characters) and grounded: the quote as it is, else with any white
    space between its words."""
    q = strip(F.coalesce(quote, F.lit("")))
    exact = F.coalesce(F.position(q, text), F.lit(0))
    words = F.transform(F.filter(F.split(q, r"(?U)\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, r"([\\\[\](){}.*+?^$|#&~\-])", r"\\$1"))
    loose = F.when((q != "") & (exact == 0), F.regexp_substr(text, F.concat(F.lit("(?U)"), F.array_join(words, r"\s+"))))
    start = F.when(q == "", F.lit(None).cast("int")).when(exact > 0, exact - 1).when(loose.isNotNull(), F.position(loose, text) - 1)
    length = F.when(exact > 0, F.char_length(q)).otherwise(F.char_length(loose))
    return {"start": start, "end": start + length, "grounded": start.isNotNull()}


def extraction_batches(chunks: DataFrame, n: int = 2) -> DataFrame:
    """Chunks of a document in order of page and index, n to a batch, as one prompt text with labels."""
    order = Window.partitionBy("document_id").orderBy("page_number", "chunk_index")
    numbered = chunks.withColumn("at", F.row_number().over(order) - 1)
    numbered = numbered.withColumns({"batch_no": F.floor(F.col("at") / n), "label": F.concat(F.lit("chunk_"), F.col("at") % n + 1)})
    shown = F.concat(F.lit("["), F.col("label"), F.lit("]\n"), F.col("text"))
    return numbered.groupBy("document_id", "batch_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", shown.alias("shown")))), lambda x: x["shown"]), "\n\n").alias("prompt"), F.count("*").alias("n_chunks"))


# The fields of an extracted item, what stands for an absent one, and the types a fact can have.
ITEM = (
    "chunk_id", "subject", "predicate", "raw_claim", "value_text", "raw_value_text", "value_numeric", "value_boolean", "unit", "fact_type", "period_text", "scope", "geography",
    "segment", "status", "attribution", "confidence", "quote",
)
ABSENT = {"fact_type": "NUMERICAL", "status": "actual", "confidence": "0.9"}


def truth(text: Column) -> Column:
    """True or false of a text like true, yes, on, 1; null for others."""
    word = F.lower(strip(text))
    return F.when(word.isin("true", "t", "yes", "y", "on", "1"), True).when(word.isin("false", "f", "no", "n", "off", "0"), False)


def parse_model_answers(answers: DataFrame) -> DataFrame:
    """(batch_id, position, item) of every answer text; one bad item rejects its whole answer.

    Code fences and what stands around the outer braces are cut. Items are read as texts and then
    cast, so numbers in quotes pass. Subject, predicate, claim and quote must be there; an absent type, status or confidence
    is that of ABSENT, a null status stays null, a null or unknown type or a confidence outside 0 to 1 is bad,
    as is a number or truth value that cannot be read.
    """
    body = nonblank(F.regexp_extract("answer", r"(?s)\{.*\}", 0))
    parsed = answers.withColumn("facts", F.from_json(body, "facts array<map<string,string>>")["facts"])
    value = lambda m, c: F.when(~F.map_contains_key(m, F.lit(c)), F.lit(ABSENT[c])).otherwise(m[c]) if c in ABSENT else m[c]
    items = F.transform("facts", lambda m: F.struct(*[value(m, c).alias(c) for c in ITEM]))
    there = lambda x, *names: reduce(lambda p, q: p & q, [x[c].isNotNull() for c in names])
    fine = lambda x: (
        there(x, "subject", "predicate", "raw_claim", "quote") & (x["value_numeric"].isNull() | x["value_numeric"].try_cast("double").isNotNull()) & (x["value_boolean"].isNull() | truth(x["value_boolean"]).isNotNull())
        & x["fact_type"].isin(*FACT_TYPES) & x["confidence"].try_cast("double").between(0, 1)
    )
    parsed = parsed.where(F.col("facts").isNotNull() & F.forall("facts", lambda m: m.isNotNull())).withColumn("facts", items)
    return parsed.where(F.forall("facts", lambda x: F.coalesce(fine(x), F.lit(False)))).select("batch_id", F.posexplode("facts").alias("position", "item"))


def ground_facts(items: DataFrame) -> DataFrame:
    """Adds start, end, grounded and offset_base to (quote, chunk_text, page_text): in the chunk, else in the page."""
    c, p = locate_quote(F.col("quote"), F.col("chunk_text")), locate_quote(F.col("quote"), F.col("page_text"))
    base = F.when(c["grounded"], "chunk").when(p["grounded"], "page")
    return items.withColumns({"start": F.coalesce(c["start"], p["start"]), "end": F.coalesce(c["end"], p["end"]), "grounded": base.isNotNull(), "offset_base": base})


#: Open facts that one task walks through in order, and rounds of joins before that.
WALK, ROUNDS = 200_000, 2


def _walk(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of the rows of each group, in the order of d_turn, those that repeat no claim and no quote of one that stays."""

    def keep(batches):
        group, claims, quotes = None, set(), set()
        for batch in batches:
            stays = []
            for *now, of, claim, quote in zip(*[batch.column(c).to_pylist() for c in [*by, "d_of", "d_claim", "d_quote"]], strict=True):
                if now != group:
                    group, claims, quotes = now, set(), set()
                new = (of, claim) not in claims and (of, quote) not in quotes
                if new:
                    claims.add((of, claim))
                    quotes.add((of, quote))
                stays.append(new)
            yield batch.filter(pa.array(stays, pa.bool_()))

    rows = rows.repartition(*by).sortWithinPartitions(*by, "d_turn", "d_claim", "d_quote")
    return rows.mapInArrow(keep, rows.schema)


def _linked(rows: DataFrame) -> DataFrame:
    """`rows` with `d_part`: equal for facts that shared claims and quotes connect. Nodes are 64-bit hashes;
    should two of them meet, parts are joined that need not be, which changes nothing.

    Each round hooks every label to the least one among the neighbours of all that bear it, so that the number of labels
    of a part at least halves: a chain of n facts takes about log n rounds."""
    node = lambda kind, c: F.xxhash64(F.lit(kind), "d_of", c)
    rows = rows.withColumns({"d_u": node("claim", "d_claim"), "d_v": node("quote", "d_quote")})
    both = settled(rows.select(F.explode(F.array(F.struct(F.col("d_u").alias("u"), F.col("d_v").alias("v")), F.struct(F.col("d_v").alias("u"), F.col("d_u").alias("v")))).alias("e")).select("e.*").distinct())
    labels = both.groupBy("u").agg(F.first("u").alias("label"))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = settled(labels.join(near, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("low")))
        hooks = settled(lower.where("low < old").groupBy("old").agg(F.min("low").alias("hook")))
        if hooks.isEmpty():
            return rows.join(labels.select(F.col("u").alias("d_u"), F.col("label").alias("d_part")), "d_u").drop("d_u", "d_v")
        further = hooks.join(hooks.select(F.col("old").alias("hook"), F.col("hook").alias("next")), "hook", "left").select("old", F.coalesce("next", "hook").alias("hook"))
        # A file has the size that it has; a checkpoint keeps the size estimated of joins, which would be squared with every round.
        labels = rewritten(lower.join(further, "old", "left").select("u", F.coalesce("hook", "old").alias("label")))


def dedup_facts(new: DataFrame, stored: DataFrame, walk: int = WALK) -> DataFrame:
    """New facts (document_id, position, raw_claim, quote) that repeat no claim and no quote, in order.

    Stored ones are anti-joined on either text. Within a document's new facts a dropped one suppresses
    nothing after it, so the order decides. Two rounds of joins keep what is the first of its claim and of its
    quote and drop what shares either with it, which ends every claim or quote of many facts. What is still
    open depends on chains of facts: documents with up to `walk` open facts are walked in order, a
    document a task, with a set of claims and one of quotes; larger ones are cut into the parts that
    shared texts connect, and these are walked; parts that are larger still go through the rounds again.
    A chain of any length up to `walk` thus takes as many stages as a pair.

    A null claim, quote or document is a value of its own, a null position comes last, of rows
    that are equal in all four one stays.
    """
    key = lambda c: F.trim(F.lower(F.col(c)))
    fresh = new.withColumns({"d_claim": key("raw_claim"), "d_quote": key("quote")})
    for c, k in (("raw_claim", "d_claim"), ("quote", "d_quote")):
        known = stored.where(F.col(c).isNotNull()).select("document_id", key(c).alias(k)).distinct()
        fresh = fresh.join(known, ["document_id", k], "left_anti")
    # Keys without nulls, for joins; no text is a lone NUL.
    filled = {k: F.coalesce(F.col(c).cast("string"), F.lit("\0")) for k, c in (("d_of", "document_id"), ("d_claim", "d_claim"), ("d_quote", "d_quote"))}
    fresh = rewritten(fresh.select(*new.columns)).withColumns({"d_claim": key("raw_claim"), "d_quote": key("quote")})
    fresh = fresh.withColumns(filled | {"d_turn": F.struct(F.col("position").isNull().alias("last"), "position")})
    texts = ["d_of", "d_claim", "d_quote"]
    # Of equal claim and quote only the first can stay.
    left, kept = rewritten(fresh.groupBy(*texts).agg(F.min("d_turn").alias("d_turn"))), []
    turns = ROUNDS
    while not left.isEmpty():
        for _ in range(turns):
            if left.isEmpty():
                break
            first = lambda k: left.groupBy("d_of", k).agg(F.min(F.struct("d_turn", "d_claim", "d_quote")).alias("f")).select("d_of", "f.*")  # noqa: B023, E731
            kept.append(rewritten(first("d_claim").join(first("d_quote"), [*texts, "d_turn"], "left_semi")))
            for k in ("d_claim", "d_quote"):
                left = left.join(kept[-1].select("d_of", k), ["d_of", k], "left_anti")
            left = rewritten(left)
        for by in (["d_of"], ["d_part"]):
            if left.isEmpty():
                break
            if by == ["d_part"]:
                left = settled(_linked(left))
            large = settled(left.groupBy(*by).count().where(F.col("count") > walk).select(*by))
            kept.append(settled(_walk(left.join(large, by, "left_anti"), by).select(*texts, "d_turn")))
            left = settled(left.join(large, by, "left_semi").select(*texts, "d_turn"))
        turns *= 2
    stays = reduce(DataFrame.unionByName, kept, left)  # nothing is left
    return fresh.join(stays, [*texts, "d_turn"], "left_semi").dropDuplicates([*texts, "d_turn"]).select(*new.columns)


def embed(rows: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], column: str = "embedding") -> DataFrame:
    """Fills null vectors with what `embedder` gives for batches of texts."""
    schema = rows.schema

    def fill(frames):
        for f in frames:
            need = f[column].isna()
            if need.any():
                f.loc[need, column] = pd.Series(embedder(f.loc[need, text].tolist()), index=f.index[need])
            yield f

    return rows.mapInPandas(fill, schema)


def fact_embedding_text() -> Column:
    part = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    return F.concat_ws(" | ", F.concat(F.lit("Entity: "), "subject"), F.concat(F.lit("Metric: "), "predicate"), F.concat(F.lit("Claim: "), "raw_claim"), part("Period: ", "period_text"), part("Unit: ", "normalized_unit"))


def rag_context(hits: DataFrame, texts: DataFrame, queries: DataFrame, nothing: str = "No relevant document chunks found.") -> DataFrame:
    """A context for every query (query_id) from its hits (query_id, id, distance, rank) and texts (id, text);
    a query without hits gets `nothing`."""
    line = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] ("), F.col("id").cast("string"), F.lit(", "), F.format_string("%.3f", 1 - F.col("distance")), F.lit(")\n"), F.col("text"))
    lines = hits.join(texts, "id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    lines = queries.select("query_id").distinct().join(lines, "query_id", "left")
    return lines.select("query_id", F.coalesce(nonblank(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n")), F.lit(nothing)).alias("context"))


def select_pages(pages: DataFrame, extracted: DataFrame, most: int | None = None, numbers: list[int] | None = None, offset: int = 0) -> DataFrame:
    """Pages (document_id, page_id, page_number) to process, numbered by `turn` within each document.

    Those of `numbers`, if any are named; else those after the first `offset` ones, if it is above 0;
    else those not extracted yet, or all of a document's if none is left. Of the last two at most `most`.
    """
    order = Window.partitionBy("document_id").orderBy("page_number", "page_id")
    if numbers:
        return pages.where(F.col("page_number").isin(*numbers)).withColumn("turn", F.row_number().over(order))
    if offset > 0:
        wanted = pages.withColumn("turn", F.row_number().over(order) - offset).where("turn > 0")
    else:
        done = extracted.select("page_id").distinct().withColumn("done", F.lit(True))
        marked = pages.join(done, "page_id", "left").withColumn("left", F.sum(F.when(F.col("done").isNull(), 1).otherwise(0)).over(Window.partitionBy("document_id")))
        wanted = marked.where(F.col("done").isNull() | (F.col("left") == 0)).drop("done", "left").withColumn("turn", F.row_number().over(order))
    return wanted if most is None else wanted.where(F.col("turn") <= most)


def has_text(text: Column) -> Column:
    """Whether a text is more than white space."""
    return F.coalesce(strip(text), F.lit("")) != ""


def nonblank_pages(pages: DataFrame, text: str = "text") -> DataFrame:
    """Pages whose text is more than white space."""
    return pages.where(has_text(F.col(text)))


def file_hash(content: Column) -> Column:
    """SHA-256 of a file's bytes in hex."""
    return F.sha2(content.cast("binary"), 256)


def chunk_index(pages: DataFrame, pieces: Column, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """A row per piece of a page (an array column) with its place in the page from 0."""
    return pages.select(*keep, F.posexplode(pieces).alias("chunk_index", "text"))


def format_value(value: Column, unit: Column) -> Column:
    """Crore and lakh for rupees, else billions, millions, thousands; an em dash for null."""
    size = F.abs(value)
    short = lambda by, tail: F.concat(F.format_string("%.2f", value / by), F.lit(tail))
    inr = F.coalesce(F.upper(unit) == "INR", F.lit(False))
    sign = F.when(inr, "₹").when(F.upper(unit) == "USD", "$").otherwise("")
    body = F.when(inr & (size >= 1e7), short(1e7, " Cr")).when(inr & (size >= 1e5), short(1e5, " Lakh")).when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).otherwise(F.format_string("%.2f", value))
    return F.when(value.isNull(), "—").otherwise(F.concat(sign, body))


def format_bytes(size: Column) -> Column:
    """B, KB, MB or GB with one place, which is left out if it is 0."""
    step = F.least(F.floor(F.log(2.0, size) / 10), F.lit(3)).cast("int")
    shown = F.regexp_replace(F.format_string("%.1f", size / F.pow(F.lit(1024.0), step)), r"\.0$", "")
    names = F.array(*[F.lit(x) for x in ("B", "KB", "MB", "GB")])
    return F.when(F.coalesce(size, F.lit(0)) <= 0, "0 B").otherwise(F.concat_ws(" ", shown, F.get(names, step)))


def format_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("—"))


def format_confidence(score: Column) -> Column:
    return F.coalesce(F.concat(F.floor(score * 100 + 0.5).cast("string"), F.lit("%")), F.lit("—"))
