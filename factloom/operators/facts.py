"""Listings, joins, counts and checks over the fact tables. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

from factloom.functions.normalize import nonblank, normalize_unit, period_of, scalar_and_factor, scaled, strip
from factloom.sources.tables import settled


def normalize_facts(facts: DataFrame) -> DataFrame:
    """Adds normalized_value_numeric, normalized_unit, period_start and period_end; one narrow pass.
    Period bounds that a fact has already stay."""
    # What is used twice is a column first, so that a text is searched once.
    scalar, factor = scalar_and_factor(F.col("value_numeric"), F.col("raw_value_text"), F.col("unit"))
    parts = facts.withColumns({"n_scalar": scalar, "n_factor": factor, "n_period": period_of(F.col("period_text"))})
    kept = lambda c, new: F.coalesce(F.col(c).cast("date"), new) if c in facts.columns else new
    return parts.withColumns({
        "normalized_value_numeric": scaled(F.col("n_scalar"), F.col("n_factor")),
        "normalized_unit": normalize_unit(F.col("unit"), F.col("raw_value_text")),
        "period_start": kept("period_start", F.col("n_period.start")), "period_end": kept("period_end", F.col("n_period.end")),
    }).drop("n_scalar", "n_factor", "n_period")


def first_evidence(evidence: DataFrame) -> DataFrame:
    """(fact_id, quote, page_id, page_number) of each fact's first evidence; pre-aggregated."""
    first = F.min_by(F.struct("quote", "page_id", "page_number"), F.struct("created_at", "id")).alias("e")
    return evidence.groupBy("fact_id").agg(first).select("fact_id", "e.quote", "e.page_id", F.col("e.page_number").alias("evidence_page"))


def facts_for_matching(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with the page of their first evidence, else the page they carry."""
    e = first_evidence(evidence)
    joined = facts.join(e, facts["id"] == e["fact_id"], "left").drop("fact_id")
    return joined.withColumn("page_number", F.coalesce("evidence_page", "page_number")).drop("evidence_page")


def facts_with_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts with the array of their evidence in order of creation; `quote` is the first one's."""
    items = evidence.groupBy("fact_id").agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("evidence_id"), "quote", "page_number"))).alias("evidence"))
    return facts.join(items, facts["id"] == items["fact_id"], "left").drop("fact_id").withColumn("quote", F.try_element_at("evidence", F.lit(1))["quote"])


def facts_search(facts: DataFrame, dataset: str | None = None, document: str | None = None, category: str | None = None, entity: str | None = None, search: str | None = None, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Newest first, with the total before paging; texts match anywhere, whatever their case. A fact's
    category is the one in its metadata (a map, if there is one), else its type."""
    out = facts
    kind = F.coalesce(F.col("metadata")["category"], F.col("fact_type")) if "metadata" in facts.columns else F.col("fact_type")
    if dataset:
        out = out.where(F.col("dataset_id") == dataset)
    if document:
        out = out.where(F.col("document_id") == document)
    if category:
        out = out.where(kind == category)
    if entity:
        out = out.where(F.col("subject").ilike(f"%{entity}%"))
    if search:
        out = out.where(F.col("subject").ilike(f"%{search}%") | F.col("predicate").ilike(f"%{search}%") | F.col("raw_claim").ilike(f"%{search}%"))
    out = out.crossJoin(out.agg(F.count("*").alias("total"))).orderBy(F.desc("created_at"), "id").offset(offset)
    return out if limit is None else out.limit(limit)


def fact_view(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Presentation columns: page, value and unit with their fallbacks."""
    f = facts_for_matching(facts, evidence)
    return f.select("id", "subject", "predicate", "quote", F.col("page_number").alias("page"), F.coalesce(F.col("normalized_value_numeric").cast("double"), "value_numeric").alias("value"), F.coalesce("normalized_unit", "unit").alias("shown_unit"))


def relationships_detailed(edges: DataFrame, facts: DataFrame, evidence: DataFrame, filings: DataFrame) -> DataFrame:
    """Edges with both facts, their files, pages and first quotes as fact_a and fact_b. The enriched
    facts are built once and joined twice."""
    names = filings.select(F.col("id").alias("document_id"), "filename")
    rich = facts_for_matching(facts, evidence).join(names, "document_id", "left")
    side = lambda k: rich.select(F.col("id").alias(f"fact_{k}_id"), F.struct(*rich.columns).alias(f"fact_{k}"))
    return edges.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")


def relationships_basic(edges: DataFrame, facts: DataFrame, dataset: str | None = None) -> DataFrame:
    """Edges whose facts exist (and are both in the dataset), with both claims."""
    side = lambda k: facts.select(F.col("id").alias(f"fact_{k}_id"), F.col("raw_claim").alias(f"claim_{k}"), F.col("dataset_id").alias(f"dataset_{k}"))
    out = edges.join(side("a"), "fact_a_id").join(side("b"), "fact_b_id")
    return out if dataset is None else out.where((F.col("dataset_a") == dataset) & (F.col("dataset_b") == dataset))


def relationship_filters(detailed: DataFrame, kind: str | None = None, least: float | None = None, scope: str = "all", drop_same_page: bool = False, dataset: str | None = None) -> DataFrame:
    """By type, confidence, dataset (of fact A), and scope cross, same or all; unknown pages keep a pair."""
    a, b = F.col("fact_a"), F.col("fact_b")
    out = detailed if dataset is None else detailed.where(a["dataset_id"] == dataset)
    if kind:
        out = out.where(F.col("relationship_type") == kind)
    if least is not None:
        out = out.where(F.col("confidence") >= least)
    apart = (a["page_number"] != b["page_number"]) | a["page_number"].isNull() | b["page_number"].isNull()
    if scope == "cross":
        return out.where(a["document_id"] != b["document_id"])
    if scope == "same":
        return out.where((a["document_id"] == b["document_id"]) & (apart if drop_same_page else F.lit(True)))
    return out.where((a["document_id"] != b["document_id"]) | apart) if drop_same_page else out


def relationship_search(detailed: DataFrame, text: str, kind: str | None = None, least: float | None = None, scope: str = "all") -> DataFrame:
    """`relationship_filters` with a text that one of the file names, predicates, claims, entities or the
    reason holds, whatever its case."""
    fields = [F.col(f"fact_{k}")[c] for k in "ab" for c in ("filename", "predicate", "raw_claim", "subject")]
    fields += [F.col("reason")] if "reason" in detailed.columns else []
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.lower(f).contains(text.lower()), F.lit(False))
    return relationship_filters(detailed, kind, least, scope).where(hit)


def facts_by_dataset(facts: DataFrame, dataset: str | None = None) -> DataFrame:
    """All facts, or a dataset's, in order of creation."""
    return (facts if dataset is None else facts.where(F.col("dataset_id") == dataset)).orderBy("created_at", "id")


def document_search(filings: DataFrame, text: str) -> DataFrame:
    """Documents whose file name holds a text, whatever its case."""
    return filings.where(F.lower("filename").contains(text.lower()))


def storage_path(dataset: str = "dataset_id", document: str = "document_id", filename: str = "filename") -> Column:
    """Where a document's file is stored: dataset / document / base name."""
    return F.concat_ws("/", dataset, document, F.element_at(F.split(F.replace(F.col(filename), F.lit("\\"), F.lit("/")), "/"), -1))


def overview_totals(filings: DataFrame, facts: DataFrame, edges: DataFrame, pages: DataFrame) -> DataFrame:
    """One row with the numbers of documents, facts, relationships and pages."""
    one = lambda t, name: t.agg(F.count("*").alias(name))
    return one(filings, "documents").crossJoin(one(facts, "facts")).crossJoin(one(edges, "relationships")).crossJoin(one(pages, "pages"))


def document_fact_counts(selection: DataFrame, facts: DataFrame) -> DataFrame:
    """Selected documents with the number of their facts, 0 if there are none."""
    n = facts.groupBy("document_id").agg(F.count("*").alias("facts"))
    return selection.join(n, "document_id", "left").fillna(0, ["facts"])


def purge_same_page(detailed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): pairs of one page of one document go if both pages are known."""
    a, b = F.col("fact_a"), F.col("fact_b")
    same = F.coalesce((a["document_id"] == b["document_id"]) & (a["page_number"] == b["page_number"]), F.lit(False))
    return detailed.where(~same), detailed.where(same)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks, in order; a rule that is null counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


# What a fact can be.
FACT_TYPES = ("NUMERICAL", "SEMANTIC", "DERIVED")


def validate_facts(facts: DataFrame) -> DataFrame:
    """Adds the names of the rules that a fact breaks: it has a value as text, number or truth value, its period does not
    end before it starts, subject, predicate and claim are not empty, its confidence is from 0 to 1 and its
    type is one of FACT_TYPES. Value columns that the table lacks count as null."""
    given = lambda c: F.col(c).isNotNull() if c in facts.columns else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    dates = F.col("period_start").isNull() | F.col("period_end").isNull() | (F.col("period_end") >= F.col("period_start"))
    rules = {
        "value": given("value_text") | given("value_numeric") | given("value_boolean"), "period": dates, "subject": filled("subject"), "predicate": filled("predicate"),
        "claim": filled("raw_claim"), "confidence": F.col("confidence").between(0, 1), "type": F.col("fact_type").isin(*FACT_TYPES),
    }
    return facts.withColumn("violations", violations(rules))


def validate_evidence(evidence: DataFrame, text: str = "quote") -> DataFrame:
    """Text, offsets and (where there is one) extraction_confidence, which may be null."""
    rules = {"text": F.coalesce(strip(F.col(text)), F.lit("")) != "", "start": F.col("start_offset") >= 0, "order": F.col("end_offset") >= F.col("start_offset")}
    if "extraction_confidence" in evidence.columns:
        rules["confidence"] = F.col("extraction_confidence").isNull() | F.col("extraction_confidence").between(0, 1)
    return evidence.withColumn("violations", violations(rules))


def validate_relationships(edges: DataFrame) -> DataFrame:
    kinds = ("CORROBORATES", "CONTRADICTS", "CONTEXTUAL_DIFFERENCE", "RELATED", "UNCERTAIN")
    rules = {"order": F.col("fact_a_id") < F.col("fact_b_id"), "type": F.col("relationship_type").isin(*kinds), "confidence": F.col("confidence").between(0, 1), "reason": F.coalesce(F.col("reason") != "", F.lit(False))}
    return edges.withColumn("violations", violations(rules))


def validate_vectors(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    return vectors.withColumn("violations", violations({"dimension": F.size(column) == dim}))


def confidence_band(facts: DataFrame) -> DataFrame:
    """HIGH from 90, MEDIUM from 70, else LOW; by `score` if there is one, else by the confidence, else 85."""
    own = [F.col("score").cast("int")] if "score" in facts.columns else []
    score = F.coalesce(*own, F.round(F.col("confidence") * 100).cast("int"), F.lit(85))
    return facts.withColumn("band", F.when(score >= 90, "HIGH").when(score >= 70, "MEDIUM").otherwise("LOW"))


def dataset_counts(datasets: DataFrame, filings: DataFrame, facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents, facts and relationships (by fact A) of each dataset; empty test datasets are hidden."""
    docs = filings.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("documents"))
    n = facts.groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("facts"))
    owner = facts.select(F.col("id").alias("fact_a_id"), "dataset_id")
    pairs = edges.join(owner, "fact_a_id").groupBy(F.col("dataset_id").alias("id")).agg(F.count("*").alias("relationships"))
    out = datasets.join(docs, "id", "left").join(n, "id", "left").join(pairs, "id", "left").fillna(0, ["documents", "facts", "relationships"])
    return out.where(~(F.col("name").ilike("%test suite%") & (F.col("documents") == 0)))


def extracted_pages(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct page numbers per document that occur in evidence or chunks."""
    both = evidence.select("document_id", "page_number").unionByName(chunks.select("document_id", "page_number"))
    return both.groupBy("document_id").agg(F.array_sort(F.collect_set("page_number")).alias("pages"), F.countDistinct("page_number").alias("n_pages"))


def relationship_stats(detailed: DataFrame) -> DataFrame:
    """Counts by scope and type with totals over each (null is the total)."""
    scoped = detailed.withColumn("scope", F.when(F.col("fact_a.document_id") != F.col("fact_b.document_id"), "cross").otherwise("same"))
    return scoped.cube("scope", "relationship_type").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def best_case_per_type(detailed: DataFrame) -> DataFrame:
    """Per type the pair of highest confidence, then newest; pairs across documents first, but for UNCERTAIN."""
    cross = (F.col("fact_a.document_id") != F.col("fact_b.document_id")) & (F.col("relationship_type") != "UNCERTAIN")
    order = Window.partitionBy("relationship_type").orderBy(cross.desc(), F.desc("confidence"), F.desc("created_at"), "fact_a_id", "fact_b_id")
    return detailed.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def document_status(filings: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Documents, newest first, with page_count and file_size_bytes (from their metadata) or 0, and the
    status of the latest run; one that processes for over five minutes counts as failed."""
    latest = Window.partitionBy("document_id").orderBy(F.col("started_at").desc_nulls_first(), "id")
    last = runs.withColumn("rank", F.row_number().over(latest)).where("rank = 1")
    stale = (F.col("status") == "PROCESSING") & (F.col("started_at") < now - F.expr("INTERVAL 5 MINUTES"))
    shown = last.select("document_id", F.when(stale, "failed").otherwise(F.lower("status")).alias("run_status"))
    out = filings.join(shown, filings["id"] == shown["document_id"], "left").drop(shown["document_id"])
    size = F.coalesce(F.col("metadata")["file_size_bytes"].try_cast("long"), F.lit(0)) if "metadata" in filings.columns else F.lit(0)
    pages = F.coalesce("page_count", F.lit(0)) if "page_count" in filings.columns else F.lit(0)
    out = out.withColumns({"shown_status": F.coalesce("run_status", F.lit("ingested")), "page_count": pages.cast("int"), "file_size_bytes": size.cast("long")})
    return out.orderBy(F.desc("created_at"), "id") if "created_at" in filings.columns else out


def stale_runs(runs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Runs with those that process for too long turned to FAILED."""
    stale = (F.col("status") == "PROCESSING") & (F.col("started_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return runs.withColumns({"changed": stale, "completed_at": F.when(stale, now), "status": F.when(stale, "FAILED").otherwise(F.col("status"))})


def active_run(runs: DataFrame, now: Column, minutes: int = 5) -> DataFrame:
    """Latest processing run of each document that started within the last minutes."""
    live = runs.where((F.col("status") == "PROCESSING") & (F.col("started_at") >= now - F.expr(f"INTERVAL {minutes} MINUTES")))
    order = Window.partitionBy("document_id").orderBy(F.desc("started_at"), "id")
    return live.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def run_counters(runs: DataFrame, batches: DataFrame, status: str | None = None, now: Column | None = None) -> DataFrame:
    """Adds each run's batches (run_id and any of chunks, facts, rejected) to its counters chunks_created,
    facts_extracted and facts_rejected, and sets the status (and the end, if `now` is given) of these runs."""
    counters = {"chunks": "chunks_created", "facts": "facts_extracted", "rejected": "facts_rejected"}
    given = [c for c in counters if c in batches.columns]
    sums = batches.groupBy("run_id").agg(*[F.sum(c).alias(f"more_{c}") for c in given], F.lit(True).alias("hit"))
    out = runs.join(sums, runs["id"] == sums["run_id"], "left").drop("run_id")
    old = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in runs.columns else F.lit(0)
    out = out.withColumns({counters[c]: (old(counters[c]) + F.coalesce(f"more_{c}", F.lit(0))).cast("long") for c in given})
    if status is not None:
        out = out.withColumn("status", F.when(F.col("hit"), status).otherwise(F.col("status")))
    if now is not None:
        out = out.withColumn("completed_at", F.when(F.col("hit"), now).otherwise(F.col("completed_at") if "completed_at" in runs.columns else F.lit(None)))
    return out.drop("hit", *[f"more_{c}" for c in given])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str], latest: str | None = None, changed: bool = False, few: int = 1_000_000) -> DataFrame:
    """Inserts or replaces on `keys`; of a replaced row the `kept` columns (ids, creation) stay.

    Of new rows with equal keys one counts: the last by `latest` if it is given, of these (or of all) the
    largest by their other columns in order, so that a rerun takes the same one. A new value that is null
    replaces the old one like any other. Columns are those of `old`; what `new` lacks is null.
    changed: only the rows that are inserted or replaced. New rows are computed once then, and the keys of up to `few` are
    known to every task, so that of the old rows only those that are replaced are moved.
    """
    others = [F.to_json(F.struct(F.col(f"`{c}`"))).desc() if isinstance(new.schema[c].dataType, (MapType, VariantType)) else F.col(f"`{c}`").desc_nulls_last() for c in new.columns if c not in keys]
    order = ([F.col(latest).desc_nulls_last()] if latest is not None else []) + others
    if order:
        new = new.withColumn("__turn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__turn = 1").drop("__turn")
    else:
        new = new.dropDuplicates(keys)
    if changed:
        new = settled(new)
        named = new.select(*keys)
        old = old.join(F.broadcast(named) if new.count() <= few else named, keys, "left_semi")
    o, n = old.withColumn("__old", F.lit(True)).alias("o"), new.withColumn("__new", F.lit(True)).alias("n")
    joined = o.join(n, keys, "right" if changed else "full_outer")
    there = lambda c: F.col(f"n.{c}") if c in new.columns else F.lit(None)
    value = lambda c: F.when(F.col("__new") & ~(F.lit(c in kept) & F.coalesce("__old", F.lit(False))), there(c)).otherwise(F.col(f"o.{c}"))
    return joined.select(*keys, *[value(c).alias(c) for c in old.columns if c not in keys])


def delete_dataset(dataset: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What is left of each table once a dataset and all below it are gone.

    tables: filings and any of facts, pages, chunks, runs (by document), evidence, edges (by fact).
    Evidence of other documents that named one of the chunks that go stays, without the chunk.
    """
    filings = tables["filings"]
    documents = filings.where(F.col("dataset_id") == dataset).select(F.col("id").alias("gone"))
    rest = {"filings": filings.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset)))}
    without = lambda t, c, gone: t.join(gone, t[c] == gone["gone"], "left_anti")
    for name in ("pages", "chunks", "runs", "facts"):
        if name in tables:
            rest[name] = without(tables[name], "document_id", documents)
    if "facts" in tables:
        facts = tables["facts"]
        rest["facts"] = rest["facts"].where(~F.col("dataset_id").eqNullSafe(F.lit(dataset)))
        of_set = facts.where(F.col("dataset_id") == dataset).select(F.col("id").alias("gone"))
        of_document = facts.join(documents.withColumnRenamed("gone", "document_id"), "document_id", "left_semi").select(F.col("id").alias("gone"))
        gone = of_set.unionByName(of_document).distinct()
        if "evidence" in tables:
            rest["evidence"] = without(tables["evidence"], "fact_id", gone)
        if "edges" in tables:
            rest["edges"] = without(without(tables["edges"], "fact_a_id", gone), "fact_b_id", gone)
    if "evidence" in rest and "chunks" in tables and "chunk_id" in tables["evidence"].columns:
        chunks = tables["chunks"].join(documents.withColumnRenamed("gone", "document_id"), "document_id", "left_semi").select(F.col("id").alias("chunk_id"), F.lit(True).alias("lost")).distinct()
        marked = rest["evidence"].join(chunks, "chunk_id", "left")
        rest["evidence"] = marked.withColumn("chunk_id", F.when(F.col("lost").isNull(), F.col("chunk_id"))).select(*tables["evidence"].columns)
    return rest


def dedup_documents(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Marks files that are stored under the same dataset and hash or come earlier in the batch."""
    order = Window.partitionBy("dataset_id", "file_hash").orderBy("filename", "id")
    known = stored.select("dataset_id", "file_hash").distinct().withColumn("known", F.lit(True))
    out = new.withColumn("turn", F.row_number().over(order)).join(known, ["dataset_id", "file_hash"], "left")
    return out.withColumn("state", F.when(F.coalesce("known", F.lit(False)) | (F.col("turn") > 1), "ALREADY_EXISTS").otherwise("NEW")).drop("turn", "known")


def register_datasets(names: DataFrame, stored: DataFrame) -> DataFrame:
    """Datasets to create for names that no stored dataset has."""
    return names.select("name").distinct().join(stored.select("name"), "name", "left_anti").withColumn("description", F.concat(F.lit("Dataset: "), "name"))


def fact_confidence(facts: DataFrame, quote: str = "quote", page: str = "page_number", corroborated: Column | None = None) -> DataFrame:
    """score (0 to 100), level, signals, and counts of good and bad ones for each fact.

    signals: array<struct<signal, impact, status, description>> in a fixed order; status is pass, warn or
    fail. Where a column is empty or missing, others stand in: for the quote that of the first of `evidence` (an array of
    structs), then evidence_quote; for the page that of the first evidence, then metadata (a map); for time_period
    period_text, temporal_period, then metadata's period and time_period; for unit normalized_unit, then metadata; for scope metadata.
    A fact whose metadata has table_ambiguity or extraction_warning loses 15. Who is corroborated is for the caller to say.
    """
    unknown = ("none", "null", "unknown", "", "n/a")
    tidy = lambda c: F.coalesce(strip(F.lower(c.cast("string"))), F.lit(""))
    meta = F.col("metadata") if "metadata" in facts.columns else F.create_map().cast("map<string,string>")
    have = lambda c: nonblank(F.col(c).cast("string")) if c in facts.columns else F.lit(None).cast("string")
    kept = F.try_element_at("evidence", F.lit(1)) if "evidence" in facts.columns else None
    fields = {f.name for f in facts.schema["evidence"].dataType.elementType.fields} if kept is not None else set()
    of_evidence = lambda *names: [kept[c].cast("string") for c in names if c in fields]
    pages = [F.col(c).cast("string") for c in (page,) if c in facts.columns]
    said, paper = F.coalesce(have(quote), *of_evidence("quote"), have("evidence_quote")), F.coalesce(*pages, *of_evidence("page_number", "pdf_page_number"), meta["page_number"])
    length = F.char_length(F.coalesce(strip(said), F.lit("")))
    number = F.col("normalized_value_numeric").isNotNull() | F.col("value_numeric").isNotNull()
    digit = F.coalesce(F.coalesce(nonblank(F.col("raw_value_text")), F.col("raw_claim")).rlike(r"(?U)\d"), F.lit(False))
    unit, scope = F.coalesce(have("unit"), have("normalized_unit"), meta["unit"]), F.coalesce(have("scope"), meta["scope"])
    period = F.coalesce(have("time_period"), have("period_text"), have("temporal_period"), nonblank(meta["period"]), meta["time_period"])
    has_unit, has_period, has_scope = ~tidy(unit).isin(*unknown), ~tidy(period).isin(*unknown), ~tidy(scope).isin(*unknown, "actual")
    paged = F.coalesce(paper.try_cast("int") > 0, F.lit(False))
    on = lambda c: ~tidy(meta[c]).isin("", "false", "0")
    signal = lambda name, impact, status, text: F.struct(F.lit(name).alias("signal"), F.lit(impact).alias("impact"), F.lit(status).alias("status"), (text if isinstance(text, Column) else F.lit(text)).alias("description"))
    signals = F.array_compact(F.array(
        F.when(length >= 20, signal("quote", 20, "pass", "The source is quoted.")).when(length > 0, signal("short quote", 10, "warn", F.concat(F.lit("The quote has only "), length.cast("string"), F.lit(" characters."))))
        .otherwise(signal("no quote", -20, "fail", "Nothing is quoted from the source.")),
        F.when(paged, signal("page", 15, "pass", F.concat(F.lit("It stands on page "), paper, F.lit(".")))).otherwise(signal("no page", -10, "warn", "The page is not known.")),
        F.when(has_period, signal("period", 10, "pass", F.concat(F.lit("It is about "), period, F.lit(".")))).otherwise(signal("no period", -5, "warn", "No period is named.")),
        F.when(has_unit, signal("unit", 10, "pass", F.concat(F.lit("It is measured in "), unit, F.lit(".")))).when(number | digit, signal("no unit", -5, "warn", "A number has no unit.")).otherwise(signal("in words", 5, "pass", "A statement in words needs no unit.")),
        F.when(has_scope, signal("scope", 5, "pass", F.concat(F.lit("Its scope is "), scope, F.lit(".")))).otherwise(signal("no scope", 0, "warn", "The scope is not known.")),
        F.when(number, signal("number", 5, "pass", "The value is a number.")),
        F.when(corroborated if corroborated is not None else F.lit(False), signal("corroborated", 5, "pass", "Another fact agrees.")),
        F.when(on("table_ambiguity") | on("extraction_warning"), signal("table", -15, "fail", F.coalesce(nonblank(meta["extraction_warning"]), F.lit("The columns of a table are uncertain.")))),
    ))
    out = facts.withColumn("signals", signals)
    score = F.greatest(F.least(F.aggregate(F.transform("signals", lambda x: x["impact"]), F.lit(40), lambda s, x: s + x), F.lit(100)), F.lit(0))
    count = lambda good: F.size(F.filter("signals", lambda x: (x["status"] == "pass") == F.lit(good)))
    return out.withColumns({"score": score, "positive_count": count(True), "negative_count": count(False)}).withColumn("level", F.when(F.col("score") >= 80, "HIGH").when(F.col("score") >= 60, "MEDIUM").otherwise("LOW"))


def reset_runs(runs: DataFrame, documents: DataFrame, now: Column) -> DataFrame:
    """Runs with those of `documents` (document_id) that still process turned to FAILED."""
    named = documents.select("document_id").distinct().withColumn("named", F.lit(True))
    out = runs.join(named, "document_id", "left")
    hit = F.coalesce(F.col("named") & (F.col("status") == "PROCESSING"), F.lit(False))
    return out.withColumns({"changed": hit, "completed_at": F.when(hit, now), "status": F.when(hit, "FAILED").otherwise(F.col("status"))}).drop("named")


def update_columns(stored: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`stored` with `columns` from `updates` where it has the key; other rows keep theirs."""
    new = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("hit"))
    value = lambda c: F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c) if c in stored.columns else F.lit(None)).alias(c)
    return stored.join(new, key, "left").select(*[F.col(c) for c in stored.columns if c not in columns], *[value(c) for c in columns])


def document_detail(filings: DataFrame, facts: DataFrame, evidence: DataFrame, chunks: DataFrame, runs: DataFrame, now: Column, last: int = 10) -> DataFrame:
    """Status, counts of facts and chunks, extracted pages and the last runs (newest first) of each document."""
    n = lambda t, name: t.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name))
    pages = extracted_pages(evidence, chunks).withColumnRenamed("document_id", "id")
    order = Window.partitionBy("document_id").orderBy(F.col("started_at").desc_nulls_first(), "id")
    latest = runs.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= last)
    latest = latest.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.col("id").alias("run_id"), "status", "started_at"))).alias("runs"))
    out = document_status(filings, runs, now).join(n(facts, "facts"), "id", "left").join(n(chunks, "chunks"), "id", "left")
    return out.join(pages, "id", "left").join(latest, "id", "left").fillna(0, ["facts", "chunks", "n_pages"])
