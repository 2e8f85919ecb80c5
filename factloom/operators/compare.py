"""Metric by metric comparison of two to five ordered documents; many comparisons in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions.normalize import nonblank, strip
from factloom.sources.tables import settled

from .facts import first_evidence


# Categories in the order in which they are shown.
CATEGORIES = ("INCREASED", "DECREASED", "CONTEXT_CHANGED", "UNCHANGED", "ADDED", "NOT_FOUND")


def tidy(text: Column) -> Column:
    """Lower case, single blanks, nothing around; null becomes empty."""
    return strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def title(text: Column) -> Column:
    """Every run of letters with a capital first, as in Revenue-From Operations."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0)), F.initcap), "")


def hundredths(x: Column) -> Column:
    """To two places as SQL's round does, half away from 0 on the hundredfold: a half that its quotient misses by the last bit still is one."""
    return F.round(x * 100) / 100


def _value(facts: DataFrame) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in ("normalized_value_numeric", "value_numeric") if c in facts.columns])


def metric_pick(facts: DataFrame, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """One fact per subject key, predicate key and `keys`: the first with a number by creation time,
    else the last. Blank predicates go."""
    f = facts.withColumns({"subject_key": tidy(F.col("subject")), "predicate_key": tidy(F.col("predicate"))}).where("predicate_key <> ''")
    none = _value(facts).isNull()
    order = Window.partitionBy("subject_key", "predicate_key", *keys).orderBy(none, F.when(~none, F.col("created_at")).asc(), F.when(none, F.col("created_at")).desc(), F.when(~none, F.col("id")).asc(), F.when(none, F.col("id")).desc())
    return f.withColumn("pick", F.row_number().over(order)).where("pick = 1").drop("pick")


def too_few_documents(selection: DataFrame) -> DataFrame:
    """(comparison_id, n_documents) of comparisons that name fewer than two documents: these are errors, and
    `compare_documents` gives no rows for them."""
    return selection.groupBy("comparison_id").agg(F.count_distinct("document_id").alias("n_documents")).where("n_documents < 2")


def compare_documents(facts: DataFrame, selection: DataFrame, evidence: DataFrame | None = None, few: int = 200_000) -> DataFrame:
    """Compares the first two documents of each comparison per metric; later ones add to the timeline.

    selection: (comparison_id, ordinal from 1, document_id, filename), of any size; up to `few` rows (some 150 bytes each) are known
    to every task; ordinals above 5 are left out. evidence
    (fact_id, quote, page_number, created_at, ...) gives points their quote and page. Returns a row per
    comparison and metric: subject, predicate, unit and scope as shown (of the first of its documents that has it),
    category, change (its label), percent and difference (of numbers, unless scopes differ), value_a,
    value_b, raw_a and raw_b (the claims), timeline (a point or null for each document: fact_id, document_id, filename,
    value, raw, unit, period, scope, page, quote) and position in the comparison: by category, size of the percent, predicate.
    """
    wanted = selection.where("ordinal <= 5")
    files = wanted.groupBy("comparison_id").agg(F.count("*").alias("n_documents"), F.max_by("filename", -F.abs(F.col("ordinal") - 2)).alias("second_file")).where("n_documents >= 2")
    chosen = settled(wanted.join(files, "comparison_id"))
    chosen = F.broadcast(chosen) if chosen.count() <= few else chosen  # facts meet it where they lie then
    have = lambda c, kind: F.col(c).cast(kind) if c in facts.columns else F.lit(None).cast(kind)
    noted = facts.withColumns({"p_page": have("page_number", "int"), "p_quote": F.lit(None).cast("string")})
    if evidence is not None:
        first = first_evidence(evidence).select(F.col("fact_id").alias("id"), "evidence_page", F.col("quote").alias("first_quote"))
        noted = noted.join(first, "id", "left").withColumns({"p_page": F.coalesce("evidence_page", "p_page"), "p_quote": F.col("first_quote")}).drop("evidence_page", "first_quote")
    picks = metric_pick(noted.join(chosen, "document_id"), ("comparison_id", "document_id"))
    point = F.struct(
        F.col("id").alias("fact_id"), "document_id", "filename", _value(facts).alias("value"), F.coalesce("raw_claim", F.lit("")).alias("raw"), F.coalesce(nonblank(have("normalized_unit", "string")), have("unit", "string")).alias("unit"),
        have("period_text", "string").alias("period"), have("scope", "string").alias("scope"), F.coalesce("p_page", F.lit(1)).alias("page"), F.col("p_quote").alias("quote"),
    )
    keys = ("comparison_id", "subject_key", "predicate_key")
    rows = picks.groupBy(*keys).agg(F.first("second_file").alias("second_file"), F.first("n_documents").alias("n"), F.map_from_entries(F.collect_list(F.struct(F.col("ordinal").cast("int"), point))).alias("at"))
    timeline = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.try_element_at("at", i))
    rows = rows.withColumn("timeline", timeline)
    rows = rows.withColumns({"a": F.try_element_at("at", F.lit(1)), "b": F.try_element_at("at", F.lit(2)), "sample": F.try_element_at(F.array_compact("timeline"), F.lit(1))})
    a, b, sample = F.col("a"), F.col("b"), F.col("sample")
    x, y, both = a["value"], b["value"], a.isNotNull() & b.isNotNull()
    old, new = tidy(a["scope"]), tidy(b["scope"])
    scopes = both & (old != "") & (new != "") & (old != new)
    numbers = both & ~scopes & x.isNotNull() & y.isNotNull()
    percent = F.when(numbers, F.when(F.abs(x) > 1e-9, hundredths((y - x) / F.greatest(F.abs(x), F.lit(1e-9)) * 100)).when(F.abs(y) > 1e-9, 100.0).otherwise(0.0))
    rows = rows.withColumns({"percent": percent, "difference": F.when(numbers, F.round(y - x, 4)), "in_pair": a.isNotNull() | b.isNotNull()})
    p, same = F.col("percent"), tidy(a["raw"]) == tidy(b["raw"])
    found = (  # the first that holds gives category and label
        (a.isNotNull() & b.isNull(), "NOT_FOUND", F.concat(F.lit("Not found in "), "second_file")), (a.isNull() & b.isNotNull(), "ADDED", F.concat(F.lit("Added in "), "second_file")),
        (~both, "UNCHANGED", F.lit("No change")), (scopes, "CONTEXT_CHANGED", F.concat(F.lit("Scope changed: "), title(old), F.lit(" → "), title(new))),
        (p > 0.5, "INCREASED", F.format_string("+%.2f%% ↑", p)), (p < -0.5, "DECREASED", F.format_string("%.2f%% ↓", p)), (numbers, "UNCHANGED", F.lit("0.00% (No change)")),
        (same, "UNCHANGED", F.lit("Identical claim")), (F.lit(True), "CONTEXT_CHANGED", F.lit("Qualitative claim variance")),
    )
    category = label = None
    for holds, name, text in found:
        category = F.when(holds, name) if category is None else category.when(holds, name)
        label = F.when(holds, text) if label is None else label.when(holds, text)
    subject = F.when(F.col("subject_key") == "", sample["filename"]).when((sample["raw"] != "") & (F.char_length("subject_key") < 40), title(F.col("subject_key"))).otherwise("Metric")
    out = rows.withColumns({
        "subject": subject, "predicate": title(F.col("predicate_key")), "unit": sample["unit"], "scope": sample["scope"], "category": category, "change": label,
        "value_a": x, "value_b": y, "raw_a": a["raw"], "raw_b": b["raw"],
    })
    out = out.withColumn("order_rank", F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")))
    order = Window.partitionBy("comparison_id").orderBy("order_rank", F.abs(F.coalesce("percent", F.lit(0.0))).desc(), "predicate", "subject_key", "predicate_key")
    return out.withColumn("position", F.row_number().over(order)).drop("at", "second_file", "a", "b", "sample")


def comparison_summary(compared: DataFrame) -> DataFrame:
    """Metrics of each comparison in all and by category; metrics of later documents alone are in the total only."""
    count = lambda c: F.count_if((F.col("category") == c) & F.col("in_pair")).alias(c.lower())
    return compared.groupBy("comparison_id").agg(F.count("*").alias("total"), *[count(c) for c in CATEGORIES])


def metric_filters(compared: DataFrame, category: str = "ALL", search: str = "") -> DataFrame:
    """Rows by category, CHANGES_ONLY, ADDED_OR_NOT_FOUND, and a text in subject, predicate or a raw value,
    whatever its case."""
    out = compared
    if category == "CHANGES_ONLY":
        out = out.where("category <> 'UNCHANGED'")
    elif category == "ADDED_OR_NOT_FOUND":
        out = out.where(F.col("category").isin("ADDED", "NOT_FOUND"))
    elif category != "ALL":
        out = out.where(F.col("category") == category)
    hit = F.lit(False)
    for c in ("predicate_key", "subject_key", "raw_a", "raw_b"):
        hit = hit | F.coalesce(F.lower(c).contains(search.lower()), F.lit(False))
    return out.where(hit)
