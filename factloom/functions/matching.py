"""Rules for pairs of facts, as Column expressions over two struct columns `a` and `b`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import nonblank, strip

# Predicates too general to name a metric, and currencies.
GENERIC = ("amount", "value", "total", "figure", "number", "reported", "level")
CURRENCIES = ("INR", "USD", "EUR", "GBP")


def tokens(text: Column) -> Column:
    """Distinct lower-case words of a text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


def jaccard(x: Column, y: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(both / F.greatest(F.size(x) + F.size(y) - both, F.lit(1)))


def token_jaccard(x: Column, y: Column) -> Column:
    return jaccard(tokens(x), tokens(y))


def metric_tokens(predicate: Column, subject: Column) -> Column:
    """Tokens that name a fact's metric: the predicate's, with the subject's if it is general or empty,
    without fiscal years. Computed once per fact."""
    own = tokens(predicate)
    wide = F.when((F.size(own) == 0) | F.arrays_overlap(own, F.array(*[F.lit(g) for g in GENERIC])), F.array_union(own, tokens(subject))).otherwise(own)
    return F.filter(wide, lambda t: ~t.rlike(r"^fy\d{2,4}$"))


def _low(text: Column, default: str = "") -> Column:
    return strip(F.lower(F.coalesce(nonblank(text), F.lit(default))))


def _clean(text: Column) -> Column:
    """A text in lower case, empty if it says that nothing is known."""
    t = _low(text)
    return F.when(t.isin("none", "null", "unknown", "n/a"), "").otherwise(t)


def _audit_unit(x: Column) -> Column:
    return _clean(F.coalesce(nonblank(x["unit"]), nonblank(x["normalized_unit"])))


def _audit_number(x: Column) -> Column:
    return F.coalesce(F.nullif(x["normalized_value_numeric"], F.lit(0.0)), x["value_numeric"])


def _shown(x: Column) -> Column:
    return F.coalesce(nonblank(x["raw_value_text"]), nonblank(x["raw_claim"]), _audit_number(x).cast("string"), F.lit("N/A"))


#: What rules for pairs need of each fact alone.
TRAITS = {
    "predicate_text": lambda x: _low(x["predicate"]), "metric_tokens": lambda x: metric_tokens(x["predicate"], x["subject"]), "period_low": lambda x: _low(x["period_text"]),
    "known_unit": lambda x: F.coalesce(nonblank(x["normalized_unit"]), nonblank(x["unit"])), "status_low": lambda x: _low(x["status"], "actual"), "scope_low": lambda x: _low(x["scope"]),
    "predicate_tokens": lambda x: tokens(x["predicate"]), "subject_tokens": lambda x: tokens(x["subject"]), "claim_tokens": lambda x: tokens(x["raw_claim"]), "norm": lambda x: F.sqrt(_dot(x["embedding"], x["embedding"])),
    "entity": lambda x: _clean(x["subject"]), "predicate": lambda x: _clean(x["predicate"]), "period": lambda x: _clean(x["period_text"]), "scope": lambda x: _clean(x["scope"]), "unit": _audit_unit,
    "money": lambda x: _audit_unit(x).rlike(r"inr|rs|₹|rupee|usd|\$|eur|€"), "number": _audit_number, "shown": _shown, "shown_clean": lambda x: _clean(_shown(x)),
}


class Prepared:
    """A struct of a fact whose field `traits` holds what the rules would else work out for every pair of it."""

    def __init__(self, column: str):
        self.column = column

    def __getitem__(self, name: str) -> Column:
        return F.col(self.column)[name]


def traits(names: tuple[str, ...]) -> Column:
    """The field `traits` of a fact, from its columns."""
    columns = type("Columns", (), {"__getitem__": lambda _, c: F.col(c)})()
    return F.struct(*[TRAITS[n](columns).alias(n) for n in names]).alias("traits")


def trait(x: Column | Prepared, name: str) -> Column:
    return x["traits"][name] if isinstance(x, Prepared) else TRAITS[name](x)


def predicate_alignment(a: Column, b: Column) -> tuple[Column, Column]:
    """(aligned, score): equal predicates 1; else Jaccard of the metric tokens, aligned from 0.25 or
    if one set holds the other."""
    pa, pb = (trait(x, "predicate_text") for x in (a, b))
    ta, tb = (trait(x, "metric_tokens") for x in (a, b))
    equal = (pa != "") & (pa == pb)
    score = F.when(equal, 1.0).otherwise(jaccard(ta, tb))
    inside = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    some = (F.size(ta) > 0) & (F.size(tb) > 0)
    return equal | (some & ((score >= 0.25) | inside)), score


def _known(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")


def same_dataset(a: Column, b: Column) -> Column:
    return _known(a["dataset_id"], b["dataset_id"]) & a["dataset_id"].eqNullSafe(b["dataset_id"])


def non_self(a: Column, b: Column) -> Column:
    return _known(a["id"], b["id"]) & ~a["id"].eqNullSafe(b["id"])


def cross_document(a: Column, b: Column) -> Column:
    return _known(a["document_id"], b["document_id"]) & ~a["document_id"].eqNullSafe(b["document_id"])


def not_same_page(a: Column, b: Column) -> Column:
    """False only for one document's pages that are both known and equal."""
    same = _known(a["document_id"], b["document_id"]) & a["document_id"].eqNullSafe(b["document_id"])
    return ~(same & a["page_number"].isNotNull() & b["page_number"].isNotNull() & a["page_number"].eqNullSafe(b["page_number"]))


def temporal(a: Column, b: Column) -> tuple[Column, Column]:
    """(compatible, reason) from period ranges, else from the period texts."""
    known = a["period_start"].isNotNull() & a["period_end"].isNotNull() & b["period_start"].isNotNull() & b["period_end"].isNotNull()
    overlap = F.greatest(a["period_start"], b["period_start"]) <= F.least(a["period_end"], b["period_end"])
    same = (a["period_start"] == b["period_start"]) & (a["period_end"] == b["period_end"])
    ta, tb = (trait(x, "period_low") for x in (a, b))
    texts = (ta != "") & (tb != "")
    fiscal = ta.contains("fy") & tb.contains("fy") & (F.right(ta, F.lit(2)) == F.right(tb, F.lit(2)))
    reason = (
        F.when(known, F.when(overlap, F.when(same, "identical_period_range").otherwise("overlapping_period_range")).otherwise("disjoint_period_range"))
        .when(texts & (ta == tb), "identical_period_text").when(texts & fiscal, "compatible_fy_text").otherwise("unspecified_period")
    )
    return ~known | overlap, reason


def metric(a: Column, b: Column) -> tuple[Column, Column]:
    """(comparable, reason) of the units; currencies go together, a missing unit goes with any."""
    ua, ub = (trait(x, "known_unit") for x in (a, b))
    both = ua.isNotNull() & ub.isNotNull()
    equal = F.upper(ua) == F.upper(ub)
    money = F.upper(ua).isin(*CURRENCIES) & F.upper(ub).isin(*CURRENCIES)
    semantic = a["fact_type"].eqNullSafe(F.lit("SEMANTIC")) | b["fact_type"].eqNullSafe(F.lit("SEMANTIC"))
    reason = (
        F.when(both & equal, F.concat(F.lit("identical_unit_"), F.upper(ua))).when(both & money, "currency_conversion_needed")
        .when(both, F.concat(F.lit("incompatible_units_"), ua, F.lit("_vs_"), ub)).when(semantic, "semantic_fact").otherwise("unit_unspecified")
    )
    return ~both | equal | money, reason


def candidate(a: Column, b: Column, require_cross: bool = True, exclude_same_page: bool = True) -> tuple[Column, Column]:
    """(eligible, reasons): the reason of the first gate that fails, else tags in their order."""
    ok_m, why_m = metric(a, b)
    ok_t, why_t = temporal(a, b)
    aligned, score = predicate_alignment(a, b)
    fail = F.when(~same_dataset(a, b), "different_datasets").when(~non_self(a, b), "self_fact")
    if require_cross:
        fail = fail.when(~cross_document(a, b), "same_document")
    if exclude_same_page:
        fail = fail.when(~not_same_page(a, b), "same_page_same_document")
    fail = fail.when(~ok_m, why_m)
    tags = F.array_compact(F.array(F.when(cross_document(a, b), "cross_document"), why_m, F.when(ok_t, why_t), F.when(aligned, F.format_string("predicate_aligned_%.2f", score))))
    return fail.isNull(), F.when(fail.isNotNull(), F.array(fail)).otherwise(tags)


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_similarity(x: Column, y: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Cosine clamped to [0, 1]; 0 for missing vectors, unequal lengths and zero norms. norms: those of x and y, if they are known."""
    one, two = norms or (F.sqrt(_dot(x, x)), F.sqrt(_dot(y, y)))
    norm = one * two
    fine = x.isNotNull() & y.isNotNull() & (F.size(x) == F.size(y)) & (norm > 0)
    return F.when(fine, F.least(F.greatest(_dot(x, y) / norm, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)


def hybrid_score(a: Column, b: Column) -> Column:
    """0.65 vector + 0.20 predicate + 0.15 subject, or without vectors 0.50 claim + 0.30 predicate +
    0.20 subject, to four places."""
    alike = lambda c: jaccard(trait(a, c), trait(b, c))
    p, s = alike("predicate_tokens"), alike("subject_tokens")
    vectors = a["embedding"].isNotNull() & b["embedding"].isNotNull()
    score = F.when(vectors, 0.65 * cosine_similarity(a["embedding"], b["embedding"], (trait(a, "norm"), trait(b, "norm"))) + 0.20 * p + 0.15 * s)
    score = score.otherwise(0.50 * alike("claim_tokens") + 0.30 * p + 0.20 * s)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4)


def numeric_variance(x: Column, y: Column) -> Column:
    """|x - y| over the larger magnitude; 0 if equal, null if either is null."""
    return F.when(x == y, 0.0).otherwise(F.try_divide(F.abs(x - y), F.greatest(F.abs(x), F.abs(y))))


def _rules(a: Column, b: Column, tolerance: float) -> list[Column]:
    """Conditions of the rules, in their order."""
    ok_t, why_t = temporal(a, b)
    ok_m, _ = metric(a, b)
    aligned, _ = predicate_alignment(a, b)
    sa, sb = trait(a, "status_low"), trait(b, "status_low")
    planned = ("forecast", "target", "projection")
    x, y = a["normalized_value_numeric"], b["normalized_value_numeric"]
    v = numeric_variance(x, y)
    numbers = x.isNotNull() & y.isNotNull() & ok_m & aligned
    ca, cb = trait(a, "scope_low"), trait(b, "scope_low")
    scopes = (ca != "") & (cb != "") & (ca != cb)
    subjects = [F.lower(F.coalesce(f["subject"], F.lit(""))) for f in (a, b)]
    return [
        (sa != sb) & (sa.isin(*planned) | sb.isin(*planned)), numbers & ok_t & (v <= tolerance), numbers & ok_t & (v > 0.05) & scopes, numbers & ok_t & (v > 0.05),
        numbers & (why_t == "disjoint_period_range"), ~aligned & (subjects[0] == subjects[1]),
    ]


def rule_number(a: Column, b: Column, tolerance: float = 0.015) -> Column:
    """The number from 1 of the first rule that decides, or null."""
    out, *rest = _rules(a, b, tolerance)
    out = F.when(out, 1)
    for n, holds in enumerate(rest, 2):
        out = out.when(holds, n)
    return out


def rule_relationship(a: Column, b: Column, tolerance: float = 0.015, number: Column | None = None) -> Column:
    """struct<type, confidence, factors, reason> of the first rule that decides, or nulls. number: `rule_number`, if it is a column
    already; each field then costs only its own text."""
    number = rule_number(a, b, tolerance) if number is None else number
    sa, sb, ca, cb = trait(a, "status_low"), trait(b, "status_low"), trait(a, "scope_low"), trait(b, "scope_low")
    x, y = a["normalized_value_numeric"], b["normalized_value_numeric"]
    v = numeric_variance(x, y)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    percent = F.concat(F.format_string("%.2f", v * 100), F.lit(" %"))
    values = F.concat_ws(" and ", F.format_string("%.1f", x), F.format_string("%.1f", y))
    say = lambda *parts: F.concat(*[F.coalesce(p, F.lit("?")) if isinstance(p, Column) else F.lit(p) for p in parts])
    pt = lambda x, d: F.coalesce(nonblank(x["period_text"]), F.lit(d))
    told = (
        ("CONTEXTUAL_DIFFERENCE", 0.92, (F.lit("status_factor"), F.concat(sa, F.lit(" vs "), sb)), say("One fact is ", sa, ", the other ", sb, ".")),
        ("CORROBORATES", 0.96, (F.lit("variance"), text(F.round(v, 5)), F.lit("temporal_overlap"), F.lit("true")), say("The values ", values, " differ by ", percent, ", which rounding explains.")),
        ("CONTEXTUAL_DIFFERENCE", 0.90, (F.lit("scope_factor"), F.concat(ca, F.lit(" vs "), cb), F.lit("variance"), text(F.round(v, 4))), say("The scopes ", ca, " and ", cb, " explain a difference of ", percent, ".")),
        ("CONTRADICTS", 0.92, (F.lit("variance"), text(F.round(v, 4)), F.lit("period"), text(a["period_text"])), say("For one metric (", a["predicate"], ") and period the values ", values, " differ by ", percent, ", and nothing explains it.")),
        ("CONTEXTUAL_DIFFERENCE", 0.95, (F.lit("temporal_difference"), F.concat(pt(a, "Period A"), F.lit(" vs "), pt(b, "Period B"))), say("The periods differ: ", pt(a, "Period A"), " and ", pt(b, "Period B"), ".")),
        ("RELATED", 0.85, (F.lit("shared_subject"), text(a["subject"])), say("Both are about ", a["subject"], ", but measure ", a["predicate"], " and ", b["predicate"], ".")),
    )

    def field(i: int, make, kind: str) -> Column:
        out = F.when(number == 1, make(told[0][i]))
        for n, row in enumerate(told[1:], 2):
            out = out.when(number == n, make(row[i]))
        return out.cast(kind)

    return F.struct(
        field(0, F.lit, "string").alias("type"), field(1, F.lit, "double").alias("confidence"), field(2, lambda kv: F.create_map(*kv), "map<string,string>").alias("factors"), field(3, lambda c: c, "string").alias("reason"),
    )


def investigate(a: Column, b: Column, relationship: Column) -> dict[str, Column]:
    """The audit of a pair: checks, signed percent and difference, verdict."""
    pairs = {k: (trait(a, k), trait(b, k)) for k in ("entity", "predicate", "period", "scope", "unit")}
    inside = lambda p: (p[0] != "") & (p[1] != "") & (p[0].contains(p[1]) | p[1].contains(p[0]))
    pa, pb = pairs["period"]
    period, scope, unit = (pa != "") & (pa == pb), pairs["scope"][0] == pairs["scope"][1], pairs["unit"][0] == pairs["unit"][1]
    x, y = trait(a, "number"), trait(b, "number")
    percent = F.when(x.isNotNull() & y.isNotNull(), F.when(F.abs(x) > 1e-9, F.round((y - x) / F.greatest(F.abs(x), F.lit(1e-9)) * 100, 2)).when(F.abs(y) > 1e-9, 100.0).otherwise(0.0))
    close = (F.coalesce(F.abs(percent) <= 1.5, F.lit(False)) | (trait(a, "shown_clean") == trait(b, "shown_clean"))) & (period | (pa == "") | (pb == ""))
    units_differ = ~unit & (pairs["unit"][0] != "") & (pairs["unit"][1] != "")
    disjoint = ~period & (pa != "") & (pb != "")
    material = F.coalesce(F.abs(percent) > 1.5, F.lit(False)) & period & scope
    pick = lambda *v: F.when(close & units_differ, v[0]).when(close, v[1]).when(disjoint, v[2]).when(~scope, v[3]).when(material, v[4]).otherwise(v[5])
    same_document = F.coalesce(a["document_id"] == b["document_id"], F.lit(False))
    change = F.coalesce(F.format_string("%+.2f %%", percent), F.lit("n/a"))
    metric_name = F.coalesce(nonblank(a["predicate"]), nonblank(b["predicate"]), F.lit("the metric"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    named = lambda c: F.coalesce(nonblank(c), F.lit("not named"))
    explanation = pick(
        say("Both state one figure (", trait(a, "shown"), " and ", trait(b, "shown"), ") in different units: ", pairs["unit"][0], " and ", pairs["unit"][1], "."),
        F.when(percent.isNull(), say("Both state the same about ", metric_name, ".")).otherwise(say("Both agree on ", metric_name, " within rounding (", change, ").")),
        say("They are about different periods, ", pa, " and ", pb, "; the change of ", change, " is no contradiction."),
        say("They have different scopes, ", named(pairs["scope"][0]), " and ", named(pairs["scope"][1]), ", which explain the difference of ", change, "."),
        say("For ", metric_name, ", one period and one scope they differ by ", change, "; the sources should be checked."),
        F.when(percent.isNull(), "The statements differ in what they mean or in their context.").otherwise(say("They differ by ", change, ", but also in context or terms.")),
    )
    return {
        "entity_match": inside(pairs["entity"]), "predicate_match": inside(pairs["predicate"]), "period_match": period, "scope_match": scope, "unit_match": unit,
        "currency_match": trait(a, "money") == trait(b, "money"), "same_document": same_document,
        "same_page": same_document & F.coalesce(a["page_number"] == b["page_number"], F.lit(False)),
        "variance_percent": percent, "absolute_difference": F.round(y - x, 4),
        "verdict_type": pick("UNIT_DIFFERENCE", "CORROBORATED", "TEMPORAL_DIFFERENCE", "CONTEXTUAL_DIFFERENCE", "TRUE_CONTRADICTION", "CONTEXTUAL_DIFFERENCE"),
        "relationship": F.when(close, "CORROBORATES").when(disjoint | ~scope, "CONTEXTUAL_DIFFERENCE").when(material, "CONTRADICTS").otherwise(F.coalesce(relationship, F.lit("CONTEXTUAL_DIFFERENCE"))),
        "audit_confidence": pick(96, 98, 94, 97, 93, 88), "review_required": ~close & ~disjoint & scope & material, "explanation": explanation,
    }


def pair_flags(a: Column, b: Column, vector_similarity: Column | None = None) -> dict[str, Column]:
    """subject_match (overlap of 0.3 or more), predicate_match, temporal_match and vector_reason."""
    reason = F.lit(None).cast("string") if vector_similarity is None else F.when(vector_similarity.isNotNull(), F.format_string("vector_sim_%.2f", vector_similarity))
    return {"subject_match": jaccard(trait(a, "subject_tokens"), trait(b, "subject_tokens")) >= 0.3, "predicate_match": predicate_alignment(a, b)[0], "temporal_match": temporal(a, b)[0], "vector_reason": reason}


def card_variance(x: Column, y: Column, relationship: Column) -> Column:
    """What a pair's card says of its values: exact under half a percent, else the signed percent of
    the first; nothing for types that don't compare values."""
    gap, most = F.abs(y - x), F.greatest(F.abs(x), F.abs(y))
    percent = F.try_divide(y - x, F.abs(x)) * 100
    text = F.when((gap == 0) | (F.try_divide(gap, most) < 0.005), "Exact match (~0% variance)").otherwise(F.format_string("%s%.1f%% variance", F.when(percent > 0, "+").otherwise(""), percent))
    return F.when(F.upper(relationship).isin("CORROBORATES", "CONTRADICTS", "CONTEXTUAL_DIFFERENCE") & x.isNotNull() & y.isNotNull() & ((gap == 0) | percent.isNotNull()), text)


def telling_factors(factors: Column) -> Column:
    """Entries of a map of texts that say something."""
    return F.map_filter(factors, lambda _, v: F.coalesce(~F.lower(F.trim(v)).isin("", "none", "null", "n/a", "unspecified"), F.lit(False)))
