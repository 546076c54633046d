"""Which of two claims governs, and what a packet of claims is worth: authority scores, override rules, certificates, risk, confidence.

A claim is a struct column with id, authority (a key of RANKS), kind, status, artifact, role, sender, keys (array of strings), confidence,
ts and topic. Null fields fit no rule and add nothing; a null authority has rank 0.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .authority import BASE_RISK, OTHER_RISK, RANKS, lookup

#: Kinds of claims that set the scope, and those of a meeting that need an approval.
SCOPE_KINDS = ("scope_item", "exclusion", "customer_instruction", "constraint", "assumption")
SPOKEN_KINDS = ("scope_item", "exclusion", "customer_instruction", "decision", "meeting_commitment", "quantity")
#: Authorities that a meeting's claim never beats.
ABOVE_MEETINGS = ("contractual", "customer_current", "roster")
#: What a review status takes from a score, and the score of claims that cannot govern.
REVIEW_PENALTY = {"approved": -2.0, "needs_review": 4.0, "rejected": 1000.0}
NEVER = -1_000_000.0


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _points(*given: tuple[Column, float]) -> Column:
    out = F.lit(0.0)
    for holds, value in given:
        out = out + F.when(holds, value).otherwise(0.0)
    return out


def unapproved_speech(x: Column) -> Column:
    """A meeting's claim on the scope that nobody approved."""
    return _is((x["authority"] == "meeting") & x["kind"].isin(*SPOKEN_KINDS)) & ~_is(x["status"] == "approved")


def score(x: Column, recency: Column, current_customer: Column, family: Column, own_domain: str = "own.example") -> Column:
    """The authority score of claim x among others; recency (0 to 2) and current_customer (a current claim of the customer on the topic) tell of them."""
    mail = F.lower(F.coalesce(x["sender"], F.lit("")))
    outside = F.contains(mail, F.lit("@")) & ~F.contains(mail, F.lit(own_domain))
    author = _points((x["authority"] == "customer_current", 2.0), (_is(x["role"] == "customer") | outside, 1.0), (x["role"] == "internal", -0.5))
    placed = F.exists(F.coalesce(x["keys"], F.array().cast("array<string>")), lambda k: F.startswith(k, F.lit("site:")) | F.startswith(k, F.lit("device:")))
    roster, vendor = _is(x["authority"] == "roster"), _is(x["authority"] == "vendor")
    source = _points(
        (roster & (x["kind"] == "quantity") & placed, 1.5), (roster & x["artifact"].isin("xlsx", "csv"), 0.5),
        (vendor & x["artifact"].isin("xlsx", "csv", "txt"), 0.5), (vendor & (family == "vendor_mismatch"), 1.0),
    )
    penalty = _points(
        ((x["authority"] == "quoted_old") & current_customer, 40.0), (unapproved_speech(x), 12.0),
        (vendor & x["kind"].isin("scope_item", "exclusion", "customer_instruction") & family.isin("scope_inclusion", "scope_exclusion"), 50.0),
    )
    total = lookup(x["authority"], RANKS, 0) + recency + author + source - penalty - lookup(x["status"], REVIEW_PENALTY, 0.0)
    return F.when(_is(x["authority"] == "deleted") | _is(x["status"] == "rejected"), NEVER).otherwise(F.round(total, 4))


def may_govern(x: Column) -> Column:
    """False for deleted and rejected claims, and for a vendor's on the scope."""
    vendor_scope = (x["authority"] == "vendor") & x["kind"].isin(*SCOPE_KINDS)
    return ~(_is(x["authority"] == "deleted") | _is(x["status"] == "rejected") | _is(vendor_scope))


def decide(a: Column, b: Column, family: Column) -> Column:
    """struct(governing, losing, reason) of two claims: rules first, then score, confidence, newer time, smaller id.

    In a rule with both orders, a's is looked at first.
    """
    same = _is(a["topic"] == b["topic"])
    newer = lambda x, y: F.when((x["authority"] == y["authority"]) & (x["ts"] > y["ts"]), 2.0).otherwise(0.0)
    current = lambda x: same & _is(x["authority"] == "customer_current")
    score_a, score_b = score(a, newer(a, b), current(b), family), score(b, newer(b, a), current(a), family)
    is_ = lambda x, name: _is(x["authority"] == name)
    counted = family.isin("quantity_conflict", "vendor_mismatch") & (a["kind"] == "quantity") & (b["kind"] == "quantity")
    rules = [
        ("current_over_quoted", lambda x, y: same & is_(x, "customer_current") & is_(y, "quoted_old")),
        ("exclusion_over_roster", lambda x, y: same & is_(x, "customer_current") & (x["kind"] == "exclusion") & is_(y, "roster")),
        ("vendor_scope", lambda x, y: is_(y, "vendor") & y["kind"].isin(*SCOPE_KINDS)),
        ("roster_over_vendor", lambda x, y: counted & is_(x, "roster") & is_(y, "vendor")),
        ("written_over_meeting", lambda x, y: same & is_(y, "meeting") & x["authority"].isin(*ABOVE_MEETINGS)),
        ("vendor_quantity_over_meeting", lambda x, y: same & is_(y, "meeting") & is_(x, "vendor") & (_is(x["kind"] == "quantity") | _is(y["kind"] == "quantity"))),
    ]
    chain = []
    for name, beats in rules:
        # Where both claims are a vendor's on the scope, the first one loses.
        both = [(beats(b, a), False, name), (beats(a, b), True, name)] if name == "vendor_scope" else [(beats(a, b), True, name), (beats(b, a), False, name)]
        chain += both
    for name, x, y in (("score", score_a, score_b), ("confidence", a["confidence"], b["confidence"]), ("newer", a["ts"], b["ts"])):
        chain += [(x > y, True, name), (x < y, False, name)]
    chain += [(a["id"] <= b["id"], True, "id"), (F.lit(True), False, "id")]
    out = None
    for holds, first, name in chain:
        pick = F.struct((a if first else b)["id"].alias("governing"), (b if first else a)["id"].alias("losing"), F.lit(name).alias("reason"))
        out = F.when(_is(holds), pick) if out is None else out.when(_is(holds), pick)
    return out


def context(claims: DataFrame, packet: str) -> DataFrame:
    """claims (packet, x) with recency and current_customer within the packet: small aggregates that are joined back, no group is collected.

    A null packet is a packet; another claim of the same id counts as another one only if ids differ, as a claim is no context of itself.
    """
    at = F.unix_seconds(F.col("x.ts").cast("timestamp"))
    ends = claims.groupBy(F.col(packet).alias("p"), F.col("x.authority").alias("c")).agg(F.min(at).alias("first"), F.max(at).alias("last"))
    mine = claims.filter("x.authority = 'customer_current' and x.topic is not null").groupBy(F.col(packet).alias("q"), F.col("x.topic").alias("t")).agg(F.min("x.id").alias("low"), F.max("x.id").alias("high"))
    out = claims.join(ends, claims[packet].eqNullSafe(F.col("p")) & F.col("x.authority").eqNullSafe(F.col("c")), "left")
    out = out.join(mine, claims[packet].eqNullSafe(F.col("q")) & (F.col("x.topic") == F.col("t")), "left")
    span = F.col("last") - F.col("first")
    recency = F.when(span > 0, F.round(2.0 * (at - F.col("first")) / span, 4)).otherwise(0.0)
    others = F.col("low").isNotNull() & ((F.col("low") != F.col("x.id")) | (F.col("high") != F.col("x.id")))
    return out.select(*claims.columns, F.coalesce(recency, F.lit(0.0)).alias("recency"), others.alias("current_customer"))


def certificate(*, governed: Column, supported: Column, verified: Column, unsupported: Column, contested: Column, open_: Column, anchored: Column, tied: Column, unsure: Column) -> Column:
    """struct(completeness, ambiguity) of a packet by what holds of it; nulls do not hold."""
    full = F.when(_is(governed) & _is(supported) & _is(verified), 1.0).otherwise(0.8)
    complete = F.round(full - _points((_is(contested) & _is(open_), 0.2), (_is(unsupported), 0.15), (~_is(anchored), 0.2)), 4)
    complete = F.least(F.greatest(complete, F.lit(0.0)), F.lit(1.0))
    unclear = F.round(1.0 - complete + _points((tied, 0.2), (unsure, 0.2)), 4)
    return F.struct(complete.alias("completeness"), F.least(F.greatest(unclear, F.lit(0.0)), F.lit(1.0)).alias("ambiguity"))


def packet_confidence(best: Column, contested: Column) -> Column:
    """The best governing confidence, 0.15 less if contested, between 0 and 1; 0 without a governing claim."""
    return F.coalesce(F.least(F.greatest(best - F.when(contested, 0.15).otherwise(0.0), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))


#: Families by their entry in BASE_RISK.
FAMILY_RISK = {
    "scope_exclusion": "exclusion", "vendor_mismatch": "mismatch", "quantity_conflict": "conflict", "customer_override": "override", "site_access": "access",
    "missing_info": "missing", "meeting_decision": "decision", "action_item": "action", "scope_inclusion": "inclusion",
}
#: What a flag adds to a packet's risk, and flags that add once to one family.
FLAG_RISK = {"contradiction_present": 0.10, "customer_current_override": 0.10, "exclusion_present": 0.10, "vendor_scope_quantity_mismatch": 0.15, "roster_vendor_aggregate_mismatch": 0.08, "low_confidence_atom": 0.05}
POWER_FLAGS = ("power_vendor_scope_mismatch", "scope_pollution_vendor_vs_written_exclusion", "vendor_scope_pollution_candidate")
BLOCKING_FLAGS = ("raceway_conduit_pathway_missing_info", "certification_testing_export_missing_info", "missing_info_access_gate", "site_access_gate_unknown")


def packet_risk(family: Column, status: Column, flags: Column, generic_action: Column, contested: Column, completeness: Column, ambiguity: Column) -> Column:
    """A packet's risk from 0 to 1 by its family, status, flags and certificate, in four places. Null flags are none."""
    marks = F.coalesce(flags, F.array().cast("array<string>"))
    has = lambda *names: F.arrays_overlap(marks, F.array(*map(F.lit, names)))
    out = lookup(family, {f: BASE_RISK[b] for f, b in FAMILY_RISK.items()}, OTHER_RISK)
    out = out + _points((status == "needs_review", 0.10), *((has(f), v) for f, v in FLAG_RISK.items()), (family.isin("quantity_conflict", "vendor_mismatch"), 0.04))
    out = out + _points(((family == "scope_exclusion") & has(*POWER_FLAGS), 0.10), ((family == "missing_info") & has(*BLOCKING_FLAGS), 0.08), (family == "site_access", 0.03))
    out = F.when(_is(family == "action_item") & _is(generic_action), F.greatest(out - 0.14, F.lit(0.0))).otherwise(out)
    out = out + _points((ambiguity > 0.5, 0.10), ((completeness > 0.9) & ~_is(contested), -0.10))
    return F.least(F.greatest(F.round(out, 4), F.lit(0.0)), F.lit(1.0))


#: Parts of file names and the tier that the first of them found gives; others are supporting evidence.
TIER_NAMES = {
    "contractual_final": ("sow", "statement of work", "executed", "signed", "purchase order", "contract", "change order"),
    "approved_scope": ("rfp", "rfq", "rfb", "specifications", "spec", "requirements", "scope", "design", "approved"),
}


def artifact_tier(name: Column) -> Column:
    """The tier of a file by its name; a null name is supporting evidence."""
    flat = F.translate(F.lower(F.coalesce(name, F.lit(""))), "_-", "  ")
    out = F.when(F.lit(False), "")
    for tier, parts in TIER_NAMES.items():
        for p in parts:
            out = out.when(F.contains(flat, F.lit(p)), tier)
    return out.otherwise("supporting_evidence")


#: What a tier adds to a claim's confidence.
TIER_BONUS = {"contractual_final": 0.20, "approved_scope": 0.10, "supporting_evidence": 0.05}


def confidence(keyed: Column, completeness: Column, corroborated: Column, contested: Column, tier: Column, verified: Column, length: Column, sourced: Column) -> Column:
    """A claim's confidence from its signals, between 0.05 and 0.99, in three places; null signals add nothing, a null length is 0."""
    n = F.coalesce(length, F.lit(0))
    out = 0.5 + 0.15 * F.coalesce(completeness, F.lit(0.0)) + lookup(tier, TIER_BONUS, 0.0)
    out = out + _points((keyed, 0.15), (corroborated, 0.10), (verified, 0.10), (contested, -0.10), (n >= 80, 0.05), (n < 20, -0.10), (~_is(sourced), -0.05))
    return F.round(F.least(F.greatest(out, F.lit(0.05)), F.lit(0.99)), 3)


def source_conflicts(claims: DataFrame, key: str, value: str, tier: str) -> DataFrame:
    """key, n_values, severity of keys with more than one value and more than one tier; a null key is a key, null values and tiers count as none."""
    of = claims.groupBy(key).agg(F.countDistinct(value).alias("n_values"), F.countDistinct(tier).alias("n"), *(F.max((F.col(tier) == name).cast("int")).alias(name) for name in TIER_NAMES))
    severity = F.when(F.col("contractual_final") == 1, "high").when(F.col("approved_scope") == 1, "medium").otherwise("low")
    return of.filter("n_values > 1 and n > 1").select(key, "n_values", severity.alias("severity"))


def route(scores: DataFrame, of: str, pack: str, score_column: str) -> DataFrame:
    """of, pack, confidence: the best pack if its score is 2 or more and 1 or more above the next, else nulls; ties go to the smaller pack.

    The number of packs, which a configuration names, bounds a group.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col(score_column)).alias("s"), F.col(pack).alias("pack"))))
    top = scores.filter(F.col(score_column).isNotNull()).groupBy(of).agg(ranked.alias("r")).select(of, F.col("r")[0].alias("a"), -F.col("r")[0]["s"] + F.when(F.size("r") > 1, F.get("r", F.lit(1))["s"]).otherwise(0.0), F.col("r")).toDF(of, "a", "margin", "r")
    sure = (-F.col("a.s") >= 2) & (F.col("margin") >= 1)
    return top.select(of, F.when(sure, F.col("a.pack")).alias("pack"), F.when(sure, F.round(F.least(F.lit(0.85), 0.55 - 0.05 * F.col("a.s")), 4)).alias("confidence"))


def scope_dimension(hint: Column, text: Column) -> Column:
    """A claim's bid scope: the hint, else alternate or base by its text, else unspecified; nulls are empty."""
    given, flat = F.trim(F.regexp_replace(F.lower(F.coalesce(hint, F.lit(""))), r"\s+", " ")), F.lower(F.coalesce(text, F.lit("")))
    out = F.when(given != "", given).when(F.regexp_like(flat, F.lit(r"\b(add\s*alt|add\s*alternate|alternate|option|owner\s*allowance)\b")), "alternate")
    return out.when(F.regexp_like(flat, F.lit(r"\b(base|base\s*bid)\b")), "base").otherwise("unspecified")


def scopes_agree(a: Column, b: Column) -> Column:
    """Equal dimensions, or one is unspecified."""
    return (a == b) | (a == "unspecified") | (b == "unspecified")
