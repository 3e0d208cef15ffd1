"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong finds are reported wherever they stand: assignments, access key identifiers and
long hexadecimal strings. Weak parts are strings that mean nothing alone: words shaped
like an access identifier, like a secret, or like an endpoint. A weak part is reported
only if parts that complete it (an identifier and a secret, with or without an endpoint)
lie within SCOPE code points of it. The parts, few to a text, are
sorted by place, and the interval join reads for each part the nearest one
of each other role before and after it from running maxima and minima over windows; no
pairs are formed, so a text with many parts costs a sort.

Places come from cutting: what a pattern matches and what lies between the matches
alternate, so the running sum of their lengths has all offsets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxwise.llm.common import checkpointed, text_table

#: Code points between complementary parts at most.
SCOPE = 200

#: Strong patterns, in the order of the kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The same matches as AKIA[A-Z0-9]+ of 20 characters or more and [0-9a-f]+ of 24 or more: a
#: run is as long as it is, from wherever it is entered.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")

#: Weak patterns, by kind and role: nothing that they match is a find alone.
WEAK = (
    ("weak_id", "id", r"(?i:client|access|account|user|key)_?id[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9_-]{6,}|A[SG]IA[A-Z0-9]{16,}"),
    ("weak_secret", "secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]{0,60}[0-9])(?=[A-Za-z0-9+/_-]{0,60}[a-z])(?=[A-Za-z0-9+/_-]{0,60}[A-Z])[A-Za-z0-9+/_-]{20,64}={0,2}(?![A-Za-z0-9+/=_-])"),
    ("weak_endpoint", "endpoint", r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/-]{4,}"),
)
#: Weak kinds that a part of the role on the left completes.
COMPLETES = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
ROLES = {"assign": "secret", "access": "id", "hex": "secret"} | {kind: role for kind, role, _ in WEAK}
ALL_KINDS = (*KINDS, *(kind for kind, _, _ in WEAK))


def _may(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match of the kind passes."""
    if kind == "assign":
        return reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in ("passw", "secret", "token", "apikey", "api_key")))
    if kind == "access":
        return F.contains(text, F.lit("AKIA"))
    if kind == "weak_id":
        return F.rlike(text, F.lit(r"""[iI][dD]["']?\x20*[:=]|A[SG]IA[A-Z0-9]{16}"""))
    if kind == "weak_endpoint":
        return F.contains(text, F.lit("://"))
    return F.rlike(text, F.lit(HEX if kind == "hex" else "[A-Za-z0-9+/_-]{20}"))


def _spans(text: Column, kind: str, pattern: str, value: int = 0) -> Column:
    """Spans (start, end) of the matches, leftmost and not overlapping, in code points; with `value`, of those whose group 2 is as long."""
    none = "cast(array() as array<struct<start:int,end:int>>)"
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        counts = F.length(F.regexp_extract(x["match"], pattern, 2)) >= value if value else F.lit(True)
        spans = F.when(counts, F.array_append(done["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(done["spans"])
        return F.when(x["match"].isNull(), done).otherwise(F.struct(end.alias("at"), spans.alias("spans")))

    found = F.aggregate(parts, F.expr(f"named_struct('at', 0, 'spans', {none})"), step, lambda done: done["spans"])
    return F.when(_may(text, kind), found).otherwise(F.expr(none))


def _joined(spans: Column) -> Column:
    """kind:start:end of sorted spans (start, place of the kind, end), comma-joined."""
    kinds = F.array(*(F.lit(k) for k in ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _tagged(kinds: tuple[str, ...]) -> Column:
    """All spans of some kinds, each with its kind's place, as one array."""
    tag = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(ALL_KINDS.index(k)).alias("kind"), s["end"].alias("end")))
    return F.concat(*(tag(k) for k in kinds))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, strong and linked.

    strong and linked are arrays of (start, kind, end), sorted; kind is a place in
    ALL_KINDS. A null or empty text has no spans. Rows that repeat are scanned each,
    and a null doc_id stays null; an empty table gives no rows. Columns other than
    doc_id and text are not read. Weak parts that overlap a strong find are no parts.
    """
    text = F.col("text")
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX} | {kind: pattern for kind, _, pattern in WEAK}
    found = text_table(docs).select("doc_id", *(_spans(text, k, p, 6 if k == "assign" else 0).alias(k) for k, p in patterns.items()))
    weak = F.sort_array(_tagged(ALL_KINDS[len(KINDS) :]))
    rows = checkpointed(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sort_array(_tagged(KINDS)).alias("strong"), weak.alias("weak")))

    role = F.element_at(F.array(*(F.lit(ROLES[k]) for k in ALL_KINDS)), F.col("kind") + 1)
    parts = rows.where("size(weak) > 0").select("row", F.inline(F.concat("strong", "weak"))).withColumn("role", role).withColumn("weak", F.col("kind") >= len(KINDS))
    # Both frames grow from their start, so that every part is added once: what lies after is what lies before in the reverse order.
    before = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    strong_end = F.max(F.when(~F.col("weak"), F.col("end")))
    strong_start = F.min(F.when(~F.col("weak"), F.col("start")))
    free = parts.withColumn("covered", F.col("weak") & (F.coalesce(strong_end.over(before) > F.col("start"), F.lit(False)) | F.coalesce(strong_start.over(after) < F.col("end"), F.lit(False)))).where("not covered")
    near = free
    for r in COMPLETES:
        own = F.col("role") == r
        gap_before = F.col("start") - F.max(F.when(own, F.col("end"))).over(before)
        gap_after = F.min(F.when(own, F.col("start"))).over(after) - F.col("end")
        near = near.withColumn(f"near_{r}", F.coalesce(F.least(gap_before, gap_after) <= SCOPE, F.lit(False)))
    complete = reduce(Column.__or__, ((F.col("role") == r) & reduce(Column.__or__, (F.col(f"near_{x}") for x in others)) for r, others in COMPLETES.items()))
    linked = near.where(F.col("weak") & complete).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("linked"))
    return rows.join(linked, "row", "left").select("doc_id", *(f"n_{k}" for k in KINDS), "strong", F.coalesce("linked", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")).alias("linked"))


def digests(found: DataFrame) -> DataFrame:
    """The rows of scan() with base_sha256 of the strong spans and spans, all of them, as text."""
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(_joined(F.col("strong")), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("strong", "linked"))).alias("spans"))
