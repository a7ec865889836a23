"""Secret scans over an incremental blob ledger: DataFrame and SQL functions only.

Every version of every text is content-addressed by its SHA-256. The ledger remembers which
(blob, rule version) pairs have been scanned, with what was found; each rule has a version
of its own, so a changed or added rule is scanned alone. A scan reads a blob only for the
rules that are new to it, once however many paths hold it, and findings are joined back to
all paths. Copies are combined before the shuffle.

Spans are code points of the text, end exclusive. ``split`` at a rule's matches gives the
texts between them, so offsets follow from lengths without a user-defined function.

Edge cases: a null text is the empty blob; repeated rows are paths of one blob; a null path
is kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern is a Java expression; group and least: length that a match's group needs; the version names its revision."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1
    base: bool = False


BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, base=True),
    Rule("hex", r"[0-9a-f]+", 0, 16, base=True),
]
# Public formats of credentials.
MORE = [
    Rule("privkey", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*", 0, 23),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
]
RULES = BASE + MORE
SPAN = "array<struct<start:int,k:int,end:int>>"
#: As the ledger keeps them: by the rule's version, which outlives its place in a list.
KEPT = "array<struct<start:int,rule:string,end:int>>"


def rule_version(rule: Rule) -> str:
    """Names a rule as it is: any change of it makes blobs unseen by it."""
    return f"{rule.kind}@{hashlib.sha256(repr(rule).encode()).hexdigest()[:12]}"


def spans_of(text: Column, rule: Rule, place: int) -> Column:
    """array<struct(start, k, end)> of a rule's matches, leftmost and not overlapping."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole

    def located(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
        sizes = F.transform(found, F.length)
        matches = F.zip_with(sizes, F.transform(measured, F.length), lambda size, held: F.struct(size.alias("size"), held.alias("held")))
        pairs = F.zip_with(gaps, matches, lambda gap, m: F.struct(gap.alias("gap"), m["size"].alias("size"), m["held"].alias("held")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["gap"]
            end = start + F.coalesce(x["size"], F.lit(0))
            span = F.struct(start.alias("start"), F.lit(place).alias("k"), end.alias("end"))
            return F.struct(end.alias("at"), F.when(x["held"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(pairs, zero, step, lambda acc: acc["out"])

    long_enough = F.exists(measured, lambda m: F.length(m) >= rule.least)
    return F.when(long_enough, located(whole)).otherwise(F.array().cast(SPAN))


def versions(docs: DataFrame, path_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(path, blob, text) of every version."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), F.sha2(text, 256).alias("blob"), text.alias("text"))


def unseen(held: DataFrame, ledger: DataFrame, now: Column) -> DataFrame:
    """(blob, missing): blobs of ``held`` and the rule versions of ``now`` under which the ledger has not seen them."""
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("versions")).alias("seen"))
    missing = F.array_except(now, F.coalesce("seen", F.array().cast("array<string>")))
    return held.select("blob").distinct().join(seen, "blob", "left").select("blob", missing.alias("missing")).where(F.size("missing") > 0)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] | None = None, path_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings of every path, ledger to hand to the next scan).

    findings: path, blob, spans. ledger: (blob, versions, spans), a row for each blob and
    scan of it: the rule versions that were scanned then, and what they found. Pairs of the
    given ledger are not scanned again; it may hold rules that are no longer in use.
    """
    rules = RULES if rules is None else rules
    names = [rule_version(r) for r in rules]
    now = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    held = versions(docs, path_col, text_col)
    blobs = held.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("missing", now)
    else:
        blobs = blobs.join(saved(unseen(held, ledger, now), "secret-unseen"), "blob")
    none = F.array().cast(SPAN)
    new = [spans_of(F.col("text"), r, i) for i, r in enumerate(rules)]
    new = [F.when(F.array_contains("missing", n), x).otherwise(none) for n, x in zip(names, new)] if ledger is not None else new
    kept = F.transform(F.flatten(F.array(*new)) if new else none, lambda s: F.struct(s["start"].alias("start"), F.get(now, s["k"]).alias("rule"), s["end"].alias("end")))
    scanned = saved(blobs.select("blob", F.col("missing").alias("versions"), kept.cast(KEPT).alias("spans")), "secret-ledger")
    book = scanned if ledger is None else ledger.select("blob", "versions", "spans").unionByName(scanned)
    placed = F.transform(F.filter("spans", lambda s: F.array_contains(now, s["rule"])), lambda s: F.struct(s["start"].alias("start"), (F.array_position(now, s["rule"]) - 1).cast("int").alias("k"), s["end"].alias("end")))
    found = book.select("blob", placed.alias("spans")).where(F.size("spans") > 0)
    found = saved(found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "secret-found")  # so that a blob of many paths can be split in the join
    paths = held.select("path", "blob").join(found, "blob", "left")
    return paths.select("path", "blob", F.coalesce("spans", none).alias("spans")), book


def listed(spans: Column, rules: list[Rule]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat(kinds[s["k"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, rules: list[Rule] | None = None) -> Column:
    """The text with every span replaced by [kind]; of overlapping spans the first names the piece."""
    kinds = F.array(*[F.lit(r.kind) for r in (RULES if rules is None else rules)])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), kinds[s["k"]], F.lit("]"))
        out = F.when(s["start"] < acc["at"], acc["out"]).otherwise(fresh)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
