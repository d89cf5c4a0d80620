"""Secrets in texts: a trigram inverted index narrows the documents that each rule's expression reads.

A rule's regular expression is parsed once on the driver into a Boolean query: an OR of alternatives,
each an AND of trigrams that every match of the alternative must contain. The index holds postings
(trigram, document) for the trigrams the rules name; an alternative's postings are intersected by
counting its trigrams per document. Candidate documents are verified with the expression itself, whole
texts. A rule without mandatory trigrams reads every text. All of it is DataFrame functions.

Defined results: a null text is empty; a row without doc_id is matched with the other rows without
one, each on its own text; rows that repeat a doc_id are reported each; other columns are not read.
"""

from __future__ import annotations

import re._parser as sre  # the standard library's parse tree of an expression
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from haulcast.llm.common import stage


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = True


# The base rules in their given order. For hex, [0-9a-f]{16,} finds exactly the runs of
# [0-9a-f]+ that have 16 characters or more, since both begin where a run begins and take all of it.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("pat", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
]
MOST_STRINGS = 64  # exact strings kept while deriving a query


def _strings(node) -> set[str] | None:
    """All strings (lower case) that a parsed part can match, or None when they are too many."""
    found = {""}
    for op, arg in node:
        part = _part_strings(op, arg)
        if part is None or len(found) * len(part) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in part}
    return found


def _part_strings(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _strings(arg[-1])
    if op is sre.BRANCH:
        parts = [_strings(b) for b in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 2:
        inner = _strings(arg[2])
        if inner is not None:
            return {a for k in range(arg[0], arg[1] + 1) for a in _powers(inner, k)}
    return None


def _powers(strings: set[str], k: int) -> set[str]:
    out = {""}
    for _ in range(k):
        out = {a + b for a in out for b in strings}
    return out


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of trigrams that any match of ``pattern`` (as lower case) contains; [] if none is mandatory.

    Runs of parts with a bounded set of strings give one alternative per string; of all such runs the
    one with the longest shortest string is taken.
    """
    runs: list[set[str]] = [{""}]
    for op, arg in sre.parse(pattern):
        part = _part_strings(op, arg)
        if part is None or len(runs[-1]) * len(part) > MOST_STRINGS:
            runs.append({""})
            if part is not None and len(part) <= MOST_STRINGS:
                runs[-1] = part
        else:
            runs[-1] = {a + b for a in runs[-1] for b in part}
    best = max(runs, key=lambda r: min(map(len, r)))
    if min(map(len, best)) < 3:
        return []
    terms = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in best}
    # an alternative that asks for more than another adds nothing
    return sorted(sorted(t) for t in terms if not any(other < t for other in terms))


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc, kinds): documents that some indexed rule must verify, by intersecting postings."""
    spark = docs.sparkSession
    terms = [(r.kind, f"{r.kind}{n}", t, len(ts)) for r in rules for n, ts in enumerate(trigram_query(r.pattern)) for t in ts]
    wanted = sorted({t for _, _, t, _ in terms})
    text = F.lower(F.coalesce("text", F.lit("")))
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(t)) for t in wanted]), lambda t: t.isNotNull())
    postings = docs.select(F.col("doc_id").cast("long").alias("doc"), text.alias("low")).select("doc", F.explode(held).alias("trigram")).distinct()
    query = spark.createDataFrame(terms, "kind string, alternative string, trigram string, needed int")
    met = postings.join(F.broadcast(query), "trigram").groupBy("doc", "kind", "alternative", "needed").count()
    return met.filter("count = needed").groupBy("doc").agg(F.collect_set("kind").alias("kinds"))


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches that are long enough; code points, end exclusive."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(F.transform(whole, F.length), F.transform(counted, F.length), lambda w, c: F.struct(w.alias("w"), c.alias("c")))
    pieces = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(whole), F.lit(0))), lengths, lambda g, m: F.struct(F.length(g).alias("g"), m["w"].alias("w"), m["c"].alias("c")))
    empty = F.array().cast("array<struct<start:int,end:int,c:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc, p):
        start = acc["at"] + p["g"]
        end = start + p["w"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), p["c"].alias("c")))).alias("out"))

    found = F.aggregate(pieces, zero, step, lambda acc: acc["out"])
    kept = F.filter(found, lambda s: s["c"] >= rule.least)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def _labelled(order: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def scan(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Per row: doc_id, text and ``found``: array<struct<start, order, end, kind>> sorted by start and rule."""
    rules = RULES if rules is None else rules
    indexed = [r for r in rules if trigram_query(r.pattern)]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    if indexed:
        named = stage(candidates(docs, indexed))
        rows = rows.join(named, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    found = []
    for order, rule in enumerate(rules):
        # a scanned rule looks for any match before it splits the text
        test = F.array_contains("kinds", rule.kind) if rule in indexed else F.col("text").rlike(rule.pattern)
        each = F.transform(spans(F.col("text"), rule), _labelled(order, rule.kind))
        found.append(F.when(F.coalesce(test, F.lit(False)), each).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")))
    return rows.select("doc_id", "text", F.array_sort(F.concat(*found)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r.kind for r in RULES if r.base]
    found = scan(docs).select("doc_id", "found")
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("found", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(_joined(own), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))
