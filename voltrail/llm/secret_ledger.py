"""Secret scans over a ledger of content-addressed texts, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text (its blob). The ledger holds, per
blob, which versions of which rules have been run and what they found. A scan takes one text per
blob, runs only the rule versions that the ledger does not hold for it, and returns rows to append.
Findings are then joined back to all paths that ever held the blob.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window

from voltrail.llm.common import whole_row

ASSIGN = "({})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]{{{},}})"


def _any_case(words: str) -> str:
    """A pattern for ASCII letters in either case, free of an engine's own notion of case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


NAMES = _any_case("password|passwd|secret|token|api_?key")


class Rule(NamedTuple):
    name: str
    version: int
    pattern: str
    #: Group whose length counts, and how many characters it needs.
    group: int
    least: int
    #: A pattern found in every text that has a finding.
    needs: str


#: In the order in which spans of one start are listed; the first three are the base rules.
RULES = (
    Rule("assign", 1, ASSIGN.format(NAMES, 1), 2, 6, ASSIGN.format(NAMES, 6)),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", 0, 20, "AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, "[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}"),
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\\s]+-----END [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ[A-Za-z0-9_-]{8}"),
    Rule("hosted_token", 1, "gh[oprsu]_[A-Za-z0-9]{36,}", 0, 1, "gh[oprsu]_[A-Za-z0-9]{36}"),
)
BASE = ("assign", "access", "hex")
LEDGER_SCHEMA = "blob binary, scanned array<string>, findings array<struct<start: int, rank: int, end: int, rule: string>>"


def blob(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _pair(rule: Rule) -> str:
    return f"{rule.name}:{rule.version}"


def _matches(rule: Rule, rank: int) -> Column:
    """Lengths of all matches of a rule and of the text before each, in text order."""
    lengths = F.arrays_zip(
        F.slice(F.split("text", rule.pattern, -1), F.lit(1), F.size(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)))).alias("before"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)).alias("part"))
    found = F.transform(lengths, lambda m, i: F.struct(
        F.lit(rank).alias("rank"), F.lit(rule.name).alias("rule"), i.alias("n"), F.length(m["before"]).alias("before"),
        F.length(m["match"]).alias("size"), (F.length(m["part"]) >= rule.least).alias("good")))
    wanted = F.array_contains("todo", _pair(rule)) & F.col("text").rlike(rule.needs)
    return F.when(wanted, found).otherwise(F.array().cast("array<struct<rank: int, rule: string, n: int, before: int, size: int, good: boolean>>"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (LEDGER_SCHEMA) for all blobs of `docs` with a rule version that the ledger lacks.

    Matches are leftmost and do not overlap, per rule; start and end count code points, end is
    exclusive. A null text is the empty blob. Texts that occur often are scanned once; other columns are not read, so ids may be
    null or repeated. An empty table gives no rows.
    """
    texts = docs.select(blob(text_column).alias("blob"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    texts = texts.groupBy("blob").agg(F.first("text").alias("text"))
    every = F.array(*[F.lit(_pair(r)) for r in rules])
    if ledger is None:
        unseen = texts.withColumn("todo", every)
    else:
        done = ledger.groupBy("blob").agg(F.flatten(F.collect_set("scanned")).alias("done"))
        unseen = texts.join(done, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("done", F.array().cast("array<string>"))))
    unseen = unseen.filter(F.size("todo") > 0)
    found = unseen.select("blob", "todo", F.explode_outer(F.concat(*[_matches(r, i) for i, r in enumerate(rules)])).alias("m"))
    upto = Window.partitionBy("blob", "m.rank").orderBy("m.n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.before") + F.col("m.size")).over(upto).cast("int")
    spans = found.withColumn("end", end).select("blob", "todo", F.when(F.col("m.good"), F.struct(
        (F.col("end") - F.col("m.size")).alias("start"), F.col("m.rank").alias("rank"), F.col("end").alias("end"),
        F.col("m.rule").alias("rule"))).alias("span"))
    return spans.groupBy("blob").agg(F.first("todo").alias("scanned"), F.array_sort(F.collect_list("span")).alias("findings"))


def by_path(docs: DataFrame, ledger: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, to: str = "findings") -> DataFrame:
    """The rows of `docs` with all findings of their text by the rule versions given, in column `to`.

    Every path is kept: repeated rows stay as often as they occur, ids are not read and may be null, a null text has the findings of the empty
    blob, an empty table stays empty. A column of the input that is called `to` gives way; no other name matters.
    """
    known = ledger.filter(F.size("findings") > 0).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    names = [r.name for r in rules]
    wanted = F.filter("findings", lambda f: f["rule"].isin(names))
    none = F.array().cast("array<struct<start: int, rank: int, end: int, rule: string>>")
    joined = docs.select(whole_row(docs).alias("row"), blob(text_column).alias("blob")).join(known, "blob", "left")
    return joined.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != to], F.coalesce(wanted, none).alias(to))


def listed(findings: str | Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["rule"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def redact(text: str, findings: str, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by a mark; spans that overlap or touch are replaced together."""
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def merge(acc, f):
        last = F.get(acc, F.size(acc) - 1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            last["start"].alias("start"), F.greatest(last["end"], f["end"]).alias("end"))))
        apart = F.concat(acc, F.array(F.struct(f["start"].alias("start"), f["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (f["start"] <= last["end"]), joined).otherwise(apart)

    spans = F.aggregate(findings, empty, merge)
    body = F.col(text)
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(
        body, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)) + 1,
        F.coalesce(F.get(spans, i)["start"], F.length(body)) - F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))))
    return F.when(F.size(findings) > 0, F.array_join(pieces, mark)).otherwise(body)
