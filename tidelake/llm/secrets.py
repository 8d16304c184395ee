"""Secret scans with an incremental ledger of blobs.  DataFrame functions throughout."""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALL, checkpointed, with_columns


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A pattern that is cheap to test and has to occur.
    hint: str
    #: A group whose match must have this length at least; no length: whole match.
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Letters in either case are spelled out, so that no engine's idea of case folding matters.
ASSIGN = "(" + "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The first three are the base; a greedy run with a least length is the same as a run that is dropped when it is shorter.
BASE_RULES = (
    Rule("assign", ASSIGN, ASSIGN, 2, 6),
    Rule("access", "AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", "[0-9a-f]{24,}", "[0-9a-f]{24}"),
)
MORE_RULES = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+", "eyJ"),
)
RULES = BASE_RULES + MORE_RULES


def _matches(rule: Rule, text: Column) -> Column:
    """For every match, the code points before it since the last match, those of the match, and whether it counts."""
    every = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    found = F.transform(
        F.arrays_zip(F.slice(between, 1, F.size(every)).alias("skip"), every.alias("all"), counts.alias("part")),
        lambda m: F.struct(F.length(m["skip"]).alias("skip"), F.length(m["all"]).alias("len"), (F.length(m["part"]) >= rule.least).alias("ok")),
    )
    hit = F.contains(text, F.lit(rule.hint)) if rule.hint.isalpha() or rule.hint == "PRIVATE KEY-----" else text.rlike(rule.hint)
    return F.when(hit, found)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text), one row for each blob -> (blob, spans): ``spans`` has (start, rank, kind, end), in that order, in code points, end exclusive.

    Leftmost matches of a rule that don't overlap; positions are running sums of the lengths
    between and of the matches.
    """
    by_rule = F.array(
        *[F.struct(F.lit(k).alias("rank"), F.lit(r.kind).alias("kind"), _matches(r, F.col("text")).alias("ms")) for k, r in enumerate(rules)],
        # So that each blob has a row: something that isn't a finding.
        F.struct(F.lit(len(rules)).alias("rank"), F.lit("").alias("kind"), F.array(F.struct(F.lit(0).alias("skip"), F.lit(0).alias("len"), F.lit(False).alias("ok"))).alias("ms")),
    )
    each = blobs.select("blob", F.explode(by_rule).alias("r")).where(F.size("r.ms") > 0).select("blob", "r.rank", "r.kind", F.posexplode("r.ms").alias("i", "m"))
    w = Window.partitionBy("blob", "rank").orderBy("i")
    end = F.sum(F.col("m.skip") + F.col("m.len")).over(w)
    return (
        each.withColumn("end", end)
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.when(F.col("m.ok"), F.struct((F.col("end") - F.col("m.len")).alias("start"), "rank", "kind", "end")))).alias("spans"))
    )


def version_of(rules: tuple[Rule, ...]) -> str:
    """A version that follows from the rules themselves."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def new_findings(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan what is new in ``versions`` (one row for every version of every path) and return (versions with blob, rows to append to the ledger).

    The ledger has a row (blob, rule_version, spans) for every text ever scanned under a version of the rules;
    blob is the text's SHA-256.  A text that many rows share is scanned once, one in the ledger under
    this rule version not at all.  Copies are put together where they are read, before texts are shuffled.  A
    version that isn't given is a hash of the rules, so findings of other rules are never taken for these.
    """
    version = version_of(rules) if rule_version is None else rule_version
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.sha2(text.cast("binary"), 256)
    texts = versions.select(blob.alias("blob"), text.alias("text"))
    if ledger is not None:
        texts = texts.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    texts = texts.dropDuplicates(["blob"])
    # Every rule's findings of a text, or an empty list, so that a text without any isn't scanned again.
    found = scan_blobs(texts, rules)
    new = found.select("blob", F.lit(version).alias("rule_version"), "spans")
    return versions.select(F.struct(*versions.columns).alias(ALL), blob.alias("blob")), checkpointed(new)


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions with blob, the ledger with what is new): only new rows are written, the earlier ledger stays as it is."""
    named, new = new_findings(versions, ledger, text_col, rules, rule_version)
    return named, new if ledger is None else ledger.unionByName(new)


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES, rule_version: str | None = None) -> DataFrame:
    """``docs`` with ``blob`` and ``secret_spans`` added: the ledger's findings joined back to every row.

    Null text: as empty.  Long texts are scanned whole.  Null ids pass through.  Repeated rows: one blob, each row kept.  Ties by start: in the order of the rules.
    Empty table: no rows.  Columns with these two names are replaced.
    """
    named, ledger = update_ledger(docs, ledger, text_col, rules, rule_version)
    version = version_of(rules) if rule_version is None else rule_version
    found = ledger.where(F.col("rule_version") == version).select(F.col("blob").alias("b"), "spans")
    return named.join(found, F.col("blob") == F.col("b")).select(*with_columns(docs, ALL, {"blob": F.col("blob"), "secret_spans": F.col("spans")}))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    spans = F.col("secret_spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["rank"] == k)).cast("long")
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)],
        F.sha2(_joined(F.filter(spans, lambda s: s["rank"] < len(BASE_RULES))).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = [
        f"SELECT doc_id, {k} AS rank, '{r.kind}' AS kind, string_split_regex(t, {quoted(r.pattern)}) AS b, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS e, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS c, {r.least} AS least FROM d"
        for k, r in enumerate(RULES)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
x AS (SELECT doc_id, rank, kind, least, unnest(range(len(e))) AS i, unnest(b[:len(e)]) AS skip, unnest(e) AS hit, unnest(c) AS part FROM m WHERE len(e) > 0),
p AS (SELECT *, CAST(sum(length(skip) + length(hit)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS BIGINT) AS stop FROM x),
s AS (SELECT doc_id, rank, stop - length(hit) AS start, kind || ':' || (stop - length(hit)) || ':' || stop AS span FROM p WHERE length(part) >= least)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""


SQL = _sql()
