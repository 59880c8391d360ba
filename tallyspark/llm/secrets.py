"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its UTF-8 bytes. The ledger is a Parquet table of what was scanned: a row has a
blob, the rules it was scanned with, each as name@version, and the spans found. A scan reads only pairs of blob and rule version
that the ledger doesn't have, appends them, and joins the findings of every blob back to all versions and paths that hold it. So a text
is scanned once however many copies, paths and versions have it, and again only when a rule gets a new version.

Rows are joined by blob, never by text. A text is shuffled at most once to its blob, copies within a task meeting before that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, read

_ANY = re.I | re.A


@dataclass(frozen=True)
class Rule:
    """A pattern, leftmost and non-overlapping; a match counts if its group has at least `least` characters. `hints`: words of which a
    text in lower case must have one, so that most texts are left at once."""

    name: str
    version: int
    pattern: re.Pattern
    hints: tuple[str, ...] = ()
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"

    def spans(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.hints and not any(h in lower for h in self.hints):
            return []
        return [m.span() for m in self.pattern.finditer(text) if len(m.group(self.group)) >= self.least]


_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
#: Fixed patterns, whose spans always stay.
BASE = (
    Rule("assign", 1, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ANY), _NAMES, 2, 8),
    Rule("access", 1, re.compile("AKIA[A-Z0-9]+"), ("akia",), 0, 16),
    Rule("hex", 1, re.compile("[0-9a-f]{32,}+"), (), 0, 32),
)
#: What the base misses: key blocks, web tokens, keys with their issuer's prefix, credentials in addresses and headers, other names.
ADDED = (
    Rule("private_key", 1, re.compile(r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END (?:[A-Z0-9]{1,20} ){0,4}PRIVATE KEY-----)?"), ("private key",)),
    Rule("web_token", 1, re.compile(r"(?<![0-9A-Za-z_-])eyJ[0-9A-Za-z_-]{6,}+\.eyJ[0-9A-Za-z_-]{6,}+\.[0-9A-Za-z_-]*+"), ("eyj",)),
    Rule("session_key", 1, re.compile(r"(?<![0-9A-Za-z])ASIA[A-Z0-9]{12,}+"), ("asia",)),
    Rule("issued", 1, re.compile(r"(?<![0-9A-Za-z])(?:gh[oprsu]_[0-9A-Za-z]{30,}+|github_pat_[0-9A-Za-z_]{30,}+|glpat-[0-9A-Za-z_-]{20,}+|xox[abeoprs]-[0-9A-Za-z-]{10,}+|[prs]k_(?:live|test)_[0-9A-Za-z]{16,}+|AIza[0-9A-Za-z_-]{35}|sk-[0-9A-Za-z_-]{20,}+|npm_[0-9A-Za-z]{30,}+|hf_[0-9A-Za-z]{30,}+)"), ("gho_", "ghp_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "xox", "k_live_", "k_test_", "aiza", "sk-", "npm_", "hf_")),
    Rule("address", 1, re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s/:@]{1,64}:([^\s/:@]{3,128})@[A-Za-z0-9.-]+"), ("://",)),
    Rule("header", 1, re.compile(r"authorization[\"']?\x20*[:=]\x20*[\"']?(?:basic|bearer)\x20+([A-Za-z0-9+/_.=~-]{8,}+)", _ANY), ("authorization",)),
    Rule("named", 1, re.compile(r"""\b(?:pwd|passphrase|credential|(?:access|secret|private|client|signing|encryption)[_ -]?key|auth[_-]?key)["']?\x20*(?:[:=]|=>)\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{8,}+)""", _ANY), ("pwd", "passphrase", "credential", "key")),
)
RULES = BASE + ADDED
_ROW = "blob binary, rules array<string>, found array<struct<rule: string, start: int, end: int>>"


def find(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """(rule, start, end) in code points, end exclusive."""
    text = text or ""
    lower = text.lower()
    return [(r.key, a, b) for r in rules for a, b in r.spans(text, lower)]


def _scanner(rules: tuple[Rule, ...]):
    by = {r.key: r for r in rules}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            found = [[{"rule": k, "start": a, "end": b} for k, a, b in find(t, tuple(by[x] for x in todo))] for t, todo in zip(some["text"], some["todo"], strict=True)]
            yield pd.DataFrame({"blob": some["blob"], "rules": some["todo"], "found": found})

    return scan


def versions(rows: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of rows, or those to keep, as a struct `row`, with `text` (null: empty) and `blob`, its address."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in keep or rows.columns]).alias("row"), text.alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path, empty where nothing was written yet."""
    try:
        return spark.read.schema(_ROW).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _ROW)


def scan(named: DataFrame, known: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of all pairs of blob and rule version in named (see versions()) that `known` doesn't have; each pair once."""
    every = F.array(*[F.lit(r.key) for r in rules])
    if known is None:
        texts = named.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", every)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))  # as many as there are rule versions
        wanted = named.select("blob").distinct().join(seen, "blob", "left").select("blob", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo")).where(F.size("todo") > 0)
        texts = named.join(wanted, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    return texts.mapInPandas(_scanner(rules), _ROW)


def detect(rows: DataFrame, text_col: str = "text", path: str | None = None, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """`row` (a struct of the columns of rows, or of those to keep) and `found`, the array of (rule, start, end) of its text under the versions of `rules`.

    One row per row of rows: null texts are empty, repeated rows and equal texts of other paths and versions get the same findings, long
    texts are read whole, an empty table gives an empty one. The columns stay inside the struct, so no name can clash. With a path the
    ledger there is read and what is new is appended to it, in one commit of Spark's writer: a job that fails leaves the ledger as it was.
    Two jobs that append at the same time may scan a pair twice; the findings are then taken once. Without a path the ledger lasts for
    this job.
    """
    spark, named = rows.sparkSession, versions(rows, text_col, keep)
    if path is None:
        records = cut(scan(named, None, rules))
    else:
        known = ledger(spark, path)
        scan(named, known, rules).write.mode("append").parquet(path)
        records = ledger(spark, path)
    hits = records.where(F.size("found") > 0).select("blob", "found")
    if path is not None:
        current = F.explode(F.filter("found", lambda x: x["rule"].isin(*[r.key for r in rules])))
        hits = hits.select("blob", current.alias("f")).groupBy("blob").agg(F.collect_set("f").alias("found"))  # a text's own findings
    empty = F.array().cast("array<struct<rule: string, start: int, end: int>>")
    return named.select("row", "blob").join(hits, "blob", "left").select("row", F.coalesce("found", empty).alias("found"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the base spans' hash and all spans of each document, by start and then by kind in the order of RULES."""
    found = detect(read(spark, sf_dir, "documents"), keep=["doc_id"])
    place = F.create_map(*[F.lit(v) for k, r in enumerate(RULES) for v in (r.key, k)])
    spans = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("a"), F.element_at(place, x["rule"]).alias("k"), x["end"].alias("b"), F.split_part(x["rule"], F.lit("@"), F.lit(1)).alias("kind"))))
    line = lambda some: F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["a"], x["b"])), ",")
    base = F.filter("s", lambda x: x["k"] < len(BASE))
    count = lambda k: F.size(F.filter("s", lambda x: x["k"] == k)).cast("long")
    rows = found.select(F.col("row.doc_id").alias("doc_id"), spans.alias("s"))
    return rows.select("doc_id", *[count(k).alias(f"n_{r.name}") for k, r in enumerate(BASE)], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("s")).alias("spans"))
