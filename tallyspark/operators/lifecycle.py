"""Commands on claims and their documents, applied to stored state one after the other; each leaves an audit row.

claims: claim_id, status (draft, submitted), submitted_at, total_amount, currency.
documents: claim_id, document_id, status (processing, ready, needs_review, failed, confirmed, removed), amount, currency, needs_confirm.
commands: claim_id, at (their order, unique in a claim), command, document_id, amount, currency, status, needs_confirm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AMOUNT = "decimal(22,2)"
AUDIT = f"claim_id long, document_id long, at long, command string, outcome string, before string, after string, total_amount {AMOUNT}, currency string"
#: Command on a document, the states from which it is legal (None: any but removed), the state after it (None: as it was), the reason of a refusal.
MOVES = {
    "finish": (("processing",), None, "not_processing"),
    "edit": (("processing", "ready", "needs_review", "failed"), None, "document_confirmed"),
    "confirm": (("ready", "needs_review"), "confirmed", "not_confirmable"),
    "reopen": (("confirmed",), "needs_review", "not_confirmed"),
    "retry": (("failed",), "processing", "not_failed"),
    "remove": (None, "removed", "document_not_found"),
}


def _absent(x) -> bool:
    return x is None or x != x


@dataclass
class Claim:
    """The state of one claim: its documents, not its history."""

    status: str | None = None
    submitted_at: int | None = None
    total: Decimal | None = None
    currency: str | None = None
    documents: dict[int, list] = field(default_factory=dict)  # status, amount, currency, needs_confirm

    def totals(self) -> dict[str, Decimal]:
        found: dict[str, Decimal] = {}
        for status, amount, currency, _ in self.documents.values():
            if status == "confirmed" and not _absent(amount):
                name = "unknown" if _absent(currency) else currency
                found[name] = found.get(name, Decimal(0)) + amount
        return found

    def apply(self, at: int, command: str, document, amount, currency, status, needs_confirm) -> tuple[str, str | None, str | None]:
        """(outcome, status before, status after); outcome is applied, or why the command is refused, which changes nothing.

        Only a finish is heard after the claim was submitted, as work on a document may end late, but it can move nothing that isn't processing.
        """
        if command in ("create", "submit"):
            before = self.status
            outcome = self._claim(at, command)
            return outcome, before, self.status
        own = None if _absent(document) else self.documents.get(int(document))
        before = own[0] if own else None
        outcome = self._document(command, document, own, amount, currency, status, needs_confirm)
        if outcome == "applied" and command != "finish":
            totals = self.totals()
            self.currency, self.total = next(iter(totals.items())) if len(totals) == 1 else (None, None)
        return outcome, before, self.documents[int(document)][0] if outcome == "applied" else before

    def _claim(self, at: int, command: str) -> str:
        if command == "create":
            if self.status is not None:
                return "claim_exists"
            self.status = "draft"
            return "applied"
        if self.status != "draft":
            return "claim_not_found" if self.status is None else "claim_submitted"
        shown = [d for d in self.documents.values() if d[0] != "removed"]
        if not shown:
            return "no_documents"
        if any(d[0] != "confirmed" and d[3] for d in shown):
            return "unconfirmed_documents"
        totals = self.totals()
        self.currency, self.total = next(iter(totals.items())) if len(totals) == 1 else (None, None) if totals else ("INR", Decimal(0))
        self.status, self.submitted_at = "submitted", at
        return "applied"

    def _document(self, command: str, document, own, amount, currency, status, needs_confirm) -> str:
        if command != "upload" and command not in MOVES:
            return "unknown_command"
        if self.status is None:
            return "claim_not_found"
        if self.status != "draft" and command != "finish":
            return "claim_submitted"
        if command == "upload":
            if own or _absent(document):
                return "document_exists" if own else "document_not_found"
            self.documents[int(document)] = ["processing", amount, currency, needs_confirm is None or bool(needs_confirm)]
            return "applied"
        if own is None or own[0] == "removed":
            return "document_not_found"
        legal, to, reason = MOVES[command]
        if legal is not None and own[0] not in legal:
            return reason
        if command == "finish" and status not in ("ready", "needs_review", "failed"):
            return "unknown_status"
        own[0] = to or (status if command == "finish" or status in ("ready", "needs_review") else own[0])
        if command in ("finish", "edit", "confirm") and not _absent(amount):
            own[1], own[2] = amount, currency
        return "applied"


_OUT = "part string, " + AUDIT + ", needs_confirm boolean"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (claim_id, kind, at): a claim's state, its documents, its commands. Holds one claim's documents."""
    key, claim = None, Claim()

    def state() -> list[tuple]:
        if key is None or claim.status is None:
            return []
        rows = [("document", key, d, None, None, s, None, None, a, c, n) for d, (s, a, c, n) in claim.documents.items()]
        return [("claim", key, None, claim.submitted_at, None, claim.status, None, None, claim.total, claim.currency, None), *rows]

    for batch in batches:
        out: list[tuple] = []
        columns = ("claim_id", "kind", "at", "command", "document_id", "amount", "currency", "status", "needs_confirm")
        for k, kind, at, command, document, amount, currency, status, needs in zip(*(batch[c].tolist() for c in columns), strict=True):
            if k != key:
                out += state()
                key, claim = k, Claim()
            if kind == 0:
                claim.status, claim.submitted_at, claim.total, claim.currency = status, None if _absent(at) else int(at), amount, currency
            elif kind == 1:
                claim.documents[int(document)] = [status, amount, currency, needs is None or bool(needs)]
            else:
                outcome, before, after = claim.apply(int(at), command, document, amount, currency, status, needs)
                out.append(("audit", k, document, at, command, outcome, before, after, claim.total, claim.currency, None))
        yield _frame(out)
    yield _frame(state())


def _frame(rows: list[tuple]) -> pd.DataFrame:
    found = pd.DataFrame(rows, columns=_COLUMNS)
    return found.astype({"document_id": "Int64", "at": "Int64", "needs_confirm": "boolean"})


def apply_commands(claims: DataFrame, documents: DataFrame, commands: DataFrame) -> DataFrame:
    """All rows that applying the commands to the state leaves, told by `part`; see states() and audit().

    Commands are taken in the order of `at`; those of an unknown claim, until it is created, are refused and leave no state. One shuffle
    by claim and a sort; a task streams through its claims and holds one claim's documents, never its commands.
    """
    long = lambda c: F.col(c).cast("long").alias(c)
    money = F.col("amount").cast(AMOUNT).alias("amount")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    state = claims.select(long("claim_id"), F.lit(0).alias("kind"), F.col("submitted_at").cast("long").alias("at"), none("string", "command"), none("long", "document_id"), F.col("total_amount").cast(AMOUNT).alias("amount"), "currency", "status", none("boolean", "needs_confirm"))
    parts = documents.select(long("claim_id"), F.lit(1).alias("kind"), none("long", "at"), none("string", "command"), long("document_id"), money, "currency", "status", "needs_confirm")
    asked = commands.select(long("claim_id"), F.lit(2).alias("kind"), long("at"), "command", long("document_id"), money, "currency", "status", "needs_confirm")
    rows = state.unionByName(parts).unionByName(asked).where("claim_id IS NOT NULL")
    return rows.repartition("claim_id").sortWithinPartitions("claim_id", "kind", "at").mapInPandas(_fold, _OUT)


def audit(applied: DataFrame) -> DataFrame:
    """One row a command: outcome, the status of what it is about before and after, and the claim's total after it."""
    return applied.where("part = 'audit'").drop("part", "needs_confirm")


def states(applied: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new claims and documents."""
    claims = applied.where("part = 'claim'").select("claim_id", F.col("outcome").alias("status"), F.col("at").alias("submitted_at"), "total_amount", "currency")
    documents = applied.where("part = 'document'").select("claim_id", "document_id", F.col("outcome").alias("status"), F.col("total_amount").alias("amount"), "currency", "needs_confirm")
    return claims, documents


#: Events that change a claim or its documents.
_CHANGES = ("upload", "edit", "confirm", "reopen", "remove", "retry", "revert")


def breaches(events: DataFrame) -> DataFrame:
    """(claim_id, document_id, at, event, breach) of events that should not have happened, from the log alone.

    events: claim_id, document_id, at, event (as the commands, and submit), status (of a finish). breach: edit_after_submit, a change of a
    claim that was submitted before; edit_of_confirmed, an edit or a revert between confirm and reopen; confirm_from_wrong_state, a confirm of
    a document that is not ready or in need of review. The first that fits is given. An as-of join: the claim's first submission comes by its id,
    the document's state from the last event before that sets one.
    """
    from pyspark.sql import Window

    submitted = events.where("event = 'submit'").groupBy("claim_id").agg(F.min("at").alias("submitted_at"))
    sets = F.when(F.col("event") == "finish", F.col("status")).when(F.col("event").isin("upload", "retry"), "processing").when(F.col("event") == "confirm", "confirmed").when(F.col("event") == "reopen", "needs_review").when(F.col("event") == "remove", "removed")
    before = Window.partitionBy("claim_id", "document_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where("event <> 'submit'").withColumn("state", F.last(sets, ignorenulls=True).over(before)).join(submitted, "claim_id", "left")
    breach = (
        F.when((F.col("at") > F.col("submitted_at")) & F.col("event").isin(*_CHANGES), "edit_after_submit")
        .when(F.col("event").isin("edit", "revert") & (F.col("state") == "confirmed"), "edit_of_confirmed")
        .when((F.col("event") == "confirm") & ~F.coalesce(F.col("state").isin("ready", "needs_review"), F.lit(False)), "confirm_from_wrong_state")
    )
    return rows.withColumn("breach", breach).where("breach IS NOT NULL").select("claim_id", "document_id", "at", "event", "breach")
