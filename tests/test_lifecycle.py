"""Commands on claims: guards, totals, stored state, the stream; breaches of a log."""

from decimal import Decimal as D

from tallyspark.operators import lifecycle as L
from tallyspark.streaming import jobs

CLAIM = f"claim_id long, status string, submitted_at long, total_amount {L.AMOUNT}, currency string"
DOCUMENT = f"claim_id long, document_id long, status string, amount {L.AMOUNT}, currency string, needs_confirm boolean"
COMMAND = f"claim_id long, at long, command string, document_id long, amount {L.AMOUNT}, currency string, status string, needs_confirm boolean"
DO = lambda at, command, document=None, amount=None, currency=None, status=None, claim=1, needs=None: (claim, at, command, document, amount, currency, status, needs)
STORY = [
    DO(1, "upload", 7), DO(2, "create"), DO(3, "submit"), DO(4, "upload", 7), DO(5, "confirm", 7), DO(6, "finish", 7, D("14.18"), "INR", "ready"), DO(7, "finish", 7, None, None, "failed"), DO(8, "submit"), DO(9, "confirm", 7),
    DO(10, "edit", 7, D(1), "INR"), DO(11, "upload", 8), DO(12, "finish", 8, D(5), "USD", "needs_review"), DO(13, "confirm", 8), DO(14, "reopen", 7), DO(15, "edit", 7, D(20), "INR"), DO(16, "confirm", 7), DO(17, "remove", 8), DO(18, "remove", 8),
    DO(19, "upload", 9, needs=False), DO(20, "submit"), DO(21, "reopen", 7), DO(22, "finish", 9, None, None, "failed"), DO(23, "retry", 9), DO(24, "pay", 7),
]
WANT = [
    "claim_not_found", "applied", "no_documents", "applied", "not_confirmable", "applied", "not_processing", "unconfirmed_documents", "applied", "document_confirmed", "applied", "applied", "applied", "applied", "applied", "applied", "applied", "document_not_found",
    "applied", "applied", "claim_submitted", "applied", "claim_submitted", "unknown_command",
]
TOTALS = {9: (D("14.18"), "INR"), 13: (None, None), 14: (D(5), "USD"), 16: (None, None), 17: (D(20), "INR"), 20: (D(20), "INR")}


def run(spark, claims, documents, commands):
    applied = L.apply_commands(spark.createDataFrame(claims, CLAIM), spark.createDataFrame(documents, DOCUMENT), spark.createDataFrame(commands[::-1], COMMAND).repartition(3))
    log = sorted(L.audit(applied).collect(), key=lambda r: (r.claim_id, r.at))
    return log, [sorted(map(tuple, x.collect())) for x in L.states(applied)]


def test_guards_and_totals(spark):
    log, (claims, documents) = run(spark, [], [], STORY)
    assert [r.outcome for r in log] == WANT
    assert {r.at: (r.total_amount, r.currency) for r in log if r.at in TOTALS} == TOTALS
    assert claims == [(1, "submitted", 20, D(20), "INR")]
    assert documents == [(1, 7, "confirmed", D(20), "INR", True), (1, 8, "removed", D(5), "USD", True), (1, 9, "failed", None, None, False)]
    assert (log[8].before, log[8].after) == ("ready", "confirmed") and (log[9].before, log[9].after) == ("confirmed", "confirmed")


def test_stored_state_goes_on(spark):
    """Commands in two runs, the second on the state that the first leaves, give what one run gives."""
    whole, states = run(spark, [], [], STORY + [DO(k, "create", claim=2) for k in (1, 2)])
    first, (claims, documents) = run(spark, [], [], STORY[:12] + [DO(1, "create", claim=2)])
    second, end = run(spark, claims, documents, STORY[12:] + [DO(2, "create", claim=2)])
    assert sorted(first + second, key=lambda r: (r.claim_id, r.at)) == whole and end == states


def test_untouched_state_stays(spark):
    claims, documents = [(3, "draft", None, None, None), (4, "submitted", 5, D(1), "INR")], [(3, 1, "ready", None, None, True)]
    log, states = run(spark, claims, documents, [DO(9, "confirm", 1, claim=4), DO(9, "submit", claim=5)])
    assert [r.outcome for r in log] == ["claim_submitted", "claim_not_found"] and states == [claims, documents]
    assert run(spark, [], [], []) == ([], [[], []])


def test_stream_equals_batch(spark, tmp_path):
    parts = (STORY[:10], STORY[10:17], STORY[17:])
    for k, part in enumerate(parts):
        spark.createDataFrame(part + [DO(k, "create", claim=2)], COMMAND).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(COMMAND).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        jobs.follow_commands(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=lambda r: (r[0], r[2]))
    log, _ = run(spark, [], [], STORY + [DO(k, "create", claim=2) for k in range(3)])
    assert got == [tuple(r) for r in log]


def test_breaches(spark):
    rows = [
        (1, 1, 1, "upload", None), (1, 1, 2, "confirm", None), (1, 1, 3, "finish", "ready"), (1, 1, 4, "edit", None), (1, 1, 5, "confirm", None), (1, 1, 6, "edit", None), (1, 1, 7, "confirm", None), (1, 1, 8, "reopen", None), (1, 1, 9, "revert", None), (1, 1, 10, "confirm", None),
        (1, None, 11, "submit", None), (1, 1, 12, "edit", None), (1, 2, 13, "finish", "failed"), (2, 3, 12, "edit", None), (2, 3, 13, "confirm", None),
    ]
    got = L.breaches(spark.createDataFrame(rows, "claim_id long, document_id long, at long, event string, status string")).collect()
    want = {(1, 2, "confirm_from_wrong_state"), (1, 6, "edit_of_confirmed"), (1, 7, "confirm_from_wrong_state"), (1, 12, "edit_after_submit"), (2, 13, "confirm_from_wrong_state")}
    assert {(r.claim_id, r.at, r.breach) for r in got} == want
