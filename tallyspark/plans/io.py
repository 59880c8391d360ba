"""Queries that write parts of the tables to shared scratch folders and read them back, and incremental ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import audit as I
from tallyspark.operators import documents as Q
from tallyspark.operators import lifecycle as C
from tallyspark.operators import versions as V
from tallyspark.plans.documents import claims
from tallyspark.plans.proxy import DOCS, docs, table
from tallyspark.plans.registry import SQL, query
from tallyspark.sources import readers, sinks
from tallyspark.streaming import jobs


@query("S1_results", "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'fuel_receipt' ELSE 'other' END AS document_type FROM supplier")
def results(spark, d):
    """A file for each object; the outer object's type fills a missing inner one."""
    path = readers.scratch(spark)
    inner = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, "fuel_receipt").alias("document_type"))
    rows = table(spark, d, "supplier").select(F.lit("other").alias("document_type"), inner.alias("clean_json"))
    sinks.object_files(rows, path)
    return readers.results(spark, path, "document_type string, clean_json struct<id:string,document_type:string>").select("clean_json.id", "clean_json.document_type")


@query("S2_samples", "SELECT event_id FROM events WHERE event_id % 3 <> 0")
def samples(spark, d):
    path = readers.scratch(spark)
    table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, False).when(F.col("event_id") % 3 == 1, True).alias("success")).write.json(path)
    return readers.samples(spark, path, "event_id long, success boolean").select("event_id")


@query("S3_manifest", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def manifest(spark, d):
    path = readers.scratch(spark)
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.json(path)
    there = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return readers.manifest(spark, path, "o_orderkey long, o_orderstatus string", there, "o_orderkey")


@query("S4_texts", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0 ELSE length(d.text) END AS n FROM documents d LEFT JOIN labels l USING (doc_id)")
def texts(spark, d):
    found = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
    return readers.with_texts(table(spark, d, "documents").select("doc_id"), found, "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))


@query("S5_keyed_object", "SELECT c_custkey::VARCHAR AS key, c_name AS company, c_nationkey::VARCHAR AS total FROM customer")
def keyed_object(spark, d):
    """Objects of at most some thousand keys each, a line for each object."""
    path = readers.scratch(spark)
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.struct(F.col("c_name").alias("company"), F.col("c_nationkey").cast("string").alias("total")).alias("v"))
    sinks.keyed_objects(rows, path)
    return readers.keyed_object(spark, path, "struct<company:string,total:string>")


@query("S6_lines", "SELECT doc_id, quality FROM labels")
def lines(spark, d):
    path = readers.scratch(spark)
    sinks.json_lines(table(spark, d, "labels"), path)
    return readers.lines(spark, path, "doc_id long, quality int")


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("S7_scan", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES))
def scan(spark, d):
    """All tables; a count reads no column."""
    from functools import reduce

    from pyspark.sql import DataFrame

    return reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in _TABLES])


@query("S8_cache", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def cache(spark, d):
    path = readers.scratch(spark)
    table(spark, d, "events").select("user_id", "event_id", "event_type").write.json(path)
    return readers.cache(spark, path, "user_id long, event_id long, event_type string", "user_id", "event_id").select("user_id", "event_type")


@query("S9_overrides", "SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'bad' END, d.lang) AS label, CASE WHEN l.toxic = 1 AND quality = 0 THEN 'seen' END AS notes, coalesce(l.toxic = 1 AND quality = 1, false) AS ambiguous FROM (SELECT doc_id, lang FROM documents) d LEFT JOIN labels l USING (doc_id)")
def overrides(spark, d):
    """A map of overrides in files of one object each, read back and laid over the documents' own labels."""
    path = readers.scratch(spark)
    human = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.struct(F.lit("bad").alias("label"), F.when(F.col("quality") == 0, "seen").alias("notes"), (F.col("quality") == 1).alias("ambiguous")).alias("v"))
    sinks.keyed_objects(human.select(F.col("doc_id").cast("string").alias("key"), "v"), path)
    found = readers.keyed_object(spark, path, "struct<label:string,notes:string,ambiguous:boolean>").withColumn("doc_id", F.col("key").cast("long"))
    return readers.with_overrides(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label")), found, "doc_id")


@query("S10_pages_text", "SELECT conv_id, md5(string_agg(CASE WHEN turn % 2 = 0 THEN '' ELSE role END, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def pages_text(spark, d):
    page = F.struct("turn", F.when(F.col("turn") % 2 != 0, F.col("role")).alias("markdown"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(page)).alias("pages")).select("conv_id", F.md5(readers.pages_text(F.col("pages"))).alias("digest"))


@query("K1_json_lines", "SELECT event_id, event_type, user_id FROM events WHERE event_type = 'purchase'")
def json_lines(spark, d):
    path = readers.scratch(spark)
    sinks.json_lines(table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "event_type", "user_id"), path)
    return readers.lines(spark, path, "event_id long, event_type string, user_id long")


@query("K2_append_versions", f"WITH {DOCS} SELECT document_id, amount FROM docs WHERE claim_status = 'submitted'")
def append_versions(spark, d):
    root, rows = readers.scratch(spark), docs(spark, d).where("claim_status = 'submitted'").select("document_id", "amount", "doc_status")
    sinks.append_versions({"extractions": rows.select("document_id", "amount"), "audit": rows.select("document_id", F.lit("extracted").alias("action"))}, root, "run-1")
    return sinks.published(spark, root, "extractions").select("document_id", "amount")


@query("K3_append_decisions", f"WITH {DOCS} SELECT claim_id, document_id, s AS evaluation_seq FROM docs, (SELECT unnest([1, 2])::INT AS s) WHERE s = 1 OR claim_status = 'submitted'")
def append_decisions(spark, d):
    path, rows = readers.scratch(spark), docs(spark, d).select("claim_id", "document_id", "claim_status")
    sinks.append_decisions(rows, path, None)
    sinks.append_decisions(rows.where("claim_status = 'submitted'"), path, spark.read.parquet(path))
    return spark.read.parquet(path).select("claim_id", "document_id", "evaluation_seq")


@query("K4_resumed_predictions", "SELECT vec_id FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 5 = 0")
def resumed_predictions(spark, d):
    """What a second run still has to do: rows not predicted under this fingerprint, or with an error."""
    path, rows = readers.scratch(spark), table(spark, d, "embeddings").select("vec_id")
    first = rows.where("vec_id % 3 = 0").select("vec_id", F.lit("rules").alias("method"), F.lit("f1").alias("fingerprint"), F.when(F.col("vec_id") % 5 == 0, "timeout").alias("error"))
    sinks.append_predictions(first, path)
    return sinks.unpredicted(rows, spark.read.parquet(path), "vec_id", "f1")


@query("K5_nested_report", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def nested_report(spark, d):
    path = readers.scratch(spark)
    sinks.nested_report(table(spark, d, "documents").select("lang", "doc_id", "n_chars"), "lang", path)
    return readers.lines(spark, path, "lang string, part int, n long, documents array<struct<doc_id:long,n_chars:long>>").where(F.size("documents") == F.col("n")).groupBy("lang").agg(F.sum("n").alias("n"))


@query("K6_replaced_methods", "SELECT event_type AS method, event_id % 2 + CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END AS v, count(*) AS n FROM events GROUP BY ALL")
def replaced_methods(spark, d):
    path = readers.scratch(spark)
    rows = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("event_id") % 2).alias("v"))
    sinks.replace_methods(rows, path)
    sinks.replace_methods(rows.where("method = 'purchase'").withColumn("v", F.col("v") + 10), path)
    return spark.read.parquet(path).groupBy("method", "v").agg(F.count(F.lit(1)).alias("n"))


@query("T1_arrivals", SQL["Q1_checks"])
def arrivals(spark, d):
    """Documents read as a stream of files, checked and appended batch by batch."""
    root = readers.scratch(spark)
    rows = claims(spark, d)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    jobs.arrive(stream, f"{root}/checkpoint", Q.check_rows, f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("document_id", "name", "passed")


_COMMANDS = "['create', 'upload', 'upload', 'finish', 'finish', 'edit', 'confirm', 'confirm', 'reopen', 'submit', 'remove', 'retry', 'pay'][(event_id * 7 // 3 % 13 + 1)::INT]"
#: One document for each claim, so that the claim's and the document's state are a row; users are claims, events their commands.
_FOLD = f"""WITH RECURSIVE cmd AS (SELECT user_id, event_id AS "at", {_COMMANDS} AS cmd, (event_id % 100)::DECIMAL(22,2) AS amt, CASE event_id % 2 WHEN 0 THEN 'INR' ELSE 'USD' END AS cur, ['ready', 'needs_review', 'failed'][(event_id % 3 + 1)::INT] AS fin, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  st AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS "at", NULL::VARCHAR AS command, NULL::VARCHAR AS outcome, NULL::VARCHAR AS before, NULL::VARCHAR AS after, CASE WHEN {{stored}} THEN 'draft' END AS c, CASE WHEN {{stored}} THEN 'ready' END AS s, CASE WHEN {{stored}} THEN 10::DECIMAL(22,2) END AS amount, CASE WHEN {{stored}} THEN 'INR' END AS currency, NULL::BIGINT AS sub, NULL::DECIMAL(22,2) AS total, NULL::VARCHAR AS total_cur FROM events
  UNION ALL SELECT user_id, n, "at", cmd, outcome, CASE WHEN cmd IN ('create', 'submit') THEN c ELSE s END, CASE WHEN cmd IN ('create', 'submit') THEN c2 ELSE s2 END, c2, s2, a2, u2, CASE WHEN outcome = 'applied' AND cmd = 'submit' THEN "at" ELSE sub END,
    CASE WHEN outcome <> 'applied' OR cmd IN ('create', 'finish') THEN total WHEN s2 = 'confirmed' THEN a2 WHEN cmd = 'submit' THEN 0 END, CASE WHEN outcome <> 'applied' OR cmd IN ('create', 'finish') THEN total_cur WHEN s2 = 'confirmed' THEN u2 WHEN cmd = 'submit' THEN 'INR' END
    FROM (SELECT *, CASE WHEN outcome <> 'applied' THEN c WHEN cmd = 'create' THEN 'draft' WHEN cmd = 'submit' THEN 'submitted' ELSE c END AS c2,
      CASE WHEN outcome <> 'applied' THEN s ELSE CASE cmd WHEN 'upload' THEN 'processing' WHEN 'finish' THEN fin WHEN 'confirm' THEN 'confirmed' WHEN 'reopen' THEN 'needs_review' WHEN 'retry' THEN 'processing' WHEN 'remove' THEN 'removed' WHEN 'edit' THEN CASE WHEN fin = 'failed' THEN s ELSE fin END ELSE s END END AS s2,
      CASE WHEN outcome = 'applied' AND cmd IN ('upload', 'finish', 'edit', 'confirm') THEN amt ELSE amount END AS a2, CASE WHEN outcome = 'applied' AND cmd IN ('upload', 'finish', 'edit', 'confirm') THEN cur ELSE currency END AS u2
      FROM (SELECT st.user_id, cmd.n, cmd."at", cmd.cmd, amt, cur, fin, c, s, amount, currency, sub, total, total_cur,
        CASE WHEN cmd.cmd = 'create' THEN CASE WHEN c IS NULL THEN 'applied' ELSE 'claim_exists' END WHEN cmd.cmd = 'pay' THEN 'unknown_command' WHEN c IS NULL THEN 'claim_not_found' WHEN c <> 'draft' AND cmd.cmd <> 'finish' THEN 'claim_submitted'
          WHEN cmd.cmd = 'submit' THEN CASE WHEN s IS NULL OR s = 'removed' THEN 'no_documents' WHEN s <> 'confirmed' THEN 'unconfirmed_documents' ELSE 'applied' END WHEN cmd.cmd = 'upload' THEN CASE WHEN s IS NULL THEN 'applied' ELSE 'document_exists' END
          WHEN s IS NULL OR s = 'removed' THEN 'document_not_found' WHEN cmd.cmd = 'finish' AND s <> 'processing' THEN 'not_processing' WHEN cmd.cmd = 'edit' AND s = 'confirmed' THEN 'document_confirmed' WHEN cmd.cmd = 'confirm' AND s NOT IN ('ready', 'needs_review') THEN 'not_confirmable'
          WHEN cmd.cmd = 'reopen' AND s <> 'confirmed' THEN 'not_confirmed' WHEN cmd.cmd = 'retry' AND s <> 'failed' THEN 'not_failed' ELSE 'applied' END AS outcome
        FROM st JOIN cmd ON cmd.user_id = st.user_id AND cmd.n = st.n + 1)))"""


def _commands(spark, d):
    at = F.col("event_id")
    name = F.element_at(F.array(*[F.lit(c) for c in ("create", "upload", "upload", "finish", "finish", "edit", "confirm", "confirm", "reopen", "submit", "remove", "retry", "pay")]), (F.floor(at * 7 / 3) % 13 + 1).cast("int"))
    end = F.element_at(F.array(F.lit("ready"), F.lit("needs_review"), F.lit("failed")), (at % 3 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").cast("long").alias("claim_id"), at.cast("long").alias("at"), name.alias("command"), (F.col("user_id") * 10).cast("long").alias("document_id"), (at % 100).cast(C.AMOUNT).alias("amount"), F.when(at % 2 == 0, "INR").otherwise("USD").alias("currency"), end.alias("status"), F.lit(True).alias("needs_confirm"))


def _applied(spark, d):
    """Every third claim has a stored draft with a document that is ready."""
    users = table(spark, d, "events").select(F.col("user_id").alias("claim_id")).distinct().where("claim_id % 3 = 0")
    claims = users.select("claim_id", F.lit("draft").alias("status"), F.lit(None).cast("long").alias("submitted_at"), F.lit(None).cast(C.AMOUNT).alias("total_amount"), F.lit(None).cast("string").alias("currency"))
    documents = users.select("claim_id", (F.col("claim_id") * 10).alias("document_id"), F.lit("ready").alias("status"), F.lit(10).cast(C.AMOUNT).alias("amount"), F.lit("INR").alias("currency"), F.lit(True).alias("needs_confirm"))
    return C.apply_commands(claims, documents, _commands(spark, d))


@query("T2_folded_commands", f"{_FOLD.format(stored='false')} SELECT user_id AS claim_id, \"at\", command, outcome, before, after, total AS total_amount, total_cur AS currency FROM st WHERE n > 0")
def folded_commands(spark, d):
    """Commands as a stream of files, with state kept for each claim."""
    root = readers.scratch(spark)
    rows = _commands(spark, d)
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
    jobs.follow_commands(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("document_id")


@query("T8_command_fold", f"{_FOLD.format(stored='user_id % 3 = 0')} SELECT user_id AS claim_id, \"at\", command, outcome, before, after, total AS total_amount, total_cur AS currency FROM st WHERE n > 0")
def command_fold(spark, d):
    """One audit row for each command, on stored state."""
    return C.audit(_applied(spark, d)).drop("document_id")


@query("T8_new_states", f"{_FOLD.format(stored='user_id % 3 = 0')} SELECT user_id AS claim_id, c AS status, sub AS submitted_at, total AS total_amount, total_cur AS currency, s AS document FROM st WHERE c IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def new_states(spark, d):
    """The claims and the status of their document after all commands."""
    claims, documents = C.states(_applied(spark, d))
    return claims.join(documents.select("claim_id", F.col("status").alias("document")), "claim_id", "left")


@query("T4_idempotent_intake", "SELECT count(DISTINCT (source, sha256(text))) AS n FROM documents")
def idempotent_intake(spark, d):
    rows = table(spark, d, "documents").select("source", F.sha2("text", 256).alias("sha"))
    return jobs.without_repeats(rows, ["source", "sha"], "at", "1 day").agg(F.count(F.lit(1)).alias("n"))


@query("T5_resume", "SELECT doc_id, CASE WHEN doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) THEN 2 ELSE 1 END::INT AS run FROM documents")
def resume(spark, d):
    """The first run has predicted the labelled rows, some under another fingerprint or with an error; the second does the rest, and all have a valid prediction then."""
    path, rows = readers.scratch(spark), table(spark, d, "documents").select("doc_id")
    first = table(spark, d, "labels").select("doc_id", F.lit("rules").alias("method"), F.when(F.col("quality") == 1, "f2").otherwise("f1").alias("fingerprint"), F.when(F.col("toxic") == 1, "timeout").alias("error"), F.lit(1).alias("run"))
    sinks.append_predictions(first, path)
    second = sinks.unpredicted(rows, spark.read.parquet(path), "doc_id", "f2").select("doc_id", F.lit("rules").alias("method"), F.lit("f2").alias("fingerprint"), F.lit(None).cast("string").alias("error"), F.lit(2).alias("run"))
    sinks.append_predictions(second, path)
    return spark.read.parquet(path).where("fingerprint = 'f2' AND error IS NULL").select("doc_id", "run")


@query("T6_weekly_counts", "SELECT user_id, date_trunc('week', ts)::DATE AS week, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def weekly_counts(spark, d):
    """The same windows in a stream over all files, in complete mode."""
    root = readers.scratch(spark)
    rows = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    jobs.weekly_counts(stream, "user_id", "ts", "value").writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").withColumn("total", F.round("total", 4))


@query("I2_reviewer_overlay", f"WITH {DOCS}, h AS (SELECT user_id, arg_max(event_type, event_id) AS label FROM events GROUP BY 1) SELECT document_id, coalesce(label, doc_status) AS verdict FROM docs LEFT JOIN h ON employee_id = user_id")
def reviewer_overlay(spark, d):
    """The newest label of each key over the stored verdict, which stays as it is."""
    newest = V.latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id").select(F.col("user_id").alias("employee_id"), F.col("event_type").alias("label"))
    return docs(spark, d).join(newest, "employee_id", "left").select("document_id", F.coalesce("label", "doc_status").alias("verdict"))


_REVIEWED = "CASE event_id % 5 WHEN 0 THEN 'compliant' WHEN 1 THEN 'violation' WHEN 2 THEN 'needs_approval' WHEN 3 THEN 'insufficient_information' ELSE 'fine' END"


@query("I4_label_domain", f"SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'bad_verdict' WHEN event_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = event_id % 3000 AND p_partkey % 2 = event_id % 2) THEN 'unknown_clause' END AS problem FROM events")
def label_domain(spark, d):
    """Reviewers' labels on events; parts are the clauses, of two versions of the policy."""
    clauses = table(spark, d, "part").select((F.col("p_partkey") % 2).cast("string").alias("policy_version"), F.col("p_partkey").cast("string").alias("clause_id"))
    labels = table(spark, d, "events").select("event_id", (F.col("event_id") % 2).cast("string").alias("policy_version"), F.expr(_REVIEWED).alias("human_verdict"), F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 3000).cast("string")).alias("human_clause_id"))
    return I.reviewer_labels(labels, clauses).select("event_id", "problem")
