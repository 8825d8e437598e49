"""Incremental jobs on Structured Streaming.

State lives in tables, not in operators. Each micro-batch writes one directory of its own,
``<table>/run=<query id>/batch=<n>``, and reads the rows of all other runs and of its own earlier
batches; a batch that is run again after a failure replaces its own directory and changes nothing
else. A new checkpoint is a new query id, hence a new run: it finds all that earlier runs have
written and touches none of it. All paths must be on storage every executor reaches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import schemas
from ..functions.strings import blank_to_null
from ..operators import leads as lead_ops
from ..operators import outreach as out_ops
from ..operators import replies as reply_ops
from ..operators import sites
from ..operators.candidates import first_per_domain
from ..operators.receipts import final_receipts
from ..rules import DEFAULT_RULES, RuleSet
from ..sources.tables import recent_messages

#: The run under which ticks of the cadence write; they number their batches themselves.
TICKS = "ticks"
#: Deliveries by what they outdo; all others count as failed.
RECEIPT_RANKS = {"sent": 0, "drafted": 1}


def run_id(spark: SparkSession, checkpoint: str) -> str:
    """The id of the streaming query that a checkpoint belongs to."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def read_batches(
    spark: SparkSession, path: str, schema: StructType, before: tuple[str, int] | None = None
) -> DataFrame:
    """Rows of a table of runs and batches; with ``before`` (run, batch) all but those of this run
    from this batch on. Empty at first."""
    try:
        full = StructType([
            *schema.fields, StructField("run", StringType()), StructField("batch", LongType())])
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        rows = rows.filter((F.col("run") != before[0]) | (F.col("batch") < before[1]))
    return rows.drop("run", "batch")


def write_batch(rows: DataFrame, path: str, run: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")


def _start(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str,
           trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def discover_stream(
    pages: DataFrame, leads_path: str, checkpoint: str, now: Column,
    rules: RuleSet = DEFAULT_RULES, allow_non_us: bool = False, vendors_only: bool = True,
    candidates_only: bool = True, trigger: dict | None = None, existing: DataFrame | None = None,
) -> StreamingQuery:
    """Newly arrived pages become profiles, and qualifying new domains are appended as leads.

    ``existing`` leads count as known next to those written under ``leads_path``; they are not read
    again. What pages contribute is stored (``<leads_path>-evidence``, about a kilobyte a page), and
    a site of which pages arrive is judged on all that has arrived of it: a domain that was refused
    is added once later pages make it qualify. Each judgment is stored too (``<leads_path>-judged``),
    and ``discovered_leads`` reads the leads as of the last one, so a site whose pages come in
    several batches ends as if they had come in one.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = run_id(spark, checkpoint)
        known = read_batches(spark, leads_path, schemas.LEADS, (run, batch_id))
        visits = first_per_domain(batch.select(
            F.col("page_id").alias("ord"), "url", F.lit("stored pages").alias("query"),
            F.lit("page_stream").alias("source")))
        fresh = sites.page_evidence(batch, rules, candidates_only, with_ids=True)
        if existing is not None:
            known = known.unionByName(existing.select(*schemas.LEADS.names))
            visits = visits.join(existing.select("domain"), "domain", "left_anti")
            fresh = fresh.join(existing.select("domain"), "domain", "left_anti")
        evidence = f"{leads_path}-evidence"
        write_batch(fresh, evidence, run, batch_id)
        stored = spark.read.schema(fresh.schema).parquet(f"{evidence}/run={run}/batch={batch_id}")
        earlier = read_batches(spark, evidence, fresh.schema, (run, batch_id))
        touched = stored.select("domain").union(visits.select("domain")).distinct()
        all_ = sites.joined_evidence(stored, earlier.join(touched, "domain", "left_semi"))
        profiles = sites.profiles_from(all_, rules, candidates_only)
        judged = lead_ops.judged_visits(visits, profiles, allow_non_us, vendors_only)
        judgments = f"{leads_path}-judged"
        write_batch(judged.withColumn("judged_at", F.unix_micros(F.current_timestamp())), judgments, run, batch_id)
        judged = spark.read.schema(judged.schema).parquet(f"{judgments}/run={run}/batch={batch_id}")
        write_batch(lead_ops.new_leads(known, judged, now), leads_path, run, batch_id)

    return _start(pages, body, checkpoint, trigger)


def discovered_leads(spark: SparkSession, leads_path: str) -> DataFrame:
    """The leads that ``discover_stream`` has found, as their sites stand after all batches: profile
    fields are those of the last judgment, and a lead whose site no longer qualifies is left out.

    Ids and dates stay those of the first batch that added the lead. The judgment made last counts,
    in whatever run: it has seen all evidence before it.
    """
    leads = read_batches(spark, leads_path, schemas.LEADS)
    judged = spark.read.parquet(f"{leads_path}-judged")
    fields = [c for c in (
        "company_name", "email", "phone", "description", "research_only_evidence", "company_type", "sells_direct",
        "manufactures", "us_based", "state") if c in judged.columns]
    last = judged.groupBy("domain").agg(F.max(F.struct("judged_at", "run", "reason", *fields)).alias("_last"))
    rows = leads.join(last, "domain").filter(F.col("_last.reason").isNull())
    name = F.coalesce(blank_to_null(F.col("_last.company_name")), F.col("domain"))
    return rows.withColumns(
        {c: name if c == "company_name" else F.col(f"_last.{c}") for c in fields}).select(*schemas.LEADS.names)


def reply_stream(
    messages: DataFrame, leads: DataFrame, outreach: DataFrame, updates_path: str, checkpoint: str,
    now: Column, since_days: int, policy: str = "any", rules: RuleSet = DEFAULT_RULES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Arriving messages become reply updates, one small table per batch.

    The lead table itself is not rewritten; ``leads_with_replies`` lays the updates over it.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        digest = reply_ops.message_digest(recent_messages(batch, now, since_days), rules)
        updates = reply_ops.reply_updates(
            reply_ops.contacted_map(outreach, leads), digest, policy)
        run = run_id(batch.sparkSession, checkpoint)
        write_batch(updates.withColumn("applied_at", now), updates_path, run, batch_id)

    return _start(messages, body, checkpoint, trigger)


def merged_updates(spark: SparkSession, updates_path: str) -> DataFrame:
    """Reply updates of all batches, one row per lead: opting out in any batch counts."""
    rows = read_batches(spark, updates_path, schemas.REPLY_UPDATES)
    return rows.groupBy("lead_id").agg(
        F.min("first_msg_id").alias("first_msg_id"), F.bool_or("opted_out").alias("opted_out"),
        F.min("applied_at").alias("applied_at"))


def leads_with_replies(leads: DataFrame, updates: DataFrame) -> DataFrame:
    """The lead table as of all reply updates."""
    at = updates.select(F.col("lead_id").alias("id"), F.col("applied_at").alias("_at"))
    rows = leads.join(at, "id", "left")
    applied = reply_ops.apply_updates(leads, updates, F.lit(None).cast("timestamp_ntz"))
    stamps = rows.select("id", "_at", F.col("replied_at").alias("_before"), F.col("status").alias("_s"),
                         F.col("opted_out").alias("_o"), F.col("updated_at").alias("_u"))
    joined = applied.join(stamps, "id")
    touched = F.col("_at").isNotNull() & (
        F.col("_before").isNull() | (F.col("_s") != "replied") | (F.col("opted_out") != F.col("_o")))
    return joined.withColumns({
        "replied_at": F.coalesce("_before", "_at"),
        "updated_at": F.when(touched, F.col("_at")).otherwise(F.col("_u")),
    }).select(*schemas.LEADS.names)


def _latest_outcome(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The outcome of one lead and step, told when it changes: (rank, moment) is what is kept."""
    best = state.get if state.exists else None
    found = best
    for batch in batches:
        for delivery, error, at in zip(batch["delivery"], batch["error"], batch["at"]):
            rank = RECEIPT_RANKS.get(delivery, len(RECEIPT_RANKS))
            text = error if isinstance(error, str) and rank == len(RECEIPT_RANKS) else None
            moment = (rank, int(at) if rank < len(RECEIPT_RANKS) else -int(at))
            if found is None or moment < (found[0], found[1]):
                found = (*moment, text)
    if found != best:
        state.update(found)
        name = {v: k for k, v in RECEIPT_RANKS.items()}.get(found[0], "failed")
        yield pd.DataFrame({"lead_id": [key[0]], "step": [key[1]], "delivery": [name], "error": [found[2]], "at": [abs(found[1])]})


def receipt_stream(
    receipts: DataFrame, outcomes_path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """K4: arriving receipts (``lead_id, step, delivery, error, delivered_at``) become outcomes.

    The outcome of each lead and step is kept as state, so a repeated or outdone receipt writes
    nothing. ``merged_receipts`` reads the outcomes of all batches and runs.
    """
    rows = receipts.filter("lead_id IS NOT NULL AND step IS NOT NULL").select(
        "lead_id", "step", "delivery", "error", F.unix_micros(F.col("delivered_at").cast("timestamp")).alias("at"))
    changed = rows.groupBy("lead_id", "step").applyInPandasWithState(
        _latest_outcome, "lead_id bigint, step int, delivery string, error string, at bigint",
        "rank int, at bigint, error string", "update", GroupStateTimeout.NoTimeout)

    def body(batch: DataFrame, batch_id: int) -> None:
        moment = F.timestamp_micros("at").cast("timestamp_ntz").alias("delivered_at")
        run = run_id(batch.sparkSession, checkpoint)
        write_batch(batch.select("lead_id", "step", "delivery", "error", moment), outcomes_path, run, batch_id)

    writer = changed.writeStream.outputMode("update").foreachBatch(body).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def merged_receipts(spark: SparkSession, outcomes_path: str) -> DataFrame:
    """Outcomes of all batches, one row per lead and step."""
    return final_receipts(read_batches(spark, outcomes_path, schemas.RECEIPTS))


def cadence_tick(
    leads: DataFrame, log_path: str, tick: int, now: Column, first: tuple[str, str],
    follow_up: tuple[str, str], sender: dict[str, str], interval_days: int, max_followups: int,
) -> None:
    """Plans what is due and logs it as batch ``tick``.

    Earlier ticks only are looked at, so repeating a tick replaces its rows by the same rows, and
    a lead never has two delivered rows for one step.
    """
    log = read_batches(leads.sparkSession, log_path, schemas.OUTREACH, (TICKS, tick))
    due = out_ops.plan_outreach(
        leads, log, now, interval_days=interval_days, max_followups=max_followups)
    messages = out_ops.with_delivery(
        out_ops.with_problems(out_ops.render_messages(due, first, follow_up, sender), sender), False)
    write_batch(out_ops.log_rows(log, messages, now), log_path, TICKS, tick)
