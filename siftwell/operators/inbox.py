"""Inbox triage and the briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as K
from ..functions.rules import is_job_mail, mail_status, needs_action
from ..functions.text import display_name


def triage(messages: DataFrame, rules=K.MAIL_STATUS, senders=K.MAIL_SENDERS) -> DataFrame:
    """is_job_related, status and needs_action beside the messages' columns."""
    m = messages.withColumn("is_job_related", is_job_mail(F.col("sender"), F.col("subject"), senders))
    m = m.withColumn("status", mail_status(F.col("sender"), F.col("subject"), F.col("snippet"), rules, senders))
    return m.withColumn("needs_action", needs_action(F.col("is_job_related"), F.col("status")))


def pipeline_counts(triaged: DataFrame) -> DataFrame:
    return triaged.where("is_job_related").groupBy("status").agg(F.count("*").alias("n"))


def due(triaged: DataFrame) -> DataFrame:
    """status, sender (as shown) and subject of every message that needs action, a row each: the whole list, however long."""
    return triaged.where("needs_action").select("status", display_name(F.col("sender")).alias("sender"), "subject")


def briefing(triaged: DataFrame, jobs: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """One row: scanned, job_mail, noise, pipeline (map), needs_action (the whole list, by status, sender and subject), and the ``most`` best jobs.

    Where a mailbox has more due messages than a row should hold, ``due`` gives them as rows; ``needs_action_total`` is their number in any case.
    """
    head = triaged.agg(
        F.count("*").alias("scanned"), F.count_if("is_job_related").alias("job_mail"), F.count_if(~F.col("is_job_related")).alias("noise"), F.count_if("needs_action").alias("needs_action_total"),
    )
    pipe = pipeline_counts(triaged).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("pipeline"))
    listed = due(triaged).agg(F.array_sort(F.collect_list(F.struct("status", "sender", "subject"))).alias("needs_action"))
    best = jobs.orderBy(F.desc("score"), "id").limit(most).agg(F.array_sort(F.collect_list(F.struct("id", "title", "company", "score"))).alias("jobs"))
    whole = head.join(pipe, F.lit(True)).join(listed, F.lit(True)).join(best, F.lit(True))
    return whole.withColumn("generated_at", now).withColumn("date", F.to_date(now))
