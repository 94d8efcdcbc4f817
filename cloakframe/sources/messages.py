"""Agent messages: what is anonymised before the model, restored after it, and around tools."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import replace as replacing
from cloakframe.plans import conversation
from cloakframe.plans.conversation import FORMS, Thread
from cloakframe.plans.pipeline import Pipeline, with_originals


class ToolStrategy(Enum):
    """How tool calls see personal data."""

    #: Arguments are restored, responses anonymised.
    FULL = "full"
    #: Arguments are restored, responses left; tool messages are anonymised before the model.
    INBOUND_ONLY = "inbound_only"
    #: Nothing is touched.
    PASSTHROUGH = "passthrough"


#: The default thread of messages that name none.
DEFAULT_THREAD = "default"


def before_model(messages: DataFrame, pipeline: Pipeline, strategy: ToolStrategy = ToolStrategy.FULL, names: Thread | None = None, role: str = "role") -> DataFrame:
    """Add `content`: user and assistant messages (and tool ones for INBOUND_ONLY) anonymised, others as they are."""
    names = names or Thread()
    roles = ["user", "assistant"] + (["tool"] if strategy is ToolStrategy.INBOUND_ONLY else [])
    meant = F.col(role).isin(roles) & (F.trim(F.coalesce(F.col(names.text), F.lit(""))) != "")
    masked = messages.withColumn("_text", F.when(meant, F.col(names.text))).withColumn(names.thread, F.coalesce(F.col(names.thread).cast("string"), F.lit(DEFAULT_THREAD)))
    out = conversation.anonymize(masked, pipeline, Thread(names.thread, names.turn, "_text"))
    return out.select(*messages.columns, F.coalesce("anonymized_text", F.col(names.text)).alias("content"))


def after_model(replies: DataFrame, mapping: DataFrame, forms: DataFrame, text: str = "text", thread: str = "thread_id", role: str = "role") -> DataFrame:
    """Add `content`: the stored original of a user or assistant message, otherwise its tokens restored."""
    kept = with_originals(replies, mapping, text, (thread,)).withColumnRenamed("restored", "_original")
    out = conversation.restore_tokens(kept, forms, text, thread)
    meant = F.col(role).isin("user", "assistant")
    return out.select(*replies.columns, F.when(meant, F.coalesce("_original", "restored")).otherwise(F.col(text)).alias("content"))


def tool_calls(calls: DataFrame, forms: DataFrame, strategy: ToolStrategy, anonymized: Callable[[Column], Column] | None = None, thread: str = "thread_id") -> DataFrame:
    """Of thread, args (map of strings) and response: what the tool is given, and what the model sees of its answer."""
    if strategy is ToolStrategy.PASSTHROUGH:
        return calls
    joined = calls.join(forms.select(F.col("thread").alias("_thread"), "forms"), calls[thread] == F.col("_thread"), "left")
    known = F.coalesce("forms", F.array().cast(FORMS))
    back = F.transform(known, lambda f: F.struct(f["token"].alias("source"), f["source"].alias("token")))
    there = F.transform(known, lambda f: F.struct(f["source"].alias("source"), f["token"].alias("token")))
    out = joined.withColumn("args", F.transform_values("args", lambda _, v: replacing.replace_all(v, back)))
    if strategy is ToolStrategy.FULL:
        answer = replacing.replace_all(F.col("response"), there)
        out = out.withColumn("response", anonymized(answer) if anonymized else answer)
    return out.drop("_thread", "forms")


def expired(threads: DataFrame, now: float, ttl: float, updated_at: str = "updated_at") -> DataFrame:
    """Threads not touched for longer than `ttl` seconds."""
    return threads.where(F.col(updated_at) < now - ttl)
