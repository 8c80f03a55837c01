"""Prompts out of the JSON lines of three transcript dialects, and per-session order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Separators of synthesised ids.
ORDINAL_MARK, LONG_MARK = "#", "########"

_BLOCKS = "array<struct<type:string,text:string>>"


def _content(json: Column, path: str) -> tuple[Column, Column]:
    """A message's content as (string, blocks): one of both, since it may be either."""
    raw = F.get_json_object(json, path)
    listed = F.ltrim(raw).startswith("[")
    return F.when(~listed, raw), F.when(listed, F.from_json(raw, _BLOCKS))


def human_text(plain: Column, blocks: Column) -> Column:
    """Whether a person wrote it: a non-empty string, or blocks with text and no tool result."""
    some = F.exists(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False)))
    tool = F.exists(blocks, lambda b: F.coalesce(b["type"] == "tool_result", F.lit(False)))
    return F.coalesce(plain != "", F.lit(False)) | F.coalesce(some & ~tool, F.lit(False))


def joined_text(plain: Column, blocks: Column, any_kind: bool = False) -> Column:
    """The string itself, or the text of its text blocks one after the other."""
    kept = blocks if any_kind else F.filter(blocks, lambda b: F.coalesce(b["type"] == "text", F.lit(False)))
    return F.coalesce(plain, F.array_join(F.transform(kept, lambda b: F.coalesce(b["text"], F.lit(""))), ""))


def _flag(json: Column, path: str) -> Column:
    return F.coalesce(F.get_json_object(json, path) == "true", F.lit(False))


def dialect_a(lines: DataFrame, context: bool = False) -> DataFrame:
    """lines: path, off, line. User prompts: session, prompt id, cwd, text. context: every user line with text, as what came before a
    prompt is told, under its own id where it has no prompt's."""
    j = F.col("line")
    plain, blocks = _content(j, "$.message.content")
    got = lambda p: F.coalesce(F.get_json_object(j, p), F.lit(""))
    prompt = got("$.promptId")
    if context:
        keep, prompt = (got("$.type") == "user") & human_text(plain, blocks), F.coalesce(F.nullif(prompt, F.lit("")), got("$.uuid"))
    else:
        keep = (got("$.type") == "user") & (prompt != "") & ~_flag(j, "$.isSidechain") & ~_flag(j, "$.isMeta") & F.get_json_object(j, "$.toolUseResult").isNull() & human_text(plain, blocks)
    return lines.where(keep).select("path", "off", got("$.sessionId").alias("session_id"), prompt.alias("prompt_id"), got("$.cwd").alias("cwd"), joined_text(plain, blocks).alias("text"))


def dialect_b(lines: DataFrame) -> DataFrame:
    """Event lines with an ordinal and a message; the session is the last header before the line, else the file's first."""
    j = F.col("line")
    kind = F.get_json_object(j, "$.type")
    header = F.when((kind == "session_meta") & (F.coalesce(F.get_json_object(j, "$.payload.id"), F.lit("")) != ""), F.struct(F.get_json_object(j, "$.payload.id").alias("id"), F.get_json_object(j, "$.payload.cwd").alias("cwd")))
    order = Window.partitionBy("path").orderBy("off")
    rows = lines.withColumn("_h", header)
    latest = F.last("_h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("_h", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ordinal = F.expr("try_cast(get_json_object(line, '$.ordinal') as bigint)")
    rows = rows.withColumn("_s", F.coalesce(latest, first)).withColumn("ordinal", ordinal)
    message = F.coalesce(F.get_json_object(j, "$.payload.message"), F.lit(""))
    keep = (kind == "event_msg") & F.col("ordinal").isNotNull() & (F.get_json_object(j, "$.payload.type") == "user_message") & (message != "") & F.col("_s").isNotNull()
    session = F.col("_s.id")
    return rows.where(keep).select("path", "off", session.alias("session_id"), F.concat(session, F.lit(ORDINAL_MARK), F.col("ordinal").cast("string")).alias("prompt_id"), F.col("_s.cwd").alias("cwd"), message.alias("text"))


def dialect_c(lines: DataFrame) -> DataFrame:
    """User turns with text beyond white space, numbered from 0 within their file."""
    j = F.col("line")
    plain, blocks = _content(j, "$.content")
    text = joined_text(plain, blocks, any_kind=True)
    keep = F.get_json_object(j, "$['$set']").isNull() & (F.get_json_object(j, "$.type") == "user") & (F.coalesce(F.get_json_object(j, "$.id"), F.lit("")) != "") & (F.coalesce(T.trimmed(text), F.lit("")) != "")
    session = F.first(F.get_json_object(j, "$.sessionId"), ignorenulls=True).over(Window.partitionBy("path").orderBy("off").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lines.withColumn("session_id", session).where(keep)
    ordinal = F.row_number().over(Window.partitionBy("path").orderBy("off")) - 1
    rows = rows.withColumn("ordinal", ordinal)
    return rows.select("path", "off", "session_id", F.concat("session_id", F.lit(LONG_MARK), F.col("ordinal").cast("string")).alias("prompt_id"), F.get_json_object(j, "$.id").alias("record_id"), "ordinal", text.alias("text"))


def split_id(c: str, mark: str = ORDINAL_MARK) -> tuple[Column, Column]:
    """(session, ordinal) at the last mark; a null ordinal without one."""
    last = f"substring_index({c}, '{mark}', -1)"
    session = F.expr(f"substring({c}, 1, length({c}) - length({last}) - {len(mark)})")
    return session, F.expr(f"case when contains({c}, '{mark}') then try_cast({last} as bigint) end")


def flatten_pointer(pointers: DataFrame) -> DataFrame:
    """Nested work items to flat jobs."""
    return pointers.select(
        F.col("source.id").alias("source"), F.col("correlation.scheme").alias("scheme"), F.col("correlation.id").alias("prompt_id"), F.col("correlation.session_id").alias("session_id"),
        F.col("pointer.path").alias("path"), F.col("pointer.cwd").alias("cwd"), F.col("inline.text").alias("inline_text"),
    )


def hook_jobs(rows: DataFrame) -> DataFrame:
    """Hook payloads: the session id falls back over its three names; without a prompt id a row goes."""
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumn("session_id", F.coalesce(blank("session_id"), blank("conversation_id"), blank("thread_id"))).where(F.coalesce("prompt_id", F.lit("")) != "")


def resolve(jobs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Jobs with their text: inline text wins, else the prompt at (path, prompt_id); what stays without goes.

    Prompts with records and ordinals (the third dialect) answer to both kinds of id: one with the long mark means the ordinal after it,
    whatever session stands before it; one without means a record, of several the first."""
    if "record_id" in prompts.columns:
        ordinal = F.concat(F.lit(LONG_MARK), F.col("ordinal").cast("string"))
        records = prompts.where(~F.contains("record_id", F.lit(LONG_MARK))).groupBy("path", F.col("record_id").alias("_at")).agg(F.min_by("text", "off").alias("_found"))
        found = prompts.select("path", ordinal.alias("_at"), F.col("text").alias("_found")).unionByName(records)
        _, number = split_id("prompt_id", LONG_MARK)
        at = F.when(F.contains("prompt_id", F.lit(LONG_MARK)), F.concat(F.lit(LONG_MARK), number.cast("string"))).otherwise(F.col("prompt_id"))
    else:
        found, at = prompts.select("path", F.col("prompt_id").alias("_at"), F.col("text").alias("_found")), F.col("prompt_id")
    out = jobs.withColumn("_at", at).join(found, ["path", "_at"], "left").withColumn("text", F.coalesce(F.nullif(F.col("inline_text"), F.lit("")), "_found"))
    return out.where(F.col("text").isNotNull()).select(*(c for c in jobs.columns if c != "inline_text"), "text")


def with_ordinals(prompts: DataFrame, session: str, order: str) -> DataFrame:
    return prompts.withColumn("ordinal", F.row_number().over(Window.partitionBy(session).orderBy(order)) - 1)


def recent(prompts: DataFrame, session: str, order: str, text: str = "text", n: int = 3) -> DataFrame:
    """The last n prompts before each, newest first, on one line each and within the byte budget."""
    before = Window.partitionBy(session).orderBy(order).rowsBetween(-n, -1)
    return prompts.withColumn("recent_prompts", T.budgeted(F.reverse(F.collect_list(text).over(before))))


def last_prompt(events: DataFrame, session: str, order: str, is_prompt: Column, prompt_id: Column) -> DataFrame:
    """As-of linkage: each event's most recent prompt at or before it."""
    upto = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("last_prompt_id", F.last(F.when(is_prompt, prompt_id), ignorenulls=True).over(upto))


def sequence(events: DataFrame, session: str, order: str, records: Column) -> DataFrame:
    """1-based numbers of emitted records within a session; records: how many a row emits."""
    rows = events.withColumn("sub", F.explode(F.sequence(F.lit(0), records - 1)))
    return rows.withColumn("event_sequence", F.row_number().over(Window.partitionBy(session).orderBy(order, "sub")))


def cwd_context(jobs: DataFrame, heads: DataFrame) -> DataFrame:
    """Branch and project of a working directory, from a table (cwd, head, project); unknown ones are empty."""
    dim = heads.select("cwd", F.regexp_extract(F.trim("head"), r"^ref: refs/heads/(.*)$", 1).alias("branch"), "project")
    return jobs.join(dim, "cwd", "left").fillna("", ["branch", "project"])


def path_identity(c: str, marker: str) -> Column:
    """Account and organisation: the two path segments after a marker."""
    parts = F.split(F.col(c), "/")
    at = F.array_position(parts, marker)
    return F.when(at > 0, F.struct(F.try_element_at(parts, (at + 1).cast("int")).alias("account"), F.try_element_at(parts, (at + 2).cast("int")).alias("organisation")))
