"""Queries over records built from the tables: transcript lines, hooks, usage, redaction, gauges, passes, queues, metrics."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars, vocab
from ..functions import text as T
from ..operators import evaluation as V
from ..operators import events as E
from ..operators import loadstats, passes, queueing, sensitivity, transcripts
from ..scratch import scratch
from ..sources import loaders, sinks
from ..sources.tail import TranscriptTail
from ..streaming import processors, stateful
from ..streaming.delivery import Delivery
from ..streaming.landing import arrival, drained, landed, table_stream
from ..streaming.settings import Holder, Settings, enriched
from .registry import query, table


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("path", F.concat(F.lit("conv-"), F.col("conv_id").cast("string")))


def _lines_a(spark, sf_dir):
    """Conversations as lines of the first dialect, with all that it passes over."""
    rows = _turns(spark, sf_dir)
    second = F.when(F.col("conv_id") % 3 == 0, "tool_result").otherwise("text")
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(second.alias("type"), F.lit("!").alias("text")))
    head = [
        F.when(F.col("role") == "user", "user").otherwise("assistant").alias("type"), F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.concat(F.lit("p"), F.col("turn").cast("string"))).alias("promptId"),
        (F.col("turn") == 2).alias("isSidechain"), (F.col("conv_id") % 11 == 0).alias("isMeta"), F.col("path").alias("sessionId"), F.lit("/w").alias("cwd"),
    ]
    plain = F.to_json(F.struct(*head, F.struct(F.col("text").alias("content")).alias("message")))
    listed = F.to_json(F.struct(*head, F.struct(blocks.alias("content")).alias("message")))
    torn = F.when(F.col("conv_id") % 13 == 0, "{torn").otherwise(F.when(F.col("turn") % 4 == 0, plain).otherwise(listed))
    return rows.select("path", F.col("turn").alias("off"), torn.alias("line"))


_A = """select 'conv-' || conv_id as path, turn as off, 'p' || turn as prompt_id, 'conv-' || conv_id as session_id, case when turn % 4 = 0 then text else text || '!' end as text
from conversations where role = 'user' and conv_id % 5 <> 0 and turn <> 2 and conv_id % 11 <> 0 and conv_id % 13 <> 0 and (turn % 4 <> 0 or text <> '') and (turn % 4 = 0 or conv_id % 3 <> 0)"""


@query(_A)
def transcript_dialect_a(spark, sf_dir):
    return transcripts.dialect_a(_lines_a(spark, sf_dir)).select("path", "off", "prompt_id", "session_id", "text")


@query("""
with m as (select 'conv-' || conv_id as path, conv_id, turn, 2 * turn + 1 as off, text from conversations where role = 'user' and turn % 8 <> 6),
s as (select *, case when conv_id % 3 = 0 and off > 6 then 't' || conv_id when conv_id % 2 = 0 then 's' || conv_id when conv_id % 3 = 0 then 't' || conv_id end as session_id from m)
select path, off, session_id, session_id || '#' || turn as prompt_id, text from s where session_id is not null and text <> ''""")
def transcript_dialect_b(spark, sf_dir):
    """Headers at a file's head or within it; messages without an ordinal are passed over."""
    rows = _turns(spark, sf_dir)
    kind = F.when(F.col("role") == "user", "user_message").otherwise("agent_message")
    event = F.struct(F.lit("event_msg").alias("type"), F.when(F.col("turn") % 8 != 6, F.col("turn")).alias("ordinal"), F.struct(kind.alias("type"), F.col("text").alias("message")).alias("payload"))
    messages = rows.select("path", (2 * F.col("turn") + 1).alias("off"), F.to_json(event).alias("line"))

    def headers(mark: str, every: int, off: int):
        header = F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit(mark), F.col("conv_id").cast("string")).alias("id"), F.lit("/w").alias("cwd")).alias("payload"))
        return rows.where(F.col("conv_id") % every == 0).select("path", F.lit(off).cast("long").alias("off"), F.to_json(header).alias("line")).distinct()

    lines = messages.unionByName(headers("s", 2, 0)).unionByName(headers("t", 3, 6))
    return transcripts.dialect_b(lines).select("path", "off", "session_id", "prompt_id", "text")


@query("""
with k as (select conv_id, turn, case when conv_id % 9 = 0 and turn = 0 then '  ' else text end as text from conversations where role = 'user' and turn % 8 <> 4),
o as (select *, row_number() over (partition by conv_id order by turn) - 1 as ordinal from k where trim(text, ' \t\n\r') <> '')
select 'conv-' || conv_id as path, turn as off, 'conv-' || conv_id || '########' || ordinal as prompt_id, 'r' || turn as record_id, ordinal::int as ordinal, text from o""")
def transcript_dialect_c(spark, sf_dir):
    """Turns are numbered by those that count; updates, blank texts and records without an id don't."""
    return transcripts.dialect_c(_lines_c(spark, sf_dir)).select("path", "off", "prompt_id", "record_id", "ordinal", "text")


def _lines_c(spark, sf_dir):
    rows = _turns(spark, sf_dir)
    text = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), "  ").otherwise(F.col("text"))
    record = F.struct(F.when(F.col("role") == "user", "user").otherwise("gemini").alias("type"), F.when(F.col("turn") % 8 == 4, "").otherwise(F.concat(F.lit("r"), F.col("turn").cast("string"))).alias("id"), text.alias("content"))
    meta = rows.select("path", F.lit(-1).cast("long").alias("off"), F.to_json(F.struct(F.col("path").alias("sessionId"))).alias("line")).distinct()
    update = rows.select("path", F.lit(100).cast("long").alias("off"), F.to_json(F.create_map(F.lit("$set"), F.col("text"))).alias("line"))
    return rows.select("path", F.col("turn").alias("off"), F.to_json(record).alias("line")).unionByName(meta).unionByName(update)


@query("""
with k as (select conv_id, turn, case when conv_id % 9 = 0 and turn = 0 then '  ' else text end as text from conversations where role = 'user' and turn % 8 <> 4),
o as (select *, row_number() over (partition by conv_id order by turn) - 1 as ordinal from k where trim(text, ' \t\n\r') <> ''),
j as (select event_id, event_id % 90 as conv_id, (event_id // 90) % 6 as n, event_id % 4 as way from events)
select event_id, case way when 0 then 'conv-' || j.conv_id || '########' || n when 1 then 'r' || n when 2 then 'moved########' || n else 'conv-' || j.conv_id || '########x' end as prompt_id, o.text as text
from j join o on o.conv_id = j.conv_id and case way when 1 then o.turn = n when 3 then false else o.ordinal = n end""")
def resolved_records(spark, sf_dir):
    """Ids with the long mark find a prompt by its number, ids without by their record; a number that is none finds nothing."""
    e, n = F.col("event_id"), (F.floor(F.col("event_id") / 90) % 6).cast("string")
    path = F.concat(F.lit("conv-"), (e % 90).cast("string"))
    made = F.when(e % 4 == 0, F.concat(path, F.lit("########"), n)).when(e % 4 == 1, F.concat(F.lit("r"), n)).when(e % 4 == 2, F.concat(F.lit("moved########"), n)).otherwise(F.concat(path, F.lit("########x")))
    jobs = table(spark, sf_dir, "events").select("event_id", path.alias("path"), made.alias("prompt_id"), F.lit("").alias("inline_text"))
    return transcripts.resolve(jobs, transcripts.dialect_c(_lines_c(spark, sf_dir))).select("event_id", "prompt_id", "text")


@query(f"""
with p as ({_A}), j as (select event_id, 'conv-' || (event_id % 90) as path, 'p' || (event_id % 5) as prompt_id, case when event_id % 3 = 0 then 'inline ' || event_id when event_id % 3 = 1 then '' end as inline_text from events)
select event_id, j.path, j.prompt_id, coalesce(nullif(inline_text, ''), p.text) as text from j left join p on p.path = j.path and p.prompt_id = j.prompt_id where coalesce(nullif(inline_text, ''), p.text) is not null""")
def resolved_jobs(spark, sf_dir):
    """Jobs as nested pointers, made flat and given the text that they point to."""
    e, inline = F.col("event_id"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("inline "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "")
    nested = table(spark, sf_dir, "events").select(
        F.struct(F.lit("s").alias("id")).alias("source"), F.struct(F.lit("prompt").alias("scheme"), F.concat(F.lit("p"), (e % 5).cast("string")).alias("id"), e.cast("string").alias("session_id")).alias("correlation"),
        F.struct(F.concat(F.lit("conv-"), (e % 90).cast("string")).alias("path"), F.lit("/w").alias("cwd")).alias("pointer"), F.struct(inline.alias("text")).alias("inline"),
    )
    jobs = transcripts.flatten_pointer(nested)
    got = transcripts.resolve(jobs, transcripts.dialect_a(_lines_a(spark, sf_dir)))
    return got.select(F.col("session_id").cast("long").alias("event_id"), "path", "prompt_id", "text")


@query("""select event_id, coalesce(case when event_id % 2 = 0 then 's' || user_id end, case when event_id % 3 = 0 then 'c' || user_id end, case when event_id % 5 = 0 then 't' || user_id end) as session_id,
  'x#' || event_id as prompt_id, 'x' as head, event_id as ordinal from events where event_id % 7 <> 0""")
def hook_sessions(spark, sf_dir):
    """Hook payloads: the session by the first of three names; ids are cut at the last mark."""
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 2 == 0, F.concat(F.lit("s"), u)).otherwise("").alias("session_id"), F.when(e % 3 == 0, F.concat(F.lit("c"), u)).alias("conversation_id"),
        F.when(e % 5 == 0, F.concat(F.lit("t"), u)).alias("thread_id"), F.when(e % 7 != 0, F.concat(F.lit("x#"), e.cast("string"))).alias("prompt_id"),
    )
    head, ordinal = transcripts.split_id("prompt_id")
    return transcripts.hook_jobs(rows).select("event_id", "session_id", "prompt_id", head.alias("head"), ordinal.alias("ordinal"))


@query("""
with h(k, branch, project) as (values (0, 'main', 'a'), (1, 'feat/x', 'b'), (2, '', 'c'))
select event_id, coalesce(branch, '') as branch, coalesce(project, '') as project, case when user_id % 2 = 0 then 'acc' || user_id % 10 end as account, case when user_id % 2 = 0 then 'org' end as organisation
from events left join h on h.k = user_id % 5""")
def working_dirs(spark, sf_dir):
    """Branch and project of a working directory by a table of heads; account and organisation out of a path."""
    heads = spark.createDataFrame([("/w/0", "ref: refs/heads/main\n", "a"), ("/w/1", "ref: refs/heads/feat/x", "b"), ("/w/2", "9fceb02d", "c")], "cwd string, head string, project string")
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("/w/"), (u % 5).cast("string")).alias("cwd"), F.when(u % 2 == 0, F.concat(F.lit("/home/mark/acc"), (u % 10).cast("string"), F.lit("/org/f"))).otherwise("/home/x").alias("file"))
    who = transcripts.path_identity("file", "mark")
    return transcripts.cwd_context(rows, heads).select("event_id", "branch", "project", who["account"].alias("account"), who["organisation"].alias("organisation"))


@query("""
with p as (select event_id, unnest([{'pos': 0, 'name': 'tokens.input', 'value': event_id % 50}, {'pos': 1, 'name': 'tokens.output', 'value': event_id % 7}, {'pos': 2, 'name': 'tokens.cache_read', 'value': event_id % 3}, {'pos': 3, 'name': 'tokens.cache_write', 'value': 0}]) as x
  from events where event_type in ('view', 'purchase') and event_id % 4 <> 0)
select x.name as name, count(*) as n, sum(x.value)::bigint as total, string_agg(distinct 'model=m' || (event_id % 2), ',' order by 'model=m' || (event_id % 2)) as attributes from p where x.pos < 2 or x.value > 0 group by x.name""")
def usage_metrics(spark, sf_dir):
    """Assistant lines with usage to points of metrics, with attributes; no text of theirs goes along."""
    e = F.col("event_id")
    usage = F.struct((e % 50).alias("input_tokens"), (e % 7).alias("output_tokens"), (e % 3).alias("cache_read_input_tokens"), F.lit(0).alias("cache_creation_input_tokens"))
    message = F.struct(F.when(e % 4 != 0, usage).alias("usage"), F.lit("secret answer").alias("content"))
    line = F.to_json(F.struct(F.when(F.col("event_type").isin("view", "purchase"), "assistant").otherwise("user").alias("type"), message.alias("message")))
    points = E.usage_points(table(spark, sf_dir, "events").select("event_id", line.alias("line")))
    points = points.withColumn("model", F.concat(F.lit("m"), (e % 2).cast("string"))).withColumn("none", F.lit(""))
    flat = F.array_join(F.transform(sinks.attributes({"model": "model", "none": "none"}), lambda a: F.concat(a["key"], F.lit("="), a["value"])), ",")
    sinks.assert_no_raw_text(points)
    return points.withColumn("_a", flat).groupBy("name").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.array_join(F.array_sort(F.collect_set("_a")), ",").alias("attributes"))


_SAMPLED = "('0x' || substr(md5(event_id::varchar), 1, 8))::bigint / 4294967296.0"


@query(f"select event_id, case when event_type = 'view' then 'daemon.start' else event_type end as code from events where (event_type = 'view' or event_type in ('error', 'signup')) and {_SAMPLED} < 0.25")
def event_gate(spark, sf_dir):
    """A severity floor that some codes pass, and sampling by a hash."""
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "daemon.start").otherwise(F.col("event_type")).alias("code"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "critical").when(F.col("event_type") == "click", "odd").otherwise("info").alias("severity"))
    return E.gate(rows, "error", 0.25).select("event_id", "code")


@query("select event_id, source from (select event_id, case user_id % 3 when 0 then 'cowork' when 1 then 'codex' end as source from events) where source = 'cowork'")
def telemetry_allowed(spark, sf_dir):
    u = F.col("user_id") % 3
    return E.telemetry_sources(table(spark, sf_dir, "events").select("event_id", F.when(u == 0, "cowork").when(u == 1, "codex").alias("source")))


@query(f"""
select event_id, case when event_id % 4 = 0 then '{{"n":"' || event_id || '","s":"<redacted>"}}' when event_id % 4 = 1 then '{{"n":"' || event_id || '","s":"f.txt"}}' when event_id % 4 = 2 then '{{"n":"' || event_id || '","s":"' || event_type || '"}}' else '{{"n":"' || event_id || '"}}' end as fields,
  'OSError: open <path> ' || event_type as error, 'a_' || '_b' || event_id as name, left(props, 5) as clipped from events""")
def redacted_fields(spark, sf_dir):
    """Fields, error messages, file names and clipped texts as they may leave."""
    e, kind = F.col("event_id"), F.col("event_type")
    value = F.when(e % 4 == 0, F.concat(F.lit("see /etc/passwd for "), kind)).when(e % 4 == 1, F.lit("C:\\Users\\me\\f.txt")).when(e % 4 == 2, kind)
    rows = table(spark, sf_dir, "events").withColumn("fields", F.create_map(F.lit("n"), e.cast("string"), F.lit("s"), value))
    error = T.redact_error(F.lit("OSError"), F.concat(F.lit("open\t/tmp/x "), kind))
    return E.redact(rows).select("event_id", F.to_json("fields").alias("fields"), error.alias("error"), T.safe_name(F.concat(F.lit("a_/b"), e.cast("string"))).alias("name"), T.clip("props", 5).alias("clipped"))


@query("""
select event_id, least(10, greatest(1, round_even(10 - 9 * greatest(0, least(1, (event_id % 100 - 60.0) / 25.0)), 0)))::int as threads, 2 * greatest(0, least(1, (event_id % 100 - 60.0) / 25.0)) as pause_s,
  case when event_id % 6 = 0 then 0.0 else (event_id % 6 - 2.0) / (event_id % 6) end as falls, coalesce(case when event_id % 2 = 0 then event_id end, -1) as laid_over, strpos(event_type, 'i') - 1 as first_i,
  least(0.5 * pow(2, event_id % 12), 30.0) * ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint / 4294967296.0 as wait_s, event_type || '-v6' as versioned, case when event_id % 2 = 0 then event_type || '-c' || event_id else event_type || '-custom' end as producer
from events""")
def engine_scalars(spark, sf_dir):
    e = F.col("event_id")
    load, version = e % 100, F.when(e % 2 == 0, F.concat(F.lit("-c"), e.cast("string"))).otherwise("-custom")
    kinds = ("signup", "purchase", "view", "click", "error")
    named = F.create_map(*(F.lit(x) for k in kinds for x in (k, T.versioned(k))))
    custom = F.create_map(*(F.lit(x) for k in kinds for x in (k, T.custom_producer(k, None).removesuffix("-custom"))))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.threads(load).alias("threads"), scalars.pacing_interval(load).alias("pause_s"), scalars.relative_drop((e % 6).cast("double"), F.lit(2.0)).alias("falls"),
        scalars.overlay(F.when(e % 2 == 0, e), F.lit(-1).cast("long")).alias("laid_over"), scalars.first_offset(F.col("event_type"), F.lit("i")).cast("long").alias("first_i"),
        scalars.jittered(scalars.backoff(e % 12 + 1), "event_id").alias("wait_s"), named[F.col("event_type")].alias("versioned"), F.concat(custom[F.col("event_type")], version).alias("producer"),
    )


@query("""
with recursive o as (select user_id, epoch_us(ts) as t, value as v, row_number() over (partition by user_id order by ts, event_id) as r from events),
e as (select user_id, t, 0::bigint as r0, r from o where r = 1
  union all select user_id, t, r0, r from (select o.user_id, o.t, e.r as r0, o.r, row_number() over (partition by o.user_id order by o.r) as k from e join o on o.user_id = e.user_id and o.r > e.r and o.t - e.t >= 86400000000) where k = 1)
select e.user_id, e.t as at_us, round(min(o.v), 6) as min, round(max(o.v), 6) as max, round(avg(o.v), 6) as mean, round(stddev_pop(o.v), 6) as std, round(arg_max(o.v, o.r), 6) as last, count(*) as n, round((e.t - min(o.t)) / 1e6, 6) as window_s
from e join o on o.user_id = e.user_id and o.r > e.r0 and o.r <= e.r group by e.user_id, e.t""")
def gauge_triggers(spark, sf_dir):
    got = E.triggered_gauges(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 86_400.0)
    return got.select("user_id", "at_us", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "last")), "n", F.round("window_s", 6).alias("window_s"))


@query("select user_id, count(distinct event_type) as n_roles, round(sum(value), 4) as total, round(sum(value) filter (event_type = 'view'), 4) as viewed from events group by user_id")
def role_totals(spark, sf_dir):
    got = loadstats.role_sums(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value")
    return got.select("user_id", F.size("by_role").cast("long").alias("n_roles"), F.round("total", 4).alias("total"), F.round(F.try_element_at("by_role", F.lit("view")), 4).alias("viewed"))


_GOLD = "(select doc_id, case quality when 0 then 'poor' else 'none' end as gold, case when len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x0B\\f]+')) >= 60 then 'none' else 'poor' end as pred, source as class from documents join labels using (doc_id))"


@query(f"""select round(coalesce(count(*) filter (gold = 'poor' and pred = gold) / nullif(count(*) filter (gold = 'poor'), 0), 1.0), 6) as recall,
  round(coalesce(count(*) filter (class = 'src1' and pred = 'poor') / nullif(count(*) filter (class = 'src1'), 0), 0.0), 6) as false_rate from {_GOLD}""")
def sensitive_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select(F.when(F.col("quality") == 0, "poor").otherwise("none").alias("gold"), F.when(T.words("text") >= 60, "none").otherwise("poor").alias("pred"), F.col("source").alias("class"))
    recall, false = V.recall(rows, "gold", "pred"), V.false_rate(rows, "src1", "pred", "poor", "false_rate")
    one = recall.withColumn("_k", F.lit(1)).join(false.withColumn("_k", F.lit(1)), "_k")  # a row each
    return one.select(F.round("recall", 6).alias("recall"), F.round("false_rate", 6).alias("false_rate"))


@query("""with g as (select doc_id, row_number() over (order by doc_id) - 1 as r from labels), p as (select conv_id * 100 + turn as k, row_number() over (order by conv_id * 100 + turn) - 1 as r from conversations)
select g.r as row_id, g.doc_id, p.k as turn_key from g join p using (r)""")
def positional_pairs(spark, sf_dir):
    gold = table(spark, sf_dir, "labels").select("doc_id")
    pred = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"))
    return V.positional(gold, pred, "doc_id").select("row_id", F.col("gold_doc_id").alias("doc_id"), F.col("pred_doc_id").alias("turn_key"))


@query("select event_type, event_id from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc) as k from events) where k <= 40")
def completed_memory(spark, sf_dir):
    return queueing.last_completed(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], 40).select("event_type", "event_id")


@query("""select user_id, count(*) as n_events, arg_min(event_type, (ts, event_type)) as first_code, arg_max(event_type, (ts, event_type)) as last_code from events group by user_id""")
def event_envelopes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_type").alias("code"), F.lit("info").alias("severity"))
    got = E.envelope(rows, ["user_id"])
    n = F.size(F.from_json("body", "events array<struct<code:string>>")["events"])
    codes = F.from_json("body", "events array<struct<code:string>>")["events"]["code"]
    return got.where(n == F.col("n_events")).select("user_id", "n_events", codes[0].alias("first_code"), F.element_at(codes, -1).alias("last_code"))


@query("select event_id, event_id % 10 = 0 as poison, case when event_id % 10 = 0 then 'e__' || event_id || '.json' end as file, case when event_id % 10 <> 0 then props->>'k' end::int as k from events where event_type <> 'purchase' or event_id % 10 = 0")
def spool_drain(spark, sf_dir):
    """What one drain leaves: undecodable bodies are set aside under a safe name, settled ones go, failed ones stay."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("e/.."), e.cast("string")).alias("id"), F.when(e % 10 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("body"), "event_type")
    _, left, poison = queueing.drained(rows, rows.select("event_id", (F.col("event_type") == "purchase").alias("ok")), "event_id", "body", "k int")
    good = left.select("event_id", F.lit(False).alias("poison"), F.lit(None).cast("string").alias("file"), F.from_json("body", "k int")["k"].alias("k"))
    return good.unionByName(poison.select("event_id", F.lit(True).alias("poison"), "file", F.lit(None).cast("int").alias("k")))


@query("select event_type as source, max(ts) as newest from events group by event_type having max(ts) >= timestamp '2024-01-30 12:00:00' and event_type not in (select event_type from events where event_id < 3)")
def uncaptured_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    files = rows.select(F.col("event_type").alias("source"), F.col("ts").alias("modified"))
    return loaders.hidden_sources(files, rows.where("event_id < 3").select(F.col("event_type").alias("source")), datetime(2024, 1, 31, 12), 24)


@query("""
with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+|\\?') as w, regexp_extract_all(coalesce(text, ''), '""" + vocab.ENTITY_PATTERNS["email"] + """') as mails from documents),
v as (select *, len(list_filter(w, lambda x: list_contains(['und', 'der'], x))) as n_de, len(list_filter(w, lambda x: list_contains(['and', 'the'], x))) as n_en from t)
select doc_id, case when n_de + n_en = 0 then '' when n_de >= n_en then 'de' else 'en' end as tongue, case when n_en = 0 then '' else 'tagged' end as tag,
  list_transform(mails, lambda x: '***@' || list_last(string_split(x, '@')))::varchar[] as mails, case when n_de + n_en > 0 and n_de >= n_en then 'first' else '' end as depends from v""")
def custom_passes(spark, sf_dir):
    """Custom passes of each kind: a single label, one label against its opposite, entities, and labels that depend on an earlier facet."""
    words = {"tongue": {"de": ["und", "der"], "en": ["and", "the"], "other": []}, "tag": {"english": ["and", "the"], "Not english": []}, "sub": {"one": ["und", "der"], "two": []}}
    backend = passes.KeywordBackend(words)
    rows = table(spark, sf_dir, "documents")
    tongue = passes.custom(passes.CustomPass("tongue", "single_label", (("de", "de"), ("en", "en"), ("", "other"))), F.col("text"), backend, {})["labeled"]["value"]
    tag = passes.custom(passes.CustomPass("k", "single_label", (("tagged", "english"),), title="tag"), F.col("text"), backend, {})["labeled"]["value"]
    mails = passes.custom(passes.CustomPass("mails", "entity", (("email", ""),)), F.col("text"), backend, {})["entities"]
    p = passes.CustomPass("sub", "single_label", (), condition_on="tongue", subsets=(("de", (("first", "one"), ("second", "two"))),))
    depends = passes.custom(p, F.col("text"), backend, {"tongue": F.col("tongue")})["labeled"]["value"]
    got = rows.select("doc_id", "text", tongue.alias("tongue"), tag.alias("tag"), F.transform(mails, lambda m: m["masked"]).alias("mails"))
    return got.select("doc_id", "tongue", "tag", "mails", depends.alias("depends"))


_SPECS = """(select event_id, case when event_id % 7 = 0 then 'domain' when event_id % 11 = 0 then '' else event_type end as key, (['entity', 'tree', 'single_label', 'multi_label', 'relation'])[event_id % 5 + 1] as kind,
  event_id % 4 as n_labels, event_id % 3 as n_subsets, event_id % 13 = 0 as is_system from events)"""


@query(f"""
select event_id, case when why = '' then 'kept' else 'rejected' end as fate, why from (select event_id, case when key = '' then 'no key' when kind not in ('entity', 'single_label', 'multi_label') then 'unknown kind ' || kind when n_labels + n_subsets = 0 then 'no labels' else '' end as why
  from {_SPECS} where not is_system and key not in ('task_type', 'domain', 'sensitivity', 'speech_act', 'activity_type', 'personal', 'function_guess', 'subcategory'))""")
def screened_passes(spark, sf_dir):
    """Which passes run, of events read as passes; system and built-in keys go silently."""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ("entity", "tree", "single_label", "multi_label", "relation")))
    key = F.when(e % 7 == 0, "domain").when(e % 11 == 0, "").otherwise(F.col("event_type"))
    specs = table(spark, sf_dir, "events").select("event_id", key.alias("key"), F.element_at(kinds, (e % 5 + 1).cast("int")).alias("kind"), (e % 4).alias("n_labels"), (e % 3).alias("n_subsets"), (e % 13 == 0).alias("is_system"))
    return passes.screened(specs).select("event_id", "fate", "why")


@query(f"select coalesce(string_agg(distinct why, ',' order by why), '') as digest from (select case when key = '' then 'no key' when kind not in ('entity', 'single_label', 'multi_label') then 'unknown kind ' || kind when n_labels + n_subsets = 0 then 'no labels' end as why from {_SPECS} where not is_system and key <> 'domain')")
def reject_reasons(spark, sf_dir):
    """The set of reasons for which passes were rejected, as one text whatever their order."""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, ("entity", "tree", "single_label", "multi_label", "relation")))
    key = F.when(e % 7 == 0, "domain").when(e % 11 == 0, "").otherwise(F.col("event_type"))
    specs = table(spark, sf_dir, "events").select(key.alias("key"), F.element_at(kinds, (e % 5 + 1).cast("int")).alias("kind"), (e % 4).alias("n_labels"), (e % 3).alias("n_subsets"), (e % 13 == 0).alias("is_system"))
    return queueing.set_digest(passes.screened(specs).where("fate = 'rejected'"), "why")


@query("""select doc_id, len(regexp_extract_all(coalesce(text, ''), '""" + vocab.ENTITY_PATTERNS["email"] + """')) as n_entities, true as blanked from documents""")
def published_entities(spark, sf_dir):
    """Documents as published: entities without their text, one JSON document each."""
    rows = table(spark, sf_dir, "documents")
    entities = passes.KeywordBackend().entities(F.col("text"), ["email"])
    sent = sinks.published(rows.select("doc_id", entities.alias("entities")))
    back = F.from_json("value", "doc_id long, entities array<struct<label:string,text:string>>")
    got = sent.select("value", back.alias("b"))
    return got.select("b.doc_id", F.size("b.entities").cast("long").alias("n_entities"), (F.forall("b.entities", lambda e: e["text"].isNull()) & ~F.contains("value", F.lit("@"))).alias("blanked"))


_CASES = [("<token>", True, False), ("${API_KEY}", True, False), ("****", True, False), ("YOUR_KEY", True, False), ("changeme", True, False), ("hunter2", False, False), ("lgtm", False, True), ("yes, go ahead", False, True), ("fix the bug", False, False), ("", False, False), ("4111 1111 1111 1111", False, False)]


@query(f"select p_partkey, value, placeholder, gated, card, masked from part join (values " + ", ".join(f"({i}, '{v}', {p}, {g}, {'true' if v.startswith('4111') else 'false'}, '{'***' if len(v) <= 6 else '…' + v[-4:]}')" for i, (v, p, g) in enumerate(_CASES)) + f") t(k, value, placeholder, gated, card, masked) on k = p_partkey % {len(_CASES)}")
def stated_cases(spark, sf_dir):
    """Placeholders, approvals, card numbers and masks, case by case, a case for each part."""
    value = F.element_at(F.array(*(F.lit(v) for v, *_ in _CASES)), (F.col("p_partkey") % len(_CASES) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", value.alias("value"))
    return rows.select("p_partkey", "value", T.is_placeholder("value").alias("placeholder"), T.content_free("value").alias("gated"), T.luhn("value").alias("card"), T.mask(F.lit("secret"), "value").alias("masked"))


@query("select event_id, case when event_type = 'error' then 'phi' when event_type in ('view', 'click') then 'secrets' when event_type = 'purchase' then 'pii' end as class, 800 + event_id % 50 as ceiling_mb, greatest(800 + event_id % 50, 2000 - event_id % 300) as hard_mb from events")
def severity_and_limits(spark, sf_dir):
    e, kind = F.col("event_id"), F.col("event_type")
    labels = F.when(kind == "error", F.array(F.lit("email"), F.lit("ssn"))).when(kind.isin("view", "click"), F.array(F.lit("phone"), F.lit("api_key"))).when(kind == "purchase", F.array(F.lit("person"))).otherwise(F.array(F.lit("language")))
    limits = scalars.memory_limits(F.lit(800), e % 50, F.lit(2000), e % 300)
    return table(spark, sf_dir, "events").select("event_id", T.severity_class(labels).alias("class"), limits["ceiling_mb"].cast("long").alias("ceiling_mb"), limits["hard_mb"].cast("long").alias("hard_mb"))


@query("""
select event_id, '{"at":{"file":"' || case when event_id % 3 = 0 then 'b.py' else '<redacted>' end || '","kind":"' || event_type || '","more":{"k":' || (props->>'k') || ',"note":"<redacted>","ok":' || case when event_id % 2 = 0 then 'true' else 'false' end || '}},"id":' || event_id || ',"share":0.5,"text":"5"}' as fields from events""")
def redacted_props(spark, sf_dir):
    """Nested fields by their real types, at every depth: numbers and booleans pass, strings are vetted, nulls and lists go."""
    e = F.col("event_id")
    more = F.concat(F.lit('"more":{"ok":'), (e % 2 == 0).cast("string"), F.lit(',"note":"a sentence of words","none":null,"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    at = F.concat(F.lit('"at":{"kind":"'), F.col("event_type"), F.lit('","file":"'), F.when(e % 3 == 0, "/home/u/b.py").otherwise("saw /home/u/b.py"), F.lit('",'), more, F.lit(',"list":[1,{"a":"b"}]}'))
    fields = F.concat(F.lit('{"id":'), e.cast("string"), F.lit(',"share":0.5,"text":"5","gone":null,'), at, F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", T.redact_json(fields).alias("fields"))


# -- the same over streams -------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    return table_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("select event_type, user_id, min(event_id) as event_id from events group by event_type, user_id")
def stream_dedup(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("event_type", "user_id", "event_id")
    return landed(stateful.dedup(rows, "user_id", "event_id", "event_type", remembered=1_000_000), "dedup")


@query("""select conv_id, turn, row_number() over (partition by conv_id order by turn) as event_sequence,
  last_value(case when role = 'user' then conv_id || '#' || turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as last_prompt_id from conversations""")
def stream_sequence(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "conversations")
    pid = F.when(F.col("role") == "user", F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string")))
    return landed(stateful.sequence(rows.select("conv_id", "turn", pid.alias("pid"), arrival().alias("at")), "conv_id", "turn", "pid", "at"), "sequence")


@query("""
with o as (select user_id, ts, event_id, coalesce(value > 40, false) as over_it from events),
n as (select *, case when over_it <> coalesce(lag(over_it) over w, false) then 1 else 0 end as fresh from o window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as island from n),
e as (select *, case when over_it then epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id, island order by ts, event_id) end / 1e6 as el from i),
s as (select *, case when el >= 14400 then 'critical' when el >= 7200 then 'error' when el >= 3600 then 'warn' end as severity from e),
b as (select *, lag(severity) over (partition by user_id order by ts, event_id) as prior from s)
select user_id, epoch_us(ts) as at_us, coalesce(severity, prior) as severity, severity is null as recovered from b
where (severity is not null and severity is distinct from prior) or (severity is null and prior is not null)""")
def stream_sustained(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select("user_id", "ts", "value")
    got = landed(stateful.sustained(rows, "user_id", "ts", "value", 40.0, 3600.0), "sustained")
    return got.select("user_id", F.unix_micros("ts").alias("at_us"), "severity", "recovered")


@query("""
with l as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as fresh from events window w as (partition by user_id order by event_id)),
r as (select *, sum(fresh) over (partition by user_id order by event_id) as run from l), g as (select user_id, run, min(event_id) as event_id, min(event_type) as event_type, count(*) as count from r group by user_id, run)
select user_id, event_id, event_type, count from g where run < (select max(run) from r where r.user_id = g.user_id)""")
def stream_runs(spark, sf_dir):
    """Runs that the next has ended; the last of each group is still open."""
    return landed(stateful.runs(_event_stream(spark, sf_dir).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type"), "runs")


@query("""
with recursive o as (select user_id, epoch_us(ts) as t, value as v, row_number() over (partition by user_id order by ts, event_id) as r from events),
e as (select user_id, t, 0::bigint as r0, r from o where r = 1
  union all select user_id, t, r0, r from (select o.user_id, o.t, e.r as r0, o.r, row_number() over (partition by o.user_id order by o.r) as k from e join o on o.user_id = e.user_id and o.r > e.r and o.t - e.t >= 86400000000) where k = 1)
select e.user_id, e.t as at_us, round(min(o.v), 6) as min, round(max(o.v), 6) as max, count(*) as n from e join o on o.user_id = e.user_id and o.r > e.r0 and o.r <= e.r group by e.user_id, e.t""")
def stream_gauges(spark, sf_dir):
    got = landed(stateful.gauges(_event_stream(spark, sf_dir).select("user_id", "ts", "value"), "user_id", "ts", "value", 86_400.0), "gauges")
    return got.select("user_id", F.unix_micros("ts").alias("at_us"), F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), "n")


@query(r"""
with w as (select lang, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\x0B\f]+')) as w from documents)
select lang, count(*) as n, round(avg(w), 6) as mean, round(stddev_samp(w), 6) as std from w where w > 0 group by lang""")
def stream_lengths(spark, sf_dir):
    rows = table_stream(spark, sf_dir, "documents").select("lang", T.words("text").alias("words"))
    got = landed(stateful.length_state(rows, "lang", "words"), "lengths").where("n > 0")
    return got.select("lang", "n", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.try_divide("m2", F.col("n") - 1)), 6).alias("std"))


@query("""
with n as (select user_id, event_id, event_type, count(*) filter (event_type in ('error', 'signup')) over w as handed, coalesce(bool_or(event_type = 'purchase') over w, false) as done from events window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding)),
o as (select *, row_number() over (partition by user_id, handed order by event_id) as k from n where event_type not in ('error', 'signup', 'purchase'))
select user_id, event_id from o where k = 1 and not done""")
def stream_inflight(spark, sf_dir):
    """Offers against keys in flight: a worker takes a key with signups and errors, a purchase publishes it."""
    rows = _event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    offers = rows.where("event_type not in ('error', 'signup', 'purchase')")
    kinds = F.when(F.col("event_type") == "purchase", processors.COMPLETE).otherwise(processors.NEXT)
    outcomes = _event_stream(spark, sf_dir).where("event_type in ('error', 'signup', 'purchase')").select("user_id", "event_id", kinds.alias("kind"))
    return landed(processors.admitted(offers, outcomes, ["user_id"], "event_id"), "inflight")


@query("""
with l as (select *, case when event_type = lag(event_type) over w then 0 else 1 end as fresh from events window w as (partition by user_id order by event_id)),
r as (select *, sum(fresh) over (partition by user_id order by event_id) as run from l), g as (select user_id, run, min(event_id) as event_id, min(event_type) as event_type, count(*) as count from r group by user_id, run)
select user_id, event_id, event_type, count, case when k = least(n, 8) then greatest(n - 8, 0) else 0 end as dropped from (select *, row_number() over (partition by user_id order by run desc) as k, count(*) over (partition by user_id) as n from g) where k <= 8""")
def stream_ring(spark, sf_dir):
    """Rings of eight runs per user, drained by a timer: the newest runs, the last included."""
    rows = _event_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    return drained(processors.ring(rows, ["user_id"], "event_id", ["event_type"], capacity=8, drain_ms=1_000), "ring")


def _flaky(batch):
    """A sink that needs one to seven attempts for a row, refuses some for good and raises for none."""
    need = batch["event_id"] % 7 + 1
    return [422 if i % 50 == 13 else 200 if a >= n else 503 for i, a, n in zip(batch["event_id"], batch["attempt"], need)]


@query("""
select event_id, case when event_id % 50 = 13 then 1 else least(event_id % 7 + 1, 4) end as attempts, case when event_id % 50 = 13 or event_id % 7 + 1 > 4 then 'quarantine' else 'done' end as state, event_id % 50 = 13 or event_id % 7 + 1 > 4 as dead from events""")
def stream_delivery(spark, sf_dir):
    """Events to a flaky sink: attempts by round, the fourth failure and what is refused to the dead letters."""
    folder = scratch(spark, "delivery")
    to = Delivery(f"{folder}/to", ("event_id",), "event_id", _flaky)
    to.stream(_event_stream(spark, sf_dir).select("event_id", "user_id", "event_type"), f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    to.sweep(spark)
    dead = to.dead_letters(spark).select("event_id", F.lit(True).alias("_d"))
    return to.settled(spark).join(dead, "event_id", "left").select("event_id", "attempts", "state", F.coalesce("_d", F.lit(False)).alias("dead"))


@query("""
select doc_id, case when doc_id % 3 = 0 then 'first' else 'second' end as document, list_filter(case when doc_id % 3 = 0 then ['and', 'von'] else ['entre', 'para', 'the'] end, lambda w: contains(lower(coalesce(text, '')), w)) as labels from documents""")
def stream_settings(spark, sf_dir):
    """Passes that change between batches: the second batch works with another document, the third with a broken one that is not taken."""
    folder, source = scratch(spark, "settings"), scratch(spark, "settings-in")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("web").alias("source"), "text").withColumn("meta", _no_meta())
    words = lambda *w: json.dumps({"enrichment_schema": {"passes": {"words": {"key": "words", "kind": "multi_label", "labels": [{"id": x, "text": x} for x in w]}, "domain": {"key": "domain", "kind": "entity"}}}})
    named = {Settings.parse(words("and", "von")).version: "first", Settings.parse(words("entre", "para", "the")).version: "second"}
    holder = Holder(f"{folder}/now.json", f"{folder}/good.json")
    for i, said in enumerate((words("and", "von"), words("entre", "para", "the"), "{broken")):
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/written")
        _moved(spark, f"{folder}/written", f"{folder}/now.json")
        docs.where(F.col("doc_id") % 3 == i).write.mode("append").parquet(source)
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        stream = spark.readStream.schema(docs.schema).parquet(source)
        enriched(stream, holder, write, keep=["doc_id"], gating=False).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{folder}/out")
    return got.select("doc_id", F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("settings_version")].alias("document"), F.transform(F.col("custom")["words"]["labels"], lambda r: r["label"]).alias("labels"))


def _no_meta():
    return F.struct(*(F.lit("").alias(k) for k in ("repo", "branch", "project", "tool")), F.array().cast("array<string>").alias("recent_prompts"))


def _moved(spark, folder, path):
    """The one text file of a folder as a document at a path."""
    jvm = spark._jvm
    root, to = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part-"))
    fs.delete(to, False)
    fs.rename(part, to)


def _transcripts(spark, sf_dir):
    """Conversations written as transcript files, *.jsonl."""
    folder = scratch(spark, "transcripts")
    lines = _lines_a(spark, sf_dir).repartition(4, "path").sortWithinPartitions("path", "off").select("line")
    lines.write.text(f"{folder}/logs")
    path = spark._jvm.org.apache.hadoop.fs.Path
    root = path(f"{folder}/logs")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for s in fs.listStatus(root):
        if s.getPath().getName().startswith("part-"):
            fs.rename(s.getPath(), path(root, s.getPath().getName().partition(".")[0] + ".jsonl"))
    return f"{folder}/logs"


_BY_SESSION = f"select session_id, prompt_id, text from ({_A})"


@query(_BY_SESSION)
def transcript_files(spark, sf_dir):
    """The first dialect out of files, which are read in ranges of bytes."""
    lines = loaders.transcript_lines(spark, [("s", _transcripts(spark, sf_dir))])
    return transcripts.dialect_a(lines).select("session_id", "prompt_id", "text")


@query(_BY_SESSION)
def stream_transcripts(spark, sf_dir):
    """The same as a stream that tails the folder from its files' beginnings, in ranges of 64 KB."""
    spark.dataSource.register(TranscriptTail)
    lines = spark.readStream.format(TranscriptTail.name()).option("source", "s").option("backfill", "true").option("split", str(1 << 16)).load(_transcripts(spark, sf_dir))
    path = f"{scratch(spark, 'stream-transcripts')}"
    q = transcripts.dialect_a(lines).select("session_id", "prompt_id", "text").writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.read.schema("session_id string, prompt_id string, text string").parquet(f"{path}/rows")


@query("""
with e as (select event_id, case when event_type = 'error' then 'error' when event_type = 'signup' then 'critical' else 'info' end as severity from events), d(document, rank) as (values ('all', 0), ('errors', 2), ('off', 9))
select document, count(*) filter (case severity when 'info' then 0 when 'error' then 2 else 3 end >= rank) as n from e cross join d group by document""")
def settings_gate(spark, sf_dir):
    """Events that telemetry lets pass, by what a settings document says."""
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "critical").otherwise("info")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("code"), severity.alias("severity"))
    said = {"all": {"enabled": True}, "errors": {"enabled": True, "min_severity": "error"}, "off": {"enabled": False}}
    out = None
    for name, telemetry in said.items():
        one = Settings.parse(json.dumps({"client_telemetry": telemetry})).gated(rows).agg(F.count("*").alias("n")).select(F.lit(name).alias("document"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select 'm' || (event_id % 2) as model, case when event_id % 3 = 0 then 'r' || (event_id % 5) else '' end as repo, count(*) as n, sum(event_id % 50)::bigint as total from events group by 1, 2""")
def exported_points(spark, sf_dir):
    """Points as a sink gets them, read back: attributes without a value are left out."""
    e = F.col("event_id")
    points = table(spark, sf_dir, "events").select(F.lit("tokens.input").alias("name"), (e % 50).alias("value"), F.concat(F.lit("m"), (e % 2).cast("string")).alias("model"), F.when(e % 3 == 0, F.concat(F.lit("r"), (e % 5).cast("string"))).otherwise("").alias("repo"))
    path = scratch(spark, "points")
    if not sinks.export(points, {"model": "model", "repo": "repo"}, path):
        raise RuntimeError("nothing was exported")
    back = spark.read.schema("name string, value string, attributes array<struct<key:string,value:string>>").json(path)
    of = F.map_from_entries("attributes")
    return back.groupBy(of["model"].alias("model"), F.coalesce(F.try_element_at(of, F.lit("repo")), F.lit("")).alias("repo")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query("""select doc_id, coalesce(length(text), 0) as prompt_chars, len(regexp_extract_all(coalesce(text, ''), '""" + vocab.ENTITY_PATTERNS["email"] + """')) as n_entities from documents""")
def published_documents(spark, sf_dir):
    """Documents published to a folder and read back: counts of entities leave, their text does not."""
    rows = table(spark, sf_dir, "documents")
    entities = passes.KeywordBackend().entities(F.col("text"), ["email"])
    path = scratch(spark, "published")
    sinks.publish(rows.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("prompt_chars"), entities.alias("entities")), path)
    back = spark.read.schema("doc_id long, prompt_chars long, entities array<struct<label:string,text:string>>").json(path)
    return back.where(F.forall("entities", lambda x: x["text"].isNull())).select("doc_id", "prompt_chars", F.size("entities").cast("long").alias("n_entities"))
