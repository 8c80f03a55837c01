"""Queries over conversations and events: order, linkage, runs, thresholds, gauges, queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import events as E
from ..operators import loadstats, queueing, transcripts
from .registry import query, table

_SEVERITY = {"error": "error", "purchase": "warn", "signup": "critical"}


def _events(spark, sf_dir):
    """Events as client events: the type is the code, a fixed mapping the severity."""
    severity = F.create_map(*(F.lit(x) for pair in _SEVERITY.items() for x in pair))
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("code", F.col("event_type")).withColumn("severity", F.coalesce(severity[F.col("event_type")], F.lit("info")))


_EV = "(select *, event_type as code, case event_type when 'error' then 'error' when 'purchase' then 'warn' when 'signup' then 'critical' else 'info' end as severity from events)"


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) - 1 as ordinal, conv_id || '########' || (row_number() over (partition by conv_id order by turn) - 1) as prompt_id from conversations where role = 'user'")
def prompt_ordinals(spark, sf_dir):
    rows = transcripts.with_ordinals(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn")
    return rows.select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), F.concat(F.col("conv_id").cast("string"), F.lit(transcripts.LONG_MARK), F.col("ordinal").cast("string")).alias("prompt_id"))


@query(r"""
with u as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations where role = 'user'),
c as (select conv_id, turn, case when length(t) > 400 then left(t, 400) || '…' else t end as t from u),
p as (select a.conv_id, a.turn, b.turn as bt, b.t, octet_length(encode(b.t)) as n, row_number() over (partition by a.conv_id, a.turn order by b.turn desc) as k from c a join c b on a.conv_id = b.conv_id and b.turn < a.turn),
s as (select *, sum(n) over (partition by conv_id, turn order by bt desc) as total from p where k <= 3),
ok as (select * from s where t <> '' and (k = 1 or total <= 1500))
select c.conv_id, c.turn, count(ok.t) as n_recent, coalesce(sum(ok.n), 0)::bigint as n_bytes from c left join ok using (conv_id, turn) group by c.conv_id, c.turn""")
def recent_prompts(spark, sf_dir):
    rows = transcripts.recent(table(spark, sf_dir, "conversations").where("role = 'user'"), "conv_id", "turn")
    n_bytes = F.aggregate(F.transform("recent_prompts", lambda x: F.octet_length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.size("recent_prompts").cast("long").alias("n_recent"), n_bytes.alias("n_bytes"))


@query("select conv_id, turn, role, last_value(case when role = 'user' then conv_id || '#' || turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and current row) as last_prompt_id from conversations")
def last_prompt_asof(spark, sf_dir):
    pid = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    return transcripts.last_prompt(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", pid).select("conv_id", "turn", "role", "last_prompt_id")


@query("""
with r as (select conv_id, turn, role, unnest(range(case when role = 'assistant' then 2 else 1 end)) as sub from conversations)
select conv_id, turn, sub::int as sub, row_number() over (partition by conv_id order by turn, sub) as event_sequence from r""")
def event_sequence(spark, sf_dir):
    n = F.when(F.col("role") == "assistant", 2).otherwise(1)
    got = transcripts.sequence(table(spark, sf_dir, "conversations"), "conv_id", "turn", n)
    return got.select("conv_id", "turn", "sub", F.col("event_sequence").cast("long").alias("event_sequence"))


@query(f"select severity, code, count(*) as n from {_EV} where severity in ('error', 'critical') group by severity, code")
def severity_floor(spark, sf_dir):
    return E.gate(_events(spark, sf_dir), floor="error").groupBy("severity", "code").agg(F.count("*").alias("n"))


@query(f"""
with l as (select *, case when code = lag(code) over w and severity = lag(severity) over w then 0 else 1 end as fresh from {_EV} window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as run from l)
select user_id, arg_min(event_id, (ts, event_id)) as event_id, min(code) as code, count(*) as count from r group by user_id, run""")
def coalesce_runs(spark, sf_dir):
    rows = _events(spark, sf_dir).select("user_id", "ts", "event_id", "code", "severity")
    return E.coalesce_runs(rows, ["user_id"], ["ts", "event_id"], ["code", "severity"]).select("user_id", "event_id", "code", "count")


@query(f"select user_id, event_id, code from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from {_EV}) where k <= 3")
def ring_newest(spark, sf_dir):
    return E.newest(_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", "code")


@query("""
with o as (select user_id, ts, event_id, value, coalesce(value > 40, false) as over_it from events),
n as (select *, case when over_it <> coalesce(lag(over_it) over w, false) then 1 else 0 end as fresh from o window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as island from n),
e as (select *, case when over_it then epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id, island order by ts, event_id) end / 1e6 as el from i),
s as (select *, case when el >= 14400 then 'critical' when el >= 7200 then 'error' when el >= 3600 then 'warn' end as severity from e),
b as (select *, lag(severity) over (partition by user_id order by ts, event_id) as prior from s)
select user_id, event_id, coalesce(severity, prior) as severity, severity is null as recovered from b
where (severity is not null and severity is distinct from prior) or (severity is null and prior is not null)""")
def sustained_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return E.sustained(rows, ["user_id"], "ts", "event_id", "value", 40.0, 3600.0).select("user_id", "event_id", "severity", "recovered")


@query("""
select event_type, floor(epoch_us(ts) / 86400000000)::bigint as window_id, round(min(value), 6) as min, round(max(value), 6) as max, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std,
  round(arg_max(value, (ts, event_id)), 6) as last, count(value) as n, round((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 6) as window_s from events group by event_type, floor(epoch_us(ts) / 86400000000)""")
def gauge_windows(spark, sf_dir):
    got = E.gauges(table(spark, sf_dir, "events"), ["event_type"], "ts", "event_id", "value", 86_400)
    return got.select("event_type", "window_id", *(F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std", "last")), "n", F.round("window_s", 6).alias("window_s"))


@query("select event_type as name, min(event_id) as first_pos, count(*) as n_points, round(arg_max(value, event_id), 6) as newest, round(sum(value), 4) as total from events group by event_type")
def metric_groups(spark, sf_dir):
    points = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("pos"), "value")
    parts = E.metric_groups(points, most=500).withColumn("newest", F.element_at("points", -1))
    got = parts.groupBy("name").agg(F.min("first_pos").alias("first_pos"), F.sum(F.size("points")).alias("n_points"), F.max_by("newest", "part").alias("newest"), F.sum("total").alias("total"))
    return got.select("name", "first_pos", "n_points", F.round("newest", 6).alias("newest"), F.round("total", 4).alias("total"))


@query("select user_id, event_type, min(event_id) as position, arg_max(event_id, (ts, event_id)) as latest_id, round(arg_max(value, (ts, event_id)), 6) as value from events group by user_id, event_type")
def spool_upsert_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("position"), F.struct("ts", "event_id").alias("at"), F.col("event_id").alias("latest_id"), "value")
    got = queueing.upsert_latest(rows, ["user_id", "event_type"], "at", "position")
    return got.select("user_id", "event_type", "position", "latest_id", F.round("value", 6).alias("value"))


@query("select user_id, event_type, min(event_id) as event_id from events group by user_id, event_type")
def dedup_first(spark, sf_dir):
    return queueing.dedup_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


_BYTES = "(select doc_id, source, octet_length(encode(coalesce(text, ''))) as n_bytes from documents)"


def _sized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


@query(f"select source, doc_id, n_bytes from (select *, sum(n_bytes) over (partition by source order by doc_id desc) as s from {_BYTES} where n_bytes <= 40000) where s <= 40000")
def byte_budget_evict(spark, sf_dir):
    return queueing.evict(_sized(spark, sf_dir), ["source"], "doc_id", "n_bytes", 40_000).select("source", "doc_id", "n_bytes")


@query(f"""
with b as (select *, (row_number() over (partition by source order by doc_id) - 1) // 16 as batch from {_BYTES} where n_bytes <= 60000), p as (select source, batch, sum(n_bytes) as b from b group by source, batch),
k as (select source, batch from (select *, sum(b) over (partition by source order by batch desc) as s from p) where s <= 60000)
select source, doc_id from b join k using (source, batch)""")
def batch_evict(spark, sf_dir):
    return queueing.evict_batches(_sized(spark, sf_dir), ["source"], "doc_id", "n_bytes", 60_000).select("source", "doc_id")


@query(f"select source, count(*) as depth, sum(n_bytes)::bigint as bytes, 1000000.0 - min(doc_id) as oldest_s from {_BYTES} group by source")
def spool_stats(spark, sf_dir):
    return queueing.stats(_sized(spark, sf_dir), ["source"], "doc_id", "n_bytes", 1_000_000.0)


@query("select event_id, user_id from events where event_id > 500 order by event_id limit 100")
def keyset_page(spark, sf_dir):
    return queueing.page(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 500)


@query("select e.event_id, e.user_id from events e where not exists (select 1 from events b where b.event_type = 'signup' and b.user_id % 3 = 0 and b.user_id = e.user_id)")
def admit_offers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return queueing.admit(rows, rows.where("event_type = 'signup' and user_id % 3 = 0"), ["user_id"]).select("event_id", "user_id")


@query("""
with a as (select user_id, event_id as pos, event_type <> 'error' as ok from events), s as (select *, sum(ok::int) over (partition by user_id order by pos) as since from a),
l as (select user_id, arg_max(ok, pos) as ok, max(since) as s from s group by user_id), f as (select user_id, since, count(*) as n from s where not ok group by user_id, since)
select l.user_id, case when l.ok then 0 else coalesce(f.n, 0) end as attempts, case when l.ok then 'done' when coalesce(f.n, 0) >= 4 then 'quarantine' else 'again' end as state from l left join f on f.user_id = l.user_id and f.since = l.s""")
def retry_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return queueing.settle(rows, ["user_id"])


@query("select event_type, round(coalesce(regr_slope(value, epoch_us(ts) / 1e6), 0) * 60, 9) as slope from events group by event_type")
def value_slope(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("x", F.unix_micros("ts") / 1e6)
    return loadstats.slope(rows, ["event_type"], "x", "value").select("event_type", F.round("slope", 9).alias("slope"))


@query("""
with k as (select *, row_number() over (partition by event_type order by ts, event_id) as r, count(*) over (partition by event_type) as n from events)
select event_type, round(coalesce(avg(value) filter (r > n // 2) - avg(value) filter (r <= n // 2), 0), 6) as growth from k group by event_type""")
def half_mean_growth(spark, sf_dir):
    return loadstats.half_growth(table(spark, sf_dir, "events"), ["event_type"], ["ts", "event_id"], "value").select("event_type", F.round("growth", 6).alias("growth"))


@query("""
with k as (select user_id, value, lag(value) over (partition by user_id order by ts, event_id) as b from events) select user_id, bool_and(coalesce(value <= b * 1.5, true)) as non_increasing from k group by user_id""")
def nonincreasing(spark, sf_dir):
    return loadstats.non_increasing(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 0.5)


@query("""
with recursive o as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as r from events),
e as (select user_id, r, value as v from o where r = 1 union all select o.user_id, o.r, 0.3 * o.value + 0.7 * e.v from e join o on o.user_id = e.user_id and o.r = e.r + 1)
select user_id, round(arg_max(v, r), 6) as ewma from e group by user_id""")
def value_ewma(spark, sf_dir):
    return loadstats.ewma(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("ewma", 6).alias("ewma"))


@query("select user_id, event_id, round(max(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 6) as peak from events")
def peak_high_water(spark, sf_dir):
    return loadstats.peaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", F.round("peak", 6).alias("peak"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as r, count(*) over (partition by user_id) as n from events) where r > floor(n * 0.2)")
def warmup_trim(spark, sf_dir):
    return loadstats.trimmed(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 0.2).select("user_id", "event_id")


@query("select user_id, count(*) as submitted, count(*) filter (event_type = 'purchase') as completed, count(*) filter (event_type = 'error') as shed, count(*) filter (event_type = 'purchase') / 60.0 as per_second from events group by user_id")
def status_counters(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", 200).when(F.col("event_type") == "error", 503).otherwise(102)
    return loadstats.status_counts(table(spark, sf_dir, "events").withColumn("status", status), ["user_id"], "status", 60.0)


@query("select user_id, event_id, event_id - coalesce(lag(event_id) over (partition by user_id order by ts, event_id), 0) as delta from events")
def counter_delta(spark, sf_dir):
    return loadstats.counter_delta(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("user_id", "event_id", "delta")


@query("select event_id, least(0.5 * pow(2, event_id % 12), 30.0) as wait_s, event_id % 600 in (408, 429, 500, 502, 503, 504) as again, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at, (epoch_us(date_trunc('second', ts)) * 1000)::varchar as nanos, least(1.0, greatest(0.0, (event_id % 100 - 60.0) / 25.0)) as load from events")
def retry_scalars(spark, sf_dir):
    at = scalars.rfc3339("ts")
    return table(spark, sf_dir, "events").select("event_id", scalars.backoff(F.col("event_id") % 12 + 1).alias("wait_s"), scalars.transient(F.col("event_id") % 600).alias("again"), at.alias("at"), scalars.unix_nanos(at).alias("nanos"), scalars.ramp(F.col("event_id") % 100).alias("load"))


@query("select array_to_string(list_sort(list(distinct event_type)), ',') as digest from events")
def set_digest(spark, sf_dir):
    return queueing.set_digest(table(spark, sf_dir, "events"), "event_type")


@query("select user_id, arg_max(event_type, (value, -event_id)) as top_type, round(max(value), 6) as top_value from events where value is not null group by user_id")
def top_child(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumnRenamed("event_type", "type")
    return loadstats.leaders(rows, ["user_id"], "value", "type", -F.col("event_id")).withColumn("top_value", F.round("top_value", 6))


