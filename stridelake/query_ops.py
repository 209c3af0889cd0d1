"""Registered queries for bronze/incremental, quality, conversation, scalar and
ingest operators (continues ``query_registry``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as SF
from .operators import conversations as conv
from .operators import ingest, quality
from .operators.incremental import incremental_filter, upsert
from .oracle import _q, dur, pace
from .plans import bronze
from .plans.pipeline import TrainingModels
from .query_registry import register
from .session import scratch_path
from .sources import fixtures
from .sources.tables import read_table

RECENT_LIMIT = conv.RECENT_RAW_MESSAGE_LIMIT
#: The given sessions hold 2 to 8 messages, so only the compaction pair needs smaller numbers.
COMPACTION_LIMIT = 2
COMPACTION_TRIGGER = 4
# Incremental split: the target holds activities up to this day; the batch
# is every landing partition since the mark minus the lookback.
BASE_CUTOFF = "1997-06-30"
LOOKBACK_DAYS = 2

WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _landing_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.as_landing(fixtures.activities(spark, sf_dir))


# --- bronze ---------------------------------------------------------------------
@register(
    "bronze_distinct",
    "select distinct *, cast(run_date as date) as dt from (select * from t_activities union all select * from t_activities) x",
)
def q_bronze_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``select distinct *`` over landing rows (here: every row landed twice)."""
    a = _landing_activities(spark, sf_dir)
    return bronze.bronze_distinct(a.unionByName(a))


_WORKOUT_LANDING = """
select w.workout_id, w.workout_name, w.workout_segments, u.run_date, cast(u.run_date as date) as dt
from t_workouts w join (select distinct workout_id, run_date from t_activities where workout_id is not null) u using (workout_id)"""


@register(
    "bronze_latest_workout",
    f"select * from ({_WORKOUT_LANDING}) x qualify row_number() over (partition by workout_id order by run_date desc) = 1",
)
def q_bronze_latest_workout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest landing of each workout (a workout is re-landed on every day it is used)."""
    return bronze.bronze_workouts(fixtures.workout_landing(spark, sf_dir))


# Landing that comes in two runs: up to a day, then the rest, with every third activity landed once more
# at the end with a changed value. The second run starts at the first one's mark.
RELANDED_DAY = "2030-01-01"


def _relanding_sql(table: str, day: str, cutoff: str, changed: str, keys: str) -> str:
    return f"""
with land as (
 select *, 1 as landing, {day} as dt from {table}
 union all
 select * replace ({changed} + 1e0 as {changed}), 2 as landing, date '{RELANDED_DAY}' as dt from {table} where activity_id % 3 = 0),
first_run as (select * from land where dt <= date '{cutoff}'),
second_run as (select * from land where dt >= (select max(dt) from first_run)
               qualify row_number() over (partition by {keys} order by dt desc) = 1)
select * from first_run f anti join second_run s using ({keys})
union all select * from second_run"""


def _relanded(spark: SparkSession, asset: str, rows: DataFrame, day, cutoff: str, changed: str) -> DataFrame:
    root = scratch_path(spark, f"bronze-{asset}")
    first = rows.withColumn("landing", F.lit(1)).withColumn("dt", day)
    once = F.struct(*rows.columns, F.lit(1).alias("landing"), day.alias("dt"))
    others = [(F.col(c) + F.lit(1.0)).alias(c) if c == changed else F.col(c) for c in rows.columns]
    again = F.struct(*others, F.lit(2).alias("landing"), F.lit(RELANDED_DAY).cast("date").alias("dt"))
    # What a row lands in the second run, in one pass over the rows.
    landings = F.array(F.when(day > cutoff, once), F.when(F.col("activity_id") % 3 == 0, again))
    second = rows.select(F.explode(F.filter(landings, lambda x: x.isNotNull())).alias("r")).select("r.*")
    for run, landed in enumerate((first.filter(F.col("dt") <= cutoff), second)):
        # (two landing jobs; the copy of a row is in the same days' folders, as re-landed files are)
        landed.write.mode("append" if run else "errorifexists").partitionBy("dt").parquet(f"{root}/landing/{asset}")
        bronze.build_bronze(spark, f"{root}/landing", f"{root}/bronze", tables=(asset,))
    return spark.read.schema(first.schema).parquet(f"{root}/bronze/{asset}")


@register(
    "bronze_splits",
    _relanding_sql(
        "t_splits", "cast(date_trunc('month', cast(run_date as date)) as date)", "1996-06-01", "average_hr", "activity_id, message_index"
    ),
)
def q_bronze_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bronze laps after two incremental loads, some activities landed twice."""
    month = F.trunc(F.to_date("run_date"), "month")
    return _relanded(spark, "splits", fixtures.splits(spark, sf_dir), month, "1996-06-01", "average_hr")


@register(
    "bronze_activity_details",
    _relanding_sql(
        "t_activity_details", "cast(run_date as date)", "2024-01-14", "metric_value", "activity_id, measurement_index, metric_index"
    ),
)
def q_bronze_activity_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored bronze samples after two incremental loads, some activities landed twice."""
    rows = fixtures.activity_details(spark, sf_dir)
    return _relanded(spark, "activity_details", rows, F.to_date("run_date"), "2024-01-14", "metric_value")


_INCR = f"""
with land as (select *, cast(run_date as date) as dt from t_activities),
target as (select * from land where run_date <= '{BASE_CUTOFF}'),
batch as (select * from land where dt >= (select cast(max(dt) - interval {LOOKBACK_DAYS} day as date) from target))
"""


@register("incremental_filter", _INCR + "select * from batch")
def q_incremental_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing partitions at or after the target's high-water mark minus the lookback."""
    land = _landing_activities(spark, sf_dir)
    target = land.filter(F.col("run_date") <= BASE_CUTOFF)
    return incremental_filter(land, "dt", target, LOOKBACK_DAYS)


@register(
    "incremental_upsert",
    _INCR
    + """, changed as (select * replace (average_hr + 1e0 as average_hr) from batch)
select * from target t where not exists (select 1 from changed c where c.activity_id = t.activity_id)
union all select * from changed""",
)
def q_incremental_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete-then-insert by key: the batch (a newer version of each row) replaces the target's rows."""
    land = _landing_activities(spark, sf_dir)
    target = land.filter(F.col("run_date") <= BASE_CUTOFF)
    batch = incremental_filter(land, "dt", target, LOOKBACK_DAYS)
    changed = batch.withColumn("average_hr", F.col("average_hr") + F.lit(1.0))
    return upsert(target, changed, bronze.UNIQUE_KEYS["activities"])


# --- data quality ---------------------------------------------------------------------
_MODEL_CTE = {
    "activities": "b_activities",
    "splits": "b_splits",
    "activity_details": "b_details",
    "workouts": "b_workouts",
    "running_trainings": "m_trainings",
    "running_splits": "m_splits",
    "running_derived_splits": "m_derived",
    "running_activity_details": "m_details",
    "running_workouts": "m_workouts",
    "running_workout_results": "m_results",
    "running_trainings_summary": "g_trainings_summary",
    "running_derived_splits_summary": "g_derived_summary",
    "running_workout_results_summary": "g_results_summary",
    "running_summary": "g_running_summary",
    "running_workout_summary": "g_workout_summary",
}

_DQ_BRONZE = f"""
with b_activities as (select distinct * from t_activities),
b_splits as (select distinct * from t_splits),
b_details as (select distinct * from t_activity_details),
b_workouts as (select * from ({_WORKOUT_LANDING}) x
               qualify row_number() over (partition by workout_id order by run_date desc) = 1),
g_running_summary as (select * from g_results_summary union all select * from g_derived_summary)
"""


def _check_sql(ch: quality.Check) -> str:
    t = _MODEL_CTE[ch.model]
    cols = ", ".join(ch.columns)
    head = f"select {_q(ch.model)} as model, {_q(ch.test)} as test, {_q(','.join(ch.columns))} as column_name, cast(count(*) as bigint) as failures"
    if ch.test == "not_null":
        return f"{head} from {t} where {ch.columns[0]} is null"
    if ch.test == "unique":
        c = ch.columns[0]
        return f"{head} from (select {c} from {t} where {c} is not null group by {c} having count(*) > 1) x"
    if ch.test == "unique_combination":
        return f"{head} from (select {cols} from {t} group by {cols} having count(*) > 1) x"
    if ch.test == "relationships":
        p = _MODEL_CTE[ch.parent]
        c = ch.columns[0]
        return f"{head} from {t} c where c.{c} is not null and not exists (select 1 from {p} p where p.{ch.parent_column} = c.{c})"
    raise ValueError(ch.test)


def _dq_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    m = TrainingModels.from_fixtures(spark, sf_dir)
    tables = {
        "activities": m.activities.distinct(),
        "splits": m.splits.distinct(),
        "activity_details": m.activity_details.distinct(),
        "workouts": bronze.bronze_workouts(fixtures.workout_landing(spark, sf_dir)),
    }
    for name in TrainingModels.MODEL_ORDER:
        tables[name] = getattr(m, name)
    return tables


def _register_dq(test: str) -> None:
    checks = tuple(c for c in quality.CHECKS if c.test == test)
    oracle = _DQ_BRONZE + "\nunion all\n".join(_check_sql(c) for c in checks)

    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return quality.run_checks(_dq_tables(spark, sf_dir), checks)

    q.__doc__ = f"Failure counts of every ``{test}`` schema test of the model layer."
    register(f"dq_{test}", oracle)(q)


for _t in ("not_null", "unique", "unique_combination", "relationships"):
    _register_dq(_t)


# --- conversations ----------------------------------------------------------------
def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.messages(spark, sf_dir)


_LINE = "case when role = 'user' then 'User: ' else 'Assistant: ' end || content"


@register(
    "session_title",
    f"""
with f as (select session_id, arg_min(content, created_at) as m from t_messages where role = 'user' group by 1),
c as (select session_id, regexp_replace(regexp_replace(m, '{WS}+', ' ', 'g'), '^ | $', '', 'g') as cleaned from f)
select session_id, case when cleaned = '' then 'New chat' when length(cleaned) <= 60 then cleaned
  else rtrim(substr(cleaned, 1, 57)) || '...' end as title from c""",
)
def q_session_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.session_titles(_messages(spark, sf_dir))


@register(
    "list_sessions",
    f"""
with f as (select session_id, arg_min(content, created_at) as m from t_messages where role = 'user' group by 1),
c as (select session_id, regexp_replace(regexp_replace(m, '{WS}+', ' ', 'g'), '^ | $', '', 'g') as cleaned from f),
t as (select session_id, case when cleaned = '' then 'New chat' when length(cleaned) <= 60 then cleaned
  else rtrim(substr(cleaned, 1, 57)) || '...' end as title from c)
select s.session_id, s.updated_at, t.title, coalesce(nullif(t.title, ''), 'Untitled session') as label
from (select session_id, max(created_at) as updated_at from t_messages group by 1) s left join t using (session_id)""",
)
def q_list_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.list_sessions(_messages(spark, sf_dir))


_RANKED = """
with r as (select *, row_number() over (partition by session_id order by created_at desc) as rd,
             count(*) over (partition by session_id) as total from t_messages)
"""


@register(
    "recent_context",
    _RANKED + f"select session_id, created_at, role, content, cast(total - rd as bigint) as position from r where rd <= {RECENT_LIMIT}",
)
def q_recent_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.recent_context(_messages(spark, sf_dir), limit=RECENT_LIMIT)


@register(
    "conversation_transcript",
    _RANKED
    + f""", t as (select session_id, string_agg({_LINE}, chr(10) order by created_at) as transcript
             from r where rd <= {RECENT_LIMIT} group by 1)
select s.session_id, coalesce(t.transcript, 'No previous conversation.') as transcript
from (select distinct session_id from t_messages) s left join t using (session_id)""",
)
def q_conversation_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversation_transcript(_messages(spark, sf_dir), limit=RECENT_LIMIT)


_DUE = f"""
with size as (select session_id, count(*) as n from t_messages group by 1),
due as (select session_id, n, summarized, summary, n - summarized - {COMPACTION_LIMIT} as old
        from size join t_sessions using (session_id) where n > {COMPACTION_TRIGGER} and n - summarized > {COMPACTION_LIMIT}),
numbered as (select *, cast(row_number() over (partition by session_id order by created_at) - 1 as bigint) as position from t_messages),
old as (select m.*, d.summarized, d.summary, d.old from numbered m join due d
        on m.session_id = d.session_id and position >= summarized and position < summarized + old)
"""


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sessions(spark, sf_dir)


@register(
    "compaction_plan",
    _DUE
    + """select session_id, cast(n as bigint) as total_messages, summarized as summarized_before,
 cast(old as bigint) as messages_to_compact, cast(summarized + old as bigint) as summarized_after from due""",
)
def q_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = _messages(spark, sf_dir), _sessions(spark, sf_dir)
    return conv.compaction_plan(m, s, trigger=COMPACTION_TRIGGER, limit=COMPACTION_LIMIT)


@register("messages_to_compact", _DUE + "select session_id, created_at, role, content, position from old")
def q_messages_to_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = _messages(spark, sf_dir), _sessions(spark, sf_dir)
    return conv.messages_to_compact(m, s, trigger=COMPACTION_TRIGGER, limit=COMPACTION_LIMIT)


#: The given sessions are short, so parts are, too; the library's own size is larger.
MESSAGES_PER_PART = 2
# The summary prompt, once more as lines, for the SQL side.
_SUMMARY_LINES = """You maintain long-term memory for a running coach chat.

Update the session summary using:
- the previous summary
- the older conversation turns that are being compacted

Keep only durable and useful facts such as:
- user goals
- race targets
- training phase
- preferences
- injury or recovery notes
- constraints
- conclusions already reached
- unresolved follow-ups

Do not include filler or repeated phrasing.
Do not invent facts.
Keep the summary concise and factual.

Previous summary:
@PRIOR@

Older conversation to compact:
@OLD@

Return only the updated session summary."""


@register(
    "summary_prompt",
    _DUE
    + f"""select session_id, part, n_parts,
 if(part = 0, replace(split_part({_q(_SUMMARY_LINES)}, '@OLD@', 1), '@PRIOR@',
   case when coalesce(summary, '') = '' then 'No previous summary.' else summary end), chr(10))
 || lines || if(part = n_parts - 1, split_part({_q(_SUMMARY_LINES)}, '@OLD@', 2), '') as text
from (select session_id, cast((position - summarized) // {MESSAGES_PER_PART} as bigint) as part, any_value(summary) as summary,
       cast((any_value(old) + {MESSAGES_PER_PART} - 1) // {MESSAGES_PER_PART} as bigint) as n_parts,
       string_agg(if(role = 'user', 'User', 'Assistant') || ': ' || content, chr(10) order by position) as lines
      from old group by 1, 2)""",
)
def q_summary_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt that updates each due session's summary, in numbered parts."""
    m, s = _messages(spark, sf_dir), _sessions(spark, sf_dir)
    return conv.summary_prompt(m, s, COMPACTION_TRIGGER, COMPACTION_LIMIT, MESSAGES_PER_PART)


@register(
    "prompt_assembly",
    f"""
with p as (select *, row_number() over (partition by session_id order by created_at) - 1 as pos from t_messages),
h as (select q.session_id, q.pos, string_agg(case when m.role = 'user' then 'User: ' else 'Assistant: ' end || m.content,
        chr(10) order by m.pos) as history
      from p q join p m on m.session_id = q.session_id and m.pos between q.pos - {RECENT_LIMIT} and q.pos - 1
      where q.role = 'user' group by 1, 2),
ctx as (select coalesce((select 'Latest run on ' || cast(run_date as varchar) || ': ' || training_summary
          from g_trainings_summary order by run_date desc, activity_id desc limit 1), 'No training summary available.') as c)
select q.session_id, q.created_at,
 regexp_replace({_q(conv.PROMPT_HEAD)} || ctx.c || {_q(conv.PROMPT_SUMMARY)} || 'No previous summary.'
   || {_q(conv.PROMPT_HISTORY)} || coalesce(h.history, 'No previous conversation.') || {_q(conv.PROMPT_QUESTION)}
   || q.content, '{WS}+\\z', '') as prompt
from p q left join h using (session_id, pos), ctx where q.role = 'user'""",
)
def q_prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coach prompt of every user turn: training context, summary, last turns, question."""
    m = TrainingModels.from_fixtures(spark, sf_dir)
    return conv.prompt_assembly(_messages(spark, sf_dir), m.latest_training_context, limit=RECENT_LIMIT)


@register(
    "llm_run_usage",
    """
select session_id, created_at, case when k % 13 = 0 then 'started' when k % 11 = 0 then 'failed' else 'completed' end as status,
 prompt_tokens, completion_tokens, if(k % 13 = 0, null, k * 10) as duration_ms,
 if(k % 11 = 0 and k % 13 <> 0, 'provider unavailable', null) as error_message, if(k % 13 = 0, 1, 2)::bigint as n_events,
 if(prompt_tokens is null, completion_tokens, prompt_tokens + ifnull(completion_tokens, 0)) as total_tokens
from (select *, if(k % 13 = 0 or k % 11 = 0 or k % 5 = 0, null, length(content) // 4) as prompt_tokens,
       if(k % 13 = 0 or k % 11 = 0 or k % 7 = 0, null, length(content) // 3) as completion_tokens
      from (select *, session_id + created_at as k from t_messages where role = 'assistant'))""",
)
def q_llm_run_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last state and token accounting of every model run, reduced from the log of its events."""
    return conv.run_states(fixtures.run_events(spark, sf_dir), ["session_id", "created_at"])


# --- scalar helpers -----------------------------------------------------------------
@register(
    "format_duration",
    f"select activity_id, {dur('duration')} as duration_min, {dur('duration - 3000e0')} as shifted_duration_min from t_activities",
)
def q_format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``m:ss`` of every activity's duration (and of a shifted one that goes negative)."""
    a = fixtures.activities(spark, sf_dir)
    return a.select(
        "activity_id",
        SF.format_duration("duration").alias("duration_min"),
        SF.format_duration(F.col("duration") - F.lit(3000.0)).alias("shifted_duration_min"),
    )


@register(
    "format_pace",
    f"""select activity_id, {pace('average_speed')} as pace,
 if(minutes is null, null, concat_ws(':', trunc(minutes)::bigint, ((minutes - trunc(minutes)) * 60)::bigint)) as pace_min_per_km
from (select *, if(average_speed > 0, 1000e0 / average_speed / 60e0, null) as minutes from t_activities)""",
)
def q_format_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pace text from speed, and the decimal-minutes formatter."""
    a = fixtures.activities(spark, sf_dir)
    minutes = F.when(F.col("average_speed") > 0, F.lit(1000.0) / F.col("average_speed") / F.lit(60.0))
    return a.select(
        "activity_id",
        SF.format_pace_from_speed("average_speed").alias("pace"),
        SF.format_pace_min_per_km(minutes).alias("pace_min_per_km"),
    )


@register(
    "interval_summary",
    """select activity_id, split_index,
 'Split' || ': ' || round(distance_m / 1000e0, 2) || ' km with pace ' || split_pace || ' min/km'
  || case when include_hr then ' and avg HR ' || average_hr else '' end as interval_summary
from m_splits""",
)
def q_interval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line per lap; NULL when any piece (e.g. the pace) is NULL."""
    s = TrainingModels.from_fixtures(spark, sf_dir).running_splits
    return s.select(
        "activity_id",
        "split_index",
        SF.interval_summary(
            "Split", SF.round2(F.col("distance_m") / F.lit(1000.0)), "split_pace", "average_hr", "include_hr"
        ).alias("interval_summary"),
    )


_RAW_ACT = """
with raw as (select o_orderkey as activity_id,
  case o_custkey % 5 when 0 then '' when 1 then null when 2 then substr(cast(o_orderdate as varchar), 1, 7)
       else cast(o_orderdate as varchar) end as start_time_local,
  case when o_custkey % 3 = 0 then '' else cast(o_orderdate + interval 1 day as varchar) end as start_time_gmt
 from orders)
"""


def _raw_activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    ts = F.col("o_orderdate").cast("string")
    local = (
        F.when(F.col("o_custkey") % 5 == 0, F.lit(""))
        .when(F.col("o_custkey") % 5 == 1, F.lit(None).cast("string"))
        .when(F.col("o_custkey") % 5 == 2, F.substring(ts, 1, 7))
        .otherwise(ts)
    )
    gmt = F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(
        (F.col("o_orderdate") + F.expr("interval 1 day")).cast("string")
    )
    return o.select(F.col("o_orderkey").alias("activity_id"), local.alias("start_time_local"), gmt.alias("start_time_gmt"))


@register(
    "event_date",
    _RAW_ACT
    + """select activity_id, start_time_local, start_time_gmt,
 case when length(coalesce(nullif(start_time_local, ''), nullif(start_time_gmt, ''))) >= 10
      then substr(coalesce(nullif(start_time_local, ''), nullif(start_time_gmt, '')), 1, 10) else '1970-01-01' end as dt
from raw""",
)
def q_event_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily partition of raw activities: local date, else GMT date, else the fallback."""
    return ingest.partition_by_event_date(_raw_activities(spark, sf_dir), "1970-01-01")


# --- ingest planning --------------------------------------------------------------
WORKLIST_ASSETS = (
    ingest.IngestAsset("splits", "splits", True, False, "activity"),
    ingest.IngestAsset("activity_details", "activity_details", True, True, "activity"),
    ingest.IngestAsset("workouts", "workouts", True, True, "reference"),
    ingest.IngestAsset("laps", "laps", True, True, "activity"),
    ingest.IngestAsset("hrv", "hrv", False, True, "activity"),
)


@register(
    "fetch_worklist",
    """
with a as (select activity_id, workout_id, run_date as dt from t_activities),
existing as (select distinct 'raw/splits/dt=' || run_date || '/splits_' || cast(activity_id as varchar) || '.json' as output_file
             from t_splits)
select * from (
 select 'splits' as asset, activity_id, activity_id as lookup_id, dt,
  'raw/splits/dt=' || dt || '/splits_' || cast(activity_id as varchar) || '.json' as output_file from a
 union all
 select 'activity_details', activity_id, activity_id, dt,
  'raw/activity_details/dt=' || dt || '/activity_details_' || cast(activity_id as varchar) || '.json' from a
 union all
 select 'workouts', activity_id, workout_id, dt,
  'raw/workouts/dt=' || dt || '/workouts_' || cast(activity_id as varchar) || '.json' from a
 where coalesce(workout_id, 0) <> 0) w
where not (asset = 'splits' and output_file in (select output_file from existing))""",
)
def q_fetch_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches to make per activity and enabled asset; existing split files are kept."""
    acts = fixtures.activities(spark, sf_dir).select("activity_id", "workout_id", F.col("run_date").alias("dt"))
    s = fixtures.splits(spark, sf_dir)
    existing = s.select(
        F.concat(
            F.lit("raw/splits/dt="), F.col("run_date"), F.lit("/splits_"), F.col("activity_id").cast("string"), F.lit(".json")
        ).alias("output_file")
    ).distinct()
    return ingest.fetch_worklist(acts, WORKLIST_ASSETS, "raw", existing)


@register(
    "backfill_dates",
    """
with parts as (select run_date as dt from t_activities union select run_date from t_splits),
d as (select cast(cast(x as date) as varchar) as run_date
      from unnest(generate_series(date '1996-01-01', date '1996-03-31', interval 1 day)) t(x))
select run_date from d where run_date in (select dt from parts)""",
)
def q_backfill_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a requested range that have a raw partition for any asset."""
    a = fixtures.activities(spark, sf_dir).select(F.col("run_date").alias("dt"))
    s = fixtures.splits(spark, sf_dir).select(F.col("run_date").alias("dt"))
    return ingest.backfill_dates(spark, "1996-01-01", "1996-03-31", a.union(s))


@register(
    "session_messages",
    "select session_id, created_at, role, content, "
    "cast(row_number() over (partition by session_id order by created_at) - 1 as bigint) as position from t_messages",
)
def q_session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's full transcript as rows, with the chronological position."""
    return conv.with_positions(_messages(spark, sf_dir)).select("session_id", "created_at", "role", "content", "position")


# --- landing on files ----------------------------------------------------------------
_LOCAL_START = """case when o_custkey % 5 = 0 then '' when o_custkey % 5 = 1 and month = date '1995-03-01' then null
  else cast(month as varchar) || ' 07:00:00' end"""


@register(
    "raw_daily_landing",
    f"""
with raw as (select t.*, o_custkey, month, {_LOCAL_START} as start_time_local,
              cast(month + interval 1 month as date) || ' 05:00:00' as gmt
             from t_activities t join (select *, cast(date_trunc('month', o_orderdate) as date) as month from orders) o
             on o_orderkey = activity_id),
filed as (select *, cast(substr(coalesce(nullif(start_time_local, ''), gmt), 1, 10) as date) as dt from raw),
kept as (select *, bool_and(start_time_local is not null) over (partition by dt) as valid from filed)
select activity_id, start_time_local, gmt as start_time_gmt, 'Run ' || activity_id as activity_name, activity_type, distance,
 duration, o_custkey as owner_id, 'Customer ' || o_custkey as owner_full_name, average_speed, average_hr, has_splits,
 device_id, workout_id, '2024-01-01T00:00:00' as ingested_at, '2024-01-01' as ingestion_date, cast(dt as varchar) as run_date,
 'activities_20240101T000000.json' as source_file, dt
from kept where valid""",
)
def q_raw_daily_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw activity rows -> one JSON file per event day -> landed table, read back (one day's file is quarantined)."""
    from .config import default_config
    from .plans import landing
    from .query_registry import QUERY_CLOCK
    from .sources.raw import landing_scan
    from .sources.raw_docs import activity_payloads
    from .sources.raw_sink import write_daily_documents

    root = scratch_path(spark, "raw-daily")
    cfg = default_config(source_path=f"{root}/raw", landing_path=f"{root}/landing", quarantine_dir=f"{root}/quarantine")
    payloads = activity_payloads(spark, sf_dir)
    stamp = f"{QUERY_CLOCK:%Y%m%dT%H%M%S}"  # no colons: local filesystems with checksums reject them
    write_daily_documents(payloads, f"{root}/raw", "activities", stamp, "1970-01-01", order_col="activity_id")
    landing.land_asset(spark, cfg, "activities", clock=QUERY_CLOCK)
    return landing_scan(spark, f"{root}/landing", "activities")


# Values that casts meet in the wild, by order key: what each dtype makes of them.
_WILD = (
    # text, int64, float64, boolean
    ("12", 12, 12.0, None),
    ("3.7", None, 3.7, None),
    (" 8 ", 8, 8.0, None),
    ("true", None, None, True),
    ("x1", None, None, None),
    ("", None, None, None),
    ("1e3", None, 1000.0, None),
    ("9223372036854775808", None, 9223372036854775808.0, None),
)


def _wild_sql() -> str:
    show = lambda v: "null" if v is None else repr(v).lower()
    rows = ", ".join(f"({i}, {_q(t)}, {show(a)}, {show(b)}, {show(c)})" for i, (t, a, b, c) in enumerate(_WILD))
    return f"""select cast(o_orderkey as varchar) || '.json' as source_file, o_orderkey as id, t as text, cast(a as bigint) as as_int,
 cast(b as double) as as_float, cast(c as boolean) as as_bool, '"' || t || '"' as as_json, cast(o_custkey as double) as number
from orders join (values {rows}) v(i, t, a, b, c) on i = o_orderkey % {len(_WILD)}"""


@register("lenient_cast", _wild_sql())
def q_lenient_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record payloads whose values fit their declared types or do not: what does not fit becomes NULL."""
    from .operators.extract import extract_documents

    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    texts = F.array(*[F.lit(t) for t, *_ in _WILD])
    text = F.get(texts, (F.col("o_orderkey") % len(_WILD)).cast("int"))
    docs = o.select(
        F.lit("2024-01-01").alias("dt"),
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".json")).alias("source_file"),
        F.to_json(F.struct(F.col("o_orderkey").alias("id"), text.alias("v"), F.col("o_custkey").alias("n"))).alias("value"),
    )
    column = lambda target, source, dtype: {"target": target, "source": source, "dtype": dtype, "required": False}
    asset = {
        "extract": {"payload_kind": "record"},
        "column_mapping": [
            column("id", "id", "int64"), column("text", "v", "string"), column("as_int", "v", "int64"),
            column("as_float", "v", "float64"), column("as_bool", "v", "boolean"), column("as_json", "v", "json"),
            column("number", "n", "float64"),
        ],
    }
    return extract_documents(docs, asset).select("source_file", F.inline("records"))
