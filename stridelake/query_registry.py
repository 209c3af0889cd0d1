"""Registered queries: name -> (spark, sf_dir) -> DataFrame, and their oracles.

Every query reads the driver's tables (through the derived training-log
tables of ``sources.fixtures``) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import gold, silver
from .plans.pipeline import TrainingModels

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SELECTS: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SELECTS[name] = oracle
        return fn

    return deco


def _models(spark: SparkSession, sf_dir: str) -> TrainingModels:
    return TrainingModels.from_fixtures(spark, sf_dir)


# --- table models ------------------------------------------------------------
for _name, _cte in [
    ("running_trainings", "m_trainings"),
    ("running_splits", "m_splits"),
    ("running_activity_details", "m_details"),
    ("running_derived_splits", "m_derived"),
    ("running_workouts", "m_workouts"),
    ("running_workout_results", "m_results"),
    ("running_trainings_summary", "g_trainings_summary"),
    ("running_derived_splits_summary", "g_derived_summary"),
    ("running_workout_results_summary", "g_results_summary"),
    ("running_workout_summary", "g_workout_summary"),
]:

    def _model_query(spark: SparkSession, sf_dir: str, _n: str = _name) -> DataFrame:
        return getattr(_models(spark, sf_dir), _n)

    register(_name, f"select * from {_cte}")(_model_query)


@register(
    "running_summary",
    "select * from g_results_summary union all select * from g_derived_summary",
)
def q_running_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).running_summary


@register(
    "latest_training_context",
    """select coalesce((select 'Latest run on ' || cast(run_date as varchar) || ': ' || training_summary
            from g_trainings_summary order by run_date desc, activity_id desc limit 1),
           'No training summary available.') as training_context""",
)
def q_latest_training_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _models(spark, sf_dir).latest_training_context


# --- operator-level queries (CTEs of the models exposed on their own) ------------
@register("warmup_cooldown_agg", "select * from m_warmup_cooldown")
def q_warmup_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.warmup_cooldown_agg(_models(spark, sf_dir).running_splits)


@register("km_bucket_agg", "select * from m_bucket_agg")
def q_km_bucket_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.km_bucket_agg(_models(spark, sf_dir).running_activity_details).select(
        "activity_id", "distance_km_bucket", "avg_speed_mps", "avg_heart_rate_bpm"
    )


@register("metric_pivot", "select * from m_pivot_all")
def q_metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.metric_pivot(_models(spark, sf_dir).activity_details)


@register("workout_interval_match", "select * from m_intervals")
def q_workout_interval_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _models(spark, sf_dir)
    return silver.workout_interval_match(m.running_splits, m.running_workouts)


@register("repeat_next_boundary", "select * from g_repeat_rows")
def q_repeat_next_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.repeat_next_boundary(_models(spark, sf_dir).running_workouts)


# --- landing: raw payload documents -> typed rows ------------------------------
import datetime as _dt  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from .config import DEFAULT_LANDING_CONFIG  # noqa: E402
from .oracle import canonical_segments  # noqa: E402
from .plans import landing as _landing  # noqa: E402
from .sources import raw_docs as _raw_docs  # noqa: E402

# A fixed batch clock keeps the metadata columns reproducible.
QUERY_CLOCK = _dt.datetime(2024, 1, 1, 0, 0, 0)
_CLOCK_COLS = "'2024-01-01T00:00:00' as ingested_at, '2024-01-01' as ingestion_date"


def _staged(spark: SparkSession, sf_dir: str, asset: str) -> DataFrame:
    docs = _raw_docs.DOCUMENT_SOURCES[asset](spark, sf_dir)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _landing.stage_documents(docs, DEFAULT_LANDING_CONFIG["assets"][asset], spread=spread)


def _landed(spark: SparkSession, sf_dir: str, asset: str, valid: bool = True) -> DataFrame:
    cfg = DEFAULT_LANDING_CONFIG["assets"][asset]
    return _landing.landing_rows(_staged(spark, sf_dir, asset), cfg, QUERY_CLOCK, valid)


_ACT_DOCS = """
with a as (select t.*, o.o_custkey, o.o_orderpriority,
             'activities_' || t.run_date || 'T0' || substr(o.o_orderpriority, 1, 1) || ':00:00.json' as source_file
           from t_activities t join orders o on o.o_orderkey = t.activity_id),
latest as (select run_date, max(source_file) as source_file from a group by run_date),
kept as (select a.* from a join latest using (run_date, source_file)),
files as (select run_date, source_file, bool_and(o_custkey % 53 <> 0) as valid, count(*) as n from kept group by 1, 2)
"""

_SPLIT_DOCS = """
with s as (select *, 'splits_' || cast(activity_id as varchar) || '.json' as source_file,
             not (message_index = 2 and distance >= 2000) as lap_ok from t_splits),
files as (select run_date, source_file, bool_and(lap_ok) as valid, count(*) as n from s group by 1, 2)
"""

_SPLIT_ROWS = """
select s.activity_id, case when lap_ok then s.start_time_gmt end as start_time_gmt, s.intensity_type, s.distance,
 s.duration, s.average_speed, s.average_hr, s.average_hr + 10e0 as max_hr, s.message_index, s.workout_step_index,
 {clock}, s.run_date, s.source_file, s.run_date as dt
from s join files f using (run_date, source_file) where f.valid = {valid}
"""

_WORKOUT_DOCS = """
with uses as (select workout_id, run_date, min(activity_id) as activity_id from t_activities
              where workout_id is not null group by 1, 2),
w as (select w.*, u.run_date, 'workouts_' || cast(u.activity_id as varchar) || '.json' as source_file,
        w.workout_id % 13 <> 0 as valid
      from t_workouts w join uses u using (workout_id))
"""

_DETAIL_DOCS = """
with e as (select user_id, event_id, ts, value, date_trunc('hour', ts) as hour from events),
n as (select *, row_number() over (partition by user_id, hour order by ts, event_id) - 1 as mi from e),
r as (select user_id as activity_id, cast(mi as bigint) as measurement_index, cast(ki as bigint) as metric_index,
  case when ki = 5 and user_id % 10 = 0 then null
       when ki = 2 and user_id % 10 = 1 then 'sumElapsedDuration'
       else ['directTimestamp','sumDistance','sumMovingDuration','directSpeed','directHeartRate','directCadence'][ki + 1] end
   as metric_key,
  case ki when 0 then floor(epoch(ts)) when 1 then value when 2 then cast(event_id % 100 as double)
          when 3 then 2e0 + (event_id % 16) / 8e0 when 4 then 120e0 + event_id % 60
          else case when event_id % 9 = 0 then null else 1e0 end end as metric_value,
  case when ki = 5 and user_id % 10 = 0 then null
       else ['gmt','meter','second','mps','bpm','spm'][ki + 1] end as unit_key,
  case when ki = 5 and user_id % 10 = 0 then null
       else [1e0, 100e0, 1000e0, 10e0, 1e0, 1e0][ki + 1] end as unit_factor,
  strftime(hour, '%Y-%m-%d') as dt,
  'activity_details_' || cast(user_id as varchar) || '_' || strftime(hour, '%Y%m%d%H') || '.json' as source_file,
  user_id % 10 <> 0 as valid
 from n, (select unnest(range(6)) as ki) k)
"""


@register(
    "payload_list",
    _ACT_DOCS
    + f"""
select k.activity_id, k.start_time_gmt as start_time_local, k.start_time_gmt, 'Run ' || cast(k.activity_id as varchar) as activity_name,
 k.activity_type, k.distance, k.duration, k.o_custkey as owner_id, 'Customer ' || cast(k.o_custkey as varchar) as owner_full_name,
 k.average_speed, k.average_hr, k.has_splits, k.device_id, k.workout_id, {_CLOCK_COLS}, k.run_date, k.source_file,
 k.run_date as dt
from kept k join files f using (run_date, source_file) where f.valid""",
)
def q_payload_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List payloads: latest daily snapshot file, one row per element."""
    return _landed(spark, sf_dir, "activities")


@register("payload_object", _SPLIT_DOCS + _SPLIT_ROWS.format(clock=_CLOCK_COLS, valid="true"))
def q_payload_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object payloads: elements of ``lapDTOs`` with the document's activityId."""
    return _landed(spark, sf_dir, "splits")


@register("quarantine_rows", _SPLIT_DOCS + _SPLIT_ROWS.format(clock=_CLOCK_COLS, valid="false"))
def q_quarantine_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of a file that has one row missing a required value."""
    return _landed(spark, sf_dir, "splits", valid=False)


@register(
    "payload_record",
    _WORKOUT_DOCS
    + f"""
select workout_id, workout_name, 'running' as workout_type, cast(workout_id * 60 as bigint) as estimated_duration_in_secs,
 workout_id * 100e0 as estimated_distance_in_meters, {canonical_segments()} as workout_segments,
 {_CLOCK_COLS}, run_date, source_file, run_date as dt
from w join part on p_partkey + 1 = workout_id where valid""",
)
def q_payload_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record payloads; the nested plan survives as JSON text, in the variant's form (sorted keys)."""
    return _landed(spark, sf_dir, "workouts")


@register(
    "payload_descriptor_metrics",
    _DETAIL_DOCS
    + f"""
select activity_id, measurement_index, metric_index, metric_key, metric_value, unit_key, unit_factor, {_CLOCK_COLS},
 dt as run_date, source_file, dt
from r where valid""",
)
def q_payload_descriptor_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor payloads: measurements x metric positions, labelled by descriptor."""
    return _landed(spark, sf_dir, "activity_details")


@register(
    "schema_validate",
    _SPLIT_DOCS + "select run_date as dt, source_file, cast(n as integer) as n_records, valid from files",
)
def q_schema_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-level validation: a file is valid when no record breaks a required column."""
    st = _staged(spark, sf_dir, "splits")
    return st.select("dt", "source_file", F.size("records").alias("n_records"), "valid")


_COUNTS = (
    """
with c as (
 select 'activities' as asset, run_date as dt, count(*) as files_seen,
   sum(case when valid then n else 0 end) as rows_valid, sum(case when valid then 0 else n end) as rows_invalid
 from (""" + _ACT_DOCS.replace("with a as", "with a0 as").replace("from a group", "from a0 group").replace("from a join", "from a0 join")
    .replace("select a.* from a0", "select a0.* from a0") + """ select * from files) x group by 2
 union all
 select 'splits', run_date, count(*), sum(case when valid then n else 0 end), sum(case when valid then 0 else n end)
 from (""" + _SPLIT_DOCS + """ select * from files) y group by 2
 union all
 select 'workouts', run_date, count(*), sum(case when valid then 1 else 0 end), sum(case when valid then 0 else 1 end)
 from (""" + _WORKOUT_DOCS + """ select * from w) z group by 2
 union all
 select 'activity_details', dt, count(distinct source_file), sum(case when valid then 1 else 0 end),
   sum(case when valid then 0 else 1 end)
 from (""" + _DETAIL_DOCS + """ select * from r) q group by 2)
select asset, dt, cast(files_seen as bigint) as files_seen, cast(rows_valid as bigint) as rows_valid,
 cast(rows_invalid as bigint) as rows_invalid, cast(case when rows_valid > 0 then 1 else 0 end as bigint) as staged_files,
 cast(0 as bigint) as malformed_files
from c"""
)


@register("batch_counts", _COUNTS)
def q_batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (asset, day): files seen, valid/invalid rows, staged flag, malformed files."""
    out = None
    for asset in ("activities", "splits", "workouts", "activity_details"):
        c = _landing.batch_counts(_staged(spark, sf_dir, asset), asset)
        out = c if out is None else out.unionByName(c)
    return out


@register(
    "run_summary",
    f"""
select string_agg(distinct asset, ',' order by asset) as assets, cast(sum(rows_valid) as bigint) as rows_valid,
 cast(sum(rows_invalid) as bigint) as rows_invalid, cast(0 as bigint) as quarantine_files,
 cast(sum(staged_files) as bigint) as staged_files
from ({_COUNTS}) per_day""",
)
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run totals of a landing run over all four assets."""
    s = _landing.run_summary(q_batch_counts(spark, sf_dir))
    return s.select(F.array_join("assets", ",").alias("assets"), "rows_valid", "rows_invalid", "quarantine_files", "staged_files")


from . import query_ops  # noqa: E402,F401  (registers the remaining queries)
