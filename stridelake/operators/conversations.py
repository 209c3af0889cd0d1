"""Chat-memory table operators, as batch operations over all sessions.

The chat service assembles one prompt per request from a session's stored
messages. Here the same data work runs for every session (or every user
turn) at once.

Skew: a session may be very long. Nothing here sorts a whole session in one
task:
* positions come from ``ordinal_within_group`` (hot sessions are numbered in chunks);
* "last N" uses ``row_number() <= N``, which Spark plans as a
  ``WindowGroupLimit`` (each task forwards at most N rows per session);
* the history before a turn is a window of N rows over chunks of the session that overlap by N messages;
* the text to be summarised, of any length, is built in numbered parts of a bounded number of messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import NEWLINE, PY_WHITESPACE_CLASS, listagg_ordered, session_title
from .sequence import ordinal_within_group

# Fixed values (defaults of the chat service).
RECENT_RAW_MESSAGE_LIMIT = 6
COMPACTION_TRIGGER_MESSAGE_COUNT = 12
MESSAGES_PER_CHUNK = 1024
NO_CONVERSATION = "No previous conversation."
NO_SUMMARY = "No previous summary."
NEW_CHAT = "New chat"
UNTITLED = "Untitled session"

# The chat prompt template (8-space indented lines, then the
# whole prompt is stripped).
_IND = "        "
PROMPT_HEAD = (
    "You are a concise running coach.\n"
    f"{_IND}Use the training context when answering.\n"
    f"{_IND}Use the session summary and recent conversation to preserve continuity.\n"
    f"{_IND}If the context is incomplete, say what assumption you are making.\n"
    f"{_IND}Do not invent Garmin metrics that were not provided.\n"
    f"{_IND}Answer in 4 short bullet points max.\n"
    "\n"
    f"{_IND}Training context:\n{_IND}"
)
PROMPT_SUMMARY = f"\n\n{_IND}Session summary:\n{_IND}"
PROMPT_HISTORY = f"\n\n{_IND}Recent conversation:\n{_IND}"
PROMPT_QUESTION = f"\n\n{_IND}User question:\n{_IND}"


def with_positions(messages: DataFrame) -> DataFrame:
    """Adds ``position`` (0-based, chronological) within the session."""
    return ordinal_within_group(messages, ["session_id"], ["created_at"], name="position")


def transcript_line(role: Column | str = "role", content: Column | str = "content") -> Column:
    """``User: ...`` for role ``user``; every other role is ``Assistant``."""
    r = F.col(role) if isinstance(role, str) else role
    c = F.col(content) if isinstance(content, str) else content
    return F.concat(F.when(r == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), c)


def session_titles(messages: DataFrame, max_length: int = 60) -> DataFrame:
    """Title from each session's first user message (sessions without one: none)."""
    first = (
        messages.filter(F.col("role") == "user")
        .groupBy("session_id")
        .agg(F.min_by("content", "created_at").alias("first_message"))
    )
    return first.select("session_id", session_title("first_message", max_length).alias("title"))


def list_sessions(messages: DataFrame) -> DataFrame:
    """Sessions newest-activity first with their display label."""
    activity = messages.groupBy("session_id").agg(F.max("created_at").alias("updated_at"))
    titled = activity.join(session_titles(messages), "session_id", "left")
    label = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(UNTITLED))
    return titled.select("session_id", "updated_at", "title", label.alias("label")).orderBy(
        F.col("updated_at").desc(), F.col("session_id")
    )


def _session_state(messages: DataFrame, sessions: DataFrame | None) -> DataFrame:
    totals = messages.groupBy("session_id").agg(F.count(F.lit(1)).alias("total"))
    if sessions is None:
        return totals.select(
            "session_id", "total", F.lit(0).cast("bigint").alias("summarized"), F.lit(None).cast("string").alias("summary")
        )
    s = sessions.select(
        "session_id",
        F.coalesce(F.col("summarized_message_count"), F.lit(0)).cast("bigint").alias("summarized"),
        F.col("summary").cast("string").alias("summary"),
    )
    return totals.join(s, "session_id", "left").select(
        "session_id",
        "total",
        F.coalesce("summarized", F.lit(0)).cast("bigint").alias("summarized"),
        "summary",
    )


def recent_context(
    messages: DataFrame, sessions: DataFrame | None = None, limit: int = RECENT_RAW_MESSAGE_LIMIT
) -> DataFrame:
    """The last ``limit`` messages after each session's summarized prefix."""
    newest_first = Window.partitionBy("session_id").orderBy(F.col("created_at").desc())
    ranked = messages.withColumn("_rank_desc", F.row_number().over(newest_first)).filter(
        F.col("_rank_desc") <= limit
    )
    state = _session_state(messages, sessions)
    joined = ranked.join(state, "session_id")
    # position >= summarized  <=>  rank_desc <= total - summarized
    kept = joined.filter(F.col("_rank_desc") <= F.col("total") - F.col("summarized"))
    return kept.select(
        "session_id",
        "created_at",
        "role",
        "content",
        (F.col("total") - F.col("_rank_desc")).cast("bigint").alias("position"),
    )


def conversation_transcript(
    messages: DataFrame, sessions: DataFrame | None = None, limit: int = RECENT_RAW_MESSAGE_LIMIT
) -> DataFrame:
    """Per session, the transcript of its recent context (bounded by ``limit``)."""
    recent = recent_context(messages, sessions, limit).withColumn("_line", transcript_line())
    per = recent.groupBy("session_id").agg(listagg_ordered("_line", NEWLINE, "position").alias("_t"))
    all_sessions = messages.select("session_id").distinct()
    if sessions is not None:
        all_sessions = all_sessions.union(sessions.select("session_id")).distinct()
    return all_sessions.join(per, "session_id", "left").select(
        "session_id", F.coalesce("_t", F.lit(NO_CONVERSATION)).alias("transcript")
    )


def compaction_plan(
    messages: DataFrame,
    sessions: DataFrame | None = None,
    trigger: int = COMPACTION_TRIGGER_MESSAGE_COUNT,
    limit: int = RECENT_RAW_MESSAGE_LIMIT,
) -> DataFrame:
    """Sessions due for compaction and the resulting summarized count.

    Due when total > trigger and unsummarized > limit; all unsummarized
    messages but the last ``limit`` are compacted. Raw rows stay.
    """
    st = _session_state(messages, sessions)
    unsummarized = F.col("total") - F.col("summarized")
    due = st.filter((F.col("total") > trigger) & (unsummarized > limit))
    to_compact = (unsummarized - F.lit(limit)).cast("bigint")
    return due.select(
        "session_id",
        F.col("total").cast("bigint").alias("total_messages"),
        F.col("summarized").alias("summarized_before"),
        to_compact.alias("messages_to_compact"),
        (F.col("summarized") + to_compact).alias("summarized_after"),
    )


def messages_to_compact(
    messages: DataFrame,
    sessions: DataFrame | None = None,
    trigger: int = COMPACTION_TRIGGER_MESSAGE_COUNT,
    limit: int = RECENT_RAW_MESSAGE_LIMIT,
) -> DataFrame:
    """The message rows a compaction would fold into the session summary."""
    plan = compaction_plan(messages, sessions, trigger, limit)
    pos = with_positions(messages)
    j = pos.join(plan, "session_id")
    return j.filter(
        (F.col("position") >= F.col("summarized_before")) & (F.col("position") < F.col("summarized_after"))
    ).select("session_id", "created_at", "role", "content", "position")


# The summary prompt template.
SUMMARY_HEAD = (
    "You maintain long-term memory for a running coach chat.\n"
    "\n"
    "Update the session summary using:\n"
    "- the previous summary\n"
    "- the older conversation turns that are being compacted\n"
    "\n"
    "Keep only durable and useful facts such as:\n"
    "- user goals\n"
    "- race targets\n"
    "- training phase\n"
    "- preferences\n"
    "- injury or recovery notes\n"
    "- constraints\n"
    "- conclusions already reached\n"
    "- unresolved follow-ups\n"
    "\n"
    "Do not include filler or repeated phrasing.\n"
    "Do not invent facts.\n"
    "Keep the summary concise and factual.\n"
    "\n"
    "Previous summary:\n"
)
SUMMARY_HISTORY = "\n\nOlder conversation to compact:\n"
SUMMARY_TAIL = "\n\nReturn only the updated session summary."


def summary_prompt(
    messages: DataFrame,
    sessions: DataFrame | None = None,
    trigger: int = COMPACTION_TRIGGER_MESSAGE_COUNT,
    limit: int = RECENT_RAW_MESSAGE_LIMIT,
    messages_per_part: int = 256,
) -> DataFrame:
    """The prompt that folds a session's older messages into its summary: session_id, part, n_parts, text.

    The parts of a session, in order and joined without a separator, are its prompt. A part holds
    at most ``messages_per_part`` messages, so a session of any length is spread over tasks; the first one
    has the instructions and the previous summary, the last one the closing line.
    """
    plan = compaction_plan(messages, sessions, trigger, limit)
    state = _session_state(messages, sessions).select("session_id", F.coalesce(F.nullif("summary", F.lit("")), F.lit(NO_SUMMARY)).alias("prior"))
    due = plan.join(state, "session_id").select(
        "session_id", "prior", F.col("summarized_before").alias("first"),
        F.ceil(F.col("messages_to_compact") / F.lit(messages_per_part)).cast("bigint").alias("n_parts"),
    )
    rows = messages_to_compact(messages, sessions, trigger, limit).join(due.select("session_id", "first"), "session_id")
    part = F.floor((F.col("position") - F.col("first")) / F.lit(messages_per_part)).cast("bigint")
    texts = (
        rows.select("session_id", part.alias("part"), "position", transcript_line().alias("line"))
        .groupBy("session_id", "part")
        .agg(listagg_ordered("line", NEWLINE, "position").alias("lines"))
    )
    opening = F.when(F.col("part") == 0, F.concat(F.lit(SUMMARY_HEAD), F.col("prior"), F.lit(SUMMARY_HISTORY))).otherwise(F.lit(NEWLINE))
    closing = F.when(F.col("part") == F.col("n_parts") - 1, F.lit(SUMMARY_TAIL)).otherwise(F.lit(""))
    return texts.join(due, "session_id").select(
        "session_id", "part", "n_parts", F.concat(opening, F.coalesce("lines", F.lit("")), closing).alias("text")
    )


#: The states of a run; a run that is not ended is still started.
STARTED, COMPLETED, FAILED = "started", "completed", "failed"
RUN_DETAILS = ("prompt_tokens", "completion_tokens", "duration_ms", "error_message")


def run_states(events: DataFrame, run_cols: list[str], at: str = "at") -> DataFrame:
    """The last state of every run of an event log: run columns, status, details, total_tokens.

    ``events`` has a row per state change (status started, completed or failed, with the details
    that came with it). The latest event decides; of events of the same time, an end comes after the
    start, and a failure after a completion. One partial aggregate: a run's log, however long, is
    reduced before the shuffle. Details that the last event lacks stay NULL, as a failed run has no counts.
    """
    rank = F.when(F.col("status") == STARTED, 0).when(F.col("status") == COMPLETED, 1).otherwise(2)
    last = F.max_by(F.struct("status", *RUN_DETAILS), F.struct(F.col(at), rank)).alias("last")
    known = events.filter(F.col("status").isin(STARTED, COMPLETED, FAILED))
    states = known.groupBy(*run_cols).agg(last, F.count(F.lit(1)).alias("n_events")).select(*run_cols, "last.*", "n_events")
    return states.withColumn("total_tokens", llm_run_usage(F.col("prompt_tokens"), F.col("completion_tokens")))


def llm_run_usage(prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Total tokens: NULL when both counts are NULL, else the sum with NULL as 0."""
    return F.when(
        prompt_tokens.isNull() & completion_tokens.isNull(), F.lit(None).cast("bigint")
    ).otherwise(F.coalesce(prompt_tokens, F.lit(0)) + F.coalesce(completion_tokens, F.lit(0)))


def _rstrip_py(c: Column) -> Column:
    return F.regexp_replace(c, PY_WHITESPACE_CLASS + "+\\z", "")


def prompt_assembly(
    messages: DataFrame,
    training_context: DataFrame,
    sessions: DataFrame | None = None,
    limit: int = RECENT_RAW_MESSAGE_LIMIT,
) -> DataFrame:
    """The chat prompt for every user turn.

    History = the ``limit`` messages right before the turn (what the service
    reads before storing the question): a window of ``limit`` rows over chunks of the session. The last
    ``limit`` messages of a chunk are also the first ones of the next chunk, so no window ends at a border,
    every other text is moved once, and a session of any length is spread over tasks.
    ``training_context`` is a one-row frame, used as a scalar subquery.
    """
    rows = max(MESSAGES_PER_CHUNK, limit)
    pos = with_positions(messages).select("session_id", "created_at", "role", "content", "position")
    own = F.floor(F.col("position") / F.lit(rows)).cast("bigint")
    places = F.when(F.col("position") % rows >= rows - limit, F.array(own, own + 1)).otherwise(F.array(own))
    placed = pos.select("*", own.alias("_own"), F.explode(places).alias("_chunk"))
    before = Window.partitionBy("session_id", "_chunk").orderBy("position").rowsBetween(-limit, -1)
    lines = F.collect_list(transcript_line()).over(before)
    history = F.when(F.size("_lines") > 0, F.array_join("_lines", NEWLINE)).alias("_history")
    questions = (
        placed.withColumn("_lines", lines)
        .filter((F.col("_own") == F.col("_chunk")) & (F.col("role") == "user"))
        .select("session_id", "created_at", "content", history)
    )
    st = _session_state(messages, sessions).select("session_id", "summary")
    ctx = training_context.select(F.col(training_context.columns[0]).alias("c")).scalar()
    q = questions.join(st, "session_id", "left")
    body = F.concat(
        F.lit(PROMPT_HEAD),
        ctx,
        F.lit(PROMPT_SUMMARY),
        F.coalesce(F.nullif(F.col("summary"), F.lit("")), F.lit(NO_SUMMARY)),
        F.lit(PROMPT_HISTORY),
        F.coalesce(F.col("_history"), F.lit(NO_CONVERSATION)),
        F.lit(PROMPT_QUESTION),
        F.col("content"),
    )
    return q.select("session_id", "created_at", _rstrip_py(body).alias("prompt"))
