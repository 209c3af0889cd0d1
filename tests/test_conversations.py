from __future__ import annotations

from stridelake.operators import conversations as conv

MSG = "session_id long, created_at long, role string, content string"


def _msgs(spark):
    rows = []
    for i in range(8):
        rows.append((1, i, "user" if i % 2 == 0 else "assistant", f"m{i}"))
    rows += [(2, 0, "assistant", "hello"), (2, 1, "user", "  How   was my run?  ")]
    return spark.createDataFrame(rows, MSG)


def test_recent_and_transcript_respect_summarized_prefix(spark):
    m = _msgs(spark)
    sessions = spark.createDataFrame([(1, "sum", 5)], "session_id long, summary string, summarized_message_count long")
    recent = sorted((r.session_id, r.created_at) for r in conv.recent_context(m, sessions, limit=6).collect())
    assert recent == [(1, 5), (1, 6), (1, 7), (2, 0), (2, 1)]
    t = {r.session_id: r.transcript for r in conv.conversation_transcript(m, sessions, limit=2).collect()}
    assert t[1] == "User: m6\nAssistant: m7"
    assert t[2] == "Assistant: hello\nUser:   How   was my run?  "


def test_transcript_fallback_for_session_without_messages(spark):
    m = _msgs(spark)
    sessions = spark.createDataFrame([(3, None, 0)], "session_id long, summary string, summarized_message_count long")
    t = {r.session_id: r.transcript for r in conv.conversation_transcript(m, sessions, limit=2).collect()}
    assert t[3] == "No previous conversation."


def test_compaction_plan(spark):
    m = _msgs(spark)
    plan = {r.session_id: tuple(r)[1:] for r in conv.compaction_plan(m, trigger=4, limit=2).collect()}
    assert plan == {1: (8, 0, 6, 6)}
    rows = sorted(r.created_at for r in conv.messages_to_compact(m, trigger=4, limit=2).collect())
    assert rows == [0, 1, 2, 3, 4, 5]
    sessions = spark.createDataFrame([(1, "s", 6)], "session_id long, summary string, summarized_message_count long")
    assert conv.compaction_plan(m, sessions, trigger=4, limit=2).count() == 0


def test_titles_and_listing(spark):
    m = _msgs(spark)
    titles = {r.session_id: r.title for r in conv.session_titles(m).collect()}
    assert titles == {1: "m0", 2: "How was my run?"}
    listed = conv.list_sessions(m).collect()
    assert [r.session_id for r in listed] == [1, 2] and listed[0].label == "m0"


def test_prompt_assembly_text(spark):
    m = _msgs(spark)
    ctx = spark.createDataFrame([("Latest run on 2024-01-01: Total distance: 5.0 km, time: 25:00",)], "c string")
    p = {(r.session_id, r.created_at): r.prompt for r in conv.prompt_assembly(m, ctx, limit=2).collect()}
    ind = " " * 8
    assert p[(2, 1)] == (
        "You are a concise running coach.\n"
        f"{ind}Use the training context when answering.\n"
        f"{ind}Use the session summary and recent conversation to preserve continuity.\n"
        f"{ind}If the context is incomplete, say what assumption you are making.\n"
        f"{ind}Do not invent Garmin metrics that were not provided.\n"
        f"{ind}Answer in 4 short bullet points max.\n\n"
        f"{ind}Training context:\n{ind}Latest run on 2024-01-01: Total distance: 5.0 km, time: 25:00\n\n"
        f"{ind}Session summary:\n{ind}No previous summary.\n\n"
        f"{ind}Recent conversation:\n{ind}Assistant: hello\n\n"
        f"{ind}User question:\n{ind}  How   was my run?"
    )
    assert p[(1, 0)].split("Recent conversation:\n" + ind)[1].startswith("No previous conversation.")
    assert "User: m2\nAssistant: m3\n\n" in p[(1, 4)]


def test_llm_usage(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(12, 8), (None, None), (None, 5)], "p long, c long")
    got = [r[0] for r in df.select(conv.llm_run_usage(F.col("p"), F.col("c"))).collect()]
    assert got == [20, None, 5]


SESSIONS = "session_id long, summary string, summarized_message_count long"
TEMPLATE = """You maintain long-term memory for a running coach chat.

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
{prior}

Older conversation to compact:
{old}

Return only the updated session summary."""


def test_summary_prompt_in_parts_equals_the_whole_text(spark):
    m = _msgs(spark)
    sessions = spark.createDataFrame([(1, "Likes hills.", 3)], SESSIONS)
    for size, parts in ((1, 3), (2, 2), (100, 1)):
        rows = conv.summary_prompt(m, sessions, trigger=4, limit=2, messages_per_part=size).orderBy("part").collect()
        assert [(r.session_id, r.part, r.n_parts) for r in rows] == [(1, k, parts) for k in range(parts)]
        old = "Assistant: m3\nUser: m4\nAssistant: m5"
        assert "".join(r.text for r in rows) == TEMPLATE.format(prior="Likes hills.", old=old)
    blank = spark.createDataFrame([(1, "", None), (2, None, 0)], SESSIONS)
    text = conv.summary_prompt(m, blank, trigger=4, limit=6).collect()
    assert [r.text for r in text] == [TEMPLATE.format(prior="No previous summary.", old="User: m0\nAssistant: m1")]
    assert conv.summary_prompt(m, sessions, trigger=40, limit=2).count() == 0
    assert conv.summary_prompt(m.limit(0), sessions).count() == 0


def test_summary_prompt_of_a_very_long_session_is_spread(spark):
    rows = spark.range(3000).selectExpr("1L as session_id", "id as created_at", "'user' as role", "concat('m', id) as content")
    parts = conv.summary_prompt(rows, messages_per_part=100).orderBy("part").collect()
    assert len(parts) == 30 and max(r.text.count("User: ") for r in parts) == 100
    assert "".join(r.text for r in parts) == TEMPLATE.format(prior="No previous summary.", old="\n".join(f"User: m{i}" for i in range(2994)))


def test_run_states_reduce_an_event_log(spark):
    schema = "run long, at long, status string, prompt_tokens long, completion_tokens long, duration_ms long, error_message string"
    log = [
        (1, 10, "started", None, None, None, None), (1, 20, "completed", 5, 7, 100, None),
        (2, 10, "started", None, None, None, None), (2, 30, "failed", None, None, 40, "timeout"),
        (3, 10, "started", None, None, None, None),
        (4, 10, "completed", 5, None, 3, None), (4, 10, "started", None, None, None, None),  # one clock tick: ended
        (5, 10, "started", None, None, None, None), (5, 20, "failed", None, None, 1, "x"),
        (5, 30, "started", None, None, None, None), (5, 40, "completed", None, None, 9, None),  # tried again
        (6, 10, "unknown", None, None, None, None),
        (1, 10, "started", None, None, None, None),  # logged twice
    ]
    got = conv.run_states(spark.createDataFrame(log, schema).repartition(4), ["run"])
    assert {r.run: (r.status, r.total_tokens, r.duration_ms, r.error_message, r.n_events) for r in got.collect()} == {
        1: ("completed", 12, 100, None, 3), 2: ("failed", None, 40, "timeout", 2), 3: ("started", None, None, None, 1),
        4: ("completed", 5, 3, None, 2), 5: ("completed", None, 9, None, 4),
    }


def test_history_does_not_end_at_chunk_borders(spark, monkeypatch):
    m = spark.range(50).selectExpr("1L as session_id", "id as created_at", "if(id % 3 = 0, 'user', 'assistant') as role", "if(id = 7, null, concat('m', id)) as content")
    ctx = spark.createDataFrame([("c",)], "c string")
    for rows, limit in ((1024, 4), (6, 4), (4, 4), (2, 5)):
        monkeypatch.setattr(conv, "MESSAGES_PER_CHUNK", rows)
        got = {r.created_at: r.prompt for r in conv.prompt_assembly(m, ctx, limit=limit).collect()}
        assert sorted(got) == list(range(0, 50, 3))
        for i, text in got.items():
            said = [f"{'User' if k % 3 == 0 else 'Assistant'}: m{k}" for k in range(max(0, i - limit), i) if k != 7]
            history = text.split("Recent conversation:\n" + " " * 8)[1].split("\n\n        User question:")[0]
            assert history == ("\n".join(said) or "No previous conversation.")
