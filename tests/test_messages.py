import json
import os
import random

import pytest
from pyspark.sql import functions as F

from segmill.operators import messages as M
from segmill.schemas import MESSAGES, SUBMISSIONS
from segmill.streaming import messages as S


def log(spark, rows):
    return spark.createDataFrame(rows, MESSAGES)


def submitted(spark, *ids, seq=0):
    return spark.createDataFrame([(seq, i, "download", f"http://h/{i}") for i in ids], SUBMISSIONS)


ROWS = [
    (1, "podcast.download.complete", "a", "f1"),
    (2, "podcast.transcribe.complete", "a", "f1"),
    (3, "podcast.download.failed", "b", None),
    (4, "podcast.ad_detection.complete", "a", ""),
    (5, "podcast.audio_processing.complete", "a", "f1"),
    (6, "podcast.download.failed", "a", "f1"),
    (7, "podcast.download.complete", None, "f2"),
]


def test_routing(spark):
    got = [tuple(r) for r in M.next_requests(log(spark, ROWS)).orderBy("seq").collect()]
    assert got == [(1, "podcast.transcribe.request", "a", "f1"), (2, "podcast.ad_detection.request", "a", "f1")]


def test_status_is_not_sticky(spark):
    got = {r.correlation_id: (r.type, r.url, r.status, r.n_steps, r.last_seq) for r in M.request_status(log(spark, ROWS), submitted(spark, "a", "b", "quiet")).collect()}
    assert got == {"a": ("download", "http://h/a", "failed", 5, 6), "b": ("download", "http://h/b", "failed", 2, 3), "quiet": ("download", "http://h/quiet", "processing", 1, 0)}


def test_steps(spark):
    got = [(r.step, r.step_status) for r in M.request_steps(log(spark, ROWS), submitted(spark, "a")).where("correlation_id = 'a'").orderBy("step_no").collect()]
    assert got == [("submitted", "completed"), ("download", "completed"), ("transcribe", "completed"), ("audio_processing", "completed"), ("download", "failed")]


def test_unknown_requests_are_ignored(spark):
    """A message counts for a request that was submitted before it, and for the last submission of its id."""
    rows = log(spark, ROWS)
    assert M.request_status(rows, submitted(spark)).count() == 0 and M.request_steps(rows, submitted(spark)).count() == 0
    late = submitted(spark, "a", seq=2)
    assert [(r.correlation_id, r.n_steps, r.last_seq) for r in M.request_status(rows, late).collect()] == [("a", 4, 6)]
    assert {(r.seq, r.correlation_id) for r in M.unknown_updates(rows, late).collect()} == {(1, "a"), (3, "b")}
    again = submitted(spark, "a").unionByName(submitted(spark, "a", seq=6).withColumn("url", F.lit("other")))
    assert [(r.url, r.status, r.n_steps) for r in M.request_status(rows, again).collect()] == [("other", "failed", 2)]
    assert {r.correlation_id for r in M.unknown_updates(rows, again).collect()} == {"b"}
    after = submitted(spark, "a", seq=7)
    assert [(r.status, r.n_steps, r.last_seq) for r in M.request_status(rows, after).collect()] == [("processing", 1, 7)]


def test_feeds_and_external_updates(spark):
    rows = [(1, "podcast.rss.download.complete", "f", "url", None, None), (2, "podcast.rss.download.failed", "g", None, None, None), (3, "api.status.update", "f", None, "paused", None), (4, "api.status.update", "g", None, "again", "retry"), (5, "api.status.update", "g", None, "", "x")]
    log = spark.createDataFrame(rows, MESSAGES + ", new_status string, new_step string")
    got = {r.correlation_id: (r.status, r.n_steps, r.last_seq) for r in M.request_status(log, submitted(spark, "f", "g")).collect()}
    assert got == {"f": ("paused", 2, 3), "g": ("again", 3, 4)}
    assert [r.step for r in M.request_steps(log, submitted(spark, "f", "g")).where("correlation_id = 'g'").orderBy("step_no").collect()] == ["submitted", "rss_download", "retry"]


def test_invalid_requests(spark):
    got = {(r.seq, r.topic) for r in M.invalid_requests(log(spark, ROWS)).collect()}
    assert got == {(3, "podcast.download.failed"), (4, "podcast.ad_detection.failed")}


def test_claims(spark):
    events = [(1, "k", "request"), (2, "k", "request"), (3, "k", "failed"), (4, "k", "request"), (5, "k", "done"), (6, "k", "request"), (7, "z", "request")]
    rows = spark.createDataFrame(events, "seq bigint, key string, event string")
    got = [r.outcome for r in M.claim_outcome(rows, busy="in_progress").orderBy("seq").collect()]
    assert got == ["claimed", "in_progress", "claimed", "already_processed", "claimed"]
    assert "failed" in [r.outcome for r in M.claim_outcome(rows).collect()]


def test_work(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert [r.key for r in M.new_work(keys("a", "b"), keys("b", "c")).collect()] == ["a"]
    assert [r.key for r in M.already_processed(keys("a", "b", "c"), keys("b", "c"), keys("c")).collect()] == ["c"]


NAMES = {"messages": ("seq", "topic", "correlation_id", "file_path"), "submissions": ("seq", "correlation_id", "type", "url")}


def drop(folder, kind, n, rows):
    """A file of the stream, later than those before."""
    (folder / kind).mkdir(parents=True, exist_ok=True)
    path = folder / kind / f"{n:03}.json"
    path.write_text("".join(json.dumps(dict(zip(NAMES[kind], r, strict=True))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + n,) * 2)


def test_streams_without_state(spark, tmp_path):
    for n, part in enumerate((ROWS[:3], ROWS[3:])):
        drop(tmp_path, "messages", n, part)
    messages = S.read_messages(spark, str(tmp_path / "messages"), files_per_batch=1)
    S.to_table(S.next_requests_stream(messages), str(tmp_path / "next"), str(tmp_path / "c2")).awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "next")).collect()} == {tuple(r) for r in M.next_requests(log(spark, ROWS)).collect()}
    S.to_table(S.first_claims_stream(messages), str(tmp_path / "first"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(r.file_path for r in spark.read.parquet(str(tmp_path / "first")).collect()) == ["", "f1", "f2"]


@pytest.mark.parametrize("seed", [1, 3])
def test_streamed_requests_equal_batch(spark, tmp_path, seed):
    """Any split of the log into batches, messages that are overtaken, ids submitted again or never, and a restart."""
    rng = random.Random(seed)
    hold = seed == 3
    topics = [f"podcast.{s}.{k}" for s in M.STAGES for k in ("complete", "failed")]
    told = [(2 * i + 1, rng.choice(topics), rng.choice("abcdefxyz"), rng.choice(("f", "f", None))) for i in range(120)]
    opened = [(0, c, "download", f"u/{c}") for c in "abc"] + [(2 * rng.randrange(120), c, "rss", f"u/{c}/{i}") for i, c in enumerate("adefa")]
    # held streams arrive in any order; else a message may come late, but not a submission
    if hold:
        parts = [(rng.randrange(8), m) for m in told], [(rng.randrange(8), s) for s in opened]
    else:
        cuts = sorted(rng.sample(range(240), 7))
        place = lambda seq: sum(c <= seq for c in cuts)
        parts = [(min(7, place(m[0]) + (rng.random() < 0.2) * rng.randrange(3)), m) for m in told], [(place(s[0]), s) for s in opened]
    n = 0
    for half in (range(4), range(4, 8)):
        for b in half:
            for kind, rows in zip(("messages", "submissions"), parts, strict=True):
                mine = [r for at, r in rows if at == b]
                rng.shuffle(mine)
                drop(tmp_path, kind, b, mine)
        streams = S.read_messages(spark, str(tmp_path / "messages"), 1), S.read_submissions(spark, str(tmp_path / "submissions"), 1)
        S.to_table(S.request_changes_stream(*streams, hold=hold), str(tmp_path / "out"), str(tmp_path / "c"), "update").awaitTermination()
        n += len(half)
        have = log(spark, [r for at, r in parts[0] if at < n]), spark.createDataFrame([r for at, r in parts[1] if at < n], SUBMISSIONS)
        changes = S.latest_changes(spark.read.parquet(str(tmp_path / "out")))
        status = S.changed_requests(changes).select("correlation_id", "type", "url", "status", "n_steps", "last_seq")
        assert sorted(map(tuple, status.collect())) == sorted(map(tuple, M.request_status(*have).collect()))
        assert sorted(map(tuple, S.changed_steps(changes).drop("batch").collect())) == sorted(map(tuple, M.request_steps(*have).collect()))
        if not hold:
            assert {r.seq for r in S.unknown_changes(changes).collect()} == {r.seq for r in M.unknown_updates(*have).collect()}
    assert status.count() == 6


HELD = [("podcast.download.complete", "f"), ("podcast.transcribe.failed", "f"), ("podcast.ad_detection.complete", None), ("podcast.audio_processing.complete", "f")]


@pytest.mark.parametrize("aggregated", [True, False])
def test_held_requests_in_any_order(spark, tmp_path, monkeypatch, aggregated):
    """Messages far ahead of their submission, a submission after a later one, several messages of an id in one batch, and an id
    without messages. Without a time to live the state of many ids costs no call of Python for each; RequestState gives the same."""
    if not aggregated:
        monkeypatch.setattr(S, "_held_requests", lambda events: events.groupBy("correlation_id").transformWithStateInPandas(S.RequestState(None, True), S.CHANGES, "update", "none"))
    told = [(10 * i + j, *HELD[(i + j) % 4], c) for i in range(6) for j, c in enumerate("abcx")]
    told = [(seq, topic, c, path) for seq, topic, path, c in told]
    opened = [(-1, "a", "rss", "u/a"), (25, "b", None, "u/b1"), (5, "b", "rss", "u/b0"), (22, "c", "rss", "u/c"), (3, "d", "rss", None)]
    # all that is told before all that is opened, but for the last rows
    batches = [(told[12:], []), ([], opened[:2]), (told[3:12], opened[2:]), (told[:3], [])]
    for n, (messages, submissions) in enumerate(batches):
        drop(tmp_path, "messages", n, messages)
        drop(tmp_path, "submissions", n, submissions)
    streams = S.read_messages(spark, str(tmp_path / "messages"), 1), S.read_submissions(spark, str(tmp_path / "submissions"), 1)
    query = S.to_table(S.request_changes_stream(*streams, hold=True), str(tmp_path / "out"), str(tmp_path / "c"), "update")
    query.awaitTermination()
    changes = S.latest_changes(spark.read.parquet(str(tmp_path / "out")))
    have = log(spark, told), spark.createDataFrame(opened, SUBMISSIONS)
    status = S.changed_requests(changes).select("correlation_id", "type", "url", "status", "n_steps", "last_seq")
    assert sorted(map(tuple, status.collect())) == sorted(map(tuple, M.request_status(*have).collect()))
    assert sorted(map(tuple, S.changed_steps(changes).drop("batch").collect())) == sorted(map(tuple, M.request_steps(*have).collect()))
    operators = [o.operatorName for o in query.lastProgress.stateOperators]
    assert (operators == ["stateStoreSave"]) == aggregated


ANY = [
    {"topic": "podcast.download.complete", "data": {"file_path": "f1", "more": [1, {"a": None}]}, "message_id": "m1", "correlation_id": "a"},
    {"topic": "podcast.rss.download.complete", "data": {"rss_url": "u"}, "message_id": "m2", "correlation_id": None},
    {"topic": "api.status.update", "data": {"status": "paused", "step": "x"}, "message_id": None, "correlation_id": "a"},
    *({"topic": "t", "data": d, "message_id": "m", "correlation_id": "c"} for d in ("text", 'a "quoted" \\ text', "5", "null", "{}", "", 5, -1.25, True, None, [1, "2", []], {}, {"": {"ä": "\u2028😀"}})),
]


def test_envelopes(spark, tmp_path):
    lacking = [json.dumps({k: v for k, v in ANY[0].items() if k != lost}) for lost in ANY[0]]
    whole = json.dumps(ANY[0])
    behind = [whole + x for x in (" trailing", "}", ",", "{}", " null", ',"end":1}', whole, "\n{")]
    texts = [json.dumps(m) for m in ANY] + [f"  {whole}\n"] + lacking + behind + [whole[:-1], whole.replace('"topic"', '"data": 1, "topic"', 1), json.dumps({**ANY[0], "topic": None}), "{bad", "", "[1]", f"[{whole}]", "null", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "seq bigint, value string")
    found = M.from_envelopes(raw)
    got = {r.seq: {"topic": r.topic, "data": None if r.data is None else json.loads(r.data), "message_id": r.message_id, "correlation_id": r.correlation_id} for r in found.collect()}
    assert got == dict(enumerate([*ANY, ANY[0]]))
    log = {r.seq: tuple(r)[1:] for r in M.log_of(found).collect()}
    assert log[0] == ("podcast.download.complete", "a", "f1", None, None) and log[1][2] == "u" and log[2][3:] == ("paused", "x") and log[4][2] is None
    # what is sent and read again is the same
    sent = M.to_envelopes(found, keep=("seq",))
    assert {r.seq: json.loads(r.value) for r in sent.collect()} == got
    again = M.from_envelopes(sent.drop("topic"))
    assert sorted(map(tuple, again.select(found.columns).collect()), key=str) == sorted(map(tuple, found.collect()), key=str)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(m) for m in ANY) + "\n{bad\n")
    S.to_table(S.read_envelopes(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ANY)


def test_streamed_claims_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    events = [(i, rng.choice("abcdefgh"), rng.choices(("request", "failed", "done"), (8, 3, 1))[0]) for i in range(300)]
    (tmp_path / "in").mkdir()
    for n in range(6):
        part = events[50 * n : 50 * n + 50]
        rng.shuffle(part)
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps(dict(zip(("seq", "key", "event"), e, strict=True))) + "\n" for e in part))
        os.utime(tmp_path / f"in/{n}.json", (1_700_000_000 + n,) * 2)  # files are taken in the order of their times
    stream = spark.readStream.schema("seq bigint, key string, event string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    S.to_table(S.claim_outcome_stream(stream, "in_progress"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    want = M.claim_outcome(spark.createDataFrame(events, "seq bigint, key string, event string"), "in_progress")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
    assert {r.outcome for r in want.collect()} == {"claimed", "in_progress", "already_processed"}


def test_feed_requests_and_last_file(spark):
    requests = spark.createDataFrame([(1, "u"), (2, "v"), (3, None)], "i int, rss_url string")
    got = M.feed_requests(requests, requests.where("i <> 2"))
    assert {(r.i, r.already_processed) for r in got.collect()} == {(1, True), (2, False), (3, False)}
    asked = spark.createDataFrame([(1, "u"), (2, None), (3, "w")], "request_id bigint, url string")
    produced = spark.createDataFrame([("u", "f1", 1), ("u", "f2", 2)], "url string, file string, seq bigint")
    objects = spark.createDataFrame([("f1",), ("f2",)], "key string")
    assert sorted(map(tuple, M.serve_decision(asked, produced, objects).collect())) == [(1, 200, "f2"), (2, 400, None), (3, 202, None)]
