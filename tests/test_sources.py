import json
import os
import random
import threading
import time
import xml.etree.ElementTree as ET
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from segmill.functions import columns as C
from segmill.operators import classifier, detection, feeds, transcripts
from segmill.parameters import Parameters
from segmill.schemas import ANSWERS, SEGMENTS
from segmill.sources import files, objects
from segmill.sources.objects import ObjectStore, ObjectStoreError


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, str(tmp_path / "store"))
    local = tmp_path / "local.bin"
    local.write_bytes(b"two")
    store.put("test/file1.txt", b"one")
    store.put("test/file2.txt", str(local))
    store.put("other/file3.txt", b"")
    assert store.get("test/file2.txt") == b"two" and store.get("other/file3.txt") == b""
    assert {r.key: r.size for r in store.list().collect()} == {"test/file1.txt": 3, "test/file2.txt": 3, "other/file3.txt": 0}
    assert {r.key for r in store.list("test").collect()} == {"test/file1.txt", "test/file2.txt"}
    assert store.list("none").count() == 0
    assert {(r.key, bytes(r.content)) for r in store.read("test").collect()} == {("test/file1.txt", b"one"), ("test/file2.txt", b"two")}
    for key in ("test/_x", "test/.y", "test/sub/deep/z", "test/empty"):
        store.put(key, b"" if key.endswith("empty") else b"q")
    more = {"test/_x": b"q", "test/.y": b"q", "test/sub/deep/z": b"q", "test/empty": b"", "test/file1.txt": b"one", "test/file2.txt": b"two"}
    assert {r.key: r.size for r in store.list("/test/").collect()} == {k: len(v) for k, v in more.items()}
    assert {r.key: bytes(r.content) for r in store.read("test").collect()} == more and store.read("none").count() == 0
    assert all(r.last_modified is not None for r in store.list().collect())
    assert [r.key for r in store.list("test/sub").collect()] == ["test/sub/deep/z"]
    assert store.url("test/file1.txt") == f"file://{tmp_path}/store/test/file1.txt"
    assert store.delete("test/file1.txt") and not store.exists("test/file1.txt") and not store.delete("test/file1.txt")
    assert store.delete("test") and not store.exists("test/file2.txt")
    with pytest.raises(ObjectStoreError):
        store.get("test/file1.txt")
    with pytest.raises(ObjectStoreError):
        store.put("x", str(tmp_path / "missing"))
    with pytest.raises(ObjectStoreError):
        ObjectStore(spark, "gs://bucket")


def test_listing_by_prefix(spark, tmp_path, monkeypatch):
    """A flat folder is dealt to several tasks by ranges of keys, in pages of bounded size; a prefix is any text."""
    root = tmp_path / "flat"
    (root / "podcasts/deep/er").mkdir(parents=True)
    names = [f"podcasts/{i * 7919 % 100_003:06}" for i in range(3000)] + ["podcasts/deep/er/z", "podcasts/deep/y", "podx", "other", "podcasts/.note.crc", "podcasts/x", "podcasts/.x.crc", "podcasts/_q"]
    for name in names:
        (root / name).write_bytes(b"123")
    store = ObjectStore(spark, str(root))
    want = set(names) - {"podcasts/.x.crc"}
    found = store.list_by_prefix("pod", tasks=8)
    assert {r.key for r in found.collect()} == {n for n in want if n.startswith("pod")} and found.where("size <> 3").count() == 0
    sizes = [r.n for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1000
    assert {r.key for r in store.list_by_prefix("podcasts/de").collect()} == {"podcasts/deep/er/z", "podcasts/deep/y"}
    assert {r.key for r in store.list("podcasts").collect()} == {n for n in want if n.startswith("podcasts/")}
    assert {r.key for r in store.list().collect()} == want and store.list_by_prefix("none/x").count() == 0
    monkeypatch.setattr(objects, "PAGE", 100)
    reader = objects.ListingReader({"root": f"file://{root}", "prefix": "pod", "tasks": "3", "settings": "{}"})
    pages = [b.num_rows for part in reader.partitions() for b in reader.read(part)]
    assert max(pages) == 100 and sum(pages) == len(want) - 1


def test_bulk_write(spark, tmp_path):
    """Rows become objects by tasks; a task that fails and runs again leaves nothing by halves."""
    store = ObjectStore(spark, str(tmp_path / "bulk"))
    store.put("a/1", b"old")
    rows = spark.range(2000, numPartitions=4).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("key"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).cast("binary").alias("content"), F.lit(1).alias("size"))
    assert store.put_all(rows) == 2000
    got = {r.key: len(r.content) for r in store.read("a").collect()}
    assert got == {f"a/{i}": i % 50 for i in range(2000)}
    assert store.put_all(spark.createDataFrame([("n", None)], "key string, content binary")) == 1 and store.get("n") == b""
    assert store.put_all(rows.limit(0)) == 0
    big = bytes(range(256)) * 40_000
    assert store.put_all(spark.createDataFrame([("big", big)], "key string, content binary")) == 1 and store.get("big") == big

    def fail(batches):
        for batch in batches:
            yield batch
        raise ValueError("lost")

    with pytest.raises(Exception, match="lost"):
        store.put_all(rows.select(F.concat(F.lit("b/"), "key").alias("key"), "content").mapInArrow(fail, "key string, content binary"))
    for key in (None, "", "/x", "a/../../x", "a//b", "x/"):
        with pytest.raises(Exception, match="is no key"):
            store.put_all(spark.createDataFrame([("fine", b"1"), (key, b"2")], "key string, content binary"))
    assert not store.exists("b") and not store.exists("fine") and not [p for p in (tmp_path / "bulk").iterdir() if "pending" in p.name]


def test_tasks_open_the_same_store(spark):
    """Endpoint and keys of the Hadoop settings, a bucket's own before those for all."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    given = {"fs.s3a.endpoint": "http://minio:9000", "fs.s3a.access.key": "k", "fs.s3a.bucket.mine.access.key": "own", "fs.s3a.secret.key": "s", "fs.s3a.endpoint.region": "eu-1"}
    for name, value in given.items():
        conf.set(name, value)
    try:
        settings = ObjectStore(spark, "s3a://mine/x")._settings()
        assert objects.s3_arguments(settings) == {"endpoint_override": "minio:9000", "scheme": "http", "access_key": "own", "secret_key": "s", "region": "eu-1"}
        store, base = objects.open_store("s3a://mine/x", settings)
        assert store.type_name == "s3" and base == "mine/x"
        assert ObjectStore(spark, "s3a://other")._settings()["access.key"] == "k" and ObjectStore(spark, "/tmp/x")._settings() == {}
    finally:
        for name in given:
            conf.unset(name)


def test_store_behind_a_mount_table(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.segmill.link./in", f"file://{tmp_path}")
    store = ObjectStore(spark, "viewfs://segmill/in/store")
    rows = spark.createDataFrame([("a/1", b"x"), ("a/2", b"yz")], "key string, content binary")
    assert store.list("a").count() == 0 and store.put_all(rows) == 2
    assert {r.key: r.size for r in store.list_by_prefix("a/").collect()} == {"a/1": 1, "a/2": 2} and store.get("a/2") == b"yz"
    assert {(r.key, bytes(r.content)) for r in store.read("a").collect()} == {("a/1", b"x"), ("a/2", b"yz")}


def test_columns(spark):
    row = spark.createDataFrame([("/a/test.mp3", "http://h/x?url=1", "/process?x=&url=http%3A%2F%2Fh%2Fa+b&y=1", ".hidden")], "p string, u string, t string, h string")
    got = row.select(C.key_of_path(F.col("p")), C.key_of_url(F.col("u")), C.query_value(F.col("t"), "url"), C.query_value(F.col("t"), "x"), C.clean_name(F.col("p")), C.clean_name(F.col("h")), C.content_type(F.col("p")), C.route(F.col("t"))).first()
    assert tuple(got) == ("podcasts/original/test.mp3", "podcasts/" + __import__("hashlib").md5(b"http://h/x?url=1").hexdigest(), "http://h/a b", None, "/a/test_clean.mp3", ".hidden_clean", "audio/mpeg", "process")


def test_feeds_round_trip(spark):
    xml = "<rss version='2.0'><channel><title>T</title><item><title>A &amp; B</title><enclosure url='u1?a=1&amp;b=2' type='audio/mpeg'/></item><item><title>C</title><enclosure url='v' type='video/mp4'/></item><item><title>D</title></item></channel></rss>"
    entries = files.feed_entries(spark.createDataFrame([("f", xml), ("bad", "<rss"), ("null", None)], "feed string, xml string"), "feed", "xml")
    assert entries.count() == 3
    found = feeds.episodes(entries)
    assert [(r.title, r.audio_url) for r in found.collect()] == [("A & B", "u1?a=1&b=2")]
    new = feeds.rewritten(found, "http://s")
    (row,) = feeds.feed_xml(new, "feed", "pos").collect()
    item = ET.fromstring(row.xml).find("channel/item")
    assert item.find("title").text == "A & B" and item.find("enclosure").get("url") == "http://s/process?url=u1?a=1&b=2"


def test_first_audio_enclosure(spark):
    links = "links array<struct<rel: string, type: string, href: string>>"
    rows = spark.createDataFrame([("a", [("enclosure", None, "x"), ("alternate", "audio/mpeg", "y"), ("enclosure", "audio/ogg", "z"), ("enclosure", "audio/mpeg", "w")]), ("b", [("enclosure", "audio/mpeg", "")]), ("c", [])], f"title string, {links}")
    assert [(r.title, r.audio_url) for r in feeds.episodes(rows).collect()] == [("a", "z")]


def test_transcripts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, "a", 0.0, 1.5, False), (1, 1, 1, "b", 2.0, 3.0, True)], SEGMENTS)
    files.write_transcripts(rows, str(tmp_path / "t"), "2024-01-01T00:00:00")
    back = files.read_transcripts(spark, str(tmp_path / "t"), lines=True).orderBy("pos")
    whole = [("1", datetime(2024, 1, 1), 0, 0, "a", 0.0, 1.5, False), ("1", datetime(2024, 1, 1), 1, 1, "b", 2.0, 3.0, True)]
    assert [tuple(r) for r in back.collect()] == whole
    assert back.select(C.iso_text(F.col("processed_at"))).first()[0] == "2024-01-01T00:00:00"
    segment = {"id": 1, "text": "a", "start": 0.0, "end": 1.0, "is_ad": True}
    cache = tmp_path / "c"
    cache.mkdir()
    (cache / "ok.json").write_text(json.dumps({"segments": [segment], "processed_at": "2024-01-01T10:20:30.5"}, indent=2))
    (row,) = files.read_transcripts(spark, str(cache)).collect()
    assert tuple(row) == ("ok.json", datetime(2024, 1, 1, 10, 20, 30, 500000), 0, 1, "a", 0.0, 1.0, True)
    for name, text, says in (
        ("lacking", json.dumps({"segments": [{k: v for k, v in segment.items() if k != "is_ad"}], "processed_at": "2024-01-01"}), "a segment lacks a key"),
        ("keyless", json.dumps({"segments": [segment]}), "a transcript lacks a key"),
        ("odd time", json.dumps({"segments": [segment], "processed_at": "yesterday"}), "no ISO time"),
        ("broken", "{not json", "."),
    ):
        (cache / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match=says):
            files.read_transcripts(spark, str(cache / f"{name}.json")).collect()
    # what can't be read is not in the cache, so it is transcribed again
    cached = files.readable_transcripts(spark, str(cache))
    assert [r.tid for r in cached.collect()] == ["ok.json"] and files.readable_transcripts(spark, str(tmp_path / "none")).count() == 0
    audio = spark.createDataFrame([("ok.json", b"a"), ("broken.json", b"b")], "tid string, content binary")
    new = detection.transcribe_new(audio, cached, lambda: lambda content: [{"text": "n", "start": 0.0, "end": 1.0}])
    assert [(r.tid, r.text) for r in new.collect()] == [("broken.json", "n")]


def test_processed(spark, tmp_path):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    path = str(tmp_path / "set")
    assert files.read_processed(spark, path).count() == 0
    files.write_processed(keys("a", "b", "b", None), path)
    files.write_processed(keys("b", "c"), path)
    assert sorted(r.key for r in files.read_processed(spark, path).collect()) == ["a", "b", "c"]
    assert sum(spark.read.parquet(path).groupBy("key").count().toPandas()["count"]) == 3
    (tmp_path / "set" / "part-broken.parquet").write_text("no parquet")
    assert files.read_processed(spark, path).count() == 3
    lists = tmp_path / "lists"
    lists.mkdir()
    (lists / "p.json").write_text('["a", "b"]')
    (lists / "q.json").write_text('["b", "z", null]')
    (lists / "r.json").write_text("not json")
    assert sorted(r.key for r in files.import_processed(spark, str(lists)).collect()) == ["a", "b", "z"]
    assert files.import_processed(spark, str(tmp_path / "none.json")).count() == 0


def test_classifier_slot(spark):
    rows = spark.createDataFrame([(1, i, i, f"t{i}", 0.0, 1.0, i == 3) for i in range(4)], SEGMENTS)

    def make():
        calls = {"n": 0}

        def call(messages):
            calls["n"] += 1
            if "bad" in messages[1]["content"] or calls["n"] == 1:
                raise ValueError("no answer")
            return {"segments": [{"id": 0, "ad": True}, {"id": 3, "ad": False}, {"id": 99, "ad": True}]}

        return call

    prompts = transcripts.chunk_prompts(transcripts.chunks(rows))
    answered = classifier.classify(prompts, make, pause_s=0)
    merged = transcripts.merge_answers(transcripts.chunks(rows), classifier.answer_rows(answered))
    assert {(r.id, r.is_ad, r.matched) for r in merged.collect()} == {(0, True, True), (1, False, False), (2, False, False), (3, False, True)}
    failed = classifier.classify(spark.createDataFrame([(1, 0, "bad")], "tid bigint, chunk_id bigint, prompt string"), make, pause_s=0)
    assert [tuple(r) for r in classifier.errors(failed).collect()] == [(1, 0, "no answer")]


def test_prompts_are_dealt_by_number_and_asked_once(spark, tmp_path):
    """64 prompts of one small file run in several tasks, with several calls at once; a second run asks nothing again, and a
    run that was killed is taken up where it ended."""
    calls, lots = tmp_path / "calls", tmp_path / "prompts"
    calls.mkdir()
    spark.range(64).selectExpr("id % 8 as tid", "id div 8 as chunk_id", "concat('ID: ', id) as prompt").coalesce(1).write.parquet(str(lots))
    prompts = spark.read.parquet(str(lots))

    def maker(fatal=False):
        def make():
            def call(messages):
                number = messages[1]["content"].split("ID: ")[1].split()[0]
                if fatal and number == "40":
                    os._exit(1)
                (calls / f"{number}-{random.randrange(10**9)}-{os.getpid()}-{threading.get_ident()}").write_text("")
                time.sleep(0.02)
                if number == "7" and fatal:
                    raise ValueError("busy")
                return {"segments": [{"id": int(number), "ad": True}]}

            return call

        return make

    with pytest.raises(Exception):
        classifier.ask(prompts, maker(fatal=True), str(tmp_path / "answers"), 1, 0, per_task=8, together=2)
    time.sleep(5)  # other tasks of the job may still end
    before = [p.name.split("-")[0] for p in calls.iterdir()]
    have = classifier.kept_answers(prompts, str(tmp_path / "answers"))
    kept = {str(r.answers[0].id) for r in have.where("error is null").collect()}
    assert "40" not in before and 0 < len(kept) < 64
    got = classifier.ask(prompts, maker(), str(tmp_path / "answers"), 1, 0, per_task=8)
    assert {(r.tid, r.chunk_id, r.answers[0].id, r.error) for r in got.collect()} == {(i % 8, i // 8, i, None) for i in range(64)}
    names = [p.name.split("-") for p in calls.iterdir()]
    later = [n[0] for n in names][:]
    for x in before:
        later.remove(x)
    assert not kept & set(later) and {n[0] for n in names} == {str(i) for i in range(64)}
    assert len({n[2] for n in names}) > 1 and len({(n[2], n[3]) for n in names}) > len({n[2] for n in names})
    assert classifier.ask(prompts, maker(), str(tmp_path / "answers"), 1, 0).count() == 64 and len(list(calls.iterdir())) == len(names)
    # another text is another prompt
    changed = prompts.withColumn("prompt", F.when(F.col("tid") == 3, F.concat("prompt", F.lit(" new"))).otherwise(F.col("prompt")))
    assert classifier.ask(changed, maker(), str(tmp_path / "answers"), 1, 0).count() == 64 and len(list(calls.iterdir())) == len(names) + 8
    assert classifier.classify(prompts, maker(), 1, 0, per_task=8).select(F.spark_partition_id().alias("p")).distinct().count() == 8


def test_transcriber_slot(spark):
    audio = spark.createDataFrame([(1, b"ab")], "tid bigint, content binary")
    got = classifier.transcribe(audio, lambda: lambda content: [{"text": f" {len(content)} ", "start": 0.0, "end": 1.0}])
    assert [tuple(r) for r in transcripts.segments_from_model(got).collect()] == [(1, 0, 0, "2", 0.0, 1.0, False)]


def test_strip_is_of_any_white_space(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    texts = [s + "a" + s + "b" + s for s in spaces] + ["\u200bx\u200b", "".join(spaces), "a\n\n", "\x85\na"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", C.strip(F.col("t")))
    assert all(r.s == r.t.strip() for r in rows.collect())


def test_feed_titles_and_parts(spark):
    rows = [(f, i, f"t{i}", "", "", f"http://a/{i}") for f in "abc" for i in range(40 if f == "a" else 2)]
    found = spark.createDataFrame(rows, "feed string, n long, title string, description string, published string, audio_url string")
    channels = spark.createDataFrame([("a", "A & co", "http://a", ""), ("b", None, None, None)], "feed string, title string, link string, description string")
    whole = {r.feed: r.xml for r in feeds.feed_xml(found, "feed", "n", channels).collect()}
    heads = {f: tuple(ET.fromstring(x).findtext(f"channel/{t}") for t in ("title", "link", "description")) for f, x in whole.items()}
    default = ("Episodes", "", "Episodes without advertisements")
    assert heads == {"a": ("A & co", "http://a", ""), "b": default, "c": default}
    parts = feeds.feed_xml_parts(found, "feed", "n", channels, partitions=5).collect()
    assert {f: "".join(r.xml for r in sorted(parts, key=lambda r: r.part) if r.feed == f) for f in "abc"} == whole
    assert sum(r.feed == "a" for r in parts) > 4
    xml = "<rss><channel><title>T</title><description></description></channel></rss>"
    got = files.feed_channels(spark.createDataFrame([("f", xml)], "feed string, xml string"), "feed", "xml").first()
    assert (got.title, got.link, got.description or "") == ("T", None, "")


def test_answers_count_in_their_chunk_only(spark):
    rng = random.Random(2)
    rows = [(t, rng.randrange(6), p, "x", 0.0, 1.0, rng.random() < 0.5) for t in range(4) for p in range(10)]
    answers = [(t, c, a, rng.randrange(8), rng.random() < 0.5) for t in range(4) for c in range(4) for a in rng.sample(range(50), rng.randrange(5))]
    want = []
    for t, i, p, _, _, _, flag in rows:
        own = [ad for tt, c, a, j, ad in sorted(answers) if (tt, c, j) == (t, p // 3, i)]
        want.append((t, p, own[0] if own else flag, bool(own)))
    chunked = transcripts.chunks(spark.createDataFrame(rows, SEGMENTS), Parameters(chunk_size=3))
    merged = transcripts.merge_answers(chunked, spark.createDataFrame(answers, ANSWERS))
    assert sorted((r.tid, r.pos, r.is_ad, r.matched) for r in merged.collect()) == sorted(want)


def test_detection_as_a_whole(spark, tmp_path):
    texts = ["Gespräch", "Nach einer kurzen Unterbrechung", "Jetzt buchen", "weiter", "weiter", "weiter", "Bleiben Sie dran", "Werbung", "Werbung", "Werbung", "Werbung", "Zurück"]
    rows = [(t, 147 + i, i, x, 460.0 + 3 * i, 462.5 + 3 * i, False) for t in (1, 2) for i, x in enumerate(texts)]
    # an id that comes again: the last one stays
    rows += [(1, 150, 12, "ein Nachtrag", 480.0, 481.0, False)]
    calls = tmp_path / "calls"
    calls.mkdir()

    def make():
        def call(messages):
            lines = messages[1]["content"]
            (calls / str(random.random())).write_text("")
            if "ID: 153" in lines and "ID: 152" in lines and "Nachtrag" not in lines and "Jetzt" not in lines:
                raise ValueError("overloaded")
            return {"segments": [{"id": 152 + i, "ad": True} for i in range(6)]}

        return call

    audio = spark.createDataFrame([(1, 600_000), (2, 600_000)], "tid bigint, len_ms bigint")
    p = Parameters(chunk_size=5)
    got = detection.clean(spark.createDataFrame(rows, SEGMENTS), audio, make, str(tmp_path / "out"), p, attempts=2, pause_s=0)
    # three chunks of either transcript; the second one fails twice
    assert {(r.tid, r.chunk_id, r.error) for r in got.detection.errors.collect()} == {(1, 1, "overloaded"), (2, 1, "overloaded")}
    segments = {(r.tid, r.id): (r.text, r.is_ad) for r in got.detection.segments.collect()}
    assert len(segments) == 24 and segments[1, 150] == ("ein Nachtrag", False)
    # the third chunk has 157 and 158, of which 157 is answered; rules add both transitions
    assert {k for k, (_, ad) in segments.items() if ad} == {(t, i) for t in (1, 2) for i in (148, 149, 153, 157)}
    reports = {r.tid: (r.n_segments, r.n_ads, r.errors) for r in got.detection.report.collect()}
    assert reports == {t: (12, 4, ["Chunk 1: overloaded"]) for t in (1, 2)}
    n_calls = len(list(calls.iterdir()))
    assert n_calls == 2 * (1 + 2 + 1)
    # what was observed while the tables were written
    stats = got.detection.chunks.agg(F.sum("n_total"), F.sum("n_updated"), F.sum("n_ads")).first()
    assert got.detection.figures == {"n_total": stats[0], "n_updated": stats[1], "n_answered_ads": stats[2], "n_segments": 24, "n_ads": 8}
    assert got.figures["n_intervals"] == got.cuts.count() and got.figures["cut_s"] == pytest.approx(got.cuts.selectExpr("sum(end_s - start_s)").first()[0])
    assert {(r.tid, r.n_total, r.n_updated) for r in got.detection.chunks.where("chunk_id = 2").collect()} == {(1, 3, 1), (2, 2, 1)}
    assert {r.tid: r.kept_ms for r in got.report.collect()} == {r.tid: r.len for r in got.kept.groupBy("tid").agg(F.sum(F.col("to_ms") - F.col("from_ms")).alias("len")).collect()}
    # errors are asked again, answers aren't
    detection.detect_ads(spark.createDataFrame(rows, SEGMENTS), make, str(tmp_path / "out"), p, attempts=2, pause_s=0)
    assert len(list(calls.iterdir())) == n_calls + 4 and spark.read.parquet(str(tmp_path / "out/prompts")).count() == 6


def test_feed_files(spark, tmp_path):
    """A large feed is read by many tasks, with the rows of feed_entries; what is malformed gives warnings."""
    folder = tmp_path / "feeds"
    folder.mkdir()
    rng = random.Random(6)

    def item(i):
        gap = rng.choice(("", "\n", " \n\t"))
        enclosure = f"<enclosure url='http://h/{i}?a=1&amp;b=2' type='{rng.choice(('audio/mpeg', 'video/mp4'))}'/>" * rng.randrange(3)
        return f"{gap}<item{gap}><title>t {i} &amp; ü</title>{gap}<itunes:duration>5</itunes:duration><description><![CDATA[<b>{'d' * rng.randrange(200)}</b>]]></description>{enclosure}{gap}</item>"

    head = "<?xml version='1.0' encoding='UTF-8'?>\n<rss version='2.0'>\n<channel><title>{}</title><link>http://l</link>\n<description/>"
    large = head.format("Large") + "".join(map(item, range(6000))) + "\n</channel></rss>\n"
    (folder / "large.xml").write_text(large)
    (folder / "empty.xml").write_text(head.format("Empty") + "</channel></rss>")
    (folder / "bad.xml").write_text(head.format("Bad") + "<item><title>a</title></item><item><title>b</item><item><title>c</title></item>")
    (folder / "page.xml").write_text("<html>not found</html>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = files.read_feed_files(spark, str(folder))
        assert spark.read.option("lineSep", "</item>").text(str(folder / "large.xml")).where("value like '%<item%'").select(F.spark_partition_id()).distinct().count() > 5
        short = F.element_at(F.split("feed", "/"), -1)
        got = {(r.feed, r.pos): (r.title, r.description, r.published, r.links) for r in found.entries.withColumn("feed", short).collect()}
        want = files.feed_entries(spark.createDataFrame([("large.xml", large)], "feed string, xml string"), "feed", "xml")
        assert {k: v for k, v in got.items() if k[0] == "large.xml"} == {(r.feed, r.pos): (r.title, r.description, r.published, r.links) for r in want.collect()}
        assert {k: v[0] for k, v in got.items() if k[0] != "large.xml"} == {("bad.xml", 0): "a", ("bad.xml", 2): "c"}
        assert {(r.feed, r.title, r.link, r.description or "") for r in found.channels.withColumn("feed", short).collect()} == {(f"{n.lower()}.xml", n, "http://l", "") for n in ("Large", "Empty", "Bad")}
        assert {tuple(r) for r in found.warnings.withColumn("feed", short).collect()} == {("bad.xml", 1, "the item is not well formed"), ("bad.xml", None, "the channel has no end"), ("page.xml", None, "no channel")}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
