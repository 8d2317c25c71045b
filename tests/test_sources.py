import json
import zipfile

import pytest
from pyspark.sql import functions as F

from policyloom.runtime import ship
from policyloom.sources import readers, writers
from policyloom.streaming import ledgers


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_strict_jsonl(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n')
    assert readers.read_jsonl(spark, str(good), "a long, b string", "a").count() == 2
    for line in ('{"a": 1, "a": 2}', '{"a": 1, "c": 2}', '{"a": NaN}'):
        bad.write_text(line + "\n")
        with pytest.raises(ValueError):
            readers.read_jsonl(spark, str(bad), "a long, b string")
    bad.write_text('{"a": 1}\n{"a": 1}\n')
    with pytest.raises(ValueError):
        readers.read_jsonl(spark, str(bad), "a long, b string", "a")
    bad.write_text('{"b":1,"a":2}\n{"a":2,"b":1}\n')
    assert sorted(r.canonical for r in readers.canonical_lines(spark, str(bad)).collect()) == [False, True]


def test_labelled_lines_count_blank_ones(spark, tmp_path):
    path = tmp_path / "sms.txt"
    path.write_bytes("ham\tHello  there\n\nspam\tWin at https://x.y/z\n".encode())
    assert [(r.source_id, r.text, r.source_label) for r in readers.labelled_lines(spark, str(path)).orderBy("ordinal").collect()] == [("sms-000001", "Hello there", "ham"), ("sms-000003", "Win at [URL]", "spam")]
    path.write_bytes("ham\tcafé\n".encode("latin-1"))
    assert readers.labelled_lines(spark, str(path)).first().text == "café"


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.csv", "x")
        z.writestr("a.csv", "y")
    assert [r.member for r in readers.archive_members(spark, str(tmp_path / "a.zip")).collect()] == ["a.csv", "b.csv"]
    assert not readers.safe_member("../x") and not readers.safe_member("/x") and readers.safe_member("d/x")


def test_adapters(spark):
    comments = spark.createDataFrame([("s", 1, "c1", "hi", "1"), ("s", 2, " ", "yo", "0")], "stem string, row int, COMMENT_ID string, CONTENT string, CLASS string")
    assert [(r.source_id, r.source_label) for r in readers.comment_rows(comments).orderBy("ordinal").collect()] == [("s:000001:c1", "spam"), ("s:000002:row-2", "ham")]
    guard = spark.createDataFrame([(1, "a", "p", "r", "Safe"), (2, "b", "REDACTED", None, "x"), (3, "c", "q", None, "Unsafe")], "ordinal int, id string, prompt string, response string, label string")
    assert [(r.text, r.source_label) for r in readers.guard_rows(guard).orderBy("ordinal").collect()] == [('{"query":"p","response":"r"}', "safe"), ("q", "unsafe")]
    scored = spark.createDataFrame([(1, None, "t", 0.5), (2, "7", "u", 0.4)], "ordinal int, id string, text string, toxicity double")
    assert [(r.source_id, r.source_label) for r in readers.toxicity_rows(scored).orderBy("ordinal").collect()] == [("civil-row-000000001", "toxic"), ("7", "non_toxic")]
    with pytest.raises(Exception, match="toxicity"):
        readers.toxicity_rows(scored.withColumn("toxicity", F.lit(2.0))).collect()
    queries = spark.createDataFrame([(1, "us", "train", "Red  Shoe"), (2, "us", "train", "red shoe"), (3, "es", "train", "x"), (4, "us", "test", "y")], "ordinal int, product_locale string, split string, query string")
    assert [(r.ordinal, r.text) for r in readers.query_rows(queries).collect()] == [(1, "Red Shoe")]


def test_union_keeps_the_first_text(spark):
    row = lambda o, s, i, t: spark.createDataFrame([(o, s, i, t, None, t)], readers.SEED)
    got = readers.union_seeds([row(1, "a", "1", "x"), row(1, "b", "1", "x"), row(2, "b", "2", "y")]).collect()
    assert sorted((r.source, r.source_id) for r in got) == [("a", "1"), ("b", "2")]
    with pytest.raises(ValueError):
        readers.union_seeds([row(1, "a", "1", "x"), row(2, "a", "1", "z")])


def test_pages(spark):
    html = "<p>outside the article, long enough</p><article><p>first   paragraph of the article</p><script>p</script><li>short</li><p>first paragraph of the article</p></article>"
    pages = spark.createDataFrame([(1, html), (2, "<p>only a plain paragraph here</p>"), (3, None)], "page_id long, html string")
    assert [(r.page_id, r.text) for r in readers.page_cases(pages, "page_id", "html").orderBy("page_id").collect()] == [(1, "first paragraph of the article"), (2, "only a plain paragraph here")]


def test_caps_and_order(spark):
    ids = spark.createDataFrame([("10",), ("9",), ("a",)], "i string")
    assert [r.i for r in ids.orderBy(*readers.item_order("i")).collect()] == ["9", "10", "a"]
    head, more = readers.capped(ids, ["i"], 2)
    assert more and head.count() == 2


def test_governed_sources(spark):
    catalog = spark.createDataFrame([("a", "CC0-1.0", True), ("b", "Proprietary", True), ("c", "Apache-2.0", False)], "source string, license string, enabled boolean")
    assert [r.source for r in readers.governed(catalog).collect()] == ["a"]
    with pytest.raises(ValueError):
        readers.governed(catalog, ["c"])


def test_bundles_are_verified(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    writers.write_bundle(spark, str(tmp_path / "b"), {"rows": rows}, {"seed": 1})
    assert writers.read_bundle(spark, str(tmp_path / "b"))["rows"].count() == 2
    rows.limit(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "rows"))
    with pytest.raises(ValueError):
        writers.read_bundle(spark, str(tmp_path / "b"))


def test_jsonl_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i}") for i in range(50)], "z int, a string")
    writers.write_jsonl(rows, str(tmp_path / "j"))
    first = json.loads(next(p for p in sorted((tmp_path / "j").glob("part-*")) if p.stat().st_size).read_text().splitlines()[0])
    assert list(first) == ["a", "z"]
    counts = writers.write_splits(rows, str(tmp_path / "s"), "a")
    assert sum(r["rows"] for r in counts.collect()) == 50


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", "a" if m % 2 else "b", float(m)) for m in range(40)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    for name, frame, mode in (("counts", ledgers.windowed_counts(stream, width="10 minutes"), "complete"), ("usage", ledgers.running_usage(stream, "event_type", "value", 395.0), "update")):
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 40
    assert {r.event_type: (r.total, r.within) for r in spark.table("usage").collect()} == {"a": (400.0, False), "b": (380.0, True)}


def test_zip_members_are_read_in_parallel(spark, tmp_path):
    import zipfile

    from policyloom.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/Youtube01.csv", "COMMENT_ID,CONTENT,CLASS\r\nc1,\"two\nlines, and a comma\",1\r\n,second,0\r\n")
        z.writestr("youtube02.csv", b"\xef\xbb\xbfCOMMENT_ID,CONTENT,CLASS\nc3,third\xc3\xa9,1\n")
        z.writestr("notes.txt", "n" * 1000)
        z.writestr("../out.csv", "a,b\n1,2\n")
        z.writestr("empty.csv", "")
        z.writestr("latin.csv", b"a\n\xe9\n")
        z.writestr("folder/", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w", zipfile.ZIP_STORED) as z:
        z.writestr("good.bin", b"\x00\x01")
        z.writestr("bad.bin", b"payload that will be damaged")
    data = (tmp_path / "b.zip").read_bytes().replace(b"payload that will", b"payload thot will")
    (tmp_path / "b.zip").write_bytes(data)
    (tmp_path / "c.zip").write_bytes(b"no archive")
    archives.register(spark)
    read = lambda **o: spark.read.format("zip_members").options(path=str(tmp_path), **o).load()
    whole = read(member_bytes=900)
    assert whole.rdd.getNumPartitions() == 9
    got = {(r.archive, r.member): (r.code, bytes(r.content) if r.content is not None else None) for r in whole.collect()}
    assert got["b.zip", "good.bin"] == (None, b"\x00\x01") and got["b.zip", "bad.bin"] == ("damaged", None) and got["c.zip", None] == ("not_an_archive", None)
    assert got["a.zip", "notes.txt"] == ("too_large", None) and got["a.zip", "../out.csv"] == ("unsafe_name", None) and got["a.zip", "empty.csv"] == (None, b"")
    rows = read(rows="csv").where("member like '%.csv'").collect()
    assert {(r.member, r.code) for r in rows if r.code} == {("../out.csv", "unsafe_name"), ("empty.csv", "no_header"), ("latin.csv", "not_text")}
    assert [(r.row, r.fields["CONTENT"]) for r in rows if r.member == "x/Youtube01.csv"] == [(1, "two\nlines, and a comma"), (2, "second")]
    with pytest.raises(Exception, match="more than 500 bytes"):
        read(total_bytes=500).collect()
    seeds = readers.comment_rows(archives.comment_archive(spark, str(tmp_path))).collect()
    assert sorted((r.source_id, r.text, r.source_label) for r in seeds) == [("Youtube01:000001:c1", "two lines, and a comma", "spam"), ("Youtube01:000002:row-2", "second", "ham"), ("youtube02:000001:c3", "thirdé", "spam")]
