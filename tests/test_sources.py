import tarfile
import zipfile

import pytest

from missive.sources.archives import UnsafeArchive, unpack
from missive.sources.mail import html_text, parse_message, read_mbox, read_messages
from missive.sources.sinks import sheet_cells, write_once
from missive.sources.text_files import bad_json_lines, read_judgments, read_labelled_lines, read_token_columns
from missive.streaming.ingest import keep_archive

RAW = b"Message-ID: <A1@x>\r\nDate: Wed, 7 Jun 2017 16:17:23 +0900\r\nFrom: =?utf-8?q?J=C3=B6rg?= <j@x.example>\r\nTo: a@b.example, A <a@b.example>\r\nReferences: <p@x>\r\n <q@x>\r\nSubject: plan\r\nContent-Type: multipart/mixed; boundary=z\r\n\r\n--z\r\nContent-Type: text/plain\r\n\r\nHello\r\n--z\r\nContent-Type: application/pdf\r\nContent-Disposition: attachment; filename=a.pdf\r\n\r\nxx\r\n--z--\r\n"


def test_message():
    m = parse_message(RAW, "p")
    assert (m["message_id"], m["sent_at"], m["subject"], m["body"].strip(), m["attachment_names"], m["reference_ids"]) == ("a1@x", "2017-06-07T07:17:23+00:00", "plan", "Hello", ["a.pdf"], ["p@x", "q@x"])
    assert "Jörg" in m["sender"] or "j@x.example" in m["sender"]
    assert parse_message(b"", "p")["sent_at"] is None


def test_html():
    assert html_text("<head><title>t</title></head><p>One&amp;two</p><script>x()</script><div>three<br>four</div>") == "One&two\n\nthree\nfour"


def test_mail_files(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "1.").write_bytes(RAW)
    assert read_messages(spark, str(tmp_path / "md")).collect()[0]["message_id"] == "a1@x"
    (tmp_path / "m.mbox").write_bytes(b"From x Mon\nMessage-ID: <1@x>\n\none\n>From here\n\nFrom y Tue\nMessage-ID: <2@x>\n\ntwo\n")
    got = {r["message_id"]: r["body"].strip() for r in read_mbox(spark, str(tmp_path / "m.mbox")).collect()}
    assert got == {"1@x": "one\nFrom here", "2@x": "two"}


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a"\n')
    assert sorted(r["value"] for r in bad_json_lines(spark, str(tmp_path / "a.jsonl")).collect()) == ["[1]", '{"a"']
    (tmp_path / "l.tsv").write_text("Yes\tdo it\nNo\tno\n")
    assert [tuple(r)[1:] for r in read_labelled_lines(spark, str(tmp_path / "l.tsv")).collect()] == [("Yes", "do it"), ("No", "no")]
    (tmp_path / "j.txt").write_text("f1\tY\t3\t4\t10\t2\nf2\tN\n")
    assert [(r["file"], [tuple(s) for s in r["spans"]]) for r in read_judgments(spark, str(tmp_path / "j.txt")).collect()] == [("f1", [(3, 7), (10, 12)]), ("f2", [])]
    (tmp_path / "c.conll").write_text("#begin document (d1);\na x\nb y\n\nc z\n#end document\n")
    assert [tuple(r)[:3] for r in read_token_columns(spark, str(tmp_path / "c.conll")).collect()] == [("d1", 0, 0), ("d1", 0, 1), ("d1", 1, 0)]


def test_archives(tmp_path):
    good, bad = tmp_path / "g.zip", tmp_path / "b.tar"
    with zipfile.ZipFile(good, "w") as z:
        z.writestr("d/a.txt", "x")
    assert len(unpack(str(good), str(tmp_path / "o"))) == 1
    with pytest.raises(UnsafeArchive):
        unpack(str(good), str(tmp_path / "o2"), max_bytes=0)
    (tmp_path / "f").write_text("x")
    with tarfile.open(bad, "w") as t:
        t.add(tmp_path / "f", arcname="../f")
    with pytest.raises(UnsafeArchive):
        unpack(str(bad), str(tmp_path / "o3"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"], "x" * 40_000)], "a int, b array<string>, c string")
    assert write_once(df, str(tmp_path / "t")) and not write_once(df, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="other rows"):
        write_once(df.unionAll(df), str(tmp_path / "t"))
    r = sheet_cells(df).collect()[0]
    assert r["b"] == '["a"]' and len(r["c"]) == 32_767


def test_stream(spark, tmp_path):
    schema = "k string, at int, how string"
    spark.createDataFrame([("a", 1, "HUMAN")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: keep_archive(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), "k", "at", {"how": "NO"}, str(tmp_path / "ck")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "NO"), ("b", 1, "NO")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "1")).select("k", "at", "how").collect())) == [("a", 2, "HUMAN"), ("b", 1, "NO")]


def test_mbox_keeps_bytes_and_splits_anywhere(spark, tmp_path):
    bodies = [b"caf\xe9 and \xff", b"\nFrommage\n>From me\n>>From you\n", b"x" * 300, b""]
    raw = b"".join(b"From a@x Mon Jan 1 00:00:00 2001\nMessage-ID: <%d@x>\nContent-Type: text/plain; charset=iso-8859-1\n\n%s\n" % (k, b) for k, b in enumerate(bodies))
    (tmp_path / "a.mbox").write_bytes(raw)
    whole = {r["message_id"]: r["body"] for r in read_mbox(spark, str(tmp_path)).collect()}
    assert len(whole) == 4 and any("café" in b for b in whole.values()) and any("\nFrom me\n>From you" in b for b in whole.values())
    for block in (1, 7, 64, 101):
        assert {r["message_id"]: r["body"] for r in read_mbox(spark, str(tmp_path), block).collect()} == whole
    assert read_mbox(spark, str(tmp_path), 64, 2).count() == 2
