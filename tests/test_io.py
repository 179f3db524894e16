import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from logwarden.functions import syslog
from logwarden.operators import cooldown, ensemble, reports
from logwarden.sources import readers, tail
from logwarden.sources.training import load_dataset
from logwarden.streaming import ingest, stateful


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.csv": "﻿timestamp,src_ip,port,ok,bytes\n2026-01-07T10:00:00Z,1.1.1.1,443,yes,1\n\"2026-01-07T10:00:01Z\",\"a\nb\",80,true,2.5\n,,,,\n",
        "b.tsv": "Time;x\n2026-01-07 10:00:00;5\n",
        "c.json": '[{"timestamp":"t1","u":{"n":"a"},"l":[1,2]},5,"x",{"timestamp":"t2"}]',
        "sub/d.json": '{"meta":{"ts":"t3"},"v":1}',
        "e.jsonl": '{"time":"x1","v":2}\n\nbad\n[1]\n{"time":"x2"}\n',
        "f.log": "<34>Jan  7 10:00:00 web nginx: hi\nnoise\n<165>1 2026-01-07T10:00:04.000Z fw app - - [m a=\"1\"] msg\n",
        "g.xml": '<Events><Event><System><EventID>1</EventID><TimeCreated SystemTime="T"/></System><EventData><Data Name="U">bob</Data><Data>x</Data></EventData></Event>\n'
                 '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID Qualifiers="7">2</EventID></System>'
                 '<UserData><A><B k="v">t</B></A></UserData></Event></Events>',
        "h.dat": '{"a":1}\n{"a":2}\n', "i.json": "{broken", "j.dat": "<13>Jan  7 10:00:03 db x: y\n", "k.bin": "zzz",
    }
    for name, text in files.items():
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_formats(spark, folder):
    got = {os.path.basename(r["path"]): r["format"] for r in readers.formats(spark, folder).collect()}
    assert got == {"a.csv": "CSV", "b.tsv": "CSV", "c.json": "JSON", "d.json": "JSON", "e.jsonl": "JSONL", "f.log": "Syslog", "g.xml": "EVTX",
                   "h.dat": "JSONL", "i.json": "JSON", "j.dat": "Syslog", "k.bin": None}


def test_csv(spark, folder):
    rows = readers.read_csv(spark, f"{folder}/a.csv").orderBy("timestamp").collect()
    assert [(r["src_ip"], r["port"], r["ok"], r["bytes"]) for r in rows] == [("1.1.1.1", 443, True, 1.0), ("a\nb", 80, True, 2.5)]
    assert readers.read_csv(spark, f"{folder}/b.tsv").first()["x"] == 5


def test_json(spark, folder):
    rows = {r["timestamp"]: r for r in readers.read_json(spark, f"{folder}/c.json").collect()}
    assert set(rows) == {"t1", "t2"} and rows["t1"]["u.n"] == "a" and rows["t1"]["l[1]"] == 2 and rows["t2"]["l"] is None
    assert readers.read_json(spark, f"{folder}/sub/d.json").first()["timestamp"] == "t3"
    assert readers.read_json(spark, f"{folder}/i.json").count() == 0
    lines = readers.read_jsonl(spark, f"{folder}/e.jsonl")
    assert sorted(r["timestamp"] for r in lines.collect()) == ["x1", "x2"]
    with pytest.raises(Exception, match="invalid JSON line"):
        readers.read_jsonl(spark, f"{folder}/e.jsonl", schema="time STRING", strict=True).collect()


def test_event_xml(spark, folder):
    one, two = readers.read_event_xml(spark, f"{folder}/g.xml").orderBy("EventID").collect()
    assert (one["timestamp"], one["EventData"]) == ("T", {"U": "bob", "Data0": "x"})
    assert (two["EventID.Qualifiers"], two["UserData"]) == ("7", {"A.B": "t", "A.B.@k": "v"})


def test_directory_and_registry(spark, folder):
    df = readers.read_logs(spark, folder)
    assert {r["source_format"]: r["count"] for r in df.groupBy("source_format").count().collect()} == {"CSV": 3, "EVTX": 2, "JSON": 7, "Syslog": 3}
    assert readers.read_logs(spark, f"{folder}/j.dat", fmt="syslog").count() == 1
    with pytest.raises(ValueError):
        readers.read_logs(spark, folder, fmt="nope")
    readers.register(".bin", lambda s, p: s.read.text(p).withColumn("source_format", F.lit("Custom")), "Custom")
    try:
        assert readers.read_logs(spark, f"{folder}/k.bin").first()["value"] == "zzz"
    finally:
        readers.EXTENSIONS.pop(".bin"), readers.READERS.pop("Custom")
    e = readers.parse_errors(spark, f"{folder}/f.log", "Syslog").first()
    assert (e["parsed"], e["rejected"]) == (2, 1)


def test_training_load(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.csv").write_text(" Flow Duration,Src IP, Label\n1,a,BENIGN\n2,b,DoS Hulk\n3,c,DoS Hulk\n")
    (tmp_path / "y.csv").write_text(" Flow Duration,Src IP, Label\n4,a,Bot\n")
    df = load_dataset(spark, str(tmp_path))
    assert sorted((r["flow_duration"], r["label"]) for r in df.collect()) == [(1, "Benign"), (2, "DDoS"), (3, "DDoS"), (4, "Malware")]
    assert "src_ip" not in df.columns
    assert load_dataset(spark, str(tmp_path), max_rows_per_file=1).count() == 2


def test_files_with_different_headers_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,src_ip,dst_ip\n2024-01-01T00:00:00Z,1.1.1.1,2.2.2.2\n")
    (tmp_path / "b.csv").write_text("user,timestamp,action\nbob,2024-01-02T00:00:00Z,login\nann,2024-01-03T00:00:00Z\n")
    (tmp_path / "c.csv").write_bytes("user;action\nJos\u00e9;out\n".encode("latin-1"))
    (tmp_path / "d.csv").write_text("")
    rows = {r["timestamp"] or r["user"]: r for r in readers.read_csv(spark, str(tmp_path)).collect()}
    assert rows["2024-01-01T00:00:00Z"]["src_ip"] == "1.1.1.1" and rows["2024-01-01T00:00:00Z"]["user"] is None
    assert (rows["2024-01-02T00:00:00Z"]["user"], rows["2024-01-02T00:00:00Z"]["action"]) == ("bob", "login")
    assert rows["2024-01-03T00:00:00Z"]["action"] is None and rows["Jos\u00e9"]["action"] == "out" and len(rows) == 4
    empty = readers.read_csv(spark, f"{tmp_path}/d.csv")
    assert empty.count() == 0 and {"timestamp", "source_file", "source_format"} <= set(empty.columns)


def test_training_files_with_swapped_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Flow Duration, Label\n1,BENIGN\n2,Bot\n")
    (tmp_path / "y.csv").write_text(" Label,Flow Duration\nDDoS,3\nDDoS\n")
    got = sorted((r["flow_duration"] or 0, r["label"]) for r in load_dataset(spark, str(tmp_path)).collect())
    assert got == [(0, "DDoS"), (1, "Benign"), (2, "Malware"), (3, "DDoS")]


def test_json_names_and_mixed_types(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"VOID_reason":"x","OBJECT<":{"a b":[{"c":1.5}]},"n":null,"m":1,"t`q":true}\n{"m":"text","VOID_reason":"y"}\n{"m":{"k":2}}\n')
    rows = readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), flatten=False)
    assert sorted(r["VOID_reason"] for r in rows.where("VOID_reason is not null").collect()) == ["x", "y"]
    assert sorted(r["m"] for r in rows.groupBy("m").count().collect()) == ["1", "text", '{"k":2}']
    assert dict(rows.dtypes)["n"] == "string" and rows.where("`t\u0060\u0060q`").first()["OBJECT<"]["a b"][0]["c"] == 1.5


def test_suppression_keeps_rows_with_a_null_bypass(spark):
    df = spark.createDataFrame([(1, "a", 0, None), (2, "b", 0, True), (3, "c", 0, False)], "id long, fp string, s long, pass boolean").withColumn("ts", F.timestamp_seconds("s"))
    assert {r["id"] for r in cooldown.suppress(df, "fp", "ts", "id", 60, F.col("pass")).collect()} == {1, 2, 3}


def test_a_corrupt_file_is_an_error(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    part = next((tmp_path / "t").glob("*.parquet"))
    (tmp_path / "t" / "broken.parquet").write_bytes(part.read_bytes()[:500])
    with pytest.raises(Exception):
        spark.read.parquet(str(tmp_path / "t")).agg(F.sum("id")).collect()


def test_late_rows_do_not_split_a_session(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for n, times in enumerate([[0, 1700], [100], [2000], [9000]]):
        (src / f"{n}.json").write_text("".join(f'{{"id":"r{t}","e":"x","t":{t}}}\n' for t in times))
        os.utime(src / f"{n}.json", (time.time() - 100 + n, time.time() - 100 + n))
    stream = spark.readStream.schema("id STRING, e STRING, t LONG").option("maxFilesPerTrigger", 1).json(str(src)).withColumn("ts", F.timestamp_seconds("t"))
    with stateful.rocksdb_state(spark):
        ingest.drain(stateful.sessions_stream(stream, "e", "ts", "id"), out, str(tmp_path / "cp"))
    assert {r["id"]: r["session_id"] for r in spark.read.parquet(out).collect()} == {"r0": 0, "r1700": 0, "r100": 0, "r2000": 0, "r9000": 1}


def test_escapes_in_structured_data(spark):
    line = r'<165>1 2026-01-07T10:00:04Z h app - - [m@1 a="x\"y\\z\] w" b="2"][n c=""] the message'
    r = syslog.parse_lines(spark.createDataFrame([(line,)], "value string"), "value", 2026).first()["parsed"]
    assert r["sd"] == {"m@1.a": 'x"y\\z] w', "m@1.b": "2", "n.c": ""} and r["message"] == "the message"


def lines_between(reader, start, end):
    return [t for part in reader.partitions(start, end) for batch in reader.read(part) for t in batch.column(0).to_pylist()]


def test_growing_files_ranges(tmp_path):
    f = tmp_path / "a.log"
    f.write_bytes(b"one\n\ntwo two\r\nthree\nhalf")
    for size in (1, 2, 3, 5, 100):
        reader = tail._TailReader({"path": str(tmp_path), "glob": "*.log", "rangebytes": str(size)})
        start, end = reader.initialOffset(), reader.latestOffset()
        assert lines_between(reader, start, end) == ["one", "two two", "three"], size
        with open(f, "ab") as h:
            h.write(b" done\n")
        later = reader.latestOffset()
        assert lines_between(reader, end, later) == ["half done"]
        f.write_bytes(b"new\n")  # rotated
        assert lines_between(reader, later, reader.latestOffset()) == ["new"]
        f.write_bytes(b"one\n\ntwo two\r\nthree\nhalf")


def test_growing_files_equal_plain_lines_for_any_cuts(tmp_path):
    rng = random.Random(5)
    for case in range(30):
        folder = tmp_path / str(case)
        folder.mkdir()
        lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + rng.choice(["", "\r", "é"]) for _ in range(rng.randint(1, 60))]
        (folder / "a.log").write_bytes("".join(x + "\n" for x in lines).encode())
        reader = tail._TailReader({"path": str(folder), "rangebytes": str(rng.randint(1, 400))})
        got = lines_between(reader, reader.initialOffset(), reader.latestOffset())
        assert got == [x.rstrip("\r") for x in lines if x.strip()]


def test_growing_files_are_read_once(tmp_path, monkeypatch):
    line = b"x" * 99 + b"\n"
    (tmp_path / "a.log").write_bytes(line * 200_000)
    read = [0]
    plain = tail._files

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *args):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            got = self.f.read(n)
            read[0] += len(got)
            return got

    class Files:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return getattr(self.files, name)

        def open_input_file(self, path):
            return Counted(self.files.open_input_file(path))

    monkeypatch.setattr(tail, "_files", lambda path: (lambda pair: (Files(pair[0]), pair[1]))(plain(path)))
    reader = tail._TailReader({"path": str(tmp_path), "rangebytes": str(3_000_000)})
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = sum(b.num_rows for part in reader.partitions(start, end) for b in reader.read(part))
    assert rows == 200_000 and read[0] <= 1.1 * len(line) * rows
    read[0] = 0
    assert reader.latestOffset() == end and read[0] == 0  # nothing changed, nothing is opened


def test_growing_files_bound_per_trigger_and_restart(tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    for name, n in (("a", 500), ("b", 50), ("c", 3)):
        (logs / f"{name}.log").write_bytes(b"".join(b"%s %05d\n" % (name.encode(), i) for i in range(n)))
    (logs / "d.log").write_bytes(b"y" * 2000 + b"\nend\n")
    options = {"path": str(logs), "maxbytespertrigger": "400", "progresslocation": str(tmp_path / "progress")}
    reader = tail._TailReader(options)
    offset, got, batches = reader.initialOffset(), [], 0
    while True:
        end = reader.latestOffset()
        if end == offset:
            break
        new = lines_between(reader, offset, end)
        assert sum(len(x) + 1 for x in new if x[0] != "y") <= 400
        got += new
        reader.commit(end)
        offset, batches = end, batches + 1
        if batches % 7 == 0:  # a new driver goes on from what is noted
            reader = tail._TailReader(options)
    want = [f"{name} {i:05d}" for name, n in (("a", 500), ("b", 50), ("c", 3)) for i in range(n)] + ["y" * 2000, "end"]
    assert sorted(got) == sorted(want) and batches > 10


def test_growing_files_follow_a_rotated_file_under_its_new_name(tmp_path):
    reader = tail._TailReader({"path": str(tmp_path), "glob": "*.log*"})
    (tmp_path / "a.log").write_bytes(b"one\ntwo\n")
    start = reader.initialOffset()
    first = reader.latestOffset()
    assert lines_between(reader, start, first) == ["one", "two"]
    with open(tmp_path / "a.log", "ab") as f:
        f.write(b"three\n")
    os.rename(tmp_path / "a.log", tmp_path / "a.log.1")
    (tmp_path / "a.log").write_bytes(b"four is longer than all before\n")
    assert sorted(lines_between(reader, first, reader.latestOffset())) == ["four is longer than all before", "three"]


def test_growing_stream(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    logs.mkdir()
    (logs / "a.log").write_text('{"src_ip":"1.1.1.1","action":"x"}\nplain line\n')
    stream = ingest.records(ingest.growing_lines(spark, str(logs), "*.log"), "timestamp STRING, src_ip STRING, action STRING, raw_log STRING")
    q = stream.drop("ingest_time").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        with open(logs / "a.log", "a") as f:
            f.write("more\n")
        q.processAllAvailable()
        assert ingest.ingestion_stats(q)["rows"] == 3
    finally:
        q.stop()
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r["action"] for r in rows) == ["log_entry", "log_entry", "x"]
    assert {r["raw_log"] for r in rows} == {None, "plain line", "more"}


def test_directory_stream_to_alerts(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    logs.mkdir()
    for i in range(3):
        (logs / f"{i}.log").write_text(f'{{"record_id":{i},"anomaly_score":0.9,"classification":"Malware","class_confidence":0.9}}\n')
    stream = ingest.records(ingest.directory_lines(spark, str(logs), "*.log", max_files=1),
                            "record_id LONG, anomaly_score DOUBLE, classification STRING, class_confidence DOUBLE")
    q = ingest.micro_batches(stream, ingest.analysis_sink(ensemble.score, out, ts="ingest_time"), str(tmp_path / "cp"), available_now=True)
    assert q.awaitTermination(300)
    assert spark.read.parquet(f"{out}/alerts").count() == 3
    assert spark.read.parquet(f"{out}/stats").where("total_records = 1").count() == 3
    reports.analysis_report(spark.read.parquet(f"{out}/alerts"), spark.read.parquet(f"{out}/history"), f"{out}/report")
    assert spark.read.json(f"{out}/report/stats").first()["alerts_generated"] == 3


def test_cooldown_stream_keeps_state_between_batches(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    for n, seconds in enumerate([[0, 30], [59, 40], [10]]):
        rows = "".join(f'{{"id":{n * 10 + i},"fp":"x","ts":"2026-01-01T00:0{n}:{s:02d}"}}\n' for i, s in enumerate(seconds))
        (src / f"{n}.json").write_text(rows)
        os.utime(src / f"{n}.json", (time.time() - 100 + n, time.time() - 100 + n))
    stream = spark.readStream.schema("id LONG, fp STRING, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 1).json(str(src))
    with stateful.rocksdb_state(spark):
        ingest.drain(stateful.cooldown_stream(stream, "fp", "ts", "id", 60), out, str(tmp_path / "cp"))
    # 0 s kept, 30 s not; 100 s kept, 119 s not; 130 s not.
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [0, 11]


def test_directory_scan_counts_every_file(spark, tmp_path):
    logs = tmp_path / "in"
    (logs / "deep").mkdir(parents=True)
    (logs / "a.csv").write_text("src_ip,action\n1.1.1.1,x\n2.2.2.2,y\n")
    (logs / "deep/b.jsonl").write_text('{"src_ip":"3.3.3.3"}\nnot json\n')
    (logs / "broken.json").write_text('{"src_ip": ')
    (logs / "notes.bin").write_text("nothing known")
    (logs / "none.log").write_text("")
    scan = readers.scan_logs(spark, str(logs), str(tmp_path / "out"))
    got = {r.path.rsplit("/", 1)[1]: (r.format, r.rows, r.status) for r in scan.files.collect()}
    assert got == {"a.csv": ("CSV", 2, "read"), "b.jsonl": ("JSONL", 1, "read"), "broken.json": ("JSON", 0, "rejected"),
                   "notes.bin": (None, 0, "foreign")}  # Spark lists no file without bytes
    assert scan.rows.count() == 3
    foreign = tmp_path / "foreign"
    foreign.mkdir()
    (foreign / "x.bin").write_text("nothing known")
    alone = readers.scan_logs(spark, str(foreign), str(tmp_path / "out2"))
    assert [r.status for r in alone.files.collect()] == ["foreign"] and alone.rows.count() == 0


def test_streams_keep_one_state_for_a_group_of_keys(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for n in range(3):
        rows = "".join(json.dumps({"id": n * 100 + k, "fp": None if k == 39 else f"k{k}", "ts": f"2026-01-01T00:0{n}:{k:02d}"}) + "\n" for k in range(40))
        (src / f"{n}.json").write_text(rows)
        os.utime(src / f"{n}.json", (time.time() - 100 + n, time.time() - 100 + n))
    stream = spark.readStream.schema("id LONG, fp STRING, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 1).json(str(src))

    def drained(df, label):
        out = str(tmp_path / label)
        q = ingest.append_history(df, out, f"{out}-cp", available_now=True)
        assert q.awaitTermination(300)
        assert 0 < max(s.numRowsTotal for p in q.recentProgress for s in p.stateOperators) <= 4
        return spark.read.parquet(out).collect()

    with stateful.rocksdb_state(spark):
        # A pause of 61 s keeps the first and the third minute of every key, null among them.
        kept = drained(stateful.cooldown_stream(stream, "fp", "ts", "id", 61, 3600, groups=4), "cooldown")
        assert sorted(r.id for r in kept) == [*range(40), *range(200, 240)]
        found = drained(stateful.sessions_stream(stream, "fp", "ts", "id", 60, groups=4), "sessions")
    assert {r.id: (r.session_id, r.events_in_session, r.session_duration_seconds) for r in found} == {
        n * 100 + k: (0, n + 1, 60.0 * n) for n in range(3) for k in range(39)}
