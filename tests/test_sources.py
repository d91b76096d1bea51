import hashlib
import json
import sqlite3
import zipfile

import pytest
from tickloom.sources import captures, recording
from tickloom.sources.recording import RecordingError, read_recording

HEAD = ",".join(recording.TICK_COLUMNS)


def row(n, **k):
    r = dict.fromkeys(recording.TICK_COLUMNS, "") | {"sequence": n, "captured_at_utc": "2026-01-05T14:30:00Z", "elapsed_ns": n * 10, "symbol": "AB", "con_id": 7, "bid": 1.5, "market_data_type": 1} | k
    return ",".join(str(r[c]) for c in recording.TICK_COLUMNS)


def write_zip(path, lines, extra=(), **manifest):
    csv = "\n".join([HEAD, *lines]) + "\n"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("manifest.json", json.dumps({"row_count": len(lines)} | manifest))
        z.writestr("ticks.csv", csv)
        z.writestr("checksums.json", json.dumps({"files": {"ticks.csv": hashlib.sha256(csv.encode()).hexdigest()}}))
        for name, body in extra:
            z.writestr(name, body)


def write_db(path, rows):
    with sqlite3.connect(path) as c:
        c.execute("create table ticks (sequence, captured_at_utc, elapsed_ns, symbol, con_id, bid, market_data_type)")
        c.executemany("insert into ticks values (?,?,?,?,?,?,?)", rows)


def test_both_containers_as_a_spark_format(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write_zip(tmp_path / "a.rec", [row(1), row(2, bid="x"), row(3, market_data_type=9), row(4, elapsed_ns=-1)])
    write_db(tmp_path / "sub" / "b.rec", [(2, "t", 5, "CD", 8, None, 2), (1, "t", 4, "CD", 8, 2.5, 1)])
    recording.register(spark)
    df = spark.read.format("tick_recording").load(str(tmp_path))
    rows = sorted(((r.recording, r.sequence, r.bid, r.error) for r in df.collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in rows if r[3] is None] == [("a.rec", 1, 1.5), ("b.rec", 1, 2.5), ("b.rec", 2, None)]
    assert len([r for r in rows if r[3]]) == 3
    assert df.where("symbol = 'CD'").count() == 2


def write_full_db(path):
    with sqlite3.connect(path) as c:
        c.execute("create table metadata (key, value_json)")
        m = {"format_version": 3, "contract": {"symbol": "cd", "con_id": 8, "min_tick": 0.01}, "row_count": 3, "rth_period_count": 2, "status": "Complete"}
        c.executemany("insert into metadata values (?,?)", [(k, json.dumps(v)) for k, v in m.items()])
        c.execute("create table ticks (sequence, captured_at_utc, elapsed_ns, symbol, con_id, bid, bid_size, market_data_type, rth_period_id)")
        c.executemany("insert into ticks values (?,?,?,?,?,?,?,?,?)", [(1, "2026-01-05T14:30:00Z", 1, "CD", 8, 1.0, 5, 1, 1), (2, "2026-01-05T14:31:00Z", 2, "CD", 9, 1.0, 5, 1, 1), (3, "2026-01-05T14:32:00Z", 3, "CD", 8, 1.0, -5, 1, 2)])
        c.execute("create table events (sequence, created_at_utc, event_type, payload_json)")
        c.executemany("insert into events values (?,?,?,?)", [(1, "t1", "feed", '{"payload": {"error_code": 1100}}'), (2, "t2", "x", "[1]")])
        c.execute("create table rth_periods (period_id, schedule_open_utc, schedule_close_utc, observed_start_utc, observed_end_utc, status)")
        c.executemany("insert into rth_periods values (?,?,?,?,?,?)", [(1, "2026-01-05T14:30:00Z", "2026-01-05T21:00:00Z", "2026-01-05T14:30:01Z", None, "active"), (2, "b", "a", "2026-01-05T15:00:00Z", "", "closed")])


def test_metadata_events_and_periods(spark, tmp_path):
    write_full_db(tmp_path / "d.rec")
    write_zip(tmp_path / "z.rec", [row(1)], extra=[("events.jsonl", '{"event_type": "gateway_connected", "created_at_utc": "t"}\n\n{"error_code": "2104"}\nbroken\n')], format_version=2, contract={"symbol": "AB", "conId": 7, "minTick": 0})
    recording.register(spark)
    load = lambda name: spark.read.format(name).load(str(tmp_path))
    info = {r.recording: r for r in load("recording_info").collect()}
    assert (info["d.rec"].container, info["d.rec"].symbol, info["d.rec"].con_id, info["d.rec"].row_count, info["d.rec"].periods, info["d.rec"].status, info["d.rec"].problems) == ("sqlite", "CD", 8, 3, 2, "complete", [])
    assert info["z.rec"].problems == ["min_tick"]
    events = sorted((r.recording, r.sequence, r.event_type, r.error_code, r.error is None) for r in load("recording_events").collect())
    assert events == [("d.rec", 1, "feed", 1100, True), ("d.rec", 2, "x", None, False), ("z.rec", 1, "gateway_connected", None, True), ("z.rec", 3, None, 2104, True), ("z.rec", 4, None, None, False)]
    periods = [(r.period_id, r.observed_end_utc, r.error) for r in load("recording_periods").orderBy("period_id").collect()]
    assert periods == [(1, "2026-01-05T14:31:00Z", None), (2, None, "schedule")]
    ticks = {(r.recording, r.sequence, r.error) for r in load("tick_recording").collect()}
    assert ticks == {("z.rec", 1, None), ("d.rec", 1, None), ("d.rec", None, "another contract than the manifest's"), ("d.rec", None, "a negative size")}
    (tmp_path / "bad.rec").write_bytes(b"PK no archive")
    with pytest.raises(Exception, match="bad.rec"):
        load("tick_recording").collect()


def test_containers_that_break_a_rule(tmp_path):
    p = tmp_path / "x.rec"
    for build, why in [
        (lambda: write_zip(p, [row(1)], row_count=2), "row_count"),
        (lambda: write_zip(p, [row(1)], [("../evil", "x")]), "outside"),
        (lambda: write_zip(p, [row(1)], [(f"m{i}", "") for i in range(70)]), "too many"),
    ]:
        build()
        with pytest.raises(RecordingError, match=why):
            list(read_recording(str(p)))
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("manifest.json", "{}")
        z.writestr("ticks.csv", HEAD + "\n")
        z.writestr("checksums.json", json.dumps({"files": {"ticks.csv": "00"}}))
    with pytest.raises(RecordingError, match="checksum"):
        list(read_recording(str(p)))


def test_tolerant_database_tables(spark, tmp_path):
    for name, cols, rows in [("a.db", "id, v", [("1", "x"), ("2", None)]), ("b.db", "id, w", [("3", 5)])]:
        with sqlite3.connect(tmp_path / name) as c:
            c.execute(f"create table cycles ({cols})")
            c.executemany("insert into cycles values (?, ?)", rows)
    recording.register(spark)
    df = spark.read.format("sqlite_table").option("dbtable", "cycles").load(str(tmp_path))
    assert sorted((r.id, r.v, r.w, r.source_file) for r in df.collect()) == [("1", "x", None, "a.db"), ("2", None, None, "a.db"), ("3", None, "5", "b.db")]
    assert [r.source_file for r in df.where("id = '3'").collect()] == ["b.db"] and df.where("v = 'x'").count() == 1
    assert spark.read.format("sqlite_table").option("dbtable", 'no "such').load(str(tmp_path)).count() == 0


def test_capture_archives(spark, tmp_path):
    ok = tmp_path / "T" / "cycle_1"
    ok.mkdir(parents=True)
    lines = [{"captured_at_utc": "t1", "fields": {"last": 2.0}, "cycle_id": "c"}, {"captured_at_utc": "t1", "fields": {"last": 2.0}, "cycle_id": "c"}, {"captured_at_utc": "t2", "price": "nan"}, {"captured_at_utc": "t3", "price": 3, "strategy_price_usable": False}]
    with zipfile.ZipFile(ok / "e.zip", "w") as z:
        z.writestr("manifest.json", json.dumps({"ticker": "T", "rows": 4, "event_type": "BUY_FILL"}))
        z.writestr("market_data.jsonl", "\n".join(map(json.dumps, lines)) + "\n{broken\n")
    with zipfile.ZipFile(ok / "f.zip", "w") as z:
        z.writestr("market_data.jsonl", "nothing\n")
        z.writestr("market_data.csv", "captured_at_utc,price,atr_pct\nt9,4.5,0.7\n")
    (ok / "g.zip").write_bytes(b"no archive")
    rows = captures.points(spark, str(tmp_path)).collect()
    good = sorted((r.captured_at_utc, r.price, r.atr_pct) for r in rows if r.error is None)
    assert good == [("t1", 2.0, None), ("t9", 4.5, 0.7)]
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["archive", "json", "json", "price"]
    inv = {r.file.rsplit("/", 1)[-1]: r for r in captures.inventory(spark, str(tmp_path)).collect()}
    assert inv["e.zip"].event_type == "BUY_FILL" and inv["f.zip"].error == "manifest" and inv["g.zip"].error.startswith("archive")


def test_hash_chain(spark, tmp_path):
    rows = [{"sequence": i, "bid": i * 0.5} for i in range(1, 6)]
    hashes = [recording.row_hash(r) for r in rows]
    chain = list(recording.chain_hashes(iter(hashes)))

    def build(name, change=None):
        with sqlite3.connect(tmp_path / name) as c:
            c.execute("create table ticks (sequence, bid, record_hash, chain_hash)")
            c.executemany("insert into ticks values (?,?,?,?)", [(r["sequence"], r["bid"], h, k) for r, h, k in zip(rows, hashes, chain)])
            if change:
                c.execute(change)

    build("ok.db")
    build("bid.db", "update ticks set bid = 9 where sequence = 3")
    build("cut.db", "delete from ticks where sequence = 2")
    got = {(r.path.rsplit("/", 1)[-1], r.problem) for r in recording.verify_recordings(spark, str(tmp_path)).collect()}
    assert got == {("bid.db", "record 3"), ("cut.db", "chain 3"), ("cut.db", "sequence 3")}
