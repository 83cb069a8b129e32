"""Vectors and edge cases of the frame operators that SQL doesn't check."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import expr, extend, protocols, signals
from framequarry.operators import decode, diff, graph, learn, models, ordered, profile, store, windows
from framequarry.schema import FRAME_SCHEMA
from framequarry.sources import binary, dictionary, documents, text
from framequarry.streaming import folds, runtime


def make(spark, rows):
    """Frames out of (ts_us, can_id, bytes) or with a dict of further columns as fourth."""
    out = []
    for i, r in enumerate(rows):
        more = r[3] if len(r) > 3 else {}
        out.append((i, more.get("session_id", 0), r[0], r[1], *(more.get(c, False) for c in ("extended", "rtr", "error", "fd", "brs", "esi", "xl")), len(r[2]), list(r[2])))
    return spark.createDataFrame(out, FRAME_SCHEMA)


@pytest.mark.parametrize(
    "text_,expected",
    [
        ("can.id == 0x100", True), ("can.id == 256", True), ("can.dlc == 8", False), ("can.data[0] == 0xFF", True), ("can.data[1] == 0x42", True), ("can.id > 0x100", False), ("can.dlc <= 4", True),
        ("can.id == 0x100 and can.data[0] == 1", False), ("can.id == 1 or can.data[0] == 255", True), ("not can.fd", True), ("!(can.id == 1) && can.data[63] == 0", True), ("can.err || can.ext", False), ("", True), ("   ", True),
        ("can.id ==", False), ("can.bogus == 1", False), ("(can.id == 256", False), ("can.id == 256 )", False), ("true", True), ("false or can.dlc", True), ("can.id @ == $ 256", True),
    ],
)
def test_filter_language(spark, text_, expected):
    df = make(spark, [(0, 0x100, [0xFF, 0x42])])
    assert bool(expr.filter_frames(df, text_).count()) is expected


def test_filter_errors_are_told():
    assert expr.compile_filter("can.id ==")[1] and expr.compile_filter("can.id == 1")[1] is None


def test_frame_bits(spark):
    rows = [(0, 1, [], {"fd": True}), (0, 1, [0] * 64, {"fd": True}), (0, 1, [], {"fd": True, "extended": True}), (0, 1, [0] * 64, {"fd": True, "extended": True}), (0, 1, [0] * 8, {"extended": True}), (0, 1, [])]
    assert [r[0] for r in make(spark, rows).orderBy("frame_id").select(profile.frame_bits()).collect()] == [60, 572, 80, 592, 128, 44]


def test_intervals_drop_times_that_do_not_rise(spark):
    df = make(spark, [(t, 1, [0]) for t in (0, 10_000, 20_000, 15_000, 20_000, 30_000, 90_000)])
    r = profile.interval_stats(df).first()
    assert (r["intervals"], r["gaps"], r["min_s"], r["max_s"]) == (4, 1, 0.01, 0.06) and not r["periodic"]
    one = profile.interval_stats(make(spark, [(5, 1, [0])])).first()
    assert (one["intervals"], one["sd_s"], one["min_s"]) == (0, 0.0, 0.0)


def test_roles_of_known_bytes(spark):
    df = make(spark, [(i * 10_000, 7, [i % 256, 0x42, 255 * (i % 2), i * 13 % 256]) for i in range(300)])
    roles = {r["byte_idx"]: r["role"] for r in profile.byte_role(df).collect()}
    assert roles == {0: "COUNTER", 1: "CONST", 2: "TOGGLE", 3: "VALUE"}
    assert profile.message_timing(df).first()["timing"] == "PERIODIC"
    assert sorted(r["byte_idx"] for r in profile.auto_increment(df).collect()) == [0, 2]


def test_counter_keeps_expectation_over_short_frames(spark):
    df = make(spark, [(i, 1, d) for i, d in enumerate(([3], [4], [], [5], [9], [10]))])
    assert [r["result"] for r in windows.counter_check(df, 1, 0, 16).orderBy("frame_id").collect()] == ["Skip", "Ok", "OutOfRange", "Ok", "Mismatch", "Ok"]
    nibble = make(spark, [(i, 1, [v << 4]) for i, v in enumerate((14, 15, 0, 2))])
    assert [r["result"] for r in windows.counter_check(nibble, 1, 0, 16, True).orderBy("frame_id").collect()] == ["Skip", "Ok", "Ok", "Mismatch"]


def test_rate_anomaly_window_agrees_with_fold(spark):
    times = [i * 10_000 for i in range(20)] + [190_000 + 3_000, 193_000 + 50_000, 260_000, 270_000]
    df = make(spark, [(t, 5, [0]) for t in times])
    window = {r["frame_id"] for r in windows.rate_anomalies(df, 50.0).collect()}
    fold = {r["frame_id"] for r in folds.run_fold(df.select("frame_id", "can_id", "ts_us", F.col("dlc").cast("long").alias("dlc")), ["can_id"], ["ts_us", "frame_id"], folds.alerts([{"name": "r", "type": "RateAnomaly", "percent": 50.0}]), "rule string, frame_id long, can_id long, ts_us long").collect()}
    assert window == fold and window


def test_recording_diff_and_compare(spark):
    a, b = make(spark, [(0, 1, [1, 2]), (1, 2, [5]), (2, 3, [7])]), make(spark, [(0, 1, [1, 9]), (1, 2, [5]), (2, 4, [0xAA])])
    got = {r["can_id"]: (r["change"], r["count_a"], r["count_b"], r["changed_mask"]) for r in diff.recording_diff(a, b).collect()}
    assert got == {1: ("ByteChanged", 1, 1, 2), 3: ("Removed", 1, 0, 0), 4: ("Added", 0, 1, 0)}
    status = {r["can_id"]: r["status"] for r in diff.compare_by_id(a, b).collect()}
    assert status == {1: "Different", 2: "Identical", 3: "LeftOnly", 4: "RightOnly"}


def test_request_response_pairs(spark):
    rows = [x for i in range(10) for x in ((i * 200_000, 0x7E0, [1]), (i * 200_000 + 50_000, 0x7E8, [2]))]
    got = [(r["req_id"], r["resp_id"], r["hits"], r["latency_ms"]) for r in diff.request_response(make(spark, rows)).collect()]
    assert (0x7E0, 0x7E8, 10, 50.0) in got


def test_payload_search_edges(spark):
    df = make(spark, [(0, 1, [1, 2, 1, 2]), (1, 1, [2]), (2, 1, [])])
    assert [(r["frame_id"], r["offset"]) for r in store.search_payload(df, [1, 2]).collect()] == [(0, 0)]
    assert store.search_payload(df, []).count() == 0 and store.search_payload(df, [0xF2], [0x0F]).count() == 2


def test_signals_round_trip(spark):
    dbc = 'BO_ 256 EngineData: 8 Vector__XXX\n SG_ EngineSpeed : 0|16@1+ (1,0) [0|65535] "rpm" Vector__XXX\n SG_ T : 23|12@0- (0.5,-10) [0|0] "C" Vector__XXX\nBO_ 0x123 X: 2 Vector__XXX\n'
    rows = dictionary.parse_dbc(dbc)
    assert [r[3] for r in rows] == ["EngineSpeed", "T", None] and rows[2][0] == 0x123
    assert dictionary.parse_dbc(dictionary.serialize_dbc(rows)) == rows
    dims = dictionary.dictionary(spark, rows)
    df = make(spark, [(0, 256, [0x34, 0x12, 0xFF, 0xE0, 0, 0, 0, 0]), (1, 256, [0x34])])
    got = {(r["frame_id"], r["sig_name"]): r["value"] for r in decode.decode(df, dims).collect()}
    assert got == {(0, "EngineSpeed"): 0x1234, (0, "T"): -2 * 0.5 - 10, (1, "EngineSpeed"): 0x34}
    extend.register_decode(spark, rows)
    df.createOrReplaceTempView("frames_for_decode")
    table = {(r["frame_id"], r["sig_name"]): r["value"] for r in spark.sql("SELECT frame_id, d.* FROM frames_for_decode, LATERAL decode_signals(can_id, data) d").collect()}
    assert table == got


def test_field_insertion(spark):
    df = make(spark, [(0, 1, [0xFF] * 8)])
    out = df.select(signals.insert_little(F.col("data"), F.lit(12), F.lit(8), F.lit(0x5A).cast("long")), signals.insert_motorola(F.col("data"), F.lit(3), F.lit(12), F.lit(0xABC).cast("long"))).first()
    assert out[0][:4] == [0xFF, 0xAF, 0xF5, 0xFF] and out[1][:3] == [0xFA, 0xBC, 0xFF]


def test_checksums(spark):
    df = make(spark, [(0, 1, [0x31, 0x32, 0x33, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39])])
    r = df.select(signals.checksum("crc8_j1850", 0, 8), signals.checksum("crc8_autosar", 0, 8), signals.checksum("xor", 0, 8), signals.checksum("sum8", 0, 9)).first()
    # The published check values over "123456789": 0x4B with a final XOR of 0xFF, and 0xDF.
    assert (r[0] ^ 0xFF, r[1], r[2], r[3]) == (0x4B, 0xDF, 0x31, 0)


def test_lin_identifiers(spark):
    known = {0x00: 0x80, 0x01: 0xC1, 0x02: 0x42, 0x3C: 0x3C, 0x3D: 0x7D}
    got = spark.createDataFrame([(k,) for k in known], "i long").select("i", protocols.lin_pid(F.col("i"))).collect()
    assert {r[0]: r[1] for r in got} == known


def test_obd_values(spark):
    rows = [(0, 0x7E8, [3, 0x41, 0x11, 0xFF]), (1, 0x7E8, [3, 0x41, 0x0E, 128]), (2, 0x7E8, [3, 0x41, 0x11]), (3, 0x7E8, [4, 0x41, 0x0C, 0x1A, 0xF8]), (4, 0x123, [3, 0x41, 0x11, 0xFF])]
    got = [round(r["value"], 6) for r in protocols.decode_obd(make(spark, rows)).orderBy("frame_id").collect()]
    assert got == [100.0, 0.0, 0.0, 1726.0, 0.0]


def test_doip_and_someip_errors(spark):
    df = make(spark, [(0, 1, [2, 0xFD, 0x80, 1, 0, 0, 0, 6, 0x0E, 0, 0x10, 1, 0x22, 0xF1]), (1, 1, [2, 2, 0, 0, 0, 0, 0, 0]), (2, 1, [1, 2]), (3, 1, [2, 0xFD, 0, 5, 0, 0, 0, 9, 1])])
    rows = df.orderBy("frame_id").select(*protocols.doip_fields()).collect()
    assert rows[0]["valid"] and (rows[0]["source_addr"], rows[0]["target_addr"]) == (0x0E00, 0x1001)
    assert [r["error"][:9] for r in rows[1:]] == ["Invalid D", "Too short", "Truncated"]
    entry = [1, 0, 0, 0x10, 0x12, 0x34, 0, 1, 1, 0, 0, 3, 0, 0, 0, 7]
    sd = [0xFF, 0xFF, 0x81, 0, 0, 0, 0, 8 + 8 + 16 + 4, 0, 0, 0, 1, 1, 1, 2, 0, 0x80, 0, 0, 0, 0, 0, 0, 16, *entry, 0, 0, 0, 0]
    r = make(spark, [(0, 1, sd)]).select(*protocols.someip_fields()).first()
    assert r["valid"] and r["discovery"] and [(e["type"], e["service"], e["ttl"], e["minor"]) for e in r["entries"]] == [(1, 0x1234, 3, 7)]


def test_transport_vectors(spark):
    payload = bytes(range(40))
    frames = folds.segment(payload)
    state, out = {}, []
    for i, d in enumerate(frames):
        state, more = folds.can_tp()(state, {"can_id": 5, "ts_us": i, "data": list(d)})
        out += more
    assert [m["payload"] for m in out] == [payload.hex()] and folds.segment(b"") == [] and folds.segment(b"abc") == [b"\x03abc"]
    long = folds.segment(bytes(200))
    assert [f[0] & 0x0F for f in long[1:]][14:17] == [15, 1, 2]
    state, more = folds.can_tp()({"total": 20, "sn": 1, "ts": 0, "last": 0, "buf": [0] * 6}, {"can_id": 5, "ts_us": 2_000_000, "data": [0x21, 1]})
    assert state == {} and more[0]["error"] == "CAN TP session timeout"
    assert folds.iso_tp()({}, {"can_id": 0x123, "ts_us": 0, "data": [1, 2]}) == ({}, [])


def test_uds_sequence_states():
    steps = [{"name": "a", "rx": 8, "sid": 0x10, "timeout_us": 100, "retries": 1, "stop": True}, {"name": "b", "rx": 8, "sid": 0x22, "timeout_us": 100, "retries": 0, "stop": True}, {"name": "c", "rx": 8, "sid": 0x3E, "timeout_us": 100, "retries": 0, "stop": False}]
    state, out = {}, []
    for ts, data in ((0, [0]), (150, [0x50, 1]), (180, [0x7F, 0x22, 0x31]), (190, [0x7E])):
        state, more = folds.uds_sequence(steps)(state, {"can_id": 8, "ts_us": ts, "data": data})
        out += more
    assert [(o["step"], o["status"], o["retries"]) for o in out] == [("a", "Pass", 1), ("b", "NegResponse", 0)]


def test_rate_limit_and_merge(spark):
    df = make(spark, [(t, i, [0]) for t in range(0, 100_000, 10_000) for i in (1, 2)])
    out = folds.run_fold(df, ["can_id"], ["ts_us", "frame_id"], folds.rate_limit(40, {2: 0}), "frame_id long, can_id long, ts_us long").collect()
    assert sorted((r["can_id"], r["ts_us"]) for r in out) == [(1, t) for t in (0, 30_000, 60_000, 90_000)]
    two = make(spark, [(0, 1, [1]), (50_000, 2, [2]), (60_000, 1, [1]), (400_000, 3, [3])]).withColumn("side", F.when(F.col("frame_id") % 2 == 0, "a").otherwise("b"))
    got = sorted((r["frame_a"] if r["frame_a"] is not None else -1, r["frame_b"] if r["frame_b"] is not None else -1, r["status"]) for r in folds.merge_heads(two).collect())
    assert got == [(-1, 1, "RightOnly"), (-1, 3, "RightOnly"), (0, -1, "LeftOnly"), (2, -1, "LeftOnly")]
    assert folds.merge_heads(two.limit(0)).count() == 0


def test_text_formats(spark):
    lines = spark.createDataFrame([("(1.000000) can0 123#AABB",), ("# note",), ("(2.5) can0 18FEEE00##1AABBCC",), ("(3) can0 12#A",), ("bad",)], "value string")
    got = [(r["ts_us"], r["can_id"], r["extended"], r["fd"], r["data"]) for r in text.parse_candump(lines).orderBy("ts_us").collect()]
    assert got[0] == (1_000_000, 0x123, False, False, [0xAA, 0xBB]) and got[2][4] == [] and got[1][:4] == (2_500_000, 0x18FEEE00, True, True)
    us = text.parse_candump(spark.createDataFrame([("(1000000) can0 123#AABB",)], "value string"), "us").first()
    assert (us["ts_us"], us["data"]) == (1_000_000, [0xAA, 0xBB])
    serial = text.parse_slcan(spark.createDataFrame([("t1232AABB",), ("T0000010019F",), ("V1013",), ("r1230",)], "value string")).collect()
    assert sorted((r["can_id"], r["extended"], r["rtr"], r["data"]) for r in serial) == [(0x100, True, False, [0x9F]), (0x123, False, False, [0xAA, 0xBB]), (0x123, False, True, [])]
    esp = text.parse_esp(spark.createDataFrame([("RX EXT 1ABCDEF 2 0A FF",), ("RX STD zz 1 0",), ("TX STD 1 0",), ("RX STD 7FF 9",)], "value string")).collect()
    assert [(r["can_id"], r["extended"], r["data"]) for r in esp] == [(0x1ABCDEF, True, [10, 255])]
    msg = text.parse_messages(spark.createDataFrame([('{"type":"frames","count":1,"frames":[{"id":5,"extended":true,"dlc":2,"timestamp":9,"data":"0102"}]}',), ("{oops",), ('{"type":"x"}',)], "value string")).collect()
    assert [(r["can_id"], r["ts_us"], r["data"], r["rtr"]) for r in msg] == [(5, 9, [1, 2], False)]
    send = text.parse_send(spark.createDataFrame([('{"id":"0x800","data":"FF"}',), ('{"id":12,"dlc":0}',), ("{}",)], "value string")).collect()
    assert sorted((r["can_id"], r["extended"], r["dlc"], r["data"][:1]) for r in send) == [(12, False, 0, []), (0x800, True, 8, [255])]


def test_mcan_files(spark, tmp_path):
    rows = [(10, 0x123, [1, 2], {"extended": True}), (20, 5, [9] * 64, {"xl": True}), (30, 6, [], {"error": True})]
    df = make(spark, rows)
    blob = binary.encode_mcan(r.asDict() for r in df.orderBy("frame_id").collect())
    assert blob[:8] == struct.pack("<II", 0x4E41434D, 1)
    back = binary.decode_mcan(blob)
    assert [(r[2], r[3], r[4], r[6], r[12]) for r in back] == [(10, 0x123, True, False, [1, 2]), (20, 5, False, False, [9] * 64), (30, 6, False, True, [])]
    assert len(binary.decode_mcan(blob[:-1])) == 2 and binary.decode_mcan(b"nope" + blob) == []
    binary.register(spark)
    path = str(tmp_path / "rec")
    documents.synthetic_frames(spark, 3, 500).coalesce(2).write.format("mcan").option("path", path).option("compression", "zstd").mode("append").save()
    read = spark.read.format("mcan").load(path)
    assert read.count() == 500 and read.filter("can_id = 257").count() == sum(1 for i in range(500) if i % 8 == 1)
    assert binary.read_mcan(spark, path).count() == 500


def test_capture_channel_and_stream_formats():
    rows = [{"ts_us": 1_500_000, "can_id": 5, "extended": True, "fd": False, "dlc": 2, "data": [1, 2]}, {"ts_us": 2_500_000, "can_id": 6, "extended": False, "fd": True, "dlc": 12, "data": list(range(12))}]
    blob = binary.encode_pcap(rows)
    assert len(blob) == 24 + 2 * 32 and struct.unpack_from("<I", blob, 20)[0] == 227 and struct.unpack_from("<II", blob, 24) == (1, 500000)
    assert struct.unpack_from("<IB", blob, 40) == (0x80000005, 2) and struct.unpack_from("<IB", blob, 72) == (0x40000006, 8)
    assert binary.decode_channels(binary.encode_channels(rows)) == {"CAN_ID_0x005": [(0.0, 1.0)], "CAN_ID_0x006": [(1.0, 0.0)]}
    packet = b"\xf1\x00" + bytes(4) + struct.pack("<I", 0x80000123) + b"\x02\xaa\xbb"
    frames, rest = binary.feed_gvret(b"junk" + packet + packet[:-1])
    assert frames == [(0x123, True, b"\xaa\xbb")] and rest == packet[:-1]
    assert binary.feed_gvret(b"xx\xf1") == ([], b"\xf1")


def test_streams(spark, tmp_path):
    source, data = str(tmp_path / "in"), documents.synthetic_frames(spark, 1, 400)
    data.coalesce(1).write.parquet(source)
    seen = []
    q = runtime.fan_out(runtime.frame_stream(spark, source), [lambda b, n: seen.append(b.count())], 16, [lambda b, n: seen.append(b.count())], str(tmp_path / "c1"))
    q.processAllAvailable()
    q.stop()
    assert seen == [400, 25]
    q = runtime.tumbling(runtime.frame_stream(spark, source), "100 milliseconds").writeStream.format("memory").queryName("ticks").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(frames) FROM ticks").first()[0] == 400
    both = runtime.merge_observed(runtime.observe(data.filter("frame_id < 100")), runtime.observe(data.filter("frame_id >= 100")))
    assert sorted(map(str, both.collect())) == sorted(map(str, runtime.observe(data).collect()))


def test_scripts_and_plugins(spark):
    df = make(spark, [(5000, 1, [1]), (6000, 2, [])])

    def script(host, can_id, data, ts):
        host.log(f"{host.tick()} {data[0]}")

    got = sorted((r["frame_id"], r["kind"]) for r in extend.on_frame(df, script).collect())
    assert got == [(0, "log"), (1, "error")]

    class Only:
        schema = "frame_id long"

        def relevant(self):
            return F.col("can_id") == 2

        def process(self, pdf):
            return pdf[["frame_id"]]

    assert [r[0] for r in extend.run_plugin(df, Only()).collect()] == [1]
    with pytest.raises(ValueError):
        extend.Tools(df).call("nothing")


def test_p_values():
    assert learn.p_value(0.9, 30) < 0.001 and learn.p_value(0.2, 30) > 0.1 and learn.p_value(0.5, 4) > 0.2
    assert learn.p_value(1, 10) == 0 and learn.p_value(0, 100) == pytest.approx(1) and learn.p_value(0.5, 2) == 1
    assert learn.p_value(0.5, 20) == pytest.approx(0.024769, abs=2e-5)


def test_series_models():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(0, 0.1, 50), rng.normal(5, 0.1, 50)])
    assert models.change_points(v) == [50] and models.change_points(np.zeros(40)) == []
    t = np.arange(128)
    mag, n = models.spectrum(np.sin(2 * math.pi * t / 16))
    assert n == 128 and int(np.argmax(mag)) == 8
    x = rng.normal(0, 1, 300)
    y = np.concatenate(([0, 0], x[:-2])) + rng.normal(0, 0.1, 300)
    assert models.granger_f(x, y, 2) > 100 > models.granger_f(y, x, 2)
    pts = np.concatenate([rng.normal(0, 0.05, (30, 2)), rng.normal(3, 0.05, (30, 2)), [[10, 10]]])
    labels = models.dbscan(pts, 0.5, 4)
    assert len(set(labels[:30])) == 1 and len(set(labels[30:60])) == 1 and labels[0] != labels[30] and labels[60] == -1
    forest = models.isolation_forest(pts, 50, 64)
    scores = models.isolation_score(forest, pts, 61)
    assert scores.argmax() == 60 and (scores > 0).all() and (scores < 1).all()
    flat, losses = models.tsne(pts[:40], 10, 300)
    assert flat.shape == (40, 2) and losses[-1] < losses[1]
    net = models.Network(3)
    x = rng.uniform(0, 1, (400, 3))
    assert net.fit(x, x[:, 0] - x[:, 1], 400) < 0.05


def test_pearson_vectors(spark):
    rows = [("v", i, float(i), float(2 * i + 1), 1, 0, i) for i in range(1, 6)] + [("v", i, float(i), float(2 * i + 1), 2, 0, 9) for i in range(1, 6)]
    df = spark.createDataFrame([(v, o, y, c, b, a) for v, o, _, y, c, b, a in rows], "variable string, obs_id long, value double, can_id long, byte_idx int, avg_byte int")
    got = {r["can_id"]: r["r"] for r in learn.byte_correlations(df).collect()}
    assert got[1] == pytest.approx(1) and got[2] == 0


def test_empty_recording(spark):
    none = make(spark, [(0, 1, [0])]).limit(0)
    for plan in (profile.id_profile, profile.interval_stats, profile.byte_entropy, profile.flag_bits, windows.transitions, windows.delta, windows.new_ids, diff.dlc_anomalies, store.ids, store.id_frequency):
        assert plan(none).count() == 0
    assert windows.window_features(none, 1000).count() == 0


def test_steps_cross_chunks_and_empty_chunks(spark):
    times = [5, 5, 9, 12, 40, 41, 41, 99, 100, 100, 205]
    df = make(spark, [(t, k % 3 and 1 + (t > 50), [k, t % 7]) for k, t in enumerate(times)])
    rows = sorted(df.collect(), key=lambda r: (r["ts_us"], r["frame_id"]))
    chunk = ordered.by_time(10)
    for key in (["can_id"], ["session_id"]):
        before, after, at, last, n = {}, {}, {}, {}, {}
        for r in rows:
            k = r[key[0]]
            before[r["frame_id"]] = last.get(k)
            if k in last:
                after[last[k]] = r["frame_id"]
            n[k] = n.get(k, 0) + 1
            last[k], at[r["frame_id"]] = r["frame_id"], n[k]
        got = ordered.position(ordered.following(ordered.previous(df, {"b": "frame_id", "bd": "data"}, key, chunk), {"a": "frame_id"}, key, chunk), "rn", key, chunk).collect()
        assert {r["frame_id"]: (r["b"], r["a"], r["rn"]) for r in got} == {i: (before[i], after.get(i), at[i]) for i in at}
    assert ordered.previous(df.limit(0), {"b": "frame_id"}).count() == 0


def test_median_period_is_the_upper_median(spark):
    gaps = [10_000, 30_000, 20_000, 1_500_000, 2_500_000, 20_000]
    df = make(spark, [(sum(gaps[:i]), 1, [0]) for i in range(len(gaps) + 1)] + [(7, 2, [0])])
    assert [tuple(r) for r in profile.median_period(df).collect()] == [(1, 30.0)]


def test_fps_bursts_over_stretches(spark):
    counts = [(i * 7) % 5 + 1 for i in range(60)] + [200] + [3] * 10
    df = make(spark, [(i * 1000 + k, 1, []) for i, n in enumerate(counts) for k in range(n)])
    whole = {r["tick"]: (r["burst"], r["mean_frames"]) for r in windows.fps_bursts(df, 1000, 5).collect()}
    cut = {r["tick"]: (r["burst"], r["mean_frames"]) for r in windows.fps_bursts(df, 1000, 5, 8).collect()}
    assert whole == cut and whole[60][0] and whole[0][1] is None


def test_long_payloads_reach_mining(spark):
    df = make(spark, [(i, 1, [0] * 8 + [i, 255 - i] + [7] * 54, {"fd": True}) for i in range(6)])
    obs = df.select(F.lit("v").alias("variable"), F.col("frame_id").alias("obs_id"), "ts_us", F.col("frame_id").cast("double").alias("value"))
    got = {r["byte_idx"]: r["r"] for r in learn.byte_correlations(learn.observation_bytes(df, obs, 0, 0)).collect()}
    assert len(got) == 64 and got[8] == pytest.approx(1) and got[9] == pytest.approx(-1) and got[63] == 0
    assert len(learn.byte_means(df).first()["vec"]) == 64


def test_candidates_agree_with_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(e, e < 6, i, [float(x) for x in rng.normal(size=5)] if (e, i) != (2, 1) else [0.0] * 5) for e in range(11) for i in (1, 2)] + [(0, True, 3, [1.0] * 5)]
    got = {r["can_id"]: (r["same"], r["diff"]) for r in learn.candidates(spark.createDataFrame(rows, "event_id long, label boolean, can_id long, vec array<double>")).collect()}
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if any(a) and any(b) else 0.0
    for i in (1, 2):
        pos, neg = ([r[3] for r in rows if r[2] == i and r[1] == side] for side in (True, False))
        same = [cos(a, b) for k, a in enumerate(pos) for b in pos[:k]]
        diff_ = [cos(a, b) for a in pos for b in neg]
        assert got[i] == pytest.approx((sum(same) / len(same), sum(diff_) / len(diff_)))
    assert set(got) == {1, 2}


def event_case(spark):
    """Frames of four identifiers with equal times and gaps, events on and off frames, one of them alone; and all windows by brute force."""
    rng = np.random.default_rng(12)
    times = sorted(int(t) for t in rng.integers(0, 3000, 300))
    df = make(spark, [(t, int(rng.integers(1, 5)), [int(x) for x in rng.integers(0, 256, rng.integers(0, 5))]) for t in times] + [(90_000, 3, [1])])
    frames = [(r["ts_us"], r["frame_id"], r["can_id"], list(r["data"])) for r in df.collect()]
    events = [(i, i % 3 == 0, at) for i, at in enumerate([*times[::9], *(int(t) for t in rng.integers(-300, 3300, 30)), 90_000])]
    inside = {(e, label): sorted(f for f in frames if at - 200 <= f[0] <= at + 60) for e, label, at in events}
    return df, spark.createDataFrame(events, "event_id long, label boolean, at_us long"), {k: v for k, v in inside.items() if len(v) >= 3}


def above_join(df):
    """What the plan does with the rows of the join on buckets of time."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan[: plan.index("[_b#")] if "[_b#" in plan else None


def test_event_frames_without_a_shuffle_of_pairs(spark):
    df, events, inside = event_case(spark)
    got = learn.event_frames(df, events, 200, 60).select("event_id", "label", "frame_id")
    assert sorted(map(tuple, got.collect())) == sorted((e, label, f[1]) for (e, label), fs in inside.items() for f in fs) and 40 < len(inside) < events.count()
    assert "Window" not in above_join(got) and "Exchange" not in above_join(got)


def test_event_frames_in_runs(spark, monkeypatch):
    """In a file ids take a fraction of a byte if an event's rows come in runs; frame by frame they are no runs at all. As on large tables nothing is broadcast."""
    monkeypatch.setattr(learn, "BLOCK", 32, raising=False)
    conf = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(conf)
    spark.conf.set(conf, -1)
    times = np.random.default_rng(13).integers(0, 1000, 2000)
    df = make(spark, [(int(t), 1, [0]) for t in times])
    events = [(i, i % 2 == 0, 25 * i) for i in range(40)]
    got = learn.event_frames(df, spark.createDataFrame(events, "event_id long, label boolean, at_us long"), 300, 100).select("event_id", "frame_id").collect()
    spark.conf.set(conf, before)
    frames = [(r["ts_us"], r["frame_id"]) for r in df.collect()]
    assert sorted(map(tuple, got)) == sorted((e, f) for e, _, at in events for t, f in frames if at - 300 <= t <= at + 100)
    runs = 1 + sum(a["event_id"] != b["event_id"] for a, b in zip(got, got[1:]))
    assert 16 * runs < len(got)


def test_event_features_without_pairs(spark):
    df, events, inside = event_case(spark)
    features = learn.event_features(df, events, 200, 60)
    got = {(r["event_id"], r["label"], r["can_id"]): r["vec"] for r in features.collect()}
    want = {}
    for (e, label), fs in inside.items():
        for i in {f[2] for f in fs}:
            own = [f for f in fs if f[2] == i]
            gaps = np.diff([f[0] for f in own]) / 1000
            want[e, label, i] = [len(own), gaps.mean() if len(gaps) else 0, gaps.std() if len(gaps) else 0, *(np.mean([(f[3] + [0] * 8)[k] for f in own]) / 255 for k in range(8))]
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert above_join(features) is None


def test_candidates_of_events_without_pairs(spark):
    df, events, inside = event_case(spark)
    scores = learn.candidates(learn.event_features(df, events.filter("event_id < 34"), 200, 60))
    seen = [{f[2] for f in fs} for (e, label), fs in inside.items() if label and e < 34]
    assert {r["can_id"] for r in scores.collect()} == set.intersection(*seen) != set()
    assert above_join(scores) is None


@pytest.mark.parametrize("n", [1, 2, 3])
def test_sequences_without_pairs(spark, n):
    df, events, inside = event_case(spark)
    want = {}
    for fs in inside.values():
        for k in range(len(fs) - n + 1):
            g = "→".join(f"{f[2]:X}" for f in fs[k : k + n])
            want[g] = want.get(g, 0) + 1
    found = learn.sequences(df, events, 200, 60, n)
    assert {r["seq"]: (r["n"], r["confidence"]) for r in found.collect()} == {g: (c, c / len(inside)) for g, c in want.items()}
    assert above_join(found) is None


def test_decimal_scales_reach_their_bucket(spark):
    df = make(spark, [(i, 1, [raw % 256, raw // 256]) for i, raw in enumerate([0, 3, *(6528 * k for k in range(1, 11))])])
    dims = dictionary.dictionary(spark, dictionary.parse_dbc('BO_ 1 M: 8 X\n SG_ S : 0|16@1+ (0.1,0) [0|0] "" X\n'))
    values = decode.decode(df, dims)
    want = [0.0, 0.3, *(6528 * k / 10 for k in range(1, 11))]
    assert [r["value"] for r in values.orderBy("frame_id").collect()] == want
    stats, cells = decode.signal_stats(values).first(), [min(9, math.floor(v / 6528.0 * 10)) for v in want]
    assert [stats[f"h{i}"] for i in range(10)] == [cells.count(i) for i in range(10)] != [[min(9, math.floor(raw * 0.1 / 6528.0 * 10)) for raw in [0, 3, *(6528 * k for k in range(1, 11))]].count(i) for i in range(10)]


def test_density_clusters_of_all_windows(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(0, 0.3, (40, 4)), rng.normal(5, 0.3, (30, 4)), rng.uniform(-9, 9, (12, 4)), np.linspace((0, 0, 0, 0), (3, 0, 0, 0), 15)])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "win long, frames double, ids double, entropy double, duration_ms double")
    want = models.dbscan((x - x.mean(axis=0)) / x.std(axis=0), 0.5, 5)
    got = {r["win"]: r["cluster"] for r in models.dbscan_windows(df).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist() and len(set(want)) > 2


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 3), (3, 9)], "a long, b long")
    got = {r["node"]: r["comp"] for r in graph.components(path).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {3: 3, 7: 3, 9: 3}


def test_dictionary_statements():
    text_ = """BO_ 256 A: 8 X
 SG_ Mux M : 0|8@1+ (1,0) [0|0] "" X,Y
 SG_ S1 m0 : 8|8@1- (0.5,-3) [-1|1e3] "km/h" X
 SG_ bad : 8|8@2- (0.5,-3) [-1|1e3] "km/h" X
CM_ SG_ 256 S1 "first
BO_ 9 Fake: 8 X
 SG_ F : 0|8@1+ (1,0) [0|0] "" X";
BO_ zz B: 8 X
 SG_ lost : 0|8@1+ (1,0) [0|0] "" X
BO_ 0x1FFF C: 4 X
 SG_ t:7|64@0+(1,0)[0|0]"" X
BO_ 5 D: 1 X"""
    rows = dictionary.parse_dbc(text_)
    assert [(r[0], r[1], r[3], r[4], r[5], r[6], r[7]) for r in rows] == [(256, "A", "Mux", 0, 8, True, False), (256, "A", "S1", 8, 8, True, True), (8191, "C", "t", 7, 64, False, False), (5, "D", None, None, None, None, None)]
    assert rows[1][8:] == (0.5, -3.0, -1.0, 1000.0, "km/h") and dictionary.parse_dbc("") == []


@pytest.mark.parametrize("size", [1, 3, 8, 12, 64])
def test_fields_against_bits(spark, size):
    rng = np.random.default_rng(size)
    data = [int(x) for x in rng.integers(0, 256, size)]
    bit = lambda k: data[k // 8] >> k % 8 & 1 if 0 <= k < 8 * size else 0
    fields = [(int(rng.integers(0, 8 * size)), int(rng.integers(1, 65))) for _ in range(25)] + [(0, 64), (7, 64)]
    little = [signals.raw_little("data", str(s), str(n)) for s, n in fields]
    big = [signals.raw_motorola("data", str(s), str(n)) for s, n in fields]
    out = make(spark, [(0, 1, data)]).select(*(c.alias(f"c{i}") for i, c in enumerate(little + big))).first()
    for i, (s, n) in enumerate(fields):
        assert out[i] % (1 << 64) == sum(bit(s + k) << k for k in range(n)), (s, n)
        places = [s // 8 * 8 + s % 8 - k if k <= s % 8 else (s // 8 + 1 + (k - s % 8 - 1) // 8) * 8 + 7 - (k - s % 8 - 1) % 8 for k in range(n)]
        assert out[len(fields) + i] % (1 << 64) == sum(bit(p) << n - 1 - k for k, p in enumerate(places)), (s, n)
