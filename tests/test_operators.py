"""Small literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from flightloom.operators import coverage, graph, matching, pairs, prepare, raster, reports, windows
from flightloom.sources import messages, readers, writers


def capture_row(seq, lat, name, alt=100.0, lon=73.8567, yaw=0.0):
    return (1, seq, float(seq), name, lat, lon, alt, alt - 5, 1.0, 1.0, yaw, 0.0, 0.0, 0.0)


CAPTURE = (
    "mission_id long, seq long, t double, image_name string, latitude double, longitude double, gps_altitude double, "
    "baro_altitude double, roll double, pitch double, yaw double, gyro_x double, gyro_y double, gyro_z double"
)


def test_coverage_of_two_images(spark):
    df = spark.createDataFrame(
        [capture_row(1, 18.5204, "img_001.jpg"), capture_row(2, 18.5205, "img_002.jpg", 90.0, 73.8568, 25.0)], CAPTURE
    )
    shapes = coverage.footprints(df)
    assert [len(r.corners) for r in shapes.collect()] == [4, 4]
    row = coverage.coverage(shapes).first()
    assert 0 < row.unique_area_m2 <= row.raw_area_m2 and row.image_count == 2


def test_no_footprints_gives_a_zero_row(spark):
    df = spark.createDataFrame([capture_row(1, 0.0, "a.jpg")], CAPTURE)
    row = coverage.coverage(coverage.footprints(df), missions=df).first()
    assert (row.image_count, row.raw_area_m2, row.unique_area_m2, row.overlap_area_m2) == (0, 0.0, 0.0, 0.0)


def test_candidate_graph_of_three_close_images(spark):
    df = spark.createDataFrame([capture_row(i + 1, 18.5204 + i * 3e-5, n) for i, n in enumerate("abc")], CAPTURE)
    edges = {(r.source, r.target) for r in pairs.candidate_graph(df, prior=True).collect()}
    assert ("a", "c") in edges and len(edges) == 3


def test_far_images_do_not_overlap(spark):
    df = spark.createDataFrame([capture_row(1, 18.5204, "a"), capture_row(2, 18.52042, "b"), capture_row(3, 18.5304, "c")], CAPTURE)
    got = {(r.source, r.target): r.predicted_overlap for r in pairs.candidate_graph(df).collect()}
    assert got[("a", "b")] > 0 and got[("a", "c")] == 0.0


def test_pairs_of_a_crowded_moment_equal_brute_force(spark):
    """Forty images within seconds, spread over grid squares: the bucketed join must lose none."""
    data = [capture_row(i, 18.5204 + (i * 37 % 40) * 2.5e-4, f"i{i:02d}", 300.0, 73.8567 + (i * 11 % 40) * 2.5e-4) for i in range(40)]
    df = spark.createDataFrame([(*r[:2], 15.0 + r[1] * 0.4, *r[3:]) for r in data], CAPTURE)
    nodes = pairs.image_nodes(df)
    got = {(r.a_image_name, r.b_image_name) for r in pairs.spatial_pairs(nodes).collect()}
    a = nodes.select("mission_id", *pairs._sided(nodes, "a"))
    b = nodes.select("mission_id", *pairs._sided(nodes, "b"))
    everything = a.join(b, "mission_id").filter("a_idx < b_idx and abs(a_cx - b_cx) <= 1 and abs(a_cy - b_cy) <= 1")
    want = {(r.a_image_name, r.b_image_name) for r in pairs._measured(everything).filter(pairs._plausible()).collect()}
    assert got == want and len(want) > 20


def test_tiles(spark):
    px = []
    for r in range(12):
        for c in range(16):
            px.append((1, r, c, 255 if r % 4 == 0 else 180 if c % 4 == 0 else 90))
            px.append((2, r, c, 0))
    pixels = spark.createDataFrame(px, "event_id long, r long, c long, g long")
    caps = spark.createDataFrame([(1, *capture_row(1, 18.5, "a")), (2, *capture_row(2, 18.5, "b")), (3, *capture_row(3, 18.5, "c"))], "event_id long, " + CAPTURE)
    got = {r.image_name: r for r in raster.image_quality(caps, raster.tile_metrics(pixels, ["event_id"], 12, 16), ["event_id"]).collect()}
    assert got["a"].status in ("GOOD", "MARGINAL") and got["a"].total_score > 0
    assert got["b"].status == "REJECTED" and "underexposed" in got["b"].flags
    assert got["c"].flags == ["unreadable"] and got["c"].shadow_share == 1.0


def test_worker_recovery(spark):
    df = spark.createDataFrame([(1, "GPS", 1, 1.0, False, "boom"), (1, "GPS", 2, 2.0, True, "")], "mission_id long, worker string, seq long, t double, ok boolean, error string")
    row = reports.worker_health(windows.worker_timeline(df)).first()
    assert (row.last_status, row.errors, row.recoveries, row.last_error) == ("HEALTHY", 1, 1, "boom")


def test_session_extremes(spark):
    df = spark.createDataFrame([(1, 10.0, 12.0, 5.1, 0.4), (1, 20.0, 22.0, 4.7, 0.8)], "mission_id long, baro_altitude double, gps_altitude double, bus_voltage_v double, current_a double")
    row = reports.session_minmax(df, ["mission_id"]).first()
    assert (row.sample_count, row.min_baro_altitude, row.max_baro_altitude, row.min_bus_voltage_v) == (2, 10.0, 20.0, 4.7)


def test_reconciliation(spark):
    log = spark.createDataFrame([(1, "present"), (1, "missing")], "mission_id long, image_name string")
    files = spark.createDataFrame([(1, "present"), (1, "orphan")], "mission_id long, image_name string")
    row = reports.reconcile_images(log, files).first()
    assert (row.referenced, row.present, row.missing, row.orphan, row.missing_examples) == (2, 1, 1, 1, "missing")


def test_components_of_a_hub_and_a_long_chain(spark):
    data = [("hub", f"leaf{i:03d}") for i in range(200)] + [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    got = graph.connected_components(spark.createDataFrame(data, "u string, v string")).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {"hub": 201, "n000": 121}


def test_chained_transforms_follow_the_edges(spark):
    h = [1.0, 0.0, 1.0, 0.0, 1.0, 2.0, 0.0, 0.0, 1.0]
    edges = spark.createDataFrame([(1, "a", "b", h), (1, "c", "b", h)], "mission_id long, source string, target string, h array<double>")
    anchor = spark.createDataFrame([(1, "a")], "mission_id long, image_name string")
    got = {r.image_name: (r.hops, r.transform[2], r.transform[5]) for r in graph.reach(edges, anchor, True).collect()}
    assert got == {"a": (0, 0.0, 0.0), "b": (1, -1.0, -2.0), "c": (2, 0.0, 0.0)}


def test_matches_do_not_depend_on_the_block_size(spark, tables):
    e = tables.table("embeddings").filter("label < 3")
    d = e.select(F.col("label").alias("image_name"), F.col("vec_id").alias("feature_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    edges = spark.createDataFrame([(0, 1), (1, 2)], "source int, target int")
    runs = [sorted(map(tuple, matching.ratio_matches(edges, d, 0.95, block=b).collect())) for b in (7, 5000)]
    assert runs[0] == runs[1] and runs[0]


def test_poses(spark, tmp_path):
    path = tmp_path / "poses.csv"
    # quarter turn about z and a shift: the centre is minus the inverse rotation of the shift
    s = 0.5**0.5
    path.write_text(f"filename,camera_id,qw,qx,qy,qz,tx,ty,tz,center_x,center_y,center_z\na.jpg,1,{s},0,0,{s},1,2,3,-2,1,-3\n")
    from flightloom.functions.attitude import pose_centre

    poses = readers.read_camera_poses(spark, str(path))
    centre = poses.select(pose_centre(F.array("qw", "qx", "qy", "qz"), F.array("tx", "ty", "tz")).alias("c")).first().c
    assert all(abs(a - b) < 1e-12 for a, b in zip(centre, (-2.0, 1.0, -3.0)))


def test_required_columns_and_rows(spark):
    df = spark.createDataFrame([(1, 2)], "b int, d int")
    with pytest.raises(ValueError, match="a, c"):
        prepare.require_columns(df, ["c", "a", "b"])
    with pytest.raises(ValueError):
        prepare.require_rows(df.filter("b > 5"))


def test_mission_log_short_long_and_broken_rows(spark, tmp_path):
    from flightloom.schemas import LOG_COLUMNS

    names = list(LOG_COLUMNS)
    assert len(names) == 142
    row = {n: "0" for n in names}
    row.update(timestamp="1.500", latitude="18.520400", image_name="img_1.jpg", ahrs_valid="1", gps_fix_type="3D", yaw="oops")
    full = [row[n] for n in names]
    lines = [",".join(names), ",".join(full), ",".join(full[:136]), ",".join(full + ["extra"])]
    (tmp_path / "flight_log_7.csv").write_text("\n".join(lines) + "\n")
    kept, rejects = readers.read_mission_log(spark, str(tmp_path))
    got = kept.collect()
    assert len(got) == 2 and rejects.count() == 1
    assert got[0].mission_id == "mission_7" and got[0].latitude == 18.5204 and got[0].yaw is None and got[0].state is None
    assert got[0].ahrs_valid is True and got[0].image_name == "img_1.jpg"


def test_mission_logs_share_files_and_keep_their_missions(spark, tmp_path):
    from flightloom.schemas import LOG_COLUMNS

    names = [None, "", " a ", "b,c", 'd"e', "007", *[f"m{i}" for i in range(60)]]
    rows = [(n, float(t), 18.5 + t, f"img,{t}.jpg", t % 2 == 0, "not in the log") for n in names for t in (2, 0, 1)]
    df = spark.createDataFrame(rows, "mission_id string, timestamp double, latitude double, image_name string, ahrs_valid boolean, note string")
    want = sorted((str(r[0]), *r[1:5]) for r in rows)

    def read(path):
        kept, rejects = readers.read_mission_log(spark, path)
        assert kept.columns == ["mission_id", *LOG_COLUMNS] and rejects.count() == 0
        return sorted(map(tuple, kept.select(F.col("mission_id").cast("string"), "timestamp", "latitude", "image_name", "ahrs_valid").collect()), key=str)

    shared = tmp_path / "shared"
    writers.write_mission_log(df, str(shared))
    files = list(shared.rglob("*.csv"))
    assert 0 < len(files) <= int(spark.conf.get("spark.sql.shuffle.partitions")) < len(names)
    assert sorted((str(m), *rest) for m, *rest in read(str(shared))) == want
    # rows stand in order of mission and time, also within a file
    order = [[line.rsplit(",", 142)[0] for line in f.read_text().splitlines()[1:]] for f in sorted(files)]
    assert all(runs == sorted(runs) for runs in ([n for n in part if n.startswith("m")] for part in order))
    # a row that a comma shifted keeps its mission
    broken = files[0].read_text().splitlines()
    (shared / "part-broken.csv").write_text(f"{broken[0]}\nm5,{','.join(['1'] * 143)}\n")
    _, rejects = readers.read_mission_log(spark, str(shared))
    assert [(r.mission_id, r.line.count(",")) for r in rejects.collect()] == [("m5", 143)]
    # a folder for each mission has the columns of the log alone
    few, apart = df.filter("mission_id like 'm%'"), tmp_path / "apart"
    writers.write_mission_log(few, str(apart), folders=True)
    assert (next((apart / "mission_id=m7").glob("*.csv"))).read_text().splitlines()[0].split(",") == list(LOG_COLUMNS)
    assert read(str(apart)) == sorted((r[:5] for r in rows if str(r[0]).startswith("m")), key=str)
    # there, too, rows stand in order of time, whatever the type of the mission
    writers.write_mission_log(spark.range(4000).selectExpr("id % 7 as mission_id", "cast(id * 2741 % 4001 as double) as timestamp"), str(tmp_path / "numbers"), folders=True)
    for part in (tmp_path / "numbers").rglob("*.csv"):
        at = [float(line.split(",")[0]) for line in part.read_text().splitlines()[1:]]
        assert at == sorted(at)
    # nothing flown, nothing read
    writers.write_mission_log(df.filter("timestamp > 9"), str(tmp_path / "none"))
    assert read(str(tmp_path / "none")) == []


def test_dataset_log_has_every_column(spark, tmp_path):
    from flightloom.schemas import DATASET_COLUMNS, LOG_COLUMNS

    (tmp_path / "d.csv").write_text(",".join(DATASET_COLUMNS) + "\n" + "1,1,DATASET_TEST,,,,,,,,,,,a.jpg,1,,DATASET_TEST\n")
    out = readers.read_dataset_log(spark, str(tmp_path / "d.csv"))
    assert out.columns == ["mission_id", *LOG_COLUMNS]
    row = out.first()
    assert row.latitude is None and row.image_name == "a.jpg" and row.timestamp == 1.0


def test_ply_with_odd_property_order_and_faces(spark, tmp_path):
    text = "ply\nformat ascii 1.0\nelement vertex 3\nproperty float nx\nproperty float z\nproperty float x\nproperty float y\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n9 3 1 2\n9 6\n9 30 10 20\n3 0 1 2\n"
    (tmp_path / "cloud.ply").write_text(text)
    got = sorted((r.x, r.y, r.z) for r in readers.read_points(spark, str(tmp_path / "cloud.ply")).collect())
    assert got == [(1.0, 2.0, 3.0), (10.0, 20.0, 30.0)]


def test_calibration_files(spark, tmp_path):
    good = {"imu": {"gyro_bias_rads": [0.1, 0.2, 0.3], "mag_offset_ut": [1, 2]}, "barometer": {"sea_level_pressure_hpa": 2000}}
    (tmp_path / "flight_log_1.json").write_text(json.dumps(good))
    (tmp_path / "flight_log_2.json").write_text("[broken")
    rows = readers.read_calibration(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].bias == [0.1, 0.2, 0.3] and rows[0].offset is None and rows[0].sea_level_pressure_hpa is None


def test_image_listing_and_sinks(spark, tables, tmp_path):
    shots = tmp_path / "shots"
    shots.mkdir()
    for name in ("a.JPG", "b.png", "c.tif", "d.txt"):
        (shots / name).write_bytes(b"xyz")
    assert sorted(r.image_name for r in readers.list_images(spark, str(shots)).collect()) == ["a.JPG", "b.png"]
    assert readers.list_images(spark, str(shots), dataset=True).count() == 3
    few = tables.fx_capture.filter("mission_id < 2")
    writers.write_kml(few, str(tmp_path / "kml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "kml" / "mission_id=1").glob("*.txt")))
    import xml.dom.minidom

    xml.dom.minidom.parseString(text)
    cal = reports.calibrate(tables.fx_imu)
    writers.write_calibration(cal, str(tmp_path / "cal"))
    assert readers.read_calibration(spark, str(tmp_path / "cal")).count() == 15
    edges = pairs.candidate_graph(few)
    writers.write_edges(edges, str(tmp_path / "edges"))
    assert spark.read.option("header", True).csv(str(tmp_path / "edges/candidate_graph")).count() == edges.count()
    writers.write_report(reports.power_summary(tables.fx_power), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report/report")).count() == 15


def test_packet_stream_sink(spark, tables, tmp_path):
    from flightloom.streaming.streams import replay

    rows = tables.fx_capture.filter("mission_id < 2").select("mission_id", "seq", "t", F.col("seq").alias("telemetry_sequence"))
    writers.stream_packets(replay(rows, "seq", [30.0]), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = messages.parse_packets(spark.read.text(str(tmp_path / "out")))
    assert got.filter("packet.seq is not null").count() == rows.count()


def test_no_nested_loop_joins_in_pair_and_coverage_plans(spark, tables):
    for df in (pairs.spatial_pairs(pairs.image_nodes(tables.fx_capture)), coverage.covered_cells(coverage.footprints(tables.fx_capture))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_packet_is_parsed_once_for_all_its_fields(spark):
    lines = ['{"seq":3,"img":"a"}', ' {"t":1.5} ', "{}", "[1]", "garbled", "", None]
    out = messages.parse_packets(spark.createDataFrame([(x,) for x in lines], "value string"))
    seen = [(r.packet.seq, r.packet.img, r.packet.t) if r.packet else None for r in out.collect()]
    assert seen == [(3, "a", None), (None, None, 1.5), None, None, None, None, None]
    plan = out.filter("packet is not null").select("packet.*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") == 1


def test_hops_send_nothing_through_the_driver(spark, monkeypatch):
    rows = [(m, f"n{i:03d}", f"n{i + 1:03d}") for m in range(6) for i in range(3 + 4 * m)]
    edges = spark.createDataFrame(rows, "mission_id long, source string, target string")
    anchor = spark.createDataFrame([(m, "n000") for m in range(6)], "mission_id long, image_name string")
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: plans.append(df) or cut(df))
    got = {(r.mission_id, r.image_name): (r.hops, r.parent) for r in graph.reach(edges, anchor).collect()}
    assert got == {(m, f"n{i:03d}"): (i, f"n{i - 1:03d}" if i else None) for m in range(6) for i in range(4 + 4 * m)}
    hops = [t for t in (df._jdf.queryExecution().executedPlan().toString() for df in plans) if "LeftAnti" in t]
    assert hops and not any("Broadcast" in t for t in hops)


def test_components_keep_names_and_null_parts(spark):
    pairs = [((1, None), (1, "b")), ((1, "b"), (1, "c")), ((None, "x"), (None, "y")), ((2, "z"), (2, "z"))]
    node = "struct<m: long, n: string>"
    got = graph.connected_components(spark.createDataFrame(pairs, f"u {node}, v {node}")).collect()
    assert {(tuple(r.node), tuple(r.component)) for r in got} == {
        ((1, None), (1, None)), ((1, "b"), (1, None)), ((1, "c"), (1, None)), ((None, "x"), (None, "x")),
        ((None, "y"), (None, "x")), ((2, "z"), (2, "z")),
    } and len(got) == 6


def test_rounds_of_components_move_numbers(spark, monkeypatch):
    schemas, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: schemas.append(dict(df.dtypes)) or cut(df))
    graph.connected_components(spark.createDataFrame([("a", "b"), ("b", "c")], "u string, v string")).collect()
    assert all(s == {"u": "bigint", "v": "bigint"} for s in schemas[2:]) and len(schemas) > 3


def test_cells_are_grouped_where_they_are_listed(spark):
    df = spark.createDataFrame([capture_row(i, 18.52 + i / 5000, f"img_{i}.jpg") for i in range(40)], CAPTURE)
    shapes = coverage.footprints(df)
    cells = coverage.covered_cells(shapes, cells_a_task=500)
    counted = cells.groupBy("mission_id", "cx", "cy").count()
    # stretches are dealt to tasks, their cells are not
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and cells.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, coverage.covered_cells(shapes).collect()))


def test_a_python_task_sees_single_descriptors(spark):
    d = spark.createDataFrame([(n, i, [float(i * 7 % 11), float(i)]) for n in "ab" for i in range(9)], "image_name string, feature_id long, vec array<double>")
    edges = spark.createDataFrame([("a", "b")], "source string, target string")
    out = matching.ratio_matches(edges, d, 0.9, block=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "items_a" not in plan
    assert sorted((r.query_idx, r.train_idx, r.distance) for r in out.collect()) == [(i, i, 0.0) for i in range(9)]
