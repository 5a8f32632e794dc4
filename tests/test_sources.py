import json
from datetime import date, datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from stagecast.operators import upstream as u
from stagecast.operators import views
from stagecast.operators.coverage import IncompleteArchiveError, require_complete
from stagecast.operators.revisions import scan
from stagecast.schemas import REVISION
from stagecast.operators.events import event_state, event_transitions, transitions_and_state
from stagecast.sources import bulletins as b
from stagecast.sources import envelopes as v
from stagecast.sources import payloads as p
from stagecast.sources import tables as t
from stagecast.sources.basins import basins
from stagecast.streaming import events as se
from stagecast.streaming import compaction as sc
from stagecast.streaming import ingest as si

AT = datetime(2026, 1, 1)


def revision(gauge="05464500", value=4.2, payload="abc", at=AT):
    return ("usgs", f"series-{gauge}", gauge, "00065", at, value, "ft", at, at, None, [], None, payload, {"archive_hash": "raw"})


def test_envelope_round_trip(spark):
    rows = spark.createDataFrame([revision(at=datetime(2026, 1, 1, 1, 2, 3, 456789))], REVISION)
    encoded = v.encode(rows)
    assert encoded.first().key == "05464500"
    assert json.loads(encoded.first().value)["schema_version"] == 1
    assert v.decode(encoded).select(*rows.columns).collect() == rows.collect()


@pytest.mark.parametrize(
    "text,reason",
    [
        ('{"schema_version":2}', "unsupported observation event"),
        ("not json", "unsupported observation event"),
        ('{"schema_version":1,"event_type":"observation_revision","observation":{},"raw_payload":"x"}', "no raw payload object"),
        ('{"schema_version":1,"event_type":"observation_revision","observation":{"source":"usgs"},"raw_payload":{}}', "incomplete observation"),
    ],
)
def test_broken_contracts_become_dead_letters(spark, text, reason):
    rows = spark.createDataFrame([(text,)], "value string")
    assert v.decode(rows).count() == 0
    assert [r.reason for r in v.dead_letters(rows).collect()] == [reason]


def test_payload_features(spark):
    features = [
        {"properties": {"value": "4.5", "time": "2024-01-01T00:00:00Z", "time_series_id": "a", "approval_status": "Approved", "qualifier": ["ICE"]}},
        {"properties": {"value": -999999, "datetime": "2024-01-01T01:00:00+01:00"}},
        {"properties": {"value": None, "phenomenonTime": "2024-01-01T00:30:00Z", "monitoring_location_id": "USGS-1", "unit_of_measure": "m"}},
        {"properties": {"value": "1.0"}},
        {"properties": {"value": "bad", "time": "2024-01-01T00:45:00Z"}},
    ]
    rows = spark.createDataFrame([("g", "00065", AT, json.dumps({"features": features}))], "gauge_id string, parameter_code string, ingested_at timestamp, payload string")
    got = p.payload_observations(rows).orderBy("event_time", "value").collect()
    assert [(r.time_series_id, r.value, r.unit, r.approved, r.qualifiers) for r in got] == [
        ("g", None, "ft", False, []), ("a", 4.5, "ft", True, ["ICE"]), ("USGS-1", None, "m", False, []),
    ]
    assert got[0].event_time == got[1].event_time == datetime(2024, 1, 1)
    assert [r.reason for r in p.payload_errors(rows).collect()] == ["unreadable value"]


def test_thresholds_drop_what_is_no_stage(spark):
    text = json.dumps({"flood": {"categories": {"minor": {"stage": 12}, "major": {"stage": -9999}, "note": "x", "empty": {}}}})
    rows = spark.createDataFrame([("g", "n", AT, text), ("h", "m", AT, "{}")], "gauge_id string, nwps_id string, captured_at timestamp, metadata string")
    snapshots = p.station_snapshots(rows)
    assert [(r.threshold_name, r.threshold) for r in p.threshold_rows(snapshots).collect()] == [("minor", 12.0)]
    assert {r.gauge_id: r.datum for r in snapshots.collect()} == {"g": [], "h": []}
    assert p.changed_snapshots(snapshots, snapshots.where("gauge_id = 'g'")).first().gauge_id == "h"


def bulletin(spark, *lines):
    df = spark.createDataFrame([(1, "\n".join(lines))], "bulletin_id bigint, text string")
    return b.bulletin_values(df).orderBy("line", "valid_at").collect(), b.bulletin_errors(df).orderBy("line").collect()


def test_bulletin_sequence(spark):
    values, errors = bulletin(spark, ".E CIDI4 20240628 Z /DC202406281446/DH15/DIH06/HGIFF 10.1/11.2/M/13.0")
    assert errors == [] and [r.value for r in values] == [10.1, 11.2, None, 13.0]
    assert values[1].valid_at == datetime(2024, 6, 28, 21) and values[0].created_at == datetime(2024, 6, 28, 14, 46)


def test_bulletin_errors(spark):
    values, errors = bulletin(spark, ".B UNKNOWN")
    assert values == [] and len(errors) == 1


def test_continuations_follow_the_last_good_header(spark):
    values, errors = bulletin(
        spark,
        ".E1 /9.9",
        ".ER AAAA1 20240628 Z /DH00/DIH1/HGIFF 1/2",
        ".E1 /3/bad/5",
        ".E BBBB1 20240628 Q /DH00/DIH1/HGIFF 7",
        "free text",
        ".E2 /3 / 4 x",
        ".AR CCCC1 20240628 E /DH1830/HGIFFX 20.5",
        ".E3 /M",
        ".E DDDD1 20240628 Z /DH00/DIH1/HGIFF 8/oops",
        ".E4 /6",
    )
    assert [(r.line, r.station, r.valid_at.hour, r.value, r.is_crest) for r in values] == [
        (1, "AAAA1", 0, 1.0, False), (1, "AAAA1", 1, 2.0, False),
        (2, "AAAA1", 2, 3.0, False),
        (5, "AAAA1", 2, 3.0, False), (5, "AAAA1", 3, 4.0, False),
        (6, "CCCC1", 22, 20.5, True),
        (7, "AAAA1", 4, None, False),
        (8, "DDDD1", 0, 8.0, False),
        (9, "AAAA1", 5, 6.0, False),
    ]
    assert [(r.line, r.reason) for r in errors] == [
        (0, "unsupported construct"), (2, "unreadable value"),
        (3, "missing or unreadable date, zone, interval or forecast-stage parameter"), (8, "unreadable value"),
    ]


def test_bulletins_are_worked_out_inside_their_rows(spark):
    text = ".E AAAA1 20240628 Z /DH00/DIH1/HGIFF 1\r\n.E1 /2\n.B X"
    rows = [(1, text), (1, text), (2, ".E1 /5"), (3, None), (4, ""), (None, text)]
    df = spark.createDataFrame(rows, "bulletin_id bigint, text string")
    values = b.bulletin_values(df)
    got = [(r.bulletin_id, r.line, r.valid_at.hour, r.value) for r in values.collect()]
    own = [(0, 0, 1.0), (1, 1, 2.0)]
    assert sorted(got, key=repr) == sorted([(i, *v) for i in (1, 1, None) for v in own], key=repr)
    errors = [(r.bulletin_id, r.line) for r in b.bulletin_errors(df).collect()]
    assert sorted(errors, key=repr) == sorted([(1, 2), (1, 2), (2, 0), (None, 2)], key=repr)
    shuffled = spark.range(2).selectExpr("id AS bulletin_id", "'.E1 /5' AS text")
    for found in (b.bulletin_values(shuffled), b.bulletin_errors(shuffled)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 3, 10_000])
def test_bulletin_lines_are_rows_before_they_are_parsed(spark, size):
    good = ".E AAAA1 20240628 Z /DH00/DIH1/HGIFF 1/M"
    first = "\r\n".join([".E1 /9", good, ".E1 /2", "\t.E2 \t/+3.0\tx / -999.5 ", ".E BBBB1 2024 Z /DH00/DIH1/HGIFF 7", ".E3 /5", ".E4"])
    rows = [(1, first), (1, ".E1 /8"), (1, first), (2, None), (2, f"{good}\x85.E1 /4")]
    df = spark.createDataFrame(rows, "bulletin_id bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        found = b.bulletin_values(df)
        got = sorted((r.bulletin_id, r.line, r.valid_at.hour, r.value or -1.0) for r in found.collect())
        errors = sorted((r.bulletin_id, r.line) for r in b.bulletin_errors(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    mine = [(1, 1, 0, 1.0), (1, 1, 1, -1.0), (1, 2, 2, 2.0), (1, 3, 3, 3.0), (1, 3, 4, -999.5), (1, 5, 5, 5.0)]
    assert got == sorted(mine + mine + [(2, 0, 0, 1.0), (2, 0, 1, -1.0), (2, 1, 2, 4.0)])
    assert errors == [(1, 0), (1, 0), (1, 0), (1, 4), (1, 4), (1, 6), (1, 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def test_header_parts_go_to_python_once_as_plain_columns(spark):
    df = spark.range(2).selectExpr("id AS bulletin_id", "'.E1 /5' AS text")
    plan = b.bulletin_values(df)._jdf.queryExecution().executedPlan().toString()
    passed = next(line for line in plan.splitlines() if "MapInArrow" in line)
    assert "own#" not in passed and passed.count("station#") == 2  # once in, once out
    assert "struct(station" not in plan


def test_even_data_are_cast_like_words(spark):
    head = ".E AAAA1 20240628 Z /DC202406281446/DH15/DIH06/HGIFF "
    values, errors = bulletin(spark, head + "1.5/+2/-.5/3e2", ".E1 /4 / 5.//6", ".E2 /1/1-2/3", ".E3 /7/M/8 x", ".E4 /1d/2", ".E5 /")
    assert [(r.line, r.value) for r in values] == [
        (0, 1.5), (0, 2.0), (0, -0.5), (0, 300.0), (1, 4.0), (1, 5.0), (1, 6.0), (2, 1.0), (3, 7.0), (3, None), (3, 8.0)
    ]
    assert [(r.line, r.reason) for r in errors] == [(2, "unreadable value"), (4, "unreadable value")]
    assert {r.created_at for r in values} == {datetime(2024, 6, 28, 14, 46)}


def test_values_under_one_header_are_numbered_on(spark):
    lines = [".E AAAA1 20240101 Z /DH00/DIH1/HGIFF 0"]
    lines += [f".E{i} /{'/'.join(map(str, range(3 * i - 2, 3 * i + 1)))}" for i in range(1, 201)]
    values, errors = bulletin(spark, *lines)
    start = datetime(2024, 1, 1)
    assert errors == [] and len(values) == 601
    assert all((r.valid_at - start).total_seconds() == 3600 * r.value for r in values)


SERIES = """id string, monitoring_location_id string, parameter_code string, statistic_id string, primary string,
    computation_period_identifier string, begin string, end string"""


def test_only_primary_instantaneous_series_count(spark):
    rows = spark.createDataFrame(
        [
            ("good", "USGS-1", "00065", "00011", "Primary", "Points", "2010-01-01T00:00:00Z", "2026-01-01T00:00:00Z"),
            ("late", "USGS-1", "00065", "00011", "Primary", "Points", "2011-01-01T00:00:00Z", "2026-01-01T00:00:00Z"),
            ("daily", "USGS-1", "00065", "00003", "Primary", "Daily", "2010-01-01T00:00:00Z", "2026-01-01T00:00:00Z"),
        ],
        SERIES,
    )
    assert [r.id for r in u.preferred_series(rows).collect()] == ["good"]


def candidates(spark, target, rows):
    return spark.createDataFrame(
        [(target, g, stem, "s", "d" if both else None, overlap) for g, stem, both, overlap in rows],
        """target_id string, gauge_id string, is_target_mainstem boolean, stage_series_id string,
        discharge_series_id string, nominal_overlap_fraction double""",
    )


def test_target_is_no_candidate(spark):
    topology = spark.createDataFrame(
        [("9", 0, "USGS-9", "target", "m", 1), ("9", 1, "USGS-1", "up", "m", 2)],
        "target_id string, pos int, identifier string, name string, mainstem string, comid bigint",
    )
    series = spark.createDataFrame([("1", "00065", "s", "2007-10-01T00:00:00Z", "2026-09-13T00:00:00Z")], "gauge_id string, parameter_code string, id string, begin string, end string")
    found = u.connected_candidates(topology, series, date(2007, 10, 1), date(2026, 9, 13))
    got = u.select_candidates(found).collect()
    assert [(r.gauge_id, r.is_target_mainstem) for r in got] == [("1", True)]


def test_selection_and_lean_selection(spark):
    rows = [(f"m{i}", True, True, 0.9 - i / 100) for i in range(7)] + [(f"t{i}", False, True, 0.9) for i in range(5)] + [("short", False, True, 0.4)]
    got = u.select_candidates(candidates(spark, "x", rows))
    assert [r.gauge_id for r in got.orderBy("rank").collect()] == ["m0", "m1", "m2", "m3", "m4", "t0", "t1", "t2"]
    assert [r.gauge_id for r in u.lean_selection(got).orderBy("rank").collect()] == ["m0", "m1", "m2", "t0"]


def test_required_proxy_replaces_the_last(spark):
    rows = [(f"m{i}", True, True, 0.9) for i in range(6)] + [(f"t{i}", False, True, 0.9) for i in range(4)] + [("02087183", False, False, 0.1)]
    got = u.select_candidates(candidates(spark, "02089000", rows))
    assert [r.gauge_id for r in got.orderBy("rank").collect()][-2:] == ["t1", "02087183"] and got.count() == 8
    assert "02087183" in [r.gauge_id for r in u.lean_selection(got).collect()]


def test_partial_archives_are_refused(spark):
    rows = spark.createDataFrame([("g", "00060", 3, 5)], "gauge_id string, parameter_code string, complete bigint, required bigint")
    with pytest.raises(IncompleteArchiveError, match="g/00060 3 of 5"):
        require_complete(rows)
    require_complete(rows.where("complete > 9"))


def test_manifest_is_written_once_and_notices_drift(spark, tmp_path):
    lags = spark.createDataFrame([("target", "upstream", 12, True), ("target", "other", 3, False)], "target_id string, gauge_id string, lag_hours int, suitable boolean")
    frozen = t.manifest(lags, {"report": lags}, date(2026, 9, 13))
    path = str(tmp_path / "manifest")
    t.freeze(frozen, path)
    stored = spark.read.parquet(path)
    assert [tuple(r) for r in t.frozen_lags(stored).collect()] == [("target", "upstream", 12)]
    with pytest.raises(AnalysisException):
        t.freeze(frozen, path)
    t.require_unchanged(stored, "report", lags.orderBy("gauge_id"))
    with pytest.raises(t.FrozenInputChanged):
        t.require_unchanged(stored, "report", lags.withColumn("lag_hours", F.lit(1)))


def test_direct_batches_store_a_revision_once(spark, tmp_path):
    rows = spark.createDataFrame([revision(), revision(payload="b"), revision()], REVISION)
    for _ in range(2):
        si.ingest(rows, "direct", str(tmp_path))
    assert si.revisions_table(spark, str(tmp_path)).count() == 2
    assert [tuple(r) for r in si.high_water_table(spark, str(tmp_path)).select("series_key", "event_time").collect()] == [("series-05464500", AT)]


def test_a_batch_reads_only_its_months(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(sc, "read_parts", lambda s, path, parts, schema: asked.append(sorted({p.split("/batch_id")[0] for p in parts})) or t.read_parts(s, path, parts, schema))
    for batch, at in enumerate((datetime(2020, 5, 1), datetime(2026, 1, 1))):
        si.ingest(spark.createDataFrame([revision(at=at)], REVISION), "direct", str(tmp_path), batch_id=batch)
    si.ingest(spark.createDataFrame([revision(at=datetime(2020, 5, 1)), revision(at=datetime(2026, 1, 1))], REVISION), "direct", str(tmp_path), batch_id=2)
    si.ingest(spark.createDataFrame([revision(at=datetime(2020, 5, 1))], REVISION), "direct", str(tmp_path), batch_id=3)
    both = ["parameter_code=00065/event_month=2020-05", "parameter_code=00065/event_month=2026-01"]
    assert [parts for parts in asked if parts] == [both, both[:1]]
    assert si.revisions_table(spark, str(tmp_path)).count() == 2


def test_reads_prune_months(spark, tmp_path):
    rows = [revision(at=datetime(2024, m, 1), payload=str(m)) for m in range(1, 13)]
    si.ingest(spark.createDataFrame(rows, REVISION), "direct", str(tmp_path))
    found = scan(si.revisions_table(spark, str(tmp_path)), start=datetime(2024, 3, 1), before=datetime(2024, 5, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "event_month" in filters and "2024-03" in filters and "2024-05" in filters
    assert found.count() == 2


def test_basin_by_any_identifier(spark):
    asked = spark.createDataFrame([("cedar-ia",), ("05464500",), ("CIDI4",), ("nowhere",)], "identifier string")
    assert {r.target_name for r in views.basin_for(basins(spark), asked).collect()} == {"Cedar Rapids"}
    assert views.basin_for(basins(spark), asked).count() == 3


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    first = v.encode(spark.createDataFrame([revision(), revision(payload="b")], REVISION)).select("value")
    second = v.encode(spark.createDataFrame([revision(), revision("02089000", payload="c")], REVISION)).select("value")
    for batch, events in ((0, first), (1, second), (1, second), (0, first)):
        si.ingest_batch(events, batch, root)
    table = si.revisions_table(spark, root)
    assert sorted(r.payload_hash for r in table.collect()) == ["abc", "b", "c"]
    assert si.high_water_table(spark, root).count() == 2


def test_a_join_with_a_table_not_there_yet_shuffles_nothing(spark, tmp_path):
    readings = spark.range(3).selectExpr("CAST(id AS string) AS gauge_id", "id AS seq")
    last = se.state_table(spark, str(tmp_path), -1).select("gauge_id", "last_seq")
    placed = readings.join(last, "gauge_id", "left")
    assert [r.last_seq for r in placed.collect()] == [None] * 3
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()


def test_transitions_and_state_share_the_batches_below(spark):
    stages = [2.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0]
    rows = spark.createDataFrame(
        [(g, i, AT, f"b{i}", v, 1.0, False) for g in ("a", "b") for i, v in enumerate(stages)], se.READING
    )
    transitions, state, below = transitions_and_state(rows, width=2)
    below.persist()
    try:
        for found, want in ((transitions, event_transitions(rows, width=2)), (state, event_state(rows, width=2))):
            assert "InMemoryTableScan" in found.select("*")._jdf.queryExecution().executedPlan().toString()
            assert sorted(found.collect()) == sorted(want.collect())
    finally:
        below.unpersist()
    assert sorted((r.gauge_id, r.open, len(r.below_batches)) for r in state.collect()) == [("a", True, 2), ("b", True, 2)]


def test_event_state_is_carried_between_batches(spark, tmp_path):
    root = str(tmp_path)

    def batch(n, *readings):
        rows = [("g", seq, AT, b, stage, 12.0, False) for seq, b, stage in readings]
        se.observe_batch(spark.createDataFrame(rows, se.READING), n, root)

    batch(0, (0, "a", 13.0), (1, "b", 11.0))
    batch(1, (2, "b", 11.0), (3, "c", 11.0))
    assert se.state_table(spark, root, 1).first().below_batches == ["b", "c"]
    batch(2, (4, "d", 11.0), (5, "e", 11.0), (6, "f", 13.0))
    got = sorted((r.seq, r.transition) for r in se.transition_table(spark, root).collect())
    assert got == [(0, "observed_flooding"), (4, "resolved"), (6, "observed_flooding")]


def test_late_readings_are_set_aside_and_worked_in(spark, tmp_path):
    root = str(tmp_path)
    make = lambda *r: spark.createDataFrame([("g", seq, AT, b, stage, 12.0, False) for seq, b, stage in r], se.READING)
    first, second, late = [(-3, "a", 13.0), (-1, "b", 11.0)], [(5, "c", 11.0)], [(2, "x", 13.0), (6, "d", 11.0)]
    for n, part in enumerate((first, second, late)):
        se.observe_batch(make(*part), n, root)
    assert [r.seq for r in se.late_table(spark, root).collect()] == [2]
    assert sorted(r.seq for r in se.transition_table(spark, root).collect()) == [-3, 6]
    whole = make(*first, *second, *late)
    assert sorted((r.seq, r.transition) for r in se.corrected(spark, root, whole).collect()) == [(-3, "observed_flooding")]
    state = se.corrected_state(spark, root, 2, whole).first()
    assert state.open and state.below_batches == ["c", "d"] and state.last_seq == 6


def test_a_lost_state_is_an_error(spark, tmp_path):
    with pytest.raises(t.MissingTable):
        se.observe_batch(spark.createDataFrame([("g", 1, AT, "a", 13.0, 12.0, False)], se.READING), 3, str(tmp_path))


def test_both_ingestion_modes_lead_to_the_same_table(spark, tmp_path):
    rows = spark.createDataFrame([revision(), revision(payload="b"), revision("02089000", payload="c")], REVISION)
    landing = str(tmp_path / "landing")
    si.ingest(rows, "direct", str(tmp_path / "direct"), landing)
    si.ingest(rows, "streaming", str(tmp_path / "stream"), landing)
    si.run_available(si.file_values(spark, landing), str(tmp_path / "stream"), str(tmp_path / "checkpoint"))
    keys = ["gauge_id", "event_time", "payload_hash", "value"]
    direct = si.revisions_table(spark, str(tmp_path / "direct")).select(keys)
    streamed = si.revisions_table(spark, str(tmp_path / "stream")).select(keys)
    assert sorted(direct.collect()) == sorted(streamed.collect()) and direct.count() == 3
    with pytest.raises(ValueError):
        si.ingest(rows, "both", str(tmp_path), landing)
