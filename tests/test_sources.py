"""Text readers, raw tables, payloads, upserts, ledger, replayed batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import metric
from levelfield.functions import parse, text
from levelfield.operators import quality
from levelfield.session import shared_folder
from levelfield.sources import payloads, shaping, sinks
from levelfield.streaming.incremental import incremental_upsert


def read(make, expression, values, kind="string"):
    df = make(f"i int, v {kind}", [(i, v) for i, v in enumerate(values)])
    return [r[1] for r in df.select("i", expression("v")).orderBy("i").collect()]


def test_readers(make):
    assert read(make, parse.slugify, ["Playing Time", "SoT%", "Take-Ons", "1/3"]) == [
        "playing_time", "sot_pct", "take_ons", "1_3"]
    assert read(make, parse.parse_age, ["27-104", "22", "", "x", None]) == [27, 22, None, None, None]
    assert read(make, parse.parse_nation, ["es ESP", "fra", " ", None]) == ["ESP", "FRA", None, None]
    assert read(make, parse.split_positions, ["DF,MF", "fw , mf", "D S", "XX", None]) == [
        ["DF", "MF"], ["FW", "MF"], ["DF"], [], []]
    assert read(make, parse.parse_amount, [
        "150000000", "€12.00m", "€900k", "1.5bn", "Free transfer", "?", "", "1.2.3", None]) == [
        150000000.0, 12000000.0, 900000.0, 1500000000.0, None, None, None, None, None]
    assert read(make, parse.classify_transfer, [
        "Loan transfer", "Free transfer", "€12.00m", "End of loan", "-", "0", None]) == [
        "cesion", "libre", "traspaso", "fin_cesion", None, None, None]
    day = datetime.date(2020, 7, 31)
    assert read(make, parse.parse_date, ["2020-07-31", "Jul 31, 2020", "31/07/2020", "ayer", None]) \
        == [day, day, day, None, None]
    assert read(make, parse.season_code, [datetime.date(2026, 9, 8), datetime.date(2026, 3, 1),
                                          datetime.date(1999, 12, 1)], "date") == [
        "2627", "2526", "9900"]
    assert read(make, parse.season_label, ["2627", "raro"]) == ["26/27", "raro"]
    assert read(make, parse.season_span, ["2526", "9900", "x"]) == ["2025-2026", "1999-2000", None]
    assert read(make, parse.format_amount, [1234567890.0, None], "double") == [
        "1.234.6 M EUR", "-"]
    assert read(make, parse.to_percentile, [12.5, 13.5, 140.0, -3.0, None], "double") == [
        12, 14, 100, 0, None]
    assert read(make, text.normalise_name, ["Iñaki Peña", "A. García-López", "ﬁn Ĳ"]) == [
        "inaki pena", "a garcia lopez", "fin ij"]
    assert read(make, lambda c: text.file_slug(c, F.lit("2627"), F.lit("per90")),
                ["Nico Williams"]) == ["nico-williams-2627-per90.png"]


METRICS = (
    metric("goals", "Goals", "standard", column="performance_gls"),
    metric("extra", "Extra", "standard", "optional"),
)


def test_headers_and_metrics(make):
    raw = make("`Unnamed: 0_level_0` struct<player: string>, Performance struct<Gls: string>, "
               "`Per 90 Minutes` struct<Gls: string>", [(("a",), ("3",), ("1",)),
                                                        (("b",), ("x",), ("1",))])
    flat = shaping.flatten_headers(raw)
    assert flat.columns == ["player", "performance_gls"]
    got = shaping.select_metrics(flat, METRICS, "standard", ["player"]).collect()
    assert [(r.player, r.goals, r.extra) for r in got] == [("a", 3.0, None), ("b", None, None)]
    with pytest.raises(shaping.MissingColumnsError):
        shaping.select_metrics(flat.drop("performance_gls"), METRICS, "standard")


def test_keys_and_outer_merge(make):
    keys = "league string, season string, team string, player string"
    one = make(f"{keys}, a int", [("L", "s", "T", " p ", 1), ("L", "s", "T", "q", 2)])
    two = make(f"{keys}, b int", [("L", "s", "T", "q", 3), ("L", "s", None, "r", 4),
                                  ("L", "s", "T", " ", 5)])
    merged = shaping.merge_sources({"one": one, "two": two, "none": two.where("b > 9")})
    kept = shaping.normalise_keys(merged)
    assert {(r.player, r.a, r.b) for r in kept.collect()} == {("p", 1, None), ("q", 2, 3)}


def test_shots(make):
    raw = make("shot_id string, date string, player_id string, minute string, xg string, "
               "location_x string, location_y string, situation string, result string",
               [("1", "2026-08-10 20:00", "p", "5", "0.76", "0.885", "0.5", None, "Goal"),
                ("2", "2026-08-10", "p", "9", "nan", "0.70", "0.5", None, "Miss"),
                ("1", "2026-08-10 20:00", "p", "5", "0.76", "0.885", "0.5", None, "Goal"),
                (None, "2026-08-10", "p", "9", "0.1", "0.70", "0.5", "Open", "Miss")])
    got = {r.shot_id: r for r in shaping.build_shots(raw).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].situation == "Penalty" and got["1"].match_date == datetime.date(2026, 8, 10)
    assert got["2"].situation is None and got["2"].xg is None


def test_payloads(make):
    df = make("entity_id string, payload string", [
        ("1", '{"marketValueHistory": [{"age": 20, "date": "Jul 1, 2024", "clubName": "A", '
              '"marketValue": 60000000}, {"date": "?", "clubName": null}]}'),
        ("2", "{}")])
    got = payloads.flatten_history(df).collect()
    assert [(r.entity_id, r.market_value, r.age_at_time) for r in got] == [("1", 6e7, 20)]
    assert {r.entity_id: r.clubs for r in payloads.club_history(df).collect()} == {
        "1": ["A"], "2": []}


def test_guards(make):
    df = make("a string, b string", [("1", None), ("x", ""), (None, None), ("y", "2")])
    assert quality.fill_rate(df, ["a", "b"]).first().fill_rate == 0.5
    assert quality.check_complete(df, ["a", "b"]) is df
    with pytest.raises(quality.IncompleteTableError):
        quality.check_complete(df, ["b"])
    assert len(catalog.template_axes()) == 24


def test_keys_of_white_space_are_dropped(make):
    df = make("k string, v int", [("\t", 1), ("\u3000\u2009", 2), ("\x1c", 3), (" a\u00a0", 4), (None, 5), ("", 6)])
    assert [tuple(r) for r in shaping.normalise_keys(df, ["k"]).collect()] == [("a", 4)]


SCHEMA = "k string, a int, b string, updated_at timestamp"


def test_upsert_changes_only_what_it_brings(make):
    old = datetime.datetime(2024, 1, 1)
    current = make(SCHEMA, [("x", 1, "keep", old), ("y", 2, "stay", old)])
    batch = make("k string, a int", [("x", None), ("z", 9)])
    now = F.lit("2025-01-01").cast("timestamp")
    got = {r.k: r for r in sinks.merge_batch(current, batch, ["k"], now).collect()}
    assert got["x"].a is None and got["x"].b == "keep" and got["x"].updated_at.year == 2025
    assert got["y"].a == 2 and got["y"].updated_at == old
    assert got["z"].a == 9 and got["z"].b is None
    safe = sinks.merge_batch(current, make("k string, a int, b string", [("x", 5, "lost")]),
                             ["k"], now, protected=["b"])
    assert {r.k: (r.a, r.b) for r in safe.collect()}["x"] == (5, "keep")


def folder(spark, name):
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def test_snapshot_table(spark, make):
    table = sinks.SnapshotTable(spark, folder(spark, "snap"), "t", SCHEMA, ["k"])
    assert table.current().count() == 0
    batch = make("k string, a int", [("x", 1), ("x", 1), ("y", 2)])
    assert table.upsert(batch, ["a"]) == 2
    assert table.upsert(batch, ["a"]) == 2
    open_run = table.start()
    with pytest.raises(sinks.AlreadyRunningError):
        table.upsert(batch)
    later = datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(hours=5)
    assert table.start(later) != open_run  # the first is stale by then
    with pytest.raises(sinks.AlreadyRunningError):
        table.start()
    assert {(r.k, r.a) for r in table.current().collect()} == {("x", 1), ("y", 2)}


def test_untouched_buckets_keep_their_files(spark, make):
    table = sinks.SnapshotTable(spark, folder(spark, "buckets"), "t", SCHEMA, ["k"], buckets=8)
    table.upsert(make("k string, a int", [(str(i), i) for i in range(100)]))
    before = set(table.current().inputFiles())
    assert table.upsert(make("k string, a int", [("7", 70), ("new", 1)])) == 101
    after = set(table.current().inputFiles())
    assert 0 < len(after - before) <= 2 and len(before & after) >= 6
    got = {r.k: r.a for r in table.current().collect()}
    assert got["7"] == 70 and got["new"] == 1 and got["8"] == 8 and len(got) == 101


def test_whole_error_is_recorded(spark, make):
    table = sinks.SnapshotTable(spark, folder(spark, "error"), "t", SCHEMA, ["k"])
    with pytest.raises(Exception):
        table.upsert(make("k string, a int", [("x", 7)]).withColumn(
            "a", F.expr("raise_error(repeat('long ', 400))")))
    assert len(table.ledger().where("status = 'failed'").first().error) > 2000
    table.upsert(make("k string, a int", [("x", 1)]))


def test_failed_load_is_invisible(spark, make):
    table = sinks.SnapshotTable(spark, folder(spark, "fail"), "t", SCHEMA, ["k"])
    table.upsert(make("k string, a int", [("x", 1)]))
    bad = make("k string, a int", [("x", 7)]).withColumn("a", F.expr("raise_error('broken')"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    assert table.current().first().a == 1
    states = sinks.run_states(table.ledger(), F.current_timestamp())
    assert {r.status for r in states.collect()} == {"success", "failed"}
    assert sinks.data_version(states).first().version != catalog.NO_DATA_VERSION
    empty = sinks.run_states(table.ledger().limit(0), F.current_timestamp())
    assert sinks.data_version(empty).first().version == catalog.NO_DATA_VERSION


def test_stream_reads_each_file_once(spark, make):
    base = folder(spark, "stream")
    table = sinks.SnapshotTable(spark, base, "t", SCHEMA, ["k"])
    schema = make("k string, a int", []).schema

    def run():
        incremental_upsert(spark, f"{base}/in", schema, table, f"{base}/mark", ["a"],
                           files_per_batch=1).awaitTermination()
        return {(r.k, r.a) for r in table.current().collect()}

    make("k string, a int", [("x", 1)]).coalesce(1).write.parquet(f"{base}/in")
    assert run() == {("x", 1)}
    make("k string, a int", [("x", 3), ("y", 2)]).coalesce(1).write.mode("append").parquet(
        f"{base}/in")
    assert run() == {("x", 3), ("y", 2)}
    assert run() == {("x", 3), ("y", 2)}


def test_keys_of_another_type_lose_no_row(spark, make):
    """A double, a text and a date as text land where their numbers, and dates, are."""
    table = sinks.SnapshotTable(spark, folder(spark, "types"), "t", "id bigint, a int", ["id"])
    table.upsert(make("id bigint, a int", [(i, i) for i in range(20)]))
    assert table.upsert(make("id double, a int", [(float(i), i + 100) for i in range(10, 30)])) == 30
    assert table.upsert(make("id string, a int", [(str(i), i + 500) for i in range(25, 35)])) == 35
    got = {r.id: r.a for r in table.current().collect()}
    assert got == {i: i if i < 10 else i + 100 if i < 25 else i + 500 for i in range(35)}
    for bad in (make("id double, a int", [(1.5, 1)]), make("id string, a int", [("x", 1)])):
        with pytest.raises(sinks.KeyTypeError):
            table.upsert(bad)
    assert table.current().count() == 35
    dated = sinks.SnapshotTable(spark, folder(spark, "dates"), "t", "d date, a int", ["d"])
    dated.upsert(make("d date, a int", [(datetime.date(2024, 1, 1), 1)]))
    assert dated.upsert(make("d string, a int", [("2024-01-01", 2), ("2024-01-02", 3)])) == 2


def test_rows_without_a_key_are_counted(spark, make):
    table = sinks.SnapshotTable(spark, folder(spark, "nulls"), "t", "k string, l int, a int", ["k", "l"])
    rows = [("x", 1, 1), (None, 1, 2), ("y", None, 3), (None, None, 4), ("x", 2, 5)]
    assert table.upsert(make("k string, l int, a int", rows)) == 2
    assert [r.skipped for r in table.ledger().where("status = 'success'").collect()] == [3]


def test_a_table_grows_by_splitting_buckets(spark, make):
    """Doubled twice: nothing is lost, few buckets are written, old files go."""
    table = sinks.SnapshotTable(spark, folder(spark, "grow"), "t", "k int, a int", ["k"], buckets=4, bucket_rows=50)
    want = {}
    for start in range(0, 800, 100):
        rows = [(k, k + start) for k in range(start, start + 100)]
        want |= dict(rows)
        assert table.upsert(make("k int, a int", rows)) == len(want)
        assert {r.k: r.a for r in table.current().collect()} == want
    width, runs = table._state()
    assert width == 16 and set(runs) == set(range(16))
    before = set(table.current().inputFiles())
    # One more row over the limit splits one bucket; its own bucket and those two are written.
    assert table.upsert(make("k int, a int", [(5, -5)])) == 800
    after = set(table.current().inputFiles())
    assert table._state()[0] == 17 and len(before & after) >= 14
    gone = table.tidy(keep_hours=0.0, now=datetime.datetime.now(datetime.timezone.utc) + datetime.timedelta(seconds=5))
    assert gone > 10 and set(table.current().inputFiles()) == after
    assert {r.k: r.a for r in table.current().collect()} == want | {5: -5}
    stored = table.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(table.root).select("path")
    data = [r.path for r in stored.collect() if "__bucket" in r.path]
    assert len(data) == len(after)
    assert table.ledger().where("status = 'success'").count() == 9
    assert table.upsert(make("k int, a int", [(900, 1)])) == 801


@pytest.mark.parametrize("first", [1, 3, 4])
def test_buckets_of_a_growing_table(make, first):
    """A key moves only from the bucket that is split to the one that is new."""
    df = make("k int", [(k,) for k in range(300)])
    mark = F.xxhash64("k")
    at = {w: [r[0] for r in df.select(sinks.bucket_of(mark, first, w)).collect()] for w in range(first, 4 * first + 2)}
    for w in range(first, 4 * first + 1):
        assert set(at[w]) <= set(range(w))
        moved = {(a, b) for a, b in zip(at[w], at[w + 1]) if a != b}
        assert moved <= {(sinks.split_from(w, first), w)}


def test_a_batch_killed_before_its_commit_is_loaded_once(spark, make, monkeypatch):
    table = sinks.SnapshotTable(spark, folder(spark, "kill"), "t", "k string, a int", ["k"])
    batch = make("k string, a int", [("x", 1), ("y", 2)])
    real = table._record

    def killed(run_id, status, **values):
        if status in ("success", "failed"):
            raise KeyboardInterrupt
        real(run_id, status, **values)

    monkeypatch.setattr(table, "_record", killed)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch, source="stream", number=7)
    monkeypatch.undo()
    assert table.current().count() == 0
    with pytest.raises(sinks.AlreadyRunningError):
        table.upsert(batch, source="another", number=7)
    assert table.upsert(batch, source="stream", number=7) == 2  # the mark was its own
    files = set(table.current().inputFiles())
    assert table.upsert(make("k string, a int", [("x", 99)]), source="stream", number=7) == 2
    assert set(table.current().inputFiles()) == files
    assert table.ledger().where("status = 'success'").count() == 1
    assert {(r.k, r.a) for r in table.current().collect()} == {("x", 1), ("y", 2)}
