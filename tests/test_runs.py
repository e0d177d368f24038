"""Whole runs over files: states of a second technology, rules, added operators, and the files written."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayfield.config import CoverageConfig
from wayfield.functions.names import free_name
from wayfield.operators import order, rules, zones
from wayfield.plans import outputs
from wayfield.plans.run import run
from wayfield.sources import sinks, text

HEAD = "latitude;longitude;frequency;pci;mcc;mnc;rsrp"
MAIN = HEAD + ";UTC\n48.1000;17.1000;1;2;231;1;-80;1714557600\n48.1300;17.1300;1;2;231;3;-85;1714557601\n"


def write(tmp_path, name, body):
    path = tmp_path / name
    path.write_text(body, encoding="utf-8")
    return str(path)


def states(tmp_path, name="lte.csv", head="MCC;MNC;5G NR;UTC", rows=("231;1;yes;1714557600", "231;3;no;1714557601")):
    return write(tmp_path, name, "\n".join([head, *rows]) + "\n")


def nr_of(result):
    return {r.mnc: r.nr for r in result.best.collect()}


def test_ss_rsrp_is_a_signal(spark, tmp_path):
    p = write(tmp_path, "a.csv", HEAD.replace("rsrp", "SS-RSRP") + "\n48.1;17.1;1;2;231;1;-80\n")
    assert text.preview(spark, [p]).first()["mapping"]["rsrp"] == "SS-RSRP"
    assert text.typed(text.read(spark, [p])).first().rsrp_v == -80.0


def test_states_of_any_spelling_are_one_column(spark, tmp_path):
    paths = [states(tmp_path, "a.csv", rows=("231;1;yes;1714557600",)), states(tmp_path, "b.csv", "UTC;NR;MNC;MCC;Note", ("1714557601;No;3;231;x",)), states(tmp_path, "c.csv", "MCC;MNC;5GNR;Date;Time", ("231;3;1;01.05.2024;12:00:01",))]
    rows = text.typed(text.read_states(spark, paths), {"nr": text.NR}).orderBy("seq").collect()
    assert [(r.mnc, r.nr) for r in rows] == [("1", "yes"), ("3", "no"), ("3", "yes")]
    main = write(tmp_path, "main.csv", MAIN)
    assert nr_of(run(spark, [main], CoverageConfig(mobile=True), paths[:2])) == {"1": "yes", "3": "no"}


def test_rules_apply_to_states_too(spark, tmp_path):
    rule = tmp_path / "rules"
    rule.mkdir()
    (rule / "shared.txt").write_text('<Query>\n"MNC" = 1; ("MCC" = 231 AND "MNC" = 6)\n</Query>')
    main = write(tmp_path, "main.csv", MAIN)
    lte = states(tmp_path, rows=("231;6;yes;1714557600", "231;3;no;1714557601"))
    cfg = CoverageConfig(mobile=True, rule_paths=(str(rule),))
    assert nr_of(run(spark, [main], cfg, [lte])) == {"1": "yes", "3": "no"}
    assert nr_of(run(spark, [main], CoverageConfig(mobile=True), [lte]))["1"] == "no"


@pytest.mark.parametrize(
    "lte, message",
    [
        ({"rows": ("231;1;no;1714557600",)}, "no state says yes"),
        ({"rows": ("231;1;maybe;1714557600",)}, "no usable row"),
        ({"head": "MCC;MNC;5G NR;Hour"}, "time in .*lte.csv"),
        ({"head": "MCC;PLMN;5G NR;UTC"}, "mnc in .*lte.csv"),
        ({"rows": ("231;1;yes;1714999999",)}, "no match"),
    ],
)
def test_states_that_cannot_be_used(spark, tmp_path, lte, message):
    with pytest.raises(ValueError, match=message):
        run(spark, [write(tmp_path, "main.csv", MAIN)], CoverageConfig(mobile=True), [states(tmp_path, **lte)])


def test_a_main_file_without_times(spark, tmp_path):
    paths = [write(tmp_path, "a.csv", MAIN), write(tmp_path, "b.csv", MAIN.replace("1714557600", "").replace("1714557601", "soon"))]
    with pytest.raises(ValueError, match="no row with a time in: 1"):
        run(spark, paths, CoverageConfig(mobile=True), [states(tmp_path)])


def test_means_are_of_unrounded_numbers(spark, tmp_path):
    p = write(tmp_path, "a.csv", HEAD + "\n48.1;17.1;1;2;231;1;-110,004\n")
    result = run(spark, [p], CoverageConfig())
    assert [(r.good, r.bad) for r in result.stats.collect()] == [(0, 1)]
    assert result.zones.first()["rsrp"] == "-110.00"


def test_rule_fields(spark):
    columns = ["SSRef", "NR-ARFCN", "MCC", "lat"]
    got = rules.resolve(["Frequency", "EARFCN", "mcc", "Latitude", "RSRP"], columns, {"frequency": "NR-ARFCN", "latitude": "lat", "rsrp": "SS-RSRP"})
    assert got == {"Frequency": "SSRef", "EARFCN": "NR-ARFCN", "mcc": "MCC", "Latitude": "lat", "RSRP": "SS-RSRP"}


def test_many_rules_have_no_limit(spark):
    many = [rules.Rule(f"r{k:05d}", ((("MNC", k, k),),), {"MNC": (k + 1,)}) for k in range(3000)]
    df = spark.createDataFrame([("7",), ("2999",), ("x",), (None,)], "MNC string")
    rows = rules.expand(rules.match(df, many), many).collect()
    assert {(r.rule, r.MNC) for r in rows} == {("r00007", "8"), ("r02999", "3000"), (None, "x"), (None, None)}


FULL = "\n".join(
    [
        '"latitude";"longitude";frequency;pci;mcc;mnc;rsrp;SINR;note',
        "48,1000;17.1000;1;2;231;01;-80.126;7;first", "48.1000;17.1000;1;2;231;01;-81;8;again", "48.1300;17.1300;3;4;231;3;-90;;\"a;b\"",
    ]
)


@pytest.mark.parametrize("mode", ["center", "original", "segments"])
def test_zones_file_in_the_columns_of_the_input(spark, tmp_path, mode):
    p = write(tmp_path, "full.csv", FULL + "\n")
    cfg = CoverageConfig(zone_mode=mode, densify=True, custom_operators=(("231", "9", "5"), ("231", "1", ""), ("231", "9", "6")))
    result = run(spark, [p], cfg)
    rows = result.zones.collect()
    measured = [r for r in rows if r.part == 0]
    first = next(r for r in measured if r.mnc == "1")
    assert result.layout.columns == ["latitude", "longitude", "frequency", "pci", "mcc", "mnc", "rsrp", "SINR", "note"]
    assert (first.rsrp, first.SINR, first.note, first.Riadky_v_zone, first.Frekvencie_v_zone) == ("-80.56", "7.50", "first", "1,2", "1 # Meraní: 2")
    assert (first.latitude == "48.1") == (mode == "original")
    if mode == "center":
        assert abs(float(first.latitude) - 48.1) < 0.001 and len(first.latitude.split(".")[1]) == 6
    n_zones = len({r.segment_id for r in rows} if mode == "segments" else {(r.zone_x, r.zone_y) for r in rows})
    empty, added = ([r for r in rows if r.part == k] for k in (1, 2))
    assert len(empty) == 2 * n_zones - len(measured) and len(added) == n_zones
    assert {(r.mnc, r.rsrp, r.note, r.SINR) for r in empty} == {("1", "-174", "first", "7.0"), ("3", "-174", "a;b", "")}
    assert {(r.mnc, r.pci, r.rsrp, r.note) for r in added} == {("9", "5", "-174", "first")}
    assert all("Prázdn" in r.Frekvencie_v_zone and r.latitude and r.longitude for r in empty + added)
    counts = {r.mnc: (r.good, r.bad) for r in result.stats.collect()}
    assert counts["9"] == (0, n_zones) and all(sum(v) == n_zones for v in counts.values())


def lines_of(folder):
    return "".join(p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob("part-*"))).splitlines()


def test_written_files(spark, tmp_path):
    p = write(tmp_path, "full.csv", FULL + "\n")
    cfg = CoverageConfig(densify=True)
    run(spark, [p], cfg).write(str(tmp_path / "zones"), str(tmp_path / "stats"), cfg)
    lines = lines_of(tmp_path / "zones")
    assert lines[:2] == ["", "latitude;longitude;frequency;pci;mcc;mnc;rsrp;SINR;note;Riadky_v_zone;Frekvencie_v_zone"]
    assert lines[2].endswith(";1;2;231;1;-80.56;7.50;first;1,2;1 # Meraní: 2")
    assert lines[3].endswith(';231;3;-90.00;;"a;b";3;3 # Meraní: 1')
    assert len(lines) == 6 and all("Prázdna zóna" in x and x.split(";")[-2] == "" for x in lines[4:])
    assert lines_of(tmp_path / "stats") == ["MNC;MCC;RSRP >= -110 a SINR >= -5;RSRP < -110 alebo SINR < -5", "1;231;1;1", "3;231;1;1"]
    assert sinks.stats_labels(-90.5, 0, False, True) == ("RSRP >= -90.5 a 5G NR = yes", "RSRP < -90.5 alebo 5G NR != yes")


def test_long_lists_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """Lists of several pieces come out whole and in order, also where a line goes on in another part."""
    monkeypatch.setattr(zones, "PIECE", 2)
    values = [(i, str(i + 1), 0.0, 0.0, "231", "1", "5", "2", "1", -80.0, 7.0, "no", "piece;x", "") for i in range(23) if i % 5]
    values += [(i, str(i + 1), 100.0, 0.0, "231", "1", "5", "2", "1", -80.0, 7.0, "no", "y", "b") for i in range(0, 23, 5)]
    df = spark.createDataFrame(values, "seq long, row_id string, zone_x double, zone_y double, mcc string, mnc string, pci string, frequency string, rsrp string, rsrp_v double, sinr_v double, nr string, piece string, line string").repartition(3)
    best = zones.best_frequency(zones.frequency_stats(df), -110.0, -5.0)
    cells = df.select("seq", "mcc", "mnc", "pci", "frequency", "rsrp", "piece", "line")
    layout = outputs.layout_of(cells, {})
    made = outputs.zones_file(best.withColumns({"lat": F.lit("48"), "lon": F.lit("17")}), None, None, cells, zones.row_lists(df), layout, False)
    outputs.write_zones_file(made, layout, str(tmp_path / "zones"))
    ids = [",".join(str(i + 1) for i in range(23) if bool(i % 5) == odd) for odd in (True, False)]
    want = [f'231;1;5;2;-80.00;"piece;x";;{ids[0]};2 # Meraní: 18', f"231;1;5;2;-80.00;y;b;{ids[1]};2 # Meraní: 5"]
    assert lines_of(tmp_path / "zones") == ["", "mcc;mnc;pci;frequency;rsrp;piece;line;Riadky_v_zone;Frekvencie_v_zone", *want]


def test_zone_first_order(spark):
    rows = [(100.0, 0.0, "231", "10", "2"), (100.0, 0.0, "231", "9", "3"), (20.0, 0.0, "231", "1", "x"), (20.0, 0.0, "231", "1", "7")]
    df = spark.createDataFrame(rows, "zone_x double, zone_y double, mcc string, mnc string, pci string")
    assert [(r.zone_x, r.mnc, r.pci) for r in df.orderBy(*zones.zone_first_order(df)).collect()] == [(100.0, "10", "2"), (100.0, "9", "3"), (20.0, "1", "7"), (20.0, "1", "x")]


def test_helper_columns_do_not_clash(spark):
    df = spark.createDataFrame([(2, "p", "m", "n"), (1, "q", "m", "n")], "seq long, part string, mono string, number string")
    rows = order.row_ids(df).orderBy("seq").collect()
    assert [(r.row_id, r.part, r.mono, r.number) for r in rows] == [("1", "q", "m", "n"), ("2", "p", "m", "n")]
    assert free_name(df, "PART") == "PART_"


def test_files_of_many_blocks(spark, tmp_path):
    """Lines keep their order where a file is read in many pieces by several tasks."""
    paths = []
    for k in range(3):
        body = "".join(f"48.{i};17.1;{k};{i};231;1;-{60 + i % 50};{'x' * (i % 40)}\n" for i in range(400))
        paths.append(write(tmp_path, f"f{k}.csv", ("note\n\n" if k == 1 else "") + HEAD + ";note\n" + body))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
        spark.conf.set("spark.sql.files.openCostInBytes", "10b")
        rows = text.read(spark, paths).orderBy("seq").select("source_idx", "pci", "note").collect()
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert [(r.source_idx, r.pci, len(r.note)) for r in rows] == [(k, str(i), i % 40) for k in range(3) for i in range(400)]
