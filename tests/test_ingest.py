"""Files in, files out."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfield.config import CoverageConfig
from wayfield.functions import geo
from wayfield.functions.scalars import operator_code
from wayfield.operators import densify, rules, sync
from wayfield.plans.run import run
from wayfield.sources import sinks, text

HEAD = "latitude;longitude;frequency;pci;mcc;mnc;rsrp"


def write(tmp_path, name, body, encoding="utf-8"):
    path = tmp_path / name
    path.write_bytes(body.encode(encoding))
    return str(path)


def test_quoted_cells_and_preamble(spark, tmp_path):
    p = write(tmp_path, "a.csv", 'meter;1\n\n"latitude";"longitude";"frequency";"pci";"mcc";"mnc";"rsrp";"note"\n"48,1";"17.1";"1";"2";"231";"01";"-80";"meter;""rear"""\n48.2;17.2;1;2;231;01;-81\n')
    rows = text.read(spark, [p]).orderBy("seq").collect()
    assert [r.note for r in rows] == ['meter;"rear"', ""]
    assert rows[0].latitude == "48,1"


def test_latin1_file(spark, tmp_path):
    p = write(tmp_path, "a.csv", HEAD + ";poznámka\n48.1;17.1;1;2;231;01;-80;áno\n", "latin1")
    assert text.inspect(spark, [p])[0].utf8 is False
    assert text.read(spark, [p]).first()["poznámka"] == "áno"


def header_by_reading(body):
    """Header line of a file's lines, by the three rules in turn."""
    rows = body.split("\n")
    cut = [re.sub(";+$", "", r).split(";") if r.strip(" ") else None for r in rows]
    named = [i for i, c in enumerate(cut) if c and {"latitude", "longitude", "mcc", "mnc", "rsrp"} <= {text.token(x) for x in c}]
    if named:
        return named[0]
    wide = [i for i, c in enumerate(cut) if c and len(c) >= 6]
    for i in wide:
        ahead = [c for c in cut[i + 1 :] if c][:25]
        if sum(len(c) >= max(6, len(cut[i]) - 1) for c in ahead) >= 2:
            return i
    return wide[0] if wide else 0


@pytest.mark.parametrize("prefix,chunk", [(1000, 50_000), (30, 40), (1, 26)])
def test_headers_of_all_kinds(spark, tmp_path, prefix, chunk):
    """Named and unnamed headers near the start, far down, followed or not, against plain reading."""
    draw = random.Random(7)
    wide = lambda n: ";".join(f"v{k}" for k in range(n))
    bodies = {
        "named": f"meter;1\n\n{HEAD}\n" + "48.1;17.1;1;2;231;01;-80\n" * 3, "named_late": "meter;1\n" * 70 + f"{HEAD}\n48.1;17.1;1;2;231;01;-80", "followed": "a;b\n" + wide(7) + "\n" + (wide(6) + "\n") * 2,
        "decoy": wide(9) + "\n" + "x\n" * 26 + (wide(9) + "\n") * 4, "decoy_late": "x;y\n" * 45 + wide(9) + "\n" + "x\n\n" * 26 + (wide(8) + "\n") * 4, "alone": "x\n" * 40 + wide(8) + "\n" + "y\n" * 33,
        "decoy_then_named": (wide(8) + "\n") * 50 + f"{HEAD}\n48.1;17.1;1;2;231;01;-80\n", "narrow": "a;b;c\n1;2;3\n", "blank": "\n\n  \na;b\n", "quoted": '"a;b";c\n' + wide(7) + "\n" + wide(7) + "\n" + wide(7) + "\n",
    }
    for k in range(12):
        bodies[f"random{k}"] = "\n".join(wide(draw.choice((1, 5, 6, 7, 12))) if draw.random() < draw.choice((0.05, 0.3)) else draw.choice(("", "x", "a;b")) for _ in range(draw.randrange(1, 160))) + "\nend"
    paths = {write(tmp_path, f"{k}.csv", b): k for k, b in bodies.items()}
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.header_line, r.header) for r in text.file_meta(text.blocks_of(spark, list(paths)), prefix, chunk).collect()}
    for name, body in bodies.items():
        at = header_by_reading(body)
        first = next(r for r in body.split("\n")[at:] if r.strip(" "))
        assert got[name] == (at, first), name


def test_lines_where_the_number_of_cores_changes(spark, tmp_path):
    """Numbers come from the scan that read the lines, however later scans are cut."""
    body = "".join(f"48.1;17.1;{k};{k % 504};231;1;-80\n" for k in range(60_000))
    p = write(tmp_path, "a.csv", HEAD + "\n" + body)
    name, old = "spark.sql.leafNodeDefaultParallelism", spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        for first, then in ((1, 8), (8, 1), (3, 7)):
            spark.conf.set(name, first)
            blocks = text.blocks_of(spark, [p])
            spark.conf.set(name, then)
            rows = text.lines(blocks).withColumn("n", F.row_number().over(Window.orderBy("line_no"))).select("n", F.col("raw").cast("string").alias("t")).collect()
            assert len(rows) == 60_001
            assert all(r.t == HEAD if r.n == 1 else r.t.split(";")[2] == str(r.n - 2) for r in rows)
            spark.conf.set(name, first)
            table = text.read(spark, [p])
            spark.conf.set(name, then)
            assert [r.frequency for r in table.orderBy("seq").collect()] == [str(k) for k in range(60_000)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def test_union_of_aliases(spark, tmp_path):
    a = write(tmp_path, "a.csv", "Latitude;Longitude;NR-ARFCN;PCI;MCC;MNC;SSS-RSRP\n48.1;17.1;1;2;231;01;-80\n")
    b = write(tmp_path, "b.csv", "Lat;Lng;Frequency;PCI;MCC;MNC;RSRP\n48.2;17.2;3;4;231;01;-90\n")
    rows = text.read(spark, [a, b]).orderBy("seq").collect()
    assert [(r.Latitude, r["NR-ARFCN"], r["SSS-RSRP"]) for r in rows] == [("48.1", "1", "-80"), ("48.2", "3", "-90")]
    assert [m.technology for m in text.inspect(spark, [a, b])] == ["5g", "unknown"]


def test_mapped_column_goes_first(spark, tmp_path):
    p = write(tmp_path, "a.csv", "Lat;Lon;Freq;PCI;MCC;MNC;RSRP;SSS-RSRP\n48.1;17.1;1;2;231;01;-70;-100\n")
    row = text.typed(text.read(spark, [p], {"rsrp": "SSS-RSRP"}), {"rsrp": "SSS-RSRP"}).first()
    assert row.rsrp_c == -10000


def test_errors_name_the_file(spark, tmp_path):
    p = write(tmp_path, "bad.csv", HEAD.replace(";pci", "") + "\n48.1;17.1;1;231;01;-80\n")
    with pytest.raises(ValueError, match="pci in .*bad.csv"):
        text.read(spark, [p])
    q = write(tmp_path, "two.csv", HEAD + ";R-SRP\n48.1;17.1;1;2;231;01;-80;1\n")
    with pytest.raises(ValueError, match="rsrp in .*two.csv"):
        text.read(spark, [q])


def test_extra_and_blank_headers():
    assert text.column_names(["a", "", "a"], 5) == ("a", "column_2", "a_2", "extra_col_1", "extra_col_2")


def test_rule_files(spark, tmp_path):
    write(tmp_path, "a.txt", '<Query>"MCC" = 231 "MNC" = 1 "MNC" = 1; ("MCC" = 231 AND "Frequency" = 20-10) OR ("PCI" = 7)</Query>')
    (rule,) = text.rules_of(text.read_rules(spark, str(tmp_path)))
    assert rule.assignments == {"MCC": (231.0,), "MNC": (1.0,)}
    assert rule.groups == ((("MCC", 231.0, 231.0), ("Frequency", 10.0, 20.0)), (("PCI", 7.0, 7.0),))
    write(tmp_path, "b.txt", '<Query>"MCC" = 1-2; ("PCI" = 7)</Query>')
    with pytest.raises(ValueError, match="range in an assignment"):
        text.rules_of(text.read_rules(spark, str(tmp_path)))


def test_rule_tie_range_and_products(spark):
    df = spark.createDataFrame([(0, "5"), (1, "10"), (2, "x")], "seq long, K string")
    tied = [rules.Rule("z", ((("K", 5, 10),),), {"X": (1,)}), rules.Rule("a", ((("K", 5, 10),),), {"X": (2,), "Y": (3, 4)})]
    out = rules.expand(rules.match(df, tied), tied, keep_original=True).orderBy("seq", "pos").collect()
    assert [(r.seq, r.pos, r.X, r.Y) for r in out] == [(0, 0, None, None), (0, 1, "2", "3"), (0, 2, "2", "4"), (1, 0, None, None), (2, 0, None, None)]


def test_sync_conflict_and_spelling(spark):
    states = spark.createDataFrame([("231.0", "1.0", 100, "yes"), ("231", "1", 101, "no"), ("231", "1", 102, "")], "mcc string, mnc string, time_ms long, nr string")
    rows = spark.createDataFrame([(0, "231", "01", 101), (1, "231", "01", 500), (2, "231", "01", None), (3, "", "01", 108)], "seq long, mcc string, mnc string, time_ms long")
    got = {r.seq: (r.nr, r.yes_n, r.no_n, r.fallback) for r in sync.sync(rows, states, 10).collect()}
    assert got == {0: ("yes", 1, 1, False), 1: ("no", 0, 0, False), 2: ("no", 0, 0, False), 3: ("yes", 1, 1, True)}


def test_custom_list():
    assert densify.custom_list("231:03:30, 231:03 231:5") == [("231", "03", "30"), ("231", "5", "")]


def test_projection_there_and_back(spark):
    known = [(17.1077, 48.1486, -573686.657, -1280322.097), (17.2, 48.2, -566283.257, -1275323.851), (21.261074, 48.716381, -262582.668, -1240040.607)]
    df = spark.createDataFrame(known, "lon double, lat double, ex double, ey double")
    rows = geo.reproject(df).withColumn("back", geo.unproject(F.col("x"), F.col("y"))).collect()
    for r in rows:
        assert abs(r.x - r.ex) < 1e-3 and abs(r.y - r.ey) < 1e-3
        assert abs(r.back.lon - r.lon) < 1e-7 and abs(r.back.lat - r.lat) < 1e-7


def test_run_with_exclusion_and_files_out(spark, tmp_path):
    p = write(tmp_path, "a.csv", HEAD + "\n48.1486;17.1077;1;10;231;01;-80\n48.1491;17.1082;1;11;231;01;-81\n48.1496;17.1087;1;20;231;02;-82\n")
    out = run(spark, [p], CoverageConfig(exclude_row_ids=(2,)))
    assert sorted(r.pci for r in out.best.collect()) == ["10", "20"]
    sinks.write_zones(out.best, str(tmp_path / "zones"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "zones")).collect()]
    assert sum(" # Meraní: 1" in x for x in lines) == 2
    assert out.summary.first().unique_zones == 2


def test_run_densifies_segments(spark, tmp_path):
    p = write(tmp_path, "a.csv", HEAD + "\n48.1486;17.1077;1;10;231;01;-80\n48.1486;17.1098;1;11;231;02;-81\n")
    out = run(spark, [p], CoverageConfig(zone_mode="segments", densify=True))
    assert out.best.count() == 2 and out.empty.count() == 2
    q = write(tmp_path, "b.csv", HEAD + "\n48.1486;17.1077;1;10;231;01;-80\n48.1486;17.1105;1;11;231;01;-81\n")
    assert run(spark, [q], CoverageConfig(zone_mode="segments", zone_size=50, densify=True)).empty.count() == 3


def test_files_in_time_order_before_exclusion(spark, tmp_path):
    head = HEAD + ";Date;Time\n"
    a = write(tmp_path, "a.csv", head + "48.1486;17.1077;1;10;231;01;-80;01.05.2024;10:10:00\n")
    b = write(tmp_path, "b.csv", head + "48.1491;17.1082;1;20;231;01;-81;01.05.2024;10:05:00\n")
    out = run(spark, [a, b], CoverageConfig(exclude_row_ids=(2,)))
    assert [r.pci for r in out.best.collect()] == ["20"]


def test_mobile_run(spark, tmp_path):
    head = HEAD + ";Date;Time\n"
    m = write(tmp_path, "m.csv", head + "48.1486;17.1077;1;10;231;01;-80;01.05.2024;10:00:00\n48.1586;17.1177;1;10;231;01;-80;01.05.2024;10:05:00\n")
    s = write(tmp_path, "s.csv", "MCC;MNC;5G NR;Date;Time\n231;01;yes;01.05.2024;10:00:00\n")
    out = run(spark, [m], CoverageConfig(mobile=True), [s])
    assert sorted(r.nr for r in out.best.collect()) == ["no", "yes"]
    assert [(r.good, r.bad) for r in out.stats.collect()] == [(1, 1)]


def test_windows_in_local_time(spark):
    from wayfield.operators import filters

    rows = spark.createDataFrame([(1714557600000,), (1714561200000,), (1714564800000,), (None,)], "time_ms long")
    bounds = filters.window_bounds(rows, [("2024-05-01 13:00", "2024-05-01 13:30"), ("", "2024-05-01 13:30")])
    kept = filters.exclude_windows(rows, bounds)
    assert [r.time_ms for r in kept.collect()] == [1714557600000, 1714564800000, None]
    with pytest.raises(ValueError):
        filters.window_bounds(rows, [("2024-05-01 14:00", "2024-05-01 13:30")])


def test_templates_and_positions(spark):
    from wayfield.operators import zones

    rows = spark.createDataFrame([(0, "231", "01", -573650.0, "a"), (1, "231", "1", -573550.0, "b"), (2, "231", "2", -573550.0, "c")], "seq long, mcc string, mnc string, x double, note string").withColumn("y", F.lit(-1280250.0))
    zoned = zones.grid(rows, 100.0)
    empty = densify.empty_zones(zoned, densify.operators_of(rows))
    got = [(r.zone_x, r.mnc, r.note) for r in densify.with_templates(empty, rows, ["note"]).collect()]
    assert got == [(-573700.0, "2", "c")]
    at = zones.with_positions(empty, 100.0).first()
    x = geo.reproject(spark.createDataFrame([(at.lon, at.lat)], "lon double, lat double")).first()
    assert abs(x.x + 573650) < 1e-3 and abs(x.y + 1280250) < 1e-3


def test_codes_with_a_comma(spark):
    rows = spark.createDataFrame([("1,0",), ("A,50",), ("A.00",), ("x,",), (None,)], "t string").select(operator_code(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == ["1", "A.5", "A", "x", None]


def test_missing_sources_by_name(spark):
    check = spark.createDataFrame([(0, 3), (1, 0), (2, 0)], "source_idx int, usable long")
    names = spark.createDataFrame([(0, "a.csv"), (1, "b.csv")], "source_idx int, path string")
    with pytest.raises(ValueError, match=r"no usable row in: 1 \(b.csv\), 2$"):
        sync.require_sources(check, "usable", "usable row", names)
    with pytest.raises(ValueError, match="in: 1, 2$"):
        sync.require_sources(check, "usable", "usable row")
