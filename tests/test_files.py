import time

import pytest

from spatialrank import config
from spatialrank.landscape import Grid
from spatialrank.sources import grids, lists
from spatialrank.streaming import progress

GRID = """ncols 5
nrows 4
xllcorner 10
yllcorner 20
cellsize 2
NODATA_value -9999
9 9 9 9 9
9 1 -9999 2.5 9
9 nan 0 3 9
9 9 9 9 9
"""


def put(path, text):
    path.write_text(text)
    return str(path)


def test_grid_round_trip(spark, tmp_path):
    path = put(tmp_path / "a.asc", GRID)
    layer = grids.read_grid(spark, path)
    cells = {(r.y, r.x): r.value for r in layer.collect()}
    assert cells == {(1, 1): 1.0, (1, 3): 2.5, (2, 2): 0.0, (2, 3): 3.0}
    grid, nodata = grids.read_header(spark, path)
    assert grid == Grid(4, 5, 10.0, 20.0, 2.0) and nodata == -9999
    grids.write_grid(layer, grid, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    again = {(r.y, r.x): r.value for r in grids.read_grid(spark, str(part)).collect()}
    assert again == cells
    with pytest.raises(ValueError, match="not 9 x 9"):
        grids.read_grid(spark, path, expect=Grid(9, 9))
    with pytest.raises(ValueError, match="no ncols"):
        grids.read_grid(spark, put(tmp_path / "b.asc", "1 2 3\n"))
    occ = grids.read_layers(spark, [path, path], grid)
    grids.save_occurrences(occ, str(tmp_path / "occ"))
    assert grids.load_occurrences(spark, str(tmp_path / "occ"), grid).count() == 8
    with pytest.raises(ValueError, match="outside"):
        grids.load_occurrences(spark, str(tmp_path / "occ"), Grid(2, 2))


def test_coordinates(spark):
    points = spark.createDataFrame([(10.0, 20.0), (19.9, 27.9)], "X double, Y double")
    assert [(r.y, r.x) for r in Grid(4, 5, 10.0, 20.0, 2.0).cell(points).collect()] == [(3, 0), (0, 4)]


def test_lists(spark, tmp_path):
    short = lists.feature_list(spark, put(tmp_path / "s", '# names\n1.0 0.5 1 2 0.25 f1.asc\n\n2 0.5 1 2 0.25 "with space.asc" # note\n'))
    assert [(r.feature, r.weight, r.path) for r in short.orderBy("feature").collect()] == [(0, 1.0, "f1.asc"), (1, 2.0, "with space.asc")]
    long = lists.feature_list(spark, put(tmp_path / "l", "1 0.5 1 2 1 0.3 0.5 0.25 f1.asc\n"))
    assert long.first().tj == 0.3
    with pytest.raises(lists.ListError) as e:
        lists.feature_list(spark, put(tmp_path / "e", "1 2 3 4 5 a.asc\n1 2 x 4 5 b.asc\n1 2\n"))
    assert [n for n, _ in e.value.problems] == [2, 3]
    assert lists.groups(spark, put(tmp_path / "g", "1 1 -1 1 -1\n2 1 -1 1 -1 3\n"), 2).count() == 2
    with pytest.raises(ValueError, match="1 rows for 3"):
        lists.groups(spark, put(tmp_path / "g2", "1 1 -1 1 -1\n"), 3)
    assert lists.profiles(spark, put(tmp_path / "p", "1 1 1 0.5 0.8 0 0.2\n")) == {1: [(1.0, 1.0), (0.5, 0.8), (0.0, 0.2)]}
    assert lists.interactions(spark, put(tmp_path / "i", "1 2 0.5 1 1.0\n")) == [(0, 1, 0.5, 1, 1.0)]
    assert lists.matrix(spark, put(tmp_path / "m", "1 0.5\n0.5 1\n"), 2).count() == 4
    for bad in ("1 2\n3\n", "1 -1\n0 1\n"):
        with pytest.raises(ValueError):
            lists.matrix(spark, put(tmp_path / "m2", bad))
    assert lists.weighted_paths(spark, put(tmp_path / "w", "1.0 beta.asc\n"), 1) == [(1.0, "beta.asc")]
    assert lists.tree(spark, put(tmp_path / "t", "4 2\n2 -1\n")).count() == 2
    with pytest.raises(ValueError, match="increase"):
        lists.kernel_points(spark, put(tmp_path / "k", "0 1\n0 2\n"))
    units = lists.admin_units(spark, put(tmp_path / "u", "10 1.0 0.5 North Bay\n"))
    assert units.first().name == "North Bay"
    layer = spark.createDataFrame([(10,), (11,)], "admu int")
    assert [r.admu for r in lists.unknown_units(layer, units).collect()] == [11]
    assert lists.admin_weights(spark, put(tmp_path / "aw", "1 2\n3 4\n"), [10, 11]).count() == 4
    assert lists.analyses(spark, put(tmp_path / "a", "LSI 10 2 3 0.5\nLSC 10 20 cmp.asc out.asc\n"))[1] == {"kind": "LSC", "f1": 10.0, "f2": 20.0, "compare": "cmp.asc", "out": "out.asc"}
    cells = spark.createDataFrame([(1, 1)], "y int, x int")
    points = lists.point_observations(spark, put(tmp_path / "o", "# X Y\n12.5 25.0 3 0.2\n12.5 25.5 5\n500 500 2\n"), Grid(4, 5, 10.0, 20.0, 2.0), cells, 7)
    assert [tuple(r) for r in points.collect()] == [(1, 1, 7, 1.0)]


def test_settings_and_command_lines():
    found = config.settings('[Settings]\nremoval rule = 2 ; additive\n"warp factor" = 0\nuse condition layer = true\nodd = 1\n[Info-gap settings]\nInfo-gap proportional = 1\n')
    assert found.rule == "abf" and found.get("warp factor") == 1 and found.get("Info-gap proportional", "Info-gap settings") is True
    assert len(found.notices) == 2 and not found.get("use condition layer")
    assert len(config.known()) == 96
    assert config.settings(config.settings_text(found)).values == found.values
    for bad in ("[Settings]\nremoval rule = 9\n", "[Settings]\nuse cost = maybe\n", "rubbish\n"):
        with pytest.raises(ValueError):
            config.settings(bad)
    run = config.command_line("-r s.dat f.spp out.txt 0.5 0 1 1 --use-threads 4 --removal-rule 3")
    assert (run.mode, run.threads, run.rule, run.alpha) == ("rank", 4, 3, 0.5)
    runs = config.batch('rem a comment\ncall prog -r s.dat f.spp out.txt 0 0 1 1\ncall prog "-lold rank.asc" s.dat f.spp out.txt 0 0 1 1\n')
    assert [r.ranking for r in runs] == [None, "old rank.asc"]
    assert config.output_suffix(found, run) == "TBF_E_IG0.5"
    with pytest.raises(ValueError):
        config.command_line("-x a b")


def test_progress_stream(spark, tmp_path):
    path = str(tmp_path / "feed")
    make = lambda n, k: spark.createDataFrame([(i, i, n, i) for i in range(k)], progress.SCHEMA)
    progress.publish(make(1, 3), path)
    query = progress.rounds(progress.follow(spark, path)).writeStream.outputMode("complete").format("memory").queryName("feed").start()
    try:
        query.processAllAvailable()
        progress.publish(make(2, 2), path)
        time.sleep(0.1)
        query.processAllAvailable()
        assert {tuple(r) for r in spark.sql("SELECT * FROM feed").collect()} == {(1, 3), (2, 2)}
    finally:
        query.stop()
