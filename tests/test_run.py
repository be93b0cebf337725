"""A run from settings, lists and grids to its outputs."""

import numpy as np
import pytest

from spatialrank import config, run
from spatialrank.operators import greedy
from spatialrank.operators import transforms as t
from spatialrank.sources import grids

YD, XD = 9, 10


def asc(values):
    head = f"ncols {XD}\nnrows {YD}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9\n"
    return head + "\n".join(" ".join(f"{v:g}" for v in row) for row in values) + "\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path, random = tmp_path_factory.mktemp("run"), np.random.default_rng(3)
    for name in ("one", "two", "three"):
        layer = np.round(random.gamma(1.0, 2.0, (YD, XD)), 3)
        layer[random.random((YD, XD)) < 0.35] = -9
        (path / f"{name}.asc").write_text(asc(layer))
    (path / "cost.asc").write_text(asc(1 + random.integers(0, 4, (YD, XD))))
    (path / "mask.asc").write_text(asc((np.indices((YD, XD))[1] > 5).astype(int)))
    (path / "cond.asc").write_text(asc(np.round(random.random((YD, XD)), 2)))
    (path / "area.asc").write_text(asc((np.indices((YD, XD)).max(0) < 5).astype(int)))
    (path / "unit.asc").write_text(asc(np.indices((YD, XD))[0] // 3))
    (path / "features.spp").write_text("# weight alpha profile radius exponent path\n1 0.5 1 1 0.25 one.asc\n2 0.5 1 1 0.25 two.asc\n-0.5 0.5 1 1 0.25 three.asc\n")
    (path / "groups.txt").write_text("1 1 -1 0 -1\n1 -1 -1 0 -1\n2 1 -1 0 -1\n")
    (path / "condition.txt").write_text("1 cond.asc\n")
    (path / "analyses.txt").write_text("LSI 0.3 0.2 2 9\nLSM unit.asc 0.3 2 9\nLSC 0.3 0.3 cost.asc out\n")
    (path / "profiles.txt").write_text("1 1 1 0.5 0.8 0 0.2\n")
    return path


def line(folder, mode, text, out, rest="0 0 1 1"):
    (folder / f"{out}.dat").write_text(text)
    return config.command_line(f"{mode} {folder}/{out}.dat {folder}/features.spp {folder}/{out} {rest}")


def order(done):
    return [(r.y, r.x) for r in done.order.orderBy("step").collect()]


def test_rank_then_reload(spark, folder):
    text = "removal rule = 1\nwarp factor = 2\nedge removal = 0\nuse cost = 1\ncost file = cost.asc\npost-processing list file = analyses.txt\n"
    words = line(folder, "-r", text, "out")
    done = run.execute(spark, words)
    made = done.prepared
    # the same by hand
    occ = t.normalise(grids.read_layers(spark, [f"{folder}/{n}.asc" for n in ("one", "two", "three")], made.grid))
    cost = grids.read_grid(spark, f"{folder}/cost.asc", "cost", made.grid)
    features = spark.createDataFrame([(0, 0.5, 0.25), (1, 1.0, 0.25), (2, -0.25, 0.25)], "feature int, weight double, sr_par double")
    want = greedy.rank_small(occ, features, "caz", 2, cost=cost, whole_blocks=False, neighbours=True)
    assert order(done) == [(r.y, r.x) for r in want.orderBy("round", "place").collect()]
    run.write(spark, words, done)
    base = f"{folder}/out.CAZ_C"
    (part,) = (folder / "out.CAZ_C.rank.asc").glob("part-*")
    again = run.execute(spark, line(folder, f"-l{part}", text, "again"))
    assert order(again) == order(done)
    first, second = ({tuple(r) for r in d.tables["curves"].selectExpr("step", "feature", "round(repr, 9)").collect()} for d in (done, again))
    assert first == second and len(first) == 3 * len(order(done))
    for name in ("summary", "features", "removals", "1_LSI", "2_LSM", "3_LSC", "progress"):
        assert spark.read.parquet(f"{base}.{name}" if name == "progress" else f"{base}.{name}.parquet").count()
    assert "use cost = 1" in [r.value for r in spark.read.text(f"{base}.settings").collect()]


def test_masks_conditions_and_smoothing(spark, folder):
    text = "removal rule = 2\nuse mask = 1\nmask file = mask.asc\nuse groups = 1\ngroups file = groups.txt\nuse condition layer = 1\ncondition file = condition.txt\n[Transformed layers]\noutput condition transformed layers = 1\noutput final transformed layers = 1\n"
    done = run.execute(spark, line(folder, "-r", text, "masked", "0.01 1 2 1"))
    got = order(done)
    level = {(r.y, r.x): r.mask_level for r in done.prepared.levels.collect()}
    assert [level[c] for c in got] == sorted(level[c] for c in got) and len(got) == len(level)
    assert set(done.prepared.stages) == {"condition", "final"} and {r.grp for r in done.tables["groups"].collect()} == {1}
    worst = {(r.y, r.x): r.prop_loss for r in done.maps["prop_loss"][0].collect()}
    losses = [worst[c] for c in got]
    assert losses == sorted(losses) and losses[0] == 0 and losses[-1] > 0.9


def test_penalties_take_part(spark, folder):
    text = "removal rule = 2\nmask missing areas = 1\narea mask file = area.asc\n"
    plain = order(run.execute(spark, line(folder, "-r", text, "plain")))
    with_length = order(run.execute(spark, line(folder, "-r", text + "BLP = 0.5\ninitial removal percent = 40\n", "blp")))
    assert sorted(plain) == sorted(with_length) and plain != with_length


def test_what_no_operator_has_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="tree connectivity"):
        run.execute(spark, line(folder, "-r", "use tree connectivity = 1\n", "tree"))
    with pytest.raises(ValueError, match="core-area"):
        run.execute(spark, line(folder, "-r", "removal rule = 2\nuse SSI = 1\nSSI file name = features.spp\n", "points"))
