import numpy as np
import pytest

from tallystream.operators.velocity import VelocityConfig, add_velocity
from tallystream.sources import artifacts, files
from tallystream.streaming.activity import ActivityState, advanced_snapshot, state_snapshot, velocity_from_snapshot

CONFIG = VelocityConfig((50, 300))
SCHEMA = "id int, cc_num string, unix_time long, amt double"


def history(spark, n=400):
    """Rows of a few entities, rows without one, and seconds before 1970."""
    draw = np.random.default_rng(3)
    rows = [(i, None if i % 5 == 0 else f"c{i % 3}", int(t), float(a)) for i, (t, a) in enumerate(zip(draw.integers(-2000, 2500, n), draw.integers(1, 900, n) / 4, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("cut", [-700, 900])
def test_null_entities_go_on(spark, cut):
    rows = history(spark)
    first, rest = rows.filter(f"unix_time < {cut}"), rows.filter(f"unix_time >= {cut}")
    want = sorted(map(tuple, add_velocity(rows, CONFIG).filter(f"unix_time >= {cut}").select("id", *CONFIG.names()).collect()))
    state = state_snapshot(first, CONFIG)
    assert sorted(map(tuple, velocity_from_snapshot(rest, state, CONFIG).select("id", *CONFIG.names()).collect())) == want
    key = lambda r: (r.entity is None, r.entity)
    assert sorted(advanced_snapshot(state, rest, CONFIG).collect(), key=key) == sorted(state_snapshot(rows, CONFIG).collect(), key=key)


def test_rows_of_the_open_second_see_the_past(spark):
    rows = spark.createDataFrame([(0, None, 100, 1.0), (1, None, 5000, 1.0), (2, None, 5000, 3.0), (3, None, 4000, 1.0)], SCHEMA)
    state = state_snapshot(rows.filter("id < 2"), CONFIG)
    got = velocity_from_snapshot(rows.filter("id = 2"), state, CONFIG).first()
    assert (got["cc_txn_count_prior"], got["cc_amt_sum_prior"], got["cc_txn_count_prev_50s"]) == (1, 1.0, 0)
    with pytest.raises(ValueError, match="earlier"):
        velocity_from_snapshot(rows.filter("id = 3"), state, CONFIG)


def test_seconds_before_1970():
    state = ActivityState((50,))
    assert state.add(-5, 100) == [0, 0, 0, 0] and state.add(3, 100) == [1, 100, 1, 100] and state.add(-6, 1) is None


@pytest.fixture(params=["file", "viewfs"])
def folder(request, spark, tmp_path):
    if request.param == "file":
        return f"file://{tmp_path}"
    name = f"t{tmp_path.parent.name}-{tmp_path.name}".replace("_", "-")
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./in", f"file://{tmp_path}")
    return f"viewfs://{name}/in"


def test_documents_on_any_file_system(folder):
    path = f"{folder}/deep/a.json.gz"
    artifacts.write_json(path, {"a": 1})
    assert artifacts.read_json(path) == {"a": 1} and files.names(f"{folder}/deep") == ["a.json.gz"] and files.exists(path)
    with pytest.raises(FileExistsError):
        artifacts.write_json(path, {"a": 2})
    assert artifacts.read_json(path) == {"a": 1} and files.names(f"{folder}/deep") == ["a.json.gz"]
    artifacts.write_json(path, {"a": 3}, overwrite=True)
    assert artifacts.read_json(path) == {"a": 3} and files.names(f"{folder}/none") == []
    with pytest.raises(FileNotFoundError):
        artifacts.read_json(f"{folder}/none.json")


def test_one_of_two_writers_gets_the_place(folder, monkeypatch):
    """The second has seen no file, but the first has written before it renames."""
    real = files._hadoop

    def late(path):
        jvm, system, at = real(path)

        class System:
            def exists(self, p):
                found, self.exists = False, system.exists
                return found

            def __getattr__(self, name):
                if name == "mkdirs":
                    monkeypatch.setattr(files, "_hadoop", real)
                    files.write_once(path, b"first")
                return getattr(system, name)

        return jvm, System(), at

    monkeypatch.setattr(files, "_hadoop", late)
    with pytest.raises(FileExistsError):
        files.write_once(f"{folder}/x", b"second")
    assert files.read(f"{folder}/x") == b"first" and files.names(folder) == ["x"]
