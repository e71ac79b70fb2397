import json
import os
import random
import sys

import pytest
from conftest import ANIMALS, brute_concepts, brute_covers, got_concepts, got_covers, make_context
from pyspark.sql import functions as F

from conceptloom.functions import masks as M
from conceptloom.operators import metering as R
from conceptloom.plans import stages
from conceptloom.scratch import checkpoint_root
from conceptloom.sources import configs, files, reports
from conceptloom.streaming.incremental import LatticeState, follow


# -- run tables ----------------------------------------------------------------


RUNS = [
    ("b10", "d1", "OK", 10, 5), ("b9", "d1", "FAILED", 2048, None), ("ref", "d1", "ok ", None, 7),
    ("b10", "d2", "OK", 30, 1), ("", "d2", "OK", 99, 1),
]


def runs(spark):
    return spark.createDataFrame(RUNS, "algorithm_id string, dataset_id string, status string, ram bigint, disk bigint")


def test_roll_up_and_pivot(spark):
    rolled = {r.algorithm_id: (r.cases, r.ram, r.disk) for r in R.roll_up(runs(spark), ["ram", "disk"]).collect()}
    assert rolled == {"b10": (2, 30, 5), "b9": (1, 2048, 0), "ref": (1, 0, 7)}
    text = {r.algorithm_id: r.ram for r in R.formatted(R.roll_up(runs(spark), ["ram", "disk"]), ["ram", "disk"]).collect()}
    assert text["b9"] == "2.00 KiB" and text["ref"] == "0 B"
    order = R.algorithm_order(runs(spark), "REF")
    assert order == ["ref", "b9", "b10"]
    wide = {r.dataset_id: r for r in R.pivot_runs(runs(spark), {"RAM": "ram"}, order).collect()}
    assert (wide["d1"].ok, wide["d1"].failed) == (2, 1)
    assert [wide["d1"][f"RAM {a}"] for a in order] == ["n/a", "FAILED", "10"]
    assert [wide["d2"][f"RAM {a}"] for a in order] == ["n/a", "n/a", "30"]


def test_statuses(spark):
    t, f = F.lit(True), F.lit(False)
    row = spark.range(1).select(
        R.execution_status(f, f, F.lit(0), t), R.execution_status(t, t, F.lit(0), t),
        R.execution_status(t, f, F.lit(0), t), R.execution_status(t, f, F.lit(0), f), R.execution_status(t, f, F.lit(2), t),
        R.return_code(t, F.lit(0)), R.effective_timeout(F.lit(5), F.lit(9)), R.effective_timeout(F.lit(5), F.lit(9), t),
        R.normalize_status(f, f, f), R.normalize_status(t, t, f), R.normalize_status(t, f, t), R.normalize_status(t, f, f),
        R.compare_status(t, t), R.compare_status(f, F.lit(None)), R.compare_status(f, f), R.is_full_name(F.lit("A_FULL.dot")),
    ).first()
    assert list(row) == [
        "MISSING_INPUT", "TIMEOUT", "OK", "FAILED", "FAILED", 124, 5, None, "MISSING_RAW_DOT", "CONVERSION_TIMEOUT",
        "CONVERSION_FAILED", "OK", "COMPARE_TIMEOUT", "COMPARE_FAILED", "OK", True,
    ]


def test_latest_and_cases(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, at int, v string")
    assert {(r.k, r.v) for r in R.latest(df, ["k"], "at").collect()} == {("a", "y"), ("b", "z")}
    assert R.cases(df.select("k").distinct(), ["p", "q"]).count() == 4


def test_report_text_round_trip(spark, tmp_path):
    text = (
        f"# {reports.TITLE} - case 7\n\nGénéré le: 2020-01-01\n\n## {reports.SECTIONS['summary']}\n\n- Cas execution: 3\n- Timeouts: 0\n\n"
        f"## {reports.SECTIONS['compare']}\n\n| Dataset | Pair | Status | Equivalent |\n| --- | --- | --- | --- |\n"
        "| d | a vs b | OK | true |\n| d | a vs c | OK |\n"
    )
    path = tmp_path / "r.md"
    path.write_text(text)
    cells = [r.cells for r in reports.read_tables(spark, str(path)).orderBy("at").collect()]
    assert cells == [
        {"Dataset": "d", "Pair": "a vs b", "Status": "OK", "Equivalent": "true"},
        {"Dataset": "d", "Pair": "a vs c", "Status": "OK", "Equivalent": ""},
    ]
    summary = {r.key: r.value for r in reports.read_summary(spark, str(path)).collect()}
    assert summary == {"Cas execution": "3", "Timeouts": "0"}
    assert tuple(reports.read_titles(spark, str(path)).select("title", "generated_at").first()) == ("case 7", "2020-01-01")
    assert reports.markdown_table([], ["a"]) == "_Aucune donnée._"
    lines = reports.table_lines(runs(spark).where("disk = 7"), {"algorithm_id": "Algo", "ram": "RAM"}, ["algorithm_id"])
    assert [r.line for r in lines.orderBy("at").collect()] == ["| Algo | RAM |", "| --- | --- |", "| ref |  |"]


# -- configuration and stages ------------------------------------------------------


def write_config(folder, **change):
    os.makedirs(folder, exist_ok=True)
    me = f"{sys.executable} -m conceptloom lattice {{csv_path}}"
    out = "{repo_root}/out/{dataset_id}_%s.dot"
    algorithm = lambda i, extra: {
        "id": i, "label": i, "csv_path_template": "{repo_root}/{dataset_id}.csv", "command_template": f"{me} {out % i} {extra}",
        "dot_glob_template": "{repo_root}/out/{dataset_id}_" + i + "*.dot", "timeout_seconds": 300,
    }
    parts = {
        "algorithms": {"algorithms": [algorithm("one", "--method subtree"), algorithm("two", "--method join --order lectic")]},
        "datasets": {"datasets": [{"id": "animals", "label": "Animals", "tags": []}, {"id": "gone", "label": "Gone", "tags": []}]},
        "run": {"selected_algorithms": [], "selected_datasets": ["animals"], "stages": list(configs.STAGES),
                "timeout_seconds": 300, "continue_on_error": True},
    }
    parts.update(change)
    for name, value in parts.items():
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            json.dump(value, f)
    return str(folder)


def test_configuration_problems(spark, tmp_path):
    algorithms, datasets, run = configs.load_config(spark, write_config(tmp_path / "ok"))
    assert algorithms.count() == 2 and [r.id for r in datasets.collect()] == ["animals"]
    for k, bad in enumerate([
        {"run": {"selected_algorithms": ["nobody"], "selected_datasets": [], "stages": [], "timeout_seconds": 1, "continue_on_error": True}},
        {"run": {"selected_algorithms": [], "selected_datasets": [], "stages": ["cook"], "timeout_seconds": 1, "continue_on_error": True}},
        {"run": {"selected_algorithms": [], "selected_datasets": [], "stages": [], "timeout_seconds": 0, "continue_on_error": True}},
        {"datasets": {"datasets": [{"id": "d", "label": "x"}, {"id": "d", "label": "y"}]}},
        {"datasets": {"datasets": [{"id": "animals", "label": " "}]}},
    ]):
        with pytest.raises(configs.ConfigError):
            configs.load_config(spark, write_config(tmp_path / f"bad{k}", **bad))
    assert configs.read_records(spark, str(tmp_path / "none.json"), configs.RUN).count() == 0


def test_all_stages(spark, tmp_path, monkeypatch):
    """Two runs of the engine as commands, compared and reported."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    monkeypatch.setenv("PYTHONPATH", repo)
    monkeypatch.setenv("BENCH_CPUS", "2")
    (tmp_path / "animals.csv").write_text(ANIMALS)
    (tmp_path / "out").mkdir()
    config = write_config(tmp_path / "config")
    run_dir = str(tmp_path / "runs" / "first")
    assert stages.run_stages(spark, config, run_dir, str(tmp_path))
    compared = stages.load(run_dir, "compare")
    assert compared["equivalence_matrix"] == {"animals": {"one__vs__two": True}}
    with pytest.raises(FileExistsError):
        stages.run_stages(spark, config, run_dir, str(tmp_path))
    assert stages.run_stages(spark, config, run_dir, str(tmp_path), resume=True, stages=["execution", "report"])
    row = stages.compile_reports(spark, f"{tmp_path}/runs/*/report/*.md", first="two").first()
    assert (row.dataset_id, row.ok, row.failed, row.n_equivalent) == ("animals", 2, 0, 2)
    assert [c for c in row.__fields__ if c.startswith("Temps")] == ["Temps two", "Temps one"]
    assert "| animals | 2/0 | 2 |" in stages.compiled_text(spark, f"{tmp_path}/runs/*/report/*.md", "all")


def test_failed_cases_are_recorded(spark, tmp_path):
    (tmp_path / "animals.csv").write_text(ANIMALS)
    (tmp_path / "full.dot").write_text("digraph G {\n}\n")
    make = lambda i, command: {
        "id": i, "label": i, "csv_path_template": "{repo_root}/{dataset_id}.csv", "command_template": command,
        "dot_glob_template": "{repo_root}/full.dot" if i == "full" else "{repo_root}/none*", "timeout_seconds": 1,
    }
    config = write_config(
        tmp_path / "c", algorithms={"algorithms": [make("full", "true"), make("late", "sleep 20"), make("bad", "false"), make("no", "/no/such")]},
        run={"selected_algorithms": [], "selected_datasets": [], "stages": [], "timeout_seconds": 9, "continue_on_error": True},
    )
    run_dir = str(tmp_path / "r")
    assert not stages.run_stages(spark, config, run_dir, str(tmp_path))
    got = {(r["dataset_id"], r["algorithm_id"]): r["status"] for r in stages.load(run_dir, "execution")["results"]}
    assert got[("animals", "full")] == "OK" and got[("animals", "late")] == "TIMEOUT"
    assert got[("animals", "bad")] == got[("animals", "no")] == "FAILED" and got[("gone", "bad")] == "MISSING_INPUT"
    assert len(stages.load(run_dir, "execution")["timeout_events"]) == 1
    kept = {r["algorithm_id"]: r["status"] for r in stages.load(run_dir, "normalize")["results"] if r["dataset_id"] == "animals"}
    assert kept == {"full": "OK", "late": "MISSING_RAW_DOT", "bad": "MISSING_RAW_DOT", "no": "MISSING_RAW_DOT"}
    assert "TIMEOUT" in open(os.path.join(run_dir, "report", stages.REPORT)).read()


def test_finding_files(spark, tmp_path):
    for i, name in enumerate(["b/x.csv", "a/y.csv", "a/z.txt"]):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("x")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    assert [r.dataset_id for r in files.datasets(spark, str(tmp_path)).collect()] == ["y", "x"]
    assert files.latest(spark, str(tmp_path), "*.csv").endswith("a/y.csv")
    assert files.latest(spark, str(tmp_path), "*.none") is None


# -- streams --------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["subtree", "join"])
def test_every_batch_leaves_the_right_lattice(spark, tmp_path, method):
    rng = random.Random(4)
    state = LatticeState(spark, str(tmp_path / "s"), [f"a{j}" for j in range(6)], method)
    seen = []
    assert got_concepts(state.lattice()) == brute_concepts([], 6)
    for batch, size in enumerate([3, 1, 0, 4]):
        rows = [rng.getrandbits(6) for _ in range(size)] + ([63] if batch == 3 else [])
        data = [(100 * batch + i, "o", r) for i, r in enumerate(rows)]
        seen += rows
        for _ in range(2):  # a batch run again counts once
            state.append(spark.createDataFrame(data, "obj_id bigint, name string, m0 bigint"), batch)
        lattice = state.lattice()
        want = brute_concepts(seen, 6)
        assert got_concepts(lattice) == want
        assert set(got_covers(lattice)) == brute_covers(want)


def test_stream_of_files(spark, tmp_path):
    rng = random.Random(11)
    rows = [rng.getrandbits(70) & rng.getrandbits(70) for _ in range(9)]
    context = make_context(spark, rows, 70)
    context.objects.repartition(3).write.parquet(str(tmp_path / "in"))
    state = LatticeState(spark, str(tmp_path / "s"), context.attributes)
    stream = spark.readStream.schema(context.objects.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow(stream, state, str(tmp_path / "cp")).awaitTermination()
    want = {}
    full = (1 << 70) - 1
    intents = {full}
    for r in rows:
        intents |= {i & r for i in intents} | {r}
    for i in intents:
        want[i] = sum(r & i == i for r in rows)
    assert got_concepts(state.lattice()) == want
    assert M.word_count(70) == 2


# -- working folder ---------------------------------------------------------------------


class _Session:
    """Just the settings of a session."""

    def __init__(self, **settings):
        self.settings = {k.replace("_", "."): v for k, v in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_working_folder_comes_from_the_session():
    assert checkpoint_root(_Session(spark_checkpoint_dir="/shared/x/", spark_master="yarn")) == "/shared/x"
    with pytest.raises(ValueError, match="share"):
        checkpoint_root(_Session(spark_master="yarn"))
    local = _Session(spark_master="local[2]", spark_app_id="here")
    assert os.path.isdir(checkpoint_root(local)) and checkpoint_root(local) == checkpoint_root(local)
