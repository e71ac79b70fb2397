"""Comparative runs: execute, normalise, compare, report.

The stages only arrange the engine's operators; every lattice they touch is read,
expanded and compared by Spark.  What the stages pass on are small JSON records.
"""

from __future__ import annotations

import json
import os
import resource
import shlex
import shutil
import subprocess
import time
from collections.abc import Sequence
from glob import glob
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conceptloom.functions.text import format_bytes, natural_key
from conceptloom.operators import compare as C
from conceptloom.operators import graph as G
from conceptloom.operators import metering as R
from conceptloom.operators.metering import TIMEOUT_CODE
from conceptloom.sources import configs, dot, reports
from conceptloom.sources.reports import now_iso

REPORT = "rapport_pipeline.md"


def run_stages(
    spark: SparkSession, config: str, run_dir: str, root: str = ".", resume: bool = False,
    stages: Sequence[str] | None = None, no_timeout: bool = False,
) -> bool:
    """Run the selected stages; True if every case of every stage ended OK."""
    algorithms, datasets, settings = configs.load_config(spark, config)
    if os.path.isdir(run_dir) and os.listdir(run_dir) and not resume:
        raise FileExistsError(f"{run_dir} is not empty; resume it or take another folder")
    os.makedirs(os.path.join(run_dir, "metadata"), exist_ok=True)
    chosen = list(stages or settings["stages"] or configs.STAGES)
    unknown = set(chosen) - set(configs.STAGES)
    if unknown:
        raise configs.ConfigError(f"unknown stages {sorted(unknown)}")
    algos = {a.id: a for a in algorithms.collect()}  # configuration, a handful of rows
    cases = [
        (algos[r.algorithm_id], r.id)
        for r in R.cases(datasets.select("id"), sorted(algos)).orderBy("id", "algorithm_id").collect()
    ]
    limit = None if no_timeout else settings["timeout_seconds"]
    keep_on = settings["continue_on_error"]
    good = True
    for stage in configs.STAGES:
        if stage not in chosen:
            continue
        work = {"execution": _execution, "normalize": _normalize, "compare": _compare, "report": _report}[stage]
        ok = work(spark, run_dir, root, cases, limit, resume)
        good = good and ok
        if not ok and not keep_on:
            break
    return good


# -- records -------------------------------------------------------------------


def _index(run_dir: str, stage: str) -> str:
    return os.path.join(run_dir, "metadata", f"{stage}_index.json")


def load(run_dir: str, stage: str) -> dict:
    """A stage's record, empty if it has not run."""
    try:
        with open(_index(run_dir, stage), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return {}


def _store(run_dir: str, stage: str, results: list[dict], **extra) -> bool:
    total = "total_pairs" if stage == "compare" else "total_cases"
    record = {"stage": stage, "generated_at": now_iso(), total: len(results), "results": results, **extra}
    with open(_index(run_dir, stage), "w", encoding="utf-8") as f:
        json.dump(record, f, indent=2, ensure_ascii=False)
    return all(r["status"] == "OK" for r in results)


def _done(run_dir: str, stage: str, resume: bool) -> dict:
    if not resume:
        return {}
    return {(r["dataset_id"], r["algorithm_id"]): r for r in load(run_dir, stage).get("results", []) if r["status"] == "OK"}


# -- stages --------------------------------------------------------------------


def _execution(spark, run_dir, root, cases, limit, resume) -> bool:
    done, results, timeouts = _done(run_dir, "execution", resume), [], []
    for algorithm, dataset in cases:
        record = done.get((dataset, algorithm.id)) or _execute(algorithm, dataset, run_dir, root, limit)
        results.append(record)
        if record["timed_out"]:
            timeouts.append({
                "dataset_id": dataset, "algorithm_id": algorithm.id, "at": record["finished_at"],
                "timeout_seconds": algorithm.timeout_seconds if limit is None else min(limit, algorithm.timeout_seconds),
            })
    return _store(run_dir, "execution", results, timeout_events=timeouts)


def _execute(algorithm, dataset: str, run_dir: str, root: str, limit: int | None) -> dict:
    """Run one command on one dataset under the smaller of the two time limits."""
    fill = {"repo_root": root, "dataset_id": dataset}
    fill["csv_path"] = algorithm.csv_path_template.format(**fill)
    command = [part.format(**fill) for part in shlex.split(algorithm.command_template)]
    record = {f.name: None for f in configs.EXECUTION} | {
        "algorithm_id": algorithm.id, "dataset_id": dataset, "command": command, "timed_out": False,
        "started_at": now_iso(),
    }
    if not os.path.exists(fill["csv_path"]):
        return record | {"status": "MISSING_INPUT", "finished_at": now_iso()}
    log = os.path.join(run_dir, "execution", "logs", f"{algorithm.id}__{dataset}.log")
    os.makedirs(os.path.dirname(log), exist_ok=True)
    start, before = time.monotonic(), resource.getrusage(resource.RUSAGE_CHILDREN)
    with open(log, "w", encoding="utf-8") as out:
        try:
            wait = None if limit is None else min(limit, algorithm.timeout_seconds)
            code = subprocess.run(command, stdout=out, stderr=subprocess.STDOUT, timeout=wait).returncode
        except subprocess.TimeoutExpired:
            code, record["timed_out"] = TIMEOUT_CODE, True
        except OSError as e:
            out.write(str(e))
            code = 127
    after = resource.getrusage(resource.RUSAGE_CHILDREN)
    record |= {
        "returncode": code, "elapsed_seconds": round(time.monotonic() - start, 3), "finished_at": now_iso(),
        "cpu_seconds": round(after.ru_utime + after.ru_stime - before.ru_utime - before.ru_stime, 3),
        "peak_rss_bytes": after.ru_maxrss * 1024, "stdout_log": log,
        "peak_io_read_bytes": (after.ru_inblock - before.ru_inblock) * 512,
        "peak_io_write_bytes": (after.ru_oublock - before.ru_oublock) * 512,
    }
    found = sorted(glob(algorithm.dot_glob_template.format(**fill)), key=os.path.getmtime)
    if code == 0 and found and os.path.getsize(found[-1]):
        copy = os.path.join(run_dir, "execution", "dot", f"{algorithm.id}__{dataset}__{os.path.basename(found[-1])}")
        os.makedirs(os.path.dirname(copy), exist_ok=True)
        shutil.copyfile(found[-1], copy)
        record |= {"raw_dot_source": found[-1], "raw_dot_copy": copy, "total_written_bytes": os.path.getsize(copy)}
    status = "TIMEOUT" if record["timed_out"] else "OK" if code == 0 and record["raw_dot_copy"] else "FAILED"
    return record | {"status": status}


def _normalize(spark, run_dir, root, cases, limit, resume) -> bool:
    done, results = _done(run_dir, "normalize", resume), []
    for run in load(run_dir, "execution").get("results", []):
        key = (run["dataset_id"], run["algorithm_id"])
        results.append(done.get(key) or _normalize_one(spark, run_dir, run))
    return _store(run_dir, "normalize", results)


def _normalize_one(spark, run_dir: str, run: dict) -> dict:
    raw = run.get("raw_dot_copy")
    record = {"algorithm_id": run["algorithm_id"], "dataset_id": run["dataset_id"], "raw_dot": raw, "normalized_dot": None}
    if not raw or not os.path.exists(raw):
        return record | {"status": "MISSING_RAW_DOT", "message": "no DOT file to convert"}
    if "full" in os.path.basename(run.get("raw_dot_source") or raw).lower():
        return record | {"status": "OK", "message": "already full", "normalized_dot": raw}
    target = os.path.join(run_dir, "normalize", f"{run['algorithm_id']}__{run['dataset_id']}__full_{time.time_ns()}")
    try:
        graph = dot.read_dot(spark, raw, loose_breaks=True, free=True)
        full = G.expand(graph)
        G.validate(full)
        dot.write_dot(dot.expanded_lines(full), target)
    except Exception as e:  # noqa: BLE001  a bad file is a result of this stage
        return record | {"status": "CONVERSION_FAILED", "message": str(e).split("\n")[0][:300]}
    return record | {"status": "OK", "message": "converted to full", "normalized_dot": target}


def _compare(spark, run_dir, root, cases, limit, resume) -> bool:
    results, matrix = [], {}
    by_dataset: dict[str, dict[str, str]] = {}
    for r in load(run_dir, "normalize").get("results", []):
        if r["status"] == "OK":
            by_dataset.setdefault(r["dataset_id"], {})[r["algorithm_id"]] = r["normalized_dot"]
    for dataset, files in sorted(by_dataset.items()):
        row = matrix.setdefault(dataset, {})
        graphs: dict[str, G.Graph] = {}
        for left, right in combinations(sorted(files), 2):
            record = {"dataset_id": dataset, "left_algorithm": left, "right_algorithm": right}
            try:
                for a in (left, right):
                    if a not in graphs:
                        graphs[a] = dot.read_dot(spark, files[a], free=True)
                report = C.compare_graphs(graphs[left], graphs[right]).summary().first().asDict()
                record |= {"status": "OK", "equivalent": report["equivalent"], "report": report,
                           "returncode": 0 if report["equivalent"] else 1}
            except Exception as e:  # noqa: BLE001  a bad file is a result of this stage
                record |= {"status": "COMPARE_FAILED", "equivalent": None, "returncode": 1, "message": str(e).split("\n")[0][:300]}
            results.append(record)
            row[f"{left}__vs__{right}"] = record["equivalent"]
    return _store(run_dir, "compare", results, equivalence_matrix=matrix)


def _report(spark, run_dir, root, cases, limit, resume) -> bool:
    path = os.path.join(run_dir, "report", REPORT)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report_text(spark, run_dir) + "\n")
    with open(_index(run_dir, "report"), "w", encoding="utf-8") as f:
        json.dump({"stage": "report", "generated_at": now_iso(), "report_path": path}, f, indent=2)
    return True


# -- reports -------------------------------------------------------------------


def _byte_cells(spark, rows: list[dict]) -> list[dict]:
    """The byte columns of run records as text."""
    if not rows:
        return []
    df = spark.createDataFrame([{f.name: r.get(f.name) for f in configs.EXECUTION} for r in rows], configs.EXECUTION)
    text = df.select(*[format_bytes(F.col(p)).alias(p) for p in R.PEAKS]).collect()
    return [r | t.asDict() for r, t in zip(rows, text)]


def report_text(spark: SparkSession, run_dir: str) -> str:
    """The Markdown report of one run folder."""
    execution, normalize, compare = (load(run_dir, s) for s in configs.STAGES[:3])
    runs = execution.get("results", [])
    timeouts = execution.get("timeout_events", [])
    out = [f"# {reports.TITLE} - {os.path.basename(os.path.abspath(run_dir))}", "", f"{reports.STAMP}: {now_iso()}", ""]

    def section(key, *body):
        out.extend([f"## {reports.SECTIONS[key]}", "", *body, ""])

    section(
        "summary", *(f"- {reports.COUNTS[s]}: {r.get('total_pairs', r.get('total_cases', 0))}"
                     for s, r in (("execution", execution), ("normalize", normalize), ("compare", compare))),
        f"- Timeouts: {len(timeouts)}",
    )
    titles = reports.EXECUTION_TITLES
    if runs:
        df = spark.createDataFrame([{f.name: r.get(f.name) for f in configs.EXECUTION} for r in runs], configs.EXECUTION)
        rolled = R.formatted(R.roll_up(df)).orderBy("algorithm_id").collect()  # one row per algorithm
        table = [{"Algo": r.algorithm_id, "Cas": r.cases} | {titles[p]: r[p] for p in R.PEAKS} for r in rolled]
        section("resources", reports.markdown_table(table, list(table[0])))
    shown = []
    for r in _byte_cells(spark, runs):
        cells = {t: r.get(c) for c, t in titles.items()}
        cells["Timeout"] = "yes" if r.get("timed_out") else "no"
        cells["DOT copié"] = "yes" if r.get("raw_dot_copy") else "no"
        shown.append({t: "" if v is None else v for t, v in cells.items()})
    section("execution", reports.markdown_table(shown, list(titles.values())))
    shown = [
        {t: r.get(c) for c, t in reports.NORMALIZE_TITLES.items()} | {"DOT normalisé": "yes" if r.get("normalized_dot") else "no"}
        for r in normalize.get("results", [])
    ]
    section("normalize", reports.markdown_table(shown, list(reports.NORMALIZE_TITLES.values())))
    verdict = {True: "true", False: "false", None: "NA"}
    shown = [
        {"Dataset": r["dataset_id"], "Pair": f"{r['left_algorithm']} vs {r['right_algorithm']}", "Status": r["status"],
         "Equivalent": verdict[r["equivalent"]]}
        for r in compare.get("results", [])
    ]
    section("compare", reports.markdown_table(shown, list(reports.COMPARE_TITLES.values())))
    lines = []
    for dataset, row in sorted(compare.get("equivalence_matrix", {}).items()):
        lines.append(f"- {dataset}")
        lines += [f"  - {pair}: {value}" for pair, value in sorted(row.items())] or ["  - no comparisons"]
    section("matrix", *(lines or ["no comparisons"]))
    if timeouts:
        shown = [{"Dataset": t["dataset_id"], "Algo": t["algorithm_id"], "Timeout(s)": t["timeout_seconds"], "At": t["at"]} for t in timeouts]
        section("timeouts", reports.markdown_table(shown, list(shown[0])))
    return "\n".join(out)


def compile_reports(spark: SparkSession, pattern: str, first: str = "") -> DataFrame:
    """One row per dataset over many reports: runs that ended well or not, size of the
    largest group of equivalent algorithms, and time, memory and disk per algorithm.

    ``first`` names the algorithm whose columns come before the others.
    """
    rows = reports.read_tables(spark, pattern)

    def table(section: str, titles: dict[str, str]) -> DataFrame:
        picked = rows.where(F.col("section") == reports.SECTIONS[section])
        return picked.select("path", *[F.col("cells").getItem(t).alias(c) for c, t in titles.items()])

    runs = table("execution", reports.EXECUTION_TITLES)
    pairs = table("compare", reports.COMPARE_TITLES)
    verdicts = pairs.select(
        F.col("dataset_id").alias("dataset"), F.trim(F.split("pair", " vs ")[0]).alias("left"),
        F.trim(F.split("pair", " vs ")[1]).alias("right"), (F.lower("equivalent") == "true").alias("equivalent"),
    )
    ok = runs.where(F.upper("status") == "OK").select(F.col("dataset_id").alias("dataset"), F.col("algorithm_id").alias("producer"))
    groups = C.equivalence_group_sizes(ok, verdicts)
    metrics = {"Temps": "elapsed_seconds", "RAM": "peak_rss_bytes", "Disque max": "total_written_bytes"}
    wide = R.pivot_runs(runs, metrics, R.algorithm_order(runs, first))
    return (
        wide.join(groups.withColumnRenamed("dataset", "dataset_id"), "dataset_id", "left")
        .withColumn("n_equivalent", F.coalesce("n_equivalent", F.lit(0)).cast("bigint"))
    )


def compiled_text(spark: SparkSession, pattern: str, title: str, first: str = "") -> str:
    """The Markdown roll-up of many reports, datasets in natural order."""
    table = compile_reports(spark, pattern, first).orderBy(natural_key(F.col("dataset_id")), "dataset_id")
    rest = [c for c in table.columns if c not in ("dataset_id", "ok", "failed", "n_equivalent")]
    rows = [  # one row per dataset
        {"Dataset": r.dataset_id, "OK / failed": f"{r.ok}/{r.failed}", "Largest equivalent group": r.n_equivalent}
        | {f"{c} (s)" if c.startswith("Temps ") else c: r[c] for c in rest}
        for r in table.collect()
    ]
    if not rows:
        raise FileNotFoundError(f"no report matches {pattern}")
    out = [f"# {title}", "", f"{len(rows)} datasets, written {now_iso()}", "",
           "## All datasets", "", reports.markdown_table(rows, list(rows[0])), "", "## Dataset by dataset", ""]
    details: dict[str, dict[str, list[dict]]] = {}
    for r in reports.read_tables(spark, pattern).orderBy("path", "section", "at").collect():  # rows of short reports
        details.setdefault(r.cells.get("Dataset", ""), {}).setdefault(r.section, []).append(r.cells)
    about = {
        t.path: t.generated_at for t in reports.read_titles(spark, pattern).collect()
    }
    out += [f"- Source: {p} ({at})" for p, at in sorted(about.items())] + [""]
    for row in rows:
        out += [f"### {row['Dataset']}", ""]
        for heading, key, titles in (
            ("Execution", "execution", reports.EXECUTION_TITLES), ("Normalize", "normalize", reports.NORMALIZE_TITLES),
            ("Compare", "compare", reports.COMPARE_TITLES),
        ):
            found = details.get(row["Dataset"], {}).get(reports.SECTIONS[key], [])
            out += [f"#### {heading}", "", reports.markdown_table(found, list(titles.values())), ""]
    return "\n".join(out).rstrip() + "\n"
