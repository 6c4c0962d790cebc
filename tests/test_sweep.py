"""The thread sweep: settings, trials, errors, results as CSV, sources of git tags."""

import os
import subprocess

import pytest
from test_codec import make_file

from braidspark.cli import sweep


def test_settings(tmp_path, capsys):
    config = tmp_path / "c.toml"
    config.write_text("threads = [1, 0]\nrepeats = 2\n[tools]\nengine = [2, 2, 1]\n")
    own = sweep.settings(["x.bam", "--config", str(config)]).sweep
    assert own.repeats == 2 and not own.cold and [t for t in own.trials() if t[1] == "engine"] == [("", "engine", 2), ("", "engine", 1)]
    assert sweep.settings(["x.bam", "--config", str(config), "--threads", "3", "--cold"]).sweep.threads["engine"] == [3]
    plain = sweep.settings(["x.bam", "--config", str(tmp_path / "none")]).sweep
    assert plain == sweep.Sweep("x.bam") and "missing" in capsys.readouterr().err
    assert len([t for t in plain.trials() if t[1] == "engine"]) == len({1, 2, 4, 8, os.cpu_count()})


def test_results_and_errors(tmp_path, monkeypatch):
    path, rows = make_file(tmp_path, 800, n=30)
    monkeypatch.setitem(sweep.COUNTERS, "engine", ["-c", "raise RuntimeError('broken')"])
    out = str(tmp_path / "r.csv")
    assert sweep.main([path, "--threads", "1,2", "--repeats", "2", "--tag", "t", "--csv", out]) == 0
    lines = open(out).read().splitlines()
    assert lines[0] == "tag,tool,threads,elapsed_s,throughput_mb_s,records,error" and len(lines) == 4
    assert lines[1].endswith("RuntimeError: broken") and lines[3].startswith("t,sequential,1,") and lines[3].endswith(f",{len(rows)},")
    monkeypatch.setitem(sweep.COUNTERS, "engine", ["-c", "print(3)"])
    assert sweep.main([path, "--threads", "1", "--repeats", "1"]) == 1


def test_fastest_run_counts():
    import pandas as pd

    runs = pd.DataFrame([{"tag": "", "tool": "a", "threads": 1, "elapsed_s": s, "records": 5, "error": ""} for s in (2.0, 1.0)])
    assert sweep.summary(runs, 7.0)[["elapsed_s", "throughput_mb_s", "records"]].values.tolist() == [[1.0, 7.0, 5]]


def test_tags(tmp_path, monkeypatch):
    repo = tmp_path / "repo"
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    repo.mkdir()
    git("init", "-q")
    for tag in ("one", "two"):
        (repo / "which.py").write_text(f"print({len(tag) if tag == 'one' else 4})")
        git("add", "-A")
        git("commit", "-qm", tag)
        git("tag", tag)
    path, _ = make_file(tmp_path, 800, n=3)
    monkeypatch.setattr(sweep, "ROOT", str(repo))
    monkeypatch.setattr(sweep, "COUNTERS", {"engine": ["-m", "which"], "sequential": ["-m", "which"]})
    out = str(tmp_path / "r.csv")
    assert sweep.main([path, "--tags", "one,two,none", "--threads", "1", "--repeats", "1", "--csv", out]) == 1
    lines = [line.split(",") for line in open(out).read().splitlines()[1:]]
    assert [(x[0], x[1], x[5]) for x in lines[:4]] == [("one", "engine", "3"), ("one", "sequential", "3"), ("two", "engine", "4"), ("two", "sequential", "4")]
    assert lines[4][0] == "none" and lines[4][6]
    assert len(subprocess.run(["git", "-C", str(repo), "worktree", "list"], capture_output=True, text=True).stdout.splitlines()) == 1


@pytest.mark.parametrize("threads", [1, 3])
def test_sequential_counter(tmp_path, threads):
    path, rows = make_file(tmp_path, 800, n=30)
    assert sweep.Sweep(path).observe("", "sequential", threads)["records"] == len(rows)
