"""python -m braidspark.cli.sweep BAM [BAI] [--config FILE.toml] [--threads 1,2,0] [--repeats N] [--cold] [--tag NAME | --tags A,B] [--csv FILE]

Times the count of all records, by this engine at several thread counts and by the sequential reader. The trials of a sweep go
round by round, so that a machine's drift meets all of them alike; of each, the fastest round is reported with MiB of
compressed file a second. A trial that fails is reported with its error and the others go on; the exit status is 1
where counts differ. 0 threads stands for all cores. The TOML file may hold `threads`, `repeats`, `cold` and a table `tools` of
thread lists (`engine`, `sequential`); the command line goes before it, and a file that is missing counts as empty.
--tags runs the engine of each git tag of this repository, from a worktree of its own.
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import tempfile
import time
import tomllib
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import dataclass, field

import pandas as pd

from braidspark.sources.files import file_size

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: What a run of one counter prints last is the number of records.
COUNTERS = {
    "engine": ["-m", "braidspark.cli.count", "-t", "{threads}", "{bam}", "{bai}"],
    "sequential": ["-c", "import sys; from braidspark.api import sequential_count as f; print(f(sys.argv[1], int(sys.argv[2]))[0])", "{bam}", "{threads}"],
}
#: Columns of the result, in the order of other harnesses' files.
COLUMNS = ["tool", "threads", "elapsed_s", "throughput_mb_s", "records", "error"]


@dataclass(frozen=True)
class Sweep:
    bam: str
    bai: str = ""
    threads: dict[str, list[int]] = field(default_factory=lambda: {"engine": [1, 2, 4, 8, 0], "sequential": [1]})
    repeats: int = 3
    cold: bool = False
    #: name -> folder of the sources to run
    sources: dict[str, str] = field(default_factory=lambda: {"": ROOT})

    def trials(self) -> Iterator[tuple[str, str, int]]:
        """(tag, counter, threads) of one round."""
        for tag in self.sources:
            for tool, wanted in self.threads.items():
                cores = [n if n else os.cpu_count() or 1 for n in wanted]
                yield from ((tag, tool, n) for i, n in enumerate(cores) if n not in cores[:i])

    def run(self) -> pd.DataFrame:
        """One row for each run of a trial: tag, tool, threads, elapsed_s, records, error."""
        rows = []
        for _ in range(self.repeats):
            for tag, tool, threads in self.trials():
                if self.cold:
                    forget_pages()
                rows.append({"tag": tag, "tool": tool, "threads": threads, **self.observe(tag, tool, threads)})
        return pd.DataFrame(rows)

    def observe(self, tag: str, tool: str, threads: int) -> dict:
        """One run in a process of its own, its start included, as one that a user would make."""
        words = [w.format(threads=threads, bam=self.bam, bai=self.bai) if w.startswith("{") else w for w in COUNTERS[tool]]
        environment = os.environ | {"PYTHONPATH": self.sources[tag]}
        began = time.perf_counter()
        done = subprocess.run([sys.executable, *filter(None, words)], capture_output=True, text=True, check=False, env=environment, cwd=os.path.dirname(os.path.abspath(self.bam)))
        seconds = time.perf_counter() - began
        said = done.stdout.split()
        if done.returncode or not said or not said[-1].isdecimal():
            return {"elapsed_s": None, "records": None, "error": (done.stderr.strip().splitlines() or [f"exit {done.returncode}"])[-1]}
        return {"elapsed_s": seconds, "records": int(said[-1]), "error": ""}


def forget_pages() -> None:
    """Empty the page cache, where this process may."""
    with suppress(OSError), open("/proc/sys/vm/drop_caches", "w") as f:
        f.write("1")


def summary(runs: pd.DataFrame, mib: float) -> pd.DataFrame:
    """A row for each trial: its fastest run, or the first error."""
    keys = ["tag", "tool", "threads"]
    failed = runs[runs.error != ""].groupby(keys, sort=False).error.first()
    best = runs.groupby(keys, sort=False).agg(elapsed_s=("elapsed_s", "min"), records=("records", "max")).join(failed)
    best["error"] = best.error.fillna("")
    best.loc[best.error != "", ["elapsed_s", "records"]] = None
    best["throughput_mb_s"] = mib / best.elapsed_s.astype(float)
    best["records"] = best.records.astype("Int64")
    return best.reset_index()[["tag", *COLUMNS]]


@contextmanager
def checkout(tag: str):
    """A worktree of a git tag of this repository, removed afterwards."""
    with tempfile.TemporaryDirectory(prefix="braidspark-tag-") as folder:
        git = ["git", "-C", ROOT, "worktree"]
        subprocess.run([*git, "add", "--detach", f"{folder}/tree", tag], check=True, capture_output=True)
        try:
            yield f"{folder}/tree"
        finally:
            subprocess.run([*git, "remove", "--force", f"{folder}/tree"], check=False, capture_output=True)


def settings(argv: list[str] | None) -> argparse.Namespace:
    """The command line over the TOML file over the defaults."""
    usage = argparse.ArgumentParser(prog="sweep", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    usage.add_argument("bam")
    usage.add_argument("bai", nargs="?", default="")
    usage.add_argument("--config", default="")
    usage.add_argument("--threads", type=lambda text: [int(n) for n in text.split(",")])
    usage.add_argument("--repeats", type=int)
    usage.add_argument("--cold", action="store_true", default=None)
    usage.add_argument("--tag", default="")
    usage.add_argument("--tags", type=lambda text: text.split(","), default=[])
    usage.add_argument("--csv")
    given = usage.parse_args(argv)
    stored: dict = {}
    if given.config:
        try:
            with open(given.config, "rb") as f:
                stored = tomllib.load(f)
        except FileNotFoundError:
            print(f"{given.config} is missing and counts as empty", file=sys.stderr)
    plain = Sweep(given.bam)
    own = stored.get("tools", {})
    engine = given.threads or own.get("engine") or stored.get("threads") or plain.threads["engine"]
    given.sweep = Sweep(given.bam, given.bai, {"engine": engine, "sequential": own.get("sequential", plain.threads["sequential"])}, given.repeats or stored.get("repeats", plain.repeats), stored.get("cold", False) if given.cold is None else True, {given.tag: ROOT})
    return given


def report(given: argparse.Namespace, runs: pd.DataFrame) -> pd.DataFrame:
    table = summary(runs, file_size(given.bam) / 2**20)
    return table if table.tag.any() else table.drop(columns="tag")


def main(argv: list[str] | None = None) -> int:
    given = settings(argv)
    if given.tags:
        found = []
        for tag in given.tags:
            try:
                with checkout(tag) as folder:
                    found += Sweep(**{**vars(given.sweep), "sources": {tag: folder}}).run().to_dict("records")
            except subprocess.CalledProcessError as e:
                found.append({"tag": tag, "tool": "engine", "threads": 0, "elapsed_s": None, "records": None, "error": (e.stderr or b"").decode().strip()})
        runs = pd.DataFrame(found)
    else:
        runs = given.sweep.run()
    table = report(given, runs)
    print(table.to_string(index=False))
    if given.csv:
        table.to_csv(given.csv, index=False)
    return int(runs.records.dropna().nunique() > 1)


if __name__ == "__main__":
    sys.exit(main())
