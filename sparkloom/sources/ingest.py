"""Declared sources: folders and git repositories as one table of files, and their readers by file name."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources import files as F_
from sparkloom.sources import markdown, office, transcripts

HISTORY = "path string, commit string, date timestamp"
FILES = "source string, path string, modified timestamp, content binary, text string, finding string, commit string, last_modified timestamp"


@dataclass(frozen=True)
class Origin:
    """A source: a folder that executors can read, or a git repository that the driver clones into `checkout` first."""

    name: str
    root: str
    git: str | None = None
    ref: str = "HEAD"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    ignore: str = ""
    #: Folders below the root that this engine writes itself.
    outputs: tuple[str, ...] = field(default=())


def git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], check=True, capture_output=True, text=True).stdout


def cloned(origin: Origin) -> None:
    """The repository at `origin.git` under `origin.root`, without blobs that the checkout does not need; fetched anew where
    it is there already."""
    if not Path(origin.root, ".git").exists():
        subprocess.run(["git", "clone", "--quiet", "--filter=blob:none", "--no-checkout", "--end-of-options", origin.git, origin.root], check=True, capture_output=True)
    git(origin.root, "fetch", "--quiet", "origin")
    git(origin.root, "checkout", "--quiet", "--force", "--detach", origin.ref)


def log_rows(output: str) -> Iterable[tuple[str, str, int]]:
    """(path, commit, seconds) of the newest commit of each path, from `git log --name-only -z` with a header a commit."""
    seen: set[str] = set()
    commit, at = "", 0
    for token in output.split("\0"):
        token = token.strip("\n")
        if token.startswith("commit:"):
            _, commit, when = token.split(" ", 2)
            when, _, first = when.partition("\n")
            at, token = int(when), first.strip("\n")
        if token and token not in seen:
            seen.add(token)
            yield token, commit, at


def history(spark: SparkSession, folder: str) -> DataFrame:
    """HISTORY of a working tree: the last commit of each path; paths that differ from it are left out, so that the time of
    their change counts.  One row a file, made on the driver from one `git log`."""
    changed = {e[3:] for e in git(folder, "status", "--porcelain", "-z").split("\0") if len(e) > 3}
    rows = [(p, c, t) for p, c, t in log_rows(git(folder, "log", "-m", "--first-parent", "--name-only", "-z", "--format=commit: %H %ct")) if p not in changed]
    return spark.createDataFrame(rows, "path string, commit string, seconds long").select("path", "commit", F.col("seconds").cast("timestamp").alias("date"))


def ingested(spark: SparkSession, origins: list[Origin]) -> tuple[DataFrame, DataFrame]:
    """(files (FILES), findings (check, source, message)) of all sources; one that cannot be read gives
    W-SOURCE-UNREACHABLE and no files, and stops nothing.  Dates are those of the last commit, else of the file."""
    found, bad = [spark.createDataFrame([], FILES)], []
    for o in origins:
        try:
            if o.git:
                cloned(o)
            own = tuple(f"{x.strip('/')}/**" for x in o.outputs) + (".git/**",)
            rows = F_.read_files(spark, o.root, source=o.name, include=list(o.include) or None, exclude=[*o.exclude, *own], ignore=o.ignore)
            tree = Path(o.root.removeprefix("file://"), ".git").exists()
            past = history(spark, o.root.removeprefix("file://")) if tree else spark.createDataFrame([], HISTORY)
            found.append(F_.with_history(rows, past).select(*(c.split()[0] for c in FILES.split(", "))))
        except (OSError, subprocess.CalledProcessError, AnalysisException) as e:
            bad.append(("W-SOURCE-UNREACHABLE", o.name, str(getattr(e, "stderr", None) or e).strip().splitlines()[0] if str(e) else type(e).__name__))
    return reduce(DataFrame.unionByName, found), spark.createDataFrame(bad, "check string, source string, message string")


@dataclass(frozen=True)
class Reader:
    """What reads the files of some endings: a table of (path, content, text) to a table with a path column."""

    name: str
    endings: tuple[str, ...]
    read: Callable[[DataFrame], DataFrame]


READERS = (
    Reader("markdown", (".md",), markdown.parse_notes),
    Reader("transcripts", (".vtt", ".srt"), transcripts.cues),
    Reader("documents", (".docx", ".pptx", ".xlsx", ".pdf"), office.document_properties),
)


def dispatched(files: DataFrame, readers: tuple[Reader, ...] = READERS) -> tuple[dict[str, DataFrame], DataFrame]:
    """(what each reader reads of its files, the files that none reads): by the first reader whose ending a path has.  Files
    of several sources go by `source/path`."""
    key = F.concat_ws("/", "source", "path") if "source" in files.columns else F.col("path")
    rows = files.withColumn("path", key)
    lower = F.lower("path")
    fits = [reduce(or_, (lower.endswith(e) for e in r.endings)) for r in readers]
    chosen = F.coalesce(*(F.when(f, F.lit(r.name)) for f, r in zip(fits, readers)))
    rows = rows.withColumn("reader", chosen)
    return {r.name: r.read(rows.where(F.col("reader") == r.name)) for r in readers}, rows.where("reader is null").drop("reader")
