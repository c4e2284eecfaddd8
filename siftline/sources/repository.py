"""Snapshots and diffs of a Git repository, by its own command on the driver; what they give is read by Spark."""

from __future__ import annotations

import subprocess
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from siftline.sources.corpus import from_folder

ZERO = "0" * 40


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def snapshot(spark: SparkSession, repo: str, commit: str, folder: str) -> DataFrame:
    """The files of a commit, unpacked to `folder` (which the executors have to see) and read by from_folder()."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    archive = Path(folder, "commit.tar")
    archive.write_bytes(_git(repo, "archive", "--format=tar", commit))
    with tarfile.open(archive) as t:
        t.extractall(Path(folder, "tree"), filter="data")
    return from_folder(spark, str(Path(folder, "tree").absolute()), project=Path(repo).name)


def pushed_diff(repo: str, local: str, remote: str) -> str:
    """The unified diff of a push; of the commit alone where the remote has nothing yet."""
    return (_git(repo, "diff", f"{remote}..{local}") if remote != ZERO else _git(repo, "show", local)).decode(errors="replace")


def pushed_files(repo: str, local: str, remote: str) -> list[str]:
    """The files that a push changes."""
    out = _git(repo, "diff", "--name-only", f"{remote}..{local}") if remote != ZERO else _git(repo, "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", local)
    return out.decode(errors="replace").split("\n")[:-1]
