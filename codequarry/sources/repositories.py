"""Fetching repositories into a folder on the driver: reuse, a time limit, a size limit."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.files import git_url_parts

SECONDS, MEGABYTES = 120, 500


def url_parts(spark: SparkSession, url: str) -> tuple[str, str, str] | None:
    """host, owner, repo of an address on a known host."""
    row = spark.createDataFrame([(url,)], "url string").select(*git_url_parts(F.col("url"))).first()
    return (row.host, row.owner, row.repo) if row.host else None


def is_url(spark: SparkSession, text: str) -> bool:
    return text.startswith(("http://", "https://")) or url_parts(spark, text) is not None


def clone_url(host: str, owner: str, repo: str) -> str:
    return f"https://{host}/{owner}/{repo}.git"


def repository_size(files: DataFrame) -> DataFrame:
    """megabytes: of files(size)."""
    return files.agg((F.coalesce(F.sum("size"), F.lit(0)) / (1024 * 1024)).alias("megabytes"))


def folder_megabytes(folder: Path) -> float:
    return sum(p.stat().st_size for p in folder.rglob("*") if p.is_file()) / (1024 * 1024)


def fetch(source: str, target: Path, force: bool = False, seconds: int = SECONDS, megabytes: int = MEGABYTES) -> Path:
    """A shallow clone of source (an address that git takes, or a local repository) in target. A clone that is there is used again unless
    force; one that is too large is removed and refused."""
    if target.exists() and not force:
        return target
    if target.exists():
        shutil.rmtree(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    done = subprocess.run(["git", "clone", "--depth", "1", "--single-branch", source, str(target)], capture_output=True, text=True, timeout=seconds, check=False)
    if done.returncode:
        raise RuntimeError(f"git clone failed: {done.stderr.strip()[:500]}")
    size = folder_megabytes(target)
    if size > megabytes:
        shutil.rmtree(target)
        raise ValueError(f"repository has {size:.0f} MB, more than {megabytes}")
    return target
