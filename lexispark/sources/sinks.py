"""Sinks: blank-line-separated text, split tables, JSON reports, conditional promotion of a model."""

from __future__ import annotations

import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rstrip_newlines


def write_program_text(df: DataFrame, path: str) -> int:
    """One file, byte-exact: records without newlines at their ends, a blank line between, one newline last. Streamed through the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        for (source,) in df.orderBy("ord").select(rstrip_newlines(F.col("source"))).toLocalIterator(prefetchPartitions=True):
            f.write("\n\n" * (n > 0) + source)
            n += 1
        f.write("\n")
    return n


def write_program_parts(df: DataFrame, path: str) -> int:
    """The same records as many text files in a folder, for corpora that no single file should hold; their number."""
    df.repartitionByRange("ord").sortWithinPartitions("ord").select(rstrip_newlines(F.col("source"))).write.mode("overwrite").option("lineSep", "\n\n").text(path)
    return df.count()


def write_report(report: dict, path: str) -> str:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(report, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return path


def promote(model_dir: str, registry_dir: str, allowed: bool) -> bool:
    """Copies a model folder over the registered one, which is kept beside it as .old; only if allowed."""
    if not allowed:
        return False
    target = Path(registry_dir)
    if target.exists():
        old = target.with_name(target.name + ".old")
        shutil.rmtree(old, ignore_errors=True)
        target.rename(old)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copytree(model_dir, target)
    return True
