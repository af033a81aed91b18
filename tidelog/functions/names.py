"""Names of files and directories, as Columns and as Python strings, and their validation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT_FILE = re.compile(r"^(\d{8})\.json$")
AUDIT_FILE = re.compile(r"^(\d+)-(\d+)(?:\.(\d+))?\.jsonl$")


def segment_file(seq: int) -> str:
    return f"{seq:08d}.json"


def segment_file_col(seq: Column) -> Column:
    return F.concat(F.lpad(seq.cast("string"), 8, "0"), F.lit(".json"))


def block_locator(block_id: str) -> str:
    return f"blocks/{block_id}.parquet"


def audit_file(attempt: int, rank: int, part: int | None = None) -> str:
    return f"{attempt}-{rank}.jsonl" if part is None else f"{attempt}-{rank}.{part}.jsonl"


def checkpoint_name(segment: int, cursor: int, world_size: int, attempt: int = 0) -> str:
    return f"checkpoint_g{segment:06d}_p{cursor * world_size:06d}_n{world_size:02d}_a{attempt:02d}"


def checkpoint_name_col(segment: Column, cursor: Column, world_size: Column, attempt: Column) -> Column:
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat(F.lit("checkpoint_g"), pad(segment, 6), F.lit("_p"), pad(cursor * world_size, 6), F.lit("_n"), pad(world_size, 2), F.lit("_a"), pad(attempt, 2))


#: What a producer prints for each commit (fixed value).
COMMIT_LINE = r"committed segment (\d+)\b.*? at (\d+(?:\.\d+)?)"


def commit_lines(lines: Column) -> tuple[Column, Column]:
    """(segment, time) of a producer's line, null for others."""
    number, when = (F.regexp_extract(lines, COMMIT_LINE, i) for i in (1, 2))
    return F.when(number != "", number).cast("long"), F.when(when != "", when).cast("double")


def valid_block_id(block_id: Column) -> Column:
    """Not empty, no slash, no leading dot."""
    return F.coalesce(block_id.rlike(r"^[^./][^/]*$"), F.lit(False))


def valid_locator(locator: Column) -> Column:
    """Relative, without empty or ``..`` components."""
    parts = F.split(locator, "/")
    return F.coalesce(~F.exists(parts, lambda p: (p == "") | (p == "..")), F.lit(False))


def check_block_id(block_id: str) -> str:
    if not isinstance(block_id, str) or not re.fullmatch(r"[^./][^/]*", block_id):
        raise ValueError(f"bad block id {block_id!r}")
    return block_id


def check_locator(locator: str) -> str:
    if not locator or any(part in ("", "..") for part in locator.split("/")):
        raise ValueError(f"bad locator {locator!r}")
    return locator
