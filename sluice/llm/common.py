"""What the training-data operators share: column names of their own, words, and the size of Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..tables import cut, delete, new_path, numbered, qualified, release, scratch, setting, shared_dir, spread_join  # noqa: F401

#: White space that separates words: the six ASCII characters of the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: Whole texts that go to a Python worker at once.
ARROW_ROWS = 500


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column has it (case aside)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with "_in" appended to the columns that have an operator's own names, and every column's new name by its old one."""
    mine = {c.lower() for c in own}
    taken = {c.lower() for c in df.columns} | mine
    names = {}
    for c in df.columns:
        names[c] = c
        if c.lower() in mine:
            while names[c].lower() in taken:
                names[c] += "_in"
            taken.add(names[c].lower())
    return df.toDF(*names.values()), names


def bound_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """At most ``rows`` rows in an Arrow batch of this session, so that batches of long texts stay small.

    It only lowers the setting, and leaves it so: a lazy result is planned after
    the operator has returned.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
