"""Corrections as an append-only log, replayed by one merge.

A step is a table of the rows that one correction changes: the row id and, for each
target, what the cell was and became, in its own types. A step is written once to
shared storage, so its conditions are evaluated once, and counts, findings and the
corrected table all read it. The corrected table is one join of the base with the
last change of each cell, however many corrections there were. A run that lost its
driver goes on behind the last step that was written.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.sqltext import quote
from tallyward.operators.checks import ROW, Replacement, replaced_cells


@dataclass(frozen=True)
class Step:
    key: str
    targets: tuple[str, ...]
    #: the row id, and for target i a column c_i of (before, after), null where the cell stays
    rows: DataFrame

    def counts(self) -> list[int]:
        """The number of changed cells of each target."""
        return list(self.rows.agg(*[F.count(f"c_{i}") for i in range(len(self.targets))]).first())

    def cells(self, i: int) -> DataFrame:
        """(row, before, after) of the changed cells of target i."""
        return self.rows.filter(f"c_{i} IS NOT NULL").select(F.col(ROW).alias("row"), f"c_{i}.before", f"c_{i}.after")

    def kinds(self) -> dict:
        return {t: self.rows.schema[f"c_{i}"].dataType["after"].dataType for i, t in enumerate(self.targets)}


def step_rows(data: DataFrame, replacements: Sequence[Replacement]) -> DataFrame:
    """The rows of a step that makes all replacements at once; rows without a change are left out."""
    cells = [c.alias(f"c_{i}") for i, c in enumerate(replaced_cells(replacements))]
    some = " OR ".join(f"c_{i} IS NOT NULL" for i in range(len(cells)))
    return data.select(ROW, *cells).filter(some)


class ChangeLog:
    """The steps of one table under one folder.

    The folder belongs to that table: a step is found again by the schema of the table and the texts of all
    steps up to it, not by the values, so another table needs another folder.

    Defined cases: a step without changes is written empty; a null that is set and a value that is
    set to null are changes; a cell changed by several steps has its last value; rows of the log whose id the
    table lacks are ignored; a column takes the type of the last step that has it as a target.
    """

    def __init__(self, base: DataFrame, folder: str):
        self.base, self.folder = base, folder.rstrip("/")
        self.steps: list[Step] = []
        self._origin = hashlib.sha256(base.schema.json().encode()).hexdigest()

    def _written(self, path: str) -> bool:
        spark = self.base.sparkSession
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)

    def record(self, text: str, targets: Sequence[str], rows: Callable[[], DataFrame]) -> Step:
        """Append a step that `text` identifies; its rows are computed only if it is not there yet."""
        before = self.steps[-1].key if self.steps else self._origin
        key = hashlib.sha256(f"{before}\n{text}".encode()).hexdigest()
        path = f"{self.folder}/{len(self.steps):05d}-{key[:32]}"
        if not self._written(path):
            rows().write.mode("overwrite").parquet(path)  # over what a lost run left half done
        step = Step(key, tuple(targets), self.base.sparkSession.read.parquet(path))
        self.steps.append(step)
        return step

    def merged(self) -> DataFrame:
        """The table after all steps."""
        kinds: dict = {}
        for step in self.steps:
            kinds |= step.kinds()
        if not kinds:
            return self.base
        parts = []
        for n, step in enumerate(self.steps):
            own = {t: f"c_{i}" for i, t in enumerate(step.targets)}
            cells = []
            for j, (t, kind) in enumerate(kinds.items()):
                value = F.col(f"{own[t]}.after").cast(kind) if t in own else F.lit(None).cast(kind)
                cell = F.struct(F.lit(n).alias("step"), value.alias("value"))
                cells.append(F.when(F.col(own[t]).isNotNull() if t in own else F.lit(False), cell).alias(f"l_{j}"))
            parts.append(step.rows.select(F.col(ROW).alias("__at"), *cells))
        every = functools.reduce(DataFrame.unionByName, parts)
        last = every.groupBy("__at").agg(*[F.max_by(f"l_{j}", f"l_{j}.step").alias(f"l_{j}") for j in range(len(kinds))])
        last = last.select("__at", F.struct(*[f"l_{j}" for j in range(len(kinds))]).alias("__last"))
        place = {t: j for j, t in enumerate(kinds)}
        columns = []
        for name in self.base.columns:
            column = F.col(quote(name))
            if name in place:
                new = F.col(f"__last.l_{place[name]}")
                column = F.when(new.isNotNull(), new["value"]).otherwise(column.cast(kinds[name]))
            columns.append(column.alias(name))
        return self.base.join(last, F.col(ROW) == F.col("__at"), "left").select(*columns)

    def history(self) -> DataFrame:
        """(step, row, column, before, after) of every change, as text."""
        parts = [
            step.cells(i).select(F.lit(n).alias("step"), "row", F.lit(t).alias("column"), F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after"))
            for n, step in enumerate(self.steps)
            for i, t in enumerate(step.targets)
        ]
        if not parts:
            return self.base.sparkSession.createDataFrame([], "step int, row long, column string, before string, after string")
        return functools.reduce(DataFrame.unionByName, parts)
