"""Column names of an epoch table, validity codes and source presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntFlag

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from epochloom.functions.time import epoch_seconds


@dataclass(frozen=True)
class EpochSchema:
    """Where an epoch table keeps what. One table holds all participants; a row is one epoch of one participant.

    ``row`` is an optional tie-break for epochs of equal time. ``day`` names the column that counts as day: operators
    that re-sequence days return a schema that points to the new column and leave the calendar day alone.
    """

    pid: str = "pid"
    time: str = "hyp_time_col"
    row: str | None = None
    activity: tuple[str, ...] = ("hyp_act_x",)
    hr: str | None = None
    mets: str | None = None
    annotation: str = "hyp_annotation"
    day: str = "hyp_exp_day"
    invalid: str = "hyp_invalid"
    wearing: str = "hyp_wearing"
    diary_onset: str = "hyp_diary_onset"
    diary_offset: str = "hyp_diary_offset"
    diary_sleep: str = "hyp_diary_sleep"
    freq_s: int = 30
    blocks: tuple[str, ...] = ()  # set by epochloom.operators.blocks

    def window(self, *by: str) -> WindowSpec:
        """Epochs of one participant (and of each of ``by``) in order of time."""
        return Window.partitionBy(self.pid, *self.blocks, *by).orderBy(self.time, *([self.row] if self.row else []))

    def window_back(self, *by: str) -> WindowSpec:
        """The same epochs from the last to the first. A running frame of it looks ahead in linear time, where a frame up
        to the unbounded following row is recomputed for every row."""
        return Window.partitionBy(self.pid, *self.blocks, *by).orderBy(*[F.col(c).desc() for c in (self.time, *([self.row] if self.row else []))])

    def seconds(self, df: DataFrame) -> Column:
        """Time of an epoch as whole seconds."""
        return epoch_seconds(F.col(self.time), df.schema[self.time].dataType)

    @property
    def per_minute(self) -> float:
        return 60.0 / self.freq_s

    @property
    def per_hour(self) -> float:
        return 3600.0 / self.freq_s

    def need(self, df: DataFrame, *columns: str) -> None:
        """Raise ``KeyError`` for a column that the table lacks."""
        for c in columns:
            if c not in df.columns:
                raise KeyError(f"no column {c!r}")

    def at(self, **changes) -> EpochSchema:
        return replace(self, **changes)


class InvCode(IntFlag):
    """Bits of the validity mask. Values are part of the data format."""

    FLAG_OKAY = 0
    FLAG_EPOCH_PA = 1
    FLAG_EPOCH_NON_WEARING = 2
    FLAG_EPOCH_NULL_VALUE = 4
    FLAG_DAY_SHORT_SLEEP = 8
    FLAG_DAY_LONG_SLEEP = 16
    FLAG_DAY_WITHOUT_DIARY = 32
    FLAG_DAY_NON_WEARING = 64
    FLAG_DAY_NOT_ENOUGH_VALID_EPOCHS = 128
    FLAG_DAY_NOT_ENOUGH_CONSECUTIVE_DAYS = 256
    FLAG_DAY_TOO_MANY_INVALID_EPOCHS = 512

    @classmethod
    def has(cls, mask: Column, code: InvCode) -> Column:
        return mask.bitwiseAND(int(code)) == int(code)


@dataclass(frozen=True)
class SourceConfig:
    """How a file format maps to the canonical columns."""

    activity: tuple[str, ...]
    datetime: str
    pid: str | None = None
    hr: str | None = None
    mets: str | None = None
    strftime: str | None = None
    day_of_week: str | None = None
    start_of_week: int = -1
    activity_counts: bool = False
    annotation: tuple[str, tuple[str, ...]] | None = None
    extra: dict = field(default_factory=dict)


#: File formats with fixed columns.
ACTIWATCH = SourceConfig(("activity",), "time", pid="pid", day_of_week="dayofweek", activity_counts=True, annotation=("interval", ("REST", "REST-S")))
MESA = SourceConfig(("activity",), "linetime", pid="mesaid", day_of_week="dayofweek", activity_counts=True, annotation=("interval", ("REST", "REST-S")))
HCHS = SourceConfig(("activity",), "time", pid="pid", day_of_week="dayofweek", activity_counts=True, annotation=("interval", ("REST", "REST-S")))
MMASH = SourceConfig(("Axis1", "Axis2", "Axis3"), "time", pid="pid", hr="HR", strftime="%Y-%b-%d %H:%M:%S")
