"""Panel description shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class PanelSpec:
    """Names of the key columns of an entity x year (x month) panel.

    ``chunk`` is the column used to split one entity's history into
    independently processed pieces (default: the year). Window operators
    partition by ``(entity, chunk)`` and carry state across chunks through a
    small per-chunk summary, so one hot entity never lands in one task.
    """

    entity: str = "fips"
    year: str = "year"
    month: str | None = "month"
    target: str | None = None
    chunk: str | None = None

    @property
    def time_cols(self) -> list[str]:
        return [self.year] + ([self.month] if self.month else [])

    @property
    def keys(self) -> list[str]:
        return [self.entity] + self.time_cols

    @property
    def chunk_col(self) -> str:
        return self.chunk or self.year

    def window(self) -> WindowSpec:
        """``W(e)``: per entity, ordered by time."""
        return Window.partitionBy(self.entity).orderBy(*self.time_cols)

    def with_target(self, target: str) -> "PanelSpec":
        return PanelSpec(self.entity, self.year, self.month, target, self.chunk)
