"""Height sources by name: each name stands for a function that gives a raster as a table of cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources import readers

Provider = Callable[[SparkSession], DataFrame]


class UnknownSource(LookupError):
    """A source that nothing is registered for."""


class Providers:
    """A registry of providers; a provider gives cells (rr, cc, v). Nothing is read before the raster is used, so a window reaches the provider's scan."""

    def __init__(self) -> None:
        self._known: dict[str, Provider] = {}

    def register(self, name: str, provider: Provider) -> None:
        """A name stands for one provider; the last one registered counts. Names with a colon are kept for files."""
        if ":" in name:
            raise ValueError(f"a source's name has no colon: {name}")
        self._known[name] = provider

    def names(self) -> list[str]:
        return sorted(self._known)

    def resolve(self, source: str, size: float) -> Provider:
        """The provider of a name, or of files: ``xyz:path`` (lists of x y z, the highest counts) and ``grid:path`` (ASCII grid, rows from the top)."""
        kind, _, path = source.partition(":")
        if path and kind == "xyz":
            return lambda spark: readers.xyz_cells(spark, path, size)
        if path and kind == "grid":
            return lambda spark: readers.ascii_grid(spark, path)
        if source in self._known:
            return self._known[source]
        raise UnknownSource(f"no source of heights is called {source}")

    def raster(self, spark: SparkSession, source: str, window: tuple[int, int, int, int], size: float) -> DataFrame:
        """Cells (rr, cc, v) of a source in a window (first row and column, past the last ones); cells without a height are left out."""
        r0, c0, r1, c1 = window
        inside = (F.col("rr") >= r0) & (F.col("rr") < r1) & (F.col("cc") >= c0) & (F.col("cc") < c1)
        return self.resolve(source, size)(spark).select("rr", "cc", "v").where(inside & F.col("v").isNotNull())
