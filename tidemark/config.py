"""Settings of a build."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """is_dev and dev_window_days limit the appointment fact to its last days; as_of stands for today.

    databases maps a layer's prefix to the database its tables are kept in, by its plain name.
    """

    is_dev: bool = False
    dev_window_days: int = 90
    as_of: str | None = None
    databases: tuple[tuple[str, str], ...] = (("stg", "staging"), ("int", "intermediate"), ("dim", "marts"), ("fct", "marts"), ("mart", "product"), ("agg", "executive"))

    def database(self, model: str) -> str:
        return dict(self.databases)[model.split("_")[0]]
