"""Column roles: which columns of a table are the time, the dimensions and the measures."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Roles:
    """Names the columns the operators should read; the library fixes no column name itself."""

    time: str
    dims: tuple[str, ...]
    measures: tuple[str, ...]
    region: str = "state"
    place: str = "location"
    text: str | None = None

    def require(self, columns) -> None:
        """Raise when a role names a column the table does not have."""
        wanted = {self.time, self.region, self.place, *self.dims, *self.measures}
        missing = sorted(wanted - set(columns))
        if missing:
            raise ValueError(f"columns named by roles are missing: {missing}")
