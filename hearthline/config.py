"""Settings of a run. There is no wall clock anywhere: the valuation date is given."""

from __future__ import annotations

import dataclasses
import datetime
import os

#: The districts that are loaded unless others are named.
DEFAULT_PREFIXES = ("W8", "SW7", "SW5", "SW3")


#: The least and usual limits of training.
LEAST_TRAINING_ROWS, USUAL_TRAINING_ROWS, LEAST_TARGET, USUAL_TARGET = 500, 0, 1_000_000, 50_000_000
YES, NO_LIMIT = ("1", "true", "yes", "y"), ("ALL", "FULL", "NONE", "0")


def _joined(text: str) -> str:
    return "".join(text.upper().split())


def parse_prefixes(text: str | None) -> tuple[str, ...]:
    """A comma-separated list. ALL, alone, means no restriction; blanks drop out; nothing given, the usual ones."""
    if text is None:
        return DEFAULT_PREFIXES
    if _joined(text) == "ALL":
        return ()
    return tuple(filter(None, map(_joined, text.split(","))))


def limit_of(text: str | None, usual: int, least: int, unlimited: tuple[str, ...] = ()) -> int:
    """A whole number, least at the lowest; 0 for the words that mean no limit; the usual for anything else."""
    said = (text or "").strip().upper()
    if said in unlimited:
        return 0
    try:
        return max(least, int(said))
    except ValueError:
        return usual


@dataclasses.dataclass(frozen=True)
class EngineConfig:
    """What a run needs besides its input: most_rows of 0 is no limit."""

    as_of: datetime.date
    prefixes: tuple[str, ...] = DEFAULT_PREFIXES
    refresh: bool = False
    most_rows: int = USUAL_TRAINING_ROWS
    most_price: int = USUAL_TARGET

    @classmethod
    def from_environment(cls, as_of: datetime.date) -> EngineConfig:
        get = os.environ.get
        return cls(
            as_of,
            parse_prefixes(get("POSTCODE_PREFIXES")),
            get("REFRESH_PROCESSED_DATASETS", "").strip().lower() in YES,
            limit_of(get("ML_MAX_TRAINING_ROWS"), USUAL_TRAINING_ROWS, LEAST_TRAINING_ROWS, NO_LIMIT),
            limit_of(get("ML_MAX_TARGET_PRICE"), USUAL_TARGET, LEAST_TARGET),
        )
