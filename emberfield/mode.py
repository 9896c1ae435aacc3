"""Label thresholds for the two run modes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Mode:
    """Thresholds of the category rule.

    ``frequent``: repeats from which a cell counts as a persistent emitter.
    ``wildfire_frp``: radiative power (MW) that marks a sudden strong fire.
    ``repeat_below``: exclusive upper bound of repeats for field burning.
    """

    name: str
    frequent: int
    wildfire_frp: float
    repeat_below: int


# Fixed threshold values.
NRT = Mode("nrt", frequent=3, wildfire_frp=7.0, repeat_below=3)
ARCHIVE = Mode("archive", frequent=5, wildfire_frp=14.0, repeat_below=5)

MODES = {m.name: m for m in (NRT, ARCHIVE)}
