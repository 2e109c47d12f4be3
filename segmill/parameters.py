"""Parameters of the segment operators."""

from __future__ import annotations

from dataclasses import dataclass

# Phrases that the rules for advertisement blocks look for.
TRANSITIONS = (
    "nach einer kurzen unterbrechung",
    "bleiben sie dran",
    "wir sind gleich wieder da",
    "gleich geht es weiter",
)
PROMOTIONS = (
    "tickets",
    "infos",
    "anmeldung",
    "weitere informationen",
    "sparen sie",
    "rabatt",
    "vorteilscode",
    "jetzt buchen",
    "besuchen sie",
    "mehr erfahren",
)


@dataclass(frozen=True)
class Parameters:
    """Times are seconds. bridge_gap and block_gap bound the silence inside a block, max_gap the one inside a cut."""

    transitions: tuple[str, ...] = TRANSITIONS
    promotions: tuple[str, ...] = PROMOTIONS
    bridge_gap: float = 5.0
    block_gap: float = 5.0
    max_gap: float = 20.0
    min_duration: float = 5.0
    chunk_size: int = 600


DEFAULT = Parameters()
