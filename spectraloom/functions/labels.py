"""Isobaric labels: channels in order of mass, and the mass of the label."""

from __future__ import annotations

# Channel names and monoisotopic masses as the reagents' makers give them.
CHANNELS = {
    2: ["126", "127"],
    6: ["126", "127", "128", "129", "130", "131"],
    10: ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131"],
    11: ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C"],
    16: ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C", "132N", "132C", "133N", "133C", "134N"],
    18: ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C", "132N", "132C", "133N", "133C", "134N", "134C", "135N"],
}
MASS = {2: 225.155833, 6: 229.162932, 10: 229.162932, 11: 229.162932, 16: 304.207146, 18: 304.207146}


def channels(plex: int) -> list[str]:
    if plex not in CHANNELS:
        raise ValueError(f"no {plex}-plex label; there are {sorted(CHANNELS)}")
    return CHANNELS[plex]
