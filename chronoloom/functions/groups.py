"""Names and groups of the features."""

from __future__ import annotations

import json
import re
from pathlib import Path

# The names that users ask for. A number stands for the members of a family, from 0.
_GROUPS: dict[str, list[str | tuple[str, int]]] = {
    "statistics": [
        "Interquartile range",
        "Kurtosis",
        "Max",
        "Mean",
        "Mean absolute deviation",
        "Mean absolute diff",
        "Mean diff",
        "Median",
        "Median absolute deviation",
        "Median absolute diff",
        "Median diff",
        "Min",
        "Skewness",
        "Standard deviation",
        "Sum absolute diff",
        "Variance",
    ],
    "distribution": [("ECDF Percentile Count", 2), ("ECDF Percentile", 2), ("ECDF", 10), ("Histogram", 10)],
    "complexity_peaks": ["Autocorrelation", "Negative turning points", "Positive turning points", "Neighbourhood peaks", "Zero crossing rate"],
    "time_shape_energy": ["Absolute energy", "Area under the curve", "Entropy", "Root mean square", "Signal distance", "Slope", "Peak to peak distance"],
    "spectral_frequency": [
        "Average power",
        "Centroid",
        "Fundamental frequency",
        "Human range energy",
        "Max power spectrum",
        "Maximum frequency",
        "Median frequency",
        "Power bandwidth",
        "Spectral centroid",
        "Spectral decrease",
        "Spectral distance",
        "Spectral entropy",
        "Spectral kurtosis",
        "Spectral positive turning points",
        "Spectral roll-off",
        "Spectral roll-on",
        "Spectral skewness",
        "Spectral slope",
        "Spectral spread",
        "Spectral variation",
    ],
    "cepstral": [("LPCC", 12), ("MFCC", 12)],
    "wavelet": [("Wavelet absolute mean", 9), ("Wavelet energy", 9), "Wavelet entropy", ("Wavelet standard deviation", 9), ("Wavelet variance", 9)],
}


def _expand(entry: str | tuple[str, int]) -> list[str]:
    return [f"0_{entry}"] if isinstance(entry, str) else [f"0_{entry[0]}_{i}" for i in range(entry[1])]


GROUPS: dict[str, list[str]] = {g: [n for e in entries for n in _expand(e)] for g, entries in _GROUPS.items()}
ALL_FEATURES: list[str] = [n for names in GROUPS.values() for n in names]
#: Bulky columns that are dropped by their prefix.
PRUNED_PREFIX = "0_FFT mean coefficient"


def snake(name: str) -> str:
    """A column name for SQL."""
    return re.sub(r"[^a-z0-9]+", "_", name.removeprefix("0_").lower()).strip("_")


def load_group(path: str | Path) -> list[str]:
    """Names of a group file: a JSON list, a JSON object with ``features``, or lines such as ``3. name``. Blank
    and non-text entries, and lines of ``===``, are dropped."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        told = json.loads(text)
    except json.JSONDecodeError:
        lines = [re.sub(r"^\d+\.\s*", "", x.strip()) for x in text.splitlines() if "===" not in x]
        return [x for x in lines if x]
    entries = told.get("features", []) if isinstance(told, dict) else told
    return [x.strip() for x in entries if isinstance(x, str) and x.strip()]


def resolve(groups: list[str] | None) -> list[str]:
    """The features of the groups, in the order of ALL_FEATURES. An entry is a group's name, also as that of a
    file (``statistics.json``), a feature's name or the path of a group file; an unknown one is an error. None or
    nothing: all."""
    if not groups:
        return list(ALL_FEATURES)
    wanted: set[str] = set()
    for g in groups:
        if g in GROUPS:
            wanted.update(GROUPS[g])
        elif g in ALL_FEATURES:
            wanted.add(g)
        elif Path(g).is_file():
            wanted.update(load_group(g))
        elif g.removesuffix(".json") in GROUPS:
            wanted.update(GROUPS[g.removesuffix(".json")])
        else:
            raise ValueError(f"unknown feature or group: {g}")
    if unknown := wanted - set(ALL_FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return [n for n in ALL_FEATURES if n in wanted] or list(ALL_FEATURES)
