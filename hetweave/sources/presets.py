"""Layers of three public citation and film networks, by the numbers of their archives."""

from __future__ import annotations

# fixed values: what the archives' node and link types mean
ACM = {
    "target": "0",
    "main_types": ("0", "1", "2"),
    "semantic_types": ("3",),
    "core_links": ("2", "3", "4", "5"),
    "term_paths": {"0": ("6",), "1": ("3", "6"), "2": ("5", "6")},
    "half_paths": {"PAP": ("2",), "PSP": ("4",), "PTP": ("6",)},
    "strong_types": ("0",),
}
DBLP = {
    "target": "0",
    "main_types": ("0", "1", "3"),
    "semantic_types": ("2",),
    "core_links": ("0", "2", "3", "5"),
    "term_paths": {"0": ("0", "1"), "1": ("1",), "3": ("5", "1")},
    "half_paths": {"APA": ("0",), "APVPA": ("0", "2"), "APTPA": ("0", "1")},
    "strong_types": ("0",),
}
IMDB = {
    "target": "0",
    "main_types": ("0", "1", "2"),
    "semantic_types": ("3",),
    "core_links": ("0", "1", "2", "3"),
    "term_paths": {"0": ("4",), "1": ("1", "4"), "2": ("3", "4")},
    "half_paths": {"MDM": ("0",), "MAM": ("2",), "MKM": ("4",)},
    "strong_types": ("0",),
}
PRESETS = {"ACM": ACM, "DBLP": DBLP, "IMDB": IMDB}
