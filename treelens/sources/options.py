"""Scan options from an INI file without sections, and which options exclude each other (SRC10, FLT7, PRJ4, SET1)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from configparser import ConfigParser

#: The spellings of a switch.
ON, OFF = ("y", "t", "1", "yes", "true"), ("n", "f", "0", "no", "false")


def _switch(value: str) -> bool:
    word = value.lower()
    if word not in ON + OFF:
        raise ValueError("is neither on nor off")
    return word in ON


#: Names of the options.
NAMES = ("kernel", "cve", "exclude", "exploit", "verbose", "files", "ignore_files", "kernel_config", "check_strict", "report", "all_files", "metadata", "arch")
KINDS: dict[str, Callable[[str], object]] = {"verbose": int}
KINDS |= dict.fromkeys(("cve", "exclude", "files", "ignore_files"), str.split) | dict.fromkeys(("check_strict", "all_files", "exploit"), _switch)


def parse(text: str) -> dict[str, object]:
    """Options by name: lists, switches and the number by KINDS, any other as text; ValueError names what can't be read."""
    reader = ConfigParser()
    reader.read_string("[options]\n" + text)
    out: dict[str, object] = {}
    for name, value in reader["options"].items():
        try:
            out[name] = KINDS.get(name, str)(value)
        except ValueError as wrong:
            raise ValueError(f"option {name} = {value!r}: {wrong}") from None
    return out


def layers(*texts: str) -> dict[str, object]:
    """Options of several files, later ones overriding; ValueError for names that there aren't (SET1, SET2)."""
    out: dict[str, object] = {}
    for text in texts:
        out |= parse(text)
    if unknown := sorted(set(out) - set(NAMES)):
        raise ValueError(f"unknown options: {', '.join(unknown)}")
    return out


def merged(layered: Mapping[str, object], given: Mapping[str, object], defaults: Mapping[str, object]) -> dict[str, object]:
    """Given options override the files' ones unless they are the defaults (PRJ4)."""
    return dict(layered) | {name: value for name, value in given.items() if value != defaults.get(name) or name not in layered}


def check(options: Mapping[str, object]) -> None:
    """Scanning all files leaves nothing for choosing rules by their files to do (FLT7)."""
    if options.get("all_files") and (clash := [n for n in ("files", "ignore_files") if options.get(n)]):
        raise ValueError(f"all_files can't be used with {', '.join(clash)}")


def layered(files):
    """(path, name, value) of options files (path, layer, content): for each path the layers in order, later ones overriding; values as text."""
    import pandas as pd

    def of_path(rows: pd.DataFrame) -> pd.DataFrame:
        found = layers(*rows.sort_values("layer")["content"])
        return pd.DataFrame([(rows["path"].iloc[0], name, " ".join(v) if isinstance(v, list) else str(v)) for name, v in found.items()], columns=["path", "name", "value"])

    return files.groupBy("path").applyInPandas(of_path, "path string, name string, value string")
