"""Text and path functions of the library."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand between names at the end of a file name; slots of colours; default joiner and block separator.
BETWEEN_NAMES = r"[\s,;:+&/|()\[\]{}._-]+"
COLOUR_SLOTS = 8
JOINER, BLOCK = ", ", " "


def casefolded(text: Column) -> Column:
    """Text as it is compared without case: "Straße" and "STRASSE" alike, as are the two small sigmas; a dotless i keeps apart.

    Equal to full case folding but for Cherokee, which folds the other way, and a few letters with no plain capital.
    """
    held = F.translate(text, "ı\u1e9e", "\ue000ß")
    # with nothing in between, the optimizer would take lower(upper(x)) for lower(x)
    return F.translate(F.lower(F.translate(F.upper(held), "\ue000", "ı")), "ς", "σ")


def name_key(name: Column) -> Column:
    """What two spellings of a person's name share: all but blanks around it and case."""
    return casefolded(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def filename_of(path: Column) -> Column:
    """The last part of a path of either kind of separator."""
    return F.element_at(F.split(F.regexp_replace(path, r"\\", "/"), "/"), -1)


def to_unix_path(path: Column) -> Column:
    """A Windows path as its mounted Unix path, without the long-path prefix; other paths stay."""
    bare = F.regexp_replace(path, r"^\\\\\?\\", "")
    drive = F.lower(F.regexp_extract(bare, r"^([A-Za-z]):[\\/]", 1))
    rest = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z]:[\\/]", ""), r"\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), drive, F.lit("/"), rest)).otherwise(bare)


def to_display_path(path: Column) -> Column:
    """A mounted Unix path as the Windows path that it shows."""
    drive = F.upper(F.regexp_extract(path, r"^/mnt/([a-z])(?:/|$)", 1))
    rest = F.translate(F.regexp_replace(path, r"^/mnt/[a-z]/?", ""), "/", "\\")
    return F.when(drive != "", F.concat(drive, F.lit(":\\"), rest)).otherwise(path)


def colour_slot(name: Column) -> Column:
    """A slot from 1 to 8 for a name, 0 without one: a 32-bit hash over UTF-16 units; names outside the basic plane count code points."""
    codes = F.transform(F.filter(F.split(name, ""), lambda c: c != ""), F.ascii)
    wrap = lambda x: F.when(x.bitwiseAND(F.lit(0xFFFFFFFF)) >= 2**31, x.bitwiseAND(F.lit(0xFFFFFFFF)) - 2**32).otherwise(x.bitwiseAND(F.lit(0xFFFFFFFF)))
    # 31 * hash + code is what shifting by five and taking the hash away again gives
    hashed = F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: wrap(h * 31 + c))
    return F.when(name.isNull() | (name == ""), 0).otherwise((F.abs(hashed) % COLOUR_SLOTS + 1).cast("int")).cast("int")


def semver(text: Column) -> Column:
    """A version as an array of three numbers, which compare as versions do; null where it is none."""
    parts = [F.regexp_extract(text, r"^v?(\d+)\.(\d+)\.(\d+)$", i) for i in (1, 2, 3)]
    return F.when(parts[0] != "", F.array(*(F.try_cast(p, "int") if hasattr(F, "try_cast") else p.try_cast("int") for p in parts)))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds of two ISO timestamps, not below zero; null where either can't be read."""
    micros = lambda x: F.unix_micros(F.try_to_timestamp(x))
    gone = (micros(end) - micros(start)) / 1e6
    return F.when(gone > 0, gone).when(gone.isNotNull(), 0.0)


def format_summary(joiner: str = JOINER, block: str = BLOCK) -> str:
    return f"DATEI{block}Name 1{joiner}Name 2.jpg"


def distinct_names(names) -> list[str]:
    """Names in order, blank ones left out, the first spelling of each kept."""
    found: dict[str, str] = {}
    for n in names if names is not None else ():
        if n and n.strip():
            found.setdefault(n.strip().casefold(), n.strip())
    return list(found.values())


def trailing_names(stem: str, names: list[str], block: str = BLOCK) -> tuple[str, list[str]]:
    """(root, names): the known names that end a stem after some block separator, the earliest that leaves a root.

    Names are compared without case, the longest first; between two of them stands something of BETWEEN_NAMES.
    """
    if not stem or not names or not block:
        return stem, []
    longest = sorted(names, key=lambda n: (-len(n), n))
    between = re.compile(BETWEEN_NAMES)

    def read(rest: str) -> list[str]:
        found, at = [], 0
        while at < len(rest):
            if found:
                gap = between.match(rest, at)
                if not gap:
                    return []
                at = gap.end()
            hit = next((n for n in longest if rest[at : at + len(n)].casefold() == n.casefold()), None)
            if hit is None:
                return []
            found.append(hit)
            at += len(hit)
        return found

    at = stem.find(block)
    while at >= 0:
        rest = stem[at + len(block) :].strip()
        if at > 0 and rest and (found := read(rest)):
            return stem[:at], found
        at = stem.find(block, at + len(block))
    return stem, []


def rename_of(filename: str, names, block: str = BLOCK, joiner: str = JOINER) -> dict | None:
    """The file name that ends in the people found in the image; null where nothing is to change."""
    wanted = distinct_names(names)
    if not filename or not wanted:
        return None
    stem, extension = os.path.splitext(filename)
    root, current = trailing_names(stem, wanted, block)
    proposed = f"{root or stem}{block}{joiner.join(wanted)}".strip() + extension
    if proposed == filename and current == wanted:
        return None
    return {"current_filename": filename, "proposed_filename": proposed, "detected_person_names": wanted, "current_suffix_person_names": current}


RENAME = "current_filename string, proposed_filename string, detected_person_names array<string>, current_suffix_person_names array<string>"


def rename_preview(filename: Column, names: Column, block: str = BLOCK, joiner: str = JOINER) -> Column:
    """``rename_of`` over columns, a batch of rows at a time."""

    @F.pandas_udf(RENAME)
    def preview(files: pd.Series, people: pd.Series) -> pd.DataFrame:
        empty = dict.fromkeys(c.split()[0] for c in RENAME.split(", "))
        return pd.DataFrame([rename_of(f, p, block, joiner) or empty for f, p in zip(files, people, strict=True)], columns=list(empty))

    return preview(filename, names)


def bbox_for_orientation(orientation: Column, width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """A face box turned by the EXIF orientations 3, 6 and 8; others leave it."""
    box = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("w"), d.alias("h"))
    return (
        F.when(orientation == 3, box(width - x - w, height - y - h, w, h)).when(orientation == 6, box(height - y - h, x, h, w))
        .when(orientation == 8, box(y, width - x - w, h, w)).otherwise(box(x, y, w, h))
    )
