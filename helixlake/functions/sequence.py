"""Column expressions over bases and presence patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Region classes in order of their ids, the first being the default.
CLASSES = ["unique", "SD", "ct", "mon", "dhor", "hor", "hor_active", "bsat", "gsat", "hsat1A", "hsat1B", "hsat2", "hsat3", "censat", "rDNA"]
#: Subjects by lineage, shallow to deep, with approximate divergence times in million years.
LINEAGES = [("human_specific", ["hg002"], 0.0), ("pan", ["chimp", "bonobo"], 6.4), ("gorilla", ["gorilla"], 9.0), ("pongo", ["borang", "sorang"], 15.5), ("hylobatid", ["siamang"], 19.5)]
#: Bins of the capped multiplicity.
COPY_BINS = [(1, 1, "1"), (2, 2, "2"), (3, 9, "3-9"), (10, 99, "10-99"), (100, 254, "100-254"), (255, 255, ">=255")]
#: Label families of the second annotation release.
FAMILIES = {"active_hor": "hor_active", "hor": "hor", "dhor": "dhor", "mon": "mon", "ct": "ct", "bSat": "bsat", "gSat": "gsat", "HSat1A": "hsat1A", "HSat1B": "hsat1B", "HSat2": "hsat2", "HSat3": "hsat3", "cenSat": "censat", "rDNA": "rDNA", "mixedAlpha": "hor"}


def has_bit(pattern: Column, bit: int) -> Column:
    return pattern.bitwiseAND(1 << bit) != 0


def mask_of(names: Sequence[str], subjects: Sequence[str]) -> int:
    return sum(1 << i for i, s in enumerate(subjects) if s in names)


def has_any(pattern: Column, names: Sequence[str], subjects: Sequence[str]) -> Column:
    return pattern.bitwiseAND(mask_of(names, subjects)) != 0


def age_index(pattern: Column, subjects: Sequence[str]) -> Column:
    """0 for none, else 1.. for the deepest lineage present; absence from shallower ones is ignored."""
    out = F.lit(0)
    for i, (_, names, _) in enumerate(LINEAGES, 1):
        out = F.when(has_any(pattern, names, subjects), i).otherwise(out)
    return out


def age_label(pattern: Column, subjects: Sequence[str]) -> Column:
    """The lineage's label; subjects of no lineage alone give not_in_hg002_but_in_ape."""
    index = age_index(pattern, subjects)
    out = F.when(pattern == 0, "chm13_only").when(index == 0, "not_in_hg002_but_in_ape")
    for i, (label, _, _) in enumerate(LINEAGES, 1):
        out = out.when(index == i, label)
    return out


def copy_bin(mult: Column) -> Column:
    out = None
    for low, high, name in COPY_BINS:
        out = (F if out is None else out).when(mult.between(low, high), name)
    return out


def region_class(label: Column, release: str = "chm13") -> Column:
    """The class of an annotation label, null where it has none."""
    base = F.substring_index(label, "(", 1)
    family = F.split(base, "_")[0]
    rest = F.substring(label, F.length(base) + 1, F.length(label))
    if release == "chm13":
        active = rest.rlike(r"L\)$|L,")
        found = F.when((family == "hor") & active, "hor_active").otherwise(family)
        return F.when(found.isin(CLASSES), found)
    family = F.when(base.startswith("active"), "active_hor").otherwise(family)
    out = None
    for name, cls in FAMILIES.items():
        out = (F if out is None else out).when(family == name, cls)
    return out


def share(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole, null where there is nothing to share."""
    out = F.try_divide(part.cast("double"), whole.cast("double"))
    return out if digits is None else F.round(out, digits)
