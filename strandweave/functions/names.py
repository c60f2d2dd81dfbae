"""Names of variants, measures and result columns, as columns where they depend on data and as text where they don't."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stages of the data, with short and display names.
STAGES = {"raw": ("RAW", "Raw"), "normal": ("NC", "Correlated"), "non_normal": ("NN", "Non-normal")}
RESAMPLED = "resampled_"
# Names under which measures are shown.
SHOWN = {"SCW": "SWC", "PMB": "PBM"}


def is_resampled(stage: Column) -> Column:
    return F.contains(stage, F.lit(RESAMPLED))


def resampled_stage(rule: str) -> str:
    return RESAMPLED + rule


def rule_of(stage: Column) -> Column:
    """The rule of a resampled stage; any other stage stays as it is."""
    return F.replace(stage, F.lit(RESAMPLED), F.lit(""))


def _named(stage: Column, at: int, resampled: str) -> Column:
    out = F.when(is_resampled(stage), resampled)
    for s, names in STAGES.items():
        out = out.when(stage == s, names[at])
    return out.otherwise(stage)


def stage_key(stage: Column) -> Column:
    return _named(stage, 0, "RS")


def stage_display(stage: Column) -> Column:
    return _named(stage, 1, "Downsampled")


def variation_name(stage: Column, extension: Column) -> Column:
    """Key, extension and rule, as far as there are any, with blanks between."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", stage_key(stage), some(extension), F.when(is_resampled(stage), rule_of(stage)))


def irregular_extension(folder: Column) -> Column:
    """`p30` of a folder that ends in `_p30`; empty for others."""
    return F.regexp_extract(folder, r"_(p\d+)$", 1)


def custom_order(value: Column, order: list[str]) -> Column:
    """The 1-based place of a value in an order of one's own; null if it is not in it."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value)
    return F.when(place > 0, place.cast("int"))


def frequency_code(seconds: Column) -> Column:
    """The largest unit that fits a time step, in whole numbers: 2D, 3h, 1min, 5s."""
    whole = lambda unit, code: F.concat(F.floor(seconds / unit).cast("string"), F.lit(code))
    return F.when(seconds >= 86400, whole(86400, "D")).when(seconds >= 3600, whole(3600, "h")).when(seconds >= 60, whole(60, "min")).otherwise(whole(1, "s"))


def distribution_name(text: Column) -> Column:
    """The family in the printed form of a fitted distribution."""
    return F.regexp_extract(text, r"_distns\.(\w+)_gen", 1)


def shown_measure(name: str) -> str:
    return SHOWN.get(name, name)


def correlation_column(internal: str, external: str) -> str:
    return f"r {internal}, {external}"


def measure_column(internal: str, measure: str) -> str:
    return f"{internal}: {measure}"


def compared(a: str, b: str) -> str:
    return f"{a} vs {b}"


def reduction_column(internal: str, n_dropped: int, kind: str) -> str:
    return f"{internal}: {n_dropped} {kind}"


def file_safe(text: str) -> str:
    """A name for files and folders: lower case, runs of other signs as one dash."""
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
