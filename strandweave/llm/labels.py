"""Language labels in many spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def language_of(label: Column | str, aliases: DataFrame) -> Column:
    """The code of a label by the alias table (fixed, small), or null."""
    pairs = [x for r in aliases.where("alias is not null and lang_code is not null").distinct().orderBy("alias").collect() for x in (F.lit(r["alias"]), F.lit(r["lang_code"]))]
    c = F.col(label) if isinstance(label, str) else label
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(c))) if pairs else F.lit(None).cast("string")
