"""The skill dictionary as an inline table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.model import SKILLS


def skill_dictionary(spark: SparkSession) -> DataFrame:
    """``(col, skill, skill_pos)``, one row per tracked skill."""
    rows = ", ".join(f"('{col}', '{name}', {i})" for i, (col, name) in enumerate(SKILLS.items(), 1))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(col, skill, skill_pos)")


def with_skill_name(df: DataFrame) -> DataFrame:
    """Attach the skill name to rows that hold a flag-column name in ``col``."""
    return df.join(F.broadcast(skill_dictionary(df.sparkSession)), "col")
