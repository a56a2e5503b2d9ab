"""Access levels and the row filter that every search goes through."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def permitted(level: Column) -> Column:
    """Levels that a user of ``level`` may read; unknown levels read PUBLIC alone."""
    return (
        F.when(level == "RESTRICTED", F.array(F.lit("PUBLIC"), F.lit("INTERNAL"), F.lit("RESTRICTED")))
        .when(level == "INTERNAL", F.array(F.lit("PUBLIC"), F.lit("INTERNAL")))
        .otherwise(F.array(F.lit("PUBLIC")))
    )


def levels_of(level: str) -> list[str]:
    """The same for one level."""
    every = ["PUBLIC", "INTERNAL", "RESTRICTED"]
    return every[: 1 + every.index(level)] if level in every else every[:1]


def decide(level: str, service: Callable[[dict], bool | dict] | None = None, claims: dict | None = None) -> tuple[bool, list[str], str | None]:
    """(allowed, levels, reason) by a policy service; without one, or where it fails, by the level alone.

    A service that says yes or no gives all levels to RESTRICTED users and two to others; one that gives an object is taken at
    its word, with two levels where it names none.
    """
    if service is not None:
        try:
            got = service(claims or {})
            if isinstance(got, bool):
                return got, levels_of("RESTRICTED" if level == "RESTRICTED" else "INTERNAL"), None
            return bool(got.get("allowed", False)), got.get("permitted_access_levels", levels_of("INTERNAL")), got.get("denied_reason")
        except Exception:
            pass
    return True, levels_of(level), None


def decided(level: Column, said: Column) -> Column:
    """struct(allowed, levels) of a policy's answer as JSON: a boolean, an object, or null where it gave none."""
    two, three = (F.array(*[F.lit(x) for x in levels_of(x)]) for x in ("INTERNAL", "RESTRICTED"))
    got = F.from_json(said, "allowed boolean, permitted_access_levels array<string>")
    plain = F.trim(said).isin("true", "false")
    levels = F.when(said.isNull(), permitted(level)).when(plain, F.when(level == "RESTRICTED", three).otherwise(two)).otherwise(F.coalesce(got["permitted_access_levels"], two))
    allowed = F.when(said.isNull(), True).when(plain, F.trim(said) == "true").otherwise(F.coalesce(got["allowed"], F.lit(False)))
    return F.struct(allowed.alias("allowed"), levels.alias("levels"))


def secured(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of ``chunks`` each query may see: same tenant, same base if the query names one, level permitted.

    An empty list of levels gives no rows.
    """
    q = queries.select("query_id", F.col("tenant_id").alias("q_tenant"), F.col("knowledge_base_id").alias("q_kb"), "levels")
    c = chunks.withColumn("access_classification", F.coalesce("access_classification", F.lit("INTERNAL")))
    on = (c.tenant_id == q.q_tenant) & (q.q_kb.isNull() | (c.knowledge_base_id == q.q_kb)) & F.array_contains(q.levels, c.access_classification)
    return c.join(q, on).drop("q_tenant", "q_kb", "levels")
