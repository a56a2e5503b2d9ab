"""Enrichment of chunks from an industry's configuration."""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Configurations that come with the package, one file an industry.
OWN = Path(__file__).resolve().parent.parent / "config"
# The configuration of an industry without a file of its own.
GENERIC = {
    "domain": "generic",
    "entity_types": [],
    "relation_types": [],
    "security_classifications": ["PUBLIC", "INTERNAL", "RESTRICTED"],
    "chunking_rules": {"parent_token_range": [1024, 2048], "child_token_range": [128, 256]},
}


@lru_cache(256)
def load_config(folder: str | None, industry: str) -> dict:
    """The industry's JSON file in ``folder``, or that of the package if none is named; the generic one if it is missing or broken."""
    try:
        got = json.loads((Path(folder) / f"{industry}.json" if folder else OWN / f"{industry}.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        got = dict(GENERIC)
    got["relation_types"] = [r.get("name", "") if isinstance(r, dict) else r for r in got.get("relation_types", [])]
    return got


def default_level(config: dict) -> str:
    levels = config.get("security_classifications") or []
    return "INTERNAL" if "INTERNAL" in levels or not levels else levels[0]


def hints_of(config: dict) -> dict[str, str]:
    """What a configuration adds to the metadata of a chunk; lists and objects as JSON."""
    plain = lambda x: json.dumps(x, separators=(",", ":"))
    return {
        "entity_type_hints": plain(config.get("entity_types", [])),
        "relation_type_hints": plain(config.get("relation_types", [])),
        "chunking_rules": plain(config.get("chunking_rules", {})),
        "domain_config_version": config.get("version", "1.0"),
    }


def enrich_all(chunks: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """``enrich`` for chunks with an ``industry`` each, by the configurations of these."""
    spark = chunks.sparkSession
    rows = [(k, default_level(c), hints_of(c)) for k, c in configs.items()]
    known = spark.createDataFrame(rows, "industry string, level_ string, hints_ map<string,string>")
    own = F.coalesce(F.from_json("metadata", "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    level = F.coalesce("access_classification", F.lit("INTERNAL"))
    out = chunks.join(F.broadcast(known), "industry", "left")  # one row a configuration
    rest = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys("hints_"), k))
    return out.withColumns({
        "industry_domain": F.col("industry"),
        "access_classification": F.when(level == "INTERNAL", F.col("level_")).otherwise(level),
        "metadata_map": F.map_concat(rest, "hints_"),
    }).drop("level_", "hints_")


def enrich(chunks: DataFrame, config: dict, industry: str = "manufacturing") -> DataFrame:
    """Adds the industry, the default level where a chunk has none or INTERNAL, and the hints to the metadata map."""
    return enrich_all(chunks.withColumn("industry", F.lit(industry)), {industry: config}).drop("industry")
