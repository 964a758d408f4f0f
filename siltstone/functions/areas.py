"""Research areas and layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Areas of the data model and the spellings that stand for them (fixed values).
AREAS = ("RWA", "ESG", "ZK-IoV", "DID", "DePIN", "MEV", "Stablecoins")
ALIASES = {"rwa": "RWA", "esg": "ESG", "zk-iov": "ZK-IoV", "zk_iov": "ZK-IoV", "zkiov": "ZK-IoV", "did": "DID", "depin": "DePIN", "mev": "MEV", "stablecoins": "Stablecoins", "stablecoin": "Stablecoins"}
#: Weight of evidence by layer (fixed values); 0.5 for others.
LAYER_WEIGHTS = {"literature": 1.0, "regulation": 1.0, "failure": 0.95, "opensource": 0.9, "practitioner": 0.85, "lab": 0.8, "company": 0.75, "funding": 0.7, "dataavailability": 0.7, "investment": 0.35, "hackathon": 0.25}
#: What a record of a layer signals (fixed values); general_signal for others.
SIGNALS = {"funding": "funding_signal", "regulation": "compliance_requirement", "failure": "failure_mode", "hackathon": "prototype_challenge", "company": "market_need", "practitioner": "practitioner_pain_point", "opensource": "engineering_gap", "dataavailability": "evaluation_support", "lab": "research_activity", "literature": "research_problem", "investment": "capital_signal"}


def lookup(values: dict, key: Column, default: Column) -> Column:
    """values[key], or default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), default)


def area(raw: Column) -> Column:
    """One spelling per known area; unknown ones pass, blank ones are null."""
    text = F.nullif(F.trim(raw), F.lit(""))
    return lookup(ALIASES, F.lower(text), text)


def layer_name(layer: Column) -> Column:
    """A layer's name without punctuation and blanks, in lower case."""
    return F.regexp_replace(F.lower(layer), "[^a-z0-9]", "")


def layer_weight(layer: Column, explicit: Column | None = None, said: Column | None = None) -> Column:
    """C4: weight of evidence of a layer. explicit is a weight that the record states, kept within 0 and 1; said is the text of
    its fields, which may call it emerging demand (0.25 at most) or market validation (0.35 at most)."""
    name, base = layer_name(layer), lookup(LAYER_WEIGHTS, layer_name(layer), F.lit(0.5))
    text = F.lower(F.coalesce(said, F.lit(""))) if said is not None else F.lit("")
    out = F.when((name == "hackathon") | text.contains("emerging_demand"), F.least(base, F.lit(0.25)))
    out = out.when((name == "investment") | text.contains("market validation"), F.least(base, F.lit(0.35))).otherwise(base)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), explicit.try_cast("double"))), out) if explicit is not None else out


def signal(layer: Column) -> Column:
    """Signal type of a layer."""
    return lookup(SIGNALS, layer_name(layer), F.lit("general_signal"))


def sql_case(values: dict, key: str, default: str) -> str:
    """The same lookup as SQL."""
    quote = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + f" ELSE {default} END"


AREA_SQL = sql_case(ALIASES, "lower(nullif(trim(research_area), ''))", "nullif(trim(research_area), '')")
