"""Expressions over addresses and verification notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VANITY = "0x000000000"
# What shows that a source belongs to a factory.
FACTORY_WORDS = ["create2(", "deploybytecode", "clonefactory", "contract factory", "factory contract", "deploycontract("]


def is_vanity(address: Column) -> Column:
    return F.lower(address).startswith(VANITY)


def leading_zeros(address: Column) -> Column:
    """Zeros after 0x of a vanity address, else 0."""
    return F.when(is_vanity(address), F.length(F.regexp_extract(F.substring(address, 3, 64), "^(0*)", 1))).otherwise(0)


def vanity_class(address: Column) -> Column:
    z = leading_zeros(address)
    return F.when(~is_vanity(address), "normal").when(z >= 8, "8 or more").when(z >= 4, "4 to 7").otherwise("other")


def contract_name(notes: Column) -> Column:
    """The first word after the last 'Contract:', else Unknown."""
    last = F.trim(F.element_at(F.split(notes, "Contract:"), -1))
    word = F.element_at(F.split(last, r"\s+"), 1)
    return F.when(F.contains(notes, F.lit("Contract:")) & (word != ""), word).otherwise("Unknown")


def executed_count(notes: Column) -> Column:
    """The number after the first word 'executed' that is followed by one."""
    return F.regexp_extract(notes, r"(?:^|\s)executed\s+(\d+)(?:\s|$)", 1).try_cast("bigint")


def name_class(name: Column) -> Column:
    """The first class whose word the name holds."""
    return F.when(F.contains(name, F.lit("Factory")), "factory").when(F.contains(name, F.lit("Mint")), "mint").when(F.contains(name, F.lit("Token")), "token").when(F.contains(name, F.lit("Router")) | F.contains(name, F.lit("Swap")), "router or swap").otherwise("other")


def non_factory_source(source: Column) -> Column:
    """Whether a source that is not empty holds none of the factory words."""
    hit = F.lit(False)
    for w in FACTORY_WORDS:
        hit = hit | F.contains(F.lower(source), F.lit(w))
    return F.coalesce((source != "") & ~hit, F.lit(False))
