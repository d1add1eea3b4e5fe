"""Nested JSON payloads → rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.functions import parse

HISTORY = (
    "marketValue string, marketValueHistory array<struct<"
    "age: string, date: string, clubId: string, clubName: string, marketValue: string>>"
)
TRANSFERS = (
    "transfers array<struct<id: string, clubFrom: struct<name: string>, "
    "clubTo: struct<name: string>, date: string, upcoming: boolean, season: string, "
    "marketValue: string, fee: string>>"
)
PROFILE = (
    "id string, name string, dateOfBirth string, age string, position string, "
    "nationality array<string>, height string, foot string, joinedOn string, "
    "signedFrom string, contract string"
)


def flatten_history(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Dated valuations; points without a readable date are dropped."""
    points = payloads.select(
        "entity_id", F.explode(F.from_json(payload, HISTORY)["marketValueHistory"]).alias("p")
    )
    return points.select(
        "entity_id",
        parse.parse_date("p.date").alias("valuation_date"),
        parse.parse_amount("p.marketValue").alias("market_value"),
        F.col("p.clubName").alias("club_at_time"),
        F.col("p.age").try_cast("int").alias("age_at_time"),
    ).where("valuation_date is not null")


def club_history(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Clubs an entity has been valued at, one array per payload."""
    points = F.from_json(payload, HISTORY)["marketValueHistory"]
    named = F.filter(F.transform(points, lambda p: p["clubName"]), lambda c: c != "")
    empty = F.array().cast("array<string>")
    return payloads.select("entity_id", F.coalesce(named, empty).alias("clubs"))


def flatten_transfers(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Completed moves with a whole key; announced ones are left out."""
    moves = payloads.select(
        "entity_id", F.explode(F.from_json(payload, TRANSFERS)["transfers"]).alias("t")
    ).where("not coalesce(t.upcoming, false)")
    return moves.select(
        "entity_id",
        parse.parse_date("t.date").alias("transfer_date"),
        F.col("t.clubFrom.name").alias("club_from"),
        F.col("t.clubTo.name").alias("club_to"),
        parse.parse_amount("t.fee").alias("fee"),
        parse.classify_transfer("t.fee").alias("transfer_type"),
        parse.parse_amount("t.marketValue").alias("market_value_at_transfer"),
        F.col("t.season").alias("season"),
    ).where("transfer_date is not null and club_from <> '' and club_to <> ''")


def flatten_profiles(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One profile row per squad entry; the first nationality is the main one."""
    entry = F.from_json(payload, PROFILE)
    rows = payloads.select("entity_id", entry.alias("e"))
    return rows.select(
        "entity_id",
        F.when(F.col("e.id") != "", F.col("e.id")).alias("external_id"),
        F.col("e.name").alias("player_name"),
        parse.parse_date("e.dateOfBirth").alias("date_of_birth"),
        F.col("e.age").try_cast("int").alias("age"),
        F.col("e.position").alias("position"),
        F.try_element_at("e.nationality", F.lit(1)).alias("nationality"),
        F.col("e.height").try_cast("int").alias("height_cm"),
        F.col("e.foot").alias("foot"),
        parse.parse_date("e.joinedOn").alias("joined_on"),
        F.col("e.signedFrom").alias("signed_from"),
        parse.parse_date("e.contract").alias("contract_until"),
    )
