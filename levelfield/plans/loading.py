"""Load queries: keyed upsert, protected columns, ledger, version, replayed batches."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield.plans.registry import query
from levelfield.plans.sqlbase import using
from levelfield.plans.workspace import Workspace
from levelfield.session import shared_folder
from levelfield.sources import sinks
from levelfield.streaming.incremental import incremental_upsert as stream_upsert

STORED = "event_id bigint, kind string, amount double, note string, updated_at timestamp"
LOADED_AT = "2025-01-02 03:04:05"

_MERGED = """
  merged as (
    select e.event_id, event_type as kind,
      case when event_type in ('signup', 'click') then round("value" * 2, 4)
        when event_type = 'error' then null else "value" end as amount,
      case when event_type in ('click', 'error', 'view', 'purchase') then props end as note,
      case when event_type in ('signup', 'click', 'error')
        then '2025-01-02 03:04:05' else '2024-06-01 00:00:00' end as updated_at
    from events e)
"""


def _stored_rows(ws: Workspace) -> DataFrame:
    """What was loaded before: everything but sign-ups."""
    return ws.table("events").where("event_type <> 'signup'").select(
        "event_id",
        F.col("event_type").alias("kind"),
        F.col("value").alias("amount"),
        F.col("props").alias("note"),
        F.lit("2024-06-01").cast("timestamp").alias("updated_at"),
    )


def _arrived_rows(ws: Workspace) -> DataFrame:
    """The new batch: sign-ups, clicks and errors, without notes; errors lose their amount."""
    amount = F.when(F.col("event_type") != "error", F.round(F.col("value") * 2, 4))
    return ws.table("events").where("event_type in ('signup', 'click', 'error')").select(
        "event_id", F.col("event_type").alias("kind"), amount.alias("amount")
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def _table(ws: Workspace) -> sinks.SnapshotTable:
    folder = f"{shared_folder(ws.spark)}/loads-{uuid.uuid4().hex}"
    return sinks.SnapshotTable(ws.spark, folder, "events", STORED, ["event_id"])


@query("keyed_upsert", using("", "select * from merged", _MERGED))
def keyed_upsert(ws: Workspace) -> DataFrame:
    now = F.lit(LOADED_AT).cast("timestamp")
    return _shown(
        sinks.merge_batch(_stored_rows(ws), _arrived_rows(ws), ["event_id"], now)
    )


@query(
    "snapshot_upsert",
    using("", "select event_id, kind, amount, note from merged", _MERGED),
)
def snapshot_upsert(ws: Workspace) -> DataFrame:
    """Both loads through the stored table, the second one twice."""
    table = _table(ws)
    table.upsert(_stored_rows(ws))
    table.upsert(_arrived_rows(ws))
    table.upsert(_arrived_rows(ws))
    return table.current().drop("updated_at")


@query(
    "incremental_upsert",
    using("", "select event_id, kind, amount, note from merged", _MERGED),
)
def incremental_upsert(ws: Workspace) -> DataFrame:
    """Landed files streamed into the stored table; every key of the batch lands twice."""
    folder = f"{shared_folder(ws.spark)}/landed-{uuid.uuid4().hex}"
    landed = _arrived_rows(ws)
    landed.write.parquet(f"{folder}/batches")
    landed.write.mode("append").parquet(f"{folder}/batches")
    table = _table(ws)
    table.upsert(_stored_rows(ws))
    stream = stream_upsert(
        ws.spark, f"{folder}/batches", landed.schema, table, f"{folder}/checkpoint"
    )
    stream.awaitTermination()
    return table.current().drop("updated_at")


@query(
    "upsert_protected",
    """select cast(c_custkey as varchar) as entity_id,
      case when c_mktsegment = 'MACHINERY' then 'old' else 'new' end as external_id,
      case when c_mktsegment = 'MACHINERY' then 70.0 else 90.0 end::double as match_confidence,
      case when c_mktsegment = 'BUILDING' then null else c_custkey % 2 = 0 end as reviewed
    from customer""",
)
def upsert_protected(ws: Workspace) -> DataFrame:
    """New matches replace old ones but never a person's confirmation."""
    key = F.col("c_custkey")
    people = ws.table("customer")
    stored = people.where("c_mktsegment <> 'BUILDING'").select(
        key.cast("string").alias("entity_id"),
        F.lit("old").alias("external_id"),
        F.lit(70.0).alias("match_confidence"),
        (key % 2 == 0).alias("reviewed"),
    )
    found = people.where("c_mktsegment <> 'MACHINERY'").select(
        key.cast("string").alias("entity_id"),
        F.lit("new").alias("external_id"),
        F.lit(90.0).alias("match_confidence"),
    )
    return sinks.merge_batch(stored, found, ["entity_id"], protected=["reviewed"])


_STATES = """
  states as (
    select cast(o_orderkey as varchar) as run_id, o_orderdate as started_at,
      case when o_orderstatus <> 'P' then o_orderdate + interval 1 hour end as finished_at,
      case o_orderstatus when 'F' then 'success' when 'O' then 'failed'
        else 'running' end as status,
      case when o_orderstatus = 'F' then o_custkey end as rows,
      case when o_orderstatus = 'P' and o_orderdate <= timestamp '2001-08-01 01:00:00'
        - interval 3 hour then 'stale' when o_orderstatus = 'P' then 'running'
        when o_orderstatus = 'F' then 'success' else 'failed' end as state
    from orders)
"""


def _ledger(ws: Workspace) -> DataFrame:
    """Orders as runs: each opens on its date, most close an hour later."""
    orders = ws.table("orders")
    run = F.col("o_orderkey").cast("string").alias("run_id")
    at = F.col("o_orderdate").cast("timestamp")
    opened = orders.select(run, F.lit("running").alias("status"), at.alias("at"),
                           F.lit(None).cast("bigint").alias("rows"))
    closed = orders.where("o_orderstatus <> 'P'").select(
        run,
        F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"),
        (at + F.make_dt_interval(hours=F.lit(1))).alias("at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("rows"),
    )
    return opened.unionByName(closed)


def _states(ws: Workspace) -> DataFrame:
    return sinks.run_states(_ledger(ws), F.lit("2001-08-01 01:00:00").cast("timestamp"))


def _clock(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd HH:mm") for c in ("started_at", "finished_at")}
    )


@query(
    "run_ledger",
    using(
        "",
        """select run_id, strftime(started_at, '%Y-%m-%d %H:%M') as started_at,
        strftime(finished_at, '%Y-%m-%d %H:%M') as finished_at, status, rows, state
        from states""",
        _STATES,
    ),
)
def run_ledger(ws: Workspace) -> DataFrame:
    return _clock(_states(ws))


@query(
    "last_runs",
    using(
        "",
        """select run_id, strftime(started_at, '%Y-%m-%d %H:%M') as started_at,
        strftime(finished_at, '%Y-%m-%d %H:%M') as finished_at, status, rows, state
        from states order by states.started_at desc, run_id limit 5""",
        _STATES,
    ),
)
def last_runs(ws: Workspace) -> DataFrame:
    return _clock(sinks.last_runs(_states(ws)))


@query(
    "data_version",
    using(
        "",
        """select coalesce(strftime(max(finished_at), '%Y-%m-%dT%H:%M:%S'), 'sin-datos')
        as version from states where status = 'success'""",
        _STATES,
    ),
)
def data_version(ws: Workspace) -> DataFrame:
    return sinks.data_version(_states(ws))


@query(
    "review_queue",
    """select cast(c_custkey as varchar) as entity_id, cast(c_nationkey as varchar) as external_id,
      c_acctbal as match_confidence, c_custkey % 3 = 0 as reviewed
    from customer where c_custkey % 3 <> 0 and c_mktsegment <> 'BUILDING'""",
)
def review_queue(ws: Workspace) -> DataFrame:
    key = F.col("c_custkey")
    external = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey").cast("string"))
    mappings = ws.table("customer").select(
        key.cast("string").alias("entity_id"),
        external.alias("external_id"),
        F.col("c_acctbal").alias("match_confidence"),
        (key % 3 == 0).alias("reviewed"),
    )
    return sinks.review_queue(mappings)


@query(
    "target_loads",
    """with o as (select cast(o_custkey as varchar) as entity_id, cast(o_orderdate as date) as day,
        o_totalprice as price, o_orderstatus as status, o_orderpriority as priority from orders)
    select 'player_market_value' as target, count(*) as rows, count(market_value) as filled
      from (select entity_id, day, min(price) as market_value from o group by all)
    union all select 'player_transfers', count(*), count(fee)
      from (select entity_id, day, status, priority, min(price) as fee from o group by all)
    union all select 'player_profile', count(*), count(c_nationkey) from customer
    union all select 'team_identity', count(*), count(*) from nation
    union all select 'player_id_mapping', count(*), count(*) from customer""",
)
def target_loads(ws: Workspace) -> DataFrame:
    """Each target loaded through its own keys, the values and transfers in two batches."""
    folder = f"{shared_folder(ws.spark)}/targets-{uuid.uuid4().hex}"
    c = F.col
    orders = ws.table("orders").select(
        c("o_custkey").cast("string").alias("entity_id"),
        F.to_date("o_orderdate").alias("day"),
        c("o_totalprice").alias("price"),
        c("o_orderstatus").alias("club_from"),
        c("o_orderpriority").alias("club_to"),
    )
    people = ws.table("customer").select(
        c("c_custkey").cast("string").alias("entity_id"),
        c("c_nationkey").cast("string").alias("nationality"),
        c("c_name").alias("external_id"),
    )
    values = orders.select("entity_id", c("day").alias("valuation_date"), c("price").alias("market_value"))
    moves = orders.select("entity_id", c("day").alias("transfer_date"), "club_from", "club_to", c("price").alias("fee"))
    clubs = ws.table("nation").select(
        c("n_regionkey").cast("string").alias("league"), F.lit("2000").alias("season"),
        c("n_name").alias("team"), c("n_nationkey").cast("string").alias("external_id"),
    )
    batches = {
        "player_market_value": [values.where("market_value < 100000"), values],
        "player_transfers": [moves.where("fee < 100000"), moves],
        "player_profile": [people.select("entity_id", "nationality")],
        "team_identity": [clubs],
        "player_id_mapping": [people.select("entity_id", "external_id")],
    }
    shown = {"player_market_value": "market_value", "player_transfers": "fee",
             "player_profile": "nationality", "team_identity": "external_id",
             "player_id_mapping": "external_id"}
    parts = []
    for target, loads in batches.items():
        for batch in loads:
            table = sinks.load_target(ws.spark, folder, target, batch)
        rows = table.current().agg(F.count("*").alias("rows"), F.count(shown[target]).alias("filled"))
        parts.append(rows.select(F.lit(target).alias("target"), "rows", "filled"))
    return reduce(DataFrame.unionByName, parts)
