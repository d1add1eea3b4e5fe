"""Readings of the stored percentile table: profiles, comparisons, changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import KEYS, PLAYER_METRICS, Metric
from levelfield.functions import parse
from levelfield.operators.rates import settled
from levelfield.session import materialise


def _entity_order(*first: Column) -> Window:
    return Window.partitionBy(*KEYS).orderBy(*first, F.col("metric"))


def search(
    players: DataFrame,
    season: str,
    league: str | None = None,
    team: str | None = None,
    position_group: str | None = None,
    role: str | None = None,
    name: str | None = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of entities by exposure; ``name`` is a case-blind regular expression."""
    kept = players.where(F.col("season") == season)
    wanted = {
        "league": league,
        "team": team,
        "position_group": position_group,
        "detailed_position": role,
    }
    for column, value in wanted.items():
        if value:
            kept = kept.where(F.col(column) == value)
    if name:
        kept = kept.where(F.col("player").rlike(f"(?i){name}"))
    return kept.orderBy(F.col("minutes").desc_nulls_last(), *KEYS).offset(offset).limit(limit)


def by_name(percentiles: DataFrame, name: str) -> DataFrame:
    """Exact name, case-blind; only if nobody has it, names that contain it."""
    player = F.lower("player")
    exact = percentiles.where(player == name.lower())
    found = percentiles.where(player.contains(name.lower()))
    # The exact rows are among the containing ones, so one flag decides.
    any_exact = not exact.select(F.lit(1)).limit(1).isEmpty()
    return exact if any_exact else found


def ambiguous_entities(players: DataFrame) -> DataFrame:
    """Names with more than one stint in a season, which are never averaged."""
    return (
        players.select("season", "player", "team")
        .distinct()
        .groupBy("season", "player")
        .agg(F.count("*").alias("teams"))
        .where("teams > 1")
    )


def relevant(percentiles: DataFrame, metrics: Sequence[Metric] = PLAYER_METRICS) -> DataFrame:
    """Only the metrics that say something about the entity's group."""
    group = F.coalesce("position_group", F.lit("MF"))
    positions = F.create_map(
        *[x for m in metrics for x in (F.lit(m.name), F.lit("outfield" in m.traits))]
    )
    return percentiles.where(
        (group != catalog.GOALKEEPER) | ~F.try_element_at(positions, F.col("metric"))
    ).where(F.col("metric").isin(*[m.name for m in metrics]))


def entity_profile(
    percentiles: DataFrame,
    basis: str = "per90",
    metrics: Sequence[Metric] = PLAYER_METRICS,
) -> DataFrame:
    """Profile rows with their place (1 = highest percentile, unknown last)."""
    percentile = F.col(f"percentile_{basis}")
    dependent = [m.name for m in metrics if "team" in m.traits]
    return relevant(percentiles, metrics).select(
        *KEYS,
        "position_group",
        "metric",
        "label",
        F.col("value").alias("total"),
        "per90",
        "padj",
        percentile.alias("percentile"),
        "higher_is_better",
        F.col("metric").isin(*dependent).alias("team_dependent"),
        F.row_number().over(_entity_order(percentile.desc_nulls_last())).alias("place"),
    )


def extreme_metrics(
    profile: DataFrame,
    population: DataFrame,
    high: int = catalog.HIGH_PERCENTILE,
    low: int = catalog.LOW_PERCENTILE,
    limit: int = catalog.MAX_ALERTS,
) -> DataFrame:
    """The metrics where an entity is out of the ordinary, most extreme first."""
    whole = F.bround("percentile", 0).cast("int")
    kind = (
        F.when(F.col("higher_is_better").isNull(), "rasgo")
        .when(F.col("whole") >= high, "fortaleza")
        .otherwise("debilidad")
    )
    extreme = profile.withColumn("whole", whole).where(
        (F.col("whole") >= high) | (F.col("whole") <= low)
    )
    place = F.row_number().over(
        _entity_order(F.abs(F.col("whole") - 50).desc(), F.col("place"))
    )
    fragile = F.coalesce(F.col("population_size"), F.lit(0)) < catalog.FRAGILE_POPULATION
    return (
        extreme.withColumn("rank", place)
        .where(F.col("rank") <= limit)
        .join(population, ["season", "position_group"], "left")
        .select(
            *KEYS,
            "metric",
            "label",
            F.col("whole").alias("percentile"),
            kind.alias("kind"),
            F.concat_ws(
                "; ",
                F.when(F.col("team_dependent"), F.lit("team_dependent")),
                F.when(fragile, F.lit("small_population")),
            ).alias("note"),
            "rank",
        )
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """The two best metrics that have a good direction."""
    best = _entity_order(F.col("percentile").desc(), F.col("place"))
    top = (
        profile.where(F.col("higher_is_better") & F.col("percentile").isNotNull())
        .withColumn("n", F.row_number().over(best))
        .where("n <= 2")
    )
    part = F.format_string("%s (%d)", F.lower("label"), F.bround("percentile", 0).cast("int"))
    return top.groupBy(*KEYS).agg(
        F.max(F.when(F.col("n") == 1, part)).alias("best"),
        F.max(F.when(F.col("n") == 2, part)).alias("second"),
    )


def entity_strengths(percentiles: DataFrame) -> DataFrame:
    """Good-direction metrics from percentile 85, at most four per entity."""
    order = _entity_order(F.col("percentile_per90").desc())
    return (
        percentiles.where(
            (F.col("percentile_per90") >= catalog.STRENGTH_PERCENTILE)
            & F.col("higher_is_better")
        )
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= catalog.MAX_STRENGTHS)
        .select(*KEYS, "metric", "label", "percentile_per90", "place")
    )


def metric_leaders(
    percentiles: DataFrame, limit: int = catalog.MAX_LEADERS, group: str | None = None
) -> DataFrame:
    """Best entities of every season in every metric."""
    kept = percentiles if group is None else percentiles.where(F.col("position_group") == group)
    order = Window.partitionBy("season", "metric").orderBy(
        F.col("percentile_per90").desc_nulls_last(), *KEYS
    )
    return (
        kept.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .select("season", "metric", "place", "league", "team", "player", "percentile_per90")
    )


def family_profile(percentiles: DataFrame, basis: str = "per90") -> DataFrame:
    """Mean percentile per metric family; families without a value are absent."""
    families = F.create_map(
        *[F.lit(x) for f, ms in catalog.FAMILIES.items() for m in ms for x in (m, f)]
    )
    return (
        percentiles.withColumn("family", F.try_element_at(families, F.col("metric")))
        .where(F.col("family").isNotNull() & F.col(f"percentile_{basis}").isNotNull())
        .groupBy(*KEYS, "family")
        .agg(settled(F.avg(f"percentile_{basis}"), 1).alias("percentile"))
    )


def profile_on_template(profile: DataFrame, axes: DataFrame) -> DataFrame:
    """Every chart axis of an entity, in template order; NULL marks a missing axis."""
    entities = profile.select(*KEYS, "position_group").distinct()
    wanted = entities.join(axes, "position_group")
    values = profile.select(*KEYS, "metric", "percentile")
    return wanted.join(values, [*KEYS, "metric"], "left").select(
        *KEYS,
        "axis",
        "metric",
        "label",
        "family",
        parse.to_percentile("percentile").alias("percentile"),
        F.col("percentile").isNull().alias("missing"),
    )


def compare_on_template(charted: DataFrame, one: Column, two: Column) -> DataFrame:
    """Two entities on the same axes; ``shared`` is false where either lacks one.

    ``one`` and ``two`` are conditions that pick the two entities.
    """
    axis = ["axis", "metric", "label", "family"]
    return (
        charted.where(one | two)
        .groupBy(*axis)
        .agg(
            F.max(F.when(one, F.col("percentile"))).alias("percentile_a"),
            F.max(F.when(two, F.col("percentile"))).alias("percentile_b"),
        )
        .withColumn("gap", F.col("percentile_b") - F.col("percentile_a"))
        .withColumn("shared", F.col("gap").isNotNull())
    )


def largest_gap(compared: DataFrame, clear: int = catalog.CLEAR_GAP) -> DataFrame:
    """The shared axis with the widest gap; nothing when no gap is clear."""
    width = F.abs("gap")
    widest = F.max_by(
        F.struct("label", "percentile_a", "percentile_b", width.alias("width")),
        F.struct(width, F.col("label")),
    )
    row = compared.where("shared").agg(widest.alias("w"))
    return row.select("w.*").where(F.col("width") >= clear)


def compare_entities(
    percentiles: DataFrame, one: Column, two: Column, limit: int | None = None
) -> DataFrame:
    """Signed gap on every shared metric, widest first; empty across groups.

    ``limit`` keeps the widest ones only, as a short answer does.
    """
    value, label = F.col("percentile_per90"), F.col("label")
    both = (
        percentiles.where(one | two)
        .groupBy("metric")
        .agg(
            F.max(label).alias("label"),
            F.max(F.when(one, value)).alias("percentile_a"),
            F.max(F.when(two, value)).alias("percentile_b"),
            F.max(F.when(one, F.col("position_group"))).alias("group_a"),
            F.max(F.when(two, F.col("position_group"))).alias("group_b"),
        )
    )
    gap = F.col("percentile_a") - F.col("percentile_b")
    ordered = (
        both.where("group_a = group_b")
        .select("metric", "label", "percentile_a", "percentile_b", gap.alias("gap"))
        .where("gap is not null")
        .orderBy(F.abs("gap").desc(), "metric")
    )
    return ordered if limit is None else ordered.limit(limit)


def season_change(profile: DataFrame, seasons: DataFrame) -> DataFrame:
    """Percentiles against the previous loaded season, metrics present in both."""
    loaded = seasons.select("season").distinct()
    previous = materialise(
        loaded.withColumn("previous", F.lag("season").over(Window.orderBy("season"))), "seasons"
    )
    whole = parse.to_percentile("percentile")
    now = profile.select("player", "season", "team", "metric", "label", whole.alias("after"))
    # A name with several stints that season has no single earlier profile.
    before = (
        profile.groupBy("player", F.col("season").alias("previous"), "metric")
        .agg(F.count("*").alias("stints"), F.max("percentile").alias("percentile"))
        .where("stints = 1")
        .select("player", "previous", "metric", whole.alias("before"))
    )
    return (
        now.join(previous, "season")
        .join(before, ["player", "previous", "metric"])
        .where("before is not null and after is not null")
        .withColumn("change", F.col("after") - F.col("before"))
    )


def biggest_change(changes: DataFrame) -> DataFrame:
    """Per entity and season, the metric that moved most."""
    row = F.struct("metric", "label", "before", "after", "change")
    best = F.max_by(row, F.struct(F.abs("change"), F.col("metric")))
    return changes.groupBy("player", "season", "team").agg(best.alias("w")).select(
        "player", "season", "team", "w.*"
    )


def profile_caveats(entities: DataFrame, population: str = "position") -> DataFrame:
    """How to read a profile, as codes.

    ``entities`` carries leagues, min_minutes, configured_min_minutes,
    population_size, position_group and detailed_position.
    """
    c = F.col
    rules = [
        F.when(c("leagues") < catalog.EXPECTED_LEAGUES, "few_leagues"),
        F.when(c("min_minutes") < c("configured_min_minutes"), "lowered_threshold"),
        F.when(
            (c("population_size") > 0) & (c("population_size") < catalog.FRAGILE_POPULATION),
            "fragile_population",
        ),
        F.when(F.lit(population == "position") & (c("position_group") == "DF"), "mixed_group"),
        F.when(
            c("detailed_position").isNull() & ~c("position_group").eqNullSafe(F.lit("GK")),
            "no_role",
        ),
    ]
    return entities.withColumn("caveats", F.array_compact(F.array(*rules)))


def common_axes(charted: DataFrame, one: Column, two: Column) -> DataFrame:
    """Axes both entities have, and the union of the axes either lacks."""
    shared = (
        charted.where(one & ~F.col("missing"))
        .select("metric")
        .intersect(charted.where(two & ~F.col("missing")).select("metric"))
    )
    lacking = (
        charted.where(one & F.col("missing"))
        .select("metric")
        .union(charted.where(two & F.col("missing")).select("metric"))
        .distinct()
    )
    return shared.withColumn("status", F.lit("shared")).unionByName(
        lacking.withColumn("status", F.lit("missing"))
    )


def report_rows(profile: DataFrame, limit: int = 10) -> DataFrame:
    """Numbers behind a one-page report: chart metrics by percentile, at most ten."""
    charted = [m for names in catalog.FAMILIES.values() for m in names]
    order = _entity_order(F.col("place"))
    return (
        profile.where(F.col("metric").isin(*charted) & F.col("percentile").isNotNull())
        .withColumn("line", F.row_number().over(order))
        .where(F.col("line") <= limit)
        .select(*KEYS, "line", "label", "total", "per90", "percentile")
    )
