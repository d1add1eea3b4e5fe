"""Cluster queries: role features, roles, styles and their quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import DEMO_METRICS, KEYS
from levelfield.operators import clusters, kmeans, percentiles, rates, teams
from levelfield.plans.population import rounded
from levelfield.plans.registry import query
from levelfield.plans.sqlbase import percentile_sql, settled, using
from levelfield.plans.workspace import Workspace

K = ", ".join(KEYS)
_FEATURES = (
    ("shot_share", "np_xg", "xg_chain"),
    ("creation_share", "xa", "xg_chain"),
    ("buildup_share", "xg_buildup", "xg_chain"),
    ("shot_quality", "np_xg", "shots"),
    ("pass_quality", "xa", "key_passes"),
    ("finishing", "np_goals", "np_xg"),
)
_ROLE = (
    "features as (select league, season, team, player, position_group, "
    + ", ".join(
        f"case when {d} > 0 then cast({n} as double) / {d} end as {name}"
        for name, n, d in _FEATURES
    )
    + " from eligible)"
)


def _eligible(ws: Workspace) -> DataFrame:
    return rates.eligible(ws.players, ws.thresholds)


@query(
    "role_features",
    using(
        "eligible",
        f"""select {K}, position_group,
        {", ".join(f"cast(round(cast({n} as decimal(28, 9)), 6) as double) as {n}" for n, _, _ in _FEATURES)} from features""",
        _ROLE,
    ),
)
def role_features(ws: Workspace) -> DataFrame:
    df = clusters.role_features(_eligible(ws))
    return rounded(df.select(*KEYS, "position_group", *clusters.ROLE_COLUMNS))


@query(
    "standardise",
    using(
        "eligible",
        f"""select {K}, position_group, {", ".join(
            f'''cast(round(cast(coalesce(({n} - avg({n}) over w)
            / nullif(stddev_pop({n}) over w, 0), 0) as decimal(28, 9)), 6) as double) + 0.0 as {n}'''
            for n, _, _ in _FEATURES)}
        from features window w as (partition by season, position_group)""",
        _ROLE,
    ),
)
def standardise(ws: Workspace) -> DataFrame:
    df = clusters.role_features(_eligible(ws)).select(
        *KEYS, "position_group", *clusters.ROLE_COLUMNS
    )
    return rounded(clusters.standardise(df, clusters.ROLE_COLUMNS, clusters.ROLE_FIT))


def _roles(ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, centroids and quality of all roles, fitted once per session."""
    if "roles" not in ws.fits:
        rows, described, quality = clusters.fit_roles(_eligible(ws))
        ws.fits["roles"] = [ws.stored("roles", lambda: rows), described, ws.stored("role_quality", lambda: quality)]
    return tuple(ws.fits["roles"])


# Position groups of a season that are large enough to have twelve roles.
_CLUSTERED = """
  clustered as (
    select season, position_group, count(*) as entities from eligible
    where position_group in ('DF', 'MF', 'FW') group by all having count(*) >= 12)
"""


@query(
    "assign_roles",
    using(
        "eligible",
        """select season, position_group, entities as rows, 12 as clusters, 12 as roles,
          0 as nearer_elsewhere, 0 as off_centre from clustered""",
        _CLUSTERED,
    ),
)
def assign_roles(ws: Workspace) -> DataFrame:
    """What holds of a finished fit, counted over all its rows."""
    rows, described, _ = _roles(ws)
    held = clusters.misplaced(rows, described, clusters.ROLE_COLUMNS, clusters.ROLE_FIT)
    names = rows.groupBy(*clusters.ROLE_FIT).agg(
        F.count_distinct("detailed_position").alias("roles")
    )
    return held.join(names, list(clusters.ROLE_FIT))


@query(
    "enriched_entities",
    using(
        "eligible",
        f"""select {K}, p.position_group, p."minutes", c.season is not null as has_role
        from players p left join (
          select {K}, e.season as s from eligible e join clustered using (season, position_group)) r
          using ({K})
        left join (select distinct season from clustered) c on c.season = r.s""",
        _CLUSTERED,
    ),
)
def enriched_entities(ws: Workspace) -> DataFrame:
    whole = ws.stored(
        "enriched",
        lambda: clusters.enriched_players(ws.players, ws.thresholds, fitted=_roles(ws)[0]),
    )
    return whole.select(
        *KEYS, "position_group", "minutes", F.col("detailed_position").isNotNull().alias("has_role")
    )


@query(
    "role_clusters",
    using(
        "eligible",
        f"""select season, position_group, entities, {", ".join(
            f"cast(round(cast(avg({n}) as decimal(28, 9)), 6) as double) as {n}" for n, _, _ in _FEATURES)}
        from features join clustered using (season, position_group) group by all""",
        _ROLE + "," + _CLUSTERED,
    ),
)
def role_clusters(ws: Workspace) -> DataFrame:
    """Sizes and feature sums of the roles; together they are their position group."""
    rows = _roles(ws)[0].select(*KEYS, "position_group", "detailed_position")
    features = clusters.role_features(ws.players).select(*KEYS, *clusters.ROLE_COLUMNS)
    roles = rows.join(features, list(KEYS)).groupBy(*clusters.ROLE_FIT, "detailed_position").agg(
        F.count("*").alias("entities"),
        *[F.sum(c).alias(c) for c in clusters.ROLE_COLUMNS],
        *[F.count(c).alias(f"n_{c}") for c in clusters.ROLE_COLUMNS],
    )
    return rounded(
        roles.groupBy(*clusters.ROLE_FIT).agg(
            F.sum("entities").alias("entities"),
            *[(F.sum(c) / F.sum(f"n_{c}")).alias(c) for c in clusters.ROLE_COLUMNS],
        )
    )


@query(
    "role_names",
    using(
        "eligible",
        """select season, position_group, 12 as names, 12 as used, entities from clustered""",
        _CLUSTERED,
    ),
)
def role_names(ws: Workspace) -> DataFrame:
    """Names given, names with entities, and entities, per fit."""
    rows, described, _ = _roles(ws)
    sizes = rows.groupBy(*clusters.ROLE_FIT, F.col("detailed_position").alias("role")).agg(
        F.count("*").alias("entities")
    )
    named = described.select(*clusters.ROLE_FIT, "role").join(
        sizes, [*clusters.ROLE_FIT, "role"], "left"
    )
    return named.groupBy(*clusters.ROLE_FIT).agg(
        F.count_distinct("role").alias("names"),
        F.count("entities").alias("used"),
        F.sum("entities").alias("entities"),
    )


def _archetypes_sql() -> str:
    rows = ", ".join(
        f"('{name}', {', '.join(str(float(signature.get(c, 0.0))) + '::double' for c in clusters.ROLE_COLUMNS)})"
        for name, signature in catalog.ARCHETYPES.items()
    )
    return f"(values {rows}) a(archetype, {', '.join('a_' + c for c in clusters.ROLE_COLUMNS)})"


def _length_sql(prefix: str) -> str:
    return "sqrt(" + " + ".join(f"{prefix}{c} * {prefix}{c}" for c in clusters.ROLE_COLUMNS) + ")"


@query(
    "archetype_similarity",
    using(
        "eligible",
        f"""select season, position_group, archetype, {settled(
            "coalesce((" + " + ".join(f"m.{c} * a_{c}" for c in clusters.ROLE_COLUMNS)
            + f") / nullif({_length_sql('m.')} * {_length_sql('a_')}, 0), 0)", 6)} + 0.0 as cosine
        from (select season, position_group, {", ".join(
            f"coalesce(avg({n}), 0) as {n}" for n, _, _ in _FEATURES)}
          from features group by all) m, {_archetypes_sql()}""",
        _ROLE,
    ),
)
def archetype_similarity(ws: Workspace) -> DataFrame:
    """Cosine of every position group's mean features with every archetype."""
    means = clusters.role_features(_eligible(ws)).groupBy(*clusters.ROLE_FIT).agg(
        *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in clusters.ROLE_COLUMNS]
    )
    centres = means.collect()  # one row per season and position group
    table = clusters.archetype_similarity([[r[c] for c in clusters.ROLE_COLUMNS] for r in centres])
    rows = [
        (r.season, r.position_group, name, float(value))
        for r, cosines in zip(centres, table, strict=True)
        for name, value in zip(catalog.ARCHETYPES, cosines, strict=True)
    ]
    schema = "season string, position_group string, archetype string, cosine double"
    return rounded(ws.spark.createDataFrame(rows, schema))


@query(
    "cluster_quality",
    using(
        "eligible",
        """select season, position_group, 12 as clusters, entities > 12 as told, true as within_bounds,
          true as settled from clustered""",
        _CLUSTERED,
    ),
)
def cluster_quality(ws: Workspace) -> DataFrame:
    """Every fit stands still and has a silhouette (of squared distances) between -1 and 1; one
    of as many clusters as entities has none."""
    _, described, quality = _roles(ws)
    sizes = described.groupBy(*clusters.ROLE_FIT).agg(F.count("*").alias("clusters"))
    return sizes.join(quality, list(clusters.ROLE_FIT)).select(
        *clusters.ROLE_FIT,
        "clusters",
        F.col("silhouette").isNotNull().alias("told"),
        F.coalesce(F.col("silhouette").between(-1.0, 1.0), F.lit(True)).alias("within_bounds"),
        "settled",
    )


_GAP = " + ".join(f"(p.{c} - q.{c}) * (p.{c} - q.{c})" for c in clusters.ROLE_COLUMNS)


@query(
    "partition_silhouette",
    using(
        "eligible",
        f"""select season, {settled("avg(case when n = 1 then 0 else (b - a) / nullif(greatest(a, b), 0) end)", 6)} as silhouette
        from (
          select season, own, {K}, max(n) as n,
            max(far) filter (own = other) as a, min(far) filter (own <> other) as b
          from (
            select p.season, p.position_group as own, q.position_group as other, p.league, p.team, p.player,
              count(*) as n, sum({_GAP}) / nullif(count(*) - max((p.position_group = q.position_group)::int), 0) as far
            from scaled p join scaled q using (season)
            group by all)
          group by all)
        group by season""",
        _ROLE
        + f""",
        scaled as (
          select {K}, position_group, {", ".join(
            f"coalesce(({n} - avg({n}) over w) / nullif(stddev_pop({n}) over w, 0), 0) as {n}" for n, _, _ in _FEATURES)}
          from features where position_group is not null window w as (partition by season))""",
    ),
)
def partition_silhouette(ws: Workspace) -> DataFrame:
    """The silhouette of a partition that is given, the position groups of a season."""
    df = clusters.role_features(_eligible(ws)).where("position_group is not null")
    features = df.select(*KEYS, "position_group", *clusters.ROLE_COLUMNS)
    scaled = clusters.standardise(features, clusters.ROLE_COLUMNS, ["season"])
    rows = scaled.withColumnRenamed("position_group", "cluster")
    return rounded(kmeans.silhouette(rows, list(clusters.ROLE_COLUMNS), ["season"]))


@query(
    "role_percentiles",
    using(
        "metrics_long",
        f"""select {K}, position_raw as detailed_position, metric, {", ".join(
            settled(f"case when higher_is_better = false then 100 - raw_{b} else raw_{b} end", 6)
            + f" as percentile_{b}" for b in ("per90", "padj", "shrunk"))}
        from (select *, {", ".join(f"{percentile_sql(b, 'season, position_raw')} as raw_{b}"
            for b in ("per90", "padj", "shrunk"))}
          from metrics_raw join (select {K}, position_raw from players) using ({K}))""",
    ),
)
def role_percentiles(ws: Workspace) -> DataFrame:
    """Percentiles against the same role; here the role is the one the source states."""
    stated = ws.players.withColumn("detailed_position", F.col("position_raw"))
    df = percentiles.population_percentiles(
        stated,
        DEMO_METRICS,
        ws.thresholds,
        ws.possession,
        catalog.POPULATION_KEYS["role"],
    )
    return rounded(
        df.select(*KEYS, "detailed_position", "metric", *[f"percentile_{b}" for b in catalog.BASES])
    )


def _styles(ws: Workspace) -> tuple[DataFrame, DataFrame, DataFrame]:
    if "styles" not in ws.fits:
        styled, labels, quality = clusters.cluster_styles(ws.teams)
        ws.fits["styles"] = [
            ws.stored("styles", lambda: styled),
            ws.stored("style_labels", lambda: labels),
            ws.stored("style_quality", lambda: quality),
        ]
    return tuple(ws.fits["styles"])


_STYLED = """
  styled as (
    select season, count(*) as teams from teams where perspective = 'for'
    group by season having count(*) >= 5)
"""


@query(
    "team_styles",
    using(
        "teams",
        """select season, teams as rows, 5 as clusters, 0 as nearer_elsewhere, 0 as off_centre,
          teams as labelled from styled""",
        _STYLED,
    ),
)
def team_styles(ws: Workspace) -> DataFrame:
    """What holds of a finished partition of every season's teams."""
    styled, labels, _ = _styles(ws)
    features = styled.select(*teams.TEAM_KEYS, "cluster", *clusters.STYLE_COLUMNS)
    scaled = clusters.standardise(features, clusters.STYLE_COLUMNS, clusters.STYLE_FIT)
    held = clusters.misplaced(scaled, labels, clusters.STYLE_COLUMNS, clusters.STYLE_FIT)
    named = teams.style_map(styled).groupBy("season").agg(F.count("style").alias("labelled"))
    return held.join(named, "season")


@query(
    "style_report",
    using(
        "teams",
        "select season, 5 as styles, teams, true as within_bounds from styled",
        _STYLED,
    ),
)
def style_report(ws: Workspace) -> DataFrame:
    """Styles of a season with their sizes and the silhouette of the partition."""
    _, labels, quality = _styles(ws)
    sizes = labels.groupBy("season").agg(F.count("*").alias("styles"), F.sum("teams").alias("teams"))
    return sizes.join(quality, "season").select(
        "season",
        "styles",
        "teams",
        F.coalesce(F.col("silhouette").between(-1.0, 1.0), F.col("teams") == F.col("styles")).alias("within_bounds"),
    )


@query(
    "style_membership",
    using(
        "teams",
        "select season, league, team, 1 as styles from teams where perspective = 'for'",
    ),
)
def style_membership(ws: Workspace) -> DataFrame:
    """Every team of a season has one style."""
    members = clusters.style_membership(_styles(ws)[0])
    return members.groupBy(*["season", "league", "team"]).agg(
        F.count_distinct("style").cast("int").alias("styles")
    )


@query(
    "style_labels",
    using(
        "teams",
        """, words as (
          select league, season, team, axis, abs(v) as far, case when v >= 0 then high else low end
            as word
          from (select league, season, team, unnest(range(8)) as axis, unnest([pressing, territory,
                chance_creation, chance_prevention, finishing, chance_quality, pressed,
                box_defence]) as v,
              unnest(['presión asfixiante', 'campo rival como territorio', 'genera mucho peligro',
                'concede poco', 'finaliza por encima de lo esperado', 'cada llegada es peligrosa',
                'le presionan arriba', 'aguanta el asedio']) as high,
              unnest(['presión pasiva', 'poca presencia en campo rival', 'genera poco peligro',
                'concede mucho', 'desperdicia ocasiones', 'llega mucho y remata mal',
                'le dejan salir jugando', 'se le mete todo el mundo en el área']) as low
            from scaled))
        select league, season, team, max(word) filter (n = 1) || ', ' || max(word) filter (n = 2)
          as style
        from (select *, row_number() over (partition by league, season, team
          order by far desc, axis) as n from words) group by all""",
        """
        style as (
          select f.league, f.season, f.team, -f.ppda as pressing,
            f.deep_completions / f.matches_played as territory,
            f.np_xg / f.matches_played as chance_creation,
            -(a.np_xg / f.matches_played) as chance_prevention,
            (f.goals - f.np_xg) / f.matches_played as finishing,
            f.np_xg / nullif(f.deep_completions, 0) as chance_quality,
            -a.ppda as pressed, -(a.deep_completions / f.matches_played) as box_defence
          from teams f join teams a using (league, season, team)
          where f.perspective = 'for' and a.perspective = 'against'),
        scaled as (select league, season, team, """
        + ", ".join(
            f"(({c}) - avg({c}) over w) / stddev_pop({c}) over w as {c}"
            for c in clusters.STYLE_COLUMNS
        )
        + " from style window w as (partition by season))",
    ).replace("\n, words", ",\nwords"),
)
def style_labels(ws: Workspace) -> DataFrame:
    """Every team season read by its own two most extreme features."""
    features = teams.style_features(ws.teams)
    scaled = clusters.standardise(features, clusters.STYLE_COLUMNS, ["season"])
    label = clusters.style_label({c: F.col(c) for c in clusters.STYLE_COLUMNS})
    return scaled.select(*teams.TEAM_KEYS, label.alias("style"))
