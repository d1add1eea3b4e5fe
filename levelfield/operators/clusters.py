"""Role profiles and team styles: features, standardising, K-means, naming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield import catalog
from levelfield.catalog import KEYS
from levelfield.operators import kmeans, rates, teams
from levelfield.operators.rates import number
from levelfield.session import materialise

ROLE_COLUMNS = tuple(catalog.ROLE_FEATURES)
STYLE_COLUMNS = tuple(catalog.STYLE_WORDS)
UNKNOWN_STYLE = "estilo sin describir"
# A fit stands for itself: one season's position group, one season's teams.
ROLE_FIT, STYLE_FIT = ("season", "position_group"), ("season",)


def role_features(players: DataFrame) -> DataFrame:
    """Six composition ratios; NULL where the denominator is not positive."""
    ratios = {
        name: F.when(number(below) > 0, number(above) / number(below))
        for name, (above, below) in catalog.ROLE_FEATURES.items()
        if above in players.columns and below in players.columns
    }
    return players.withColumns(ratios)


def standardise(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Standard deviations from the group mean (population form); missing is 0.

    Group statistics are pre-aggregated and joined back, so a group that holds
    most rows is still spread over all tasks.
    """
    measures = [
        m
        for c in columns
        for m in (F.avg(c).alias(f"__mean_{c}"), F.stddev_pop(c).alias(f"__std_{c}"))
    ]
    if by:
        stats = materialise(df.groupBy(*by).agg(*measures), "group_stats")
        joined = df.join(stats, list(by))
        moments = {
            c: (F.col(f"__mean_{c}"), F.col(f"__std_{c}")) for c in columns
        }
    else:
        row = df.agg(*measures).first()
        joined = df
        moments = {c: (F.lit(row[f"__mean_{c}"]), F.lit(row[f"__std_{c}"])) for c in columns}
    scaled = {
        c: F.coalesce(F.try_divide(F.col(c) - mean, F.nullif(std, F.lit(0.0))), F.lit(0.0))
        for c, (mean, std) in moments.items()
    }
    return joined.withColumns(scaled).select(*df.columns)


def archetype_similarity(centroids: Sequence[Sequence[float]]) -> list[list[float]]:
    """Cosine of every centroid with every archetype; 0 when either has no length."""
    table = []
    for centre in centroids:
        size = sum(v * v for v in centre) ** 0.5
        row = []
        for signature in catalog.ARCHETYPES.values():
            target = [signature.get(c, 0.0) for c in ROLE_COLUMNS]
            norm = sum(v * v for v in target) ** 0.5
            dot = sum(a * b for a, b in zip(centre, target, strict=True))
            row.append(dot / (size * norm) if size and norm else 0.0)
        table.append(row)
    return table


def name_clusters(similarity: Sequence[Sequence[float]]) -> list[str]:
    """One archetype per centroid, none twice, with the largest total similarity."""
    names = list(catalog.ARCHETYPES)
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in similarity:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for j, value in enumerate(row):
                mask = used | 1 << j
                if mask != used and (mask not in step or total + value > step[mask][0]):
                    step[mask] = (total + value, (*chosen, j))
        best = step
    _, chosen = max(best.values(), key=lambda option: option[0])
    return [names[j] for j in chosen]


def _large_enough(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Rows of the groups that have at least ``k`` of them."""
    sizes = df.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") >= k)
    return df.join(materialise(sizes.select(*by), "large_groups"), list(by), "left_semi")


def fit_roles(
    players: DataFrame, restarts: int = catalog.CLUSTER_RESTARTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Roles of every season and position group that is large enough, each fitted alone.

    Returns (KEYS, position_group, features in standard deviations, cluster,
    detailed_position), (season, position_group, cluster, role, centroid) and (season,
    position_group, silhouette, cost, steps, settled).
    """
    k = len(catalog.ARCHETYPES)
    known = players.where(F.col("position_group").isin(*catalog.ROLE_GROUPS))
    members = _large_enough(known, ROLE_FIT, k)
    features = role_features(members).select(*KEYS, "position_group", *ROLE_COLUMNS)
    scaled = standardise(features, ROLE_COLUMNS, ROLE_FIT)
    rows, centres, quality = kmeans.fit(
        scaled, ROLE_COLUMNS, k, ROLE_FIT, KEYS, restarts, catalog.CLUSTER_SEED
    )
    fits: dict[tuple, list] = {}
    for row in centres.orderBy(*ROLE_FIT, "cluster").collect():  # k rows a fit: the model
        fits.setdefault((row.season, row.position_group), []).append([row[c] for c in ROLE_COLUMNS])
    named = [
        (*fit, cluster, name, *centroid)
        for fit, own in fits.items()
        for cluster, (name, centroid) in enumerate(
            zip(name_clusters(archetype_similarity(own)), own, strict=True)
        )
    ]
    schema = "season string, position_group string, cluster int, role string, " + ", ".join(
        f"{c} double" for c in ROLE_COLUMNS
    )
    described = players.sparkSession.createDataFrame(named, schema)
    role = described.select(*ROLE_FIT, "cluster", F.col("role").alias("detailed_position"))
    return rows.join(role, [*ROLE_FIT, "cluster"]), described, quality


def assign_roles(
    players: DataFrame, group: str, restarts: int = catalog.CLUSTER_RESTARTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``fit_roles`` of one position group; raises if no season can be clustered."""
    if group not in catalog.ROLE_GROUPS:
        raise ValueError(f"no roles for {group!r}")
    members = players.where(F.col("position_group") == group)
    k = len(catalog.ARCHETYPES)
    if _large_enough(members, ROLE_FIT, k).isEmpty():
        raise ValueError(f"{group} needs at least {k} entities in a season")
    return fit_roles(members, restarts)


def assign_all_roles(
    players: DataFrame, restarts: int = catalog.CLUSTER_RESTARTS, fitted: DataFrame | None = None
) -> DataFrame:
    """Everybody, with cluster and detailed_position; NULL for whoever has no role.

    ``fitted`` are the rows of an earlier ``fit_roles`` of the same players.
    """
    rows = fit_roles(players, restarts)[0] if fitted is None else fitted
    roles = rows.select(*KEYS, "cluster", "detailed_position")
    return players.join(roles, list(KEYS), "left")


def enriched_players(
    players: DataFrame,
    min_minutes: int | DataFrame,
    restarts: int = catalog.CLUSTER_RESTARTS,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Eligible players with their role, plus everybody else without one."""
    able = rates.eligible(players, min_minutes)
    with_role = materialise(assign_all_roles(able, restarts, fitted), "roles")
    rest = unranked_entities(players, with_role)
    return with_role.unionByName(rest, allowMissingColumns=True)


def unranked_entities(players: DataFrame, ranked: DataFrame) -> DataFrame:
    """Entities outside the clustered population."""
    return players.join(ranked.select(*KEYS), list(KEYS), "left_anti").select(*players.columns)


def style_label(values: dict[str, Column], n: int = 2) -> Column:
    """The ``n`` features furthest from the mean, read with the style vocabulary."""
    read = [
        F.struct(
            (-F.abs(value)).alias("far"),
            F.lit(i).alias("i"),
            F.when(value >= 0, catalog.STYLE_WORDS[name][0])
            .otherwise(catalog.STYLE_WORDS[name][1])
            .alias("word"),
        )
        for i, (name, value) in enumerate(values.items())
        if name in catalog.STYLE_WORDS
    ]
    if not read:
        return F.lit(UNKNOWN_STYLE)
    extreme = F.slice(F.array_sort(F.array(*read)), 1, n)
    return F.array_join(F.transform(extreme, lambda s: s["word"]), ", ")


def cluster_styles(
    team_seasons: DataFrame,
    n_styles: int = catalog.DEFAULT_STYLES,
    restarts: int = catalog.CLUSTER_RESTARTS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Team styles of every season over all its leagues, each season fitted alone.

    Returns (teams with features, cluster, style), (season, cluster, style, teams,
    centroid) and (season, silhouette, cost, steps, settled).  A season with fewer than ``n_styles`` teams has no
    styles; without any other season that is an error.
    """
    sides = {r.perspective for r in team_seasons.select("perspective").distinct().take(2)}
    if sides != {"for", "against"}:
        raise ValueError("styles need the for and against rows of every team")
    features = _large_enough(teams.style_features(team_seasons), STYLE_FIT, n_styles)
    if features.isEmpty():
        raise ValueError(f"styles need at least {n_styles} teams in a season")
    scaled = standardise(features, STYLE_COLUMNS, STYLE_FIT)
    rows, centres, quality = kmeans.fit(
        scaled, STYLE_COLUMNS, n_styles, STYLE_FIT, teams.TEAM_KEYS, restarts, catalog.CLUSTER_SEED
    )
    label = style_label({c: F.col(c) for c in STYLE_COLUMNS})
    sizes = rows.groupBy(*STYLE_FIT, "cluster").agg(F.count("*").alias("teams"))
    labels = centres.withColumn("style", label).join(sizes, [*STYLE_FIT, "cluster"])
    clusters = rows.select(*teams.TEAM_KEYS, "cluster")
    styled = features.join(clusters, list(teams.TEAM_KEYS)).join(
        labels.select(*STYLE_FIT, "cluster", "style"), [*STYLE_FIT, "cluster"]
    )
    return styled, labels, quality


def style_membership(styled: DataFrame) -> DataFrame:
    """One row per season, style and team."""
    return styled.select("season", "style", "league", "team").distinct()


def misplaced(rows: DataFrame, centres: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Per group: rows, clusters, rows nearer to another centroid than to their own, and
    centroids that are not the mean of their rows.  The last two are 0 for a finished fit."""
    listed = centres.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("cluster").alias("idx"), *columns)).alias("centres")
    )

    def far(c: Column) -> Column:
        return sum((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in columns)

    own = F.filter("centres", lambda c: c["idx"] == F.col("cluster"))[0]
    least = F.array_min(F.transform("centres", far))
    placed = rows.join(listed, list(by)).withColumn("elsewhere", far(own) > least + 1e-9)
    means = placed.groupBy(*by, "cluster").agg(
        F.count("*").alias("n"),
        F.count_if("elsewhere").alias("elsewhere"),
        *[F.avg(c).alias(f"mean_{c}") for c in columns],
    )
    off = F.greatest(*[F.abs(F.col(f"mean_{c}") - F.col(c)) for c in columns], F.lit(0.0)) > 1e-6
    return means.join(centres, [*by, "cluster"]).groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("clusters"),
        F.sum("elsewhere").alias("nearer_elsewhere"),
        F.count_if(off).alias("off_centre"),
    )
