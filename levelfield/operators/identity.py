"""Fuzzy identity resolution between two sources.

Names are compared only inside a block (competition, club).  Even there not all
pairs are scored: names are first made distinct, and two names become a pair only
if they share the letters and neighbouring letters (or a rare word) that any match
above the threshold must share.  The filter is lossless, so the result is the one an
all-pairs comparison gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelfield.functions import text
from levelfield.operators.fuzzyjoin import close_pairs
from levelfield.session import grown, materialise

# Scores and margins of the matching rules.
CONFIDENT_SCORE = 95.0
MATCH_THRESHOLD = 85.0
CLUB_SCORE = 80.0
CLUB_NAME_SCORE = 70.0
TIE_MARGIN = 5.0
NO_CLUB_PENALTY = 15.0

MATCH_COLUMNS = (
    "entity_id", "player_name", "external_id", "match_method", "match_confidence", "reviewed",
)


def usable(external: str = "external_id", confidence: str = "match_confidence") -> Column:
    """A match that can be loaded: found, and confirmed or confident."""
    sure = F.col("reviewed") | (F.coalesce(F.col(confidence), F.lit(0.0)) >= CONFIDENT_SCORE)
    return F.col(external).isNotNull() & sure


def _names(df: DataFrame, name: str, out: str) -> DataFrame:
    """Distinct sorted-token names per block."""
    sorted_name = text.sort_tokens(text.normalise_name(F.coalesce(F.col(name), F.lit(""))))
    return df.select("block", sorted_name.alias(out)).distinct()


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fixed partitions by key: scoring costs far more than its few bytes suggest."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def name_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Scored pairs of distinct names per block with a token-sort ratio ≥ threshold."""
    return close_pairs(left, right, threshold)


def match_in_block(
    players: DataFrame, squad: DataFrame, threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """Match every player inside its own block (the squad of its club).

    ``players`` holds entity_id, player_name, block; ``squad`` external_id, name,
    block.  Being in the block is the proof, so a match is confident, unless two
    members have almost the same name: then it is capped below and left to review.
    """
    members = squad.withColumn(
        "right_name",
        text.sort_tokens(text.normalise_name(F.coalesce(F.col("name"), F.lit("")))),
    )
    holders = members.groupBy("block", "right_name").agg(
        F.count("*").alias("holders"), F.min("external_id").alias("first_id")
    )
    scored = name_pairs(
        _names(players, "player_name", "left_name"),
        holders.select("block", "right_name"),
        threshold - TIE_MARGIN,
    )
    # Read twice below, and dear to compute.
    scored = materialise(scored, "squad_pairs").join(grown(holders), ["block", "right_name"])
    best = scored.groupBy("block", "left_name").agg(
        F.max("score").alias("best"),
        F.min_by("first_id", F.struct(-F.col("score"), F.col("first_id"))).alias("external_id"),
    )
    tied = (
        scored.join(grown(best), ["block", "left_name"])
        .where(F.col("score") >= F.col("best") - TIE_MARGIN)
        .groupBy("block", "left_name")
        .agg(
            F.first("best").alias("best"),
            F.first("external_id").alias("external_id"),
            F.sum("holders").alias("tied"),
        )
        .where(F.col("best") >= threshold)
    )
    capped = F.round(F.least(F.col("best"), F.lit(CONFIDENT_SCORE - 1)), 2)
    named = players.withColumn(
        "left_name",
        text.sort_tokens(text.normalise_name(F.coalesce(F.col("player_name"), F.lit("")))),
    )
    return named.join(grown(tied), ["block", "left_name"], "left").select(
        "entity_id",
        "player_name",
        "external_id",
        F.lit("squad").alias("match_method"),
        F.when(F.col("tied") > 1, capped)
        .when(F.col("tied") == 1, F.lit(CONFIDENT_SCORE))
        .alias("match_confidence"),
        F.lit(False).alias("reviewed"),
    )


def score_candidates(entities: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each entity's own candidates with the name score and the club test.

    ``candidates`` holds entity_id, external_id, name, club_name.  The rules read
    the scores several times, so they are written once.
    """
    joined = _spread(candidates, "entity_id").join(
        grown(entities.select("entity_id", "player_name", "team")), "entity_id"
    )

    def sorted_name(column: str) -> Column:
        name = F.coalesce(F.col(column), F.lit(""))
        return text.sort_tokens(text.normalise_name(name))

    ready = joined.withColumns(
        {
            "__a": sorted_name("player_name"),
            "__b": sorted_name("name"),
            "__team": sorted_name("team"),
            "__club": sorted_name("club_name"),
        }
    )
    ready = materialise(ready, "candidates")

    def scored_pairs(left: str, right: str, out: str) -> DataFrame:
        """Each distinct pair of texts is scored once, however many rows hold it."""
        pairs = _spread(ready.select(left, right).distinct(), left, right)
        return materialise(pairs.withColumn(out, text.indel_ratio(left, right)), "scored_pairs")

    has_club = F.coalesce(F.col("club_name"), F.lit("")) != ""
    scored = (
        ready.join(scored_pairs("__a", "__b", "score"), ["__a", "__b"])
        .join(scored_pairs("__team", "__club", "__club_score"), ["__team", "__club"])
        .withColumn("same_club", has_club & (F.col("__club_score") >= CLUB_SCORE))
        .drop("__a", "__b", "__team", "__club", "__club_score")
    )
    return materialise(scored, "scored_candidates")


def tied_candidates(scored: DataFrame, margin: float = TIE_MARGIN) -> DataFrame:
    """Candidates whose score is within ``margin`` of their entity's best."""
    best = scored.groupBy("entity_id").agg(F.max("score").alias("best"))
    return scored.join(grown(best), "entity_id").where(F.col("score") >= F.col("best") - margin)


def best_match(
    entities: DataFrame, scored: DataFrame, threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """Best candidate of every entity, from `score_candidates`.

    A candidate of the same club is preferred whatever its spelling; without one,
    a near-tie costs fifteen points.
    """
    club = scored.groupBy("entity_id").agg(F.max("same_club").alias("any_club"))
    considered = scored.join(grown(club), "entity_id").where("same_club or not any_club")
    order = F.struct(-F.col("score"), F.col("external_id"))
    best = considered.groupBy("entity_id").agg(
        F.max("score").alias("base"),
        F.min_by("external_id", order).alias("external_id"),
        F.first("any_club").alias("any_club"),
    )
    near = (
        considered.select("entity_id", "score")
        .join(grown(best.select("entity_id", "base")), "entity_id")
        .where(F.col("score") >= F.col("base") - TIE_MARGIN)
        .groupBy("entity_id")
        .agg(F.count("*").alias("tied"))
    )
    penalty = F.when(~F.col("any_club") & (F.col("tied") > 1), NO_CLUB_PENALTY).otherwise(0.0)
    ranked = best.join(grown(near), "entity_id").withColumn("final", F.col("base") - penalty)
    found = entities.select("entity_id", "player_name").join(
        grown(ranked.where(F.col("final") >= threshold)), "entity_id", "left"
    )
    sure = F.col("final") >= CONFIDENT_SCORE
    return found.select(
        "entity_id",
        "player_name",
        "external_id",
        F.when(sure, "exact").otherwise("fuzzy").alias("match_method"),
        F.round("final", 2).alias("match_confidence"),
        F.lit(False).alias("reviewed"),
    )


def confirm_by_history(
    matches: DataFrame, scored: DataFrame, histories: DataFrame
) -> DataFrame:
    """Break a tie by career: exactly one tied candidate has been at the team.

    ``histories`` holds one row per (external_id, club).  All tied candidates are
    looked up; the look-up is a join, so no limit on their number is needed.
    """
    # Both are read several times below, and each reading would join all candidates again.
    matches = materialise(matches, "matches")
    tied = tied_candidates(scored).select("entity_id", "external_id", "team", "score")
    doubtful = matches.where(
        F.col("external_id").isNotNull() & (F.col("match_confidence") < CONFIDENT_SCORE)
    ).select("entity_id")
    # A repeated id counts once per listing, as in a search result.
    contested = materialise(tied.join(grown(doubtful), "entity_id", "left_semi"), "contested")
    clubs = histories.select(
        "external_id", text.sort_tokens(text.normalise_name("club")).alias("__club")
    ).distinct()
    careers = materialise(
        contested.withColumn("__team", text.sort_tokens(text.normalise_name("team")))
        .select("entity_id", "external_id", "__team")
        .distinct()
        .join(grown(clubs), "external_id"),
        "careers",
    )
    # Each distinct pair of team and club is scored once, however many careers hold it.
    known = _spread(careers.select("__club", "__team").distinct(), "__club", "__team")
    same = materialise(known.where(text.indel_ratio("__club", "__team") >= CLUB_SCORE), "same_clubs")
    at_team = (
        careers.join(same, ["__club", "__team"])
        .select("entity_id", "external_id")
        .distinct()
        .withColumn("__been", F.lit(1))
    )
    verdict = (
        contested.join(grown(at_team), ["entity_id", "external_id"], "left")
        .groupBy("entity_id")
        .agg(
            F.count("*").alias("__tied"),
            F.count("__been").alias("__confirmed"),
            F.max(F.when(F.col("__been") == 1, F.col("external_id"))).alias("__id"),
            F.max(F.when(F.col("__been") == 1, F.col("score"))).alias("__score"),
        )
        .where("__tied > 1 and __confirmed = 1")
    )
    decided = F.col("__id").isNotNull()
    return matches.join(grown(verdict), "entity_id", "left").select(
        "entity_id",
        "player_name",
        F.when(decided, F.col("__id")).otherwise(F.col("external_id")).alias("external_id"),
        F.when(decided, "history").otherwise(F.col("match_method")).alias("match_method"),
        F.when(decided, F.col("__score"))
        .otherwise(F.col("match_confidence"))
        .alias("match_confidence"),
        "reviewed",
    )


def identity_cascade(known: DataFrame, in_squad: DataFrame, by_search: DataFrame) -> DataFrame:
    """Stored match, else a match inside the squad, else the one found by search.

    Each input has at most one row per entity; a squad row without a match gives
    way to the search.
    """
    columns = list(MATCH_COLUMNS)
    found = in_squad.where("external_id is not null")
    options = [
        df.select(*columns).withColumn("source", F.lit(i))
        for i, df in enumerate((known, found, by_search))
    ]
    stacked = options[0].unionByName(options[1]).unionByName(options[2])
    row = F.min_by(F.struct(*columns, "source"), F.col("source"))
    return stacked.groupBy(F.col("entity_id").alias("__id")).agg(row.alias("w")).select("w.*")


def resolution_rate(matches: DataFrame) -> DataFrame:
    """Counts of a matching run and the share that was resolved."""
    resolved = F.count_if(F.col("external_id").isNotNull())
    return matches.agg(
        F.count("*").alias("entities"),
        resolved.alias("resolved"),
        F.count_if(usable()).alias("usable"),
        F.round(F.try_divide(resolved, F.count("*")), 3).alias("rate"),
    )


# --- clubs -----------------------------------------------------------------------


def _word_keys(df: DataFrame, name: str, frequency: DataFrame, threshold: float) -> DataFrame:
    """The rare words of a name that a word-sharing match on its side must contain.

    The shared words of such a match hold at least t/(200−t) of one name's
    characters.  Words are taken rarest first until the rest is shorter than that.
    """
    words = df.select("block", name, F.explode(F.split(name, " ")).alias("word"))
    weighed = words.join(grown(frequency), ["block", "word"])
    # Bounded by the words of one name.
    listed = weighed.groupBy("block", name).agg(
        F.array_sort(
            F.collect_list(F.struct("n", "word", (F.length("word") + 1).alias("size")))
        ).alias("w")
    )
    need = F.length(name) * (threshold / (200.0 - threshold)) + 1
    kept = F.expr(
        "filter(w, (x, i) -> aggregate(slice(w, i + 1, size(w)), 0, (s, y) -> s + y.size)"
        " >= __need - 1e-9)"
    )
    return (
        listed.withColumn("__need", need)
        .select("block", name, F.explode(kept).alias("x"))
        .select("block", name, F.col("x.word").alias("word"))
    )


def club_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Scored (block, left_name, right_name): token-set and token-sort ratios."""

    def words(df: DataFrame, name: str) -> DataFrame:
        return df.select("block", name, F.explode(F.split(name, " ")).alias("word"))

    def without_repeats(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn("w", F.array_join(F.array_distinct(F.split(name, " ")), " "))

    # Repeated words count once in the set ratio, so candidates are sought without them.
    lefts, rights = without_repeats(left, "left_name"), without_repeats(right, "right_name")
    one = lefts.select("block", F.col("w").alias("left_name")).distinct()
    two = rights.select("block", F.col("w").alias("right_name")).distinct()
    frequency = (
        words(one, "left_name")
        .select("block", "word")
        .unionAll(words(two, "right_name").select("block", "word"))
        .groupBy("block", "word")
        .agg(F.count("*").alias("n"))
    )
    by_left = _word_keys(one, "left_name", frequency, threshold).join(
        grown(words(two, "right_name")), ["block", "word"]
    )
    by_right = _word_keys(two, "right_name", frequency, threshold).join(
        grown(words(one, "left_name")), ["block", "word"]
    )
    names = ("block", "left_name", "right_name")
    bare = (
        by_left.select(*names)
        .unionByName(by_right.select(*names))
        .unionByName(close_pairs(one, two, threshold, score=False))
        .distinct()
        .withColumnsRenamed({"left_name": "lw", "right_name": "rw"})
    )
    pairs = (
        bare.join(grown(lefts.withColumnRenamed("w", "lw")), ["block", "lw"])
        .join(grown(rights.withColumnRenamed("w", "rw")), ["block", "rw"])
        .select(*names)
    )
    split = {
        "__l": F.array_distinct(text.tokens("left_name")),
        "__r": F.array_distinct(text.tokens("right_name")),
    }
    rests = {
        "__ab": F.array_join(F.array_except("__l", "__r"), " "),
        "__ba": F.array_join(F.array_except("__r", "__l"), " "),
    }
    ready = pairs.withColumns(split).withColumns(rests)
    scored = _spread(ready, "block", "left_name").withColumns(
        {
            "set_score": text.token_set_ratio("__l", "__r", "__ab", "__ba"),
            "sort_score": text.indel_ratio("left_name", "right_name"),
        }
    )
    return scored.select(*names, "set_score", "sort_score").where(
        F.col("set_score") >= threshold
    )


def match_clubs(
    teams: DataFrame, clubs: DataFrame, threshold: float = CLUB_NAME_SCORE
) -> DataFrame:
    """The club of every team inside its competition.

    ``teams`` holds block, team; ``clubs`` block, club_id, name.  The best pair of
    scores wins; a full tie resolves to nothing.
    """

    def sorted_name(column: str) -> Column:
        return text.sort_tokens(text.normalise_name(F.coalesce(F.col(column), F.lit(""))))

    listed = clubs.withColumn("right_name", sorted_name("name"))
    holders = listed.groupBy("block", "right_name").agg(
        F.count("*").alias("holders"), F.min("club_id").alias("club_id")
    )
    scored = club_pairs(
        _names(teams, "team", "left_name"), holders.select("block", "right_name"), threshold
    )
    scored = materialise(scored, "club_pairs").join(grown(holders), ["block", "right_name"])
    key = F.struct("set_score", "sort_score")
    best = scored.groupBy("block", "left_name").agg(F.max(key).alias("best"))
    winners = (
        scored.join(grown(best), ["block", "left_name"])
        .where(key == F.col("best"))
        .groupBy("block", "left_name")
        .agg(
            F.sum("holders").alias("tied"),
            F.min("club_id").alias("club_id"),
            F.first("best").alias("best"),
        )
    )
    clear = F.col("tied") == 1
    return (
        teams.withColumn("left_name", sorted_name("team"))
        .join(grown(winners), ["block", "left_name"], "left")
        .select(
            "block",
            "team",
            F.when(clear, F.col("club_id")).alias("club_id"),
            F.when(clear, F.round(F.col("best.set_score"), 4)).alias("set_score"),
            F.when(clear, F.round(F.col("best.sort_score"), 4)).alias("sort_score"),
        )
    )
