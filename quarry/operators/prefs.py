"""Preferences and upserts: joins of dimensions and facts, completion, replace-all and merge writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def completion(sports: Column, teams: Column) -> Column:
    """A3: 100 with three sports and five teams, 50 with three sports and none, else 16.67 a sport and 10 a team."""
    return F.when((sports >= 3) & (teams >= 5), 100.0).when((sports >= 3) & (teams == 0), 50.0).otherwise(F.round(sports * 16.67 + teams * 10.0, 2))


def status(users: DataFrame, sport_prefs: DataFrame, team_prefs: DataFrame) -> DataFrame:
    """Counts of each user's preferences and how complete they are; users without any count 0."""
    s = sport_prefs.groupBy("user_id").agg(F.countDistinct("sport_id").alias("sports"))
    t = team_prefs.groupBy("user_id").agg(F.countDistinct("team_id").alias("teams"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = users.select("user_id").join(s, "user_id", "left").join(t, "user_id", "left")
    return joined.select("user_id", zero("sports").alias("sports"), zero("teams").alias("teams"), completion(zero("sports"), zero("teams")).alias("completion"))


def listing(sport_prefs: DataFrame, team_prefs: DataFrame, sports: DataFrame, teams: DataFrame) -> DataFrame:
    """Both kinds of preference as one list with typed nulls. J2, J3, union."""
    a = sport_prefs.join(sports, "sport_id").select("user_id", F.lit("sport").alias("kind"), F.col("sport_id").cast("long").alias("id"), F.col("sport_name").alias("name"), F.lit(None).cast("string").alias("sport"), "position")
    b = team_prefs.join(teams, "team_id").join(sports, "sport_id").select("user_id", F.lit("team").alias("kind"), F.col("team_id").cast("long").alias("id"), F.col("team_name").alias("name"), F.col("sport_name").alias("sport"), "position")
    return a.unionByName(b)


def replaced(current: DataFrame, lists: DataFrame) -> DataFrame:
    """SK5: current: user_id, entity_id, position; lists: user_id, entities. A listed user's rows are replaced, numbered from 1."""
    new = lists.select("user_id", F.posexplode("entities").alias("p", "entity_id")).select("user_id", "entity_id", (F.col("p") + 1).alias("position"))
    return current.join(lists.select("user_id"), "user_id", "left_anti").unionByName(new)


def invalid(requested: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """Requested ids that the catalogue lacks."""
    return requested.join(catalogue, key, "left_anti")


def upserted(current: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """SK1, SK3, SK4, SK6: new rows replace those of equal key, but for the `keep` columns, which stay as first written. new has each key once."""
    mine, theirs = current.alias("c"), new.alias("n")
    there = F.col(f"n.{key}").isNotNull()
    columns = [F.coalesce(f"n.{key}", f"c.{key}").alias(key)]
    for c in current.columns:
        if c != key:
            first, last = F.col(f"c.{c}"), F.col(f"n.{c}")
            columns.append((F.when(F.col(f"c.{key}").isNotNull(), first).otherwise(last) if c in keep else F.when(there, last).otherwise(first)).alias(c))
    return mine.join(theirs, F.col(f"c.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def inserted(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SK2, SK4 (do nothing on conflict): new rows whose key isn't there yet are added."""
    return current.unionByName(new.join(current.select(key), key, "left_anti"))


def source_name(domain: Column) -> Column:
    """SK2: the domain in title case without www. : letters after any other character are capitals."""
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(domain), r"^www\.", ""), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def patched(current: DataFrame, update: DataFrame, key: str) -> DataFrame:
    """M2: only the fields that the update gives overwrite."""
    fields = [F.coalesce(F.col(f"u.{c}"), F.col(f"c.{c}")).alias(c) for c in current.columns if c != key]
    return current.alias("c").join(update.alias("u"), key, "left").select(key, *fields)


def allowed(roles: Column, needed: tuple[str, ...], every: bool = False) -> Column:
    """M1: whether roles hold any (or every one) of those needed; nothing needed is always allowed."""
    if not needed:
        return F.lit(True)
    wanted = F.array(*map(F.lit, needed))
    return F.size(F.array_except(wanted, roles)) == 0 if every else F.arrays_overlap(roles, wanted)


def relative_impact(value: Column, base: Column) -> Column:
    """M4."""
    return F.when(base > 0, (value - base) / base).otherwise(0.0)


def failures(checks: dict[str, Column]) -> Column:
    """M5, M6: the names of the checks that don't hold, in order."""
    marks = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return F.filter(marks, lambda m: m.isNotNull())


