"""Column expressions on player-game rows. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlens.schema import KILL_COUNTERS, ROLES


def kde(kills="kills", deaths="deaths", assists="assists") -> Column:
    """Kills and assists per death; one is added to deaths, so no division by zero."""
    return (F.col(kills) + F.col(assists)) / (F.col(deaths) + 1)


def multi_kill(counters=KILL_COUNTERS) -> Column:
    """1 when any multi-kill counter is positive. A missing counter is not positive."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) > 0, F.lit(False)) for c in counters])
    return F.when(hit, 1).otherwise(0)


def dtpd(damage="total_damage_taken", deaths="deaths") -> Column:
    """Damage taken per death."""
    return F.col(damage) / (F.col(deaths) + 1)


def percent_fraction(name: str) -> Column:
    """``'45.1%'`` to 0.451; text that is no number becomes NULL."""
    return F.expr(f"try_cast(trim(trim(BOTH '%' FROM trim(`{name}`))) AS double)") / 100


def pair_low(blue="blue_team", red="red_team") -> Column:
    return F.least(blue, red)


def pair_high(blue="blue_team", red="red_team") -> Column:
    return F.greatest(blue, red)


def win_by_slot(slot, winner="winning_team", blue="blue_team", team_size: int = 5) -> Column:
    """Label of a player by slot: the first ``team_size`` slots are the blue side."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.when((slot < team_size) == (F.col(winner) == F.col(blue)), 1).otherwise(0)


def other_team(team: Column) -> Column:
    """The side of the game that is not ``team``."""
    return F.when(team == F.col("blue_team"), F.col("red_team")).otherwise(F.col("blue_team"))


def own_team() -> Column:
    """A winner played for the winning team, a loser for the other one."""
    winner = F.col("winning_team")
    return F.when(F.col("win") == 1, winner).otherwise(other_team(winner))


def opponent_team() -> Column:
    winner = F.col("winning_team")
    return F.when(F.col("win") == 1, other_team(winner)).otherwise(winner)


def threshold_label(probability) -> Column:
    """1 only when the probability is strictly above one half."""
    p = F.col(probability) if isinstance(probability, str) else probability
    return (p > 0.5).cast("int")


def stat_or_zero(name: str) -> Column:
    """A stat that is missing at scoring time counts as zero."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def role_display(role) -> Column:
    """Display spelling of a role written in any case; NULL for an unknown role."""
    role = F.col(role) if isinstance(role, str) else role
    low = F.lower(F.trim(role))
    return F.coalesce(*[F.when(low == r.lower(), F.lit(r)) for r in ROLES])
