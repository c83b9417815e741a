"""Reads of a sports league: standings, games, rosters, box scores and transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.errors import Refused
from weftline.operators.writes import Change, update_where
from weftline.specs import TableSpec


def standings(table: DataFrame, season: int | None = None, conference: str | None = None) -> DataFrame:
    """Standings, of a season and a conference when given, most wins first."""
    if season is not None:
        table = table.where(F.col("season") == season)
    if conference:
        table = table.where(F.col("conference") == conference)
    return table.orderBy(F.col("wins").desc(), "team_id")


def games(table: DataFrame, season: int | None = None, week: int | None = None, team: int | None = None) -> DataFrame:
    """Games by date; a team's games are those at home or away."""
    if season is not None:
        table = table.where(F.col("season") == season)
    if week is not None:
        table = table.where(F.col("week") == week)
    if team is not None:
        table = table.where((F.col("home_team_id") == team) | (F.col("away_team_id") == team))
    return table.orderBy("game_date", "id")


def roster(players: DataFrame, team: int, position: str | None = None, active: bool | None = None) -> DataFrame:
    players = players.where(F.col("team_id") == team)
    if position:
        players = players.where(F.col("position") == position)
    if active is not None:
        players = players.where(F.col("is_active") == active)
    return players.orderBy("last_name", "id")


def boxscore(stats: DataFrame, game: int) -> DataFrame:
    return stats.where(F.col("game_id") == game)


def transfer(players: DataFrame, spec: TableSpec, player: int, team: int) -> Change:
    """Move one player to another team; a player who is not there is refused."""
    if not players.where(F.col("id") == player).take(1):
        raise Refused(f"there is no player {player}")
    return update_where(players, spec, F.col("id") == player, {"team_id": team})
