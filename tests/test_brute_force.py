"""Requests against plain Python on random facts in which one key holds a third of the rows."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from helpers import fact, rows

from reachlens.operators import affinity
from reachlens.plans import weekly
from reachlens.schemas import REF_CH_GROUP_TG_MKT, REF_GENRE_TG_MKT

SELECTION = affinity.Selection(1, "ADGRP", affinity.Cell(1, 1), affinity.Cell(11, 2), 201505, 201520)
NETWORK_OF = {1: 1, 2: 1, 3: 2, 4: 3}
GENRE_OF = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def random_fact(seed):
    pick = random.Random(seed)
    data = []
    for number in range(240):
        hot = number % 3 == 0
        channel = 1 if hot else pick.choice([1, 2, 3, 4])
        program = 1 if hot else pick.choice([1, 2, 3, 4, 5])
        data.append(
            {
                "CHANNEL_GROUP_KEY": channel,
                "NETWORK_KEY": NETWORK_OF[channel],
                "PROGRAM_GROUP_KEY": program,
                "GENRE_KEY": GENRE_OF[program],
                "ADVERTISERS_GROUP_KEY": pick.choice([1, 2]),
                "TG_KEY": pick.choice([1, 11]),
                "MARKET_KEY": pick.choice([1, 2]),
                "WEEK_KEY": pick.choice([201504, 201505, 201512, 201520, 201521]),
                "ADGRP": pick.choice([None, 1, 2, 2, 0.0000001]),
            }
        )
    return data


def in_cell(row, cell):
    return (row["TG_KEY"], row["MARKET_KEY"]) == (cell.tg, cell.market) and 201505 <= row["WEEK_KEY"] <= 201520


def total(values):
    known = [Decimal(str(value)) for value in values if value is not None]
    return sum(known) if known else None


def grouped(data, key):
    groups = defaultdict(list)
    for row in data:
        groups[key(row)].append(row["ADGRP"])
    return {key_: total(values) for key_, values in groups.items()}


def counted_once(data, key):
    """Sums per cell, equal (key, sum) rows merged, then summed."""
    merged = {
        item for cell in (SELECTION.older, SELECTION.newer) for item in grouped([r for r in data if in_cell(r, cell)], key).items()
    }
    result = defaultdict(list)
    for key_, value in merged:
        result[key_].append(value)
    return {key_: total(values) for key_, values in result.items()}


KEYS = {
    "Genre": lambda row: (row["GENRE_KEY"], row["NETWORK_KEY"]),
    "Channel": lambda row: (row["CHANNEL_GROUP_KEY"], row["GENRE_KEY"]),
    "Show": lambda row: (row["CHANNEL_GROUP_KEY"], row["PROGRAM_GROUP_KEY"]),
}


def genre_of(level, key):
    return {"Genre": key[0], "Channel": key[1], "Show": GENRE_OF[key[1]]}[level]


def expected(data, level):
    client = [row for row in data if row["ADVERTISERS_GROUP_KEY"] == 1]
    totals, clients = counted_once(data, KEYS[level]), counted_once(client, KEYS[level])
    genres = counted_once(data, lambda row: row["GENRE_KEY"])
    client_genres = counted_once(client, lambda row: row["GENRE_KEY"])
    return sorted(
        (
            (*key, value, genres[genre_of(level, key)], clients.get(key), client_genres.get(genre_of(level, key)))
            for key, value in totals.items()
        ),
        key=lambda row: tuple((value is None, str(value)) for value in row[:2]),
    )


def frames(spark, data, kind):
    genres = [(k, "", f"genre {k}", 1, 1, "CUST_SALES", "") for k in (1, 2)]
    channels = [(k, "", 11, 2, "CUST_SALES/BARC", "", "", "") for k in (1, 1, 3)]
    return kind(
        fact(spark, *data),
        spark.createDataFrame(genres, REF_GENRE_TG_MKT),
        spark.createDataFrame(channels, REF_CH_GROUP_TG_MKT),
    )


@pytest.mark.parametrize("kind", [weekly.Rollups, weekly.FactOnly])
@pytest.mark.parametrize("level", ["Genre", "Channel", "Show"])
def test_totals(spark, level, kind):
    data = random_fact(level)
    found = affinity.tg_affinity(frames(spark, data, kind).cells(SELECTION, affinity.LEVELS[level]))
    columns = ("cat_key", "level_key", "prog_metric", "metric_share", "client_metric", "client_share")
    assert rows(found, *columns) == expected(data, level)


@pytest.mark.parametrize("kind", [weekly.Rollups, weekly.FactOnly])
def test_channel_insights(spark, kind):
    data = random_fact(7)
    merged = set()
    for cell in (SELECTION.older, SELECTION.newer):
        chosen = [row for row in data if in_cell(row, cell)]
        client = grouped([row for row in chosen if row["ADVERTISERS_GROUP_KEY"] == 1], KEYS["Channel"])
        every = grouped(chosen, KEYS["Channel"])
        merged |= {(key, value, every[key]) for key, value in client.items()}
    wanted = defaultdict(lambda: ([], []))
    for key, client_value, value in merged:
        wanted[key][0].append(client_value)
        wanted[key][1].append(value)
    found = affinity.channel_insights(frames(spark, data, kind).cells(SELECTION, affinity.CHANNEL))
    assert {(row.level_key, row.cat_key): (row.client_metric, row.prog_metric) for row in found.collect()} == {
        key: (total(clients), total(totals)) for key, (clients, totals) in wanted.items()
    }


@pytest.mark.parametrize("kind", [weekly.Rollups, weekly.FactOnly])
@pytest.mark.parametrize("level", ["Genre", "Channel", "Show"])
def test_denominators(spark, level, kind):
    """A channel whose base cell is listed twice counts twice."""
    data = random_fact(11)
    built = frames(spark, data, kind)
    times = {1: 1, 2: 1} if level == "Genre" else {1: 2, 3: 1}
    cell = affinity.Cell(1, 1) if level == "Genre" else affinity.Cell(11, 2)
    key_name = "GENRE_KEY" if level == "Genre" else "CHANNEL_GROUP_KEY"
    wanted = defaultdict(list)
    for row in data:
        if in_cell(row, cell):
            wanted[KEYS[level](row)] += [row["ADGRP"]] * times.get(row[key_name], 0)
    chosen = affinity.LEVELS[level]
    kinds = (chosen.category, chosen.level)
    prefix = [name.removesuffix("_DISPLAY_NAME").lower() for name in kinds]
    found = {
        (row.category, row.level): row.affinity_denom
        for row in built.denominator(SELECTION, chosen).collect()
        if row.affinity_denom is not None
    }
    order = (1, 0) if level == "Show" else (0, 1)
    assert found == {
        (f"{prefix[0]} {key[order[0]]}", f"{prefix[1]} {key[order[1]]}"): total(values)
        for key, values in wanted.items()
        if total(values) is not None
    }
