"""Configuration: defaults, merging, and every problem at once."""

import dataclasses

import pytest

from dossier.functions import config


def test_defaults_and_merging():
    assert config.load().search.floor == 0.56 and config.load({}) == config.load(None)
    given = config.load({"search": {"floor": 0.6, "results": None}, "vocabulary": {"topic": [0.97, 0.95]}})
    assert given.search.floor == 0.6 and given.search.results == 50 and given.vocabulary["topic"] == (0.97, 0.95) and given.vocabulary["party"] == (1.0, 0.9)
    with pytest.raises(dataclasses.FrozenInstanceError):
        given.search.floor = 1


@pytest.mark.parametrize(
    ("given", "problems"),
    [
        ({"serch": {}, "search": {"flor": 1}}, ["serch is no setting", "search.flor is no setting"]),
        ({"search": 5}, ["search must be an object"]),
        ({"watcher": {"polls": 0, "longest_s": 0}, "search": {"floor": 2}}, ["watcher.polls must be at least 1", "watcher.longest_s must be more than 0", "search.floor must be at most 1"]),
        ({"watcher": {"polls": 1.5, "zero_bytes_s": "30"}, "search": {"rrf_k": True}}, ["watcher.polls must be a whole number", "watcher.zero_bytes_s must be a number", "search.rrf_k must be a whole number"]),
        ({"watcher": {"longest_s": 60}}, ["watcher.longest_s must be more than the other waits, so that a file could have stopped changing before"]),
        ({"search": {"floor": float("nan")}}, ["search.floor must be at least -1", "search.floor must be at most 1"]),
        ({"language": {"sure_of_short": 0.1}}, ["language.sure_of_short must not be less than language.sure"]),
        ({"vocabulary": {"topic": [0.9, 0.95], "party": [1.0], "object": [1.0, 0.3]}}, ["vocabulary.party must be two similarities above 0.45, of 1 at most", "vocabulary.topic: what is merged must be as alike as what is suggested", "vocabulary.object must be two similarities above 0.45, of 1 at most"]),
    ],
)
def test_problems(given, problems):
    with pytest.raises(config.ConfigError) as found:
        config.load(given)
    assert sorted(found.value.problems) == sorted(problems)
