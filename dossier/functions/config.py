"""CFG1: configuration as frozen data, with the constants of the library as its defaults, checked as a whole.

    config = load({"search": {"floor": 0.6}})

``load`` merges what is given into the defaults and raises ``ConfigError`` with every problem at once: keys that there are
not, values of another kind, values beyond their bounds, and values that contradict each other.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from dossier.functions import language, settings
from dossier.operators import search, vocabulary
from dossier.streaming import changes


class ConfigError(ValueError):
    def __init__(self, problems: list[str]):
        super().__init__("\n".join(problems))
        self.problems = problems


def _bound(default: Any, least: float | None = None, most: float | None = None, above: float | None = None):
    return field(default=default, metadata={"least": least, "most": most, "above": above})


@dataclass(frozen=True)
class Watcher:
    polls: int = _bound(changes.POLLS, least=1)
    zero_bytes_s: float = _bound(changes.ZERO_BYTES_S, least=0)
    unopenable_s: float = _bound(changes.UNOPENABLE_S, least=0)
    longest_s: float = _bound(changes.LONGEST_S, above=0)
    pair_s: float = _bound(changes.PAIR_S, above=0)


@dataclass(frozen=True)
class Search:
    rrf_k: int = _bound(search.RRF_K, least=1)
    floor: float = _bound(search.FLOOR, least=-1, most=1)
    candidates: int = _bound(search.CANDIDATES, least=1)
    results: int = _bound(search.RESULTS, least=1)
    shortest: int = _bound(search.SHORTEST, least=1)


@dataclass(frozen=True)
class Language:
    sure: float = _bound(language.SURE, least=0, most=1)
    sure_of_short: float = _bound(language.SURE_OF_SHORT, least=0, most=1)
    words: int = _bound(language.WORDS, least=0)


@dataclass(frozen=True)
class Config:
    watcher: Watcher = field(default_factory=Watcher)
    search: Search = field(default_factory=Search)
    language: Language = field(default_factory=Language)
    #: Kind to the similarity of a merge and of a suggestion.
    vocabulary: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(vocabulary.THRESHOLDS))

    def problems(self) -> list[str]:
        out = []
        for section in ("watcher", "search", "language"):
            for f in fields(getattr(self, section)):
                value, name = getattr(getattr(self, section), f.name), f"{section}.{f.name}"
                wanted = (int,) if f.type == "int" else (int, float)
                if isinstance(value, bool) or not isinstance(value, wanted):
                    out.append(f"{name} must be {'a whole number' if f.type == 'int' else 'a number'}")
                    continue
                least, most, above = (f.metadata[k] for k in ("least", "most", "above"))
                # Written so that what is no number fails.
                if least is not None and not value >= least:
                    out.append(f"{name} must be at least {least}")
                if most is not None and not value <= most:
                    out.append(f"{name} must be at most {most}")
                if above is not None and not value > above:
                    out.append(f"{name} must be more than {above}")
        if out:
            return out
        if self.watcher.longest_s <= max(self.watcher.zero_bytes_s, self.watcher.unopenable_s):
            out.append("watcher.longest_s must be more than the other waits, so that a file could have stopped changing before")
        if self.search.results > 2 * self.search.candidates:
            out.append("search.results must not be more than two lists of search.candidates can give")
        if self.language.sure_of_short < self.language.sure:
            out.append("language.sure_of_short must not be less than language.sure")
        for kind, pair in self.vocabulary.items():
            if len(pair) != 2 or any(isinstance(x, bool) or not isinstance(x, int | float) or not 0.45 < x <= 1 for x in pair):
                out.append(f"vocabulary.{kind} must be two similarities above 0.45, of 1 at most")
            elif pair[0] < pair[1]:
                out.append(f"vocabulary.{kind}: what is merged must be as alike as what is suggested")
        return out


def load(given: dict[str, Any] | None = None) -> Config:
    """The defaults with what is given; a null value leaves its default."""
    base, given = asdict(Config()), given or {}
    problems = [f"{key} is no setting" for key in settings.unknown_keys({k: v for k, v in base.items() if k != "vocabulary"}, {k: v for k, v in given.items() if k != "vocabulary"})]
    shapes = [f"{key} must be an object" for key, value in given.items() if key in base and value is not None and not isinstance(value, dict)]
    if problems or shapes:
        raise ConfigError(problems + shapes)
    whole = settings.merged(base, given)
    config = Config(Watcher(**whole["watcher"]), Search(**whole["search"]), Language(**whole["language"]), {k: tuple(v) if isinstance(v, list | tuple) else (v,) for k, v in whole["vocabulary"].items()})
    if found := config.problems():
        raise ConfigError(found)
    return config
