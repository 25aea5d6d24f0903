"""Settings of a nightly run: one file, checked as a whole, into frozen sections.

TOML and JSON are read as they are, YAML where a reader for it is installed. Each section's fields, their types and defaults are
its class; an unknown field is an error, as is one that is missing or can't be read as its type. Keys of providers stay in the environment, which a
``.env`` file beside the settings' folder may fill; what is set already wins.
"""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import MISSING, dataclass, field, fields
from pathlib import Path
from typing import Any, get_type_hints


class SettingsError(ValueError):
    """Settings that can't be used; the message names the field."""


@dataclass(frozen=True)
class Scout:
    categories: list[str]
    lookback_days: int = 1
    max_results: int = 200
    #: Where the pages of the search are (see ``sources.search``).
    pages: str = ""


@dataclass(frozen=True)
class Corpus:
    source: str = ""
    stale_after_days: int = 30


@dataclass(frozen=True)
class Ranking:
    weights: dict[str, float]
    top_n: int = 5


@dataclass(frozen=True)
class Connect:
    enabled: bool = True
    openalex_mailto: str = ""
    arxiv_bib: bool = True


@dataclass(frozen=True)
class Retention:
    enabled: bool = True
    days: int = 7


@dataclass(frozen=True)
class Role:
    provider: str
    model: str
    api_key_env: str
    base_url: str = ""

    @property
    def api_key(self) -> str:
        key = os.environ.get(self.api_key_env, "").strip()
        if not key:
            raise SettingsError(f"{self.api_key_env} isn't set")
        return key


@dataclass(frozen=True)
class Settings:
    root: Path
    topics: list[str]
    scout: Scout
    ranking: Ranking
    llm: dict[str, Role]
    corpus: Corpus = field(default_factory=Corpus)
    connect: Connect = field(default_factory=Connect)
    retention: Retention = field(default_factory=Retention)

    def role(self, name: str) -> Role:
        if name not in self.llm:
            raise SettingsError(f"llm.{name} is missing; there are: {', '.join(sorted(self.llm))}")
        return self.llm[name]


#: Roles of models that a run needs.
ROLES = ("light", "heavy")


def _read_as(value: Any, kind: Any, where: str) -> Any:
    """``value`` as a field's type: whole numbers and numbers also from text, lists and maps entry by entry."""
    try:
        if kind is bool:
            if not isinstance(value, bool):
                raise TypeError
            return value
        if kind in (int, float, str):
            if isinstance(value, (bool, list, dict)) or value is None and kind is not str:
                raise TypeError
            return kind("" if value is None else value)
        if kind == list[str]:
            if not isinstance(value, list):
                raise TypeError
            return [_read_as(v, str, where) for v in value]
        if not isinstance(value, dict):
            raise TypeError
        if kind == dict[str, float]:
            return {str(k): _read_as(v, float, f"{where}.{k}") for k, v in value.items()}
        return _section(kind, value, where)
    except (TypeError, ValueError) as error:
        if isinstance(error, SettingsError):
            raise
        raise SettingsError(f"{where}: {value!r} isn't {getattr(kind, '__name__', kind)}") from None


def _section(kind: type, raw: dict, where: str) -> Any:
    hints, known, out = get_type_hints(kind), {f.name: f for f in fields(kind)}, {}
    if unknown := sorted(set(raw) - set(known)):
        raise SettingsError(f"{where}: unknown {', '.join(unknown)}")
    for name, f in known.items():
        if name in raw and raw[name] is not None:
            out[name] = _read_as(raw[name], hints[name], f"{where}.{name}")
        elif f.default is MISSING and f.default_factory is MISSING:
            raise SettingsError(f"{where}.{name} is missing")
    return kind(**out)


def _parsed(path: Path) -> dict:
    try:
        if path.suffix == ".json":
            out = json.loads(path.read_text())
        elif path.suffix == ".toml":
            out = tomllib.loads(path.read_text())
        else:
            try:
                import yaml
            except ImportError:
                raise SettingsError(f"{path}: no reader for YAML is installed; use TOML or JSON") from None
            try:
                out = yaml.safe_load(path.read_text())
            except yaml.YAMLError as error:
                raise SettingsError(f"{path}: {error}") from None
    except (json.JSONDecodeError, tomllib.TOMLDecodeError) as error:
        raise SettingsError(f"{path}: {error}") from None
    if not isinstance(out, dict):
        raise SettingsError(f"{path}: not a table of sections")
    return out


def fill_environment(path: Path) -> None:
    """Sets what a file of NAME=value lines has and the environment lacks."""
    for line in path.read_text().splitlines() if path.exists() else ():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def load(path: str | Path, root: str | Path | None = None) -> Settings:
    """Reads and checks a file; relative paths in it start at ``root``, the folder above the file's own if not given."""
    path = Path(path).expanduser().resolve()
    if not path.exists():
        raise SettingsError(f"{path} doesn't exist")
    root = Path(root).resolve() if root else path.parent.parent
    fill_environment(root / ".env")
    raw = _parsed(path)
    sections = {"scout": Scout, "ranking": Ranking, "corpus": Corpus, "connect": Connect, "retention": Retention}
    if unknown := sorted(set(raw) - set(sections) - {"topics", "llm"}):
        raise SettingsError(f"unknown {', '.join(unknown)}")
    for needed in ("scout", "ranking", "llm"):
        if not raw.get(needed):
            raise SettingsError(f"{needed} is missing")
    topics = _read_as(raw.get("topics") or [], list[str], "topics")
    read = {name: _read_as(raw.get(name) or {}, kind, name) for name, kind in sections.items()}
    if not isinstance(raw["llm"], dict):
        raise SettingsError("llm: not a table of roles")
    llm = {name: _read_as(value, Role, f"llm.{name}") for name, value in raw["llm"].items()}
    out = Settings(root=root, topics=topics, llm=llm, **read)
    wrong = [
        (not out.topics, "topics: none, so nothing could be relevant"), (not out.ranking.weights, "ranking.weights: none"), (out.retention.days < 1, "retention.days: less than 1; switch it off by retention.enabled"),
        (out.connect.enabled and not out.connect.openalex_mailto, "connect.openalex_mailto: empty, though connect is enabled"), *((name not in llm, f"llm.{name} is missing") for name in ROLES),
    ]
    if said := [text for bad, text in wrong if bad]:
        raise SettingsError("; ".join(said))
    if out.corpus.source and "://" not in out.corpus.source:
        source = Path(out.corpus.source).expanduser()
        out = Settings(**{**{f.name: getattr(out, f.name) for f in fields(out)}, "corpus": Corpus(str(source if source.is_absolute() else root / source), out.corpus.stale_after_days)})
    return out
