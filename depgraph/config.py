"""Settings in layers: defaults, then YAML, then the environment, then the command line; later layers win whole keys."""

from __future__ import annotations

import argparse
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

DIRECTIONS = ("uses", "used-by")
PREFIX = "DEPGRAPH_"


class ConfigError(ValueError):
    """The first thing that is wrong with the settings."""


@dataclass(frozen=True)
class Config:
    base_path: str
    direction: str = "uses"
    level: int | None = None
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    type: str = "php"
    debug: Mapping[str, Any] = field(default_factory=dict)


def defaults() -> dict[str, Any]:
    return {"basePath": ".", "direction": "uses", "level": None, "includes": [], "excludes": [], "type": "php", "debug": {"depth": 5, "seed": None}}


def from_yaml(path: str) -> dict[str, Any]:
    """A missing file has no settings; one that can't be read, isn't YAML or holds no mapping is an error."""
    if not os.path.exists(path):
        return {}
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("reading YAML needs the yaml package") from e
    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        raise ConfigError(f"{path} can't be read: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError(f"{path} holds no mapping")
    return found


def from_env(env: Mapping[str, str], prefix: str = PREFIX) -> dict[str, Any]:
    """PREFIX_SOME_KEY is someKey; debug_* are nested; lists are split at commas; only the level becomes a number."""
    found: dict[str, Any] = {}
    for name, value in sorted(env.items()):
        if not name.startswith(prefix):
            continue
        first, *rest = name[len(prefix) :].lower().split("_")
        if first == "debug" and rest:
            found.setdefault("debug", {})["".join([rest[0], *(x.capitalize() for x in rest[1:])])] = value
            continue
        key = "".join([first, *(x.capitalize() for x in rest)])
        if key in ("includes", "excludes"):
            found[key] = [x.strip() for x in value.split(",")]
        elif key == "level":
            found[key] = int(value) if value.strip().lstrip("-").isdigit() else value
        else:
            found[key] = value
    return found


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inspect", description="What a symbol uses, or what uses it.", argument_default=argparse.SUPPRESS)
    p.add_argument("target")
    p.add_argument("path", nargs="?")
    p.add_argument("--config")
    p.add_argument("-D", "--direction")
    p.add_argument("-L", "--level")
    p.add_argument("-R", "--reverse", action="store_true")
    p.add_argument("-I", "--include", action="append")
    p.add_argument("-E", "--exclude", action="append")
    p.add_argument("--type")
    p.add_argument("--debug-depth", type=int)
    p.add_argument("--debug-seed", type=int)
    p.add_argument("--memory-limit")
    p.add_argument("--format", help="name of a reporter")
    return p


def from_args(given: argparse.Namespace) -> dict[str, Any]:
    """Only what was given; --reverse wins over --direction."""
    args, found = vars(given), {}
    for name, key in (("path", "basePath"), ("direction", "direction"), ("include", "includes"), ("exclude", "excludes"), ("type", "type")):
        if args.get(name) is not None:
            found[key] = args[name]
    if args.get("reverse"):
        found["direction"] = "used-by"
    if "level" in args:
        if not str(args["level"]).isdigit() or int(args["level"]) < 1:
            raise ConfigError(f"Invalid level: {args['level']}. Level must be a positive integer.")
        found["level"] = int(args["level"])
    debug = {k: args[n] for n, k in (("debug_depth", "depth"), ("debug_seed", "seed")) if n in args}
    return found | ({"debug": debug} if debug else {})


def merged(*layers: Mapping[str, Any]) -> Config:
    """One Config from layers, later ones first in rank; keys are replaced whole, and unknown ones are let be."""
    both: dict[str, Any] = {}
    for layer in layers:
        both |= layer
    return checked(both)


def checked(s: Mapping[str, Any]) -> Config:
    def wrong(what: str):
        raise ConfigError(what)

    base = s.get("basePath")
    if not isinstance(base, str) or not base.strip():
        wrong("basePath must be a non-empty string")
    if s.get("direction") not in DIRECTIONS:
        wrong(f"direction must be one of {', '.join(DIRECTIONS)}")
    level = s.get("level")
    if level is not None and (type(level) is not int or level < 1):
        wrong("level must be a positive integer")
    for key in ("includes", "excludes"):
        value = s.get(key, [])
        if not isinstance(value, (list, tuple)) or any(not isinstance(x, str) or not x.strip() for x in value):
            wrong(f"{key} must be a list of non-blank strings")
    from depgraph.registry import ANALYZERS  # only now, as others may be registered by then

    if s.get("type") not in ANALYZERS:
        wrong(f"type must be one of {', '.join(ANALYZERS)}")
    debug = s.get("debug", {})
    if not isinstance(debug, Mapping):
        wrong("debug must be a mapping")
    if s["type"] == "debug":
        if type(debug.get("depth")) is not int or debug["depth"] < 1:
            wrong("debug depth must be a positive integer")
        if debug.get("seed") is not None and type(debug["seed"]) is not int:
            wrong("debug seed must be an integer")
    return Config(base, s["direction"], level, tuple(s.get("includes", ())), tuple(s.get("excludes", ())), s["type"], dict(debug))


def load(argv: Sequence[str], env: Mapping[str, str] | None = None) -> tuple[Config, str, argparse.Namespace]:
    """Config, target and the parsed arguments of a command line."""
    args = parser().parse_args(argv)
    layers = [defaults(), from_yaml(getattr(args, "config", "depgraph.yaml")), from_env(os.environ if env is None else env), from_args(args)]
    return merged(*layers), args.target, args
