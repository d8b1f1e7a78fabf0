"""Configuration: TOML file, profile overlay, merged lists, validation, and a careful writer. Driver-side only."""

from __future__ import annotations

import dataclasses
import os
import re
import stat
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions.chars import EXCLUDED_APPS, TRACKING
from ..operators.rules import MOST_RULES, Rule, RuleError, compiled

DEFAULT_WINDOW_MS = 450


class ConfigError(ValueError):
    """A configuration that can't be used."""


class ConfigIntegrityError(ConfigError):
    """A configuration file with unexpected permissions."""


@dataclass(frozen=True)
class Settings:
    normalize_unicode: bool = True
    whitespace_cleanup: bool = True
    agent_strip: bool = True
    structural_detection: bool = True
    url_cleaning: bool = True
    table_cell_picker: bool = True
    table_cell_picker_min_confidence: float = 0.75
    auto_wrapper: bool = False
    user_rules: bool = True
    sensitive_filter: bool = True
    max_input_bytes: int = 1_048_576
    double_tap_window_ms: int | str = DEFAULT_WINDOW_MS
    history_store_raw: bool = False
    em_dash: str = "--"
    url_strip_scheme: bool = False
    url_decode_pairs: bool = False


#: What a profile may set.
PROFILE_FIELDS = ("normalize_unicode", "whitespace_cleanup", "agent_strip", "structural_detection", "table_cell_picker", "url_cleaning", "auto_wrapper", "user_rules", "sensitive_filter")
FEATURES = (*PROFILE_FIELDS, "history_store_raw", "url_strip_scheme", "url_decode_pairs")


@dataclass(frozen=True)
class Config:
    settings: Settings = Settings()
    rules: tuple[Rule, ...] = ()
    global_deny: tuple[str, ...] = TRACKING
    domains: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    excluded_apps: tuple[str, ...] = EXCLUDED_APPS
    window_ms: int | None = DEFAULT_WINDOW_MS
    profile: str | None = None

    def enabled(self, feature: str) -> bool:
        """A switch by name; unknown names are off."""
        return bool(getattr(self.settings, feature)) if feature in FEATURES else False


def default_path() -> Path:
    return Path.home() / ".quillsift" / "config.toml"


def load(path: str | os.PathLike | None = None) -> dict:
    """The raw tables of the file; empty if there is none. Only modes 0600 and 0644 are trusted."""
    place = Path(path) if path is not None else default_path()
    if not place.exists():
        return {}
    if (mode := stat.S_IMODE(place.stat().st_mode)) not in (0o600, 0o644):
        raise ConfigIntegrityError(f"{place} has permissions {mode:o}, expected 0600 or 0644")
    try:
        return tomllib.loads(place.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e


def _settings(raw: dict) -> Settings:
    own = {f.name: raw[f.name] for f in dataclasses.fields(Settings) if f.name in raw and f.name != "em_dash"}
    dash = raw.get("em_dash", {})
    return Settings(**own, em_dash=dash.get("replace", "--") if isinstance(dash, dict) else "--")


def _rules(raw: dict) -> tuple[Rule, ...]:
    return tuple(Rule(r["name"], r["pattern"], r["replacement"]) for r in raw.get("rules", []))


# What the messages of the checks below say.
def problems(raw: dict) -> list[str]:
    """What is wrong with a configuration, without resolving it."""
    out = []
    rules = _rules(raw)
    if len(rules) > MOST_RULES:
        out.append(f"Too many user rules: {len(rules)} (max {MOST_RULES})")
    for r in rules:
        try:
            compiled(r)
        except RuleError as e:
            out.append(str(e))
    out += _range_problems(_settings(raw.get("settings", {})))
    out += ["Profile name cannot be empty" for name in raw.get("profiles", {}) if not name]
    out += [f"Bundle ID '{b}' doesn't look like a valid bundle ID (missing '.')" for b in raw.get("exclusions", {}).get("bundle_ids", []) if "." not in b]
    return out


def _range_problems(s: Settings) -> list[str]:
    out = []
    if s.max_input_bytes <= 0:
        out.append("max_input_bytes must be > 0")
    if not 0 <= s.table_cell_picker_min_confidence <= 1:
        out.append("table_cell_picker_min_confidence must be between 0.0 and 1.0")
    if isinstance(s.double_tap_window_ms, int):
        if not 100 <= s.double_tap_window_ms <= 2000:
            out.append("double_tap_window_ms must be between 100 and 2000")
    elif s.double_tap_window_ms != "auto":
        out.append(f'double_tap_window_ms: invalid value "{s.double_tap_window_ms}", expected a number or "auto"')
    return out


def resolve(raw: dict | None = None, profile: str | None = None) -> Config:
    """Defaults, file and profile as one configuration. A profile that isn't there is an error if any profiles are."""
    raw = raw or {}
    settings = _settings(raw.get("settings", {}))
    if profile is not None and "profiles" in raw:
        if profile not in raw["profiles"]:
            raise ConfigError(f"Profile '{profile}' not found in config")
        settings = dataclasses.replace(settings, **{k: v for k, v in raw["profiles"][profile].items() if k in PROFILE_FIELDS})
    rules = _rules(raw)
    if len(rules) > MOST_RULES:
        raise ConfigError(f"Too many user rules: {len(rules)} (max {MOST_RULES})")
    for r in rules:
        compiled(r)
    if found := _range_problems(settings):
        raise ConfigError(found[0])
    urls = raw.get("url_params", {})
    return Config(settings, rules, (*TRACKING, *urls.get("global_deny", [])), urls.get("domains", {}), (*EXCLUDED_APPS, *raw.get("exclusions", {}).get("bundle_ids", [])), None if settings.double_tap_window_ms == "auto" else settings.double_tap_window_ms, profile)


def _shown(value: bool | int | float | str) -> str:
    """The value as TOML."""
    if isinstance(value, bool):
        return str(value).lower()
    if not isinstance(value, str):
        return repr(value)
    escapes = {'"': r"\"", "\\": r"\\"} | {chr(c): f"\\u{c:04x}" for c in [*range(0x20), 0x7F]}
    return '"' + "".join(escapes.get(c, c) for c in value) + '"'


def set_setting(path: str | os.PathLike, key: str, value: bool | int | float | str) -> None:
    """Writes one key of [settings] and leaves the rest as it stands: new file beside it, synced, renamed over it, mode 0600. What
    would not load again is not written (ConfigError)."""
    place = Path(path)
    if not re.fullmatch(r"[A-Za-z0-9_-]+", key):
        raise ConfigError(f"not a key: {key!r}")
    shown = _shown(value)
    lines = place.read_text().splitlines() if place.exists() else []
    head = next((i for i, x in enumerate(lines) if re.fullmatch(r"\s*\[settings\]\s*(#.*)?", x)), None)
    if head is None:
        lines += [*([""] if lines else []), "[settings]", f"{key} = {shown}"]
    else:
        end = next((i for i in range(head + 1, len(lines)) if lines[i].lstrip().startswith("[")), len(lines))
        at = next((i for i in range(head + 1, end) if re.match(rf"\s*{re.escape(key)}\s*=", lines[i])), None)
        if at is None:
            lines.insert(head + 1, f"{key} = {shown}")
        else:
            lines[at] = f"{key} = {shown}"
    text = "\n".join(lines) + "\n"
    try:
        again = tomllib.loads(text)["settings"][key]
    except (tomllib.TOMLDecodeError, KeyError) as e:
        raise ConfigError(f"{place} would not load with {key} = {shown}: {e}") from e
    if again != value:
        raise ConfigError(f"{key} = {shown} would load as {again!r}")
    place.parent.mkdir(parents=True, exist_ok=True)
    beside = place.with_name(place.name + ".tmp")
    with open(beside, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.chmod(beside, 0o600)
    os.replace(beside, place)


def _typed(key: str, kind: type) -> None:
    known = {f.name: f.default for f in dataclasses.fields(Settings)}
    if key not in known or type(known[key]) is not kind and not (kind is str and key == "double_tap_window_ms"):
        raise ConfigError(f"no {kind.__name__} setting: {key}")


def set_bool(path: str | os.PathLike, key: str, value: bool) -> None:
    """A switch of [settings] by name."""
    _typed(key, bool)
    set_setting(path, key, bool(value))


def set_string(path: str | os.PathLike, key: str, value: str) -> None:
    """A text of [settings] by name."""
    _typed(key, str)
    if found := _range_problems(dataclasses.replace(Settings(), **{key: value})):
        raise ConfigError(found[0])
    set_setting(path, key, value)
