"""Command line: clean a text from standard input, preview the changes, check the configuration, read the history."""

from __future__ import annotations

import argparse
import json
import os
import platform
import shutil
import sys
from pathlib import Path

from .operators.cleaner import clean_text
from .operators.diff import line_diff
from .operators.structure import pretty_json
from .sources import config as configuration

#: Options that select stages.
SELECT = {"normalize": ("normalize_unicode",), "unwrap": ("whitespace_cleanup",), "structural": ("structural_detection",), "urls": ("url_cleaning",)}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillsift", description=__doc__)
    p.add_argument("--config")
    p.add_argument("--profile")
    p.add_argument("--preview", action="store_true", help="show a line diff instead")
    p.add_argument("--flatten-json", action="store_true", help="print a JSON text on one line")
    for name in SELECT:
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("command", nargs="?", choices=("clean", "validate", "doctor", "history"), default="clean")
    p.add_argument("--folder", help="folder of the history")
    p.add_argument("--search")
    p.add_argument("--type")
    p.add_argument("--limit", type=int, default=10)
    o = p.parse_args(args)
    try:
        if o.command == "doctor":  # reports what is wrong instead of stopping at it
            return _doctor(o)
        raw = configuration.load(o.config)
        if o.command == "validate":
            found = configuration.problems(raw)
            print("\n".join(found) or "ok")
            return int(bool(found))
        config = configuration.resolve(raw, o.profile)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if o.command == "history":
        return _history(o)
    try:
        text = sys.stdin.buffer.read().decode("utf-8")
    except UnicodeDecodeError:
        print("input is not UTF-8", file=sys.stderr)
        return 1
    if o.flatten_json:
        out = pretty_json(text.strip(), flat=True)
        sys.stdout.write(text if out is None else out)
        return 0
    chosen = [s for name, stages in SELECT.items() if getattr(o, name) for s in stages] or None
    out, ctx = clean_text(text, config, chosen)
    if ctx.skipped_oversize or ctx.skipped_sensitive:
        print("skipped: " + ("too large" if ctx.skipped_oversize else "looks like a secret"), file=sys.stderr)
    if o.preview:
        shown = "".join(f"{sign}{line}\n" for sign, line in line_diff(text, out))
        print(shown, end="") if shown else print("No changes.", file=sys.stderr)
    else:
        sys.stdout.write(out)
    return 0


def diagnosis(config: str | None, profile: str | None, folder: str | None) -> list[tuple[str, bool, str]]:
    """(what, fine, note) of the machine, the configuration file, its switches, the history folder, and a text cleaned on trial."""
    place = Path(config) if config else configuration.default_path()
    out = [("python", sys.version_info >= (3, 10), f"{platform.python_version()} on {platform.system()} {platform.machine()}")]
    java = shutil.which("java") or os.environ.get("JAVA_HOME")
    out.append(("java", bool(java), java or "not found: Spark can't start"))
    out.append(("configuration", True, f"{place} " + ("exists" if place.exists() else "doesn't exist: defaults hold")))
    settings = configuration.Config().settings
    try:
        raw = configuration.load(place)
        faults = configuration.problems(raw)
        out += [("configuration", False, x) for x in faults] or [("configuration", True, "valid")]
        resolved = configuration.resolve(raw, profile) if not faults else configuration.Config()
        settings = resolved.settings
        out += [("feature", True, f"{name} {'on' if resolved.enabled(name) else 'off'}") for name in configuration.FEATURES]
    except ValueError as e:
        out.append(("configuration", False, str(e)))
    if not settings.sensitive_filter:
        out.append(("secret filter", False, "off: texts that look like secrets are cleaned and kept"))
    if folder and "://" not in folder:
        manifest = Path(folder) / "manifest.json"
        try:
            parts = json.loads(manifest.read_text())["parts"] if manifest.exists() else []
            gone = [p for p in parts if not (Path(folder) / p).is_dir()]
            size = sum(f.stat().st_size for p in parts for f in (Path(folder) / p).glob("*.parquet"))
            out.append(("history", not gone, f"{folder}: {len(parts)} parts, {size} bytes" + (f", missing {gone}" if gone else "")))
        except (ValueError, KeyError, TypeError):
            out.append(("history", False, f"{manifest} can't be read"))
    trial, _ = clean_text("“a” — b")
    out.append(("trial", trial == '"a" -- b', "a text was cleaned" if trial == '"a" -- b' else f"cleaning gave {trial!r}"))
    return out


def _doctor(o: argparse.Namespace) -> int:
    found = diagnosis(o.config, o.profile, o.folder)
    for name, fine, note in found:
        print(f"{name}: {note}" + ("" if fine else "  <- needs a look"))
    return int(not all(fine for _, fine, _ in found))


def _history(o: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .sources import history as H

    rows = H.History(SparkSession.builder.getOrCreate(), o.folder).rows()
    found = H.search(rows, o.search, o.limit) if o.search else H.by_type(rows, o.type, o.limit) if o.type else H.recent(rows, o.limit)
    for r in found.collect():
        print(f"{r['id']}\t{r['content_type'] or '-'}\t{r['preview']}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
