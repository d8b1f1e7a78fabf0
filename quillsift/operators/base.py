"""What stages share: the side-channel of a row, and the order of the stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

#: Content types, as they are stored.
URL, CODE, PROSE, TABLE, JSON, MIXED, SHELL, LIST = "Url", "Code", "Prose", "Table", "Json", "Mixed", "ShellBlock", "List"


@dataclass
class Context:
    content_type: str | None = None
    rules_fired: list[tuple[str, str, int]] = field(default_factory=list)
    profile: str | None = None
    input_size_bytes: int = 0
    skipped_sensitive: bool = False
    skipped_oversize: bool = False

    def fired(self, stage: str, description: str, changed: int) -> None:
        self.rules_fired.append((stage, description, changed))


#: A stage: a pure function of the text, which may note what it did in the context.
Stage = Callable[[str, Context], str]

CONTEXT_DDL = "struct<content_type:string,rules_fired:array<struct<stage:string,description:string,chars_changed:bigint>>,profile:string,input_size_bytes:bigint,skipped_sensitive:boolean,skipped_oversize:boolean>"

# What a summary calls the stages.
LABELS = {
    "normalize_unicode": "Normalized text formatting",
    "whitespace_cleanup": "Cleaned whitespace",
    "agent_strip": "Removed hidden characters",
    "structural_detection": "Structured content",
    "url_cleaning": "Removed tracking parameters",
    "auto_wrapper": "Wrapped code-like tokens",
    "user_rules": "Applied custom rules",
}


def summary(stages: list[str]) -> str:
    """One line about the stages that fired, two labels at most."""
    labels = [LABELS.get(s, "Applied cleanup") for s in dict.fromkeys(stages)]
    if not labels:
        return "No changes needed"
    return " · ".join(labels[:2]) + (f" +{len(labels) - 2} more" if len(labels) > 2 else "")
