"""Parameters of the checks with their defaults (CFG-01, CFG-02). Frozen: a query is built with one set, and another set is another object."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Options:
    spelling_threshold: int = 3
    listed_lines: int = 5
    long_line: int = 75
    short_line: int = 55
    left_margin: int = 0
    right_margin: int = 72
    block_step: int = 2
    poetry_indent: int = 4
    phrase_level: str = "normal"
    suspects_only: bool = False
    nested_brackets: bool = False
    within_paragraph: bool = False
    language: str = "en"

    def but(self, **changes: object) -> Options:
        return replace(self, **changes)

    def saved(self) -> dict[str, object]:
        """What differs from the defaults, as it is stored."""
        return {k: v for k, v in asdict(self).items() if v != getattr(Options, k)}

    @classmethod
    def loaded(cls, stored: dict[str, object]) -> Options:
        """Stored values over the defaults; names that are unknown are left out."""
        return cls(**{k: v for k, v in stored.items() if k in cls.__dataclass_fields__})
