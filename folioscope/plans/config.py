"""Settings from text: typed, with defaults, and errors for what can't be read."""

from __future__ import annotations

from collections.abc import Mapping

# Words that switch a setting on or off, and words for no limit.
TRUE, FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}
UNLIMITED = {"none", "all", "full", "unlimited", "no", "0"}


class Settings:
    """Reads a mapping of names to text, such as an environment."""

    def __init__(self, values: Mapping[str, str]):
        self._values = values

    def text(self, name: str, default: str | None = None) -> str:
        """The value without blanks around it; without a default, an absent one is an error."""
        got = self._values.get(name, "").strip()
        if not got and default is None:
            raise ValueError(f"{name} isn't set")
        return got or (default or "")

    def flag(self, name: str, default: bool) -> bool:
        got = self.text(name, "").lower()
        if not got:
            return default
        if got not in TRUE | FALSE:
            raise ValueError(f"{name}={got!r} is neither true nor false")
        return got in TRUE

    def number(self, name: str, default: int, least: int = 1) -> int:
        got = self.text(name, "")
        if not got:
            return default
        if not got.lstrip("-").isdigit() or int(got) < least:
            raise ValueError(f"{name}={got!r} isn't a whole number of {least} or more")
        return int(got)

    def limit(self, name: str, default: int | None) -> int | None:
        """A whole number of 1 or more, or None for no limit."""
        got = self.text(name, "").lower()
        if got in UNLIMITED:
            return None
        return self.number(name, default or 0) if got else default


def last_page(start: int, end: int | None, count: int | None) -> int | None:
    """An explicit end wins; else ``count`` pages from ``start``; None: no end."""
    return end if end is not None else None if count is None else start + count - 1
