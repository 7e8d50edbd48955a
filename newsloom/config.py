"""Settings from INI text: ``[section]`` or ``[section argument]``, comments, quotes, and ``section.key=value`` overrides."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class Config:
    values: dict[tuple[str, str], str] = field(default_factory=dict)
    #: (section, argument) of each section, in order.
    sections: list[tuple[str, str]] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Config:
        """A line that is neither section, setting, comment nor blank is an error that names it."""
        c, at = cls(), ""
        for n, line in enumerate(text.splitlines(), 1):
            line = re.sub(r"(?:^|\s)[#;].*$", "", line).strip() if '"' not in line else line.strip()
            if not line:
                continue
            if m := re.fullmatch(r"\[\s*([\w-]+)(?:\s+([^\]]+?))?\s*\]", line):
                at = m[1] + (f" {m[2]}" if m[2] else "")
                c.sections.append((m[1], m[2] or ""))
            elif m := re.fullmatch(r'([\w.-]+)\s*=\s*(?:"([^"]*)".*|(.*))', line):
                c.values[at, m[1]] = m[2] if m[2] is not None else m[3].strip()
            else:
                raise ValueError(f"line {n} not understood: {line}")
        return c

    def override(self, setting: str) -> None:
        key, _, value = setting.partition("=")
        section, _, name = key.strip().rpartition(".")
        self.values[section, name] = value.strip()

    def get(self, section: str, name: str, default=None):
        """The value in the type of ``default``."""
        v = self.values.get((section, name))
        if v is None:
            return default
        if isinstance(default, bool):
            return v.lower() in ("1", "true", "yes", "on")
        return type(default)(v) if default is not None else v
