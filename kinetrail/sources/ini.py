"""Run configurations: sections of `key = value` lines, read, built and written."""

from __future__ import annotations

from pathlib import Path

LEADING = ("general", "model", "mapping", "mapping.file", "topology", "polymer_classifier", "groups", "topo_groups")


class ConfigError(ValueError):
    pass


class Config:
    """Comments are whole lines beginning with # or ;. Quotes around a value are dropped. The last of repeated keys wins."""

    def __init__(self, sections: dict[str, dict[str, str]] | None = None):
        self.sections: dict[str, dict[str, str]] = {k: dict(v) for k, v in (sections or {}).items()}

    @classmethod
    def parse(cls, text: str) -> Config:
        out, section = cls(), None
        for n, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if not line or line[0] in "#;":
                continue
            if line[0] == "[":
                if line[-1] != "]" or not line[1:-1].strip():
                    raise ConfigError(f"line {n}: not a section")
                section = line[1:-1].strip()
                out.sections.setdefault(section, {})
                continue
            key, eq, value = line.partition("=")
            if not eq or not key.strip() or section is None:
                raise ConfigError(f"line {n}: not a setting of a section")
            value = value.strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            out.sections[section][key.strip()] = value
        return out

    @classmethod
    def read(cls, path: str) -> Config:
        return cls.parse(Path(path).read_text(encoding="utf-8"))

    def copy(self) -> Config:
        return Config(self.sections)

    def has(self, section: str, key: str | None = None) -> bool:
        return section in self.sections and (key is None or key in self.sections[section])

    def section(self, name: str) -> dict[str, str]:
        return dict(self.sections.get(name, {}))

    def get(self, section: str, key: str, default: str | None = None) -> str:
        value = self.sections.get(section, {}).get(key, default)
        if value is None:
            raise ConfigError(f"[{section}] {key} is missing")
        return value

    def _as(self, kind, section: str, key: str, default):
        if not self.has(section, key):
            return default
        text = self.get(section, key)
        try:
            return kind(text)
        except ValueError:
            raise ConfigError(f"[{section}] {key}: not {kind.__name__}: {text!r}") from None

    def get_int(self, section: str, key: str, default: int | None = None) -> int | None:
        return self._as(int, section, key, default)

    def get_float(self, section: str, key: str, default: float | None = None) -> float | None:
        return self._as(float, section, key, default)

    def get_bool(self, section: str, key: str, default: bool = False) -> bool:
        if not self.has(section, key):
            return default
        text = self.get(section, key).lower()
        if text in ("true", "yes", "on", "1"):
            return True
        if text in ("false", "no", "off", "0"):
            return False
        raise ConfigError(f"[{section}] {key}: not a truth value: {text!r}")

    def get_list(self, section: str, key: str) -> list[str]:
        return [x.strip() for x in self.get(section, key, "").split(",") if x.strip()]

    # Building ------------------------------------------------------------------------------------------------------

    def set(self, section: str, key: str, value: object) -> Config:
        if isinstance(value, bool):
            value = "true" if value else "false"
        elif isinstance(value, (list, tuple)):
            value = ",".join(map(str, value))
        self.sections.setdefault(section, {})[key] = str(value)
        return self

    def update(self, section: str, **values: object) -> Config:
        for k, v in values.items():
            self.set(section, k, v)
        return self

    def define(self, **sections: dict[str, object]) -> Config:
        """Settings by section; `__` in a name stands for its dot, as in measure__msd."""
        for name, values in sections.items():
            self.update(name.replace("__", "."), **values)
        return self

    def to_ini(self) -> str:
        order = [s for s in LEADING if s in self.sections] + sorted(s for s in self.sections if s not in LEADING)
        return "\n".join(f"[{s}]\n" + "".join(f"{k} = {v}\n" for k, v in self.sections[s].items()) for s in order)

    def write(self, path: str) -> str:
        Path(path).write_text(self.to_ini(), encoding="utf-8")
        return path
