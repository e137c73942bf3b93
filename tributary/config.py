"""Hierarchical dotted configuration with lists and ``${key}`` interpolation."""

from __future__ import annotations

import logging
import os
import re
from collections.abc import Iterable, Mapping

log = logging.getLogger(__name__)
_SECRET = re.compile(r"password|secret|token|auth\.user", re.I)


class Config(Mapping[str, str]):
    """An immutable mapping of dotted keys. Values are text; lists are comma-separated; ``${a.b}`` is looked up."""

    def __init__(self, values: Mapping[str, object] | None = None):
        self._raw = {str(k): v if isinstance(v, str) else ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in (values or {}).items()}

    @classmethod
    def from_lines(cls, lines: Iterable[str]) -> Config:
        """``key=value`` lines: split at the first ``=``, both sides trimmed, ``#`` and ``!`` begin comments."""
        out = {}
        for line in lines:
            text = line.strip()
            if text and text[0] not in "#!":
                key, eq, value = text.partition("=")
                if not eq:
                    raise ValueError(f"no '=' in {text!r}")
                out[key.strip()] = value.strip()
        return cls(out)

    @classmethod
    def from_file(cls, *paths: str) -> Config:
        """The first path; further ones are ignored with a warning."""
        if len(paths) > 1:
            log.warning("only the first of %d configuration files is used", len(paths))
        if not paths or not os.path.isfile(paths[0]):
            raise ValueError(f"not a readable file: {paths[:1]}")
        with open(paths[0], encoding="utf-8") as f:
            return cls.from_lines(f)

    def __getitem__(self, key: str) -> str:
        return self._interpolated(self._raw[key], (key,))

    def _interpolated(self, value: str, seen: tuple[str, ...]) -> str:
        def put(m: re.Match) -> str:
            if m[1] in seen:
                raise ValueError(f"interpolation of {m[1]} never ends")
            return self._interpolated(self._raw[m[1]], (*seen, m[1])) if m[1] in self._raw else m[0]

        return re.sub(r"\$\{([^}]*)\}", put, value)

    def __iter__(self):
        return iter(self._raw)

    def __len__(self) -> int:
        return len(self._raw)

    def require(self, key: str) -> str:
        if not self.get(key, "").strip():
            raise ValueError(f"configuration property '{key}' is required")
        return self[key]

    def list(self, key: str, default: list[str] | None = None) -> list[str]:
        if key not in self:
            if default is None:
                raise ValueError(f"configuration property '{key}' is required")
            return default
        return [x.strip() for x in self[key].split(",") if x.strip()]

    def boolean(self, key: str, default: bool = False) -> bool:
        text = self.get(key, str(default)).strip().lower()
        if text not in ("true", "false"):
            raise ValueError(f"'{key}' must be true or false, not {text!r}")
        return text == "true"

    def number(self, key: str, default: int | None = None) -> int | None:
        try:
            return int(self[key]) if key in self else default
        except ValueError:
            raise ValueError(f"'{key}' must be a whole number, not {self[key]!r}") from None

    def subset(self, prefix: str) -> Config:
        """Keys below ``prefix.``, without it. Interpolation is done before, as it may look outside."""
        p = prefix.rstrip(".") + "."
        return Config({k[len(p) :]: self[k] for k in self if k.startswith(p) and len(k) > len(p)})

    def with_retained(self, whole: Config, mapping: Mapping[str, str]) -> Config:
        """Adds ``whole[a]`` under ``b`` for each a -> b; a missing source or a taken target is an error."""
        out = {k: self[k] for k in self}
        for a, b in mapping.items():
            keys = [k for k in whole if k == a or k.startswith(a + ".")]
            if not keys:
                raise ValueError(f"global configuration has no '{a}'")
            for k in keys:
                to = b + k[len(a) :]
                if to in out:
                    raise ValueError(f"'{to}' would be overwritten by the global '{k}'")
                out[to] = whole[k]
        return Config(out)

    def redacted(self) -> dict[str, str]:
        return {k: "*****" if _SECRET.search(k) else self[k] for k in self}


def resolve_secrets(conf: Config, providers: Mapping[str, object]) -> Config:
    """Values ``secret:<provider>:<name>`` replaced through ``provider.get(name)``."""
    out = {}
    for k in conf:
        m = re.fullmatch(r"secret:(\w+):(.+)", conf[k])
        if m and m[1] not in providers:
            raise ValueError(f"no secrets provider '{m[1]}' for '{k}'")
        out[k] = providers[m[1]].get(m[2]) if m else conf[k]
    return Config(out)


class EnvSecrets:
    def get(self, name: str) -> str:
        return os.environ[name]


class FileSecrets:
    """Secrets in files of a folder, surrounding blanks trimmed."""

    def __init__(self, folder: str):
        self.folder = folder

    def get(self, name: str) -> str:
        with open(os.path.join(self.folder, os.path.basename(name)), encoding="utf-8") as f:
            return f.read().strip()
