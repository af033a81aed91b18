"""Configuration: a table of keys, their types, defaults and rules, read from YAML with dotted overrides."""

from __future__ import annotations

import math
import os
import types
import warnings
from dataclasses import field, make_dataclass
from typing import Any

from .operators.hooks import hook_specs
from .sources.storage import S3Access

_INT, _NUMBER, _FLAG, _TEXT = (int,), (int, float), (bool,), (str,)
_NONE = type(None)
_positive = (lambda v: v is None or v > 0, "must be positive")
_not_negative = (lambda v: v is None or v >= 0, "can't be negative")
_fraction = (lambda v: 0 <= v < 1, "must be at least 0 and below 1")


def _one_of(*names: str):
    return (lambda v: v in names, f"must be one of {names}")


#: Sections and keys of the file format, with their defaults (fixed values): key -> (types, default, rule).
KEYS: dict[str, dict[str, tuple]] = {
    "log": {
        "W": (_INT, 16, _positive), "passes": (_INT, 2, _positive), "wait_poll_s": (_NUMBER, 1.0, _positive), "retention_segments": (_INT, 4, _not_negative),
        "shuffle_buffer_segments": (_INT, 1, _positive), "gc": (_FLAG, False, None), "gc_blocks": (_FLAG, True, None),
    },
    "checkpoint": {
        "policy": (_TEXT, "any", _one_of("any", "every_k", "segment_end", "pass_end", "time", "never")), "every_k": ((*_INT, _NONE), 4, _positive),
        "time_budget_s": ((*_NUMBER, _NONE), None, _positive), "time_poll_every": (_INT, 1, _positive), "num_to_keep": ((*_INT, _NONE), 3, _positive), "report_every_step": (_FLAG, False, None),
    },
    "loader": {"prefetch": (_INT, 2, _positive), "threads": (_INT, 2, _positive)},
    "scaling": {"num_workers": ((int, list, tuple), 2, None)},
    "parallel": {
        "kind": (_TEXT, "ddp", _one_of("ddp", "none", "local_sgd", "diloco")), "outer_lr": (_NUMBER, 0.7, _positive), "outer_momentum": (_NUMBER, 0.9, _fraction), "outer_nesterov": (_FLAG, True, None),
    },
    "failure": {"max_failures": (_INT, 3, _not_negative)},
    "storage": {
        "kind": (_TEXT, "local", _one_of("local", "s3")), "endpoint": ((*_TEXT, _NONE), None, None), "region": ((*_TEXT, _NONE), None, None),
        "access_key_env": (_TEXT, "S3_ACCESS_KEY", None), "secret_key_env": (_TEXT, "S3_SECRET_KEY", None), "anonymous": (_FLAG, False, None),
    },
}
#: Keys outside a section.
PLAIN: dict[str, tuple] = {
    "run_name": (_TEXT, "run", (lambda v: bool(v) and "/" not in v, "must be a single name")), "storage_path": (_TEXT, "runs", None), "store_root": (_TEXT, "blocks", None),
    "seed": (_INT, 1234, None), "hooks": ((dict,), {}, None), "train": ((dict,), {}, None),
}


def _section(name: str, keys: dict[str, tuple], methods: dict[str, Any]):
    return make_dataclass(name, [(k, object, field(default=d) if not isinstance(d, dict) else field(default_factory=dict)) for k, (_, d, _) in keys.items()], namespace=methods)


def _bounds(self) -> tuple[int, int]:
    n = self.num_workers
    return (n, n) if isinstance(n, int) else (n[0], n[1])


def _access(self) -> S3Access | None:
    """How the section's stores are reached; None leaves that to the environment."""
    named = self.kind == "s3" and (self.endpoint or self.region or self.anonymous)
    return S3Access(self.endpoint, self.region, self.access_key_env, self.secret_key_env, self.anonymous) if named else None


_METHODS = {"scaling": {"bounds": _bounds}, "storage": {"access": _access}}
SECTIONS = {name: _section(f"{name.title()}Config", keys, _METHODS.get(name, {})) for name, keys in KEYS.items()}


def _checked(where: str, keys: dict[str, tuple], given: dict[str, Any]) -> dict[str, Any]:
    """Given values over the defaults, of the right types and by their rules."""
    if unknown := sorted(set(given) - set(keys)):
        raise ValueError(f"unknown keys {unknown} in {where or 'the configuration'}")
    out = {}
    for key, (kinds, default, rule) in keys.items():
        value = given.get(key, dict(default) if isinstance(default, dict) else default)
        value = {} if value is None and kinds == (dict,) else value
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise ValueError(f"{where}{key} can't be {value!r}")
        if rule and not rule[0](value):
            raise ValueError(f"{where}{key} {rule[1]}, not {value!r}")
        out[key] = value
    return out


class Config(types.SimpleNamespace):
    @staticmethod
    def of(values: dict[str, Any]) -> "Config":
        for name in KEYS:
            if not isinstance(values.get(name) or {}, dict):
                raise ValueError(f"{name} is a section")
        plain = _checked("", PLAIN, {k: v for k, v in values.items() if k not in KEYS})
        made = Config(**plain, **{name: SECTIONS[name](**_checked(f"{name}.", keys, values.get(name) or {})) for name, keys in KEYS.items()})
        for name in ("storage_path", "store_root"):
            path = getattr(made, name)
            if "://" not in path:
                setattr(made, name, f"s3://{path.strip('/')}" if made.storage.kind == "s3" else os.path.abspath(os.path.expanduser(path)))
        made.validate()
        return made

    def validate(self) -> None:
        """Rules between keys."""
        n, log, ck = self.scaling.num_workers, self.log, self.checkpoint
        pair = isinstance(n, int) or (len(n) == 2 and all(isinstance(k, int) for k in n))
        if not pair or not 0 < self.scaling.bounds()[0] <= self.scaling.bounds()[1]:
            raise ValueError(f"num_workers is a positive number or a pair of bounds, not {n!r}")
        low, high = self.scaling.bounds()
        if log.W % math.lcm(*range(low, high + 1)):
            raise ValueError(f"W={log.W} can't be dealt to every size from {low} to {high}")
        if log.gc and log.retention_segments < 1:
            raise ValueError("gc needs retention_segments of at least 1")
        if (ck.policy == "every_k" and ck.every_k is None) or (ck.policy == "time" and ck.time_budget_s is None):
            raise ValueError(f"policy {ck.policy!r} needs its value")
        hook_specs(self.hooks)
        between = ck.policy in ("every_k", "time") or (ck.policy == "any" and (ck.every_k or ck.time_budget_s))
        if self.parallel.kind in ("local_sgd", "diloco") and between:
            warnings.warn("replicas that agree at segment ends drift between checkpoints within a segment", stacklevel=2)


def with_overrides(values: dict[str, Any], overrides: list[str]) -> dict[str, Any]:
    """values with ``a.b=value`` pairs put in, the values typed as YAML; values itself stays as it is."""
    import yaml

    out = dict(values)
    for item in overrides:
        path, equals, text = item.partition("=")
        if not equals or not all(path.split(".")):
            raise ValueError(f"override {item!r} isn't of the form a.b=value")
        first, _, rest = path.partition(".")
        if rest and not isinstance(out.get(first) or {}, dict):
            raise ValueError(f"{first} in {item!r} is no section")
        out[first] = with_overrides(out.get(first) or {}, [f"{rest}={text}"]) if rest else yaml.safe_load(text)
    return out


def load(path: str, overrides: list[str] | None = None) -> Config:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Config.of(with_overrides(yaml.safe_load(f) or {}, overrides or []))
