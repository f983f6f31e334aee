"""Control documents of a scan: configuration, rule packs, keyrings, hooks. Each is checked against its
exact shape before any of it is used; what does not fit raises ValueError."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace

from . import ed25519
from .registry import SEVERITIES, Rule

# Bounds.
CONFIG_BYTES, CUSTOM, OVERRIDES, PATHS, TEXT = 256 * 1024, 64, 256, 256, 512
PACK_BYTES, PACK_RULES, ALL_BYTES, ALL_RULES, PACKS = 2 << 20, 1000, 8 << 20, 4000, 64
HOOK_BYTES = 4 << 20
PROFILES = ("balanced", "strict", "secrets-only")


def strict_json(raw: bytes, most: int) -> object:
    """JSON of bounded size in UTF-8 without repeated keys."""

    def once(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) != len(pairs):
            raise ValueError("repeated key")
        return out

    if len(raw) > most:
        raise ValueError("document too large")
    try:
        return json.loads(raw.decode("utf-8"), object_pairs_hook=once)
    except (UnicodeDecodeError, json.JSONDecodeError, RecursionError) as e:
        raise ValueError("not strict JSON") from e


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-8")


def _must(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _shape(x: object, need: set[str], may: set[str] = frozenset()) -> dict:
    _must(isinstance(x, dict) and need <= set(x) <= need | set(may), "unexpected fields")
    return x


def _text(x: object, most: int = TEXT) -> str:
    _must(isinstance(x, str) and 0 < len(x) <= most, "bad text")
    return x


def _severity(x: object) -> str:
    _must(x in SEVERITIES, "unknown severity")
    return x


@dataclass(frozen=True)
class Config:
    profile: str = "balanced"
    threshold: str | None = None
    config_check: bool | None = None
    fail_on: str = "medium"
    warn_on: str = "low"
    overrides: dict[str, str] = field(default_factory=dict)
    custom: tuple[Rule, ...] = ()
    high: tuple[str, ...] = ()
    medium: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()


def parse_config(raw: bytes) -> Config:
    d = _shape(strict_json(raw, CONFIG_BYTES), set(), {"profile", "severity_threshold", "config_check", "thresholds", "pattern_overrides", "custom_patterns", "file_patterns"})
    limits = _shape(d.get("thresholds", {}), set(), {"fail_on_severity", "warn_on_severity"})
    files = _shape(d.get("file_patterns", {}), set(), {"high_severity_paths", "medium_severity_paths", "ignore_paths"})
    over, custom = d.get("pattern_overrides", {}), d.get("custom_patterns", [])
    _must(isinstance(over, dict) and len(over) <= OVERRIDES and isinstance(custom, list) and len(custom) <= CUSTOM, "too many patterns")
    _must(d.get("profile", "balanced") in PROFILES, "unknown profile")
    _must(d.get("config_check") in (None, True, False), "config_check is not a boolean")
    paths = {k: tuple(_text(p) for p in v) for k, v in files.items() if isinstance(v, list) and len(v) <= PATHS}
    _must(len(paths) == len(files), "too many paths")
    rules = []
    for x in custom:
        x = _shape(x, {"name", "regex"}, {"severity", "description"})
        name, pattern = _text(x["name"], 128), _text(x["regex"])
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError("bad pattern") from e
        digest = hashlib.sha256(f"{name}\0{pattern}".encode()).hexdigest()[:12].upper()
        rules.append(Rule(f"CRT-CUSTOM-{digest}", name, _severity(x.get("severity", "medium")), pattern, confidence="medium"))
    severities = {_text(k, 128): _severity(_shape(v, set(), {"severity"})["severity"]) for k, v in over.items() if v}
    threshold = d.get("severity_threshold")
    return Config(
        d.get("profile", "balanced"), None if threshold is None else _severity(threshold), d.get("config_check"), _severity(limits.get("fail_on_severity", "medium")), _severity(limits.get("warn_on_severity", "low")),
        severities, tuple(rules), paths.get("high_severity_paths", ()), paths.get("medium_severity_paths", ()), paths.get("ignore_paths", ()),
    )


def configured(rules: list[Rule], config: Config) -> list[Rule]:
    """Rules with the configuration's severities, and its own rules after them."""
    return [replace(r, severity=config.overrides.get(r.name, r.severity)) for r in rules] + list(config.custom)


def linear_pattern(pattern: str) -> str:
    """A pattern of literals, escapes, classes and exact counts only, as packs may hold."""
    _text(pattern)
    outside = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    _must(not re.search(r"[().|*+?]", outside), "pattern beyond the linear grammar")
    counts = re.findall(r"\{([^{}]*)\}", outside)
    _must(outside.count("{") == outside.count("}") == len(counts) and all(c.isdigit() and 1 <= int(c) <= 256 for c in counts), "bad count in a pattern")
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError("bad pattern") from e
    return pattern


def parse_keyring(raw: bytes) -> dict[str, bytes]:
    keys = _shape(strict_json(raw, PACK_BYTES), {"schema", "version", "keys"})["keys"]
    _must(isinstance(keys, dict) and 1 <= len(keys) <= 64, "bad keyring")
    for k, v in keys.items():
        _must(bool(re.fullmatch("[a-z][a-z0-9._-]{2,63}", k)) and isinstance(v, str) and bool(re.fullmatch("[0-9a-f]{64}", v)), "bad key")
    return {k: bytes.fromhex(v) for k, v in keys.items()}


def signed(envelope: dict, keys: dict[str, bytes]) -> bool:
    """Whether an envelope's signature is a trusted key's of the canonical JSON of all else in it."""
    key, signature = keys.get(envelope.get("key_id")), envelope.get("signature")
    if key is None or not isinstance(signature, str) or not re.fullmatch("[0-9a-f]{128}", signature):
        return False
    return ed25519.verify(key, canonical({k: v for k, v in envelope.items() if k != "signature"}), bytes.fromhex(signature))


def parse_pack(raw: bytes, keys: dict[str, bytes]) -> list[Rule]:
    """The rules of a signed pack."""
    d = _shape(strict_json(raw, PACK_BYTES), {"schema", "version", "key_id", "pack", "signature"})
    _must(d["version"] == 1 and signed(d, keys), "pack is not signed by a trusted key")
    pack = _shape(d["pack"], {"pack_version", "rules"})
    _must(isinstance(pack["pack_version"], str) and bool(re.fullmatch(r"[0-9]{4}\.[0-9]{2}\.[0-9]+", pack["pack_version"])), "bad pack version")
    _must(isinstance(pack["rules"], list) and 1 <= len(pack["rules"]) <= PACK_RULES, "bad number of rules")
    out, seen = [], set()
    for x in pack["rules"]:
        x = _shape(x, {"name", "regex", "severity", "description", "rule_id", "category", "confidence", "remediation", "kind", "file_globs"})
        _must(isinstance(x["rule_id"], str) and bool(re.fullmatch("CRT-(?:SEC|POL)-[0-9]{3}", x["rule_id"])) and x["rule_id"] not in seen, "bad or repeated rule id")
        _must(bool(re.fullmatch("[A-Z][A-Z0-9_]{2,63}", _text(x["name"]))) and x["confidence"] in SEVERITIES[:3] and x["kind"] in ("secret", "policy"), "bad rule")
        globs = x["file_globs"]
        _must(isinstance(globs, list) and len(globs) <= 32 and all(isinstance(g, str) and 0 < len(g) <= 128 and ".." not in g and "\\" not in g for g in globs), "bad globs")
        seen.add(x["rule_id"])
        out.append(Rule(x["rule_id"], x["name"], _severity(x["severity"]), linear_pattern(x["regex"]), globs=tuple(globs), confidence=x["confidence"]))
    return out


def parse_packs(raws: list[bytes], keys: dict[str, bytes], known: list[Rule] = ()) -> list[Rule]:
    """Rules of several packs; ids must differ from each other's and from known rules'."""
    _must(1 <= len(raws) <= PACKS and sum(map(len, raws)) <= ALL_BYTES, "too many packs")
    out = [r for raw in raws for r in parse_pack(raw, keys)]
    ids = [r.rule_id for r in (*known, *out)]
    _must(len(out) <= ALL_RULES and len(set(ids)) == len(ids), "too many or repeated rules")
    return out


def parse_hook(raw: bytes, event_field: str = "event", events: frozenset[str] = frozenset({"post-change"})) -> str:
    """The diff of an agent hook's envelope: schema, version 1, event, diff."""
    d = _shape(strict_json(raw, HOOK_BYTES), {"schema", "version", event_field, "diff"})
    _must(type(d["version"]) is int and d["version"] == 1 and d[event_field] in events, "unknown hook")
    _must(isinstance(d["diff"], str) and d["diff"] != "" and "\0" not in d["diff"], "bad diff")
    return d["diff"]
