"""Signed rule packs on disk: installing one keeps the last for a rollback; both are checked before and after."""

from __future__ import annotations

import json

from palisade.functions import ed25519
from palisade.functions.control import PACK_BYTES, canonical, parse_pack
from palisade.functions.registry import Rule
from palisade.functions.safefile import read_regular, write_private


def install(source: str, target: str, keys: dict[str, bytes]) -> list[Rule]:
    """Puts a pack in place; the one that is there goes to ``target.rollback`` if it still verifies."""
    raw = read_regular(source, PACK_BYTES, "pack")
    rules = parse_pack(raw, keys)
    try:
        before = read_regular(target, PACK_BYTES, "pack")
    except ValueError:
        before = None
    if before is not None:
        parse_pack(before, keys)
        write_private(f"{target}.rollback", before)
    write_private(target, raw)
    return rules


def rollback(target: str, keys: dict[str, bytes]) -> list[Rule]:
    raw = read_regular(f"{target}.rollback", PACK_BYTES, "pack")
    rules = parse_pack(raw, keys)
    write_private(target, raw)
    return rules


def qualify(rules: list[Rule], samples: dict[str, tuple[list[str], list[str]]]) -> dict[str, list[str]]:
    """Of each rule what its samples (rule id: texts that match, texts that must not) show to be wrong."""
    import re

    wrong: dict[str, list[str]] = {}
    for r in rules:
        hit, miss = samples.get(r.rule_id, ([], []))
        pattern = re.compile(r.regex, re.IGNORECASE if r.ignore_case else 0)
        said = ([] if hit else ["no sample that matches"]) + ([] if miss else ["no sample that must not match"])
        said += [f"missed sample {i}" for i, x in enumerate(hit) if not pattern.search(x)] + [f"matched sample {i}" for i, x in enumerate(miss) if pattern.search(x)]
        if said:
            wrong[r.rule_id] = said
    return wrong


def sign(document: dict, key_id: str, private: bytes) -> dict:
    """A document with its signer and an Ed25519 signature of its canonical JSON."""
    out = document | {"key_id": key_id}
    return out | {"signature": ed25519.sign(private, canonical(out)).hex()}


def dumps(document: dict) -> bytes:
    return json.dumps(document, sort_keys=True).encode()
