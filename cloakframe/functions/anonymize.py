"""Anonymization operators as column expressions, and policies that choose among them by entity type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakframe.functions import surrogates as S


OPERATORS = ("redact", "replace", "mask", "hash", "encrypt", "keep", "custom", "hips", "pseudonymize")


class InvalidOperatorParams(ValueError):
    """An operator was given parameters that it can't use."""


@dataclass(frozen=True)
class Policy:
    operator: str
    params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise InvalidOperatorParams(f"unknown operator {self.operator!r}; one of {', '.join(OPERATORS)}")


HIPS = Policy("hips")
REPLACE = Policy("replace")


def redact(original: Column) -> Column:
    return F.lit("")


def replace(entity_type: Column, new_value: str | None = None) -> Column:
    plain = F.when(entity_type == "USER_ADDED", F.lit("[REDACTED]")).otherwise(F.concat(F.lit("<"), entity_type, F.lit(">")))
    return plain if new_value is None else F.lit(new_value)


def mask(original: Column, masking_char: str = "*", chars_to_mask: int = 1 << 20, from_end: bool = False) -> Column:
    n = F.least(F.lit(chars_to_mask), F.length(original))
    kept = F.length(original) - n
    stars = F.repeat(F.lit(masking_char), n)
    return F.concat(F.substring(original, F.lit(1), kept), stars) if from_end else F.concat(stars, F.substring(original, n + 1, kept))


def hash_value(original: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), original), 256)


def _key(key: str | bytes | None) -> Column:
    raw = key.encode() if isinstance(key, str) else key or b""
    if len(raw) not in (16, 24, 32):
        raise InvalidOperatorParams("encrypt needs a key of 16, 24 or 32 bytes")
    return F.lit(bytearray(raw))


def encrypt(original: Column, key: str | bytes | None = None) -> Column:
    return F.base64(F.aes_encrypt(original, _key(key), F.lit("GCM")))


def decrypt(value: Column, key: str | bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), _key(key), F.lit("GCM")).cast("string")


def avoid_pattern(originals: Column) -> Column:
    """What a surrogate must not contain: any of a document's originals, by the leak check's rules."""
    from cloakframe.operators.leak import alternation

    return alternation(originals)


def apply(policy: Policy, entity_type: Column, original: Column, salt: Column, avoid: Column | None = None) -> Column:
    p, name = policy.params, policy.operator
    if name == "redact":
        return redact(original)
    if name == "replace":
        return replace(entity_type, p.get("new_value"))
    if name == "mask":
        return mask(original, p.get("masking_char", "*"), int(p.get("chars_to_mask", 1 << 20)), bool(p.get("from_end", False)))
    if name == "hash":
        return hash_value(original, p.get("salt", ""))
    if name == "encrypt":
        return encrypt(original, p.get("key"))
    if name == "keep":
        return original
    if name == "custom":
        fn: Callable[[Column], Column] | None = p.get("lambda")
        if fn is None:
            raise InvalidOperatorParams("custom needs a function of a column")
        return fn(original)
    if name == "hips":
        own = F.lit(p["salt"]) if "salt" in p else salt
        return S.surrogate(entity_type, original, own, avoid)
    # without a store, the first candidate; cloakframe.operators.mapping resolves collisions
    return S.pseudonym_candidate(entity_type, original, F.lit(0), p.get("language"))


def _rules(policies: dict[str, Policy] | None, default: Policy) -> tuple[dict[str, Policy], Policy]:
    """By type, and for the rest: DEFAULT, or replace where policies lack it, or default without policies."""
    policies = policies or {}
    rest = policies.get("DEFAULT") or (REPLACE if policies else default)
    return {k: v for k, v in policies.items() if k != "DEFAULT"}, rest


def render(entity_type: Column, original: Column, policies: dict[str, Policy] | None, salt: Column, avoid: Column | None = None, default: Policy = HIPS) -> Column:
    own, rest = _rules(policies, default)
    out = None
    for kind, policy in own.items():
        value = apply(policy, entity_type, original, salt, avoid)
        out = F.when(entity_type == kind, value) if out is None else out.when(entity_type == kind, value)
    last = apply(rest, entity_type, original, salt, avoid)
    return last if out is None else out.otherwise(last)


def operator_of(entity_type: Column, policies: dict[str, Policy] | None, default: Policy = HIPS) -> Column:
    own, rest = _rules(policies, default)
    out = F.lit(rest.operator)
    for kind, policy in own.items():
        out = F.when(entity_type == kind, F.lit(policy.operator)).otherwise(out)
    return out
