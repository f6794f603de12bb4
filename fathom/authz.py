"""Who may read and write which types, rows and fields."""

from __future__ import annotations

import re
import secrets
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .errors import DeniedError
from .schema import EntityType

TENANT_ID = re.compile(r"^(?!.*--)[a-z0-9](?:[a-z0-9-]{0,50}[a-z0-9])?$")


@dataclass(frozen=True)
class Caller:
    """subject: the user's id; roles decide which rules are bypassed."""

    subject: str | None = None
    tenant: str | None = None
    roles: frozenset[str] = frozenset()
    suspended: bool = False


@dataclass(frozen=True)
class Rules:
    """For one type: roles that may use it, roles that see all owners' rows, and roles that a field is kept from."""

    allowed_roles: frozenset[str] | None = None
    bypass_roles: frozenset[str] = frozenset()
    hidden: dict[str, frozenset[str]] = field(default_factory=dict)  # field -> roles that may see it


@dataclass(frozen=True)
class Constraint:
    """What a caller's reads of a type are held to; allowed None: every field."""

    owner_field: str | None = None
    owner: str | None = None
    tenant_field: str | None = None
    tenant: str | None = None
    allowed: frozenset[str] | None = None

    def permits(self, name: str) -> bool:
        return self.allowed is None or name.lower() in self.allowed

    def predicates(self, df: DataFrame) -> list[Column]:
        found = []
        if self.owner_field is not None:
            found.append(df[self.owner_field] == F.lit(self.owner))
        if self.tenant_field is not None:
            found.append(df[self.tenant_field] == F.lit(self.tenant))
        return found

    def rows(self, df: DataFrame) -> DataFrame:
        """df with the owner's and the tenant's rows only; pushed into the scan like any other filter."""
        for p in self.predicates(df):
            df = df.where(p)
        return df

    def mask(self, df: DataFrame) -> DataFrame:
        return df if self.allowed is None else df.select(*[c for c in df.columns if c.lower() in self.allowed])


OPEN = Constraint()


def new_key() -> str:
    """A UUID of version 7: keys of later entities are greater."""
    value = time.time_ns() // 1_000_000 << 80 | secrets.randbits(80)
    return str(uuid.UUID(int=value & ~(0xF << 76) & ~(0x3 << 62) | 0x7 << 76 | 0x2 << 62))


def valid_tenant(tenant: str | None) -> bool:
    return bool(tenant) and bool(TENANT_ID.match(tenant))


def evaluate(t: EntityType, rules: Rules | None, caller: Caller | None) -> Constraint | None:
    """The constraint on a caller's reads of a type; None if they are denied.

    No rules, no caller, no subject or no valid tenant: denied. The key is never hidden.
    """
    if rules is None or caller is None or not caller.subject or caller.suspended:
        return None
    if t.tenant_field and not valid_tenant(caller.tenant):
        return None
    if rules.allowed_roles is not None and not (caller.roles & (rules.allowed_roles | rules.bypass_roles)):
        return None
    bypass = bool(caller.roles & rules.bypass_roles)
    hidden = set() if bypass else {f.lower() for f, roles in rules.hidden.items() if not (caller.roles & roles)}
    hidden.discard(t.key.lower())
    return Constraint(
        owner_field=None if bypass else t.owner_field,
        owner=None if bypass else caller.subject,
        tenant_field=t.tenant_field,
        tenant=caller.tenant if t.tenant_field else None,
        allowed=frozenset(n.lower() for n in t.names if n.lower() not in hidden) if hidden else None,
    )


def prepare_write(t: EntityType, rules: Rules | None, caller: Caller, row: dict, stored: dict | None, make_key: bool = False) -> dict:
    """The row as it may be written: tenant and owner are the caller's on create and cannot change on update."""
    limits = evaluate(t, rules, caller)
    if limits is None:
        raise DeniedError(f"{t.name} cannot be written")
    by_name = {n.lower(): n for n in t.names}
    row = {by_name.get(k.lower(), k): v for k, v in row.items()}
    for name in row:
        if not limits.permits(name) and name.lower() not in {(t.owner_field or "").lower(), (t.tenant_field or "").lower()}:
            raise DeniedError(f"{name} cannot be written")
    if stored is None:
        if make_key or not row.get(t.key):
            row[t.key] = new_key()
        if t.tenant_field:
            row[t.tenant_field] = caller.tenant
        if t.owner_field and limits.owner_field:
            row[t.owner_field] = caller.subject
        return row
    if not row.get(t.key):
        raise DeniedError("an update needs a key")
    for name, own in ((t.tenant_field, caller.tenant), (t.owner_field if limits.owner_field else None, caller.subject)):
        if name:
            if stored.get(name) != own:
                raise DeniedError(f"this {t.name} belongs to another {name}")
            row[name] = stored[name]
    if t.owner_field and not limits.owner_field:
        row[t.owner_field] = stored.get(t.owner_field)
    return row
