"""The tenants that an engine serves, and what is set up for each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .authz import valid_tenant
from .errors import SchemaError
from .schema import EntityType

#: Status of a tenant; those that are unknown have none.
ACTIVE, SUSPENDED, DELETED = "active", "suspended", "deleted"


@dataclass
class Tenants:
    """status: of each known tenant. set_up(tenant, type) is called once for each pair, when it is first needed."""

    status: dict[str, str] = field(default_factory=dict)
    set_up: Callable[[str, EntityType], None] | None = None
    prefix: str = "entities"
    done: set[tuple[str, str]] = field(default_factory=set)

    def add(self, tenant: str) -> None:
        if not valid_tenant(tenant):
            raise SchemaError(f"'{tenant}' is not a valid tenant")
        self.status[tenant] = ACTIVE

    def active(self, tenant: str | None) -> bool:
        return tenant is not None and self.status.get(tenant) == ACTIVE

    def suspend(self, tenant: str) -> None:
        self._known(tenant, SUSPENDED)

    def delete(self, tenant: str) -> None:
        self._known(tenant, DELETED)

    def _known(self, tenant: str, status: str) -> None:
        if tenant not in self.status:
            raise SchemaError(f"'{tenant}' is not known")
        self.status[tenant] = status

    def database(self, tenant: str) -> str:
        """The physical name of a tenant's database."""
        if not valid_tenant(tenant):
            raise SchemaError(f"'{tenant}' is not a valid tenant")
        return f"{self.prefix}_tenant_{tenant}"

    def ensure(self, tenant: str, t: EntityType) -> bool:
        """Set a tenant up for a type if that was not done yet; whether it was done now. Tenants that are not active have nothing set up."""
        if not self.active(tenant):
            raise SchemaError(f"'{tenant}' is not an active tenant")
        key = (tenant, t.name.lower())
        if key in self.done:
            return False
        if self.set_up is not None:
            self.set_up(tenant, t)
        self.done.add(key)
        return True
