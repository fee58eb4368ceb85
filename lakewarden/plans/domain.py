"""The nine domain tables' contract."""

from __future__ import annotations

import json
from importlib import resources

from lakewarden.sources.contract import ColumnSpec, Contract, Role, TableSpec


def clinical_contract() -> Contract:
    """The contract shipped with the package; it lies inside the package, not on shared storage,
    so it is read on the driver. Contracts elsewhere are read with ``load_contract``."""
    text = resources.files("lakewarden.contracts").joinpath("clinical.json").read_text()
    content = json.loads(text)
    tables = {
        name: TableSpec(
            name,
            tuple(
                ColumnSpec(c, d["type"], d.get("phi_type"), d.get("masking"))
                for c, d in t["columns"].items()
            ),
            t["entity_column"], t["primary_key"], t["foreign_keys"], t["description"],
        )
        for name, t in content["tables"].items()
    }
    roles = {
        name: Role(r["phi_access"], tuple(r["masked_phi_types"]))
        for name, r in content["roles"].items()
    }
    return Contract(tables, roles)
