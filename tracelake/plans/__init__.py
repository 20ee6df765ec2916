"""All queries; importing this fills the registry."""

from . import engine, grouping, io, more, simulated, single, tables, windows  # noqa: F401
