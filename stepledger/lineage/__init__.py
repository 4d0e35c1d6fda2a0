"""Programs and run logs as tables: steps, reads and writes, graphs, provenance."""
