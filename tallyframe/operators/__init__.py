"""Operators over frames: rules, fees, resolution, diffs, reconciliation, pages, usage."""
