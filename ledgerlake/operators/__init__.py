"""The write side: traces and deltas to tables, current state, temporal lookups."""
