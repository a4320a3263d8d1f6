"""Reading events, deltas and snapshots."""
