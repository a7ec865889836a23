"""Part of swathframe."""
