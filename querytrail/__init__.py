"""Search-log analytics as plain DataFrame-to-DataFrame functions."""
