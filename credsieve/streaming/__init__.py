"""Continuous scans and the stateful parts of validation."""
