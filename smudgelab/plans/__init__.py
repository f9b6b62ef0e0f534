"""Composite jobs: the configuration grid, sweeps, evaluations and reports."""
