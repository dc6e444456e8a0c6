"""Flows: streaming jobs over change logs with their configuration, supervision and control plane."""
