"""Imports every module that registers queries."""

from sluice.operators import contracts, files, gates, kernels, profiles, reconcile, records, scans, scores, sentences, series, splits, streams, summaries  # noqa: F401
