"""Whole jobs: the choice of a counting method, the stream report, the registered queries."""
