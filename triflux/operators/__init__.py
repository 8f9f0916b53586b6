"""Operators on graphs, histograms and sketches: DataFrame in, DataFrame out."""
