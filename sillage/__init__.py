"""Evidence analytics on Spark: lookup, ranking, spectra, replicate statistics, text retrieval and counters."""
