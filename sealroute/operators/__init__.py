"""DataFrame-to-DataFrame steps of the exchange jobs."""
