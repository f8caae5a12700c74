"""Bronze storage, raw-payload parsers, row validation and curated seeds."""
