"""Training-data pipeline operators: mixing, deduplication, extraction, decontamination, filtering and scoring."""
