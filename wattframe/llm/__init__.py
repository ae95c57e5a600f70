"""Operations of a training-data pipeline: deduplication, scoring, mixing, sharding, search."""
