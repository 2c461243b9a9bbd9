"""Operations of a training-data pipeline: tokens, search, scoring, archives, deduplication, formatting."""
