"""Operations of a large training-data pipeline."""
