"""Operations of a training-data pipeline; ``catalog`` lists their queries."""
