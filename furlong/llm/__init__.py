"""Operations of a training-data pipeline; nothing else in furlong imports this subpackage."""
