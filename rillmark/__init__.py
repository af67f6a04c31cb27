"""rillmark: entity-centred stream analytics as PySpark DataFrame functions."""
