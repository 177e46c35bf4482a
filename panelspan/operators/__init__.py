"""DataFrame operators: ``op(df, ..., by=[...]) -> DataFrame``."""
