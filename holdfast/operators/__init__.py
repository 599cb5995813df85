"""User-level operators: DataFrames in, DataFrames out; nothing runs until a sink asks for rows."""
