"""Column functions: Column in, Column out, usable in batch, SQL views and streams."""
