"""The models: each is a function from tables to a table. Parameter names are table names."""
