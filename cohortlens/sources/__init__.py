from cohortlens.sources.tables import TABLES, Tables, table  # noqa: F401
