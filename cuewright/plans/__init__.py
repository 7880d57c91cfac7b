"""Views over the driver's tables, and the catalogue of queries with their SQL counterparts."""
