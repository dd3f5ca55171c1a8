"""A small table of queries."""


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        """Decorator: register a (spark, sf_dir) -> DataFrame with its SQL."""

        def put(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return put
