"""How a query module lists its queries: a function of lazily made views, and the SQL for the same rows."""

from __future__ import annotations

from .adapters import view


class Views:
    """The adapter tables of one data set, made when first asked for."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str):
        if name not in self._made:
            self._made[name] = view(self.spark, self.sf_dir, name)
        return self._made[name]


class Registry(dict):
    def add(self, name: str, sql: str | None = None):
        def put(f):
            self[name] = (lambda spark, sf_dir: f(Views(spark, sf_dir)), sql)
            return f

        return put
