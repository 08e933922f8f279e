"""Decorator that collects queries of one catalog module."""
from __future__ import annotations

from ..relations import Tables, sql


class Catalog(dict):
    def query(self, needs: str = "", text: str | None = None, recursive: str = ""):
        """Register ``fn(Tables) -> DataFrame`` under its name with its SQL over the named relations."""
        def add(fn):
            def run(spark, folder, fn=fn):
                return fn(Tables(spark, folder))
            run.__name__, run.__doc__ = fn.__name__, fn.__doc__
            body = None if text is None else (sql(needs, text, recursive) if needs or recursive else text)
            self[fn.__name__] = (run, body)
            return fn
        return add
