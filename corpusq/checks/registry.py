"""All registered queries and their oracles, collected from the modules of this package."""

from importlib import import_module

MODULES = ["corpus", "chunking", "labelling", "extraction", "retrieving", "analysing", "recording", "streams"]


class Checks:
    """Register ``name -> (query, sql)``; sql None means rows only."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def add(self, name, sql=None):
        def register(query):
            self.queries[name] = query
            if sql is not None:
                self.oracles[name] = sql
            return query
        return register


def _collect(attribute):
    merged = {}
    for module in MODULES:
        merged.update(getattr(import_module(f"corpusq.checks.{module}").checks, attribute))
    return merged


def queries():
    return _collect("queries")


def oracle_sql():
    return _collect("oracles")
