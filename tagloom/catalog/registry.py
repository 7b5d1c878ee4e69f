"""Registration of queries with their SQL."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise KeyError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
