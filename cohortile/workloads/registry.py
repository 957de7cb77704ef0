"""One table of named queries, each with the SQL that must give the same rows."""

QUERIES = {}
ORACLE = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add
