"""Training-data operators. Nothing outside this subpackage imports it."""

MODULES = ("chat", "secrets", "pii", "compression", "bpe", "mixing", "langid", "topk", "jaccard", "suffix")


def _modules():
    from importlib import import_module

    return [import_module(f"streammart.llm.{name}") for name in MODULES]


def queries():
    """Query name -> callable(spark, sf_dir)."""
    return {m.NAME: m.query for m in _modules()}


def oracle_sql():
    """Query name -> DuckDB SQL, where SQL can express the query."""
    return {m.NAME: m.SQL for m in _modules() if m.SQL}
