"""DuckDB SQL with the same results as the registered Spark queries; used only to check them."""

from __future__ import annotations


def all_sql() -> dict[str, str]:
    from oracle import knowledge, requests, warehouse

    return {**warehouse.all_sql(), **knowledge.all_sql(), **requests.all_sql()}
