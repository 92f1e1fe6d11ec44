"""All queries of the keyspace operators, by name."""

from __future__ import annotations

from keelson.plans import base, q_bits, q_geo, q_hashes, q_json, q_keys, q_lists, q_sets, q_streams, q_strings, q_vectors, q_zsets  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
