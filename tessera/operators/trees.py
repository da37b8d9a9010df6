"""Nested registries, stored as JSON, flattened to rows: each level is exploded as a variant, and what isn't as it should be is passed over.

A body that is no JSON, a level that is no object (or no list), and a leaf without what it must have give no rows; the rest of
the same body does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def endpoints(trees: DataFrame) -> DataFrame:
    """(contract_key, repo_id, symbol_key, symbol_id, contract, direction, confidence) of trees (body): contract, repository, symbol, endpoint."""
    return trees.sparkSession.sql(
        """
        SELECT a.key AS contract_key, b.key AS repo_id, c.key AS symbol_key, try_variant_get(c.value, '$.symbol_id', 'string') AS symbol_id, try_variant_get(c.value, '$.contract', 'string') AS contract,
               try_variant_get(c.value, '$.direction', 'string') AS direction, try_variant_get(c.value, '$.confidence', 'double') AS confidence
        FROM {trees} AS t, LATERAL variant_explode(try_parse_json(t.body)) AS a, LATERAL variant_explode(a.value) AS b, LATERAL variant_explode(b.value) AS c
        WHERE a.key IS NOT NULL AND b.key IS NOT NULL AND c.key IS NOT NULL
        """,
        trees=trees,
    ).where("symbol_id IS NOT NULL AND contract IS NOT NULL AND direction IN ('inbound', 'outbound') AND confidence IS NOT NULL")


def flows(trees: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id, param, arg) of trees (body): a symbol and the list of its edges; an edge needs its end and its parameter."""
    return trees.sparkSession.sql(
        """
        SELECT a.key AS from_symbol_id, try_variant_get(b.value, '$.to_symbol_id', 'string') AS to_symbol_id, try_variant_get(b.value, '$.param', 'string') AS param, try_variant_get(b.value, '$.arg', 'string') AS arg
        FROM {trees} AS t, LATERAL variant_explode(try_parse_json(t.body)) AS a, LATERAL variant_explode(a.value) AS b
        WHERE a.key IS NOT NULL AND b.key IS NULL
        """,
        trees=trees,
    ).where("to_symbol_id IS NOT NULL AND param IS NOT NULL")
