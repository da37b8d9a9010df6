"""Registries of endpoints and of data flow, flattened."""

from __future__ import annotations

from ..operators import trees
from ..registry import query
from ..sources.crosswalk import frame, with_ctes

# DuckDB takes the keys of a level and what stands under them.
LEVEL = "SELECT {keep}unnest(json_keys({j})) AS {k}, unnest(list_transform(json_keys({j}), lambda x: json_extract({j}, '$.\"' || x || '\"'))) AS {v} FROM {src} WHERE json_type({j}) = 'OBJECT'"
ENDPOINTS = f"""WITH t AS (SELECT CAST(body AS JSON) AS j FROM endpoint_trees WHERE json_valid(body)),
a AS ({LEVEL.format(keep='', j='j', k='k1', v='v1', src='t')}), b AS ({LEVEL.format(keep='k1, ', j='v1', k='k2', v='v2', src='a')}), c AS ({LEVEL.format(keep='k1, k2, ', j='v2', k='k3', v='v3', src='b')})
SELECT k1 AS contract_key, k2 AS repo_id, k3 AS symbol_key, v3->>'$.symbol_id' AS symbol_id, v3->>'$.contract' AS contract, v3->>'$.direction' AS direction, TRY_CAST(v3->>'$.confidence' AS DOUBLE) AS confidence
FROM c WHERE v3->>'$.symbol_id' IS NOT NULL AND v3->>'$.contract' IS NOT NULL AND v3->>'$.direction' IN ('inbound', 'outbound') AND TRY_CAST(v3->>'$.confidence' AS DOUBLE) IS NOT NULL"""
FLOWS = f"""WITH t AS (SELECT CAST(body AS JSON) AS j FROM flow_trees WHERE json_valid(body)), a AS ({LEVEL.format(keep='', j='j', k='k1', v='v1', src='t')}),
e AS (SELECT k1, unnest(CAST(v1 AS JSON[])) AS e FROM a WHERE json_type(v1) = 'ARRAY')
SELECT k1 AS from_symbol_id, e->>'$.to_symbol_id' AS to_symbol_id, e->>'$.param' AS param, e->>'$.arg' AS arg FROM e WHERE e->>'$.to_symbol_id' IS NOT NULL AND e->>'$.param' IS NOT NULL"""


@query("endpoints_flatten", with_ctes(["endpoint_trees"], ENDPOINTS))
def endpoints_flatten(spark, sf_dir):
    return trees.endpoints(frame(spark, sf_dir, "endpoint_trees"))


@query("dataflow_flatten", with_ctes(["flow_trees"], FLOWS))
def dataflow_flatten(spark, sf_dir):
    return trees.flows(frame(spark, sf_dir, "flow_trees"))
