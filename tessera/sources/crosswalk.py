"""The logical tables (symbols, edges, effects, ledger, feedback, audit, endpoints, docs) over the driver's tables.

Each is declared once, in SQL that Spark and DuckDB both read but for the
dialect marks of `render`; `frame` gives it as a DataFrame, `ctes` as text.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]

#: The time that counts as now.
NOW = "TIMESTAMP '2024-02-01 00:00:00'"

#: name: (tables it reads, SQL)
LOGICAL: dict[str, tuple[list[str], str]] = {
    "symbols": (["part"], """
SELECT concat('sym_', p_partkey) AS symbol_id, p_partkey AS part,
       concat(lower(p_type), '.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_'), '_', p_partkey) AS qname,
       CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'rust' END AS language,
       CASE p_size % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'class' ELSE 'variable' END AS kind,
       concat(CASE p_size % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'scheduler/' WHEN 2 THEN 'views/' WHEN 3 THEN 'storage/' WHEN 4 THEN 'models/' WHEN 5 THEN 'docs/'
                WHEN 6 THEN 'samples/' WHEN 7 THEN 'viewmodels/' ELSE 'src/' END, lower(p_type), '/', lower(replace(p_brand, '#', '')),
              CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.rs' END) AS file,
       p_size AS start_line, p_size + 10 AS end_line,
       concat('def ', replace(p_name, ' ', '_'), '(self, ', lower(p_type), ', size: int)') AS signature,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_name, ' for ', lower(p_type), '. Size ', p_size) END AS doc
FROM part"""),
    "edges": (["lineitem"], """
SELECT DISTINCT concat('sym_', a.l_partkey) AS src, concat('sym_', b.l_partkey) AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_quantity > 40 AND b.l_quantity > 40 AND a.l_partkey <> b.l_partkey"""),
    "effects": (["part"], """
SELECT concat('sym_', p_partkey) AS symbol_id,
       CASE p_size % 6 WHEN 0 THEN 'fs.read' WHEN 1 THEN 'net.out' WHEN 2 THEN 'db.write' WHEN 3 THEN 'log' WHEN 4 THEN 'throws' ELSE 'process.spawn' END AS effect
FROM part WHERE p_size % 4 = 1 OR p_partkey % 10 = 3"""),
    "ledger": (["events"], """
SELECT concat('e', event_id) AS entry_id, event_id AS seq, concat('sym_', user_id * 20) AS symbol_id,
       CASE concat(event_type, event_id % 3)
         WHEN 'click0' THEN 'decision' WHEN 'click1' THEN 'constraint' WHEN 'click2' THEN 'mapping'
         WHEN 'view0' THEN 'proof' WHEN 'view1' THEN 'hypothesis' WHEN 'view2' THEN 'open_question'
         WHEN 'purchase0' THEN 'invariant' WHEN 'purchase1' THEN 'mental_model' WHEN 'purchase2' THEN 'rationale'
         WHEN 'signup0' THEN 'ownership' WHEN 'signup1' THEN 'concept' WHEN 'signup2' THEN 'follow_up'
         WHEN 'error0' THEN 'hazard' WHEN 'error1' THEN 'known_bug' ELSE 'failed_attempt' END AS kind,
       concat(event_type, ' note ', @JSON(props, k)) AS summary, props AS body,
       concat('agent', user_id % 5) AS author, round(least(1.0@D, value / 100.0@D), 6) AS confidence,
       CASE WHEN CAST(@JSON(props, k) AS INT) % 7 = 0 THEN 'e' || CAST(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS STRING) END AS supersedes,
       ts AS created_at,
       CASE CAST(@JSON(props, k) AS INT) % 8 WHEN 0 THEN 'stale-api' WHEN 1 THEN 'audit-pending' WHEN 2 THEN 'fast-test' WHEN 3 THEN 'diagnostic-test' END AS role,
       CASE WHEN CAST(@JSON(props, k) AS INT) % 4 = 2 THEN concat('run ', user_id) END AS command
FROM events"""),
    "live": (["ledger"], """
SELECT l.* FROM ledger l LEFT JOIN (SELECT DISTINCT symbol_id AS s, supersedes AS e FROM ledger WHERE supersedes IS NOT NULL) x
  ON x.s = l.symbol_id AND x.e = l.entry_id WHERE x.e IS NULL"""),
    "feedback": (["events"], """
SELECT concat('f', event_id) AS entry_id, concat('sym_', user_id * 20) AS symbol_id,
       concat(CASE event_id % 4 WHEN 0 THEN 'red ' WHEN 1 THEN 'blue ' WHEN 2 THEN 'small ' ELSE 'large ' END, CASE event_id % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' ELSE 'bolt' END) AS query,
       CASE event_id % 6 WHEN 0 THEN 'useful' WHEN 1 THEN 'noisy' WHEN 2 THEN 'missing' WHEN 3 THEN 'wrong-layer' WHEN 4 THEN 'covered' ELSE 'diagnostic' END AS verdict,
       ts AS created_at, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 10 DAY END AS expires_at
FROM events WHERE event_type IN ('click', 'error')"""),
    # feedback with its author, some of it on files by a glob, some on queries without words
    "verdicts": (["events"], """
SELECT concat('f', event_id) AS entry_id, concat('sym_', user_id * 20) AS symbol_id,
       CASE WHEN event_id % 97 = 0 THEN '?!' ELSE concat(CASE event_id % 4 WHEN 0 THEN 'red ' WHEN 1 THEN 'blue ' WHEN 2 THEN 'small ' ELSE 'large ' END, CASE event_id % 3 WHEN 0 THEN 'ring' WHEN 1 THEN 'widget' ELSE 'bolt' END) END AS query,
       CASE event_id % 31 WHEN 1 THEN 'noisy' WHEN 2 THEN 'missing' WHEN 3 THEN 'wrong-layer' WHEN 4 THEN 'covered' WHEN 5 THEN 'diagnostic' ELSE 'useful' END AS verdict,
       concat('user', user_id % 7) AS author, ts AS created_at,
       CASE event_id % 33 WHEN 0 THEN 'models/**' WHEN 11 THEN concat('**/brand', event_id % 25, '.py') WHEN 22 THEN 'views/economy/*' END AS file_scope
FROM events WHERE event_type IN ('click', 'error')"""),
    # decisions and constraints that penalise, with the files they speak of: a list of globs, none, or nothing that can be read
    "penalties": (["ledger"], """
SELECT entry_id, symbol_id, CASE seq % 5 WHEN 0 THEN concat('{"scope": ["models/**", "**/brand', seq % 25, '.py"]}') WHEN 1 THEN '{"scope": []}' WHEN 2 THEN 'no json'
  WHEN 3 THEN concat('{"scope": ["', CASE seq % 3 WHEN 0 THEN 'views/*/*' WHEN 1 THEN 'src/**' ELSE 'storage/economy/brand*.ts' END, '"]}') END AS body
FROM ledger WHERE kind IN ('decision', 'constraint') AND role IN ('stale-api', 'audit-pending')"""),
    "audit": (["events"], """
SELECT seq, event_type, actor_id, ts, outcome, subject_id, event_hash,
       CASE WHEN seq % 500 = 499 THEN 'tampered' ELSE lag(event_hash) OVER (ORDER BY seq) END AS prev_event_hash
FROM (SELECT event_id AS seq, concat('ledger.', event_type) AS event_type, concat('user', user_id) AS actor_id, ts,
             CASE WHEN value > 50 THEN 'deny' WHEN value > 20 THEN 'require-approval' ELSE 'allow' END AS outcome,
             concat('sym_', user_id * 20) AS subject_id, @SHA(concat(event_id, '|', event_type, '|', user_id)) AS event_hash FROM events) AS e"""),
    "endpoints": (["pages"], """
SELECT page_id, concat('page.', page_id) AS symbol_id, @GROUP(url, '^https?://([^/?#]+)') AS repo_id,
       concat('http:GET ', @SUB(lower(@GROUP(url, '^https?://[^/?#]+([^?#]*)')), '/[0-9]+', '/{}')) AS contract,
       CASE WHEN page_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS direction, CASE WHEN page_id % 2 = 0 THEN 0.9@D ELSE 0.7@D END AS confidence
FROM pages"""),
    # registries as they are stored, a file of JSON for each page: contract, repository, symbol, endpoint; some files or levels are broken
    "endpoint_trees": (["pages"], """
SELECT page_id, CASE WHEN page_id % 19 = 0 THEN 'no json' WHEN page_id % 19 = 1 THEN '[1, {"a": 2}]' WHEN page_id % 19 = 2 THEN concat('{"h', page_id, '": 7}')
  WHEN page_id % 19 = 3 THEN concat('{"h', page_id, '": {"', host, '": null, "other": {"s": "text"}}}') WHEN page_id % 19 = 4 THEN concat('{"h', page_id, '": {"', host, '": {"s1": {"symbol_id": "s1"}}}}') WHEN page_id % 19 = 5 THEN '' WHEN page_id % 19 = 6 THEN '{}'
  ELSE concat('{"h', page_id % 40, '": {"', host, '": {"page.', page_id, '": {"symbol_id": "page.', page_id, '", "contract": "http:GET /p/', page_id % 40, '", "direction": "', CASE WHEN page_id % 2 = 0 THEN 'inbound' WHEN page_id % 23 = 1 THEN 'sideways' ELSE 'outbound' END, '", "confidence": ', CASE WHEN page_id % 11 = 0 THEN '"high"' ELSE '0.5' END, '}, "twin.', page_id, '": {"symbol_id": "twin.', page_id, '", "contract": "http:PUT /p", "direction": "inbound", "confidence": 1}}}, "x": {}}') END AS body
FROM (SELECT page_id, @GROUP(url, '^https?://([^/?#]+)') AS host FROM pages) AS p"""),
    # data flow: a symbol and the list of its edges
    "flow_trees": (["lineitem"], """
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 17 = 0 THEN '{"s": 1' WHEN l_partkey % 17 = 1 THEN concat('{"sym_', l_partkey, '": "none"}') WHEN l_partkey % 17 = 2 THEN concat('{"sym_', l_partkey, '": [{"param": "x"}, 3, null]}')
  ELSE concat('{"sym_', l_partkey, '": [{"to_symbol_id": "sym_', l_suppkey, '", "param": "p', l_linenumber, '", "arg": "a"}, {"to_symbol_id": "sym_', l_partkey, '", "param": "q"}]}') END AS body
FROM lineitem WHERE l_quantity > 45"""),
    "docs": (["documents"], """
SELECT doc_id, source AS kind, split_part(text, chr(10), 1) AS title, text AS body FROM documents"""),
    "docfiles": (["conversations", "events", "part", "customer", "nation", "pages"], """
SELECT concat(CASE conv_id % 9 WHEN 7 THEN 'node_modules/' WHEN 8 THEN '.cache/' ELSE '' END, 'notes/c', conv_id, '_', turn, '.md') AS path,
       concat('# ', role, chr(10), replace(text, '. E', concat(chr(10), '## E'))) AS content FROM conversations
UNION ALL SELECT concat('data/', event_id, CASE WHEN event_id % 50 = 0 THEN '/Package.json' ELSE '.json' END) AS path,
       concat('{', chr(10), '  "type": "', event_type, '",', chr(10), '  // user', chr(10), '  "props": ', props, ',', chr(10), '  "tags": [', chr(10), '    "', user_id, '"', chr(10), '  ]', chr(10), '}') AS content FROM events
UNION ALL SELECT concat('crates/', p_partkey, CASE WHEN p_size % 10 = 0 THEN '/Cargo.toml' ELSE '/conf.toml' END) AS path,
       concat('name = "', p_name, '"', chr(10), '# made', chr(10), CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('[dependencies]', chr(10), 'brand = "', p_brand, '"', chr(10)) END, ' [features.', lower(p_type), ']', chr(10), CASE WHEN p_size % 2 = 0 THEN '# none' ELSE concat('size = ', p_size) END) AS content FROM part
UNION ALL SELECT concat('conf/c', c_custkey, '.yaml') AS path, concat('# customer', chr(10), 'name: ', c_name, chr(10), '  segment: ', c_mktsegment, chr(10), chr(10), '  # note', chr(10), 'nation: ', c_nationkey) AS content FROM customer
UNION ALL SELECT concat('ui/', p_partkey, '.css') AS path,
       concat('/* {', chr(10), '.', lower(p_type), ' > .', replace(p_name, ' ', '-'), ' {', chr(10), '  --size: ', p_size, 'px;', chr(10), '  color: red;', chr(10), '}') AS content FROM part
UNION ALL SELECT concat('build/', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '/Makefile' WHEN 1 THEN '/Fastfile' ELSE '/Gemfile' END) AS path,
       CASE n_nationkey % 3 WHEN 0 THEN concat('all:', chr(10), lower(n_name), ':', chr(10), '# no:', chr(10), 'two words:', chr(10), 'x: y') WHEN 1 THEN concat('desc "', n_name, '"', chr(10), 'lane :n', n_nationkey, ' do', chr(10), 'end') ELSE concat('gem ', n_name) END AS content FROM nation
UNION ALL SELECT concat('site/p', page_id, CASE WHEN page_id % 20 = 0 THEN '.txt' ELSE '.HTML' END) AS path, html AS content FROM pages"""),
    "names": (["part"], """
SELECT p_partkey AS part, concat(lower(p_type), '.', replace(p_brand, '#', ''), '.get', upper(substring(split_part(p_name, ' ', 1), 1, 1)), substring(split_part(p_name, ' ', 1), 2),
  CASE WHEN p_size % 3 = 0 THEN '_' ELSE '' END, upper(p_type), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2), p_size) AS ident FROM part"""),
    "paths": (["part"], """
SELECT DISTINCT concat(CASE p_size % 13 WHEN 0 THEN 'App/Sources/' WHEN 1 THEN 'lib/src/' WHEN 2 THEN 'Tests/unit/' WHEN 3 THEN 'pkg/__tests__/' WHEN 4 THEN 'MockData/' WHEN 5 THEN 'ui/views/' WHEN 6 THEN 'a/samples/' WHEN 7 THEN 'core/' WHEN 8 THEN 'x/Source/y/' WHEN 9 THEN 'playgrounds/' WHEN 10 THEN 'contest/' WHEN 11 THEN 'specs/' ELSE '' END,
  CASE p_partkey % 17 WHEN 0 THEN 'Till' WHEN 1 THEN 'test_till' WHEN 2 THEN 'till_test' WHEN 3 THEN 'TillTests' WHEN 4 THEN 'TillTest' WHEN 5 THEN 'till.spec' WHEN 6 THEN 'TillSpec' WHEN 7 THEN 'till_spec' WHEN 8 THEN 'TillView' WHEN 9 THEN 'TillPreview' WHEN 10 THEN 'till.generated'
    WHEN 11 THEN 'MockTill' WHEN 12 THEN 'till_fake' WHEN 13 THEN 'TillViewControllerBase' WHEN 14 THEN 'TillOverlay' WHEN 15 THEN 'Contest' ELSE lower(replace(p_name, ' ', '_')) END,
  CASE p_partkey % 9 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' WHEN 3 THEN '.go' WHEN 4 THEN '.java' WHEN 5 THEN '.cs' WHEN 6 THEN '.rb' WHEN 7 THEN '.kt' ELSE '.swift' END) AS file FROM part"""),
    # commits of a few sources, one of them busy: of the index, of a pair of which the other is told, and all others
    "commits": (["events"], """
SELECT CASE WHEN user_id % 2 = 0 THEN 'main' ELSE concat('side', user_id % 10) END AS source, event_id AS commit_id, ts AS committed_at,
       CASE event_type WHEN 'view' THEN 'index' WHEN 'purchase' THEN 'paired' WHEN 'click' THEN 'decision' WHEN 'signup' THEN 'effect_declared' ELSE 'commit' END AS kind,
       concat(event_type, ' ', event_id) AS summary, event_id % 5 = 0 AS informative FROM events"""),
    # moves of symbols, some of them back to where they came from; what is written to the ledger, and by whom
    "moves": (["events"], """
SELECT event_id AS seq, concat('sym_', user_id * 20) AS src, concat('sym_', ((user_id * 3 + event_id) % 150) * 20) AS dst, ts AS made_at FROM events WHERE event_type = 'signup' AND event_id % 3 <> 1"""),
    "proposals": (["events"], """
SELECT concat('led_', substring(@SHA(concat(event_type, '|', event_id)), 1, 16)) AS entry_id, event_id AS seq, concat('sym_', user_id * 20) AS symbol_id, event_type AS kind, concat(event_type, ' of ', user_id) AS summary,
       concat('ledger.', event_type) AS action, concat('user', user_id) AS actor FROM events"""),
    # symbols with names in mixed case, and what is asked for: single words, phrases, words that many names share
    "code": (["part"], """
SELECT concat('sym_', p_partkey) AS symbol_id,
       concat(lower(p_type), '.m', p_partkey, '.', CASE p_size % 6
         WHEN 0 THEN concat(split_part(p_name, ' ', 1), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2))
         WHEN 1 THEN concat('refresh', upper(substring(p_name, 1, 1)), substring(split_part(p_name, ' ', 1), 2), upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2))
         WHEN 2 THEN concat(split_part(p_name, ' ', 2), 'For', upper(substring(p_name, 1, 1)), substring(split_part(p_name, ' ', 1), 2))
         WHEN 3 THEN concat(upper(p_type), 'State', upper(substring(split_part(p_name, ' ', 2), 1, 1)), substring(split_part(p_name, ' ', 2), 2))
         WHEN 4 THEN concat('get', upper(substring(p_name, 1, 1)), substring(split_part(p_name, ' ', 1), 2), 'State') ELSE replace(p_name, ' ', '_') END) AS qname,
       CASE p_partkey % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'rust' END AS language,
       CASE p_size % 5 WHEN 0 THEN 'module' WHEN 1 THEN 'function' WHEN 2 THEN 'method' WHEN 3 THEN 'class' ELSE 'variable' END AS kind,
       concat(CASE p_size % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'scheduler/' WHEN 2 THEN 'views/' WHEN 3 THEN 'storage/' WHEN 4 THEN 'models/' WHEN 5 THEN 'docs/'
                WHEN 6 THEN 'samples/' WHEN 7 THEN 'viewmodels/' ELSE 'src/' END, lower(p_type), '/', CASE WHEN p_partkey % 4 = 0 THEN concat(split_part(p_name, ' ', 1), 'Brand') ELSE 'brand' END, substring(p_brand, 7),
              CASE p_partkey % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.rs' END) AS file,
       p_size AS start_line, concat('def ', replace(p_name, ' ', '_'), '(self, ', lower(p_type), 'Size: int)') AS signature,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_name, ' for ', lower(p_type), '. Size ', p_size) END AS doc
FROM part"""),
    "asks": (["feedback", "part", "events"], """
SELECT query FROM feedback UNION SELECT concat(split_part(p_name, ' ', 2), ' state') AS query FROM part UNION SELECT concat('refresh ', p_name) AS query FROM part
UNION SELECT concat(split_part(p_name, ' ', 2), ' view') AS query FROM part UNION SELECT concat(event_type, ' note of the ', substring(event_type, 1, 4)) AS query FROM events
UNION SELECT concat(split_part(p_name, ' ', 2), CASE p_size % 5 WHEN 0 THEN ' network' WHEN 1 THEN ' engine' WHEN 2 THEN ' service' WHEN 3 THEN ' schema' ELSE ' queue' END) AS query FROM part WHERE p_size < 12"""),
    "policies": ([], """
SELECT * FROM (VALUES (1, 'ledger.purchase', FALSE, 'human', NULL), (2, 'ledger.click', TRUE, NULL, 'user7'), (3, 'ledger.error.*', TRUE, NULL, NULL),
  (4, 'ledger.view', FALSE, NULL, NULL), (5, 'ledger.*', FALSE, NULL, 'user8'), (6, 'ledger.signup', TRUE, NULL, NULL)) AS t(pos, match_action, deny, require_approval, agent_id)"""),
    "adjacent": (["edges"], "SELECT src AS node, dst AS other FROM edges UNION SELECT dst AS node, src AS other FROM edges"),
}


def render(text: str, duck: bool) -> str:
    """The dialect marks: @JSON(col, key), @SHA(x), @GROUP(text, pattern) (the first group), @SUB(text, pattern, to) (all), @D (double literal)."""
    text = re.sub(r"@JSON\((\w+), (\w+)\)", (r"(\1->>'$.\2')" if duck else r"get_json_object(\1, '$.\2')"), text)
    text = text.replace("@D", "::DOUBLE" if duck else "D")
    text = text.replace("@SHA(", "sha256(" if duck else "@SHA2(")
    while "@SHA2(" in text:
        text = _closed(text, "@SHA2(", lambda inner: f"sha2({inner}, 256)")
    while "@GROUP(" in text:
        text = _closed(text, "@GROUP(", lambda inner: f"regexp_extract({inner}, 1)")
    while "@SUB(" in text:
        text = _closed(text, "@SUB(", lambda inner: f"regexp_replace({inner}, 'g')" if duck else f"regexp_replace({inner})")
    return text


def _closed(text: str, start: str, to) -> str:
    """Replaces the first call that begins with `start`, up to its closing bracket outside of quotes."""
    a = text.index(start)
    depth, quoted, i = 1, False, a + len(start)
    while depth:
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
        i += 1
    return text[:a] + to(text[a + len(start) : i - 1]) + text[i:]


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        if n in LOGICAL:
            out += [x for x in [*_needed(LOGICAL[n][0]), n] if x not in out]
    return out


def with_ctes(names: list[str], body: str) -> str:
    """DuckDB SQL: the logical tables that are needed, as CTEs, before the body."""
    ctes = [f"{n} AS ({LOGICAL[n][1]})" for n in _needed(names)]
    recursive = "WITH RECURSIVE " in body
    body = body.replace("WITH RECURSIVE ", "WITH ", 1)
    if body.lstrip().startswith("WITH "):
        ctes.append(body.lstrip()[5:])
        return render(f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes), duck=True)
    return render((f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(ctes) + "\n" if ctes else "") + body, duck=True)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base or logical table."""
    if name not in LOGICAL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run_sql(spark, sf_dir, LOGICAL[name][0], LOGICAL[name][1])


def over(spark: SparkSession, body: str, **tables: DataFrame) -> DataFrame:
    """A query over DataFrames by name, in the form with dialect marks."""
    text = render(body, duck=False).replace("{", "{{").replace("}", "}}")
    for n in tables:
        text = re.sub(rf"(\b(?:FROM|JOIN)\s+|,\s*(?=\w+ (?:AS )?\w+ WHERE)){n}\b", rf"\g<1>{{{n}}}", text)
    return spark.sql(text, **{n: t for n, t in tables.items() if "{" + n + "}" in text})


def run_sql(spark: SparkSession, sf_dir: str, names: list[str], body: str) -> DataFrame:
    """A query over base and logical tables, which are passed as DataFrames, not as views of the session."""
    return over(spark, body, **{n: frame(spark, sf_dir, n) for n in names})
