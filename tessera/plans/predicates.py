"""Predicates, projections and scalar functions over paths, names, queries and texts."""

from __future__ import annotations

from .base import sql

# Words that queries ignore.
STOPWORDS = (
    "a an and as at be but by for from if into is it nor not of on or so the to via vs yet with over about "
    "between than that this are was were has have had its our"
).split()
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)



def found(column: str, pattern: str) -> str:
    """SQL: whether a pattern occurs."""
    return f"@GROUP({column}, '({pattern})') <> ''"


# Folders and file names of tests, then of samples, stand-ins and generated code.
PATH = "replace(lower(file), chr(92), '/')"
TEST = "(" + " OR ".join(found(PATH, x) for x in (
    "(^|/)(tests|test|specs|spec|__tests__|__mocks__|testing|testcases)/", "(^|/)test_[^/]*$", "_test[.](py|go|rs)$", "(tests|spec)[.]swift$", "[.](test|spec)[.][^/]*$", "_spec[.]rb$", "tests?[.](java|kt|cs)$",
)) + ")"
UTILITY = "(" + " OR ".join(found(PATH, x) for x in (
    "(^|/)(previews|preview|samples|sample|sampledata|examples|example|mocks|mock|stubs|stub|fixtures|fixture|demo|demos|editor|editors|generated|gen|sandbox|playground|playgrounds)/",
    "(^|/)(mock|stub|fake|sample|preview|generated)[^/]*/", "(preview|sampledata|sample_data|[.]generated[.]|[.]g[.]|_mock[.]|_stub[.]|_fake[.])[^/]*$", "generated[.]swift$", "(^|/)(mock|stub|fake)[^/]*$", "[.]playground$",
)) + ")"
TIER = f"CASE WHEN {TEST} THEN 2 WHEN {UTILITY} THEN 1 ELSE 0 END"
# Directories that name a layer, in the order in which layers are tried.
LAYERS = {
    "scheduler": "scheduler schedulers engine engines audio audioengine transport render renderer pipeline worker workers processing realtime dsp clock",
    "persistence": "storage database db repository repositories cache datastore persistence migration migrations store dao",
    "viewmodel": "viewmodels viewmodel presenters presenter coordinators coordinator interactors interactor controllers controller states state routers router",
    "ui": "views view screens screen pages page components component widgets widget cells viewcontrollers ui fragments",
    "core_model": "models model domain core entities entity services service usecases usecase business logic features feature",
}
# Endings of a file's stem that name a layer.
SUFFIXES = {
    "scheduler": "scheduler engine transport renderer pipeline worker processor synthesizer synth clock timer compiler loop",
    "persistence": "repository store database cache storage dao datasource migration",
    "viewmodel": "viewmodel viewstate presenter coordinator interactor statemanager controller observable environment router",
    "ui": "view screen page component widget cell viewcontroller fragment layout button label panel sheet modal overlay header footer",
    "core_model": "model entity service usecase manager handler factory builder validator",
}


def layer(file: str, tier: str) -> str:
    """SQL: the layer of a lower-case path; directories before stems, tests and utilities before all."""
    out = f"CASE WHEN {tier} = 2 THEN 'tests' WHEN {tier} = 1 THEN 'utility'"
    for name, dirs in LAYERS.items():
        some = "|".join(dirs.split())
        ends = "|".join(SUFFIXES[name].split())
        out += f" WHEN @GROUP(concat('/', {file}), '/({some})/') <> '' OR @GROUP({file}, '({ends})[.][^./]*$') <> '' THEN '{name}'"
    return out + " ELSE 'other' END"


LAYER = layer("file", f"({TIER})")
ALL_FILES = "SELECT file FROM symbols UNION SELECT file FROM paths"
sql("is_test_file", "symbols paths", f"SELECT file, {TEST} AS is_test FROM ({ALL_FILES}) AS f")
sql("is_utility_file", "symbols paths", f"SELECT file, {UTILITY} AS is_utility FROM ({ALL_FILES}) AS f")
sql("symbol_tier", "symbols paths", f"SELECT file, {TIER} AS tier FROM ({ALL_FILES}) AS f")
sql("tests_clause", "symbols", f"SELECT mode, qname FROM (SELECT qname, {TIER} AS tier FROM symbols) AS s CROSS JOIN (SELECT * FROM (VALUES ('only'), ('all'), ('none')) AS m(mode)) AS m WHERE mode = 'all' OR (mode = 'only' AND tier = 2) OR (mode = 'none' AND tier <> 2)")
sql("classify_layer", "symbols", f"SELECT DISTINCT file, {LAYER} AS layer FROM symbols")
sql("classify_layer_sym", "symbols", f"SELECT qname, CASE WHEN layer <> 'other' THEN layer WHEN qname LIKE '%widget%' THEN 'ui' WHEN qname LIKE '%store%' THEN 'persistence' ELSE 'other' END AS layer FROM (SELECT qname, {LAYER} AS layer FROM symbols) AS s")
sql("classify_file_role", "symbols", "SELECT DISTINCT file, CASE WHEN concat('/', file) LIKE '%/test%' OR concat('/', file) LIKE '%/spec%' THEN 'test' WHEN concat('/', file) LIKE '%/example%' OR concat('/', file) LIKE '%/sample%' OR concat('/', file) LIKE '%/demo%' THEN 'example' WHEN concat('/', file) LIKE '%/fixture%' OR concat('/', file) LIKE '%/seed%' THEN 'fixture' WHEN concat('/', file) LIKE '%/script%' OR concat('/', file) LIKE '%/tools/%' OR concat('/', file) LIKE '%/bin/%' THEN 'script' WHEN concat('/', file) LIKE '%/generated%' OR file LIKE '%.pb.%' THEN 'generated' WHEN concat('/', file) LIKE '%/doc%' OR file LIKE '%readme%' OR file LIKE '%.md' THEN 'reference' WHEN concat('/', file) LIKE '%/viewmodels/%' THEN 'viewmodel' WHEN concat('/', file) LIKE '%/views/%' THEN 'view' ELSE 'impl' END AS role FROM symbols")
sql("view_layer", "symbols", f"SELECT qname, {LAYER} IN ('ui', 'viewmodel') AS is_view FROM symbols")
STEM = "@SUB(@GROUP(file, '([^/]*)$'), '[.][^.]*$', '')"
# Endings and parts of names of views.
VIEWS = "(View|Screen|Widget|Panel|Cell|Button|Label|Row|Canvas|Overlay|Surface|Roll|Sheet|Layer|Renderer|Drawable|Page|Fragment)$|ViewController|Renderer"
sql("view_like", "symbols paths", f"SELECT file, layer, layer = 'view' OR {found('stem', VIEWS)} AS view_like FROM (SELECT file, {STEM} AS stem, {LAYER.replace('file', 'lower(file)')} AS layer FROM ({ALL_FILES}) AS f) AS v")
sql("rendering_surface", "symbols paths", f"SELECT file, {found(STEM, '(Canvas|Overlay|Surface|Roll|Sheet|Layer|Renderer|Drawable)$')} AS surface FROM ({ALL_FILES}) AS f")
sql("package_of", "symbols", "SELECT DISTINCT file, CASE WHEN @GROUP(file, '^(.*)/[^/]*$') = '' THEN '.' ELSE @GROUP(file, '^(.*)/[^/]*$') END AS package FROM symbols")
sql("same_module", "symbols edges", "SELECT e.src, e.dst, split_part(a.qname, '.', 1) = split_part(b.qname, '.', 1) AS same_module FROM edges e JOIN (SELECT symbol_id, qname FROM symbols) a ON a.symbol_id = e.src JOIN (SELECT symbol_id, qname FROM symbols) b ON b.symbol_id = e.dst")
sql("runtime_entry", "symbols", "SELECT qname, @GROUP(qname, '([^.]*)$') IN ('main') OR @GROUP(qname, '(__[a-z]+__)$') <> '' AS is_entry FROM symbols")
# Categories that say little unless they stand alone.
sql("low_signal_effect", "effects", "SELECT symbol_id, effect, low AND n > 1 AS hidden FROM (SELECT symbol_id, effect, effect IN ('throws', 'rand', 'log', 'pure', 'time.read', 'time.sleep') AS low, count(*) OVER (PARTITION BY symbol_id) AS n FROM effects) AS e")




sql("exclude_languages", "symbols", "SELECT qname FROM symbols WHERE lower(upper(language)) NOT IN ('rust', 'python')")


sql("scratch_filter", "events", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 7 AND ts + INTERVAL 20 DAY >= TIMESTAMP '2024-02-01 00:00:00'")
sql("scratch_clean", "events", "SELECT event_id FROM events WHERE event_type IN ('error', 'signup') AND ts < TIMESTAMP '2024-02-01 00:00:00' - INTERVAL 14 DAY")
sql("brief_projection", "symbols", "SELECT qname, concat(file, ':', start_line) AS place_in_file, signature, split_part(coalesce(doc, ''), '.', 1) AS first_line FROM symbols")
sql("brief_read", "symbols effects", "SELECT s.qname, concat(s.file, ':', s.start_line) AS at, coalesce(e.n, 0) AS n_effects FROM symbols s LEFT JOIN (SELECT symbol_id, count(*) AS n FROM effects GROUP BY symbol_id) e ON e.symbol_id = s.symbol_id")
sql("exact_symbol_exists", "symbols", "SELECT w.name, max(CASE WHEN lower(s.qname) = w.name OR lower(s.qname) LIKE concat('%.', w.name) THEN 1 ELSE 0 END) AS found FROM (SELECT 'small_ring_0' AS name UNION ALL SELECT 'red_widget_1' AS name UNION ALL SELECT 'nothing_here' AS name) AS w CROSS JOIN symbols s GROUP BY w.name")
sql("is_doc_path", "symbols", "SELECT DISTINCT file, file LIKE 'docs/%' OR lower(file) LIKE '%readme%' OR lower(file) LIKE '%license%' AS is_doc FROM symbols")
sql("watch_filter", "symbols", "SELECT DISTINCT file, @GROUP(file, '[.](py|ts|rs|go|java)$') <> '' AND file NOT LIKE 'tests/%' AS watched FROM symbols")
sql("test_command", "symbols", f"SELECT DISTINCT file, CASE WHEN NOT {TEST} THEN NULL WHEN file LIKE '%.py' THEN concat('pytest ', file) WHEN file LIKE '%.ts' THEN concat('npx vitest run ', file) WHEN file LIKE '%.rs' THEN 'cargo test' END AS command FROM symbols")
# words of a stem are cut at _, - and dots: it is in lower case before it is cut
WORDS_S = f"filter(split(lower({STEM}), '[_.-]+'), w -> w <> '')"
WORDS_D = f"list_filter(regexp_split_to_array(lower({STEM}), '[_.-]+'), lambda w: w <> '')"
MOVED = "replace(replace(replace(file, '/Sources/', '/Tests/'), '/Source/', '/Tests/'), '/src/', '/tests/')"
PROPOSED = f"concat(CASE WHEN {MOVED} <> file THEN @SUB({MOVED}, '/[^/]*$', '') ELSE 'Tests' END, '/', {STEM}, 'Tests.', @GROUP(file, '[.]([^./]*)$'))"
sql("propose_test_path", "symbols paths", f"SELECT file, {PROPOSED} AS test_path FROM ({ALL_FILES}) AS f")
sql("test_role", "symbols", f"SELECT DISTINCT file, CASE WHEN {TEST} AND file LIKE '%brand1%' THEN 'diagnostic-test' WHEN {TEST} THEN 'fast-test' END AS role FROM symbols")
sql("default_name", "pages", "SELECT page_id, @SUB(lower(@GROUP(url, '^https?://([^/?#]+)')), '[^a-z0-9_-]+', '-') AS name FROM pages")
sql("clean_path", "symbols", "SELECT DISTINCT file, @SUB(@SUB(file, '[^A-Za-z0-9._-]+', '_'), '^_+', '') AS clean FROM symbols")
sql("snake_case", "symbols", "SELECT part, lower(regexp_replace(replace(initcap(replace(split_part(qname, '.', 3), '_', ' ')), ' ', ''), '([a-z0-9])([A-Z])', '$1_$2')) AS snake FROM symbols",
    "SELECT part, lower(regexp_replace(array_to_string(list_transform(string_split(split_part(qname, '.', 3), '_'), lambda w: upper(w[1]) || lower(w[2:])), ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake FROM symbols")
sql("pascal_case", "symbols", "SELECT part, array_join(transform(split(split_part(qname, '.', 3), '[_-]'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '') AS pascal FROM symbols",
    "SELECT part, array_to_string(list_transform(string_split_regex(split_part(qname, '.', 3), '[_-]'), lambda w: upper(w[1]) || w[2:]), '') AS pascal FROM symbols")
# a word begins after a small letter or digit, and before the last capital of a run that goes on in small letters
def camel(x: str, duck: bool) -> str:
    one, two = ("\\1", "\\2") if duck else ("$1", "$2")
    every = ", 'g'" if duck else ""
    return f"regexp_replace(regexp_replace({x}, '([a-z0-9])([A-Z])', '{one} {two}'{every}), '([A-Z])([A-Z][a-z])', '{one} {two}'{every})"


sql("split_camel", "names", f"SELECT part, split({camel('ident', False)}, ' ') AS words FROM names", f"SELECT part, string_split({camel('ident', True)}, ' ') AS words FROM names")
SEG_S = f"flatten(transform(split(ident, '[.]'), s -> concat(array(lower(s)), filter(transform(split({camel('s', False)}, ' '), w -> lower(w)), w -> length(w) >= 2))))"
SEG_D = f"flatten(list_transform(string_split(ident, '.'), lambda s: list_concat([lower(s)], list_filter(list_transform(string_split({camel('s', True)}, ' '), lambda w: lower(w)), lambda w: length(w) >= 2))))"
# only neighbours that are equal are left out
NEXT_S = "array_join(element_at(transform(array({0}), a -> filter(a, (x, i) -> i = 0 OR x <> get(a, i - 1))), 1), ' ')"
NEXT_D = "array_to_string(list_filter({0}, lambda x, i: i = 1 OR x <> {0}[i - 1]), ' ')"
sql("expand_identifier", "names", f"SELECT part, {NEXT_S.format('parts')} AS expanded FROM (SELECT part, concat(array(ident), {SEG_S}) AS parts FROM names) AS n", f"SELECT part, {NEXT_D.format('parts')} AS expanded FROM (SELECT part, list_concat([ident], {SEG_D}) AS parts FROM names) AS n")
CUT_S = f"flatten(transform(filter(split(text, '[^\\\\p{{L}}\\\\p{{N}}]+'), t -> octet_length(t) >= 2), t -> concat(array(lower(t)), filter(transform(split({camel('t', False)}, ' '), w -> lower(w)), w -> octet_length(w) >= 2))))"
CUT_D = f"flatten(list_transform(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) >= 2), lambda t: list_concat([lower(t)], list_filter(list_transform(string_split({camel('t', True)}, ' '), lambda w: lower(w)), lambda w: strlen(w) >= 2))))"
sql("expand_text", "conversations", f"SELECT conv_id, turn, {NEXT_S.format('parts')} AS expanded FROM (SELECT conv_id, turn, concat(array(text), {CUT_S}) AS parts FROM conversations) AS n", f"SELECT conv_id, turn, {NEXT_D.format('parts')} AS expanded FROM (SELECT conv_id, turn, list_concat([text], {CUT_D}) AS parts FROM conversations) AS n")
# every capital but the first letter begins a token here
LAST = "@GROUP(ident, '([^.:]*)$')"
sql("name_tokens", "names", f"SELECT part, array_join(array_sort(array_distinct(filter(split(lower(@SUB({LAST}, '([A-Z])', '_$1')), '_'), w -> length(w) > 2 AND w NOT IN ({STOP})))), ' ') AS tokens FROM names",
    f"SELECT part, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(@SUB({LAST}, '([A-Z])', '_\\1')), '_'), lambda w: length(w) > 2 AND w NOT IN ({STOP})))), ' ') AS tokens FROM names")
TOK_S = f"filter(transform(split(title, '[\\\\s_.-]+'), w -> lower(w)), w -> length(w) >= 2 AND w NOT IN ({STOP}))"
TOK_D = f"list_filter(list_transform(regexp_split_to_array(title, '[\\s_.-]+'), lambda w: lower(w)), lambda w: length(w) >= 2 AND w NOT IN ({STOP}))"
sql("query_tokenize", "docs", f"SELECT doc_id, array_join({TOK_S}, ' ') AS tokens FROM docs", f"SELECT doc_id, array_to_string({TOK_D}, ' ') AS tokens FROM docs")
sql("stopword_filter", "docs", f"SELECT w, count(*) AS n, w IN ({STOP}) AS is_stop FROM (SELECT explode(split(lower(title), ' ')) AS w FROM docs) AS t GROUP BY w", f"SELECT w, count(*) AS n, w IN ({STOP}) AS is_stop FROM (SELECT unnest(string_split(lower(title), ' ')) AS w FROM docs) AS t GROUP BY w")
Q_S, Q_D = "split(concat(lower(title), ' -legacy -old'), ' ')", "string_split(concat(lower(title), ' -legacy -old'), ' ')"
sql("parse_query", "docs", f"SELECT doc_id, cast(size(filter({Q_S}, w -> NOT startswith(w, '-') AND w <> '')) AS BIGINT) AS n_tokens, array_join(filter({Q_S}, w -> startswith(w, '-') AND length(w) > 1), ' ') AS exclusions FROM docs",
    f"SELECT doc_id, len(list_filter({Q_D}, lambda w: NOT starts_with(w, '-') AND w <> '')) AS n_tokens, array_to_string(list_filter({Q_D}, lambda w: starts_with(w, '-') AND length(w) > 1), ' ') AS exclusions FROM docs")
sql("fb_tokens", "feedback", f"SELECT DISTINCT query, array_join(array_distinct(filter(split(lower(query), '[^a-z]+'), w -> length(w) > 2 AND w NOT IN ({STOP}))), ' ') AS tokens FROM feedback",
    f"SELECT DISTINCT query, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^a-z]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})), ' ') AS tokens FROM feedback")
sql("identifier_words", "names", f"SELECT part, array_join(filter(split(@SUB({LAST}, '([A-Z])', '_$1'), '[_-]'), w -> length(w) > 1), ' ') AS words FROM names", f"SELECT part, array_to_string(list_filter(string_split_regex(@SUB({LAST}, '([A-Z])', '_\\1'), '[_-]'), lambda w: length(w) > 1), ' ') AS words FROM names")
INSIDE = "@GROUP(signature, '[(](.*)[)]')"
sql("parse_params", "symbols", f"SELECT symbol_id, array_join(filter(transform(split({INSIDE}, ','), p -> trim(split_part(p, ':', 1))), p -> p NOT IN ('self', 'cls') AND NOT startswith(p, '*')), ',') AS params FROM symbols",
    f"SELECT symbol_id, array_to_string(list_filter(list_transform(string_split({INSIDE}, ','), lambda p: trim(split_part(p, ':', 1))), lambda p: p NOT IN ('self', 'cls') AND NOT starts_with(p, '*')), ',') AS params FROM symbols")
sql("sig_param_names", "symbols", f"SELECT symbol_id, array_join(transform(split({INSIDE}, ','), p -> trim(split_part(p, ':', 1))), ',') AS names FROM symbols", f"SELECT symbol_id, array_to_string(list_transform(string_split({INSIDE}, ','), lambda p: trim(split_part(p, ':', 1))), ',') AS names FROM symbols")
sql("extract_summary", "symbols", "SELECT symbol_id, coalesce(split_part(doc, '.', 1), substring(signature, 1, 100)) AS summary FROM symbols")
FIRST_S = "filter(split(text, '\\n'), l -> trim(l) <> '')"
FIRST_D = "list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')"
sql("first_line", "conversations", f"SELECT conv_id, turn, substring(coalesce(try_element_at({FIRST_S}, 1), text), 1, 140) AS first_line FROM conversations",
    f"SELECT conv_id, turn, substring(coalesce({FIRST_D}[1], text), 1, 140) AS first_line FROM conversations")
# Words of a rule, in the order in which they are tried, and what a scenario for it does and expects.
SCENARIOS = (
    ("must not|never|cannot|forbidden", "Trigger conditions that would violate: {s}", "System rejects or prevents the violation — «{t}» holds"),
    ("must|shall|always", "Exercise the happy path for: {s}", "Observe that «{t}» is satisfied after execution"),
    ("ensure|guarantee", "Run the scenario that exercises: {s}", "Post-condition confirmed: «{t}»"),
    ("require", "Attempt to call without satisfying the precondition for: {s}", "Guard fires or error raised before violating «{t}»"),
    ("only|prevent", "Attempt a bypass around: {s}", "Prevention still enforced — «{t}»"),
    ("", "Verify the observable behaviour of: {s}", "Constraint «{t}» holds after the change"),
)
SKIP = "the a an this that it must never cannot shall always only not no should will would is are be been require ensure prevent guarantee invariant".split()
SKIPPED = ", ".join(f"'{w}'" for w in SKIP)
RULE = "concat(CASE entry_seq % 7 WHEN 0 THEN 'It must not be that ' WHEN 1 THEN 'Always: ' WHEN 2 THEN 'Ensure ' WHEN 3 THEN 'We require ' WHEN 4 THEN 'Only ' WHEN 5 THEN 'The ' ELSE 'is not ' END, summary, ' of a ', author)"
RULES_OF = f"SELECT entry_id, {RULE} AS rule FROM (SELECT entry_id, seq AS entry_seq, summary, author FROM live WHERE kind = 'invariant') AS l"


def _case(part: int, subject: str) -> str:
    out = "CASE"
    for words, *texts in SCENARIOS:
        head, tail = texts[part].replace("{s}", "{t}").split("{t}")
        text = f"concat('{head}', {subject if part == 0 else 'rule'}, '{tail}')"
        out += f" WHEN {found('lower(rule)', words)} THEN {text}" if words else f" ELSE {text} END"
    return out


SUBJECT_S = f"array_join(slice(filter(split(trim(rule), ' +'), w -> @SUB(lower(w), '[^a-z]', '') NOT IN ({SKIPPED})), 1, 5), ' ')"
SUBJECT_D = f"array_to_string(list_filter(regexp_split_to_array(trim(rule), ' +'), lambda w: @SUB(lower(w), '[^a-z]', '') NOT IN ({SKIPPED}))[1:5], ' ')"
sql("extract_subject", "benchmark", f"SELECT item_id, {SUBJECT_S} AS subject FROM (SELECT item_id, text AS rule FROM benchmark) AS b", f"SELECT item_id, {SUBJECT_D} AS subject FROM (SELECT item_id, text AS rule FROM benchmark) AS b")
SCENARIO = f"SELECT entry_id, {_case(0, 'subject')} AS step, {_case(1, 'subject')} AS expected FROM (SELECT entry_id, rule, coalesce(nullif(SUBJECT, ''), rule) AS subject FROM ({RULES_OF}) AS r) AS s"
sql("invariant_to_scenario", "live", SCENARIO.replace("SUBJECT", SUBJECT_S), SCENARIO.replace("SUBJECT", SUBJECT_D))
sql("intent_order", "symbols", f"SELECT layer, CASE layer WHEN 'ui' THEN 1 WHEN 'viewmodel' THEN 2 WHEN 'core_model' THEN 3 WHEN 'scheduler' THEN 4 WHEN 'persistence' THEN 5 WHEN 'utility' THEN 6 WHEN 'tests' THEN 7 ELSE 8 END AS priority, count(*) AS n FROM (SELECT {LAYER} AS layer FROM symbols) AS s GROUP BY layer")
# What a test to fill in looks like in each language; {s} is the name in snake case, {p} in Pascal case.
STUBS = {
    "py": 'def test_{s}():\n    # arrange\n    # act\n    # assert\n    raise NotImplementedError("test_{s}: fill in")\n',
    "ts": "test('{s}', () => {\n  // arrange\n  // act\n  // assert\n  throw new Error('test {s}: fill in');\n});\n",
    "rs": '#[test]\nfn {s}() {\n    // arrange\n    // act\n    // assert\n    todo!("{s}: fill in");\n}\n',
    "go": 'func Test{p}(t *testing.T) {\n    // arrange\n    // act\n    // assert\n    t.Fatal("Test{p}: fill in")\n}\n',
    "java": '@Test\npublic void test{p}() {\n    // arrange\n    // act\n    // assert\n    fail("test{p}: fill in");\n}\n',
    "cs": '[Test]\npublic void {p}_Should() {\n    // arrange\n    // act\n    // assert\n    Assert.Fail("{p}_Should: fill in");\n}\n',
    "rb": 'def test_{s}\n  # arrange\n  # act\n  # assert\n  flunk("test_{s}: fill in")\nend\n',
    "kt": '@Test\nfun `{s}`() {\n    // arrange\n    // act\n    // assert\n    fail("{s}: fill in")\n}\n',
    "swift": 'func test{p}() throws {\n    // arrange\n    // act\n    // assert\n    XCTFail("test{p}: fill in")\n}\n',
}
SNAKE = {False: "lower(@SUB(@GROUP(ident, '([^.]*)$'), '([a-z0-9])([A-Z])', '$1_$2'))", True: "lower(@SUB(@GROUP(ident, '([^.]*)$'), '([a-z0-9])([A-Z])', '\\1_\\2'))"}
PASCAL = {
    False: "array_join(transform(split(@GROUP(ident, '([^.]*)$'), '[_-]'), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')",
    True: "array_to_string(list_transform(string_split_regex(@GROUP(ident, '([^.]*)$'), '[_-]'), lambda w: concat(upper(substring(w, 1, 1)), substring(w, 2))), '')",
}


def _stubs(duck: bool) -> str:
    extensions = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(STUBS))
    rows = f"SELECT part, CASE part % 9 {extensions} END AS extension, {SNAKE[duck]} AS snake, {PASCAL[duck]} AS pascal FROM names"
    # quotes are doubled and new lines named, as both dialects read them in literals
    literal = lambda t: "concat('" + t.replace("'", "''").replace("\n", "', chr(10), '") + "')" if duck else "concat('" + t.replace("'", "\\'").replace("\n", "', chr(10), '") + "')"
    stub = "CASE extension " + " ".join(f"WHEN '{x}' THEN {literal(t)}" for x, t in STUBS.items()) + " END"
    return f"SELECT part, extension, replace(replace({stub}, '{{s}}', snake), '{{p}}', pascal) AS stub FROM ({rows}) AS n"


sql("test_stub", "names", _stubs(False), _stubs(True))
sql("effect_badge", "effects events", "SELECT e.symbol_id, e.effect, CASE WHEN c.no > c.yes THEN 'contested' WHEN c.yes > 0 THEN 'runtime-verified' ELSE 'static' END AS badge FROM effects e LEFT JOIN (SELECT concat('sym_', user_id) AS s, count(CASE WHEN value < 10 THEN 1 END) AS yes, count(CASE WHEN value > 40 THEN 1 END) AS no FROM events GROUP BY 1) c ON c.s = e.symbol_id")
FIRST_SENTENCE = "trim(split_part(trim(split_part(coalesce(doc, ''), chr(10), 1)), '.', 1))"
LEAF = "@GROUP(qname, '([^.:/]*)$')"
PARAMS_S = "filter(transform(split(@GROUP(signature, '[(](.*)[)]'), ','), p -> trim(split_part(p, ':', 1))), p -> p NOT IN ('self', 'cls', ''))"
PARAMS_D = "list_filter(list_transform(string_split(@GROUP(signature, '[(](.*)[)]'), ','), lambda p: trim(split_part(p, ':', 1))), lambda p: p NOT IN ('self', 'cls', ''))"
LEAVES_S, LEAVES_D = f"filter(split({LEAF}, '[_-]'), w -> length(w) > 1)", f"list_filter(string_split_regex({LEAF}, '[_-]'), lambda w: length(w) > 1)"
HINTS = """SELECT symbol_id, concat_ws('; ', CASE WHEN length(sentence) > 12 THEN concat('verify: ', lower(sentence)) END,
  CASE WHEN n >= 2 THEN concat('verify ', lower(words), ' behavior') WHEN n = 1 AND length(sentence) <= 12 THEN concat('verify ', lower(words), ' is correct') END,
  CASE WHEN k BETWEEN 1 AND 4 THEN concat('verify effect of ', params, ' on output') END) AS hints FROM (ROWS) AS h"""
sql("cold_hints", "symbols", HINTS.replace("ROWS", f"SELECT symbol_id, {FIRST_SENTENCE} AS sentence, size({LEAVES_S}) AS n, array_join({LEAVES_S}, ' ') AS words, size({PARAMS_S}) AS k, array_join({PARAMS_S}, ', ') AS params FROM symbols"),
    HINTS.replace("ROWS", f"SELECT symbol_id, {FIRST_SENTENCE} AS sentence, len({LEAVES_D}) AS n, array_to_string({LEAVES_D}, ' ') AS words, len({PARAMS_D}) AS k, array_to_string({PARAMS_D}, ', ') AS params FROM symbols"))
NOTES = "SELECT symbol_id, count(CASE WHEN kind = 'invariant' THEN 1 END) AS inv, count(CASE WHEN kind = 'hazard' THEN 1 END) AS haz, min(CASE WHEN kind = 'ownership' THEN summary END) AS owns, count(*) AS n FROM live GROUP BY symbol_id"
HOT = "SELECT DISTINCT concat('sym_', l_partkey) AS symbol_id, 1 AS hot FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 49"
HAS = {k: f"contains(concat(' ', reasons), ' {k}:')" for k in ("name", "file", "sig", "doc", "invariant-attached", "ledger", "ownership")}
LABEL = f"""CASE WHEN {HAS['name']} AND {HAS['invariant-attached']} THEN 'strong: name match + invariant-attached' WHEN {HAS['name']} AND {HAS['ownership']} THEN 'strong: name match + ownership declaration'
  WHEN {HAS['name']} AND {HAS['ledger']} THEN 'strong: name match + hazard ledger entry' WHEN {HAS['name']} AND has_ledger THEN 'strong: name match + ledger entry' WHEN {HAS['name']} AND is_hot THEN 'moderate: name match + recently edited' WHEN {HAS['name']} THEN 'moderate: name match only'
  WHEN has_ledger AND {HAS['sig']} THEN 'moderate: signature match + ledger entry' WHEN has_ledger THEN 'moderate: ledger entry (indirect match)' WHEN {HAS['sig']} THEN 'weak: signature match only' WHEN {HAS['doc']} THEN 'weak: doc-only match' WHEN {HAS['file']} THEN 'weak: file path match only' ELSE 'weak: low-signal indirect match' END"""
sql("route_decorators", "pages", "SELECT page_id, upper(@GROUP(line, '^@[a-z]+[.]([a-z]+)[(]')) AS method, @GROUP(line, '[(].([^)]*).[)]') AS path FROM (SELECT page_id, concat('@app.', CASE page_id % 3 WHEN 0 THEN 'get' WHEN 1 THEN 'post' ELSE 'delete' END, '(/items/', page_id, '/)') AS line FROM pages) AS p")
sql("client_calls", "pages", "SELECT page_id, upper(@GROUP(line, 'requests[.]([a-z]+)[(]')) AS method, @GROUP(line, '(https?://[^) ]+)') AS url FROM (SELECT page_id, concat('r = requests.', CASE page_id % 2 WHEN 0 THEN 'get' ELSE 'put' END, '(', url, ' )') AS line FROM pages) AS p")
sql("celery_emits", "events", "SELECT event_id, concat('topic:', @GROUP(line, '^([a-z_]+)[.](delay|apply_async)[(]')) AS topic FROM (SELECT event_id, concat(event_type, CASE event_id % 2 WHEN 0 THEN '.delay(' ELSE '.apply_async(' END, user_id, ')') AS line FROM events) AS e")
# one dot is the package of the module, each further one the package above; too many dots name nothing
RAW = "CASE p_partkey % 5 WHEN 0 THEN '.' WHEN 1 THEN '.base' WHEN 2 THEN '..util.text' WHEN 3 THEN '....' ELSE 'json' END"
MODULES = f"SELECT p_partkey AS part, concat(lower(p_type), '.', replace(p_brand, '#', ''), '.', replace(p_name, ' ', '_')) AS module, {RAW} AS raw FROM part"
DOTS = "length(raw) - length(ltrim(raw, '.'))"
sql("relative_import", "part", f"SELECT part, module, raw, CASE WHEN d = 0 OR d > size(parts) THEN NULL ELSE nullif(array_join(filter(concat(slice(parts, 1, size(parts) - d), array(rest)), x -> x <> ''), '.'), '') END AS absolute FROM (SELECT part, module, raw, length(raw) - length(ltrim('.', raw)) AS d, ltrim('.', raw) AS rest, split(module, '[.]') AS parts FROM ({MODULES}) AS m) AS r",
    f"SELECT part, module, raw, CASE WHEN d = 0 OR d > len(parts) THEN NULL ELSE nullif(array_to_string(list_filter(list_concat(parts[1:len(parts) - d], [rest]), lambda x: x <> ''), '.'), '') END AS absolute FROM (SELECT part, module, raw, {DOTS} AS d, ltrim(raw, '.') AS rest, string_split(module, '.') AS parts FROM ({MODULES}) AS m) AS r")
sql("dynamic_dispatch", "conversations", "SELECT conv_id, turn, text LIKE '%que%' AS dynamic FROM conversations")
sql("disambiguate", "symbols", "SELECT symbol_id, CASE WHEN count(*) OVER (PARTITION BY file, split_part(split_part(qname, '.', 3), '_', 1)) > 1 THEN concat(split_part(split_part(qname, '.', 3), '_', 1), ':', start_line) ELSE split_part(split_part(qname, '.', 3), '_', 1) END AS name FROM symbols")

# The commonest calls of each language that read files, write them, go out to the network, start a process, read the environment.
CALLS = {
    "": ["open(", "os.open(", "io.open(", "os.write(", "os.remove(", "os.rename(", "requests.", "urllib.", "httpx.", "subprocess.", "os.system(", "os.exec", "os.environ", "os.getenv", "os.putenv"],
    "_ts": ["fs.readFile(", "fs.readFileSync(", "fs.open(", "fs.writeFile(", "fs.unlink(", "fs.rename(", "fetch(", "axios.", "https.get(", "child_process.exec", "spawn(", "execFile(", "process.env.", "process.env[", "process.env)"],
    "_rs": ["fs::read(", "File::open(", "fs::read_dir(", "fs::write(", "File::create(", "fs::rename(", "reqwest::", "hyper::", "ureq::", "Command::new(", "std::process::", "process::exit(", "env::var(", "env::args(", "std::env::"],
    "_go": ["os.Open(", "os.ReadFile(", "os.ReadDir(", "os.Create(", "os.WriteFile(", "os.Remove(", "http.Get(", "http.Post(", "net.Dial(", "exec.Command(", "exec.CommandContext(", "os.StartProcess(", "os.Getenv(", "os.LookupEnv(", "os.Environ("],
    "_java": ["new FileReader(", "Files.readAllBytes(", "Files.lines(", "new FileWriter(", "Files.write(", "Files.createFile(", "HttpURLConnection", "OkHttpClient", "RestTemplate(", "Runtime.getRuntime().exec(", "new ProcessBuilder(", "ProcessBuilder(", "System.getenv(", "System.getProperties(", "System.getenv()"],
    "_cs": ["File.ReadAll", "File.OpenRead(", "new StreamReader(", "File.WriteAll", "File.AppendAll", "new StreamWriter(", "new HttpClient(", "client.GetAsync(", "client.PostAsync(", "Process.Start(", "new Process(", "ProcessStartInfo(", "Environment.GetEnvironmentVariable(", "Environment.GetEnvironmentVariables(", "Environment.GetCommandLineArgs("],
    "_rb": ["File.read(", "File.readlines(", "CSV.read(", "File.write(", "FileUtils.rm", "File.rename(", "Net::HTTP", "Faraday.get(", "HTTParty.post(", "system(", "IO.popen(", "Open3.", "ENV[", "ENV.fetch(", "ENV.key?("],
    "_kt": [".readText(", ".readLines(", "FileReader(", ".writeText(", ".appendText(", "FileWriter(", "OkHttpClient(", "HttpClient(", "client.get(", "ProcessBuilder(", "Runtime.getRuntime().exec(", "ProcessBuilder.start(", "System.getenv(", "System.getProperty(", "dotenv["],
    "_sw": ["FileManager.default", "String(contentsOf:", "Data(contentsOf:", "write(to:", "createFile(atPath:", "removeItem(", "URLSession.", "dataTask(with:", "URLRequest(", "Process(", "Process.launchedProcess(", "NSTask(", "ProcessInfo.processInfo.environment", "getenv(", "ProcessInfo.processInfo.arguments"],
}
CATEGORIES = ["fs.read", "fs.write", "net.out", "process.spawn", "env.read"]


def _effects(suffix: str) -> None:
    """Effects of every symbol's body: each line calls something of its language, or says so in a comment, which Python's rules pass over."""
    rows = ", ".join(f"({i}, '{CATEGORIES[i // 3]}', '{c}')" for i, c in enumerate(CALLS[suffix]))
    calls = f"SELECT * FROM (VALUES {rows}) AS v(i, effect, needle)"
    comment, kept = ("#", "@SUB(body, '#[^@N]*', '')") if not suffix else ("//", "body")
    body = f"concat('begin', chr(10), '  a = ', x.needle, ' 1)', chr(10), CASE WHEN p.p_size % 4 = 0 THEN '  {comment} ' ELSE '  ' END, y.needle, ' 2)', chr(10), 'end')"
    bodies = f"SELECT concat('sym_', p.p_partkey) AS symbol_id, {body} AS body FROM part p JOIN ({calls}) AS x ON x.i = p.p_size % 15 JOIN ({calls}) AS y ON y.i = (p.p_partkey * 7 + p.p_size) % 15"
    text = f"SELECT b.symbol_id, c.effect, count(*) AS n, min(c.needle) AS note FROM (SELECT symbol_id, {kept} AS scan FROM ({bodies}) AS s) AS b JOIN ({calls}) AS c ON contains(b.scan, c.needle) GROUP BY b.symbol_id, c.effect"
    sql(f"effect_inference{suffix}", "part", text.replace("@N", "\\n"), text.replace("@N", "\n"))


for _suffix in CALLS:
    _effects(_suffix)

# A glob as a pattern, segment by segment: ** is any number of segments, * stays within one, all else is literal.
# Names of scopes and of sets to leave out stand for globs; an unknown scope is a glob itself, an unknown set is empty.
GLOBS = "SELECT * FROM (VALUES ('views/*/brand1*'), ('**/brand1.py'), ('views/**'), ('storage/*/*.py'), ('models/**/brand?.ts'), ('**'), ('tests/**/*2*'), ('src/economy/brand3.rs'), ('scheduler/**')) AS g(pat)"
SCOPES = "SELECT * FROM (VALUES ('ui', 'views/**'), ('ui', 'viewmodels/**'), ('core', 'models/**')) AS a(alias, pat)"
SETS = "SELECT * FROM (VALUES ('generated', 'samples/**'), ('generated', '**/brand2.*')) AS a(alias, pat)"
QUOTED = "@SUB(pat, '([.+?^$()|{}])', '@ONE')"
PATTERN = f"concat('^', @SUB(replace(@SUB(@SUB(@SUB(@SUB({QUOTED}, '^[*][*]$', '<W>'), '/[*][*]$', '<Z>'), '^[*][*]/', '<A>'), '/[*][*]/', '/<A>'), '*', '[^/]*'), '<A>', '([^/]+/)*'), '$')"


def _globbed(text: str, duck: bool) -> str:
    """The two dialects name a group and a match differently; <Z> is anything below a folder or the folder, <W> is all."""
    pattern = f"replace(replace({PATTERN}, '<Z>', '(/.*)?'), '<W>', '.*')".replace("@ONE", "\\\\\\1" if duck else "\\\\\\\\$1")
    return text.replace("@PATTERN", pattern).replace("@MATCH", "regexp_matches" if duck else "regexp_like")


def _glob(name: str, tables: str, text: str) -> None:
    sql(name, tables, _globbed(text, False), _globbed(text, True))


FILES = "SELECT DISTINCT file FROM symbols"
_glob("glob_match", "symbols", f"SELECT f.file, g.pat, @MATCH(f.file, g.pattern) AS matches FROM ({FILES}) AS f CROSS JOIN (SELECT pat, @PATTERN AS pattern FROM ({GLOBS}) AS g) AS g")
_glob("glob_any", "symbols", f"SELECT f.file, max(CASE WHEN @MATCH(f.file, g.pattern) THEN 1 ELSE 0 END) = 1 AS matches FROM ({FILES}) AS f CROSS JOIN (SELECT @PATTERN AS pattern FROM ({GLOBS}) AS g WHERE pat LIKE 's%') AS g GROUP BY f.file")
CHOSEN = f"SELECT @PATTERN AS pattern FROM ({GLOBS}) AS g WHERE pat LIKE '%/**'"
SCORED = "SELECT DISTINCT concat('sym_', user_id * 20) AS symbol_id FROM events"
ANY = f"SELECT f.file FROM ({FILES}) AS f CROSS JOIN ({CHOSEN}) AS g GROUP BY f.file HAVING max(CASE WHEN @MATCH(f.file, g.pattern) THEN 1 ELSE 0 END) = 1"
_glob("paths_filter", "symbols events", f"SELECT c.symbol_id, s.file FROM ({SCORED}) AS c LEFT JOIN symbols s ON s.symbol_id = c.symbol_id LEFT JOIN ({ANY}) AS a ON a.file = s.file WHERE s.file IS NULL OR a.file IS NOT NULL")
_glob("exclude_paths", "symbols events", f"SELECT c.symbol_id, s.file FROM ({SCORED}) AS c LEFT JOIN symbols s ON s.symbol_id = c.symbol_id LEFT JOIN ({ANY}) AS a ON a.file = s.file WHERE s.file IS NULL OR a.file IS NULL")
ASKED = "SELECT * FROM (VALUES ('ui'), ('core'), ('generated'), ('storage/**')) AS w(alias)"
NAMED = "SELECT alias, count(DISTINCT file) AS n FROM (SELECT w.alias, f.file FROM ({asked}) AS w CROSS JOIN (" + FILES + ") AS f LEFT JOIN (SELECT alias, @PATTERN AS pattern FROM ({globs}) AS g) AS g ON g.alias = w.alias WHERE @MATCH(f.file, g.pattern)) AS m GROUP BY alias"
_glob("scope_alias", "symbols", NAMED.format(asked=ASKED, globs=f"{SCOPES} UNION ALL SELECT alias, alias AS pat FROM ({ASKED}) AS w WHERE alias NOT IN (SELECT alias FROM ({SCOPES}) AS s)"))
_glob("exclude_set", "symbols", f"SELECT w.alias, count(CASE WHEN m.file IS NULL THEN 1 END) AS n FROM ({ASKED}) AS w CROSS JOIN ({FILES}) AS f LEFT JOIN (SELECT DISTINCT g.alias, f.file FROM (SELECT alias, @PATTERN AS pattern FROM ({SETS}) AS g) AS g CROSS JOIN ({FILES}) AS f WHERE @MATCH(f.file, g.pattern)) AS m ON m.alias = w.alias AND m.file = f.file GROUP BY w.alias")
