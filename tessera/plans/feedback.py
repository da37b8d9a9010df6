"""Scores of symbols for queries, feedback on them, penalties by glob, and the tests of source files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers, feedback, globs, index
from ..operators.contain import contained, needles_in
from ..registry import query
from ..shared import saved
from ..sources.crosswalk import NOW, frame, over, with_ctes
from . import predicates
from .predicates import STOP, STOPWORDS, TEST
from .search import TOKENS_D, tokens

# What a word in a name, signature, doc, ledger summary or path counts.
POINTS = {"qname": 4, "signature": 3, "doc": 3, "ledger": 2, "file": 1}


def matched(code: DataFrame, live: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, at, term, symbol_id, field): the words of queries that stand within a symbol's texts or in what the ledger says of it."""
    own = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lower(f).alias("hay")) for f in POINTS if f != "ledger")))
    texts = code.select("symbol_id", own.alias("t")).select("symbol_id", "t.*")
    texts = texts.unionByName(live.select("symbol_id", F.lit("ledger").alias("field"), F.lower("summary").alias("hay")))
    pairs = contained(asked.select("term"), texts.select("hay"))
    return asked.join(pairs, F.col("term") == F.col("needle")).select("query", "at", "term", "hay").join(texts, "hay").select("query", "at", "term", "symbol_id", "field").distinct()


FIELDS = [f for f in POINTS if f != "ledger"]
LEDGER = 1 << len(FIELDS)
#: What a mask is worth.
WORTH = [sum(n for i, n in enumerate([*(POINTS[f] for f in FIELDS), POINTS["ledger"]]) if mask >> i & 1) for mask in range(2 * LEDGER)]


def held(code: DataFrame, live: DataFrame, asked: DataFrame) -> DataFrame:
    """(symbol_id, held, own): the words of queries within a symbol's texts (a bit for each of FIELDS) or within what the ledger says of it, and the newest note of its owner that holds each."""
    terms = saved(asked.select("term").distinct(), "terms")
    code, live = answers.dealt(code, "symbol_id"), answers.dealt(live, "symbol_id")
    texts = needles_in(code.select("symbol_id", *FIELDS), [F.lower(f) for f in FIELDS], terms).select("symbol_id", "needle", "mask")
    owner = F.when(F.col("kind") == "ownership", F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "entry_id", "summary")) if "created_at" in live.columns else F.lit(None).cast("struct<t: bigint, entry_id: string, summary: string>")
    said = needles_in(live, [F.lower("summary")], terms).select("symbol_id", "needle", F.lit(LEDGER).alias("mask"), owner.alias("own"))
    return answers.gathered(texts.withColumn("own", F.lit(None).cast(said.schema["own"].dataType)).unionByName(said), "symbol_id", ["own"])


def scored(code: DataFrame, live: DataFrame, asked: DataFrame, of_symbols: DataFrame | None = None, of_queries: DataFrame | None = None, key: str = "file") -> DataFrame:
    """(query, symbol_id, qname, file, kind, score): symbols with a word of a query within one of their texts; with the further columns of files (or symbols, by `key`) and queries that are given."""
    symbols = code.select("symbol_id", "qname", "file", "kind").join(held(code, live, asked).drop("own"), "symbol_id")
    queries = answers.worded(asked)
    more = []
    if of_symbols is not None:
        symbols, more = symbols.join(of_symbols, key, "left"), [c for c in of_symbols.columns if c != key]
    if of_queries is not None:
        queries, more = queries.join(of_queries, "query", "left"), [*more, *(c for c in of_queries.columns if c != "query")]
    worth = F.array(*(F.lit(n) for n in WORTH))
    score = F.aggregate("masks", F.lit(0), lambda total, m: total + F.element_at(worth, m + 1))
    return answers.answered(symbols, queries).select("query", "symbol_id", "qname", "file", "kind", score.cast("double").alias("score"), *more)


def _asked(spark, sf_dir: str) -> DataFrame:
    return saved(tokens(frame(spark, sf_dir, "asks")), "asked")


def _scored(spark, sf_dir: str) -> DataFrame:
    return scored(frame(spark, sf_dir, "code"), frame(spark, sf_dir, "live"), _asked(spark, sf_dir))


USED = ["code", "live", "asks"]
SCORED = f"""tok AS ({TOKENS_D}), said AS (SELECT DISTINCT t.query, t.at, l.symbol_id FROM tok t JOIN live l ON contains(lower(l.summary), t.term)),
sc AS (SELECT * FROM (SELECT t.query, c.symbol_id, c.qname, c.file, c.kind, sum(CASE WHEN contains(lower(c.qname), t.term) THEN 4 ELSE 0 END + CASE WHEN contains(lower(c.signature), t.term) THEN 3 ELSE 0 END
    + CASE WHEN contains(lower(coalesce(c.doc, '')), t.term) THEN 3 ELSE 0 END + CASE WHEN contains(lower(c.file), t.term) THEN 1 ELSE 0 END + CASE WHEN s.symbol_id IS NOT NULL THEN 2 ELSE 0 END)::DOUBLE AS score
  FROM tok t CROSS JOIN code c LEFT JOIN said s ON s.query = t.query AND s.at = t.at AND s.symbol_id = c.symbol_id GROUP BY t.query, c.symbol_id, c.qname, c.file, c.kind) AS x WHERE score > 0)"""


@query("in_memory_score", with_ctes(USED, f"WITH {SCORED} SELECT query, qname, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, qname) AS r FROM sc) AS t WHERE r <= 20"))
def in_memory_score(spark, sf_dir):
    """The first 20 symbols for each query by the plain scorer."""
    return index.best(_scored(spark, sf_dir), 20, ["query"], [F.col("score").desc(), F.col("qname")]).select("query", "qname", "score")


FB_WORDS = f"list_distinct(list_filter(regexp_split_to_array(lower({{0}}), '[^\\p{{{{L}}}}]+'), lambda w: strlen(w) > 2 AND w NOT IN ({STOP})))".replace("{{", "{").replace("}}", "}")
NAME_WORDS = f"list_distinct(list_filter(string_split(lower(regexp_replace(regexp_extract(qname, '([^.:]*)$', 1), '(\\p{{Lu}})', '_\\1', 'g')), '_'), lambda w: strlen(w) > 2 AND w NOT IN ({STOP})))"
JUDGED = f"""{SCORED}, qs AS (SELECT DISTINCT query, {FB_WORDS.replace('{0}', 'query')} AS words FROM sc),
fb AS (SELECT *, {FB_WORDS.replace('{0}', 'query')} AS words FROM verdicts WHERE file_scope IS NULL),
hit AS (SELECT q.query AS asked, f.* FROM qs q JOIN fb f ON len(f.words) = 0 OR list_has_any(q.words, f.words)),
bad AS (SELECT h.asked, h.symbol_id, c.file, {NAME_WORDS.replace('qname', 'c.qname')} AS names FROM hit h JOIN code c ON c.symbol_id = h.symbol_id WHERE h.verdict IN ('noisy', 'wrong-layer')),
own AS (SELECT asked, symbol_id, sum(CASE WHEN verdict = 'useful' THEN 1.5::DOUBLE * CASE WHEN created_at < {NOW} THEN pow(0.5::DOUBLE, (epoch({NOW}) - floor(epoch(created_at))) / 86400.0::DOUBLE / 90.0::DOUBLE) ELSE 1::DOUBLE END ELSE 0 END) AS boost,
  bool_or(verdict = 'useful') AS useful, bool_or(verdict IN ('noisy', 'wrong-layer')) AS wrong, bool_or(verdict = 'covered') AS covered, bool_or(verdict = 'diagnostic') AS diagnostic,
  min([created_at::VARCHAR, entry_id, verdict, query, author]) AS first FROM hit GROUP BY asked, symbol_id),
again AS (SELECT symbol_id, list(word) AS words FROM (SELECT symbol_id, unnest(words) AS word FROM fb WHERE verdict IN ('noisy', 'wrong-layer')) AS w GROUP BY symbol_id, word HAVING count(*) >= 2),
rep AS (SELECT symbol_id, flatten(list(words)) AS words FROM again GROUP BY symbol_id),
sib AS (SELECT h.asked, c.file, min([h.created_at::VARCHAR, h.entry_id, h.query, h.author]) AS entry FROM hit h JOIN code c ON c.symbol_id = h.symbol_id WHERE h.verdict IN ('noisy', 'wrong-layer') GROUP BY h.asked, c.file),
j1 AS (SELECT s.*, q.words AS qwords, {NAME_WORDS} AS names FROM sc s JOIN qs q ON q.query = s.query),
j AS (SELECT j1.*, o.boost, coalesce(o.wrong, FALSE) AS wrong, coalesce(o.useful, FALSE) AS useful, coalesce(o.covered, FALSE) AS covered, coalesce(o.diagnostic, FALSE) AS diagnostic, o.first, sib.entry,
  j1.kind NOT IN ('class', 'module') AND EXISTS (SELECT 1 FROM bad b WHERE b.asked = j1.query AND b.file = j1.file AND b.symbol_id <> j1.symbol_id AND list_has_any(b.names, j1.names)) AS beside,
  list_has_any(qwords, names) AS relevant, coalesce(list_has_any(rep.words, qwords), FALSE) AS recurs
  FROM j1 LEFT JOIN own o ON o.asked = j1.query AND o.symbol_id = j1.symbol_id LEFT JOIN sib ON sib.asked = j1.query AND sib.file = j1.file LEFT JOIN rep ON rep.symbol_id = j1.symbol_id),
r AS (SELECT *, CASE WHEN beside AND NOT wrong AND NOT useful AND NOT relevant THEN 'same_file_sibling_suppression' WHEN wrong THEN 'exact_noisy' WHEN covered THEN 'already_covered' WHEN diagnostic THEN 'diagnostic_only' WHEN recurs THEN 'recurring_fp' END AS rule FROM j)"""


def _judged(spark, sf_dir: str, told: bool = False) -> DataFrame:
    """The hits with what feedback says of them; of those alone on whose symbols or their siblings there is any, if `told`."""
    code, live, asked = frame(spark, sf_dir, "code"), frame(spark, sf_dir, "live"), _asked(spark, sf_dir)
    entries = frame(spark, sf_dir, "verdicts").where("file_scope IS NULL")
    known = saved(feedback.state(entries, F.expr(NOW)), "known")
    about = saved(feedback.by_symbol(code, entries, known, code, STOPWORDS), "about")
    if told:
        spoken = about.where("said IS NOT NULL OR near IS NOT NULL").select("symbol_id")
        code, live = code.join(spoken, "symbol_id", "left_semi"), live.join(spoken, "symbol_id", "left_semi")
    return feedback.ruled(scored(code, live, asked, about, feedback.by_query(asked, known, STOPWORDS), "symbol_id"), STOPWORDS)


@query("feedback_adjust", with_ctes([*USED, "verdicts"], f"WITH {JUDGED} SELECT query, qname, round(score + coalesce(boost, 0), 6) AS score FROM r WHERE rule IS NULL"))
def feedback_adjust(spark, sf_dir):
    """The hits of each query that feedback leaves, with what it adds."""
    return _judged(spark, sf_dir).where("rule IS NULL").select("query", "qname", F.round(F.col("score") + F.col("boost"), 6).alias("score"))


@query("feedback_explain", with_ctes([*USED, "verdicts"], f"WITH {JUDGED} SELECT query, qname, rule, CASE WHEN first IS NOT NULL THEN first[3] WHEN beside THEN 'sibling_suppressed' END AS verdict, CASE WHEN first IS NOT NULL THEN first[4] ELSE entry[3] END AS matched_query, CASE WHEN first IS NOT NULL THEN first[5] ELSE entry[4] END AS author FROM r WHERE first IS NOT NULL OR beside"))
def feedback_explain(spark, sf_dir):
    """What was said first of each hit, or of its sibling, and the rule that takes the hit away, if one does."""
    return _judged(spark, sf_dir, told=True).where("verdict IS NOT NULL").select("query", "qname", "rule", "verdict", "matched_query", "author")


def scopes(files: DataFrame, queries: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What entries on files (file_scope, query, verdict, created_at) say: (file, globs), the globs that a file matches, and (query, told), for each
    query a map of globs to what those of its family add there (boost) and whether they suppress (out)."""
    weight = feedback.BOOST * feedback.decay(F.col("created_at"), F.expr(NOW))
    known = entries.groupBy(F.col("file_scope").alias("glob"), F.col("query").alias("said")).agg(
        F.sum(F.when(F.col("verdict") == "useful", weight).otherwise(0.0)).alias("boost"),
        F.max(~F.col("verdict").isin("useful", "missing")).alias("out"),
    )
    known = saved(known, "scopes")
    told = known.join(feedback.families(queries, known, STOPWORDS), "said").groupBy("query", "glob").agg(F.sum("boost").alias("boost"), F.max("out").alias("out"))
    told = told.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("glob", F.struct("boost", "out")))).alias("told"))
    return globs.matches(files.select("file"), known.select("glob")).groupBy("file").agg(F.array_sort(F.collect_list("glob")).alias("globs")), told


def scoped(hits: DataFrame) -> DataFrame:
    """hits (…, score, globs, told) with what entries on their files add; those that one of them suppresses are gone."""
    met = F.filter(F.transform("globs", lambda g: F.try_element_at("told", g)), lambda e: e.isNotNull())
    out = F.coalesce(F.exists(met, lambda e: e["out"]), F.lit(False))
    boost = F.coalesce(F.aggregate(met, F.lit(0.0), lambda total, e: total + e["boost"]), F.lit(0.0))
    return hits.where(~out).withColumn("score", F.round(F.col("score") + boost, 6)).drop("globs", "told")


SCOPED = f"""WITH {SCORED}, qs AS (SELECT DISTINCT query, {FB_WORDS.replace('{0}', 'query')} AS words FROM sc),
fb AS (SELECT *, {FB_WORDS.replace('{0}', 'query')} AS words, @PATTERN AS pattern FROM (SELECT *, file_scope AS pat FROM verdicts WHERE file_scope IS NOT NULL) AS v),
fl AS (SELECT f.file, b.* EXCLUDE words, b.words FROM (SELECT DISTINCT file FROM code) AS f JOIN fb b ON @MATCH(f.file, b.pattern)),
met AS (SELECT q.query AS asked, f.file, bool_or(f.verdict NOT IN ('useful', 'missing')) AS out,
  sum(CASE WHEN f.verdict = 'useful' THEN 1.5::DOUBLE * CASE WHEN f.created_at < {NOW} THEN pow(0.5::DOUBLE, (epoch({NOW}) - floor(epoch(f.created_at))) / 86400.0::DOUBLE / 90.0::DOUBLE) ELSE 1::DOUBLE END ELSE 0 END) AS boost
  FROM qs q JOIN fl f ON len(f.words) = 0 OR list_has_any(q.words, f.words) GROUP BY q.query, f.file)
SELECT s.query, s.qname, round(s.score + coalesce(m.boost, 0), 6) AS score FROM sc s LEFT JOIN met m ON m.asked = s.query AND m.file = s.file WHERE NOT coalesce(m.out, FALSE)"""


@query("file_feedback", with_ctes([*USED, "verdicts"], predicates._globbed(SCOPED, True)))
def file_feedback(spark, sf_dir):
    """The hits that feedback on files leaves."""
    asked, code = _asked(spark, sf_dir), frame(spark, sf_dir, "code")
    by_file, by_query = scopes(code, asked, frame(spark, sf_dir, "verdicts").where("file_scope IS NOT NULL"))
    return scoped(scored(code, frame(spark, sf_dir, "live"), asked, by_file, by_query)).select("query", "qname", "score")


def penalised(symbols: DataFrame, entries: DataFrame) -> DataFrame:
    """The symbols that an entry penalises: one without a scope that can be read, or with a glob that the symbol's file matches."""
    scope = F.filter(F.from_json("body", "scope array<string>")["scope"], lambda g: g.isNotNull() & (g != ""))
    read = entries.select("symbol_id", F.when(F.size(scope) > 0, scope).alias("scope")).join(symbols.select("symbol_id", "file"), "symbol_id")
    read = saved(read.distinct(), "penalties")
    named = read.select("symbol_id", "file", F.explode("scope").alias("glob"))
    met = named.join(globs.matches(named.select("file"), named.select("glob")), ["file", "glob"])
    return read.where("scope IS NULL").select("symbol_id").unionByName(met.select("symbol_id")).distinct()


GLOBBED = """g AS (SELECT p.entry_id, p.symbol_id, c.file, CASE WHEN json_valid(p.body) THEN list_filter(coalesce(from_json(p.body->'scope', '["VARCHAR"]'), []), lambda x: x <> '') ELSE [] END AS scope FROM penalties p JOIN code c ON c.symbol_id = p.symbol_id),
u AS (SELECT symbol_id, file, unnest(scope) AS pat FROM g), w AS (SELECT symbol_id, file, @PATTERN AS pattern FROM u),
pen AS (SELECT symbol_id FROM g WHERE len(scope) = 0 UNION SELECT symbol_id FROM w WHERE @MATCH(file, pattern))"""


@query("constraint_semi_join", with_ctes(["code", "penalties"], predicates._globbed(f"WITH {GLOBBED} SELECT symbol_id FROM pen", True)))
def constraint_semi_join(spark, sf_dir):
    return penalised(frame(spark, sf_dir, "code"), frame(spark, sf_dir, "penalties"))


@query("constraint_penalty", with_ctes([*USED, "penalties"], predicates._globbed(f"WITH {SCORED}, {GLOBBED} SELECT query, qname, score FROM sc WHERE symbol_id NOT IN (SELECT symbol_id FROM pen)", True)))
def constraint_penalty(spark, sf_dir):
    """The hits without a penalty."""
    out = penalised(frame(spark, sf_dir, "code"), frame(spark, sf_dir, "penalties"))
    return _scored(spark, sf_dir).join(out, "symbol_id", "left_anti").select("query", "qname", "score")


# A test file is one for a source file if its stem holds the source's, or the source's holds what is left of its own without its ending.
STEMS = f"SELECT file, {TEST} AS is_test, lower(@SUB(@GROUP(file, '([^/]*)$'), '[.][^.]*$', '')) AS stem FROM (SELECT file FROM symbols UNION SELECT file FROM paths UNION SELECT file FROM code) AS f"
SHORT = "@SUB(@SUB(@SUB(stem, '(tests)+$', ''), '(test)+$', ''), '(spec)+$', '')"


def tests_of(stems: DataFrame) -> DataFrame:
    """(source, test) of stems (file, is_test, stem, short): the test files of each source file.  What is left of a test's stem can be empty, then it is for all."""
    sources, tests = stems.where("NOT is_test AND stem <> ''"), stems.where("is_test")
    s, t = sources.select(F.col("file").alias("source"), F.col("stem").alias("s_stem")), tests.select(F.col("file").alias("test"), F.col("stem").alias("t_stem"), F.col("short").alias("t_short"))
    there = contained(sources.select("stem"), tests.select("stem")).toDF("s_stem", "t_stem")
    back = contained(tests.select("short"), sources.select("stem")).toDF("t_short", "s_stem")
    one = s.join(there, "s_stem").join(t, "t_stem").select("source", "test")
    two = s.join(back, "s_stem").join(t, "t_short").select("source", "test")
    bare = t.where("t_short = ''").select("test").crossJoin(s.select("source")).select("source", "test")  # tests named test alone: each is for every source
    return one.unionByName(two).unionByName(bare).distinct()


def _stems(spark, sf_dir: str) -> DataFrame:
    return saved(over(spark, f"SELECT file, is_test, stem, {SHORT} AS short FROM ({STEMS}) AS s", **{n: frame(spark, sf_dir, n) for n in ("symbols", "paths", "code")}), "stems")


FOUND = f"WITH st AS (SELECT file, is_test, stem, {SHORT} AS short FROM ({STEMS}) AS s), pairs AS (SELECT s.file AS source, t.file AS test FROM st s JOIN st t ON NOT s.is_test AND t.is_test AND s.stem <> '' AND (contains(t.stem, s.stem) OR contains(s.stem, t.short)))"


@query("test_files_for_source", with_ctes(["symbols", "paths", "code"], FOUND + " SELECT source, test FROM pairs"))
def test_files_for_source(spark, sf_dir):
    return tests_of(_stems(spark, sf_dir))


@query("test_gap", with_ctes(["symbols", "paths", "code"], FOUND + f", gap AS (SELECT file FROM st WHERE NOT is_test AND file NOT IN (SELECT source FROM pairs)) SELECT file, {predicates.PROPOSED} AS test_path FROM gap"))
def test_gap(spark, sf_dir):
    """Source files without a test file, and where one would stand."""
    stems = _stems(spark, sf_dir)
    gap = stems.where("NOT is_test").join(tests_of(stems).select(F.col("source").alias("file")).distinct(), "file", "left_anti").select("file")
    return over(spark, f"SELECT file, {predicates.PROPOSED} AS test_path FROM gap", gap=gap)
