"""Why a symbol was found for a query, and what that is worth: rows for the symbols that a query's words find, and no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import answers
from ..registry import query
from ..shared import saved
from ..sources.crosswalk import frame, over, run_sql, with_ctes
from .base import sql
from .feedback import FIELDS, LEDGER, SCORED, held, matched, scored
from .predicates import HAS, HOT, LABEL, NOTES, TIER, WORDS_D, WORDS_S
from .search import tokens

LABELS = {"qname": "name", "file": "file", "signature": "sig", "doc": "doc"}
TABLES = ["code", "live", "asks", "lineitem"]


#: The label of a word by the mask of the texts that hold it, the first that does.
LABELED = [next((label for f, label in LABELS.items() if mask >> FIELDS.index(f) & 1), None) for mask in range(2 * LEDGER)]


def reasons(code: DataFrame, live: DataFrame, asked: DataFrame, hot: DataFrame, notes: DataFrame) -> DataFrame:
    """(query, symbol_id, file, has_ledger, is_hot, reasons): each word of the query by the first text that holds it, then what the ledger and recent edits say."""
    symbols = code.select("symbol_id", "file").join(held(code, live, asked), "symbol_id").join(notes, "symbol_id", "left").join(hot, "symbol_id", "left")
    wide = answers.answered(symbols, answers.worded(asked))
    labels = F.array(*(F.lit(x).cast("string") for x in LABELED))
    label = lambda mask: F.element_at(labels, mask + 1)
    words = F.filter(F.transform(F.arrays_zip("words", "masks"), lambda w: F.concat(label(w["masks"]), F.lit(":"), w["words"])), lambda t: t.isNotNull())  # one for each word of the query
    newest = F.array_min(F.transform("words", lambda w: F.try_element_at("own", w)))
    wide = wide.withColumn("owned", F.array_join(F.slice(F.split(F.trim(newest["summary"]), r"\s+"), 1, 4), "-"))
    text = F.concat_ws(
        " ", F.nullif(F.array_join(words, " "), F.lit("")),
        F.when(F.col("inv") > 0, F.concat(F.lit("invariant-attached:"), "inv")),
        F.when(F.col("haz") > 0, F.concat(F.lit("ledger:"), "haz", F.when(F.col("haz") == 1, " hazard").otherwise(" hazards"))),
        F.concat(F.lit("ownership:"), "owned"), F.when(F.col("hot") == 1, "recent-edit"),
    )
    return wide.select("query", "symbol_id", "file", (F.coalesce("n", F.lit(0)) > 0).alias("has_ledger"), F.col("hot").isNotNull().alias("is_hot"), text.alias("reasons"))


def _reasons(spark, sf_dir: str) -> DataFrame:
    code, live = frame(spark, sf_dir, "code"), frame(spark, sf_dir, "live")
    asked = saved(tokens(frame(spark, sf_dir, "asks")), "asked")
    return reasons(code, live, asked, run_sql(spark, sf_dir, ["lineitem"], HOT), run_sql(spark, sf_dir, ["live"], NOTES))


FOUND = "CASE WHEN contains(lower(c.qname), t.term) THEN concat('name:', t.term) WHEN contains(lower(c.file), t.term) THEN concat('file:', t.term) WHEN contains(coalesce(lower(c.signature), ''), t.term) THEN concat('sig:', t.term) WHEN contains(coalesce(lower(c.doc), ''), t.term) THEN concat('doc:', t.term) END"
REASONS = f"""{SCORED}, wd AS (SELECT t.query, c.symbol_id, string_agg({FOUND}, ' ' ORDER BY t.at) AS words FROM sc s JOIN tok t ON t.query = s.query JOIN code c ON c.symbol_id = s.symbol_id GROUP BY t.query, c.symbol_id),
ow AS (SELECT query, symbol_id, array_to_string(regexp_split_to_array(trim(summary), '\\s+')[1:4], '-') AS owned FROM (SELECT t.query, l.symbol_id, l.summary, row_number() OVER (PARTITION BY t.query, l.symbol_id ORDER BY l.created_at DESC, l.entry_id) AS r FROM (SELECT DISTINCT query, term FROM tok) AS t JOIN live l ON l.kind = 'ownership' AND contains(lower(l.summary), t.term)) AS o WHERE r = 1),
re AS (SELECT w.query, w.symbol_id, c.file, coalesce(l.n, 0) > 0 AS has_ledger, h.hot IS NOT NULL AS is_hot, concat_ws(' ', w.words, CASE WHEN l.inv > 0 THEN concat('invariant-attached:', l.inv) END, CASE WHEN l.haz > 0 THEN concat('ledger:', l.haz, CASE WHEN l.haz = 1 THEN ' hazard' ELSE ' hazards' END) END,
    'ownership:' || o.owned, CASE WHEN h.hot = 1 THEN 'recent-edit' END) AS reasons
  FROM wd w JOIN code c ON c.symbol_id = w.symbol_id LEFT JOIN ow o ON o.query = w.query AND o.symbol_id = w.symbol_id LEFT JOIN ({NOTES}) AS l ON l.symbol_id = w.symbol_id LEFT JOIN ({HOT}) AS h ON h.symbol_id = w.symbol_id)"""
BUCKET = f"CASE WHEN {TIER} = 2 THEN 'test-only' WHEN has_ledger AND ({HAS['name']} OR is_hot) THEN 'core' WHEN has_ledger OR {HAS['name']} THEN 'relevant' WHEN is_hot OR {HAS['doc']} OR {HAS['file']} THEN 'peripheral' ELSE 'noisy' END"


def _of(name: str, column: str, what: str) -> None:
    @query(name, with_ctes(TABLES, f"WITH {REASONS} SELECT query, symbol_id, {what} AS {column} FROM re"))
    def run(spark, sf_dir):
        return over(spark, f"SELECT query, symbol_id, {what} AS {column} FROM re", re=_reasons(spark, sf_dir))


_of("explain_match", "reasons", "reasons")
_of("confidence_reason", "reason", LABEL)
_of("result_bucket", "bucket", BUCKET)

# Each query leaves out what holds a word of its own.
LEFT_OUT = "SELECT DISTINCT query, concat('brand', length(query) % 20 + 3) AS term FROM asks"


@query("exclude_terms", with_ctes(["code", "live", "asks"], f"WITH {SCORED}, ex AS ({LEFT_OUT}) SELECT s.query, s.qname FROM sc s WHERE NOT EXISTS (SELECT 1 FROM ex JOIN code c ON c.symbol_id = s.symbol_id WHERE ex.query = s.query AND (contains(lower(c.qname), ex.term) OR contains(lower(c.file), ex.term) OR contains(lower(coalesce(c.doc, '')), ex.term) OR contains(lower(c.signature), ex.term)))"))
def exclude_terms(spark, sf_dir):
    """The hits of each query without those that hold a word it leaves out."""
    code, live = frame(spark, sf_dir, "code"), frame(spark, sf_dir, "live")
    hits = scored(code, live, saved(tokens(frame(spark, sf_dir, "asks")), "asked"))
    out = saved(run_sql(spark, sf_dir, ["asks"], LEFT_OUT).withColumn("at", F.lit(0)), "left_out")
    gone = matched(code, live.limit(0), out).select("query", "symbol_id").distinct()
    return hits.join(gone, ["query", "symbol_id"], "left_anti").select("query", "qname")


# A file is named by all words of its name, or two of them.
NAMED = "SELECT file, query, {hits} >= least(2, {n}) AS named FROM (SELECT file, {words} AS words FROM paths) AS p CROSS JOIN (SELECT DISTINCT query FROM asks) AS q"
sql(
    "query_names_file", "paths asks", NAMED.format(hits="size(filter(words, w -> array_contains(split(query, ' '), w)))", n="size(words)", words=WORDS_S),
    NAMED.format(hits="len(list_filter(words, lambda w: list_contains(string_split(query, ' '), w)))", n="len(words)", words=WORDS_D),
)
