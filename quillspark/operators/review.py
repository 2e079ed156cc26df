"""What still needs an estimate, answers that are estimates, and what of a payload may be shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import normalize as n
from ..functions import text as t


def human_driven(originator: Column, source: Column, source_is_text: Column, thread_source: Column) -> Column:
    """Whether a human drove a session: no ``exec`` run, no subagent (whose source is an object), from a known client."""
    low = F.lower(F.coalesce(source, F.lit("")))
    spawned = (F.lower(F.coalesce(originator, F.lit(""))) == "codex_exec") | (low == "exec") | (F.lower(F.coalesce(thread_source, F.lit(""))) == "subagent")
    return ~spawned & F.coalesce(source_is_text, F.lit(False)) & low.isin("vscode", "desktop", "cli")


def needs_estimation(known: Column, review: Column, estimated_at: Column, baseline: Column) -> Column:
    """Whether a session has no estimate yet: an entry alone is none, and one that waits for a review isn't tried again."""
    tried = F.coalesce(review, F.lit(False)) | (F.coalesce(estimated_at, F.lit("")) != "") | baseline.isNotNull()
    return ~(F.coalesce(known, F.lit(False)) & tried)


def candidates(prompts: DataFrame, entries: DataFrame, stranded: bool = False) -> DataFrame:
    """session_id, last_ts, prompts, newest first: sessions with prompts (session_id, ts) whose entry (session_id, review,
    estimated_at, baseline) has no estimate; with ``stranded`` only those that have an entry."""
    sums = prompts.where("ts is not null").groupBy("session_id").agg(F.max("ts").alias("last_ts"), F.count("*").alias("prompts"))
    known = entries.withColumn("_known", F.lit(True))
    rows = sums.join(known, "session_id", "inner" if stranded else "left")
    rows = rows.where(needs_estimation(F.col("_known"), F.col("review"), F.col("estimated_at"), F.col("baseline")))
    return rows.select("session_id", "last_ts", "prompts").orderBy(F.desc("last_ts"), "session_id")


def json_text(text: Column) -> Column:
    """The JSON in an answer: without a code fence around it, and from the first brace to the last where there is more."""
    bare = F.trim(text)
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"\n?```[^\n]*$", "")
    bare = F.trim(F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(n.blank_to_null(F.regexp_extract(bare, r"(?s)\{.*\}", 0)))


def estimates(answers: DataFrame, text_col: str = "text", deep: int = 3) -> DataFrame:
    """The rows with valid and estimate: the payload of an answer, which may be wrapped in ``result`` (an object or JSON text)
    up to ``deep`` times, brought to its bounds. Without a description or with hours that are no number or below 0 an
    answer is not valid and its estimate is null."""
    has = lambda c, k: F.coalesce(F.array_contains(F.json_object_keys(c), k), F.lit(False))
    rows = answers.withColumn("_j", json_text(F.col(text_col)))
    for _ in range(deep):
        done = has("_j", "brief_description") & has("_j", "ai_baseline_hours")
        rows = rows.withColumn("_j", F.when(done, F.col("_j")).when(has("_j", "result"), json_text(F.get_json_object("_j", "$.result"))).otherwise(F.col("_j")))
    value = lambda k: F.get_json_object("_j", f"$.{k}")
    words = F.trim(F.regexp_replace(value("brief_description"), r"\s+", " "))
    hours = value("ai_baseline_hours").try_cast("double")
    one_of = lambda k, kinds, other: F.when(value(k).isin(*kinds), value(k)).otherwise(other)
    found = F.struct(
        hours.alias("ai_baseline_hours"),
        words.alias("brief_description"),
        one_of("estimation_confidence", ("high", "medium", "low"), "low").alias("estimation_confidence"),
        (F.lower(F.trim(F.coalesce(value("needs_manual_review"), F.lit("")))) == "true").alias("needs_manual_review"),
        n.clamp(value("frustration_score")).alias("frustration_score"),
        n.clamp(value("appreciation_score")).alias("appreciation_score"),
        F.substring(F.coalesce(value("mood_arc"), F.lit("")), 1, 30).alias("mood_arc"),
        one_of("sentiment_intensity", ("low", "medium", "high"), "low").alias("sentiment_intensity"),
    )
    valid = F.coalesce((words != "") & (hours >= 0) & ~F.isnan(hours), F.lit(False))
    return rows.withColumn("valid", valid).withColumn("estimate", F.when(valid, found)).drop("_j")


def markers_since(messages: DataFrame, since: str, patterns: tuple[str, ...] = t.PROFANITY) -> DataFrame:
    """path, markers: marks in what users wrote (path, ts, role, text) at an instant or later."""
    rows = messages.where((F.col("role") == "user") & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    return rows.groupBy("path").agg(F.sum(t.count_markers(F.col("text"), patterns)).cast("long").alias("markers"))


def with_schema_version(value: Column, version: int = 1) -> Column:
    """JSON text of an object with a schema version in front, if it has none."""
    keys = F.coalesce(F.json_object_keys(value), F.array().cast("array<string>"))
    empty = F.size(keys) == 0
    added = F.concat(F.lit(f'{{"schema_version": {version}'), F.when(empty, "").otherwise(", "), F.ltrim(F.substring(F.trim(value), 2, 2**31 - 1)))
    return F.when(F.array_contains(keys, "schema_version"), value).otherwise(added)


def public_sessions(expensive: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """What may be shown of expensive sessions: the short id, times, cost and lines, and of commits (session_id, subject,
    insertions, deletions) nothing that names a repository. Commits of one session are few: those made while it lasted."""
    shown = expensive.select("session_id", F.substring("session_id", 1, 8).alias("session_short"), "start", "end", "cost", "lines", "cost_per_line")
    if commits is None:
        return shown.drop("session_id")
    plain = F.struct(F.coalesce("subject", F.lit("")).alias("subject"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("insertions", "deletions")])
    own = commits.groupBy("session_id").agg(F.array_sort(F.collect_list(plain)).alias("commits"))
    return shown.join(own, "session_id", "left").drop("session_id")


def public_slop(summary: DataFrame, private: tuple[str, ...] = ("session_id", "path", "run_id")) -> DataFrame:
    """A slop summary without columns that name sessions or files."""
    return summary.drop(*private)


def united(runs: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Texts of runs and of transcripts (agent, role, text, ...) as one table with their source; missing columns are null."""
    return runs.withColumn("source", F.lit("runs")).unionByName(transcripts.withColumn("source", F.lit("transcripts")), allowMissingColumns=True)


# Marks of passages that stay as they are, and what is replaced elsewhere, in this order.
KEEP_OPEN, KEEP_CLOSE = "<!-- oss:keep -->", "<!-- /oss:keep -->"
RULES = (
    (r"\b(?:10|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b", "localhost", "Private LAN IP (RFC1918)"),
    (r"(?<![\w/])/(?:home|users)/[\w\-+./]+", "<user_home>", "Unix user home"),
)


def _split_kept(texts):
    """Each text as JSON of its parts in turn: to be cleaned, kept, to be cleaned, ... A kept part goes from a line with the
    opening mark to a line with the closing one or to the end of a code fence that began after it."""
    import json

    def parts(text: str | None) -> str | None:
        if text is None:
            return None
        out, kept, fence = [""], False, None
        for line in text.splitlines(keepends=True):
            if not kept and KEEP_OPEN in line:
                kept, fence = True, None
                out += [line]
                continue
            out[-1] += line
            if kept:
                bare = line.lstrip()
                if KEEP_CLOSE in line or fence and bare.startswith(fence):
                    kept = False
                    out += [""]
                elif fence is None and bare[:3] in ("```", "~~~"):
                    fence = bare[:3]
        return json.dumps(out)

    return texts.map(parts)


def _count(pieces: Column, pattern: str) -> Column:
    """How often a pattern is in the pieces to be cleaned, every second one."""
    found = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_count(x, F.lit(pattern))).otherwise(0))
    return F.aggregate(found, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _replace(pieces: Column, pattern: str, new: str) -> Column:
    return F.transform(pieces, lambda x, i: F.when(i % 2 == 0, F.regexp_replace(x, pattern, new)).otherwise(x))


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """id, text, hits (array of rule and count, rules that hit only): texts with the rules applied outside of kept passages.

    Texts without a mark stay in Spark's own functions; only marked ones are split by a pandas UDF. Null stays null."""
    split = F.pandas_udf(_split_kept, StringType())(F.col(text_col))
    marked = F.contains(F.col(text_col), F.lit(KEEP_OPEN))
    pieces = F.when(marked, F.from_json(split, "array<string>")).otherwise(F.array(F.col(text_col)))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), pieces.alias("_p"))
    for k, (pattern, new, _) in enumerate(rules):
        rows = rows.withColumn(f"_h{k}", _count(F.col("_p"), pattern)).withColumn("_p", _replace(F.col("_p"), pattern, new))
    hits = [F.struct(F.lit(what).alias("rule"), F.col(f"_h{k}").alias("n")) for k, (_, _, what) in enumerate(rules)]
    text = F.when(F.col("text").isNotNull(), F.array_join("_p", ""))
    return rows.select(id_col, text.alias("text"), F.filter(F.array(*hits), lambda h: h["n"] > 0).alias("hits"))


def role_lines(changes: DataFrame) -> DataFrame:
    """role, line: the suggestion for each role (role, action, agent, confidence) as a comment of a configuration file."""
    what = F.when(F.col("action") == "keep", F.concat(F.lit("keep current ("), "agent", F.lit(")"))).otherwise(F.concat(F.lit("switch to "), "agent"))
    confidence = F.coalesce("confidence", F.lit("none"))
    return changes.select("role", F.concat(F.lit("# Suggestion: "), what, F.lit(". Confidence: "), confidence, F.lit(".")).alias("line"))


def report_lines(matrix: DataFrame) -> DataFrame:
    """run_id, canonical, line: a row of a Markdown table for each canonical finding of a matrix (run_id, canonical, role,
    state), roles in the order of their names. A finding has a state for each role of its run, which are few."""
    cells = F.array_sort(F.collect_list(F.struct("role", "state")))
    each = F.transform(F.col("cells"), lambda c: F.concat(c["role"], F.lit(": "), c["state"]))
    return matrix.groupBy("run_id", "canonical").agg(cells.alias("cells")).select(
        "run_id", "canonical",
        F.concat(F.lit("| "), "canonical", F.lit(" | "), F.array_join(each, " | "), F.lit(" |")).alias("line"),
    )
