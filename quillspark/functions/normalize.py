"""Column functions that bring ledger fields into one form. Null-safe; none needs a UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names of producers and their canonical form.
OPENAI = ("openai", "openai_codex", "codex")
OPENROUTER = ("openrouter", "openrouter_openclaw", "openclaw")
OPENCODE = ("opencode", "opencode_openrouter", "openrouter_opencode")
ANTHROPIC = ("anthropic", "anthropic_claude", "claude")
OUTPUT_KEYS = {"anthropic": "anthropic_claude", "openai": "openai_codex", "openrouter": "openrouter_openclaw", "opencode": "opencode_openrouter"}
SYNTHETIC = "<synthetic>"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def provider(c: Column) -> Column:
    """Four canonical providers; whatever is unknown is anthropic."""
    p = F.lower(F.coalesce(c, F.lit("")))
    return F.when(p.isin(*OPENAI), "openai").when(p.isin(*OPENROUTER), "openrouter").when(p.isin(*OPENCODE), "opencode").otherwise("anthropic")


def dedupe_provider(c: Column, default: Column) -> Column:
    """As ``provider``, but what is unknown takes the file's default."""
    p = F.lower(F.coalesce(c, F.lit("")))
    return F.when(p.isin(*OPENAI), "openai").when(p.isin(*OPENROUTER), "openrouter").when(p.isin(*OPENCODE), "opencode").when(p.isin(*ANTHROPIC), "anthropic").otherwise(default)


def output_key(c: Column) -> Column:
    out = c
    for name, key in OUTPUT_KEYS.items():
        out = F.when(c == name, key).otherwise(out)
    return out


def provider_model(p: Column, model: Column) -> Column:
    """``provider/model``, without a second prefix."""
    return F.when(F.startswith(F.lower(model), F.concat(p, F.lit("/"))), model).otherwise(F.concat(p, F.lit("/"), model))


def codex_origin(origin: Column, originator: Column, source: Column, model: Column, canonical: Column) -> Column:
    """Where a call came from; an explicit origin wins, then the first rule that holds."""
    m, o, s = (F.lower(F.coalesce(x, F.lit(""))) for x in (model, originator, source))
    return (
        F.when(blank_to_null(origin).isNotNull(), origin)
        .when((m == "codex-auto-review") | F.contains(s, F.lit("subagent")), "auto_review")
        .when((o == "codex_exec") | (s == "exec"), "headless")
        .when((o == "codex-tui") | (s == "cli"), "tui")
        .when((o == "codex desktop") | s.isin("vscode", "desktop"), "desktop")
        .when(canonical == "openai", "headless")
        .otherwise("unknown")
    )


def model_name(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit("unknown"))


def model_short(c: Column) -> Column:
    """A compact label: without the vendor, family and version, as in ``opus 4.1``."""
    bare = F.lower(c)
    for prefix in ("anthropic/", "openai/", "claude-", "claude/"):
        bare = F.when(F.startswith(bare, F.lit(prefix)), F.substring(bare, len(prefix) + 1, 10_000)).otherwise(bare)
    version = F.concat(F.regexp_extract(bare, r"^([^-]*)-(\d+)", 1), F.lit(" "), F.regexp_extract(bare, r"^[^-]*-(\d+)", 1))
    minor = F.regexp_extract(bare, r"^[^-]*-\d+-(\d+)(?:-|$)", 1)
    return F.when(c.isNull(), "unknown").when(
        bare.rlike(r"^[^-]*-\d+(-|$)"),
        F.when(minor != "", F.concat(version, F.lit("."), minor)).otherwise(version),
    ).otherwise(bare)


def model_label(c: Column) -> Column:
    """The same for agents' labels: only one prefix goes, the first that fits."""
    low = F.lower(c)
    bare = low
    for prefix in reversed(("anthropic/", "openai/", "claude-", "claude/")):
        bare = F.when(F.startswith(low, F.lit(prefix)), F.substring(low, len(prefix) + 1, 10_000)).otherwise(bare)
    parts = F.split(bare, "-", -1)
    digits = lambda k: F.coalesce(F.get(parts, F.lit(k)).rlike(r"^\d+$"), F.lit(False))
    version = F.concat(F.get(parts, F.lit(0)), F.lit(" "), F.get(parts, F.lit(1)))
    label = F.when(digits(1) & digits(2), F.concat(version, F.lit("."), F.get(parts, F.lit(2)))).when(digits(1), version).otherwise(bare)
    return F.coalesce(label, F.lit("unknown"))


def uncached_input(tokens: Column, cached: Column) -> Column:
    return F.greatest(tokens - cached, F.lit(0))


def total_tokens(total: Column, tokens: Column, cached: Column, output: Column, cache_read: Column, cache_creation: Column) -> Column:
    """The written total, or what the parts add up to where it is 0."""
    return F.coalesce(F.nullif(total, F.lit(0)), uncached_input(tokens, cached) + cached + output + cache_read + cache_creation)


def as_int(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def as_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.0))))


def prompt_size(tokens: Column) -> Column:
    return F.when(tokens < 1000, "xs").when(tokens < 10_000, "s").when(tokens < 100_000, "m").otherwise("l")


def session_size(events: Column) -> Column:
    return F.when(events <= 3, "stub").when(events <= 50, "small").when(events <= 500, "medium").when(events <= 1500, "large").otherwise("marathon")


# Markers of agents, the first that occurs decides.
AGENT_MARKERS = (
    ("claude", "claude"), ("anthropic", "claude"), ("codex", "codex"), ("opencode", "opencode"), ("deepseek", "opencode"),
    ("openclaw", "openclaw"), ("openai", "openai"), ("human", "human"),
)


def agent(invocation: Column, model: Column, fallback: Column) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(invocation, F.lit("")), F.coalesce(model, F.lit(""))))
    out = F.coalesce(blank_to_null(fallback), F.lit("unknown"))
    for marker, name in reversed(AGENT_MARKERS):
        out = F.when(F.contains(text, F.lit(marker)), name).otherwise(out)
    return out


def exit_status(stop_reason: Column) -> Column:
    """0 for an ordinary end, 1 for an error or an abort."""
    return F.when(F.lower(F.coalesce(stop_reason, F.lit(""))).isin("error", "aborted", "cancelled", "canceled"), 1).otherwise(0)


def channel(text: Column) -> Column:
    """Where a conversation came in, from its runtime context."""
    out = F.lit("workspace")
    for name in ("whatsapp", "discord", "telegram"):
        out = F.when(F.contains(F.coalesce(text, F.lit("")), F.lit(f"{name}:")), name).otherwise(out)
    return out


def project_dir(name: Column) -> Column:
    """A working folder from its encoded name: what is before two hyphens is a drive, other hyphens are separators."""
    at = F.instr(name, "--")
    return F.when(
        at > 0,
        F.concat(F.substring(name, F.lit(1), at - 1), F.lit(":/"), F.translate(F.substring(name, at + 2, F.length(name)), "-", "/")),
    ).otherwise(F.translate(name, "-", "/"))


def _from_cp1251(texts: pd.Series) -> pd.Series:
    def turn(text: str | None) -> str | None:
        try:
            fixed = text.encode("cp1251").decode("utf-8")
        except (UnicodeError, AttributeError):
            return text
        marks = lambda x: x.count("Р") + x.count("С")
        return fixed if marks(fixed) < marks(text) else text

    return texts.map(turn)


def repair_cp1251(text: Column) -> Column:
    """UTF-8 that was read as windows-1251, turned back where that leaves fewer of its marks. Spark has no such charset, so
    texts that bear a mark go through a pandas UDF."""
    return F.when(text.rlike("[РС]"), F.pandas_udf(_from_cp1251, StringType())(text)).otherwise(text)


def effective_hours(corrected: Column, baseline: Column) -> Column:
    """A written correction decides even where it is no number (then null); otherwise the baseline."""
    return F.when(corrected.isNotNull(), corrected.try_cast("double")).otherwise(baseline.try_cast("double"))


def guarded_hours(
    baseline: Column, active: Column, events: Column, *, trivial_events: int = 5, trivial_hours: float = 0.05,
    trivial_baseline: float = 1.0, per_event: float = 1.0, band: float = 6.0,
) -> Column:
    """struct(hours, kind): no less than the active time, and no more than the number of events makes credible."""
    eff = F.greatest(baseline, active)
    ceiling = F.greatest(F.lit(band), events * per_event)
    trivial = (events <= trivial_events) & (active <= trivial_hours) & (baseline > trivial_baseline)
    hours = F.when(trivial, active).when(eff > ceiling, ceiling).otherwise(eff)
    kind = F.when(trivial, "ceiling_trivial").when(eff > ceiling, "ceiling_band").when(baseline < active, "floor").otherwise("normal")
    return F.struct(hours.alias("hours"), kind.alias("kind"))


def wilson(successes: Column, runs: Column, z: float = 1.96) -> Column:
    """The lower bound of Wilson's score interval; 0 without runs."""
    n = F.nullif(runs, F.lit(0)).cast("double")
    p = successes / n
    top = p + F.lit(z * z) / (n * 2) - F.sqrt((p * (1 - p) + F.lit(z * z) / (n * 4)) / n) * z
    return F.coalesce(F.greatest(F.lit(0.0), top / (F.lit(z * z) / n + 1)), F.lit(0.0))


def confidence(runs: Column) -> Column:
    return F.when(runs <= 1, "low (single-run sample)").when(runs < 5, "low (small sample)").when(runs < 10, "medium").otherwise("high")


def sentiment_label(c: Column) -> Column:
    return F.when(c < 0.2, "low").when(c < 0.4, "medium-low").when(c < 0.6, "medium").when(c < 0.8, "medium-high").otherwise("high")


def stress_trend(first: Column, second: Column) -> Column:
    delta = second - first
    return F.when(delta.isNull(), "n/a (need both halves)").when(delta <= -0.05, "↘ improving").when(delta >= 0.05, "↗ worsening").otherwise("→ stable")


def percent(used: Column, limit: Column) -> Column:
    return F.coalesce(F.try_divide(used * 100, limit), F.lit(0.0))


def epoch_ms(c: Column) -> Column:
    """A timestamp from milliseconds since 1970, if it lies between 2001 and 2100."""
    return F.when((c > 978_307_200_000) & (c < 4_102_444_800_000), F.timestamp_millis(c))
