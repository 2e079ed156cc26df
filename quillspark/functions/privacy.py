"""Scanning and scrubbing of personal data by regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is scrubbed, in this order.
PATH_WIN = r"(?i)(?<![\w/])[A-Za-z]:[\\/][\w\\/.\-+~]*"
PATH_UNIX = r"(?i)(?<![\w/])(?:~|/(?:home|usr|opt|var|etc)(?:/[\w\-+./]*)?)"
EMAIL = r"\b[\w.+\-]+@[\w\-]+\.[\w\-.]+\b"
TOKEN = r"\b(?:sk_|pk_|ghp_|gho_|github_pat_)\w{16,}\b"
# What a scan finds.
SCAN = {
    "windows_path": r"""[A-Za-z]:[\\/][^"'\s<>]+""",
    "user_profile": r"""(?i)C:[\\/]Users[\\/][^"'\s<>]+""",
    "unix_home": r"(?i)/(?:home|users)/[\w\-+./]+",
    "email": EMAIL,
    "api_token": TOKEN,
    "telegram_id": r"\btelegram:\d+\b",
    "raw_message_id": r"\bmsg_[A-Za-z0-9]{12,}\b",
    "raw_session_id": r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    "private_lan_ip": r"\b(?:10|172\.(?:1[6-9]|2[0-9]|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b",
}
# What a release may not contain, with its severity.
GATE = (
    ("email", "warn", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("api_token", "fail", r"\bsk-or-v1-[A-Za-z0-9][A-Za-z0-9._-]{2,}\b"),
    ("api_token", "fail", r"\bsk-ant-[A-Za-z0-9][A-Za-z0-9._-]{2,}\b"),
    ("api_token", "fail", r"\bghp_[A-Za-z0-9][A-Za-z0-9_]{15,}\b"),
    ("api_token", "fail", r"\bgithub_pat_[A-Za-z0-9_]{20,}\b"),
    ("api_token", "fail", r"\bgho_[A-Za-z0-9][A-Za-z0-9_]{15,}\b"),
    ("api_token", "fail", r"\bxoxb-[A-Za-z0-9][A-Za-z0-9-]{8,}\b"),
    ("named_secret", "fail", r"""(?i)\b(?:api[_-]?key|api|token|secret|key)\b[\w .-]{0,32}[:=]\s*["']?[A-Za-z0-9_-]{32,}={0,2}"""),
    ("absolute_path", "warn", r"""(?<![\w.-])[A-Za-z]:[\\/][^\s"'<>`]+"""),
    ("lan_address", "warn", r"\b(?:10(?:\.\d{1,3}){3}|172\.(?:1[6-9]|2\d|3[01])(?:\.\d{1,3}){2}|192\.168(?:\.\d{1,3}){2})\b"),
    ("mdns_name", "warn", r"""(?i)(?<![\w.-])(?:[a-z0-9-]+\.)+local(?=[:/\s'")\]}]|$)"""),
    ("cyrillic_path", "warn", r"""(?<![\w.-])(?:[A-Za-z]:[\\/]|~/|/)[^\s"'<>`]*[Ѐ-ӿ][^\s"'<>`]*"""),
)
ALLOW_MARKER = r"(?i)#\s*release-gate:\s*allow\b"


def any_script(pattern: str) -> str:
    """A pattern whose word signs are those of every script, as where it was written for."""
    return "(?U)" + pattern


def term_pattern(terms: list[str]) -> str | None:
    """One pattern for literal terms, the longest first, at the edges of words of any script; None without terms."""
    names = sorted({t.strip() for t in terms if t.strip() and not t.lstrip().startswith("#")}, key=lambda t: (-len(t), t))
    if not names:
        return None
    return r"(?iu)(?<![\wЀ-ӿ])(?:" + "|".join(re.escape(t) for t in names) + r")(?![\wЀ-ӿ])"


def scrub(text: Column, terms: list[str] | None = None) -> Column:
    """Paths, addresses, tokens and given terms replaced by what they are; null gives an empty text."""
    out = F.coalesce(text, F.lit(""))
    for pattern, name in ((PATH_WIN, "[path]"), (PATH_UNIX, "[path]"), (EMAIL, "[email]"), (TOKEN, "[token]")):
        out = F.regexp_replace(out, any_script(pattern), name)
    extra = term_pattern(terms or [])
    return F.regexp_replace(out, extra, "[client]") if extra else out


def scan(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """id, kind, value: every passage that a pattern finds, one row each."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text_col, F.lit(any_script(p)), F.lit(0)).alias("values")) for k, p in (patterns or SCAN).items()])
    return df.select(id_col, F.explode(found).alias("f")).select(id_col, "f.kind", F.explode("f.values").alias("value"))


def gate(df: DataFrame, id_col: str, text_col: str, allowed_emails: tuple[str, ...] = (), terms: list[str] | None = None) -> DataFrame:
    """id, line, kind, severity, value: what may not be released; lines with an allow marker are left out, and so are
    addresses that are allowed or of an allowed domain (``@…``)."""
    lines = df.select(
        id_col,
        F.posexplode(F.split(text_col, "\r\n|\n|\r")).alias("line", "_t"),
    ).withColumn("line", F.col("line") + 1).where(~F.col("_t").rlike(ALLOW_MARKER))
    extra = term_pattern(terms or [])
    rules = (*GATE, ("codename", "fail", extra)) if extra else GATE
    found = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.lit(severity).alias("severity"), F.regexp_extract_all("_t", F.lit(any_script(p)), F.lit(0)).alias("values"))
        for k, severity, p in rules
    ])
    rows = lines.select(id_col, "line", F.explode(found).alias("f")).select(id_col, "line", "f.kind", "f.severity", F.explode("f.values").alias("value"))
    domains = tuple(e for e in allowed_emails if e.startswith("@"))
    fine = F.lower("value").isin(*[e.lower() for e in allowed_emails]) if allowed_emails else F.lit(False)
    for d in domains:
        fine = fine | F.endswith(F.lower("value"), F.lit(d.lower()))
    return rows.where((F.col("kind") != "email") | ~fine)


def hashed_id(value: Column, salt: str) -> Column:
    """Eight hex digits that stand for an id; empty for none."""
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.substring(F.sha2(F.concat(F.lit(salt), value), 256), 1, 8))


def description(text: Column, most: int = 120) -> Column:
    """A text fit to be shown: no failure messages, no unprintable or direction signs, cut to a length."""
    low = F.lower(text)
    failed = F.lit(False)
    for marker in ("estimation failed", "[winerror", "[errno", "traceback"):
        failed = failed | F.contains(low, F.lit(marker))
    clean = F.trim(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]", ""))
    cut = F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…"))).otherwise(clean)
    return F.when(failed, "").otherwise(F.coalesce(cut, F.lit("")))
