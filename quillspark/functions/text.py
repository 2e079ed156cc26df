"""Text scores as column expressions: repetition, stock phrases, hedging, markers, findings and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stock phrases, hedges and imperatives.
STOCK = (
    "in summary", "it is important to note", "it's important to note", "in conclusion", "as an ai language model",
    "let me know if you have", "let me know if you need", "feel free to ask", "i hope this helps", "please note that",
    "as a side note", "with that being said", "that being said", "in essence", "broadly speaking", "generally speaking",
    "to put it simply", "for example,", "for instance,", "in order to",
)
HEDGES = (
    "might", "may", "could", "would", "should", "perhaps", "possibly", "potentially", "consider", "consider that",
    "consider whether", "it seems", "appears to", "tends to", "often", "sometimes", "in general", "typically", "arguably",
    "presumably",
)
IMPERATIVES = (
    "run", "use", "do", "fix", "check", "verify", "add", "remove", "replace", "rename", "build", "test", "deploy", "commit",
    "push", "merge", "scan", "read", "write", "set", "ensure", "call", "import", "install", "open", "close", "rebase", "restart",
    "execute", "create", "delete", "update", "save", "compute", "extract", "render", "parse", "validate", "compile", "rebuild",
    "stage", "tag",
)
STOP_WORDS = """
the a an and or but if then else not no yes is are was were be been being of to in on at by for from with into onto off
out over under above below this that these those it its as such so than too very can may might shall should would could
will need needs has have had do does did done we us our you your they them their he she his her i me my mine ours yours
here there where when why how what who which whose also still yet just only even both either neither most some many few
all any each every other another using use used uses via per about across between within among sample run runs ran section
sections page pages line lines item items
""".split()
WORD = r"[A-Za-zА-Яа-яЁё][A-Za-zА-Яа-яЁё']*"
TOKEN = r"[a-zа-яё0-9_]+"  # of texts in lower case
# Markers counted in what people write; each pattern counts on its own.
PROFANITY = (
    r"\bбля[а-яё]*",
    r"\bёб[а-яё]*",
    r"\bеб[а-яё]+",
    r"\b(?:за|вы|на|по|подъ|пере)еб[а-яё]+",
    r"\bхуй[а-яё]*|\bхрен[а-яё]*|\bхер[а-яё]*",
    r"\bпизд[а-яё]*",
    r"\bсук[а-яё]*",
    r"\bговн[а-яё]*",
    r"\bсран[а-яё]*|\bсрать",
    r"\bжоп[а-яё]*",
    r"\bнах(уй|ер|рен)[а-яё]*",
    r"\bпошёл\s+на\b|\bпошел\s+на\b",
    r"\bfuck[a-z]*",
    r"\bshit[a-z]*",
    r"\bdamn[a-z]*",
    r"\bbitch[a-z]*",
    r"\bcrap[a-z]*",
)
THANKS = (
    r"\bспасибо[а-яё]*",
    r"\bблагодар[а-яё]+",
    r"\bкрасав[а-яё]*",
    r"\bты\s+(лучший|молодец|гений)\b",
    r"\bобожаю\b",
    r"\bthanks?\b|\bthank\s+you\b",
    r"\bawesome\b|\bexcellent\b|\bbrilliant\b",
    r"\blove\s+it\b",
)
WEIGHTS = {"trigram": 0.4, "stock": 0.3, "hedge": 0.3}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens of two letters or more that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def count_markers(text: Column, patterns: tuple[str, ...]) -> Column:
    """The sum over patterns: one passage may count under several. Letters of any script have case and are word letters."""
    out = F.lit(0)
    for p in patterns:
        out = out + F.coalesce(F.regexp_count(text, F.lit(f"(?iuU){p}")), F.lit(0))
    return out


def total(items: list[Column]) -> Column:
    out = items[0]
    for x in items[1:]:
        out = out + x
    return out


def trigram_repetition(w: Column) -> Column:
    """The share of trigrams of words that aren't distinct, told apart by 64 bits."""
    n = F.size(w) - 2
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(n > 0, 1 - F.size(F.array_distinct(grams)) / n).otherwise(0.0)


def stock_density(lower: Column, count: Column) -> Column:
    hits = total([occurrences(lower, p) for p in STOCK])
    return F.when(count > 0, F.least(hits * 100 / F.greatest(count, F.lit(1)) / 5.0, F.lit(1.0))).otherwise(0.0)


def hedge_ratio(w: Column, lower: Column) -> Column:
    single = [h for h in HEDGES if " " not in h]
    h = F.size(F.filter(w, lambda x: x.isin(*single))) + total([occurrences(lower, p) for p in HEDGES if " " in p])
    i = F.size(F.filter(w, lambda x: x.isin(*IMPERATIVES)))
    return F.when(h == 0, 0.0).when(i == 0, 1.0).otherwise(F.least(h / F.greatest(i, F.lit(1)), F.lit(1.0)))


def slop(df, text_col: str = "text"):
    """The rows with trigram, stock, hedge, word_count and score (0 to 100)."""
    lower = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = df.withColumn("_w", words(lower)).withColumn("word_count", F.size("_w"))
    rows = rows.withColumn("trigram", trigram_repetition(F.col("_w"))).withColumn(
        "stock", stock_density(lower, F.col("word_count")),
    ).withColumn("hedge", hedge_ratio(F.col("_w"), lower))
    score = total([F.col(k) * w for k, w in WEIGHTS.items()]) * 100
    return rows.withColumn("score", score).drop("_w")


def prefix(text: Column, n: int) -> Column:
    """The first n tokens in lower case; empty where there are fewer."""
    t = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    return F.when(F.size(t) < n, "").otherwise(F.array_join(F.slice(t, 1, n), " "))


# Openings of messages that a program wrote.
NOISE = (
    "<system-reminder>", "<command-name>", "this session is being continued", "continue from where you", "caveat:",
    "<local-command-", "<task-notification", "base directory for this", "<command-message>", "the user has asked",
)


def is_noise(text: Column) -> Column:
    head = F.ltrim(F.lower(F.substring(text, 1, 80)))
    out = F.lit(False)
    for p in NOISE:
        out = out | F.startswith(head, F.lit(p))
    return out


# First words that tell what an opening is.
VERBS = """
сделай напиши запусти запиши проверь почини обнови удали добавь перенеси поправь развей сгенерируй посчитай собери опубликуй
выкати закоммить пушни смерджи продеплой run write build fix update remove add move patch deploy ship merge commit push
generate check verify compile test publish audit compute render validate
""".split()
QUESTIONS = "как что где почему зачем когда сколько how what where why when should can could is do does".split()


def opener_kind(key: Column) -> Column:
    first = F.substring_index(key, " ", 1)
    return F.when(first.isin(*VERBS), "script").when(
        first.isin(*QUESTIONS), "prompt-template",
    ).when(F.size(F.split(key, " ")) < 3, "noise").otherwise("prompt-template")


def slug(text: Column) -> Column:
    """A name for files: letters and digits joined by hyphens, a hash for other scripts, 60 characters at most."""
    s = F.trim(F.regexp_replace(F.trim(text), "[^A-Za-zА-Яа-яЁё0-9]+", "-"), F.lit("-"))
    s = F.when(s == "", "pattern").otherwise(s)
    s = F.when(s.rlike("^[A-Za-z0-9._-]+$"), s).otherwise(F.concat(F.lit("pattern-"), F.substring(F.sha2(s, 256), 1, 8)))
    return F.substring(F.lower(s), 1, 60)


def clip_end(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1), F.lit("…")))


def clip_middle(text: Column, limit: int) -> Column:
    half = (limit - 1) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 1 - half), F.lit("…"), F.right(text, F.lit(half))))


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\u001b\\[[0-9;?]*[ -/]*[@-~]", "")


# Tags and beginnings of messages that a client put in.
INJECTED_TAGS = ("recommended_plugins", "environment_context", "app-context", "codex_internal_context", "turn_aborted", "user_instructions", "INSTRUCTIONS")
INJECTED_START = "# AGENTS.md instructions for"


def is_injected(text: Column) -> Column:
    t = F.ltrim(F.coalesce(text, F.lit("")))
    return F.regexp_extract(t, r"^<([\w-]+)[ >\n\t]", 1).isin(*INJECTED_TAGS) | F.startswith(t, F.lit(INJECTED_START))


#: A line that begins or ends fenced code, with its end.
FENCE = r"(?:^|(?<=\n)|(?<=\r)(?!\n)) *(?:```|~~~)[^\r\n]*(?:\r\n|\r|\n|$)"


def finding_titles(text: Column) -> Column:
    """array of titles: headings of level 2 and 3, bullets and numbered items at the line's start, outside fenced code.

    Fences cut a text into parts, of which every second one is code."""

    def title(line: Column) -> Column:
        s = F.trim(line)
        heading = F.startswith(s, F.lit("##"))
        item = F.rtrim(F.regexp_extract(line, r"^(?:[-*+]|\d+\.)\s+(.+)", 1))
        return F.struct(heading.alias("heading"), F.when(heading, F.rtrim(F.ltrim(F.ltrim(s, F.lit("# "))))).otherwise(item).alias("title"))

    text = F.coalesce(text, F.lit(""))
    fenced = F.contains(text, F.lit("```")) | F.contains(text, F.lit("~~~"))
    parts = F.when(fenced, F.filter(F.split(text, FENCE), lambda _, k: k % 2 == 0)).otherwise(F.array(text))
    lines = F.flatten(F.transform(parts, lambda p: F.split(p, "\r\n|\n|\r")))
    return F.filter(F.transform(lines, title), lambda t: t["heading"] | (t["title"] != ""))["title"]


def content_id(toks: Column) -> Column:
    """Eight hex digits from the sorted distinct tokens."""
    return set_id(F.sort_array(F.array_distinct(toks)))


def set_id(toks: Column) -> Column:
    """The same from tokens that are sorted and distinct."""
    return F.substring(F.sha2(F.array_join(toks, " "), 256), 1, 8)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if one side is empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))
