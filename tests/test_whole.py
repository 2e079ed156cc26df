"""Queries without SQL over all rows of small fixtures, against brute force."""

import random
import re
from collections import defaultdict
from datetime import datetime
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import privacy
from quillspark.functions import text as t
from quillspark.operators import mining
from quillspark.plans import queries as plans


def test_every_flow_is_routed(spark, tmp_path):
    r = random.Random(3)
    parts = [(k, f"Brand#{k % 3}") for k in range(6)]
    lines = [(o, n, r.randrange(6), r.randrange(12), r.choice("AAAANR")) for o in (1, 2, 1999, 2000, 2001, 70_000, 10**9) for n in range(1, 8)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    rows = [(*x, 5.0, datetime(2024, 1, 1), "O") for x in lines]
    spark.createDataFrame(
        rows,
        "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_quantity double, l_shipdate timestamp_ntz, l_linestatus string",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")

    stats = defaultdict(list)
    for _, _, p, s, flag in lines:
        stats[parts[p][1], f"agent{s % 8}"].append(flag)

    def risk(role, agent):
        flags = stats.get((role, agent), [])
        if len(flags) < 5:
            return "MED"
        if flags.count("A") / len(flags) < 0.7:
            return "HIGH"
        return "MED" if "R" in flags and flags.count("R") / len(flags) >= 0.2 else "LOW"

    flows = defaultdict(list)
    for o, n, p, s, _ in lines:
        flows[o].append((o * 10 + n, "reviewer" if (o * 10 + n) % 4 == 3 else parts[p][1], f"agent{s % 8}"))
    want = []
    for o, steps in flows.items():
        just = False
        steps = [*sorted(steps), (None, None, None)]
        for (at, role, agent), (_, after, _) in zip(steps, steps[1:]):
            level, action = risk(role, agent), "keep"
            add = role != "reviewer" and level != "LOW" and after != "reviewer" and not just
            if add:
                action = "inject_reviewer"
            elif role != "reviewer" and level == "LOW" and after == "reviewer":
                action = "trim_reviewer"
            just = add
            want.append((o, at, role, agent, level, action))
    got = plans.QUERIES["disagreement_routing"](spark, str(tmp_path))
    assert sorted(map(tuple, got.select("flow_id", "ord", "role", "agent", "risk", "action").collect())) == sorted(want)


LONG = "First the parser cache breaks. Then nobody repairs slow tests! " + " ".join(f"Filler number{i} sentence{i}." for i in range(30)) + "\n## Final heading here\n- last bullet stays"
DOCS = [
    (8, LONG, "en", "web"),
    (9, "Broken parser cache", "en", "web"),
    (10, "Сломан кэш разбора. Тесты очень медленные\n```\n- hidden bullet\n```\nконец текста Ёлка", "ru", "web"),
    (11, "Les tests lents restent. slow tests nobody repairs", "fr", "books"),
    (12, "", "en", "web"),
    (13, None, "en", "web"),
    (16, "final heading\n1. last bullet stays\n  \ncache parser breaks first", "de", "books"),
    (17, "it might run. " * 9, "de", "web"),
]


def documents(spark, path):
    spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def words(text, least=2):
    return [w for w in re.findall("[a-zа-яё0-9_]+", text.lower()) if len(w) >= least and (least == 1 or w not in t.STOP_WORDS)]


def titles(text):
    out, fenced = [], False
    for line in re.sub(r"(?<=[^0-9\s][.!?])[ \t]+", "\n", text or "").split("\n"):
        if line.strip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and line.strip():
            out.append(re.sub(r"^(#+|[-*+]|[0-9]+\.)\s+", "", line).strip())
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def test_findings_of_whole_texts(spark, tmp_path):
    sf = documents(spark, tmp_path)
    found = defaultdict(lambda: defaultdict(dict))
    for d, text, _, _ in DOCS:
        for k, title in enumerate(titles(text)):
            if own := frozenset(words(title)):
                found[d // 8][f"role{d % 8}"].setdefault(own, (k, title))
    got = plans.QUERIES["consensus_findings"](spark, sf).collect()
    assert sorted((r["run_id"], r["role"], r["ord"], r["title"]) for r in got) == sorted((run, role, *x) for run, roles in found.items() for role, own in roles.items() for x in own.values())
    fid = {frozenset(words(r["title"])): r["fid"] for r in got}
    want = []
    for run, roles in found.items():
        chosen = []
        for role in sorted(roles):
            for own, _ in sorted(roles[role].items(), key=lambda x: x[1]):
                if all(jaccard(own, c) < 0.4 for c in chosen):
                    chosen.append(own)
        for c in chosen:
            for role, own in roles.items():
                state = "raised" if c in own else "corroborated" if any(jaccard(c, x) >= 0.4 for x in own) else "silent"
                want.append((run, fid[c], role, state))
    got = plans.QUERIES["consensus_matrix"](spark, sf).select("run_id", "canonical", "role", "state").collect()
    assert sorted(map(tuple, got)) == sorted(want) and {x[3] for x in want} == {"raised", "corroborated", "silent"}


def test_patterns_of_all_messages(spark, tmp_path):
    rows = [(c, k, "user", m) for c in range(3) for k, m in enumerate(["Сделай мне новый отчёт, пожалуйста", "run all the tests now", "run all the", "Ünder the old bridge — again", "<command-name> run all the tests"])]
    rows += [(9, 0, "assistant", "run all the tests now"), (9, 1, "user", None), (9, 2, "user", "nobody else says this")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.QUERIES["pattern_mining"](spark, str(tmp_path)).select("prefix", "occurrences", "sessions", "first_at", "last_at", "shown").collect()
    seen = defaultdict(list)
    for c, k, role, m in rows:
        if role == "user" and m and not m.startswith("<command-name>") and len(own := words(m, 1)) >= 2:
            seen[" ".join(own[:2])].append((c, c * 1000 + k))
    want = [(p, len(x), len({c for c, _ in x}), min(o for _, o in x), max(o for _, o in x), min(len(x), 3)) for p, x in seen.items() if len(x) >= 2]
    assert sorted(map(tuple, got)) == sorted(want) and "сделай мне" in {w[0] for w in want}


def test_slop_of_all_languages(spark, tmp_path):
    sf = documents(spark, tmp_path)
    want = {}
    for d, text, _, source in DOCS:
        own = re.findall("[a-zа-яё][a-zа-яё']*", (text or "").lower())
        n = len(own) - 2
        grams = {tuple(own[k : k + 3]) for k in range(n)}
        h, i = sum(w in t.HEDGES for w in own), sum(w in t.IMPERATIVES for w in own)
        trigram, hedge = 1 - len(grams) / n if n > 0 else 0.0, 0.0 if not h else 1.0 if not i else min(h / i, 1)
        want[d] = (40 * trigram + 30 * hedge, len(own), source)
    got = {r["doc_id"]: r for r in plans.QUERIES["slop_components"](spark, sf).collect()}
    assert {d: r["word_count"] for d, r in got.items()} == {d: n for d, (_, n, _) in want.items()}
    assert all(abs(got[d]["score"] - x) < 1e-5 for d, (x, _, _) in want.items()) and got[17]["score"] > 30
    rows = {(r["agent"], r["role"], r["level"]): r for r in plans.QUERIES["slop_by_source"](spark, sf).collect()}
    for source in ("web", "books"):
        own = [x for x, _, s in want.values() if s == source]
        assert rows[source, None, 1]["texts"] == len(own) and abs(rows[source, None, 1]["mean_score"] - sum(own) / len(own)) < 1e-5
    assert rows[None, None, 3]["texts"] == len(DOCS)


def test_pairs_of_whole_texts(spark, tmp_path):
    r = random.Random(6)
    base = [f"слово{k}" if k % 2 else f"word{k}" for k in range(40)]
    docs = [(k, "Same head\n" + " ".join(r.sample(base[k % 3 * 8 :][:22], r.randrange(1, 20))), r.choice(["en", "ru"]), "ab"[k % 2]) for k in range(80)]
    docs += [(100, None, "en", "a"), (101, "", "en", "a"), (102, docs[0][1], "fr", docs[0][3])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {d: (s, set(words(text or ""))) for d, text, _, s in docs}
    want = {(s, a, b): jaccard(x, y) for a, (s, x) in sets.items() for b, (s2, y) in sets.items() if a < b and s == s2 and jaccard(x, y) >= 0.4}
    got = {(r["run_id"], r["a"], r["b"]): r["similarity"] for r in plans.QUERIES["consensus_pairs_all"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_all_kinds_are_scanned(spark, tmp_path):
    values = {
        "windows_path": ["D:\\data\\x", "C:/Users/ann/notes"],
        "user_profile": ["C:/Users/ann/notes"],
        "unix_home": ["/home/ann/notes.txt", "/Users/ann/notes"],  # the second within the profile's path
        "email": ["ann@example.com"],
        "api_token": ["ghp_0123456789abcdefGH"],
        "telegram_id": ["telegram:12345"],
        "raw_message_id": ["msg_0123456789abcd"],
        "raw_session_id": ["0A1b2c3d-0000-1111-2222-0123456789ab"],
        "private_lan_ip": ["192.168.1.20"],
    }
    passages = sorted({x for own in values.values() for x in own if x != "/Users/ann/notes"})
    spark.createDataFrame([(k, f"see {x} there") for k, x in enumerate(passages)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["privacy_findings"](spark, str(tmp_path)).select("doc_id", "kind", "value").collect()
    assert sorted(map(tuple, got)) == sorted((k, kind, x) for kind, own in values.items() for x in own for k, p in enumerate(passages) if x in p)


def test_patterns_against_python(spark, tmp_path):
    """Scrubbing, the release gate and counted markers with Python's regular expressions, which know look-behind too."""
    texts = [
        "mail me.too@ex-ample.org, C:\\Users\\me\\x.txt or /home/me/y and ~ here", "Fuck, DAMN it; thanks! Спасибо, сука", "key ghp_abcdefghijklmnop1234 at 10.1.2.3 and host.local:80",
        "a@example.com b@other.net\n# release-gate: allow c@d.org\nsecret: " + "x" * 40, "D:/диск/файл and http://x/y 172.20.1.9", "", None, "plain", "sk-ant-abc123 xoxb-123456789-a github_pat_" + "a" * 22,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(i, 0, "user", t) for i, t in enumerate(texts) if t is not None], "conv_id long, turn long, role string, text string",
    ).write.parquet(f"{tmp_path}/conversations.parquet")

    def scrubbed(text):
        for pattern, name in ((privacy.PATH_WIN, "[path]"), (privacy.PATH_UNIX, "[path]"), (privacy.EMAIL, "[email]"), (privacy.TOKEN, "[token]")):
            text = re.sub(pattern, name, text)
        return text

    got = {r["doc_id"]: r["text"] for r in plans.QUERIES["public_scrub"](spark, str(tmp_path)).collect()}
    assert got == {i: scrubbed(t or "") for i, t in enumerate(texts)}
    count = lambda x, patterns: sum(len(list(re.finditer(p, x, re.I))) for p in patterns)
    got = {r["conv_id"]: (r["profanity"], r["thanks"]) for r in plans.QUERIES["profanity_count"](spark, str(tmp_path)).collect()}
    assert got == {i: (count(x, t.PROFANITY), count(x, t.THANKS)) for i, x in enumerate(texts) if x is not None}
    want = []
    for i, x in enumerate(texts):
        for n, line in enumerate(re.split("\r\n|\n|\r", x or ""), 1):
            if not re.search(privacy.ALLOW_MARKER, line):
                for kind, severity, pattern in privacy.GATE:
                    want += [(i, n, kind, severity, m[0]) for m in re.finditer(pattern, line) if kind != "email" or not m[0].lower().endswith("@example.com")]
    got = [(r["doc_id"], r["line"], r["kind"], r["severity"], r["value"]) for r in plans.QUERIES["release_gate"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block", [10**6, 150, 1])
def test_pairs_over_blocks(spark, monkeypatch, block):
    """Runs of one block, of several, and of a block for each finding; a finding that comes twice; few meetings at once."""
    r = random.Random(8)
    rows = [(run, f"f{k:03d}", sorted(r.sample([f"t{x}" for x in range(60)], r.choice([1, 2, 5, 12, 30])))) for run, n in (("a", 90), ("b", 7)) for k in range(n)]
    rows = [x for x in rows if block > 1 or x[0] == "b" or x[1] < "f006"]
    found = mining.similar_pairs(spark.createDataFrame([*rows, rows[0], (None, "f1", ["t1"]), ("b", "none", [])], "run_id string, fid string, tokens array<string>"), 0.4, block).collect()
    want = {(i[0], i[1], j[1]): jaccard(set(i[2]), set(j[2])) for i in rows for j in rows if i[0] == j[0] and i[1] < j[1] and jaccard(set(i[2]), set(j[2])) >= 0.4}
    assert len(found) == len(want) > 0 and {(x["run_id"], x["a"], x["b"]): x["similarity"] for x in found} == want
    monkeypatch.setattr(mining, "AT_ONCE", 50)
    own = [i for i in rows if i[0] == "a"]
    parts = list(mining.alike(np.array([int(x[1:]) for i in own for x in i[2]]), np.array([len(i[2]) for i in own]), None, 0.4))
    assert len(parts) > 1 or block == 1
    assert {(own[y][1], own[x][1]): z for p in parts for x, y, z in zip(*p)} == {k[1:]: z for k, z in want.items() if k[0] == "a"}


def test_blocks_that_may_have_pairs_meet_once():
    """Ranges of sizes against all their pairs; a round has no more than it may, or one task."""
    r = random.Random(2)
    for _ in range(200):
        bands, block, least = [], r.randrange(1, 60), r.choice([0.1, 0.4, 0.8, 1.0])
        for run in "ab":
            low = 1
            for band in range(r.randrange(1, 9)):
                high = low + r.randrange(4)
                bands.append((run, band, r.randrange(1, 200), low, high))
                low = high + 1
        dealing, tasks = mining.laid_out(bands, least, block)
        at = {(run, band): range(first, first + parts) for run, band, first, parts in dealing}
        met = [(run, x, y) for run, x, y, _ in tasks]
        assert len(set(met)) == len(met) and all(x <= y for _, x, y in met)
        for run, band, n, low, high in bands:
            assert n <= block * len(at[run, band])
            for run2, band2, _, low2, high2 in bands:
                if run == run2 and band <= band2 and high >= least * low2:
                    assert {(run, min(x, y), max(x, y)) for x in at[run, band] for y in at[run2, band2]} <= set(met)
        lists = list(mining.rounds(tasks, 100))
        assert [t for some in lists for t in some] == tasks and all(len(some) == 1 or sum(t[3] for t in some) <= 100 for some in lists)


def test_rounds_leave_no_shuffle_behind(spark):
    """Before, each of a run's blocks lay on disk as often as the run had blocks."""
    r = random.Random(5)
    hashes = [r.getrandbits(63) for _ in range(4000)]  # (small numbers would be compressed)
    sets = [sorted(r.sample(hashes, r.choice([10, 30, 30]))) for _ in range(400)]
    sets += [x[:-1] for x in sets[::9]]
    rows = spark.createDataFrame([("r", k, x) for k, x in enumerate(sets)] + [("s", 0, [1, 2]), ("s", 1, [1, 2])], "run_id string, fid long, h array<long>")
    dirs = [str(x) for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    on_disk = lambda: sum(f.stat().st_size for d in dirs for f in Path(d).rglob("shuffle_*.data"))
    before = on_disk()
    found = mining.set_pairs(rows, 0.4, 500, at_once=1).collect()
    assert on_disk() - before < 8 * sum(map(len, sets))
    want = {("r", a, b): jaccard(set(x), set(y)) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and jaccard(set(x), set(y)) >= 0.4}
    assert len(found) == len(want) + 1 and {tuple(x)[:3]: x["similarity"] for x in found} == want | {("s", 0, 1): 1.0} and len(want) > 40


def test_runs_in_one_task_and_in_blocks(spark):
    """The matrix of small and of large runs, of findings without tokens and roles without a name, against a loop."""
    r = random.Random(9)
    bits = [f"t{k}" for k in range(25)]
    sets = [sorted(r.sample(bits, r.choice([0, 1, 2, 3, 5, 8]))) for _ in range(60)]
    rows = []
    for run in ("a", "b", "c", None):
        for role in ("r1", "r2", "r3", None):
            for k, f in enumerate(r.sample(range(60), r.choice([0, 3, 25]) if run != "a" else 25)):
                rows.append((run, role, f"f{f:02d}", k, sets[f]))
    df = spark.createDataFrame(rows, "run_id string, role string, fid string, ord int, tokens array<string>")
    want = []
    for run in "abc":
        own = [x for x in rows if x[0] == run]
        chosen = []
        for x in sorted(own, key=lambda x: (x[1] is not None, x[1] or "", x[3], x[2])):
            if x[2] not in {c[2] for c in chosen} and not any(jaccard(set(x[4]), set(c[4])) >= 0.4 for c in chosen):
                chosen.append(x)
        # (equal findings of several roles are one)
        for c in chosen:
            for role in {x[1] for x in own}:
                theirs = [x for x in own if x[1] == role]
                state = "raised" if c[2] in {x[2] for x in theirs} else "corroborated" if any(jaccard(set(c[4]), set(x[4])) >= 0.4 for x in theirs) else "silent"
                want.append((run, c[2], role, "silent" if role is None else state))
    key = lambda x: tuple(map(str, x))
    for found in (mining.consensus(df), mining.consensus(df, most=100), mining.consensus(df, most=0), mining.large_consensus(df)):
        assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert {x[3] for x in want} == {"raised", "corroborated", "silent"} and sum(len(x[4]) for x in rows if x[0] == "a") > 100


def test_matrix_shuffles_texts_only(spark, tmp_path):
    """Before, findings were shuffled a dozen times, and what roles say of them checkpointed."""
    found = plans.QUERIES["consensus_matrix"](spark, documents(spark, tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("Exchange hashpartitioning(run_id") == 1 and "ExistingRDD" not in plan


def test_pairs_shuffle_no_row_for_each_token(spark):
    """Before, each token of each text was a row of two shuffles."""
    rows = spark.range(2).selectExpr("'r' AS run_id", "id AS fid", "array('a', 'b') AS tokens")
    assert "Generate explode(tokens" not in mining.similar_pairs(rows)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_copies_are_dealt_out(spark):
    """Before, all pairs of a run's copies came from one task."""
    rows = spark.range(2500).selectExpr("'r' AS run_id", "id AS fid", "IF(id < 2100, array('a', 'b', 'c'), IF(id < 2490, array('a', 'b'), array('x'))) AS tokens")
    found = mining.similar_pairs(rows).groupBy("similarity", F.spark_partition_id().alias("task")).agg(
        F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") >= F.col("b")).alias("wrong"),
    ).collect()
    sets = [range(2100), range(2100, 2490), range(2490, 2500)]
    same = sum(len(x) * (len(x) - 1) // 2 for x in sets)
    assert {round(x["similarity"], 6) for x in found} == {1.0, 0.666667} and not any(x["wrong"] for x in found)
    assert sum(x["n"] for x in found if x["similarity"] == 1) == same and sum(x["n"] for x in found) == same + 2100 * 390
    assert sum(x["a"] for x in found) == sum(k * (x[-1] - k) for x in sets for k in x) + sum(sets[0]) * 390
    assert sum(x["b"] for x in found) == sum(k * (k - x[0]) for x in sets for k in x) + sum(sets[1]) * 2100
    assert len({x["task"] for x in found}) > 2


def test_titles_between_fences(spark):
    """Any mix of fences, line ends and items, against a loop over lines; before, each title copied those before it, and
    tokens were made twice."""
    r = random.Random(4)
    bits = ["```", "~~~", " ```x", "\n", "\n", "\r\n", "\r", "- a b", "* c", "## h", "##", "1. item", " - no", "text", " ", "\t```", "-  "]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(3000)] + [None]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, text string").select("k", t.finding_titles(F.col("text")).alias("x")).collect()
    for row in got:
        want, fenced = [], False
        for line in re.split("\r\n|\n|\r", texts[row["k"]] or ""):
            own = line.strip(" ")
            if own.startswith(("```", "~~~")):
                fenced = not fenced
            elif not fenced and own.startswith("##"):
                want.append(own.lstrip("# "))
            elif not fenced and (m := re.match(r"(?:[-*+]|[0-9]+\.)\s+(.+)", line)) and m[1].strip(" "):
                want.append(m[1].rstrip(" "))
        assert row["x"] == want, texts[row["k"]]
    plan = mining.findings(spark.createDataFrame([(1, "a", "- b")], "run_id long, role string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "aggregate(" not in plan
