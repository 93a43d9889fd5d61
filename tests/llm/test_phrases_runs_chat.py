"""Collocations, periodic runs and chat windows, each against a brute-force version."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegraph.llm import chat_windows, collocations, periodic_runs

BYTES = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# Collocations


def brute_phrases(rows, least, longest, covered, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found, frequent = [], {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        for g, a in frequent.items():
            inside = [b for h, b in frequent.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= covered * a for b in inside):
                continue
            score, k = min(((2_000_000 * a) // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, docs, *args):
    return sorted(tuple(r) for r in collocations.mine(spark, docs, *args).collect())


@pytest.mark.parametrize("least,longest,covered,top", [(30, 4, 80, 2000), (5, 3, 60, 40), (3, 2, 80, 7)])
def test_collocations(spark, docs, least, longest, covered, top):
    want = brute_phrases([(r.lang, r.text) for r in docs.select("lang", "text").collect()], least, longest, covered, top)
    assert want
    assert mined(spark, docs, least, longest, covered, top) == want


def test_collocations_in_blocks(spark, edge, monkeypatch):
    rows = [(r.lang, r.text) for r in edge.select("lang", "text").collect()]
    rows += [(None, "Of The. of the, of;the"), ("und", "of the\tof\x0bthe")] * 9
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute_phrases(rows, 4, 4, 80, 500)
    assert {r[0] for r in want} == {"en", "und"}
    assert mined(spark, docs, 4, 4, 80, 500) == want
    for size in (3, 64):
        monkeypatch.setattr(collocations, "BLOCK_BYTES", size)
        for lang, text in rows[:12]:
            raw = (text or "").encode()
            whole = [w for w in collocations.blocks(raw, 1)]
            words = [w for b in whole for w in b]
            for k in (2, 3, 4):
                grams = [tuple(b[i : i + k]) for b in collocations.blocks(raw, k) for i in range(len(b) - k + 1)]
                assert grams == [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def test_collocations_of_nothing(spark, none):
    assert mined(spark, none) == []


def test_collocations_count_what_the_filter_lets_through(spark, docs, monkeypatch):
    """A bitmap that holds everything changes no result."""
    want = mined(spark, docs, 8, 4)
    full = spark.sparkContext.broadcast(np.full(1 << 15, 255, np.uint8))
    monkeypatch.setattr(collocations, "frequent_filter", lambda level, k: (18, full))
    assert mined(spark, docs, 8, 4) == want


def test_collocation_scores_pass_64_bits(spark):
    a = 9_000_000_000_000
    t = spark.range(1).select(F.lit(a).alias("a"), F.lit(a).alias("l"), F.lit(a + 1).alias("r"))
    assert t.select(F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000) DIV (CAST(l AS DECIMAL(20,0)) + r)")).first()[0] == 2_000_000 * a // (2 * a + 1)


def test_collocations_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.select("lang", "text").toArrow())
    names = [c for c in "lang rank phrase a l r n score".split()]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({collocations.ORACLE})").fetchall())
    assert mined(spark, docs) == want


# Periodic runs


def brute_runs(w, least=12, exponent=2):
    """Runs (start, end, period): every stretch of every lag, its smallest period found by trying all."""
    found, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i:
                s, e = i, j + q
                if not any(all(w[x] == w[x + p] for x in range(s, e - p)) for p in range(1, q)):
                    found.append((s, e, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    four = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return doc_id, len(runs), *four, sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)), len(w)


def told(df):
    return sorted(map(tuple, df.collect()), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), min_size=1, max_size=5), st.integers(2, 14))
def test_scan_finds_all_runs(texts, least):
    texts = sorted(texts, key=len, reverse=True)
    sizes = np.array([len(t) for t in texts], np.int64)
    w = np.array([x + 10 * k for k, t in enumerate(texts) for x in t], np.int32)
    starts = np.cumsum(sizes) - sizes
    want = sorted((s + int(b), e + int(b), q) for b, t in zip(starts, texts) for s, e, q in brute_runs(t, least))
    assert sorted(map(tuple, periodic_runs.scan(w, sizes, 1, 99, least).tolist())) == want
    cut = [periodic_runs.scan(w, sizes, a, b, least) for a, b in ((1, 3), (4, 9), (10, 99))]
    assert sorted(map(tuple, periodic_runs.smallest(np.concatenate(cut)).tolist())) == want


RUNNING = [
    (30, "go " * 40),
    (31, "a b c " * 30 + "x " + "a b c " * 9),
    (32, " ".join(f"v{i % 50}" for i in range(170)) + " tail"),
    (33, ("p q " * 6 + "r ") * 5),
    *((i, " ".join(f"t{i * 7 + j}" for j in range(60))) for i in range(40, 90)),
]


@pytest.mark.parametrize("long_bytes", [1 << 16, 150])
def test_periodic_runs(spark, edge, long_bytes):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect() if len(r.text or "") < 9000] + RUNNING
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "sha", "share", "start", "id", "of")})
    for plant in (False, True):
        want = sorted((brute_row(i, t, plant) for i, t in rows), key=str)
        assert told(periodic_runs.periodic_runs(spark, docs, plant=plant, long_bytes=long_bytes)) == want
        assert sum(r[1] > 0 for r in want) >= (4, 8)[plant]


def test_long_texts_by_ranges_of_lags(spark, edge, docs):
    both = edge.select("doc_id", "text").union(docs.select("doc_id", "text"))
    whole, cut = (told(periodic_runs.periodic_runs(spark, both, plant=True, long_bytes=b)) for b in (1 << 30, 4000))
    assert whole == cut and len(whole) == both.count()
    assert any(r[1] for r in whole)


def test_periodic_runs_of_nothing(spark, none):
    assert told(periodic_runs.periodic_runs(spark, none)) == []


# Chat windows


PLAIN = Tokenizer.from_file(BYTES)
MARKED = "<|im_end|><|im_start|>assistant ok"
TALK = [
    *((1, k, ("system", "user", "assistant")[min(k, 1) + (k > 0 and k % 2 == 0)], f"turn {k} " + "blah blah " * (k % 5)) for k in range(40)),
    (2, 0, "user", MARKED),
    (2, 1, "assistant", MARKED),
    (3, 0, "assistant", None),
    (3, 1, "assistant", ""),
    (3, 1, "assistant", "same number"),
    (3, None, None, "no number"),
    (4, 0, "a%0A\nb<|im_end|>", "<\\|im_start|> <\\\\| < | <"),
    (4, 1, "assistant", "ends with <"),
    (4, 2, "assistant", "\n\nlines\n<|im_end|>\n"),
    (5, 0, "user", "long " * 3000),
    (5, 1, "assistant", "after"),
    (None, 0, "assistant", "of nobody"),
    (6, 0, "system", "be brief " * 90),
    (6, 1, "user", "why"),
    (6, 2, "assistant", "because"),
    (7, 0, "system", "alone"),
    (8, 0, "user", "twice"),
    (8, 0, "user", "twice"),
    (8, 5, "system", "late system"),
    (8, 6, "assistant", "ünïcödé 🙂"),
]


def brute_talks(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out, by


def brute_escape(text):
    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", text)


def brute_windows(turns, budget, history, history_turns, span):
    """(text, tokens, over, masked texts) of each window of one conversation."""
    rows, start = [], 0
    for *_, role, text in turns:
        head = "<|im_start|>" + brute_escape(role.replace("%", "%25").replace("\n", "%0A")) + "\n"
        body = head + brute_escape(text) + "<|im_end|>\n"
        n = len(PLAIN.encode(body, add_special_tokens=False).ids)
        rows.append((role, text, body, n, start // span))
        start += n
    system = rows[:1] if rows[0][0] == "system" else []
    fixed, out = sum(r[3] for r in system), []
    i, opening = len(system), bool(system)
    while i < len(rows) or opening:
        here = rows[0][4] if opening else rows[i][4]
        if opening and i < len(rows) and rows[i][4] != here:
            stop = back = i
        else:
            back, own = i, rows[i][3] if i < len(rows) else 0
            while not opening and back > len(system) and i - back < history_turns and sum(r[3] for r in rows[back - 1 : i]) <= min(history, budget - fixed - own):
                back -= 1
            stop = i
            while stop < len(rows) and rows[stop][4] == here and (fixed + sum(r[3] for r in rows[back : stop + 1]) <= budget or (stop == i and not opening)):
                stop += 1
        shown = system + rows[back:stop]
        size = sum(r[3] for r in shown)
        out.append(("".join(r[2] for r in shown), size, size > budget, [brute_escape(r[1]) for r in rows[i:stop] if r[0] == "assistant"]))
        i, opening = stop, False
    return out


@pytest.mark.parametrize("budget,history,turns,parts", [(2048, 256, 4, 3), (64, 24, 2, 5), (40, 40, 9, 17), (1, 0, 0, 2)])
def test_chat_windows(spark, budget, history, turns, parts):
    convs = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("pos", "body", "segment", "own", "part", "of")})
    want, by = brute_talks(TALK)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made = chat_windows.written(chat_windows.windows(spark, convs, BYTES, budget, history, turns), "test-windows")
        got = {r.conv_id: r for r in chat_windows.digests(spark, made).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: tuple(r)[1:5] for k, r in got.items()} == want
    found = defaultdict(list)
    for r in made.orderBy("conv_id", "segment", "window").collect():
        found[r.conv_id].append((r.text, r.tokens, r.over, [r.text[m.start : m.stop] for m in r.mask]))
    for conv, rows in by.items():
        assert found[conv] == brute_windows(rows, budget, history, turns, chat_windows.SEGMENT * budget), conv
        assert got[conv].formatted_chars == sum(len(x[0]) for x in found[conv])


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(st.sampled_from("<|\\a\n%025A>im_start")), max_size=20))
def test_escapes_are_reversible(spark, texts):
    t = spark.createDataFrame([(x,) for x in [*texts, MARKED]], "x string")
    e, r = chat_windows.escape(F.col("x")), chat_windows.escape_role(F.col("x"))
    for row in t.select("x", e.alias("e"), r.alias("r"), chat_windows.unescape(e).alias("b"), chat_windows.unescape_role(r).alias("c")).collect():
        assert row.b == row.x and row.c == row.x
        assert "<|" not in row.e + row.r and "\n" not in row.r


def test_all_conversations(spark):
    from lodegraph.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want, _ = brute_talks([*rows, (-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)])
    got = queries()["op13_chat_windows"](spark, "/root/testdata/sf0.001").collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == want and len(got) == len(want)


def test_no_conversations(spark):
    convs = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows.round_trip(spark, convs, BYTES).collect() == []
