"""Periodic runs, ranked lexical search and the URL filter against brute force, and the defined results of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from holdfast.llm import lexical, periodic, urlfilter
from holdfast.llm.queries import with_planted_runs

SCHEMA = "doc_id bigint, text string, key string, id string, n bigint, term string, score string, words string, a string, row string"


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", "y", 5, "z", "u", "v", "w", "r") for k, t in texts], SCHEMA)


def odd_texts():
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["the", "of", "é", "###", "12", "中文", "a.\n"]) for _ in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "ab cd " * 30), (5, "ab cd " * 30), (7, long), (None, "the x " * 12), (8, "x  y ▁ \u3000z \x0b q"), (9, "𝒳 " * 300)]


def brute_runs(a, least):
    runs = {}
    for q in range(1, len(a) // 2 + 1):
        i = 0
        while i + q < len(a):
            j = i
            while j + q < len(a) and a[j] == a[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                runs.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in runs.items()), key=lambda r: (r[0], r[2]))


def sequence(rnd, kind):
    letters = rnd.choice([1, 2, 3, 40])
    if kind == 0:
        return [rnd.randrange(letters) for _ in range(rnd.randint(0, 220))]
    if kind == 1:
        return ([rnd.randrange(9) for _ in range(5)] + [rnd.randrange(letters) for _ in range(rnd.randint(1, 90))] * rnd.randint(1, 6))[:320]
    if kind == 2:  # short-period stretches, broken and shifted
        out, base = [], [rnd.randrange(2) for _ in range(rnd.randint(1, 4))]
        for _ in range(rnd.randint(1, 5)):
            out += base * rnd.randint(1, 40) + base[: rnd.randint(0, len(base))] + [7] * (rnd.random() < 0.4)
        return out[:320]
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < 250:
            a, b = b, b + a
        return b[: rnd.randint(100, 250)]
    if kind == 4:
        u = ([0, 1] * 60)[: rnd.randint(20, 101)]
        return u + u + u[: rnd.randint(0, 50)]
    u = sequence(rnd, rnd.randrange(5))[:100]
    return u + u[: rnd.randint(0, 100)] + u


@pytest.mark.parametrize(("least", "base"), [(2, 4), (3, 8), (12, 32)])
def test_runs_equal_brute_force(least, base):
    rnd = random.Random(base)
    for _ in range(60):
        parts = [sequence(rnd, kind) for kind in range(6)]
        got = periodic.runs_of([np.array(p, dtype=np.int64) for p in parts], least, base)
        assert got == [brute_runs(p, least) for p in parts]


def test_long_periods_in_a_long_text():
    rnd = random.Random(5)
    unit = [rnd.randrange(500) for _ in range(7_001)]
    a = [501, *unit * 3, 502, *[3, 4] * 4_000, 503, *[3, 4] * 4_000, 503]
    got = periodic.runs_of([np.array(a, dtype=np.int64)])[0]
    assert got == [(1, 21_003, 7_001), (21_005, 8_000, 2), (21_005, 16_002, 8_001), (29_006, 8_000, 2)]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_find_runs_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "CHUNK_WORDS", 100)
    texts = odd_texts()
    rows = periodic.find_runs(frame(spark, texts).repartition(3)).collect()
    want = []
    for k, t in texts:
        words = split(t)
        runs = brute_runs(words[:2_000], 12) if len(words) < 2_000 else None
        want.append((k, len(words), runs))
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]] if r["n_words"] < 2_000 else None) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["collapsed"] == "ab cd" and by[9]["collapsed"] == "𝒳" and by[1]["collapsed"] == by[3]["collapsed"] == ""
    none = periodic.digest(periodic.find_runs(frame(spark, [])))
    assert none.count() == 0
    digests = {r["doc_id"]: r for r in periodic.digest(periodic.find_runs(frame(spark, texts))).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(digests[1])[1:] == (0, None, None, None, None, empty, empty)
    assert tuple(digests[5])[1:6] == (1, 0, 60, 2, 30_000)
    assert digests[5]["runs_sha256"] == hashlib.sha256(b"0,60,2\n").hexdigest()


def test_planted_runs_query(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    planted = {r["doc_id"]: split(r["text"]) for r in with_planted_runs(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    rows = {r["doc_id"]: r for r in entry.queries()["op11_periodic_runs"](spark, folder).collect()}
    assert rows.keys() == docs.keys()
    repeated = 0
    for k, text in docs.items():
        words, h = split(text), zlib.crc32(str(k).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            repeated += 1
        assert planted[k] == words
        if n < 600:
            runs = brute_runs(words, 12)
            dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
            top = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
            assert tuple(rows[k])[1:] == (
                len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
                hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest(),
            )
    assert repeated > 5


def brute_ranks(texts, items, top):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(k, Counter(w), len(w)) for k, t in texts if (w := terms(t))]
    n_docs, n_terms = len(docs), sum(n for _, _, n in docs)
    out = []
    for item in {i for i, t in items if i is not None and t is not None}:
        asked = Counter(w for t in {t for i, t in items if i == item and t is not None} for w in terms(t))
        found = []
        for k, own, n in docs:
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for w, times in asked.items():
                df = sum(1 for _, c, _ in docs if w in c)
                score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((10**9 * own[w]) // (1000 * own[w] + 12 * m))
            if score > 0:
                found.append((-score, k is None, k))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, rank + 1, k, -s) for rank, (s, _, k) in enumerate(found[:top])]
    return Counter(out)


@pytest.mark.parametrize(("block_bytes", "cells"), [(8_000_000, 2_000_000), (60, 40)])
def test_ranks_equal_brute_force(spark, monkeypatch, block_bytes, cells):
    rnd = random.Random(4)
    vocabulary = ["sea", "Wind", "é", "中文", "a1", "x", "the", "the", "of", "sea2"]
    texts = [(k, " ".join(rnd.choice(vocabulary) + rnd.choice(["", ",", "-x", "\n"]) for _ in range(rnd.randint(0, 30)))) for k in range(70)]
    texts += [(None, "sea wind"), (90, None), (91, "..."), (5, texts[6][1]), (200, "sea"), (201, "sea"), (202, "sea" * 3), (203, "x " * 20_000)]
    items = [("a", "sea the sea"), ("b", "X"), ("c", "missing"), ("d", ""), ("e", None), (None, "sea"), ("f", "中文-é of"), ("f", "中文-é of"), ("f", "wind"), ("g", "the")]
    monkeypatch.setattr(lexical, "CELLS", cells)
    asked = spark.createDataFrame([(i, t, "n") for i, t in items], "item_id string, text string, doc_id string")
    got = lexical.rank_documents(frame(spark, texts).repartition(5), asked, top=4, block_bytes=block_bytes)
    assert Counter(tuple(r) for r in got.collect()) == brute_ranks(texts, items, 4)


def test_ranks_of_empty_tables(spark):
    docs, items = frame(spark, [(1, "sea"), (2, None)]), spark.createDataFrame([(1, "sea")], "item_id int, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs.where("doc_id = 2"), items).count() == 0
    none = lexical.rank_documents(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert [tuple(r)[:3] for r in lexical.rank_documents(docs, items).collect()] == [(1, 1, 1)]


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), (None, "/", "block")]


def brute_rule(host, path):
    fits = [r for r in RULES if r[0] and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fits, key=lambda r: len(r[0] + r[1])) if fits else None


def urls():
    rnd = random.Random(6)
    made = [f"{rnd.choice(['http', 'https'])}://{rnd.choice(['', 'www.', 'M.', 'blog.'])}{rnd.choice(['example', 'Example', 'sea', 'wind', 'xexample'])}.{rnd.choice(['com', 'net', 'org'])}"
            f"{rnd.choice(['', '/'])}{rnd.choice(['', 'en/', 'es/', 'de/', 'en'])}{rnd.choice(['', '12', '?a=/b#c', '#/en/'])}" for _ in range(400)]  # fmt: skip
    return [None, "", "no scheme/en/", "://", "://com", "a://com?x=://y", "http://com/", "https://中文.com/é?q", "x://www.example.com/en/\n1", *made, "http://www.sea.org/" + "q" * 50_000]


def rule_frame(spark):
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


@pytest.mark.parametrize("block_rules", [200_000, 1])
def test_urls_and_rules(spark, block_rules):
    rows = [(k, u, "x", "y", "z", "v", "w") for k, u in enumerate(urls())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, rule string, key string, ratio string").repartition(4)
    got = {r["page_id"]: r for r in urlfilter.judge(pages, rule_frame(spark), block_rules=block_rules).collect()}
    assert len(got) == len(rows)
    for k, u, *_ in rows:
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = brute_rule(host, path)
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert got[k]["verdict"] == (rule[2] if rule else "allow" if math.floor(round(got[k]["score"] * urlfilter.BINS, 6)) >= 0 else "block")


def brute_ratio(accepted, rejected, url, order=urlfilter.ORDER):
    def chance(sample, data, i):
        p = 1 / 256
        for k in range(order + 1):
            context, follows = data[i - k : i], Counter()
            for s in sample:
                for j in range(order, len(s)):
                    if s[j - k : j] == context:
                        follows[s[j]] += 1
            if total := sum(follows.values()):
                p = (follows[data[i]] + len(follows) * p) / (total + len(follows))
        return p

    marked = lambda u: b"\x02" * order + u.encode() + b"\x03"
    a, r, data = [marked(u) for u in accepted], [marked(u) for u in rejected], marked(url)
    return sum(math.log(chance(a, data, i)) - math.log(chance(r, data, i)) for i in range(order, len(data))) / (len(data) - order)


def test_character_models_equal_brute_force(spark):
    accepted, rejected = ["sea.com/a", "sea.com/ab", "wind.com/é"], ["bad.net/es/1", "bad.net/es/22"]
    hosted = [(u, "allow") for u in accepted] + [(u, "block") for u in rejected] + [("org", None)]
    hosted = [(f"h{next(i for i in range(99) if zlib.crc32(f'h{i}'.encode()) % 5)}", u, v) for u, v in hosted]
    model = urlfilter.learn(spark.createDataFrame(hosted, "host string, address string, ruled string").repartition(3))
    asked = ["sea.com/a", "bad.net/es/3", "", "zzz", "é"]
    assert model.ratios(asked) == pytest.approx([brute_ratio(accepted, rejected, u) for u in asked], rel=1e-9)
    cut = [(-3, 0, 5), (-1, 1, 1), (2, 4, 0)]
    merits = {c: sum(a for s, a, _ in cut if s >= c) / 5 + sum(r for s, _, r in cut if s < c) / 6 for c in range(-9, 9)}
    assert merits[urlfilter.best_cut(cut)] == max(merits.values()) and urlfilter.best_cut(cut) == -1
    assert urlfilter.best_cut([(5, 1, 0)]) == 0


def test_rare_grams_leave_the_model(spark):
    rows = [("h0" if zlib.crc32(b"h0") % 5 else "h1", "aaaaaaaaaa", "allow")] * 50 + [("h0" if zlib.crc32(b"h0") % 5 else "h1", "b", "block")] * 200
    docs = spark.createDataFrame([*rows, (rows[0][0], "aaaaaq", "allow")], "host string, address string, ruled string")
    all_grams, few = urlfilter.learn(docs), urlfilter.learn(docs, 0.01)
    assert len(few.gram) < len(all_grams.gram) and ord("q") not in (few.gram & 255) and ord("q") in (all_grams.gram & 255)


def test_one_sample_or_none(spark):
    pages = spark.createDataFrame([(1, "http://sea.com/x"), (2, "http://sea.org/"), (2, None)], "page_id int, url string")
    rules = rule_frame(spark)
    assert {r["verdict"] for r in urlfilter.judge(pages, rules).collect()} == {"allow"}
    assert [r["verdict"] for r in urlfilter.judge(pages, rules.where("verdict = 'block'")).collect()] == ["allow"] * 3
    only = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    assert {r["verdict"] for r in urlfilter.judge(pages, only).collect()} == {"block"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
