"""Corpus operators on small tables: brute force, exact round trips, and the defined results of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from holdfast.llm import chat, decontaminate, htmltext, langid, lm, neardup, packing, quality_fm, rules, tokencount
from holdfast.llm.queries import QUERIES, tokenizer_file

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, words string, node string, score string, component string"


def frame(spark, texts, langs=None):
    rows = [(k, t, (langs or {}).get(k), "s", None, "x", "y", "z", "u", "v") for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rnd = random.Random(3)
    long = " ".join(rnd.choice(["the", "of", "ering", "thon", "é", "###", "12", "中文", "a.\n"]) for _ in range(40_000))
    twice = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 3
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, twice), (6, twice), (7, long), (7, long), (None, "A b c d e f g h i j k l"), (8, "x  y ▁ <s> </s>　z"), (9, "𝒳" * 300)]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, odd_texts()).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_token_counts_equal_the_library(spark, odd, empty):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for chunk in (65_536, 1000):
        got = Counter(map(tuple, tokencount.count_tokens(odd, path, chunk_chars=chunk).collect()))
        want = Counter((k, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for k, t in odd_texts())
        assert got == want
    assert tokencount.count_tokens(empty, path).count() == 0


def test_chunk_maps_compose_in_any_way():
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    library, transducer, rnd = sentencepiece.SentencePieceProcessor(model_file=path), tokencount.transducer_of(path), random.Random(1)
    parts = [" ", "  ", "▁", "a", "th", "the", "\n", "é", "𝒳", "ing", "12", " the", "    ", "中", "<s>", " " * 17]
    for _ in range(500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 30)))
        marked, size = tokencount.MARK + text.replace(" ", tokencount.MARK), rnd.randint(1, 6)
        maps = [transducer.chunk(marked[k : k + size]) for k in range(0, len(marked), size)]
        assert transducer.total(maps) == transducer.tokens(text) == len(library.encode(text))


def test_quality_machine(spark, empty):
    rnd = random.Random(2)
    good = [" ".join(rnd.choice(["the", "sea", "and", "wind", "moved", "over", "hills"]) for _ in range(60)) + "." for _ in range(60)]
    bad = [" ".join(rnd.choice(["the%%%", "sea###", "and***", "wind$$$"]) for _ in range(60)) for _ in range(60)]
    docs = frame(spark, [*enumerate(good + bad), (500, None), (501, ""), (3, good[3])])
    labels = spark.createDataFrame([(k, int(k < 60), 0) for k in range(120)] + [(3, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality_fm.classify(docs, labels).collect()
    assert len(rows) == 123 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 120]
    assert held and all(r["predicted"] == (r["doc_id"] < 60) for r in held)
    assert quality_fm.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality_fm.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_machine_learns_from_one_row_of_each_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_fm.Machine, "learn", lambda self, rows, labels: seen.append((len(rows), labels.tolist())))
    docs = frame(spark, [(7, f"hot text {k % 5}") for k in range(3000)] + [(8, "good one"), (9, None)]).repartition(6)
    labels = spark.createDataFrame([(7, 0), (8, 1), (9, 1)], "doc_id bigint, quality int")
    quality_fm.fit(docs, labels)
    assert seen == [(3, [0.0, 1.0, 1.0])]


def test_pairs_by_sums_of_squares():
    machine, rnd = quality_fm.Machine.start(), np.random.default_rng(0)
    machine.vectors[:] = rnd.normal(size=machine.vectors.shape)
    index, value = np.array([1, 5, 9, 70]), rnd.normal(size=4).astype(np.float32)
    pairs = sum(machine.vectors[index[i]] @ machine.vectors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert machine.terms(index, value, np.array([0]))[0][0] == pytest.approx(pairs, rel=1e-4)


def brute_hits(texts, items, window=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    found = []
    for key, text in texts:
        own, hit, items_hit = split(text), set(), set()
        for item, item_text in items:
            w = split(item_text)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if w else 0):
                for j in range(len(own) - n + 1):
                    if own[j : j + n] == w[i : i + n]:
                        hit |= set(range(j, j + n))
                        items_hit.add(str(item))
        found.append((key, len(own), len(hit), len(items_hit), hashlib.sha256(",".join(sorted(items_hit)).encode()).hexdigest(), bool(hit)))
    return Counter(found)


@pytest.mark.parametrize("block_words", [2_000_000, 8])
def test_decontamination_equals_brute_force(spark, empty, block_words):
    item = "One two three, four five six seven eight nine ten eleven twelve"
    items = [(1, item), (2, "short Item"), (10, "short item"), (3, None), (4, " - "), (None, "lost"), (1, item)]
    texts = [(1, f"x {item.upper()} y"), (2, "a short-item here short item"), (3, None), (4, ""), (5, "two three four five six seven eight nine ten eleven"), (5, "one two three"), (None, "short item")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, texts)
    got = Counter(map(tuple, decontaminate.digest(decontaminate.find_hits(docs, benchmark, block_words=block_words)).where("doc_id is not null or n_hit >= 0").collect()))
    assert got == brute_hits(texts, [(i, t) for i, t in items if i is not None])
    assert decontaminate.find_hits(empty, benchmark).count() == 0
    assert decontaminate.digest(decontaminate.find_hits(docs, benchmark.limit(0))).where("contaminated").count() == 0
    kept = decontaminate.remove_contaminated(docs, benchmark)
    assert kept.schema == docs.schema and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(docs.where("doc_id < 3"), benchmark, max_share=0.95).collect()}
    assert spans == {1: "x  y", 2: "a  here "}


PAGE = (
    '<html><head><title>T</title><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>'
    '<div class="post-{n} content"><h1>Head &amp; line</h1><p>First <b>bold</b>\n text here &eacute;.<br>More<p>Second paragraph is somewhat longer than that.'
    '<div class="ad">Buy</div><ul><li>One<li>Two</ul></div><div class="comments"><p>Reader says a great deal of things that nobody asked for, at length.</p></div>'
    '<aside>Side</aside><form><input name=x>Send</form><!-- c --><footer>&copy; me</footer></body></html>'
)
TEXT = "Head & line\n\nFirst bold text here é. More\n\nSecond paragraph is somewhat longer than that.\n\nOne\n\nTwo"


def test_main_text(spark):
    pages = [(k, f"http://www.Host.example/{k}", PAGE.replace("{n}", str(k))) for k in range(4)]
    pages += [(10, None, None), (11, "x", ""), (12, "http://a.b/c", "plain words only"), (3, pages[3][1], pages[3][2]), (13, "http://q.example", '<div class="a"><p>cut off in the mid&am')]
    got = htmltext.main_text(spark.createDataFrame([(*p, 1, 2) for p in pages], "page_id bigint, url string, html string, host int, paths int"))
    rows = [tuple(r) for r in got.collect()]
    want = [(*p[:2], TEXT, len(TEXT)) for p in pages if p[0] < 4]
    want += [(10, None, "", 0), (11, "x", "", 0), (12, "http://a.b/c", "plain words only", 16), (13, "http://q.example", "cut off in the mid&am", 21)]
    assert Counter(rows) == Counter(want)
    assert htmltext.main_text(got.limit(0).selectExpr("page_id", "url", "text as html")).count() == 0


def test_main_text_of_deep_and_long_markup():
    page = '<div class="a>b n7">' * 20_000 + "<p>in the " + "<i>deep</i> " * 20_000
    found = htmltext.blocks(page)
    path, _ = htmltext.best(found)
    assert path.endswith("div.a-b.nN") and htmltext.extract(found, [path]) == " ".join(["in the"] + ["deep"] * 20_000)
    assert htmltext.extract(found, ["#>div.other"]) == htmltext.extract(found, [])


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(odd, path, capacity=64, with_ids=True).collect()
    want, total = Counter(), 0
    for key, text in odd_texts():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        want.update((key, k // 64, k, tuple(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64))
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"]), r["ids_crc32"]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64
    assert len(sequences) == -(-total // 64)
    assert packing.pack_documents(empty, path).count() == 0


def test_fullest_bins_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        available = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(1, 30)
        sums = {0}
        for n, c in available.items():
            sums |= {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        chosen = packing.fullest(available, room)
        assert sum(chosen) == max(sums) and all(Counter(chosen)[n] <= available[n] for n in chosen)


def test_quality_rules(spark, odd, empty):
    for r in rules.digest(odd).collect():
        text = next(t for k, t in odd_texts() if k == r["doc_id"]) or ""
        own = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen, covered = Counter(tuple(own[k : k + 8]) for k in range(len(own) - 7)), set()
        for k in range(len(own) - 7):
            if seen[tuple(own[k : k + 8])] > 1:
                covered |= set(range(k, k + 8))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(own),
            sum(map(len, own)),
            len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)),
            len(covered),
        )
        assert r["base_failed"] == (len(own) < 20 or 100 * len(covered) > 30 * len(own)) and not (r["kept"] and r["base_failed"])
    assert rules.digest(empty).count() == 0
    assert rules.keep_good(odd).schema == odd.schema


def test_texts_of_other_scripts_are_not_voted_against(spark):
    rnd = random.Random(11)
    words = lambda n: [f"word{rnd.randrange(500)}" for _ in range(n)]
    texts = [(k, " ".join(words(60)) + ".") for k in range(60)]
    texts += [(100 + k, " ".join(words(60)) + " यह एक वाक्य है।") for k in range(30)] + [(200 + k, " ".join(words(60))) for k in range(30)]
    rows = rules.digest(frame(spark, texts)).collect()
    assert all(r["kept"] and "-" not in r["votes"] for r in rows) and {r["votes"][6] for r in rows if r["doc_id"] >= 200} == {"0"}


def test_votes_of_a_mixed_corpus():
    good = rules.posteriors({"++++": 900, "+++0": 50, "-+++": 60, "--+-": 40, "0000": 1})
    assert good["++++"] > 0.8 > 0.5 > good["-+++"] > good["--+-"] and good["+++0"] > 0.5
    assert rules.posteriors({}) == {}


def test_language_model(spark, empty):
    rnd = random.Random(4)
    vocabulary = {"aa": ["toren", "molen", "kaas", "water"], "bb": ["vino", "casa", "mesa", "agua"]}
    texts = [(k, " ".join(rnd.choice(vocabulary["aa" if k % 2 else "bb"]) for _ in range(20))) for k in range(200)]
    langs = {k: "aa" if k % 2 else "bb" for k, _ in texts}
    odd_rows = [(900, None), (901, "12 -- 3"), (902, "½ Ⅷ"), (903, "torenmolen"), (None, "casa mesa"), (4, texts[4][1])]
    got = langid.identify(frame(spark, texts + odd_rows, langs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 206 and all(by[k]["lang_pred"] == v for k, v in langs.items())
    assert [by[k]["lang_pred"] for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(empty).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame(spark, texts[:3])).collect()} == {"und"}


@pytest.mark.parametrize("known", [3, 120_000])
def test_every_counted_word_tells_its_language(spark, monkeypatch, known):
    monkeypatch.setattr(langid, "KNOWN_WORDS", known)
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    own = {"aa": [word() for _ in range(400)], "bb": [word() for _ in range(20)]}
    texts = [(k, " ".join(own["aa"])) for k in range(20)] + [(100, " ".join(own["bb"]))]
    model = langid.fit(frame(spark, texts, {k: "aa" if k < 100 else "bb" for k, _ in texts}))
    cases = [(1, own["bb"][3]), (2, own["aa"][3]), (3, " ".join(own["bb"])), (4, None), (4, own["bb"][7][:5] + "zz")]
    got = langid.predict(frame(spark, cases), model).collect()
    labelled = [(t, "aa" if k < 100 else "bb") for k, t in texts]

    def brute(text):
        return brute_language(labelled, text) if text else ("und", 0.0)

    want = sorted((k, *brute(t)) for k, t in cases)
    assert [(r[0], r[1], pytest.approx(r[2], abs=1e-9)) for r in want] == sorted(map(tuple, got))
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 3)} == {1: "bb", 3: "bb"}


def test_chats_come_back(spark):
    texts = ["\\### Assistant: </turn> ok", "", "a\\b\\h\\l\\c #< </turn>\n### user: x", "é𝒳", None, "\\"]
    roles = ["user", "assistant", "a: b", None, "system", "assistant"]
    rows = [(1, k, roles[k], texts[k], "q") for k in range(6)] + [(2, 0, "user", "hi", "q"), (2, 1, "assistant", "yo", "q"), (3, 0, "assistant", "x", "q"), (None, None, "user", "u", "q")]
    got = {r["conv_id"]: r for r in chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, segments string"))).collect()}
    for key in (1, 2, 3, None):
        own = [(r or "", t or "") for k, _, r, t, _ in rows if k == key]
        loss = "".join(t for r, t in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[key][c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want
    assert [got[k]["well_formed"] for k in (1, 2, 3, None)] == [False, True, False, True]


def near_rows():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(30):
        base = [word() for _ in range(rnd.randint(20, 120))]
        rows.append(base)
        for _ in range(rnd.randint(0, 6)):
            copy = list(rnd.choice(rows[-3:]))
            for _ in range(rnd.randint(0, max(1, len(copy) // 14))):
                copy[rnd.randrange(len(copy))] = word()
            rows.append(copy)
    return [(k, " ".join(r)) for k, r in enumerate(rows)] + [(900, None), (901, ""), (902, "Solo"), (903, "solo"), (904, " \n"), (None, "solo"), (5, " ".join(rows[5]))]


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, empty, shingle):
    texts = near_rows()
    sets = {k: neardup.shingles(neardup.words(t), shingle) for k, t in texts if k is not None}
    label = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    for rounds in (0, 2):
        got = Counter(map(tuple, neardup.group(frame(spark, texts), shingle, rounds=rounds).collect()))
        want = Counter((k, len(sets[k]), label[k], label[k] == k) if k is not None else (None, 1, None, True) for k, _ in texts)
        assert got == want
    assert neardup.group(empty, shingle).count() == 0
    kept = neardup.keep_first(frame(spark, texts), shingle)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({v for v in label.values()})


def test_scores_prefer_the_corpus(spark, odd, empty):
    rnd = random.Random(8)
    usual = [" ".join(x for _ in range(40) for x in rnd.choice([("red", "apple"), ("green", "pear")])) for _ in range(300)]
    shuffled = " ".join(rnd.sample(usual[0].split(), 80))
    docs = frame(spark, [*enumerate(usual), (1000, shuffled), (1001, None), (1002, " ")])
    by = {r["doc_id"]: r for r in lm.score_documents(docs).collect()}
    assert by[1000]["mean_log_likelihood"] < min(by[k]["mean_log_likelihood"] for k in range(300))
    assert (by[1001]["n_tokens"], by[1001]["log_likelihood"], by[1002]["mean_log_likelihood"]) == (0, 0.0, None)
    assert lm.score_documents(odd).count() == len(odd_texts())
    assert lm.score_documents(empty).count() == 0


@pytest.mark.parametrize("known", [0, 100_000])
def test_every_word_has_its_own_probability(spark, monkeypatch, known):
    monkeypatch.setattr(lm, "KNOWN_WORDS", known)
    rnd = random.Random(12)
    filler = [" ".join(f"w{k}" for k in rnd.sample(range(900), 300)) for _ in range(30)]
    rare = [f"{a}{b}tail" for a in "klmnopqrst" for b in "klmnopqrst"]
    texts = [*enumerate(filler), *((300 + k, f"w1 w2 {w} w3 w4") for k, w in enumerate(rare)), (500, f"w1 w2 {rare[0]} w3 w4"), (501, None)]
    by = {r["doc_id"]: r for r in lm.score_documents(frame(spark, texts)).collect()}
    assert len(by) == len(texts) and by[501]["log_likelihood"] == 0.0
    assert by[300]["log_likelihood"] - by[301]["log_likelihood"] == pytest.approx(np.log(2), abs=1e-5)


def test_training_ignores_the_file_split(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 4000)
    rnd = random.Random(9)
    texts = [(k, " ".join(x for _ in range(30) for x in rnd.choice([("red", "apple"), ("green", "pear"), ("blue", "plum")]))) for k in range(400)]
    docs = frame(spark, [*texts, *((1000 + k, "hot text " * 40) for k in range(200)), (2000, None)])
    means = lambda d: {r["doc_id"]: r["mean_log_likelihood"] for r in lm.score_documents(d).collect()}
    one, many = means(docs.coalesce(1)), means(docs.repartition(40))
    assert one.keys() == many.keys() and all(one[k] == pytest.approx(many[k], abs=1e-4) for k in one if one[k] is not None)
    assert np.mean([many[k] for k in range(400)]) > -0.75  # half of the words leave one choice of three


def test_two_passes_train_the_network(spark, monkeypatch):
    """Windows of a chain with four followers a word: where single-rate descent went over all of them 57 times."""
    monkeypatch.setattr(lm, "PART_WORDS", 10_000)
    rnd = random.Random(10)

    def chain(at: int) -> str:
        out = [at := (3 * at + rnd.randrange(4)) % 200 for _ in range(300)]
        return " ".join(f"w{k}" for k in out)

    docs = frame(spark, [(k, chain(rnd.randrange(200))) for k in range(400)])
    rounds, real = [], lm.one_round
    monkeypatch.setattr(lm, "one_round", lambda *given: rounds.append(real(*given)) or rounds[-1])
    lm.trained(lm.encoded(docs, ([f"w{k}".encode() for k in range(200)], [], {})), 120_000)
    assert lm.PARTS <= len(rounds) <= 3 * lm.PARTS
    assert rounds[-1][1] > -0.5  # either side leaves four words in two hundred


def test_language_model_holds_the_windows_of_one_round():
    texts, copies = [[5, 6, 7], [], [8], [9, 10, 11, 12, 13]], [2, 1, 3, 1]
    packed = (np.array([x for t in texts for x in t], "<u2").tobytes(), np.array([len(t) for t in texts], "<u4").tobytes(), np.array(copies, "<u8").tobytes())
    found = [lm.windows(*packed, k, 4) for k in range(4)]
    assert [len(at) for _, at, _ in found] == [len(n) for *_, n in found] == [3, 2, 2, 2]
    seen = sorted((int(p), int(ids[p]), n) for ids, at, own in found for p, n in zip(at, own, strict=True))
    want = [(2 + k, x, n) for k, (x, n) in enumerate((x, n) for t, n in zip(texts[:1], copies[:1]) for x in t)] + [(9, 8, 3)] + [(12 + k, x, 1) for k, x in enumerate(texts[3])]
    assert seen == want


def test_language_model_reads_rows_in_small_slices(spark):
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(3 * lm.ROWS + 7))})
    slices = list(lm.in_slices(iter([rows, rows.slice(0, 0), rows.slice(0, 2)])))
    assert [b.num_rows for b in slices] == [lm.ROWS] * 3 + [7, 2] and [x for b in slices[:4] for x in b.column(0).to_pylist()] == list(range(rows.num_rows))
    docs = frame(spark, [(k, "one two two") for k in range(lm.ROWS + 3)])
    coded = lm.encoded(docs, ([b"one"], [], {})).collect()
    left = [r for r in coded if r["word"] is not None]
    assert len({r["row"] for r in coded if r["word"] is None}) == lm.ROWS + 3 == len(left) == len({r["row"] for r in left}) and {(bytes(r["word"]), r["times"]) for r in left} == {(b"two", 2)}


def test_classes_of_counted_words(spark):
    texts = [(k, t) for k, t in enumerate(["a ab abc abcd", "ÄÖ straße 日本語 x", "Abcd abcd", None, " "])]
    want = Counter(w for _, t in texts for w in lm.words(t))
    got = {bytes(r["word"]): (r["class"], r["n"]) for r in lm.counted(frame(spark, texts)).collect()}
    assert got == {w: (lm.class_of(w), n) for w, n in want.items()}


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    network = lm.Network(lm.Network.start().flat + rng.normal(0, 0.3, len(lm.Network.start().flat)))
    ids, at, weight = np.zeros(404, np.int16), np.arange(2, 402), rng.integers(1, 4, 400).astype(float)
    ids[at] = rng.integers(1, lm.VOCABULARY, 400)
    gradient = lm.Network(np.zeros(len(network.flat)))
    network.pass_over(ids, at, gradient, weight)

    def mean_with(k: int, change: float) -> float:
        moved = network.flat.copy()
        moved[k] += change
        return float(lm.Network(moved).pass_over(ids, at) @ weight / weight.sum())

    logs = network.pass_over(ids, at)
    assert logs.max() < 0
    for k in np.argsort(-abs(gradient.flat))[:2000:100]:
        assert gradient.flat[k] == pytest.approx((mean_with(k, -0.01) - mean_with(k, 0.01)) / 0.02, rel=0.01, abs=1e-5)


def test_pipeline(spark, folder, odd):
    rows = corpus_pipeline.run(spark, folder)
    docs = {r["doc_id"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()}
    left = {r["doc_id"] for r in rows.collect()}
    assert left and left <= docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, folder).schema.names == odd.schema.names, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), folder).count() == 0


def test_queries_are_registered():
    names = set(entry.queries())
    assert set(QUERIES) | {"pipeline"} <= names and {int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")} == set(range(1, 14))


PROSE, INTRO = "x y z and so on. " * 180, "words of an opening paragraph. " * 10


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<nav><a href=/>Home of it all</a></nav><article><h1>T</h1><p>{INTRO}</p><div class=text><p>{PROSE}</p></div></article><footer>c</footer>", ["T", INTRO, PROSE]),
        (f"<div class=post><h1>T</h1><p>{INTRO}</p><div><div class=text><p>{PROSE}</p></div></div></div><div class=x><p>not marked</p></div>", ["T", INTRO, PROSE]),
        (f"<article><section class=a><p>{PROSE}</p></section><section class=b><p>{INTRO}</p></section></article>", [PROSE, INTRO]),
        (f'<div class="content has-sidebar"><h1>T</h1><p>{PROSE}</p></div><div class=sidebar><p>{INTRO}</p></div>', ["T", PROSE]),
        (f"<article class=no-comments><h1>T</h1><p>{INTRO}</p></article><section class=comments><article class=comment><p>{PROSE}</p></article></section>", ["T", INTRO]),
        (f"<form id=f><div class=nav><a href=/>x</a></div><article><h1>T</h1><p>{PROSE}</p><form>Sign up</form></article><footer>c</footer></form>", ["T", PROSE]),
        (f"<h1>T</h1><div class=text><p>{INTRO}</p></div><div class=comments><p>{PROSE}</p></div>", ["T", INTRO]),
    ],
)
def test_main_text_keeps_the_article(page, want):
    found = htmltext.blocks(f"<html><body>{page}</body></html>")
    expected = "\n\n".join(" ".join(w.split()) for w in want)
    assert htmltext.extract(found, []) == expected
    assert htmltext.extract(found, [htmltext.best(found)[0]]) == expected


@pytest.mark.parametrize("tag", ["div", "form", "article"])
def test_main_text_of_deep_elements_takes_linear_time(tag):
    import time

    start = time.perf_counter()
    found = htmltext.blocks("<body>" + f"<{tag}><p>w w</p>" * 20_000 + "<h1>t</h1>")
    assert htmltext.best(found) and time.perf_counter() - start < 15


def test_main_text_of_generated_pages(spark):
    """Pages of several templates with known main text; boilerplate around and inside it."""
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice(["sea", "wind", "the", "hill", "over", "moves"]) for _ in range(n)) + "."
    rows, want = [], {}
    for k in range(120):
        title, body = say(5), [say(rnd.randint(3, 60)) for _ in range(rnd.randint(2, 6))]
        inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" + rnd.choice(["", "<aside>Read more</aside>", "<div class='share-buttons'>Tell friends</div>"]) for p in body)
        wrap = [f"<article>{inner}</article>", f"<main><div class='post p{k}'>{inner}</div></main>", f"<div id=content class='with-sidebar'>{inner}</div>"][k % 3]
        side = f"<div class=sidebar><p>{say(40)}</p></div><section id=comments><p>{say(90)}</p></section>"
        page = f"<body><header><p>{say(4)}</p></header><nav><ul><li><a href=/>{say(3)}</a></ul></nav>{wrap}{side}<footer>{say(6)}</footer></body>"
        rows.append((k, f"http://h{k % 3}.org/{k}", f"<form action=/>{page}</form>" if k % 5 == 0 and k % 3 == 0 else page))
        want[k] = "\n\n".join([title, *body])
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_contamination_is_judged_once_over_all_blocks(spark):
    rnd = random.Random(12)
    items = [(f"i{k}", " ".join(f"w{k}x{j}" for j in range(12))) for k in range(5)]
    texts = []
    for k in range(40):
        parts = [" ".join(f"c{rnd.randrange(900)}" for _ in range(rnd.randint(5, 30))) for _ in range(3)]
        for item in rnd.sample(items, rnd.randint(0, 3)):
            parts.insert(rnd.randrange(4), item[1])
        texts.append((k, " ".join(parts)))
    docs = spark.createDataFrame([(k, t, k, "x") for k, t in texts], "doc_id bigint, text string, _row int, n_words string")
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    for share in (0.0, 0.45, 0.95):
        one = {tuple(r) for r in decontaminate.remove_contaminated(docs, benchmark, max_share=share).collect()}
        many = decontaminate.remove_contaminated(docs, benchmark, max_share=share, block_words=60)
        assert many.columns == docs.columns and {tuple(r) for r in many.collect()} == one and (share or len(one) < 40)


def test_language_stage_keeps_columns_of_any_name(spark, tmp_path):
    rows = [(k, ("the sea and the wind " if k % 2 else "das meer und der wind ") * 5, "en" if k % 2 else "de", 777) for k in range(30)] + [(99, "123", None, 777)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _language_row int")
    model = langid.fit(docs.select("text", "lang"))
    docs.write.parquet(str(tmp_path / "docs"))
    for source in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = langid.keep_known(source, model)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[:-1])


def brute_language(rows, text, lengths=langid.LENGTHS):
    """Log sums by plain dictionaries."""
    import math

    seen = {}
    for t, lang in rows:
        for w in langid.words(t):
            for kind, entries in [(0, [w]), *[(k, langid.grams(w, k)) for k in lengths]]:
                for e in entries:
                    seen.setdefault((kind, lang), Counter())[e] += 1
    langs = sorted({lang for _, lang in seen})
    log = lambda kind, e, x: math.log(seen.get((kind, x), {}).get(e, 0) + 0.5) - math.log(sum(seen.get((kind, x), Counter()).values()) + len(seen.get((kind, x), ())) + 1)
    known = lambda kind, e: any(e in seen.get((kind, x), ()) for x in langs)
    total = dict.fromkeys(langs, 0.0)
    for w in langid.words(text):
        parts = [(0, w)] if known(0, w) else next(([(k, g) for g in langid.grams(w, k) if known(k, g)] for k in lengths if any(known(k, g) for g in langid.grams(w, k))), [])
        for x in langs:
            total[x] += sum(log(kind, e, x) for kind, e in parts) / max(1, len(parts))
    best = max(total.values())
    return min(x for x in langs if total[x] == best), 1 / sum(math.exp(max(-700, v - best)) for v in total.values())


@pytest.mark.parametrize("known", [0, 3, 120_000])
def test_languages_equal_brute_force(spark, monkeypatch, known):
    monkeypatch.setattr(langid, "KNOWN_WORDS", known)
    monkeypatch.setattr(langid, "TASK_ENTRIES", 5)
    rows = [("the sea and the wind", "en"), ("über das meer und der see", "de"), ("la mer et le vent", "fr"), ("the wind", "en")]
    texts = ["the unknown seas", "das Unbekannte", "vents", "zzz qqq", "und the", "x", "meer meer winds"]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).collect()}
    for k, t in enumerate(texts):
        lang, score = brute_language(rows, t)
        assert got[k][0] == lang and got[k][1] == pytest.approx(score, rel=1e-6)


def brute_posteriors(votes, rounds=rules.ROUNDS):
    """The same estimates text by text, in plain probabilities."""
    good = [0.1 if "-" in v else 0.9 for v in votes]
    for _ in range(rounds):
        share, n = (1 + sum(good)) / (2 + len(votes)), len(votes)
        rates = []
        for k in range(len(votes[0])):
            sides = []
            for side, before in ((0, (1, 1)), (1, (1 + 0.998 * n, 1 + 0.002 * n))):
                weight = [g if side else 1 - g for g in good]
                yes, no = (b + sum(w for w, v in zip(weight, votes, strict=True) if v[k] == s) for b, s in zip(before, "+-", strict=True))
                sides.append({"+": yes / (yes + no), "-": no / (yes + no), "0": 1.0})
            rates.append(sides)
        chance = lambda v, side: np.prod([r[side][s] for r, s in zip(rates, v, strict=True)]) * (share if side else 1 - share)
        good = [chance(v, 1) / (chance(v, 1) + chance(v, 0)) for v in votes]
    return dict(zip(votes, good, strict=True))


def test_posteriors_equal_brute_force():
    rnd = random.Random(8)
    for _ in range(5):
        bad = [rnd.random() < 0.2 for _ in range(300)]
        votes = ["".join(rnd.choices("+-0", (0.2, 0.6, 0.2) if b else (0.85, 0.02, 0.13))[0] for _ in range(4)) for b in bad]
        got, want = rules.posteriors(dict(Counter(votes))), brute_posteriors(votes)
        assert got == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("marks", [("[{role}] ", "\n"), ("<{role}>", "</s>"), ("{role}: ", " |"), ("### {role}: ", " </turn>\n"), ("\u00ab{role}\u00bb", "\u00a7"), ("<|{role}|>\n", "~end~")])
def test_any_template_comes_back(spark, marks):
    template = chat.Template(*marks)
    rnd, signs = random.Random(3), "".join(marks) + "\\ubhlc00003ca# x"
    said = [(c, t, rnd.choice(["user", "a]: b", "", "<\n"]), "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25)))) for c in range(30) for t in range(rnd.randint(1, 4))]
    rows = chat.format_chats(spark.createDataFrame(said, "conv_id int, turn int, role string, text string"), template)
    got = {r["conv_id"]: [tuple(x) for x in r["turns"]] for r in rows.select("conv_id", chat.read_back(F.col("formatted"), template).alias("turns")).collect()}
    want = {}
    for c, t, role, text in sorted(said):
        want.setdefault(c, []).append((role, text))
    assert got == want


@pytest.mark.parametrize("marks", [("{role}", "\n"), ("### {role}: ", "END"), ("no role", "\n"), ("<{role}>", "<>"), ("a{role}b", "c")])
def test_unsafe_templates_are_refused(marks):
    with pytest.raises(ValueError):
        chat.Template(*marks)
