"""Packing, filters, language, chat, sharding, decontamination, licenses and quality."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pytest

from ridgeline.llm import chat_format, decontamination, language_id, license_scan, packing, quality, sharding, url_filter
from ridgeline.llm._text import ALNUM, word_hash
from ridgeline.llm.queries import tokenizer_path
from tests.llm import frames
from tests.llm.test_text import ALNUM_RE, LOWER


def low(text):
    return ALNUM_RE.findall((text or "").translate(LOWER))


# --- packing ------------------------------------------------------------------------------------------------------------


def check_pieces(rows, texts, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = sorted((i is None, i, (np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")).tobytes()) for i, t in texts if i is not None)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for i in {w[1] for w in want}:
        ids = next(w[2] for w in want if w[1] == i)
        copies = sum(w[1] == i for w in want)
        own = sorted(by[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == copies * len(ids) // 4
        for r in own:
            assert r.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0 and at < length


@pytest.mark.parametrize("part", [packing.PARTITION_BYTES, 20_000])
def test_packing_round_trip(spark, monkeypatch, part):
    monkeypatch.setattr(packing, "PARTITION_BYTES", part)
    odd = [(20, "<|endoftext|> Hello<|startoftext|>WORLD"), (21, "é ΣΑΣ İ  x\x0by\x1cz"), (22, "<|ENDOFTEXT|>")]
    frame = frames.docs(spark, [(*o, "en") for o in odd])
    texts = [(r.doc_id, r.text) for r in frame.collect()]
    check_pieces(packing.pack(frame, tokenizer_path(), length=512).collect(), texts, 512)
    assert packing.pack(frames.empty(spark), tokenizer_path()).count() == 0


def test_cache_may_start_anew(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    ids, out = packing.WordIds(tokenizer_path()), []
    for text in ("a b c d e", "e d c b a", "f a"):
        out += [flat.tolist() for _, flat, _ in packing.tokens(pa.array([text]), ids)]
    assert out == [[*ids.tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in ("a b c d e", "e d c b a", "f a")]


def test_hilbert_curve_is_a_walk():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


# --- URL filter ------------------------------------------------------------------------------------------------------------


def test_url_cases(spark):
    urls = ["http://a.Example.NET/en/x?q", "https://example.net/de/", "http://x.org/fr/", "http://x.org", "nothing", None, "http://notexample.com/de/1", "http://b.example.com/de/1#x", "http://www.casino-win.example.org/", "http://a.org/?page=3", "://?x", "http://net/", "http://x.net"]
    frame = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[1] == ("example.net", "/de/", "net/", "block")
    assert got[2] == ("x.org", "/fr/", "org/fr/", "allow")
    assert got[3] == ("x.org", "", None, "allow")
    assert got[4] == got[5] == got[10] == ("", "", None, "allow")
    assert got[6] == ("notexample.com", "/de/1", None, "allow")
    assert got[7] == ("b.example.com", "/de/1", "example.com/de/", "block")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[11] == ("net", "/", "net/", "block") and got[12] == ("x.net", "", None, "allow")
    assert url_filter.judge(frame.where("false")).count() == 0


def test_thousands_of_rules(spark):
    """Rules from a table against all expressions run on all URLs; odd rows and columns."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(120)]
    rules = []
    for k in range(3000):
        a, b = rng.sample(vocabulary, 2)
        shape = rng.choice((rf"[/.]{a}[/.-]", rf"[/.]{a}-{b}[./]", rf"[?&]{a}=[0-9]+(&|$)", rf"/{a}/.*/{b}(/|$)"))
        rules.append((f"r{k:04d}", rng.choice(("allow", "block")), shape, [a, b] if b in shape else [a]))
    rules.append(("none", "block", ".", []))
    word = lambda: rng.choice(vocabulary[:40]) if rng.random() < 0.6 else rng.choice(vocabulary)
    urls = [f"http://{word()}-{word()}.{rng.choice(('org', 'net'))}/{word()}/{word()}?{word()}={rng.randint(0, 99)}" for _ in range(300)]
    urls += [None, "", "no scheme w1", "HTTP://W1.ORG/W2/", "http://w3.org/" + "w4/" * 20_000, urls[0], urls[0]]
    frame = spark.createDataFrame([(None if k % 50 == 7 else k, u, "h", "r", 1) for k, u in enumerate(urls)], "page_id long, url string, host string, pattern string, token int")
    got = url_filter.judge(frame, patterns=spark.createDataFrame(rules, url_filter.RULES)).collect()
    assert len(got) == len(urls)
    known = sorted(((action != "allow", name, re.compile(regex)) for name, action, regex, tokens in rules if tokens))
    want = {}
    for k, u in enumerate(urls):
        hit = next(((name, blocks) for blocks, name, regex in known if regex.search((u or "").lower())), (None, False)) if u else (None, False)
        want.setdefault(None if k % 50 == 7 else k, []).append((hit[0], "block" if hit[1] else "allow"))
    have = {}
    for r in got:
        if r.rule is None:
            have.setdefault(r.page_id, []).append((r.pattern, r.verdict))
        else:
            have.setdefault(r.page_id, []).append(None)
    assert set(have) == set(want)
    assert all(x is None or x in want[i] for i, xs in have.items() for x in xs) and sum(x is not None for xs in have.values() for x in xs) > 100


def test_index_runs_what_all_expressions_say(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    first = sorted(url_filter.PATTERN_RULES, key=lambda r: (r.action != "allow", r.name))
    for r in url_filter.judge(pages).join(pages, "page_id").collect():
        if r.rule is None:
            hits = [p.name for p in first if re.search(p.regex, (r.url or "").lower())]
            assert r.pattern == (hits[0] if hits else None)


# --- language ----------------------------------------------------------------------------------------------------------------


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_is_that_of_plain_naive_bayes(spark):
    """Against counting and summing n-gram by n-gram, without batches, pieces or offsets; extra columns clash."""
    rng = random.Random(4)
    words_of = {lang: [rng.choice("abcdefghij") * rng.randint(1, 2) + rng.choice(("tion", "ung", "ment", "ção")) for _ in range(30)] for lang in ("aa", "bb", "cc")}
    rows = []
    for k in range(240):
        lang = rng.choice(("aa", "bb", "cc"))
        mixed = [w for other in words_of.values() for w in other]
        rows.append((k, " ".join(rng.choice(words_of[lang] if rng.random() < 0.4 else mixed) for _ in range(rng.choice((1, 4, 30, 400)))), None if k % 17 == 0 else lang))
    rows += [(500, "A", "aa"), (501, "", "aa"), (502, None, "bb")]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")

    def grams(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [int(g[p]) for n, g in zip(language_id.SIZES, language_id._grams(data)) for p in range(len(data) - n + 1)] if len(data) else []

    out_of = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, texts = {}, {}
    for i, t, lang in rows:
        if lang is not None and t is not None and not out_of(i):
            texts[lang] = texts.get(lang, 0) + 1
            own = counts.setdefault(lang, np.zeros(language_id.WIDTH))
            for g in grams(t):
                own[g] += 1
    names = sorted(counts)
    logs = {n: np.log((counts[n] + 0.5) / (counts[n].sum() + 0.5 * language_id.WIDTH)).astype(np.float32).astype(float) for n in names}
    got = {r.doc_id: r for r in language_id.identify(frame).collect()}
    for i, t, _ in rows:
        if not t:
            assert got[i].lang_pred == "und"
            continue
        total = {n: np.log(texts[n] / sum(texts.values())) + sum(logs[n][g] for g in grams(t)) for n in names}
        best = max(total.values())
        assert total[got[i].lang_pred] >= best - 1e-6 * abs(best) and 0 <= got[i].score <= 1


def test_language_odd_cases(spark):
    got = {}
    for r in language_id.identify(frames.docs(spark)).collect():
        got[r.doc_id] = r
    assert got[4].lang_pred == got[5].lang_pred == got[6].lang_pred == "und" and got[4].score == 0
    assert got[11].lang_pred != "und"
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert language_id.identify(frames.empty(spark)).count() == 0
    nothing = language_id.identify(frames.docs(spark).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_language_long_texts_in_pieces(monkeypatch):
    data = np.frombuffer(("der die das und " * 400).encode(), np.uint8)
    table = np.random.default_rng(0).random((language_id.WIDTH, 2)).astype(np.float32)
    whole = language_id._score(data, np.array([0, len(data)]), table, 2)
    monkeypatch.setattr(language_id, "PIECE", 256)
    cut = language_id._score(data, np.array([0, len(data)]), table, 2)
    assert np.allclose(whole[0], cut[0]) and whole[1] == pytest.approx(cut[1])


# --- chat ----------------------------------------------------------------------------------------------------------------------


def test_chat_links_orders_and_validates(spark):
    schemas = {"add": (chat_format.Field("a", "integer"), chat_format.Field("b", "number", False))}
    calls = spark.createDataFrame(
        [(1, "c2", 0, "add", '{"b": 1.5, "a": 2}', ["c1"]), (1, "c1", 1, "add", '{"a":"x"}', []), (1, "c3", 2, "add", "{bad", None), (1, "c4", 3, "other", "{}", ["nowhere"]), (1, None, 4, "add", "{}", []), (2, "x", 0, "add", "[1]", ["y"]), (2, "y", 1, "add", '{"a":1}', ["x"])],
        "conv_id long, call_id string, turn long, name string, arguments string, after array<string>",
    )
    results = spark.createDataFrame([(1, "c2", 6, "late"), (1, "c2", 5, "first"), (1, "zz", 7, "lost"), (1, "c1", 8, None)], "conv_id long, call_id string, turn long, content string")
    rows = chat_format.link(calls, results, schemas).orderBy("conv_id", "position").collect()
    one = [r for r in rows if r.conv_id == 1]
    assert [r.position for r in one] == list(range(len(one)))
    place = {r.call_id: r.position for r in one if r.state in ("linked", "open")}
    assert place["c1"] < place["c2"]
    state = {(r.call_id, r.state) for r in one}
    assert state == {("c2", "linked"), ("c1", "linked"), ("c3", "open"), ("c4", "open"), (None, "open"), ("c2", "extra"), ("zz", "orphan")}
    wrong = {r.call_id: r.problems for r in one if r.state in ("linked", "open")}
    assert wrong["c2"] == "" and wrong["c1"] == "a is no integer" and wrong["c3"] == "malformed" and wrong["c4"] == "unknown tool" and wrong[None] == "missing a"
    linked = json.loads(next(r.json for r in one if r.call_id == "c2" and r.state == "linked"))
    assert linked["arguments"] == {"a": 2, "b": 1.5} and linked["content"] == "first" and list(linked) == sorted(linked)
    two = [r for r in rows if r.conv_id == 2]
    assert [r.call_id for r in two] == ["x", "y"] and two[0].problems == "no object"
    assert chat_format.link(calls.where("false"), results.where("false"), schemas).count() == 0


def test_chat_plan_is_native(spark, folder):
    plan = chat_format.link(*chat_format.from_conversations(spark.read.parquet(f"{folder}/conversations.parquet"))[:2], chat_format.TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chat_levels_of_any_graph(spark):
    """Chains, joins, cycles and what hangs on them, against plain recursion."""
    rng = random.Random(6)
    deps = {}
    for conv in range(12):
        size = rng.choice((1, 5, 40))
        for k in range(size):
            some = [rng.randrange(size) for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))] if conv % 3 == 0 else [x for x in (k - 1, k - rng.randint(1, 5)) if x >= 0][: rng.choice((1, 1, 2))]
            deps[conv, f"c{k}"] = [f"c{x}" for x in some] + (["nowhere"] if rng.random() < 0.2 else [])
    def level(call, seen=()):
        if call in seen:
            return None
        found = [level((call[0], d), (*seen, call)) for d in deps[call] if (call[0], d) in deps and d != call[1]]
        return None if None in found else 1 + max(found, default=-1)

    rows = [(conv, call, list(after)) for (conv, call), after in deps.items()]
    calls = spark.createDataFrame(rows + rows[:3] + [(1, None, ["c0"]), (None, "c1", ["c0"])], "conv_id long, call_id string, after array<string>")
    got = {(r.conv_id, r.call_id): r.level for r in chat_format.levels(calls, chat_format.Scratch(spark, "levels")).collect()}
    want = {c: level(c) for c in deps if c[0] % 3 or len([1 for d in deps if d[0] == c[0]]) < 40}
    assert {c: got.get(c) for c in want} == want and len(got) == len(set(got)) and max(got.values()) > 10
    assert not set(got) - set(deps)


def test_chat_odd_messages(spark):
    """Null turns and conversations link with nothing; repeated rows, long texts, other roles and columns stay."""
    long = "x" * 100_000
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", long), (1, 2, "assistant", "yes"), (1, 3, None, "odd"), (1, 4, "tool", None), (2, 0, "assistant", "alone"), (7, None, "user", "when?"), (7, None, "assistant", "never"), (None, 0, "user", "who?"), (None, 1, "assistant", "me"), (3, 0, "user", None), (3, 0, "user", None), (3, 1, "assistant", "a"), (3, 1, "assistant", "b")]
    frame = spark.createDataFrame([(*t, 5, "s") for t in turns], "conv_id long, turn long, role string, text string, position int, state string")
    calls, results, others = chat_format.from_conversations(frame)
    rows = chat_format.link(calls, results, chat_format.TOOLS, others).collect()
    have = sorted(((r.conv_id, r.position, r.turn, r.state) for r in rows), key=str)
    want = [(1, 0, 0, "other"), (1, 1, 3, "other"), (1, 2, 4, "other"), (1, 3, 1, "linked"), (2, 0, 0, "orphan"), (7, 0, None, "open"), (7, 1, None, "orphan"), (None, 0, 0, "open"), (None, 1, 1, "orphan"), (3, 0, 0, "linked"), (3, 1, 0, "linked"), (3, 2, 1, "extra")]
    assert have == sorted(want, key=str)
    by = {(r.conv_id, r.position): r for r in rows}
    assert by[7, 0].call_id is None and '"content":null' in by[1, 2].json and '"name":"system"' in by[1, 0].json and by[3, 0].problems == "malformed"
    assert len(by[1, 3].json) > 100_000 and json.loads(by[1, 3].json)["content"] == "yes"
    empty = frame.where("false")
    assert chat_format.link(*chat_format.from_conversations(empty)[:2], chat_format.TOOLS, chat_format.from_conversations(empty)[2]).count() == 0


# --- sharding ------------------------------------------------------------------------------------------------------------------


def test_differencing_beats_greedy():
    rng = random.Random(2)
    for shards in (2, 3, 16):
        sizes = [rng.randint(1, 10_000) for _ in range(200)]
        parts = sharding.difference([(s, k) for k, s in enumerate(sizes)], shards)
        assert sorted(k for _, ks in parts for k in ks) == list(range(200))
        assert all(s == sum(sizes[k] for k in ks) for s, ks in parts)
        bins = [0] * shards
        for s in sorted(sizes, reverse=True):
            bins[bins.index(min(bins))] += s
        spread = max(s for s, _ in parts) - min(s for s, _ in parts)
        assert spread <= max(bins) - min(bins)
    assert sharding.difference([], 3) == [(0, [])] * 3


def test_blocks_lose_little_to_plain_differencing(spark, monkeypatch):
    """One Karmarkar-Karp run over all groups against blocks of 50 groups and then of their partitions."""
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 50)
    rng = random.Random(12)
    rows = [(k, "y" * int(rng.paretovariate(1.2) * 40) + str(k // rng.choice((1, 1, 3)))) for k in range(1500)]
    groups = {}
    for _, t in rows:
        groups[t] = groups.get(t, 0) + len(t) + 1
    plain = [s for s, _ in sharding.difference([(n, t) for t, n in groups.items()], 8)]
    sums = [0] * 8
    for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect():
        sums[r.shard] += r.size
    even = max(sum(sums) / 8, max(groups.values()))
    assert sum(sums) == sum(plain) and max(plain) <= 1.001 * even
    assert max(sums) <= 1.005 * max(plain)


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_GROUPS", 50)
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 3000) + f"é{k % 350}") for k in range(600)] + [(k, "same") for k in range(700, 800)] + [(900, None), (901, ""), (902, None), (902, None)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    text = dict(rows)
    assert len(got) == len(rows)
    home, sums, slots = {}, [0] * 8, {}
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert r.size == len(body) + 1 and r.text_crc32 == zlib.crc32(body) and r.law == "bytes" and r.grown_shard is None
        assert home.setdefault(text[r.doc_id], r.shard) == r.shard
        sums[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sums) - min(sums) < 0.01 * sum(sums) / 8
    assert sharding.shard(frames.empty(spark)).count() == 0
    assert sharding.shard(frames.docs(spark)).count() == frames.docs(spark).count()


# --- decontamination ------------------------------------------------------------------------------------------------------------


def brute_hits(text, windows):
    w, hit, items = low(text), set(), set()
    for size in {len(k) for k in windows}:
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                items |= windows[tuple(w[i : i + size])]
    return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    rng = random.Random(3)
    word = lambda: rng.choice("abcde")
    items = [(k, " ".join(word() for _ in range(rng.choice((1, 3, 9, 10, 14))))) for k in range(12)] + [(50, None), (51, ""), (52, "Quick, brown FOX jumps over")]
    texts = [(k, "; ".join(word() for _ in range(rng.randint(0, 60)))) for k in range(80)]
    frame = frames.docs(spark, [(100 + k, t, "en") for k, t in texts])
    windows = {}
    for i, t in items:
        w = low(t)
        for p in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[p : p + 10]), set()).add(str(i))
    got = decontamination.digest(decontamination.find(frame, spark.createDataFrame(items, "item_id long, text string"))).collect()
    assert len(got) == frame.count()
    want = {}
    for r in frame.collect():
        want.setdefault(r.doc_id, set()).add(brute_hits(r.text, windows))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, set()).add((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    assert have == want


def test_decontamination_without_items_and_with_slop(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contaminated for r in decontamination.digest(decontamination.find(frames.docs(spark), none)).collect()} == {False}
    assert decontamination.find(frames.empty(spark), none).count() == 0
    item = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    text = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x x x x beta gamma"), (4, "alpha beta")], "doc_id long, text string")
    found = lambda slop: {r.doc_id for r in decontamination.find(text, item, slop=slop).collect() if r["items"]}
    assert found(0) == {1} and found(1) == {1, 2} and found(4) == {1, 2, 3}


def test_index_is_kept_for_other_test_sets(spark, tmp_path, monkeypatch):
    """Proximity against brute force, from an index that was written before the items were known; keys are strings."""
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 200)
    rng = random.Random(9)
    texts = [(f"d{k}", " ".join(rng.choice("abcdefg") for _ in range(rng.choice((0, 3, 20, 70, 500))))) for k in range(60)]
    decontamination.build_index(spark.createDataFrame(texts, "name string, text string"), f"file://{tmp_path}/index", key="name")
    index = decontamination.Index.open(spark, f"file://{tmp_path}/index")
    counts = {}
    for _, t in texts:
        for w in low(t):
            counts[w] = counts.get(w, 0) + 1
    names = sorted(counts, key=lambda w: int(word_hash(w, ALNUM)[0]))
    vocabulary = np.concatenate([word_hash(w, ALNUM) for w in names])
    assert decontamination.term_counts(index, vocabulary).tolist() == [counts[w] for w in names]
    for seed in (1, 2):
        items = [(k, " ".join(random.Random(seed * 100 + k).choice("abcdefg") for _ in range(k % 4 + 3))) for k in range(15)]
        for slop in (0, 1, 2):
            got = {r.key: set(r["items"]) for r in decontamination.search(index, spark.createDataFrame(items, "item_id long, text string"), slop=slop).collect()}
            for name, t in texts:
                w = low(t)
                want = set()
                for k, q in items:
                    q = low(q)
                    lead = min(range(len(q)), key=lambda o: counts.get(q[o], 0))  # noqa: B023
                    near = lambda p, o: q[o] in w[max(0, p + o - slop) : max(0, p + o + slop + 1)]  # noqa: E731, B023
                    if any(w[p + lead] == q[lead] and all(near(p, o) for o in range(len(q))) for p in range(-lead, len(w) - lead)):
                        want.add(str(k))
                assert got[name] == want


# --- licenses ---------------------------------------------------------------------------------------------------------------------


def test_licenses(spark):
    cases = [(100, "x\nLicensed under the MIT License.\nsee the Apache License, Version 2.0"), (101, "Under  THE mit\nlicense under the MIT license"), (102, "CC BY-NC 4.0 and cc by nc"), (103, "Licensed under the GNU General Public License, version 3"), (104, "under the mit licenses"), (105, "licensed under the gnu\ngeneral public license version 3")]
    got = {r.doc_id: r for r in license_scan.scan(frames.docs(spark, [(*c, "en") for c in cases])).collect()}
    assert (got[100].n_base, got[100].first_word, got[100].last_word, got[100].base_labels, got[100].labels) == (2, 2, 8, "apache-2,mit", "apache-2,mit")
    assert (got[101].n_base, got[101].first_word, got[101].last_word) == (2, 0, 4)
    assert got[102].base_labels == "cc-by-nc" and got[102].n_base == 2
    assert got[103].base_labels == "" and got[103].labels == "gpl-3" and got[103].score == 1
    assert got[104].n_base == 0 and got[104].first_word is None
    assert got[4].n_words == 0 and got[4].labels == "" and got[4].score == 0
    assert license_scan.scan(frames.empty(spark)).count() == 0


# --- quality -------------------------------------------------------------------------------------------------------------------------


def test_em_finds_the_accurate_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    vote = lambda hit, false: np.where(np.where(truth, rng.random(20_000) < false, rng.random(20_000) < hit), quality.JUNK, quality.NONE)
    votes = np.stack([vote(0.9, 0.01), vote(0.6, 0.02), vote(0.5, 0.3)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, table, share = quality.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.8) < 0.05 and table[0, 0, quality.JUNK] > table[2, 0, quality.JUNK]


def test_quality_against_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "good")
    rows = quality.classify(docs).join(labels, "doc_id").collect()
    clean, junk = ([r for r in rows if r.good == g] for g in (1, 0))
    assert np.mean([r.accepted for r in clean]) > 0.98 and np.mean([r.accepted for r in junk]) < 0.05


def test_scorer_knows_no_votes(spark):
    """The linear model sees features of the text only, and agrees with the weak labels of documents that it wasn't fitted
    to; votes, patterns and features against plain loops."""
    import pyarrow as pa

    texts = ["One two two, three!!", "", "a", None, "é漢 字 x" * 300, "AB 12 #$ AB AB 12"]
    vectors = list(quality._vectors(pa.array(texts, pa.string())))
    for t, v in zip(texts, vectors):
        data = np.frombuffer((t or "").encode(), np.uint8).astype(np.uint32)
        assert len(v) == quality.WIDTH
        grams, classes, recurs = np.split(v, [quality.GRAMS, quality.GRAMS + quality.CLASSES])
        want = np.zeros(quality.GRAMS)
        for p in range(len(data) - 2):
            want[quality._grams(data[p : p + 3], 3, quality.GRAMS)[0]] += 1
        assert np.allclose(grams**2 * max(want.sum(), 1), want)
        seen, before, want = {}, None, np.zeros(quality.RECURRENCE)
        for w in (t or "").lower().split():
            want[min(int(np.log2(seen.get(w, 0) + 1)), 7) * 2 + (w == before)] += 1
            seen[w], before = seen.get(w, 0) + 1, w
        assert np.allclose(recurs**2 * max(want.sum(), 1), want)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in quality.classify(docs).collect() if r.weak_label is not None]
    assert np.mean([r.accepted == (r.weak_label >= 0.5) for r in rows]) > 0.97


def test_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"plain words of text number {k} stand here") for k in range(300)] + [(1, "##$$ %% !! " * 9) for _ in range(300)], "doc_id long, text string")
    posterior, _, _ = quality.weak_labels(docs)
    taken = []
    monkeypatch.setattr(quality, "_logistic", lambda places, values, sizes, y: taken.append(len(y)))
    quality.fit(docs, posterior, sample=100)
    assert all(n <= 100 for n in taken)


def test_quality_odd_cases(spark):
    got = {r.doc_id: r for r in quality.classify(frames.docs(spark)).collect()}
    assert not got[4].accepted and not got[5].accepted and got[4].quality == 0 and not got[6].accepted
    assert got[1].accepted and got[7].accepted
    assert quality.classify(frames.empty(spark)).count() == 0


def _labels(spark, texts):
    return {r.doc_id: (r.labels, r.score) for r in license_scan.scan(frames.docs(spark, [(1000 + k, t, "en") for k, t in enumerate(texts)])).collect() if r.doc_id is not None and r.doc_id >= 1000}


def test_wrapped_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    gpl = "licensed under the gnu\ngeneral public license version 3"  # case 105 of test_licenses
    apart = "licensed under the gnu\n" + "filler words stand here\n" * 5 + "general public license version 3"
    stray = "she came mit.\nLicensed under the Apache License, Version 2.0"  # the word before belongs to no notice
    got = _labels(spark, [bsd, gpl, f"prose\n{gpl}\nprose", apart, stray])
    assert got == {1000: ("bsd", 1.0), 1001: ("gpl-3", 1.0), 1002: ("gpl-3", 1.0), 1003: ("", 0.0), 1004: ("apache-2", 1.0)}


def test_second_notice_in_a_line_stays(spark):
    two = "licensed under cc by nc 4 0 and parts licensed under cc by 4 0 international"
    short = "licensed under cc by nc 4 0 and parts licensed under cc by 4 0"
    one = "licensed under cc by nc 4 0"
    lesser = "licensed under the gnu lesser general public license 3 x licensed under the gnu lesser general public license version 3"
    got = _labels(spark, [two, short, one, lesser, "licensed under the gnu general public license version 3"])
    assert set(got[1000][0].split(",")) >= {"cc-by", "cc-by-nc"} and set(got[1001][0].split(",")) >= {"cc-by", "cc-by-nc"}
    assert got[1002] == ("cc-by-nc", 1.0) and "agpl" not in got[1003][0] and got[1004] == ("gpl-3", 1.0)


def test_chat_levels_have_no_bound(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "range", lambda a, b: range(a, min(b, 3)), raising=False)  # draws in a bound, if there is one
    calls = spark.createDataFrame([(1, f"c{k}", 9 - k, [f"c{k - 1}"] if k else []) for k in range(5)], "conv_id long, call_id string, turn long, after array<string>")
    assert {r.call_id: r.level for r in chat_format.levels(calls, chat_format.Scratch(spark, "levels")).collect()} == {f"c{k}": k for k in range(5)}
