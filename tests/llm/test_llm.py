"""The ten operators against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from conftest import SF, plain
from pyspark.sql import functions as F

from sieveline.llm import byte_cnn, chat, common, decontam, language_id, lm_score, near_dup, pieces, quality, queries, rules, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, word string"


def words(n, seed, vocab=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edge_rows():
    long = words(30_000, 1, 5000)
    near = words(200, 2, 5000).split()
    rows = [
        (1, words(80, 3)), (2, words(80, 3)), (3, words(80, 3).upper()), (4, None), (5, ""), (6, " \t\n\x0b "), (7, "One"), (8, "one"), (9, "one two"), (10, long), (11, long + " end"), (None, words(80, 3)), (None, None),
        (12, " ".join(near)), (13, " ".join(near[:-3] + ["x", "y", "z"])), (14, " ".join(["a", "b"] + near[2:])), (15, words(50, 9)), (15, words(50, 9)), (15, words(60, 10)), (16, words(60, 10)), (17, "\u00a0é\u0301 \U0001f600\x00 ▁ <|im_end|>"),
        (18, "a\nb\na\n\na\n"), (19, "same five words in here " * 6), (20, "12 34 !! ##"),
    ]
    return [(i, t, "en" if i is None or i % 2 else None, "s", 0, 0.5, "fp", "w") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


ALL = queries.QUERIES
SMALL = [n for n in ALL if n in queries.ORACLE]


@pytest.mark.parametrize("name", SMALL)
def test_query_matches_sql(spark, duck, name):
    columns, rows = plain(ALL[name](spark, SF).toPandas())
    want_columns, want = plain(duck.sql(queries.ORACLE[name]).df())
    assert columns == want_columns and rows == want


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in ALL) == list(range(1, 14))


# near duplicates


def brute_components(rows, k, percent):
    sets, ids = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set())
        ids.append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if ids[a] == ids[b] or 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    low = {}
    for x in range(len(rows)):
        if ids[x] is not None:
            low[find(x)] = min(ids[x], low.get(find(x), ids[x]))
    return Counter((ids[x], len(sets[x]), low.get(find(x)) if sets[x] else ids[x]) for x in range(len(rows)))


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(docs, k):
    got = near_dup.near_duplicates(docs, k, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components([(r.doc_id, r.text) for r in docs.collect()], k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_large_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10_000)}" for _ in range(120)]
    rows = []
    for i in range(300):  # copies with a few words changed: linked to some, not to others
        w = list(base)
        for _ in range(rng.choice([0, 2, 5, 9, 14])):
            w[rng.randrange(120)] = f"x{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, 2, 80).collect())
    assert got == brute_components(rows, 2, 80)


def test_blocks_compare_all_pairs():
    chunk = np.array([0, 0, 1, 1, 1, 2, 2])
    first, last = np.array([0] * 5 + [5] * 2), np.array([5] * 5 + [7] * 2)
    start, count = near_dup.partners(first, last, chunk, np.array([False] * 5 + [True] * 2))
    pairs = {(r, s) for r in range(7) for s in range(start[r], start[r] + count[r])}
    assert pairs == {(a, b) for a in (0, 1) for b in (2, 3, 4)} | {(5, 6)}


def test_bayes_prunes_only_the_unlikely():
    least = near_dup.least_matches(0.8)
    for i, m in enumerate(least):
        n = near_dup.BATCH * (i + 1)
        cdf = lambda x, n=n: sum(math.comb(n + 1, j) * 0.8**j * 0.2 ** (n + 1 - j) for j in range(x + 1))
        assert cdf(m) >= near_dup.MISS and (m == 0 or cdf(m - 1) < near_dup.MISS)


def test_near_duplicates_with_hot_classes(docs, monkeypatch):
    whole = Counter(map(tuple, near_dup.near_duplicates(docs, 5, 80).collect()))
    monkeypatch.setattr(near_dup, "HOT", 1)
    monkeypatch.setattr(near_dup, "HOT_CLASSES", 1000)
    assert Counter(map(tuple, near_dup.near_duplicates(docs, 5, 80).collect())) == whole


def test_near_duplicates_empty(empty):
    assert near_dup.near_duplicates(empty).count() == 0


# decontamination


def test_decontamination(docs, spark):
    near = next(r.text for r in docs.collect() if r.doc_id == 12).split()
    items = [(1, " ".join(near[20:60])), (2, "ONE, two!"), (3, None), (4, ""), (5, "..."), (11, " ".join(near[30:40])), (None, " ".join(near[90:100])), (2, "ONE, two!"), (7, "w1")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words long")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.decontaminate(docs, bench).collect())

    def split(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    wins = {(str(i) if i is not None else "null", tuple(w[j : j + 10])) for i, t in items if (w := split(t)) for j in range(max(1, len(w) - 9))}
    want = Counter()
    for r in docs.collect():
        w = split(r.text)
        hit, found = set(), set()
        for i, win in wins:
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found.add(i)
        want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want


def test_words_differ_as_texts_do(spark):
    rng = random.Random(3)
    alphabet = "aAzZ09" + "".join(map(chr, [0xC0, 0xE0, 0xC9, 0xE9, 0xD7, 0xDF, 0xFF, 0x130, 0x131, 0x3A3, 0x3C2, 0x3C3, 0x2160, 0x1E9E, 0xA640, 0xFF21, 0xFF41, 0x10400, 0x10428, 0x1F600])) + " .,\n\x00\x7f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", decontam.words_of(F.col("text")).alias("w")).collect()
    there, back = {}, {}
    for r in got:
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        assert len(want) == len(r.w)
        for x, y in zip(want, r.w):
            assert there.setdefault(x, y) == y and back.setdefault(y, x) == x


def test_decontamination_empty(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, spark.createDataFrame([(1, "a b")], none.schema)).count() == 0


def test_decontamination_is_native(docs, spark):
    plan = decontam.decontaminate(docs, spark.createDataFrame([(1, "w1 w2")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_in_blocks(docs, spark, monkeypatch):
    bench = spark.createDataFrame([(i, words(12, i)) for i in range(3, 12)], "item_id long, text string")
    whole = sorted(map(str, decontam.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 4000)
    assert sorted(map(str, decontam.decontaminate(docs, bench).collect())) == whole


# language model


@pytest.mark.parametrize("order", [1, 2, 3])
def test_stupid_backoff(docs, order):
    rows = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    total = [Counter() for _ in range(order + 1)]
    own = []
    for _, w in rows:
        c = [Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(order + 1)]
        own.append(c)
        for n in range(1, order + 1):
            total[n].update(c[n])
    size = sum(len(w) for _, w in rows)
    want = Counter()
    for (i, w), c in zip(rows, own):
        s = full = unseen = 0.0
        for j in range(len(w)):
            factor, p = 1.0, None
            for n in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if (x := total[n][g] - c[n][g]) > 0:
                    p = factor * x / (max(size - len(w), 1) if n == 1 else total[n - 1][g[:-1]] - c[n - 1][g[:-1]])
                    full += n == order
                    break
                factor *= 0.4
            if p is None:
                p, unseen = factor / (size - len(w) + 1), unseen + 1
            s += math.log(p)
        want[(i, len(w), full, unseen, f"{s:.5f}")] += 1
    got = lm_score.stupid_backoff(docs, order).collect()
    assert Counter((r.doc_id, r.n_words, r.n_full, r.n_unseen, f"{r.log_prob:.5f}") for r in got) == want
    assert all((r.score is None) == (r.n_words == 0) for r in got)


def test_stupid_backoff_in_blocks_and_parts(docs, spark, monkeypatch):
    copies = docs.select("doc_id", "text").where("doc_id < 10")
    df = docs.select("doc_id", "text").unionByName(copies).unionByName(copies)

    def scores():
        return Counter((r.doc_id, r.n_words, r.n_full, r.n_unseen, f"{r.log_prob:.6f}") for r in lm_score.stupid_backoff(df, 3).collect())

    whole = scores()
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(lm_score, "PART_GRAMS", 5000)
    assert scores() == whole


def test_packed_messages():
    rng = np.random.default_rng(4)
    for parts in (1, 3, 1000):
        for n in (1, 5, 3000):
            keys = np.unique(np.append(rng.integers(0, 1 << 64, n, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)))
            back = [lm_score.unpack_keys(lm_score.pack_keys(keys[a:b], p, parts), b - a, p, parts) for p, a, b in lm_score._parts_of(keys, parts)]
            assert (np.concatenate(back) == keys).all()
    for x in ([1], [0, 1 << 40, 7], rng.integers(0, 300, 1000)):
        assert (lm_score.unpack_counts(lm_score.pack_counts(np.array(x))) == np.array(x)).all()


def test_stupid_backoff_empty(empty):
    assert lm_score.stupid_backoff(empty).count() == 0


# chat


def test_escape_round_trip():
    for s in ["<|im_end|>", "<\\|x", "<\\\\|<|", "<<||>", "a<", "", "\\n\n<|"]:
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_windows_keep_all_turns(spark):
    rows = [(c, k, ["system", "user", "assistant"][0 if k == 0 and c % 2 else 1 + k % 2], words(random.Random(c * 31 + k).randrange(120), k), 1) for c in range(12) for k in range(9)]
    rows += [(None, 0, "user", None, 1), (None, None, None, "x", 1), (50, 0, "assistant", "", 1), (51, 0, "assistant", "a<|im_end|>", 1), (51, 0, "assistant", "a<|im_end|>", 1), (52, 0, "user", words(900, 4), 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    wins = chat.format_chats(df, budget=150, history=40)
    got = {r.conv_id: r for r in chat.digest(wins).collect()}
    by = {}
    for c, k, r, t, _ in rows:
        by.setdefault(c, []).append((-1 if k is None else k, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    found = wins.collect()
    assert max(Counter(r.conv_id for r in found).values()) > 2
    assert all(not r.over_budget or r.last_turn - r.first_turn == 1 for r in found)
    assert all(r.tokens <= 150 or r.over_budget for r in found)
    assert any(r.repeated > 0 for r in found)
    assert all(r.text.startswith("<|im_start|>system") for r in found if r.conv_id is not None and r.conv_id % 2 and r.conv_id < 12)


def brute_spans(tokens, system, budget, history):
    """(first, last, history start) of each window, from sums over all turns."""
    sums = [0]
    for t in tokens:
        sums.append(sums[-1] + t)
    out, first = [], 0
    while first < len(tokens):
        kept = tokens[0] if system and first > 0 else 0
        back = first
        while back > (1 if system else 0) and sums[first] - sums[back - 1] <= history:
            back -= 1
        while back < first and kept + sums[first + 1] - sums[back] > budget:
            back += 1
        last = first + 1
        while last < len(tokens) and kept + sums[last + 1] - sums[back] <= budget:
            last += 1
        out.append((first, last, back))
        first = last
    return out


def test_streamed_windows_are_those_of_prefix_sums():
    rng = random.Random(6)
    for _ in range(400):
        budget, history = rng.randrange(1, 60), rng.randrange(0, 40)
        turns = [(rng.choice(["system", "user", "assistant"]), f"t{i}", rng.randrange(1, 25)) for i in range(rng.randrange(1, 30))]
        stream, got = chat.Windows(budget, history), []
        for t in turns:
            got.append(stream.add(*t))
        got = [w for w in [*got, stream.close()] if w]
        system = turns[0][0] == "system"
        want = brute_spans([t[2] for t in turns], system, budget, history)
        assert [(w[1], w[2]) for w in got] == [(a, b) for a, b, _ in want]
        for w, (first, last, back) in zip(got, want):
            use = ([0] if system and first else []) + list(range(back, last))
            assert w[3] == len(use) - (last - first) and w[4] == sum(turns[i][2] for i in use)
            assert [w[6][a:b] for _, a, b in chat.turns_of(w[6])] == [turns[i][1] for i in use]


def test_digest_of_windows_in_any_place(spark):
    rows = [(f"c{c}", k, "assistant" if k % 2 else "user", words(30, c * k)) for c in range(9) for k in range(7)]
    wins = chat.format_chats(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), 60, 20)
    assert sorted(map(tuple, chat.digest(wins.repartition(5)).collect())) == sorted(map(tuple, chat.digest(wins, placed=True).collect()))
    back = sorted((r.conv_id, r.turn, r.role, r.text, r.target) for r in chat.read_windows(wins).collect())
    assert back == sorted((c, k, r, t, t if r == "assistant" else None) for c, k, r, t in rows)


def test_chat_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# classifiers


def test_windows_cover_all_bytes():
    for n in (0, 1, 255, 256, 257, 1000, 5000):
        raw = bytes(i % 250 + 1 for i in range(n))
        for stride in (192, 253, 256):
            w = byte_cnn.cut(raw, stride)
            out = bytearray(len(w) * stride + 256)
            for i, x in enumerate(w):
                out[i * stride : i * stride + 256] = x.tobytes()
            assert bytes(out[:n]) == raw and not any(out[n : (len(w) - 1) * stride + 256])


def test_training_separates_classes():
    rng = np.random.default_rng(0)
    bags = [byte_cnn.cut(bytes(rng.integers(97, 99 + i % 2 * 8, 300, dtype=np.uint8)), 192) for i in range(60)]
    y = np.arange(60) % 2
    for both in (False, True):
        net = byte_cnn.train(bags, y, 2, both=both, epochs=2, least=300)
        p = byte_cnn.predict(net, [b"abababab" * 40, b"ahbgcjdi" * 40], 192)
        assert p[0, 0] > 0.8 and p[1, 1] > 0.8
        raw = [b"abcd" * 3000, b"x", b""]
        assert np.allclose(byte_cnn.predict(net, raw, 192, group=5), byte_cnn.predict(net, raw, 192), atol=1e-4)


def random_net(classes, both, kind=np.float64):
    rng = np.random.default_rng(12)
    net = byte_cnn.start(classes, both, rng)
    made = [np.asarray(x, kind) for x in (net.emb, net.conv, net.bias, net.dense, net.out)]
    made[2] += rng.normal(0, 0.1, made[2].shape)
    made[4] += rng.normal(0, 0.1, made[4].shape)
    return byte_cnn.Net(*made, both)


@pytest.mark.parametrize("both", [False, True])
def test_predictions_are_those_of_plain_loops(both):
    net = random_net(3, both)
    rng = random.Random(2)
    raw = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 200, 256, 257, 900)]
    got = byte_cnn.predict(net, raw, 192)
    for x, p in zip(raw, got):
        feats = []
        at = 0
        while True:
            win = x[at : at + 256].ljust(256, b"\0")
            own = []
            for f in range(len(net.bias)):
                width = byte_cnn.WIDTHS[f // byte_cnn.EACH]
                sums = [sum(net.emb[win[i + j], d] * net.conv[j * byte_cnn.DIM + d, f] for j in range(width) for d in range(byte_cnn.DIM)) for i in range(0, 256 - max(byte_cnn.WIDTHS) + 1)]
                own.append(max(0.0, max(sums) + net.bias[f]))
            feats.append(own)
            if at + 256 >= len(x):
                break
            at += 192
        mean = [sum(c) / len(c) for c in zip(*feats)]
        use = mean + [max(c) for c in zip(*feats)] if both else mean
        z = [sum(u * net.dense[i, k] for i, u in enumerate(use)) + net.out[k] for k in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        assert np.allclose(p, np.array(e) / sum(e), atol=1e-4)


@pytest.mark.parametrize("both", [False, True])
def test_gradients_are_finite_differences(both):
    net = random_net(3, both)
    rng = np.random.default_rng(9)
    win = rng.integers(0, 256, (7, 256)).astype(np.uint8)
    case = (win, np.array([3, 1, 3]), np.array([0, 2, 1]), np.array([1.0, 0.5, 2.0]))
    _, slopes = byte_cnn.gradients(net, *case)
    for q, dq in zip((net.emb, net.conv, net.bias, net.dense, net.out), slopes):
        found = np.flatnonzero(np.abs(dq) > 1e-6)
        for i in rng.choice(found, min(12, len(found)), replace=False):
            keep = q.flat[i]
            q.flat[i] = keep + 1e-6
            up, _ = byte_cnn.gradients(net, *case)
            q.flat[i] = keep - 1e-6
            down, _ = byte_cnn.gradients(net, *case)
            q.flat[i] = keep
            assert (up - down) / 2e-6 == pytest.approx(dq.flat[i], rel=1e-3, abs=1e-7)


def test_samples_are_bounded_and_hold_no_repeats(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("l"), F.concat(F.lit("t"), F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id"))).alias("t"))
    odd = spark.range(3000).select(F.lit(None).cast("long").alias("k"), F.concat(F.lit("x"), "id").alias("l"), F.lit("z").alias("t"))
    df = rows.unionByName(odd)
    rank = common.rank_of("k", "t")
    got = common.smallest(common.share_of(df, "l", rank, 100, 2), "l", rank, "t", 100)
    sizes = Counter(r.label for r in got)
    assert set(sizes) == {"often", "rare"} and all(70 <= n <= 100 for n in sizes.values())
    assert len({(r.label, r.h) for r in got}) == len(got)


def test_language_id(spark, docs, empty):
    got = language_id.predict_languages(docs).collect()
    assert len(got) == docs.count()
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    assert language_id.predict_languages(empty).count() == 0
    real = spark.read.parquet(f"{SF}/documents.parquet")
    pred = language_id.predict_languages(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in pred) >= 0.9 * len(pred)
    changed = real.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("?"))
    again = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_languages(changed).collect()}
    assert all(again[r.doc_id] == (r.lang_pred, r.score) for r in pred)


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 7, 9, 10, 15, 15, 19)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, score int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.score == 0.5 for r in quality.score_quality(docs, labels.where("false")).collect())
    assert quality.score_quality(empty, labels).count() == 0
    sf = SF.replace("sf0.001", "sf0.01")
    real, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = quality.score_quality(real, marks).join(marks, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


# pieces


def test_sampled_segmentations(docs, empty):
    got = pieces.encode(docs, keep=["doc_id", "text", "score"]).collect()
    assert all((r.ids is None) == (r.text is None) and (r.lossless is None or r.lossless) for r in got)
    back = pieces.decode(pieces.encode(docs, keep=["doc_id", "text"]).withColumnRenamed("text", "want"), ["want"]).collect()
    assert all(r.text == r.want for r in back)
    again = pieces.encode(docs.repartition(7), keep=["doc_id", "text"]).collect()
    assert {(r.doc_id, r.text): r.ids for r in again} == {(r.doc_id, r.text): r.ids for r in got}
    assert pieces.encode(docs, seed=2).where(F.size("ids") > 0).select("ids").collect() != pieces.encode(docs, seed=1).where(F.size("ids") > 0).select("ids").collect()
    assert pieces.encode(empty).count() == 0


def test_sampling_follows_the_posterior():
    vocab = pieces.vocabulary()
    lattice = pieces.Lattice(vocab, 1.0)
    text, n = "theory", 20_000
    ids, sizes = lattice.encode([text] * n, list(range(n)))
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - s : e].tolist()) for e, s in zip(ends, sizes))
    weight = {p: (2.0 - max(s, -len(vocab))) ** -1.0 for p, s, byte in vocab if p and not byte and (s > -1e8 or p == pieces.MARK)}
    paths = {}

    def walk(rest, path, w):
        if not rest:
            paths[tuple(path)] = w
        for m in range(1, len(rest) + 1):
            if rest[:m] in weight:
                walk(rest[m:], [*path, rest[:m]], w * weight[rest[:m]])

    walk(pieces.MARK + text, [], 1.0)
    total = sum(paths.values())
    number = {p: i for i, (p, _, byte) in reversed(list(enumerate(vocab))) if not byte}
    for path, w in paths.items():
        assert abs(seen[tuple(number[p] for p in path)] / n - w / total) < 0.02
    processor = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert processor.decode([int(i) for i in ids[: sizes[0]]]) == text


@pytest.mark.parametrize("text", ["of to", "a\n\nof", "té €", "x▁y z", "", " ", "  a", "\n", "\u0e01a"])
def test_sampling_of_several_units(text):
    vocab = pieces.vocabulary()
    lattice = pieces.Lattice(vocab, 1.0)
    weight = {p: (2.0 - max(s, -len(vocab))) ** -1.0 for p, s, byte in vocab if p and not byte and (s > -1e8 or p == pieces.MARK)}
    number = {p: i for i, (p, _, byte) in reversed(list(enumerate(vocab))) if not byte}
    byte_of = {int(p[1:-1], 16): i for i, (p, _, byte) in enumerate(vocab) if byte}

    def paths(rest, at=0):  # all segmentations with their weights; a mark inside a unit is a character like any other
        if at == len(rest):
            return {(): 1.0}
        out = Counter()
        for m in range(1, len(rest) - at + 1):
            p = rest[at : at + m]
            if p in weight and pieces.MARK not in p[at == 0 :]:
                for tail, w in paths(rest, at + m).items():
                    out[(number[p], *tail)] += weight[p] * w
        if rest[at] not in weight or (at and rest[at] == pieces.MARK):
            for tail, w in paths(rest, at + 1).items():
                out[(*(byte_of[b] for b in rest[at].encode()), *tail)] += math.exp(pieces.UNKNOWN) * w
        return out

    spaced = re.findall(r"\n|[^\n]+", "".join(" " + w for w in text.split(" ")))
    found = [u for x in spaced for u in re.findall(r"^ ?[^ ]*| [^ ]*", x) if u]
    want = {(): 1.0}
    for u in found:
        one = paths(pieces.MARK + u[1:] if u[0] == " " else u)
        whole = sum(one.values())
        want = {a + b: x * y / whole for a, x in want.items() for b, y in one.items()}
    n = 20_000
    ids, sizes = lattice.encode([text] * n, [near_dup.mix(np.array([i], np.uint64))[0] for i in range(n)])
    ends = np.cumsum(sizes)
    seen = Counter(tuple(ids[e - m : e].tolist()) for e, m in zip(ends, sizes))
    assert set(seen) <= set(want) and all(abs(seen[k] / n - v) < 0.02 for k, v in want.items())
    assert all(lattice.decode(k) == text for k in want)


def test_long_texts_are_taken_in_slices(monkeypatch):
    lattice = pieces.Lattice(pieces.vocabulary(), 1.0)
    rng = random.Random(8)
    texts = ["".join(rng.choice("the of and é€▁\U0001f600  \n" if i % 3 else "abcdefgh") for _ in range(rng.randrange(400))) for i in range(150)]
    texts += [" " * 300, "\n" * 300, "x" * 300, "x" * 50 + " " + "y" * 50, ""]
    whole = [lattice.encode([t], [i])[0].tolist() for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "GROUP", 60)
    spaced = [i for i, t in enumerate(texts) if max(map(len, t.split(" "))) < 60]
    got = [lattice.encode([t], [i]) for i, t in enumerate(texts)]
    assert all(got[i][0].tolist() == whole[i] for i in spaced) and len(spaced) > 50
    monkeypatch.setattr(pieces, "UNIT", 16)
    alone = [lattice.encode([t], [i])[0] for i, t in enumerate(texts)]
    ids, sizes = lattice.encode(texts, list(range(len(texts))))
    ends = np.cumsum(sizes)
    for t, x, e, m in zip(texts, alone, ends, sizes):
        assert x.tolist() == ids[e - m : e].tolist() and lattice.decodes(x, t)
        assert all(len(p) <= pieces.GROUP for _, p in pieces.slices(t))


# urls


def test_url_filter(spark, monkeypatch):
    pages = [(1, "http://WWW.Example.com/en/a?x#y"), (2, "https://a.example.com/en/b"), (3, "http://x.net/es/"), (4, "http://x.net/es"), (5, None), (6, "no scheme/en/"), (7, "ftp://q.org"), (8, "http://xexample.com/en/"), (9, "http://bad.org/p.html?u=1"), (9, "http://bad.org/p.html?u=1"), (None, "http://www.bad.org/p/"), (10, "http://com/"), (11, "http://a://b/c"), (12, "")]
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in pages], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    listed = spark.createDataFrame([("http://bad.org/p",), (None,), ("http://bad.org/p/",)], "url string")
    got = {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, listed).collect()}
    assert got == {
        (1, "www.example.com"): ("/en/a", "www.example.com/en/", "allow"), (2, "a.example.com"): ("/en/b", "example.com/en/", "block"), (3, "x.net"): ("/es/", "net/es/", "block"), (4, "x.net"): ("/es", None, "allow"), (5, ""): ("", None, "allow"), (6, ""): ("", None, "allow"),
        (7, "q.org"): ("", None, "allow"), (8, "xexample.com"): ("/en/", "com/", "allow"), (9, "bad.org"): ("/p.html", None, "block"), (None, "www.bad.org"): ("/p/", None, "block"), (10, "com"): ("/", "com/", "allow"), (11, "a:"): ("//b/c", None, "allow"), (12, ""): ("", None, "allow"),
    }
    monkeypatch.setattr(url_filter, "MAX_BYTES", 4)  # several filters, one after the other
    assert {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, listed).collect()} == got
    full = url_filter.BlockedBloom(1)
    full.bits[:] = np.uint64((1 << 64) - 1)
    monkeypatch.setattr(url_filter, "build_filter", lambda keys, n: full)  # lets everything pass
    assert {(r.page_id, r.host): (r.path, r.rule, r.verdict) for r in url_filter.judge(df, rules, listed).collect()} == got
    assert url_filter.judge(df, rules.where("false"), listed.where("false")).where("verdict <> 'allow'").count() == 0
    assert url_filter.judge(df.where("false"), rules, listed).count() == 0


def test_bloom_has_no_false_negatives():
    keys = [f"k{i}" for i in range(5000)]
    bloom = url_filter.BlockedBloom(len(keys))
    bloom.add(url_filter.key_hash(keys))
    assert bloom.may_hold(url_filter.key_hash(keys)).all()
    assert bloom.may_hold(url_filter.key_hash([f"o{i}" for i in range(20_000)])).mean() < 0.02


# rules


def test_quality_rules(docs, empty, spark):
    got = Counter(tuple(r)[:8] for r in rules.quality_rules(docs).drop("char_distance", "word_distance").collect())
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        cover = {x for j in range(len(w) - 4) if grams[tuple(w[j : j + 5])] > 1 for x in range(j, j + 5)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        bad = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), bad)] += 1
    assert Counter({k: v for k, v in ((x[:7], n) for x, n in got.items())}) == want
    assert not any(x[6] and x[7] for x in got)
    assert rules.quality_rules(empty).count() == 0


def test_distance():
    a, b = np.array([1.0, 0, 3]), np.array([0, 2.0, 0])
    assert rules.distance(a, b) == pytest.approx(1.0) and rules.distance(a, a * 7) == pytest.approx(0.0) and rules.distance(a, b * 0) == 0


def test_divergence_tells_noise(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(marks, "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in rows if r.quality == 1) >= 0.98 * sum(r.quality for r in rows)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.8 * sum(1 - r.quality for r in rows)


def test_divergence_is_that_of_plain_counts(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(900_001, words(90, 1), "xx"), (900_002, "ÀÉ é € \U0001f600 !!! \t\r\n #*$ 12 " * 30, "en"), (900_003, words(90, 2), None), (900_004, words(49, 3), "en"), (900_005, "", "en")]
    df = real.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    rows = [(r.doc_id, r.text, r.lang) for r in df.collect() if r.text is not None]

    def kind(c):
        if ord(c) > 0x7F:
            return 8 if ord(c) < 0x280 else 9
        return next((i for i, group in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\t\n\x0b\x0c\r", ".,;:?'\"-()", "!"]) if c in group), 7)

    def split(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    def folded(chars):
        out = Counter()
        for c, n in chars.items():
            out["a" if c in (0, 1, 8, 9) else c] += n
        return out

    def far(p, q):
        a, b = sum(p.values()), sum(q.values())
        total = 0.0
        for k in {*p, *q}:
            x, y = p[k] / a, q[k] / b
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
        return math.sqrt(max(0.0, total / 2))

    chars, common_words, sizes, every = {}, {}, Counter(), Counter()
    for _, t, lang in rows:
        sizes[lang] += 1
        own = Counter(map(kind, t))
        every.update(own)
        chars.setdefault(lang, Counter()).update(own)
        common_words.setdefault(lang, Counter()).update(split(t))
    top = {lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[:50]] for lang, c in common_words.items()}
    got = {r.doc_id: r for r in rules.quality_rules(df).collect()}
    seen = 0
    for i, t, lang in rows:
        r, w = got[i], split(t)
        char = word = None
        good = True
        if len(w) >= 50:
            own = Counter(map(kind, t))
            if lang is not None and sizes[lang] >= 20:
                char = far(own, chars[lang])
                class_of = lambda c, lang=lang: Counter({k: n for k, n in c.items() if k in top[lang]}) + Counter({"": sum(n for k, n in c.items() if k not in top[lang])})
                word = far(class_of(Counter(w)), class_of(common_words[lang]))
                good = word <= 0.27 + 1.4 / math.sqrt(len(w))
            else:
                char = far(folded(own), folded(every))
            good = good and char <= 0.24 + 0.8 / math.sqrt(len(t))
            seen += 1
        assert (r.char_distance is None) == (char is None) and (r.word_distance is None) == (word is None)
        assert char is None or r.char_distance == pytest.approx(char, abs=1e-6)
        assert word is None or r.word_distance == pytest.approx(word, abs=1e-6)
        assert r.kept == (good and not r.base_failed)
    assert seen > 100


def prose(i, mark, common=("the", "of", "and", "to", "in"), n=150):
    rng = random.Random(f"{mark}{i}")
    return " ".join(rng.choice(common) + mark if rng.random() < 0.6 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_references_do_not_depend_on_other_languages(spark, monkeypatch):
    few = [(i, prose(i, "q"), "xx") for i in range(25)]  # under a thousandth of the rows below, but enough for a reference
    rare = [(100 + i, "".join(chr(0x430 + ord(c) - 97) if c.isalpha() else c for c in prose(i, "z")), "yy") for i in range(5)]
    odd = [(200, prose(1, "k"), "xx"), (201, "#*$ 12 %& " * 5 + " ".join(f"#{i}$ %{i}* &{i}|" for i in range(60)), None)]
    mine = spark.createDataFrame(few + rare + odd, "doc_id long, text string, lang string")
    text = F.concat_ws(" ", *[F.concat(F.lit(w + " "), F.hex(F.xxhash64("id", F.lit(i)) % 100)) for i, w in enumerate(["el", "la", "los", "de"] * 15)])
    others = spark.range(30_000).select((F.col("id") + 1000).alias("doc_id"), text.alias("text"), F.lit("zz").alias("lang"))

    def verdicts(df):
        return {r.doc_id: r for r in rules.quality_rules(df).where("doc_id < 1000").collect()}

    got = verdicts(mine.unionByName(others))
    alone = verdicts(mine)
    for i in [*range(25), 200]:
        assert (got[i].kept, got[i].char_distance, got[i].word_distance) == (alone[i].kept, alone[i].char_distance, alone[i].word_distance)
    assert all(got[i].kept and got[i].word_distance is not None for i in range(25)) and not got[200].kept
    assert all(got[100 + i].kept and got[100 + i].word_distance is None for i in range(5))  # not failed on other languages' words
    assert not got[201].kept
    monkeypatch.setattr(rules, "BROADCAST_BYTES", 0)  # references in a table joined by language
    assert verdicts(mine) == alone


# warc


def test_warc(spark, tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(warc, "FRAME", 3000)
    big = words(200, 1)
    pages = [(3, "http://a/é b", big), (2, "u", big), (5, None, big), (None, "n", big), (7, "x", None), (8, "x", ""), (9, "x", "short"), (10, "x", "short"), (2, "again", big), (11, "x", "\r\n\r\nWARC/1.1\r\n" * 20), (12, "x", "é\x00\U0001f600" * 5000)]
    df = spark.createDataFrame([(i, u, h, "k") for i, u, h in pages], "page_id long, url string, html string, digest string").repartition(2)
    index = warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(index, f"file://{tmp_path}/w").collect()
    want = Counter()
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min(j for j, _, x in pages if x == h and j is not None)
        other = first if len(raw) >= 100 and i != first else None
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other is not None else "response", other)] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert {(r.page_id, r.file, r.frame, r["at"], r["size"]) for r in got} == {tuple(r) for r in index.collect()}
    one = index.where("page_id = 12").first()
    head, body = warc.fetch(f"file://{tmp_path}/w", one.file, one.frame, one["at"], one["size"])
    assert head["WARC-Type"] == "response" and body.decode() == pages[-1][2]
    raw = (tmp_path / "w" / one.file).read_bytes()
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as r:
        assert r.read().count(b"WARC-Record-ID") == index.where(F.col("file") == one.file).count()
    assert warc.archive_pages(df.where("false")).count() == 0
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)  # repeats beyond a broadcast
    assert Counter(tuple(r)[:5] for r in warc.archive_pages(df).collect()) == want


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = SF.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = None
    kept = [docs.count()]
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns
        assert docs.join(before, columns, "left_anti").count() == 0
        kept.append(docs.count())
        if name == "near_dedup":
            links = brute_components([(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()], 5, 80)
            assert {r.doc_id for r in docs.collect()} == {i for i, _, low in links if i == low}
        if name == "decontaminate":
            hits = decontam.decontaminate(before, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").select("doc_id")
            assert docs.count() == before.count() - hits.distinct().count()
    assert kept[0] >= kept[1] > kept[2] > kept[3] > kept[4] > 0.7 * kept[0]
    last = c.STAGES[-1][1](spark, docs, sf)
    assert last.where("not lossless").count() == 0 and last.count() == docs.count()


def test_pipeline_edge_rows(docs, empty, spark):
    import corpus_pipeline as c

    for df in (docs, empty):
        out = df
        for _, stage in c.STAGES:
            out = stage(spark, out, SF)
        assert out.count() <= df.count()


def test_pipeline_without_labels_or_benchmark(docs, spark, tmp_path):
    import corpus_pipeline as c

    rows = docs.select("doc_id", "text", "lang", "source", "n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = c.run(spark, str(tmp_path))
    assert got.where("not lossless").count() == 0
    links = brute_components([(r.doc_id, r.text) for r in rows.collect()], 5, 80)
    found = {r.doc_id for r in got.collect()}
    assert found <= {i for i, _, low in links if i is None or i == low} and len(found) > 5


def test_pipeline_keeps_one_of_equal_texts(spark):
    import corpus_pipeline as c

    a, b, d = words(60, 1), words(60, 2), words(60, 3)
    near = " ".join(a.split()[:-1] + ["end"])
    rows = [(1, a), (1, a), (2, a), (None, a), (None, a), (None, near), (None, b), (None, b), (3, d), (3, b), (4, None), (5, ""), (None, None), (None, None), (3, d)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, sieve_id string, sieve_score double").repartition(4)
    got = c.unique(spark, df, SF)
    assert got.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, a), (3, d), (3, b), (4, None), (5, ""), (None, None)])
    alone = c.unique(spark, df.where("doc_id is null and text is not null"), SF)
    left = Counter(r.text for r in alone.collect())
    assert left[b] == 1 and left[a] + left[near] == 1 and sum(left.values()) == 2
    assert c.unique(spark, df.limit(0), SF).count() == 0


def test_pipeline_with_clashing_names(docs, spark):
    import corpus_pipeline as c

    df = docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "'a' as sieve_lang", "'b' as sieve_score", "1 as fp", "2 as hit_id", "3 as comp")
    out = df
    for _, stage in c.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == df.columns
    assert out.where("sieve_lang = 'a' and sieve_score = 'b'").count() == out.count() > 0


def test_pipeline_decontaminates_rows_not_ids(spark):
    import corpus_pipeline as c

    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    rows = [(i, t) for i in (None, 1) for t in (leak, words(40, 1), words(40, 1), words(40, 2), None)] + [(2, words(40, 3))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, c.clean(spark, df, SF).collect())) == Counter(r for r in rows if r[1] != leak)


def test_sql_is_duckdb():
    assert duckdb.__version__ and all(isinstance(s, str) for s in queries.ORACLE.values())
