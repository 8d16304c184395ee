"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidelake.llm import decontaminate, katz, langid, line_dedup, media, mixing, repeats, secrets, simhash, toxicity

LICENSE = "Licensed under the Foo Licence, version 2.0; see the file."
LONG = " ".join(f"w{i * i % 997}" for i in range(3000))
TEXTS = [
    (0, None, "a"), (1, "", "b"), (2, "\n\n \t", None), (3, f"one\n {LICENSE}\ntwo", "a"), (4, f"{LICENSE.upper()}\nx", "a"), (5, f"{LICENSE}\n{LICENSE}", "b"),
    (6, f"y\n{LICENSE} ", "b"), (7, LICENSE, "c"), (8, LONG, "c"), (9, LONG + " end", "a"), (10, "É à la Ünïcode ÀÉ and 日本語 text", "a"), (11, "É à la Ünïcode ÀÉ and 日本語 text", "d"),
    (12, LONG[:400] + " a new middle " + LONG[400:900], "a"), (13, "token=abc secret: 'hunter22' AKIA" + "Q" * 16 + " " + "0f" * 13, "a"), (14, "token:token:abcdefgh password==secret1", None),
    (15, "the same words again and again " * 40, "a"), (16, "x", "b"), (-3, LICENSE + "\r\nz", "b"),
]
SCHEMA = "doc_id long, text string, source string, row string, key string, n_words string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "r", "k", "n") for i, t, s in TEXTS], SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    rows = df.collect()
    assert len(rows) == len({r["doc_id"] for r in rows})
    return {r["doc_id"]: r for r in rows}


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def low(s: str) -> str:
    return s.translate({i: i + 32 for i in range(65, 91)})


def words(s: str | None) -> list[str]:
    return re.findall("[^\x20\x09-\x0d]+", low(s or ""))


def test_lines(docs, nothing):
    strip = lambda x: low(x.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t, _ in TEXTS:
        for x in (t or "").split("\n"):
            holders[strip(x)].add(i)
    gone = {k: max(d) for k, d in holders.items() if len(k) >= 40 and len(d) >= 5}
    assert gone
    got = by_id(line_dedup.query(docs))
    for i, t, _ in TEXTS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(strip(x), i) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    assert line_dedup.query(nothing).count() == 0
    assert line_dedup.dedup_lines(docs).columns[: len(docs.columns)] == docs.columns


def test_repeated_rows_are_one_document(spark):
    twice = spark.createDataFrame([(i, LICENSE) for i in (1, 2, 3, 4, 4, 4)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in line_dedup.query(twice).collect()) == [0] * 6


def test_secrets(docs, nothing):
    assign = re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
    rules = [("assign", assign, lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    got = by_id(secrets.query(docs))
    for i, t, _ in TEXTS:
        found = sorted((m.start(), k, f"{n}:{m.start()}:{m.end()}") for k, (n, p, ok) in enumerate(rules) for m in p.finditer(t or "") if ok(m))
        counts = Counter(k for _, k, _ in found)
        assert [got[i][f"n_{n}"] for n, _, _ in rules] == [counts[k] for k in range(3)], i
        assert got[i]["base_sha256"] == sha(",".join(s for _, _, s in found).encode())
    assert got[13]["n_access"] == 1 and got[14]["n_assign"] == 1 and secrets.query(nothing).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    v = lambda *rows: spark.createDataFrame(rows, "path string, text string")
    _, ledger = secrets.update_ledger(v(("a", "token=abcdefgh"), ("b", "token=abcdefgh"), ("c", "nothing")))
    assert ledger.count() == 2
    marked = ledger.withColumn("spans", ledger["spans"])  # as it was
    _, after = secrets.update_ledger(v(("d", "token=abcdefgh"), ("e", "secret=zzzzzzzz")), marked)
    assert after.count() == 3
    _, newer = secrets.update_ledger(v(("a", "nothing")), after, rule_version="2")
    assert newer.where("rule_version = '2'").count() == 1
    found = secrets.scan_secrets(v(("x", "secret=zzzzzzzz"), ("y", None)), after).collect()
    assert sorted(len(r["secret_spans"]) for r in found) == [0, 1]


def test_benchmark(spark, docs, nothing):
    items = [(1, "the same words again and again the same words again"), (2, "Ünïcode àé"), (3, None), (4, "..."), (None, "la Ünïcode ÀÉ and"), (5, LONG[900:2000]), (5, "x"), (6, "w0, W1; w4 w9 w16 w25 w36 w49 w64")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t or ""))
        for a in range(max(1, len(w) - 7)) if w else ():
            windows[tuple(w[a : a + 8])].add("" if i is None else str(i))
    for block_bytes in (1 << 20, 300):
        found = by_id(decontaminate.decontaminate(docs, tests, block_bytes=block_bytes))
        for i, t, _ in TEXTS:
            w = pattern.findall(low(t or ""))
            hit, names = set(), set()
            for key, owners in windows.items():
                for a in range(len(w) - len(key) + 1):
                    if tuple(w[a : a + len(key)]) == key:
                        hit |= set(range(a, a + len(key)))
                        names |= owners
            r = found[i]
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (len(w), len(hit), sorted(names), len(names) >= 2), (i, block_bytes)
    assert decontaminate.query(nothing, tests).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.query(docs, tests.limit(0)).collect())


def test_repeats(docs, nothing):
    seen, got = {}, by_id(repeats.query(docs))
    for i, t, _ in sorted(TEXTS):
        b = (t or "").encode()
        own = {b[k : k + 50] for k in range(len(b) - 49)}
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if b[k : k + 50] in seen:
                gone[k : k + 50] = True
        seen |= dict.fromkeys(own)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), gone.sum(), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())), i
    assert repeats.query(nothing).count() == 0


def test_index_on_random_strings():
    rng = np.random.default_rng(0)
    base = [bytes(rng.integers(97, 99, 72).tolist()) for _ in range(5)]
    strings = list({base[rng.integers(5)][a : a + rng.integers(50, 73 - a)] for a in rng.integers(0, 20, 80)})
    docs = rng.integers(0, 50, len(strings))
    got = repeats.earlier(strings, docs)
    for s, row in zip(strings, got, strict=True):
        for k in range(len(s) - 49):
            assert row[k] == min(d for t, d in zip(strings, docs, strict=True) if s[k : k + 50] in t)


def test_simhash(spark, docs, nothing):
    def plain(t):
        w = words(t)
        h = [int.from_bytes(__import__("xxhash").xxh64_digest(" ".join(w[i : i + 4]).encode(), 42), "big") for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: plain(t) for i, t, _ in TEXTS}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    got = by_id(simhash.query(docs))
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert simhash.query(nothing).count() == 0
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert 8 in kept and not kept & {9, 11} and {12, 13, 14, 15, 16} <= kept


def test_keys_miss_nothing():
    rng = np.random.default_rng(5)
    p = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in p], np.uint64)
    both = np.concatenate([p, p ^ flips])
    keys, row, base = simhash.golay_keys(both)
    order = np.argsort(keys, kind="stable")
    found = set(zip(*[x.tolist() for x in simhash.linked(keys[order], both[row[order]], base[order])], strict=True))
    assert all((min(a, b), max(a, b)) in found for a, b in zip(p.tolist(), (p ^ flips).tolist(), strict=True))


def test_large_groups_are_walked():
    rng = np.random.default_rng(6)
    center = np.uint64(0x0123456789ABCDEF)
    near = np.unique(np.array([center ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))], np.uint64))
    x, y = simhash.linked(np.zeros(len(near), np.uint64), near, np.ones(len(near), bool))
    a, b = simhash.forest(x, y)
    assert len(a) == len(near) - 1 and set(b.tolist()) == {int(near.min())}


def test_mixing(docs, nothing):
    mixed, slots = mixing.mix_sources(docs)
    got = by_id(mixed.select("doc_id", "size", "source", "source_size", "target", "taken"))
    sizes = Counter()
    for i, t, s in TEXTS:
        assert got[i]["size"] == len(words(t))
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, total = set(order), {}, 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    for r in got.values():
        assert math.isclose(r["target"], target[r["source"]], abs_tol=1e-6) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
    for s in order:
        assert abs(sum(r["taken"] for r in got.values() if r["source"] == s) - target[s]) <= mixing.BLOCK
    again = by_id(mixing.query(docs))
    assert all(again[i]["taken"] == r["taken"] for i, r in got.items())
    assert mixing.query(nothing).count() == 0 and slots.groupBy("source", "slot").count().where("count > 1").isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutations(n):
    assert sorted(mixing.permute(np.arange(n), n, 12345).tolist()) == list(range(n))


def test_katz(docs, nothing):
    tokens = {i: [*words(t), "\0end"] for i, t, _ in TEXTS}
    train = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2}
    one, two = Counter(), Counter()
    for i in train:
        one.update(tokens[i])
        two.update(zip(["\0start", *tokens[i]], tokens[i], strict=False))

    def discount(counts):
        n = np.array([0.0] + [sum(c == r for c in counts.values()) for r in range(1, 7)])
        d = katz.discounts(n)
        return lambda c: d[c] if c <= katz.K else 1.0

    d1, d2, total = discount(one), discount(two), sum(one.values())
    freed = 1 - sum(d1(c) * c for c in one.values()) / total
    unseen = freed if freed > 1e-12 else 1 / (total + 1)
    lower = lambda w: d1(one[w]) * one[w] / total * (1 - unseen) / (1 - freed) if w in one else unseen
    after = defaultdict(dict)
    for (v, w), c in two.items():
        after[v][w] = c

    def p(v, w):
        if v not in after:
            return lower(w)
        n = sum(after[v].values())
        free = 1 - sum(d2(c) * c for c in after[v].values()) / n
        left = free if free > 1e-12 else 1 / (n + 1)
        if w in after[v]:
            return d2(after[v][w]) * after[v][w] / n * (1 - left) / (1 - free)
        return left * lower(w) / (1 - sum(map(lower, after[v])))

    for v in ("\0start", "x", "again"):
        assert math.isclose(sum(p(v, w) for w in one) + p(v, "never"), 1, rel_tol=1e-9)
    got = by_id(katz.query(docs))
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i not in train, len(ws), sum(w in one for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(v, w)) for v, w in zip(["\0start", *ws], ws, strict=False)), rel_tol=1e-7)
    assert katz.query(nothing).count() == 0


def test_media(docs, nothing):
    got = by_id(media.query(docs))
    for i, t, _ in TEXTS:
        b = (t or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), len(p), sha(p), zlib.crc32(p[-64:]))
    assert got[10]["media_sha256"] == got[11]["media_sha256"] and got[10]["feature"] == got[11]["feature"]
    stored = media.store_texts(docs)
    clips = media.clips(stored).where("id = 8").orderBy("clip").collect()
    assert clips[0]["first_frame"] == 0 and sum(c["n_frames"] for c in clips) == -(-len(LONG) // 1024)
    assert media.clips(docs.selectExpr("doc_id AS id", "cast('junk' as binary) AS media")).where("clip <> -1").isEmpty()
    assert media.query(nothing).count() == 0


def test_frames_come_back_and_shots_are_found():
    rng = np.random.default_rng(2)
    dark, light = rng.integers(0, 60, 1024 * 6, dtype=np.uint8), rng.integers(180, 256, 1024 * 5, dtype=np.uint8)
    payload = dark.tobytes() + light.tobytes()
    (file,) = media.encode([payload])
    ((frames, n, micros),) = media.decode_frames([file])
    assert frames.tobytes()[:n] == payload and media.cuts(frames).tolist() == [0, 6] and micros == 40000


def test_language(spark, docs, nothing):
    vowels = {"it": "la casa bella era piena di gente allegra ", "de": "der hund und die katze schlafen im garten "}
    rows = [(i, vowels[k] * (3 + i % 4), k) for i in range(60) for k in (("it", "de")[i % 2],)] + [(90, None, "it"), (91, "123 !!", "de"), (92, "die katze", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(langid.query(table))
    assert all(got[i]["lang_pred"] == ("it", "de")[i % 2] and 0.5 < got[i]["score"] <= 1 for i in range(60))
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and got[92]["lang_pred"] == "de"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert langid.query(nothing.selectExpr("*", "source AS lang")).count() == 0
    assert {r["lang_pred"] for r in langid.query(table.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


def test_code_lengths_are_exact():
    counts = Counter()
    text = b"abracadabra abracadabra"
    full = langid.START + text
    for i in range(len(text)):
        counts[int.from_bytes(full[i : i + langid.ORDER + 1], "big")] += 1
    model = langid.build([("x", k, n) for k, n in counts.items()])

    def bits(context: bytes, byte: int) -> float:
        seen = Counter()
        for k, n in counts.items():
            s = k.to_bytes(langid.ORDER + 1, "big")
            if s[:-1].endswith(context):
                seen[s[-1]] += n
        total, kinds = sum(seen.values()), len(seen)
        if byte in seen:
            return -math.log2(seen[byte] / (total + kinds))
        escape = -math.log2(kinds / (total + kinds)) if total else 0.0
        return escape + (bits(context[1:], byte) if context else 8.0)

    for t in (b"abra", b"cadaver xyz", b"\xff"):
        whole = langid.START + t
        want = sum(bits(whole[i : i + langid.ORDER], whole[i + langid.ORDER]) for i in range(len(t)))
        assert math.isclose(langid.code_lengths(model, [t])[0, 0], want, rel_tol=1e-5)


def test_segments_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        s = rng.integers(-5, 5, rng.integers(1, 25)).astype(float)

        def split(a: int, b: int) -> list:
            best = max(((s[i:j].sum(), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, i, j = best
            return [*split(a, i), (i, j), *split(j, b)]

        got = toxicity.segments(s)
        assert sorted(x[2] for x in got) == sorted(s[i:j].sum() for i, j in split(0, len(s)))


def test_toxicity(spark, nothing):
    rng = np.random.default_rng(8)
    text = lambda bad: " ".join(rng.permutation([*[f"word{int(k)}" for k in rng.integers(0, 50, 40)], *["vilething"] * (3 * bad)]))
    rows = [(i, text(i % 3 == 0)) for i in range(600)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = by_id(toxicity.query(docs, labels))
    held = [i for i in range(600) if got[i]["held_out"]]
    assert len(held) > 80 and all(got[i]["predicted"] == int(i % 3 == 0) for i in held)
    assert got[1000]["predicted"] == 0 and 0 <= got[1001]["score"] <= 1
    assert toxicity.query(nothing, labels.limit(0)).count() == 0
