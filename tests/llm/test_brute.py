"""Operators against plain Python on their whole results."""
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import license_scans, media_avi, packing, quality_rules, url_filters

WORDS = [f"w{i}" for i in range(300)]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing_is_the_plain_rule(seed):
    own = random.Random(seed)
    width = own.choice([10, 64, 100])
    lengths = [own.randrange(1, width + 1) for _ in range(200)]
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in range(len(rows)) if free[r] >= lengths[i]]
        if fits:
            least = min(free[r] for r in fits)
            r = [r for r in fits if free[r] == least][-1]  # of equal places the last opened or filled, as a stack
            got = rows[r]
        else:
            rows.append([])
            free.append(width)
            r, got = len(rows) - 1, rows[-1]
        got.append(i)
        free[r] -= lengths[i]
    found = packing.best_fit_decreasing(lengths, width)
    assert sorted(sum(lengths[i] for i in r) for r in found) == sorted(sum(lengths[i] for i in r) for r in rows)
    assert sorted(i for r in found for i in r) == list(range(len(lengths)))


def test_packing_loses_no_document(spark):
    encoded = spark.createDataFrame([(1, []), (2, [5]), (3, None), (None, [7, 8]), (2, [5])], "doc_id long, ids array<int>").repartition(2)
    packed = packing.pack_ids(encoded, 4)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in packing.unpack_documents(packed).collect()) == [("1", []), ("2", [5]), ("2", [5]), ("3", []), ("None", [7, 8])]
    with pytest.raises(Exception, match="65,536"):
        packing.pack_ids(spark.createDataFrame([(1, [70_000])], "doc_id long, ids array<int>")).collect()


def test_trees_in_python_give_the_same_margin_and_rank_held_out_urls(spark):
    own = random.Random(5)

    def url(bad):
        host = own.choice(["shop", "news", "blog"]) + str(own.randrange(50)) + own.choice([".com", ".org", ".net"])
        path = "/".join(own.choice(["a", "list", "item", "page"]) for _ in range(own.randrange(1, 3)))
        return f"http://{host}/{path}" + (f"/{own.randrange(10**9)}?id={own.randrange(10**6)}&ref={own.randrange(10**6)}" if bad else "")

    made = [(url(i % 2 if own.random() < 0.95 else 1 - i % 2), i % 2) for i in range(1200)]
    model = url_filters.fit(spark.createDataFrame(made[:800], "url string, blocked int"))
    held = spark.createDataFrame(made[800:], "url string, blocked int")
    host, path = url_filters.host_and_path(F.col("url"))
    rows = held.withColumns({"h": host, "p": path})
    features = model.features(F.col("url"), F.col("h"), F.col("p"))
    out = rows.select("url", "blocked", F.array(*features).alias("x"), model.margin(features).alias("m")).collect()

    def entropy(u):
        return -sum(n / len(u) * math.log2(n / len(u)) for n in collections.Counter(u).values())

    def walk(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for r in out:
        u, x = r["url"], r["x"]
        h, _, p = u.split("://")[1].partition("/")
        p = "/" + p.split("?")[0]
        want = [len(u), p.count("/"), sum(map(str.isdigit, u)) / len(u), entropy(u), u.count("="), h.count("-"), h.count(".")]
        assert np.allclose(x[:7], want, atol=1e-6)
        assert math.isclose(r["m"], model.base + sum(walk(t, x) for t in model.trees), abs_tol=1e-6)
    bad, good = ([r["m"] for r in out if r["blocked"] == k] for k in (1, 0))
    area = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    assert model.trees and area >= 0.9


def test_quality_against_plain_python(spark):
    own = random.Random(8)
    texts = []
    for i in range(120):
        w = [own.choice(quality_rules.COMMON["en"]) if own.random() < 0.2 else own.choice(["Lorem", "ipsum", "dolor7", "sit|", "a#b", "été", "x"]) + str(own.randrange(30)) for _ in range(own.choice([3, 12, 60, 150, 1200]))]
        texts.append(own.choice([" ", "  ", "\n", "\t"]).join(w))
    texts += [None, "", "| # |" * 100, " ".join(["so"] * 80), "one line here\none line here\n\none line here", " ".join(f"##{i}||" for i in range(90))]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    rows = {r["doc_id"]: r for r in quality_rules.judged(docs).collect()}
    every = [w for ws in quality_rules.COMMON.values() for w in ws]

    def base(t):
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = collections.Counter(grams)
        again = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(5)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(again)

    def histograms(t):
        close = "".join(words(t))
        kinds = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[#*$%&|<>]", r"[^\W_]"]
        count = [len(re.findall(k, close)) for k in kinds[:4]]
        ascii_rest = len(re.findall(r"[\x21-\x7E]", close)) - sum(count)
        wide = len(close) - sum(count) - ascii_rest
        w = words(t)
        common = [w.count(x) for x in every]
        return [*count, ascii_rest, wide, len(t or "") - len(close)], [*common, sum(x not in every for x in w)]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x > 0)
        return math.sqrt(max(0.0, (part(p) + part(q)) / 2))

    failed = {}
    for i, t in enumerate(texts):
        want = base(t)
        got = rows[i]
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == want
        failed[i] = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert got["base_failed"] == failed[i]
    known = {lang: [np.sum([histograms(t)[k] for i, t in enumerate(texts) if i % 2 == lang and not failed[i]], axis=0) for k in (0, 1)] for lang in (0, 1)}
    told = 0
    for i, t in enumerate(texts):
        n, chars, *_ = base(t)
        d = [distance(h, q) for h, q in zip(histograms(t), known[i % 2])]
        for x, name in zip(d, ("char_distance", "word_distance")):
            assert (x is None) == (rows[i][name] is None) and (x is None or math.isclose(x, rows[i][name], abs_tol=2e-6))
        far = n >= quality_rules.GUARD_WORDS and chars >= quality_rules.GUARD_CHARS and (d[0] > quality_rules.CHAR_LIMIT or d[1] > quality_rules.WORD_LIMIT + quality_rules.WORD_SPREAD / math.sqrt(n))
        assert rows[i]["kept"] == (not failed[i] and not far)
        told += far and not failed[i]
    assert told


def test_shots_against_plain_python():
    own = random.Random(9)
    for n in (1, 3, 40):
        payload = media_avi.pad(b"".join(bytes(own.choices(own.choice([b"abc ", b"xyz", bytes(range(256))]), k=3000)) for _ in range(n)))
        back, pixels = media_avi.decode(media_avi.encode(payload))
        assert back == payload
        cuts, seen = [0], []
        for i in range(1, len(pixels)):
            a, b = ([int(v) >> 4 for v in pixels[j].ravel()] for j in (i - 1, i))
            d = sum(abs(a.count(k) - b.count(k)) for k in range(media_avi.BINS)) / (2 * len(a))
            mean = sum(seen) / len(seen) if seen else 0.0
            spread = math.sqrt(max(0.0, sum(x * x for x in seen) / len(seen) - mean * mean)) if seen else 0.0
            if d > max(media_avi.FLOOR, mean + 3 * spread):
                cuts.append(i)
                seen = []
            else:
                seen.append(d)
        assert media_avi.clips(pixels) == list(zip(cuts, [*cuts[1:], len(pixels)]))


def test_frames_decode_by_a_library_independent_of_the_codec():
    """The payload's bytes are the coefficients: a frame's blocks, transformed back by the plain cosine sum, are its pixels."""
    payload = media_avi.pad(hashlib.sha256(b"x").digest() * 32)
    _, pixels = media_avi.decode(media_avi.encode(payload))
    block = list(payload[:64])
    coefficients = [[0.0] * 8 for _ in range(8)]
    for k, z in enumerate(media_avi.ZIGZAG):
        v = block[k]
        coefficients[z // 8][z % 8] = v if v >= 128 else v - 255
    for y, x in ((0, 0), (3, 5), (7, 7)):
        s = sum((math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1) * coefficients[v][u] * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16) for v in range(8) for u in range(8)) / 4
        assert abs(int(pixels[0][0][y * 8 + x]) - min(255, max(0, math.floor(s + 0.5) + 128))) <= 1


def test_licenses_against_containment_of_edited_templates(spark):
    own = random.Random(10)
    texts, want = [], []
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    known = {k: shingles(license_scans._python_words(t)) for k, t in license_scans.TEMPLATES.items()}
    for name, t in license_scans.TEMPLATES.items():
        for edits in (0, 1, 1, 2):
            w = license_scans._python_words(t)
            for p in own.sample(range(len(w)), min(edits, len(w) // 12)):
                w[p] = "changed"
            texts.append(" ".join([*own.choices(WORDS, k=own.randrange(40)), *w, *own.choices(WORDS, k=own.randrange(40))]))
            here = shingles(texts[-1].split())
            want.append({k for k, s in known.items() if len(s & here) >= license_scans.CONTAINMENT * len(s)})
            assert name in want[-1] or edits
    texts += [None, "", " ".join(own.choices(WORDS, k=500))]
    want += [set(), set(), set()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: {x["template"] for x in r["licenses"]} for r in license_scans.scanned(docs).collect()}
    assert all(got[i] <= w for i, w in enumerate(want))
    assert sum(len(got[i]) for i in got) >= 0.97 * sum(map(len, want))
    with pytest.raises(ValueError, match="fewer than"):
        license_scans.scanned(docs, {"MIT": "MIT License"})
