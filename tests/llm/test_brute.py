"""Queries and operators against plain versions of themselves, held-out accuracy, and properties."""

import collections
import datetime
import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from credsieve.llm import bpe, licenses, minhash, pii, registry, sharding, vectors
from credsieve.llm.graph import components
from credsieve.llm.registry import QUERIES

sys.path.insert(0, str(Path(__file__).parent.parent))
import oracle  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


def test_bpe_query(spark, small, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, small).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        want = lib.encode(t, add_special_tokens=False).ids
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'stré _²½İΣσſ́ \x1c\x85\t\n.!<|>12€ŉ"), st.characters(codec="utf-8")), max_size=40), st.booleans())
def test_bpe_words_are_the_librarys(text, special):
    tool = bpe.splitter(WORD)
    text = text + "<|endoftext|>" + text if special else text
    assert [i for ids in tool.ids(tool.words(text)) for i in ids] == tool.lib.encode(text, add_special_tokens=False).ids


def test_language_held_out(spark, small):
    found = QUERIES["op2_language"](spark, small)
    labels = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang")
    rows = found.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_decontamination_query(spark, small, texts):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op4_decontamination"](spark, small).collect()}
    seeds = collections.defaultdict(set)
    for n, w in items.items():
        for k in range(max(1, len(w) - 4)):
            seeds[tuple(w[k : k + 5])].add(n)
    for i, t in texts.items():
        w = words(t)
        near = {n for k in range(len(w) - 4) for n in seeds.get(tuple(w[k : k + 5]), ())}
        assert got[i].n_sharing == len(near)
        # Where an item stands in whole, its coverage is one.
        whole = {n for n in near if f" {' '.join(items[n])} " in f" {' '.join(w)} "}
        assert whole <= set(got[i].item_ids) and got[i].contaminated == bool(got[i].item_ids)


def _plain_tiles(doc, item, size):
    """The definition, step by step: of all longest runs of unmarked words, the first in doc, then in item."""
    free_d, free_i, count = [True] * len(doc), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and doc[d + n] == item[p + n] and free_d[d + n] and free_i[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, p)
        n, d, p = best
        if n < size:
            return len(item) - sum(free_i), count
        free_d[d : d + n] = free_i[p : p + n] = [False] * n
        count += 1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=25), st.integers(1, 5))
def test_tiling_is_greedy_string_tiling(doc, item, size):
    from credsieve.llm.decontamination import tiles
    from credsieve.llm.words import mix

    hashes = mix(np.arange(1, 5, dtype=np.uint64))
    assert tiles(hashes[np.array(doc, int)], hashes[np.array(item, int)], size) == (_plain_tiles(doc, item, size) if item else (0, 0))


def test_tiling_of_repeated_words_takes_little_space(spark):
    import tracemalloc

    from credsieve.llm.decontamination import tiles

    doc, item = np.full(20000, 7, np.uint64), np.full(3000, 7, np.uint64)
    tracemalloc.start()
    assert tiles(doc, item, 5) == (3000, 1)
    assert tracemalloc.get_traced_memory()[1] < 20e6
    tracemalloc.stop()


def test_coverage_is_that_of_plain_tiling(spark, small, texts):
    from credsieve.llm.decontamination import contamination

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    bench = spark.read.parquet(f"{small}/benchmark.parquet").limit(20)
    items = {r.item_id: words(r.text) for r in bench.collect()}
    short = {i: words(t) for i, t in texts.items() if len(t) < 900}
    docs = spark.createDataFrame([(i, texts[i]) for i in short], "doc_id long, text string")
    some = 0
    for r in contamination(docs, bench).collect():
        for i in r["items"]:
            covered, n = _plain_tiles(short[r.doc_id], items[i["item_id"]], min(5, len(items[i["item_id"]])))
            assert (i["coverage"], i["tiles"]) == (covered / len(items[i["item_id"]]), n)
            some += 1
    assert some


def test_license_query(spark, small, texts):
    got = {r.doc_id: r for r in QUERIES["op5_licenses"](spark, small).collect()}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
        hits = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@settings(max_examples=150, deadline=None)
@given(st.integers(0, len(licenses.NOTICES) - 1), st.lists(st.tuples(st.integers(0, 80), st.sampled_from("ei"), st.sampled_from("xyz")), max_size=3))
def test_notices_within_the_errors_are_found(n, edits):
    notice, label = licenses.NOTICES[n]
    scanner, k = licenses.Scanner(licenses.NOTICES), licenses.errors_allowed(notice)
    text = notice
    for at, kind, c in edits[:k]:
        at = min(at, len(text) - 1)
        if text[at] != " ":
            text = text[:at] + (c if kind == "e" else c + text[at]) + text[at + 1 :]
    text = f"before it {text} after it"
    hits = [scanner.confirm(text, m, about) for m, about in scanner.candidates(text) if m == n]
    assert any(h and h[2] <= k for h in hits)


def test_pii_is_linked_valid_and_distinct(spark):
    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10 == 0
    cards = [c for c in (f"4{n:014d}{k}" for n in range(400) for k in range(10)) if luhn(c)]
    ips = [f"10.{n // 256}.{n % 256}.7" for n in range(400)]
    dates = [f"19{n % 100:02d}-{n % 12 + 1:02d}-{n % 28 + 1:02d}" for n in range(400)]
    ssns = [f"{n + 1:03d}-12-{n + 1:04d}" for n in range(400)]
    phones = [f"+1 ({200 + n}) 555-{n:04d}" for n in range(400)]
    rows = [(k, n, f"a {v} b {v}") for k, values in enumerate([cards, ips, dates, ssns, phones]) for n, v in enumerate(values)]
    df = spark.createDataFrame(rows, "kind int, doc_id int, text string")
    got = pii.pseudonymise(df, "k").collect()
    other = {(r.kind, r.doc_id): r.text for r in pii.pseudonymise(df, "other").collect()}
    by_kind = collections.defaultdict(dict)
    for r in got:
        m = re.fullmatch(r"a (.+) b (.+)", r.text)
        assert m and m[1] == m[2]
        by_kind[r.kind][r.doc_id] = m[1]
    for k, values in enumerate([cards, ips, dates, sorted(set(ssns)), phones]):
        assert len(set(by_kind[k].values())) == len({r[2] for r in rows if r[0] == k})
    assert all(luhn(c) and len(c) == 16 and c[0] == "4" for c in by_kind[0].values())
    assert all(all(0 <= int(o) < 256 for o in x.split(".")) for x in by_kind[1].values())
    assert all(np.datetime64(x) for x in by_kind[2].values()) and all(x.startswith("19") for x in by_kind[2].values())
    assert all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", x) for x in by_kind[4].values())
    assert sum(r.text == other[r.kind, r.doc_id] for r in got) < 20


def _plain_pseudonym(key, kind, m):
    """The definition in plain Python: a Feistel network within the format, or m itself where it isn't valid."""
    sha = lambda *parts: hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()

    def feistel(tweak, a, b, mod_a, mod_b):
        for i in range(10):
            if i % 2 == 0:
                a = (a + int(sha(key, tweak, i, b)[:15], 16)) % mod_a
            else:
                b = (b + int(sha(key, tweak, i, a)[:15], 16)) % mod_b
        return a, b

    def digits(tweak, d):
        u = len(d) // 2
        a, b = feistel(f"{tweak}{len(d)}", int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
        return f"{a:0{u}d}{b:0{len(d) - u}d}"

    def fill(form, d):
        d = iter(d)
        return "".join(next(d) if c in "0123456789" else c for c in form)

    luhn = lambda d: sum(x - 9 if x > 9 else x for x in (int(c) * (1 + k % 2) for k, c in enumerate(reversed(d)))) % 10
    only = re.sub("[^0-9]", "", m)
    if kind == "card":
        if luhn(only):
            return m
        body = only[0] + digits("card" + only[0], only[1:-1])
        return fill(m, body + str((10 - luhn(body + "0")) % 10))
    if kind == "ip":
        o = m.split(".")
        if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in o):
            return m
        a, b = feistel("ip", int(o[0]) * 256 + int(o[1]), int(o[2]) * 256 + int(o[3]), 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind == "ssn":
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return m
        a, b = feistel("ssn", (area - 2 if area > 666 else area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        p = a // 99
        return f"{p + 2 if p >= 665 else p + 1:03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "date":
        n = list(map(int, re.findall(r"\d+", m)))
        y, mo, d = n if len(m.split(m[4])[0]) == 4 and m[4] in "-/" else (n[2], n[1], n[0]) if "." in m else (n[2], n[0], n[1])
        try:
            day = datetime.date(y, mo, d)
        except ValueError:
            return m
        if y < 100:
            return m
        first, low = datetime.date(y // 100 * 100, 1, 1), 487 if y // 100 % 4 == 0 else 397
        k = (day - first).days
        a, b = feistel(f"date{first.year}", k // low, k % low, 75 if low == 487 else 92, low)
        new = first + datetime.timedelta(a * low + b)
        return fill(m, new.strftime("%Y%m%d" if re.match(r"\d{4}", m) else "%d%m%Y" if "." in m else "%m%d%Y"))
    if kind == "phone":

        def national(d):
            area, middle, line = int(d[:3]), int(d[3:6]), int(d[6:])
            if area < 200:
                a, b = feistel("phone-area", area * 1000 + middle, line, 200000, 10000)
                return f"{a:06d}{b:04d}"
            if middle < 200:
                a, b = feistel("phone-exchange", (area - 200) * 200 + middle, line, 160000, 10000)
                return f"{a // 200 + 200:03d}{a % 200:03d}{b:04d}"
            a, b = feistel("phone", (area - 200) * 100 + line // 100, (middle - 200) * 100 + line % 100, 80000, 80000)
            return f"{a // 100 + 200:03d}{b // 100 + 200:03d}{a % 100:02d}{b % 100:02d}"

        if len(only) == 10 and not m.startswith("+"):
            return fill(m, national(only))
        if len(only) == 11 and only[0] == "1":
            return fill(m, "1" + national(only[1:]))
        return fill(m, only[:2] + digits("phone+" + only[:2], only[2:]))
    if kind == "iban":
        x = re.sub("[^A-Z0-9]", "", m)
        number = lambda t: int("".join(str(int(c, 36)) for c in t))
        body = x[4:]
        held = re.sub("[^0-9]", "", body)
        if number(body + x[:4]) % 97 != 1 or len(held) < 2:
            return m
        new = fill(body, digits("iban" + x[:2] + re.sub("[0-9]", "0", body), held))
        return fill(m, f"{98 - number(new + x[:2] + '00') % 97:02d}" + re.sub("[^0-9]", "", new))
    name, at, host = m.partition("@")
    u = len(name) // 2
    a, b = name[:u], name[u:]

    def shift(x, stream):
        out = ""
        for i, c in enumerate(x):
            by = int(stream[i * 4 % 64 : i * 4 % 64 + 4], 16) + i
            low, size = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if "0" <= c <= "9" else (0, 0)
            out += chr(low + (ord(c) - low + by) % size) if size else c
        return out

    for i in range(10):
        if i % 2 == 0:
            a = shift(a, sha(key, "mail", len(name), i, b))
        else:
            b = shift(b, sha(key, "mail", len(name), i, a))
    return a + b + at + host


def _plain_text(key, text):
    def kind(m):
        return next(k for k in ("email", "iban", "date", "ip", "ssn", "card", "phone") if (k == "email") == ("@" in m) and re.fullmatch(re.sub(r"\(\?<!\[[^]]*\]\)|\(\?!\[[^]]*\]\)$|\(\?!\\\.\?\[[^]]*\]\)$", "", pii.FORMS[k]), m))

    return re.sub(pii.PATTERN, lambda m: _plain_pseudonym(key, kind(m[0]), m[0]), text)


def test_pii_query_against_a_plain_feistel(spark, small, texts):
    got = {r.doc_id: r for r in QUERIES["op6_pii"](spark, small).collect()}
    assert set(got) == set(texts) and sum(r.n_pii for r in got.values()) > 50
    assert all(got[i].text == _plain_text(pii.DEMO_KEY, t) for i, t in texts.items())


def test_pseudonyms_of_all_forms_against_a_plain_feistel(spark):
    values = ["4111111111111111", "4111 1111 1111 1111", "4111111111111112", "10.0.0.1", "256.1.1.1", "01.2.3.4", "123-45-6789", "666-45-6789", "899-01-0001", "1999-12-31", "2000-02-29", "1900-02-29", "12/31/1999", "31.12.1999", "2024/01/31"]
    values += ["(212) 555-0100", "+1 (112) 555-0100", "+1 212 155 0100", "+44 20 7946 0958", "+4915112345678", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432", "a@b.de", "Ab.C9_d+e@mail.example.org", "x1@y.co"]
    df = spark.createDataFrame([(k, f"see {v} there") for k, v in enumerate(values)], "doc_id long, text string")
    for r in pii.pseudonymise(df, "k").collect():
        assert r.text == _plain_text("k", f"see {values[r.doc_id]} there")


def test_language_query_against_a_plain_reading(spark, small, texts):
    from credsieve.llm import language

    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language.train(docs)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}

    def bucket(c):
        one = (ord(c[0]) * 0x9E3779B1) & 0xFFFFFFFF
        two = ((one ^ ord(c[1])) * 0x85EBCA77) & 0xFFFFFFFF if len(c) > 1 else None
        h = one if len(c) == 1 else two if len(c) == 2 else (((two ^ (two >> 15)) + ord(c[2])) * 0xC2B2AE3D) & 0xFFFFFFFF
        return max(1, (((h ^ (h >> 16)) * 0x27D4EB2F) & 0xFFFFFFFF) >> 16)

    for i in sorted(texts)[:60]:
        t = "".join(c if c.isalpha() else " " for c in texts[i].lower())
        t = f" {t}  "
        found = []
        for k in range(len(t) - 2):
            if t[k] != " ":
                found.append(t[k])
            if t[k : k + 2] != "  ":
                found.append(t[k : k + 2])
            if t[k + 1] != " ":
                found.append(t[k : k + 3])
        logits = sum(model.table[bucket(g)].astype(float) for g in found) / max(1, len(found)) + model.bias
        e = np.exp((logits - logits.max()) / model.temperature)
        chance = e / e.sum()
        assert got[i].lang_pred == (model.languages[int(chance.argmax())] if any(c.isalpha() for c in texts[i]) else "und")
        assert got[i].lang_pred == "und" or abs(got[i].score - chance.max()) < 1e-4


def test_vector_query(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    base = np.array([r.embedding for r in rows])
    rng = np.random.default_rng(1)
    near = base[:60] + rng.normal(scale=0.02, size=(60, base.shape[1]))
    # Cosines all about the threshold, which int8 values leave open.
    loose = [base[k] + rng.normal(size=base.shape[1]) * np.linalg.norm(base[k]) / np.sqrt(base.shape[1]) * f for k in range(60, 90) for f in (0.31, 0.32, 0.33, 0.34)]
    x = np.concatenate([base, near, base[:20], base[:5] * 7, loose])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(comp, np.where(link, comp[None, :], len(x)).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    for group in (4096, 50):  # one tile, and many
        old, vectors.GROUP = vectors.GROUP, group
        got = {r.vec_id: r for r in vectors.near_vectors(df).collect()}
        vectors.GROUP = old
        assert all((got[i].n_links, got[i].component_id) == (link[i].sum(), comp[i]) for i in range(len(x)))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 70), st.integers(0, 10**6))
def test_quantisation_bound_holds(width, seed):
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(30, width)) ** 3
    u /= np.linalg.norm(u, axis=1)[:, None]
    ready = vectors.quantised(u)
    found = {(int(a), int(b)): bool(s) for i, j, sure in vectors._candidates(ready, ready, True, 0.3) for a, b, s in zip(i, j, sure)}
    exact = u @ u.T
    assert {(a, b) for a in range(30) for b in range(a + 1, 30) if exact[a, b] >= 0.3} <= set(found)
    assert all(exact[a, b] >= 0.3 for (a, b), s in found.items() if s)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_sharding_is_minimax(spark, small, texts, shards):
    rows = sharding.shard_documents(spark.read.parquet(f"{small}/documents.parquet"), shards).collect()
    sizes = collections.Counter()
    for t in texts.values():
        sizes[hashlib.sha256(t.encode()).hexdigest()] += len(t.encode()) + 8
    order = [sizes[k] for k in sorted(sizes)]

    def needed(cap):
        n, used = 1, 0
        for s in order:
            n, used = (n + 1, s) if used + s > cap else (n, used + s)
        return n

    low, high = max(order), sum(order)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards else (mid + 1, high)
    per = collections.Counter()
    for r in rows:
        per[r.shard] += r.size
        assert r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
    assert max(per.values()) == low and set(per) <= set(range(shards))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 9))
def test_ranges_find_the_least_capacity(sizes, shards):
    # Ranges of several groups are split until no cut falls within one, as minimax_cuts does.
    parts = {(k, min(k + 8, len(sizes))) for k in range(0, len(sizes), 8)}
    while True:
        named = {f"{a:04d}": (a, z) for a, z in parts}
        r = sharding.Ranges([(n, sum(sizes[a:z]), z - a) for n, (a, z) in named.items()])
        again = r.open(shards)
        if not again:
            break
        for n in again:
            a, z = named[n]
            parts.discard((a, z))
            parts |= {(a, (a + z) // 2), ((a + z) // 2, z)}

    def needed(cap):
        n, used = 1, 0
        for s in sizes:
            if s > cap:
                return 10**9
            n, used = (n + 1, s) if used + s > cap else (n, used + s)
        return n

    assert r.least(shards, False) == min(c for c in range(max(sizes), sum(sizes) + 1) if needed(c) <= shards)


def _sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def _near(sets, percent):
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    by = collections.defaultdict(list)
    for i, s in sorted(sets.items()):
        for x in s:
            by[x].append(i)
    for i, s in sets.items():
        both = collections.Counter(j for x in s for j in by[x] if j > i)
        for j, n in both.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return {i: root(i) for i in sets}


def test_minhash_query(spark, small, texts):
    sets = _sets(texts, 3)
    want = _near(sets, 85)
    for r in QUERIES["op9_minhash"](spark, small).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_finds_a_loose_group_in_chunks(spark):
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(120)]
    texts = {0: " ".join(base)}
    for i in range(1, 260):
        w = list(base)
        for _ in range(rng.integers(1, 4)):
            w[rng.integers(0, 120)] = f"x{rng.integers(0, 10**6)}"
        texts[i] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = _near(_sets(texts, 3), 85)
    old, minhash.CHUNK = minhash.CHUNK, 16
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    minhash.CHUNK = old
    assert got == want


def test_odd_sketch_counts_differing_samples():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**32, minhash.SAMPLES, dtype=np.uint32)
    for off in (0, 5, 20):
        b = a.copy()
        b[:off] += 1
        _, s = minhash.bands_and_sketches(np.stack([a, b]))
        flips = int(np.bitwise_count(s[0] ^ s[1]).sum())
        assert flips <= 2 * off and flips >= (off and off)
    assert minhash.most_flips(0.85) < minhash.BITS / 4 + 10


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = np.random.default_rng(7)
    edges = {"path": [(i, i + 1) for i in range(200)], "star": [(500, i) for i in range(200)], "random": rng.integers(0, 400, (260, 2)).tolist()}[shape]
    got = {r.node: r.root for r in components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "u long, v long")).collect()}
    comp = {i: i for e in edges for i in e}
    for _ in range(len(comp)):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    groups = collections.defaultdict(set)
    for i, r in got.items():
        groups[r].add(i)
    want = collections.defaultdict(set)
    for i, r in comp.items():
        want[r].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_url_query(spark, small):
    assert oracle.compare(QUERIES["op10_url_filters"](spark, small), oracle.connect(small), registry.ORACLE_SQL["op10_url_filters"]) is None


def test_pipeline(spark, small, texts):
    import corpus_pipeline
    from credsieve.llm.decontamination import contaminated, contamination

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, stage(spark, kept, small).cache()
        if name == "near_dedup":
            want = _near(_sets({r.doc_id: r.text for r in before.collect()}, 5), 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if c == i}
        if name == "decontamination":
            held = contamination(before, spark.read.parquet(f"{small}/benchmark.parquet")).where(contaminated(F.col("items")))
            assert kept.count() == before.count() - held.count() and held.count() > 0
    out = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in kept.collect()}
    assert out.where("n_tokens <> size(ids)").count() == 0
